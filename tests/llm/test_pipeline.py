import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

import corpus_pipeline
from lexiforge.llm import decontam, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SF = "/root/testdata/sf0.001"


def deduplicated(docs):
    """The smallest doc_id of every group of documents whose fingerprints link."""
    prints = []
    for _, text, _ in docs:
        w = WORDS.findall((text or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                group = [group[j] if g == group[i] else g for g in group]
    return {min(docs[i][0] for i in range(len(docs)) if group[i] == g) for g in set(group)}


def copies_in_order(docs):
    """What the curriculum takes of docs(doc_id, text, source), a document at a time."""
    size = {d: len(WORDS.findall(text or "")) for d, text, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(size[d] for d, _, x in docs if x == s) for s in sources}
    target, left, full = {}, sum(size.values()), set()
    while len(full) < len(sources):
        level = (left - sum(3 * total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        above = {s for s in sources if s not in full and 3 * total[s] < level * weight[s]}
        full |= above
        if not above:
            break
    for s in sources:
        target[s] = 3 * total[s] if s in full else level * weight[s]
    copies = []
    for s in sources:
        a, before = {1: 1.5, 2: 1.0, 3: 0.5}[weight[s]], 0
        for d in sorted((d for d, _, x in docs if x == s), key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
            for epoch in range(3):
                u = (epoch * total[s] + before + size[d] / 2) / target[s]
                if u < 1:
                    copies.append((u if a == 1 else 2 * u / (a + math.sqrt(a * a + 4 * (1 - a) * u)), d))
            before += size[d]
    return [d for _, d in sorted(copies)]


def test_pipeline(spark):
    """The two fitted stages by the ids that their operators decide on, the other three by plain Python."""
    from tokenizers import Tokenizer

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = read("documents")
    toxic = {r.doc_id for r in toxicity.graded(spark, docs, read("labels")).filter("toxicity.toxic").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id not in toxic]
    kept = deduplicated(rows)
    held = {r.doc_id for r in decontam.contaminated(spark, docs, read("benchmark")).collect()}
    rows = [r for r in rows if r[0] in kept - held]
    text = {d: t or "" for d, t, _ in rows}
    tokenizer, want, ahead = Tokenizer.from_file(corpus_pipeline.tokenizer_path()), [], 0
    for d in copies_in_order(rows):
        ids = [*tokenizer.encode(text[d], add_special_tokens=False).ids, 2]
        want.append((d, ahead, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ahead += len(ids)
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert toxic and held and len(kept) < docs.count() and got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
