"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give
equal chunks wherever they stand. Each different chunk is stored once, in the pack of the task
that has its first occurrence; a document is a recipe of chunk places. Digests of chunks are
the leaves of one Merkle tree per document and one per pack, and reading verifies both.

Folder layout::

    packs/*.ids      chunks' ids, little-endian, 2 bytes each if the vocabulary fits, else 4
    manifest/        Parquet: pack, root (hex Merkle root over its chunks' digests), sizes (ids of each chunk in turn)
    recipes/         Parquet, in the store's order: doc_id, start, n_tokens, root, chunks[pack, at, n]
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.llm.common import Workspace, filesystem, hot_join, split_words, steps

END_ID = 2
#: Chunks have LEAST to MOST ids, MASK + LEAST or so on average (a document's last may be shorter).
LEAST, MOST, MASK = 128, 4096, 1023
REACH = 16
DIGEST = 16
#: Words whose ids a Python worker remembers.
MEMO = 400_000


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The tokenizer never joins across ASCII white space, so each different word is encoded once
    per worker and remembered. Where the tokenizer's normalising lower-cases, words of plain letters, lower-cased
    and without the punctuation behind them, need none of it and go through its model in bulk; any
    other word goes through the tokenizer as it is. Tokenizers of another kind take whole texts.
    """

    #: Normalising that leaves lower-case letters and ASCII punctuation as they are, beside white space.
    KNOWN = ("NFC", "Replace", "Lowercase")

    PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
    TAILED = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,!?;:#$%&*()]+$"

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"].get("end_of_word_suffix") or ""
        kinds = [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        normalizer = spec.get("normalizer") or {}
        rules = normalizer.get("normalizers", [normalizer] if normalizer else [])
        known = all(r.get("type") in self.KNOWN and (r["type"] != "Replace" or r.get("pattern") == {"Regex": "\\s+"}) for r in rules)
        lowers = any(r.get("type") == "Lowercase" for r in rules)
        self.by_word = bool(self.end) and kinds == ["Split", "ByteLevel"] and known and lowers
        if self.by_word:
            cut = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
            level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [cut, level]}, "added_tokens": []}
            self.bulk = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(self.end)]] = True
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        base = len(self.start)
        self.at.update(zip(words, range(base, base + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, ids])

    def _places(self, words: pa.Array, plain: bool) -> np.ndarray:
        """Where the words' ids are remembered."""
        listed = words.to_pylist()
        new = [w for w in listed if w not in self.at]
        if new and plain:
            got = self.bulk.encode_batch_fast(["\n".join(new[i : i + 256]) for i in range(0, len(new), 256)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
            stops = np.flatnonzero(self.ends[ids])
            n = np.diff(stops, prepend=-1)
            if len(n) != len(new):
                raise ValueError("a word's ids don't end where the word does")
            self._add(new, ids, n)
        elif new:
            got = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(new, add_special_tokens=False)]
            self._add(new, np.concatenate(got), np.array([len(x) for x in got], np.int64))
        return np.array([self.at[w] for w in listed], np.int64)

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        if not self.by_word:
            got = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(values.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)
        if len(self.at) > MEMO:
            self.clear()
        flat, counts = split_words(values, lower=False)
        coded = flat.dictionary_encode()
        words = coded.dictionary
        of = coded.indices.to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(words, self.PLAIN).to_numpy(zero_copy_only=False)
        tailed = pc.match_substring_regex(words, self.TAILED).to_numpy(zero_copy_only=False)
        other = ~(plain | tailed)
        head, tail = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        if (plain | tailed).any():
            simple = words.filter(pa.array(plain | tailed))
            cores = pc.utf8_lower(pc.utf8_rtrim(simple, ".,!?;:#$%&*()")).dictionary_encode()
            head[plain | tailed] = self._places(cores.dictionary, True)[cores.indices.to_numpy(zero_copy_only=False)]
        if tailed.any():
            ends = pc.replace_substring_regex(words.filter(pa.array(tailed)), "^[^.,!?;:#$%&*()]+", "").dictionary_encode()
            tail[tailed] = self._places(ends.dictionary, False)[ends.indices.to_numpy(zero_copy_only=False)]
        if other.any():
            head[other] = self._places(words.filter(pa.array(other)), False)
        pairs = np.stack([head[of], tail[of]], 1).ravel()
        pairs_of_text = np.repeat(np.arange(len(counts)), 2 * counts)
        keep = pairs >= 0
        place, text = pairs[keep], pairs_of_text[keep]
        n = self.n[place]
        where = np.repeat(self.start[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.ids[where], np.bincount(text, weights=n, minlength=len(counts)).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_width(spark: SparkSession, path: str) -> int:
    """Bytes that an id takes in the store. A worker loads the tokenizer for it, so the driver never holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoder(path).width])], ["width"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "width long").first()["width"]


def boundaries(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all documents, and how many chunks each document has.

    A chunk ends behind an id at which the rolling hash over the last REACH ids of the document
    has MASK's bits clear, but not before LEAST ids and always at MOST or the document's end.
    """
    gear = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    gear ^= gear >> np.uint64(29)
    gear *= np.uint64(0xBF58476D1CE4E5B9)
    rolled = gear >> np.uint64(40)
    h = rolled.copy()
    for k in range(1, REACH):
        h[k:] = h[k:] + (rolled[:-k] << np.uint64(k))
    marks = np.flatnonzero((h >> np.uint64(8)) & np.uint64(MASK) == 0) + 1
    ends, per = [], np.zeros(len(counts), np.int64)
    stop = np.cumsum(counts)
    lo = np.searchsorted(marks, stop - counts + REACH, "left").tolist()
    hi = np.searchsorted(marks, stop, "left").tolist()
    for d, (a, b, i, j) in enumerate(zip((stop - counts).tolist(), stop.tolist(), lo, hi, strict=True)):
        had = len(ends)
        for m in marks[i:j].tolist():
            while m - a > MOST:
                a += MOST
                ends.append(a)
            if m - a >= LEAST:
                a = m
                ends.append(m)
        while b - a > MOST:
            a += MOST
            ends.append(a)
        if b > a:
            ends.append(b)
        per[d] = len(ends) - had
    return np.array(ends, np.int64), per


def merkle(leaves: list[bytes]) -> bytes:
    """The root over the leaves; an odd last node moves up as it is; of no leaves, the digest of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=DIGEST).digest()
    while len(leaves) > 1:
        up = [hashlib.blake2b(b"\x01" + a + b, digest_size=DIGEST).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = up + leaves[len(leaves) - 1 :] * (len(leaves) % 2)
    return leaves[0]


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def _encode_stage(path: str, end_id: int, stage: str, order: list[str]):
    """Writes each task's ids to a file of its own and gives a row per document with its chunks' digests and their root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = np.dtype("<u2" if enc.width == 2 else "<u4")
        name = uuid.uuid4().hex
        fs, folder = filesystem(stage)
        fs.create_dir(folder, recursive=True)
        out, at, row = None, 0, 0
        for batch in batches:
            for part, values in steps(batch, "text"):
                ids, counts = enc.encode(values)
                full = np.full(len(ids) + len(counts), end_id, np.uint32)
                put = np.ones(len(full), bool)
                counts = counts + 1
                put[np.cumsum(counts) - 1] = False
                full[put] = ids
                ends, per = boundaries(full, counts)
                data = full.astype(kind).tobytes()
                cut = (ends * enc.width).tolist()
                digests = [_digest(data[a:b]) for a, b in zip([0, *cut[:-1]], cut, strict=True)]
                if out is None:
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(data)
                bounds = np.concatenate([[0], np.cumsum(per)])
                roots = [merkle(digests[a:b]).hex() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.array(bounds.astype(np.int32))
                sizes = np.diff(ends, prepend=0)
                ats = at + ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[part.column(c) for c in order],
                        pa.array([name] * len(counts)),
                        pa.array(np.arange(row, row + len(counts))),
                        pa.array(counts),
                        pa.array(roots, pa.string()),
                        pa.ListArray.from_arrays(lists, pa.array(digests, pa.binary())),
                        pa.ListArray.from_arrays(lists, pa.array(sizes.astype(np.int32))),
                        pa.ListArray.from_arrays(lists, pa.array(ats)),
                    ],
                    ["doc_id", *order, "file", "row", "n_tokens", "root", "digests", "sizes", "ats"],
                )
                at, row = at + len(full), row + len(counts)
        if out is not None:
            out.close()

    return run


def _pack_stage(stage: str, packs: str, width: int):
    """rows (file, at, n, uses, digest) by file and at -> a pack for each file, and where its chunks lie.

    A row without a digest ends each pack: its Merkle root and the sizes of its chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, folder = filesystem(stage)
        dst, target = filesystem(packs)
        dst.create_dir(target, recursive=True)
        file, reader, out, pack, at = None, None, None, "", 0
        leaves: list[bytes] = []
        sizes: list[int] = []

        def ended() -> Iterator[pa.RecordBatch]:
            if out is not None:
                reader.close()
                out.close()
                yield _placed([None], [pack], [len(leaves)], [0], [0], [merkle(leaves).hex()], [sizes])

        for batch in batches:
            names, places = [], []
            cols = [batch.column(c).to_pylist() for c in ("file", "at", "n", "digest")]
            for f, a, n, d in zip(*cols, strict=True):
                if f != file:
                    yield from ended()
                    leaves, sizes = [], []
                    # Buffered and in order, so the reads of a file coalesce.
                    file, reader = f, src.open_input_file(f"{folder}/{f}")
                    pack, at, block, lo = f"{f}-{uuid.uuid4().hex[:8]}.ids", 0, b"", 0
                    out = dst.open_output_stream(f"{target}/{pack}", compression=None)
                a, b = a * width, (a + n) * width
                if b > lo + len(block):
                    lo = a
                    reader.seek(a)
                    block = reader.read(max(b - a, 4 << 20))
                data = block[a - lo : b - lo]
                if _digest(data) != d:
                    raise ValueError(f"ids in {f} changed")
                out.write(data)
                names.append(pack)
                places.append(at)
                leaves.append(d)
                sizes.append(n)
                at += n
            none = [None] * batch.num_rows
            yield _placed(batch.column("digest"), names, places, batch.column("n"), batch.column("uses"), none, none)
        yield from ended()

    return run


PLACED = "digest binary, pack string, at long, n int, uses long, root string, sizes array<int>"


def _placed(*columns) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()))
    arrays = [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["digest", "pack", "at", "n", "uses", "root", "sizes"])


def write_store(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, order: list[str] | None = None) -> int:
    """Encodes every text of docs(doc_id, text, ...), appends end_id, and writes the store to the folder path.

    Returns the bytes that an id takes there.

    Documents come by the columns that order names, ascending with null first; by doc_id without it. Null
    texts count as empty. Repeated doc_ids and repeated rows are documents of their own, and a null doc_id
    is one like any other. An empty table gives a store without documents. Columns that order doesn't name aren't
    read. A task that runs again writes files of new names; only names in the tables count.
    """
    ws = Workspace(spark, "tokens")
    width = id_width(spark, tokenizer)
    stage = ws.at("ids")
    places_of = [f"o{i}" for i in range(len(order or ["doc_id"]))]
    texts = docs.select("doc_id", "text", *[F.col(c).alias(o) for c, o in zip(order or ["doc_id"], places_of, strict=True)])
    typed = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("doc_id", *places_of))
    schema = f"{typed}, file string, row long, n_tokens long, root string, digests array<binary>, sizes array<int>, ats array<long>"
    rows = ws.table(texts.mapInArrow(_encode_stage(tokenizer, end_id, stage, places_of), schema), "rows")
    chunk = rows.select("file", F.explode(F.arrays_zip("digests", "sizes", "ats")).alias("c"))
    chunk = chunk.select(F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n"), "file", F.col("c.ats").alias("at"))
    first = chunk.groupBy("digest", "n").agg(F.min(F.struct("file", "at")).alias("p"), F.count("*").alias("uses"))
    owned = first.select("digest", "n", "uses", "p.file", "p.at").repartition("file").sortWithinPartitions("file", "at")
    places = ws.table(owned.mapInArrow(_pack_stage(stage, f"{path}/packs", width), PLACED), "places")
    ws.drop("ids")
    places.filter("digest is null").select("pack", "root", "sizes").write.mode("overwrite").parquet(f"{path}/manifest")
    _write_recipes(ws, rows, places.filter("digest is not null").drop("root", "sizes"), f"{path}/recipes", places_of)
    ws.close()
    return width


def _write_recipes(ws: Workspace, rows: DataFrame, places: DataFrame, path: str, order: list[str]) -> None:
    used = rows.select("file", "row", F.posexplode("digests").alias("k", "digest"))
    used = hot_join(used, places, "digest", "uses")
    placed = used.groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("k", "pack", "at", "n"))).alias("c"))
    slim = rows.select("doc_id", *order, "file", "row", "n_tokens", "root").join(placed, ["file", "row"], "left")
    chunks = F.coalesce(F.transform("c", lambda x: F.struct(x["pack"].alias("pack"), x["at"].alias("at"), x["n"].alias("n"))), F.array().cast("array<struct<pack:string,at:bigint,n:int>>"))
    slim = slim.select("doc_id", *order, "file", "row", "n_tokens", "root", chunks.alias("chunks"))
    # With file and row no two rows tie, so ranges stay even where a doc_id repeats.
    by = [*[F.col(o).asc_nulls_first() for o in order], F.col("file"), F.col("row")]
    ranged = slim.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    ranged = ws.table(ranged.sortWithinPartitions(*by), "ranged")
    ahead = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = ahead.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.join(F.broadcast(ahead), "part")  # a row per partition
    starts = starts.withColumn("start", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    starts.select("part", "doc_id", "start", "n_tokens", "root", "chunks").write.mode("overwrite").parquet(path)


def verify_packs(spark: SparkSession, path: str, width: int) -> int:
    """Reads every pack through and holds its chunks against the root in the manifest; how many packs there are.

    A pack is read in order, a chunk at a time, so it may be larger than memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(f"{path}/packs")
        for batch in batches:
            for pack, root, sizes in zip(*(batch.column(c).to_pylist() for c in ("pack", "root", "sizes")), strict=True):
                with fs.open_input_stream(f"{folder}/{pack}", compression=None, buffer_size=1 << 20) as source:
                    leaves = [_digest(source.read(n * width)) for n in sizes]
                    if source.read(1) or merkle(leaves).hex() != root:
                        raise ValueError(f"pack {pack} doesn't have the Merkle root of the manifest")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    packs = spark.read.parquet(f"{path}/manifest")
    return packs.repartition("pack").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _read_stage(packs: str, width: int, verify: bool, gap: int = 1 << 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(packs)
        opened: dict[str, object] = {}
        kind = np.dtype("<u2" if width == 2 else "<u4")

        def ranges(want: dict[str, list[tuple[int, int]]]) -> dict[tuple[str, int], bytes]:
            """The wanted chunks; neighbours come in one read of 8 MB at most."""
            got = {}
            for pack, spans in want.items():
                if pack not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[pack] = fs.open_input_file(f"{folder}/{pack}")
                spans = sorted(set(spans))
                i = 0
                while i < len(spans):
                    lo, hi, j = spans[i][0], spans[i][1], i + 1
                    while j < len(spans) and spans[j][0] <= hi + gap and spans[j][1] - lo <= 8 << 20:
                        hi, j = max(hi, spans[j][1]), j + 1
                    opened[pack].seek(lo)
                    block = opened[pack].read(hi - lo)
                    got |= {(pack, a): block[a - lo : b - lo] for a, b in spans[i:j]}
                    i = j
            return got

        for batch in batches:
            size = np.maximum(batch.column("n_tokens").to_numpy(zero_copy_only=False), 1) * width
            group = (np.cumsum(size) - size) // (8 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(x, y - x)
                recipes = part.column("chunks").to_pylist()
                want: dict[str, list[tuple[int, int]]] = {}
                for recipe in recipes:
                    for c in recipe:
                        want.setdefault(c["pack"], []).append((c["at"] * width, (c["at"] + c["n"]) * width))
                got = ranges(want)
                out = []
                leaf: dict[tuple[str, int], bytes] = {}
                for recipe, n, root in zip(recipes, part.column("n_tokens").to_pylist(), part.column("root").to_pylist(), strict=True):
                    keys = [(c["pack"], c["at"] * width) for c in recipe]
                    if verify:
                        for k in keys:
                            if k not in leaf:
                                leaf[k] = _digest(got[k])
                        if merkle([leaf[k] for k in keys]).hex() != root:
                            raise ValueError("a document's ids don't have its Merkle root")
                    ids = b"".join([got[k] for k in keys])
                    if len(ids) != n * width:
                        raise ValueError("a document doesn't have as many ids as its recipe")
                    out.append(np.frombuffer(ids, kind).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_store(spark: SparkSession, path: str, width: int, verify: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids, 4 bytes each, little-endian, put together from its chunks.

    verify holds all packs against the manifest first, and each document against its recipe's root.
    """
    if verify:
        verify_packs(spark, path, width)
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "root", "chunks")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    return recipes.mapInArrow(_read_stage(f"{path}/packs", width, verify), f"doc_id {kind}, start long, n_tokens long, ids binary")


def store_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Writes the store and reads all documents back from its files."""
    path = path or Workspace(spark, "store").path
    return read_store(spark, path, write_store(spark, docs, path, tokenizer, end_id, order))
