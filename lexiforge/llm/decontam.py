"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of WINDOW words at every STRIDE words, benchmark items at every ITEM_STRIDE, so
each passage of a copied item has an item's passage a word away at most. Passages are TF-IDF vectors with document frequencies over all
documents. A randomised SVD, worked out by partition sums over the benchmark's passages, gives the latent space;
passages of documents are folded into it and compared by cosine. What holds an item's answer, or as many of its
rarest words as any close copy must, is a candidate whatever its cosine. Candidates are checked on the words
themselves: longest common subsequence of item and neighbourhood, how much of the item's TF-IDF weight is
there, and whether the item's answer, its last words, is.

Words are compared by 32-bit hashes. Two words that differ are taken for the same once in 2**32 pairs, and
half of an item's words, in order, decide, so that no chance of note is left for a text to be rejected by it.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiforge.llm.common import STEP_BYTES, Decisions, Workspace, bounded_batches, filesystem, keyed, split_words, steps
from lexiforge.llm.simhash import joined_at
from lexiforge.llm.xxh64 import hash_runs

WINDOW, STRIDE, ITEM_STRIDE = 12, 4, 2
RANK, OVERSAMPLE, POWER = 192, 16, 2
#: A passage is a candidate from this cosine on: in the latent space, and as far as its words are the benchmark's.
COSINE = 0.65
#: Share of an item's words that the longest common subsequence has: enough alone, or with the answer.
COMMON, WITH_ANSWER = 0.8, 0.6
#: Enough for a paraphrase that the cosine finds: as much in order (two halves that changed places have it), and so much
#: of the item's weight in any order, which common words alone can't have.
IN_ORDER, IN_WEIGHT = 0.5, 0.5
#: Last words of an item that count as its answer.
ANSWER = 5
#: So many of an item's rarest words must be near each other, out of so many more than an accepted copy can lack.
RARE = 3
#: Document frequencies are kept by this many hashes of words, for all words of all documents.
BUCKETS = 1 << 20
EDGES = " .,!?;:#$%&*()[]{}\"'|-_/\\<>=+~`@^"
#: Benchmark passages that one search block holds; a larger benchmark is searched in several blocks, each by GROUP bytes of documents.
BLOCK, GROUP = 100_000, 64 << 20
#: Passages that one matrix product compares with the benchmark's.
ROWS = 1024


def word_codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the different words, lower-cased and bare of punctuation at their ends; which each word is; words per text."""
    flat, counts = split_words(values)
    coded = flat.dictionary_encode()
    bare = pc.utf8_trim(pc.utf8_lower(coded.dictionary), EDGES)
    size = pc.binary_length(bare).to_numpy(zero_copy_only=False).astype(np.int64)
    data = bare.buffers()[2].to_pybytes()[joined_at(bare)] if size.sum() else b""
    hashes = hash_runs(data, np.cumsum(size) - size, size, 7).astype(np.uint32) if len(size) else np.zeros(0, np.uint32)
    return hashes, coded.indices.to_numpy(zero_copy_only=False), counts


def word_ids(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and words per text."""
    hashes, of, counts = word_codes(values)
    return hashes[of], counts


def buckets_of_texts(hashes: np.ndarray, of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bucket of each text's different words, as often as there are texts. Words are marked in a table of texts by words."""
    width, out, ends = max(len(hashes), 1), [], np.cumsum(counts)
    rows = max(1, (1 << 25) // width)
    for lo in range(0, len(counts), rows):
        some = counts[lo : lo + rows]
        mine = of[ends[lo] - counts[lo] : ends[lo + len(some) - 1]]
        there = np.zeros(len(some) * width, bool)
        there[np.repeat(np.arange(len(some)) * width, some) + mine] = True
        out.append(np.flatnonzero(there) % width)
    which = np.concatenate(out) if out else np.zeros(0, np.int64)
    return (hashes[which] & np.uint32(BUCKETS - 1)).astype(np.int64)


def _encoded(keep: list[str]):
    """Each document's word ids and, in a last row, how many of the task's documents each bucket is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        n, kinds = 0, None
        empty = pa.array([], pa.int64())
        lists = lambda k, a, b: [pa.ListArray.from_arrays(pa.array(np.append(np.zeros(k, np.int32), len(x)).astype(np.int32)), x) for x in (a, b)]
        names = [*keep, "words", "bucket", "df"]
        for batch in batches:
            kinds = [batch.column(c).type for c in keep]
            for part, values in steps(batch, "text"):
                hashes, of, counts = word_codes(values)
                ids = hashes[of]
                np.add.at(df, buckets_of_texts(hashes, of, counts), 1)
                n += len(counts)
                at = pa.py_buffer(np.concatenate([[0], np.cumsum(4 * counts)]).astype(np.int32).tobytes())
                words = pa.Array.from_buffers(pa.binary(), len(counts), [None, at, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), words, *lists(len(counts), empty, empty)], names)
        if kinds is not None:
            some = np.flatnonzero(df)
            table = lists(1, pa.array(np.append(some, -1)), pa.array(np.append(df[some], n)))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.nulls(1, pa.binary()), *table], names)

    return run


def encode(ws: Workspace, docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The documents as word ids, and where the document frequencies over all documents lie, a table of bounded size."""
    typed = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select("text", *keep).mapInArrow(_encoded(keep), f"{typed}, words binary, bucket array<long>, df array<long>")
    rows = ws.table(rows, "words")
    pairs = rows.filter("words is null").select(F.explode(F.arrays_zip("bucket", "df")).alias("x"))
    ws.table(pairs.groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum("x.df").alias("df")), "frequencies")
    return rows.filter("words is not null").select(*keep, "words"), ws.at("frequencies")


def load_idf(path: str) -> np.ndarray:
    """log((1 + N) / (1 + df)) + 1 by bucket."""
    fs, folder = filesystem(path)
    files = [f.path for f in fs.get_file_info(FileSelector(folder)) if f.path.endswith(".parquet")]
    parts = [pq.read_table(f, filesystem=fs) for f in files]
    bucket, df = (np.concatenate([p[c].to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for c in ("bucket", "df"))
    n = int(df[bucket == -1].sum())
    out = np.full(BUCKETS, np.log(1 + n) + 1, np.float32)
    out[bucket[bucket >= 0]] = (np.log((1 + n) / (1 + df[bucket >= 0])) + 1).astype(np.float32)
    return out


class Latent:
    """A block of the benchmark in the latent space, and what it takes to fold passages of documents in.

    item says whose each passage is, kept the share of a passage's length that the latent space keeps.
    """

    _scaled = None

    def __init__(self, words: np.ndarray, idf: np.ndarray, basis: np.ndarray, items: list[np.ndarray]) -> None:
        self.words, self.basis = words, basis
        self.seen = np.zeros(BUCKETS, bool)
        self.seen[(words & np.uint32(BUCKETS - 1)).astype(np.int64)] = True
        self.weighed = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)])
        sizes = np.array([len(x) for x in items])
        rows, self.item = passages(self.places(np.concatenate(items)), sizes)
        z = self.fold(rows)
        norm = np.maximum(np.linalg.norm(z, axis=1), 1e-9)
        self.passages, self.kept = z / norm[:, None], (norm / np.maximum(lengths(rows, idf), 1e-9)).astype(np.float32)

    @property
    def scaled(self) -> np.ndarray:
        """The passages, longer as the latent space keeps less of them."""
        if self._scaled is None:
            self._scaled = self.passages / np.maximum(self.kept, 1e-3)[:, None]
        return self._scaled

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Which of the benchmark's words each id is, or -1."""
        out = np.full(len(ids), -1, np.int32)
        some = np.flatnonzero(self.seen[ids & np.uint32(BUCKETS - 1)])
        at = np.minimum(np.searchsorted(self.words, ids[some]), len(self.words) - 1)
        out[some] = np.where(self.words[at] == ids[some], at, -1)
        return out

    def fold(self, place: np.ndarray) -> np.ndarray:
        """Rows of place are passages' words (-1: not in the benchmark) -> their latent vectors, not normalised."""
        out = np.zeros((len(place), self.basis.shape[1]), np.float32)
        for k in range(place.shape[1]):
            out += self.weighed[place[:, k]]
        return out


def passages(place: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all passages of items, WINDOW columns with -1 behind a short item's end, and whose passage each is.

    An item's passages begin ITEM_STRIDE words from each other; the last one ends with it.
    """
    n = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // ITEM_STRIDE) + 1, np.minimum(sizes, 1))
    item = np.repeat(np.arange(len(sizes)), n)
    start = np.minimum((np.arange(len(item)) - (np.cumsum(n) - n)[item]) * ITEM_STRIDE, np.maximum(sizes[item] - WINDOW, 0))
    at = start[:, None] + np.arange(WINDOW)
    inside = at < sizes[item][:, None]
    k = np.where(inside, (np.cumsum(sizes) - sizes)[item][:, None] + at, 0)
    return np.where(inside, place[k], -1), item


def lengths(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Lengths of passages as vectors of (times a word is there x its weight)."""
    w = np.append(weights, 0)
    out = np.zeros(len(rows))
    for lo in range(0, len(rows), ROWS):
        some = rows[lo : lo + ROWS]
        out[lo : lo + ROWS] = ((some[:, :, None] == some[:, None, :]).sum(2) * np.square(w[some], dtype=np.float64)).sum(1)
    return np.sqrt(out)


def randomised_svd(parts: RDD, words: np.ndarray, weights: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """The right singular vectors, words x rank, of the matrix whose rows are the passages of parts' items, each of length 1.

    Every round multiplies with the matrix and its transpose by summing what the partitions give (A'A Q is a sum over
    passages), and orthonormalises the result on the driver, which sees no passage: both are bounded by a block's vocabulary.
    """
    width = len(words)
    k = min(rank + OVERSAMPLE, width)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, k)))[0]

    def gram(q: np.ndarray) -> np.ndarray:
        shared = parts.context.broadcast((q, words, weights))  # bounded by a block's vocabulary

        def part(it: Iterator) -> Iterator[np.ndarray]:
            q, words, weights = shared.value
            total = np.zeros(q.shape)
            for (data,) in it:
                ids = np.frombuffer(data, np.uint32)
                rows, _ = passages(np.searchsorted(words, ids), np.array([len(ids)]))
                scaled = np.append(weights, 0)[rows] / np.maximum(lengths(rows, weights), 1e-9)[:, None]
                for lo in range(0, len(rows), ROWS):
                    r, s = rows[lo : lo + ROWS], scaled[lo : lo + ROWS]
                    y = np.einsum("pw,pwk->pk", s, q[r])
                    for c in range(WINDOW):  # -1, behind an item's end, weighs nothing
                        np.add.at(total, r[:, c], s[:, c, None] * y)
            yield total

        found = parts.mapPartitions(part).treeReduce(lambda a, b: a + b)
        shared.unpersist()
        return found

    for _ in range(POWER):
        q = np.linalg.qr(gram(q))[0]
    values, vectors = np.linalg.eigh(q.T @ gram(q))
    return (q @ vectors[:, ::-1])[:, : min(rank, k)].astype(np.float32)


def _encoded_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as word hashes, and how many passages each has."""
    for batch in batches:
        for part, values in steps(batch, "text"):
            ids, counts = word_ids(values)
            at = np.concatenate([[0], np.cumsum(counts)])
            words = pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            n = np.maximum(-(-(counts - WINDOW) // ITEM_STRIDE) + 1, 1)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), words, pa.array(n)], ["item_id", "words", "passages"])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids).astype(np.int64))], ["word"])


def benchmark_blocks(ws: Workspace, benchmark: DataFrame) -> list[int]:
    """Writes the different items that have words, as word hashes, by blocks of about BLOCK passages; how many each block has.

    Which block an item is in follows from a hash of it; an item isn't split.
    """
    some = benchmark.select("item_id", "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).distinct()
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = ws.table(some.mapInArrow(_encoded_items, f"item_id {kind}, words binary, passages long"), "encoded-items")
    total = items.agg(F.sum("passages")).first()[0] or 0
    blocks = -(-total // BLOCK)
    if blocks:
        of = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "words"), F.lit(blocks)).cast("int")
        items.withColumn("block", of).write.partitionBy("block").parquet(ws.at("items"))
    ws.drop("encoded-items")
    if not blocks:
        return []
    sizes = {r.block: r.n for r in ws.spark.read.parquet(ws.at("items")).groupBy("block").agg(F.sum("passages").alias("n")).collect()}  # a row per block
    return [sizes.get(k, 0) for k in range(blocks)]


def save_basis(ws: Workspace, block: int, n: int, idf: np.ndarray, rank: int = RANK) -> None:
    """Works the latent space of a block's n passages out and writes its words and basis."""
    items = ws.spark.read.parquet(f"{ws.at('items')}/block={block}").select("words")
    words = np.sort(items.mapInArrow(_distinct_words, "word long").distinct().toArrow()["word"].to_numpy()).astype(np.uint32)
    parts = items.repartition(max(1, min(8, n // 4096))).rdd
    basis = randomised_svd(parts, words, idf[words & np.uint32(BUCKETS - 1)], rank)
    data = io.BytesIO()
    np.savez(data, words=words, basis=basis)
    fs, at = filesystem(ws.at(f"basis-{block}.npz"))
    with fs.open_output_stream(at) as f:
        f.write(data.getbuffer())


class Item:
    """A benchmark item's words as the checks need them."""

    def __init__(self, ids: np.ndarray, idf: np.ndarray) -> None:
        self.n = len(ids)
        self.words = ids.tolist()
        self.weights = idf[ids & np.uint32(BUCKETS - 1)].astype(float).tolist()
        self.total = sum(self.weights)
        self.answer = self.words[-ANSWER:]
        self.masks: dict[int, int] = defaultdict(int)
        for i, x in enumerate(self.words):
            self.masks[x] |= 1 << i
        self.masks = dict(self.masks)

    def common(self, text: list[int]) -> int:
        """Length of the longest common subsequence, one bit-parallel row per word of the text (Hyyro 2004)."""
        full = (1 << self.n) - 1
        v = full
        for m in [m for x in text if (m := self.masks.get(x))]:
            u = v & m
            v = ((v + u) | (v - u)) & full
        return self.n - v.bit_count()

    def accepted(self, text: list[int]) -> tuple[float, bool] | None:
        """Share of the item that the text has in order, and whether it has the answer, if that is enough."""
        there = set(text)
        has = [w in there for w in self.words]
        if 2 * sum(has) < self.n:  # no subsequence is longer than what is there
            return None
        common = self.common(text) / max(self.n, 1)
        if common < min(WITH_ANSWER, IN_ORDER):
            return None
        first = [i for i, w in enumerate(text) if w == self.answer[0]] if self.answer else []
        hit = any(text[i : i + len(self.answer)] == self.answer for i in first)
        if common >= COMMON or common >= WITH_ANSWER and hit:
            return common, hit
        weight = sum(w for w, h in zip(self.weights, has, strict=True) if h)
        return (common, hit) if common >= IN_ORDER and weight >= IN_WEIGHT * self.total else None


class Gate:
    """What a neighbourhood of an item must hold to be a close copy.

    A copy that has the share COMMON of an item's n words lacks few of them; of RARE more than it can lack it has RARE
    at least, whichever these are, within the n + WINDOW + n words of a neighbourhood. The rarest are looked up.
    With WITH_ANSWER the answer stands in the neighbourhood. So no close copy is passed over. An item of fewer words than
    an answer has stands there whole and unbroken; one of a single word, which says nothing of where a text comes from, is left to the cosine.
    """

    def __init__(self, space: Latent, idf: np.ndarray, items: list[np.ndarray]) -> None:
        rare, last = [], []
        for j, x in enumerate(items):
            if len(x) > 1:
                last.append((int(space.places(x[-1:])[0]), j))
            if len(x) < ANSWER:
                continue
            lacks = next(k for k in range(len(x), -1, -1) if (len(x) - k) / len(x) >= COMMON)
            order = np.argsort(-idf[x & np.uint32(BUCKETS - 1)], kind="stable")[: lacks + RARE]
            rare += [(w, j) for w in np.unique(space.places(x[order])).tolist()]
        self.span = np.array([2 * len(x) + WINDOW for x in items])
        self.length = np.array([min(len(x), ANSWER) for x in items])
        self.answers = np.array([np.append(np.zeros(ANSWER - n, np.uint32), x[-ANSWER:]) for x, n in zip(items, self.length, strict=True)])
        self.rare, self.last = (self._lists(v, len(space.words)) for v in (rare, last))

    @staticmethod
    def _lists(pairs: list[tuple[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's items begin, and the items."""
        pairs = sorted(pairs)
        n = np.bincount(np.array([w for w, _ in pairs], np.int64), minlength=width)
        return np.concatenate([[0], np.cumsum(n)]), np.array([j for _, j in pairs], np.int64)

    @staticmethod
    def _hits(place: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) for all words that an item is listed for."""
        at, of = lists
        n = np.diff(np.append(at, at[-1]))[place]  # -1, not in the benchmark, has none
        some = np.flatnonzero(n)
        n = n[some]
        return np.repeat(some, n), of[np.repeat(at[place[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def candidates(self, ids: np.ndarray, place: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Rows of text, item, first and last word: any acceptable neighbourhood holds the words of a row."""
        pos, item = self._hits(place, self.rare)
        doc = np.searchsorted(stops, pos, "right")
        order = np.lexsort((pos, item, doc))
        doc, item, pos = doc[order], item[order], pos[order]
        a, b = slice(0, max(len(pos) - RARE + 1, 0)), slice(RARE - 1, None)
        near = np.flatnonzero((doc[a] == doc[b]) & (item[a] == item[b]) & (pos[b] - pos[a] < self.span[item[a]]))
        words = np.stack([doc[near], item[near], pos[near], pos[near + RARE - 1]], 1)
        end, item = self._hits(place, self.last)
        doc = np.searchsorted(stops, end, "right")
        inside = end - self.length[item] + 1 >= starts[doc]
        end, item, doc = end[inside], item[inside], doc[inside]
        back = np.arange(ANSWER - 1, -1, -1)
        same = ((ids[np.maximum(end[:, None] - back, 0)] == self.answers[item]) | (back >= self.length[item][:, None])).all(1)
        answers = np.stack([doc[same], item[same], end[same] - self.length[item[same]] + 1, end[same]], 1)
        found = np.concatenate([words, answers])
        return found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]


_SPACES: dict[tuple[str, int], tuple] = {}


def load_space(root: str, block: int, kind: pa.DataType) -> tuple[Latent, Gate, np.ndarray, list[Item], pa.Array]:
    """A worker's copy of one block of the benchmark in the latent space, with its items' ids; it holds one block at a time."""
    key = (root, block)
    if key not in _SPACES:
        _SPACES.clear()
        fs, at = filesystem(root)
        with fs.open_input_file(f"{at}/basis-{block}.npz") as f:
            got = np.load(io.BytesIO(f.read()))
        idf = load_idf(f"{root}/frequencies")
        files = sorted(f.path for f in fs.get_file_info(FileSelector(f"{at}/items/block={block}")) if f.path.endswith(".parquet"))
        table = pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read(["item_id", "words"]) for f in files]).combine_chunks()
        items = [np.frombuffer(x, np.uint32) for x in table["words"].to_pylist()]
        space = Latent(got["words"], idf[got["words"] & np.uint32(BUCKETS - 1)], got["basis"], items)
        ids = pa.concat_arrays(table["item_id"].chunks).cast(kind)
        _SPACES[key] = space, Gate(space, idf, items), idf, [Item(x, idf) for x in items], ids
    return _SPACES[key]


def _search(root: str, blocks: list[int], kind: pa.DataType, keep: list[str], cosine: float):
    """Documents are read once, and GROUP bytes of them at a time compared with one block after the other."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.nbytes
            if len(blocks) == 1 or size >= GROUP:
                yield some
                some, size = [], 0
        if some:
            yield some

    def compared(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        counts = pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        group = (np.cumsum(counts) - counts) // (STEP_BYTES // 8)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
        *space, item_ids = load_space(root, block, kind)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            ids = np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint32)
            out = _matches(*space, ids, counts[a:b], cosine)
            at, of = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
            col = lambda k, t: pa.array([x[k] for x in out], t)  # noqa: B023, E731  called at once
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(at) for c in keep), item_ids.take(of), col(2, pa.int64()), col(3, pa.int64()), col(4, pa.float64()), col(5, pa.float64()), col(6, pa.bool_())],
                [*keep, "item_id", "start", "end", "cosine", "common", "answered"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in groups(batches):
            for block in blocks:
                for batch in some:
                    yield from compared(batch, block)

    return run


def squared_lengths(ids: np.ndarray, weights2: list[np.ndarray], at: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Of the windows of WINDOW words at most from at to end, both ascending: the sum over words of (times it is there x weight) squared.

    A word's own squares, and twice the product for each two places of a window that have the same word.
    """
    out = []
    for w in weights2:
        ahead = np.concatenate([[0], np.cumsum(w)])
        out.append(ahead[end] - ahead[at])
    same = [np.flatnonzero(ids[d:] == ids[:-d]) for d in range(1, min(WINDOW, len(ids)))]
    if same:
        one = np.concatenate(same)
        two = one + np.repeat(np.arange(1, len(same) + 1), [len(x) for x in same])
        # Of the windows that hold both places the first, and the first behind them.
        lo = np.searchsorted(end, two, "right")
        hi = np.maximum(np.searchsorted(at, one, "right"), lo)
        some = hi > lo
        one, lo, hi = one[some], lo[some], hi[some]
        for w, total in zip(weights2, out, strict=True):
            total += 2 * np.cumsum(np.bincount(lo, w[one], len(at) + 1) - np.bincount(hi, w[one], len(at) + 1))[:-1]
    return out


def _matches(space: Latent, gate: Gate, idf: np.ndarray, items: list[Item], ids: np.ndarray, counts: np.ndarray, cosine: float) -> list[tuple]:
    if not len(ids):
        return []
    place = space.places(ids)
    known = place >= 0
    stops = np.cumsum(counts)
    starts = stops - counts
    # Passage starts of all texts; a short text is one passage.
    n = np.where(counts > WINDOW, (counts - WINDOW + STRIDE - 1) // STRIDE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    at = starts[doc] + np.minimum((np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * STRIDE, np.maximum(counts[doc] - WINDOW, 0))
    end = np.minimum(at + WINDOW, stops[doc])
    # Outside the benchmark's words a passage is at right angles to the whole latent space, so its full cosine
    # is at most the root of the share that the benchmark's words have of its squared length.
    weight2 = np.square(idf[ids & np.uint32(BUCKETS - 1)], dtype=np.float64)
    all2, known2 = squared_lengths(ids, [weight2, weight2 * known], at, end)
    likely = np.flatnonzero(known2 >= cosine**2 * np.maximum(all2, 1e-9))
    length = np.sqrt(all2).astype(np.float32)
    found: dict[tuple[int, int], tuple] = {}
    listed = ids.tolist() if len(likely) else []

    def folded(rows: np.ndarray) -> np.ndarray:
        k = at[rows][:, None] + np.arange(WINDOW)
        inside = k < end[rows][:, None]
        k = np.minimum(k, len(ids) - 1)
        return space.fold(np.where(inside, place[k], -1))

    for lo in range(0, len(likely), ROWS):
        rows = likely[lo : lo + ROWS]
        z = folded(rows)
        # The full cosine, from what the latent space keeps of a passage and of the item's passage.
        cos = (z / np.maximum(length[rows], 1e-9)[:, None]) @ space.scaled.T
        flat = np.flatnonzero(cos >= cosine)
        r, p = np.divmod(flat, cos.shape[1])
        best = cos.ravel()[flat]
        near = best * space.kept[p] * length[rows[r]] >= cosine * np.linalg.norm(z, axis=1)[r]
        r, p, best = r[near], p[near], best[near]
        order = np.lexsort((-best, space.item[p], r))
        r, j, best = r[order], space.item[p][order], best[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (j[1:] != j[:-1])
        for i, j, c in zip(rows[r[new]].tolist(), j[new].tolist(), best[new].tolist(), strict=True):
            d = int(doc[i])
            a, b = int(starts[d]), int(stops[d])
            x, y = max(a, int(at[i]) - items[j].n), min(b, int(end[i]) + items[j].n)
            if (d, j) in found and found[d, j][2] + a <= at[i] and end[i] <= found[d, j][3] + a:
                continue  # this neighbourhood has passed already
            passed = items[j].accepted(listed[x:y])
            if passed:
                had = found.get((d, j))
                if had is None or passed[0] > had[5]:
                    found[d, j] = (d, j, x - a, y - a, min(c, 1.0), *passed)
    first = np.cumsum(n) - n
    done: dict[tuple[int, int], int] = {}
    for d, j, lo, hi in gate.candidates(ids, place, starts, stops).tolist():
        a, b, item = int(starts[d]), int(stops[d]), items[j]
        had = found.get((d, j))
        if hi < done.get((d, j), 0) or had and had[2] + a <= lo and hi < had[3] + a:
            continue
        # One comparison for all neighbourhoods of this and the next candidates, then one for each.
        span = int(gate.span[j])
        x, y = max(a, lo - span), min(b, lo + 2 * span)
        done[d, j] = lo + span
        if not item.accepted(ids[x:y].tolist()):
            continue
        for i in range(int(first[d]), int(first[d] + n[d])):
            u, v = max(a, int(at[i]) - item.n), min(b, int(end[i]) + item.n)
            if v <= x or u >= y:
                continue
            passed = item.accepted(ids[u:v].tolist())
            had = found.get((d, j))
            if passed and (had is None or passed[0] > had[5]):
                found[d, j] = (d, j, u - a, v - a, 0.0, *passed)
        if (d, j) in found and found[d, j][4] == 0:
            u, v = found[d, j][2] + a, found[d, j][3] + a
            i = np.flatnonzero((doc == d) & (at >= u) & (end <= v))
            p = np.arange(*np.searchsorted(space.item, [j, j + 1]))
            cos = (folded(i) / np.maximum(length[i], 1e-9)[:, None]) @ space.scaled[p].T
            found[d, j] = (*found[d, j][:4], min(float(cos.max()), 1.0), *found[d, j][5:])
    return list(found.values())


def matches(ws: Workspace, docs: DataFrame, benchmark: DataFrame, keep: list[str], cosine: float = COSINE) -> DataFrame:
    """docs(text, and the columns to keep) -> a row per row of docs and item that it holds, with the columns kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = benchmark.schema["item_id"].dataType
    typed = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{typed}, item_id {kind.simpleString()}, start long, end long, cosine double, common double, answered boolean"
    sizes = benchmark_blocks(ws, benchmark)
    if not sizes:
        return spark.createDataFrame([], schema)
    rows, frequencies = encode(ws, docs, keep)
    idf = load_idf(frequencies)
    blocks = [k for k, n in enumerate(sizes) if n]
    for k in blocks:
        save_basis(ws, k, sizes[k], idf)
    del idf
    pa.default_memory_pool().release_unused()
    out = ws.table(rows.mapInArrow(_search(ws.path, blocks, to_arrow_type(kind), keep, cosine), schema), "matches")
    ws.drop("words", "items")
    return out


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text) -> a row per document and item that it holds.

    Columns: doc_id, item_id (of any type), start and end (words of the neighbourhood that was compared), cosine, common
    (share of the item's words in the longest common subsequence), answered. Null, empty and clean
    texts have no row; items without words match nothing, repeated items count once; repeated documents have rows each;
    of two neighbourhoods that are as good the first counts. Items of two to four words count where they stand unbroken, those of one word
    where the cosine finds them. The benchmark is taken in blocks of bounded size, each with a
    latent space of its own that lies in the shared folder; documents are read once, however many blocks there are. Other columns aren't read.
    """
    return matches(Workspace(spark, "decontam"), docs, benchmark, ["doc_id"], cosine)


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose own text holds no benchmark item, with docs' columns. Texts are read twice and not shuffled."""
    ws = Workspace(spark, "decontaminated")
    table, file, row = keyed(ws, docs)
    slim = table.select("text", F.col(file).alias("file"), F.col(row).alias("row"))
    bad = matches(ws, slim, benchmark, ["file", "row"]).select("file", "row").distinct()
    found = Decisions(ws, bad.withColumn("bad", F.lit(True)), "bad")
    return table.filter(~F.coalesce(found.of(F.col(file), F.col(row)), F.lit(False))).select(*docs.columns)
