"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

Fingerprints of 64 bits are cut into six blocks. Two that differ in four bits or fewer
agree on two whole blocks at least, so each fingerprint is dealt out under the 15 pairs of
blocks, and only fingerprints that meet under a pair are compared. Equal fingerprints are
one node throughout, so copies never become pairs. A block pair that gathers more
fingerprints than a task should hold is cut into tiles whose pairs are compared in tasks of
their own; each task keeps the links of a spanning forest for large groups, which leaves
the components as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.llm.common import Decisions, Workspace, bounded_batches, free_names, hot_join, keyed, pieces, texts
from lexiforge.llm.graph import components
from lexiforge.llm.xxh64 import hash_runs

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Block widths in bits, from the lowest bit; DISTANCE blocks can differ, the other two agree.
WIDTHS = (11, 11, 11, 11, 10, 10)
#: Fingerprints that a task compares as one group; larger groups are tiled, none is cut.
GROUP = 8192
#: Groups up to this size give all their links, larger ones a spanning forest.
DIRECT = 32

_SPREAD = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint64) << (8 * np.arange(8)).astype(np.uint64)).sum(1, dtype=np.uint64)


def fingerprints(values: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text: a bit is 1 if it is set in over half the shingles' hashes.

    A-Z are lowered; words are runs of other characters than ASCII white space. Fewer words
    than a shingle has: the whole sequence is the only shingle. No words, or null: 0. Long texts are taken in parts.
    """
    out = np.zeros(len(values), np.uint64)
    size = pc.binary_length(values).to_numpy(zero_copy_only=False)
    long: dict[int, LongText] = {}
    for part, owner in pieces(values):
        first = int(owner[0])
        if len(owner) == 1 and len(part[0].as_buffer()) < size[first]:
            long.setdefault(first, LongText(shingle, seed)).add(part)
        else:
            n, counts = bit_counts(part, shingle, seed)
            out[owner] = _majority(counts, n)
    for i, text in long.items():
        out[i] = text.fingerprint()
    return out


def _majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


class LongText:
    """Counts of a text whose parts come one by one; the last words of what was before open a part's first shingles."""

    def __init__(self, shingle: int, seed: int) -> None:
        self.shingle, self.seed, self.tail = shingle, seed, []
        self.n, self.counts = np.zeros(1, np.int64), np.zeros((1, 64), np.int64)

    def add(self, part: pa.Array) -> None:
        text = pa.array([" ".join([*self.tail, part[0].as_py()])])
        last = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text), max_splits=self.shingle - 1, reverse=True)[0].as_py()
        last = [w for w in last if w]
        if len(last) == self.shingle:
            n, counts = bit_counts(text, self.shingle, self.seed)
            self.n, self.counts = self.n + n, self.counts + counts
            last = last[1:]
        self.tail = last

    def fingerprint(self) -> int:
        if not self.n[0]:  # fewer words than a shingle has
            self.n, self.counts = bit_counts(pa.array([" ".join(self.tail)]), self.shingle, self.seed)
        return _majority(self.counts, self.n)[0]


def bit_counts(values: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each text has, and in how many of their hashes each of the 64 bits is set."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(values)))
    joined = pc.binary_join(lists, " ")
    size = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
    ends_at = np.cumsum(size)
    some = size > 0
    out = np.zeros((len(values), 64), np.int64)
    if not some.any():
        return np.zeros(len(values), np.int64), out
    n = np.where(some, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    data = joined.buffers()[2].to_pybytes()[joined_at(joined)]
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    start = np.sort(np.concatenate([(ends_at - size)[some], spaces + 1]))
    end = np.sort(np.concatenate([ends_at[some], spaces]))
    k = np.where(some, np.maximum(n - (shingle - 1), 1), 0)
    of = np.repeat(np.arange(len(n)), k)
    first = (np.cumsum(n) - n)[of] + (np.arange(len(of)) - (np.cumsum(k) - k)[of])
    last = first + np.minimum(n, shingle)[of] - 1
    hashes = hash_runs(data, start[first], end[last] - start[first], seed)
    # 64 counters a text: each byte of a hash adds its bits to 8 byte lanes, at most 255 times.
    cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip((np.cumsum(k) - k)[some].tolist(), np.cumsum(k)[some].tolist(), strict=True)])
    lanes = np.empty((len(cuts), 8), np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for i in range(8):
        lanes[:, i] = np.add.reduceat(_SPREAD[octets[:, i]], cuts)
    firsts = np.flatnonzero(np.diff(of[cuts], prepend=-1))
    out[some] = np.add.reduceat(lanes.view(np.uint8).reshape(len(cuts), 64).astype(np.int64), firsts, axis=0)
    return k, out


def joined_at(array: pa.Array) -> slice:
    """Where the bytes of a string array lie in its data buffer."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return slice(int(offsets[0]), int(offsets[-1]))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with a long column of the fingerprint's 64 bits; its other columns don't pass through Python."""

    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(fingerprints(texts(part), shingle, seed).view(np.int64))
            pa.default_memory_pool().release_unused()

    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, F.arrow_udf(of, T.LongType())(F.col(text)))


def block_keys(fp: Column, widths: tuple[int, ...] = WIDTHS, distance: int = DISTANCE) -> Column:
    """One key for each choice of the blocks that must agree; equal keys only bring fingerprints together."""
    low = np.cumsum([0, *widths])
    keys = []
    for c, chosen in enumerate(combinations(range(len(widths)), len(widths) - distance)):
        mask = sum(((1 << widths[i]) - 1) << int(low[i]) for i in chosen)
        keys.append(F.xxhash64(F.lit(c), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def _forest(fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what all the group's links connect: what is found leaves the open ones."""
    open_, stack = fp, []
    while len(open_) or stack:
        if not stack:
            stack, open_ = [open_[0]], open_[1:]
        x = stack.pop()
        near = np.bitwise_count(open_ ^ x) <= distance
        if near.any():
            found, open_ = open_[near], open_[~near]
            yield np.full(len(found), x), found
            stack.extend(found)


def _group_links(distance: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def of(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
            size = np.diff(first, append=len(key))
            a, b = [], []
            small = np.repeat(size <= DIRECT, size)
            k, f = key[small], fp[small]
            for d in range(1, int(size[size <= DIRECT].max(initial=1))):
                at = np.flatnonzero(k[d:] == k[:-d])
                at = at[np.bitwise_count(f[at] ^ f[at + d]) <= distance]
                a.append(f[at])
                b.append(f[at + d])
            for i in np.flatnonzero(size > DIRECT).tolist():
                for x, y in _forest(np.unique(fp[first[i] : first[i] + size[i]]), distance):
                    a.append(x)
                    b.append(y)
            if sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key):
                done = int(np.searchsorted(key, key[-1]))  # the last group may go on
                yield from of(key[:done], fp[:done])
                key, fp = key[done:], fp[done:]
        yield from of(key, fp)

    return links


def links(ws: Workspace, prints: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """prints(fp long, distinct) -> (a, b): links at distance bits or fewer, enough of them for the components."""
    keys = prints.select(F.explode(block_keys(F.col("fp"), WIDTHS, distance)).alias("key"), "fp")
    hot = ws.table(keys.groupBy("key").count().filter(F.col("count") > group), "hot")
    near = _group_links(distance)
    if hot.limit(1).count() == 0:
        return keys.repartition("key").sortWithinPartitions("key").mapInArrow(near, "a long, b long")
    tiles = keys.join(hot, "key").withColumn("n", F.ceil(2 * F.col("count") / group)).withColumn("t", F.pmod(F.xxhash64("fp"), "n"))
    tiles = tiles.withColumn("s", F.explode(F.expr("sequence(0L, n - 1)")))
    tiles = tiles.select(F.xxhash64("key", F.least("t", "s"), F.greatest("t", "s")).alias("key"), "fp")
    dealt = keys.join(hot, "key", "left_anti").union(tiles)
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(near, "a long, b long")


def least_row(*more: str) -> Column:
    """The smallest doc_id of a group, null being larger than any, with more columns of its row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *more)).alias("least")


def classes(ws: Workspace, prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints(fp, least, ...), a row per fingerprint -> with root, what names the fingerprint's class."""
    linked = ws.table(components(ws, links(ws, prints.select("fp"), distance)), "linked")
    return prints.join(linked, prints["fp"] == linked["node"], "left").select(*prints.columns, F.coalesce("root", "fp").alias("root"))


def simhash_components(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs(doc_id, text, ...) -> one row (doc_id, fingerprint, component_id) for each row of docs.

    Null and blank texts have fingerprint 0 and link like any other. A null doc_id counts as
    larger than any; repeated rows give repeated rows; an empty table gives none; other
    columns are not read.
    """
    ws = Workspace(spark, "simhash")
    rows = ws.table(with_fingerprint(docs.select("doc_id", "text"), name="fp").select("doc_id", "fp"), "rows")
    prints = ws.table(rows.groupBy("fp").agg(least_row(), F.count("*").alias("n")), "prints")
    joined = ws.table(classes(ws, prints, distance), "joined")
    of_root = joined.groupBy("root").agg(F.min("least").alias("of_class"))
    of = ws.table(joined.join(of_root, "root").select("fp", "n", F.col("of_class.id").alias("component_id")), "classes")
    ws.drop("prints", "linked", "joined")
    return hot_join(rows, of, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs without all but one document of each component: that with the smallest doc_id stays.

    Of repeated rows of that document one stays. All columns of docs are kept, whatever their names. Null and blank
    texts are one component; an empty table stays empty. Texts are read twice and never shuffled.
    """
    ws = Workspace(spark, "dedup")
    table, file, row = keyed(ws, docs)
    slim = table.select("doc_id", "text", F.col(file).alias("file"), F.col(row).alias("row"))
    rows = with_fingerprint(slim, name="fp").groupBy("fp")
    prints = ws.table(rows.agg(least_row("file", "row")), "prints")
    kept = classes(ws, prints, distance).groupBy("root").agg(F.min("least").alias("least"))
    stays = Decisions(ws, kept.select("least.file", "least.row", F.lit(True).alias("stays")), "stays")
    ws.drop("prints", "linked")
    return table.filter(F.coalesce(stays.of(F.col(file), F.col(row)), F.lit(False))).select(*docs.columns)
