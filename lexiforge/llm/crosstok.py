"""Alignment of two tokenizers' ids over the same texts, by a dictionary of token groups.

Both tokenizers cut a text's bytes; places where both end a token part it into groups, and within a group every pair of
overlapping tokens is a link. Few different groups make up most of a corpus, so each different group is interned: documents
hold groups with their numbers, the corpus' numbers are summed up per group, links are expanded once per different group and multiplied by its frequency, and what
the links' counts make of a group is joined back by the group.

Neither tokenizer joins across the edge between another character and a blank, so the pieces between such edges are encoded once per worker and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import Workspace, segment_sums, steps

#: Pieces that a worker remembers.
MEMO = 250_000
#: Pieces that are encoded or looked up at a time, about.
ADDED = 1 << 17
#: Groups that every task knows, at most, and characters of their keys; the documents' other groups are joined.
KEPT, KEPT_CHARS = 1 << 16, 64
#: Characters of a long text that are cut into pieces at a time.
PART = 1 << 20
#: A piece begins at a blank behind another character; white space at the text's end belongs to the piece ahead.
PIECE = re.compile(r" \s*\S+(?:[^\S ]\s*\S+)*(?:\s++\Z)?")
EDGE = re.compile(r"(?<=\S) (?=\s*\S)")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of each id."""

    #: Pieces that are encoded as one text.
    BULK = 256

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet, tokens = byte_alphabet(), self.a.get_vocab(with_added_tokens=False)
        by_id = {i: bytes(alphabet[c] for c in t) for t, i in tokens.items() if all(c in alphabet for c in t)}
        self.a_bytes = [by_id.get(i, b"") for i in range(max(tokens.values()) + 1)]
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the second tokenizer reaches over the edge ahead of a blank")
        self.a_size, self.b_size = (np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        self.a_data, self.b_data = (pa.array(known, pa.binary()) for known in (self.a_bytes, self.b_bytes))
        self.written = pa.array(np.arange(max(len(self.a_bytes), len(self.b_bytes)))).cast(pa.string())

    def encode_a(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts that begin with a blank, which the tokenizer adds itself."""
        return self.b.encode([p[1:] for p in parts], num_threads=1)

    def encode(self, encode, size: np.ndarray, parts: list[str], bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces in turn, and how many each has. Pieces are encoded in bulk where the ids' ends tell them apart again.

        size: bytes of each id; bytes_: of each piece. A piece with white space behind it would join what follows, so it is encoded alone.
        """
        alone = np.array([p[-1].isspace() for p in parts])
        ids, n = [np.zeros(0, np.int64)] * len(parts), np.zeros(len(parts), np.int64)
        rest, bulk = np.flatnonzero(alone).tolist(), np.flatnonzero(~alone)
        chunks = [bulk[i : i + self.BULK] for i in range(0, len(bulk), self.BULK)]
        for chunk, got in zip(chunks, encode(["".join([parts[i] for i in c]) for c in chunks]), strict=True):
            got, ends = np.array(got, np.int64), np.cumsum(bytes_[chunk])
            reached = np.cumsum(size[got])
            last = np.searchsorted(reached, ends)
            if len(got) == last[-1] + 1 and (reached[last] == ends).all():
                ids[chunk[0]], n[chunk] = got, np.diff(last, prepend=-1)  # the ids of a chunk's pieces stand with its first
            else:
                rest += chunk.tolist()
        for i, got in zip(rest, encode([parts[i] for i in rest]), strict=True):
            ids[i], n[i] = np.array(got, np.int64), len(got)
        order = np.concatenate([bulk, np.flatnonzero(alone)])
        return self._in_order(ids, n, order)

    @staticmethod
    def _in_order(ids: list[np.ndarray], n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([ids[i] for i in order.tolist()])  # in that order
        start = np.zeros(len(n), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def same(self, data: pa.Array, size: np.ndarray, ids: np.ndarray, n: np.ndarray, parts: pa.Array, bytes_: np.ndarray) -> np.ndarray:
        """Which pieces' ids have the pieces' very bytes."""
        good = segment_sums(size[ids], n) == bytes_
        joined = lambda x: np.frombuffer(x.buffers()[2] or b"", np.uint8)[: int(pc.sum(pc.binary_length(x)).as_py() or 0)]
        want = joined(parts.filter(pa.array(good)).cast(pa.binary()))
        got = joined(data.take(pa.array(ids[np.repeat(good, n)])))
        wrong = np.repeat(np.flatnonzero(good), bytes_[good])[want != got]
        good[wrong] = False
        return good

    def links(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """The id pairs of a group's overlapping tokens, an entry per link."""
        out, i, j, end_a, end_b = [], 0, 0, len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        while True:
            out.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                i += 1
                if i == len(a):
                    return out
                end_a += len(self.a_bytes[a[i]])
            if step_b:
                j += 1
                end_b += len(self.b_bytes[b[j]])


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def pieces_of(text: str) -> Iterator[list[str]]:
    """A text's pieces, a blank added ahead, in lists of about PART characters."""
    said, at = " " + text, 0
    while at < len(said):
        edge = EDGE.search(said, at + PART) if len(said) > at + PART else None
        end = edge.start() if edge else len(said)
        part = said[at:end]
        found = PIECE.findall(part)
        yield found if sum(map(len, found)) == len(part) else [part]
        at = end


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))


def _joined(strings: pa.Array, n: np.ndarray, mark: str) -> pa.Array:
    """Runs of n strings each, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(_offsets(n), strings), mark)


class Interned:
    """Pieces of texts and the groups that they fall into, each kept once."""

    def __init__(self, both: Tokenizers) -> None:
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.written = pa.array([], pa.string())  # a piece's groups
        self.good = np.zeros(0, bool)
        self.numbers = np.zeros((0, len(NUMBERS)), np.int64)
        self.n, self.of_piece = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.group: dict[str, int] = {}
        self.keys: list[str] = []

    def add(self, new: list[str]) -> None:
        both, parts = self.both, pa.array(new, pa.string())
        size = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        a, n_a = both.encode(both.encode_a, both.a_size, new, size)
        b, n_b = both.encode(both.encode_b, both.b_size, new, size)
        good = both.same(both.a_data, both.a_size, a, n_a, parts, size) & both.same(both.b_data, both.b_size, b, n_b, parts, size)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        ends_a, ends_b = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_group = lambda ends: np.bincount(np.searchsorted(shared, ends), minlength=len(shared))
        in_a, in_b = of_group(ends_a), of_group(ends_b)
        sides = [_joined(both.written.take(pa.array(ids)), n, ",") for ids, n in ((a, in_a), (b, in_b))]
        keys = pc.binary_join_element_wise(*sides, "|")
        piece = np.flatnonzero(good)[np.searchsorted(np.cumsum(size[good]), shared)]
        n = np.bincount(piece, minlength=len(new))
        links = np.bincount(piece, weights=in_a + in_b - 1, minlength=len(new)).astype(np.int64)
        listed = keys.to_pylist()
        for k in listed:
            if k not in self.group:
                self.group[k] = len(self.keys)
                self.keys.append(k)
        self.at.update(zip(new, range(len(self.n), len(self.n) + len(new)), strict=True))
        self.written = pa.concat_arrays([self.written, _joined(keys, n, ";")])
        self.of_piece = np.concatenate([self.of_piece, np.fromiter(map(self.group.__getitem__, listed), np.int64, len(listed))])
        self.n, self.good = np.concatenate([self.n, n]), np.concatenate([self.good, good])
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, n, links], 1)])

    def places(self, parts: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(p for p in parts if p not in self.at))
        for lo in range(0, len(new), ADDED):
            self.add(new[lo : lo + ADDED])
        return np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, back = np.unique(key, return_inverse=True)
    return each, np.bincount(back, weights=n, minlength=len(each)).astype(np.int64)


def encoded(interned: Interned, values: list[str]) -> tuple[np.ndarray, list[str], pa.ListArray, pa.ListArray]:
    """For each text its NUMBERS, the hash of its groups, its different groups and how often it has each."""
    numbers, good = np.zeros((len(values), len(NUMBERS)), np.int64), np.ones(len(values), bool)
    hashes, begun = [hashlib.sha256() for _ in values], [False] * len(values)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(interned.at) > MEMO:
        interned.clear()
    rows: list[int] = []
    sizes: list[int] = []
    parts: list[str] = []

    def flush() -> None:
        places, n = interned.places(parts), np.array(sizes, np.int64)
        row = np.repeat(np.array(rows, np.int64), n)
        good[row[~interned.good[places]]] = False
        for i, groups in zip(rows, _joined(interned.written.take(pa.array(places)), n, ";").to_pylist(), strict=True):
            hashes[i].update((";" + groups if begun[i] else groups).encode())
            begun[i] = True
        width = max(len(interned.n), 1)
        found.append(_summed(row * width + places, np.ones(len(row))))
        pair, n = found[-1]
        np.add.at(numbers, pair // width, interned.numbers[pair % width] * n[:, None])
        found[-1] = pair // width << 32 | pair % width, n
        rows.clear(), sizes.clear(), parts.clear()

    for row, text in enumerate(values):
        for some in pieces_of(text) if text else ():
            parts += some
            rows.append(row)
            sizes.append(len(some))
            if len(parts) > ADDED:
                flush()
    if parts:
        flush()
    numbers[~good] = 0
    pair, n = (np.concatenate([x[k] for x in found]) for k in range(2))
    row, piece = pair >> 32, pair & 0xFFFFFFFF
    keep = good[row]
    row, piece, n = row[keep], piece[keep], n[keep]
    size, first = interned.n[piece], np.cumsum(interned.n) - interned.n
    at = np.repeat(first[piece] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    width = max(len(interned.keys), 1)
    pair, n = _summed(np.repeat(row, size) * width + interned.of_piece[at], np.repeat(n, size))
    used, back = np.unique(pair % width, return_inverse=True)
    keys = pa.array([interned.keys[k] for k in used.tolist()], pa.string()).take(pa.array(back))
    offsets = pa.array(np.searchsorted(pair // width, np.arange(len(values) + 1)).astype(np.int32))
    told = [h.hexdigest() if some and text else "" for h, some, text in zip(hashes, good.tolist(), values, strict=True)]
    return numbers, told, pa.ListArray.from_arrays(offsets, keys), pa.ListArray.from_arrays(offsets, pa.array(n))


def _encode(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interned = Interned(tokenizers(a_path, b_path))
        for batch in batches:
            for part, values in steps(batch, "text"):
                numbers, hashes, keys, counts = encoded(interned, values.to_pylist())
                columns = [part.column("doc_id"), *[pa.array(numbers[:, k]) for k in range(len(NUMBERS))], pa.array(hashes, pa.string()), keys, counts]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *NUMBERS, "groups_sha256", "keys", "counts"])

    return run


def _expand(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        for batch in batches:
            made = []
            for key in batch.column("key").to_pylist():
                a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
                made.append(both.links(a, b))
            ids = lambda k: pa.array([[x[k] for x in links] for links in made], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "n", "documents")], ids(0), ids(1)], ["key", "n", "documents", "a", "b"])

    return run


def dictionary(ws: Workspace, encoded_docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(key, n, documents, n_best, count_sum) of each different group, and (a, b, count, best) of each linked id pair.

    n: how often the corpus has the group; documents: in how many of its texts; count: links of the pair; best: whether its count is the highest of b's.
    """
    each = encoded_docs.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("x.keys", "x.counts")
    groups = each.groupBy(F.col("keys").alias("key")).agg(F.sum("counts").alias("n"), F.count("*").alias("documents"))
    linked = ws.table(groups.mapInArrow(_expand(a_path, b_path), "key string, n long, documents long, a array<int>, b array<int>"), "groups")
    links = linked.select("key", "n", F.explode(F.arrays_zip("a", "b")).alias("x")).select("key", "n", "x.a", "x.b")
    pairs = ws.table(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    top = pairs.groupBy("b").agg(F.max("count").alias("top"))  # a row per id of b's vocabulary at most
    pairs = pairs.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    scored = links.join(pairs, ["a", "b"]).groupBy("key").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    return ws.table(linked.select("key", "n", "documents").join(scored, "key"), "dictionary"), pairs


def _common(groups: DataFrame, kept: int) -> DataFrame:
    """The most frequent groups, kept many at most: those above a bound that a histogram gives."""
    rank = F.floor(F.log2("n") * 16)
    short = groups.filter(F.length("key") <= KEPT_CHARS).withColumn("rank", rank)
    counts = short.groupBy("rank").count().toArrow().sort_by([("rank", "descending")])  # a thousand ranks at most
    within = np.cumsum(counts["count"].to_numpy()) <= kept
    return short.filter(F.col("rank") >= int(counts["rank"].to_numpy()[within].min())) if within.any() else short.limit(0)


def aligned(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, kept: int = KEPT) -> DataFrame:
    """docs(doc_id, text, ...) -> a row each: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text is encoded with a blank ahead, without special tokens; strings that look like some are plain text. n_best: links whose id pair has the highest count of its b in all
    documents, ties included; count_sum: all links' counts. groups_sha256: of the groups as ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and those whose bytes either tokenizer doesn't give
    back, have no tokens: zeros and ''. Repeated rows count as often as they stand; a null doc_id stays null. Other columns
    aren't read; an empty table gives no rows. A text is encoded whole, by one task, part by part.
    """
    ws = Workspace(spark, "crosstok")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string, keys array<string>, counts array<long>"
    made = docs.select("doc_id", "text").mapInArrow(_encode(a_path, b_path), schema)
    made = ws.table(made.withColumn("row", F.monotonically_increasing_id()), "encoded")
    groups, _ = dictionary(ws, made, a_path, b_path)
    scores = groups.select("key", "n", "n_best", "count_sum")
    common = _common(scores, kept).select("key", "n_best", "count_sum")
    each = made.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.counts").alias("times"))
    each = each.join(F.broadcast(common), "key", "left")  # kept rows of short keys at most
    sums = [F.sum(F.col("times") * F.col(c)).alias(c) for c in ("n_best", "count_sum")]
    near = each.filter("n_best is not null").groupBy("row").agg(*sums)
    far = each.filter("n_best is null").select("row", "key", "times").join(scores.join(F.broadcast(common.select("key")), "key", "left_anti"), "key").groupBy("row").agg(*sums)
    totals = near.unionByName(far).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return made.drop("keys", "counts").join(totals, "row", "left").select("doc_id", *NUMBERS, zero("n_best"), zero("count_sum"), "groups_sha256")
