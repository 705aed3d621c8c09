"""Log-bilinear language model trained with noise-contrastive estimation.

The neural model predicts units: the end of a text, the most frequent words, and groups of the other words by their last
letters. Context units give vectors r, weighed by place into ``q = c0 * r[u1] + c1 * r[u2] + c2 * mean(r[u3 .. u18])``, and
a unit scores ``q.e + b``. It is trained in numpy by noise-contrastive estimation with sampled noise: in each round every
task takes the same share of its training tokens, blocks in random order, from the last round's parameters on, and what the tasks
come to is averaged by the tokens they took. Rounds take different blocks, so that every training token is taken. Scoring normalises every token's
distribution over all units, by products of what each unit of its context does to each unit. A word of a group has its share of the
group by counts, of which unknown words have what words seen once had (Good and Turing's estimate).
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import STEP_BYTES, Workspace, filesystem, row_key, segment_sums, split_words, steps
from lexiforge.llm.simhash import joined_at
from lexiforge.llm.xxh64 import hash_runs

#: Units of their own, at most, and groups of other words; every token is scored against all of them.
OWN, GROUPS, SUFFIX = 272, 47, 3
#: Words whose counts every worker holds (16 bytes each, under 8 MB with their units); the counts of all others are joined.
HELD = 1 << 18
#: Size of vectors, units behind the second that the context's mean goes over, and noise units drawn for a batch.
SIZE, FAR, NOISE = 32, 16, 128  # FAR: a power of two
#: Rounds with their steps' size, the share of its tokens that a task takes in each unless the caller names another (so all rounds together take every token once; 1: all in each), tokens of a step at most, and the steps
#: that a task makes at least, with fewer tokens each or some tokens again.
RATES = (0.03, 0.03, 0.015)
SHARE, BATCH, LEAST = 1 / len(RATES), 2048, 100
#: Tokens that a task trains on, or fewer in a smaller corpus: what fewer tokens come to is too far apart to be averaged.
TOKENS = 1 << 21
#: Tokens that are scored at a time.
ROWS = 1024
END = 0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _hashes(column: pa.Array, seed: int = 0) -> np.ndarray:
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = column.buffers()[2].to_pybytes()[joined_at(column)] if size.sum() else b""
    return hash_runs(data, np.cumsum(size) - size, size, seed) if len(size) else np.zeros(0, np.uint64)


def suffix_group(words: pa.Array) -> np.ndarray:
    """The group of a word that isn't a unit of its own, from 0: by its last letters."""
    return (_hashes(pc.utf8_slice_codeunits(words, -SUFFIX)) % np.uint64(GROUPS)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's words; each part of about 64 MB of text is summed before it leaves."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    parts: list[pa.Table] = []
    for batch in batches:
        for _, values in steps(batch, "text"):
            flat, _ = split_words(values)
            got = flat.value_counts()
            parts.append(pa.table({"word": got.field("values"), "n": got.field("counts")}))
            if len(parts) == 16:
                parts = [summed(parts)]
                if parts[0].num_rows > 1 << 20:
                    yield from parts.pop().to_batches(1 << 16)
    if parts:
        yield from summed(parts).to_batches(1 << 16)


def count_bounds(words: DataFrame, *most: int) -> list[int]:
    """For each number the least count of which no more words have it or a higher one.

    Counts meet as a histogram of fixed size: each count up to 64, and 32 ranges an octave beyond.
    """
    n = F.col("n")
    cell = F.when(n <= 64, n.cast("double")).otherwise(F.floor(F.log2(n.cast("double")) * 32) + 1000)
    cells = words.groupBy(cell.alias("cell")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.col("cell").desc()).collect()
    out = []
    for limit in most:
        bound, total = (cells[0]["least"] if cells else 0) + (1 << 62), 0
        for r in cells:
            total += r["words"]
            if total > limit:
                break
            bound = r["least"]
        out.append(bound)
    return out


class Held:
    """The most frequent words: hashes in order, counts, and units; those counted ``own`` times or more are units of their own."""

    def __init__(self, fs, path: str, own: int) -> None:
        files = sorted(f.path for f in fs.get_file_info(FileSelector(path)) if f.path.endswith(".parquet"))
        table = pa.concat_tables([pq.read_table(f, filesystem=fs) for f in files])
        words = table["word"].combine_chunks()
        words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
        n = table["n"].to_numpy()
        at = np.flatnonzero(n >= own)
        names = words.take(pa.array(at)).to_pylist()
        first = [i for _, _, i in sorted((-int(n[i]), w, i) for w, i in zip(names, at.tolist(), strict=True))]
        self.own = len(first)
        self.units = self.own + 1 + GROUPS
        units = self.own + 1 + suffix_group(words) if len(words) else np.zeros(0, np.int64)
        units[first] = np.arange(1, len(first) + 1)
        hashes = _hashes(words)
        order = np.argsort(hashes)
        self.hashes, self.n, self.unit = hashes[order], n[order], units[order].astype(np.int16)

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1: not held) and units of words."""
        n, units = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        if not len(words):
            return n, units
        h = _hashes(words)
        units = self.own + 1 + suffix_group(words)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[at] == h
            n[same], units[same] = self.n[at[same]], self.unit[at[same]]
        return n, units


_HELD: dict[str, Held] = {}


def held(path: str, own: int) -> Held:
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Held(*filesystem(path), own)
    return _HELD[path]


def _group_counts(words: DataFrame, top: str, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each group, and words that it has once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, GROUPS), np.int64)
        for batch in batches:
            h = held(top, own)
            _, units = h.look(batch.column("word"))
            n = batch.column("n").to_numpy()
            some = units > h.own
            group = units[some] - h.own - 1
            total[0] += np.bincount(group, weights=n[some], minlength=GROUPS).astype(np.int64)
            total[1] += np.bincount(group, weights=n[some] == 1, minlength=GROUPS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(total[0]), pa.array(total[1])], ["g", "n", "once"])

    out = np.zeros((2, GROUPS), np.int64)
    for r in words.select("word", "n").mapInArrow(run, "g long, n long, once long").groupBy("g").agg(F.sum("n"), F.sum("once")).collect():  # a row per group
        out[:, r[0]] = r[1], r[2]
    return out[0], out[1]


def group_shares(n: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of an unknown word's share of each group, and of what a known word's count is multiplied with."""
    unknown = np.where(n > 0, (once + 0.5) / (n + 1.0), 1.0)
    return np.log10(unknown), np.log10(np.maximum(1 - unknown, 1e-12) / np.maximum(n, 1))


def _encode(top: str, own: int, unknown: np.ndarray, known: np.ndarray, ends: int):
    """Per document its units, what the held words give, and the words whose counts must be joined with their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in steps(batch, "text"):
                words = held(top, own)
                flat, counts = split_words(values)
                coded = flat.dictionary_encode()
                of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                n, units = words.look(coded.dictionary)
                group = units - words.own - 1
                of_group = np.maximum(group, 0)
                share = np.where(group < 0, 0.0, np.where(n > 0, np.log10(np.maximum(n, 1)) + known[of_group], unknown[of_group]))
                size = counts + 1
                stop = np.cumsum(size)
                ids = np.full(int(size.sum()), END, np.int16)
                is_word = np.ones(len(ids), bool)
                is_word[stop - 1] = False
                ids[is_word] = units[of]
                data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], 2 * stop]).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                rare = np.flatnonzero(n[of] < 0)
                doc = np.repeat(np.arange(len(counts)), counts)[rare]
                lists = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(counts)))).astype(np.int32))
                pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(of[rare])), pa.array(group[of[rare]].astype(np.int16))], ["word", "g"])
                columns = [
                    part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(segment_sums((n[of] >= 0).astype(np.int64), counts) + (ends > 0)),
                    pa.array(segment_sums(np.log10(np.maximum(n, 0) + 1.0)[of], counts) + np.log10(ends + 1)), pa.array(segment_sums(share[of], counts)), data, pa.ListArray.from_arrays(lists, pairs),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "units", "rare"])

    return run


# ---- the neural model

Parameters = dict[str, np.ndarray]


def initial(unigram: np.ndarray, seed: int = 5) -> Parameters:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.normal(0, 0.1, (len(unigram), SIZE)).astype(np.float32)
    return {"r": draw(), "c": np.ones((3, SIZE), np.float32), "e": draw(), "b": np.log(unigram).astype(np.float32)}


def contexts(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens at ``at``, whose texts begin at first[at]: the units one and two before (the end ahead of a text), and from where to where the far ones are."""
    one = np.where(at - 1 >= first[at], ids[np.maximum(at - 1, 0)], END)
    two = np.where(at - 2 >= first[at], ids[np.maximum(at - 2, 0)], END)
    hi = np.maximum(at - 2, first[at])
    return one, two, np.maximum(at - 2 - FAR, first[at]), hi


def nce_step(p: Parameters, context: tuple[np.ndarray, np.ndarray, np.ndarray], target: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> tuple[float, Parameters]:
    """Mean loss of a batch, and its gradient, for tokens anywhere; training takes run_gradient, which is held against it. context: units one and two before, and each unit's share of the far ones; noise: drawn units."""
    one, two, far = context
    n, units, kind = len(target), len(p["b"]), p["r"].dtype
    parts = (p["r"][one], p["r"][two], far @ p["r"])
    q = sum(c * x for c, x in zip(p["c"], parts, strict=True))
    data = (q * p["e"][target]).sum(1) + p["b"][target] - log_noise[target]
    other = q @ p["e"][noise].T + p["b"][noise] - log_noise[noise]
    up, down = 1 / (1 + np.exp(-np.clip(data, -40, 40))), 1 / (1 + np.exp(-np.clip(other, -40, 40)))
    loss = float(-(np.log(np.maximum(up, 1e-12)).sum() + np.log(np.maximum(1 - down, 1e-12)).sum()) / n)
    up, down = (up - 1) / n, down / n
    dq = up[:, None] * p["e"][target] + down @ p["e"][noise]
    g, rows = {}, np.arange(n)

    def summed(of: np.ndarray, values: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
        """By unit: a product with an indicator matrix, which is faster than adding rows one by one."""
        hot = np.zeros((n, units), kind)
        hot[rows, of] = weight
        return hot.T @ values

    g["e"] = summed(target, q, up)
    np.add.at(g["e"], noise, down.T @ q)
    g["b"] = (np.bincount(target, up, units) + np.bincount(noise, down.sum(0), units)).astype(kind)
    g["c"] = np.stack([(dq * x).sum(0) for x in parts])
    g["r"] = summed(one, dq * p["c"][0]) + summed(two, dq * p["c"][1]) + far.T @ (dq * p["c"][2])
    return loss, g


def context_of(ids: np.ndarray, first: np.ndarray, at: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one, two, lo, hi = contexts(ids, first, at)
    size = hi - lo
    row = np.repeat(np.arange(len(at)), size)
    place = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(row))
    far = np.zeros(len(at) * units, np.float32)
    np.add.at(far, row * units + ids[place], (1 / np.maximum(size, 1)).astype(np.float32)[row])
    return one, two, far.reshape(len(at), units)


def _by_unit(of: np.ndarray, values: np.ndarray, units: int) -> np.ndarray:
    """Sums of rows by unit."""
    order = np.argsort(of.astype(np.int16), kind="stable")
    ordered = of[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    out = np.zeros((units, values.shape[1]), values.dtype)
    out[ordered[starts]] = np.add.reduceat(values.take(order, axis=0), starts, axis=0)
    return out


def window_sums(rows: np.ndarray, width: int = FAR) -> np.ndarray:
    """Sums of so many rows, a power of two, from each place on."""
    k = 1
    while k < width:
        rows, k = rows[:-k] + rows[k:], 2 * k
    return rows


def _add_behind(to: np.ndarray, rows: np.ndarray, at: int) -> None:
    """Adds rows from place ``at`` on; those ahead of the first place are left out."""
    rows = rows[max(-at, 0) :]
    to[max(at, 0) : max(at, 0) + len(rows)] += rows


def run_gradient(p: Parameters, ids: np.ndarray, first: np.ndarray, lo: int, hi: int, drawn: np.ndarray, times: np.ndarray, log_noise: np.ndarray) -> Parameters:
    """nce_step's gradient of the tokens from lo to hi, which stand together, so that far units' sums and their gradients come from sums over windows, near the beginning of a text from running sums.

    drawn: different units, drawn as noise so many times each.
    """
    base = max(lo - FAR - 2, 0)
    n, units, near = hi - lo, len(p["b"]), ids[base:hi]
    r, target = p["r"].take(near, axis=0), ids[lo:hi]
    at, begin = np.arange(lo - base, hi - base), np.maximum(first[lo:hi] - base, 0)
    parts, has = [], []
    for k in (1, 2):
        has.append(at - k >= begin)
        x = r.take(np.maximum(at - k, 0), axis=0)
        x[~has[-1]] = p["r"][END]
        parts.append(x)
    b, a = np.maximum(at - 2, begin), np.maximum(at - 2 - FAR, begin)
    size = np.maximum(b - a, 1).astype(r.dtype)[:, None]
    # Tokens with fewer than FAR far units, of which some have any, and the places near that these stand at, put together.
    part = at - 2 - FAR < begin
    some = np.flatnonzero(part & (b > a))
    begun = first[base:hi] - base
    in_head = (begun >= 0) & (np.arange(len(near)) - begun < FAR + 2)
    heads, rank = np.flatnonzero(in_head), np.cumsum(in_head) - in_head
    from_, to = rank[a[some]], rank[b[some]]
    ahead = np.concatenate([np.zeros((1, SIZE), r.dtype), np.cumsum(r.take(heads, axis=0), axis=0)])
    lead, x = FAR + 2 - (lo - base), np.zeros((n, SIZE), r.dtype)
    x[lead:] = window_sums(r)[: max(n - lead, 0)]
    x[part] = 0
    x[some] = ahead[to] - ahead[from_]
    x /= size
    parts.append(x)
    q = p["c"][0] * parts[0]
    q += p["c"][1] * parts[1]
    q += p["c"][2] * parts[2]
    e_t, e_n = p["e"].take(target, axis=0), p["e"][drawn]
    data = np.einsum("ij,ij->i", q, e_t) + p["b"][target] - log_noise[target]
    up = (1 / (1 + np.exp(-np.clip(data, -40, 40))) - 1) / n
    down = q @ -e_n.T
    down -= p["b"][drawn] - log_noise[drawn]
    with np.errstate(over="ignore"):  # beyond exp's bounds the chance is 0
        np.exp(down, out=down)
    down += 1
    np.divide((times / n).astype(r.dtype), down, out=down)
    up = up.astype(r.dtype)
    dq = down @ e_n
    e_t *= up[:, None]
    dq += e_t
    g = {"e": _by_unit(target, up[:, None] * q, units), "b": np.bincount(target, up, units).astype(r.dtype), "c": np.stack([np.einsum("ij,ij->j", dq, x) for x in parts])}
    g["e"][drawn] += down.T @ q
    g["b"][drawn] += np.ones(n, r.dtype) @ down
    # What each place near gets: as unit before, as second before, and as one of the far ones of the tokens whose range holds it.
    far, end = dq * (p["c"][2] / size), np.zeros(SIZE, r.dtype)
    behind = np.zeros((len(near) + FAR + 2, SIZE), r.dtype)
    behind[lo - base : len(near)] = far
    behind[at[part]] = 0
    place = window_sums(behind)[3:]
    if len(some):
        edge, far = np.zeros((len(heads) + 1, SIZE), r.dtype), far[some]
        texts = np.flatnonzero(np.diff(from_, prepend=-1))  # a text's tokens have one beginning, and each an end of its own
        edge[from_[texts]] += np.add.reduceat(far, texts, axis=0)
        edge[to] -= far
        place[heads] += np.cumsum(edge[:-1], axis=0)
    for k in (1, 2):
        d, none = dq * p["c"][k - 1], ~has[k - 1]
        end += d[none].sum(0)
        d[none] = 0
        _add_behind(place, d, lo - base - k)
    g["r"] = _by_unit(near, place, units)
    g["r"][END] += end
    return g


def round_blocks(n: int, size: int, share: float, k: int, rng: np.random.Generator) -> np.ndarray:
    """Where round k's blocks of ``size`` tokens begin among n: rounds take turns in one random order, so each takes others until all are taken."""
    order = rng.permutation(-(-n // size))
    lo, hi = (round(share * len(order) * i) for i in (k, k + 1))
    return order[np.arange(lo, min(hi, lo + len(order))) % len(order)] * size


def descend(p: Parameters, ids: np.ndarray, first: np.ndarray, begins: np.ndarray, size: int, steps_: int, rate: float, noise: np.ndarray, rng: np.random.Generator) -> tuple[Parameters, int]:
    """So many Adam steps over blocks of tokens, in turn -> the parameters, and how many tokens were taken."""
    p = {k: v.copy() for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    log_noise = np.log(NOISE * noise).astype(np.float32)
    ahead, taken = np.cumsum(noise), 0
    for step in range(1, steps_ + 1):
        lo = int(begins[(step - 1) % len(begins)])
        hi = min(lo + size, len(ids))
        taken += hi - lo
        drawn, times = np.unique(np.minimum(np.searchsorted(ahead, rng.random(NOISE) * ahead[-1], "right"), len(noise) - 1), return_counts=True)
        g = run_gradient(p, ids, first, lo, hi, drawn, times, log_noise)
        now = rate * min(1, 2 * (1 - (step - 1) / steps_))
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
            p[k] -= now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
    return p, taken


def flat_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All units of a batch's texts, and where each token's text begins."""
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    ids = np.frombuffer(b"".join(column.to_pylist()), np.int16).astype(np.int64)
    return ids, np.repeat(np.cumsum(counts) - counts, counts)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of STEP_BYTES / 4 tokens or so, one text at least."""
    size = pc.binary_length(batch.column("units")).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // (STEP_BYTES // 2)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)] if len(size) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def save(path: str, **arrays: np.ndarray) -> None:
    data = io.BytesIO()
    np.savez(data, **arrays)
    fs, at = filesystem(path)
    with fs.open_output_stream(at) as f:
        f.write(data.getbuffer())


_LOADED: dict[str, Parameters] = {}


def load(path: str) -> Parameters:
    if path not in _LOADED:
        fs, at = filesystem(path)
        with fs.open_input_file(at) as f:
            got = np.load(io.BytesIO(f.read()))
        _LOADED.clear()
        _LOADED[path] = {k: got[k] for k in got.files}
    return _LOADED[path]


def plan_steps(n: int, share: float, first: bool) -> tuple[int, int]:
    """How many steps go over n tokens' share, and how many tokens each takes; a share of 1 takes every token once at least."""
    draws = share * n
    size = int(np.clip(draws / LEAST, 128, BATCH))
    steps_ = math.ceil(draws / size) if share >= 1 else round(draws / size)
    return max(LEAST if first else 1, steps_), size


def _round(path: str, rate: float, k: int, share: float):
    """A task's parameters after its tokens of round k, a row per unit, weighed by the tokens taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = load(path)
        noise = got["noise"]
        start = p = {c: got[c] for c in ("r", "c", "e", "b")}
        task, total, at = TaskContext.get().partitionId(), 0, 0
        rng = np.random.default_rng([11 + k, task])
        for batch in batches:
            for part in _slices(batch):
                ids, first = flat_units(part.column("units"))
                if not len(ids):
                    continue
                least, size = plan_steps(len(ids), share, not total)
                order = lambda: np.random.default_rng([7, task, at])  # noqa: B023, E731  the same in all rounds
                begins = round_blocks(len(ids), size, share, k, order())
                if not len(begins) and not total:  # fewer blocks than rounds
                    begins = round_blocks(len(ids), size, 1, 0, order())
                at += 1
                if len(begins):
                    n = max(len(begins), least if not total else 0)
                    p, taken = descend(p, ids, first, begins, size, n, rate, noise, rng)
                    total += taken
        if p is not start:
            rows = np.zeros((len(noise) + 3, 2 * SIZE + 1))
            rows[:-3] = np.hstack([p["r"], p["e"], p["b"][:, None]])
            rows[-3:, :SIZE] = p["c"]
            lists = pa.FixedSizeListArray.from_arrays(pa.array((rows * total).ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), float(total))), lists], ["unit", "taken", "v"])

    return run


def train(ws: Workspace, units: DataFrame, unigram: np.ndarray, tokens: int, share: float = SHARE) -> Parameters:
    """units(units binary) of all training texts -> the parameters. Rounds take different tokens, all of them together at least where share is SHARE or more."""
    p, width = initial(unigram), 2 * SIZE + 1
    units = units.coalesce(max(1, -(-tokens // TOKENS)))  # small partitions of a small corpus are read together
    if tokens <= TOKENS:  # what one task takes has an order of its own, however the files lie: a few steps would show it
        units = units.sortWithinPartitions(F.xxhash64("units"))
    for k, rate in enumerate(RATES):
        save(ws.at(f"round-{k}.npz"), noise=unigram, **p)
        sums = [F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)]
        rows = units.mapInArrow(_round(ws.at(f"round-{k}.npz"), rate, k, share), "unit long, taken double, v array<double>").groupBy("unit").agg(F.sum("taken").alias("taken"), *sums).toArrow()  # a row per unit
        if not rows.num_rows:
            break
        order = np.argsort(rows["unit"].to_numpy())
        v = np.stack([rows[f"v{i}"].to_numpy()[order] / rows["taken"].to_numpy()[order] for i in range(width)], 1).astype(np.float32)
        p = {"r": v[:-3, :SIZE], "c": v[-3:, :SIZE], "e": v[:-3, SIZE : 2 * SIZE], "b": v[:-3, 2 * SIZE]}
    return {k: np.ascontiguousarray(x) for k, x in p.items()}


def parts_of_scores(p: Parameters) -> list[np.ndarray]:
    """By unit of the context, what it adds to every unit's score: one before, two before (with the unit's bias), as the mean of the far ones."""
    r, e, c = (p[k].astype(np.float64) for k in ("r", "e", "c"))
    return [(c[0] * r) @ e.T, (c[1] * r) @ e.T + p["b"], (c[2] * r) @ e.T]


def head_chances(p: Parameters, ids: np.ndarray, first: np.ndarray, most: float) -> np.ndarray:
    """log10 of each token's unit, normalised over all units, from its context's vector; for texts of any length. most: what no score exceeds."""
    out = np.empty(len(ids))
    turned, weight = np.ascontiguousarray(p["e"].T), np.exp(p["b"])
    weighed = [p["c"][k] * p["r"] for k in range(3)]
    far_of = weighed[2].astype(np.float64)
    # Where no score can come near exp's bounds they aren't shifted.
    safe = most + np.abs(p["b"]).max() <= 80
    room = np.empty((min(ROWS, len(ids)), len(p["b"])), np.float32)
    for lo in range(0, len(ids), ROWS):
        hi = min(lo + ROWS, len(ids))
        base = max(lo - FAR - 2, 0)
        at, begin = np.arange(lo - base, hi - base), np.maximum(first[lo:hi] - base, 0)
        near = ids[base:hi]
        one, two = (np.where(at - k >= begin, near[np.maximum(at - k, 0)], END) for k in (1, 2))
        b, a = np.maximum(at - 2, begin), np.maximum(at - 2 - FAR, begin)
        ahead = np.concatenate([np.zeros((1, SIZE)), np.cumsum(far_of[near], axis=0)])
        q = ((ahead[b] - ahead[a]) / np.maximum(b - a, 1)[:, None]).astype(np.float32)
        q += weighed[0][one]
        q += weighed[1][two]
        target = near[lo - base :]
        mine = np.einsum("ij,ij->i", q, p["e"][target]) + p["b"][target]
        scores = np.matmul(q, turned, out=room[: hi - lo])
        if safe:
            total = np.exp(scores, out=scores) @ weight
        else:
            scores += p["b"]
            top = scores.max(1)
            scores -= top[:, None]
            mine -= top
            total = np.exp(scores, out=scores).sum(1)
        out[lo:hi] = (mine - np.log(total)) / np.log(10)
    return out


def log_chances(p: Parameters, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of each token's unit, normalised over all units.

    A score is a sum over the units of the context, so exp of it is a product of one factor of each, which tables hold.
    The FAR factors that a token shares with the next one are multiplied in pairs, fours and so on, so a token
    takes a few products of rows, and neither its vector nor exp. The first FAR + 2 tokens of a text, whose
    far units are fewer, and models whose products could leave double's range take head_chances.
    """
    reach, scores = FAR + 2, parts_of_scores(p)
    place, most = np.arange(len(ids)) - first, sum(np.abs(x).max() for x in scores)
    # What all units' factors have in common doesn't change their shares.
    scores = [x - (x.max(1, keepdims=True) + x.min(1, keepdims=True)) / 2 for x in scores]
    spread = sum(x.max() for x in scores)
    if spread > 650 or not (place >= reach).any():
        return head_chances(p, ids, first, most)
    kind = np.float32 if spread <= 80 else np.float64
    out, head = np.empty(len(ids)), place < reach
    before = np.cumsum(head) - head  # the heads put together are texts, too
    out[head] = head_chances(p, ids[head], before[first[head]], most)
    one, two, far = (np.exp(x / k).astype(kind) for x, k in zip(scores, (1, 1, FAR), strict=True))
    rooms = [np.empty((ROWS + FAR, len(p["b"])), kind) for _ in range(2)]
    every = np.ones(len(p["b"]), kind)
    for lo in range(reach, len(ids), ROWS):
        n = min(ROWS, len(ids) - lo)
        if head[lo : lo + n].all():
            continue
        now, k = np.take(far, ids[lo - reach : lo + n - 3], axis=0, out=rooms[0][: n + FAR - 1], mode="clip"), 1
        other = rooms[1]
        while k < FAR:
            to = other[: len(now) - k]
            np.multiply(now[:-k].reshape(-1), now[k:].reshape(-1), out=to.reshape(-1))
            now, other, k = to, rooms[0] if to.base is rooms[1] else rooms[1], 2 * k
        for table, back in ((one, 1), (two, 2)):
            now *= np.take(table, ids[lo - back : lo - back + n], axis=0, out=other[:n], mode="clip")
        got = np.flatnonzero(~head[lo : lo + n])
        out[lo + got] = np.log10(now[got, ids[lo + got]] / (now @ every)[got])
    return out


def _score(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                ids, first = flat_units(part.column("units"))
                sums = segment_sums(log_chances(load(path), ids, first), part.column("n_tokens").to_numpy())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sums)], [*names, "neural"])

    return run


def scored(spark: SparkSession, docs: DataFrame, share: float = SHARE) -> tuple[DataFrame, Parameters]:
    """score's rows, and the neural model's parameters."""
    ws = Workspace(spark, "lm")
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    texts = rows.filter(~F.col("held_out")).select("text")
    words = ws.table(texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = texts.count()
    n, v = total + ends, distinct + (1 if ends else 0)
    own, least = count_bounds(words, OWN, HELD)
    ws.table(words.filter(F.col("n") >= least), "top")
    top = ws.at("top")
    of_group, once = _group_counts(words, top, own)
    unknown, known = group_shares(of_group, once)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, inside double, units binary, rare array<struct<word:string,g:smallint>>"
    parts = row_key(ws.table(rows.mapInArrow(_encode(top, own, unknown, known, ends), schema), "parts"))
    frequent = words.filter(F.col("n") >= own).orderBy(F.col("n").desc(), "word").select("n").toArrow()["n"].to_numpy()  # OWN rows at most
    counts = np.concatenate([[ends], frequent, of_group]) + 0.5
    p = train(ws, parts.filter(~F.col("held_out")).select("units"), counts / counts.sum(), n, share)
    save(ws.at("model.npz"), **p)
    names = ["_file", "_row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside"]
    typed = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in names)
    made = parts.select(*names, "units").mapInArrow(_score(ws.at("model.npz"), names), f"{typed}, neural double")
    rare = parts.select("_file", "_row", F.explode("rare").alias("x")).select("_file", "_row", F.col("x.word").alias("word"), F.col("x.g").alias("g"))
    found = rare.join(words.filter(F.col("n") < least), "word")  # words that many tokens share are held
    change = F.get(F.array(*map(F.lit, (known - unknown).tolist())), F.col("g").cast("int"))
    found = found.groupBy("_file", "_row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + 1)).alias("s"), F.sum(F.log10(F.col("n").cast("double")) + change).alias("t"))
    joined = made.join(found, ["_file", "_row"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("s") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("neural") + F.col("inside") + zero("t")).alias("score"),
    )
    return out, p


def score(spark: SparkSession, docs: DataFrame, share: float = SHARE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Training texts are those with crc32(doc_id as text) mod 7 other than 2; a null doc_id counts as an empty
    text there. Null texts are empty: only the end is a token. Repeated rows are counted and scored each. Words that tie
    in their count come by code point. Without training texts N and V are 0 and the model is as good as uniform over its
    units. share is that of the tokens each round trains on, by default other ones in each until all are taken; 1 takes all of them, once a round at least. An empty table gives no rows. Other columns aren't read.
    """
    return scored(spark, docs, share)[0]
