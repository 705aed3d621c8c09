"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, under a softmax.

A document's features are its words, the character n-grams of each word between ``<`` and ``>``, and its pairs of
neighbouring words, all hashed into buckets with a learned vector each; a word that repeats its neighbour makes one feature
of its own, whichever word it is. The softmax over the mean vector and a bias gives the chance of good quality. Vectors
and softmax are trained by numpy stochastic gradient descent on a bounded sample of labelled documents. As the softmax is linear in the mean, scoring needs a
number per bucket alone, and it covers every document and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import Workspace, bounded_batches, pieces, segment_sums, split_words, texts

#: Labelled documents that the model is trained on, at most; those with the smallest hashes of doc_id.
SAMPLE = 3000
BUCKETS = 1 << 18
DIM = 10
#: Code points of character n-grams.
CHARS = (3, 4, 5)
#: Documents that training goes over, repeats counted: few documents are gone over more often. Steps take BATCH documents each.
DRAWN, BATCH, RATE = 15_000, 4, 1.0
#: Documents are held out whose crc32(doc_id as text) leaves this remainder; labels are learned from the others.
FOLDS, HELD = 3, 1
SEED = 7
#: Ranges of hashes that the sample is cut by.
_RANGES = 1 << 16
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: The bucket of a word that repeats its neighbour.
AGAIN = 0


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word, the buckets of all words' features (the word, then its n-grams), and how many each word has."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    point = np.frombuffer(("<" + "><".join(words.to_pylist()) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(size)), size)
    left = end[word] - np.arange(len(point))  # code points from here to the word's end
    mixed = (point + np.uint64(1)) * _P
    mixed ^= mixed >> np.uint64(31)
    with np.errstate(over="ignore"):
        at = np.arange(len(point)) - (end - size)[word]
        power = _Q ** np.arange(int(size.max()), dtype=np.uint64)
        whole = np.add.reduceat(mixed * power[at], end - size)
        owner, made = [np.arange(len(size))], [_bucket(whole * _R + np.uint64(1))]
        gram = np.zeros(len(point), np.uint64)
        for n in range(1, max(CHARS) + 1):
            whole_grams = max(len(point) - n + 1, 0)
            gram[:whole_grams] = gram[:whole_grams] * _Q + mixed[n - 1 :]
            if n in CHARS:
                some = np.flatnonzero(left >= n)
                owner.append(word[some])
                made.append(_bucket(gram[some] * _R + np.uint64(n << 8)))
    owner, made = np.concatenate(owner), np.concatenate(made)
    order = np.argsort(owner, kind="stable")
    return whole, made[order], np.bincount(owner, minlength=len(size))


def pair_buckets(hashes: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """The buckets of words and their neighbours ahead."""
    with np.errstate(over="ignore"):
        return np.where(hashes == ahead, AGAIN, _bucket((ahead * _P) ^ (hashes * _R)))


class Reader:
    """Words of texts, part by part; a long text's parts go on where the part ahead ended."""

    def __init__(self) -> None:
        self.text, self.last = -1, np.uint64(0)

    def read(self, part: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word in turn: its text, which distinct word it is, and its pair's bucket; the distinct words' buckets, and how many each has."""
        flat, counts = split_words(part, lower=False)
        coded = flat.dictionary_encode()
        hashes, bucket, size = word_features(coded.dictionary)
        of, text = coded.indices.to_numpy(zero_copy_only=False), np.repeat(owner, counts)
        hashes, ahead = hashes[of], np.zeros(len(of), np.uint64)
        if len(of):
            ahead[1:] = np.where(text[1:] == text[:-1], hashes[:-1], 0)
            ahead[0] = self.last if text[0] == self.text else 0
            self.text, self.last = int(text[-1]), hashes[-1]
        return text, of, pair_buckets(hashes, ahead), bucket, size


@dataclass(frozen=True)
class Model:
    """What a bucket's vector adds to the log-odds of good quality, which buckets were learned, and the bias."""

    odds: np.ndarray
    known: np.ndarray
    bias: float

    def scores(self, values: pa.Array) -> np.ndarray:
        """The softmax's chance of good quality for each text."""
        total, n = np.zeros(len(values)), np.zeros(len(values))
        reader = Reader()
        for part, owner in pieces(values):
            text, of, pair, bucket, size = reader.read(part, owner)
            each = segment_sums(self.odds[bucket], size)[of]
            each_n = segment_sums(self.known[bucket].astype(np.float64), size)[of]
            total += np.bincount(text, weights=each + self.odds[pair], minlength=len(values))
            n += np.bincount(text, weights=each_n + self.known[pair], minlength=len(values))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -60, 60)))


def document_features(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets in ascending order and how often it has them."""
    reader = Reader()
    found: list[list[np.ndarray]] = [[] for _ in range(len(values))]
    for part, owner in pieces(values):
        text, of, pair, bucket, size = reader.read(part, owner)
        start = np.cumsum(size) - size
        n = size[of]
        place = np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        which = np.concatenate([np.repeat(text, n), text])
        every = np.concatenate([bucket[place], pair])
        order = np.argsort(which, kind="stable")
        which, every = which[order], every[order]
        for i in np.unique(owner):
            lo, hi = np.searchsorted(which, [i, i + 1])
            found[i].append(every[lo:hi])
    for lists in found:
        yield np.unique(np.concatenate([*lists, np.zeros(0, np.int64)]), return_counts=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = list(document_features(texts(batch.column("text"))))
        lists = lambda k: pa.array([x[k].astype(np.int32) for x in got], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), lists(0), lists(1)], ["order", "label", "buckets", "counts"])


def step(vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray, bucket: np.ndarray, weight: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss of a batch, summed, and its gradients: of the softmax, the bias, and of the vectors of the distinct buckets given with it.

    bucket, weight: the documents' features one behind the other, of which a document has size many; its weights sum up to 1 (0 without features).
    """
    some = size > 0
    start = (np.cumsum(size) - size)[some]
    mean = np.zeros((len(size), vectors.shape[1]))
    if len(bucket):
        mean[some] = np.add.reduceat(vectors[bucket] * weight[:, None], start)
    z = mean @ softmax.T + bias
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    rows = np.arange(len(label))
    loss = -np.log(np.maximum(p[rows, label], 1e-12)).sum()
    p[rows, label] -= 1
    of_mean = p @ softmax
    each, back = np.unique(bucket, return_inverse=True)
    document = np.repeat(rows, size)
    pull = of_mean[document] * weight[:, None]
    order = np.argsort(back, kind="stable")
    starts = np.searchsorted(back[order], np.arange(len(each)))
    of_vectors = np.add.reduceat(pull[order], starts) if len(each) else np.zeros((0, vectors.shape[1]))
    return float(loss), p.T @ mean, p.sum(0), each, of_vectors


def fit(bucket: np.ndarray, count: np.ndarray, size: np.ndarray, label: np.ndarray, drawn: int = DRAWN, seed: int = SEED) -> Model:
    """Documents' features one behind the other, and their labels (0 or 1) -> the model."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    softmax, bias = np.zeros((2, DIM)), np.zeros(2)
    start = np.cumsum(size) - size
    weight = count / np.repeat(np.maximum(segment_sums(count, size), 1), size)
    total, done = max(drawn, len(label)), 0
    while done < total:
        order = rng.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            n = size[some]
            at = np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            _, of_softmax, of_bias, each, of_vectors = step(vectors, softmax, bias, bucket[at], weight[at], n, label[some])
            rate = RATE * max(1 - done / total, 0)
            softmax -= rate * of_softmax
            bias -= rate * of_bias
            vectors[each] -= rate * of_vectors
            done += len(some)
    known = np.zeros(BUCKETS, bool)
    known[bucket] = True
    odds = np.where(known, vectors @ (softmax[1] - softmax[0]), 0.0)
    return Model(odds, known, float(bias[1] - bias[0]))


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sampled(labels: DataFrame, sample: int) -> DataFrame:
    """labels(doc_id, quality) -> (doc_id, label, order) of at most so many documents: those in the lowest whole ranges of hashes.

    Of repeated labels any poor one counts; null ones, those of held-out documents and those without a doc_id don't.
    """
    per = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("label"))
    hashed = F.xxhash64("doc_id")
    per = per.filter(remainder(F.col("doc_id")) != HELD).select("doc_id", "label", hashed.alias("order"), F.shiftrightunsigned(hashed, 48).alias("range"))
    counts = per.groupBy("range").count().toArrow()  # a row per range, _RANGES at most
    n = np.zeros(_RANGES, np.int64)
    n[counts["range"].to_numpy()] = counts["count"].to_numpy()
    return per.filter(F.col("range") < int(np.searchsorted(np.cumsum(n), sample, "right"))).drop("range")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, drawn: int = DRAWN) -> Model:
    """Trains on sampled labelled documents that aren't held out; of rows with one doc_id the text that sorts first counts."""
    ws = Workspace(spark, "subword")
    some = ws.table(sampled(labels, sample), "labels")
    one = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label", "order").agg(F.min("text").alias("text"))  # sample rows at most
    got = one.select("order", "label", "text").mapInArrow(_features, "order long, label int, buckets array<int>, counts array<int>")
    seen = ws.table(got, "features").toArrow().sort_by([("order", "ascending"), ("label", "ascending")])  # bounded by the sample
    ws.close()
    if not seen.num_rows:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS, bool), 0.0)
    flat = lambda c: seen[c].combine_chunks().flatten().to_numpy()
    size = pc.list_value_length(seen["buckets"]).to_numpy().astype(np.int64)
    return fit(flat("buckets"), flat("counts").astype(np.float64), size, seen["label"].to_numpy(), drawn)


def _score(model: Model):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(model.scores(texts(part)))
            pa.default_memory_pool().release_unused()

    return run


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, drawn: int = DRAWN) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, score, predicted for every row.

    score (0 to 1) is the chance of good quality as labels(doc_id, quality) mark it, learned from labels of documents that
    aren't held out and from their texts alone. A null text is an empty one, and texts without words, or with unlearned
    features only, get what the bias says. Repeated rows stay rows, a null doc_id counts as an empty one for the fold, and other columns aren't
    read. Without labels every score is 0.5; an empty table gives no rows.
    """
    bounded_batches(spark)
    model = train(spark, docs, labels, sample, drawn)
    score = F.arrow_udf(_score(model), "double")
    made = docs.select("doc_id", (remainder(F.col("doc_id")) == HELD).alias("held_out"), score(F.col("text")).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
