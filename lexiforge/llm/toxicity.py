"""Toxicity as an ordinal grade: a cumulative-link model over sparse words, fitted in numpy.

P(grade > k | x) = sigmoid(w.x - theta_k) with one w for all ordered thresholds theta_0 < theta_1. The grades
are the raters': 0 for clean texts of good quality, 1 for clean ones of poor quality, 2 for toxic
ones. x says which words, and which first letters of words, a text has. The model is fitted
on a bounded sample of labelled documents; scoring covers every document and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import Workspace, bounded_batches, free_names, pieces, row_key, split_words, steps, texts
from lexiforge.llm.simhash import joined_at
from lexiforge.llm.xxh64 import hash_runs

#: Labelled documents that the model is fitted on, at most; those with the smallest hashes of doc_id.
SAMPLE = 16_000
#: A feature counts if it is in so many of the sample's documents, and its share of a grade's documents or of those above
#: is so many standard errors from that of all documents.
LEAST_DOCS, LEAST_ERRORS = 5, 5.0
#: A word's first letters are a feature beside the word.
PREFIX = 5
GRADES = 3
#: Every so-many-th document of the sample finds the chance from which on a text is rejected.
HELD = 5
EDGES = " .,!?;:#$%&*()[]{}\"'|-_/\\<>=+~`@^"
#: Ranges of hashes that the sample is cut by.
_RANGES = 1 << 16
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Model:
    """Hashes of features in ascending order, their weights, the thresholds, and the chance of toxicity that is rejected."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    reject: float = 0.5

    def chances(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(sums[:, None] - self.thresholds, -60, 60)))


def word_hashes(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash of the word and of its first letters for all words, and words per text.

    Words are lower-cased and bare of punctuation at their ends.
    """
    flat, counts = split_words(values)
    coded = flat.dictionary_encode()
    bare = pc.utf8_trim(pc.utf8_lower(coded.dictionary), EDGES)
    hashes = []
    for seed, column in enumerate((bare, pc.utf8_slice_codeunits(bare, 0, PREFIX))):
        size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        data = column.buffers()[2].to_pybytes()[joined_at(column)] if size.sum() else b""
        hashes.append(hash_runs(data, np.cumsum(size) - size, size, seed) if len(size) else np.zeros(0, np.uint64))
    of = coded.indices.to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(counts)), counts), hashes[0][of], hashes[1][of], counts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of words and first letters, and four min-hashes over pairs of words."""
    for batch in batches:
        for part, values in steps(batch, "text"):
            text, word, prefix, counts = word_hashes(values)
            pair = word.copy()
            pair[1:] ^= word[:-1] * np.uint64(3)
            some = counts > 0
            at = (np.cumsum(counts) - counts)[some]
            sketch = np.zeros((len(counts), 4), np.uint64)
            for k in range(4):
                if len(at):
                    sketch[some, k] = np.minimum.reduceat(pair * _MULTIPLIERS[k] ^ (pair * _MULTIPLIERS[k] >> np.uint64(31)), at)
            text, word = np.concatenate([text, text]), np.concatenate([word, prefix])
            order = np.lexsort((word, text))
            t, w = text[order], word[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1])
            first = np.flatnonzero(new)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(t[first], minlength=len(counts)))]).astype(np.int32)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("grade"), lists(w[first].view(np.int64)), pa.array(sketch.view(np.int64).tolist(), pa.list_(pa.int64()))],
                ["doc_id", "grade", "words", "sketch"],
            )


def one_of_copies(sketches: np.ndarray) -> np.ndarray:
    """Rows that agree with no earlier row in three of the four min-hashes, so that copies count once and like texts don't."""
    keep = np.ones(len(sketches), bool)
    for three in combinations(range(sketches.shape[1]), 3):
        _, first = np.unique(sketches[:, list(three)], axis=0, return_index=True)
        mine = np.zeros(len(sketches), bool)
        mine[first] = True
        keep &= mine
    return keep


def likelihood(p: np.ndarray, d: np.ndarray, f: np.ndarray, grade: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the penalty on weights, and its gradient, at p = (weights, first threshold, log gaps).

    d, f: (document, feature) pairs, each once.
    """
    n, m = len(grade), len(p) - GRADES + 1
    theta = p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])
    s = np.bincount(d, weights=p[f], minlength=n)
    up = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -60, 60)))  # P(grade > k)
    edge = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], 1)
    rows = np.arange(n)
    chance = np.maximum(edge[rows, grade] - edge[rows, grade + 1], 1e-12)
    slope = edge * (1 - edge)
    ds = (slope[rows, grade] - slope[rows, grade + 1]) / chance
    g = np.zeros_like(p)
    g[:m] = -np.bincount(f, weights=ds[d], minlength=m) / n + l2 * p[:m]
    # d chance / d theta_k: the lower edge of grades k + 1, the upper edge of grade k
    dt = np.array([(-(slope[:, k + 1] / chance)[grade == k + 1].sum() + (slope[:, k + 1] / chance)[grade == k].sum()) / n for k in range(GRADES - 1)])
    g[m] = -dt.sum()
    g[m + 1 :] = [-dt[k:].sum() * np.exp(p[m + k]) for k in range(1, GRADES - 1)]
    return float(-np.log(chance).mean() + l2 / 2 * (p[:m] ** 2).sum()), g


def descend(d: np.ndarray, f: np.ndarray, m: int, grade: np.ndarray, rounds: int = 400, l2: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch Adam on the likelihood -> weights and thresholds, which stay in order."""
    p = np.zeros(m + GRADES - 1)
    share = np.clip([(grade > k).mean() for k in range(GRADES - 1)], 1e-4, 1 - 1e-4)
    logit = np.log((1 - share) / share)
    p[m], p[m + 1 :] = logit[0], np.log(np.maximum(np.diff(logit), 0.1))
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        _, g = likelihood(p, d, f, grade, l2)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        rate = 0.1 * min(1.0, 2 * (1 - (step - 1) / rounds))
        p -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        p[:m] = np.maximum(p[:m], 0)
    return p[:m], p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])


def cut_between(chance: np.ndarray, toxic: np.ndarray) -> float:
    """Where F1 is best: amid the two neighbouring chances, on the log-odds scale; 0.5 without documents of both kinds."""
    if not 0 < toxic.sum() < len(toxic):
        return 0.5
    order = np.argsort(-chance, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + toxic.sum())
    sorted_ = chance[order]
    last = np.append(sorted_[1:] < sorted_[:-1], True)  # a cut can't part equal chances
    at = int(np.argmax(np.where(last, f1, -1)))
    odds = lambda c: np.log(np.clip(c, 1e-9, 1 - 1e-9) / np.clip(1 - c, 1e-9, 1 - 1e-9))
    low = sorted_[at + 1] if at + 1 < len(sorted_) else 0.0
    return float(1 / (1 + np.exp(-(odds(sorted_[at]) + odds(low)) / 2)))


def fit(doc: np.ndarray, word: np.ndarray, grade: np.ndarray) -> Model:
    """(document number, feature's hash) pairs, each once, and the documents' grades -> the model."""
    vocabulary, f = np.unique(word, return_inverse=True)
    held = np.arange(len(grade)) % HELD == HELD - 1
    number = np.cumsum(~held) - 1
    some = ~held[doc]
    part = Model(vocabulary, *descend(number[doc[some]], f[some], len(vocabulary), grade[~held]))
    sums = np.bincount(doc, weights=part.weights[f], minlength=len(grade))
    reject = cut_between(part.chances(sums)[held, -1], grade[held] == GRADES - 1)
    return Model(vocabulary, *descend(doc, f, len(vocabulary), grade), reject)


def telling_words(features: DataFrame, totals: list[int]) -> DataFrame:
    """features(no, grade, words) -> (word): those of which some grade's share is far from that of all documents.

    totals: documents of each grade.
    """
    above = [sum(totals[k + 1 :]) / max(sum(totals), 1) for k in range(GRADES - 1)]
    counts = [F.count_if(F.col("grade") > k).alias(f"n{k}") for k in range(GRADES - 1)]
    df = features.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *counts)
    n, far = F.col("n"), F.lit(False)
    for k, share in enumerate(above):
        if 0 < share < 1:
            far = far | (F.col(f"n{k}") - n * share >= LEAST_ERRORS * F.sqrt(n * share * (1 - share)))
    return df.filter((n >= LEAST_DOCS) & far).select("word")


def sampled(labels: DataFrame, sample: int) -> DataFrame:
    """labels(doc_id, toxic, quality) -> (doc_id, grade) of at most so many documents: those in the lowest whole ranges of hashes.

    Of repeated labels any toxic one and any poor quality counts; without a quality it is good.
    """
    poor = F.max((F.col("quality") == 0).cast("int")) if "quality" in labels.columns else F.lit(0)
    per = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.coalesce(poor, F.lit(0)).alias("poor"))
    per = per.select("doc_id", F.when(F.col("toxic") > 0, 2).otherwise(F.col("poor")).alias("grade"), F.shiftrightunsigned(F.xxhash64("doc_id"), 48).alias("range"))
    counts = per.groupBy("range").count().toArrow()  # a row per range, _RANGES at most
    n = np.zeros(_RANGES, np.int64)
    n[counts["range"].to_numpy()] = counts["count"].to_numpy()
    return per.filter(F.col("range") < int(np.searchsorted(np.cumsum(n), sample, "right"))).drop("range")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on sampled labelled documents; of rows with one doc_id the first counts, and copies count once.

    Without toxic documents in the sample, or without clean ones, nothing is rejected.
    """
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([50.0, 60.0]))
    ws = Workspace(spark, "toxicity")
    some = ws.table(sampled(labels, sample), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "grade")  # sample rows at most
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = row_key(ws.table(rows.mapInArrow(_features, f"doc_id {kind}, grade int, words array<long>, sketch array<long>"), "features"))
    per = made.groupBy("doc_id").agg(F.min(F.struct("_file", "_row", "grade", "sketch")).alias("x")).select("x.*")
    seen = per.orderBy("_file", "_row").toArrow()  # a few numbers per sampled document
    if not seen.num_rows:
        ws.close()
        return none
    keep = one_of_copies(seen["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, 4))
    kept = seen.select(["_file", "_row"]).filter(pa.array(keep)).append_column("no", pa.array(np.arange(keep.sum())))
    grade = seen["grade"].to_numpy()[keep]
    if not 0 < (grade == GRADES - 1).sum() < len(grade):
        ws.close()
        return none
    features = made.join(F.broadcast(spark.createDataFrame(kept)), ["_file", "_row"])
    chosen = ws.table(telling_words(features, np.bincount(grade, minlength=GRADES).tolist()), "telling")
    pairs = features.select("no", F.explode("words").alias("word")).join(chosen, "word").toArrow()  # bounded by the sample
    ws.close()
    return fit(pairs["no"].to_numpy(), pairs["word"].to_numpy().view(np.uint64), grade)


def sums(model: Model, values: pa.Array) -> np.ndarray:
    """w.x of each text: every feature that it has counts once. Long texts are taken in parts."""
    out, m = np.zeros(len(values)), len(model.words)
    found: dict[int, list[np.ndarray]] = {}
    for part, owner in pieces(values) if m else ():
        text, word, prefix, _ = word_hashes(part)
        text, word = np.concatenate([text, text]), np.concatenate([word, prefix])
        at = np.minimum(np.searchsorted(model.words, word), m - 1)
        known = model.words[at] == word
        pairs = np.unique(text[known] * np.int64(m) + at[known])
        if len(owner) == 1:  # perhaps a part of a longer text
            found.setdefault(int(owner[0]), []).append(pairs)
        else:
            out[owner] = np.bincount(pairs // m, weights=model.weights[pairs % m], minlength=len(owner))
    for i, lists in found.items():
        out[i] = model.weights[np.unique(np.concatenate(lists))].sum()
    return out


def _score(model: Model):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            up = model.chances(sums(model, texts(part)))
            columns = [pa.array(up.sum(1)), pa.array((up >= 0.5).sum(1).astype(np.int32)), pa.array(up[:, -1]), pa.array(up[:, -1] >= model.reject)]
            yield pa.StructArray.from_arrays(columns, ["severity", "grade", "chance", "toxic"])
            pa.default_memory_pool().release_unused()

    return run


def grade(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with a struct column: severity (the expected grade, 0 to 2), grade (the median one), chance (of grade 2), toxic (rejected).

    A null or empty text is one without features: its severity is what the thresholds alone give. Rows
    stay rows. A column of docs with that name is replaced.
    """
    bounded_batches(docs.sparkSession)
    of = F.arrow_udf(_score(model), "severity double, grade int, chance double, toxic boolean")
    return docs.withColumn(name, of(F.col("text")))


def graded(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs graded by a model of labels(doc_id, toxic, quality). An empty table gives no rows; without labels nothing is toxic."""
    return grade(docs, train(spark, docs, labels, sample))


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the model doesn't reject, with docs' columns, whatever these are called."""
    name = free_names(docs.columns, "toxicity")[0]
    return grade(docs, train(spark, docs, labels, sample), name).filter(~F.col(name)["toxic"]).select(*docs.columns)
