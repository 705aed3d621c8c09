"""Exact top-k search: tiled matrix products, partial selection per tile, and merging as a tree.

The candidates stay where they are read. The queries lie in the shared folder, and every task
multiplies its rows, a shard at a time, with one block of queries after another; of each tile
only a query's best k leave the task. Rounds of ranking, as many as it takes, merge them as a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.llm.common import Workspace, filesystem

K = 10
SCALE = 1024
#: Rows of a tile: queries by candidates.
BLOCK, SHARD = 1024, 8192
#: Branches of the merge tree.
BRANCHES = 64
_LIMIT = 2.0**53


def _matrices(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(scale * x)) for each length that valid vectors have."""
    column = batch.column("embedding")
    length = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten()
    flat = pa.compute.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    for n in np.unique(length[length >= 0]).tolist():
        rows = np.flatnonzero(length == n)
        m = flat[start[rows][:, None] + np.arange(n)]
        fine = np.isfinite(m).all(1)
        yield rows[fine], np.floor(m[fine] * float(scale))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; scores beyond 64 bits stop at the largest or smallest."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < _LIMIT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64).reshape(len(q), len(x))


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every row's k best, in order, ties to the left; columns stand by id, and own[row] has no part in its row."""
    mine = np.searchsorted(ids, own, "right") - np.searchsorted(ids, own, "left")
    take = k + int(mine.max(initial=0))
    if scores.shape[1] > take:
        least = np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = np.indices(scores.shape).reshape(2, -1)
    other = ids[column] != own[row]
    row, column = row[other], column[other]
    # Descending by the bitwise complement, which unlike the negative has no overflow.
    order = np.lexsort((column, ~scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


_BLOCKS: dict[str, list] = {}
#: Queries that a worker keeps between its shards; more are read again for each.
HELD_BYTES = 64 << 20


def _query_blocks(path: str, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(vec_id, key, matrices) of one block of queries after another."""
    if path in _BLOCKS:
        yield from _BLOCKS[path]
        return
    fs, folder = filesystem(path)
    held, size = [], 0
    for f in sorted(f.path for f in fs.get_file_info(FileSelector(folder)) if f.path.endswith(".parquet")):
        with fs.open_input_file(f) as source:
            for block in pq.ParquetFile(source).iter_batches(BLOCK):
                made = (*(block.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "key")), list(_matrices(block, scale)))
                size += sum(q.nbytes for _, q in made[2])
                if size <= HELD_BYTES:
                    held.append(made)
                yield made
    if size <= HELD_BYTES:
        _BLOCKS.clear()
        _BLOCKS[path] = held


def _tiles(path: str, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                shard = batch.slice(at, SHARD)
                ids = shard.column("vec_id").to_numpy(zero_copy_only=False)
                sides = []
                for rows, m in _matrices(shard, scale):
                    order = np.argsort(ids[rows], kind="stable")
                    sides.append((ids[rows][order], m[order]))
                tile += 1
                for qid, key, matrices in _query_blocks(path, scale):
                    for rows, q in matrices:
                        for names, m in sides:
                            if m.shape[1] != q.shape[1] or not len(m) or not len(q):
                                continue
                            scores = _scores(q, m)
                            row, column = _best(scores, names, qid[rows], k)
                            made = (qid[rows][row], key[rows][row], np.full(len(row), tile), names[column], scores[row, column])
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["query_id", "key", "tile", "vec_id", "score"])

    return run


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """vectors, queries (vec_id long, embedding array) -> (query_id, rank, vec_id, score), k rows a query or as many as there are.

    A vector's components become floor(scale * x); the score is the exact inner product. Ties go to the
    smaller vec_id. Rows that share the query's vec_id aren't its candidates. Vectors that are null, hold
    null or non-finite components, or have no vec_id take no part; vectors of different lengths
    don't meet. Repeated candidates count as often as they stand there; a query that stands there
    twice is answered once.
    """
    ws = Workspace(spark, "topk")
    asked = queries.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    ws.table(asked.distinct().withColumn("key", F.xxhash64("embedding")), "queries")
    rows = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    found = rows.mapInArrow(_tiles(ws.at("queries"), k, scale), "query_id long, key long, tile long, vec_id long, score long")
    # The merge tree has as many levels as it takes for a node to join about BRANCHES lists.
    depth = max(1, math.ceil(math.log(max(2, rows.rdd.getNumPartitions()), BRANCHES)))
    found = found.withColumn("branch", F.pmod(F.xxhash64(F.spark_partition_id(), "tile"), F.lit(BRANCHES**depth)))
    best = [F.col("score").desc(), F.col("vec_id")]
    for level in range(depth, -1, -1):
        node = ["query_id", "key", *["branch"] * (level > 0)]
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*node).orderBy(*best))).filter(F.col("rank") <= k)
        found = found.withColumn("branch", F.floor(F.col("branch") / BRANCHES))
    return found.select("query_id", "rank", "vec_id", "score")
