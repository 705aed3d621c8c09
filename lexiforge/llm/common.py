"""What the operators share: the cluster's shared folder, written tables, Arrow word splitting."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Text that one vectorised step holds at a time.
STEP_BYTES = 2 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, as the session has it.

    A path without a scheme lies in Hadoop's default file system, as Spark itself reads it. Only where that is unset and driver and executors are one process a folder of this machine serves; a cluster
    without the setting is an error, as its executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "lexiforge-shared")
    return qualified(spark, root)


def qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Tables and files of one run under the shared folder, named so that runs never meet.

    ``table`` writes a DataFrame and reads it back, which cuts its lineage: a lost
    executor costs no recomputation beyond the stage that runs. ``drop`` removes what
    no later step reads; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/lexiforge/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)
        bounded_batches(spark)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd", files: int | None = None) -> DataFrame:
        """files: for a table of bounded size, into how many files it goes, however many tasks made it."""
        df = df if files is None else df.repartition(files)
        df.write.mode("overwrite").option("compression", codec).parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.at(name))

    def close(self) -> None:
        try:
            remove(self.spark, self.path)
        except Exception:  # the session has ended; the folder belongs to the cluster's housekeeping then
            pass


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at 8 MB too, so that very long texts don't add up to one huge batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def filesystem(path: str):
    """The pyarrow file system and the path in it, for a worker's access to the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(path))


def arrow_uri(path: str) -> str:
    """A Hadoop path as pyarrow names it: S3 has one scheme there, and a local path three slashes."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return re.sub(r"^file:/+", "file:///", path)


def texts(column) -> pa.Array:
    """One string array of 64-bit offsets' width at most, null texts as empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def steps(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in slices of about STEP_BYTES of text, one row at least."""
    values = texts(batch.column(column))
    size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    if not len(size):
        return
    group = (np.cumsum(size, dtype=np.int64) - size) // STEP_BYTES
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)], strict=True):
        yield batch.slice(a, b - a), values.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def pieces(values: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts in parts of about STEP_BYTES, and which text each part is of.

    Longer texts are cut at ASCII white space, so that no word is; texts without white space stay whole.
    """
    size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)] if len(size) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if size[a:b].max() <= STEP_BYTES:
            yield values.slice(a, b - a), np.arange(a, b)
            continue
        for i in range(a, b):
            for part in _cut(values[i].as_buffer()) if size[i] > STEP_BYTES else [values.slice(i, 1)]:
                yield part, np.array([i])


def _cut(data: pa.Buffer) -> Iterator[pa.Array]:
    whole, lo = np.frombuffer(data, np.uint8), 0
    while lo < len(whole):
        hi = min(lo + STEP_BYTES, len(whole))
        while hi < len(whole):  # on to the next white space
            step = whole[hi : hi + (1 << 16)]
            blank = np.flatnonzero((step == 32) | ((step >= 9) & (step <= 13)))
            if len(blank):
                hi += int(blank[0])
                break
            hi += len(step)
        offsets = pa.py_buffer(np.array([0, hi - lo], np.int32).tobytes())
        yield pa.Array.from_buffers(pa.string(), 1, [None, offsets, data.slice(lo, hi - lo)])
        lo = hi


def split_words(values: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and how many each text has. Lowers A-Z only."""
    if lower:
        values = pc.ascii_lower(values)
    trimmed = pc.ascii_trim_whitespace(values)
    lists = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    if blank.any():
        at = np.cumsum(counts) - counts
        keep = np.ones(len(flat), bool)
        keep[at[blank]] = False
        flat = flat.filter(pa.array(keep))
        counts = np.where(blank, 0, counts)
    return flat, counts


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of counts[i] values."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of those taken (in any case)."""
    out, seen = [], {t.lower() for t in taken}
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def is_parquet_scan(df: DataFrame) -> bool:
    """Whether df reads Parquet files and does nothing else, so that files and places there name its rows."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.nodeName() == "LogicalRelation" and "Parquet" in plan.relation().toString()


def keyed(ws: Workspace, df: DataFrame, name: str = "rows") -> tuple[DataFrame, str, str]:
    """df's rows with two columns, named so that they clash with none, that tell its rows apart for good.

    A file's path (hashed) and a row's place in it never change; what isn't a plain scan of Parquet files is written first.
    """
    table = df if is_parquet_scan(df) else ws.table(df, name)
    file, row = free_names(df.columns, "_file", "_row")
    return table.select("*", F.md5(F.col("_metadata.file_path")).alias(file), F.col("_metadata.row_index").alias(row)), file, row


def in_written_order(ws: Workspace, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns by which its rows sort into the order in which its files were written, and their names.

    Spark numbers the files of a table by partition; what isn't a plain scan of Parquet files is written first.
    """
    table = df if is_parquet_scan(df) else ws.table(df, "ordered")
    names = free_names(df.columns, "_part", "_file", "_row")
    file = F.col("_metadata.file_name")
    part = F.try_to_number(F.regexp_extract(file, r"^part-(\d+)", 1), F.lit("9" * 18)).cast("long")
    return table.select("*", *[c.alias(n) for c, n in zip((part, F.col("_metadata.file_path"), F.col("_metadata.row_index")), names, strict=True)]), names


class Decisions:
    """What was decided for rows, by file and place, for tasks that read those rows again.

    Decisions lie in the shared folder, a part for each file; a task loads those of the files that it reads. So
    whatever a row bears besides its key, such as its text, isn't shuffled. A file's decisions are
    as bounded as the file is.
    """

    def __init__(self, ws: Workspace, decided: DataFrame, name: str) -> None:
        """decided(file string, row long, value ...), a row each."""
        self.path = ws.at(name)
        self.schema = decided.schema
        value = decided.columns[2]
        # A file's decisions go to a few tasks, so that one with a third of all rows isn't one task's.
        spread = decided.repartition(*[F.col("file"), (F.col("row") / (1 << 20)).cast("long")])
        spread.select("file", "row", value).sortWithinPartitions("file", "row").write.mode("overwrite").partitionBy("file").parquet(self.path)

    def lookup(self) -> Callable[[pa.Array, pa.Array], pa.Array]:
        """For tasks: (files, rows) -> the values decided for them, null where there is none."""
        return partial(_decided, self.path, self.schema[2].name, to_arrow_type(self.schema[2].dataType))

    def of(self, file: Column, row: Column) -> Column:
        """The value decided for a row, or null."""
        look = self.lookup()

        def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for files, rows in parts:
                yield look(files, rows)

        return F.arrow_udf(run, self.schema[2].dataType)(file, row)


_DECIDED: dict[tuple[str, str], tuple[np.ndarray, pa.Array]] = {}


def _file_decisions(path: str, file: str, name: str, kind: pa.DataType) -> tuple[np.ndarray, pa.Array]:
    key = (path, file)
    if key not in _DECIDED:
        while len(_DECIDED) >= 4:
            _DECIDED.pop(next(iter(_DECIDED)))
        fs, at = filesystem(f"{path}/file={file}")
        found = fs.get_file_info(FileSelector(at, allow_not_found=True))
        tables = [pq.read_table(f.path, columns=["row", name], filesystem=fs, partitioning=None) for f in found if f.path.endswith(".parquet")]
        table = pa.concat_tables(tables) if tables else pa.table({"row": pa.array([], pa.int64()), name: pa.array([], kind)})
        rows = table["row"].to_numpy()
        order = np.argsort(rows, kind="stable")
        values = table[name].take(pa.array(order)).combine_chunks()
        values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
        _DECIDED[key] = rows[order], values.cast(kind)
    return _DECIDED[key]


def _decided(path: str, name: str, kind: pa.DataType, files: pa.Array, rows: pa.Array) -> pa.Array:
    coded = files.dictionary_encode()
    of, at = coded.indices.to_numpy(zero_copy_only=False), rows.to_numpy(zero_copy_only=False)
    out, place = [], np.zeros(len(at), np.int64)
    base = 0
    for k, file in enumerate(coded.dictionary.to_pylist()):
        known, values = _file_decisions(path, file, name, kind)
        mine = np.flatnonzero(of == k)
        found = np.searchsorted(known, at[mine])
        hit = np.zeros(len(mine), bool)
        inside = found < len(known)
        hit[inside] = known[found[inside]] == at[mine][inside]
        out += [values.take(pa.array(found[hit])), pa.nulls(1, kind)]
        n = int(hit.sum())
        place[mine[hit]], place[mine[~hit]] = base + np.arange(n), base + n
        base += n + 1
    return pa.concat_arrays(out).take(pa.array(place)) if out else pa.nulls(0, kind)


def hot_join(rows: DataFrame, keyed_by: DataFrame, key: str, count: str, threshold: int = 1 << 17, spread: int = 64) -> DataFrame:
    """rows joined with keyed_by(key, count, ...), a row per key; count is the key's number of rows.

    Keys with more rows than the threshold, of which there are at most rows / threshold, are dealt out in
    ``spread`` parts, each with a copy of the key's row. Keys are equal if null, too.
    """
    salt, mine = free_names([*rows.columns, *keyed_by.columns], "_salt", "_key")
    hot = keyed_by.filter(F.col(count) > threshold).select(F.col(key).alias(mine)).withColumn(salt, F.lit(1))
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(spread))
    salted = rows.join(F.broadcast(hot), rows[key].eqNullSafe(F.col(mine)), "left")
    salted = salted.withColumn(salt, F.when(F.col(salt) == 1, part).otherwise(F.lit(0).cast("long"))).drop(mine)
    many = F.when(F.col(count) > threshold, F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    other = keyed_by.withColumnRenamed(key, mine).withColumn("_part", F.explode(many))
    joined = salted.join(other, salted[key].eqNullSafe(other[mine]) & (salted[salt] == other["_part"]))
    return joined.drop(mine, salt, "_part")


def row_key(table: DataFrame) -> DataFrame:
    """A written table with columns that name each row: its file and its place there. They never change."""
    return table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def running_total(ws: Workspace, df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with ``before``: the sum of value over all rows ahead in the order, which should have no large ties.

    Rows are dealt out in ranges; only one total per range meets in one task.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = ws.table(ranged, name)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_part", ahead.alias("_ahead"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(totals), "_part")  # a row per partition
    return joined.withColumn("before", F.col("_ahead") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_part", "_ahead")
