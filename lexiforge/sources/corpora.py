"""Declared schemas, CSV and JSON sources and sinks, and checks of their shape."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "docs": "oare_id string, transliteration string, translation string",
    "sentences": "display_name string, text_uuid string, sentence_uuid string, sentence_obj_in_text int, translation string, first_word_transcription string, first_word_spelling string, first_word_number int, first_word_obj_in_text int, line_number double, side string, column string",
    "test": "id int, text_id string, line_start int, line_end int, transliteration string",
    "submission": "id int, translation string",
    "published_texts": "oare_id string, label string, genre_label string, transliteration string, note string, aliases string, publication_catalog string",
    "publications": "pdf_name string, page_text string, has_akkadian boolean",
    "lexicon": "form string, lexeme string, norm string, type string",
    "dictionary": "word string, definition string",
    "pairs": "oare_id string, transliteration string, translation string",
}
# Spellings of a missing value in CSV files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


@dataclass(frozen=True)
class Paths:
    """Where inputs and outputs lie; each can be set by an environment variable LEXIFORGE_<NAME>."""

    data: str = field(default_factory=lambda: os.environ.get("LEXIFORGE_DATA", "data"))
    out: str = field(default_factory=lambda: os.environ.get("LEXIFORGE_OUT", "out"))
    model: str = field(default_factory=lambda: os.environ.get("LEXIFORGE_MODEL", "model"))


def read_csv(spark: SparkSession, path: str, schema: str, missing: Sequence[str] = MISSING) -> DataFrame:
    """One file or a folder of files, found recursively; quoted line breaks and doubled quotes hold, missing spellings are null."""
    reader = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', recursiveFileLookup=True)
    return _without_missing(reader.csv(path), missing)


def _without_missing(df: DataFrame, missing: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    clean = lambda c, t: t == "string" and c not in skip
    return df.select(*[F.when(F.trim(c).isin(*missing), None).otherwise(F.col(c)).alias(c) if clean(c, t) else F.col(c) for c, t in df.dtypes])


PART = "file string, block long, header boolean, begins boolean, ends boolean, record string"
#: Blocks whose quote parities are broadcast, about 100 bytes each; beyond that lines are shuffled by block instead.
MOST_BLOCKS = 100_000


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines in order, block after block, put together to records, or to the parts of records that go over a block's edge."""
    columns = [c.split()[0] for c in PART.split(", ")]
    at, lines, odd, begins, header = None, [], False, True, False
    for batch in batches:
        out = []
        for file, block, inside, line, quotes in zip(batch["file"], batch["block"], batch["inside"], batch["value"], batch["quotes"], strict=True):
            if (file, block) != at:
                if lines:
                    out.append((*at, header, begins, False, "\n".join(lines)))
                at, lines, odd, begins, header = (file, block), [], bool(inside), not inside, block == 0
            lines.append(line)
            odd ^= bool(quotes % 2)
            if not odd:
                out.append((file, block, header, begins, True, "\n".join(lines)))
                lines, begins, header = [], True, False
        yield pd.DataFrame(out, columns=columns)
    if lines:
        yield pd.DataFrame([(*at, header, begins, False, "\n".join(lines))], columns=columns)


def read_csv_by_blocks(spark: SparkSession, path: str, schema: str, missing: Sequence[str] = MISSING, bad: str = "_bad", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """IO4: read_csv's rows with a column ``bad``, each file read by as many tasks as it has blocks.

    A line begins a record if the quotes ahead of it in its file are even. So one pass counts the quotes of each block, a
    window over the blocks of a file adds up their parities, and then each block is cut into records where it lies, once for
    the whole records and once for those over an edge, so the text is read three times.
    Only the records that go over a block's edge, at most two parts a block, are shuffled to be put together; the others
    are parsed where they are read. Values that hold quotes must be quoted themselves, as write_csv does.

    A record that has more or fewer values than the schema, or one of another type, stands in ``bad`` as it is and
    keeps what could be parsed; in others ``bad`` is null. Empty lines are no records, a file's first record is its header, and an
    empty file or one with a header alone gives no row. A line break within quotes stays as it is in the file.
    """
    text = spark.read.options(lineSep="\n", recursiveFileLookup=True).text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), quotes.alias("quotes"), F.monotonically_increasing_id().alias("line"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2 == 1).alias("inside"))
    if blocks.limit(most_blocks + 1).count() <= most_blocks:
        lines = lines.join(F.broadcast(blocks), ["file", "block"])
    else:
        lines = lines.join(blocks.hint("merge"), ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "line")
    parts = lines.select("file", "block", "inside", "value", "quotes").mapInPandas(_parts, PART)
    whole = F.col("begins") & F.col("ends")
    edge = parts.where(~whole).withColumn("run", F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("block", "begins")))
    pieces = F.array_sort(F.collect_list(F.struct("block", "begins", "record")))
    edge = edge.groupBy("file", "run").agg(F.max("header").alias("header"), F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record"))
    records = parts.where(whole).select("header", "record").unionAll(edge.select("header", "record"))
    record = F.regexp_replace("record", "\r$", "")
    options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": bad}
    rows = records.where(~F.col("header") & (record != "")).select(F.from_csv(record, f"{schema}, {bad} string", options).alias("row")).select("row.*")
    return _without_missing(rows, missing, [bad])


def write_csv(df: DataFrame, path: str) -> None:
    """IO5, IO6: with a header, also where there is no row: an empty result is written as one file with its header."""
    rows = df if df.limit(1).count() else df.sparkSession.createDataFrame([], df.schema).coalesce(1)
    rows.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_map(df: DataFrame, key: str, path: str) -> None:
    """IO7: JSON objects, one a row, {key: {the other columns}}; a single other column is the value itself."""
    rest = [c for c in df.columns if c != key]
    value = F.col(rest[0]) if len(rest) == 1 else F.struct(*rest)
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), value)).alias("value")).write.mode("overwrite").text(path)


def read_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """IO7: the rows of write_map's files, or of one object with many keys: (key, the columns of value's schema, or value itself)."""
    text = spark.read.text(path, wholetext=not _is_folder(spark, path))
    pairs = text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "value"))
    return pairs.select(key, "value.*") if value.startswith("struct") else pairs


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.getFileStatus(at).isDirectory()


def write_metrics(df: DataFrame, path: str) -> None:
    """IO8: the rows of a small table as one JSON file of objects, a line each; nulls are left out."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """IO9: a metrics file, or write_metrics' folder, as rows; None where there is none."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    return spark.read.schema(schema).option("multiLine", not fs.getFileStatus(at).isDirectory()).json(path)


def resolve_column(df: DataFrame, contains: str, skip: Sequence[str] = ("id",)) -> str:
    """The first column whose name contains the word, else the last that isn't skipped."""
    named = [c for c in df.columns if contains in c.lower()]
    return named[0] if named else [c for c in df.columns if c not in skip][-1]


def conform(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """df, if it has these columns in this order and, where given, as many rows."""
    if df.columns != list(columns):
        raise ValueError(f"columns are {df.columns}, not {list(columns)}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows, not {rows}")
    return df
