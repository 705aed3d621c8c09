"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import decontam, mixing, simhash, tokens, toxicity
from lexiforge.llm.common import Workspace, in_written_order
from lexiforge.llm.queries import table, tokenizer_path

#: Stages without SQL (hashing, fitted models). The pipeline's test holds dedup, mixing and tokens against plain Python and the fitted stages against their operators.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't reject. Null and empty texts stay, repeated rows stay rows, other columns pass."""
    return toxicity.clean(spark, docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with its smallest doc_id (null is larger than any).

    Null and blank texts are copies of each other. Of repeated rows one stays; other columns pass.
    """
    return simhash.keep_one(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its own text. Null and empty texts stay; other columns pass."""
    return decontam.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the curriculum takes, in training order, which the order of the files keeps.

    Texts without words weigh nothing: they are taken where their place lies ahead of their source's target. A null
    source is a source of its own; repeated rows are rows of their own; other columns pass.
    """
    return mixing.mixed(spark, docs)


def store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all copies in the content-addressed store, in the order in which docs was written, read back from it.

    Null texts are empty ones: their end id alone. Repeated rows are documents of their own.
    """
    ordered, names = in_written_order(Workspace(spark, "store-order"), docs)
    read = tokens.store_and_read(spark, ordered, tokenizer_path(), order=names)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("tokens", store),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last stage's rows. An empty table gives none."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            ws.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
