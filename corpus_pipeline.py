"""A corpus pipeline of five stages, each over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet into the shared
folder and reads it again as the next one's docs. All but the last return the columns of documents; where a stage changes texts,
n_chars is counted anew. Rows that repeat an id are told apart by nothing else than their text, as in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import decontaminate, mixing, neardup, suffixes, toxicity
from foliomill.llm.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score of 0.5 or more go. The classifier learns from all labels, on a bounded sample of rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.trained(docs, labels)
    return toxicity.scored(docs.withColumn("text__kept", F.col("text")), model, keep=["doc_id", "text__kept", *COLUMNS[2:]]).where("score < 0.5").withColumnRenamed("text__kept", "text").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest id stays, one without an id only if no row of the group has one.

    Where ids are repeated or null, the rows get numbers in the order of their ids, and the operator groups these.
    """
    rows, by = docs, "doc_id"
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("at__").asc()]
        sorted_rows = docs.select(*COLUMNS).withColumn("at__", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
        rows, by = written(sorted_rows.withColumn("row__", F.monotonically_increasing_id()), "rows"), "row__"
    rest = neardup.near_duplicates(rows, id_col=by).where("not kept").select(F.col("doc_id").alias(by))
    return rows.join(rest, by, "left_anti").select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 50 that also start in a document with a smaller id are cut from the texts; every row stays."""
    cut = suffixes.without_repeats(docs, carry=COLUMNS[2:], text=True)
    changed = F.col("n_removed") > 0
    return cut.select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside any occurrence of a benchmark window are cut from the texts; every row stays."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its block, the block's slot in the mix, and its place in the block."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Stages of learning, sketches and schedules that SQL doesn't express; tests hold the operators against brute force, and the stages against the operators and planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
