"""Outlines and elements as they arrive: each file once, finished books skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.outlines import slug


def outline_stream(spark: SparkSession, folder: str, system: str, *, pattern: str = "*", prefix: int = 0, files_per_trigger: int = 1_000) -> DataFrame:
    """A stream of naive outline rows from a folder of outline files."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    body = F.regexp_replace(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")), "^\\x{FEFF}", "")
    lines = raw.select(slug(F.col("path"), prefix).alias("book"), F.posexplode(F.split(body, "\n")).alias("seq", "line")).where("line <> ''")
    cut = F.split(F.col("line"), ",")
    return lines.select(F.lit(system).alias("system"), "book", "seq", T.safe_int(F.get(cut, F.lit(0))).alias("level"), T.heading_clean(F.get(cut, F.lit(1))).alias("heading_naive"))


def start(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True):
    """Writes the new books of each trigger into a folder of its own below `path`; a book that an earlier trigger wrote for the same system is skipped.
    A trigger that is run again writes its folder anew, whatever it left there.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        known = spark.read.option("basePath", path).schema("system string, book string, batch bigint").parquet(path).where(F.col("batch") < number) if there else None
        new = rows.join(known.select("system", "book").distinct(), ["system", "book"], "left_anti") if there else rows
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()
