"""What functions of this package need of a session: the import path of the workers, the shared folder, a time limit."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Python workers started from now on find this package where the driver found it (an installed one needs nothing)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor and the driver reach. Only a local master has one by default."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
        root = "file:/tmp/foliomill-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() made, once nothing will read them again."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Jobs that are started inside are cancelled after so many seconds; the action that waits for them then fails."""
    sc, tag = spark.sparkContext, f"limit-{uuid.uuid4().hex}"
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    timer = threading.Timer(seconds, sc.cancelJobsWithTag, [tag])
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
        sc.setInterruptOnCancel(False)
