"""Token-bounded batches of headings as they arrive, with what each batch is refined against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..runtime import importable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a book that are answered at once.
SENT = 10_000


class TokenBatches(StatefulProcessor):
    """Of each book: the open batch and its tokens as a value, the latest heading of each level as a map.

    A batch is closed before the row that would take it beyond `limit`, even an empty one, as in candidates.greedy_batches(). Its context is the latest heading of
    each level that came before the batch was opened.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "batch int, used bigint, levels int")
        self.latest = handle.getMapState("latest", "level string", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, used, levels = self.open.get() if self.open.exists() else (0, 0, 0)
        known = {k[0]: v[0] for k, v in self.latest.iterator()} if self.latest.exists() else {}
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")  # what one trigger brings of a book is put in order
        fresh, out = dict(known), []
        for seq, level, tokens in zip(frame["seq"].tolist(), frame["level"].tolist(), frame["tokens"].tolist(), strict=True):
            if used + tokens > self.limit:
                batch, used, levels = batch + 1, 0, len(fresh)
            used += tokens
            out.append((key[0], seq, batch, levels))
            fresh["1" if level is None else str(level)] = seq
        for level, seq in fresh.items():
            if known.get(level) != seq:
                self.latest.updateValue((level,), (seq,))
        self.open.update((batch, used, levels))
        for i in range(0, len(out), SENT):
            yield pd.DataFrame(out[i : i + SENT], columns=["book", "seq", "batch", "context_levels"])

    def close(self) -> None:
        pass


def token_batches(rows: DataFrame, limit: int) -> DataFrame:
    """A stream of (book, seq, level, tokens) to (book, seq, batch, context_levels): the batch of each row, and of how many levels a heading had come before it was opened.

    Rows of a book have to arrive in the order of seq from trigger to trigger; within one they may come in any order.
    """
    spark = rows.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = dict(rows.dtypes)["book"]
    return rows.groupBy("book").transformWithStateInPandas(statefulProcessor=TokenBatches(limit), outputStructType=f"book {kind}, seq bigint, batch int, context_levels int", outputMode="Append", timeMode="None")


def collected(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream gives for all that has arrived by now, as a table below `folder`, which keeps the state for the next call as well."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
