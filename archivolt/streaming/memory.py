"""Conversation memory and new files, as they come."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from archivolt.operators.chunks import line_chunks, tag_places


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memory(StatefulProcessor):
    """The last turns of one conversation and the number of batches that left it; both go when it stays idle."""

    def __init__(self, keep: int, batch: int, idle_ms: int) -> None:
        self.keep, self.batch, self.idle_ms = keep, batch, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "turn long, role string, text string")
        self.done = handle.getValueState("done", "done int")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh, times = [], []
        for f in rows:
            fresh += [(int(t), r or "", c or "") for t, r, c in zip(f["turn"], f["role"], f["text"], strict=True)]
            times += f["ms"].tolist()
        done = self.done.get()[0] if self.done.exists() else 0
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        out = []
        for x in sorted(fresh):
            held.append(x)
            if len(held) > self.keep:
                out.append((key[0], done, [t for t, _, _ in held[: self.batch]]))
                done, held = done + 1, held[self.batch :]
        self.held.put(held)
        self.done.update((done,))
        before = list(self.handle.listTimers())
        for t in before:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(max([max(times) + self.idle_ms, *before])))
        yield pd.DataFrame(out, columns=["conv_id", "batch", "turns"])

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.done.clear()
        yield pd.DataFrame([], columns=["conv_id", "batch", "turns"])


def memory_stream(turns: DataFrame, keep: int = 8, batch: int = 6, idle: str = "7 days", at: str | None = None, late: str = "0 seconds") -> DataFrame:
    """conv_id, batch, turns: the oldest `batch` turns of a conversation each time more than `keep` are held.

    turns: conv_id, turn, role, text, in the order of `turn` from trigger to trigger. Over a whole log the batches equal those
    of memory_batches. The state of a conversation is at most `keep` turns and a number, and a timer takes it once no turn came
    for `idle` by the watermark of the column `at`, which waits for `late`; without such a column the time of arrival counts.
    A conversation that comes back after that begins anew. State is kept in RocksDB, which this session is set to use.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    turns = turns.select("conv_id", "turn", "role", "text", (F.current_timestamp() if at is None else F.col(at)).cast("timestamp").alias("at"))
    turns = turns.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    process = Memory(keep, batch, int(pd.Timedelta(idle) / pd.Timedelta("1ms")))
    return turns.groupBy("conv_id").transformWithStateInPandas(process, outputStructType="conv_id long, batch int, turns array<long>", outputMode="append", timeMode="EventTime")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, clean, terms: tuple[str, ...]):
    """Chunks of text files that came since the last call, cleaned and tagged, appended to the table at `out`.

    The checkpoint keeps which files are done. A repeated batch overwrites its own folder, so a lost run adds nothing twice.
    """
    files = spark.readStream.schema("value string").text(folder, wholetext=True)
    rows = files.select(F.xxhash64("_metadata.file_name").alias("doc_id"), F.col("_metadata.file_name").alias("source"), clean(F.col("value")).alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        tag_places(line_chunks(batch), terms).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)
