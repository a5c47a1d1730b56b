"""The completion monitor over event time: a stateful stream with timers, which may stop and go on at its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.session import scratch
from quarry.streaming.completion import SETTLE_S, STALE_S

LOOKS = "extraction_id long, at timestamp, done long, total long, cost double"
ENDS = "extraction_id long, status string, ended_ms long"
_STATE = "since_ms long, done long, total long, ended boolean"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Watch(StatefulProcessor):
    """One state for each extraction: since when its numbers are as they are. It ends when a look finds it over budget,
    or, without any look, when its numbers have stood for SETTLE_S while complete or STALE_S while not. What has ended
    keeps its mark alone, so later looks change nothing."""

    def __init__(self, budget: float):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _STATE)

    def _end(self, key: tuple, status: str, at: int) -> pd.DataFrame:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((None, None, None, True))
        return pd.DataFrame({"extraction_id": [key[0]], "status": [status], "ended_ms": [at]})

    @staticmethod
    def due(since: int, done: int, total: int) -> int:
        return since + 1000 * (SETTLE_S if done == total else STALE_S)

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = self.state.get() if self.state.exists() else None
        looks = pd.concat(list(rows))
        if held is not None and held[3]:
            return
        since, done, total = held[:3] if held is not None else (None, None, None)
        looks = looks.assign(ms=looks["at"].astype("datetime64[ms]").astype("int64")).sort_values(["ms", "done", "total", "cost"])
        for ms, now, of, cost in zip(looks["ms"], looks["done"], looks["total"], looks["cost"], strict=True):
            if since is not None and self.due(since, done, total) <= ms:
                yield self._end(key, "COMPLETE" if done == total else "STALE", self.due(since, done, total))
                return
            if cost > self.budget:
                yield self._end(key, "CANCELLED", int(ms))
                return
            if (done, total) != (now, of):
                since, done, total = int(ms), int(now), int(of)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self.due(since, done, total))
        self.state.update((since, done, total, False))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if self.state.exists() and not self.state.get()[3]:
            since, done, total, _ = self.state.get()
            yield self._end(key, "COMPLETE" if done == total else "STALE", self.due(since, done, total))

    def close(self) -> None:
        pass


def ends(looks: DataFrame, budget: float = 50.0) -> DataFrame:
    """looks: a stream of LOOKS, in order of time between batches. ENDS, a row for each extraction that has ended."""
    seen = looks.withWatermark("at", "0 seconds").groupBy("extraction_id")
    return seen.transformWithStateInPandas(Watch(budget), ENDS, "append", "EventTime")


def run_available(spark: SparkSession, source: str, folder: str, budget: float = 50.0) -> None:
    """Runs the monitor over the files of ``source`` that it has not read yet, and stops. Its checkpoint and its rows
    are in ``folder``; another run, of this process or the next, goes on where it stopped."""
    key, wanted = _PROVIDER
    was = spark.conf.get(key, None)
    spark.conf.set(key, wanted)  # timers need it; it is given back when the run is over
    try:
        stream = ends(spark.readStream.schema(LOOKS).parquet(source), budget)
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/ends").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)


def watched(looks: DataFrame, budget: float, parts: int = 3) -> DataFrame:
    """LOOKS to extraction_id, status, ended_ms: looks arrive in ``parts`` spans of time, and for each span the stream is
    started anew from its checkpoint. Those that have not ended are IN_PROGRESS."""
    spark = looks.sparkSession
    folder = f"{scratch(spark)}/watch-{uuid.uuid4().hex}"
    ms = F.unix_millis("at")
    cuts = looks.select(ms.alias("ms")).approxQuantile("ms", [k / parts for k in range(1, parts)], 0.01)
    span = F.lit(0)
    for cut in cuts:
        span = span + (ms > int(cut)).cast("int")
    for k in range(len(cuts) + 1):
        looks.where(span == k).select("extraction_id", "at", "done", "total", "cost").write.mode("append").parquet(f"{folder}/looks")
        run_available(spark, f"{folder}/looks", folder, budget)
    found = spark.read.schema(ENDS).parquet(f"{folder}/ends")
    every = looks.select("extraction_id").distinct()
    return every.join(found, "extraction_id", "left").select("extraction_id", F.coalesce("status", F.lit("IN_PROGRESS")).alias("status"), "ended_ms")
