"""Newest wins across batches: a change's events are coalesced in keyed state, and the newest is given out once it has been quiet.

The state of a change is its newest event. An older event in a later batch is dropped. A timer in event time stands at the newest event
plus the quiet time; a newer event moves it. When the watermark passes the timer the event is given out and the state goes: whatever is
older than the watermark never reaches it, so nothing older than what was given out can come again, and state is bounded by the changes
that are active.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from patchweave.sources.scratch import shared_dir
from patchweave.streaming.events import parse_payload, route

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Keeps the newest row of a key by ``order``, and gives it out when nothing newer has come for ``quiet_ms`` of event time."""

    def __init__(self, schema: StructType, order: tuple[str, str], quiet_ms: int):
        self.schema, self.order, self.quiet_ms = schema, order, quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(self.schema.names, self.newest.get(), strict=True)) if self.newest.exists() else None
        known = held
        for part in rows:  # some rows at a time, and one of them is kept
            row = part.sort_values(list(self.order)).iloc[-1].to_dict()
            if held is None or tuple(row[c] for c in self.order) > tuple(held[c] for c in self.order):
                held = row
        if held is not known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            plain = {c: None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for c, v in held.items()}
            self.newest.update(tuple(plain[c] for c in self.schema.names))
            self.handle.registerTimer(int(pd.Timestamp(held[self.order[0]]).timestamp() * 1000) + self.quiet_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            row = dict(zip(self.schema.names, self.newest.get(), strict=True))
            self.newest.clear()
            yield pd.DataFrame({f.name: pd.Series([row[f.name]], dtype="datetime64[us]" if f.dataType.typeName() == "timestamp" else object) for f in self.schema})

    def close(self) -> None:
        pass


def newest_events(routed: DataFrame, quiet_ms: int, late: str = "1 hour", order: tuple[str, str] = ("received_at", "delivery")) -> DataFrame:
    """The stream ``routed`` with one event for each burst of a change (pr_key): the newest, once it has been quiet for ``quiet_ms``.

    ``order`` is the event time and what tells events of one time apart. The session must use the RocksDB state store.
    """
    watched = routed.withColumn(order[0], F.col(order[0]).cast("timestamp")).withWatermark(order[0], late)
    return watched.groupBy("pr_key").transformWithStateInPandas(Newest(watched.schema, order, quiet_ms), watched.schema, "Append", "EventTime")


def start(raw: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, quiet_ms: int = 60_000, late: str = "1 hour"):
    """Runs ``handle`` on the events that are due in each batch. A restart from the checkpoint goes on with the state as it was."""
    raw.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    routed = route(parse_payload(raw)).where("status = 'ACCEPTED'")
    return newest_events(routed, quiet_ms, late).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coalesced(spark: SparkSession, routed: DataFrame, folder: str, quiet_ms: int, late: str, order: tuple[str, str]) -> DataFrame:
    """What ``newest_events`` gives out for all that there is now, written to ``folder`` in the shared one and read again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    at = f"{shared_dir(spark)}/patchweave/{spark.sparkContext.applicationId}/{folder}"
    due = newest_events(routed, quiet_ms, late, order)
    due.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(due.schema).parquet(f"{at}/out")
