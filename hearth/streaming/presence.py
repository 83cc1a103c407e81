"""Listings that sources stop listing: event-time timers in place of a batch's look at dates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATES = "id string, state string, at timestamp"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class _Presence(StatefulProcessor):
    """Value state: the last sighting and the state that was told; one timer, `days` behind the last sighting."""

    def __init__(self, days: float):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.unique(np.concatenate([pd.to_datetime(batch["ts"], utc=True).dt.tz_localize(None).to_numpy("datetime64[ms]").astype(np.int64) for batch in rows]))
        last, state = self.seen.get() if self.seen.exists() else (None, None)
        times = times if last is None else times[times > last]
        if not len(times):
            return
        told = []
        if state != "listed":
            told, last = [("listed", int(times[0]))], int(times[0])
        held = np.concatenate(([last], times))
        for i in np.flatnonzero(np.diff(held) > self._wait()):  # unseen for so long between two sightings of one batch
            told += [("unlisted", int(held[i]) + self._wait()), ("listed", int(held[i + 1]))]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((int(times[-1]), "listed"))
        self.handle.registerTimer(int(times[-1]) + self._wait())
        if told:
            yield self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, state = self.seen.get()
        if state == "listed" and expiredTimerInfo.getExpiryTimeInMs() == last + self._wait():
            self.seen.update((last, "unlisted"))
            yield self._told(key, [("unlisted", last + self._wait())])

    def close(self) -> None:
        pass

    def _wait(self) -> int:
        return int(self.days * 86_400_000)

    @staticmethod
    def _told(key, told: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]] * len(told), "state": [state for state, _ in told], "at": [_EPOCH + timedelta(milliseconds=at) for _, at in told]})


def presence(sightings: DataFrame, days: float = 3, late: str = "1 day") -> DataFrame:
    """A stream id, ts (ts an instant) -> id, state, at: "listed" when a listing appears or comes back, "unlisted" `days`
    after its last sighting: when the watermark passes that, or the next sighting comes that much later.

    A sighting that is late, but the last one so far, moves the timer; one before the last changes nothing, nor does a
    repeated one. Null ids and instants are no sightings. Instants count in milliseconds.
    """
    rows = sightings.filter("id is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("id").transformWithStateInPandas(_Presence(days), STATES, "append", "eventtime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """States with timers need the state store on disk; what the session had before comes back."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)
