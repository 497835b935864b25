"""Sliding-window admission on a request stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from almanac import fixed
from almanac.operators.ratelimit import Replay, limit_of

RESULT = "key_id long, event_id long, ts timestamp, admitted boolean, wait_seconds double, late boolean"
#: A key's rows of one batch are put in order by parts of the window, one part in memory at a time.
PARTS = 60

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that ``admit_requests`` needs; set it before its stream is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class Admission(StatefulProcessor):
    """The rule for one key. State: the admitted times within the window, the time of the last request that
    was judged, and, while a batch comes in that is larger than one Arrow batch, its rows by parts of the
    window. A timer drops the state once the watermark is a window past the last request."""

    def __init__(self, window_seconds: int):
        self.window_us = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "us long")
        self.judged = handle.getValueState("judged", "us long")
        self.parts = handle.getMapState("parts", "part long", "us array<long>, event_id array<long>, allowed array<int>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.judged.get()[0] if self.judged.exists() else None
        replay = Replay(self.window_us, [h[0] for h in self.hits.get()] if self.hits.exists() else ())
        first, following = next(rows), next(rows, None)
        if following is None:
            yield self._judge(key, first, replay, last)
            newest = int(first["us"].max())
        else:
            newest = max(self._put(frame) for frame in self._all(first, following, rows))
            for part in sorted(k[0] for k in list(self.parts.keys())):
                yield self._judge(key, self._take(part), replay, last)
        newest = newest if last is None else max(newest, last)
        self.judged.update((newest,))
        self.hits.clear()
        if replay.hits:
            self.hits.put([(h,) for h in replay.hits])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a watermark that has passed already calls the timer with the next one
        self.handle.registerTimer(max((newest + self.window_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        self.judged.clear()
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def _all(first: pd.DataFrame, second: pd.DataFrame, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield first
        yield second
        yield from rows

    def _put(self, frame: pd.DataFrame) -> int:
        """Adds a frame's rows to the parts they belong to; the newest time."""
        for part, own in frame.groupby(frame["us"] // max(1, self.window_us // PARTS)):
            held = [own[c].tolist() for c in ("us", "event_id", "limit")]
            if self.parts.containsKey((int(part),)):
                held = [list(old) + new for old, new in zip(self.parts.getValue((int(part),)), held)]
            self.parts.updateValue((int(part),), tuple(held))
        return int(frame["us"].max())

    def _take(self, part: int) -> pd.DataFrame:
        us, events, limits = self.parts.getValue((part,))
        self.parts.removeKey((part,))
        return pd.DataFrame({"us": list(us), "event_id": list(events), "limit": list(limits)})

    def _judge(self, key: tuple, rows: pd.DataFrame, replay: Replay, last: int | None) -> pd.DataFrame:
        rows = rows.sort_values(["us", "event_id"])
        late = (rows["us"] < last).to_numpy() if last is not None else np.zeros(len(rows), bool)
        waits = np.full(len(rows), np.nan)
        waits[~late] = replay.waits(rows["us"].to_numpy(np.int64)[~late], rows["limit"].to_numpy()[~late])
        admitted = np.where(late, None, np.isnan(waits))
        return pd.DataFrame({"key_id": key[0], "event_id": rows["event_id"].to_numpy(), "ts": pd.to_datetime(rows["us"].to_numpy(), unit="us"),
                             "admitted": pd.array(admitted, dtype="boolean"), "wait_seconds": pd.array(np.where(np.isnan(waits), None, waits), dtype="Float64"),
                             "late": late})


def admit_requests(requests: DataFrame, limits: dict[str, int] | None = None,
                   window_seconds: int = fixed.LIMIT_WINDOW_SECONDS, *, lateness: str) -> DataFrame:
    """Admission of every request of a (key_id, tier, event_id, ts) stream.

    The state of a key is its admitted times within the window, never more than its limit. A request older
    than one of its key that an earlier batch has judged can't be judged by the rule: it comes out as
    ``late``, neither admitted nor rejected. Only what is behind the watermark by more than ``lateness`` is
    dropped by Spark, and counted in the query's progress. The session needs ``use_state_store``.
    """
    prepared = (requests.withWatermark("ts", lateness)
                .select("key_id", "event_id", "ts", F.unix_micros("ts").alias("us"),
                        limit_of(F.col("tier"), limits or fixed.TIER_LIMITS).alias("limit")))
    return prepared.groupBy("key_id").transformWithStateInPandas(
        Admission(window_seconds), RESULT, "append", "EventTime")
