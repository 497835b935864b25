"""Sliding-window admission audit of a request log.

A request is admitted while fewer than the tier's limit of *admitted* requests lie within the
window before it. Rejected requests do not count, so the rule is recursive and no window frame
expresses it. Most of the log needs no recursion, though: where even the raw number of requests
stays within the limit, all of them are admitted whatever happened before.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac import fixed
from almanac.session import cut_lineage


def limit_of(tier: Column, limits: dict[str, int]) -> Column:
    """Requests per window of a tier; unknown tiers count as free."""
    result = F.lit(limits["free"])
    for name, limit in limits.items():
        result = F.when(tier == name, limit).otherwise(result)
    return result


def admit(hits: deque, now: int, limit: int, window_us: int) -> float | None:
    """One admission step on the key's admitted times (microseconds); None, or seconds to wait.

    A key that is never admitted (limit 0) is told to wait a whole window.
    """
    while hits and hits[0] <= now - window_us:
        hits.popleft()
    if len(hits) < limit:
        hits.append(now)
        return None
    return max(0.0, (window_us - (now - hits[0] if hits else 0)) / 1_000_000)


def busy_slices(log: DataFrame, window_us: int) -> DataFrame:
    """Time slices (key_id, slice, run) in which requests may be rejected.

    The log is cut into slices one window long and counted, partially before the shuffle. Every
    window ending in a slice lies within it and the slice before. If those two hold no more
    requests than the lowest limit in the slice (a key may change its tier), the slice is calm. A run is a stretch of adjacent slices that are not
    calm, with the slice before it, whose requests are all the state the run starts from.
    """
    counts = log.groupBy("key_id", "slice").agg(F.count("*").alias("n"), F.min("limit").alias("limit"))
    by_time = Window.partitionBy("key_id").orderBy("slice")
    marked = (counts
              .withColumn("before", F.sum("n").over(by_time.rangeBetween(-1, -1)))
              .withColumn("busy", F.col("n") + F.coalesce("before", F.lit(0)) > F.col("limit"))
              .withColumn("busy_after", F.coalesce(
                  F.bool_or("busy").over(by_time.rangeBetween(1, 1)), F.lit(False)))
              .filter(F.col("busy") | F.col("busy_after")))
    # A run starts at its leading calm slice, or at a busy one that follows a gap.
    follows = F.coalesce(F.count("*").over(by_time.rangeBetween(-1, -1)), F.lit(0)) > 0
    starts = (~F.col("busy")) | ~follows
    return (marked.withColumn("starts", starts.cast("int"))
            .withColumn("run", F.sum("starts").over(
                by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .select("key_id", "slice", "run"))


#: The time of the row that brings a group's entry state, before all others; also marks an admitted request.
_ENTRY = -(1 << 63)


class Replay:
    """The recursion over one key's requests in order.

    While the limit stays the same, either a request is admitted, or nothing changes before the oldest
    admitted one leaves the window: everything up to then is rejected in one step. So the work is one
    step for each admitted request, and arrays for the rest.
    """

    def __init__(self, window_us: int, hits: Iterable[int] = ()):
        self.window_us, self.hits = window_us, deque(hits)

    def waits(self, us: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Seconds to wait for each of the next requests; NaN for the admitted ones."""
        us = np.asarray(us, "int64")
        times, oldest = us.tolist(), us.copy()
        cuts = [0, *(np.flatnonzero(limit[1:] != limit[:-1]) + 1).tolist(), len(us)] if len(us) else []
        for start, stop in zip(cuts, cuts[1:]):
            self.stretch(times, start, stop, int(limit[start]), oldest)
        return _waits(us, oldest, self.window_us)

    def stretch(self, us: list[int], start: int, stop: int, limit: int, oldest: np.ndarray) -> None:
        """Replays the times from ``start`` to ``stop``, which have one limit. Into ``oldest`` goes ``_ENTRY``
        for the admitted ones and the admitted time that stands in the way of others, if there is any."""
        hits, window_us, at = self.hits, self.window_us, start
        while at < stop:
            now = us[at]
            while hits and hits[0] <= now - window_us:
                hits.popleft()
            if len(hits) < limit:
                hits.append(now)
                oldest[at] = _ENTRY
                at += 1
            elif hits:
                to = bisect_left(us, hits[0] + window_us, at, stop)
                oldest[at:to] = hits[0]
                at = to
            else:  # never admitted: told to wait a whole window
                break


def _waits(us: np.ndarray, oldest: np.ndarray, window_us: int) -> np.ndarray:
    return np.where(oldest == _ENTRY, np.nan, (window_us - (us - oldest)) / 1_000_000)


_GROUP = ["key_id", "run", "piece"]
#: Requests of the log that a piece stands for.
REQUESTS_PER_PIECE = 200_000
#: How many times as many pieces of a run are replayed in a row as in the round before.
_WIDER = 8


def _replayed(frames: Iterator[pd.DataFrame], window_us: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[tuple]]]:
    """(rows, waits, groups that ended with the state behind them) of each frame of sorted rows, and the last
    group after all. Only the state goes on from frame to frame; where rows have a ``block``, also from a
    group to the next one of the same run and block.

    Columns leave pandas once for a frame: most groups are a few rows, and a frame for each of them would
    cost many times their replay.
    """
    current, within, replay = None, None, None
    for frame in frames:
        if not len(frame):
            continue
        marks, us, limit = frame[_GROUP].to_numpy(), frame["us"].to_numpy(), frame["limit"].to_numpy()
        entry, oldest, left = us == _ENTRY, us.copy(), []
        starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1) | entry[:-1] | (limit[1:] != limit[:-1])) + 1).tolist()]
        times = us.tolist()
        blocks = frame["block"].to_numpy()[starts].tolist() if "block" in frame else [None] * len(starts)
        for start, stop, group, most, block in zip(starts, [*starts[1:], len(frame)], map(tuple, marks[starts].tolist()), limit[starts].tolist(), blocks):
            if group != current:
                if current is not None:
                    left.append((*current, list(replay.hits)))
                if block is None or within != (*group[:2], block):
                    replay = Replay(window_us)
                current, within = group, (*group[:2], block)
            if times[start] == _ENTRY:
                replay = Replay(window_us, frame["hits"].iloc[start].tolist())
            else:
                replay.stretch(times, start, stop, most, oldest)
        yield frame[~entry], _waits(us, oldest, window_us)[~entry], left
    if current is not None:
        yield frame[:0], np.empty(0), [(*current, list(replay.hits))]


def _in_groups(rows: DataFrame, entries: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Rows by group, or by block where they have one, in order; the entry state is one more row, the first."""
    rows = rows.withColumn("hits", F.lit(None).cast("array<long>"))
    if entries is not None:
        first = entries.withColumn("us", F.lit(_ENTRY)).withColumn("limit", F.lit(0))
        rows = rows.unionByName(first, allowMissingColumns=True)
    key = ["key_id", "run", "block"] if "block" in rows.columns else _GROUP
    dealt = rows.repartition(tasks, *key) if tasks else rows.repartition(*key)
    return dealt.sortWithinPartitions(*_GROUP, "us", "event_id")


def _states(rows: DataFrame, window_us: int, entries: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(group, out): the admitted times that each group of rows leaves behind."""
    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, left in _replayed(frames, window_us):
            if left:
                yield pd.DataFrame(left, columns=[*_GROUP, "out"])

    return _in_groups(rows, entries, tasks).mapInPandas(last, "key_id long, run long, piece int, out array<long>")


def entry_states(ordered: DataFrame, window_us: int, tasks: int | None = None) -> DataFrame:
    """(group, hits): the admitted times a piece of a run starts from, where a run lies in several pieces.

    All pieces of such runs are first replayed at once from nothing. What a piece leaves behind is where
    the next one starts; pieces that start from something else than before are replayed again, until none
    is left. The replay is then right from the first piece on. A state forgets its start as soon as the key
    was below its limit, so that one more round settles most runs. A run whose state never forgets can only
    be followed in order: a replay goes on into the pieces after it, as far as the end of a block that is
    ``_WIDER`` times as long in each round, so that the rounds are the logarithm of a run's pieces and all
    of them together take about as many steps as the run has rows, in one task at last. Rows are dealt to
    ``tasks`` tasks.
    """
    run, none = ["key_id", "run"], F.array().cast("array<long>")
    by_run = Window.partitionBy(*run)
    in_order, wide = by_run.orderBy("piece"), 1
    pieces = ordered.select(*_GROUP).distinct().withColumn("n", F.count("*").over(by_run)).where("n > 1")
    pieces = cut_lineage(pieces.select(*_GROUP, (F.row_number().over(in_order) - 1).alias("place")))
    alone = _states(ordered.join(pieces.drop("place"), _GROUP), window_us, tasks=tasks)
    states = cut_lineage(alone.join(pieces, _GROUP).withColumn("hits", none))
    while True:
        states = states.withColumn("before", F.coalesce(F.lag("out").over(in_order), none))
        wide *= _WIDER
        block = F.floor(F.col("place") / wide).alias("block")
        first = F.min(F.struct("place", "piece", "before")).alias("first")
        starts = states.where("hits != before").groupBy(*run, block).agg(first)
        starts = cut_lineage(starts.select(*run, "block", "first.piece", F.col("first.place").alias("start"), F.col("first.before").alias("hits")))
        if starts.isEmpty():
            return states.where(F.size("before") > 0).select(*_GROUP, F.col("before").alias("hits"))
        again = pieces.withColumn("block", block).join(starts.drop("piece", "hits"), [*run, "block"]).where("place >= start")
        new = _states(ordered.join(again.select(*_GROUP, "block"), _GROUP), window_us, starts.drop("start"), tasks)
        states = (states.drop("before").join(new.withColumnRenamed("out", "new"), _GROUP, "left")
                  .join(starts.select(*_GROUP, F.col("hits").alias("entry")), _GROUP, "left")
                  .withColumn("out", F.coalesce("new", "out")))
        # a replay that went on into a piece started there from what the piece before now leaves
        went_on = F.when(F.col("new").isNotNull(), F.coalesce(F.lag("out").over(in_order), none))
        states = cut_lineage(states.select(*_GROUP, "place", "out", F.coalesce("entry", went_on, "hits").alias("hits")))


def rate_limit_audit(log: DataFrame, limits: dict[str, int] | None = None,
                     window_seconds: int = fixed.LIMIT_WINDOW_SECONDS, pieces: int | None = None) -> DataFrame:
    """Admission of every request of (key_id, tier, event_id, ts), with the seconds to wait if not.

    Requests in calm slices are answered by columns alone. Only runs of busy slices go through the
    recursion: dealt by ranges of key, run and time into ``pieces`` (by default as many as the log's rows ask
    for), so that a key that stays at its limit without a break is many tasks' work, and streamed in order with
    at most ``limit`` admitted times in memory. Pieces are dealt to as many tasks as a shuffle has at least.
    """
    if pieces is None:
        pieces = max(1, -(-log.count() // REQUESTS_PER_PIECE))
    tasks = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces)
    window_us = window_seconds * 1_000_000
    log = log.select("key_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
                     limit_of(F.col("tier"), limits or fixed.TIER_LIMITS).alias("limit")) \
             .withColumn("slice", F.floor(F.col("us") / window_us))
    result = (f"key_id long, event_id long, ts {log.schema['ts'].dataType.simpleString()}, "
              "admitted boolean, wait_seconds double")
    placed = log.join(busy_slices(log, window_us), ["key_id", "slice"], "left")
    calm = placed.filter(F.col("run").isNull()).select(
        "key_id", "event_id", "ts", F.lit(True).alias("admitted"),
        F.lit(None).cast("double").alias("wait_seconds"))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, waits, _ in _replayed(frames, window_us):
            out = rows[["key_id", "event_id", "ts"]].copy()
            out["admitted"] = np.isnan(waits)
            out["wait_seconds"] = pd.array(np.where(np.isnan(waits), None, waits), dtype="Float64")
            yield out

    order = ["key_id", "run", "us", "event_id"]
    busy = placed.filter(F.col("run").isNotNull()).select(*order, "ts", "limit")
    ordered = cut_lineage(busy.repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id()))
    entries = entry_states(ordered, window_us, pieces)
    return calm.unionByName(_in_groups(ordered, entries, tasks).mapInPandas(decide, result))
