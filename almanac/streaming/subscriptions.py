"""Subscriptions folded from a stream of lifecycle events, whatever their order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from almanac import fixed
from almanac.operators import usage
from almanac.sources.keyed import KeyedTable
from almanac.streaming.admission import use_state_store

ACCOUNT = "account_id long, tier string, status string, customer_id string, period_end date, updated date"
_STATE = "us long, event_id long, tier string, status string, canceled boolean, customer_us long, customer_event long, customer_id string, period_us long, period_event long, period_end date"
#: Before every event.
_NEVER = (-(1 << 63), -(1 << 63))


class Fold(StatefulProcessor):
    """One account. The latest event by its own time decides plan and status, the latest with a customer the
    customer, the latest created or updated one the period end: three maxima, so that events may come in
    any order and again. An account whose plan, status, customer or period changed comes out once a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get()) if self.state.exists() else (*_NEVER, None, None, False, *_NEVER, None, *_NEVER, None)
        now = list(before)
        for frame in rows:
            for e in frame.itertuples(index=False):
                when = (_NEVER[0] if pd.isna(e.us) else int(e.us), int(e.event_id))
                customer = None if pd.isna(e.customer_id) else e.customer_id
                if when > tuple(now[0:2]):
                    now[0:5] = [*when, None if pd.isna(e.tier) else e.tier, None if pd.isna(e.status) else e.status, e.kind == "deleted"]
                if e.kind != "deleted" and customer is not None and when > tuple(now[5:7]):
                    now[5:8] = [*when, customer]
                if e.kind != "deleted" and when > tuple(now[8:10]):
                    now[8:11] = [*when, None if pd.isna(e.period_end) else e.period_end]
        if tuple(now) != before:
            self.state.update(tuple(now))
            us, _, tier, status, canceled, _, _, customer, _, _, period = now
            paid = not canceled and status in fixed.PAID_STATUSES
            updated = None if us == _NEVER[0] else pd.Timestamp(us, unit="us").date()
            yield pd.DataFrame([(key[0], (tier or "free") if paid else "free", "canceled" if canceled else status, customer, period, updated)],
                               columns=["account_id", "tier", "status", "customer_id", "period_end", "updated"])

    def close(self) -> None:
        pass


def account_changes(events: DataFrame, prices: DataFrame) -> DataFrame:
    """The accounts (as ``usage.subscription_state`` gives them) that an event has changed, from a stream of
    lifecycle events. The state is one row for each account. The session needs ``use_state_store``."""
    relevant = events.filter(F.col("kind").isin("created", "updated", "deleted")).join(prices, "price_id", "left")
    rows = relevant.select("account_id", "event_id", F.unix_micros("ts").alias("us"), "kind", "status", "tier", "customer_id", "period_end")
    return rows.groupBy("account_id").transformWithStateInPandas(Fold(), ACCOUNT, "update", "None")


def follow_subscriptions(events: DataFrame, prices: DataFrame, accounts: KeyedTable, keys: KeyedTable, checkpoint: str,
                         trigger: dict | None = None) -> StreamingQuery:
    """Keeps the accounts and the tiers of their keys up to date from a stream of events.

    Both are stored tables by account_id, of which a batch touches only the buckets of changed accounts.
    A batch repeated after a failure is known by its number in either table's manifest.
    """
    use_state_store(events.sparkSession)
    run = sha1(checkpoint.encode()).hexdigest()[:12]

    def record(batch: DataFrame, batch_id: int) -> None:
        changed = batch.persist()
        if accounts.marks().get(run, -1) < batch_id:
            accounts.replace(changed, changed, mark=(run, batch_id))
        if keys.marks().get(run, -1) < batch_id:
            keys.update(changed, lambda rows: usage.key_tiers(rows, changed), mark=(run, batch_id))
        changed.unpersist()

    return (account_changes(events, prices).writeStream.outputMode("update").foreachBatch(record)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
