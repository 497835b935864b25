"""Admission audit and streams against plain Python and their batch twins."""

import datetime as dt
import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac.operators import ratelimit, usage
from almanac.sources.keyed import KeyedTable
from almanac.streaming import admission, monitor, subscriptions
from almanac.streaming import usage as usage_stream

LOG = "key_id long, tier string, event_id long, ts timestamp"
START = dt.datetime(2024, 1, 1)
LIMITS = {"free": 3, "pro": 5, "enterprise": 50}


def plain_audit(rows, limits, window):
    out, state = {}, {}
    for key, tier, event, ts in sorted(rows, key=lambda r: (r[0], r[3], r[2])):
        now = round((ts - START).total_seconds() * 1_000_000)
        hits = state.setdefault(key, deque())
        while hits and hits[0] <= now - window * 1_000_000:
            hits.popleft()
        if len(hits) < limits.get(tier, limits["free"]):
            hits.append(now)
            out[event] = (True, None)
        else:
            out[event] = (False, max(0.0, window - (now - hits[0] if hits else 0) / 1_000_000))
    return out


def random_log(seed, n=3000):
    """One key holds a third of all requests; quiet and crowded spells, equal times, keys that change tier."""
    rng, rows, clock = random.Random(seed), [], {}
    for event in range(n):
        key = 0 if rng.random() < 1 / 3 else rng.randrange(1, 9)
        step = rng.choice([0, 0, 1_000_000, 7_500_000, 60_000_000]) if rng.random() < .98 else 600_000_000
        clock[key] = clock.get(key, 0) + step
        tier = ["free", "pro", "enterprise", "other"][(key + event // 40) % 4]
        rows.append((key, tier, event, START + dt.timedelta(microseconds=clock[key])))
    return rows


def as_dict(df):
    return {r.event_id: (r.admitted, r.wait_seconds) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for event, (admitted, wait) in want.items():
        assert got[event][0] is admitted, event
        assert (got[event][1] is None) if wait is None else got[event][1] == pytest.approx(wait)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_audit(spark, seed):
    rows = random_log(seed)
    want = plain_audit(rows, LIMITS, 60)
    assert 0 < sum(not a for a, _ in want.values()) < len(rows)
    same(as_dict(ratelimit.rate_limit_audit(spark.createDataFrame(rows, LOG), LIMITS)), want)


@pytest.mark.parametrize("kind", ["random", "even", "tiers", "bursts"])
def test_audit_of_one_key_split_over_tasks(spark, kind):
    """One key holds all rows and never leaves its limit: its run lies in many pieces. Evenly spaced
    requests never forget where they started."""
    rng, now, rows = random.Random(kind), 0, []
    for event in range(6000):
        now += {"random": rng.choice([0, 1, 3, 5]), "even": 1, "tiers": rng.choice([0, 1, 2]), "bursts": 0 if event % 300 else 20}[kind]
        tier = "free" if kind != "tiers" else ["free", "pro", "enterprise"][event // 700 % 3]
        rows.append((1, tier, event, START + dt.timedelta(seconds=now)))
    log = spark.createDataFrame(rows, LOG).repartition(5)
    got = ratelimit.rate_limit_audit(log, LIMITS, pieces=9)
    same(as_dict(got), plain_audit(rows, LIMITS, 60))


@pytest.mark.parametrize("kind", ["even", "tiers"])
def test_rounds_are_few_where_a_run_never_forgets(spark, monkeypatch, kind):
    """A run in 40 pieces took a round for each of them."""
    rows = [(1, "free" if kind == "even" else ["free", "pro", "enterprise"][n % 7 % 3], n, START + dt.timedelta(seconds=n // 4)) for n in range(2000)]
    rounds, states = [], ratelimit._states
    monkeypatch.setattr(ratelimit, "_states", lambda *a, **k: rounds.append(1) or states(*a, **k))
    got = ratelimit.rate_limit_audit(spark.createDataFrame(rows, LOG).repartition(5), LIMITS, pieces=40)
    same(as_dict(got), plain_audit(rows, LIMITS, 60))
    assert 2 < len(rounds) <= 4


def test_pieces_of_a_run_start_where_the_one_before_ended(spark):
    rows = [(1, 7, 1_000_000 * n, n, 3, n // 100) for n in range(1000)] + [(2, 1, 5, 5000, 3, 9)]
    ordered = spark.createDataFrame(rows, "key_id long, run long, us long, event_id long, limit int, piece int")
    got = {r.piece: r.hits for r in ratelimit.entry_states(ordered, 60_000_000).collect()}
    replay = ratelimit.Replay(60_000_000)
    for piece in range(10):
        assert got.get(piece, []) == list(replay.hits)
        replay.waits(np.arange(piece * 100, piece * 100 + 100) * 1_000_000, np.full(100, 3))
    assert max(r["n"] for r in ordered.groupBy("piece").agg(F.count("*").alias("n")).collect()) <= 101


def test_runs_of_a_few_rows_share_their_frames():
    """A frame of many groups comes out as one frame, and the groups that ended in it as one list."""
    rows = [(key, 1, 0, us, 10 * key + n, 2, None) for key in range(500) for n, us in enumerate([0, 1, 2, 60_000_000])]
    frame = pd.DataFrame(rows, columns=["key_id", "run", "piece", "us", "event_id", "limit", "hits"])
    got = list(ratelimit._replayed(iter([frame[:1001], frame[1001:]]), 60_000_000))
    assert [len(rows) for rows, _, _ in got] == [1001, 999, 0]
    assert np.isnan(np.concatenate([waits for _, waits, _ in got])).tolist() == [True, True, False, True] * 500
    assert [x for _, _, left in got for x in left] == [(key, 1, 0, [1, 60_000_000]) for key in range(500)]


def test_pieces_grow_with_the_log(spark, monkeypatch):
    monkeypatch.setattr(ratelimit, "REQUESTS_PER_PIECE", 50)
    rows = random_log(4, 1000)
    got = ratelimit.rate_limit_audit(spark.createDataFrame(rows, LOG), LIMITS)
    assert got.rdd.getNumPartitions() >= 20
    same(as_dict(got), plain_audit(rows, LIMITS, 60))


def test_audit_at_the_window_edge(spark):
    rows = [(1, "free", n, START + dt.timedelta(seconds=s)) for n, s in enumerate([0, 1, 2, 59, 60, 60, 61, 200])]
    want = plain_audit(rows, LIMITS, 60)
    assert [want[n][0] for n in range(8)] == [True, True, True, False, True, False, True, True]
    same(as_dict(ratelimit.rate_limit_audit(spark.createDataFrame(rows, LOG), LIMITS)), want)


@pytest.mark.parametrize("limits", [{"free": 2, "pro": 10, "enterprise": 50}, {"free": 0, "pro": 1, "enterprise": 50}])
def test_audit_of_a_key_that_changes_its_tier(spark, limits):
    rows = [(1, "pro" if n == 4 else "free", n, START + dt.timedelta(seconds=n)) for n in range(5)]
    got = {e: a for e, (a, _) in as_dict(ratelimit.rate_limit_audit(spark.createDataFrame(rows, LOG), limits)).items()}
    assert got == {n: (n < limits["free"] or n == 4) for n in range(5)}


def test_calm_logs_need_no_replay(spark):
    rows = [(1, "free", n, START + dt.timedelta(seconds=45 * n)) for n in range(50)]
    log = spark.createDataFrame(rows, LOG).withColumn("limit", F.lit(3)) \
        .withColumn("slice", F.floor(F.unix_micros("ts") / 60_000_000))
    assert ratelimit.busy_slices(log, 60_000_000).count() == 0


def written(spark, df, path, parts):
    """The rows as several files whose times follow each other, one micro-batch each."""
    ordered = df.orderBy("ts").collect()
    size = -(-len(ordered) // parts)
    for n in range(parts):
        spark.createDataFrame(ordered[n * size:(n + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{n}")
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path))


@pytest.fixture
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    admission.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("batch_rows", [10_000, 40])
def test_admission_stream_equals_the_audit(spark, tmp_path, state_store, monkeypatch, batch_rows):
    """With Arrow batches of 40 rows the hot key's rows of a micro-batch come in several."""
    rows = random_log(5, 600)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    log = spark.createDataFrame(rows, LOG)
    stream = written(spark, log, str(tmp_path / "in"), 3)
    out = str(tmp_path / "out")
    (admission.admit_requests(stream, LIMITS, lateness="1 hour").writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same(as_dict(spark.read.schema(admission.RESULT).parquet(out)), plain_audit(rows, LIMITS, 60))


class FakeState(dict):
    """List, value and map state of one key, in memory."""

    def __init__(self):
        self.held = None
        self.most = 0

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def put(self, rows):
        self.held = list(rows)

    def update(self, row):
        self.held = row

    def clear(self):
        self.held = None

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.most = max(self.most, len(self[key][0]))
        del self[key]


class FakeHandle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, *_):
        return self.states.setdefault(name, FakeState())

    getValueState = getMapState = getListState

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_backlog_is_judged_part_by_part():
    rng, rows, now = random.Random(3), [], 0
    for event in range(4000):
        now += rng.choice([0, 100_000, 900_000])
        rows.append((now, event, 3))
    want = ratelimit.Replay(60_000_000)
    want = dict(zip([r[1] for r in rows], want.waits(np.array([r[0] for r in rows]), np.full(4000, 3))))
    rng.shuffle(rows)
    frames = [pd.DataFrame(rows[n:n + 500], columns=["us", "event_id", "limit"]) for n in range(0, 4000, 500)]
    processor, handle = admission.Admission(60), FakeHandle()
    processor.init(handle)
    out = list(processor.handleInputRows((7,), iter(frames), handle))
    got = pd.concat(out)
    assert len(out) > 500 and max(map(len, out)) < 40 and handle.states["parts"].most < 40 and not handle.states["parts"]
    for event, wait in zip(got["event_id"], got["wait_seconds"]):
        assert (np.isnan(want[event]) and pd.isna(wait)) or want[event] == wait
    assert len(handle.timers) == 1 and len(handle.states["hits"].held) <= 3
    assert list(processor.handleExpiredTimer((7,), handle, None)) == [] and not handle.states["hits"].exists()


def test_late_requests_come_out_unjudged(spark, tmp_path, state_store):
    rows = [(1, "free", n, START + dt.timedelta(seconds=s)) for n, s in enumerate([0, 30, 10, 40])]
    for n, row in enumerate(rows):  # one file and micro-batch each, the third out of order
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    log = spark.createDataFrame(rows, LOG)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    (admission.admit_requests(stream, LIMITS, lateness="1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out")
     .option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination())
    got = {r.event_id: (r.admitted, r.late) for r in spark.read.schema(admission.RESULT).parquet(f"{tmp_path}/out").collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (None, True), 3: (True, False)}


def test_usage_stream(spark, tmp_path):
    log = spark.createDataFrame(random_log(6, 500), LOG)
    stream = written(spark, log, str(tmp_path / "in"), 4)
    path = str(tmp_path / "out")
    usage_stream.count_usage(stream, path, str(tmp_path / "check")).awaitTermination()
    got = {(r.key_id, r.day): r.requests for r in usage_stream.current_counts(spark, path).collect()}
    want = {(r.key_id, r.day): r["count"] for r in log.groupBy("key_id", F.to_date("ts").alias("day")).count().collect()}
    assert got == want


def test_filing_stream(spark, tmp_path):
    schema = "company_id long, accession_number string, form string, filed_date date, ts timestamp"

    def row(n, company, accession, form):
        return (company, accession, form, dt.date(2024, 1, 1), START + dt.timedelta(days=n))

    rows = [row(0, 1, "a", "10-K"), row(1, 1, "a", "10-K"), row(2, 1, "b", "4"), row(3, 2, "a", "8-K"), row(4, 1, "c", "10-Q"),
            row(5, 1, "a", "10-K")]
    filings = spark.createDataFrame(rows, schema)
    stream = written(spark, filings, str(tmp_path / "in"), 3)
    seen = str(tmp_path / "seen")
    monitor.watch_filings(stream, seen, str(tmp_path / "check")).awaitTermination()
    got = sorted((r.company_id, r.accession_number) for r in monitor.seen_filings(spark, seen).collect())
    assert got == [(1, "a"), (1, "c"), (2, "a")]
    # A second run over the same checkpoint finds nothing new and keeps the history.
    again = spark.readStream.schema(filings.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    monitor.watch_filings(again, seen, str(tmp_path / "check")).awaitTermination()
    assert monitor.seen_filings(spark, seen).count() == 3
    # Neither does a stream that starts over with another checkpoint.
    again = spark.readStream.schema(filings.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    monitor.watch_filings(again, seen, str(tmp_path / "other")).awaitTermination()
    assert monitor.seen_filings(spark, seen).count() == 3
    empty = spark.createDataFrame([], "company_id long, accession_number string")
    fresh = monitor.new_filings(filings, empty)
    assert {r.company_id: (r.new_filings, r.refresh) for r in monitor.refresh_list(fresh).collect()} == {1: (2, True), 2: (1, False)}


def test_subscriptions_in_any_order_of_arrival(spark, tmp_path, state_store):
    rng, rows = random.Random(4), []
    for event in range(400):
        rows.append((rng.randrange(25), event, None if rng.random() < 0.02 else START + dt.timedelta(hours=rng.randrange(60)), rng.choice(["created", "updated", "deleted", "other"]),
                     rng.choice(["active", "trialing", "past_due", None]), rng.choice(["p1", "p2", "old", None]), rng.choice([None, "c1", "c2"]),
                     rng.choice([None, dt.date(2024, 5, 1), dt.date(2024, 6, 1)])))
    schema = "account_id long, event_id long, ts timestamp, kind string, status string, price_id string, customer_id string, period_end date"
    prices = spark.createDataFrame([("p1", "pro"), ("p2", "enterprise")], "price_id string, tier string")
    keys = spark.createDataFrame([(n, n % 30, "free" if n % 2 else "pro") for n in range(60)], "key_id long, account_id long, tier string")
    arrival = rows + rows[:40]  # some come again
    rng.shuffle(arrival)
    for n in range(0, len(arrival), 110):
        spark.createDataFrame(arrival[n:n + 110], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:04d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    accounts = KeyedTable(spark, f"{tmp_path}/accounts", subscriptions.ACCOUNT, ["account_id"], buckets=4)
    held = KeyedTable(spark, f"{tmp_path}/keys", keys.schema, ["account_id"], buckets=4)
    held.append(keys)
    for _ in range(2):  # started again, it finds nothing to do
        subscriptions.follow_subscriptions(stream, prices, accounts, held, f"{tmp_path}/check").awaitTermination()
        state = usage.subscription_state(spark.createDataFrame(rows, schema), prices)
        assert sorted(map(tuple, accounts.read().collect())) == sorted(map(tuple, state.collect()))
        assert sorted(map(tuple, held.read().collect())) == sorted(map(tuple, usage.key_tiers(keys, state).collect()))
    assert len(set(accounts.marks().values())) == 1 and max(accounts.marks().values()) >= 3
