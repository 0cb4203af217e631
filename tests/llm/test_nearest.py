import datetime as dt
import random

import numpy as np
import pytest

from tickweave.llm.nearest import LearnedIndex, decision_snapshots, nearest_in_time

OPEN = dt.datetime(2026, 1, 5, 1, 30, tzinfo=dt.timezone.utc)


def test_index_bound_and_exact_positions():
    g = np.random.default_rng(0)
    keys = np.sort(np.r_[g.integers(0, 10**6, 4000), np.full(50, 777), (g.random(3000) ** 8 * 10**9).astype(int)]).astype(np.int64)
    starts = np.array([0, 1000, 2500])
    index = LearnedIndex(keys, starts, error=4)
    size = index.hi - index.lo
    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    miss = np.abs(np.repeat(index.slope, size) * (keys - np.repeat(index.first, size)) - pos)
    assert miss.max() <= 4 and size.sum() == len(keys)
    q = np.r_[keys[::7], keys[::5] + 1, g.integers(0, 10**9, 500), -5, 2 * 10**9]
    assert (index.lower_bound(q) == np.searchsorted(keys, q, side="left")).all()


def brute(queries, events, tolerance):
    out = set()
    for i, k, t in queries:
        near = sorted((abs(u - t), u, j) for j, g, u in events if k is not None and g == k and t is not None and u is not None and abs(u - t) <= tolerance)
        if near:
            out.add((i, near[0][2]))
    return out


@pytest.mark.parametrize("shard", [50, 1000])
def test_nearest_by_brute_force(spark, shard):
    r = random.Random(shard)
    events = [(i, r.choice(["a", "a", "a", "b"]), r.randrange(-300, 2000)) for i in range(900)] + [(9000, None, 5), (9001, "a", None)]
    queries = [(i, r.choice(["a", "a", "b", "c"]), r.randrange(-400, 2100)) for i in range(600)] + [(9000, None, 5), (9001, "a", None), (9002, "a", 44), (9003, "a", 44)]
    e = spark.createDataFrame(events, "event_id long, k string, t long").withColumnRenamed("k", "k")
    q = spark.createDataFrame([(*x, "clash") for x in queries], "query_id long, k string, t long, event_id string")
    got = nearest_in_time(q.select("k", "query_id", "t", "event_id"), e, ["k"], 7, shard=shard)
    assert {(x.query_id, x.event_id) for x in got.collect()} == brute(queries, events, 7)
    assert nearest_in_time(q, e.limit(0), ["k"], 7).count() == 0 and nearest_in_time(q.limit(0), e, ["k"], 7).count() == 0


def test_decisions_of_any_spelling(spark):
    at = lambda s: OPEN + dt.timedelta(microseconds=round(s * 1e6))
    d = [(1, " a1 ", 9.9, 5.2), (2, "A1", 5.3, None), (3, None, 5.3, 5.3), (4, "A1", None, None), (5, "A1", float("nan"), float("nan")), (6, "A1", 7.1, float("nan")), (7, "A1", 100.0, None), (8, "A1", 5.25, None)]
    dec = spark.createDataFrame([(i, c, "2026-01-05", "0930", a, b, "x") for i, c, a, b in d], "decision_id long, Contract string, trade_date string, session string, decision_seconds double, source_seconds double, open_time string")
    ses = spark.createDataFrame([(1, "A1", "2026-01-05", "0930", OPEN, 60)], "session_id long, Contract string, trade_date string, session string, open_time timestamp, session_seconds int")
    snaps = spark.createDataFrame([(i, "A1", "2026-01-05", "0930", at(s)) for i, s in ((10, 5.0), (11, 5.5), (12, 7.6), (13, 5.5), (14, 7.6))], "snap_id long, Contract string, trade_date string, session string, Datetime timestamp")
    got = {r.decision_id: r.snap_id for r in decision_snapshots(dec, ses, snaps).collect()}
    assert got == {1: 10, 2: 11, 6: 12, 8: 10}  # half a second away counts; the earlier of two, then the smaller id


@pytest.mark.parametrize("most", [40, 200])
def test_parts_of_a_shard_give_the_same_pairs(spark, most):
    r = random.Random(most)
    events = [(i, "a", r.choice([0, 700, 700, r.randrange(2000)])) for i in range(500)] + [(8000, "b", 10)]
    queries = [(i, "a", r.randrange(2000)) for i in range(700)] + [(1000 + i, "b", 11 + i % 5) for i in range(400)]  # one event, then 400 queries
    e = spark.createDataFrame(events, "event_id long, k string, t long")
    q = spark.createDataFrame(queries, "query_id long, k string, t long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(x.query_id, x.event_id) for x in nearest_in_time(q, e, ["k"], 7, shard=5000, most=most).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(queries, events, 7) and sum(i >= 1000 for i, _ in got) == 400
