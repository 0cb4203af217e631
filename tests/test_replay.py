"""The declarative replay against an event loop, order by order."""

import bisect

import pytest

from tests.data import frames, walk
from tickweave.operators.labels import Schedule, schedule
from tickweave.operators.lens import KEYS, quotes
from tickweave.operators.replay import choose_action, market_orders, orders, replay, replay_policies


def loop(data, task, side, offset, decisions, early, later=None, initial=True):
    """One order, event by event: rows before clocks at one time, a standing limit before an arriving command."""
    t = [r["t"] for r in data]
    good = lambda r: r["valid_price"] and r["valid_book"] and r["valid_queue"] and r["valid_volume"]

    def source(x):
        i = bisect.bisect_right(t, x) - 1
        return (i, "no_source") if i < 0 else (i, "stale_source") if x - t[i] > 500_000 else (i, "" if good(data[i]) else "invalid_source")

    arrive = lambda x: bisect.bisect_right(t, x) + 1
    i, bad = source(task)
    if bad:
        return "initial_" + bad
    p0 = data[i]["p"]
    later = offset if later is None else later
    standing, queue = None, [(arrive(task), "limit", p0 - side * offset, "initial")] if initial else []
    clocks = [(task + s * 1_000_000, s) for s in (*early, *decisions, 10)]
    events = sorted([(t[k], 0, k) for k in range(i + 1, len(t))] + [(c, 1, s) for c, s in clocks])

    def match(r):
        lim = standing[0]
        return (r["a"] <= lim or (r["dv"] > 0 and r["p"] < lim)) if side == 1 else (r["b"] >= lim or (r["dv"] > 0 and r["p"] > lim))

    for now, kind, k in events:
        if kind == 0:
            r = data[k]
            if not (good(r) and r["step"] and r["edge_volume"]):
                return "broken_path"
            if standing and match(r):
                return ("limit", standing[1], standing[0], now)
            while queue and queue[0][0] == k:
                _, what, level, stage = queue.pop(0)
                if what == "market":
                    return ("market", stage, r["a"] if side == 1 else r["b"], now)
                standing = (level, stage)
                if match(r):
                    return ("limit", stage, level, now)
        else:
            i, bad = source(now)
            if any(c[1] == "market" for c in queue):
                continue
            if k in early:
                if not bad and side * data[i]["qstate"] > 0:
                    queue.append((arrive(now), "market", None, "signal"))
                continue
            if bad:
                return ("deadline_" if k == 10 else "signal_") + bad
            if k == 10:
                queue.append((arrive(now), "market", None, "deadline"))
            elif side * data[i]["qstate"] > 0:
                queue.append((arrive(now), "market", None, "signal"))
            else:
                level = data[i]["p"] - side * later
                if not standing or standing[0] != level:
                    queue.append((arrive(now), "limit", level, "signal"))
    return "insufficient_arrival_tail"


@pytest.mark.parametrize("decisions,early,offsets,initial", [((3,), (), (0, 2), True), ((3, 6, 9), (), (0, 2), True), ((3,), (1,), (0, 2), True), ((3,), (2,), (0, 2), True), ((), (), (0, 1), True), ((3,), (), (0,), False), ((3,), (), tuple((k, 4) for k in range(12)), True), ((3,), (), tuple((4, k) for k in range(12)), True)])
def test_replay_equals_the_event_loop(spark, decisions, early, offsets, initial):
    raw = [r for s in range(4) for r in walk(200, seed=20 + s, step=0.45, session=f"09{s}0", first=s * 100_000)]
    sess = [(s, "A", "2026-01-05", f"09{s}0", raw[0][4].replace(minute=30, second=0, microsecond=0), 80, None) for s in range(4)]
    snaps, sessions, contracts = frames(spark, raw, sess)
    q = quotes(snaps, sessions, contracts).cache()
    tasks = schedule(sessions, Schedule(2.0, 2.0, (0.0,)))
    got = replay(tasks, q, decisions, offsets, early, initial).collect()
    by = {}
    for r in q.orderBy("rn").collect():
        by.setdefault(r.session, []).append(r.asDict())
    filled = set()
    for o in got:
        want = loop(by[o.session], o.task, o.side, o.offset, decisions, early, o.signal_offset, initial)
        if isinstance(want, str):
            assert (o.status, o.reason) == ("invalid", want), (o, want)
        else:
            assert (o.status, o.kind, o.stage, o.price, o.fill_t) == ("filled", *want), (o, want)
            filled.add((o.kind, o.stage))
    assert len(got) == 4 * 39 * 2 * len(offsets) and ({("limit", "initial")} if initial else {("limit", "signal")}) <= filled
    if decisions:
        assert {("limit", "signal"), ("market", "signal")} <= filled


@pytest.mark.parametrize("most", [50_000, 40])
def test_policies_equal_the_event_loop_however_a_session_is_cut(spark, most):
    policies = {"A": ((), True), "B": ((3,), False), "C": ((3,), True), "C369": ((3, 6, 9), True)}
    raw = [r for s in range(4) for r in walk(200, seed=40 + s, step=0.45, session=f"09{s}0", first=s * 100_000)]
    sess = [(s, "A", "2026-01-05", f"09{s}0", raw[0][4].replace(minute=30, second=0, microsecond=0), 80, None) for s in range(5)]  # the last has no rows
    snaps, sessions, contracts = frames(spark, raw, sess)
    q = quotes(snaps, sessions, contracts).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = replay_policies(schedule(sessions, Schedule(0.0, 1.0, (0.0, 1.0))), q, policies, most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {"0940": []}
    for r in q.orderBy("rn").collect():
        by.setdefault(r.session, []).append(r.asDict())
    for o in got:
        decisions, initial = policies[o.policy]
        want = loop(by[o.session], o.task, o.side, 0, decisions, (), None, initial)
        if isinstance(want, str):
            assert (o.status, o.reason, o.stage, o.kind, o.fill_t, o.price, o.cost_bp) == ("invalid", want, *[None] * 5), (o, want)
        else:
            assert (o.status, o.reason, o.kind, o.stage, o.price, o.fill_t) == ("filled", None, *want) and o.cost_bp is not None, (o, want)
    assert len(got) == len({(o.session, o.task, o.side, o.policy) for o in got}) == 5 * 80 * 2 * 4
    assert {"initial_no_source", "broken_path", "deadline_stale_source"} <= {o.reason for o in got if o.reason}


def test_policies_move_their_rows_once(spark):
    from tests.oracle import SF
    from tickweave.plans.execution import exec_policies

    plan = exec_policies(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(Contract") <= 3 and plan.count("MapInArrow") == 1


def test_orders_and_market(spark):
    snaps, sessions, contracts = frames(spark, walk(100, seed=3))
    q = quotes(snaps, sessions, contracts)
    t = schedule(sessions, Schedule(5.0, 5.0, (1.0,)))
    assert orders(t, (0, 1, 2)).count() == 6 * t.count()
    m = market_orders(t, q).select(*KEYS, "task", "side", "cost_bp").collect()
    assert m and len(m) % 2 == 0


def test_action_rule(spark):
    d = spark.createDataFrame([(1, 1, 0.2, 0.6), (1, -1, 0.6, 0.2), (1, -1, 0.4, 0.35), (-1, 0, 0.3, 0.3)], "side int, signal int, down double, up double")
    got = [r[0] for r in d.select(choose_action(d.side, d.signal, d.down, d.up, 0.1)).collect()]
    assert got == ["market", "passive", "lastprice", "lastprice"]
