import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import statistics as st
from tickweave.operators.asof import asof, following, interval_rows, interval_spread
from tickweave.operators.labels import Schedule, labels, origins, schedule
from tickweave.operators.lens import quotes
from tests.data import frames, snap


def test_asof_by_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.randrange(100), i) for i in range(80)]
    points = [(r.choice("abc"), r.randrange(-5, 110), i) for i in range(120)]
    d, p = spark.createDataFrame(rows, "k string, t long, id long"), spark.createDataFrame(points, "k string, t long, pid long")
    back = {x.pid: x.s_id for x in asof(p, d, ["k"], ["id"], order=["id"], prefix="s_").collect()}
    ahead = {x.pid: x.s_id for x in asof(p, d, ["k"], ["id"], order=["id"], forward=True, prefix="s_").collect()}
    for k, t, i in points:
        before = [(a, b) for g, a, b in rows if g == k and a <= t]
        after = [(a, b) for g, a, b in rows if g == k and a >= t]
        assert back[i] == (max(before)[1] if before else None) and ahead[i] == (min(after)[1] if after else None)
    spans = p.select("k", "pid", F.col("t").alias("lo"), (F.col("t") + 13).alias("hi"))
    got = {(x.pid, x.id) for x in interval_rows(spans, d, ["k"], lo="lo", hi="hi", bucket=10).collect()}
    assert got == {(i, b) for k, t, i in points for g, a, b in rows if g == k and t <= a <= t + 13}
    assert asof(p, d.limit(0), ["k"], ["id"], prefix="s_").where("s_id is null").count() == 120


def test_interval_spread_by_brute_force(spark):
    r = random.Random(8)
    rows = [(r.choice("ab"), r.randrange(60), r.choice([None, 1.0, 2.0, 5.0])) for _ in range(60)]
    points = [(r.choice("abc"), r.randrange(-5, 70), i) for i in range(100)]
    d, p = spark.createDataFrame(rows, "k string, t long, v double"), spark.createDataFrame(points, "k string, t long, pid long")
    got = {x.pid: (x.rows, x.most, x.least) for x in interval_spread(p, d, ["k"], "v", 7).collect()}
    near = {i: [v for g, a, v in rows if g == k and t <= a <= t + 7] for k, t, i in points}
    assert got == {i: (len(v), *(f((x for x in v if x is not None), default=None) for f in (max, min))) for i, v in near.items() if v}


def test_interval_queries_send_no_exploded_tasks(spark):
    from tickweave.plans import labels as plans
    from tests.oracle import SF

    # the driver must not collect what was exploded from a small table
    plan = plans.interval_counts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [part for part in plan.split("BroadcastExchange")[1:] if "Generate" in part.split("Exchange")[0]]


def test_following(spark):
    d = spark.createDataFrame([("a", 10 * i, i + 1) for i in range(5)], "k string, t long, rn long")
    p = spark.createDataFrame([("a", -1), ("a", 0), ("a", 5), ("a", 35), ("b", 1)], "k string, t long")
    got = {(x.k, x.t): x.n_t for x in following(p, d, ["k"], [], 2, prefix="n_").collect()}
    assert got == {("a", -1): 10, ("a", 0): 20, ("a", 5): 20, ("a", 35): None, ("b", 1): None}


def test_labels_and_statuses(spark):
    rows = [snap(i, i * 0.5 + 0.1, 100 + 0.2 * i) for i in range(60) if i not in (30, 31, 32)]
    rows = [(*x[:11], x[0], *x[12:]) for x in rows]
    s, sess, c = frames(spark, rows)
    q = quotes(s, sess, c)
    t = schedule(sess, Schedule(1.0, 1.0, (0.0,)))
    got = {(x.anchor, x.task // 1_000_000, x.horizon): x for x in labels(t, q, (1, 2)).collect()}
    assert got["decision", 5, 1].y == 3 and got["decision", 5, 2].y == 5 and got["decision", 5, 2].y_incremental == 2
    assert got["arrival", 5, 1].status == "ok" and got["arrival", 5, 1].y == 2
    assert got["decision", 15, 1].status in ("INVALID_ORIGIN", "LATE_FUTURE", "GAPPED_OR_INVALID_FUTURE")
    assert got["decision", 14, 2].status in ("LATE_FUTURE", "GAPPED_OR_INVALID_FUTURE") and got["decision", 29, 2].status == "NO_FUTURE"
    assert {x.source_status for x in origins(t, q).collect()} >= {"ok", "STALE_SOURCE"}
    with pytest.raises(ValueError):
        Schedule(step=0)


def test_correlation_guards(spark):
    g = np.random.default_rng(1)
    data = [("a", float(x), float(y)) for x, y in g.integers(0, 5, (40, 2))] + [("a", None, 1.0)]
    data += [("few", 1.0, 2.0)] * 3 + [("flat", 1.0, float(i)) for i in range(30)] + [("level", float(i), 7.0) for i in range(30)]
    got = {r.k: r for r in st.information(spark.createDataFrame(data, "k string, x double, y double"), ["k"]).collect()}
    x, y = np.array([d[1] for d in data[:40]]), np.array([d[2] for d in data[:40]])
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    assert got["a"].ic == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["a"].rank_ic == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and got["a"].n == 40
    assert [got[k].status for k in ("few", "flat", "level")] == ["NOT_ENOUGH_PAIRS", "CONSTANT_FACTOR", "CONSTANT_LABEL"] and got["flat"].ic is None


def test_survival_and_weighted(spark):
    d = spark.createDataFrame([(1.0, 1, 1.0), (2.0, 0, 1.0), (2.0, 1, 1.0), (3.0, 1, 2.0), (3.0, 0, 1.0), (5.0, 1, 1.0), (None, 1, 1.0)], "t double, e int, w double")
    got = [(r.time, round(r.survival, 9)) for r in st.survival(d.withColumn("g", F.lit("x")), ["g"], "t", "e", "w").orderBy("time").collect()]
    s = [6 / 7, 6 / 7 * 5 / 6, 6 / 7 * 5 / 6 * 2 / 4, 0.0]
    assert got == [(t, round(v, 9)) for t, v in zip((1.0, 2.0, 3.0, 5.0), s)]
    w = spark.createDataFrame([("x", float(v), float(k)) for v, k in ((1, 1), (2, 3), (9, 1))], "g string, v double, w double")
    assert [tuple(r) for r in st.weighted_quantiles(w, ["g"], "v", "w", (0.2, 0.5, 0.9)).collect()] == [("x", 1.0, 2.0, 9.0)]
    m = st.weighted_moments(w, ["g"], "v", "w").first()
    x = np.array([1, 2, 2, 2, 9.0])
    assert m.mean == pytest.approx(x.mean()) and m.sd == pytest.approx(x.std()) and m.skew == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3)


def test_sign_flip_and_blocks(spark):
    v = [0.3, -0.1, 0.2, 0.4]
    signs = [[1 if k >> i & 1 else -1 for i in range(4)] for k in range(16)]
    assert st.sign_flip(v) == np.mean([abs(np.dot(s, v)) >= abs(sum(v)) - 1e-12 for s in signs])
    draws = st.block_draws(spark, [f"d{i}" for i in range(7)], 20, 3, 1)
    assert draws.groupBy("repeat").agg(F.sum("times").alias("n")).where("n <> 7").count() == 0
    daily = spark.createDataFrame([("a", f"d{i}", float(i)) for i in range(7)], "g string, day string, m double")
    r = st.block_interval(daily, ["g"], "day", "m", repeats=50).first()
    assert r.mean == 3.0 and r.low <= 3.0 <= r.high
    assert {x.start: x["mean"] for x in st.circular_blocks(daily, ["g"], "day", "m", 3).collect()}[6] == pytest.approx((6 + 0 + 1) / 3)


def test_contracts_and_small_helpers(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError):
        st.require_unique(d, ["k"])
    assert st.require_unique(d, ["v"]) is d
    assert [r.k for r in st.kept_together(d, ["k"], "v", 2).collect()] == [1]
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "n string, p double")
    assert {r.n: round(r.adjusted, 6) for r in st.holm(p, "p").collect()} == {"x": 0.03, "z": 0.06, "y": 0.06}
    line = spark.createDataFrame([("g", float(x), 2.0 * x + 1, 1.0 + x) for x in range(4)], "g string, x double, y double, w double")
    r = st.weighted_line(line, ["g"], "x", "y", "w").first()
    assert (round(r.a, 9), round(r.b, 9), round(r.r2, 9)) == (1.0, 2.0, 1.0)
    s = spark.createDataFrame([(10, 1), (70, -1), (5000, 1)], "s int, direction int")
    assert st.scopes(s, "s", {"m": (0, 60), "h": (0, 3600)}).count() == 3 and st.sides(s).count() == 6
    assert math.isclose(st.leave_one_out(spark.createDataFrame([("g", "a", 1.0), ("g", "b", 3.0)], "g string, d string, m double"), ["g"], "d", "m").where("left_out = 'a'").first().without, 3.0)




def test_sign_flip_takes_every_day():
    g = np.random.default_rng(4)
    for n in (1, 2, 15, 18):
        v = g.normal(0.3, 1, n)
        patterns = 2.0 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1) - 1
        assert st.sign_flip(v) == np.mean(np.abs(patterns @ v) >= abs(v.sum()) - 1e-12)
    assert st.sign_flip(np.ones(40)) == 2 / 2**40
    assert st.sign_flip([1.0, -1.0]) == 1.0
    # 28 days of equal size: a binomial tail
    assert st.sign_flip([1.0] * 20 + [-1.0] * 8) == pytest.approx(2 * sum(math.comb(28, k) for k in range(20, 29)) / 2**28)
    with pytest.raises(ValueError):
        st.sign_flip(np.ones(41))


def test_sign_flips_query_uses_every_date(spark, tmp_path, monkeypatch):
    from tickweave.plans import research

    g = np.random.default_rng(5)
    cost = {(s, d): float(g.normal(0.2 * (s == "M"), 1)) for s in ("M", research.MAIN[-1] if research.MAIN[-1] != "M" else research.MAIN[0]) for d in range(20)}
    other = next(s for s, _ in cost if s != "M")
    orders = spark.createDataFrame([(f"2026-01-{d + 1:02d}", s, c) for (s, d), c in cost.items()], "trade_date string, strategy string, cost double")
    monkeypatch.setattr(research, "orders", lambda spark, d: orders)
    (r,) = research.sign_flips(spark, str(tmp_path)).collect()
    assert r.strategy == other and r.p == pytest.approx(st.sign_flip([cost["M", d] - cost[other, d] for d in range(20)]))


def test_sign_flip_of_more_than_forty_days():
    g = np.random.default_rng(6)
    assert st.sign_flip_days(np.ones(60)) == 2 / 2**60
    assert st.sign_flip_days([0.1] * 40 + [-0.1] * 21) == pytest.approx(2 * sum(math.comb(61, k) for k in range(40, 62)) / 2**61, rel=1e-12)
    whole, count = g.integers(-1000, 1300, 100), {0: 1}
    for v in whole.tolist():
        new = {}
        for s, n in count.items():
            for t in (s + v, s - v):
                new[t] = new.get(t, 0) + n
        count = new
    exact = sum(n for s, n in count.items() if abs(s) >= abs(int(whole.sum()))) / 2**100
    assert st.sign_flip_days(whole / 7.0) == pytest.approx(exact, rel=1e-11)
    assert st.sign_flip_days(whole / 7.0, most=1000) == pytest.approx(exact, rel=1e-3)  # a tie is shared out by the grid
    v = g.normal(0.3, 1, 40)  # days of no size do not matter: the grid against the halves
    assert st.sign_flip_days([*v, 0.0], most=1000) == pytest.approx(st.sign_flip(v), rel=1e-6)


def test_sign_flips_query_takes_a_year(spark, tmp_path, monkeypatch):
    from tickweave.plans import research

    other = next(s for s in research.MAIN if s != "M")
    orders = spark.createDataFrame([(f"2026-{d // 28 + 1:02d}-{d % 28 + 1:02d}", s, float(s == "M" and d % 3 > 0) - float(s == "M" and d % 3 == 0)) for d in range(250) for s in ("M", other)], "trade_date string, strategy string, cost double")
    monkeypatch.setattr(research, "orders", lambda spark, d: orders)
    (r,) = research.sign_flips(spark, str(tmp_path)).collect()
    up = sum(d % 3 > 0 for d in range(250))
    assert r.p == pytest.approx(2 * sum(math.comb(250, k) for k in range(up, 251)) / 2**250, rel=1e-10)


def test_cube_equals_the_long_form(spark):
    g = np.random.default_rng(9)
    data, long = [], []
    for task in range(60):
        for o in (1, 2):
            x = [None if g.random() < 0.1 else float(v) for v in (g.normal(), g.integers(0, 3), 7.0)]
            y = [None if g.random() < 0.1 else float(v) for v in g.integers(-3, 4, 8)]
            data.append(("d", task, o, x, y))
    full = {(u, j, c): 0 for _, u, *_ in data for j in range(3) for c in range(4)}
    for _, u, _, x, y in data:
        for j in range(3):
            for c in range(4):
                full[u, j, c] += x[j] is not None and None not in y[2 * c : 2 * c + 2]
    kinds = [(a, k) for a in ("decision", "arrival") for k in ("cumulative", "incremental")]
    for _, u, o, x, y in data:
        for j in range(3):
            for c in range(4):
                for h in (0, 1):
                    v = y[2 * c + h]
                    for target in ("signed", "absolute"):
                        for cohort in ("own", "common"):
                            if cohort == "own" or full[u, j, c] == 2:
                                long.append((f"f{j}", o, *kinds[c], target, cohort, h + 1, x[j], v if v is None or target == "signed" else abs(v)))
    by = ["factor", "observation", "anchor", "label", "target", "cohort", "horizon"]
    want = st.information(spark.createDataFrame(long, "factor string, observation bigint, anchor string, label string, target string, cohort string, horizon int, x double, y double"), by)
    wide = spark.createDataFrame(data, "trade_date string, task bigint, observation bigint, x array<double>, y array<double>")
    got = st.information_cube(wide, ["f0", "f1", "f2"], (1, 2), 2, ["trade_date"], block=2)
    a, b = ({tuple(r[k] for k in by): (r.n, r.status, r.ic, r.rank_ic) for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) == 3 * 2 * 4 * 2 * 2 * 2
    for k in a:
        assert a[k][:2] == b[k][:2] and a[k][2:] == pytest.approx(b[k][2:], abs=1e-9), k


def test_pairs_equal_plain_loops():
    g = np.random.default_rng(12)
    x = np.column_stack([g.normal(size=60), g.integers(0, 3, 60), np.full(60, 7.0), 1e10 + g.normal(size=60), np.where(np.arange(60) < 4, 1e10, g.normal(size=60)), np.where(np.arange(60) < 31, 0.0, 5 + 1e-7 * g.integers(0, 9, 60)), g.normal(size=60)])
    y = g.integers(-2, 3, (60, 4)).astype(float)
    y[:, 2] = np.where(np.arange(60) < 5, np.nan, 3.0)
    x[g.random(x.shape) < 0.05] = np.nan
    x[g.random(60) < 0.8, 6] = np.nan
    y[g.random(y.shape) < 0.05] = np.nan
    y[:31, 3] = np.nan
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() - 1) / 2 for a in v])
    seen = set()
    for own in (y, np.repeat(np.where(np.isnan(y).any(axis=1), np.nan, y[:, 0])[:, None], 3, axis=1)):
        for which, (n, ic, rank, status) in zip((own, np.abs(own)), st.pair_matrix(x, [own, np.abs(own)], 20)):
            for j in range(x.shape[1]):
                for k in range(which.shape[1]):
                    rows = ~np.isnan(x[:, j]) & ~np.isnan(which[:, k])
                    a, b = x[rows, j], which[rows, k]
                    want = "NOT_ENOUGH_PAIRS" if len(a) < 20 else "CONSTANT_FACTOR" if a.min() == a.max() else "CONSTANT_LABEL" if b.min() == b.max() else "ok"
                    assert n[j, k] == len(a) and st.STATUS[status[j, k]] == want
                    seen.add(want)
                    if want == "ok":
                        assert ic[j, k] == pytest.approx(np.corrcoef(a - a[0], b)[0, 1], abs=1e-7 if j == 3 else 1e-9) and rank[j, k] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1], abs=1e-12)
                    else:
                        assert np.isnan(ic[j, k]) and np.isnan(rank[j, k])
    assert seen == set(st.STATUS)


def test_cube_summary_tells_sessions_apart_and_equals_the_summed_rows(spark):
    g = np.random.default_rng(10)
    data = []
    for day in ("d", "e", "f", "g"):
        for session in ("0930", "1330") if day != "f" else ("0930",):
            for task in range(60 if day != "g" else 12):
                for o in (1, 2):
                    v = int(g.integers(0, 9))
                    if o == 2 and v > 5:
                        data.append((day, session, task, o, *data[-1][4:]))
                        continue
                    data.append((day, session, task, o, [None if v == 0 else float(g.normal()), float(g.integers(0, 3)), 7.0], [None if v == 1 else float(a) for a in g.integers(-3, 4, 8)]))
    wide = spark.createDataFrame(data, "trade_date string, session string, task bigint, observation bigint, x array<double>, y array<double>")
    rows = (["f0", "f1", "f2"], (1, 2), 2, ["trade_date"])
    cube = st.information_cube(wide, *rows, block=2, task=("session", "task")).cache()
    # a task of its own for each session: what is common does not mix them
    alone = [tuple([*r[:1], r[2] + 1000 * (r[1] == "1330"), *r[3:]]) for r in data]
    want = st.information_cube(spark.createDataFrame(alone, "trade_date string, task bigint, observation bigint, x array<double>, y array<double>"), *rows)
    by = ["factor", "observation", "anchor", "label", "target", "cohort", "horizon"]
    every = lambda x, k: {tuple(r[c] for c in k): tuple(r) for r in x.select(*sorted(x.columns)).collect()}
    assert every(cube, ["trade_date", *by]) == every(want, ["trade_date", *by])
    assert min(r.n for r in cube.where("trade_date = 'd' and cohort = 'common' and factor = 'f1'").collect()) > 60
    # cases of the same values in one row
    shared = wide.groupBy("trade_date", "session", "x", "y").agg(F.collect_list(F.struct("task", "observation")).alias("cases"))
    got, own = every(st.information_cube(shared, *rows, task=("session", "task")), ["trade_date", *by]), every(cube, ["trade_date", *by])
    assert shared.count() < len(data) and got.keys() == own.keys() and all(got[k] == pytest.approx(own[k], abs=1e-9) for k in own)
    total = every(st.information_summary(cube, by), by)
    for most in (20_000, 2):
        x = st.cube_summary(wide, *rows, block=2, task=("session", "task"), most=most)
        assert x.columns == st.information_summary(cube, by).columns
        got = every(x, by)
        assert got.keys() == total.keys() and len(got) == 3 * 2 * 4 * 2 * 2 * 2
        for k in got:
            assert got[k] == pytest.approx(total[k], abs=1e-9), k


def test_running_totals_with_null_groups_and_hot_ones(spark):
    from tickweave.operators.totals import running_totals

    r = np.random.default_rng(4)
    rows = [(None if k == 3 else f"g{k}", int(i), float(v)) for i, (k, v) in enumerate(zip(r.integers(0, 4, 900) // r.integers(1, 3, 900), r.integers(0, 9, 900)))]
    out = running_totals(spark.createDataFrame(rows, "g string, i long, v double").repartition(6), ["g"], ["i"], "v").collect()
    assert len(out) == 900
    for x in out:
        mine = [v for g, i, v in rows if g == x.g]
        assert x.total_all == sum(mine) and x.total == sum(v for g, i, v in rows if g == x.g and i <= x.i)
    assert running_totals(spark.createDataFrame([], "g string, i long, v double"), ["g"], ["i"], "v").count() == 0


def test_ranks_by_column():
    import pandas as pd

    g = np.random.default_rng(3)
    for shape in ((1, 3), (40, 5), (7, 1)):
        a = g.integers(0, 6, shape).astype(float)
        assert np.array_equal(st.column_ranks(a), pd.DataFrame(a).rank().to_numpy())


def test_flips_of_stretches():
    v = [0.3, 0.1, -0.2, 0.5, 0.4, 0.2, 0.1, 0.6, -0.1]
    parts = [sum(v[:3]), sum(v[3:5]), sum(v[5:7]), sum(v[7:])]
    want = sum(abs(sum(s * p for s, p in zip(signs, parts))) >= abs(sum(parts)) - 1e-12 for signs in itertools.product((1, -1), repeat=4)) / 16
    assert st.block_flip(v) == want and st.block_flip([1.0]) == 1.0


def test_label_totals_equal_the_labels_and_do_not_depend_on_parts(spark):
    from tickweave.operators.labels import label_totals
    from tickweave.plans.features import rows
    from tickweave.plans.labels import tasks
    from tests.oracle import SF

    t, q = tasks(spark, SF), rows(spark, SF)
    some = q.select("Contract", "trade_date", "session").distinct().orderBy("Contract", "trade_date", "session").limit(6)
    lone = spark.createDataFrame([("nothing", "2026-01-05", "0930", 12_000_000, 1_000_000, 13_000_000)], "Contract string, trade_date string, session string, task bigint, observation bigint, t bigint")
    t, q = t.join(some, some.columns).select(*lone.columns).unionByName(lone).cache(), q.join(some, some.columns).cache()
    by = ["Contract", "trade_date", "session", "observation", "anchor", "horizon", "status", "incremental_status"]
    totals = [F.count("*").alias("labels"), *(f(c).alias(f"{c}_{n}") for c in ("y", "y_incremental") for n, f in (("sum", F.sum), ("least", F.min), ("most", F.max))), F.sum(F.abs("y")).alias("y_size"), F.avg("late").alias("late")]
    near = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    want = {tuple(r[:8]): near(r[8:]) for r in labels(t, q, (1, 2, 5)).groupBy(*by).agg(*totals).collect()}
    for most in (50_000, 40):
        got = label_totals(t, q, (1, 2, 5), most)
        found = got.select(*by, *(c for c in got.columns if c not in by)).collect()
        assert len(found) == len(want) and {tuple(r[:8]): near(r[8:]) for r in found} == want
    assert any(k[0] == "nothing" for k in want)
