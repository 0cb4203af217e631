"""Queries that put scores, labels, replay and statistics together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.functions.catalog import AGES, ROW, SEGMENTS, WINDOWED
from tickweave.operators import factors, labels, models, replay
from tickweave.operators import statistics as st
from tickweave.operators.asof import asof
from tickweave.operators.labels import Schedule
from tickweave.operators.lens import KEYS, ORDER
from tickweave.plans.execution import SPECS, path, replay_sql
from tickweave.plans.features import kept, rows
from tickweave.plans.fills import _D, _O, MAIN, orders, out
from tickweave.plans.labels import _ALL, HORIZONS, PLAN, tasks, with_factors
from tickweave.plans.models import _S, FROZEN, examples
from tickweave.plans.oracle import rounded_sql as R
from tickweave.plans.oracle import windowed_sql

CLOCKS = (0.5, 1.0, 2.0, 3.0, 5.0, 10.0)
K = ", ".join(KEYS)


def landmark_retention(spark: SparkSession, d: str) -> DataFrame:
    """Share of orders still open at fixed times."""
    return out(st.retention(orders(spark, d), ["strategy"], "elapsed", CLOCKS))


def retention_interval(spark: SparkSession, d: str) -> DataFrame:
    """Share of orders open after 3 s per main strategy, with block resamples of dates."""
    o = orders(spark, d).where(F.col("strategy").isin(*MAIN) & F.col("elapsed").isNotNull())
    daily = o.groupBy("trade_date", "strategy").agg(F.count_if(F.col("elapsed") > 3).alias("open"), F.count("*").alias("n"))
    return out(st.block_ratio(daily, ["strategy"], "trade_date", "open", "n"))


def forward_selection(spark: SparkSession, d: str) -> DataFrame:
    """The sweep offset of least cost on the first eight dates, and what it costs later."""
    daily = orders(spark, d).where("strategy like 'sweep%'").groupBy("trade_date", "strategy").agg(F.avg("cost").alias("cost"))
    return out(st.forward_choice(daily, "strategy", "trade_date", "cost", 8))


def switch_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a strategy's daily saving on the older one is positive with its lower bound above 0."""
    daily = orders(spark, d).where(F.col("strategy").isin("legacy_3s", "fixed_1s", "fixed_3s")).groupBy("trade_date", "strategy").agg(F.avg("cost").alias("cost"))
    old = daily.where("strategy = 'legacy_3s'").select("trade_date", F.col("cost").alias("old"))
    saving = daily.where("strategy <> 'legacy_3s'").join(old, "trade_date").select("trade_date", "strategy", (F.col("old") - F.col("cost")).alias("saving"))
    x = st.block_interval(saving, ["strategy"], "trade_date", "saving")
    return out(x.withColumn("passes", (F.col("mean") > 0) & (F.col("low") > 0)))


def sign_flips(spark: SparkSession, d: str) -> DataFrame:
    """Exact sign-flip p value of each strategy's saving on the market order, over all its dates, with Holm's adjustment, and of four stretches of dates. Dates are few by nature."""
    daily = orders(spark, d).where(F.col("strategy").isin(*MAIN)).groupBy("trade_date", "strategy").agg(F.avg("cost").alias("cost"))
    m = daily.where("strategy = 'M'").select("trade_date", F.col("cost").alias("m"))
    x = daily.where("strategy <> 'M'").join(m, "trade_date").where("m - cost is not null")
    lists = x.groupBy("strategy").agg(F.sort_array(F.collect_list(F.struct("trade_date", (F.col("m") - F.col("cost")).alias("v")))).alias("v")).collect()
    values = [(r["strategy"], [v["v"] for v in r["v"]]) for r in lists]
    rows = [(k, st.sign_flip_days(v), st.block_flip(v)) for k, v in values]
    return st.holm(spark.createDataFrame(rows, "strategy string, p double, block_p double"), "p")  # not rounded: the least p is 2 of 2^dates


def trailing_accuracy(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Accuracy over the trailing half minute of nominal time, equal over dates."""
    x = examples(spark, d, plan).withColumns(models.scores(FROZEN)).withColumn("hit", F.when(models.predicted() == F.col("y"), 1.0).otherwise(0.0))
    sec = x.groupBy("trade_date", (F.col("task") / 1_000_000).cast("bigint").alias("second")).agg(F.sum("hit").alias("h"), F.count("*").alias("n"))
    w = Window.partitionBy("trade_date").orderBy("second").rangeBetween(-29, 0)
    r = sec.select("trade_date", "second", (F.sum("h").over(w) / F.sum("n").over(w)).alias("accuracy"))
    return out(r.groupBy("second").agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("days")))


def horizon_accuracy(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """How often a factor's sign meets the label's at each horizon, equal over dates: frozen signals at horizons they were not made for."""
    q, _ = with_factors(spark, d, [("price", "F05", "Momentum")])
    o = labels.origins(tasks(spark, d, plan), q, ["F05_Momentum_h5s"]).where("source_status = 'ok'")
    y = labels.labels(None, q, HORIZONS, o).where("status = 'ok' and s_F05_Momentum_h5s <> 0")
    daily = y.groupBy("trade_date", "anchor", "horizon").agg(F.avg(F.when(F.signum("y") == F.signum("s_F05_Momentum_h5s"), 1.0).otherwise(0.0)).alias("accuracy"))
    return out(daily.groupBy("anchor", "horizon").agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("days")))


def three_action(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """The action per side and threshold from frozen probabilities, and how often each is taken."""
    x = examples(spark, d, plan).withColumns(models.scores(FROZEN)).withColumn("signal", models.predicted()).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    parts = [x.withColumns({"threshold": F.lit(t), "action": replay.choose_action(F.col("side"), F.col("signal"), F.col("p_down"), F.col("p_up"), t)}) for t in (0.0, 0.1, 0.2)]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("side", "threshold", "action").agg(F.count("*").alias("tasks")))


def branch_gather(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Mean cost where each order takes, of two replayed branches, the one its queue's side picks: passive by a tick with it, at the last price against it."""
    t, q = tasks(spark, d, plan), path(spark, d)
    r = replay.replay(t, q, (3,), (0, 1)).where("status = 'filled'")
    s = asof(t.select(*KEYS, "task", F.col("task").alias("t")).distinct(), q, KEYS, ["qstate"], order=ORDER[1:], prefix="s_")
    x = r.join(s.select(*KEYS, "task", "s_qstate"), [*KEYS, "task"]).withColumn("wanted", F.when(F.col("side") * F.col("s_qstate") < 0, 1).otherwise(0)).where("offset = wanted")
    return out(x.groupBy("side", "wanted").agg(F.count("*").alias("orders"), F.avg("cost_bp").alias("cost_bp")))


def offset_heat(spark: SparkSession, d: str, plan: Schedule = PLAN, offsets: tuple = SPECS["exec_offset_sweep"][1]) -> DataFrame:
    """Mean cost by bin of the queue imbalance at the task and passive offset."""
    t, q = tasks(spark, d, plan), path(spark, d)
    r = replay.replay(t, q, (3,), offsets).where("status = 'filled'")
    s = asof(t.select(*KEYS, "task", F.col("task").alias("t")).distinct(), q, KEYS, ["qb", "qa"], order=ORDER[1:], prefix="s_")
    qi = (F.col("s_qb") - F.col("s_qa")) / (F.col("s_qb") + F.col("s_qa"))
    x = r.join(s.select(*KEYS, "task", F.least(F.floor((qi + 1) * 5), F.lit(9)).cast("int").alias("bin")), [*KEYS, "task"])
    return out(x.groupBy("side", "bin", "offset").agg(F.count("*").alias("orders"), F.avg("cost_bp").alias("cost_bp")))


def cost_parts(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Cost of market fills split at the decision: drift before it, delay and spread after it. The parts add up."""
    t, q = tasks(spark, d, plan), path(spark, d)
    r = replay.replay(t, q, (3,), (0,)).where("status = 'filled' and kind = 'market'")
    at = lambda s: asof(t.select(*KEYS, "task", (F.col("task") + s * 1_000_000).alias("t")).distinct(), q, KEYS, ["p"], order=ORDER[1:], prefix=f"x{s}_").select(*KEYS, "task", f"x{s}_p")
    x = r.join(at(0), [*KEYS, "task"]).join(at(3), [*KEYS, "task"])
    bp = lambda e: F.avg(F.col("side") * F.expr(e) / F.col("x0_p") * 1e4)
    return out(x.groupBy("stage", "side").agg(F.count("*").alias("orders"), bp("x3_p - x0_p").alias("drift"), bp("price - x3_p").alias("after"), F.avg("cost_bp").alias("cost_bp")))


def both_histories(spark: SparkSession, d: str, keys: list[tuple[str, str, str]]) -> tuple[DataFrame, tuple[list[str], list[str]]]:
    """The lens with factors over 5 and 10 s in it, from one pass of windows."""
    names = tuple([f"{f}_{s}_h{h}s" for _, f, s in keys] for h in (5, 10))
    q = factors.add_formulas(rows(spark, d), {n: (g, WINDOWED[g, f, s][0], h) for ns, h in zip(names, (5, 10)) for n, (g, f, s) in zip(ns, keys)})
    q = q.withColumns({n: F.expr(R(n)) for ns in names for n in ns})
    return kept(q, "p", "seg_price", "valid_price", *names[0], *names[1]), names


def window_compression(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """A factor over a short and a long history: correlation of both with the label and with each other, equal over dates."""
    keys = _PAIR
    q, (short, long) = both_histories(spark, d, keys)
    o = labels.origins(tasks(spark, d, plan), q, [*short, *long]).where("source_status = 'ok'")
    y = labels.labels(None, q, (1,), o).where("anchor = 'decision' and status = 'ok'")
    pair = F.explode(F.array(*(F.struct(F.lit(f"{f}_{s}").alias("factor"), F.col(f"s_{a}").alias("a"), F.col(f"s_{b}").alias("b")) for (_, f, s), a, b in zip(keys, short, long))))
    x = y.select("trade_date", "y", pair.alias("x")).select("trade_date", "y", "x.*").where("a is not null and b is not null")
    c = lambda u, v: st.correlation(F.col(u), F.col(v), 20)["ic"]
    daily = x.groupBy("trade_date", "factor").agg(c("a", "y").alias("short"), c("b", "y").alias("long"), c("a", "b").alias("common"))
    return out(daily.groupBy("factor").agg(*(F.avg(n).alias(n) for n in ("short", "long", "common")), F.count_if(F.abs("short") >= F.abs("long")).alias("short_days"), F.count("*").alias("days")))


def factor_registry(spark: SparkSession, d: str, histories: tuple[int, ...] = (5, 10)) -> DataFrame:
    """What there is: factor, family, dependency group, history, kind and formula."""
    rows = [(f"{f}_{s}", f, g, None, "row", e) for (f, s), (g, _, e) in ROW.items()]
    rows += [(f"{f}_{s}_h{h}s", f, g, h, "windowed", e) for (g, f, s), (e, _) in WINDOWED.items() for h in histories]
    rows += [(f"{p}{k}", p[:3], g, None, "age" if not k else "quality", e) for p, (g, e) in AGES.items() for k in ("", "LowerBound", "LeftCensored")]
    rows += [(f"{f}_{s}_lag{n}s", f, g, n, "segments", e) for s, (f, g, e, _) in SEGMENTS.items() for n in (2, 5)]
    rows += [(f"R05_{s}_lag{n}s", "R05", SEGMENTS[s][1], n, "alias", f"{SEGMENTS[s][0]}_{s}_lag{n}s") for s in ("VolumeRateChange", "OFIRateChange", "MomentumSpeedChange") for n in (2, 5)]
    return spark.createDataFrame(rows, "factor string, family string, dependency string, seconds int, kind string, formula string")


QUERIES = {f.__name__: f for f in (landmark_retention, retention_interval, forward_selection, switch_gate, sign_flips, trailing_accuracy, horizon_accuracy, three_action, branch_gather, offset_heat, cost_parts, window_compression, factor_registry)}

_FILLED = f"SELECT * FROM ({replay_sql(*SPECS['exec_offset_sweep'], True)}) WHERE status = 'filled'"
_TWO = f"SELECT * FROM ({replay_sql(*SPECS['exec_two_stage'], True)}) WHERE status = 'filled'"
_POINT = lambda s: f"(SELECT x.*, y.p, y.qstate, y.qb, y.qa FROM (SELECT *, task + {s * 1000000} AS t FROM tk) x ASOF LEFT JOIN lasts y ON x.Contract = y.Contract AND x.trade_date = y.trade_date AND x.session = y.session AND x.t >= y.t)"
_HEAD = _ALL.split(", src AS")[0] + f", tk AS (SELECT DISTINCT {K}, task FROM tasks)"
_PAIR = [("price", "F05", "Momentum"), ("price", "C01", "PriceRV")]
_corr = lambda u, v: f"CASE WHEN count(*) >= 20 AND min({u}) < max({u}) AND min({v}) < max({v}) THEN greatest(least(covar_pop({u}, {v}) / nullif(stddev_pop({u}) * stddev_pop({v}), 0), 1.0), -1.0) END"
_MAIN = ", ".join(repr(k) for k in MAIN)
_SAVED = f"WITH {_O}, {_D}, sv AS (SELECT a.trade_date, a.strategy, b.cost - a.cost AS saving FROM d a JOIN d b ON a.trade_date = b.trade_date AND b.strategy = 'legacy_3s' WHERE a.strategy IN ('fixed_1s', 'fixed_3s'))"
_FLIP = lambda src, out: f"""{out} AS (SELECT strategy, count(*) FILTER (WHERE abs(s) >= abs(total) - 1e-12) / count(*) AS p FROM (SELECT strategy, k, sum(CASE WHEN (k >> i) & 1 = 1 THEN v ELSE -v END) AS s, sum(v) AS total
    FROM {src}, range(0, 1 << 20) g(k) WHERE k < (1 << n) GROUP BY strategy, k) GROUP BY 1)"""  # noqa: E731
SQL = {
    "sign_flips": f"""WITH {_O}, {_D}, mk AS (SELECT trade_date, cost AS m FROM d WHERE strategy = 'M'), df AS (SELECT a.strategy, a.trade_date, m - cost AS v FROM d a JOIN mk USING (trade_date) WHERE strategy IN ({_MAIN}) AND strategy <> 'M' AND m - cost IS NOT NULL),
        f1 AS (SELECT strategy, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM df WINDOW w AS (PARTITION BY strategy ORDER BY trade_date)),
        f4 AS (SELECT strategy, b AS i, sum(v) AS v, CAST(least(4, any_value(n)) AS BIGINT) AS n FROM (SELECT *, CASE WHEN i < (n % 4) * (n // 4 + 1) THEN i // (n // 4 + 1) ELSE n % 4 + (i - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) END AS b FROM f1) GROUP BY strategy, b),
        {_FLIP('f1', 'p1')}, {_FLIP('f4', 'p4')}, h AS (SELECT strategy, p1.p, p4.p AS block_p, row_number() OVER (ORDER BY p1.p, strategy) AS k, count(*) OVER () AS c FROM p1 JOIN p4 USING (strategy))
        SELECT strategy, p, block_p, max(least(1.0, p * (c - k + 1))) OVER (ORDER BY k) AS adjusted FROM h""",
    "switch_gate": f"""{_SAVED}, {st.block_draws_sql("SELECT trade_date AS day FROM sv")}, me AS (SELECT strategy, repeat, sum(saving * times) / sum(times) AS v FROM sv JOIN dr ON dr.day = sv.trade_date WHERE saving IS NOT NULL GROUP BY 1, 2),
        lh AS (SELECT strategy, (SELECT avg(saving) FROM sv s WHERE s.strategy = me.strategy) AS mean, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM me GROUP BY 1) SELECT strategy, {R('mean')} AS mean, {R('low')} AS low, {R('high')} AS high, mean > 0 AND low > 0 AS passes FROM lh""",
    "retention_interval": f"""WITH {_O}, dy AS (SELECT trade_date, strategy, count(*) FILTER (WHERE elapsed > 3) AS a, count(*) AS b FROM o WHERE strategy IN ({_MAIN}) AND elapsed IS NOT NULL GROUP BY 1, 2), {st.block_draws_sql("SELECT trade_date AS day FROM dy")},
        me AS (SELECT strategy, repeat, sum(a * times) / sum(b * times) AS v FROM dy JOIN dr ON dr.day = dy.trade_date GROUP BY 1, 2) SELECT strategy, {R('(SELECT sum(a) / sum(b) FROM dy e WHERE e.strategy = me.strategy)')} AS ratio, {R('quantile_cont(v, 0.025)')} AS low, {R('quantile_cont(v, 0.975)')} AS high FROM me GROUP BY strategy""",
    "landmark_retention": f"WITH {_O} SELECT strategy, clock, count(*) FILTER (WHERE elapsed > clock) AS open, {R('count(*) FILTER (WHERE elapsed > clock) / count(*)')} AS share FROM o, (SELECT CAST(unnest([{', '.join(map(str, CLOCKS))}]) AS DOUBLE) AS clock) WHERE elapsed IS NOT NULL GROUP BY 1, 2",
    "forward_selection": f"WITH {_O}, {_D}, s AS (SELECT * FROM d WHERE strategy LIKE 'sweep%'), k AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT DISTINCT trade_date FROM s)), g AS (SELECT strategy, avg(cost) FILTER (WHERE k <= 8) AS train, avg(cost) FILTER (WHERE k > 8) AS test FROM s JOIN k USING (trade_date) GROUP BY 1) SELECT strategy, {R('train')} AS train, {R('test')} AS test FROM g WHERE train IS NOT NULL ORDER BY g.train, strategy LIMIT 1",
    "trailing_accuracy": f"{_S}, sec AS (SELECT trade_date, task // 1000000 AS second, sum(CASE WHEN c = y THEN 1.0 ELSE 0 END) AS h, count(*) AS n FROM pr GROUP BY 1, 2), r AS (SELECT second, sum(h) OVER w / sum(n) OVER w AS a FROM sec WINDOW w AS (PARTITION BY trade_date ORDER BY second RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT second, {R('avg(a)')} AS accuracy, count(*) AS days FROM r GROUP BY 1",
    "horizon_accuracy": f"{_ALL}, h AS (SELECT o.trade_date, anchor, horizon, avg(CASE WHEN sign(y) = sign(F05_Momentum_h5s) THEN 1.0 ELSE 0 END) AS a FROM o JOIN fac ON fac.snap_id = o.s_snap_id JOIN laby USING ({K}, task, observation) WHERE source_status = 'ok' AND laby.status = 'ok' AND F05_Momentum_h5s <> 0 GROUP BY 1, 2, 3) SELECT anchor, horizon, {R('avg(a)')} AS accuracy, count(*) AS days FROM h GROUP BY 1, 2",
    "three_action": f"{_S} SELECT side, {R('threshold')} AS threshold, CASE WHEN side * c > 0 THEN 'market' WHEN side * c < 0 AND side * (p_down - p_up) >= threshold THEN 'passive' ELSE 'lastprice' END AS action, count(*) AS tasks FROM pr, (VALUES (1), (-1)) a(side), (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) b(threshold) GROUP BY 1, threshold, 3",
    "branch_gather": f"{_HEAD} SELECT side, wanted, count(*) AS orders, {R('avg(cost_bp)')} AS cost_bp FROM (SELECT r.*, CASE WHEN side * s.qstate < 0 THEN 1 ELSE 0 END AS wanted FROM (SELECT * FROM ({replay_sql((3,), (0, 1), True)}) WHERE status = 'filled') r JOIN {_POINT(0)} s USING ({K}, task)) WHERE \"offset\" = wanted GROUP BY 1, 2",
    "offset_heat": f"{_HEAD} SELECT side, CAST(least(floor(((qb - qa) / (qb + qa) + 1) * 5), 9) AS INTEGER) AS bin, \"offset\", count(*) AS orders, {R('avg(cost_bp)')} AS cost_bp FROM ({_FILLED}) r JOIN {_POINT(0)} s USING ({K}, task) GROUP BY 1, 2, 3",
    "window_compression": f"""{_ALL.split(', fac AS')[0]}, f5 AS ({windowed_sql(_PAIR, 5)}), f10 AS ({windowed_sql(_PAIR, 10)}), w AS ({' UNION ALL '.join(f"SELECT snap_id, '{f}_{s}' AS factor, {f}_{s}_h5s AS a, {f}_{s}_h10s AS b FROM f5 JOIN f10 USING (snap_id)" for _, f, s in _PAIR)}),
        x AS (SELECT o.trade_date, factor, a, b, y FROM o JOIN w ON w.snap_id = o.s_snap_id JOIN laby USING ({K}, task, observation) WHERE source_status = 'ok' AND anchor = 'decision' AND horizon = 1 AND laby.status = 'ok' AND a IS NOT NULL AND b IS NOT NULL),
        g AS (SELECT trade_date, factor, {_corr('a', 'y')} AS short, {_corr('b', 'y')} AS long, {_corr('a', 'b')} AS common FROM x GROUP BY 1, 2)
        SELECT factor, {R('avg(short)')} AS short, {R('avg(long)')} AS long, {R('avg(common)')} AS common, count(*) FILTER (WHERE abs(short) >= abs(long)) AS short_days, count(*) AS days FROM g GROUP BY 1""",
    "cost_parts": f"{_HEAD} SELECT stage, side, count(*) AS orders, {R('avg(side * (s3.p - s0.p) / s0.p * 1e4)')} AS drift, {R('avg(side * (price - s3.p) / s0.p * 1e4)')} AS after, {R('avg(cost_bp)')} AS cost_bp FROM ({_TWO}) r JOIN {_POINT(0)} s0 USING ({K}, task) JOIN {_POINT(3)} s3 USING ({K}, task) WHERE kind = 'market' GROUP BY 1, 2",
}
