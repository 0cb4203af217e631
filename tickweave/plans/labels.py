"""Queries of schedules, as-of joins, labels and their correlation with factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators import asof as joins
from tickweave.operators import derived, factors, labels, sequences, statistics
from tickweave.operators.labels import Schedule
from tickweave.operators.lens import KEYS, ORDER, quotes_sql
from tickweave.functions.catalog import WINDOWED
from tickweave.plans.features import kept, rows
from tickweave.plans.oracle import rounded_sql, windowed_sql
from tickweave.runtime import stored, stored_together
from tickweave.sources.tables import table

#: Every task: each second from 10 s, 1 to 5 s of observation.
PLAN = Schedule()
HORIZONS = tuple(range(1, 31))
FACTORS = [("price", "F05", "Momentum"), ("price", "C01", "PriceRV")]
K = ", ".join(KEYS)

TASKS = f"""tasks AS (SELECT {K}, task, observation, task + observation AS t FROM (SELECT {K}, unnest(generate_series(10000000, session_seconds * 1000000 - 1, 1000000)) AS task FROM sessions), (SELECT unnest(generate_series(1000000, 5000000, 1000000)) AS observation))"""
LASTS = f"""lasts AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY {K}, t ORDER BY rn DESC) = 1), firsts AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY {K}, t ORDER BY rn) = 1)"""
ON = " AND ".join(f"x.{k} = y.{k}" for k in KEYS)
ORIGINS = f"""src AS (SELECT x.*, y.rn AS s_rn, y.t AS s_t, y.snap_id AS s_snap_id, y.p AS s_p, y.seg_price AS s_seg, y.valid_price AS s_valid FROM tasks x ASOF LEFT JOIN lasts y ON {ON} AND x.t >= y.t),
    org AS (SELECT x.*, y.t AS a_t, y.p AS a_p, y.seg_price AS a_seg, y.snap_id AS a_snap_id,
        CASE WHEN s_t IS NULL THEN 'NO_SOURCE' WHEN x.t - s_t > 500000 THEN 'STALE_SOURCE' WHEN NOT s_valid THEN 'INVALID_INPUT' ELSE 'ok' END AS source_status, coalesce(y.valid_price AND y.seg_price = s_seg, false) AS arrives
        FROM src x LEFT JOIN q y ON {ON} AND y.rn = coalesce(s_rn, 0) + 2),
    o AS (SELECT *, CASE WHEN source_status <> 'ok' THEN source_status WHEN arrives THEN 'ok' ELSE 'MISSING_OR_GAPPED_ARRIVAL' END AS arrival_status FROM org)"""
LABELS = f"""anch AS (SELECT {K}, task, observation, 'decision' AS anchor, source_status = 'ok' AS usable, t AS start, s_p AS p0, s_seg AS seg0 FROM o UNION ALL SELECT {K}, task, observation, 'arrival', arrival_status = 'ok', a_t, a_p, a_seg FROM o),
    hz AS (SELECT *, start + horizon * 1000000 AS t FROM anch, (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS horizon)),
    ends AS (SELECT x.*, y.t AS e_t, y.p AS e_p, y.seg_price AS e_seg, y.valid_price AS e_valid FROM hz x ASOF LEFT JOIN firsts y ON {ON} AND x.t <= y.t),
    lab AS (SELECT *, CASE WHEN NOT usable THEN 'INVALID_ORIGIN' WHEN e_t IS NULL THEN 'NO_FUTURE' WHEN e_t - t > 500000 THEN 'LATE_FUTURE' WHEN NOT coalesce(e_valid AND e_seg = seg0, false) THEN 'GAPPED_OR_INVALID_FUTURE' ELSE 'ok' END AS status FROM ends),
    laby AS (SELECT *, CASE WHEN status = 'ok' THEN e_p - p0 END AS y, CASE WHEN usable THEN (e_t - t) / 1e6 END AS late FROM lab)"""


def tasks(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    return labels.schedule(table(spark, d, "sessions"), plan)


def schedule_grid(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Nominal tasks and decision times."""
    return tasks(spark, d, plan)


def asof_backward(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Each task's source row and its age."""
    x = joins.asof(tasks(spark, d, plan), rows(spark, d), KEYS, ["snap_id"], order=ORDER[1:], prefix="s_")
    return x.select(*KEYS, "task", "observation", F.col("s_snap_id").alias("snap_id"), (F.col("t") - F.col("s_t")).alias("age"))


def asof_forward(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """The first row at or after each task, at most half a second later."""
    x = joins.asof(tasks(spark, d, plan), rows(spark, d), KEYS, ["snap_id"], forward=True, order=ORDER[1:], prefix="s_")
    ok = F.col("s_t") - F.col("t") <= 500_000
    return x.select(*KEYS, "task", "observation", F.when(ok, F.col("s_snap_id")).alias("snap_id"), F.when(ok, F.col("s_t") - F.col("t")).alias("late"))


def nth_future(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """The second row strictly after each task."""
    return joins.following(tasks(spark, d, plan), rows(spark, d), KEYS, ["snap_id"], 2, order=ORDER[1:], prefix="n_").select(*KEYS, "task", "observation", F.col("n_snap_id").alias("snap_id"))


def interval_counts(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Rows and traded volume within 3 s after each task, by a range window."""
    x = joins.interval_spread(tasks(spark, d, plan), rows(spark, d), KEYS, "v", 3_000_000)
    # what has the same keys counts together
    return x.groupBy(*KEYS, "task", "observation").agg(F.sum("rows").alias("rows"), (F.max("most") - F.min("least")).alias("volume"))


def task_origins(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Source and arrival rows of tasks with their statuses."""
    x = labels.origins(tasks(spark, d, plan), rows(spark, d))
    return x.select(*KEYS, "task", "observation", F.col("s_snap_id").alias("source"), "source_status", F.when(F.col("arrival_status") == "ok", F.col("a_snap_id")).alias("arrival"), "arrival_status")


def label_grid(spark: SparkSession, d: str, plan: Schedule = PLAN, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Cumulative and incremental labels of both anchors over each horizon, of every task: totals per session, case, anchor, horizon and status."""
    x = labels.label_totals(tasks(spark, d, plan), rows(spark, d), horizons)
    return x.withColumn("late", F.expr(rounded_sql("late")))


def factored(spark: SparkSession, d: str, keys: list[tuple[str, str, str]], h: int = 5) -> tuple[DataFrame, list[str]]:
    """The lens with rounded factors in it, and their names."""
    names = [f"{f}_{s}_h{h}s" for _, f, s in keys]
    q = factors.add_formulas(rows(spark, d), {n: (g, WINDOWED[g, f, s][0], h) for n, (g, f, s) in zip(names, keys)})
    return q.withColumns({n: F.expr(rounded_sql(n)) for n in names}), names


def with_factors(spark: SparkSession, d: str, keys: list[tuple[str, str, str]], h: int = 5) -> tuple[DataFrame, list[str]]:
    """``factored``, written once: the as-of join then carries the factors along."""
    q, names = factored(spark, d, keys, h)
    return kept(q, "p", "seg_price", "valid_price", *names), names


#: What is correlated by itself: prices of different contracts are in different ticks.
UNIT = ["Contract", "trade_date"]


def _wide(o: DataFrame, q: DataFrame, x: Column, incremental: bool, case: tuple[str, ...] = ("task", "observation")) -> DataFrame:
    """(keys, case..., x, y) for ``information_cube``: factors ``x`` of the source row and both anchors' labels."""
    of = lambda a, v: F.transform(a, lambda e: e[v])
    y = [of(a, v) for a in ("decision", "arrival") for v in ("y", *(("y_incremental",) if incremental else ()))]
    return labels.label_arrays(o, q, HORIZONS).select(*KEYS, *case, x.alias("x"), F.concat(*y).alias("y"))


def _daily(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    q, names = with_factors(spark, d, FACTORS)
    o = labels.origins(tasks(spark, d, plan), q, names).where("source_status = 'ok'")
    wide = _wide(o, q, F.array(*(f"s_{n}" for n in names)), False)
    x = statistics.information_cube(wide, names, HORIZONS, len(plan.observations), UNIT, kinds=("cumulative",), targets=("signed",), cohorts=("own",))
    return x.drop("label", "target", "cohort")


def ic_daily(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Pearson and rank correlation of factors and labels over 1 to 30 s per contract, date and observation."""
    return _daily(spark, d, plan).withColumns({c: F.expr(rounded_sql(c)) for c in ("ic", "rank_ic")})


def ic_summary(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Summary over dates."""
    x = statistics.information_summary(_daily(spark, d, plan), ["Contract", "factor", "observation", "anchor", "horizon"])
    return x.select(*(F.expr(rounded_sql(f"`{c}`")).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes))


def catalogue(q: DataFrame, histories: tuple[int, ...] = (5, 10)) -> tuple[DataFrame, list[str]]:
    """(keys, id, x) of every factor by a hash of its row, and their names; what tells only of a window's quality (R06) is no factor.

    Each family is written by itself as an array of its factors, so that no plan holds them all; a row's arrays come together in one exchange.
    """
    q = q.withColumn("snap_id", F.xxhash64(*KEYS, "rn"))  # snapshot ids may be null
    key = [*KEYS, "snap_id", "t"]
    more = [factors.window_factors(q, [k for k in WINDOWED if k[0] == g], histories, status=False) for g in sorted({k[0] for k in WINDOWED})]
    more += [factors.row_factors(q), factors.age_factors(q), factors.segment_factors(q), factors.opening_factors(q)]
    more += [f(q, h) for h in histories for f in (factors.mean_state_factors, sequences.history_percentiles)]
    more += [sequences.queue_recovery(q), sequences.lagged_flow(q), derived.variants(q), derived.more_variants(q, sequences.history_percentiles(q)), derived.mean_gap(q)]
    parts, names = [], []
    for y in more:
        own = [c for c in y.columns if c not in key and not c.endswith("__status") and c not in names]
        parts.append(y.select(*KEYS, F.col("snap_id").alias("id"), F.lit(len(names)).alias("at"), F.array(*(F.expr(rounded_sql(f"`{c}`")).cast("double") for c in own)).alias("x")))
        names += own
    x = stored_together(parts, "family").groupBy(*KEYS, "id").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("x"))
    return x.where(F.size("x") == len(parts)).select(*KEYS, "id", F.flatten(F.col("x.x")).alias("x")), names


def _cube(spark: SparkSession, d: str) -> DataFrame:
    lens = stored(rows(spark, d), "whole")
    q = lens.select(*KEYS, *ORDER, "rn", "p", "seg_price", "valid_price")
    f, names = catalogue(lens)
    # cases of one decision time have the same source and labels: they go together
    times = tasks(spark, d).groupBy(*KEYS, "t").agg(F.collect_list(F.struct("task", "observation")).alias("cases"))
    times = times.withColumns({"task": F.col("t"), "observation": F.lit(0).cast("bigint")})
    o = labels.origins(times, q).where("source_status = 'ok'").withColumn("id", F.xxhash64(*KEYS, "s_rn"))
    wide = _wide(o.join(f, [*KEYS, "id"]), q, F.col("x"), True, ("cases",))
    # a day's sessions have tasks of the same clock
    return statistics.cube_summary(wide, names, HORIZONS, len(PLAN.observations), UNIT, task=("session", "task"))


def ic_cube(spark: SparkSession, d: str) -> DataFrame:
    """Correlation per contract and date of every catalogued factor (histories 5 and 10 s) with every label over 1 to 30 s, summed up over contracts and dates by observation, anchor, label type, target and cohort. No SQL."""
    x = _cube(spark, d)
    return x.select(*(F.expr(rounded_sql(f"`{c}`")).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes))


_BY = "Contract, trade_date, factor, observation, anchor, horizon"
PAIRS = f"""fac AS ({windowed_sql(FACTORS, 5)}),
    lng AS (SELECT snap_id, 'F05_Momentum_h5s' AS factor, F05_Momentum_h5s AS x FROM fac UNION ALL SELECT snap_id, 'C01_PriceRV_h5s', C01_PriceRV_h5s FROM fac),
    prs AS (SELECT o.Contract, o.trade_date, factor, observation, anchor, horizon, x, y FROM o JOIN lng ON lng.snap_id = o.s_snap_id JOIN laby USING ({K}, task, observation) WHERE source_status = 'ok'),
    bth AS (SELECT *, rank() OVER (PARTITION BY {_BY} ORDER BY x) + (count(*) OVER (PARTITION BY {_BY}, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY {_BY} ORDER BY y) + (count(*) OVER (PARTITION BY {_BY}, y) - 1) / 2.0 AS ry FROM prs WHERE x IS NOT NULL AND y IS NOT NULL),
    grp AS (SELECT DISTINCT {_BY} FROM prs),
    agg AS (SELECT {_BY}, count(*) AS n, min(x) = max(x) AS cx, min(y) = max(y) AS cy, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS c, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS r FROM bth GROUP BY ALL),
    ic AS (SELECT {_BY}, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 20 THEN 'NOT_ENOUGH_PAIRS' WHEN cx THEN 'CONSTANT_FACTOR' WHEN cy THEN 'CONSTANT_LABEL' ELSE 'ok' END AS status,
        CASE WHEN n >= 20 AND NOT cx AND NOT cy THEN greatest(least(c, 1.0), -1.0) END AS ic, CASE WHEN n >= 20 AND NOT cx AND NOT cy THEN greatest(least(r, 1.0), -1.0) END AS rank_ic FROM grp LEFT JOIN agg USING ({_BY}))"""
_ALL = f"WITH {quotes_sql()}, {TASKS}, {LASTS}, {ORIGINS}, {LABELS}, {PAIRS}"

QUERIES = {f.__name__: f for f in (schedule_grid, asof_backward, asof_forward, nth_future, interval_counts, task_origins, label_grid, ic_daily, ic_summary)}
QUERIES |= {f.__name__: f for f in (ic_cube,)}
SQL = {
    "schedule_grid": f"WITH {TASKS} SELECT * FROM tasks",
    "asof_backward": f"WITH {quotes_sql()}, {TASKS}, {LASTS}, {ORIGINS} SELECT {K}, task, observation, s_snap_id AS snap_id, t - s_t AS age FROM src",
    "asof_forward": f"WITH {quotes_sql()}, {TASKS}, {LASTS} SELECT {', '.join('x.' + k for k in KEYS)}, task, observation, CASE WHEN y.t - x.t <= 500000 THEN snap_id END AS snap_id, CASE WHEN y.t - x.t <= 500000 THEN y.t - x.t END AS late FROM tasks x ASOF LEFT JOIN firsts y ON {ON} AND x.t <= y.t",
    "nth_future": f"WITH {quotes_sql()}, {TASKS}, n AS (SELECT {', '.join('x.' + k for k in KEYS)}, task, observation, snap_id, row_number() OVER (PARTITION BY {', '.join('x.' + k for k in KEYS)}, task, observation ORDER BY rn) AS k FROM tasks x LEFT JOIN q y ON {ON} AND y.t > x.t), second AS (SELECT * FROM n WHERE k = 2) SELECT {', '.join('x.' + k for k in KEYS)}, x.task, x.observation, y.snap_id FROM tasks x LEFT JOIN second y ON {ON} AND x.task = y.task AND x.observation = y.observation",
    "interval_counts": f"WITH {quotes_sql()}, {TASKS} SELECT {', '.join('x.' + k for k in KEYS)}, task, observation, count(*) AS rows, max(v) - min(v) AS volume FROM tasks x JOIN q y ON {ON} AND y.t BETWEEN x.t AND x.t + 3000000 GROUP BY ALL",
    "task_origins": f"WITH {quotes_sql()}, {TASKS}, {LASTS}, {ORIGINS} SELECT {K}, task, observation, s_snap_id AS source, source_status, CASE WHEN arrival_status = 'ok' THEN a_snap_id END AS arrival, arrival_status FROM o",
    "label_grid": f"""WITH {quotes_sql()}, {TASKS}, {LASTS}, {ORIGINS}, {LABELS}, inc AS (SELECT *, CASE WHEN status <> 'ok' THEN status WHEN horizon = 1 OR lag(status) OVER w = 'ok' THEN 'ok' ELSE 'INVALID_PREVIOUS_ENDPOINT' END AS incremental_status, lag(y) OVER w AS ly
        FROM laby WINDOW w AS (PARTITION BY {K}, task, observation, anchor ORDER BY horizon)) SELECT {K}, observation, anchor, horizon, status, incremental_status, count(*) AS labels, sum(y) AS y_sum, min(y) AS y_least, max(y) AS y_most, sum(yi) AS y_incremental_sum, min(yi) AS y_incremental_least, max(yi) AS y_incremental_most, sum(abs(y)) AS y_size, {rounded_sql('avg(late)')} AS late FROM (SELECT *, CASE WHEN incremental_status = 'ok' THEN y - coalesce(ly, 0) END AS yi FROM inc) GROUP BY ALL""",
    "ic_daily": f"{_ALL} SELECT {_BY}, n, status, {rounded_sql('ic')} AS ic, {rounded_sql('rank_ic')} AS rank_ic FROM ic",
    "ic_summary": f"""{_ALL} SELECT Contract, factor, observation, anchor, horizon, {", ".join(f"{rounded_sql(f'avg({c})')} AS {c}_mean, {rounded_sql(f'quantile_cont({c}, 0.5)')} AS {c}_median, {rounded_sql(f'stddev_samp({c})')} AS {c}_std, {rounded_sql(f'quantile_cont({c}, 0.1)')} AS {c}_p10, {rounded_sql(f'avg({c}) / nullif(stddev_samp({c}), 0)')} AS {c}_ir, count(*) FILTER (WHERE {c} > 1e-12) AS {c}_positive_days, count(*) FILTER (WHERE {c} < -1e-12) AS {c}_negative_days" for c in ("ic", "rank_ic"))},
        count(ic) AS days, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS days_{s.lower()}" for s in ("NOT_ENOUGH_PAIRS", "CONSTANT_FACTOR", "CONSTANT_LABEL"))} FROM ic GROUP BY 1, 2, 3, 4, 5""",
}
