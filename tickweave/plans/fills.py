"""Queries over fills and the relational tables: joins with contracts, date-equal means, selection, survival, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.operators import statistics as st
from tickweave.operators import summary
from tickweave.plans.oracle import rounded_sql
from tickweave.runtime import real
from tickweave.sources.tables import table

KEY = ["Contract", "trade_date", "nominal_second", "direction", "strategy"]
TASK = ["Contract", "trade_date", "nominal_second"]
MAIN = ("M", "legacy_3s", "fixed_1s", "fixed_3s")
SPANS = {"first_minute": (0, 60), "first_half": (0, 1800), "first_hour": (0, 3600), "later": (60, 3600)}

_O = """o AS (SELECT *, CASE WHEN NOT isnan(cost_bp) THEN cost_bp END AS cost, CASE WHEN NOT isnan(elapsed_seconds) THEN elapsed_seconds END AS elapsed FROM fills
    QUALIFY row_number() OVER (PARTITION BY Contract, trade_date, nominal_second, direction, strategy ORDER BY fill_id) = 1)"""
_D = "d AS (SELECT trade_date, strategy, avg(cost) AS cost FROM o GROUP BY 1, 2)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Fills once per natural key (the first id), NaN as null, with ``cost`` and ``elapsed``."""
    f = table(spark, d, "fills").withColumns({"cost": real("cost_bp"), "elapsed": real("elapsed_seconds")})
    return st.best(f, KEY, [F.col("fill_id")])


def out(df: DataFrame) -> DataFrame:
    """Doubles rounded as the SQL rounds them."""
    return df.select(*(F.expr(rounded_sql(f"`{c}`")).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


R = rounded_sql


@query(f"WITH {_O} SELECT fill_id, Contract, trade_date, nominal_second, direction, strategy, cost, elapsed FROM o")
def distinct_orders(spark, d):
    """Repeated rows removed by natural key."""
    return orders(spark, d).select("fill_id", *KEY, "cost", "elapsed")


@query("SELECT Contract, trade_date, nominal_second, direction, strategy, count(*) AS copies FROM fills GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    """Natural keys that occur more than once."""
    return table(spark, d, "fills").groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1")


@query(f"WITH {_O}, d AS (SELECT trade_date, strategy, avg(cost) AS cost, avg(elapsed) AS elapsed FROM o GROUP BY 1, 2) SELECT strategy, {R('avg(cost)')} AS cost, {R('avg(elapsed)')} AS elapsed, count(cost) AS cost_days, count(elapsed) AS elapsed_days FROM d GROUP BY 1")
def two_level_mean(spark, d):
    """Date-equal mean cost and time per strategy."""
    return out(st.two_level_mean(orders(spark, d), "trade_date", ["strategy"], ["cost", "elapsed"]))


@query(f"WITH {_O}, d AS (SELECT trade_date, strategy, direction, avg(cost) AS cost FROM o GROUP BY ALL), c AS (SELECT trade_date, strategy, avg(cost) AS cost FROM d WHERE cost IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT direction) = 2) SELECT strategy, {R('avg(cost)')} AS cost, count(*) AS days FROM c GROUP BY 1")
def side_complete_mean(spark, d):
    """Date-equal mean over dates with both sides, half of each."""
    daily = orders(spark, d).groupBy("trade_date", "strategy", "direction").agg(F.avg("cost").alias("cost")).where("cost is not null")
    whole = daily.groupBy("trade_date", "strategy").agg(F.avg("cost").alias("cost"), F.count_distinct("direction").alias("n")).where("n = 2")
    return out(whole.groupBy("strategy").agg(F.avg("cost").alias("cost"), F.count("*").alias("days")))


@query(f"""WITH {_O}, s AS (SELECT *, unnest(list_filter([CASE WHEN nominal_second < 60 THEN 'first_minute' END, CASE WHEN nominal_second < 1800 THEN 'first_half' END, CASE WHEN nominal_second < 3600 THEN 'first_hour' END, CASE WHEN nominal_second >= 60 AND nominal_second < 3600 THEN 'later' END], lambda v: v IS NOT NULL)) AS scope FROM o WHERE nominal_second >= 0)
    SELECT scope, side, strategy, count(*) AS orders, {R('avg(cost)')} AS cost FROM (SELECT *, unnest(CASE WHEN direction = 1 THEN ['both', 'buy'] WHEN direction = -1 THEN ['both', 'sell'] ELSE ['both'] END) AS side FROM s) GROUP BY ALL""")
def scope_side_means(spark, d):
    """Overlapping time scopes and sides by one grouping."""
    x = st.sides(st.scopes(orders(spark, d), "nominal_second", SPANS))
    return out(x.groupBy("scope", "side", "strategy").agg(F.count("*").alias("orders"), F.avg("cost").alias("cost")))


@query(f"WITH {_O}, {_D}, p AS (SELECT a.trade_date, b.strategy, a.cost - b.cost AS gain FROM d a JOIN d b USING (trade_date) WHERE a.strategy = 'M' AND b.strategy IN ('legacy_3s', 'fixed_1s', 'fixed_3s') AND a.cost - b.cost IS NOT NULL) SELECT strategy, count(*) FILTER (WHERE gain > 1e-12) AS up, count(*) FILTER (WHERE gain < -1e-12) AS down, count(*) FILTER (WHERE abs(gain) <= 1e-12) AS same, {R('avg(gain)')} AS gain FROM p GROUP BY 1")
def benchmark_days(spark, d):
    """Daily gain on the market order per strategy: days up, down and equal."""
    daily = orders(spark, d).groupBy("trade_date", "strategy").agg(F.avg("cost").alias("cost"))
    m = st.require_unique(daily.where("strategy = 'M'").select("trade_date", F.col("cost").alias("m")), ["trade_date"], "benchmark")
    g = daily.where(F.col("strategy").isin(*MAIN[1:])).join(m, "trade_date").withColumn("gain", F.col("m") - F.col("cost")).where("gain is not null")
    return out(g.groupBy("strategy").agg(F.count_if(F.col("gain") > 1e-12).alias("up"), F.count_if(F.col("gain") < -1e-12).alias("down"), F.count_if(F.abs("gain") <= 1e-12).alias("same"), F.avg("gain").alias("gain")))


@query(f"WITH {_O} SELECT fold, fill_stage, fill_kind, count(*) AS orders, sum(CASE WHEN cost IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_cost FROM o GROUP BY ALL")
def stage_histogram(spark, d):
    """Counts per fold, stage and kind; null is a group."""
    return orders(spark, d).groupBy("fold", "fill_stage", "fill_kind").agg(F.count("*").alias("orders"), F.count_if(F.col("cost").isNull()).alias("no_cost"))


@query(f"WITH {_O}, k AS (SELECT Contract, trade_date, nominal_second FROM o WHERE strategy IN ('M', 'legacy_3s', 'fixed_1s', 'fixed_3s') AND cost IS NOT NULL GROUP BY ALL HAVING count(DISTINCT strategy) = 4) SELECT fill_id FROM o SEMI JOIN k USING (Contract, trade_date, nominal_second)")
def common_cohort(spark, d):
    """Orders of the tasks that all four main strategies have."""
    o = orders(spark, d)
    keys = st.kept_together(o.where(F.col("strategy").isin(*MAIN) & F.col("cost").isNotNull()), TASK, "strategy", 4)
    return o.join(keys, TASK, "left_semi").select("fill_id")


@query("SELECT f.fill_id, CASE WHEN s.Contract IS NULL THEN 'no session' ELSE 'session' END AS found FROM fills f LEFT JOIN (SELECT DISTINCT Contract, trade_date FROM sessions) s USING (Contract, trade_date)")
def session_indicator(spark, d):
    """Left join with an indicator of a match."""
    s = table(spark, d, "sessions").select("Contract", "trade_date").distinct().withColumn("has", F.lit(True))
    x = table(spark, d, "fills").join(s, ["Contract", "trade_date"], "left")
    return x.select("fill_id", F.when(F.col("has"), "session").otherwise("no session").alias("found"))


@query("SELECT Contract, trade_date, session FROM sessions ANTI JOIN snapshots USING (Contract, trade_date, session)")
def sessions_without_rows(spark, d):
    """Sessions of which no snapshot arrived: an anti join."""
    k = ["Contract", "trade_date", "session"]
    return table(spark, d, "sessions").select(*k).join(table(spark, d, "snapshots").select(*k), k, "left_anti")


@query("SELECT Contract, trade_date, session, nominal_second FROM decisions WHERE observation_seconds IN (1, 2, 3) AND start_status = 'ok' GROUP BY ALL HAVING count(DISTINCT observation_seconds) = 3")
def iterated_intersection(spark, d):
    """Tasks that have a decision in every one of three windows."""
    x = table(spark, d, "decisions").where("observation_seconds in (1, 2, 3) and start_status = 'ok'")
    return st.kept_together(x, ["Contract", "trade_date", "session", "nominal_second"], "observation_seconds", 3)


@query(f"WITH {_O}, w AS (SELECT o.strategy, o.direction, o.cost - m.cost AS diff FROM o JOIN o m ON o.Contract = m.Contract AND o.trade_date = m.trade_date AND o.nominal_second = m.nominal_second AND o.direction = m.direction AND m.strategy = 'M' AND o.strategy <> 'M') SELECT strategy, direction, count(*) FILTER (WHERE diff < -1e-12) AS wins, count(*) FILTER (WHERE abs(diff) <= 1e-12) AS ties, count(*) FILTER (WHERE diff > 1e-12) AS losses FROM w GROUP BY ALL")
def win_tie_loss(spark, d):
    """Orders cheaper, equal and dearer than the market order of the same task and side."""
    o = orders(spark, d)
    k = [*TASK, "direction"]
    m = o.where("strategy = 'M'").select(*k, F.col("cost").alias("m"))
    x = o.where("strategy <> 'M'").join(m, k).withColumn("diff", F.col("cost") - F.col("m"))
    return x.groupBy("strategy", "direction").agg(F.count_if(F.col("diff") < -1e-12).alias("wins"), F.count_if(F.abs("diff") <= 1e-12).alias("ties"), F.count_if(F.col("diff") > 1e-12).alias("losses"))


@query(f"WITH {_O}, {_D}, m AS (SELECT strategy, avg(cost) AS cost FROM d GROUP BY 1) SELECT strategy, {R('cost')} AS cost FROM m WHERE cost IS NOT NULL AND strategy LIKE 'sweep%' ORDER BY m.cost, strategy LIMIT 1")
def best_sweep(spark, d):
    """The sweep offset of least date-equal cost, ties by name."""
    m = st.two_level_mean(orders(spark, d).where("strategy like 'sweep%'"), "trade_date", ["strategy"], ["cost"]).where("cost is not null")
    return out(m.orderBy("cost", "strategy").limit(1).select("strategy", "cost"))


@query(f"WITH {_O}, {_D}, m AS (SELECT strategy, avg(cost) AS cost FROM d GROUP BY 1 HAVING avg(cost) IS NOT NULL) SELECT strategy, {R('m.cost')} AS cost, row_number() OVER (ORDER BY round(m.cost, 2), length(strategy), strategy) AS place FROM m WHERE m.cost <= (SELECT min(cost) FROM m) + 0.5")
def tolerance_selection(spark, d):
    """Strategies within a tolerance of the best, ordered by cost in cents, length and name."""
    m = st.two_level_mean(orders(spark, d), "trade_date", ["strategy"], ["cost"]).where("cost is not null and strategy is not null").select("strategy", "cost")
    near = m.join(F.broadcast(m.agg(F.min("cost").alias("least"))), F.col("cost") <= F.col("least") + 0.5)
    return out(near.withColumn("place", F.row_number().over(Window.orderBy(F.round("cost", 2), F.length("strategy"), "strategy")).cast("bigint")).select("strategy", "cost", "place"))


@query(f"WITH {_O}, {_D} SELECT strategy, trade_date AS left_out, {R('(sum(cost) OVER w - cost) / nullif(count(cost) OVER w - 1, 0)')} AS without FROM d WHERE cost IS NOT NULL WINDOW w AS (PARTITION BY strategy)")
def leave_one_out(spark, d):
    """Mean cost per strategy with each date left out."""
    daily = orders(spark, d).groupBy("trade_date", "strategy").agg(F.avg("cost").alias("cost")).where("cost is not null")
    return out(st.leave_one_out(daily, ["strategy"], "trade_date", "cost"))


@query(f"WITH {_O} SELECT strategy, {', '.join(R(f'quantile_cont(cost, {p})') + f' AS p{round(p * 100)}' for p in (0.1, 0.5, 0.9))} FROM o GROUP BY 1")
def exact_quantiles(spark, d):
    """Linear quantiles of cost per strategy."""
    x = orders(spark, d).groupBy("strategy").agg(F.expr("percentile(cost, array(0.1D, 0.5D, 0.9D))").alias("p"))
    return out(x.select("strategy", *(F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90")))))


_W = "w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY trade_date, strategy) AS weight FROM o WHERE cost IS NOT NULL)"


def weighted(spark, d):
    """Orders with a weight that makes dates equal."""
    o = orders(spark, d).where("cost is not null")
    return o.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("trade_date", "strategy")))


@query(f"WITH {_O}, {_W}, x AS (SELECT strategy, cost, sum(weight) AS w FROM w GROUP BY 1, 2), c AS (SELECT strategy, cost, sum(w) OVER (PARTITION BY strategy ORDER BY cost) / sum(w) OVER (PARTITION BY strategy) AS c FROM x) SELECT strategy, {', '.join(R(f'min(cost) FILTER (WHERE c >= {p} - 1e-12)') + f' AS p{round(p * 100)}' for p in (0.25, 0.5, 0.75))} FROM c GROUP BY 1")
def weighted_quantile(spark, d):
    """Date-weighted step quantiles."""
    return out(st.weighted_quantiles(weighted(spark, d), ["strategy"], "cost", "weight", (0.25, 0.5, 0.75)))


@query(f"WITH {_O}, {_W}, m AS (SELECT strategy, sum(weight * cost) / sum(weight) AS mean, sum(weight) AS tw FROM w GROUP BY 1), z AS (SELECT w.strategy, any_value(mean) AS mean, sqrt(sum(weight * (cost - mean) ** 2) / any_value(tw)) AS sd, sum(weight * (cost - mean) ** 3) / any_value(tw) AS m3, sum(weight * (cost - mean) ** 4) / any_value(tw) AS m4 FROM w JOIN m ON w.strategy IS NOT DISTINCT FROM m.strategy GROUP BY 1) SELECT strategy, {R('mean')} AS mean, {R('sd')} AS sd, {R('m3 / nullif(sd ** 3, 0)')} AS skew, {R('m4 / nullif(sd ** 4, 0) - 3')} AS kurtosis FROM z")
def weighted_moments(spark, d):
    """Date-weighted mean, spread, skewness and kurtosis."""
    return out(st.weighted_moments(weighted(spark, d), ["strategy"], "cost", "weight"))


@query(f"WITH {_O}, {_W}, b AS (SELECT strategy, CAST(least(floor((cost + 10.0) / 1.0), 19) AS INTEGER) AS bin, weight FROM w WHERE cost BETWEEN -10 AND 10) SELECT strategy, bin, {R('sum(weight)')} AS weight FROM b GROUP BY 1, 2")
def weighted_histogram(spark, d):
    """Date-weighted histogram of cost on fixed edges."""
    return out(st.histogram(weighted(spark, d), ["strategy"], "cost", "weight", -10.0, 1.0, 20))


@query(f"""WITH {_O}, x AS (SELECT strategy, elapsed AS time, sum(1e0) AS n, sum(CASE WHEN fill_kind = 'limit' THEN 1e0 ELSE 0e0 END) AS died FROM o WHERE elapsed IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY strategy ORDER BY time DESC) AS at_risk FROM x),
    e AS (SELECT * FROM r WHERE died > 0) SELECT strategy, time, at_risk, died, {R('CASE WHEN bool_or(died >= at_risk - 1e-12) OVER w THEN 0.0 ELSE exp(sum(CASE WHEN died < at_risk - 1e-12 THEN ln(1 - died / at_risk) ELSE 0 END) OVER w) END')} AS survival FROM e WINDOW w AS (PARTITION BY strategy ORDER BY time)""")
def survival_curve(spark, d):
    """Kaplan-Meier curve of the time to a limit fill; market fills are censored."""
    o = orders(spark, d).withColumn("event", F.when(F.col("fill_kind") == "limit", 1).otherwise(0)).withColumn("one", F.lit(1.0))
    x = st.survival(o, ["strategy"], "elapsed", "event", "one")
    return x.withColumn("survival", F.expr(rounded_sql("survival")))


@query(f"WITH {_O}, x AS (SELECT strategy, floor(cost) AS cost, count(*) AS n FROM o WHERE cost IS NOT NULL GROUP BY 1, 2) SELECT strategy, CAST(cost AS BIGINT) AS cost, {R('sum(n) OVER (PARTITION BY strategy ORDER BY cost) / sum(n) OVER (PARTITION BY strategy)')} AS share FROM x")
def cost_ecdf(spark, d):
    """Cumulative share of orders by whole points of cost."""
    o = orders(spark, d).select("strategy", F.floor("cost").cast("bigint").alias("cost"))
    return out(st.ecdf(o, ["strategy"], "cost"))


@query(f"WITH {_O}, t AS (SELECT a.fill_stage AS old_stage, b.fill_stage AS new_stage, b.cost - a.cost AS change FROM o a JOIN o b USING (Contract, trade_date, nominal_second, direction) WHERE a.strategy = 'legacy_3s' AND b.strategy = 'fixed_1s') SELECT old_stage, new_stage, count(*) AS orders, {R('sum(change) / (SELECT count(*) FROM t)')} AS contribution FROM t GROUP BY 1, 2")
def transition_matrix(spark, d):
    """Stage under one strategy by stage under another, with what each cell adds to the mean difference."""
    o, k = orders(spark, d), [*TASK, "direction"]
    a = o.where("strategy = 'legacy_3s'").select(*k, F.col("fill_stage").alias("old_stage"), F.col("cost").alias("a"))
    x = a.join(o.where("strategy = 'fixed_1s'").select(*k, F.col("fill_stage").alias("new_stage"), F.col("cost").alias("b")), k).withColumn("change", F.col("b") - F.col("a"))
    g = x.groupBy("old_stage", "new_stage").agg(F.count("*").alias("orders"), F.sum("change").alias("s"))
    total = g.agg(F.sum("orders").alias("n"))
    return out(g.join(F.broadcast(total)).select("old_stage", "new_stage", "orders", (F.col("s") / F.col("n")).alias("contribution")))


@query(f"WITH {_O} SELECT strategy, {', '.join(R(chr(97) + 'vg(CASE WHEN fill_stage = ' + chr(39) + s + chr(39) + ' THEN coalesce(cost, 0.0) ELSE 0.0 END)') + f' AS {s}' for s in ('initial', 'signal', 'deadline', 'immediate', 'unknown'))}, {R('avg(coalesce(cost, 0.0))')} AS total FROM o GROUP BY 1")
def stage_contributions(spark, d):
    """Mean cost split by stage with the full denominator: the parts add up to the total."""
    c = F.coalesce("cost", F.lit(0.0))
    stages = ("initial", "signal", "deadline", "immediate", "unknown")
    return out(orders(spark, d).groupBy("strategy").agg(*(F.avg(F.when(F.col("fill_stage") == s, c).otherwise(0.0)).alias(s) for s in stages), F.avg(c).alias("total")))


@query(f"""WITH {_O}, s AS (SELECT strategy, fill_stage, count(*) AS n, avg(cost) AS c FROM o WHERE strategy IN ('legacy_3s', 'fixed_1s') AND cost IS NOT NULL GROUP BY 1, 2), z AS (SELECT strategy, fill_stage, n / sum(n) OVER (PARTITION BY strategy) AS share, c FROM s),
    p AS (SELECT fill_stage, coalesce(a.share, 0) AS sa, coalesce(b.share, 0) AS sb, coalesce(a.c, b.c) AS ca, coalesce(b.c, a.c) AS cb FROM (SELECT * FROM z WHERE strategy = 'legacy_3s') a FULL JOIN (SELECT * FROM z WHERE strategy = 'fixed_1s') b USING (fill_stage))
    SELECT fill_stage, {R('(sb - sa) * (ca + cb) / 2')} AS mix, {R('(cb - ca) * (sa + sb) / 2')} AS severity FROM p""")
def mix_severity(spark, d):
    """Exact symmetric split of a mean difference into mix and severity by stage."""
    o = orders(spark, d).where(F.col("strategy").isin("legacy_3s", "fixed_1s") & F.col("cost").isNotNull())
    s = o.groupBy("strategy", "fill_stage").agg(F.count("*").alias("n"), F.avg("cost").alias("c"))
    s = s.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("strategy")))
    side = lambda n, x: s.where(F.col("strategy") == n).select("fill_stage", F.col("share").alias(f"s{x}"), F.col("c").alias(f"c{x}"))
    p = side("legacy_3s", "a").join(side("fixed_1s", "b"), "fill_stage", "full").select("fill_stage", F.coalesce("sa", F.lit(0.0)).alias("sa"), F.coalesce("sb", F.lit(0.0)).alias("sb"), F.coalesce("ca", "cb").alias("ca"), F.coalesce("cb", "ca").alias("cb"))
    return out(p.select("fill_stage", F.expr("(sb - sa) * (ca + cb) / 2").alias("mix"), F.expr("(cb - ca) * (sa + sb) / 2").alias("severity")))


@query(f"WITH {_O}, {_D} SELECT trade_date, {', '.join(R(f'avg(cost) FILTER (WHERE strategy = {chr(39)}{s}{chr(39)})') + f' AS {s}' for s in MAIN)} FROM d GROUP BY 1")
def pivot_strategies(spark, d):
    """A column per strategy, a row per date."""
    return out(orders(spark, d).groupBy("trade_date", "strategy").agg(F.avg("cost").alias("cost")).groupBy("trade_date").pivot("strategy", list(MAIN)).agg(F.avg("cost")))


@query(f"WITH {_O} SELECT fill_id, 'cost' AS metric, {R('cost')} AS value FROM o UNION ALL SELECT fill_id, 'elapsed', {R('elapsed')} FROM o")
def unpivot_metrics(spark, d):
    """Long form of two measures."""
    return out(orders(spark, d).select("fill_id", "cost", "elapsed").unpivot("fill_id", ["cost", "elapsed"], "metric", "value"))


@query(f"WITH {_O} SELECT Contract, trade_date, nominal_second, direction, strategy, {R('cost')} AS cost FROM o WHERE (strategy = 'M' AND nominal_second < 60) OR (strategy = 'fixed_1s' AND nominal_second >= 60)")
def composite_strategy(spark, d):
    """One strategy in the first minute, another afterwards: a union of pieces."""
    o = orders(spark, d).select(*KEY, "cost")
    return out(o.where("strategy = 'M' and nominal_second < 60").unionByName(o.where("strategy = 'fixed_1s' and nominal_second >= 60")))


@query("(SELECT Contract, trade_date FROM fills INTERSECT SELECT Contract, trade_date FROM sessions)")
def key_intersection(spark, d):
    """Contract-days with both fills and sessions."""
    return table(spark, d, "fills").select("Contract", "trade_date").intersect(table(spark, d, "sessions").select("Contract", "trade_date"))


@query("(SELECT Contract, trade_date FROM sessions EXCEPT SELECT Contract, trade_date FROM fills)")
def key_difference(spark, d):
    """Contract-days with sessions but no fills."""
    return table(spark, d, "sessions").select("Contract", "trade_date").subtract(table(spark, d, "fills").select("Contract", "trade_date"))


@query("SELECT fill_id FROM fills WHERE fill_id % 97 = 0")
def deterministic_sample(spark, d):
    """Every 97th fill: a sampling operator."""
    return table(spark, d, "fills").where("fill_id % 97 = 0").select("fill_id")


@query(f"WITH {_O} SELECT CASE WHEN cost < -1 THEN 'under -1' WHEN cost < 0 THEN '-1 to 0' WHEN cost < 1 THEN '0 to 1' WHEN cost >= 1 THEN '1 and over' END AS band, CAST(least(floor(elapsed), 11) AS BIGINT) AS second, count(*) AS orders FROM o GROUP BY 1, 2")
def score_bins(spark, d):
    """Left-closed bands of cost by whole seconds, clipped."""
    c = F.col("cost")
    band = F.when(c < -1, "under -1").when(c < 0, "-1 to 0").when(c < 1, "0 to 1").when(c >= 1, "1 and over")
    return orders(spark, d).groupBy(band.alias("band"), F.least(F.floor("elapsed"), F.lit(11)).cast("bigint").alias("second")).agg(F.count("*").alias("orders"))


@query(f"WITH {_O} SELECT trade_date, strategy, fill_id, {R('cost')} AS cost FROM o WHERE cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date, strategy ORDER BY cost DESC, fill_id) <= 3")
def top_costs(spark, d):
    """The three dearest orders of each date and strategy: a top-k report."""
    w = Window.partitionBy("trade_date", "strategy").orderBy(F.col("cost").desc(), "fill_id")
    return out(orders(spark, d).where("cost is not null").withColumn("k", F.row_number().over(w)).where("k <= 3").select("trade_date", "strategy", "fill_id", "cost"))


@query(f"WITH {_O} SELECT fill_id, {R('avg(cost) OVER (PARTITION BY Contract, trade_date, direction, strategy ORDER BY nominal_second, fill_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS rolling, count(*) OVER (PARTITION BY Contract, trade_date) AS day_orders, {R('cost - avg(cost) OVER (PARTITION BY trade_date)')} AS centred FROM o")
def rolling_mean(spark, d):
    """Mean of the last ten orders, size of the day and centred cost."""
    w = Window.partitionBy("Contract", "trade_date", "direction", "strategy").orderBy("nominal_second", "fill_id").rowsBetween(-9, 0)
    x = orders(spark, d).select("fill_id", F.avg("cost").over(w).alias("rolling"), F.count("*").over(Window.partitionBy("Contract", "trade_date")).alias("day_orders"), (F.col("cost") - F.avg("cost").over(Window.partitionBy("trade_date"))).alias("centred"))
    return out(x)


@query(f"WITH {_O}, g AS (SELECT strategy, nominal_second // 30 AS bin, avg(cost) AS y, count(*)::DOUBLE AS w FROM o WHERE cost IS NOT NULL GROUP BY 1, 2), s AS (SELECT strategy, count(*) AS n, sum(w) AS w, sum(w * bin) AS x, sum(w * y) AS y, sum(w * bin * bin) AS xx, sum(w * bin * y) AS xy, sum(w * y * y) AS yy FROM g GROUP BY 1), t AS (SELECT *, CASE WHEN n >= 3 THEN (xy - x * y / w) / nullif(xx - x * x / w, 0) END AS b FROM s) SELECT strategy, n, {R('(y - b * x) / w')} AS a, {R('b')} AS b, {R('CASE WHEN n >= 3 THEN (xy - x * y / w) ** 2 / nullif((xx - x * x / w) * (yy - y * y / w), 0) END')} AS r2 FROM t")
def weighted_line(spark, d):
    """Weighted line of mean cost on time of day."""
    g = orders(spark, d).where("cost is not null").groupBy("strategy", F.expr("nominal_second div 30").alias("bin")).agg(F.avg("cost").alias("y"), F.count("*").cast("double").alias("w"))
    return out(st.weighted_line(g, ["strategy"], "bin", "y", "w"))


@query(f"WITH {_O}, {_D}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY trade_date) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM d WHERE cost IS NOT NULL AND strategy IN ('M', 'legacy_3s', 'fixed_1s', 'fixed_3s')), b AS (SELECT strategy, ((i - j) % n + n) % n AS start, cost FROM k, range(5) r(j)) SELECT strategy, CAST(start AS BIGINT) AS start, {R('avg(cost)')} AS mean FROM b GROUP BY 1, 2")
def circular_blocks(spark, d):
    """Mean of every circular block of five dates."""
    daily = orders(spark, d).where(F.col("strategy").isin(*MAIN)).groupBy("trade_date", "strategy").agg(F.avg("cost").alias("cost")).where("cost is not null")
    return out(st.circular_blocks(daily, ["strategy"], "trade_date", "cost").withColumn("start", F.col("start").cast("bigint")))


@query(f"""WITH {_O}, {_D}, m AS (SELECT * FROM d WHERE strategy IN ({', '.join(repr(k) for k in MAIN)})), {st.block_draws_sql("SELECT trade_date AS day FROM m")},
    me AS (SELECT strategy, repeat, sum(cost * times) / sum(times) AS v FROM m JOIN dr ON dr.day = m.trade_date WHERE cost IS NOT NULL GROUP BY 1, 2), lh AS (SELECT strategy, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM me GROUP BY 1)
    SELECT strategy, {R('(SELECT avg(cost) FROM m WHERE m.strategy = lh.strategy)')} AS mean, {R('low')} AS low, {R('high')} AS high FROM lh""")
def block_bootstrap(spark, d):
    """Mean cost per main strategy with a block bootstrap interval over dates."""
    daily = orders(spark, d).where(F.col("strategy").isin(*MAIN)).groupBy("trade_date", "strategy").agg(F.avg("cost").alias("cost"))
    return out(st.block_interval(daily, ["strategy"], "trade_date", "cost"))


@query(f"WITH {_O}, {_D}, g AS (SELECT strategy, count(cost) AS n, 1.0 / (1 + abs(avg(cost))) AS p FROM d WHERE strategy IS NOT NULL GROUP BY 1 HAVING avg(cost) IS NOT NULL), k AS (SELECT strategy, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, strategy) + 1)) AS raw, row_number() OVER (ORDER BY p, strategy) AS i FROM g) SELECT strategy, {R('p')} AS p, {R('max(raw) OVER (ORDER BY i)')} AS adjusted FROM k")
def holm_adjustment(spark, d):
    """Holm step-down over a p-like score per strategy."""
    m = st.two_level_mean(orders(spark, d), "trade_date", ["strategy"], ["cost"]).where("cost is not null and strategy is not null").select("strategy", (F.lit(1.0) / (1 + F.abs("cost"))).alias("p"))
    return out(st.holm(m, "p"))


@query("""SELECT Contract, trade_date, session, count(*) AS rows, count(*) FILTER (WHERE d < 0) AS backward, count(*) FILTER (WHERE d = 0) AS same_time, count(*) FILTER (WHERE d > 500000) AS over_half, count(*) FILTER (WHERE d > 1000000) AS over_one, max(d) AS longest, count(*) FILTER (WHERE LastPrice IS NULL OR isnan(LastPrice) OR LastPrice <= 0) AS bad_last,
    count(*) FILTER (WHERE NOT coalesce(AskPrice1 > BidPrice1 AND BidPrice1 > 0 AND NOT isnan(AskPrice1) AND NOT isnan(BidPrice1), false)) AS bad_quote, count(*) FILTER (WHERE dv < 0) AS negative_volume, count(*) FILTER (WHERE dv = 0 AND LastPrice <> lp) AS moved_without_volume
    FROM (SELECT *, epoch_us(Datetime) - epoch_us(lag(Datetime) OVER w) AS d, Volume - lag(Volume) OVER w AS dv, lag(LastPrice) OVER w AS lp FROM snapshots WINDOW w AS (PARTITION BY Contract, trade_date, session ORDER BY snap_id)) GROUP BY 1, 2, 3""")
def dq_audit(spark, d):
    """Quality of each session in order of arrival: intervals, duplicates, invalid values, volume resets."""
    k = ["Contract", "trade_date", "session"]
    w = Window.partitionBy(*k).orderBy("snap_id")
    t = F.unix_micros("Datetime")
    s = table(spark, d, "snapshots").withColumns({"d": t - F.lag(t).over(w), "dv": F.col("Volume") - F.lag("Volume").over(w), "lp": F.lag("LastPrice").over(w), "last": real("LastPrice"), "bid": real("BidPrice1"), "ask": real("AskPrice1")})
    n = lambda e: F.count_if(F.expr(e))
    return s.groupBy(*k).agg(F.count("*").alias("rows"), n("d < 0").alias("backward"), n("d = 0").alias("same_time"), n("d > 500000").alias("over_half"), n("d > 1000000").alias("over_one"), F.max("d").alias("longest"), n("last is null or last <= 0").alias("bad_last"), n("not coalesce(ask > bid and bid > 0, false)").alias("bad_quote"), n("dv < 0").alias("negative_volume"), n("dv = 0 and LastPrice <> lp").alias("moved_without_volume"))


@query("""SELECT o_orderpriority, l_returnflag, count(*) AS lines, CAST(sum(CAST(l_quantity AS DOUBLE)) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 25 AND l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def pushed_filters(spark, d):
    """Projection and filters that reach the scan, then an equi join and grouping."""
    l = table(spark, d, "lineitem").where("l_quantity < 25 and l_returnflag in ('A', 'R')").select("l_orderkey", "l_returnflag", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority", "l_returnflag").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"))


@query("SELECT model_id, regexp_extract(method, '^([a-z]+)', 1) AS stem, regexp_replace(method, '[^a-z]+', '-', 'g') AS slug, method LIKE '%ridge%' AS ridge FROM models WHERE regexp_matches(method, '^[a-z_]+$')")
def regex_names(spark, d):
    """Regular expressions over names: filter, extract, replace."""
    m = table(spark, d, "models").where(F.col("method").rlike("^[a-z_]+$"))
    return m.select("model_id", F.regexp_extract("method", "^([a-z]+)", 1).alias("stem"), F.regexp_replace("method", "[^a-z]+", "-").alias("slug"), F.col("method").contains("ridge").alias("ridge"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, strftime(ts, '%Y-%m-%d') AS day, hour(ts) * 60 + minute(ts) AS minute FROM events WHERE event_type IN ('click', 'view')")
def json_clock(spark, d):
    """A field of JSON text, and the parts of a time."""
    e = table(spark, d, "events").where("event_type in ('click', 'view')")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).cast("bigint").alias("minute"))


@query("SELECT c.Contract, h AS horizon, count(s.session_id) AS sessions FROM (SELECT Contract FROM contracts) c CROSS JOIN (VALUES (60), (90), (120)) v(h) LEFT JOIN sessions s ON s.Contract = c.Contract AND s.session_seconds = h GROUP BY 1, 2")
def dimension_grid(spark, d):
    """Every contract by every length, with counts: a small grid of dimensions, aligned to the data."""
    c = table(spark, d, "contracts").select("Contract").withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in (60, 90, 120)))))
    s = table(spark, d, "sessions").select("Contract", F.col("session_seconds").alias("horizon"), "session_id")
    return c.join(s, ["Contract", "horizon"], "left").groupBy("Contract", "horizon").agg(F.count("session_id").alias("sessions"))


@query("SELECT n_name, count(*) AS customers, count(DISTINCT c_mktsegment) AS segments, min(c_name) AS first_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY 1 HAVING count(*) > 1")
def grouped_counts(spark, d):
    """Counts, distinct counts and firsts per group with a condition on the group."""
    c = table(spark, d, "customer").where("c_acctbal between 0 and 5000").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count("*").alias("customers"), F.count_distinct("c_mktsegment").alias("segments"), F.min("c_name").alias("first_name")).where("customers > 1")


TASK = ["Contract", "trade_date", "nominal_second"]
_HOUR = {"first_minute": (0, 60), "first_hour": (0, 3600)}
_MAIN = ", ".join(repr(k) for k in MAIN)
_PAIRED = f"""WITH {_O}, oo AS (SELECT * FROM o WHERE strategy IN ({_MAIN})), tk AS (SELECT Contract, trade_date, nominal_second, count(*) AS k, count(DISTINCT (strategy, direction)) FILTER (WHERE direction IN (-1, 1)) AS n, count(*) FILTER (WHERE direction IN (-1, 1)) AS f FROM oo GROUP BY ALL),
    pa AS (SELECT Contract, trade_date, nominal_second, CASE WHEN k <> f THEN 'UNEXPECTED' WHEN f <> n THEN 'REPEATED' WHEN n <> 8 THEN 'UNPAIRED' ELSE 'ok' END AS reason FROM tk)"""
_FLAG = lambda s, k: f"CASE WHEN coalesce(fill_stage = '{s}' AND fill_kind = '{k}', false) THEN 1.0 ELSE 0.0 END"
_MEASURES = ["cost", "elapsed", "early", *summary.FILLS, "other"]


@query(f"{_PAIRED} SELECT trade_date, reason, count(*) AS tasks FROM pa GROUP BY 1, 2")
def order_pairing(spark, d):
    """How many tasks have every main strategy on both sides, and what the others lack."""
    x = summary.pairing(orders(spark, d).where(F.col("strategy").isin(*MAIN)), TASK, MAIN)
    return x.groupBy("trade_date", "reason").agg(F.count("*").alias("tasks"))


@query(f"""{_PAIRED}, z AS (SELECT oo.*, CASE WHEN elapsed IS NOT NULL THEN CASE WHEN elapsed <= 3 + 1e-10 THEN 1.0 ELSE 0.0 END END AS early, {", ".join(f"{_FLAG(*v)} AS {k}" for k, v in summary.FILLS.items())} FROM oo JOIN pa USING (Contract, trade_date, nominal_second) WHERE reason = 'ok'),
    z2 AS (SELECT *, 1.0 - {" - ".join(summary.FILLS)} AS other FROM z),
    z3 AS (SELECT z2.*, scope, side FROM z2, (VALUES ('first_minute', 60), ('first_hour', 3600)) a(scope, upto), (VALUES ('both', 0), ('buy', 1), ('sell', -1)) b(side, dir) WHERE nominal_second >= 0 AND nominal_second < upto AND (dir = 0 OR direction = dir)),
    dy AS (SELECT scope, side, trade_date, strategy, {", ".join(f"avg({m}) AS {m}" for m in _MEASURES)}, count(*) AS orders FROM z3 GROUP BY 1, 2, 3, 4),
    rf AS (SELECT dy.*, a.cost AS c1, b.cost AS c2 FROM dy LEFT JOIN dy a ON a.scope = dy.scope AND a.side = dy.side AND a.trade_date = dy.trade_date AND a.strategy = 'M' LEFT JOIN dy b ON b.scope = dy.scope AND b.side = dy.side AND b.trade_date = dy.trade_date AND b.strategy = 'legacy_3s')
    SELECT scope, side, strategy, count(*) AS days, CAST(sum(orders) AS BIGINT) AS orders, {", ".join(f"{R(f'avg({m})')} AS {m}" for m in _MEASURES)}, {R('avg(c1 - cost)')} AS "saving_on_M", count(*) FILTER (WHERE c1 - cost > 1e-12) AS "better_days_than_M", {R('avg(c2 - cost)')} AS saving_on_legacy_3s, count(*) FILTER (WHERE c2 - cost > 1e-12) AS better_days_than_legacy_3s,
        CAST(sum(orders) / CASE WHEN side = 'both' THEN 2 ELSE 1 END AS BIGINT) AS tasks FROM rf GROUP BY 1, 2, 3""")
def order_summary(spark, d):
    """Cost, fills, early fills and savings of the main strategies on paired tasks, by scope and side."""
    return out(summary.order_summary(orders(spark, d).where(F.col("strategy").isin(*MAIN)), TASK, MAIN, ("M", "legacy_3s"), _HOUR))
