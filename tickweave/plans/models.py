"""Queries of the classification models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators import factors, labels, models
from tickweave.operators.labels import Schedule
from tickweave.operators.lens import KEYS, quotes_sql
from tickweave.plans.features import rounded, rows
from tickweave.plans.fills import out
from tickweave.plans.labels import LABELS, LASTS, ORIGINS, PLAN, TASKS, factored, tasks, with_factors
from tickweave.plans.oracle import rounded_sql as R
from tickweave.plans.oracle import windowed_sql
from tickweave.runtime import stored
from tickweave.sources.tables import table

FEATURES = ["F05_Momentum_h5s", "C01_PriceRV_h5s", "M01_MADeviation_h5s"]
_KEYS = [("price", "F05", "Momentum"), ("price", "C01", "PriceRV"), ("price", "M01", "MADeviation")]
#: A frozen model for queries that score.
FROZEN = models.Model(FEATURES, 1.0, [0.0, 2.0, 0.0], [5.0, 2.0, 3.0], [[0.2, 0.1, 0.5], [0.1, -0.3, -0.1], [-0.3, 0.2, -0.4]], [0.1, -0.2, 0.1])


def examples(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """trade_date, keys, features at the source row, and y: the sign of the price change over 1 s after the decision."""
    q, names = with_factors(spark, d, _KEYS)
    o = labels.origins(tasks(spark, d, plan), q, names).where("source_status = 'ok'")
    x = labels.labels(None, q, (1,), o).where("anchor = 'decision' and status = 'ok'")
    x = x.select(*KEYS, "task", "observation", *(F.col(f"s_{n}").alias(n) for n in names), F.signum("y").cast("int").alias("y"))
    return x.dropna(subset=FEATURES)


_EX = f"""WITH {quotes_sql()}, {TASKS}, {LASTS}, {ORIGINS}, {LABELS}, fac AS ({windowed_sql(_KEYS, 5)}),
    ex AS (SELECT o.Contract, o.trade_date, o.session, o.task, o.observation, fac.*, CAST(sign(y) AS INTEGER) AS y FROM o JOIN fac ON fac.snap_id = o.s_snap_id JOIN laby USING (Contract, trade_date, session, task, observation)
        WHERE source_status = 'ok' AND anchor = 'decision' AND horizon = 1 AND laby.status = 'ok' AND {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)})"""
_Z = [" + ".join([str(i), *(f"({f} - {m}) / {s} * {b}" for f, m, s, b in zip(FEATURES, FROZEN.mean, FROZEN.scale, c))]) for c, i in zip(FROZEN.coef, FROZEN.intercept)]
_S = f"""{_EX}, zz AS (SELECT *, {_Z[0]} AS z0, {_Z[1]} AS z1, {_Z[2]} AS z2 FROM ex), mm AS (SELECT *, greatest(z0, z1, z2) AS m FROM zz), ee AS (SELECT *, exp(z0 - m) AS e0, exp(z1 - m) AS e1, exp(z2 - m) AS e2 FROM mm),
    sc AS (SELECT *, e0 / (e0 + e1 + e2) AS p_down, e1 / (e0 + e1 + e2) AS p_flat, e2 / (e0 + e1 + e2) AS p_up FROM ee),
    pr AS (SELECT *, CASE WHEN p_down >= p_flat AND p_down >= p_up THEN -1 WHEN p_flat >= p_up THEN 0 ELSE 1 END AS c, -ln(greatest(CASE y WHEN -1 THEN p_down WHEN 0 THEN p_flat ELSE p_up END, 1e-15)) AS l FROM sc)"""


def softmax_score(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Probabilities of a frozen model."""
    x = examples(spark, d, plan).withColumns(models.scores(FROZEN)).withColumn("predicted", models.predicted())
    return out(x.select(*KEYS, "task", "observation", "y", "p_down", "p_flat", "p_up", "predicted"))


def confusion_metrics(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Accuracy, losses, recall and precision per date."""
    return out(models.metrics(examples(spark, d, plan).withColumns(models.scores(FROZEN)), ["trade_date"]))


def coverage_curve(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Signals and accuracy by confidence threshold."""
    return out(models.threshold_coverage(examples(spark, d, plan).withColumns(models.scores(FROZEN)), "trade_date", (0.3, 0.4, 0.5)))


def class_prior(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Date-weighted class shares."""
    return out(models.class_prior(examples(spark, d, plan), "trade_date"))


def feature_pool(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of features over all source rows, and whether they may be used."""
    q = rows(spark, d)
    return out(models.pool(rounded(factors.window_factors(q, _KEYS, (5,), status=False)), FEATURES))


def model_fit(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Coefficients fitted on the first two thirds of the dates."""
    x = stored(examples(spark, d, plan), "examples")
    days = sorted(r[0] for r in x.select("trade_date").distinct().collect())
    m = models.fit(x.where(F.col("trade_date").isin(days[: len(days) * 2 // 3])), FEATURES, "y", "trade_date")
    rows_ = [(k, f, float(b)) for k, c, i in zip((-1, 0, 1), m.coef, m.intercept) for f, b in [*zip(m.features, c), ("intercept", i)]]
    return out(spark.createDataFrame(rows_, "class int, feature string, coefficient double"))


def trading_days(spark: SparkSession, d: str) -> list[str]:
    """The dates of the sessions, few by nature."""
    return sorted(r[0] for r in table(spark, d, "sessions").select("trade_date").where("trade_date is not null").distinct().collect())


TRAIN, TEST = 6, 2


def model_folds(spark: SparkSession, d: str) -> DataFrame:
    """Walk-forward splits of the dates."""
    rows_ = [(k, part, day) for k, f in enumerate(models.folds(trading_days(spark, d), TRAIN, TEST)) for part, days in zip(("train", "test"), f) for day in days]
    return spark.createDataFrame(rows_, "fold int, part string, trade_date string")


def model_tuning(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Validation loss of each penalty, and the one chosen."""
    best, trials = models.tune(stored(examples(spark, d, plan), "examples"), FEATURES, "y", "trade_date", 3)
    return out(spark.createDataFrame([(float(c), float(loss), c == best) for c, loss in trials], "c double, loss double, chosen boolean"))


def model_search(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Every candidate of the search with its status, penalty and validation loss."""
    r = models.search(stored(examples(spark, d, plan), "examples"), FEATURES[:1], FEATURES[1:], "y", "trade_date", 3)
    rows_ = [(" + ".join(t["features"]), t["status"], t["c"], None if t["c"] is None else float(t["loss"]), t["features"] == r["chosen"]["features"]) for t in r["tried"]]
    return out(spark.createDataFrame(rows_, "features string, status string, c double, loss double, chosen boolean"))


def model_design(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Collinearity of the features."""
    g = models.design(examples(spark, d, plan), FEATURES, "trade_date")
    return out(spark.createDataFrame([(g["status"], float(g["vif"]), float(g["pair"]))], "status string, vif double, pair double"))


def model_explained(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Share of the last feature's variance that the others explain."""
    v = models.explained(examples(spark, d, plan), FEATURES[:2], FEATURES[2], "trade_date")
    return out(spark.createDataFrame([(FEATURES[2], float(v))], "feature string, r2 double"))


def model_walk(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Each fold's model on its own test dates: accuracy, loss, and signals above the confidence that a fifth of its training rows reach."""
    q, names = factored(spark, d, _KEYS)
    x = stored(labels.counted_signs(tasks(spark, d, plan), q, names), "examples")
    parts = models.folds(trading_days(spark, d), TRAIN, TEST)
    # where a class is missing there is no model for these dates
    fitted = [(m, *days) for m, days in zip(models.fit_folds(x, FEATURES, "y", "trade_date", [train for train, _ in parts]), parts) if isinstance(m, models.Model)]
    limits = models.confidence_thresholds(models.scored_by_day(x, "trade_date", [(m, train) for m, train, _ in fitted]), "model", 0.8)
    y = models.scored_by_day(x, "trade_date", [(m, test) for m, _, test in fitted]).join(F.broadcast(limits), "model").withColumns({"c": models.predicted(), "l": models.log_loss()})
    n, sure = F.col("n"), F.greatest("p_up", "p_down") >= F.col("least")
    hit = F.when(F.col("c") == F.col("y"), n).otherwise(0)
    of = lambda v: F.sum(F.when(sure, v).otherwise(0))
    return out(y.groupBy(F.col("model").alias("fold"), "least").agg(F.sum("n").alias("n"), (F.sum(hit) / F.sum("n")).alias("accuracy"), (F.sum(n * F.col("l")) / F.sum("n")).alias("logloss"), of(n).alias("signals"), F.try_divide(of(hit), of(n)).alias("sure_accuracy")))


QUERIES = {f.__name__: f for f in (softmax_score, confusion_metrics, coverage_curve, class_prior, feature_pool, model_fit, model_folds, model_tuning, model_search, model_design, model_explained, model_walk)}
_rec = lambda k, n: f"{R(f'sum(CASE WHEN y = {k} AND c = {k} THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN y = {k} THEN 1.0 ELSE 0 END), 0)')} AS {n}_recall, {R(f'sum(CASE WHEN y = {k} AND c = {k} THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN c = {k} THEN 1.0 ELSE 0 END), 0)')} AS {n}_precision"
_raw = lambda k: f"sum(CASE WHEN y = {k} AND c = {k} THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN y = {k} THEN 1.0 ELSE 0 END), 0)"
_brier = "(p_down - CASE WHEN y = -1 THEN 1 ELSE 0 END) ** 2 + (p_flat - CASE WHEN y = 0 THEN 1 ELSE 0 END) ** 2 + (p_up - CASE WHEN y = 1 THEN 1 ELSE 0 END) ** 2"
_F1, _F2, _F3 = FEATURES
_MOMENTS = f"""{_EX}, dw AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY trade_date) / (SELECT count(DISTINCT trade_date) FROM ex) AS w FROM ex),
    mu AS (SELECT {", ".join(f"sum(w * {f}) AS m{i}" for i, f in enumerate(FEATURES))} FROM dw),
    cv AS (SELECT {", ".join(f"sum(w * ({FEATURES[i]} - m{i}) * ({FEATURES[j]} - m{j})) AS c{i}{j}" for i in range(3) for j in range(i, 3))} FROM dw, mu),
    cr AS (SELECT c01 / sqrt(c00 * c11) AS r01, c02 / sqrt(c00 * c22) AS r02, c12 / sqrt(c11 * c22) AS r12 FROM cv),
    dt AS (SELECT *, 1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12 AS det FROM cr)"""
SQL = {
    "model_folds": f"""WITH dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS k FROM (SELECT DISTINCT trade_date FROM sessions WHERE trade_date IS NOT NULL)),
        fo AS (SELECT CAST(unnest(range(greatest(0, CAST(ceil(((SELECT count(*) FROM dd) - {TRAIN}) / {TEST}) AS INTEGER)))) AS INTEGER) AS fold)
        SELECT fold, CASE WHEN k < {TRAIN} + fold * {TEST} THEN 'train' ELSE 'test' END AS part, trade_date FROM fo, dd WHERE k < {TRAIN} + (fold + 1) * {TEST}""",
    "model_design": f"""{_MOMENTS}, vf AS (SELECT *, greatest((1 - r12 * r12) / det, (1 - r02 * r02) / det, (1 - r01 * r01) / det) AS vif, greatest(abs(r01), abs(r02), abs(r12)) AS pair FROM dt)
        SELECT CASE WHEN vif <= 5 AND pair < 0.9 THEN 'OK' ELSE 'COLLINEAR' END AS status, {R('vif')} AS vif, {R('pair')} AS pair FROM vf""",
    "model_explained": f"{_MOMENTS} SELECT '{_F3}' AS feature, {R('(r02 * r02 + r12 * r12 - 2 * r01 * r02 * r12) / (1 - r01 * r01)')} AS r2 FROM dt",
    "softmax_score": f"{_S} SELECT Contract, trade_date, session, task, observation, y, {R('p_down')} AS p_down, {R('p_flat')} AS p_flat, {R('p_up')} AS p_up, c AS predicted FROM pr",
    "confusion_metrics": f"""{_S} SELECT trade_date, count(*) AS n, {R('avg(CASE WHEN c = y THEN 1.0 ELSE 0 END)')} AS accuracy, {R('avg(l)')} AS logloss, {R(f'avg({_brier})')} AS brier, {R('avg(CASE WHEN y = 0 THEN 1.0 ELSE 0 END)')} AS flat_share, {', '.join(_rec(k, n) for k, n in ((-1, 'down'), (0, 'flat'), (1, 'up')))},
        {R(f"(coalesce({_raw(-1)}, 0) + coalesce({_raw(0)}, 0) + coalesce({_raw(1)}, 0)) / nullif(count(DISTINCT y), 0)")} AS balanced_accuracy FROM pr GROUP BY 1""",
    "coverage_curve": f"""{_S}, th AS (SELECT *, CASE WHEN p_up >= p_down THEN 1 ELSE -1 END = y AS hit, greatest(p_up, p_down) >= threshold AS k FROM pr, (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)) v(threshold)),
        dy AS (SELECT threshold, trade_date, count(*) AS n, count(*) FILTER (WHERE k) AS k, sum(CASE WHEN hit THEN 1.0 ELSE 0 END) FILTER (WHERE k) AS h, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) FILTER (WHERE k) AS a FROM th GROUP BY 1, 2)
        SELECT {R('threshold')} AS threshold, CAST(sum(k) AS BIGINT) AS signals, {R('sum(k) / sum(n)')} AS coverage, {R('sum(h) / nullif(sum(k), 0)')} AS pooled_accuracy, {R('avg(a)')} AS accuracy, count(a) AS days FROM dy GROUP BY threshold""",
    "class_prior": f"""{_EX}, w AS (SELECT y, 1.0 / count(*) OVER (PARTITION BY trade_date) / (SELECT count(DISTINCT trade_date) FROM ex) AS w FROM ex), s AS (SELECT v.c AS class, coalesce(sum(w), 0) * (SELECT count(*) FROM ex) + 1e-6 AS s FROM (VALUES (-1), (0), (1)) v(c) LEFT JOIN w ON w.y = v.c GROUP BY 1)
        SELECT class, {R('s / (SELECT sum(s) FROM s)')} AS prior FROM s""",
    "feature_pool": f"WITH fac AS ({windowed_sql(_KEYS, 5)}), u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM fac" for f in FEATURES) + f") SELECT feature, {R('count(v) / count(*)')} AS coverage, CASE WHEN count(v) / count(*) >= 0.9 AND min(v) < max(v) THEN 'OK' ELSE 'LOW_COVERAGE_OR_CONSTANT' END AS status FROM u GROUP BY 1",
}
