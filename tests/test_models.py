import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import models as m


def data(spark, n=600, seed=2):
    g = np.random.default_rng(seed)
    x = g.normal(0, 1, (n, 3))
    z = x @ np.array([[1.0, -0.5, 0.2], [0, 0, 0], [-1.0, 0.4, 0.1]]).T + g.gumbel(0, 1, (n, 3))
    y = z.argmax(axis=1) - 1
    days = [f"d{k:02d}" for k in g.integers(0, 12, n)]
    rows = [(*map(float, a), int(b), d) for a, b, d in zip(x, y, days)] + [(None, 0.0, 0.0, 1, "d00"), (0.0, 0.0, 0.0, None, "d01")]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, day string"), x, y, days


def loss(theta, x, y, w):
    z = x @ theta.T
    return float(w @ (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))


def test_curvature_by_differences():
    g = np.random.default_rng(0)
    x, y, w, phi = np.column_stack([g.normal(size=(30, 2)), np.ones(30)]), g.integers(0, 3, 30), g.random(30), g.normal(size=(2, 3))
    sums = m.curvature(phi, x, y, w)
    assert np.allclose(m.CONTRASTS.T @ m.CONTRASTS, np.eye(2)) and np.allclose(m.CONTRASTS.sum(axis=0), 0)
    assert sums[0] == pytest.approx(loss(m.CONTRASTS @ phi, x, y, w)) and len(sums) == 1 + 6 + 36
    for k in range(6):
        e = np.zeros(6)
        e[k] = 1e-5
        up, down = m.curvature(phi + e.reshape(2, 3), x, y, w), m.curvature(phi - e.reshape(2, 3), x, y, w)
        assert (up[0] - down[0]) / 2e-5 == pytest.approx(sums[1 + k], abs=1e-6)
        assert (up[1:7] - down[1:7]) / 2e-5 == pytest.approx(sums[7:].reshape(6, 6)[k], abs=1e-5)


def test_fit_is_a_minimum_and_days_count_the_same(spark):
    df, x, y, days = data(spark)
    model = m.fit(df.repartition(5), ["a", "b", "c"], "y", "day", 1.0)
    assert model.gradient < 1e-8 and np.allclose(np.sum(model.coef, axis=0), 0)
    w = np.array([1 / days.count(d) for d in days])
    w /= w.sum()
    mean = w @ x
    scale = np.sqrt(w @ (x - mean) ** 2)
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    theta = np.column_stack([model.coef, model.intercept])
    full = lambda t: loss(t, design, y + 1, w) + (t[:, :-1] ** 2).sum() / 2 / len(x)
    for k in range(12):
        e = np.zeros(12)
        e[k] = 1e-4
        assert full(theta + e.reshape(3, 4)) > full(theta) - 1e-12 < full(theta - e.reshape(3, 4))
    p = df.dropna().withColumns(m.scores(model)).toPandas()
    assert np.allclose(p[["p_down", "p_flat", "p_up"]].sum(axis=1), 1) and (p[["p_down", "p_flat", "p_up"]].to_numpy().argmax(axis=1) - 1 == p.y).mean() > 0.5
    r = m.metrics(df.dropna().withColumns(m.scores(model))).first()
    assert r.accuracy == pytest.approx((p[["p_down", "p_flat", "p_up"]].to_numpy().argmax(axis=1) - 1 == p.y).mean()) and 0 < r.brier < 2


def test_missing_class_and_collinearity(spark):
    df, *_ = data(spark)
    with pytest.raises(ValueError):
        m.fit(df.where("y <> 0"), ["a"], "y", "day")
    z = df.withColumns({"a2": F.col("a") * 2, "near": F.col("a") + F.col("b") * 0.1, "one": F.lit(1.0)})
    assert m.design(z, ["a", "b"], "day")["status"] == "OK" and m.design(z, ["a", "a2"], "day")["status"] == "DEPENDENT"
    assert m.design(z, ["a", "near"], "day")["status"] == "COLLINEAR" and m.design(z, ["a", "one"], "day")["status"] == "CONSTANT"
    assert {r.feature: r.status for r in m.pool(z, ["a", "one"]).collect()} == {"a": "OK", "one": "LOW_COVERAGE_OR_CONSTANT"}


def test_many_fits_at_once_equal_single_ones(spark):
    df, *_ = data(spark, 400)
    wanted = [(["a"], 1.0), (["b", "a"], 0.1), (["a", "b", "c"], 10.0)]
    clean = m.prepared(df, ["a", "b", "c"], "y", "day")
    for (names, c), model in zip(wanted, m.fit_many(clean, ["a", "b", "c"], wanted)):
        alone = m.fit(df, names, "y", "day", c)
        assert model.features == list(names) and np.allclose(model.coef, alone.coef, atol=1e-7) and np.allclose(model.intercept, alone.intercept, atol=1e-7)
    assert isinstance(m.fit_many(clean.limit(0), ["a"], [(["a"], 1.0)])[0], str)


def test_folds_pick_their_models_and_thresholds_stay(spark):
    df, *_ = data(spark, 400)
    a, b = m.fit(df, ["a"], "y", "day"), m.fit(df, ["a", "b"], "y", "day")
    a.days, b.days = ["d00", "d01"], ["d02"]
    x = m.by_fold(df, [a, b], "day").collect()
    assert all((r.p_up is None) == (r.day not in ("d00", "d01", "d02") or r.a is None) for r in x)
    one = next(r for r in x if r.day == "d02")
    assert one.p_up == pytest.approx(df.where(F.col("a") == one.a).withColumns(m.scores(b)).first().p_up)
    t = m.confidence_threshold(df.dropna().withColumns(m.scores(b)), 0.8)
    assert 0.3 < t < 1


def test_search_prefers_few_features(spark):
    df, *_ = data(spark, 300)
    z = df.withColumn("copy", F.col("a") * 3)
    out = m.search(z, ["a"], ["copy", "b"], "y", "day", held=3, adds=2, width=1)
    assert len(out["tried"]) == len({tuple(t["features"]) for t in out["tried"]}) == 4
    assert {tuple(t["features"]): t["status"] for t in out["tried"]}[("a", "copy")] == "REJECTED_COLLINEAR" and out["chosen"]["features"][0] == "a"


def test_folds_and_prior(spark):
    f = m.folds([f"d{i:02d}" for i in range(38)])
    assert [len(b) for _, b in f] == [5, 5, 5, 3] and all(max(a) < min(b) for a, b in f)
    d = spark.createDataFrame([("x", 1), ("x", 1), ("y", -1), ("y", None)], "day string, y int")
    p = {r["class"]: r.prior for r in m.class_prior(d, "day").collect()}
    assert p[1] == pytest.approx(0.5, abs=1e-5) and p[-1] == pytest.approx(0.5, abs=1e-5) and 0 < p[0] < 1e-5
    c = {r.threshold: r for r in m.threshold_coverage(spark.createDataFrame([("x", 1, 0.1, 0.3, 0.6), ("x", -1, 0.2, 0.3, 0.5), ("y", -1, 0.45, 0.3, 0.25)], "day string, y int, p_down double, p_flat double, p_up double"), "day", (0.4, 0.55)).collect()}
    assert c[0.4].signals == 3 and c[0.4].accuracy == pytest.approx(0.75) and c[0.55].signals == 1


def test_explained_share(spark):
    df, x, _, days = data(spark)
    z = df.withColumns({"mix": F.col("a") * 2 - F.col("b"), "one": F.lit(1.0)})
    assert m.explained(z, ["a", "b"], "mix", "day") == pytest.approx(1.0, abs=1e-6) and m.explained(z, ["a"], "c", "day") < 0.05
    assert np.isnan(m.explained(z, ["a"], "one", "day")) and len(days) == len(x)


def test_folds_at_once_equal_single_fits(spark):
    df, *_ = data(spark)
    counted = df.groupBy("a", "b", "c", "y", "day").count().withColumnRenamed("count", "n").unionByName(df.where("day < 'd03'").withColumn("n", F.lit(2)))
    plain = df.unionByName(df.where("day < 'd03'")).unionByName(df.where("day < 'd03'"))
    parts = [[f"d{k:02d}" for k in range(n)] for n in (3, 6, 11)] + [["none"]]
    found = m.fit_folds(counted.repartition(5), ["a", "b", "c"], "y", "day", parts)
    for days, model in zip(parts[:-1], found):
        alone = m.fit(plain.where(F.col("day").isin(days)), ["a", "b", "c"], "y", "day")
        for c in ("mean", "scale", "coef", "intercept"):
            assert np.allclose(getattr(model, c), getattr(alone, c), atol=1e-7)
    assert isinstance(found[-1], str) and m.fit_folds(counted, ["a"], "y", "day", []) == []
    fitted = [(model, days) for model, days in zip(found, parts) if isinstance(model, m.Model)]
    counts = df.dropna().groupBy("a", "b", "c", "day").count().withColumnRenamed("count", "n")
    least = {r.model: r.least for r in m.confidence_thresholds(m.scored_by_day(counts, "day", fitted), "model", 0.8).collect()}
    assert least == {i + 1: m.confidence_threshold(df.dropna().where(F.col("day").isin(days)).withColumns(m.scores(model)), 0.8) for i, (model, days) in enumerate(fitted)}


def test_walk_reads_its_rows_as_often_as_one_fit(spark, monkeypatch):
    from tests.oracle import SF
    from tickweave.plans import models as plans

    calls, real = [], m.summed
    monkeypatch.setattr(m, "summed", lambda *a: calls.append(1) or real(*a))
    got = {r.fold: r for r in plans.model_walk(spark, SF).collect()}
    passes, x = len(calls), plans.examples(spark, SF).cache()
    single = []
    for k, (train, test) in enumerate(m.folds(plans.trading_days(spark, SF), plans.TRAIN, plans.TEST), 1):
        calls.clear()
        part = x.where(F.col("trade_date").isin(train))
        model = m.fit(part, plans.FEATURES, "y", "trade_date")
        single.append(len(calls))
        least = m.confidence_threshold(part.withColumns(m.scores(model)), 0.8)
        y = x.where(F.col("trade_date").isin(test)).withColumns(m.scores(model)).withColumns({"c": m.predicted(), "l": m.log_loss(), "s": F.greatest("p_up", "p_down") >= least})
        hit = F.when(F.col("c") == F.col("y"), 1.0).otherwise(0.0)
        want = y.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg("l").alias("logloss"), F.count_if("s").alias("signals"), F.avg(F.when(F.col("s"), hit)).alias("sure")).first()
        assert (got[k].n, got[k].signals) == (want.n, want.signals)
        assert (got[k].least, got[k].accuracy, got[k].logloss, got[k].sure_accuracy) == pytest.approx((least, want.accuracy, want.logloss, want.sure), abs=1e-6)
    assert len(got) == len(single) > 1 and passes <= max(single) + 1


def test_counted_signs_do_not_depend_on_parts(spark):
    from tests.oracle import SF
    from tickweave.operators.labels import counted_signs
    from tickweave.plans import models as plans
    from tickweave.plans.labels import factored, tasks

    q, names = factored(spark, SF, plans._KEYS)
    q, by = q.cache(), ["trade_date", *plans.FEATURES, "y"]
    want = {tuple(r) for r in plans.examples(spark, SF).groupBy(*by).count().collect()}
    for most in (50_000, 40):
        assert {tuple(r) for r in counted_signs(tasks(spark, SF), q, names, most=most).select(*by, "n").collect()} == want
    assert want
