import math
import random

import numpy as np

from tickweave.llm.percentiles import combine, percentiles, value_counts
from tickweave.operators.totals import running_totals

STEP = {"x": 0.01}


def fills(spark, n=4000):
    r = random.Random(1)
    rows = [(f"d{r.randrange(5)}", r.choice(["a", "a", "a", "b", None]), r.choice([None, float("nan"), -0.0, 1.5, r.gauss(0, 3), r.gauss(0, 3), r.lognormvariate(0, 3)]), 7) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "day string, g string, x double, bin int")


def test_bound_and_combination(spark):
    rows, df = fills(spark)
    whole = percentiles(value_counts(df, ["g"], STEP), ["g"], STEP, (0.01, 0.5, 0.9, 1.0)).collect()
    days = percentiles(combine(value_counts(df, ["day", "g"], STEP), ["g"]), ["g"], STEP, (0.01, 0.5, 0.9, 1.0)).collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in days} and len(whole) == 12
    for r in whole:
        x = np.sort([v for _, g, v, _ in rows if g == r.g and v is not None and not math.isnan(v)])
        true = x[max(math.ceil(r.percent * len(x)), 1) - 1]
        assert abs(r.value - true) <= 0.005 + 1e-9 and r.n == len(x)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", float("inf")), ("b", None), (None, -2.0)], "g string, x double")
    got = {(r.g, r.percent): r.value for r in percentiles(value_counts(df, ["g"], STEP), ["g"], STEP, (0.0, 0.5, 1.0)).collect()}
    assert got == {("a", 0.0): 1.0, ("a", 0.5): 1.0, ("a", 1.0): float("inf"), (None, 0.0): -2.0, (None, 0.5): -2.0, (None, 1.0): -2.0}
    assert percentiles(value_counts(df.limit(0), ["g"], STEP), ["g"], STEP).count() == 0


def test_running_totals_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'cold' || id % 7, 'hot') g", "cast(id as double) o", "id % 5 v")
    got = running_totals(df, ["g"], ["o"], "v").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.o):
        by[r.g] = by.get(r.g, 0) + r.v
        assert r.total == by[r.g]
    assert all(r.total_all == by[r.g] for r in got) and len(got) == 5000
