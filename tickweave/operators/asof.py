"""As-of, next and n-th following row, and interval joins, by union and windows in one partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(points: DataFrame, rows: DataFrame, keys: Sequence[str], values: Sequence[str], *, at: str = "t", forward: bool = False, order: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """``points`` with ``prefix`` + each of ``values`` (and of ``at``) of the last row with ``at`` <= the point's, or the first with ``at`` >= it.

    Of rows at one time the last in ``order`` counts backward, the first forward. Null where there is none. Both tables are shuffled once on
    ``keys`` and sorted together: no pair is ever formed.
    """
    keys, order = list(keys), list(order)
    payload = [at, *(v for v in values if v != at)]
    r = rows.select(*keys, F.col(at).alias("_at"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*payload).alias("_row"))
    p = points.select(*keys, F.col(at).alias("_at"), F.struct(*(c for c in points.columns if c not in keys)).alias("_point"))
    both = r.unionByName(p, allowMissingColumns=True).withColumn("_kind", F.when(F.col("_row").isNull(), 1).otherwise(0))
    time = [F.col("_at").desc() if forward else F.col("_at"), F.col("_kind")]
    ties = [F.col(f"_o{i}").desc() if forward else F.col(f"_o{i}") for i in range(len(order))]
    w = Window.partitionBy(*keys).orderBy(*time, *ties).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_point is not null")
    own = [c if c in keys else f"_point.{c}" for c in points.columns]  # the keys keep their partitioning
    return found.select(*own, *(F.col(f"_row.{c}").alias(f"{prefix}{c}") for c in payload))


def following(points: DataFrame, rows: DataFrame, keys: Sequence[str], values: Sequence[str], n: int, *, at: str = "t", number: str = "rn", order: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """``points`` with the n-th row strictly after each; ``number`` counts each key's rows from 1 in order of time."""
    keys = list(keys)
    last = asof(points, rows, keys, [number], at=at, order=order, prefix="_last_")
    wanted = last.withColumn("_wanted", F.coalesce(F.col(f"_last_{number}"), F.lit(0)) + n).drop(f"_last_{number}", f"_last_{at}")
    r = rows.select(*keys, F.col(number).alias("_wanted"), *(F.col(v).alias(f"{prefix}{v}") for v in [at, *values]))
    return wanted.join(r, [*keys, "_wanted"], "left").drop("_wanted")


def interval_rows(spans: DataFrame, rows: DataFrame, keys: Sequence[str], *, lo: str, hi: str, at: str = "t", bucket: int = 1_000_000) -> DataFrame:
    """Each span joined to the rows with lo <= ``at`` <= hi, by equality on ``bucket`` units of time and a filter: no cartesian product."""
    keys = list(keys)
    each = F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))
    s = spans.where(f"{lo} <= {hi}").withColumn("_bucket", F.explode(each))
    r = rows.withColumn("_bucket", F.floor(F.col(at) / bucket))
    return s.join(r, [*keys, "_bucket"]).where(f"{at} between {lo} and {hi}").drop("_bucket")


def interval_spread(points: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, ahead: int, *, at: str = "t") -> DataFrame:
    """``points`` with ``rows``, ``most`` and ``least`` of ``value`` over the rows with ``at`` from the point's to ``ahead`` later; those without any are left out.

    Points at one time are one row beside the rows, and a range window looks ahead: one shuffle on ``keys``, no pair is formed and nothing sent
    to every task. (A table of exploded points is planned by the size of what it was exploded from, which a join takes for small.)
    """
    keys = list(keys)
    p = points.groupBy(*keys, F.col(at).alias("_at")).agg(F.collect_list(F.struct(*(c for c in points.columns if c not in keys))).alias("_points"))
    both = rows.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_v"), F.lit(1).alias("_row")).unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(0, ahead)
    x = both.select(*keys, "_points", F.count("_row").over(w).alias("rows"), F.max("_v").over(w).alias("most"), F.min("_v").over(w).alias("least"))
    x = x.where("_points is not null and rows > 0").withColumn("_point", F.explode("_points"))
    return x.select(*(c if c in keys else f"_point.{c}" for c in points.columns), "rows", "most", "least")
