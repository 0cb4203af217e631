"""Percentiles per group by cumulative frequencies, from counts that can be kept per day and added."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.operators.totals import running_totals
from tickweave.runtime import real

PERCENTS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
STEPS = {"cost_bp": 0.001, "elapsed_seconds": 0.001}


def value_counts(df: DataFrame, by: Sequence[str], measures: Mapping[str, float]) -> DataFrame:
    """(by..., measure, bin, n): how often each value occurs, ``bin`` being the value in whole steps of its measure (half to even).

    The value that a bin stands for, bin x step, is off by at most step / 2. Tables of separate days or partitions add up (``combine``).
    Nulls and NaN are no values; infinities are values; groups may be null; every stored row counts, repeated ones too.
    """
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), (F.rint(real(m) / F.lit(step)) + F.lit(0.0)).alias("bin")) for m, step in measures.items())))
    return df.select(*by, each.alias("_v")).where("_v.bin is not null").groupBy(*by, F.col("_v.measure").alias("measure"), F.col("_v.bin").alias("bin")).agg(F.count("*").alias("n"))


def combine(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of coarser groups from kept ones: bins add up exactly, so any split of the rows gives the same result."""
    return counts.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, by: Sequence[str], measures: Mapping[str, float], percents: Sequence[float] = PERCENTS) -> DataFrame:
    """(by..., measure, percent, value, n): the first value whose cumulative frequency reaches rank ceil(percent x n), 1 at least.

    Exact on the bins: |value - true percentile| <= step / 2. Groups without values have no rows.
    """
    by = list(by)
    totals = running_totals(counts, [*by, "measure"], ["bin"], "n", "cum")
    # A row is the answer to every percent whose rank lies in (cum - n, cum].
    hits = totals.select(*by, "measure", "bin", "cum", "n", "cum_all", F.explode(F.filter(F.array(*(F.lit(float(p)) for p in percents)), lambda p: (F.greatest(F.ceil(p * F.col("cum_all")), F.lit(1)) <= F.col("cum")) & (F.greatest(F.ceil(p * F.col("cum_all")), F.lit(1)) > F.col("cum") - F.col("n")))).alias("percent"))
    step = F.create_map(*(x for m, s in measures.items() for x in (F.lit(m), F.lit(float(s)))))
    return hits.select(*by, "measure", "percent", (F.col("bin") * step[F.col("measure")]).alias("value"), F.col("cum_all").cast("bigint").alias("n"))
