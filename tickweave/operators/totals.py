"""Running totals of any size: range-sort, totals of the partitions as offsets, windows within partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.runtime import stored


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to and including each row of its group in ``order`` (a total order), and
    ``<name>_all``, the group's sum. Null is a group of its own; an empty table stays empty.

    No window covers a whole group: rows are range-partitioned by group and order and written out, partition totals give offsets (one row
    per partition and group), and windows run within partitions only. A group of any size spreads over many tasks.
    """
    group, order = list(group), list(order)
    ranged = stored(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group).orderBy("_part")
    of = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    parts = parts.select(*of, F.col("_part").alias("_p"), (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(*group)).alias(f"{name}_all"))
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(parts, on).withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_part", "_before", "_p", *(f"_g{i}" for i in range(len(group))))
