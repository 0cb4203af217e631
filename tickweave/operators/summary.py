"""Summaries of paired orders: which tasks are complete, how orders were filled, and what each strategy saves on another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators import statistics as st

#: How an order may have been filled: stage and kind; each order is one of these or ``other``.
FILLS = {"initial_limit": ("initial", "limit"), "signal_limit": ("signal", "limit"), "signal_market": ("signal", "market"), "deadline_market": ("deadline", "market"), "immediate_market": ("immediate", "market")}


def pairing(orders: DataFrame, task: Sequence[str], strategies: Sequence[str]) -> DataFrame:
    """(task..., reason): of every task whether each strategy has one order on both sides: ok, REPEATED, UNPAIRED or UNEXPECTED.

    Tasks that break the contract are told, not dropped: callers take those that are ok.
    """
    slot = F.struct("strategy", "direction")
    fits = F.col("strategy").isin(*strategies) & F.col("direction").isin(-1, 1)
    g = orders.groupBy(*task).agg(F.count("*").alias("_all"), F.count(F.when(fits, 1)).alias("_fit"), F.count_distinct(F.when(fits, slot)).alias("_slots"))
    reason = F.when(F.col("_all") != F.col("_fit"), "UNEXPECTED").when(F.col("_fit") != F.col("_slots"), "REPEATED").when(F.col("_slots") != 2 * len(strategies), "UNPAIRED").otherwise("ok")
    return g.select(*task, reason.alias("reason"))


def fill_flags(stage: Column, kind: Column) -> dict[str, Column]:
    """1.0 for the way an order was filled, 0.0 for the others: exhaustive and exclusive."""
    is_ = {n: F.coalesce((stage == s) & (kind == k), F.lit(False)) for n, (s, k) in FILLS.items()}
    rest = F.lit(True)
    for c in is_.values():
        rest = rest & ~c
    return {n: c.cast("double") for n, c in {**is_, "other": rest}.items()}


def order_summary(orders: DataFrame, task: Sequence[str], strategies: Sequence[str], references: Sequence[str], spans: Mapping[str, tuple[int, int]], early: float = 3.0) -> DataFrame:
    """(scope, side, strategy, days, orders, tasks, cost, elapsed, early, fills..., saving on each reference and its positive days), equal over dates.

    Only tasks whose pairing is ok count; ``orders`` has task, trade_date, nominal_second, direction, strategy, fill_stage, fill_kind, cost, elapsed.
    """
    good = pairing(orders, task, strategies).where("reason = 'ok'").drop("reason")
    z = orders.join(good, list(task)).withColumns({"early": F.when(F.col("elapsed").isNotNull(), (F.col("elapsed") <= early + 1e-10).cast("double")), **fill_flags(F.col("fill_stage"), F.col("fill_kind"))})
    z = st.sides(st.scopes(z, "nominal_second", spans))
    measures = ["cost", "elapsed", "early", *FILLS, "other"]
    daily = z.groupBy("scope", "side", "trade_date", "strategy").agg(*(F.avg(m).alias(m) for m in measures), F.count("*").alias("orders"))
    for r in references:
        daily = daily.join(daily.where(F.col("strategy") == r).select("scope", "side", "trade_date", F.col("cost").alias(f"_{r}")), ["scope", "side", "trade_date"], "left")
    saved = [a for r in references for a in (F.avg(F.col(f"_{r}") - F.col("cost")).alias(f"saving_on_{r}"), F.count_if(F.col(f"_{r}") - F.col("cost") > 1e-12).alias(f"better_days_than_{r}"))]
    both = F.when(F.col("side") == "both", 2).otherwise(1)
    g = daily.groupBy("scope", "side", "strategy").agg(F.count("*").alias("days"), F.sum("orders").alias("orders"), *(F.avg(m).alias(m) for m in measures), *saved)
    return g.withColumn("tasks", (F.col("orders") / both).cast("bigint"))
