"""Factors of factors, and factors bounded to a task's own rows."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.catalog import ROW, WINDOWED
from tickweave.operators import factors
from tickweave.operators.labels import AGE
from tickweave.operators.lens import KEYS, ORDER
from tickweave.runtime import map_parts, same_key

#: name -> (inputs, formula over them); {h} is the history in seconds. A value needs all inputs.
VARIANTS = {
    "A01_QISpread": (("F01_QI", "A01_Spread"), "F01_QI * A01_Spread"),
    "A02_QIThinDepth_h{h}s": (("F01_QI", "A02_DepthLogRatio_h{h}s"), "F01_QI / (1 + exp(A02_DepthLogRatio_h{h}s))"),
    "A03_QIStability_h{h}s": (("A03_QIMean_h{h}s", "A03_QIStd_h{h}s"), "A03_QIMean_h{h}s / (1 + A03_QIStd_h{h}s)"),
    "A07_OFIActivityAligned_h{h}s": (("A07_OFIDirection_h{h}s", "A07_OFIActivity_h{h}s"), "A07_OFIDirection_h{h}s * ln(1 + A07_OFIActivity_h{h}s)"),
    "A08_OFIPulseAligned_h{h}s": (("A07_OFIDirection_h{h}s", "A08_OFIPulse_h{h}s"), "A07_OFIDirection_h{h}s * A08_OFIPulse_h{h}s"),
    "B08_QuoteRVAligned_h{h}s": (
        ("B06_BidUpRate_h{h}s", "B06_BidDownRate_h{h}s", "B06_AskUpRate_h{h}s", "B06_AskDownRate_h{h}s", "B08_BidRV_h{h}s", "B08_AskRV_h{h}s"),
        "coalesce((B06_BidUpRate_h{h}s - B06_BidDownRate_h{h}s + B06_AskUpRate_h{h}s - B06_AskDownRate_h{h}s) / nullif(B06_BidUpRate_h{h}s + B06_BidDownRate_h{h}s + B06_AskUpRate_h{h}s + B06_AskDownRate_h{h}s, 0), 0.0) * (B08_BidRV_h{h}s + B08_AskRV_h{h}s) / 2",
    ),
    "C01_QIRV_h{h}s": (("F01_QI", "C01_PriceRV_h{h}s"), "F01_QI * C01_PriceRV_h{h}s"),
    "D01_VolumeRateAligned_h{h}s": (("F08_SignedVolume_h{h}s", "D01_VolumeRate_h{h}s"), "F08_SignedVolume_h{h}s * ln(1 + D01_VolumeRate_h{h}s)"),
    "D05_QIVolumeDepth_h{h}s": (("A03_QIMean_h{h}s", "D05_VolumeDepthRate_h{h}s"), "A03_QIMean_h{h}s * ln(1 + D05_VolumeDepthRate_h{h}s)"),
    "M01_TrendConfirmed_h{h}s": (("M01_MADeviation_h{h}s", "A07_OFIDirection_h{h}s"), "CASE WHEN M01_MADeviation_h{h}s * A07_OFIDirection_h{h}s > 0 THEN M01_MADeviation_h{h}s ELSE 0.0 END"),
    "M01_CounterflowDeviation_h{h}s": (("M01_MADeviation_h{h}s", "A07_OFIDirection_h{h}s"), "CASE WHEN M01_MADeviation_h{h}s * A07_OFIDirection_h{h}s < 0 THEN M01_MADeviation_h{h}s ELSE 0.0 END"),
}
#: Inputs from other tables than windows and rows: joined by ``variants`` where they are given.
MORE = {
    "A05_SignedStateAge": (("A05_QIState", "A05_StateAge"), "A05_QIState * ln(1 + A05_StateAge)"),
    "M07_SignedMeanAge_h{h}s_g5s": (("M07_MeanState_h{h}s_g5s", "M07_MeanStateAge_h{h}s_g5s"), "M07_MeanState_h{h}s_g5s * ln(1 + M07_MeanStateAge_h{h}s_g5s)"),
    "R04_QIVolumeState_h{h}s": (("F01_QI", "R04_VolumeRatePercentile_h{h}s"), "F01_QI * R04_VolumeRatePercentile_h{h}s"),
    "R05_QIVolumeAcceleration_lag2s": (("F01_QI", "D03_VolumeRateImbalance_lag2s"), "F01_QI * greatest(D03_VolumeRateImbalance_lag2s, 0.0)"),
    "R05_QIVolumeAcceleration_lag5s": (("F01_QI", "D03_VolumeRateImbalance_lag5s"), "F01_QI * greatest(D03_VolumeRateImbalance_lag5s, 0.0)"),
}


def apply_variants(x: DataFrame, specs: dict[str, tuple[tuple[str, ...], str]], h: int) -> DataFrame:
    """(snap_id, values, statuses): of the first input without a value PARENT_INVALID with its name and status, else ok."""
    out = {}
    for name, (inputs, formula) in specs.items():
        n, parents = name.format(h=h), [p.format(h=h) for p in inputs]
        bad = None
        for p in parents:
            why = F.col(f"{p}__status") if f"{p}__status" in x.columns else F.lit("NO_VALUE")
            term = F.concat(F.lit(f"PARENT_INVALID:{p}:"), why)
            bad = F.when(F.col(p).isNull(), term) if bad is None else bad.when(F.col(p).isNull(), term)
        out[n] = F.when(bad.isNull(), F.expr(formula.format(h=h)))
        out[f"{n}__status"] = F.coalesce(bad, F.lit("ok"))
    return x.select(*KEYS, "snap_id", *(c.alias(n) for n, c in out.items()))


def variants(q: DataFrame, h: int = 5) -> DataFrame:
    """Directional variants of windowed and row factors over ``h`` seconds."""
    need = {p.format(h=h) for inputs, _ in VARIANTS.values() for p in inputs}
    keys = [k for k in WINDOWED if f"{k[1]}_{k[2]}_h{h}s" in need]
    x = factors.window_factors(q, keys, (h,)).join(factors.row_factors(q).select(*KEYS, "snap_id", *(c for f, s in ROW for c in (f"{f}_{s}", f"{f}_{s}__status") if f"{f}_{s}" in need)), [*KEYS, "snap_id"])
    return apply_variants(x, VARIANTS, h)


def more_variants(q: DataFrame, percentiles: DataFrame, h: int = 5) -> DataFrame:
    """Directional variants of ages, mean states, history percentiles and segment changes."""
    x = factors.row_factors(q).select(*KEYS, "snap_id", "F01_QI", "F01_QI__status", "A05_QIState", "A05_QIState__status")
    for t in (factors.age_factors(q).select(*KEYS, "snap_id", "A05_StateAge", "A05_StateAge__status"), factors.mean_state_factors(q, h).select(*KEYS, "snap_id", f"M07_MeanState_h{h}s_g5s", f"M07_MeanStateAge_h{h}s_g5s"), percentiles.select(*KEYS, "snap_id", f"R04_VolumeRatePercentile_h{h}s"), factors.segment_factors(q).select(*KEYS, "snap_id", "D03_VolumeRateImbalance_lag2s", "D03_VolumeRateImbalance_lag5s")):
        x = x.join(t, [*KEYS, "snap_id"])
    return apply_variants(x, MORE, h)


def mean_gap(q: DataFrame, short: int = 5, long: int = 10) -> DataFrame:
    """Distance of a short and a long moving mean, and whether both windows start at the same row."""
    m = WINDOWED["price", "M01", "MADeviation"][0]
    x = factors.add_formulas(q, {"_s": ("price", m, short), "_l": ("price", m, long)})
    x = factors.add_formulas(x, {"_sc": ("price", "{cov}", short), "_lc": ("price", "{cov}", long)}, usable=False)
    name = f"h{long}s_short{short}s"
    return x.select(*KEYS, "snap_id", "t", (F.col("_l") - F.col("_s")).alias(f"M06_MeanGap_{name}"), F.when(F.col("valid_price"), F.when(F.col("_sc") == F.col("_lc"), 1.0).otherwise(0.0)).alias(f"M06_SameWindow_{name}"))


#: Windowed factors of a task's own rows, by the catalogue's formulas.
BOUNDED = ["A03_QIMean", "A04_QIDeviation", "A02_DepthLogRatio", "A06_PositionDeviation", "A07_OFIRate", "A07_OFIDirection", "B04_AdditionDifference", "B05_DepletionDifference", "F05_Momentum", "F06_PathEfficiency", "M01_MADeviation", "C01_PriceRV", "C05_CountImbalance", "F08_SignedVolume", "D06_PreQIVolume", "D07_UnchangedPriceOFIRate"]
CROSS = {"X_OFI_Volume": ("F03_OFI_latest", "D01_LogVolumeRate"), "X_Position_Volume": ("F07_QuotePosition", "D01_LogVolumeRate"), "X_OFI_Spread": ("F03_OFI_latest", "A01_Spread"), "X_Pressure_Path": ("A07_OFIDirection", "F06_PathEfficiency"), "X_QI_Volume": ("A03_QIMean", "D01_LogVolumeRate"), "X_Position_RV": ("F07_QuotePosition", "C01_PriceRV")}


def bounded_factors(q: DataFrame, tasks: DataFrame, window: int = 3, most: int = 100_000) -> DataFrame:
    """(keys, task, rows, source_age, factors) from the rows in [task, task + window] alone: 25 factors and 6 products.

    No step may cross the task's start, so that the first cumulative volume is no increment. The source is the last row, at most half a
    second old at the end; tasks without one have no factors. Windows must span 80 % of the task's.
    """
    import numpy as np
    import pyarrow as pa

    us = window * 1_000_000
    forms = {f"{f}_{s}": (g, WINDOWED[g, f, s][0]) for g, f, s in WINDOWED if f"{f}_{s}" in BOUNDED}
    forms |= {"F03_OFI_window": ("ofi", "{sum:ofi}"), "D01_LogVolumeRate": ("volume", "ln(1 + {sum:dv} / nullif({cov}, 0))")}
    place: dict[tuple, str] = {}
    cols = {}
    for n, (g, formula) in forms.items():
        cov = place.setdefault(("cov", None, g), f"_w{len(place)}")
        text = factors.PRIMITIVE.sub(lambda m: place.setdefault((m[1], m[2], g), f"_w{len(place)}"), formula)  # noqa: B023
        cols[n] = F.expr(f"CASE WHEN valid_{g} AND {cov} > 0 AND {cov} >= {0.8 * window} THEN {text} END")
    if any(op not in ("cov", "first", "sum") for op, _, _ in place):
        raise ValueError("formulas of bounded factors are made of cov, first and sum")
    groups = list(dict.fromkeys(g for _, _, g in place))
    # Values of single rows: of those of a step, only if it starts within the task.
    single = {"F03_OFI_latest": ("edge_ofi", "ofi"), "F04_QuoteShift": ("edge_book", "(a - l_a + b - l_b) / 2"), "F07_QuotePosition": ("valid_position", "position"), "F01_QI": ("valid_queue", "qi"), "A02_LogDepth": ("valid_queue", "ln(1 + depth)"), "F02_QIChange": ("edge_queue", "qi - l_qi"), "A01_Spread": ("valid_book", "spread")}
    plain = {"p": "double", "qi": "double", "depth": "double", "position": "double", **{f"valid_{g}": "boolean" for g in groups}, **{n: "double" for n in single}}
    values = {a: F.coalesce(F.expr(f"CAST({x} AS DOUBLE)"), F.lit(0.0)) if op == "sum" else F.expr(x) for (op, x, _), a in place.items() if op != "cov"}

    # A session's tasks come with its first row: nothing but narrow lists is shuffled a second time.
    listed = tasks.groupBy(*KEYS).agg(F.sort_array(F.collect_set("task")).alias("_tasks")).hint("merge")
    b = q.withColumns({n: F.expr(f"CASE WHEN {ok} THEN {e} END") for n, (ok, e) in single.items()})
    b = b.select(*KEYS, *ORDER, "rn", "l_t", *(f"seg_{g}" for g in groups), *plain, *(c.cast("double").alias(a) for a, c in values.items())).join(listed, list(KEYS))
    b = b.withColumn("_tasks", F.when(F.col("rn") == 1, F.col("_tasks")))

    def part(table: pa.Table, more: bool, state: dict) -> tuple[pa.Table | None, int]:
        number = lambda c: table.column(c).to_numpy()
        n, t = table.num_rows, number("t")
        new = ~same_key(table, KEYS)
        clock = (np.cumsum(new) << 44) + t  # sessions one after the other
        own = table.column("_tasks").combine_chunks()
        starts = own.flatten().to_numpy()
        lengths = pc.fill_null(pc.list_value_length(own), 0).to_numpy()
        at = (np.repeat(np.cumsum(new), lengths) << 44) + starts
        if "left" in state:  # the first session goes on
            at = np.concatenate([(np.int64(1) << 44) + state.pop("left"), at[at >= np.int64(2) << 44]])
        first = n
        if more:  # one session: tasks whose rows aren't all here wait, with the rows from the first of them on
            done = int(np.searchsorted(at, clock[-1] - us))
            state["left"] = at[done:] - (np.int64(1) << 44)
            first = int(np.searchsorted(clock, at[done])) if done < len(at) else n - 1
            at = at[:done]
        lo, last = np.searchsorted(clock, at), np.searchsorted(clock, at + us, side="right") - 1
        some = last >= lo
        at, lo, last = at[some], lo[some], last[some]
        if not len(at):
            return None, first
        took = table.take(pa.array(last))
        out = {k: took.column(k) for k in KEYS} | {"task": at & ((1 << 44) - 1), "rows": last - lo + 1, "t": took.column("t"), "l_t": took.column("l_t")} | {c: took.column(c) for c in plain}
        begin = {}
        for g in groups:
            seg = number(f"seg_{g}")
            starts_here = new.copy()
            starts_here[1:] |= seg[1:] != seg[:-1]
            begin[g] = np.maximum(lo, np.maximum.accumulate(np.where(starts_here, np.arange(n), 0))[last])
        for (op, _, g), a in place.items():
            if op == "cov":
                out[a] = (t[last] - t[begin[g]]) / 1e6
            elif op == "first":
                out[a] = table.column(a).take(pa.array(begin[g]))
            else:  # each task's own steps are added up; no running sum is taken off another
                x, ends = np.append(number(a), 0.0), np.stack([begin[g] + 1, last + 1], axis=1)
                out[a] = np.where(begin[g] < last, np.add.reduceat(x, ends.ravel())[::2], 0.0)
        return pa.table(out), first

    schema = ", ".join([*(f"{k} string" for k in KEYS), "task bigint, rows bigint, t bigint, l_t bigint", *(f"{c} {kind}" for c, kind in plain.items()), *(f"{a} double" for a in place.values())])
    x = map_parts(b, KEYS, ORDER, part, schema, most=most, placed=True)
    inside = F.coalesce(F.col("l_t") >= F.col("task"), F.lit(False))
    x = x.withColumns({n: F.when(inside, F.col(n)) for n, (ok, _) in single.items() if ok.startswith("edge")}).withColumns(cols)
    late = F.col("task") + us - F.col("t")
    fresh = late <= AGE
    x = x.select(*KEYS, "task", "rows", F.when(fresh, late / 1e6).alias("source_age"), *(F.when(fresh, F.col(n)).alias(n) for n in (*single, *forms)))
    return x.withColumns({n: F.col(a) * F.col(c) for n, (a, c) in CROSS.items()})


