"""Causal time-window factors over the row lens: window functions in one partitioning, values with their status."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.catalog import AGES, ROW, SEGMENTS, WINDOWED
from tickweave.operators.lens import KEYS, ORDER

PRIMITIVE = re.compile(r"\{(\w+)(?::((?:[^{}])*))?\}")
SECOND = 1_000_000


def _frame(group: str, h: float) -> Window:
    return Window.partitionBy(*KEYS, f"seg_{group}").orderBy("t").rangeBetween(-int(h * SECOND), 0)


#: Primitives over the steps of a window. A step's value is kept at the row that it leads from, so that the rows before the current one hold
#: exactly the window's steps and nothing has to be taken off a running sum.
STEPS = ("sum", "peak", "turns", "tail")


def _primitive(op: str, x: str | None, group: str, h: float) -> Column:
    w = _frame(group, h)
    if op == "n":
        return (F.count("t").over(w) - 1).cast("double")
    if op == "cov":
        return (F.col("t") - F.first("t").over(w)) / 1e6
    if op in ("first", "max", "min"):
        return getattr(F, op)(F.expr(x)).over(w)
    before = Window.partitionBy(*KEYS, f"seg_{group}").orderBy("t").rangeBetween(-int(h * SECOND), -1)
    if op == "sum":
        return F.coalesce(F.sum(x).over(before), F.lit(0.0))
    if op == "peak":
        return F.max(x).over(before)
    if op in ("drawdown", "runup"):
        listed = F.collect_list(F.expr(x)).over(w)
        far, of = (F.greatest, lambda best, v: best - v) if op == "drawdown" else (F.least, lambda best, v: v - best)
        start = F.struct(F.try_element_at(listed, F.lit(1)).alias("best"), F.lit(0.0).alias("move"))
        return F.aggregate(listed, start, lambda s, v: F.struct(far(s["best"], v).alias("best"), F.greatest(s["move"], of(far(s["best"], v), v)).alias("move")), lambda s: s["move"])
    signs = F.filter(F.collect_list(x).over(before), lambda v: v != 0)
    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("turns"))
    walk = F.aggregate(signs, start, lambda s, v: F.struct(v.alias("last"), F.when(s["last"] == v, s["run"] + v).otherwise(v).alias("run"), (s["turns"] + F.when(s["last"] * v < 0, 1.0).otherwise(0.0)).alias("turns")))
    return walk["run"] if op == "tail" else walk["turns"]


def add_formulas(q: DataFrame, formulas: dict[str, tuple[str, str, float]], usable: bool = True) -> DataFrame:
    """``q`` with a column per name -> (group, formula, seconds): its value where the window is usable (80 % covered), else null."""
    place: dict[tuple, str] = {}

    def name(m: re.Match, group: str, h: float) -> str:
        return place.setdefault((m[1], m[2], group, h), f"_w{len(place)}")

    finals = {}
    for out, (group, formula, h) in formulas.items():
        cov = place.setdefault(("cov", None, group, h), f"_w{len(place)}")
        text = PRIMITIVE.sub(lambda m: name(m, group, h), formula)
        ok = f"valid_{group} AND {cov} > 0 AND {cov} >= {0.8 * h}" if usable else f"valid_{group}"
        finals[out] = F.expr(f"CASE WHEN {ok} THEN {text} END")
    if any(k[1] and re.search(r"\bl_z\b", k[1]) for k in place) and "z" not in q.columns:
        base = Window.partitionBy(*KEYS, "seg_price").orderBy("t")
        q = q.withColumn("z", F.col("p") - F.first("p").over(base)).withColumn("l_z", F.lag("z").over(base))
    led: dict[tuple, str] = {}
    for op, x, g, _ in place:
        if op in STEPS:
            led.setdefault((x, g), f"_s{len(led)}")
    if led:
        q = q.withColumns({a: F.lead(F.expr(f"CAST({x} AS DOUBLE)")).over(Window.partitionBy(*KEYS, f"seg_{g}").orderBy("t")) for (x, g), a in led.items()})
    q = q.withColumns({alias: _primitive(op, led[x, g] if op in STEPS else x, g, h) for (op, x, g, h), alias in place.items()})
    return q.withColumns(finals).drop(*place.values(), *led.values())


def _status(q: DataFrame, value: str, group: str, h: float | None, missing: str) -> Column:
    s = F.when(~F.col(f"valid_{group}"), "INVALID_INPUT")
    if h is None:
        return s.when(F.col(value).isNull(), missing).otherwise("ok")
    cov = F.col("t") - F.first("t").over(_frame(group, h))
    return s.when(cov <= 0, "NO_COVERAGE").when(cov * 10 < int(8 * h * SECOND), "WARMUP").when(F.col(value).isNull(), missing).otherwise("ok")


def window_factors(q: DataFrame, keys: Iterable[tuple[str, str, str]], histories: Sequence[int] = (5, 10), status: bool = True) -> DataFrame:
    """(keys, snap_id, t, values, statuses) of windowed factors ``<family>_<stem>_h<h>s``.

    A value is null unless its status is ok: INVALID_INPUT (the row is not valid for the factor's group), NO_COVERAGE, WARMUP (less than 80 %
    of the history is covered without a gap), or the factor's own reason.
    """
    keys = list(keys)
    names = {f"{f}_{s}_h{h}s": (g, WINDOWED[g, f, s][0], h) for g, f, s in keys for h in histories}
    x = add_formulas(q, names)
    if status:
        x = x.withColumns({f"{f}_{s}_h{h}s__status": _status(x, f"{f}_{s}_h{h}s", g, h, WINDOWED[g, f, s][1]) for g, f, s in keys for h in histories})
    return x.select(*KEYS, "snap_id", "t", *names, *(f"{n}__status" for n in names if status))


def row_factors(q: DataFrame) -> DataFrame:
    """Factors of a row and its step from the row before, with statuses; a row without a legal step has NO_HISTORY."""
    x = q.withColumns({f"{f}_{s}": F.expr(f"CASE WHEN {'edge' if step else 'valid'}_{g} THEN {e} END") for (f, s), (g, step, e) in ROW.items()})
    x = x.withColumns({f"{f}_{s}__status": _status(x, f"{f}_{s}", g, None, "NO_HISTORY") for (f, s), (g, _, _) in ROW.items()})
    names = [f"{f}_{s}" for f, s in ROW]
    return x.select(*KEYS, "snap_id", "t", *names, *(f"{n}__status" for n in names))


def age_factors(q: DataFrame) -> DataFrame:
    """Seconds since the last event in the row's segment, its lower bound (since the segment's start where there was none) and whether it is
    left-censored; status LEFT_CENSORED where no event was seen."""
    cols = {}
    for prefix, (g, event) in AGES.items():
        w = Window.partitionBy(*KEYS, f"seg_{g}").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.expr(f"CASE WHEN edge_{g} AND {event} THEN t END"), ignorenulls=True).over(w)
        valid = F.col(f"valid_{g}")
        cols[prefix] = F.when(valid, (F.col("t") - last) / 1e6)
        cols[f"{prefix}LowerBound"] = F.when(valid, (F.col("t") - F.coalesce(last, F.first("t").over(w))) / 1e6)
        cols[f"{prefix}LeftCensored"] = F.when(valid, F.when(last.isNull(), 1.0).otherwise(0.0))
    x = q.withColumns(cols).withColumn("B07_AgeDifference", F.col("B07_BidAge") - F.col("B07_AskAge"))
    status = {f"{p}__status": _status(x, p, g, None, "LEFT_CENSORED") for p, (g, _) in AGES.items()}
    return x.withColumns(status).select(*KEYS, "snap_id", "t", *cols, "B07_AgeDifference", *status)


def segment_factors(q: DataFrame, lags: Sequence[int] = (2, 5)) -> DataFrame:
    """Change between two adjacent segments of ``lag`` seconds: the window up to the row, and the one up to that window's first row."""
    stage = {}
    for stem, (_, g, formula, _) in SEGMENTS.items():
        for lag in lags:
            stage[f"_v_{stem}_{lag}"] = (g, formula, lag)
    x = add_formulas(q, stage)
    out = {}
    for stem, (family, g, _, how) in SEGMENTS.items():
        for lag in lags:
            now, then = F.col(f"_v_{stem}_{lag}"), F.first(f"_v_{stem}_{lag}").over(_frame(g, lag))
            change = now - then
            out[f"{family}_{stem}_lag{lag}s"] = change if how == "difference" else F.when(now + then > 0, F.try_divide(change, now + then))
    return x.withColumns(out).select(*KEYS, "snap_id", "t", *out)


def opening_factors(q: DataFrame) -> DataFrame:
    """Position against the session so far: move, extremes, prior extremes and new ones, time- and volume-weighted means over legal steps."""
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    pv = F.when(F.col("valid_price"), F.col("p"))
    total = lambda c, e: F.sum(F.when(F.col(f"edge_{e}"), F.expr(c))).over(upto)
    x = q.withColumns({
        "_first": F.first(pv, ignorenulls=True).over(upto), "_hi": F.max(pv).over(upto), "_lo": F.min(pv).over(upto), "_phi": F.max(pv).over(before), "_plo": F.min(pv).over(before),
        "_pt": total("l_p * dt", "price"), "_tt": total("dt", "price"), "_pv": total("p * dv", "price_volume"), "_vv": total("dv", "price_volume"),
    })
    f = {
        "R01_OpeningMove": "p - _first", "R02_DistanceHigh": "p - _hi", "R02_DistanceLow": "p - _lo", "R02_OpeningRange": "_hi - _lo", "R02_OpeningLocation": "CASE WHEN _hi > _lo THEN (2 * p - _hi - _lo) / nullif(_hi - _lo, 0) END",
        "R03_PriorHighDistance": "p - _phi", "R03_PriorLowDistance": "p - _plo", "R03_NewHigh": "CASE WHEN p > _phi THEN 1.0D WHEN _phi IS NOT NULL THEN 0.0D END", "R03_NewLow": "CASE WHEN p < _plo THEN 1.0D WHEN _plo IS NOT NULL THEN 0.0D END",
        "M02_OpeningMADeviation": "p - _pt / nullif(_tt, 0)",
    }
    x = x.withColumns({k: F.expr(f"CASE WHEN valid_price THEN {e} END") for k, e in f.items()})
    x = x.withColumn("M10_OpeningVWDeviation", F.expr("CASE WHEN valid_price_volume AND _vv > 0 THEN p - _pv / nullif(_vv, 0) END"))
    return x.select(*KEYS, "snap_id", "t", *f, "M10_OpeningVWDeviation")


def quality_factors(q: DataFrame, group: str, histories: Sequence[int] = (5, 10)) -> DataFrame:
    """What each window of a group rests on: coverage, rows, warm-up, steps, longest step, a gap in the nominal window; and since the open."""
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v, e, seg = F.col(f"valid_{group}"), F.col(f"edge_{group}"), Window.partitionBy(*KEYS, f"seg_{group}").orderBy("t")
    names, x = [], q
    for h in histories:
        x = add_formulas(x, {f"_cov{h}": (group, "{cov}", h), f"_n{h}": (group, "{n}", h), f"_gap{h}": (group, "{peak:dt}", h)}, usable=False)
        nominal = Window.partitionBy(*KEYS).orderBy("t").rangeBetween(-h * SECOND, 0)
        steps = F.sum(F.when(e, 1).otherwise(0)).over(nominal) - F.when(F.first(e).over(nominal), 1).otherwise(0)
        pre = f"R06_{group}_"
        cols = {
            f"{pre}Coverage_h{h}s": F.col(f"_cov{h}"), f"{pre}Count_h{h}s": F.when(v, F.col(f"_n{h}") + 1).otherwise(0.0), f"{pre}Warmup_h{h}s": F.when(v & (F.col(f"_cov{h}") > 0) & (F.col(f"_cov{h}") >= 0.8 * h), 0.0).otherwise(1.0),
            f"{pre}CoverageRatio_h{h}s": F.col(f"_cov{h}") / h, f"{pre}StartSeconds_h{h}s": F.when(v, F.col("t") / 1e6 - F.col(f"_cov{h}")), f"{pre}EndSeconds_h{h}s": F.when(v, F.col("t") / 1e6), f"{pre}IncrementCount_h{h}s": F.when(v, F.col(f"_n{h}")).otherwise(0.0),
            f"{pre}MaxInterval_h{h}s": F.when(F.col(f"_n{h}") > 0, F.col(f"_gap{h}")), f"{pre}GapFlag_h{h}s": F.when(F.bool_and(v).over(nominal) & (steps == F.count("*").over(nominal) - 1), 0.0).otherwise(1.0),
        }
        x = x.withColumns(cols)
        names += list(cols)
    breaks = F.sum(F.when(v & ~e, 1).otherwise(0)).over(upto) - 1
    pre = f"R06_{group}_"
    cols = {
        f"{pre}SegmentAge": F.when(v, (F.col("t") - F.first("t").over(seg)) / 1e6), f"{pre}OpeningCoverage": F.coalesce(F.sum(F.when(e, F.col("dt"))).over(upto), F.lit(0.0)),
        f"{pre}StartDelay": F.first(F.when(v, F.col("t") / 1e6), ignorenulls=True).over(upto), f"{pre}GapCount": F.greatest(breaks, F.lit(0)).cast("double"),
    }
    x = x.withColumns(cols).withColumn(f"{pre}OpeningCoverageRatio", F.when(F.col("t") > 0, F.col(f"{pre}OpeningCoverage") / (F.col("t") / 1e6)))
    return x.select(*KEYS, "snap_id", "t", *names, *cols, f"{pre}OpeningCoverageRatio")


def mean_state_factors(q: DataFrame, h: int = 5, outer: int = 5) -> DataFrame:
    """Factors of the deviation from the moving mean over an outer window: states, ages, crossings, shares, spread, and speeds over 2 s.

    Rows with a deviation that follow each other by legal steps form islands. A crossing is a change between above and below, whatever
    flat rows lie between. Speeds compare with the last row at least 2 s and at most 2.5 s before in the same island.
    """
    d = add_formulas(q, {"m": ("price", WINDOWED["price", "M01", "MADeviation"][0], h), "ma": ("price", "({sum:l_p * dt} / nullif({cov}, 0))", h)})
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    d = d.withColumn("lm", F.lag("m").over(w)).withColumn("edge_m", F.col("edge_price") & F.col("m").isNotNull() & F.col("lm").isNotNull())
    d = d.withColumn("valid_m", F.col("m").isNotNull()).withColumn("seg_m", F.sum(F.when(F.col("edge_m"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    i = Window.partitionBy(*KEYS, "seg_m").orderBy("t")
    upto = i.rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("m") > 0.5, 1.0).when(F.col("m") < -0.5, -1.0).otherwise(0.0)
    d = d.withColumn("state", F.when(F.col("valid_m"), state))
    d = d.withColumn("l_state", F.when(F.col("edge_m"), F.lag("state").over(i)))
    d = d.withColumn("l_side", F.last(F.expr("nullif(state, 0)"), ignorenulls=True).over(i.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumns({"up": F.when((F.col("state") == 1) & (F.col("l_side") == -1), 1.0).otherwise(0.0), "down": F.when((F.col("state") == -1) & (F.col("l_side") == 1), 1.0).otherwise(0.0)})
    d = d.withColumns({"changed": F.last(F.expr("CASE WHEN state <> l_state THEN t END"), ignorenulls=True).over(upto), "crossed": F.last(F.expr("CASE WHEN up + down > 0 THEN t END"), ignorenulls=True).over(upto), "began": F.first("t").over(i)})
    s = f"_h{h}s_g{outer}s"
    mean = lambda x: "({sum:" + x + " * dt} / nullif({cov}, 0))"
    forms = {
        f"M07_AboveShare{s}": mean("(CASE WHEN l_state = 1 THEN 1.0 ELSE 0.0 END)"), f"M07_BelowShare{s}": mean("(CASE WHEN l_state = -1 THEN 1.0 ELSE 0.0 END)"), f"M08_CrossUpRate{s}": "({sum:up} / nullif({cov}, 0))", f"M08_CrossDownRate{s}": "({sum:down} / nullif({cov}, 0))",
        f"M09_AbsDeviationMean{s}": mean("abs(lm)"), f"M09_DeviationStd{s}": f"sqrt(greatest({mean('lm * lm')} - {mean('lm')} * {mean('lm')}, 0.0))", f"M09_MaxPositive{s}": "greatest({max:m}, 0.0)", f"M09_MinNegative{s}": "least({min:m}, 0.0)",
    }
    d = add_formulas(d, {k: ("m", f, outer) for k, f in forms.items()})
    age = lambda c: F.when(F.col("valid_m"), (F.col("t") - F.col(c)) / 1e6)
    cols = {f"M07_MeanState{s}": F.col("state"), f"M07_MeanStateAge{s}": age("changed"), f"M08_CrossAge{s}": age("crossed")}
    for p, c in (("M07_MeanStateAge", "changed"), ("M08_CrossAge", "crossed")):
        cols[f"{p}LowerBound{s}"] = F.when(F.col("valid_m"), (F.col("t") - F.coalesce(c, "began")) / 1e6)
        cols[f"{p}LeftCensored{s}"] = F.when(F.col("valid_m"), F.when(F.col(c).isNull(), 1.0).otherwise(0.0))
    cov = (F.col("t") - F.first("t").over(i.rangeBetween(-outer * SECOND, 0))) / 1e6
    cols[f"R06_DerivedCoverage{s}"] = F.when(F.col("valid_m"), cov)
    old = i.rangeBetween(-int(2.5 * SECOND), -2 * SECOND)
    then = {c: F.last(c).over(old) for c in ("t", "m", "ma")}
    lag = f"_h{h}s_lag2s"
    took = (F.col("t") - then["t"]) / 1e6
    cols |= {f"M04_DeviationSpeed{lag}": F.when(F.col("valid_m"), (F.col("m") - then["m"]) / took), f"M04_AbsDeviationSpeed{lag}": F.when(F.col("valid_m"), (F.abs("m") - F.abs(then["m"])) / took), f"M05_MeanSpeed{lag}": F.when(F.col("valid_m"), (F.col("ma") - then["ma"]) / took)}
    return d.withColumns(cols).select(*KEYS, "snap_id", "t", *forms, *cols)
