"""Windowed factors as formulas over a few primitives of a time window of one dependency group.

A formula is SQL text with primitives in braces, of expressions over the columns of the row lens:
``{sum:x}`` over the window's steps (the first row has none), ``{peak:x}`` the greatest of the steps, ``{first:x} {max:x} {min:x}`` over its
rows, ``{cov}`` seconds covered, ``{n}`` steps, ``{drawdown:x} {runup:x}``, ``{turns:x} {tail:x}`` of the steps' non-zero signs (changes
between neighbours; signed length of the last run). Other names are columns of the current row. ``mean`` weighs the state before each
step by the step's duration, so that the current row has no weight.
"""

from __future__ import annotations

from tickweave.functions import div, flag, ratio, when


def mean(x: str) -> str:
    return "({sum:(" + x + ") * dt} / nullif({cov}, 0))"


def std(x: str) -> str:
    m = mean(x)
    var = f"({mean(f'({x}) * ({x})')} - {m} * {m})"
    return f"(CASE WHEN {var} > 1e-12 * {m} * {m} THEN sqrt(greatest({var}, 0.0)) WHEN {var} IS NOT NULL THEN 0.0 END)"


def slope(x: str) -> str:
    """Weighted slope of the states before each step on time; three steps at least."""
    s = "(l_t / 1e6)"
    mt = mean(s)
    top = f"({mean(f'({x}) * {s}')} - {mt} * {mean(x)})"
    return f"(CASE WHEN {{n}} >= 3 THEN {top} / nullif(greatest({mean(f'{s} * {s}')} - {mt} * {mt}, 0.0), 0) END)"


def corr(x: str, y: str) -> str:
    """Weighted correlation of two step values; eight steps at least, null where either does not vary."""
    sx, sy = mean(x), mean(y)
    vx, vy = f"({mean(f'({x}) * ({x})')} - {sx} * {sx})", f"({mean(f'({y}) * ({y})')} - {sy} * {sy})"
    cov = f"({mean(f'({x}) * ({y})')} - {sx} * {sy})"
    return f"(CASE WHEN {{n}} >= 8 AND {vx} > 1e-9 + 1e-12 * {sx} * {sx} AND {vy} > 1e-9 + 1e-12 * {sy} * {sy} THEN greatest(-1.0, least(1.0, {cov} / nullif(sqrt(greatest({vx}, 0.0) * greatest({vy}, 0.0)), 0))) END)"


#: (group, family, stem) -> (formula, status where a usable window has no value).
WINDOWED: dict[tuple[str, str, str], tuple[str, str]] = {}


def _add(group: str, family: str, stem: str, formula: str, missing: str = "ZERO_DENOM") -> None:
    WINDOWED[group, family, stem] = (formula, missing)


# book
_add("book", "A01", "SpreadMean", mean("l_spread"))
_add("book", "A01", "SpreadMax", "{max:spread}")
_add("book", "A01", "WideSpreadShare", mean(flag("l_spread > 1")))
for _s, _d in (("Bid", "db"), ("Ask", "da")):
    _add("book", "B06", f"{_s}UpRate", div(f"{{sum:{flag(f'{_d} > 0')}}}", "{cov}"))
    _add("book", "B06", f"{_s}DownRate", div(f"{{sum:{flag(f'{_d} < 0')}}}", "{cov}"))
    _add("book", "B08", f"{_s}RV", f"sqrt({div(f'{{sum:{_d} * {_d}}}', '{cov}')})")
_add("book", "B06", "UpDifference", div("{sum:" + flag("db > 0") + " - " + flag("da > 0") + "}", "{cov}"))
_add("book", "B06", "DownDifference", div("{sum:" + flag("da < 0") + " - " + flag("db < 0") + "}", "{cov}"))
_add("book", "B08", "RVDifference", f"(sqrt({div('{sum:db * db}', '{cov}')}) - sqrt({div('{sum:da * da}', '{cov}')}))")
_any = "{sum:" + flag("db <> 0 OR da <> 0") + "}"
_add("book", "B08", "CoShare", ratio("{sum:" + flag("db * da > 0") + "}", _any))
_add("book", "B08", "OppositeShare", ratio("{sum:" + flag("db * da < 0") + "}", _any))
_add("book", "B08", "SingleShare", ratio("{sum:" + flag("(db = 0 AND da <> 0) OR (db <> 0 AND da = 0)") + "}", _any))
# queue
_add("queue", "A02", "DepthMean", mean("l_depth"))
_add("queue", "A02", "DepthCV", div(std("l_depth"), mean("l_depth")))
_add("queue", "A02", "DepthLogRatio", f"ln(depth / nullif({mean('l_depth')}, 0))")
_add("queue", "A03", "QIMean", mean("l_qi"))
_add("queue", "A03", "QIStd", std("l_qi"))
_add("queue", "A04", "QIDeviation", f"(qi - {mean('l_qi')})")
_add("queue", "A04", "QISlope", slope("l_qi"), "NOT_ENOUGH_EVENTS")
_add("queue", "A05", "BuyShare", mean(flag("l_qstate = 1")))
_add("queue", "A05", "SellShare", mean(flag("l_qstate = -1")))
_add("queue", "A05", "SwitchRate", div("{sum:" + flag("qstate <> l_qstate") + "}", "{cov}"))
_add("queue", "B01", "MeanQueueImbalance", div(f"{mean('l_qb')} - {mean('l_qa')}", f"({mean('l_qb')} + {mean('l_qa')})"))
for _s, _q in (("Bid", "l_qb"), ("Ask", "l_qa")):
    _add("queue", "B01", f"{_s}Mean", mean(_q))
    _add("queue", "B02", f"{_s}CV", div(std(_q), mean(_q)))
    _add("queue", "B03", f"{_s}Slope", slope(f"ln({_q})"), "NOT_ENOUGH_EVENTS")
_add("queue", "B02", "CVDifference", f"({div(std('l_qb'), mean('l_qb'))} - {div(std('l_qa'), mean('l_qa'))})")
_add("queue", "B03", "SlopeDifference", f"({slope('ln(l_qb)')} - {slope('ln(l_qa)')})", "NOT_ENOUGH_EVENTS")
# position
_add("position", "A06", "PositionMean", mean("l_position"))
_add("position", "A06", "PositionAbsMean", mean("abs(l_position)"))
_add("position", "A06", "PositionDeviation", f"(position - {mean('l_position')})")
# ofi
_add("ofi", "F03", "OFI", "{sum:ofi}")
_add("ofi", "F03", "NOFI", div("{sum:ofi}", mean("l_depth")))
_add("ofi", "A07", "OFIDirection", ratio("{sum:ofi}", "{sum:abs(ofi)}"))
_add("ofi", "A07", "OFIActivity", div("{sum:abs(ofi)}", "{sum:l_depth * dt}"))
_add("ofi", "A07", "OFIRate", div("{sum:ofi}", "{sum:l_depth * dt}"))
_add("ofi", "A08", "OFIPulse", ratio("{peak:abs(ofi)}", "{sum:abs(ofi)}"))
for _s, _q, _p in (("Bid", "qb", "b"), ("Ask", "qa", "a")):
    _same = f"{_p} = l_{_p}"
    _add("ofi", "B04", f"{_s}Addition", div("{sum:" + when(_same, f"greatest({_q} - l_{_q}, 0.0)") + "}", f"{{sum:l_{_q} * dt}}"))
    _add("ofi", "B05", f"{_s}Depletion", div("{sum:" + when(_same, f"greatest(l_{_q} - {_q}, 0.0)") + "}", f"{{sum:l_{_q} * dt}}"))
    _add("ofi", "B04", f"{_s}SameShare", mean(flag(_same)))
    _add("ofi", "B04", f"{_s}SameCount", "{sum:" + flag(_same) + "}")
_of = lambda side, stem: WINDOWED["ofi", *(("B04", f"{side}Addition") if stem == "A" else ("B05", f"{side}Depletion"))][0]
_add("ofi", "B04", "AdditionDifference", f"({_of('Bid', 'A')} - {_of('Ask', 'A')})")
_add("ofi", "B05", "DepletionDifference", f"({_of('Ask', 'D')} - {_of('Bid', 'D')})")
# price; deviations from the segment's first price keep squares small
_add("price", "F05", "Momentum", "(p - {first:p})")
_add("price", "F06", "PathEfficiency", "(CASE WHEN {sum:abs(dp)} > 0 THEN (p - {first:p}) / nullif({sum:abs(dp)}, 0) ELSE 0.0 END)")
_add("price", "C01", "PriceRV", f"sqrt({div('{sum:dp * dp}', '{cov}')})")
_add("price", "C01", "PriceAV", div("{sum:abs(dp)}", "{cov}"))
_up, _down = "{sum:" + when("dp > 0", "dp * dp") + "}", "{sum:" + when("dp < 0", "dp * dp") + "}"
_add("price", "C02", "UpSquares", _up)
_add("price", "C02", "DownSquares", _down)
_add("price", "C02", "TotalSquares", f"({_up} + {_down})")
_add("price", "C02", "Asymmetry", ratio(f"{_up} - {_down}", f"({_up} + {_down})"))
_add("price", "C03", "Range", "({max:p} - {min:p})")
_add("price", "C03", "Location", ratio("2 * p - {max:p} - {min:p}", "({max:p} - {min:p})"))
_add("price", "C04", "Drawdown", "{drawdown:p}")
_add("price", "C04", "Runup", "{runup:p}")
_nu, _nd, _nz = ("{sum:" + flag(f"dp {o} 0") + "}" for o in (">", "<", "="))
_add("price", "C05", "MoveRate", div(f"{_nu} + {_nd}", "{cov}"))
_add("price", "C05", "CountImbalance", ratio(f"{_nu} - {_nd}", f"({_nu} + {_nd})"))
_add("price", "C05", "ZeroCountShare", div(_nz, "{n}"))
_add("price", "C05", "ZeroTimeShare", mean(flag("dp = 0")))
_add("price", "C05", "UpCount", _nu)
_add("price", "C05", "DownCount", _nd)
_add("price", "C05", "ZeroCount", _nz)
_add("price", "C06", "NonzeroCount", f"({_nu} + {_nd})")
_add("price", "C06", "ReversalShare", f"(CASE WHEN {_nu} + {_nd} >= 2 THEN {{turns:sign(dp)}} / nullif({_nu} + {_nd} - 1, 0) END)", "NOT_ENOUGH_EVENTS")
_add("price", "C06", "RunCount", "abs(nullif({tail:sign(dp)}, 0))", "NOT_ENOUGH_EVENTS")
_add("price", "C06", "SignedRun", "nullif({tail:sign(dp)}, 0)", "NOT_ENOUGH_EVENTS")
_add("price", "M01", "MADeviation", f"(p - {mean('l_p')})")
_add("price", "M03", "StandardDeviation", ratio(f"p - {mean('l_p')}", std("l_z")), "ZERO_VARIANCE")
_add("price", "M11", "TrendSlope", slope("l_z"), "NOT_ENOUGH_EVENTS")
_add("price", "M11", "TrendResidual", f"(z - ({mean('l_z')} + {slope('l_z')} * (t / 1e6 - {mean('(l_t / 1e6)')})))", "NOT_ENOUGH_EVENTS")
_add("price", "R06", "price_MoveCount", f"({_nu} + {_nd})")
# volume
_add("volume", "D01", "VolumeTotal", "{sum:dv}")
_add("volume", "D01", "VolumeRate", div("{sum:dv}", "{cov}"))
_vsd = "sqrt(greatest({sum:dv * dv / nullif(dt, 0)} / nullif({cov}, 0) - ({sum:dv} / nullif({cov}, 0)) * ({sum:dv} / nullif({cov}, 0)), 0.0))"
_add("volume", "D02", "RateStd", _vsd)
_add("volume", "D02", "RateCV", ratio(_vsd, div("{sum:dv}", "{cov}")))
_add("volume", "D02", "LatestRateRatio", ratio("dv / nullif(dt, 0)", div("{sum:dv}", "{cov}")))
_add("volume", "D04", "ZeroVolumeTimeShare", mean(flag("dv = 0")))
_add("volume", "R06", "volume_PositiveCount", "{sum:" + flag("dv > 0") + "}")
# price and volume
_add("price_volume", "F08", "SignedVolume", ratio("{sum:sign(p - l_p) * dv}", "{sum:dv}"))
_add("price_volume", "D04", "UnchangedPriceVolumeShare", ratio("{sum:" + when("p = l_p", "dv") + "}", "{sum:dv}"))
_add("price_volume", "D08", "MovePerVolume", ratio("{sum:abs(p - l_p)}", "{sum:dv}"))
_add("price_volume", "M10", "VWDeviation", "(p - " + ratio("{sum:dv * p}", "{sum:dv}") + ")")
_add("price_volume", "D09", "SyncPairCount", "{n}")
_add("price_volume", "D09", "SignedVolumeCorr", corr("(p - l_p) / nullif(dt, 0)", "dv / nullif(dt, 0)"), "ZERO_VARIANCE")
_add("price_volume", "D09", "AbsoluteVolumeCorr", corr("abs(p - l_p) / nullif(dt, 0)", "dv / nullif(dt, 0)"), "ZERO_VARIANCE")
# joint groups
_add("volume_depth", "D05", "VolumeDepthRate", div("{sum:dv}", "{sum:l_depth * dt}"))
_add("volume_depth", "D06", "PreQIVolume", ratio("{sum:dv * l_qi}", "{sum:dv}"))
_add("price_ofi", "D07", "UnchangedPriceOFIRate", div("{sum:" + when("p = l_p", "ofi") + "}", "{sum:l_depth * dt}"))

#: Row factors: (family, stem) -> (group, needs a legal step, formula).
ROW: dict[tuple[str, str], tuple[str, bool, str]] = {
    ("F01", "QI"): ("queue", False, "qi"),
    ("F02", "QIChange"): ("queue", True, "qi - l_qi"),
    ("F03", "OFI_latest"): ("ofi", True, "ofi"),
    ("F03", "NOFI_latest"): ("ofi", True, "ofi / ((depth + l_depth) / 2)"),
    ("F04", "QuoteShift"): ("book", True, "(a - l_a + b - l_b) / 2"),
    ("F05", "LastChange"): ("price", True, "p - l_p"),
    ("F07", "QuotePosition"): ("position", False, "position"),
    ("A01", "Spread"): ("book", False, "spread"),
    ("A01", "SpreadChange"): ("book", True, "spread - l_spread"),
    ("A02", "Depth"): ("queue", False, "depth"),
    ("A05", "QIState"): ("queue", False, "qstate"),
}

#: Events whose age is measured: prefix -> (group, condition on a legal step).
AGES = {
    "A05_StateAge": ("queue", "qstate <> l_qstate"),
    "B07_BidAge": ("book", "b <> l_b"),
    "B07_AskAge": ("book", "a <> l_a"),
    "C07_PriceAge": ("price", "p <> l_p"),
    "D04_VolumeAge": ("volume", "dv > 0"),
}

#: Adjacent segments of ``lag`` seconds, recent less earlier: stem -> (family, group, formula of one segment, how they combine).
SEGMENTS = {
    "MomentumSpeedChange": ("C08", "price", div("p - {first:p}", "{cov}"), "difference"),
    "RVChange": ("R05", "price", f"sqrt({div('{sum:dp * dp}', '{cov}')})", "difference"),
    "OFIRateChange": ("A08", "ofi", div("{sum:ofi}", "{sum:l_depth * dt}"), "difference"),
    "VolumeRateChange": ("D03", "volume", div("{sum:dv}", "{cov}"), "difference"),
    "VolumeRateImbalance": ("D03", "volume", div("{sum:dv}", "{cov}"), "imbalance"),
    "DepthChange": ("R05", "queue", mean("l_depth"), "difference"),
}


def windowed(family: str | None = None, stem: str | None = None) -> list[tuple[str, str, str]]:
    """Keys of WINDOWED of a family or stem."""
    return [k for k in WINDOWED if family in (None, k[1]) and stem in (None, k[2])]
