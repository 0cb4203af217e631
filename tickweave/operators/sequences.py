"""Factors that need a row's own past in order: weighted percentiles of history, queue recovery, lagged correlation. Arrow passes per session."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.catalog import WINDOWED
from tickweave.operators.factors import add_formulas
from tickweave.operators.lens import KEYS, ORDER
from tickweave.runtime import map_groups, same_key

HOLD = 2_000_000
LATE = 500_000
SPAN = 10_000_000


def _starts(table: pa.Table) -> np.ndarray:
    return np.r_[np.flatnonzero(~same_key(table, KEYS)), table.num_rows]


def _numbers(table: pa.Table, names) -> dict[str, np.ndarray]:
    return {n: table.column(n).to_numpy(zero_copy_only=False).astype(float) if pa.types.is_floating(table.column(n).type) else table.column(n).to_numpy(zero_copy_only=False) for n in names}


def history_percentiles(q: DataFrame, h: int = 5, most: int = 40_000) -> DataFrame:
    """(keys, snap_id, t, R04_*): a row's spread, depth, volume rate and price variation against the session's history so far.

    History is the state before each legal step, weighted by the step's duration; the percentile counts ties half. Difference, log ratio or
    ratio to the weighted mean beside it; null where the row has no value or there is no history. A session in parts hands on the weight of
    each value of its past.
    """
    x = add_formulas(q, {"vr": ("volume", WINDOWED["volume", "D01", "VolumeRate"][0], h), "rv": ("price", WINDOWED["price", "C01", "PriceRV"][0], h)})
    x = x.select(*KEYS, *ORDER, "dt", F.when(F.col("valid_book"), F.col("spread")).alias("spread"), F.when(F.col("valid_queue"), F.col("depth")).alias("depth"), "vr", "rv", "edge_book", "edge_queue", "edge_volume", "edge_price")
    states = (("Spread", "spread", "edge_book", "Difference", ""), ("Depth", "depth", "edge_queue", "LogRatio", ""), ("VolumeRate", "vr", "edge_volume", "Ratio", f"_h{h}s"), ("PriceRV", "rv", "edge_price", "Ratio", f"_h{h}s"))

    none = np.zeros(0), np.zeros(0)

    def scan(table: pa.Table, lo: int, hi: int, state: dict) -> pa.Table:
        c = _numbers(table, ("dt", "spread", "depth", "vr", "rv", "edge_book", "edge_queue", "edge_volume", "edge_price"))
        out = {f"R04_{n}{k}{s}": np.full(table.num_rows, np.nan) for n, _, _, how, s in states for k in (how, "Percentile")}
        edges = _starts(table)
        for a, b in zip(edges, edges[1:]):
            new = lo if a == 0 else 0  # the first row whose step is not in the history handed on
            for n, v, e, how, s in states:
                x, step = c[v][a:b], np.flatnonzero(c[e][a:b].astype(bool))
                step = step[(step > 0) & (step >= new)]
                past, w = x[step - 1], c["dt"][a:b][step]
                ok = ~np.isnan(past)
                past, w, step = past[ok], w[ok], step[ok]
                old, weight = state.get(n, none) if new else none
                if hi < table.num_rows:  # the session goes on
                    kept = step < hi
                    values, at = np.unique(np.r_[old, past[kept]], return_inverse=True)
                    state[n] = values, np.bincount(at, np.r_[weight, w[kept]], len(values))
                if not len(step) and not len(old):
                    continue
                upto = np.searchsorted(step, np.arange(b - a), side="right")
                total = (np.r_[0, np.cumsum(w)] + weight.sum())[upto]
                mean = np.divide((np.r_[0, np.cumsum(w * past)] + weight @ old)[upto], total, out=np.full(b - a, np.nan), where=total > 0)
                heavy = np.r_[0, np.cumsum(weight)]
                before = (heavy[np.searchsorted(old, x, side="left")] + heavy[np.searchsorted(old, x, side="right")]) / 2
                for p in range(0, b - a, 512):  # blocks of rows, so that a long session does not need a square of memory
                    rows = slice(p, min(p + 512, b - a))
                    seen = np.arange(len(step))[None, :] < upto[rows, None]
                    below = (past[None, :] < x[rows, None]) + 0.5 * (past[None, :] == x[rows, None])
                    share = np.divide((below * seen) @ w + before[rows], total[rows], out=np.full(rows.stop - p, np.nan), where=total[rows] > 0)
                    out[f"R04_{n}Percentile{s}"][a + p : a + rows.stop] = np.where(np.isnan(x[rows]), np.nan, share)
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = x - mean if how == "Difference" else np.where(mean > 0, x / mean, np.nan)
                    value = np.where((value > 0), np.log(value), np.nan) if how == "LogRatio" else value
                out[f"R04_{n}{how}{s}"][a:b] = value
        cols = {k: table.column(k) for k in (*KEYS, "snap_id", "t")} | {k: pa.array(v, from_pandas=True) for k, v in out.items()}
        return pa.table(cols).slice(lo, hi - lo)

    names = [f"R04_{n}{k}{s}" for n, _, _, how, s in states for k in (how, "Percentile")]
    return map_groups(x, KEYS, ORDER, scan, ", ".join([*(f"{k} string" for k in KEYS), "snap_id bigint, t bigint", *(f"{n} double" for n in names)]), most=most)


class Clock:
    """Row numbers by time for some sessions laid end to end: times of a session follow those of the one before at a distance that no lookup spans."""

    def __init__(self, table: pa.Table, seg: np.ndarray):
        first = ~same_key(table, KEYS)
        t = table.column("t").to_numpy()
        self.far = int(t.max(initial=0)) + SPAN + HOLD + LATE + 1
        self.key = (np.cumsum(first) - 1) * self.far + t
        self.t, self.n = t, len(t)
        at = np.arange(self.n)
        self.new = first | np.r_[True, seg[1:] != seg[:-1]] if self.n else first
        self.began = np.maximum.accumulate(np.where(self.new, at, 0)) if self.n else at
        self.close = np.r_[np.flatnonzero(self.new)[1:], self.n][np.cumsum(self.new) - 1] if self.n else at
        self.last = np.r_[np.flatnonzero(first)[1:], self.n][np.cumsum(first) - 1] if self.n else at

    def after(self, i: np.ndarray, by: int) -> np.ndarray:
        """The first row ``by`` or more after each of rows ``i``; the number of rows where its session has none."""
        end = np.searchsorted(self.key, self.key[i] + by, side="left")
        return np.where(end < self.last[i], end, self.n)

    def start(self, i: np.ndarray, span: int) -> np.ndarray:
        """The first row of the segment of each of rows ``i`` within ``span`` before it."""
        return np.maximum(self.began[i], np.searchsorted(self.key, self.key[i] - span, side="left"))


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, owners) of the ranges lo <= k < hi, laid end to end."""
    n = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n), owner


def _covered(clock: Clock, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first rows of their windows) of the valid rows whose last ``SPAN`` is seen to four fifths at least."""
    i = np.flatnonzero(valid)
    s = clock.start(i, SPAN)
    ok = (clock.t[i] - clock.t[s]) * 10 >= 8 * SPAN
    return i[ok], s[ok]


def _thinned(clock: Clock, drops: np.ndarray, lo: int, before: list[int]) -> np.ndarray:
    """Drops that count: the first of a segment, and then the first at least ``HOLD`` after one that counts.

    Each drop points to the one that would count next, so that one walk along the pointers finds them. ``before`` are the times of those that
    counted among the rows before ``lo``.
    """
    old = drops[(drops < lo) & np.isin(clock.t[drops], before)] if lo else drops[:0]
    new = drops[drops >= lo]
    following = np.minimum(np.searchsorted(clock.key[new], clock.key[new] + HOLD, side="left"), np.searchsorted(new, clock.close[new], side="left")).tolist()
    k = 0
    if len(old):
        k = int(min(np.searchsorted(clock.key[new], clock.key[old[-1]] + HOLD, side="left"), np.searchsorted(new, clock.close[old[-1]], side="left")))
    walk = []
    while k < len(new):
        walk.append(k)
        k = following[k]
    return np.r_[old, new[walk]].astype(np.int64)


def queue_recovery(q: DataFrame, most: int = 400_000) -> DataFrame:
    """(keys, snap_id, t, B09_*_h10s): how queues recover from drops of a tenth or more at an unchanged quote, over the last 10 s.

    A drop holds its side for 2 s (a break in the rows frees it). It is mature once a row 2 s later is seen; then it either left its quote,
    or recovered some share of the drop. Means need three events. Whole arrays of drops and rows are looked up by time; a session in parts
    hands on its drops, as each decides where the next may be.
    """
    sides = ("Bid", "Ask")
    counts = ("MatureCount", "SameCount", "ExitCount", "SuccessCount", "ImmatureCount", "GappedCount", "UnrecoveredCount")
    means = ("Recovery", "FullShare", "SuccessTime", "ExitShare")
    names = [f"B09_{s}{k}_h10s" for s in sides for k in (*counts, *means)]
    x = q.select(*KEYS, *ORDER, "qb", "qa", "b", "a", "edge_ofi", "valid_ofi", "seg_ofi")

    def fates(clock: Clock, size: np.ndarray, quote: np.ndarray, seg: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """What became of the drops at rows ``at``, as far as the table tells."""
        end = clock.after(at, HOLD)
        known = end < clock.n
        to = np.where(known, end, at)
        gapped = known & ((clock.t[to] - clock.t[at] - HOLD > LATE) | (seg[to] != seg[at]))
        moved = np.cumsum(np.r_[True, quote[1:] != quote[:-1]])
        left = known & ~gapped & (moved[to] != moved[at])
        kept = np.flatnonzero(known & ~gapped & ~left)
        share, success = np.full(len(at), np.nan), np.full(len(at), np.nan)
        if len(kept):
            k, owner = _spread(at[kept], to[kept] + 1)
            edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            was, low = size[at[kept] - 1], size[at[kept]]
            share[kept] = np.clip((np.maximum.reduceat(size[k], edge) - low) / (was - low), 0, 1)
            back = np.minimum.reduceat(np.where(size[k] >= was[owner], k, clock.n), edge)
            had = back < clock.n
            success[kept[had]] = (clock.t[back[had]] - clock.t[at[kept[had]]]) / 1e6
        return {"gapped": gapped, "left": left, "kept": ~np.isnan(share), "full": share == 1, "back": ~np.isnan(success), "share": share, "success": success}

    def scan(table: pa.Table, lo: int, hi: int, state: dict) -> pa.Table:
        c = _numbers(table, ("t", "qb", "qa", "b", "a", "edge_ofi", "valid_ofi", "seg_ofi"))
        out = {n: np.full(table.num_rows, np.nan) for n in names}
        clock = Clock(table, c["seg_ofi"])
        i, s = _covered(clock, c["valid_ofi"].astype(bool))
        for side, size, quote in (("Bid", c["qb"], c["b"]), ("Ask", c["qa"], c["a"])):
            with np.errstate(invalid="ignore", divide="ignore"):
                fell = c["edge_ofi"].astype(bool) & np.r_[False, (quote[1:] == quote[:-1]) & (size[1:] < size[:-1]) & ((size[:-1] - size[1:]) / size[:-1] >= 0.1 - 1e-12)]
            at = _thinned(clock, np.flatnonzero(fell), lo, state.get(side, []))
            if hi < table.num_rows:  # the session goes on
                state[side] = clock.t[at[at < hi]].tolist()
            fate = fates(clock, size, quote, c["seg_ofi"], at)
            a, z = np.searchsorted(at, s, side="right"), np.searchsorted(at, i, side="right")
            m = np.clip(np.searchsorted(clock.key[at], clock.key[i] - HOLD, side="right"), a, z)
            number = {k: (lambda u: u[m] - u[a])(np.r_[0, np.cumsum(fate[k])]) for k in ("gapped", "left", "kept", "full", "back")}
            k, owner = _spread(a, m)
            total = lambda v: np.bincount(owner, np.nan_to_num(v[k]), len(i))
            mature = m - a - number["gapped"]
            with np.errstate(invalid="ignore", divide="ignore"):
                enough = np.where(number["kept"] >= 3, 1.0, np.nan)
                found = {
                    "MatureCount": mature, "SameCount": number["kept"], "ExitCount": number["left"], "SuccessCount": number["back"], "ImmatureCount": z - m, "GappedCount": number["gapped"], "UnrecoveredCount": number["kept"] - number["back"],
                    "Recovery": enough * total(fate["share"]) / number["kept"], "FullShare": enough * number["full"] / number["kept"], "SuccessTime": enough * total(fate["success"]) / np.where(number["back"] > 0, number["back"], np.nan),
                    "ExitShare": np.where(mature >= 3, number["left"] / mature, np.nan),
                }
            for n, v in found.items():
                out[f"B09_{side}{n}_h10s"][i] = v
        cols = {k: table.column(k) for k in (*KEYS, "snap_id", "t")} | {k: pa.array(v, from_pandas=True) for k, v in out.items()}
        return pa.table(cols).slice(lo, hi - lo)

    r = map_groups(x, KEYS, ORDER, scan, ", ".join([*(f"{k} string" for k in KEYS), "snap_id bigint, t bigint", *(f"{n} double" for n in names)]), most=most, back=SPAN + HOLD)
    return r.withColumns({f"B09_{k}Difference_h10s": F.col(f"B09_Bid{k}_h10s") - F.col(f"B09_Ask{k}_h10s") for k in ("Recovery", "FullShare", "SuccessTime")})


def lagged_flow(q: DataFrame, most: int = 400_000) -> DataFrame:
    """(keys, snap_id, t, D09_Lag*): correlation over 10 s of order flow per depth and second with the price's speed over the 2 s after it.

    Only pairs whose end has been seen count: a step 2 s back or more has its end by now. Eight at least, weighted by the step's duration.
    """
    names = ["D09_LagOFICorr_h10s_lag2s", "D09_LagPairCount_h10s_lag2s", "D09_LagAlignmentMax_h10s_lag2s"]
    x = q.select(*KEYS, *ORDER, "p", "ofi", "depth", "l_depth", "dt", "edge_full", "valid_full", "seg_full")
    pairs = 2_000_000

    def scan(table: pa.Table, lo: int, hi: int, state: dict) -> pa.Table:
        c = _numbers(table, ("t", "p", "ofi", "depth", "l_depth", "dt", "edge_full", "valid_full", "seg_full"))
        out = {n: np.full(table.num_rows, np.nan) for n in names}
        clock, seg, valid = Clock(table, c["seg_full"]), c["seg_full"], c["valid_full"].astype(bool)
        step = np.flatnonzero(c["edge_full"])
        end = clock.after(step, HOLD)
        late = np.where(end < clock.n, clock.t[np.minimum(end, clock.n - 1)] - clock.t[step] - HOLD, LATE + 1) if clock.n else end
        ok = (end < clock.n) & (late <= LATE)
        step, end, late = step[ok], end[ok], late[ok]
        ok = valid[end] & (seg[end] == seg[step])
        step, end, late = step[ok], end[ok], late[ok]
        with np.errstate(invalid="ignore", divide="ignore"):
            flow = c["ofi"][step] / ((c["l_depth"][step] + c["depth"][step]) / 2 * c["dt"][step])
            speed = (c["p"][end] - c["p"][step]) / ((clock.t[end] - clock.t[step]) / 1e6)
        i, s = _covered(clock, valid)
        a = np.searchsorted(step, s, side="right")
        b = np.maximum(a, np.minimum(np.searchsorted(clock.key[step], clock.key[i] - HOLD, side="right"), np.searchsorted(step, i, side="right")))
        cut = np.searchsorted(np.cumsum(b - a), np.arange(0, (b - a).sum() + 1, pairs)) if len(i) else []
        for u, v in zip(cut, np.r_[cut[1:], len(i)].astype(int) if len(i) else []):
            k, owner = _spread(a[u:v], b[u:v])
            n = v - u
            add = lambda y: np.bincount(owner, y, n)
            count, w = np.bincount(owner, minlength=n), c["dt"][step[k]]
            with np.errstate(invalid="ignore", divide="ignore"):
                total = add(w)
                f = flow[k] - (add(w * flow[k]) / total)[owner]
                g = speed[k] - (add(w * speed[k]) / total)[owner]
                scale = np.sqrt(add(w * f * f) * add(w * g * g)) / total
                value = np.where((count >= 8) & (scale > 1e-12), np.clip(add(w * f * g) / total / scale, -1, 1), np.nan)
            worst = np.full(n, np.nan)
            if len(k):
                edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                worst[owner[edge]] = np.maximum.reduceat(late[k], edge) / 1e6
            for name, y in zip(names, (value, count, worst)):
                out[name][i[u:v]] = y
        cols = {k: table.column(k) for k in (*KEYS, "snap_id", "t")} | {k: pa.array(v, from_pandas=True) for k, v in out.items()}
        return pa.table(cols).slice(lo, hi - lo)

    return map_groups(x, KEYS, ORDER, scan, ", ".join([*(f"{k} string" for k in KEYS), "snap_id bigint, t bigint", *(f"{n} double" for n in names)]), most=most, back=SPAN + HOLD)
