"""Implausible values in quote snapshots: Hampel filter, stuck runs and physical bounds, judged per contract."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.runtime import map_parts, real, same_key, stored

PRICES = ("LastPrice", "BidPrice1", "AskPrice1")
KEYS = ("Contract", "unit")
OUT = "Contract string, unit string, kind string, field string, snap_id bigint, score double, rows bigint, active bigint, run bigint"
WINDOW = 9
#: Least rows and least active rows of a stuck run.
STUCK = {"LastPrice": (20, 6), "BidPrice1": (20, 6), "AskPrice1": (20, 6), "Volume": (12, 5)}
_BIN = float(np.log(1.05))


def _beside(x: np.ndarray, group: np.ndarray, width: int, side: int) -> np.ndarray:
    """(n, width) of the values before (side -1) or after (side 1) each row, nan beyond its group."""
    n = len(x)
    out = np.full((n, width), np.nan)
    for k in range(1, width + 1):
        if k >= n:
            break
        if side < 0:
            ok = group[k:] == group[:-k]
            out[k:, k - 1] = np.where(ok, x[:-k], np.nan)
        else:
            ok = group[k:] == group[:-k]
            out[:-k, k - 1] = np.where(ok, x[k:], np.nan)
    return out


def _median(block: np.ndarray) -> np.ndarray:
    """Row medians without nan (lower of the two middle values); nan where a row has none."""
    if not len(block):
        return np.empty(0)
    s = np.sort(block, axis=1)
    count = np.sum(~np.isnan(s), axis=1)
    return np.where(count > 0, s[np.arange(len(s)), np.maximum(count - 1, 0) // 2], np.nan)


def _last(x: np.ndarray, group: np.ndarray, before: float = np.nan) -> np.ndarray:
    """The value before each row within its group, missing values skipped; ``before`` is what the first group had before its first row."""
    if not len(x):
        return x
    at = np.where(np.isnan(x), -1, np.arange(len(x)))
    at = np.r_[-1, np.maximum.accumulate(at)[:-1]]
    ok = (at >= 0) & (group[np.maximum(at, 0)] == group)
    return np.where(ok, x[np.maximum(at, 0)], np.where(group == group[0], before, np.nan))


def _final(x: np.ndarray, before: float) -> float:
    """The last value of a group, ``before`` if it has none."""
    have = x[~np.isnan(x)]
    return float(have[-1]) if len(have) else before


class Evidence:
    """What is known of some sorted sessions: candidates by row, and statistics by session.

    Statistics of a session that came in parts are given as values with their counts, which add up; of a whole one as their quantile.
    """

    def __init__(self, state: dict, more: bool):
        self.state, self.cut = state, more or "pos" in state  # is the first group a part?
        self.rows: list[tuple] = []
        self.stats: list[tuple] = []

    def row(self, kind: str, field: str, at: np.ndarray, score=None, rows=None, active=None, run=None) -> None:
        if len(at):
            self.rows.append((kind, field, at, score, rows, active, run))

    def quantile(self, kind: str, field: str, values: np.ndarray, group: np.ndarray, q: float) -> None:
        """The value at place q (n - 1), rounded down, of each group's values."""
        ok = ~np.isnan(values)
        v, g = values[ok], group[ok]
        order = np.lexsort((v, g))
        v, g = v[order], g[order]
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, int)
        size = np.diff(np.r_[edge, len(g)])
        for a, n in zip(edge, size):
            if g[a] == 0 and self.cut:
                x, k = np.unique(v[a : a + n], return_counts=True)
                self.stats += [(kind + "_part", field, 0, float(u), int(c), 0, None) for u, c in zip(x, k)]
            else:
                self.stats.append((kind, field, int(g[a]), float(v[a + int(q * (n - 1))]), int(n), 0, None))


def _number(*what: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, what)).encode(), digest_size=8).digest(), "little", signed=True)


def _stuck(e: Evidence, name: tuple, f: str, x: np.ndarray, changed: np.ndarray | None, goes: np.ndarray, away: np.ndarray, group: np.ndarray, lo: int, more: bool) -> None:
    """Runs of equal values of rows lo.. of the table; missing values in between do not end one.

    A run that a part's edge cuts gives out its rows as ``open`` under its number, and what became of it once, as ``close``, when it ends.
    """
    key, least, busy = ("run", f), *STUCK[f]
    was = e.state.get(key)
    total = np.cumsum(goes) + e.state.get(("total", f), 0)
    if more:
        e.state["total", f] = int(total[-1]) if len(total) else e.state.get(("total", f), 0)
    act = goes & ~np.isnan(x) & ~np.isnan(_last(x, group, e.state.get(("last", f), np.nan)))
    same = act & ~changed if changed is not None else act
    have = np.flatnonzero(~np.isnan(x))
    if not len(have):
        if was and not more:
            _close(e, f, was)
        return
    v, g = x[have], group[have]
    new = np.r_[True, (v[1:] != v[:-1]) | (g[1:] != g[:-1])]
    first = np.flatnonzero(new)
    rows = np.diff(np.r_[first, len(have)])
    r = np.cumsum(new) - 1
    tail = have[np.r_[first[1:], len(have)] - 1]
    began, far, acts, sames = total[have[first]].copy(), away[have[first]].copy(), np.bincount(r, act[have]), np.bincount(r, same[have])
    later = np.ones(len(have), dtype=bool)
    later[first] = False
    joined = was is not None and g[0] == 0 and v[0] == was["value"]
    if joined:
        rows[0] += was["rows"]
        began[0], far[0], later[0] = was["began"], was["far"], True
        acts[0] += was["acts"]
        sames[0] += was["sames"]
    elif was:
        _close(e, f, was)
    active, beyond = total[tail] - began, away[tail] - far
    whole = np.ones(len(first), dtype=bool)
    opened = {}
    if joined:
        opened[0] = was["number"]
        whole[0] = False
    if more:
        k = len(first) - 1
        opened.setdefault(k, _number(*name, f, int(began[k]), int(v[-1] * 1000), e.state.get("pos", 0), int(have[first[k]])))
        whole[k] = False
    for k, number in opened.items():
        at = have[(r == k) & later]
        e.row("open", f, at + lo, run=np.full(len(at), number))
        now = {"value": float(v[first[k]]), "rows": int(rows[k]), "began": int(began[k]), "far": int(far[k]), "acts": int(acts[k]), "sames": int(sames[k]), "active": int(active[k]), "beyond": int(beyond[k]), "number": number}
        if more and k == len(first) - 1:
            e.state[key] = now
        else:
            _close(e, f, now)
    if not more:
        e.state.pop(key, None)
    stuck = whole & (rows >= least) & (active >= busy)
    at = stuck[r] & later
    e.row("stuck", f, have[at] + lo, beyond[r[at]].astype(float), rows[r[at]], active[r[at]])
    if f != "Volume":
        short = whole & (rows < 20)
        for k in np.unique(g):
            mine = short & (g[first] == k)
            e.stats.append(("rests", f, int(k), 0.0, int(sames[mine].sum()), int(acts[mine].sum()), None))


def _close(e: Evidence, f: str, run: dict) -> None:
    e.stats.append(("close", f, 0, float(run["beyond"]), run["rows"], run["active"], run["number"]))
    if f != "Volume" and run["rows"] < 20:
        e.stats.append(("rests", f, 0, 0.0, run["sames"], run["acts"], None))


def judge(p: dict[str, np.ndarray], v: np.ndarray, sizes: list[np.ndarray], step: np.ndarray, usual: np.ndarray, group: np.ndarray, name: tuple, lo: int, hi: int, more: bool, state: dict) -> Evidence:
    """Evidence on rows lo..hi of sessions in order. p: prices by field, step: their tick, usual: the session's usual distance of bid and ask in ticks.

    group: ascending session numbers from 0. Rows before ``lo`` were judged in an earlier part, those from ``hi`` on will be in the next; the
    rows beside a row are at most 2 ``WINDOW`` away, all else that lies before is in ``state``.
    """
    n = len(v)
    e = Evidence(state, more)
    new = slice(lo, hi)
    mine = group[new]
    t, back, fwd, scores = {}, {}, {}, {}
    for f, x in p.items():
        with np.errstate(invalid="ignore"):
            bad = ~np.isnan(x) & ((x <= 0) | np.isinf(x) | (np.abs(x / step - np.rint(x / step)) > 0.02))
            e.row("hard", f, np.flatnonzero(bad[new]) + lo)
            t[f] = np.where(bad, np.nan, x / step)
        before, after = _beside(t[f], group, WINDOW, -1)[new], _beside(t[f], group, WINDOW, 1)[new]
        back[f], fwd[f] = _median(before), _median(after)
        both = np.concatenate([before, after], axis=1)
        at = t[f] = t[f][new]
        mid = _median(both)
        mad = _median(np.abs(both - mid[:, None]))
        d = np.fmin(np.abs(at - back[f]), np.abs(at - fwd[f]))
        scores[f] = np.where(d > 3 * 1.4826 * np.nan_to_num(mad), d, 0.0)
        e.quantile("scale", f, np.rint(np.abs(at - mid)), mine, 0.95)

    # The counter of traded volume never falls: a value above what comes after it, or below what came before it, is wrong.
    wrong = (v > _median(_beside(v, group, WINDOW, 1))) | (v < _median(_beside(v, group, WINDOW, -1))) | (v < 0)
    e.row("hard", "Volume", np.flatnonzero(wrong[new]) + lo)
    clean = np.where(wrong, np.nan, v)
    follows = _beside(clean, group, WINDOW, 1)[new]
    clean = clean[new]
    dv = clean - _last(clean, mine, state.get(("last", "Volume"), np.nan))
    # At either end of a session no rows lie on one side; only a jump beyond any trade tells there.
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, int)
    ends = np.r_[starts[1:], n].astype(int) if n else np.empty(0, int)
    place = np.arange(n)
    pos = (place - (starts[group] if n else 0))[new] + np.where(mine == 0, state.get("pos", 0), 0)
    from_end = ((ends[group] if n else 0) - 1 - place)[new]
    if more:
        from_end = np.full(len(mine), 2)
    at = np.flatnonzero((from_end <= 1) & (dv > 0))
    e.row("edge", "Volume", at + lo, dv[at])
    opening = np.flatnonzero(pos <= 1)
    following = np.array([next((y for y in row if y == y), np.nan) for row in follows[opening].tolist()]) - clean[opening] if len(opening) else np.empty(0)
    e.row("edge", "Volume", opening[following > 0] + lo, following[following > 0])
    with np.errstate(invalid="ignore", divide="ignore"):
        e.quantile("traded", "Volume", np.where(dv > 0, np.floor(np.log(dv) / _BIN), np.nan), mine, 0.5)

    # A price is borne out by the row's other prices if it agrees with them.
    last, bid, ask = (t[f] for f in PRICES)
    usual = usual[new]
    outside = np.fmax(np.fmax(bid - last, last - ask), 0.0)
    beside = {"LastPrice": outside, "BidPrice1": np.abs(bid - (ask - usual)), "AskPrice1": np.abs(ask - (bid + usual))}
    crossed = bid >= ask
    with np.errstate(invalid="ignore"):
        mb, ma = np.where(np.isnan(back["BidPrice1"]), fwd["BidPrice1"], back["BidPrice1"]), np.where(np.isnan(back["AskPrice1"]), fwd["AskPrice1"], back["AskPrice1"])
        swap = crossed & (np.abs(bid - ma) + np.abs(ask - mb) <= np.fmax(np.abs(bid - mb), np.abs(ask - ma)) + 2 * np.nan_to_num(usual))
    for f in PRICES:
        s = np.where(np.isnan(beside[f]), scores[f], np.fmin(scores[f], beside[f]))
        at = np.flatnonzero((s >= 2) & ~swap)
        e.row("spike", f, at + lo, s[at], np.isnan(beside[f])[at].astype(int))
        if f != "LastPrice":
            e.row("hard", f, np.flatnonzero(swap) + lo)
    lone = np.flatnonzero(crossed & ~swap)
    for f in PRICES[1:]:
        other = PRICES[2] if f == PRICES[1] else PRICES[1]
        e.row("hard", f, lone[np.nan_to_num(scores[f][lone]) >= np.nan_to_num(scores[other][lone])] + lo)

    # Stuck: the run of one value is too long for the contract while the other fields go on.
    traded = dv > 0
    sized = np.zeros(len(mine), dtype=bool)
    for k, x in enumerate(sizes):
        y = _last(x[new], mine, state.get(("size", k), np.nan))
        sized |= ~np.isnan(x[new]) & (x[new] != y)
    changed = {f: ~np.isnan(x) & ~np.isnan(y := _last(x, mine, state.get(("last", f), np.nan))) & (x != y) for f, x in t.items()}
    goes = {"LastPrice": traded, "BidPrice1": traded | sized, "AskPrice1": traded | sized, "Volume": changed["LastPrice"] & ~(np.nan_to_num(scores["LastPrice"]) >= 8)}
    # A trade outside the quotes: one of last price, bid and ask is not of its time.
    away = np.cumsum(traded & (np.nan_to_num(outside) > 0)) + state.get("away", 0)
    for f, x in (*t.items(), ("Volume", clean)):
        _stuck(e, name, f, x, changed.get(f), goes[f], away, mine, lo, more)
    if more:
        state["away"] = int(away[-1])
        for f, x in (*t.items(), ("Volume", clean)):
            state["last", f] = _final(x, state.get(("last", f), np.nan))
        for k, x in enumerate(sizes):
            state["size", k] = _final(x[new], state.get(("size", k), np.nan))
    return e


def _scan(table: pa.Table, more: bool, state: dict) -> tuple[pa.Table | None, int]:
    """Evidence on sorted sessions, or on a part of one; rows sent again are judged once and reported each."""
    n = table.num_rows
    same = same_key(table, KEYS)
    as_float = lambda c: table.column(c).to_numpy().astype(float)
    when, feed = table.column("t").to_numpy(), as_float("source_row")
    copy = same & np.r_[False, (when[1:] == when[:-1]) & (feed[1:] == feed[:-1])]
    for f in (*PRICES, "Volume"):
        x = as_float(f)
        copy &= np.r_[False, (x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1]))]
    keep = np.flatnonzero(~copy)
    m, lo = len(keep), state.get("lo", 0)
    hi = m - 2 * WINDOW - 1 if more else m  # more copies of the last row may come
    if hi <= lo and more:
        return None, 0
    group = np.cumsum(~same[keep]) - 1
    p = {f: as_float(f)[keep] for f in PRICES}
    tick, low = as_float("tick")[keep], as_float("low")[keep]
    step = np.where((tick > 0) & np.isfinite(tick), tick, np.where(low > 0, low, 1.0))
    contract, unit, snap = (table.column(c).combine_chunks() for c in ("Contract", "unit", "snap_id"))
    name = (contract[0].as_py(), unit[0].as_py()) if n else ()
    e = judge(p, as_float("Volume")[keep], [as_float(f)[keep] for f in ("BidVolume1", "AskVolume1")], step, as_float("usual")[keep] / step, group, name, lo, hi, more, state)
    first = np.r_[keep, n]
    count = np.diff(first)
    parts: dict[str, list] = {k: [] for k in ("kind", "field", "at", "id", "score", "rows", "active", "run")}

    def add(kind: str, field: str, at: np.ndarray, **values: np.ndarray | None) -> None:
        parts["kind"] += [kind] * len(at)
        parts["field"] += [field] * len(at)
        parts["at"].append(at)
        for k in ("id", "score", "rows", "active", "run"):
            x = values.get(k)
            parts[k].append(np.zeros(len(at), float if k == "score" else np.int64) if x is None else np.asarray(x, float if k == "score" else np.int64))

    for kind, field, at, score, rows, active, run in e.rows:
        times = count[at]
        every = np.repeat(first[at], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        spread = lambda x: None if x is None else np.repeat(np.asarray(x), times)
        add(kind, field, every, id=np.ones(len(every)), score=spread(score), rows=spread(rows), active=spread(active), run=spread(run))
    head = keep[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])] if m else keep
    for kind, field, g, score, rows, active, run in e.stats:
        add(kind, field, head[[g]], score=[score], rows=[rows], active=[active], run=[run or 0])
    at = pa.array(np.concatenate(parts["at"]) if parts["at"] else [], pa.int64())
    cat = lambda k, kind: pa.array(np.concatenate(parts[k]) if parts[k] else [], kind)
    snaps = pc.if_else(pc.equal(cat("id", pa.int64()), 1), snap.take(at), pa.scalar(None, pa.int64()))
    out = pa.table({
        "Contract": contract.take(at), "unit": unit.take(at), "kind": pa.array(parts["kind"], pa.string()), "field": pa.array(parts["field"], pa.string()), "snap_id": snaps,
        "score": cat("score", pa.float64()), "rows": cat("rows", pa.int64()), "active": cat("active", pa.int64()), "run": cat("run", pa.int64()),
    })
    start = max(0, hi - WINDOW)
    if more:
        state["lo"], state["pos"] = hi - start, state.get("pos", 0) + start
    return out, int(first[start])


def spike_evidence(snapshots: DataFrame, contracts: DataFrame, most: int = 400_000) -> DataFrame:
    """One scan: candidate values with their evidence, and each session's statistics.

    One shuffle, on the session. The usual distance of bid and ask and the least distance of a row's own prices (for contracts without a
    tick) are window aggregates over the same partitions and the same order as the pass that follows, so that nothing is sorted twice.
    """
    ticks = contracts.select(F.col("Contract").alias("Contract"), real("tick_size").alias("tick")).groupBy("Contract").agg(F.min("tick").alias("tick"))
    unit = F.concat_ws("|", *(F.coalesce(F.col(k), F.lit("?")) for k in ("trade_date", "session"))).alias("unit")
    rows = snapshots.select("Contract", unit, F.unix_micros("Datetime").alias("t"), F.col("source_row").cast("bigint").alias("source_row"), F.col("snap_id").cast("bigint").alias("snap_id"), *(real(f).alias(f) for f in (*PRICES, "BidVolume1", "AskVolume1", "Volume")))
    rows = rows.where("Contract is not null and t is not null").join(ticks, "Contract", "left")
    whole = Window.partitionBy(*KEYS).orderBy("t", "source_row", "snap_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.expr("CASE WHEN BidPrice1 > 0 AND AskPrice1 > BidPrice1 AND AskPrice1 < double('Infinity') THEN round(AskPrice1 - BidPrice1, 6) END")
    apart = [F.when((F.col(a) > 0) & (F.col(b) > 0) & (F.abs(F.col(a) - F.col(b)) > 1e-9) & (F.abs(F.col(a) - F.col(b)) < float("inf")), F.abs(F.col(a) - F.col(b))) for a, b in ((PRICES[0], PRICES[1]), (PRICES[0], PRICES[2]), (PRICES[1], PRICES[2]))]
    rows = rows.withColumns({"usual": F.percentile(gap, 0.5).over(whole), "low": F.min(F.when(F.col("tick").isNull() | ~(F.col("tick") > 0), F.least(*apart))).over(whole)})
    return map_parts(rows, KEYS, ("t", "source_row", "snap_id"), _scan, OUT, most=most, placed=True)


def implausible_values(snapshots: DataFrame, contracts: DataFrame, *, ratio: float = 3.2, alone: float = 4.0, odds: float = 15.0, quote_odds: float = 22.0, jump: float = 400.0, most: int = 400_000) -> DataFrame:
    """(snap_id, field, rule) of stored values which a contract's market cannot have shown.

    Within each session rows are ordered by ``Datetime``, ``source_row``, ``snap_id``. Rules:
    ``hard`` - a price that is not positive, is infinite or off the tick grid; bid and ask exchanged; a cumulative volume above the
    later or below the earlier rows. ``edge`` - a volume of the first or last two rows that is ``jump`` times the session's usual trade away.
    ``spike`` - Hampel filter over 9 rows before and 9 after: beyond 3 scaled deviations, farther from both sides than ``ratio`` times the
    contract's own scale (median over its sessions of the 95th percentile of deviations, a tick at least), and not borne out by the row's
    other prices (``alone`` times the scale where those are missing). ``stuck`` - a run of one value of 20 rows or more (volume: 12) during
    which the session goes on, of odds below exp(-``odds``) at the contract's own habit of resting.

    Nulls and NaN are no values and never flagged; rows without contract or time are not judged; a missing tick size is replaced by the
    least distance of two prices of one row; copies sent again are judged once and reported each; empty input gives an empty result; other
    columns are ignored. A session of more than ``most`` rows is judged in parts, with the same result.
    """
    seen = stored(spike_evidence(snapshots, contracts, most), "spikes")
    by = ["Contract", "unit", "field"]

    def statistic(kind: str, q: float) -> DataFrame:
        """Per session, from whole ones and from the counts of those in parts."""
        w = Window.partitionBy(*by)
        parts = seen.where(F.col("kind") == f"{kind}_part").groupBy(*by, "score").agg(F.sum("rows").alias("n"))
        parts = parts.withColumns({"upto": F.sum("n").over(w.orderBy("score")), "all": F.sum("n").over(w)}).where(F.col("upto") > F.floor(F.lit(q) * (F.col("all") - 1)))
        return seen.where(F.col("kind") == kind).select(*by, "score").unionByName(parts.groupBy(*by).agg(F.min("score").alias("score")))

    scale = statistic("scale", 0.95).groupBy("Contract", "field").agg(F.expr("greatest(percentile(score, 0.5), 1.0D)").alias("scale"))
    rests = seen.where("kind = 'rests'").groupBy("Contract", "field").agg(F.expr("(sum(rows) + 1.0D) / (sum(active) + 2.0D)").alias("rest"))
    usual = statistic("traded", 0.5).select(*by, F.greatest(F.exp(F.col("score") * _BIN), F.lit(1.0)).alias("trade"))
    edge = seen.where("kind = 'edge'").join(usual, by).where(F.col("score") > jump * F.col("trade"))
    least = {f: F.create_map(*(x for k, v in STUCK.items() for x in (F.lit(k), F.lit(v[f]))))[F.col("field")] for f in (0, 1)}
    ends = seen.where("kind = 'close'").where((F.col("rows") >= least[0]) & (F.col("active") >= least[1])).select("field", "run", "score", "rows", "active")
    cut = seen.where("kind = 'open'").drop("score", "rows", "active").join(ends, ["field", "run"]).withColumn("kind", F.lit("stuck"))
    flagged = seen.where("kind in ('hard', 'spike', 'stuck')").unionByName(edge.drop("trade")).unionByName(cut)
    judged = flagged.join(scale, ["Contract", "field"], "left").join(rests, ["Contract", "field"], "left")
    keep = (
        F.col("kind").isin("hard", "edge")
        | ((F.col("kind") == "spike") & (F.col("score") > F.when(F.col("rows") == 1, F.lit(alone)).otherwise(F.lit(ratio)) * F.coalesce("scale", F.lit(1.0))))
        | ((F.col("kind") == "stuck") & ((F.col("field") == "Volume") | (2 * F.least("score", F.lit(10.0)) - F.col("active") * F.log("rest") > F.when(F.col("field") == "LastPrice", odds).otherwise(quote_odds))))
    )
    return judged.where(keep).groupBy("snap_id", "field").agg(F.min("kind").alias("rule"))
