"""Irregular readings onto a regular grid, with gaps filled by low-rank factorisation or marked."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.operators.models import summed
from tickweave.runtime import real, stored

KEYS = ("Contract", "trade_date", "session")
#: Seconds on either side of a cell that its estimate rests on, and how far apart the stretches begin that the factors are fitted to.
HALF, STRIDE = 10, 5
#: Readings farther than this many spreads from their source's centre count as that far in the fit.
CLIP = 3.0
CHUNK = 20_000


def _middles(v: np.ndarray, source: np.ndarray, n: int) -> np.ndarray:
    """Median of each source's values; 0 where it has none."""
    v = v[np.lexsort((v, source))]
    count = np.bincount(source, minlength=n)
    first = np.cumsum(count) - count
    have = count > 0
    out = np.zeros(n)
    out[have] = (v[(first + (count - 1) // 2)[have]] + v[(first + count // 2)[have]]) / 2
    return out


class Laid:
    """One field of some sources, laid end to end by second with ``HALF`` empty seconds around each.

    ``x``: the values, nan where there is none; ``base``: where each source's second 0 lies; ``z``: values about their source's median in
    units of its spread, both of which faulty values hardly move, ``CLIP`` at most.
    """

    def __init__(self, batch: pa.RecordBatch, field: str):
        cells = batch.column("cells")
        self.n = batch.column("seconds").to_numpy().astype(np.int64)
        edge = cells.offsets.to_numpy().astype(np.int64)
        rows = cells.values.slice(edge[0], edge[-1] - edge[0])
        v = rows.field(field).to_numpy(zero_copy_only=False)
        source = np.repeat(np.arange(len(self.n)), np.diff(edge))
        self.base = np.cumsum(self.n + HALF) - self.n
        at = self.base[source] + rows.field("second").to_numpy(zero_copy_only=False).astype(np.int64)
        self.x = np.full(int((self.n + HALF).sum()) + HALF, np.nan)
        self.x[at] = v
        self.centre = _middles(v, source, len(self.n))
        off = np.abs(v - self.centre[source])
        middle = _middles(off, source, len(self.n))
        spread = np.bincount(source, np.where(middle[source] > 0, np.minimum(off, 12 * middle[source]), off), len(self.n)) / np.maximum(np.bincount(source, minlength=len(self.n)), 1)
        self.scale = np.where((spread > 0) & np.isfinite(spread), spread, 1.0)
        self.readings = np.bincount(source, minlength=len(self.n))
        self.z = np.full(len(self.x), np.nan)
        self.z[at] = np.clip((v - self.centre[source]) / self.scale[source], -CLIP, CLIP)

    def places(self, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(places, sources) of every ``step``-th second of each source."""
        count = -(-self.n // step)
        source = np.repeat(np.arange(len(self.n)), count)
        return self.base[source] + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)), source

    def stretches(self, at: np.ndarray) -> np.ndarray:
        """(len(at), 2 HALF + 1): what lies around each place."""
        return np.lib.stride_tricks.sliding_window_view(self.z, 2 * HALF + 1)[at - HALF]

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(stretches, sources) that the factors are fitted to, whole sources, about ``CHUNK`` stretches at a time."""
        at, source = self.places(STRIDE)
        cut = np.unique(np.searchsorted(source, source[::CHUNK])) if len(source) else np.empty(0, int)
        for a, b in zip(cut, np.r_[cut[1:], len(source)]):
            w = self.stretches(at[a:b])
            some = ~np.isnan(w).all(axis=1)
            if some.any():
                yield w[some], source[a:b][some]

    def supported(self, reach: int, least: int = 3) -> np.ndarray:
        """By place: the source has ``least`` readings, one of them within ``reach`` seconds."""
        total = np.cumsum(np.r_[0, ~np.isnan(self.x)])
        at, source = self.places()
        ok = np.zeros(len(self.x), bool)
        ok[at] = (total[at + reach + 1] > total[at - reach]) & (self.readings[source] >= least)
        return ok


def source_factors(x: np.ndarray, source: np.ndarray, v: np.ndarray, noise: float, weight: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, inverse, noises): the factors of each stretch given those of the seconds, by ridge least squares of what was observed.

    ``source`` is the source's number of each stretch, from 0. The ridge is the source's own noise: what the factors leave of its readings,
    drawn towards the common ``noise`` with the weight of ``weight`` readings.
    """
    m, r = (~np.isnan(x)).astype(float), v.shape[1]
    z = np.nan_to_num(x)
    products = (m @ (v[:, :, None] * v[:, None, :]).reshape(len(v), r * r)).reshape(-1, r, r)
    b, count = z @ v, np.bincount(source, m.sum(axis=1))
    noises = np.full(len(count), noise)
    for again in (False, True):
        inverse = np.linalg.inv(products + noises[source][:, None, None] * np.eye(r))
        u = np.einsum("nij,nj->ni", inverse, b)
        left = ((z - m * (u @ v.T)) ** 2).sum(axis=1) + noises[source] * np.einsum("nij,nij->n", products, inverse)
        if not again:
            noises = np.maximum((np.bincount(source, left, len(count)) + weight * noise) / (count + weight), 1e-3)
    return u, inverse, noises


def time_sums(x: np.ndarray, source: np.ndarray, v: np.ndarray, noise: float) -> np.ndarray:
    """What the least squares of the seconds' factors need of some sources' stretches, as one vector that adds up: sources, noise, products."""
    u, inverse, noises = source_factors(x, source, v, noise)
    n = noises[source][:, None]
    square = ((u[:, :, None] * u[:, None, :]).reshape(len(u), -1) + n * inverse.reshape(len(u), -1)) / n
    m = (~np.isnan(x)).astype(float)
    return np.concatenate([[len(noises), np.log(noises).sum()], (m.T @ square).ravel(), (np.nan_to_num(x).T @ (u / n)).ravel()])


def start(rank: int) -> tuple[np.ndarray, float]:
    """Fixed first factors: level, slope, bend and so on."""
    at = np.linspace(0, 1, 2 * HALF + 1)
    return np.stack([np.cos(np.pi * k * at) for k in range(rank)], axis=1) / 2, 0.3


def solved(sums: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """The factors of the seconds and the common noise from the sums over all sources."""
    t, r = v.shape
    a, b = sums[2 : 2 + t * r * r].reshape(t, r, r), sums[2 + t * r * r :].reshape(t, r)
    return np.linalg.solve(a + np.eye(r), b[:, :, None])[:, :, 0], float(np.exp(sums[1] / max(sums[0], 1.0)))


def fitted(sources: DataFrame, fields: Sequence[str], rank: int = 8, rounds: int = 8) -> dict[str, tuple[np.ndarray, float]]:
    """Per field the factors of a stretch's seconds, by alternating least squares over the stretches of all sources.

    The matrix has a row per source and stretch (``2 HALF + 1`` seconds, one each ``STRIDE``) and a column per second of the stretch. Given
    the columns' factors every row's are found where it is stored; given the rows', the columns' normal equations are sums over all rows, added up per
    partition and then by Spark: a round is one pass, and brings a few thousand numbers to the driver however many sources there are.
    """
    fields = list(fields)
    now = {f: start(rank) for f in fields}
    size = 2 + (2 * HALF + 1) * (rank * rank + rank)
    for _ in range(rounds):

        def part(batch: pa.RecordBatch, now: dict = now) -> np.ndarray:
            total = np.zeros((len(fields), size))
            for k, f in enumerate(fields):
                for w, source in Laid(batch, f).pieces():
                    total[k] += time_sums(w, np.unique(source, return_inverse=True)[1], *now[f])
            return total.ravel()

        sums = summed(sources, part)
        if len(sums):
            now = {f: solved(s, now[f][0]) for f, s in zip(fields, sums.reshape(len(fields), size))}
    return now


def centres(w: np.ndarray, noise: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by the factors, by interpolation, seconds to the nearest reading) of the middle of stretches of known noise; the middle itself is not looked at."""
    r = v.shape[1]
    outer = (v[:, :, None] * v[:, None, :]).reshape(len(v), r * r)
    seen = ~np.isnan(w)
    seen[:, HALF] = False
    z = np.where(seen, w, 0.0)
    a = (seen.astype(float) @ outer).reshape(-1, r, r) + noise[:, None, None] * np.eye(r)
    als = np.linalg.solve(a, (z @ v)[:, :, None])[:, :, 0] @ v[HALF]
    row, at = np.arange(len(w)), np.arange(2 * HALF + 1)
    left, right = np.where(seen & (at < HALF), at, -1).max(axis=1), np.where(seen & (at > HALF), at, 3 * HALF).min(axis=1)
    l, r_ = z[row, np.maximum(left, 0)], z[row, np.minimum(right, 2 * HALF)]
    both = (left >= 0) & (right <= 2 * HALF)
    line = np.where(both, l + (r_ - l) * (HALF - left) / np.maximum(right - left, 1), np.where(left >= 0, l, r_))
    near = np.minimum(np.where(left >= 0, HALF - left, HALF), np.where(right <= 2 * HALF, right - HALF, HALF))
    return als, np.where((left >= 0) | (right <= 2 * HALF), line, als), near


#: The shares of interpolation in an estimate that are tried, for gaps whose nearest reading is 1, 2, 3 or more seconds away.
SHARES, REACHES = np.linspace(0, 1, 21), 3


def leaned(sources: DataFrame, now: dict[str, tuple[np.ndarray, float]]) -> dict[str, np.ndarray]:
    """Per field how much an estimate leans on the line between its neighbours, by the distance of the nearest reading.

    The share of least summed error on the middles of all stretches that were observed, each hidden with up to two seconds on either side. One pass; a
    hundred numbers reach the driver. A field whose readings hardly hang together gets 0, one that moves in small steps more.
    """
    fields = list(now)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((len(fields), REACHES, len(SHARES)))
        for i, f in enumerate(fields):
            v, noise = now[f]
            for w, source in Laid(batch, f).pieces():
                source = np.unique(source, return_inverse=True)[1]
                own = source_factors(w, source, v, noise)[2][source]
                known = ~np.isnan(w[:, HALF])
                w, own = w[known], own[known]
                for k in range(REACHES):
                    hid = w.copy()
                    hid[:, HALF - k : HALF + k + 1] = np.nan
                    als, line, near = centres(hid, own, v)
                    ok = near < HALF
                    total[i, k] += np.abs((w[:, HALF] - als)[ok, None] - (line - als)[ok, None] * SHARES).sum(axis=0)
        return total.ravel()

    sums = summed(sources, part)
    best = sums.reshape(len(fields), REACHES, -1).argmin(axis=2) if len(sums) else np.zeros((len(fields), REACHES), int)
    return {f: SHARES[b] for f, b in zip(fields, best)}


def estimated(laid: Laid, at: np.ndarray, source: np.ndarray, v: np.ndarray, noise: float, lean: np.ndarray) -> np.ndarray:
    """Values at the places ``at`` of ``source`` from what was observed around them."""
    own = np.full(len(laid.n), noise)
    for w, s in laid.pieces():
        names, s = np.unique(s, return_inverse=True)
        own[names] = source_factors(w, s, v, noise)[2]
    out = np.empty(len(at))
    for k in range(0, len(at), CHUNK):
        als, line, near = centres(laid.stretches(at[k : k + CHUNK]), own[source[k : k + CHUNK]], v)
        out[k : k + CHUNK] = als + (line - als) * lean[np.clip(near - 1, 0, REACHES - 1)]
    return out * laid.scale[source] + laid.centre[source]


def grid_sources(readings: DataFrame, schedule: DataFrame, fields: Sequence[str], positive: Sequence[str]) -> DataFrame:
    """(keys, seconds, cells) of every scheduled session: its length, and second and values of the last usable reading of each second that has one."""
    fields = list(fields)
    s = schedule.select(*KEYS, F.unix_micros("open_time").alias("open"), F.col("session_seconds").cast("int").alias("seconds")).dropna().where("seconds > 0").groupBy(*KEYS).agg(F.min("open").alias("open"), F.max("seconds").alias("seconds"))
    cond = F.col("t").isNotNull()
    for c in [*(F.col(f).isNotNull() for f in fields), *(F.col(f) > 0 for f in positive)]:
        cond = cond & c
    r = readings.select(*(F.col(k).alias(f"r_{k}") for k in KEYS), F.unix_micros("Datetime").alias("t"), F.col("snap_id").cast("bigint").alias("snap_id"), *(real(f).alias(f) for f in fields)).where(cond)
    on = (F.col("t") >= F.col("open")) & (F.col("t") < F.col("open") + F.col("seconds").cast("bigint") * 1_000_000)
    for k in KEYS:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    j = s.hint("shuffle_hash").join(r, on, "left")
    micros = F.col("t") - F.col("open")
    j = j.withColumn("second", F.floor(micros / F.lit(1_000_000)).cast("int"))
    # One bigint orders the readings of a second: micros within the second, then the arrival number (43 bits).
    late = F.pmod(micros, F.lit(1_000_000)) * F.lit(1 << 43) + F.least("snap_id", F.lit((1 << 43) - 1))
    cells = j.groupBy(*KEYS, "open", "seconds", "second").agg(*(F.max_by(f, late).alias(f) for f in fields))
    return cells.groupBy(*KEYS, "seconds").agg(F.sort_array(F.collect_list(F.when(F.col("second").isNotNull(), F.struct("second", *fields)))).alias("cells"))


def regular_grid(
    readings: DataFrame,
    schedule: DataFrame,
    fields: Sequence[str] = ("LastPrice", "BidVolume1"),
    positive: Sequence[str] = ("LastPrice",),
    rank: int = 8,
    rounds: int = 8,
    reach: int = HALF,
) -> DataFrame:
    """One row per scheduled second of every session: keys, ``period_second``, per field its value and ``<field>_status``.

    The reading of a second is the last usable one in it (by ``Datetime``, then ``snap_id``); usable means that all ``fields`` have a value
    (no null, no NaN) and those of ``positive`` are above 0. Status ``observed``: the stored value, exact. ``filled``: estimated by the
    factors of the source's stretch around the second (``fitted``), leaning on the line between its neighbours as far as that helped on
    hidden readings (``leaned``). ``unsupported``: the source has under three readings or none within
    ``reach`` seconds (``HALF`` at most), the value is null. Sessions without readings come out unsupported; readings outside any session's
    seconds, or with a null key or time, are left out; sessions with a null key, open time or length give no rows; repeated schedule rows
    count once; extra columns are ignored.

    Plan: one shuffle of the readings on the session (the schedule is the build side of a shuffled hash join), whose partitioning the
    aggregations to seconds and to sources reuse. A source is one row of at most one cell per scheduled second, written once; each round of
    the factorisation and the fill are passes over that table without a shuffle, so that a contract of any number of sessions spreads.
    """
    fields = list(fields)
    if reach > HALF:
        raise ValueError(f"reach is {HALF} at most")
    sources = stored(grid_sources(readings, schedule, fields, positive), "sources")
    now = fitted(sources.select("seconds", "cells"), fields, rank, rounds)
    lean = leaned(sources.select("seconds", "cells"), now)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(["observed", "filled", "unsupported"])
        for batch in batches:
            cols: dict = {}
            for f in fields:
                laid = Laid(batch, f)
                at, source = laid.places()
                seen = ~np.isnan(laid.x[at])
                state = np.where(seen, 0, np.where(laid.supported(reach)[at], 1, 2))
                gaps = state == 1
                x = laid.x[at]
                x[gaps] = estimated(laid, at[gaps], source[gaps], *now[f], lean[f])
                if not cols:
                    cols = {k: batch.column(k).take(pa.array(source)) for k in KEYS}
                    cols["period_second"] = pa.array((at - laid.base[source]).astype(np.int32))
                cols |= {f: pa.array(x, from_pandas=True), f"{f}_status": names.take(pa.array(state))}
            out = pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
            yield from (out.slice(i, 100_000) for i in range(0, out.num_rows, 100_000))

    schema = ", ".join([*(f"{k} string" for k in KEYS), "period_second int", *(f"`{f}` double, `{f}_status` string" for f in fields)])
    return sources.mapInArrow(fill, schema)


def held_out_errors(readings: DataFrame, schedule: DataFrame, fields: Sequence[str] = ("LastPrice", "BidVolume1"), positive: Sequence[str] = ("LastPrice",), rank: int = 8, rounds: int = 8, share: int = 8, most: float = 20.0) -> DataFrame:
    """(field, cells, als, linear, last, median): mean error of the fill on readings that were hidden, beside plainer ways to fill.

    Hidden are stretches of 1 to 5 seconds, one of ``share`` by hash, without the first and last five readings of a source. Errors are in
    units of the source's spread, each counted as ``most`` at most (hidden readings may be faulty). The factors are fitted without the hidden readings.
    """
    fields = list(fields)
    every = grid_sources(readings, schedule, fields, positive)
    block = lambda x: F.xxhash64(*KEYS, F.floor(x["second"] / 6))
    marks = F.transform("cells", lambda x: (F.pmod(block(x), F.lit(share)) == 0) & (F.pmod(x["second"], F.lit(6)) <= F.pmod(F.shiftright(block(x), 20), F.lit(5))))
    n = F.size("cells")
    marks = F.transform(marks, lambda m, i: m & (i >= 5) & (i < n - 5))
    both = stored(every.select(*KEYS, "seconds", F.col("cells").alias("all"), marks.alias("hidden")).withColumn("cells", F.filter("all", lambda x, i: ~F.element_at("hidden", i + 1))), "held")
    now = fitted(both.select("seconds", "cells"), fields, rank, rounds)
    lean = leaned(both.select("seconds", "cells"), now)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((len(fields), 5))
            whole = pa.RecordBatch.from_arrays([batch.column("seconds"), batch.column("all")], ["seconds", "cells"])
            for k, f in enumerate(fields):
                left, truth = Laid(batch, f), Laid(whole, f)
                at, source = left.places()
                hid = np.isnan(left.x[at]) & ~np.isnan(truth.x[at]) & (left.readings[source] >= 3)
                at, source = at[hid], source[hid]
                have = np.flatnonzero(~np.isnan(left.x))
                before = have[np.maximum(np.searchsorted(have, at) - 1, 0)]  # five readings lie on either side
                ways = (estimated(left, at, source, *now[f], lean[f]), np.interp(at, have, left.x[have]), left.x[before], left.centre[source])
                sums[k] = [len(at), *(np.minimum(np.abs(w - truth.x[at]) / left.scale[source], most).sum() for w in ways)]
            yield pa.RecordBatch.from_arrays([pa.array(fields), *(pa.array(sums[:, j]) for j in range(5))], ["field", "cells", "als", "linear", "last", "median"])

    parts = both.mapInArrow(score, "field string, cells double, als double, linear double, last double, median double")
    return parts.groupBy("field").agg(F.sum("cells").cast("bigint").alias("cells"), *(F.round(F.sum(c) / F.sum("cells"), 4).alias(c) for c in ("als", "linear", "last", "median")))
