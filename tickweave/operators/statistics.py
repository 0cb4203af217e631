"""Grouped statistics: date-equal means, guarded correlations, weighted quantiles and moments, survival, selection, resampling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.operators.totals import running_totals
from tickweave.runtime import map_parts, same_key, stored


def two_level_mean(df: DataFrame, day: str, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean per day, then the mean of the days: every day counts the same. With the days that had a value (``<metric>_days``)."""
    daily = df.groupBy(day, *by).agg(*(F.avg(m).alias(m) for m in metrics))
    return daily.groupBy(*by).agg(*(F.avg(m).alias(m) for m in metrics), *(F.count(m).alias(f"{m}_days") for m in metrics))


def correlation(x: Column, y: Column, least: int = 20) -> dict[str, Column]:
    """Aggregates n, ic and status of the pairs of which both have a value: NOT_ENOUGH_PAIRS, CONSTANT_FACTOR, CONSTANT_LABEL, ok."""
    pair = x.isNotNull() & y.isNotNull()
    a, b = F.when(pair, x), F.when(pair, y)
    n = F.count(F.when(pair, 1))
    status = F.when(n < least, "NOT_ENOUGH_PAIRS").when(F.min(a) == F.max(a), "CONSTANT_FACTOR").when(F.min(b) == F.max(b), "CONSTANT_LABEL").otherwise("ok")
    value = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return {"n": n, "ic": F.when(status == "ok", F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))), "status": status}


def _average_ranks(counts: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by..., value, name): ranks with ties at their mean, from counts ``n`` per value, by running totals."""
    c = running_totals(counts.groupBy(*by, value).agg(F.sum("n").alias("_n")), by, [value], "_n", "_t")
    return c.select(*by, value, (F.col("_t") - (F.col("_n") - 1) / 2.0).alias(name))


def information(pairs: DataFrame, by: Sequence[str], least: int = 20) -> DataFrame:
    """(by..., n, ic, rank_ic, status) of factor ``x`` and label ``y``: Pearson, and Spearman with ranks on the joint sample.

    For groups of any size: pairs are counted, values ranked by running totals over partitions, and moments taken about the means. Groups of
    a bounded size and many columns go through ``information_cube``. Groups must not be null.
    """
    by = list(by)
    counts = stored(pairs.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count("*").alias("n")), "pairs")
    ranked = counts.join(_average_ranks(counts, by, "x", "rx"), [*by, "x"]).join(_average_ranks(counts, by, "y", "ry"), [*by, "y"])
    means = counts.groupBy(*by).agg(F.sum("n").alias("_n"), *((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"_{c}") for c in "xy"), *(f(c).alias(f"_{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))))
    m, n = ranked.join(means, by), F.col("n")
    off = {"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y"), "rx": F.col("rx") - (F.col("_n") + 1) / 2, "ry": F.col("ry") - (F.col("_n") + 1) / 2}
    cosine = lambda a, b: F.try_divide(F.sum(n * off[a] * off[b]), F.sqrt(F.sum(n * off[a] * off[a])) * F.sqrt(F.sum(n * off[b] * off[b])))
    found = m.groupBy(*by, "_n", "_lox", "_hix", "_loy", "_hiy").agg(cosine("x", "y").alias("_ic"), cosine("rx", "ry").alias("_rank"))
    every = pairs.select(*by).distinct().join(found, by, "left")
    status = F.when(F.coalesce("_n", F.lit(0)) < least, "NOT_ENOUGH_PAIRS").when(F.col("_lox") == F.col("_hix"), "CONSTANT_FACTOR").when(F.col("_loy") == F.col("_hiy"), "CONSTANT_LABEL").otherwise("ok")
    within = lambda c: F.when(status == "ok", F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(-1.0)))
    return every.select(*by, F.coalesce("_n", F.lit(0)).alias("n"), within("_ic").alias("ic"), within("_rank").alias("rank_ic"), status.alias("status"))


def column_ranks(a: np.ndarray) -> np.ndarray:
    """Rank of each value in its column, ties at their mean."""
    n, k = a.shape
    order = np.argsort(a, axis=0, kind="stable")
    s = np.take_along_axis(a, order, axis=0)
    new = np.ones((n, k), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    run = (np.cumsum(new, axis=0) - 1 + np.arange(k) * n).ravel()
    size = np.bincount(run, minlength=n * k).reshape(k, n)
    middle = (np.cumsum(size, axis=1) - (size - 1) / 2).ravel()
    out = np.empty((n, k))
    np.put_along_axis(out, order, middle[run].reshape(n, k), axis=0)
    return out


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each column: the rows in order of value, and of each row how many rows come before its value, and how many up to it. What is missing comes last."""
    n, k = a.shape
    order = np.argsort(a, axis=0, kind="stable")
    s = np.take_along_axis(a, order, axis=0)
    new = np.ones((n + 1, k), dtype=bool)
    new[1:-1] = s[1:] != s[:-1]
    at = np.arange(n)[:, None]
    begin = np.maximum.accumulate(np.where(new[:-1], at, 0), axis=0)
    end = np.minimum.accumulate(np.where(new[1:], at + 1, n)[::-1], axis=0)[::-1]
    before, upto = np.empty((2, n, k), dtype=np.int64)
    np.put_along_axis(before, order, begin, axis=0)
    np.put_along_axis(upto, order, end, axis=0)
    return order, before, upto


def _subset_ranks(runs: tuple[np.ndarray, np.ndarray, np.ndarray], known: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(row, column, mask): twice the rank of each value among its column's in the rows of each mask, off its mean, ties at their mean; 0 where the pair is missing.

    A column is sorted once; its ranks within a mask are running counts of the mask's rows. All numbers are whole.
    """
    order, before, upto = runs
    n, k = order.shape
    m = masks.shape[1]
    kind = np.int16 if n < 16_000 else np.int32
    count = np.zeros((n + 1, k, m), dtype=kind)
    np.take(masks.astype(kind), order, axis=0, out=count[1:], mode="clip")
    count[1:] *= np.take_along_axis(known, order, axis=0)[:, :, None]
    for i in range(1, n + 1):
        count[i] += count[i - 1]
    flat, column = count.reshape(-1, m), np.arange(k)
    twice = flat[before * k + column]
    twice += flat[upto * k + column]
    twice -= count[-1]
    twice *= known[:, :, None] & masks[:, None, :]
    return twice.astype(float)


def prepared(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(columns, where they have a value, values about the column's median or 0, ``_runs``), for ``pair_matrix``."""
    known, runs = ~np.isnan(a), _runs(a)
    if not len(a):
        return a, known, a, runs
    middle = runs[0][np.maximum(known.sum(axis=0) - 1, 0) // 2, np.arange(a.shape[1])]
    with np.errstate(invalid="ignore"):
        return a, known, np.where(known, a - a[middle, np.arange(a.shape[1])], 0.0), runs


def pair_matrix(x: np.ndarray | tuple, ys: Sequence[np.ndarray], least: int = 20, room: int = 500_000) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each matrix in ``ys``: (n, ic, rank_ic, status) of every column of ``x`` with every column of it, over the rows where both have a value; status by ``STATUS``.

    The matrices in ``ys`` have the same values missing; ``x`` may come ``prepared``. Ranks are those of the joint sample; their sums are whole
    numbers, so that a constant is told exactly. Moments are taken about the columns' medians, and about the pair's own means where too little
    would be left of them. Some ``room`` numbers are ranked at a time.
    """
    x, fx, cx, (order, before, upto) = x if isinstance(x, tuple) else prepared(x)
    fy = ~np.isnan(ys[0])
    n = fx.astype(float).T @ fy.astype(float)
    out = [(n.astype(np.int64), np.full(n.shape, np.nan), np.full(n.shape, np.nan), np.ones(n.shape, dtype=int)) for _ in ys]
    js, ks = np.flatnonzero((n >= least).any(axis=1)), np.flatnonzero((n >= least).any(axis=0))
    if not len(js):
        return out
    some, of = _distinct(fx[:, js])
    by = np.argsort(of, kind="stable")  # columns with the same rows come together
    of, js = of[by], js[by]
    x, fx, cx, order, before, upto = (v[:, js] for v in (x, fx, cx, order, before, upto))
    ys, fy, n = [prepared(y[:, ks]) for y in ys], fy[:, ks], n[np.ix_(js, ks)]
    masks, at = _distinct(fy)
    if masks.shape[1] == len(ks):
        masks, at = fy, None
    sxx, sxy, syy = np.empty(n.shape), np.empty((len(ys), *n.shape)), np.empty((len(ys), *n.shape))
    rows = len(x)
    width = max(1, room // (rows * len(ks)))  # of groups, and of columns
    edges = np.searchsorted(of, np.arange(some.shape[1] + 1))
    for g in range(0, some.shape[1], width):
        ry = [np.ascontiguousarray(_subset_ranks(y[3], fy, some[:, g : g + width]).transpose(2, 0, 1)) for y in ys]
        for lo in range(edges[g], edges[min(g + width, some.shape[1])], width):
            hi = min(lo + width, edges[min(g + width, some.shape[1])])
            rx = _subset_ranks(tuple(v[:, lo:hi] for v in (order, before, upto)), fx[:, lo:hi], masks)
            size = np.einsum("ijb,ijb->jb", rx, rx)
            sxx[lo:hi] = size if at is None else size[:, at]
            if at is not None and masks.shape[1] > 1:
                rx = rx[:, :, at]
            for k in range(of[lo], of[hi - 1] + 1):
                i, j = max(edges[k], lo), min(edges[k + 1], hi)
                for t, r in enumerate(ry):
                    own = rx[:, i - lo : j - lo]
                    sxy[t, i:j] = own[:, :, 0].T @ r[k - g] if masks.shape[1] == 1 else np.einsum("ijb,ib->jb", own, r[k - g])
                    syy[t, i:j] = np.einsum("ij,ij->j", r[k - g], r[k - g])
    gx, gy = fx.astype(float), fy.astype(float)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        px, pxx = cx.T @ gy, (cx * cx).T @ gy
        vx = pxx - px * px / n
    to = np.ix_(js, ks)
    for (y, _, cy, _), xy, yy, (_, ic, rank, status) in zip(ys, sxy, syy, out):
        state = np.where(n < least, 1, np.where(sxx == 0, 2, np.where(yy == 0, 3, 0)))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            r = np.clip(xy / (np.sqrt(sxx) * np.sqrt(yy)), -1, 1)
            py, pyy = gx.T @ cy, gx.T @ (cy * cy)
            vy = pyy - py * py / n
            c = np.clip((cx.T @ cy - px * py / n) / (np.sqrt(vx) * np.sqrt(vy)), -1, 1)
            weak = (state == 0) & ~((vx > 1e-4 * pxx) & (vy > 1e-4 * pyy) & np.isfinite(c))
        for j, k in zip(*np.nonzero(weak)):
            both = fx[:, j] & fy[:, k]
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = (v - v.mean() for v in (x[both, j], y[both, k]))
                c[j, k] = np.clip((a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), -1, 1)
        status[to], ic[to], rank[to] = state, np.where(state == 0, c, np.nan), np.where(state == 0, r, np.nan)
    return out


def _distinct(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different columns, and the number of each column's."""
    _, first, of = np.unique(np.packbits(masks, axis=0), axis=1, return_index=True, return_inverse=True)
    return masks[:, first], of.ravel()


STATUS = ("ok", "NOT_ENOUGH_PAIRS", "CONSTANT_FACTOR", "CONSTANT_LABEL")


KINDS, TARGETS, COHORTS = ("cumulative", "incremental"), ("signed", "absolute"), ("own", "common")


def _cubes(wide: DataFrame, factors: list[str], horizons: list[int], observations: int, unit: list[str], block: int, least: int, kinds: Sequence[str], targets: Sequence[str], cohorts: Sequence[str], task: Sequence[str], give: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``give(keys, first, width, parts)`` of every unit and block of factors: parts are (observation, number of the labels' part, n, ic, rank_ic, status)."""
    groups = [(a, k) for a in ("decision", "arrival") for k in kinds]
    blocks = -(-len(factors) // block)
    listed = "cases" in wide.columns
    d = wide.select(*unit, *(c for c in (*task, "observation") if c in wide.columns), *["cases"] * listed, "x", "y").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("x", F.slice("x", F.col("block") * block + 1, block))

    def numbers(c: pa.ChunkedArray, n: int) -> np.ndarray:
        return c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)

    def cube(table: pa.Table) -> pa.Table:
        x, y = numbers(table.column("x"), table.num_rows), numbers(table.column("y"), table.num_rows)
        place, own = np.arange(table.num_rows), {c: table.column(c).combine_chunks() for c in (*task, "observation") if c in table.column_names}
        if listed:
            each = table.column("cases").combine_chunks()
            place = np.repeat(place, pc.fill_null(pc.list_value_length(each), 0).to_numpy())
            own = {c: v.take(pa.array(place)) for c, v in own.items()} | {c: each.flatten().field(c) for c in ("task", "observation")}
        one = np.zeros(len(place), np.int64)
        for k in task:
            one = np.unique(one * (len(place) + 1) + own[k].dictionary_encode().indices.fill_null(len(place)).to_numpy(), return_inverse=True)[1].ravel()
        case = own["observation"].to_numpy()
        at = {o: place[case == o] for o in np.unique(case)}
        known = {o: prepared(x[rows]) for o, rows in at.items()}
        parts = []
        for c in range(len(groups)):
            part = y[:, c * len(horizons) : (c + 1) * len(horizons)]
            if "common" in cohorts:
                whole = ~np.isnan(part).any(axis=1)
                full = np.stack([np.bincount(one, (whole & ~np.isnan(x[:, j]))[place]) for j in range(x.shape[1])], axis=1) == observations
            for o, rows in at.items():
                for i, cohort in enumerate(cohorts):
                    xx, yy = known[o], part[rows]
                    if cohort == "common":
                        here = full[one[case == o]]
                        among = here.any(axis=1)
                        xx, yy = np.where(here, x[rows], np.nan)[among], yy[among]
                    for t, found in enumerate(pair_matrix(xx, [yy if target == "signed" else np.abs(yy) for target in targets], least)):
                        parts.append((int(o), (c * len(targets) + t) * len(cohorts) + i, *found))
        return give([table.column(k)[0].as_py() for k in unit], table.column("block")[0].as_py() * block, x.shape[1], parts)

    return d.groupBy(*unit, "block").applyInArrow(cube, schema)


def _parts(kinds: Sequence[str], targets: Sequence[str], cohorts: Sequence[str]) -> list[tuple[str, str, str, str]]:
    return [(a, k, t, c) for a in ("decision", "arrival") for k in kinds for t in targets for c in cohorts]


def information_cube(wide: DataFrame, factors: Sequence[str], horizons: Sequence[int], observations: int, unit: Sequence[str], block: int = 512, least: int = 20, kinds: Sequence[str] = KINDS, targets: Sequence[str] = TARGETS, cohorts: Sequence[str] = COHORTS, task: Sequence[str] = ("task",)) -> DataFrame:
    """(unit..., factor, observation, anchor, label, target, cohort, horizon, n, status, ic, rank_ic) of every factor and label.

    ``wide`` has the columns of ``unit`` (text: what is correlated by itself, such as a contract's day), of ``task`` (what names a task within the
    unit), observation, x (array: the factors' values) and y (array of the labels: anchor decision and arrival, of each the ``kinds``, of each the
    horizons). Target: the label or its size. Cohort ``own``: the rows where both have a value; ``common``: those of the tasks where the factor
    and all horizons have one in all ``observations`` cases. Cases with the same values may share a row: ``cases`` (array of task, observation)
    then stands for these two. A group is a unit and ``block`` factors: its rows are those of one unit, bounded by the unit's clock.
    """
    factors, horizons, unit = list(factors), [int(h) for h in horizons], list(unit)
    names = _parts(kinds, targets, cohorts)

    def give(keys: list, first: int, width: int, parts: list[tuple]) -> pa.Table:
        each, h = width * len(horizons), len(horizons)
        out = {k: pa.repeat(pa.scalar(v, pa.string()), len(parts) * each) for k, v in zip(unit, keys)}
        out |= {"factor": pa.array(np.tile(np.repeat(factors[first : first + width], h), len(parts))), "observation": pa.array(np.repeat([p[0] for p in parts], each))}
        out |= {c: pa.array(np.repeat([names[p[1]][i] for p in parts], each)) for i, c in enumerate(("anchor", "label", "target", "cohort"))}
        out["horizon"] = pa.array(np.tile(np.array(horizons, np.int32), width * len(parts)))
        n, ic, rank, status = (np.concatenate([p[i].ravel() for p in parts]) for i in range(2, 6))
        # what has no value is null, not NaN
        return pa.table(out | {"n": n, "status": np.array(STATUS)[status], "ic": pa.array(ic, from_pandas=True), "rank_ic": pa.array(rank, from_pandas=True)})

    schema = ", ".join([*(f"`{k}` string" for k in unit), "factor string, observation bigint, anchor string, label string, target string, cohort string, horizon int, n bigint, status string, ic double, rank_ic double"])
    return _cubes(wide, factors, horizons, observations, unit, block, least, kinds, targets, cohorts, task, give, schema)


def cube_summary(wide: DataFrame, factors: Sequence[str], horizons: Sequence[int], observations: int, unit: Sequence[str], block: int = 512, least: int = 20, kinds: Sequence[str] = KINDS, targets: Sequence[str] = TARGETS, cohorts: Sequence[str] = COHORTS, task: Sequence[str] = ("task",), most: int = 20_000) -> DataFrame:
    """``information_summary`` of ``information_cube`` by factor, observation, anchor, label, target, cohort and horizon, without its rows.

    A unit gives a row per factor, observation and part of the labels, with all horizons' values in it as bytes; those of a factor,
    observation and part are summed up together, some 500 bytes a unit.
    """
    factors, horizons, unit = list(factors), [int(h) for h in horizons], list(unit)
    names, h = _parts(kinds, targets, cohorts), len(horizons)
    cell = np.dtype([("ic", "<f8", h), ("rank_ic", "<f8", h), ("status", "i1", h)])

    def give(keys: list, first: int, width: int, parts: list[tuple]) -> pa.Table:
        v = np.empty((len(parts), width), cell)
        for i, (_, _, _, ic, rank, status) in enumerate(parts):
            v[i]["ic"], v[i]["rank_ic"], v[i]["status"] = ic, rank, status
        ends = pa.array(np.arange(v.size + 1, dtype=np.int32) * cell.itemsize).buffers()[1]
        cells = pa.Array.from_buffers(pa.binary(), v.size, [None, ends, pa.py_buffer(v.tobytes())])
        return pa.table({"factor": np.tile(np.arange(first, first + width, dtype=np.int32), len(parts)), "observation": np.repeat(np.array([p[0] for p in parts], np.int64), width), "part": np.repeat(np.array([p[1] for p in parts], np.int32), width), "cells": cells})

    def totals(v: np.ndarray) -> dict[str, np.ndarray]:
        """Of (group, unit) cells: statistics by group and horizon."""
        out = {}
        for c in ("ic", "rank_ic"):
            a = np.sort(v[c], axis=1)  # what is missing comes last
            known = ~np.isnan(a)
            days = known.sum(axis=1)

            def percentile(p: float) -> np.ndarray:
                at = np.maximum(days - 1, 0) * p  # noqa: B023
                low = np.floor(at).astype(int)
                lo, hi = (np.take_along_axis(a, i[:, None], axis=1)[:, 0] for i in (low, np.ceil(at).astype(int)))  # noqa: B023
                return np.where(lo == hi, lo, (low + 1 - at) * lo + (at - low) * hi)

            with np.errstate(divide="ignore", invalid="ignore"):
                out[f"{c}_mean"] = mean = np.where(known, a, 0.0).sum(axis=1) / days
                out[f"{c}_median"] = median = percentile(0.5)
                off = np.where(known, a - median[:, None], 0.0)  # what is the same every day has no spread
                off = np.where(known, off - (off.sum(axis=1) / days)[:, None], 0.0)
                out[f"{c}_std"] = std = np.sqrt((off * off).sum(axis=1) / np.where(days > 1, days - 1, np.nan))
                out[f"{c}_p10"] = percentile(0.1)
                out[f"{c}_ir"] = np.where(std == 0, np.nan, mean / std)
            out[f"{c}_positive_days"], out[f"{c}_negative_days"] = (a > 1e-12).sum(axis=1), (a < -1e-12).sum(axis=1)
            out["days"] = out.get("days", days)
        return out | {f"days_{s.lower()}": (v["status"] == k).sum(axis=1) for k, s in enumerate(STATUS) if k}

    keys, text = ["factor", "observation", "part"], ("anchor", "label", "target", "cohort")

    def part(table: pa.Table, more: bool, state: dict) -> tuple[pa.Table | None, int]:
        if more:  # the units of a group too long for one part wait
            last = table.num_rows - 1
            state.setdefault("held", []).append(table.slice(0, last))
            return None, last
        if "held" in state:
            table = pa.concat_tables([*state.pop("held"), table])
        v = np.frombuffer(b"".join(table.column("cells").to_pylist()), cell)
        begin = np.flatnonzero(~same_key(table, keys))
        size = np.diff(np.append(begin, len(v)))
        key = {k: table.column(k).to_numpy()[begin] for k in keys}
        out = []
        for units in np.unique(size):
            here = np.flatnonzero(size == units)
            step = max(1, most // int(units))
            for i in range(0, len(here), step):
                some = here[i : i + step]
                row = {"factor": np.array(factors)[key["factor"][some]], "observation": key["observation"][some]} | {c: np.array([p[j] for p in names])[key["part"][some]] for j, c in enumerate(text)}
                row = {c: np.repeat(a, h) for c, a in row.items()} | {"horizon": np.tile(np.array(horizons, np.int32), len(some))}
                found = totals(v[begin[some][:, None] + np.arange(units)])
                out.append(pa.table(row | {c: pa.array(a.ravel(), from_pandas=a.dtype.kind == "f") for c, a in found.items()}))
        return pa.concat_tables(out).select(columns), table.num_rows

    cubes = _cubes(wide, factors, horizons, observations, unit, block, least, kinds, targets, cohorts, task, give, "factor int, observation bigint, part int, cells binary")
    numbers = ", ".join(f"{c}_{n} {'bigint' if n.endswith('days') else 'double'}" for c in ("ic", "rank_ic") for n in ("mean", "median", "std", "p10", "ir", "positive_days", "negative_days"))
    schema = f"factor string, observation bigint, anchor string, label string, target string, cohort string, horizon int, {numbers}, days bigint, " + ", ".join(f"days_{s.lower()} bigint" for s in STATUS[1:])
    columns = [c.split()[0] for c in schema.split(", ")]
    return map_parts(cubes, keys, [], part, schema, most=most)


def information_summary(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """Over days: mean, median, spread, p10, ratio and signs of ic and rank_ic, valid days and days of each status."""
    z = lambda c: F.count_if(F.col(c) > 1e-12)
    aggs = []
    for c in ("ic", "rank_ic"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.expr(f"percentile({c}, 0.5)").alias(f"{c}_median"), F.stddev_samp(c).alias(f"{c}_std"), F.expr(f"percentile({c}, 0.1)").alias(f"{c}_p10"), F.try_divide(F.avg(c), F.stddev_samp(c)).alias(f"{c}_ir"), z(c).alias(f"{c}_positive_days"), F.count_if(F.col(c) < -1e-12).alias(f"{c}_negative_days")]
    return daily.groupBy(*by).agg(*aggs, F.count("ic").alias("days"), *(F.count_if(F.col("status") == s).alias(f"days_{s.lower()}") for s in ("NOT_ENOUGH_PAIRS", "CONSTANT_FACTOR", "CONSTANT_LABEL")))


def weighted_quantiles(df: DataFrame, by: Sequence[str], value: str, weight: str, percents: Sequence[float]) -> DataFrame:
    """(by..., percent, value): the least value whose cumulative weight reaches the percent of the total (a left-continuous step)."""
    d = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, F.col(value).alias("_x")).agg(F.sum(weight).alias("_w"))
    d = running_totals(d, by, ["_x"], "_w", "_t").withColumn("_c", F.col("_t") / F.col("_t_all"))
    return d.groupBy(*by).agg(*(F.min(F.when(F.col("_c") >= p - 1e-12, F.col("_x"))).alias(f"p{round(p * 100)}") for p in percents))


def weighted_moments(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean, population sd, skewness and excess kurtosis, from two passes so that large means do not cancel."""
    w, x = F.col(weight), F.col(value)
    d = df.where(x.isNotNull() & (w > 0)).select(*by, w.alias("_w"), x.alias("_x"))
    first = d.groupBy(*(F.col(k).alias(f"_{k}") for k in by)).agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("mean"), F.sum("_w").alias("_total"))
    on = F.lit(True)
    for k in by:  # null is a group
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    d = d.join(first, on).withColumn("_d", F.col("_x") - F.col("mean"))
    m = d.groupBy(*by, "mean", "_total").agg(*((F.sum(F.col("_w") * F.pow("_d", F.lit(float(k)))) / F.first("_total")).alias(f"_m{k}") for k in (2, 3, 4)))
    sd = F.sqrt("_m2")
    return m.select(*by, "mean", sd.alias("sd"), F.try_divide(F.col("_m3"), F.pow(sd, F.lit(3.0))).alias("skew"), (F.try_divide(F.col("_m4"), F.pow(sd, F.lit(4.0))) - 3).alias("kurtosis"))


def survival(df: DataFrame, by: Sequence[str], duration: str, event: str, weight: str) -> DataFrame:
    """Weighted Kaplan-Meier curve at every time of an event; at ties events come before censoring."""
    by = list(by)
    d = df.where(F.col(duration).isNotNull()).groupBy(*by, F.col(duration).alias("time")).agg(F.sum(weight).alias("_all"), F.sum(F.when(F.col(event) == 1, F.col(weight)).otherwise(0.0)).alias("died"))
    d = running_totals(d, by, ["time"], "_all", "_upto").withColumn("at_risk", F.col("_upto_all") - F.col("_upto") + F.col("_all")).where("died > 0")
    gone = F.col("died") >= F.col("at_risk") - 1e-12
    d = d.withColumns({"_log": F.when(gone, 0.0).otherwise(F.log1p(-F.col("died") / F.col("at_risk"))), "_end": gone.cast("int")}).select(*by, "time", "at_risk", "died", "_log", "_end")
    d = running_totals(running_totals(d, by, ["time"], "_log", "_sum"), by, ["time"], "_end", "_over")
    return d.withColumn("survival", F.when(F.col("_over") > 0, 0.0).otherwise(F.exp("_sum"))).select(*by, "time", "at_risk", "died", "survival")


def best(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def leave_one_out(daily: DataFrame, by: Sequence[str], day: str, metric: str) -> DataFrame:
    """Each day left out: the mean of the others per ``by``, by arithmetic on totals."""
    w = Window.partitionBy(*by)
    n = F.count(metric).over(w)
    return daily.withColumn("without", F.try_divide(F.sum(metric).over(w) - F.col(metric), n - 1)).select(*by, F.col(day).alias("left_out"), "without")


def ecdf(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., value, share): share of rows up to each distinct value."""
    d = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return running_totals(d, by, [value], "_n", "_t").select(*by, value, (F.col("_t") / F.col("_t_all")).alias("share"))


def holm(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Holm's step-down adjustment: the running maximum of (m - rank + 1) p, 1 at most."""
    w = Window.partitionBy(*by)
    k = F.row_number().over(w.orderBy(p, *[c for c in df.columns if c != p]))
    d = df.withColumn("_k", k).withColumn("_raw", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(w) - F.col("_k") + 1)))
    return d.withColumn("adjusted", F.max("_raw").over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))).drop("_k", "_raw")


def weighted_line(df: DataFrame, by: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted least squares y = a + b x with R squared; three points at least."""
    w, u, v = F.col(weight), F.col(x), F.col(y)
    s = df.where(u.isNotNull() & v.isNotNull() & (w > 0)).groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("w"), *(F.sum(e).alias(n) for n, e in (("x", w * u), ("y", w * v), ("xx", w * u * u), ("xy", w * u * v), ("yy", w * v * v))))
    sxx, sxy, syy = (F.expr(e) for e in ("xx - x * x / w", "xy - x * y / w", "yy - y * y / w"))
    b = F.when(F.col("n") >= 3, F.try_divide(sxy, sxx))
    return s.withColumn("b", b).select(*by, "n", F.expr("(y - b * x) / w").alias("a"), "b", F.when(F.col("n") >= 3, F.try_divide(sxy * sxy, sxx * syy)).alias("r2"))


def histogram(df: DataFrame, by: Sequence[str], value: str, weight: str, lo: float, width: float, bins: int) -> DataFrame:
    """(by..., bin, weight): weight in bins of fixed edges, closed on the left; the last takes what lies on its end; values outside have none."""
    hi = lo + width * bins
    k = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(*by, k.alias("bin")).agg(F.sum(weight).alias("weight"))


SEED = 20260928


def block_draws(spark: SparkSession, days: Sequence[str], repeats: int = 5000, block: int = 5, seed: int = SEED) -> DataFrame:
    """(repeat, day, times): circular moving blocks of days. Days are few by nature.

    Where a block starts is the MD5 of seed, repeat and the block's number: the same in every engine, without a generator's state.
    """
    n = len(days)
    names = spark.createDataFrame(list(enumerate(days)), "_i bigint, day string")
    if not n:
        return spark.createDataFrame([], "repeat int, day string, times int")
    blocks = spark.range(repeats).select(F.col("id").cast("int").alias("repeat"), F.explode(F.sequence(F.lit(0), F.lit(-(-n // block) - 1))).alias("_j"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "repeat", "_j").cast("binary")), 1, 15), 16, 10).cast("bigint")
    each = blocks.withColumn("_s", drawn % n).select("repeat", "_j", "_s", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_k")).where(F.col("_j") * block + F.col("_k") < n)
    times = each.groupBy("repeat", ((F.col("_s") + F.col("_k")) % n).alias("_i")).agg(F.count("*").cast("int").alias("times"))
    return times.join(F.broadcast(names), "_i").select("repeat", "day", "times")


def block_draws_sql(days: str, repeats: int = 5000, block: int = 5, seed: int = SEED) -> str:
    """The same for DuckDB as ``dr`` (repeat, day, times); ``days`` is a query of one column ``day``."""
    return f"""dd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM ({days}) WHERE day IS NOT NULL)), nn AS (SELECT count(*) AS n FROM dd),
    bl AS (SELECT r, j, CAST('0x' || substr(md5('{seed}|' || r || '|' || j), 1, 15) AS BIGINT) % n AS s, n FROM range({repeats}) a(r), range(1000) b(j), nn WHERE j * {block} < n),
    dr AS (SELECT r AS repeat, day, count(*) AS times FROM bl, range({block}) c(k), dd WHERE j * {block} + k < n AND dd.i = (s + k) % n GROUP BY ALL)"""


def block_interval(daily: DataFrame, by: Sequence[str], day: str, metric: str, repeats: int = 5000, block: int = 5, seed: int = SEED) -> DataFrame:
    """(by..., mean, low, high): mean over days with the 2.5 and 97.5 percentiles of its resamples in blocks of days."""
    days = sorted(r[0] for r in daily.select(day).where(F.col(day).isNotNull()).distinct().collect())
    draws = block_draws(daily.sparkSession, days, repeats, block, seed)
    d = daily.select(*by, F.col(day).alias("day"), F.col(metric).alias("_m")).where("_m is not null")
    means = d.join(draws, "day").groupBy(*by, "repeat").agg((F.sum(F.col("_m") * F.col("times")) / F.sum("times")).alias("_m"))
    bounds = means.groupBy(*by).agg(F.expr("percentile(_m, 0.025)").alias("low"), F.expr("percentile(_m, 0.975)").alias("high"))
    return d.groupBy(*by).agg(F.avg("_m").alias("mean")).join(bounds, list(by))


def block_ratio(daily: DataFrame, by: Sequence[str], day: str, top: str, bottom: str, repeats: int = 5000, block: int = 5, seed: int = SEED) -> DataFrame:
    """(by..., ratio, low, high): a ratio of sums over days with its block resamples, from the days' own sums."""
    days = sorted(r[0] for r in daily.select(day).where(F.col(day).isNotNull()).distinct().collect())
    draws = block_draws(daily.sparkSession, days, repeats, block, seed)
    d = daily.select(*by, F.col(day).alias("day"), F.col(top).alias("_a"), F.col(bottom).alias("_b"))
    each = d.join(draws, "day").groupBy(*by, "repeat").agg(F.try_divide(F.sum(F.col("_a") * F.col("times")), F.sum(F.col("_b") * F.col("times"))).alias("_r"))
    bounds = each.groupBy(*by).agg(F.expr("percentile(_r, 0.025)").alias("low"), F.expr("percentile(_r, 0.975)").alias("high"))
    return d.groupBy(*by).agg(F.try_divide(F.sum("_a"), F.sum("_b")).alias("ratio")).join(bounds, list(by))


def retention(df: DataFrame, by: Sequence[str], duration: str, clocks: Sequence[float]) -> DataFrame:
    """(by..., clock, open, share): rows still open after each clock. Each row is counted once per group, not once per clock and row pair."""
    n = df.where(F.col(duration).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), *(F.count_if(F.col(duration) > float(c)).alias(f"_c{i}") for i, c in enumerate(clocks)))
    each = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("clock"), F.col(f"_c{i}").alias("open")) for i, c in enumerate(clocks))))
    return n.select(*by, "_n", each.alias("x")).select(*by, "x.clock", "x.open", (F.col("x.open") / F.col("_n")).alias("share"))


def forward_choice(daily: DataFrame, option: str, day: str, metric: str, train: int) -> DataFrame:
    """(option, train, test): the option of least mean over the first ``train`` days (ties by name), with its mean over those and over the later days."""
    rank = daily.select(day).distinct().withColumn("_k", F.row_number().over(Window.orderBy(day)))
    x = daily.join(F.broadcast(rank), day).groupBy(option).agg(F.avg(F.when(F.col("_k") <= train, F.col(metric))).alias("train"), F.avg(F.when(F.col("_k") > train, F.col(metric))).alias("test"))
    return x.where("train is not null").orderBy("train", option).limit(1)


def circular_blocks(daily: DataFrame, by: Sequence[str], day: str, metric: str, block: int = 5) -> DataFrame:
    """(by..., start, mean): the mean of every circular block of days."""
    w = Window.partitionBy(*by).orderBy(day)
    d = daily.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    d = d.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda j: F.pmod(F.col("_k") - j, F.col("_n")))))
    return d.groupBy(*by, "start").agg(F.avg(metric).alias("mean"))


def sign_flip(values: Sequence[float]) -> float:
    """Exact two-sided sign-flip p value of the mean of up to 40 days: the share of sign patterns with at least its size.

    Meet in the middle: sums over either half of the days, sorted; per sum of the one, a search counts what the other completes.
    """
    x = np.asarray(values, float)
    if not 0 < len(x) <= 40:
        raise ValueError("between 1 and 40 values")

    def sums(part: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for v in part:
            out = np.concatenate([out + v, out - v])
        return np.sort(out)

    # Patterns and their opposites come in pairs: both tails are counted by the upper one, unless every pattern is extreme.
    a, b = sums(x[: len(x) // 2]), sums(x[len(x) // 2 :])
    least = abs(x.sum()) - 1e-12
    if least <= 0:
        return 1.0
    above = len(a) * len(b) - int(np.searchsorted(b, least - a, side="left").sum())
    return 2 * above / (len(a) * len(b))


def sign_flip_days(values: Sequence[float], most: int = 1 << 19, cells: int = 1 << 20) -> float:
    """``sign_flip`` of any number of days, all of them in every pattern.

    Up to 40 days as there. Beyond: a pattern is extreme if the sizes of the days that go against it sum to at most ``room``. The different sums up
    to there and their shares are carried from day to day, equal ones as one, which is exact; if they come to more than ``most``, they move onto
    a grid of ``cells`` up to ``room``, and a sum between two cells is shared out so that it keeps its mean: p is then off by some 1e-7 at most.
    """
    x = np.asarray(values, float)
    if len(x) <= 40:
        return sign_flip(x)
    size, least = np.sort(np.abs(x))[::-1], abs(x.sum()) - 1e-12
    if least <= 0:
        return 1.0
    room = (size.sum() - least) / 2 + 1e-13 * size.sum()  # sums in another order
    step, sums, share, grid = room / cells, np.zeros(1), np.ones(1), None
    for v in size:
        if grid is None:
            s = np.concatenate([sums, sums + v])
            near, place = np.unique(np.round(s / size[0], 12), return_inverse=True)  # the same sum in another order
            whole = np.bincount(place, np.concatenate([share, share]) / 2)
            first = np.zeros(len(near))
            first[place] = s
            keep = first <= room
            sums, share = first[keep], whole[keep]
            if len(sums) > most:
                at = sums / step
                low = np.minimum(at.astype(np.int64), cells)
                grid = np.bincount(low, share * (low + 1 - at), cells + 2) + np.bincount(low + 1, share * (at - low), cells + 2)
        else:
            grid = grid / 2
            low = int(v / step)
            moved = grid.copy()
            for k, part in ((low, low + 1 - v / step), (low + 1, v / step - low)):
                if k < len(grid):
                    moved[k:] += part * grid[: len(grid) - k]
            grid = moved
    # the cell at the edge stands for half a cell on either side
    return float(min(1.0, 2 * (share.sum() if grid is None else grid[:cells].sum() + grid[cells] / 2)))


def block_flip(values: Sequence[float], blocks: int = 4) -> float:
    """``sign_flip`` of whole stretches of days: days in order are cut into ``blocks`` parts whose sums keep or change their sign together."""
    return sign_flip([float(p.sum()) for p in np.array_split(np.asarray(values, float), min(blocks, len(values)))])


def kept_together(df: DataFrame, key: Sequence[str], what: str, values: int) -> DataFrame:
    """Keys that have all ``values`` different values of ``what``: the common sample."""
    return df.groupBy(*key).agg(F.count_distinct(what).alias("_n")).where(F.col("_n") == values).drop("_n")


def require_unique(df: DataFrame, key: Sequence[str], name: str = "table") -> DataFrame:
    """``df`` itself, or ValueError if a key occurs twice: the contract of the one side of a join."""
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"{name}: {', '.join(key)} is not unique")
    return df


def scopes(df: DataFrame, second: str, spans: Mapping[str, tuple[int, int]]) -> DataFrame:
    """A row per named half-open span of seconds that holds it: overlapping scopes by one explode."""
    s = F.array(*(F.when((F.col(second) >= lo) & (F.col(second) < hi), F.lit(n)) for n, (lo, hi) in spans.items()))
    return df.withColumn("scope", F.explode(F.filter(s, lambda v: v.isNotNull())))


def sides(df: DataFrame, direction: str = "direction") -> DataFrame:
    """Every row once for both sides and once for its own."""
    own = F.when(F.col(direction) == 1, "buy").when(F.col(direction) == -1, "sell")
    return df.withColumn("side", F.explode(F.filter(F.array(F.lit("both"), own), lambda v: v.isNotNull())))
