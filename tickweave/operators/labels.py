"""Task schedules and labels: what the price does after a decision, by next-row lookups within a legal segment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators.asof import asof
from tickweave.operators.lens import KEYS, ORDER
from tickweave.runtime import map_parts, same_key

AGE = 500_000


@dataclass(frozen=True)
class Schedule:
    """Clock ticks anchored to the open: every ``step`` from the first at or after ``cold`` seconds, with observation cases."""

    cold: float = 10.0
    step: float = 1.0
    observations: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0, 5.0)

    def __post_init__(self) -> None:
        if not 0 <= self.cold or self.step <= 0:
            raise ValueError("cold must be at least 0 and step above 0")
        if not self.observations or len(set(self.observations)) != len(self.observations) or min(self.observations) < 0:
            raise ValueError("observations must be different and at least 0")


def schedule(sessions: DataFrame, plan: Schedule = Schedule()) -> DataFrame:
    """(keys, task, observation, t): the nominal tasks of every session below its length, and each case's decision time in microseconds."""
    step, cold = round(plan.step * 1e6), round(plan.cold * 1e6)
    first = -(-cold // step) * step
    s = sessions.where(f"session_seconds * 1000000L > {first}").select(*KEYS, F.explode(F.expr(f"sequence({first}L, session_seconds * 1000000L - 1, {step}L)")).alias("task"))
    s = s.withColumn("observation", F.explode(F.array(*(F.lit(round(o * 1e6)).cast("bigint") for o in plan.observations))))
    return s.withColumn("t", F.col("task") + F.col("observation"))


def origins(tasks: DataFrame, q: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Tasks with their source row (the last one up to the decision) and their arrival row (the second one after it), with statuses.

    Source status: NO_SOURCE, STALE_SOURCE (older than half a second), INVALID_INPUT (no valid price), ok. Arrival status follows the source's;
    MISSING_OR_GAPPED_ARRIVAL where there is no second row, its price is not valid or it lies beyond a break. Columns of ``carry`` come along
    from the source row as ``s_<name>``.
    """
    values = ["rn", "snap_id", "p", "seg_price", "valid_price"]
    x = asof(tasks, q, KEYS, [*values, *carry], order=ORDER[1:], prefix="s_").withColumn("_second", F.coalesce("s_rn", F.lit(0)) + 2)
    x = x.join(q.select(*KEYS, F.col("rn").alias("_second"), "t", *(v for v in values if v != "rn")).toDF(*KEYS, "_second", *(f"a_{v}" for v in ("t", *values[1:]))), [*KEYS, "_second"], "left").drop("_second")
    source = F.when(F.col("s_t").isNull(), "NO_SOURCE").when(F.col("t") - F.col("s_t") > AGE, "STALE_SOURCE").when(~F.col("s_valid_price"), "INVALID_INPUT").otherwise("ok")
    x = x.withColumn("source_status", source)
    arrives = F.coalesce(F.col("a_valid_price") & (F.col("a_seg_price") == F.col("s_seg_price")), F.lit(False))
    return x.withColumn("arrival_status", F.when(F.col("source_status") != "ok", F.col("source_status")).when(arrives, "ok").otherwise("MISSING_OR_GAPPED_ARRIVAL"))


SECOND = 1_000_000


def label_arrays(origin: DataFrame, q: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(keys, task, observation, ..., decision, arrival): per case the labels of both anchors, as arrays in order of horizon.

    An element is (horizon, y, status, late, y_incremental, incremental_status), see ``labels``. Cases share their starts (a decision time, an
    arrival row): ends are looked up once for each different start, gathered beside it, and joined back, so that no case is sorted with the rows.
    """
    horizons = sorted(int(u) for u in horizons)
    own = ("t", "source_status", "arrival_status", "s_t", "s_rn", "s_snap_id", "s_p", "s_seg_price", "s_valid_price")
    more = [c for c in origin.columns if c not in (*KEYS, "task", "observation", *own) and not c.startswith("a_")]
    starts = origin.select(*KEYS, F.explode(F.array("t", "a_t")).alias("start")).where("start is not null").distinct()
    points = starts.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("t", F.col("start") + F.col("horizon").cast("bigint") * SECOND)
    ends = asof(points, q, KEYS, ["p", "seg_price", "valid_price"], forward=True, order=ORDER[1:], prefix="e_")
    ends = ends.groupBy(*KEYS, "start").agg(F.sort_array(F.collect_list(F.struct("horizon", "e_t", "e_p", "e_seg_price", "e_valid_price"))).alias("ends"))
    x = origin.select(*KEYS, "task", "observation", *more, *(F.col(c) for c in own if c not in (*more, "s_snap_id", "s_rn", "s_valid_price", "s_t")), "a_t", "a_p", "a_seg_price")
    for name, at in (("decision", "t"), ("arrival", "a_t")):
        x = x.join(ends.select(*KEYS, F.col("start").alias(at), F.col("ends").alias(f"_{name}")), [*KEYS, at], "left")
    none = F.array(*(F.expr(f"struct({u} as horizon, cast(null as bigint) as e_t, cast(null as double) as e_p, cast(null as bigint) as e_seg_price, cast(null as boolean) as e_valid_price)") for u in horizons))

    def labelled(name: str, usable: Column, start: Column, p0: Column, seg0: Column) -> Column:
        def one(e: Column) -> Column:
            late = e["e_t"] - start - e["horizon"].cast("bigint") * SECOND
            good = F.coalesce(e["e_valid_price"] & (e["e_seg_price"] == seg0), F.lit(False))
            status = F.when(~usable, "INVALID_ORIGIN").when(e["e_t"].isNull(), "NO_FUTURE").when(late > AGE, "LATE_FUTURE").when(~good, "GAPPED_OR_INVALID_FUTURE").otherwise("ok")
            return F.struct(e["horizon"].alias("horizon"), status.alias("status"), F.when(status == "ok", e["e_p"] - p0).alias("y"), F.when(usable, late / 1e6).alias("late"))

        return F.transform(F.coalesce(f"_{name}", none), one).alias(name)

    x = x.withColumns({
        "_d": labelled("decision", F.col("source_status") == "ok", F.col("t"), F.col("s_p"), F.col("s_seg_price")),
        "_a": labelled("arrival", F.col("arrival_status") == "ok", F.col("a_t"), F.col("a_p"), F.col("a_seg_price")),
    })

    def stepped(c: str) -> Column:
        def one(e: Column, i: Column) -> Column:
            before = F.get(F.col(c), i - 1)
            state = F.when(e["status"] != "ok", e["status"]).when((i == 0) | (before["status"] == "ok"), "ok").otherwise("INVALID_PREVIOUS_ENDPOINT")
            step = F.when(state == "ok", e["y"] - F.coalesce(before["y"], F.lit(0.0)))
            return F.struct(e["horizon"].alias("horizon"), e["y"].alias("y"), e["status"].alias("status"), e["late"].alias("late"), step.alias("y_incremental"), state.alias("incremental_status"))

        return F.transform(c, one)

    return x.select(*KEYS, "task", "observation", *more, stepped("_d").alias("decision"), stepped("_a").alias("arrival"))


def labels(tasks: DataFrame | None, q: DataFrame, horizons: Sequence[int] = (1, 2, 3, 4, 5), origin: DataFrame | None = None) -> DataFrame:
    """(keys, task, observation, anchor, horizon, y, status, late, y_incremental, incremental_status), in ticks.

    Anchor ``decision`` starts at the decision and its source row, ``arrival`` at the arrival row. The end is the first row ``horizon`` seconds
    after the start or later. Status: INVALID_ORIGIN, NO_FUTURE, LATE_FUTURE (over half a second late), GAPPED_OR_INVALID_FUTURE, ok. The
    incremental label is the difference to the horizon before; both must be ok. ``origin`` is the result of ``origins`` where
    it has been made already; its columns besides those of rows come along.
    """
    x = label_arrays(origins(tasks, q) if origin is None else origin, q, horizons)
    more = [c for c in x.columns if c not in ("decision", "arrival")]
    both = F.explode(F.array(*(F.struct(F.lit(a).alias("anchor"), F.col(a).alias("each")) for a in ("decision", "arrival"))))
    return x.select(*more, both.alias("x")).select(*more, "x.anchor", F.explode("x.each").alias("e")).select(*more, "anchor", "e.horizon", "e.y", "e.status", "e.late", "e.y_incremental", "e.incremental_status")


#: What a label and its increment can be together.
STATES = (("INVALID_ORIGIN",) * 2, ("NO_FUTURE",) * 2, ("LATE_FUTURE",) * 2, ("GAPPED_OR_INVALID_FUTURE",) * 2, ("ok", "ok"), ("ok", "INVALID_PREVIOUS_ENDPOINT"))
TOTALS = {"labels": "sum", **{f"{c}_{n}": f for c in ("y", "y_incremental") for n, f in (("sum", "sum"), ("least", "min"), ("most", "max"))}, "y_size": "sum", "late_sum": "sum", "late_count": "sum"}


def label_totals(tasks: DataFrame, q: DataFrame, horizons: Sequence[int], most: int = 50_000) -> DataFrame:
    """(keys, observation, anchor, horizon, status, incremental_status, totals) of the labels that ``labels`` gives: their number, sum, least, most, size and mean lateness.

    No label leaves the pass over its session's rows: the session's cases come with its first row, ends are looked up once for each start, and
    only totals are given out. A session of over ``most`` rows comes in parts, whose totals are held until it ends.
    """
    import numpy as np

    ahead = np.array(sorted(int(u) for u in horizons), np.int64)
    listed = tasks.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("t", "observation"))).alias("_cases")).hint("merge")
    rows = q.select(*KEYS, *ORDER, "rn", "p", "seg_price", "valid_price").join(listed, list(KEYS), "full").where("_cases is not null")
    # A session without rows has one that is out of reach.
    rows = rows.withColumns({"_cases": F.when(F.coalesce("rn", F.lit(1)) == 1, F.col("_cases")), "t": F.coalesce("t", F.lit(1 << 43)), "valid_price": F.coalesce("valid_price", F.lit(False)), "seg_price": F.coalesce("seg_price", F.lit(-1))})
    by = [*KEYS, "observation", "anchor", "horizon", "status", "incremental_status"]

    def totals(table: pa.Table, first: np.ndarray, case: np.ndarray, at: np.ndarray, unit: np.ndarray) -> list[pa.Table]:
        """Of some cases, in order of session and observation: ``unit`` is the number of the session from 1, ``at`` the clock."""
        number = lambda c: table.column(c).to_numpy()
        n, t, p, seg, valid = table.num_rows, number("clock"), number("p"), number("seg_price"), number("valid_price")
        sound = np.where(valid, seg, -2)
        bounds = np.append(np.flatnonzero(first), n)
        begin, end = bounds[unit - 1], bounds[unit]
        s = np.searchsorted(t, at, side="right") - 1
        has = s >= begin
        arrival = np.where(has, s + 2, begin + 1)
        there = arrival < end
        s, arrival = np.where(has, s, 0), np.where(there, arrival, 0)
        usable = has & (at - t[s] <= AGE) & valid[s]
        starts = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (case[1:] != case[:-1])))
        out = []
        for anchor, good, start, row in (("decision", usable, at, s), ("arrival", usable & there & valid[arrival] & (seg[arrival] == seg[s]), t[arrival], arrival)):
            different, place = np.unique(start, return_inverse=True)
            e = np.searchsorted(t, different[:, None] + ahead * SECOND)[place]
            future = e < end[:, None]
            e = np.where(future, e, 0)
            late = t[e] - start[:, None] - ahead * SECOND
            state = np.full(e.shape, 4, np.int8)
            state[sound[e] != seg[row][:, None]] = 3
            state[late > AGE] = 2
            state[~future] = 1
            state[~good] = 0
            ok = state == 4
            y = np.where(ok, p[e] - p[row][:, None], 0.0)
            step = y.copy()
            step[:, 1:] -= y[:, :-1]
            state[:, 1:][ok[:, 1:] & ~ok[:, :-1]] = 5
            for k, (status, incremental) in enumerate(STATES):
                here = state == k
                if not here.any():
                    continue
                count = np.add.reduceat(here, starts, axis=0, dtype=np.int64)
                i, j = np.nonzero(count)
                summed = lambda v: np.add.reduceat(np.where(here, v, 0), starts, axis=0)[i, j]  # noqa: B023, E731
                edge = lambda f, v, none: f.reduceat(np.where(here, v, none), starts, axis=0)[i, j]  # noqa: B023, E731
                none = pa.nulls(len(i), pa.float64())
                cells = {"labels": count[i, j]}
                for c, v, known_here in (("y", y, k >= 4), ("y_incremental", step, k == 4)):
                    cells |= {f"{c}_sum": summed(v), f"{c}_least": edge(np.minimum, v, np.inf), f"{c}_most": edge(np.maximum, v, -np.inf)} if known_here else {f"{c}_{m}": none for m in ("sum", "least", "most")}
                none_late = np.zeros(len(i), np.int64)
                cells |= {"y_size": summed(np.abs(y)) if k >= 4 else none, "late_sum": summed(late) if k >= 2 else none_late, "late_count": count[i, j] if k >= 2 else none_late}
                keys = table.select(list(KEYS)).take(pa.array(begin[starts][i]))
                name = lambda v: pa.repeat(v, len(i))  # noqa: B023, E731
                out.append(pa.table({**{c: keys.column(c) for c in KEYS}, "observation": case[starts][i], "anchor": name(anchor), "horizon": ahead[j].astype(np.int32), "status": name(status), "incremental_status": name(incremental), **cells}))
        return out

    def part(table: pa.Table, more: bool, state: dict) -> tuple[pa.Table | None, int]:
        first = ~same_key(table, KEYS)
        session = np.cumsum(first)
        t = (session << 44) + table.column("t").to_numpy()
        own = table.column("_cases").combine_chunks()
        each, unit = own.flatten(), np.repeat(session, pc.fill_null(pc.list_value_length(own), 0).to_numpy())
        at, case = each.field("t").to_numpy() + (unit << 44), each.field("observation").to_numpy()
        if "left" in state:  # the first session goes on
            (left, left_case), later = state.pop("left"), unit > 1
            at, case, unit = np.concatenate([left + (np.int64(1) << 44), at[later]]), np.concatenate([left_case, case[later]]), np.concatenate([np.ones(len(left), np.int64), unit[later]])
        again = table.num_rows
        if more:  # one session: cases whose last end isn't here yet wait, with the rows from their source on
            s = np.searchsorted(t, at, side="right") - 1
            ready = (s + 2 < len(t)) & (np.maximum(at, t[np.minimum(s + 2, len(t) - 1)]) + ahead[-1] * SECOND <= t[-1])
            done = len(at) if ready.all() else int(np.argmin(ready))
            state["left"] = at[done:] - (np.int64(1) << 44), case[done:]
            again = max(0, int(s[done])) if done < len(at) else len(t) - 1
            at, case, unit = at[:done], case[:done], unit[:done]
        out = state.pop("held", [])
        order, apart = np.lexsort((case, unit)), bool(out)
        x, k, ends = table.append_column("clock", pa.array(t)), 0, np.append(np.flatnonzero(np.diff(unit)) + 1, len(unit))
        while k < len(order):  # some 20,000 cases at a time, whole sessions if they are no longer
            whole = ends[max(0, int(np.searchsorted(ends, k + 20_000, side="right")) - 1)]
            apart |= bool(whole <= k)
            upto = int(whole) if whole > k else k + 20_000
            here = order[k:upto]
            out += totals(x, first, case[here], at[here], unit[here])
            k = upto
        if not out:
            return None, again
        whole = pa.concat_tables(out)
        if more or apart:
            whole = whole.group_by(by).aggregate([(c, f) for c, f in TOTALS.items()]).rename_columns([*by, *TOTALS])
        if more:
            state["held"], whole = [whole], None
        return whole, again

    kinds = {"labels": "bigint", "late_sum": "bigint", "late_count": "bigint"}
    schema = ", ".join([*(f"{k} string" for k in KEYS), "observation bigint, anchor string, horizon int, status string, incremental_status string", *(f"{c} {kinds.get(c, 'double')}" for c in TOTALS)])
    x = map_parts(rows, KEYS, ORDER, part, schema, most=most, placed=True)
    return x.withColumn("late", F.try_divide(F.col("late_sum") / 1e6, F.col("late_count"))).drop("late_sum", "late_count")


def counted_signs(tasks: DataFrame, q: DataFrame, features: Sequence[str], horizon: int = 1, most: int = 50_000) -> DataFrame:
    """(trade_date, features, y, n): the sign of the decision's label over ``horizon`` seconds and the source row's features, with the number of cases alike.

    Of all cases with a source and a label in order and no feature missing. Cases of one decision time share both: each time is looked up once, in
    one pass over its session's rows, and counts as often as there are cases. A session of over ``most`` rows comes in parts.
    """
    import numpy as np

    features, ahead = list(features), int(horizon) * SECOND
    listed = tasks.groupBy(*KEYS).agg(F.sort_array(F.collect_list("t")).alias("_times")).hint("merge")
    rows = q.select(*KEYS, "t", "rn", "p", "seg_price", "valid_price", *features).join(listed, list(KEYS), "full").where("_times is not null")
    # A session without rows has one that is out of reach.
    rows = rows.withColumns({"_times": F.when(F.coalesce("rn", F.lit(1)) == 1, F.col("_times")), "t": F.coalesce("t", F.lit(1 << 43)), "valid_price": F.coalesce("valid_price", F.lit(False)), "seg_price": F.coalesce("seg_price", F.lit(-1))})
    by = ["trade_date", *features, "y"]

    def part(table: pa.Table, more: bool, state: dict) -> tuple[pa.Table | None, int]:
        first, n = ~same_key(table, KEYS), table.num_rows
        session = np.cumsum(first)
        number = lambda c: table.column(c).to_numpy()
        t, p, seg, valid = (session << 44) + number("t"), number("p").astype(float), number("seg_price"), number("valid_price")
        own = table.column("_times").combine_chunks()
        at = own.flatten().to_numpy() + (np.repeat(session, pc.fill_null(pc.list_value_length(own), 0).to_numpy()) << 44)
        if "left" in state:  # the first session goes on
            at = np.concatenate([state.pop("left") + (np.int64(1) << 44), at[at >> 44 > 1]])
        again = n
        if more:  # one session: times whose end isn't here yet wait, with the rows from their source on
            done = int(np.searchsorted(at, t[-1] - ahead, side="right"))
            state["left"] = at[done:] - (np.int64(1) << 44)
            again = max(0, int(np.searchsorted(t, at[done], side="right")) - 1) if done < len(at) else n - 1
            at = at[:done]
        at, times = np.unique(at, return_counts=True)
        s, e = np.searchsorted(t, at, side="right") - 1, np.searchsorted(t, at + ahead)
        fits = (s >= 0) & (e < n)
        s, e, at, times = s[fits], e[fits], at[fits], times[fits]
        x = np.column_stack([number(c)[s].astype(float) for c in features])
        # rows of another session are years away
        good = valid[s] & (at - t[s] <= AGE) & valid[e] & (t[e] - at - ahead <= AGE) & (seg[e] == seg[s]) & ~np.isnan(x).any(axis=1)
        if not good.any():
            return None, again
        out = {"trade_date": table.column("trade_date").take(pa.array(s[good]))} | {c: x[good, i] for i, c in enumerate(features)} | {"y": np.sign(p[e] - p[s])[good].astype(np.int32), "n": times[good]}
        alike = pa.table(out).group_by(by).aggregate([("n", "sum")])
        return alike.select([*by, "n_sum"]).rename_columns([*by, "n"]), again

    schema = ", ".join(["trade_date string", *(f"`{c}` double" for c in features), "y int, n bigint"])
    return map_parts(rows, KEYS, ["rn"], part, schema, most=most, placed=True).groupBy(*by).agg(F.sum("n").alias("n"))
