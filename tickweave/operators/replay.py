"""Replay of limit and market orders as interval queries: earliest hit between arrival rows, validity up to the fill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators.asof import asof
from tickweave.operators.labels import AGE, SECOND
from tickweave.operators.lens import KEYS, ORDER
from tickweave.runtime import map_parts, same_key

FINAL = 10


def reached(side: int) -> Column:
    """What a row brings within reach, as side x price: limits whose side x price is that or more are hit. Null if it brings nothing.

    A limit is hit by the opposite quote at it, or by volume that traded strictly beyond it.
    """
    return F.least(*(F.col(c) * side for c in ("a" if side == 1 else "b",)), F.when(F.col("dv") > 0, F.col("p") * side + 1))


def orders(tasks: DataFrame, offsets: Sequence[int | tuple[int, int]] = (0,)) -> DataFrame:
    """Both sides and every passive offset (ticks) of each task (keys, task); of a pair the second is that of later limits."""
    pairs = [(int(k), int(k)) if isinstance(k, int) else (int(k[0]), int(k[1])) for k in offsets]
    each = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(a).alias("offset"), F.lit(b).alias("signal_offset")) for s in (1, -1) for a, b in pairs))
    return tasks.withColumn("_order", F.explode(each)).select(*tasks.columns, "_order.*")


def _records(path: Column, side: int, lo: Column, hi: Column) -> Column:
    """Rows from ``lo`` to ``hi`` that bring more within reach than every one before: (row, t, reach), the reach falling."""
    field = "buy" if side == 1 else "sell"
    part = F.transform(F.filter(path, lambda r: (r["row"] >= lo) & (r["row"] <= hi) & r[field].isNotNull()), lambda r: F.struct(r["row"].alias("row"), r["t"].alias("t"), r[field].alias("reach")))
    none = F.expr("cast(array() as array<struct<row:int,t:bigint,reach:double>>)")
    return F.aggregate(part, none, lambda seen, r: F.when((F.size(seen) == 0) | (r["reach"] < F.element_at(seen, -1)["reach"]), F.concat(seen, F.array(r))).otherwise(seen))


def paths(t: DataFrame, q: DataFrame, marks: Sequence[int]) -> DataFrame:
    """(keys, task, ...) of tasks with a usable start: per stage and side the records of the path, per command the row where it arrives.

    Each task's rows up to the arrival of its last command are looked up once (a join on blocks of row numbers) and gathered in order: they
    are what some ten seconds hold. All orders of the task are answered by the few records, whatever their limits.
    """
    rows = q.select(*KEYS, F.col("rn").alias("row"), "t", "a", "b", reached(1).alias("buy"), reached(-1).alias("sell"), (_good() & F.col("step") & F.col("edge_volume")).alias("legal"))
    last = F.coalesce(f"at{FINAL}", "top")
    span = t.where("why0 is null").withColumn("_last", last).withColumn("_b", F.explode(F.sequence(F.expr("rn0 div 64"), (last / 64).cast("bigint"))))
    near = span.select(*KEYS, "task", "rn0", "_last", "_b", *(f"at{s}" for s in marks)).join(rows.withColumn("_b", F.expr("row div 64")), [*KEYS, "_b"]).where("row > rn0 and row <= _last")
    path = near.groupBy(*KEYS, "task", "rn0", *(f"at{s}" for s in marks), "_last").agg(F.sort_array(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), "t", "a", "b", "buy", "sell", "legal"))).alias("path"))
    out = [F.array_min(F.transform(F.filter("path", lambda r: ~r["legal"]), lambda r: r["t"])).alias("broken")]
    for s, e in zip(marks[:-1], marks[1:]):
        out += [_records(F.col("path"), side, F.col(f"at{s}"), F.coalesce(f"at{e}", "_last")).alias(f"rec{s}_{'buy' if side == 1 else 'sell'}") for side in (1, -1)]
    for s in marks[1:]:
        out.append(F.get("path", (F.col(f"at{s}") - F.col("rn0") - 1).cast("int")).alias(f"row{s}"))
    return path.select(*KEYS, "task", *out)


def replay(tasks: DataFrame, q: DataFrame, decisions: Sequence[int] = (3,), offsets: Sequence[int | tuple[int, int]] = (0,), early: Sequence[int] = (), initial: bool = True) -> DataFrame:
    """(keys, task, side, offset, signal_offset, status, reason, stage, kind, fill_t, price, cost_bp) of orders that start as limits at the last price.

    ``tasks`` is (keys, task) in microseconds since the open. The limit stands ``offset`` ticks on the passive side of the last price at the
    task; without ``initial`` there is none before the first decision. At each of ``decisions`` seconds the state of the queue at the source row
    is the signal: against the order (side x signal above 0) it becomes a market order, else a limit at the then last price less
    ``signal_offset``; an unchanged limit stays. At 10 s what is left becomes a market order. At seconds of ``early``, before the first
    decision, a signal against the order makes it a market order too, any other or a missing source leaves it as it is. A command arrives at
    the second row strictly after it is given; until and including that row the old limit stands. A fill before the arrival takes
    precedence. Market orders take the opposite quote.

    An order is invalid if a source is missing, older than half a second or not valid, if a row from the task to its fill is not valid
    or does not follow its predecessor legally, or if the rows end too early; rows after the fill do not matter.
    """
    marks = [0, *early, *decisions, FINAL]
    if marks != sorted(set(marks)):
        raise ValueError("early checks come before decisions, and decisions before the end, in order of time")
    if early and not initial:
        raise ValueError("early checks need an initial order")
    t = tasks.select(*KEYS, "task").distinct().withColumn("mark", F.explode(F.array(*(F.lit(s) for s in marks))))
    t = t.withColumn("t", F.col("task") + F.col("mark").cast("bigint") * 1_000_000)
    t = asof(t, q.withColumn("good", _good()), KEYS, ["rn", "p", "qstate", "good"], order=ORDER[1:], prefix="s_")
    t = t.withColumn("why", F.when(F.col("s_t").isNull(), "no_source").when(F.col("t") - F.col("s_t") > AGE, "stale_source").when(~F.col("s_good"), "invalid_source"))
    of = lambda c, s: F.max(F.when(F.col("mark") == s, F.col(c)))
    t = t.groupBy(*KEYS, "task").agg(*(of(c, s).alias(f"{n}{s}") for s in marks for c, n in (("s_rn", "rn"), ("s_p", "p"), ("s_qstate", "state"), ("why", "why"))))
    t = t.join(q.groupBy(*KEYS).agg(F.max("rn").alias("top")), list(KEYS), "left")
    second = lambda s: F.coalesce(f"rn{s}", F.lit(0)) + 2
    t = t.withColumns({f"at{s}": F.when(second(s) <= F.col("top"), second(s)) for s in marks})
    for s in early:  # a source that can't be used is no signal
        t = t.withColumn(f"state{s}", F.when(F.col(f"why{s}").isNull(), F.col(f"state{s}")))
    t = t.join(paths(t, q, marks), [*KEYS, "task"], "left")
    x = orders(t, offsets)
    first = lambda s: s == 0 or s in early  # noqa: E731 - the initial limit stands
    limits = {f"limit{s}": F.col(f"p{0 if first(s) else s}") - F.col("side") * F.col("offset" if first(s) else "signal_offset") for s in marks[:-1]}
    x = x.withColumns(limits)
    stages = list(zip(marks[:-1], marks[1:]))

    def hit(s: int) -> Column:
        if s == 0 and not initial:
            return F.expr("cast(null as struct<row:int,t:bigint,reach:double>)")
        wanted = F.col("side") * F.col(f"limit{s}")
        return F.get(F.filter(F.when(F.col("side") == 1, F.col(f"rec{s}_buy")).otherwise(F.col(f"rec{s}_sell")), lambda r: r["reach"] <= wanted), F.lit(0))

    x = x.withColumns({f"hit{s}": hit(s) for s, _ in stages})
    # The first stage that ends the order, in order of time: a hit, a decision against it, at last the clock.
    pick: dict[str, Column] = {}

    def add(cond: Column, at: Column, name: Column, how: str, level: Column):
        for k, v in (("fill_t", at), ("stage", name), ("kind", F.lit(how)), ("_price", level)):
            pick[k] = pick[k].when(cond, v) if k in pick else F.when(cond, v)

    same = F.lit("initial")
    opposite = lambda e: F.when(F.col("side") == 1, F.col(f"row{e}.a")).otherwise(F.col(f"row{e}.b"))
    for n, (s, e) in enumerate(stages):
        if s == 0:
            name = same
        elif not initial and n == 1:
            name = F.lit("signal")
        else:
            name = F.when(F.col(f"limit{s}") == F.col(f"limit{marks[n - 1]}"), same).otherwise(F.lit("signal"))
        add(F.col(f"hit{s}").isNotNull(), F.col(f"hit{s}.t"), name, "limit", F.col(f"limit{s}"))
        same = name
        if e != FINAL:
            add(F.col("side") * F.col(f"state{e}") > 0, F.col(f"row{e}.t"), F.lit("signal"), "market", opposite(e))
    add(F.col(f"at{FINAL}").isNotNull(), F.col(f"row{FINAL}.t"), F.lit("deadline"), "market", opposite(FINAL))
    x = x.withColumns(pick)
    # What ends the order badly, at twice its time, clocks one later than rows: the first of these before the fill (a bad row at the fill too).
    ends = {"broken_path": F.col("broken") * 2}
    against = F.lit(False)
    for s in marks[1:]:  # a market order under way is not looked at again
        if s not in early:
            ends["signal" if s != FINAL else "deadline", s] = F.when(F.col(f"why{s}").isNotNull() & ~F.coalesce(against, F.lit(False)), (F.col("task") + s * 1_000_000) * 2 + 1)
        against = against | F.coalesce(F.col("side") * F.col(f"state{s}") > 0, F.lit(False))
    first_end = F.least(*ends.values()) if len(ends) > 1 else next(iter(ends.values()))
    x = x.withColumn("_end", F.when(first_end <= F.coalesce(F.col("fill_t") * 2, F.lit(1 << 62)), first_end))
    reason = F.when(F.col("why0").isNotNull(), F.concat(F.lit("initial_"), "why0"))
    for name, when in ends.items():
        reason = reason.when(F.col("_end") == when, F.lit(name) if isinstance(name, str) else F.concat(F.lit(f"{name[0]}_"), f"why{name[1]}"))
    reason = reason.when(F.col("fill_t").isNull(), "insufficient_arrival_tail")
    ok = F.col("reason").isNull()
    x = x.withColumn("reason", reason).withColumn("price", F.when(ok, F.col("_price")))
    cost = F.col("side") * (F.col("price") - F.col("p0")) / F.col("p0") * 1e4
    return x.select(*KEYS, "task", "side", "offset", "signal_offset", F.when(ok, "filled").otherwise("invalid").alias("status"), "reason", *(F.when(ok, F.col(c)).alias(c) for c in ("stage", "kind", "fill_t")), "price", cost.alias("cost_bp"))


#: Why a source is of no use, why an order is invalid, how it ended and as what: text by number, 0 is null.
WHY = ("no_source", "stale_source", "invalid_source")
REASONS = (None, *(f"{k}_{w}" for k in ("initial", "signal", "deadline") for w in WHY), "broken_path", "insufficient_arrival_tail")
STAGES = (None, "initial", "signal", "deadline")
FILLS = (None, "limit", "market")


def replay_policies(tasks: DataFrame, q: DataFrame, policies: Mapping[str, tuple[Sequence[int], bool]], most: int = 50_000) -> DataFrame:
    """(keys, task, side, status, reason, stage, kind, fill_t, price, cost_bp, policy): ``replay`` at the last price under each of ``policies`` (decisions, initial).

    One sorted pass over the rows answers them all: a session's tasks come with its first row, sources are looked up once for each clock, and the
    first row that reaches a limit is found in minima over stretches of 1, 2, 4, ... rows, whatever the number of rows. A session of over ``most``
    rows comes in parts; tasks whose last arrival isn't here yet wait for the next one.
    """
    import numpy as np

    marks = sorted({0, FINAL, *(int(s) for decisions, _ in policies.values() for s in decisions)})
    if marks[-1] != FINAL or any(list(decisions) != sorted({*decisions} - {0, FINAL}) for decisions, _ in policies.values()):
        raise ValueError("decisions come before the end, in order of time")
    listed = tasks.groupBy(*KEYS).agg(F.sort_array(F.collect_set("task")).alias("_tasks")).hint("merge")
    legal = (_good() & F.col("step") & F.col("edge_volume")).alias("legal")
    rows = q.select(*KEYS, "t", "rn", "p", "a", "b", reached(1).alias("buy"), reached(-1).alias("sell"), "qstate", _good().alias("good"), legal)
    rows = rows.join(listed, list(KEYS), "full").where("_tasks is not null")
    # A session without rows has one that is out of reach.
    rows = rows.withColumns({"_tasks": F.when(F.coalesce("rn", F.lit(1)) == 1, F.col("_tasks")), "t": F.coalesce("t", F.lit(1 << 43)), "good": F.coalesce("good", F.lit(False)), "legal": F.coalesce("legal", F.lit(False))})
    none, never = (1 << 62) + 1, 1 << 62

    def part(table: pa.Table, more: bool, state: dict) -> tuple[pa.Table | None, int]:
        first, n = ~same_key(table, KEYS), table.num_rows
        session = np.cumsum(first)
        number = lambda c: table.column(c).to_numpy()
        raw, p, good, qstate = number("t"), number("p").astype(float), number("good"), number("qstate").astype(float)
        t, bounds = (session << 44) + raw, np.append(np.flatnonzero(first), n)
        own = table.column("_tasks").combine_chunks()
        unit = np.repeat(session, pc.fill_null(pc.list_value_length(own), 0).to_numpy())
        at = own.flatten().to_numpy() + (unit << 44)
        if "left" in state:  # the first session goes on
            left, later = state.pop("left"), unit > 1
            at, unit = np.concatenate([left + (np.int64(1) << 44), at[later]]), np.concatenate([np.ones(len(left), np.int64), unit[later]])
        again = n
        if more:  # one session
            ready = np.searchsorted(t, at + FINAL * SECOND, side="right") + 1 < n
            done = len(at) if ready.all() else int(np.argmin(ready))
            state["left"] = at[done:] - (np.int64(1) << 44)
            again = max(0, int(np.searchsorted(t, at[done], side="right")) - 1) if done < len(at) else n - 1
            at, unit = at[:done], unit[:done]
        bad = np.append(np.where(number("legal"), n, np.arange(n)), n)
        bad = np.minimum.accumulate(bad[::-1])[::-1]  # the next row that is not legal, itself included
        least = {}
        for side, c in ((1, "buy"), (-1, "sell")):
            v = number(c).astype(float)
            least[side] = [np.append(np.where(np.isnan(v), np.inf, v), np.inf)]
        quote = {1: number("a").astype(float), -1: number("b").astype(float)}

        def reach(side: int, start: np.ndarray, wanted: np.ndarray, levels: int) -> np.ndarray:
            """The first row from ``start`` on that brings ``wanted`` within reach, if it is less than 2 ** levels rows away."""
            low, i = least[side], np.minimum(start, n)
            while len(low) < levels:
                low.append(np.minimum(low[-1], low[-1][np.minimum(np.arange(n + 1) + (1 << len(low) - 1), n)]))
            for k in range(levels - 1, -1, -1):
                i = np.where(low[k][i] <= wanted, i, np.minimum(i + (1 << k), n))
            return i

        def orders_of(at: np.ndarray, unit: np.ndarray) -> pa.Table:
            begin, end, task = bounds[unit - 1], bounds[unit], at - (unit << 44)
            source, why, arrive = {}, {}, {}
            for m in marks:
                s = np.searchsorted(t, at + m * SECOND, side="right") - 1
                lost = s < begin
                arrive[m], s = np.where(lost, begin + 1, s + 2), np.where(lost, begin, s)
                source[m], why[m] = s, np.where(lost, 1, np.where(at + m * SECOND - t[s] > AGE, 2, np.where(good[s], 0, 3)))
            there = {m: arrive[m] < end for m in marks}
            last = np.where(there[FINAL], arrive[FINAL], end - 1)
            row = {m: np.where(there[m], arrive[m], 0) for m in marks}
            limit, levels = {m: p[source[m]] for m in marks}, int(max(0, (last - arrive[0]).max() + 1)).bit_length()
            broken = bad[source[0] + 1]
            broken = np.where(broken <= last, raw[np.minimum(broken, n - 1)] * 2, none)
            cells: dict[str, list] = {c: [] for c in ("side", "reason", "stage", "kind", "fill_t", "price", "policy")}
            for side in (1, -1):
                hits = {m: reach(side, arrive[m], side * limit[m], levels) for m in marks[:-1]}
                against = {m: side * qstate[source[m]] > 0 for m in marks}
                for k, (decisions, initial) in enumerate(policies.values()):
                    mine = [0, *decisions, FINAL]
                    open_, fill, price = np.ones(len(at), bool), np.full(len(at), -1), np.full(len(at), np.nan)
                    stage, kind, name = np.zeros(len(at), np.int8), np.zeros(len(at), np.int8), np.ones(len(at), np.int8)

                    def ends(where: np.ndarray, rows_: np.ndarray, how: int, as_: np.ndarray | int, level: np.ndarray) -> None:
                        here = open_ & where  # noqa: B023
                        for cell, v in ((fill, rows_), (kind, how), (stage, as_), (price, level)):  # noqa: B023
                            np.copyto(cell, v, where=here, casting="unsafe")
                        open_[here] = False  # noqa: B023

                    for i, (s, e) in enumerate(zip(mine[:-1], mine[1:])):
                        if s:
                            name = np.full(len(at), 2, np.int8) if i == 1 and not initial else np.where(limit[s] == limit[mine[i - 1]], name, np.int8(2))
                        if s or initial:
                            ends(hits[s] <= np.where(there[e], arrive[e], last), hits[s], 1, name, limit[s])
                        if e != FINAL:
                            ends(against[e], np.where(there[e], arrive[e], -1), 2, 2, quote[side][row[e]])
                    ends(there[FINAL], arrive[FINAL], 2, 3, quote[side][row[FINAL]])
                    fill_t = raw[np.where(fill < 0, 0, fill)]
                    over, reason, gone = broken.copy(), np.full(len(at), REASONS.index("broken_path"), np.int8), np.zeros(len(at), bool)
                    for s in mine[1:]:  # a market order under way is not looked at again
                        clock = np.where((why[s] > 0) & ~gone, (task + s * SECOND) * 2 + 1, none)
                        reason = np.where(clock < over, why[s] + (6 if s == FINAL else 3), reason)
                        over = np.minimum(over, clock)
                        gone |= against[s]
                    reason = np.where(over <= np.where(fill < 0, never, fill_t * 2), reason, np.where(fill < 0, REASONS.index("insufficient_arrival_tail"), 0))
                    reason = np.where(why[0] > 0, why[0], reason)
                    ok = reason == 0
                    for c, v in (("side", np.full(len(at), side, np.int32)), ("reason", reason), ("stage", np.where(ok, stage, 0)), ("kind", np.where(ok, kind, 0)), ("fill_t", np.where(ok, fill_t, -1)), ("price", np.where(ok, price, np.nan)), ("policy", np.full(len(at), k, np.int8))):
                        cells[c].append(v)
            whole = {c: np.concatenate(v) for c, v in cells.items()}
            times = len(cells["side"])
            base = np.tile(p[source[0]], times)
            with np.errstate(invalid="ignore", divide="ignore"):
                cost = whole["side"] * (whole["price"] - base) / base * 1e4
            text = lambda codes, names: pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int8)), pa.array(names, pa.string())).dictionary_decode()
            keys = table.select(list(KEYS)).take(pa.array(np.tile(begin, times)))
            out = {c: keys.column(c) for c in KEYS} | {"task": np.tile(task, times), "side": whole["side"], "status": text(whole["reason"] > 0, ["filled", "invalid"])}
            out |= {c: text(whole[c], names) for c, names in (("reason", REASONS), ("stage", STAGES), ("kind", FILLS))}
            out |= {"fill_t": pa.array(whole["fill_t"], mask=whole["reason"] > 0), "price": pa.array(whole["price"], from_pandas=True), "cost_bp": pa.array(cost, from_pandas=True), "policy": text(whole["policy"], list(policies))}
            return pa.table(out)

        out = [orders_of(at[k : k + 10_000], unit[k : k + 10_000]) for k in range(0, len(at), 10_000)]
        return (pa.concat_tables(out) if out else None), again

    schema = ", ".join([*(f"{k} string" for k in KEYS), "task bigint, side int, status string, reason string, stage string, kind string, fill_t bigint, price double, cost_bp double, policy string"])
    return map_parts(rows, KEYS, ["rn"], part, schema, most=most, placed=True)


def market_orders(tasks: DataFrame, q: DataFrame) -> DataFrame:
    """(keys, task, side, price, cost_bp): market orders given at the task, filled at the second row after it if the path is legal."""
    t = asof(tasks.select(*KEYS, F.col("task"), F.col("task").alias("t")).distinct(), q.withColumn("good", _good()), KEYS, ["rn", "p", "good"], order=ORDER[1:], prefix="s_")
    t = t.where(F.col("s_good") & (F.col("t") - F.col("s_t") <= AGE))
    legal = (_good() & F.col("step") & F.col("edge_volume")).alias("legal")
    n1 = q.select(*KEYS, (F.col("rn") - 1).alias("s_rn"), legal)
    n2 = q.select(*KEYS, (F.col("rn") - 2).alias("s_rn"), legal.alias("legal2"), "a", "b")
    x = t.join(n1, [*KEYS, "s_rn"]).join(n2, [*KEYS, "s_rn"]).where("legal and legal2")
    x = x.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("price", F.when(F.col("side") == 1, F.col("a")).otherwise(F.col("b")))
    return x.select(*KEYS, "task", "side", "price", (F.col("side") * (F.col("price") - F.col("s_p")) / F.col("s_p") * 1e4).alias("cost_bp"))


def _good() -> Column:
    return F.col("valid_price") & F.col("valid_book") & F.col("valid_queue") & F.col("valid_volume")


def choose_action(side: Column, signal: Column, down: Column, up: Column, threshold: float) -> Column:
    """market against the order; passive if the odds favour waiting by ``threshold``; else lastprice."""
    favour = side * (down - up)
    return F.when(side * signal > 0, "market").when((side * signal < 0) & (favour >= threshold), "passive").otherwise("lastprice")
