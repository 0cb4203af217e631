"""Queries of the order replay."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators import replay as rp
from tickweave.operators.labels import Schedule
from tickweave.operators.lens import KEYS, quotes_sql
from tickweave.plans.features import kept, rows
from tickweave.plans.fills import out
from tickweave.plans.labels import LASTS, ON, PLAN, TASKS, tasks
from tickweave.plans.oracle import rounded_sql as R

K = ", ".join(KEYS)
GOOD = "(valid_price AND valid_book AND valid_queue AND valid_volume)"


def path(spark: SparkSession, d: str) -> DataFrame:
    """What the replay reads of the lens, written once."""
    return kept(rows(spark, d), "p", "b", "a", "qb", "qa", "dv", "qstate", "step", "edge_volume", "valid_price", "valid_book", "valid_queue", "valid_volume")


def replay_sql(decisions: tuple[int, ...], offsets: tuple, whole: bool = False, early: tuple[int, ...] = (), initial: bool = True) -> str:
    """Step by step over all rows of each order: what stands before each row, and the first row that ends the order."""
    cost = "side * (price - p0) / p0 * 1e4"
    marks = [0, *early, *decisions, 10]
    src = "".join(f""", s{s} AS (SELECT {', '.join('x.' + k for k in KEYS)}, x.task, y.rn, y.p, y.qstate, y.t AS st, CASE WHEN y.t IS NULL THEN 'no_source' WHEN x.task + {s * 1000000} - y.t > 500000 THEN 'stale_source' WHEN NOT {GOOD.replace('valid', 'y.valid')} THEN 'invalid_source' END AS why
        FROM (SELECT *, task + {s * 1000000} AS t FROM tk) x ASOF LEFT JOIN lasts y ON {ON} AND x.t >= y.t)""" for s in marks)
    using = f"USING ({K}, task)"
    cols = ", ".join(f"s{s}.rn AS rn{s}, s{s}.p AS p{s}, {f'CASE WHEN s{s}.why IS NULL THEN s{s}.qstate END' if s in early else f's{s}.qstate'} AS q{s}, s{s}.why AS why{s}" for s in marks)
    top = f"(SELECT {K}, max(rn) AS top FROM q GROUP BY ALL)"
    arr = ", ".join(f"CASE WHEN coalesce(rn{s}, 0) + 2 <= top THEN coalesce(rn{s}, 0) + 2 END AS at{s}, p{0 if s in early else s} - side * {'off' if s == 0 or s in early else 'soff'} AS limit{s}" for s in marks)
    stages = list(zip(marks[:-1], marks[1:]))
    hits = ", ".join("CAST(NULL AS BIGINT) AS hit0" if s == 0 and not initial else f"min(r.rn) FILTER (WHERE r.rn BETWEEN at{s} AND coalesce(at{e}, top) AND CASE WHEN side = 1 THEN a <= limit{s} OR (dv > 0 AND r.p < limit{s}) ELSE b >= limit{s} OR (dv > 0 AND r.p > limit{s}) END) AS hit{s}" for s, e in stages)
    fill, stage, kind, price, prev = [], [], [], [], "'initial'"
    for n, (s, e) in enumerate(stages):
        prev = "'initial'" if s == 0 else "'signal'" if n == 1 and not initial else f"CASE WHEN limit{s} = limit{marks[n - 1]} THEN {prev} ELSE 'signal' END"
        fill.append(f"WHEN hit{s} IS NOT NULL THEN hit{s}"), stage.append(f"WHEN hit{s} IS NOT NULL THEN {prev}"), kind.append(f"WHEN hit{s} IS NOT NULL THEN 'limit'"), price.append(f"WHEN hit{s} IS NOT NULL THEN limit{s}")
        if e != 10:
            for lst, v in ((fill, f"at{e}"), (stage, "'signal'"), (kind, "'market'"), (price, "NULL")):
                lst.append(f"WHEN side * q{e} > 0 THEN {v}")
    for lst, v in ((fill, "at10"), (stage, "'deadline'"), (kind, "'market'"), (price, "NULL")):
        lst.append(f"WHEN at10 IS NOT NULL THEN {v}")
    ends = [("'broken_path'", "broken * 2")]
    for n, m in enumerate(marks[1:]):
        against = " OR ".join(["false", *(f"coalesce(side * q{e} > 0, false)" for e in marks[1 : n + 1])])
        if m not in early:
            ends.append((f"'{'deadline' if m == 10 else 'signal'}_' || why{m}", f"CASE WHEN why{m} IS NOT NULL AND NOT ({against}) THEN (task + {m * 1000000}) * 2 + 1 END"))
    first_end = f"least({', '.join(e for _, e in ends)})"
    late = " ".join(f"WHEN fin = {e} THEN {n}" for n, e in ends)
    case = lambda x: f"CASE {' '.join(x)} END"
    return f"""WITH {quotes_sql()}, {TASKS}, tk AS (SELECT DISTINCT {K}, task FROM tasks), {LASTS}{src},
    m AS (SELECT {K}, task, side, off, soff, {cols}, top FROM s0 {' '.join(f'JOIN s{s} {using}' for s in marks[1:])} LEFT JOIN {top} USING ({K}), (VALUES (1), (-1)) v(side), (VALUES {', '.join(f'({k}, {k})' if isinstance(k, int) else f'({k[0]}, {k[1]})' for k in offsets)}) w(off, soff)),
    a AS (SELECT *, {arr} FROM m),
    h AS (SELECT {', '.join('x.' + k for k in KEYS)}, task, side, off, soff, {hits}, min(r.t) FILTER (WHERE NOT ({GOOD.replace('valid', 'r.valid')} AND r.step AND r.edge_volume)) AS broken
        FROM a x JOIN q r ON {ON.replace('y.', 'r.')} AND r.rn > x.rn0 AND r.rn <= coalesce(at10, top) WHERE why0 IS NULL GROUP BY ALL),
    f AS (SELECT a.*, h.* EXCLUDE ({K}, task, side, off, soff), {case(fill)} AS fill_row, {case(stage)} AS stage, {case(kind)} AS kind, {case(price)} AS lim FROM a LEFT JOIN h USING ({K}, task, side, off, soff)),
    z AS (SELECT f.*, z.t AS fill_t, z.a AS ask, z.b AS bid, CASE WHEN {first_end} <= coalesce(z.t * 2, 4611686018427387904) THEN {first_end} END AS fin
        FROM f LEFT JOIN q z ON {' AND '.join(f'f.{k} = z.{k}' for k in KEYS)} AND f.fill_row = z.rn),
    y AS (SELECT *, CASE WHEN why0 IS NOT NULL THEN 'initial_' || why0 {late} WHEN fill_row IS NULL THEN 'insufficient_arrival_tail' END AS reason FROM z),
    e AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN kind = 'limit' THEN lim WHEN side = 1 THEN ask ELSE bid END END AS price FROM y)
    SELECT {K}, task, side, off AS "offset", soff AS signal_offset, CASE WHEN reason IS NULL THEN 'filled' ELSE 'invalid' END AS status, reason, CASE WHEN reason IS NULL THEN stage END AS stage, CASE WHEN reason IS NULL THEN kind END AS kind, CASE WHEN reason IS NULL THEN fill_t END AS fill_t, price, {cost if whole else R(cost)} AS cost_bp FROM e"""


def _replay(name: str, decisions: tuple[int, ...], offsets: tuple):
    def run(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
        return out(rp.replay(tasks(spark, d, plan), path(spark, d), decisions, offsets))

    run.__name__, run.__doc__ = name, f"Orders with decisions at {decisions} s and {len(offsets)} choices of passive offsets."
    return run


#: Every passive offset of the sweep of initial limits, in ticks, and of that of the limits at 3 s; the other limit rests at ``FIXED``.
OFFSETS, LATER, FIXED = tuple(range(61)), (*range(31), 40, 60), 19
SPECS = {
    "exec_two_stage": ((3,), (0,)),
    "exec_offset_sweep": ((3,), tuple((k, FIXED) for k in OFFSETS)),
    "exec_signal_sweep": ((3,), tuple((FIXED, k) for k in LATER)),
    "exec_repeated": ((3, 6, 9), (1,)),
}
QUERIES = {n: _replay(n, *s) for n, s in SPECS.items() if "sweep" not in n}
SQL = {n: replay_sql(*s) for n, s in SPECS.items() if "sweep" not in n}
CURVE = ["trade_date", "side", "offset", "signal_offset", "status", "reason", "stage", "kind"]


def _sweep(name: str):
    def run(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
        x = rp.replay(tasks(spark, d, plan), path(spark, d), *SPECS[name])
        return out(x.groupBy(*CURVE).agg(F.count("*").alias("orders"), F.avg("cost_bp").alias("cost_bp"), F.avg(F.col("fill_t") - F.col("task")).alias("elapsed"), F.sum("price").alias("price")))

    run.__name__, run.__doc__ = name, "Every order of the sweep, totalled per date, side, offsets and what became of it."
    return run


for _n in SPECS:
    if "sweep" in _n:
        QUERIES[_n] = _sweep(_n)
        SQL[_n] = f"""SELECT trade_date, side, "offset", signal_offset, status, reason, stage, kind, count(*) AS orders, {R('avg(cost_bp)')} AS cost_bp, {R('avg(fill_t - task)')} AS elapsed, {R('sum(price)')} AS price FROM ({replay_sql(*SPECS[_n], True)}) GROUP BY ALL"""
#: Policies: a limit at the last price until the end (A); none until a decision at 3 s (B); both (C), with further decisions (C36, C369).
POLICIES = {"A": ((), True), "B": ((3,), False), "C": ((3,), True), "C36": ((3, 6), True), "C369": ((3, 6, 9), True)}


def exec_policies(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Every task and side under each policy."""
    once = replace(plan, observations=plan.observations[:1])  # orders don't depend on the observation
    return out(rp.replay_policies(tasks(spark, d, once), rows(spark, d), POLICIES))


def exec_market(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Market orders of every task and side."""
    return out(rp.market_orders(tasks(spark, d, plan), rows(spark, d)))


def exec_fill_mix(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Mean cost and orders by decision schedule, stage and kind."""
    t, q = tasks(spark, d, plan), path(spark, d)
    x = None
    for name, dec in (("C3", (3,)), ("C36", (3, 6))):
        one = rp.replay(t, q, dec, (0,)).where("status = 'filled'").withColumn("policy", F.lit(name))
        x = one if x is None else x.unionByName(one)
    return out(x.groupBy("policy", "stage", "kind").agg(F.count("*").alias("orders"), F.avg("cost_bp").alias("cost_bp")))


def exec_early(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Orders that may turn into market orders at 1 s already."""
    return out(rp.replay(tasks(spark, d, plan), path(spark, d), (3,), (0,), (1,)))


QUERIES |= {"exec_policies": exec_policies, "exec_early": exec_early, "exec_market": exec_market, "exec_fill_mix": exec_fill_mix}
SQL["exec_policies"] = " UNION ALL ".join(f"SELECT '{n}' AS policy, * EXCLUDE (\"offset\", signal_offset) FROM ({replay_sql(dec, (0,), initial=first)})" for n, (dec, first) in POLICIES.items())
SQL["exec_early"] = replay_sql((3,), (0,), early=(1,))
SQL["exec_market"] = f"""WITH {quotes_sql()}, {TASKS}, tk AS (SELECT DISTINCT {K}, task, task AS t FROM tasks), {LASTS}, s AS (SELECT x.*, y.rn, y.p AS p0 FROM tk x ASOF JOIN lasts y ON {ON} AND x.t >= y.t WHERE x.t - y.t <= 500000 AND {GOOD.replace('valid', 'y.valid')})
    SELECT {', '.join('s.' + k for k in KEYS)}, task, side, CASE WHEN side = 1 THEN n2.a ELSE n2.b END AS price, {R('side * (CASE WHEN side = 1 THEN n2.a ELSE n2.b END - p0) / p0 * 1e4')} AS cost_bp FROM s JOIN q n1 ON {' AND '.join(f's.{k} = n1.{k}' for k in KEYS)} AND n1.rn = s.rn + 1 JOIN q n2 ON {' AND '.join(f's.{k} = n2.{k}' for k in KEYS)} AND n2.rn = s.rn + 2, (VALUES (1), (-1)) v(side)
    WHERE {GOOD.replace('valid', 'n1.valid')} AND n1.step AND n1.edge_volume AND {GOOD.replace('valid', 'n2.valid')} AND n2.step AND n2.edge_volume"""
_mix = lambda n, dec: f"SELECT '{n}' AS policy, * FROM ({replay_sql(dec, (0,), True)})"
SQL["exec_fill_mix"] = f"SELECT policy, stage, kind, count(*) AS orders, {R('avg(cost_bp)')} AS cost_bp FROM (({_mix('C3', (3,))}) UNION ALL ({_mix('C36', (3, 6))})) WHERE status = 'filled' GROUP BY 1, 2, 3"
