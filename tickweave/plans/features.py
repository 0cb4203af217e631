"""Queries of the row lens and the factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.catalog import AGES, ROW, SEGMENTS, WINDOWED
from tickweave.operators import factors
from tickweave.operators.factors import PRIMITIVE
from tickweave.operators.lens import GROUPS, JOINT, quotes, quotes_sql
from tickweave.plans.oracle import ROUND, aggregate_sql, rounded_sql, windowed_sql
from tickweave.runtime import stored
from tickweave.sources.tables import table

H = 5


def rows(spark: SparkSession, d: str) -> DataFrame:
    return quotes(table(spark, d, "snapshots"), table(spark, d, "sessions"), table(spark, d, "contracts"))


def kept(q: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the row lens as a written table, for plans that read the lens more than once."""
    return stored(q.select("Contract", "trade_date", "session", "snap_id", "source_row", "t", "rn", *columns), "lens")


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """snap_id and the other columns, doubles rounded as the SQL rounds them."""
    keep = [(c, t) for c, t in df.dtypes if c not in ("Contract", "trade_date", "session", "t")]
    return df.select(*(F.expr(rounded_sql(f"`{c}`", digits)).alias(c) if t == "double" else F.col(c) for c, t in keep))


def _family(group: str, families: tuple[str, ...], h: int):
    keys = [k for k in WINDOWED if k[0] == group and k[1] in families]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(factors.window_factors(rows(spark, d), keys, (h,), status=False))

    run.__doc__ = f"Factors {', '.join(families)} of group {group} over {h} s."
    return run, windowed_sql(keys, h)


FAMILIES = {
    "book_spread": ("book", ("A01",), 5), "book_moves": ("book", ("B06", "B08"), 10), "queue_depth": ("queue", ("A02", "A03", "A05"), 5), "queue_slopes": ("queue", ("A04", "B03"), 10), "queue_sides": ("queue", ("B01", "B02"), 5), "quote_position": ("position", ("A06",), 5),
    "ofi_flow": ("ofi", ("F03", "A07", "A08"), 5), "ofi_same_quote": ("ofi", ("B04", "B05"), 10), "price_moves": ("price", ("F05", "F06", "C01", "C02", "C03", "R06"), 5), "price_drawdown": ("price", ("C04",), 10), "price_counts": ("price", ("C05",), 5), "sign_runs": ("price", ("C06",), 10),
    "moving_mean": ("price", ("M01", "M03"), 5), "trend": ("price", ("M11",), 10), "volume_rate": ("volume", ("D01", "D02", "D04", "R06"), 5), "price_volume": ("price_volume", ("F08", "D04", "D08", "M10"), 5), "sync_corr": ("price_volume", ("D09",), 10), "volume_depth": ("volume_depth", ("D05", "D06"), 5), "price_ofi": ("price_ofi", ("D07",), 5),
}
QUERIES, SQL = {}, {}
for _name, _spec in FAMILIES.items():
    QUERIES[f"factor_{_name}"], SQL[f"factor_{_name}"] = _family(*_spec)


def segment_islands(spark: SparkSession, d: str) -> DataFrame:
    """Validity, legal steps and the size of the segment of every row."""
    x = rows(spark, d)
    from pyspark.sql import Window

    cols = {}
    for g in (*GROUPS, *JOINT):
        w = Window.partitionBy("Contract", "trade_date", "session", f"seg_{g}")
        cols[f"size_{g}"] = F.when(F.col(f"valid_{g}"), F.sum(F.when(F.col(f"valid_{g}"), 1).otherwise(0)).over(w)).otherwise(0).cast("bigint")
    return x.withColumns(cols).select("snap_id", *cols, *(F.col(f"edge_{g}").cast("int").alias(f"edge_{g}") for g in (*GROUPS, *JOINT)))


QUERIES["segment_islands"] = segment_islands
SQL["segment_islands"] = f"""WITH {quotes_sql()} SELECT snap_id, {", ".join(f"CAST(CASE WHEN valid_{g} THEN count(*) FILTER (WHERE valid_{g}) OVER (PARTITION BY Contract, trade_date, session, seg_{g}) ELSE 0 END AS BIGINT) AS size_{g}, CAST(edge_{g} AS INTEGER) AS edge_{g}" for g in (*GROUPS, *JOINT))} FROM q"""


def row_factors(spark: SparkSession, d: str) -> DataFrame:
    """Factors of single rows, with statuses."""
    return rounded(factors.row_factors(rows(spark, d)))


QUERIES["factor_rows"] = row_factors
SQL["factor_rows"] = f"""WITH {quotes_sql()} SELECT snap_id, {", ".join(f"{rounded_sql('CASE WHEN ' + ('edge_' if s else 'valid_') + g + ' THEN ' + e + ' END')} AS {f}_{n}, CASE WHEN NOT valid_{g} THEN 'INVALID_INPUT' WHEN {'edge' if s else 'valid'}_{g} THEN 'ok' ELSE 'NO_HISTORY' END AS {f}_{n}__status" for (f, n), (g, s, e) in ROW.items())} FROM q"""


def status_window(spark: SparkSession, d: str) -> DataFrame:
    """Status of every row's momentum over 5 and 10 s."""
    x = factors.window_factors(rows(spark, d), [("price", "F05", "Momentum"), ("price", "C02", "Asymmetry")], (5, 10))
    return x.select("snap_id", *(c for c in x.columns if c.endswith("__status")))


QUERIES["factor_status"] = status_window
SQL["factor_status"] = f"""WITH {quotes_sql()},
    c AS (SELECT i.snap_id AS id, h, max(i.t) - min(j.t) AS cov, count(*) FILTER (WHERE j.dp <> 0 AND j.l_t >= i.t - h * 1000000) AS moves FROM q i JOIN q j USING (Contract, trade_date, session, seg_price), (VALUES (5), (10)) v(h)
        WHERE j.rn <= i.rn AND j.t >= i.t - h * 1000000 AND i.valid_price AND j.valid_price GROUP BY 1, 2),
    s AS (SELECT snap_id, v.h, CASE WHEN NOT valid_price THEN 'INVALID_INPUT' WHEN cov = 0 THEN 'NO_COVERAGE' WHEN cov * 10 < 8000000 * v.h THEN 'WARMUP' ELSE 'ok' END AS st, moves
        FROM q CROSS JOIN (VALUES (5), (10)) v(h) LEFT JOIN c ON c.id = snap_id AND c.h = v.h)
    SELECT snap_id, {", ".join(f"max(st) FILTER (WHERE h = {h}) AS F05_Momentum_h{h}s__status, max(CASE WHEN st = 'ok' AND moves = 0 THEN 'ZERO_DENOM' ELSE st END) FILTER (WHERE h = {h}) AS C02_Asymmetry_h{h}s__status" for h in (5, 10))} FROM s GROUP BY 1"""


def ages(spark: SparkSession, d: str) -> DataFrame:
    """Ages of events with their bounds."""
    return rounded(factors.age_factors(rows(spark, d)))


QUERIES["factor_ages"] = ages


def _ages_sql() -> str:
    out = []
    for p, (g, e) in AGES.items():
        e = f"edge_{g} AND {e}"
        last = f"max(CASE WHEN {e} THEN t END) OVER (PARTITION BY Contract, trade_date, session, seg_{g} ORDER BY rn)"
        began = f"min(CASE WHEN valid_{g} THEN t END) OVER (PARTITION BY Contract, trade_date, session, seg_{g})"
        v = f"valid_{g}"
        out.append(f"{rounded_sql(f"CASE WHEN {v} THEN (t - {last}) / 1e6 END")} AS {p}, {rounded_sql(f"CASE WHEN {v} THEN (t - coalesce({last}, {began})) / 1e6 END")} AS {p}LowerBound, CASE WHEN {v} THEN CASE WHEN {last} IS NULL THEN 1e0 ELSE 0e0 END END AS {p}LeftCensored, CASE WHEN NOT {v} THEN 'INVALID_INPUT' WHEN {last} IS NULL THEN 'LEFT_CENSORED' ELSE 'ok' END AS {p}__status")
    return f"WITH {quotes_sql()} SELECT *, {rounded_sql('B07_BidAge - B07_AskAge')} AS B07_AgeDifference FROM (SELECT snap_id, {', '.join(out)} FROM q)"


SQL["factor_ages"] = _ages_sql()


def adjacent_segments(spark: SparkSession, d: str) -> DataFrame:
    """Changes between adjacent segments of 2 and 5 s."""
    return rounded(factors.segment_factors(rows(spark, d)))


QUERIES["factor_segments"] = adjacent_segments


def _segments_sql(lags: tuple[int, ...] = (2, 5)) -> str:
    """Each window with the number of its first row, joined to that row's own window."""
    tables, columns, joins = [], [], []
    for stem, (family, g, formula, how) in SEGMENTS.items():
        for lag in lags:
            place: dict[tuple, str] = {("cov", None): "c0"}
            text = PRIMITIVE.sub(lambda m: place.setdefault((m[1], m[2]), f"c{len(place)}"), formula)
            n = f"w{len(joins)}"
            aggs = ", ".join(f"{aggregate_sql(op, x, g, lag)} AS {a}" for (op, x), a in place.items())
            tables.append(f"""{n} AS (SELECT id, k, CASE WHEN c0 > 0 AND c0 >= {0.8 * lag} THEN {text} END AS v FROM (SELECT i.snap_id AS id, arg_min(j.snap_id, j.rn) AS k, any_value(i.p) AS p, {aggs}
                FROM q i JOIN q j USING (Contract, trade_date, session, seg_{g}) WHERE j.rn <= i.rn AND j.t >= i.t - {lag * 1000000} AND i.valid_{g} AND j.valid_{g} GROUP BY 1))""")
            joins.append(f"LEFT JOIN {n} ON {n}.id = snap_id LEFT JOIN {n} e{n} ON e{n}.id = {n}.k")
            change = f"{n}.v - e{n}.v" if how == "difference" else f"CASE WHEN {n}.v + e{n}.v > 0 THEN ({n}.v - e{n}.v) / ({n}.v + e{n}.v) END"
            columns.append(f"{rounded_sql(change)} AS {family}_{stem}_lag{lag}s")
    return f"WITH {quotes_sql()}, {', '.join(tables)} SELECT snap_id, {', '.join(columns)} FROM q {' '.join(joins)}"


SQL["factor_segments"] = _segments_sql()


def opening(spark: SparkSession, d: str) -> DataFrame:
    """Position against the session so far."""
    return rounded(factors.opening_factors(rows(spark, d)))


QUERIES["factor_opening"] = opening
SQL["factor_opening"] = f"""WITH {quotes_sql()},
    x AS (SELECT i.snap_id, any_value(i.p) AS p, any_value(i.valid_price) AS vp, any_value(i.valid_price_volume) AS vpv, arg_min(j.p, j.rn) FILTER (WHERE j.valid_price) AS f, max(j.p) FILTER (WHERE j.valid_price) AS hi, min(j.p) FILTER (WHERE j.valid_price) AS lo,
        max(j.p) FILTER (WHERE j.valid_price AND j.rn < i.rn) AS phi, min(j.p) FILTER (WHERE j.valid_price AND j.rn < i.rn) AS plo, sum(j.l_p * j.dt) FILTER (WHERE j.edge_price) AS pt, sum(j.dt) FILTER (WHERE j.edge_price) AS tt,
        sum(j.p * j.dv) FILTER (WHERE j.edge_price_volume) AS pv, sum(j.dv) FILTER (WHERE j.edge_price_volume) AS vv
        FROM q i JOIN q j USING (Contract, trade_date, session) WHERE j.rn <= i.rn GROUP BY 1)
    SELECT snap_id, {", ".join(f"{rounded_sql(f'CASE WHEN vp THEN {e} END')} AS {n}" for n, e in (("R01_OpeningMove", "p - f"), ("R02_DistanceHigh", "p - hi"), ("R02_DistanceLow", "p - lo"), ("R02_OpeningRange", "hi - lo"), ("R02_OpeningLocation", "CASE WHEN hi > lo THEN (2 * p - hi - lo) / (hi - lo) END"), ("R03_PriorHighDistance", "p - phi"), ("R03_PriorLowDistance", "p - plo"), ("R03_NewHigh", "CASE WHEN p > phi THEN 1.0 WHEN phi IS NOT NULL THEN 0.0 END"), ("R03_NewLow", "CASE WHEN p < plo THEN 1.0 WHEN plo IS NOT NULL THEN 0.0 END"), ("M02_OpeningMADeviation", "p - pt / nullif(tt, 0)")))},
        {rounded_sql('CASE WHEN vpv AND vv > 0 THEN p - pv / vv END')} AS M10_OpeningVWDeviation FROM x"""


def _quality(group: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(factors.quality_factors(rows(spark, d), group, (H,)))

    run.__doc__ = f"What the windows of group {group} rest on."
    return run


for _g in (*GROUPS, *JOINT):
    QUERIES[f"quality_{_g}"] = _quality(_g)
    _p, _h = f"R06_{_g}_", f"_h{H}s"
    SQL[f"quality_{_g}"] = f"""WITH {quotes_sql()},
    w AS (SELECT i.snap_id AS id, (max(i.t) - min(j.t)) / 1e6 AS cov, count(*) AS n, max(j.dt) FILTER (WHERE j.edge_{_g} AND j.l_t >= i.t - {H * 1000000}) AS gap FROM q i JOIN q j USING (Contract, trade_date, session, seg_{_g})
        WHERE j.rn <= i.rn AND j.t >= i.t - {H * 1000000} AND i.valid_{_g} AND j.valid_{_g} GROUP BY 1),
    m AS (SELECT i.snap_id AS id, bool_and(j.valid_{_g}) AND bool_and(j.edge_{_g} OR j.rn = s.first) AS whole FROM q i JOIN q j USING (Contract, trade_date, session) JOIN (SELECT i.snap_id, min(j.rn) AS first FROM q i JOIN q j USING (Contract, trade_date, session) WHERE j.t BETWEEN i.t - {H * 1000000} AND i.t GROUP BY 1) s ON s.snap_id = i.snap_id
        WHERE j.t BETWEEN i.t - {H * 1000000} AND i.t GROUP BY 1),
    o AS (SELECT snap_id AS id, coalesce(sum(dt) FILTER (WHERE edge_{_g}) OVER w, 0.0) AS oc, min(t) FILTER (WHERE valid_{_g}) OVER w / 1e6 AS delay, count(*) FILTER (WHERE valid_{_g} AND NOT edge_{_g}) OVER w - 1 AS gaps,
        (t - min(t) FILTER (WHERE valid_{_g}) OVER (PARTITION BY Contract, trade_date, session, seg_{_g})) / 1e6 AS age FROM q WINDOW w AS (PARTITION BY Contract, trade_date, session ORDER BY rn))
    SELECT snap_id, {rounded_sql(f'cov')} AS {_p}Coverage{_h}, CAST(coalesce(n, 0) AS DOUBLE) AS {_p}Count{_h}, CASE WHEN cov > 0 AND cov >= {0.8 * H} THEN 0e0 ELSE 1e0 END AS {_p}Warmup{_h}, {rounded_sql(f'cov / {H}')} AS {_p}CoverageRatio{_h},
        {rounded_sql(f'CASE WHEN valid_{_g} THEN t / 1e6 - cov END')} AS {_p}StartSeconds{_h}, {rounded_sql(f'CASE WHEN valid_{_g} THEN t / 1e6 END')} AS {_p}EndSeconds{_h}, CAST(coalesce(n - 1, 0) AS DOUBLE) AS {_p}IncrementCount{_h}, {rounded_sql(f'gap')} AS {_p}MaxInterval{_h}, CASE WHEN whole THEN 0e0 ELSE 1e0 END AS {_p}GapFlag{_h},
        {rounded_sql(f'CASE WHEN valid_{_g} THEN age END')} AS {_p}SegmentAge, {rounded_sql(f'oc')} AS {_p}OpeningCoverage, {rounded_sql(f'delay')} AS {_p}StartDelay, CAST(greatest(gaps, 0) AS DOUBLE) AS {_p}GapCount, {rounded_sql(f'CASE WHEN t > 0 THEN oc / (t / 1e6) END')} AS {_p}OpeningCoverageRatio
    FROM q LEFT JOIN w ON w.id = snap_id LEFT JOIN m ON m.id = snap_id LEFT JOIN o ON o.id = snap_id"""


def mean_states(spark: SparkSession, d: str) -> DataFrame:
    """States, crossings and speeds of the deviation from the moving mean."""
    return rounded(factors.mean_state_factors(rows(spark, d)))


QUERIES["factor_mean_states"] = mean_states
