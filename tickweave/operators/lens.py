"""Raw snapshots as ordered, validated rows: ticks, validity by dependency group, legal edges and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.runtime import real

KEYS = ("Contract", "trade_date", "session")
ORDER = ("t", "source_row", "snap_id")
MAX_GAP = 1_000_000
#: Dependency groups, and the groups of which the last three are the conjunction.
GROUPS = ("price", "book", "queue", "ofi", "volume", "price_volume", "position")
JOINT = {"volume_depth": ("volume", "queue"), "price_ofi": ("price", "ofi"), "full": ("price", "ofi", "volume")}
#: Columns whose value in the row before is kept as ``l_<name>``.
LAGGED = ("t", "source_row", "p", "b", "a", "qb", "qa", "v", "depth", "qi", "qstate", "spread", "position")


def _ticks(name: str) -> Column:
    x = F.col(name)
    n = F.rint(x / F.col("tick"))
    return F.when((x > 0) & (F.abs(n) <= 2.0**52) & (F.abs(x - n * F.col("tick")) <= F.col("tick") * 1e-6), n)


def quotes(snapshots: DataFrame, sessions: DataFrame, contracts: DataFrame) -> DataFrame:
    """The rows of each session from its open to its scheduled end, in order of ``t`` (microseconds since the open), ``source_row``, ``snap_id``.

    Prices ``p b a`` are ticks (null unless positive and on the grid), sizes ``qb qa`` and cumulative volume ``v`` null unless whole and
    positive (not negative). Rows sent again (same time and ``source_row``) count once, the first to arrive; different rows of one time are
    kept and invalid. For each group g: ``valid_g``, ``edge_g`` (the step from the row before is legal: next ``source_row``, at most a second,
    both rows valid, volume not falling) and ``seg_g`` (number of the run of legal steps). All windows share one partitioning and order.
    """
    s = sessions.select(*KEYS, F.unix_micros("open_time").alias("open"), "session_seconds")
    c = contracts.select("Contract", real("tick_size").alias("tick")).where("tick > 0")
    x = snapshots.select(*KEYS, "snap_id", "source_row", F.unix_micros("Datetime").alias("at"), *(real(f).alias(f) for f in ("LastPrice", "BidPrice1", "AskPrice1", "BidVolume1", "AskVolume1", "Volume")))
    x = x.join(s, list(KEYS)).join(c, "Contract").withColumn("t", F.col("at") - F.col("open")).where("t >= 0 and t <= session_seconds * 1000000L")
    whole = lambda f, least: F.when((F.col(f) >= least) & (F.col(f) == F.floor(f)), F.col(f))
    x = x.select(
        *KEYS, "snap_id", "source_row", "t", "tick", _ticks("LastPrice").alias("p"), _ticks("BidPrice1").alias("b"), _ticks("AskPrice1").alias("a"),
        whole("BidVolume1", 1).alias("qb"), whole("AskVolume1", 1).alias("qa"), whole("Volume", 0).alias("v"),
    )
    first = Window.partitionBy(*KEYS).orderBy(*ORDER)
    x = x.withColumn("again", F.lag("t").over(first).eqNullSafe(F.col("t")) & F.lag("source_row").over(first).eqNullSafe(F.col("source_row"))).where("not again").drop("again")
    x = x.withColumns({
        "depth": F.col("qb") + F.col("qa"), "qi": F.expr("(qb - qa) / (qb + qa)"), "spread": F.expr("CASE WHEN a > b THEN a - b END"), "position": F.expr("CASE WHEN a > b THEN (a + b - 2 * p) / nullif(a - b, 0) END"),
    }).withColumn("qstate", F.expr("CASE WHEN qi > 0.2 THEN 1.0D WHEN qi < -0.2 THEN -1.0D WHEN qi IS NOT NULL THEN 0.0D END"))
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    x = x.withColumns({"rn": F.row_number().over(w), "n_before": F.lag("t").over(w), "n_after": F.lead("t").over(w), **{f"l_{k}": F.lag(k).over(w) for k in LAGGED}})
    once = "((n_before IS NULL OR n_before <> t) AND (n_after IS NULL OR n_after <> t))"
    valid = {
        "price": "p IS NOT NULL", "book": "spread IS NOT NULL", "queue": "depth IS NOT NULL", "ofi": "depth IS NOT NULL AND spread IS NOT NULL",
        "volume": "v IS NOT NULL", "price_volume": "v IS NOT NULL AND p IS NOT NULL", "position": "p IS NOT NULL AND spread IS NOT NULL",
    }
    x = x.withColumns({f"valid_{g}": F.expr(f"{once} AND {e}") for g, e in valid.items()})
    x = x.withColumns({f"valid_{g}": F.expr(" AND ".join(f"valid_{m}" for m in ms)) for g, ms in JOINT.items()})
    x = x.withColumns({"dt": F.expr("(t - l_t) / 1e6"), "dv": F.expr("v - l_v"), "step": F.expr(f"coalesce(source_row - l_source_row = 1 AND t > l_t AND t - l_t <= {MAX_GAP}, false)")})
    falls = {"volume", "price_volume"}
    x = x.withColumns({f"edge_{g}": F.col("step") & F.col(f"valid_{g}") & F.coalesce(F.lag(f"valid_{g}").over(w), F.lit(False)) & (F.coalesce(F.col("dv") >= 0, F.lit(False)) if g in falls else F.lit(True)) for g in GROUPS})
    x = x.withColumns({f"edge_{g}": F.expr(" AND ".join(f"edge_{m}" for m in ms)) for g, ms in JOINT.items()})
    x = x.withColumn("ofi", F.expr("CASE WHEN edge_ofi THEN (CASE WHEN b > l_b THEN qb WHEN b < l_b THEN -l_qb ELSE qb - l_qb END) - (CASE WHEN a > l_a THEN -l_qa WHEN a < l_a THEN qa ELSE qa - l_qa END) END"))
    x = x.withColumns({"dp": F.expr("CASE WHEN edge_price THEN p - l_p END"), "db": F.expr("CASE WHEN edge_book THEN b - l_b END"), "da": F.expr("CASE WHEN edge_book THEN a - l_a END")})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumns({f"seg_{g}": F.sum(F.when(F.col(f"edge_{g}"), 0).otherwise(1)).over(upto) for g in (*GROUPS, *JOINT)}).drop("n_before", "n_after")


def quotes_sql() -> str:
    """The same rows as a common table expression ``q`` for DuckDB."""
    ticks = lambda f: f"CASE WHEN {f} > 0 AND NOT isnan({f}) AND abs(round_even({f} / tick_size, 0)) <= 4503599627370496 AND abs({f} - round_even({f} / tick_size, 0) * tick_size) <= tick_size * 1e-6 THEN round_even({f} / tick_size, 0) END"
    whole = lambda f, least: f"CASE WHEN NOT isnan(CAST({f} AS DOUBLE)) AND {f} >= {least} AND {f} = floor({f}) THEN CAST({f} AS DOUBLE) END"
    valid = {
        "price": "p IS NOT NULL", "book": "spread IS NOT NULL", "queue": "depth IS NOT NULL", "ofi": "depth IS NOT NULL AND spread IS NOT NULL",
        "volume": "v IS NOT NULL", "price_volume": "v IS NOT NULL AND p IS NOT NULL", "position": "p IS NOT NULL AND spread IS NOT NULL",
    }
    edge = lambda g: f"(step AND valid_{g} AND coalesce(lag(valid_{g}) OVER w, false)" + (" AND coalesce(v - l_v >= 0, false))" if g in ("volume", "price_volume") else ")")
    part = "PARTITION BY Contract, trade_date, session"
    return f"""
    raw AS (SELECT Contract, trade_date, session, snap_id, source_row, epoch_us(Datetime) - epoch_us(open_time) AS t,
            {ticks("LastPrice")} AS p, {ticks("BidPrice1")} AS b, {ticks("AskPrice1")} AS a, {whole("BidVolume1", 1)} AS qb, {whole("AskVolume1", 1)} AS qa, {whole("Volume", 0)} AS v
        FROM snapshots JOIN sessions USING (Contract, trade_date, session) JOIN contracts USING (Contract)
        WHERE epoch_us(Datetime) - epoch_us(open_time) BETWEEN 0 AND session_seconds * 1000000),
    one AS (SELECT *, CASE WHEN a > b THEN a - b END AS spread, qb + qa AS depth, (qb - qa) / (qb + qa) AS qi FROM raw
        QUALIFY row_number() OVER ({part}, t, source_row ORDER BY snap_id) = 1),
    two AS (SELECT *, CASE WHEN a > b THEN (a + b - 2 * p) / (a - b) END AS position, CASE WHEN qi > 0.2 THEN 1.0 WHEN qi < -0.2 THEN -1.0 WHEN qi IS NOT NULL THEN 0.0 END AS qstate,
        count(*) OVER ({part}, t) = 1 AS once FROM one),
    three AS (SELECT *, row_number() OVER w AS rn, {", ".join(f"lag({k}) OVER w AS l_{k}" for k in LAGGED)}, {", ".join(f"once AND {e} AS valid_{g}" for g, e in valid.items())}
        FROM two WINDOW w AS ({part} ORDER BY t, source_row, snap_id)),
    four AS (SELECT *, {", ".join(" AND ".join(f"valid_{m}" for m in ms) + f" AS valid_{g}" for g, ms in JOINT.items())}, (t - l_t) / 1e6 AS dt, v - l_v AS dv,
        coalesce(source_row - l_source_row = 1 AND t > l_t AND t - l_t <= {MAX_GAP}, false) AS step FROM three),
    five AS (SELECT *, {", ".join(f"{edge(g)} AS edge_{g}" for g in GROUPS)} FROM four WINDOW w AS ({part} ORDER BY rn)),
    six AS (SELECT *, {", ".join(" AND ".join(f"edge_{m}" for m in ms) + f" AS edge_{g}" for g, ms in JOINT.items())} FROM five),
    q AS (SELECT *, CASE WHEN edge_price THEN p - l_p END AS dp, CASE WHEN edge_book THEN b - l_b END AS db, CASE WHEN edge_book THEN a - l_a END AS da,
        CASE WHEN edge_ofi THEN (CASE WHEN b > l_b THEN qb WHEN b < l_b THEN -l_qb ELSE qb - l_qb END) - (CASE WHEN a > l_a THEN -l_qa WHEN a < l_a THEN qa ELSE qa - l_qa END) END AS ofi,
        {", ".join(f"max(CASE WHEN NOT edge_{g} THEN rn END) OVER (w ROWS UNBOUNDED PRECEDING) AS seg_{g}" for g in (*GROUPS, *JOINT))}
        FROM six WINDOW w AS ({part} ORDER BY rn))"""
