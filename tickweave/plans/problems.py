"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators.grid import held_out_errors, regular_grid
from tickweave.operators.spikes import implausible_values
from tickweave.sources.tables import table


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid: every scheduled second of every session with value and status of both fields."""
    return regular_grid(table(spark, d, "snapshots"), table(spark, d, "sessions"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Scheduled seconds without a usable reading: what the grid filled or marked."""
    return p1_grid(spark, d).where("LastPrice_status <> 'observed'").select("Contract", "trade_date", "session", "period_second")


def p1_marks(spark: SparkSession, d: str) -> DataFrame:
    """The grid's statuses, and the values where they are observed."""
    x = p1_grid(spark, d)
    seen = lambda f: F.when(F.col(f"{f}_status") == "observed", F.col(f)).alias(f)
    return x.select("Contract", "trade_date", "session", "period_second", "LastPrice_status", "BidVolume1_status", seen("LastPrice"), seen("BidVolume1"))


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    """Mean error of the fill on hidden readings, beside plainer ways to fill."""
    return held_out_errors(table(spark, d, "snapshots"), table(spark, d, "sessions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Wrong values of snapshots."""
    return implausible_values(table(spark, d, "snapshots"), table(spark, d, "contracts")).select("snap_id", "field")


QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid, "p1_marks": p1_marks, "p1_errors": p1_errors, "p5_found": p5_found}

SQL = {
    "p1_marks": """
        WITH r AS (SELECT o.Contract, o.trade_date, o.session, (epoch_us(s.Datetime) - epoch_us(o.open_time)) // 1000000 AS period_second, s.LastPrice, s.BidVolume1, epoch_us(s.Datetime) AS t, s.snap_id
            FROM snapshots s JOIN sessions o USING (Contract, trade_date, session)
            WHERE s.LastPrice IS NOT NULL AND NOT isnan(s.LastPrice) AND s.LastPrice > 0 AND s.BidVolume1 IS NOT NULL AND NOT isnan(s.BidVolume1) AND s.Datetime >= o.open_time),
        u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY Contract, trade_date, session, period_second ORDER BY t DESC, snap_id DESC) = 1),
        g AS (SELECT Contract, trade_date, session, unnest(range(session_seconds)) AS period_second FROM sessions),
        x AS (SELECT g.*, LastPrice, BidVolume1, count(LastPrice) OVER (PARTITION BY Contract, trade_date, session) AS readings,
                count(LastPrice) OVER (PARTITION BY Contract, trade_date, session ORDER BY g.period_second RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near
            FROM g LEFT JOIN u USING (Contract, trade_date, session, period_second)),
        y AS (SELECT *, CASE WHEN LastPrice IS NOT NULL THEN 'observed' WHEN readings >= 3 AND near > 0 THEN 'filled' ELSE 'unsupported' END AS status FROM x)
        SELECT Contract, trade_date, session, CAST(period_second AS INTEGER) AS period_second, status AS LastPrice_status, status AS BidVolume1_status, LastPrice, BidVolume1 FROM y""",
    "p1_found": """
        WITH used AS (
            SELECT DISTINCT s.Contract, s.trade_date, s.session, (epoch_us(s.Datetime) - epoch_us(o.open_time)) // 1000000 AS period_second
            FROM snapshots s JOIN sessions o USING (Contract, trade_date, session)
            WHERE s.LastPrice IS NOT NULL AND NOT isnan(s.LastPrice) AND s.LastPrice > 0 AND s.BidVolume1 IS NOT NULL AND NOT isnan(s.BidVolume1)
              AND s.Datetime >= o.open_time)
        SELECT o.Contract, o.trade_date, o.session, CAST(g.p AS INTEGER) AS period_second
        FROM (SELECT Contract, trade_date, session, unnest(range(session_seconds)) AS p FROM sessions) g JOIN sessions o USING (Contract, trade_date, session)
        LEFT JOIN used u ON u.Contract = o.Contract AND u.trade_date = o.trade_date AND u.session = o.session AND u.period_second = g.p
        WHERE u.Contract IS NULL""",
}
