"""Queries of the live mode and of files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.runtime import shared_dir
from tickweave.sources import files
from tickweave.sources.tables import table
from tickweave.streaming import live


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Ten-second bars through a stream with watermark and deduplication."""
    return live.drained(live.bars(live.feed(spark, d, "snapshots")))


def stream_segments(spark: SparkSession, d: str) -> DataFrame:
    """Gap-closed segments kept as state."""
    return live.drained(live.segments(live.feed(spark, d, "snapshots")), "append").select("snap_id", "segment")


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Sessions through CSV and back."""
    path = os.path.join(shared_dir(spark), f"tickweave-csv-{uuid.uuid4().hex}")
    s = table(spark, d, "sessions").select("session_id", "Contract", "trade_date", "session", "session_seconds", "session_kind")
    files.write_csv(s, path)
    return files.read_csv(spark, path, "session_id bigint, Contract string, trade_date string, session string, session_seconds int, session_kind string")


def lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Fills through JSON lines and back; NaN comes back as null."""
    path = os.path.join(shared_dir(spark), f"tickweave-json-{uuid.uuid4().hex}")
    files.write_lines(table(spark, d, "fills").select("fill_id", "strategy", "cost_bp"), path)
    return files.read_lines(spark, path, "fill_id bigint, strategy string, cost_bp double")


def published(spark: SparkSession, d: str) -> DataFrame:
    """Models as a published table with its manifest, written twice."""
    path = os.path.join(shared_dir(spark), f"tickweave-table-{uuid.uuid4().hex}")
    m = table(spark, d, "models").select("model_id", "Contract", "fold")
    files.publish(m.limit(0), path)
    note = files.publish(m, path, ["fold"])
    return spark.read.parquet(path).select("model_id", "Contract", F.col("fold").cast("string").alias("fold"), F.lit(note["rows"]).cast("bigint").alias("rows"))


def _place(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"tickweave-{name}-{uuid.uuid4().hex}")


def many_files(spark: SparkSession, d: str) -> DataFrame:
    """A table that lies in several folders, read as one with its partitions pruned: sessions by date."""
    parts = []
    s = table(spark, d, "sessions").select("session_id", "trade_date", "session_seconds")
    for odd in (0, 1):
        parts.append(_place(spark, f"part{odd}"))
        s.where(F.pmod(F.col("session_id"), F.lit(2)) == odd).write.partitionBy("trade_date").parquet(parts[-1])
    both = [spark.read.schema(s.schema).option("basePath", p).parquet(p) for p in parts]
    x = both[0].unionByName(both[1]).where("trade_date >= '2009-01-07'")
    return x.groupBy(F.col("trade_date").cast("string").alias("trade_date")).agg(F.count("*").alias("sessions"), F.sum("session_seconds").alias("seconds"))


def footer_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of tables from their footers alone."""
    rows = []
    for name in ("sessions", "fills", "models"):
        found = files.footers(spark, os.path.join(d, f"{name}.parquet"))
        rows.append((name, sum(f["rows"] for f in found), max(f["columns"] for f in found)))
    return spark.createDataFrame(rows, "name string, rows bigint, leaves int").select("name", "rows")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Whether a table's fingerprint stays with the order of its rows and columns, and changes with a row."""
    s = table(spark, d, "sessions")
    one = files.fingerprint(s)
    other = files.fingerprint(s.select(*reversed(s.columns)).repartition(5))
    less = files.fingerprint(s.where("session_id <> 1").unionByName(s.where("session_id = 1")).unionByName(s.where("session_id = 1")))
    return spark.createDataFrame([(one == other, one == less, len(one))], "same boolean, repeated boolean, digits int")


def resumed(spark: SparkSession, d: str) -> DataFrame:
    """A write that stopped after some dates and went on: what each run added, and the table it left."""
    path, s = _place(spark, "resumed"), table(spark, d, "sessions").select("session_id", "trade_date", "session_seconds").where("trade_date is not null")
    first = files.append_missing(s.where("trade_date < '2009-01-09'"), path, "trade_date")
    second, third = files.append_missing(s, path, "trade_date"), files.append_missing(s, path, "trade_date")
    back = spark.read.schema(s.schema).parquet(path)
    return back.agg(F.count("*").alias("rows"), F.sum("session_seconds").alias("seconds")).select(F.lit(first + second).alias("dates"), F.lit(third).alias("again"), "rows", "seconds")


QUERIES = {f.__name__: f for f in (stream_bars, stream_segments, csv_round_trip, lines_round_trip, published, many_files, footer_rows, fingerprints, resumed)}
SQL = {
    "many_files": "SELECT trade_date, count(*) AS sessions, sum(session_seconds) AS seconds FROM sessions WHERE trade_date >= '2009-01-07' GROUP BY 1",
    "footer_rows": "SELECT 'sessions' AS name, count(*) AS rows FROM sessions UNION ALL SELECT 'fills', count(*) FROM fills UNION ALL SELECT 'models', count(*) FROM models",
    "fingerprints": "SELECT true AS same, (SELECT count(*) = 0 FROM sessions WHERE session_id = 1) AS repeated, 64 AS digits",
    "resumed": "SELECT count(DISTINCT trade_date) AS dates, 0 AS again, count(*) AS rows, sum(session_seconds) AS seconds FROM sessions WHERE trade_date IS NOT NULL",
    "stream_bars": "WITH u AS (SELECT DISTINCT ON (Contract, trade_date, session, Datetime, source_row) * FROM snapshots WHERE Datetime IS NOT NULL) SELECT Contract, time_bucket(INTERVAL 10 SECOND, Datetime) AS start, count(*) AS rows, min(Volume) AS low_volume, max(Volume) AS high_volume FROM u GROUP BY 1, 2",
    "stream_segments": "WITH g AS (SELECT snap_id, Contract, trade_date, session, Datetime, epoch_us(Datetime) - epoch_us(lag(Datetime) OVER w) > 1000000 AS gap FROM snapshots WHERE Datetime IS NOT NULL WINDOW w AS (PARTITION BY Contract, trade_date, session ORDER BY Datetime, snap_id)) SELECT snap_id, CAST(1 + coalesce(sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY Contract, trade_date, session ORDER BY Datetime, snap_id), 0) AS INTEGER) AS segment FROM g",
    "csv_round_trip": "SELECT session_id, Contract, trade_date, session, session_seconds, session_kind FROM sessions",
    "lines_round_trip": "SELECT fill_id, strategy, CASE WHEN NOT isnan(cost_bp) THEN cost_bp END AS cost_bp FROM fills",
    "published": "SELECT model_id, Contract, fold, (SELECT count(*) FROM models) AS rows FROM models",
}
