"""Files in and out: CSV, JSON lines, Parquet with a manifest beside it, fingerprints, round trips, resumable and atomic writes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header in UTF-8 (a byte-order mark is skipped) and a given schema; empty fields are null."""
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8", enforceSchema=False, mode="FAILFAST")


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with a header; doubles to ``digits`` significant digits if given. Nested columns go as JSON text."""
    cols = []
    for c, t in df.dtypes:
        if t.startswith(("array", "struct", "map")):
            cols.append(F.to_json(c).alias(c))
        elif t == "double" and digits:
            cols.append(significant(F.col(c), digits).alias(c))
        else:
            cols.append(F.col(c))
    df.select(*cols).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def significant(x: Column, digits: int) -> Column:
    """``x`` to a number of significant digits."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | F.isnan(x), x).otherwise(F.round(x * power) / power)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema."""
    return spark.read.json(path, schema=schema)


def clean(x: Any) -> Any:
    """Plain JSON values: NaN and infinities, wherever they stand, become null.

    One pass through the encoder, which meets every number: what it writes for those three is read back as null.
    """
    text = json.dumps(x, default=lambda v: v.tolist() if hasattr(v, "tolist") else str(v))
    return json.loads(text, parse_constant=lambda name: None)


def fingerprint(df: DataFrame) -> str:
    """SHA-256 over column names, types, row count and order-free sums of row hashes: equal tables have equal fingerprints in any order."""
    cols = sorted(df.columns)
    h = F.xxhash64(*cols) if cols else F.lit(0)
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    text = json.dumps([[(c, t) for c, t in sorted(df.dtypes)], r["n"], str(r["s"]), r["x"]])
    return hashlib.sha256(text.encode()).hexdigest()


def file_digest(path: str) -> str:
    """SHA-256 of a local file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, by: Sequence[str] = (), about: dict | None = None) -> dict:
    """Write a Parquet table (zstd) so that readers see the old one or the whole new one: pending folder, manifest, renames. Returns the manifest."""
    spark = df.sparkSession
    pending, (target, fs) = f"{path}.pending", _fs(spark, path)
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(pending)
    back = spark.read.parquet(pending).select(*df.columns)
    note = clean({"rows": back.count(), "columns": dict(df.dtypes), "partitioned_by": list(by), "fingerprint": fingerprint(back), **(about or {})})
    (p, _) = _fs(spark, f"{pending}/_manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(note, sort_keys=True).encode()))
    out.close()
    (old, _) = _fs(spark, f"{path}.old")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(_fs(spark, pending)[0], target)
    fs.delete(old, True)
    return note


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest beside a published table."""
    p, fs = _fs(spark, f"{path}/_manifest.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included, in any order."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Add the partitions of ``key`` that the table at ``path`` does not have yet: a stopped job goes on where it was. Returns how many."""
    spark = df.sparkSession
    (p, fs) = _fs(spark, path)
    new = df.where(F.col(key).isNotNull())
    if fs.exists(p):
        done = spark.read.parquet(path).select(key).distinct()
        new = new.join(done, key, "left_anti")
    parts = new.select(key).distinct().count()
    if parts:
        new.write.mode("append").option("compression", "zstd").partitionBy(key).parquet(path)
    return parts


def footers(spark: SparkSession, path: str) -> list[dict]:
    """Rows, row groups and key-value metadata of the Parquet files of a local folder, from their footers alone."""
    import os

    import pyarrow.parquet as pq

    files = [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))
    out = []
    for f in files:
        m = pq.ParquetFile(f).metadata
        out.append({"file": os.path.basename(f), "rows": m.num_rows, "row_groups": m.num_row_groups, "columns": m.num_columns, "keys": sorted(k.decode() for k in (m.metadata or {}))})
    return out
