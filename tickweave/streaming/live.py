"""Live counterparts: event-time windows with watermarks, and stateful segments over an unbounded feed."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.runtime import shared_dir

KEYS = ("Contract", "trade_date", "session")


def feed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, with the table's own schema."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def bars(snapshots: DataFrame, width: str = "10 seconds", late: str = "2 days") -> DataFrame:
    """Readings, mean price and volume range per contract and window of event time; rows sent again within ``late`` count once.

    Works on a stream as on a table: state older than the watermark is dropped, and with it rows later than ``late``.
    """
    s = snapshots.where("Datetime is not null")
    once = [*KEYS, "Datetime", "source_row"]
    if snapshots.isStreaming:
        s = s.withWatermark("Datetime", late).dropDuplicatesWithinWatermark(once)
    else:
        s = s.dropDuplicates(once)
    w = F.window("Datetime", width)
    return s.groupBy("Contract", w.alias("w")).agg(F.count("*").alias("rows"), F.min("Volume").alias("low_volume"), F.max("Volume").alias("high_volume")).select("Contract", F.col("w.start").alias("start"), "rows", "low_volume", "high_volume")


def segments(snapshots: DataFrame, gap: float = 1.0) -> DataFrame:
    """(keys, snap_id, segment): the number of the run of rows not more than ``gap`` seconds apart, kept per session as state over batches.

    Rows of one batch are taken in order of time; a row older than the last one seen starts no run of its own but belongs to the current one.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, number = state.get if state.exists else (None, 0)
        x = pd.concat(list(frames)).sort_values(["Datetime", "snap_id"])
        out = []
        for t, i in zip(x["Datetime"], x["snap_id"]):
            s = t.timestamp()
            if last is None or s - last > gap:
                number += 1
            last = s if last is None else max(last, s)
            out.append((*key, i, number))
        state.update((last, number))
        yield pd.DataFrame(out, columns=[*KEYS, "snap_id", "segment"])

    s = snapshots.where("Datetime is not null").select(*KEYS, "Datetime", "snap_id")
    return s.groupBy(*KEYS).applyInPandasWithState(step, ", ".join([*(f"{k} string" for k in KEYS), "snap_id bigint, segment int"]), "last double, number int", "append", "NoTimeout")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and read what it wrote: for tests and backfills."""
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"tickweave-stream-{uuid.uuid4().hex}")
    out = f"{base}/out"
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
