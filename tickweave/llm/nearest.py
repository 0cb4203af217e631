"""Pairing records with the nearest record in time of the same entity through a learned index."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import clean_key, map_groups, real, same_key

ERROR = 8


class LearnedIndex:
    """Piecewise-linear model of key -> position over ascending int64 keys, one or more pieces per shard, wrong by ``error`` at most.

    ``starts`` are the first positions of the shards. A piece is the line through its first and last key; pieces whose greatest error
    exceeds the bound are halved until none does.
    """

    def __init__(self, keys: np.ndarray, starts: np.ndarray, error: int = ERROR):
        self.keys, self.error = keys, error
        n = len(keys)
        lo, hi = starts.astype(np.int64), np.r_[starts[1:], n].astype(np.int64)
        done_lo, done_slope, done_hi = [], [], []
        while len(lo):
            width = (keys[hi - 1] - keys[lo]).astype(float)
            slope = np.divide(hi - 1 - lo, width, out=np.zeros(len(lo)), where=width > 0)
            size = hi - lo
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(lo, size) + pos
            miss = np.abs(np.repeat(slope, size) * (keys[at] - np.repeat(keys[lo], size)) - pos)
            worst = np.maximum.reduceat(miss, np.cumsum(size) - size)
            good = worst <= error
            done_lo.append(lo[good])
            done_hi.append(hi[good])
            done_slope.append(slope[good])
            lo, hi = lo[~good], hi[~good]
            mid = (lo + hi) // 2
            lo, hi = np.r_[lo, mid], np.r_[mid, hi]
        order = np.argsort(np.concatenate(done_lo)) if done_lo else np.empty(0, int)
        self.lo, self.hi, self.slope = (np.concatenate(x)[order] if done_lo else np.empty(0) for x in (done_lo, done_hi, done_slope))
        self.first = keys[self.lo] if n else np.empty(0, np.int64)

    def lower_bound(self, q: np.ndarray) -> np.ndarray:
        """Position of the first key >= q: predicted, then searched for in the window that the error bound leaves."""
        piece = np.maximum(np.searchsorted(self.first, q, side="left") - 1, 0)
        lo, hi = self.lo[piece], self.hi[piece]
        guess = lo + np.rint(self.slope[piece] * (q - self.first[piece]).astype(float)).astype(np.int64)
        a = np.clip(guess - self.error - 2, lo, hi)
        b = np.clip(guess + self.error + 2, lo, hi)
        while (open_ := a < b).any():
            m = (a + b) // 2
            less = self.keys[np.minimum(m, len(self.keys) - 1)] < q
            a, b = np.where(open_ & less, m + 1, a), np.where(open_ & ~less, m, b)
        return a


def nearest_in_time(queries: DataFrame, events: DataFrame, keys: Sequence[str], tolerance: int, shard: int = 60_000_000, most: int = 1_000_000) -> DataFrame:
    """(query_id, event_id, offset) of the event nearest to each query, at most ``tolerance`` microseconds away.

    ``queries`` has ``keys``, query_id and t, ``events`` has ``keys``, event_id and t (bigint microseconds; ids bigint). At equal
    distance the earlier event wins, then the smaller event_id. Rows with a null key, id or t pair with nothing; repeated queries each
    come out; queries without an event within tolerance do not. Other columns are ignored.

    A shard is an entity and a stretch of ``shard`` microseconds; events within ``tolerance`` of its edge are in both shards, so that
    every pair lies within one. One shuffle of both tables on the shard, which spreads hot entities over time; the JVM sorts, and each
    Arrow batch of whole shards is looked up through a ``LearnedIndex``. A shard of more than ``most`` rows comes in parts that hold all
    rows within ``tolerance`` of those they answer, so that the result is the same however many rows a shard has.
    """
    keys = list(keys)
    if not 0 <= tolerance < shard:
        raise ValueError("tolerance must be below the length of a shard")
    whole = lambda i: " and ".join(f"`{k}` is not null" for k in (*keys, "t", i))
    by = lambda t: F.floor(t / F.lit(float(shard))).cast("bigint")
    e = events.where(whole("event_id")).select(*keys, "t", F.col("event_id").alias("id"), F.lit(0).cast("tinyint").alias("kind"), F.explode(F.array_distinct(F.array(by(F.col("t") - tolerance), by(F.col("t") + tolerance)))).alias("shard"))
    q = queries.where(whole("query_id")).select(*keys, "t", F.col("query_id").alias("id"), F.lit(1).cast("tinyint").alias("kind"), by(F.col("t")).alias("shard"))
    group = [*keys, "shard"]

    def match(table: pa.Table, lo: int, hi: int, state: dict) -> pa.Table | None:
        kind = table.column("kind").to_numpy()
        ev, qu = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        qu = qu[(qu >= lo) & (qu < hi)]
        if not len(ev) or not len(qu):
            return None
        g = np.cumsum(~same_key(table, group)).astype(np.int64)
        t, ids = table.column("t").to_numpy(), table.column("id").to_numpy()
        # one ascending int64 per row: the shard's number, then the time within the shard and its overlap
        key = g * (shard + 2 * tolerance + 2) + (t - table.column("shard").to_numpy() * shard + tolerance)
        k, kg = key[ev], g[ev]
        index = LearnedIndex(k, np.flatnonzero(np.r_[True, kg[1:] != kg[:-1]]))
        pos = index.lower_bound(key[qu])
        same_run = np.r_[False, k[1:] == k[:-1]]
        run_first = np.maximum.accumulate(np.where(same_run, 0, np.arange(len(k))))
        far = np.int64(1) << 62
        right = np.minimum(pos, len(k) - 1)
        dr = np.where((pos < len(k)) & (kg[right] == g[qu]), k[right] - key[qu], far)
        left = run_first[np.maximum(pos - 1, 0)]
        dl = np.where((pos > 0) & (kg[left] == g[qu]), key[qu] - k[left], far)
        best = np.where(dl <= dr, left, right)
        ok = np.minimum(dl, dr) <= tolerance
        return pa.table({"query_id": ids[qu][ok], "event_id": ids[ev[best[ok]]], "offset": (t[ev[best]] - t[qu])[ok]})

    return map_groups(e.unionByName(q), group, ("t", "kind", "id"), match, "query_id bigint, event_id bigint, offset bigint", back=tolerance, ahead=tolerance, most=most)


def decision_snapshots(decisions: DataFrame, sessions: DataFrame, snapshots: DataFrame, tolerance: int = 500_000) -> DataFrame:
    """(decision_id, snap_id, offset): the snapshot nearest to each decision's source time, or its decision time where that is missing.

    Contract is compared without case and outer blanks; seconds count from the session's open and are rounded to whole microseconds; NaN
    is missing. Decisions without contract, session or any time have no row.
    """
    seconds = F.coalesce(real("source_seconds"), real("decision_seconds"))
    q = decisions.select(F.col("decision_id").cast("bigint").alias("query_id"), clean_key("Contract").alias("Contract"), "trade_date", "session", seconds.alias("sec"))
    q = q.where("Contract is not null and abs(sec) < 1e9")
    o = sessions.select(clean_key("Contract").alias("Contract"), "trade_date", "session", F.unix_micros("open_time").alias("open")).dropna().groupBy("Contract", "trade_date", "session").agg(F.min("open").alias("open"))
    q = q.join(o, ["Contract", "trade_date", "session"]).select("query_id", "Contract", "trade_date", "session", (F.col("open") + F.round(F.col("sec") * 1e6).cast("bigint")).alias("t"))
    e = snapshots.select(clean_key("Contract").alias("Contract"), "trade_date", "session", F.unix_micros("Datetime").alias("t"), F.col("snap_id").cast("bigint").alias("event_id"))
    found = nearest_in_time(q, e, ("Contract", "trade_date", "session"), tolerance)
    return found.select(F.col("query_id").alias("decision_id"), F.col("event_id").alias("snap_id"), "offset")
