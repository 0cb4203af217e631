"""Helpers every operator shares: durable intermediate tables and sorted, bounded-memory Arrow passes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = sc._conf.get("tickweave.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='tickweave-')}"
        sc._conf.set("tickweave.checkpoint.dir", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


_TABLES: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table below the shared folder and read it back; the table outlives any executor and goes with ``release`` or at exit."""
    return stored_together([df], name)


def stored_together(dfs: Iterable[DataFrame], name: str) -> DataFrame:
    """``stored`` for tables of the same columns: each is written by itself, and all are read as one."""
    paths = []
    for df in dfs:
        spark = df.sparkSession
        paths.append(os.path.join(shared_dir(spark), f"tickweave-{name}-{uuid.uuid4().hex}"))
        df.write.option("compression", "zstd").parquet(paths[-1])
        _TABLES.append((spark, paths[-1]))
    return spark.read.schema(df.schema).parquet(*paths)


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, for tables inside loops: a written table, as a checkpoint hands on constraints, which multiply from round to round."""
    return stored(df, "cut")


@atexit.register
def release(keep: int = 0) -> None:
    """Drop the stored tables but the first ``keep`` of them: for callers that run many queries, once the results have been read."""
    while len(_TABLES) > keep:
        spark, path = _TABLES.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session has gone, and with it the folder's use
            pass


def real(name: str | Column) -> Column:
    """A numeric column as double with stored NaN turned into null: both mean "no value"."""
    c = (F.col(name) if isinstance(name, str) else name).cast("double")
    return F.when(~F.isnan(c), c)


def clean_key(name: str) -> Column:
    """Upper case without outer white space."""
    return F.upper(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))


def same_key(table: pa.Table, keys: Sequence[str]):
    """numpy bool array: row i has the keys of row i - 1 (row 0: False); nulls are equal to nulls."""
    import numpy as np

    n = table.num_rows
    same = np.ones(n, dtype=bool)
    if n:
        same[0] = False
    for k in keys:
        c = table.column(k).combine_chunks()
        if n > 1:
            if pa.types.is_dictionary(c.type):
                c = c.dictionary_decode()
            eq = pc.equal(c.slice(1), c.slice(0, n - 1))
            both = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1)))
            same[1:] &= pc.fill_null(pc.or_kleene(eq, both), False).to_numpy(zero_copy_only=False)
    return same


def map_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[..., tuple[pa.Table | None, int]], schema: str, *, most: int = 400_000, placed: bool = False) -> DataFrame:
    """Run ``fn(table, more, state)`` over rows sorted by ``keys`` and ``order``: whole groups at a time, many in a call.

    One shuffle on ``keys`` (none if the rows are ``placed`` by them already); the JVM sorts (and spills), Python streams Arrow batches. A
    group longer than ``most`` rows comes in parts: ``more`` says that the table is one group which goes on. ``fn`` returns the rows to
    give out and the number of the first row that it wants to see again in the next part; ``state`` is a dict of its own that lasts as long
    as the group. It is for ``fn`` to give the same rows however a group is cut.
    """
    keys, order = list(keys), list(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        state: dict = {}

        def give(out: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches(max_chunksize=100_000)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < most // 4:
                continue
            table = pa.Table.from_batches(held)
            end = int((~same_key(table, keys)).nonzero()[0][-1])
            if end > 0:
                yield from give(fn(table.slice(0, end), False, state)[0])
                table = table.slice(end)
                state.clear()
            if table.num_rows >= most:
                out, first = fn(table, True, state)
                yield from give(out)
                table = table.slice(min(first, table.num_rows - 1))
            held, rows = table.combine_chunks().to_batches(), table.num_rows
        if rows:
            yield from give(fn(pa.Table.from_batches(held), False, state)[0])

    return (df if placed else df.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[..., pa.Table | None], schema: str, *, back: int = 0, ahead: int = 0, most: int = 400_000) -> DataFrame:
    """``map_parts`` for a ``fn(table, lo, hi, state)`` that gives out rows lo <= i < hi and looks at most ``back`` and ``ahead`` away in ``order[0]``.

    Parts are cut by that distance, not by a number of rows: a part holds every row of the group within ``ahead`` after its last row to give
    out, the rows within ``back`` before its first one and a row more, so that results do not depend on ``most``. What does depend on the
    whole past goes into ``state``, with rows below ``hi`` counted.
    """

    def part(table: pa.Table, more: bool, state: dict) -> tuple[pa.Table | None, int]:
        lo, n = state.pop("lo", 0), table.num_rows
        if not more:
            return fn(table, lo, n, state), n
        at = table.column(order[0]).to_numpy(zero_copy_only=False)
        hi = int(at.searchsorted(at[-1] - ahead, side="left"))
        if hi <= lo:
            state["lo"] = lo
            return None, 0
        out = fn(table, lo, hi, state)
        first = max(0, int(at.searchsorted(at[hi] - back, side="left")) - 1)
        state["lo"] = hi - first
        return out, first

    return map_parts(df, keys, order, part, schema, most=most)
