"""Filling containers of fixed capacity: exact complements of gaps by single, pair and triple lengths, then best fit."""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.operators.totals import running_totals
from tickweave.runtime import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern takes it, so long that matching it would exhaust the matcher's stack.
BLANK = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
#: Ranks per bucket of the join of items with the plan's intervals.
BUCKET = 64


def count_tokens(coder, text: str | None) -> int:
    """Tokens of a whole text. A long run of white space is a piece of its own but for its last character, which belongs to what follows."""
    if not text:
        return 0
    total, at = 0, 0
    for m in BLANK.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(coder.encode_ordinary(text[at : m.start()])) + len(coder._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(coder.encode_ordinary(text[at:]))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens): the length of each whole text in tokens of a rank file, which goes to the executors with the job; null and empty texts have 0."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            lengths = [count_tokens(coder, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], ["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, tokens bigint")


class Shelf:
    """How many items of each length are left, and an index from sums to the single, pair or triple of lengths that makes them.

    ``pairs[s]`` is the larger one of two lengths of sum s, ``triples[s]`` the first one of three, the other two being the pair of the rest;
    0 where there is none. What is left only shrinks: an entry is checked when it is used, and looked for anew if its lengths have run out.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.top = len(counts) - 1
        self.pairs, self.triples = np.zeros(self.top + 1, np.int64), np.zeros(self.top + 1, np.int64)
        lengths = np.flatnonzero(self.left > 0)
        for k, a in enumerate(lengths):
            with_ = lengths[: k + (self.left[a] > 1)]
            self.pairs[a + with_[: np.searchsorted(with_, self.top - a, side="right")]] = a
        sums = np.flatnonzero(self.pairs)
        for a in lengths:
            self.triples[a + sums[: np.searchsorted(sums, self.top - a, side="right")]] = a

    def largest(self, limit: int) -> int:
        """The greatest length of at most ``limit`` that is left, 0 if none."""
        block, hi = 256, min(limit, self.top) + 1
        while hi > 0:
            lo = max(0, hi - block)
            at = np.flatnonzero(self.left[lo:hi] > 0)
            if len(at):
                return int(lo + at[-1])
            hi, block = lo, block * 4
        return 0

    def _look(self, gap: int) -> int:
        """The larger one of two lengths left of sum ``gap``, 0 if there are none."""
        a = np.arange((gap + 1) // 2, min(gap - 1, self.top) + 1)
        at = np.flatnonzero((self.left[a] > 0) & (self.left[gap - a] > (a == gap - a)))
        return int(a[at[-1]]) if len(at) else 0

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two lengths that fill ``gap`` exactly."""
        a = int(self.pairs[gap]) if 1 < gap <= self.top else 0
        if a and not (self.left[a] > (2 * a == gap) and self.left[gap - a] > 0):
            a = self.pairs[gap] = self._look(gap)
        return (int(a), int(gap - a)) if a else None

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        """Three lengths that fill ``gap`` exactly."""
        a = int(self.triples[gap]) if 2 < gap <= self.top else 0
        while a:
            if self.left[a] > 0 and (two := self.pair(gap - a)):
                if self.left[a] <= two.count(a):  # the pair needs the same item: another one, if there is any
                    self.left[a] -= 1
                    b = self._look(gap - a)
                    self.left[a] += 1
                    two = (b, gap - a - b) if b else None
                if two:
                    self.triples[gap] = a
                    return (a, *two)
            at = np.flatnonzero((self.left[1:a] > 0) & (self.pairs[gap - a + 1 : gap][::-1] > 0))
            a = int(at[-1]) + 1 if len(at) else 0
        if 2 < gap <= self.top:
            self.triples[gap] = 0
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill ``gap`` exactly."""
        if gap <= self.top and self.left[gap] > 0:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """[({length: times}, containers)] that uses counts[length] items of every length 1..capacity.

    Each step opens a container with the longest item left. While the gap can't be filled exactly by up to three items, the longest item
    that fits goes in (best fit). The container is then repeated as often as the counts allow, until a length has less left than a container
    takes of it: the number of steps depends on the lengths, a small multiple of ``capacity`` at most, not on the number of items.
    """
    shelf, steps = Shelf(counts), []
    while first := shelf.largest(capacity):
        use: Counter[int] = Counter()
        gap, item = capacity, (first,)
        while True:
            for x in item:
                use[x] += 1
                shelf.left[x] -= 1
                gap -= x
            if not gap:
                break
            item = shelf.fill(gap)
            if item is None:
                longest = shelf.largest(gap)
                if not longest:
                    break
                item = (longest,)
        for x, k in use.items():
            shelf.left[x] += k
        times = min(int(shelf.left[x]) // k for x, k in use.items())
        for x, k in use.items():
            shelf.left[x] -= k * times
        steps.append((dict(use), times))
    return steps


def pack(sizes: DataFrame, specs: Mapping[int, int]) -> DataFrame:
    """(spec_id, doc_id, piece, start_token, tokens, container_id) of every document for every spec (id -> capacity in tokens).

    A document longer than the capacity is cut into full pieces and a rest; every other one is a single piece 0. Containers of a spec are
    numbered from 0 and hold at most its capacity. Documents of 0 tokens take no room and have container null. ``sizes`` is (doc_id,
    tokens); repeated rows are items of their own; null tokens count as 0; ties between equal lengths are broken by doc_id.

    The plan works on the counts per length, at most ``capacity`` rows a spec whatever the data, in a task of its own per spec. Items find
    their container by their rank among equal lengths, which partition offsets give without a window over a hot length: the plan gives
    intervals of ranks, which are joined by length and bucket of ``BUCKET`` ranks, so that a hot length is many keys and an item meets the
    intervals of its own bucket only.
    """
    specs = {int(k): int(v) for k, v in specs.items()}
    if any(v < 1 for v in specs.values()):
        raise ValueError("a capacity must be positive")
    each = F.array(*(F.struct(F.lit(k).alias("spec_id"), F.lit(v).cast("bigint").alias("capacity")) for k, v in sorted(specs.items())))
    d = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("total"), F.explode(each).alias("s")).select("doc_id", "total", "s.*")
    pieces = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("total") / F.col("capacity")) - 1, F.lit(0)).cast("bigint"))
    items = d.withColumn("piece", F.explode(pieces)).withColumn("start_token", F.col("piece") * F.col("capacity")).withColumn("tokens", F.least(F.col("capacity"), F.col("total") - F.col("start_token")))
    items = items.select("spec_id", "tokens", "doc_id", "piece", "start_token")

    spec = {k: (i, v) for i, (k, v) in enumerate(sorted(specs.items()))}

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]  # at most a row per length of the one spec of this partition
        if held:
            frame = pd.concat(held)
            k = int(frame["spec_id"].iloc[0])
            capacity = spec[k][1]
            counts = np.zeros(capacity + 1, dtype=np.int64)
            counts[frame["tokens"].to_numpy()] = frame["n"].to_numpy()
            used, container, rows = np.zeros(capacity + 1, dtype=np.int64), 0, []
            for use, times in plan(counts, capacity):
                for length, each in use.items():
                    rows.append((k, length, int(used[length]), int(used[length] + each * times), container, each))
                    used[length] += each * times
                container += times
            yield pd.DataFrame(rows, columns=["spec_id", "tokens", "lo", "hi", "first", "times"])

    counts = items.where("tokens > 0").groupBy("spec_id", "tokens").agg(F.count("*").alias("n"))
    place = F.create_map(*(x for k, (i, _) in spec.items() for x in (F.lit(k), F.lit(i))))[F.col("spec_id")]
    planned = counts.repartitionById(len(spec), place).mapInPandas(steps, "spec_id int, tokens bigint, lo bigint, hi bigint, first bigint, times bigint")
    intervals = stored(planned, "intervals").withColumn("bucket", F.explode(F.sequence(F.expr(f"lo div {BUCKET}"), F.expr(f"(hi - 1) div {BUCKET}"))))
    ranked = running_totals(items.where("tokens > 0").withColumn("one", F.lit(1).cast("bigint")), ["spec_id", "tokens"], ["doc_id", "piece"], "one", "rank").withColumn("rank", F.col("rank") - 1)
    columns = ["spec_id", "doc_id", "piece", "start_token", "tokens", "container_id"]
    near = ranked.withColumn("bucket", F.expr(f"rank div {BUCKET}")).join(intervals, ["spec_id", "tokens", "bucket"]).where("rank >= lo and rank < hi")
    placed = near.withColumn("container_id", F.expr("first + (rank - lo) div times")).select(*columns)
    return placed.unionByName(items.where("tokens = 0").withColumn("container_id", F.lit(None).cast("bigint")).select(*columns))


def capacities(specs: DataFrame, most: int = 1000) -> dict[int, int]:
    """{spec_id: capacity} of a table of at most ``most`` rows."""
    rows = specs.select("spec_id", "capacity_tokens").where("spec_id is not null and capacity_tokens > 0").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} container sizes")
    return {r[0]: r[1] for r in rows}


def fill_report(packed: DataFrame, specs: Mapping[int, int]) -> DataFrame:
    """(spec_id, containers, tokens, fewest, fill): containers used, the least number that could do, and the share of room that is used."""
    cap = F.create_map(*(x for k, v in specs.items() for x in (F.lit(int(k)), F.lit(int(v)))))[F.col("spec_id")]
    total = packed.where("container_id is not null").groupBy("spec_id").agg((F.max("container_id") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return total.select("spec_id", "containers", "tokens", F.ceil(F.col("tokens") / cap).alias("fewest"), F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("fill"))
