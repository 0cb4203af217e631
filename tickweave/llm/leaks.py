"""Evaluation passages inside a corpus: winnowed fingerprints are joined with those of the items, word alignment extends the hits over slips and interruptions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.words import WORD, fold, spoken
from tickweave.runtime import stored

GRAM, WINDOW, LEAST = 5, 2, 18
#: Words shared by so many different items belong to a formula.
COMMON = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Ids(dict):
    """Word -> 64-bit number of its folded form, the same in every process; forgets all when it has seen very many words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[word] = int.from_bytes(hashlib.blake2b(fold(word).encode(), digest_size=8).digest(), "little")
        return v


def word_ids(text: str | None, ids: Ids) -> list[int]:
    """Numbers of the folded words of a text without interruptions and layout."""
    return [ids[w] for w in WORD.findall(spoken(text).lower())] if text else []


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words."""
    h = np.full(max(len(ids) - n + 1, 0), n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ ids[j : j + len(h)]) * _MIX
            h ^= h >> np.uint64(29)
    return h


def winnow(ids: np.ndarray, doc: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints of documents laid end to end; ``doc`` is the ascending document number of each word.

    Of every ``window`` consecutive hashes of ``gram`` words of a document the least is kept, the last one of equals, and of a document with
    fewer the least of all. Of gram + window - 1 words in a row, one gram is kept at least.
    """
    h = grams(ids, gram)
    n = len(h)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[gram - 1 : gram - 1 + n])
    h, d = h[at], doc[at]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.empty(0, int)
    keep = np.zeros(len(h), bool)
    m = len(h) - window + 1
    if m > 0:
        view = np.lib.stride_tricks.sliding_window_view(h, window)
        best = window - 1 - np.argmin(view[:, ::-1], axis=1)
        whole = np.flatnonzero(d[:m] == d[window - 1 : window - 1 + m])
        keep[whole + best[whole]] = True
    size = np.diff(np.r_[first, len(d)])
    for a, k in zip(first[size < window], size[size < window]):
        keep[a + k - 1 - np.argmin(h[a : a + k][::-1])] = True
    return at[keep], h[keep]


#: Ways on after words that differ: a word for another, one left out or put in, two of a kind.
_SLIPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3))


def reach(a: list[int], i: int, b: list[int], j: int, step: int, gap: int = 16) -> tuple[int, int]:
    """The last pair of equal words on the way from a[i] = b[j] in direction ``step``.

    After a slip two words in a row must agree again, after an interruption of up to ``gap`` words in ``a`` three.
    """
    far, m, n = (i, j), len(a), len(b)
    while 0 <= i < m and 0 <= j < n:
        if a[i] == b[j]:
            far = (i, j)
            i, j = i + step, j + step
            continue
        for da, db in _SLIPS:
            x, y = i + step * da, j + step * db
            if 0 <= min(x, x + step) and max(x, x + step) < m and 0 <= min(y, y + step) and max(y, y + step) < n and a[x] == b[y] and a[x + step] == b[y + step]:
                break
        else:
            for k in range(3 * 2, gap * 2):
                x, y = i + step * (k // 2), j + step * (k % 2)
                if 0 <= min(x, x + 2 * step) and max(x, x + 2 * step) < m and 0 <= min(y, y + 2 * step) and max(y, y + 2 * step) < n and all(a[x + step * q] == b[y + step * q] for q in range(3)):
                    break
            else:
                return far
        i, j = x, y
    return far


_IDS = Ids()


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))


def _flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts end to end, words of each)."""
    words = [word_ids(t, _IDS) for t in texts]
    size = np.array([len(w) for w in words], dtype=np.int64)
    return np.fromiter((x for w in words for x in w), dtype=np.uint64, count=int(size.sum())), size


def item_grams(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, members, seeds) of test items.

    texts (item, words, formula): the different items, each under the least of its ids, with the places where grams of formulas begin.
    members (item, item_id): every id. seeds (h, item, pos): all grams of ``GRAM`` words but those of formulas, which ``COMMON`` or more
    different items hold, so that one gram leads to few items; an item of formulas only keeps all of its grams. An item of less than
    GRAM + WINDOW - 1 words is one gram of all its words. Items without any word are left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.array(word_ids(text, _IDS), np.uint64)
                if len(w):
                    n = GRAM if len(w) >= GRAM + WINDOW - 1 else len(w)
                    out.append((item, n, w.view(np.int64), grams(w, n).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in (2, 3))], ["item_id", "n", "words", "g"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    each = stored(rows.mapInArrow(scan, "item_id bigint, n int, words array<bigint>, g array<bigint>"), "items")
    texts = each.groupBy("words").agg(F.min("item_id").alias("item"), F.first("n").alias("n"), F.first("g").alias("g"))
    members = each.join(texts.select("words", "item"), "words").select("item", "item_id").distinct()
    every = texts.select("item", "n", F.posexplode("g").alias("pos", "h"))
    many = every.where(F.col("n") == GRAM).groupBy("h").agg(F.count_distinct("item").alias("held")).where(F.col("held") >= COMMON)
    marked = stored(every.join(many, "h", "left").withColumn("common", F.col("held").isNotNull() & (F.col("n") == GRAM)), "grams")
    formula = marked.groupBy("item").agg(F.sort_array(F.collect_list(F.when(F.col("common"), F.col("pos")))).alias("formula"), F.every("common").alias("all"))
    seeds = marked.join(formula.where("all").select("item", "all"), "item", "left").where(~F.col("common") | F.col("all").isNotNull()).select("h", "item", "pos")
    return texts.join(formula.select("item", "formula"), "item").select("item", "words", "formula"), members, seeds


def fingerprints(documents: DataFrame, short: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, h, at): winnowed grams of each document, and all grams of the lengths in ``short`` words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                flat, size = _flat(part.column(1).to_pylist())
                doc = np.repeat(np.arange(part.num_rows), size)
                found = [winnow(flat, doc)]
                for n in short:
                    h = grams(flat, n)
                    ok = np.flatnonzero(doc[: len(h)] == doc[n - 1 : n - 1 + len(h)]) if len(h) else np.empty(0, int)
                    found.append((ok, h[ok]))
                at = np.concatenate([f[0] for f in found])
                order = np.argsort(at, kind="stable")
                at, h = at[order], np.concatenate([f[1] for f in found])[order]
                count = np.bincount(doc[at], minlength=part.num_rows) if part.num_rows else np.empty(0, int)
                place = at - (np.cumsum(size) - size)[doc[at]] if len(at) else at
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(h.view(np.int64), count), _lists(place.astype(np.int32), count)], ["doc_id", "h", "at"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(scan, "doc_id bigint, h array<bigint>, at array<int>")


def longest(mine: list[int], theirs: list[int], formula: list[int], hits: list[tuple[int, int]], least: int = LEAST, beyond: int = 6) -> int:
    """Words of the longest run of an item in a document that is a case, 0 if none: extended from each hit (place in document, in item)."""
    plain = np.ones(len(theirs), bool)
    for k in formula:
        plain[k : k + GRAM] = False
    best, seen = 0, (-1, -1)
    for x, y in sorted(hits):
        if (seen[0] >= x and seen[1] >= y) or x >= len(mine) or mine[x] != theirs[y]:
            continue
        ahead, behind = reach(mine, x, theirs, y, 1), reach(mine, x, theirs, y, -1)
        seen = ahead
        run = ahead[1] - behind[1] + 1
        if run >= (len(theirs) - 1 if len(theirs) >= GRAM + WINDOW - 1 else len(theirs)) or (run >= least and plain[behind[1] : ahead[1] + 1].sum() >= beyond):
            best = max(best, run)
    return best


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, words) of every document that holds an item whole, or at least ``least`` of its words in a row.

    Words are compared without case, punctuation, layout, look-alike or invisible characters and scanning errors; single words changed, left
    out, doubled or put in, and interruptions, do not end a run. A run of formulas alone doesn't count: six words must be others. ``words``
    is the length of the longest run in the item. A run is found if six of its words in a row are without a slip and outside formulas;
    items of up to five words only if they occur exactly. Null and empty texts hold nothing; rows without an id are left out; of
    repeated ids the longest run counts; equal items are looked up once and each come out; other columns are ignored.

    Plan: one pass over the corpus winnows it, its fingerprints are joined with the grams of the items (which Spark broadcasts while they
    are small; only hits are shuffled then, both sides beyond that), hits are gathered by document and item, and the texts of documents with hits are read
    again and aligned. A gram leads to less than ``COMMON`` different items, so that a formula in every document makes no hits.
    """
    texts, members, seeds = item_grams(items)
    seeds = stored(seeds, "seeds")  # a written table has a known size
    short = tuple(r[0] for r in texts.select(F.size("words").alias("n")).where(F.col("n") < GRAM + WINDOW - 1).distinct().collect())  # five lengths at most
    each = fingerprints(documents, short).select("doc_id", F.explode(F.arrays_zip("h", "at")).alias("x")).select("doc_id", F.col("x.h").alias("h"), F.col("x.at").alias("at"))
    hits = stored(each.join(seeds, "h").groupBy("doc_id", "item").agg(F.collect_set(F.struct("at", "pos")).alias("hits")), "hits")
    again = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = again.join(hits, "doc_id").join(texts, "item").select("doc_id", "item", "text", "words", "formula", F.col("hits.at").alias("at"), F.col("hits.pos").alias("pos"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, names, runs = [], [], []
            known: tuple[str | None, list[int]] = (None, [])
            for k in range(batch.num_rows):
                r = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                if r["text"] != known[0]:
                    known = (r["text"], word_ids(r["text"], _IDS))
                theirs = np.array(r["words"], np.int64).view(np.uint64).tolist()
                if run := longest(known[1], theirs, r["formula"], list(zip(r["at"], r["pos"])), least):
                    docs.append(r["doc_id"])
                    names.append(r["item"])
                    runs.append(run)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(names, pa.int64()), pa.array(runs, pa.int32())], ["doc_id", "item", "words"])

    found = pairs.mapInArrow(extend, "doc_id bigint, item bigint, words int")
    return found.join(members, "item").groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
