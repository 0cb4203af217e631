"""Reading level of documents: classic readability formulas per sentence of the speaker's own prose, combined by medians."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.leaks import Ids
from tickweave.llm.words import spoken
from tickweave.runtime import stored

#: Cuts between levels on the grade scale where no labels are given.
CUTS = (5.5, 14.0, 25.0)

# Frequent function words of English, and of other languages where English has no such word.
ENGLISH = frozenset("the of and to in a is that for it as was on with be by at this we i you they from or have has my our not but which are".split())
OTHER = frozenset(
    "der die das den dem des ein eine einen einem einer und ist nicht wir sie mit für von zum zur auf im bis seit nach ohne unser jeder jede jedes weil trotz"
    " le la les du de et est que qui dans pour une nous vous avec sur el los las por para con una es non sed est ut ad cum pro quod".split()
)

_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|\n\s*\n")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_HEAD = re.compile(r"^\s*[^:.!?\n]{2,60}:\s+(?=[A-Z])")
_GREETING = re.compile(r"^\s*(?:[A-Z][\w.]*(?:\s[\w.]+){0,2},\s+(?:[a-z]+,\s+)?)+(?=[A-Z])")

_GROUP = re.compile(r"[aeiouyäöü]+")
_HIATUS = re.compile(r"ia(?!ge)|io(?!u)|iu|(?<!p)eo(?!u)|(?<!q)ua(?!r)|uou|yi|(?<!q)ue[nt]|eing|creat|scie|(?<=[^aeiou])ea$")
_KEPT = re.compile(r"(?:[^aeiouy]le|[td]ed|(?:[sxz]|[cs]h|[cg])es)$")
_TION = re.compile(r"(?<!s)[tcsg]i(?:on|al|ous|an|en|ent|a)")


def syllables(word: str) -> int:
    """Syllables by the rules of hyphenation: vowel groups, split at a hiatus, without a final silent e, es or ed; 1 at least."""
    total = 0
    for w in word.split("-"):
        n = len(_GROUP.findall(w))
        n += len(_HIATUS.findall(_TION.sub("sh", w)))
        if n > 1 and not _KEPT.search(w) and (w.endswith(("e", "es", "ed")) and not w.endswith(("ee", "ees", "eed"))) and (len(w) < 3 or w.rstrip("sd")[-2:-1] not in "aeiouy"):
            n -= 1
        total += max(n, 1)
    return max(total, 1)


class Lexicon:
    """What is known of each word, in growing arrays: number, syllables, letters, English or other function word."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.rows = Ids(), []
        self.table = np.empty((0, 5), np.uint64)

    def look(self, words: Sequence[str]) -> np.ndarray:
        """(n, 5) table of ``words``."""
        if len(self.at) > 500_000:
            self.at, self.rows = {}, []
            self.table = np.empty((0, 5), np.uint64)
        at = self.at
        for w in set(words).difference(at):
            at[w] = len(self.rows)
            self.rows.append((self.ids[w], syllables(w), sum(map(str.isalpha, w)), w in ENGLISH, w in OTHER))
        if len(self.rows) > len(self.table):
            more = np.array(self.rows[len(self.table) :], dtype=np.uint64)
            self.table = np.concatenate([self.table, more])
        return self.table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words of each sentence of ``spoken`` text, without speaker heads and greetings."""
    if not text:
        return []
    out = []
    for s in _SENTENCE.split(_HEAD.sub("", spoken(text))):
        if w := _TOKEN.findall(_GREETING.sub("", _HEAD.sub("", s)).lower()):
            out.append(w)
    return out


def grade_sentences(texts: list[str | None], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document index, sentence number, grade, foreign) of the sentences of ``texts``.

    The grade is the median of Flesch-Kincaid, Gunning fog, SMOG, ARI and Coleman-Liau, taken of the one sentence.
    """
    each = [sentences(t) for t in texts]
    doc = np.repeat(np.arange(len(each)), [len(s) for s in each])
    size = np.array([len(w) for s in each for w in s], dtype=np.int64)
    if not len(size):
        return doc, np.empty(0, np.uint64), np.empty(0), np.empty(0, bool)
    t = lexicon.look([w for s in each for x in s for w in x])
    first = np.cumsum(size) - size
    syl, letters = t[:, 1].astype(float), t[:, 2].astype(float)
    n = size.astype(float)
    total, chars, hard = (np.add.reduceat(x, first) for x in (syl, letters, (syl >= 3).astype(float)))
    grades = np.stack([0.39 * n + 11.8 * total / n - 15.59, 0.4 * (n + 100 * hard / n), 1.043 * np.sqrt(30 * hard) + 3.1291, 4.71 * chars / n + 0.5 * n - 21.43, 5.88 * chars / n - 29.6 / n - 15.8])
    foreign = np.add.reduceat(t[:, 4], first) > np.add.reduceat(t[:, 3], first)
    place = (np.arange(len(t)) - np.repeat(first, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = t[:, 0] * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03) | np.uint64(1))
        number = np.add.reduceat(h ^ (h >> np.uint64(31)), first)
    return doc, number, np.sort(grades, axis=0)[2], foreign


def sentence_grades(documents: DataFrame) -> DataFrame:
    """(doc_id, s, g, f): each document's sentence numbers, grades and foreign flags in order; null and empty texts have none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                doc, number, grade, foreign = grade_sentences(part.column(1).to_pylist(), lexicon)
                edge = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (number.view(np.int64), grade.astype(np.float32), foreign)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["doc_id", "s", "g", "f"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, "doc_id bigint, s array<bigint>, g array<float>, f array<boolean>")


def formulas(graded: DataFrame, share: float = 0.005, least: int = 3) -> DataFrame:
    """(s): sentences that follow, or come before, many different ones: as many as ``share`` of the documents, ``least`` at least.

    Copies of a document have the same sentences around, so that repeats make no formula; what opens every document counts by what comes
    after it. At most twice (sentences per document) / ``share`` rows.
    """
    none = F.array(F.lit(0).cast("bigint"))
    zipped = F.arrays_zip("s", F.concat(none, "s").alias("p"), F.concat(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), none).alias("f"))
    each = graded.select(F.explode(zipped).alias("x")).select("x.s", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x.p").alias("o")), F.struct(F.lit(1).alias("side"), F.col("x.f").alias("o")))).alias("y"))
    pairs = each.where("s is not null").select("s", "y.side", "y.o").distinct()
    n = graded.count()
    return pairs.groupBy("s", "side").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, share * n)).select("s").distinct()


def own_grades(graded: DataFrame, known: Sequence[int]) -> DataFrame:
    """(doc_id, grade): the median grade of a document's sentences that are neither formulas nor foreign; of all if no other is left, null if none."""
    skip = np.sort(np.array(list(known), dtype=np.int64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, g, f = (batch.column(c) for c in ("s", "g", "f"))
            edge = np.r_[0, np.cumsum(s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(int)
            number, grade, foreign = s.flatten().to_numpy(), g.flatten().to_numpy(zero_copy_only=False).astype(float), f.flatten().to_numpy(zero_copy_only=False)
            own = ~foreign & ~np.isin(number, skip)
            out = np.full(batch.num_rows, np.nan)
            for i in range(batch.num_rows):
                a, b = edge[i], edge[i + 1]
                x = grade[a:b][own[a:b]]
                x = x if len(x) else grade[a:b]
                if len(x):
                    out[i] = np.median(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, from_pandas=True)], ["doc_id", "grade"])

    return graded.mapInArrow(scan, "doc_id bigint, grade double")


def fit_cuts(grade: np.ndarray, level: np.ndarray, start: Sequence[float] = CUTS) -> tuple[float, ...]:
    """Cuts between levels 1..len(start)+1: midway between the median grades of the labels on either side, which a few wrong labels do not move.

    A cut without labels of both its levels stays at its ``start``.
    """
    cuts = []
    for k, default in enumerate(start, 1):
        below, above = grade[level == k], grade[level == k + 1]
        cuts.append(float(np.median(below) + np.median(above)) / 2 if len(below) and len(above) else default)
    return tuple(np.maximum.accumulate(cuts))


def reading_levels(documents: DataFrame, labels: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc_id, grade, level) of every document; level 1 (easiest) to 4.

    Interruptions, page marks, markup, speaker heads, greetings, formulas (learnt from the whole corpus) and foreign sentences are left
    out. The grade is the median over the other sentences of the median of five readability formulas; sentences of another level here and
    there do not move it. The cuts between levels are fitted to the labels (a sample of at most ``most``, by hash; null levels left out).
    Documents without any word have grade null and level 1; repeated rows each come out; other columns are ignored.
    """
    graded = stored(sentence_grades(documents), "sentences")
    known = [r[0] for r in formulas(graded).collect()]  # bounded by its share of the documents
    grades = stored(own_grades(graded, known), "grades")
    seen = labels.where("level is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("level").cast("int").alias("level")).orderBy(F.xxhash64("doc_id", "level")).limit(most)
    rows = grades.where("grade is not null").join(F.broadcast(seen), "doc_id").select("grade", "level").toPandas()
    cuts = fit_cuts(rows["grade"].to_numpy(), rows["level"].to_numpy()) if len(rows) else CUTS
    level = F.lit(1)
    for c in cuts:
        level = level + F.when(F.col("grade") > float(c), 1).otherwise(0)
    return grades.select("doc_id", "grade", level.cast("int").alias("level"))
