import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm import leaks
from tickweave.llm.words import words

VOCAB = [a + b + c for a in ("ba", "mo", "ti", "ra", "su", "pe", "lo") for b in ("n", "r", "st", "lk", "v") for c in ("er", "ing", "ow", "al", "et", "ish")]


def text(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def scene(spark):
    r = random.Random(8)
    items = {i: text(r, 60).split() for i in range(5)}
    items[5] = items[0][:30] + text(r, 30).split()  # shares half with another item
    docs = {}
    put = lambda k, w: docs.__setitem__(k, f"{text(r, 40)}. {w} {text(r, 50)}.")
    put(0, " ".join(items[1]))
    put(1, " ".join(items[2][10:32]).upper().replace(" ", ",  \n"))
    slip = list(items[3][:40])
    slip[7], slip[19] = "zzz", "qqq"
    del slip[13]
    slip.insert(27, slip[27])
    put(2, " ".join(slip))
    put(3, " ".join(items[4][5:20]) + " (Mx Some Body [Party]: That is not what was said!) " + " ".join(items[4][20:34]))
    put(4, " ".join(items[1][:11]))  # a quote
    put(5, "".join({"a": "а", "e": "е", "o": "ｏ"}.get(c, c) + ("​" if k % 9 == 0 else "") for k, c in enumerate(" ".join(items[2][20:45]))))
    put(6, " ".join(items[0]))
    docs[7], docs[8], docs[9] = "", None, " ".join(items[1]) * 1 + " " + text(r, 20000)
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(k, " ".join(v), None) for k, v in items.items()] + [(90, None, None), (91, "", None)], "item_id long, text string, doc_id string")
    return d, i


WANT = {(0, 1), (1, 2), (2, 3), (3, 4), (5, 2), (6, 0), (6, 5), (9, 1)}


def found(spark, docs, items):
    d = spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id long, text string")
    i = spark.createDataFrame([(k, v) for k, v in items.items()], "item_id long, text string")
    return {(r.doc_id, r.item_id): r.words for r in leaks.leaked_items(d, i).collect()}


def test_found_whatever_the_disguise(spark):
    d, i = scene(spark)
    got = leaks.leaked_items(d, i).collect()
    assert len(got) == len(WANT) and {(r.doc_id, r.item_id) for r in got} == WANT  # thirty words that two items share are a case for both
    assert leaks.leaked_items(d.limit(0), i).count() == 0 and leaks.leaked_items(d, i.limit(0)).count() == 0
    same = leaks.leaked_items(d.unionByName(d).withColumn("words", F.lit("clash")), i.withColumn("pos", F.lit(1)))
    assert {(r.doc_id, r.item_id) for r in same.collect()} == WANT


@pytest.mark.parametrize("every", [7, 8, 9])
def test_slips_at_every_seventh_to_ninth_word_are_all_found(spark, every):
    r = random.Random(every)
    items = {i: text(r, 24) for i in range(120)}
    docs = {}
    for i, t in items.items():
        w, at = t.split(), r.randrange(every)
        for k in range(at, len(w), every):
            w[k] = f"slip{r.randrange(10**6)}"
        docs[i] = f"{text(r, 30)}. {' '.join(w)} {text(r, 30)}."
    assert {k for k in found(spark, docs, items) if k[0] == k[1]} == {(i, i) for i in items}


def test_two_slips_in_eighteen_words(spark):
    r = random.Random(3)
    items = {i: text(r, 40) for i in range(100)}
    docs = {}
    for i, t in items.items():
        w = t.split()[10:28]
        w[4], w[12] = "other", "words"
        docs[i] = f"{text(r, 30)}. {' '.join(w)} {text(r, 30)}."
    assert set(found(spark, docs, items)) == {(i, i) for i in items}


def test_formulas_and_equal_items(spark):
    r = random.Random(5)
    phrase, common = text(r, 25), text(r, 30)
    items = {i: f"{text(r, 30)} {phrase} {text(r, 10)}" for i in range(leaks.COMMON)} | {10 + k: common for k in range(5)}
    docs = {1: f"{text(r, 20)} {phrase} {text(r, 20)}", 2: f"{text(r, 9)} {' '.join(common.split()[3:24])} {text(r, 9)}", 3: f"{' '.join(items[0].split()[20:60])}"}
    assert found(spark, docs, items) == {(2, 10 + k): 21 for k in range(5)} | {(3, 0): 40}
    only = {k: phrase for k in (1,)} | {k: f"{phrase} {text(r, 30)}" for k in (2, 3)}
    assert (1, 1) in found(spark, docs, only)  # an item that is nothing but a formula is found whole


def test_winnowing_guarantee():
    r = random.Random(2)
    for _ in range(200):
        shared = [r.randrange(2**63) for _ in range(leaks.GRAM + leaks.WINDOW - 1)]
        a = [r.randrange(2**63) for _ in range(r.randrange(20))] + shared + [r.randrange(2**63) for _ in range(r.randrange(20))]
        b = [r.randrange(2**63) for _ in range(r.randrange(20))] + shared + [r.randrange(2**63) for _ in range(r.randrange(20))]
        fa, fb = (set(leaks.winnow(np.array(x, np.uint64), np.zeros(len(x), int))[1].tolist()) for x in (a, b))
        assert fa & fb


def test_fingerprints_of_documents_meet_the_grams_of_items():
    r = random.Random(6)
    for _ in range(200):
        shared = [r.randrange(2**63) for _ in range(leaks.GRAM + leaks.WINDOW - 1)]
        a = [r.randrange(2**63) for _ in range(r.randrange(20))] + shared + [r.randrange(2**63) for _ in range(r.randrange(20))]
        assert set(leaks.winnow(np.array(a, np.uint64), np.zeros(len(a), int))[1].tolist()) & set(leaks.grams(np.array(shared, np.uint64), leaks.GRAM).tolist())


def test_winnowing_does_not_cross_documents():
    ids = np.arange(40, dtype=np.uint64)
    doc = np.repeat([0, 1, 2, 3], [3, 20, 5, 12])
    pos, h = leaks.winnow(ids, doc)
    assert all(doc[p] == doc[p + leaks.GRAM - 1] for p in pos) and (doc[pos] == 2).sum() == 1 and (doc[pos] == 0).sum() == 0 and len(pos) == len(h)
    _, alone = leaks.winnow(ids[3:23], np.zeros(20, int))
    assert set(alone.tolist()) == {x for x, p in zip(h.tolist(), pos) if doc[p] == 1}


def test_short_items_count_whole(spark):
    d = spark.createDataFrame([(1, "say the magic word now"), (2, "the magic"), (3, "The... MAGIC-word!")], "doc_id long, text string")
    i = spark.createDataFrame([(7, "the magic word"), (8, "magic"), (9, "say the magic word now")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i).collect()} == {(1, 7), (3, 7), (1, 8), (2, 8), (3, 8), (1, 9)}


def test_words():
    assert words("Settle-\nment <p>(Laughter) settlernent\n— 12 —\nsett1ement &amp; caſe 10,5") == words("settlement settlement settlement case 10 5")
    assert words(None) == [] and words("­​") == []
