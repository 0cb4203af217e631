import numpy as np
import pytest

from tickweave.llm import levels

EASY = "The dog runs to the lake. We like the red bus. They hold the warm cup. I see a big tree. "
HARD = "Notwithstanding the disproportionate remuneration of the interdepartmental administration, the countervailing implementation consolidates the macroeconomic infrastructure of the governmental commission. "


def test_syllables():
    want = {"the": 1, "table": 2, "created": 3, "needed": 2, "houses": 2, "area": 3, "people": 2, "animation": 4, "make": 1, "hurried": 2, "being": 2, "science": 2, "administration": 5, "infrastructure": 4, "strength": 1, "x": 1, "non-member": 3}
    assert {w: levels.syllables(w) for w in want} == want


def test_levels_and_robustness(spark):
    docs = {i: EASY * 5 for i in range(20)} | {20 + i: HARD * 4 for i in range(20)}
    docs[100] = EASY * 5 + "(Hr. X: Shame!) [Laughter] " + HARD + "Der alte Bahnhof ist nicht für die Schule und das Wasserwerk. "
    docs |= {101: "", 102: None, 103: "?! ...", 104: HARD * 800}
    df = spark.createDataFrame([(k, v, 9) for k, v in docs.items()], "doc_id long, text string, level int")
    lab = spark.createDataFrame([(0, "a", 1), (1, "b", 1), (2, "a", 4), (20, "a", 4), (21, "b", 4), (22, "a", None), (999, "a", 2)], "doc_id long, annotator string, level int")
    got = {r.doc_id: r for r in levels.reading_levels(df, lab).collect()}
    assert len(got) == len(docs) and {got[i].level for i in range(20)} == {1} and {got[i].level for i in range(20, 40)} == {4}
    assert got[100].level == 1 and got[104].level == 4
    assert all(got[k].grade is None and got[k].level == 1 for k in (101, 102, 103))
    assert levels.reading_levels(df.limit(0), lab.limit(0)).count() == 0


def test_formulas_are_learnt_but_copies_are_not(spark):
    said = "That concludes the list of speakers on this item. "
    docs = [(i, f"Sentence {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (2 + i // 26)} comes first. {said}And {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (3 + i // 26)} goes on.") for i in range(40)]
    docs += [(100 + i, "We meet here today. The same speech is printed again.") for i in range(40)]
    graded = levels.sentence_grades(spark.createDataFrame(docs, "doc_id long, text string"))
    known = {r.s for r in levels.formulas(graded).collect()}
    _, number, _, _ = levels.grade_sentences([said, "The same speech is printed again."], levels.Lexicon())
    want = set(number.view(np.int64).tolist())
    assert known == {number.view(np.int64)[0]} and len(want) == 2


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{path}/level_labels.parquet").dropna()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    train, test = lab.where("doc_id % 2 = 0"), lab.where("doc_id % 2 = 1")
    got = levels.reading_levels(docs, train).join(test.withColumnRenamed("level", "said"), "doc_id").toPandas()
    assert len(got) > 100 and (got.level == got.said).mean() > 0.9  # some labels are off


def test_cuts():
    assert levels.fit_cuts(np.array([1.0, 2, 8, 9, 20, 30]), np.array([1, 1, 2, 2, 3, 4])) == (5.0, 14.25, 25.0)
    assert levels.fit_cuts(np.array([]), np.array([])) == levels.CUTS and levels.fit_cuts(np.array([3.0]), np.array([2])) == pytest.approx(levels.CUTS)


def test_opening_formulas_are_learnt(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    said = "I rise to support this item. "
    docs = [(i, f"{said}Sentence {letters[i % 26] * (2 + i // 26)} comes next. And {letters[i % 26] * (3 + i // 26)} goes on.") for i in range(40)]
    docs += [(100 + i, "We meet here today. The same speech is printed again.") for i in range(40)]
    graded = levels.sentence_grades(spark.createDataFrame(docs, "doc_id long, text string"))
    _, number, _, _ = levels.grade_sentences([said], levels.Lexicon())
    assert [r.s for r in levels.formulas(graded).collect()] == [number.view(np.int64)[0]]
