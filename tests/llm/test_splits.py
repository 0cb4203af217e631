import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tickweave.llm.splits import SHARES, broken_models, deal, date_groups, grouped_splits, plain_date, spanning_forest


def components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            up[root(a)] = root(b)
    out = defaultdict(set)
    for x in list(up):
        out[root(x)].add(x)
    return {frozenset(v) for v in out.values()}


def test_forest_of_random_graphs(spark):
    for seed, n, m in ((1, 60, 40), (2, 200, 260), (3, 5, 0)):
        r = random.Random(seed)
        edges = [(f"n{r.randrange(n):03d}", f"n{r.randrange(n):03d}") for _ in range(m)] + [(f"chain{i:02d}", f"chain{i + 1:02d}") for i in range(25)] + [("hub", f"leaf{i}") for i in range(30)] + [("a", None), (None, None), ("z", "z")]
        forest, members = spanning_forest(spark.createDataFrame(edges + edges[:5], "a string, b string"))
        got = defaultdict(set)
        for x in members.collect():
            got[x.root].add(x.node)
        want = components(edges)
        assert {frozenset(v) for v in got.values()} == want and all(k in v for k, v in got.items())
        tree = [tuple(x) for x in forest.collect()]
        assert len(tree) == sum(len(w) - 1 for w in want) and components(tree) == want


def test_empty_graph(spark):
    forest, members = spanning_forest(spark.createDataFrame([], "a string, b string"))
    assert forest.count() == 0 and members.count() == 0


def test_dates(spark):
    d = spark.createDataFrame([(x,) for x in (" 2026-01-05 ", "20260105", "2026/1/5", "2026.01.05", "2026-1-05", "soon", " ", None)], "d string")
    assert [r[0] for r in d.select(plain_date("d")).collect()] == ["2026-01-05"] * 5 + ["soon", None, None]


def test_models_with_tied_dates(spark):
    links = spark.createDataFrame([("2026-01-05", "20260106"), ("2026/01/06", " 2026-01-09"), ("2026-01-07", None), ("2026-01-05", "20260106")], "trade_date string, linked_date string")
    rows = [(1, ["2026-01-05"], ["2026-1-9", "2026-01-08"]), (2, ["2026-01-07"], ["2026/01/07", "20260107"]), (3, ["2026-01-08"], None), (4, [], ["2026-01-05"]), (5, [None, "2026-01-06"], ["2026-01-05", None])]
    m = spark.createDataFrame([(*r, "x") for r in rows], "model_id long, train_dates array<string>, test_dates array<string>, root string")
    assert {tuple(r) for r in broken_models(m, date_groups(links)).collect()} == {(1, "2026-01-09"), (2, "2026-01-07"), (5, "2026-01-05")}


def test_splits_keep_groups_and_shares(spark):
    r = random.Random(5)
    keys = [f"k{i}" for i in range(3000)]
    rows = [(k,) for k in keys for _ in range(r.choice([1, 1, 2, 5, 30]))] + [(None,)] * 10
    links = [(f"k{2 * i}", f"k{2 * i + 1}") for i in range(400)]
    members = spanning_forest(spark.createDataFrame(links, "a string, b string"))[1]
    out = grouped_splits(spark.createDataFrame(rows, "key string"), "key", members).collect()
    split = {x.key: x.split for x in out}
    assert len(out) == 3000 and all(split[a] == split[b] for a, b in links)
    n = Counter()
    for x in out:
        n[x.split] += x.rows
    total = sum(n.values())
    assert abs(n["train"] / total - 0.8) < 0.02 and abs(n["test"] / total - 0.1) < 0.02 and abs(n["validation"] / total - 0.1) < 0.02
    again = {x.key: x.split for x in grouped_splits(spark.createDataFrame(rows, "key string").repartition(7).withColumn("split", F.lit("clash")), "key", members).collect()}
    assert again == split
    assert grouped_splits(spark.createDataFrame([], "key string"), "key", members).count() == 0


def test_dealing_keeps_shares_with_few_uneven_roots():
    r = random.Random(9)
    for n in (12, 30, 200, 5000):
        sizes = sorted((int(r.lognormvariate(6, 1.2)) + 1 for _ in range(n)), reverse=True)
        bands = [(s, sizes.count(s), s * sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        got = [0, 0, 0]
        for (s, k, _), upto in zip(bands, deal(bands, list(SHARES.values()))):
            assert upto[-1] == k and upto == sorted(upto)
            for i, (a, b) in enumerate(zip([0, *upto], upto)):
                got[i] += (b - a) * s
        worst = max(abs(g / sum(sizes) - w) for g, w in zip(got, SHARES.values()))
        assert worst <= {12: 0.1, 30: 0.01, 200: 0.001, 5000: 0.0001}[n]


def test_giant_component_and_hub(spark):
    links = [("hub", f"n{i}") for i in range(400)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(300)]
    forest, members = spanning_forest(spark.createDataFrame(links, "a string, b string"))
    assert forest.count() == len(links) and members.select("root").distinct().count() == 2
    rows = spark.createDataFrame([(f"n{i}",) for i in range(400)] + [(f"x{i}",) for i in range(600)], "key string")
    out = grouped_splits(rows, "key", members).collect()
    assert len({x.split for x in out if x.key.startswith("n")}) == 1 and len(out) == 1000
    n = Counter(x.split for x in out)
    assert n["train"] == 800 and n["validation"] == 100 and n["test"] == 100
