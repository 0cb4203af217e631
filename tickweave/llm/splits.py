"""Splits that keep linked records together: Borůvka contraction to a spanning forest, roots dealt by size band."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators.totals import running_totals
from tickweave.runtime import cut, stored

SALTS = 16
#: Size bands per doubling of a root's records: sizes of a band differ by about a hundredth, small sizes have bands of their own.
BANDS = 64
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def plain_date(c: str | Column) -> Column:
    """``YYYY-MM-DD`` of a date in any of its spellings (blanks, slashes, dots, no separators, missing zeros); other text trimmed; blank is null."""
    c = F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))
    compact, loose = r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})$"
    part = lambda p, i: F.lpad(F.regexp_extract(c, p, i), 2, "0")
    of = lambda p: F.concat_ws("-", F.regexp_extract(c, p, 1), part(p, 2), part(p, 3))
    return F.when(c.rlike(compact), of(compact)).when(c.rlike(loose), of(loose)).when(c != "", c)


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, members) of an undirected graph given as (a, b): the tree edges kept, (a, b), and (node, root) of every node with an edge.

    Borůvka: in each round every component takes its least edge to another one (edges have a total order: hash, then ends), the chosen edges
    join the forest, components contract along them, and parallel edges keep the least. The number of components with edges at least
    halves each round. Of two components that chose the same edge the smaller name is the root; pointer jumping takes the others there.
    Rounds are cut by written tables, as are the forest and the members. Null ends, loops and repeated edges are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = cut(e.withColumn("w", F.struct(F.xxhash64("a", "b").alias("h"), F.col("a").alias("a"), F.col("b").alias("b"))).select(F.col("a").alias("x"), F.col("b").alias("y"), "w"))
    members = cut(e.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("root", F.col("node")))
    chosen: list[DataFrame] = []
    while not e.isEmpty():
        ends = e.select(F.col("x").alias("c"), F.col("y").alias("o"), "w").unionByName(e.select(F.col("y").alias("c"), F.col("x").alias("o"), "w"))
        best = cut(ends.groupBy("c").agg(F.min(F.struct("w", "o")).alias("m")).select("c", F.col("m.o").alias("p"), F.col("m.w").alias("w")))
        chosen.append(best.select(F.col("w.a").alias("a"), F.col("w.b").alias("b")))
        # Only pairs choose each other, as the order of edges is total: the smaller name of a pair points to itself.
        back = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = cut(best.select("c", "p").join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        while True:
            over = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            up = cut(up.join(over, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moved = not up.where("moved").isEmpty()
            up = up.select("c", "p")
            if not moved:
                break
        # A giant component is one root: its members are dealt over salts, so that no task gets them all.
        salted = up.select(F.col("c").alias("root"), "p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
        members = members.withColumn("_s", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        members = cut(members.join(salted, ["root", "_s"], "left").select("node", F.coalesce("p", "root").alias("root")))
        e = e.join(up.select(F.col("c").alias("x"), F.col("p").alias("px")), "x").join(up.select(F.col("c").alias("y"), F.col("p").alias("py")), "y").where("px <> py")
        e = cut(e.groupBy(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).agg(F.min("w").alias("w")))
    forest = members.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)
    for c in chosen:
        forest = forest.unionByName(c)
    return stored(forest.distinct(), "forest"), stored(members, "members")


def date_groups(links: DataFrame) -> DataFrame:
    """(node, root) of dates tied to another through ``trade_date`` - ``linked_date`` rows, in whatever spelling."""
    return spanning_forest(links.select(plain_date("trade_date").alias("a"), plain_date("linked_date").alias("b")))[1]


def deal(bands: Sequence[tuple[int, int, float]], shares: Sequence[float]) -> list[list[int]]:
    """For each (band, roots, records), the largest band first: the number of its roots that come to each split and those before it.

    Systematic: every split has a claim of records, its share of all that has been dealt less what it got. The records of a band are laid
    end to end and cut by the claims; a root goes where its middle lies. What a split got too much or too little of is settled in the bands below.
    """
    debt, out = [0.0] * len(shares), []
    total = sum(shares)
    for _, n, size in bands:
        each = size / n
        claims = [d + s / total * size for d, s in zip(debt, shares)]
        line, upto = 0.0, []
        for c in claims[:-1]:
            line += max(c, 0.0)
            upto.append(min(n, max(0, math.ceil(line / each - 0.5))))
        upto.append(n)
        got = [b - a for a, b in zip([0, *upto], upto)]
        debt = [c - g * each for c, g in zip(claims, got)]
        out.append(upto)
    return out


def grouped_splits(rows: DataFrame, key: str, members: DataFrame, shares: Mapping[str, float] = SHARES, seed: int = 42, weight: str | None = None) -> DataFrame:
    """(key, root, rows, split): the split of every key, such that keys of one root share it. A root is named by its least key.

    ``rows`` has a row per record with ``key`` (not null rows count), ``members`` (node, root) ties keys; a key without a tie is its own root.
    Roots are stratified by size band, ordered within a band by the MD5 of name and seed, and dealt systematically from the largest band
    down (``deal``): shares are counted in records, or in units of ``weight`` where tables of different sizes are to count alike, and off by
    no more than about the smallest roots.

    A band's roots are ranked by partition offsets, not in one task; only (band, roots, records) reach the driver, at most ``BANDS`` rows per
    doubling, some 3,000 for any number of roots.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.count("*").alias("rows"), F.sum(F.col(weight) if weight else F.lit(1)).cast("double").alias("_w"))
    keys = stored(sizes.join(members, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rows", "_w"), "keys")
    roots = keys.groupBy("root").agg(F.greatest(F.round(F.sum("_w")), F.lit(1.0)).alias("size"), F.min("node").alias("name"))
    roots = roots.withColumns({"band": F.floor(F.log2("size") * BANDS).cast("int"), "_h": F.md5(F.concat(F.col("name").cast("string"), F.lit(f"|{seed}")).cast("binary")), "_one": F.lit(1).cast("bigint")})
    ranked = stored(running_totals(roots, ["band"], ["_h", "name"], "_one", "k"), "roots")
    bands = [tuple(r) for r in ranked.groupBy("band").agg(F.count("*"), F.sum("size")).orderBy(F.desc("band")).collect()]
    upto = [(b[0], u) for b, u in zip(bands, deal(bands, list(shares.values())))]
    cuts = F.broadcast(rows.sparkSession.createDataFrame(upto, "band int, upto array<bigint>"))  # as few rows as there are bands
    split = F.lit(list(shares)[-1])
    for i, name in reversed(list(enumerate(shares))):
        split = F.when(F.col("k") <= F.col("upto")[i], name).otherwise(split)
    dealt = ranked.join(cuts, "band").select("root", "name", split.alias("split"))
    return keys.join(dealt, "root").select(F.col("node").alias(key), F.col("name").alias("root"), "rows", "split")


def shares_report(rows: DataFrame, key: str, dealt: DataFrame) -> DataFrame:
    """(split, rows, share): what each split got of the records of ``rows`` that have a key."""
    x = rows.groupBy(key).agg(F.count("*").alias("n")).join(dealt.select(key, "split"), key).groupBy("split").agg(F.sum("n").alias("rows"))
    return x.select("split", "rows", (F.col("rows") / F.sum("rows").over(Window.partitionBy())).alias("share"))


def broken_models(models: DataFrame, members: DataFrame) -> DataFrame:
    """(model_id, trade_date) of test dates in the same group as one of the model's train dates; null or empty arrays have none."""
    root = lambda d: d.join(members.withColumnRenamed("node", "trade_date"), "trade_date", "left").withColumn("root", F.coalesce("root", "trade_date"))
    of = lambda c: models.select("model_id", F.explode(c).alias("d")).select("model_id", plain_date("d").alias("trade_date")).where("trade_date is not null").distinct()
    train = root(of("train_dates")).select("model_id", "root")
    return root(of("test_dates")).join(train, ["model_id", "root"], "left_semi").select("model_id", "trade_date")
