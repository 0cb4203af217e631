"""Queries of this subpackage's operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import leaks, levels, nearest, packing, percentiles, splits
from tickweave.runtime import stored
from tickweave.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Decisions and their nearest snapshots."""
    return nearest.decision_snapshots(table(spark, d, "decisions"), table(spark, d, "sessions"), table(spark, d, "snapshots")).select("decision_id", "snap_id")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per strategy, from counts kept per date."""
    daily = percentiles.value_counts(table(spark, d, "fills"), ["trade_date", "strategy"], percentiles.STEPS)
    return percentiles.percentiles(percentiles.combine(daily, ["strategy"]), ["strategy"], percentiles.STEPS)


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    """The same per date and strategy."""
    daily = percentiles.value_counts(table(spark, d, "fills"), ["trade_date", "strategy"], percentiles.STEPS)
    return percentiles.percentiles(daily, ["trade_date", "strategy"], percentiles.STEPS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Test dates of models which are tied to a train date."""
    return splits.broken_models(table(spark, d, "models"), splits.date_groups(table(spark, d, "date_links")))


def _dealt(spark: SparkSession, d: str) -> DataFrame:
    """The split of every date, by the rows that fills and decisions have on it: each table's rows weigh a million together."""
    parts = []
    for t in ("fills", "decisions"):
        x = table(spark, d, t).select(splits.plain_date("trade_date").alias("trade_date")).where("trade_date is not null")
        parts.append(x.withColumn("weight", F.lit(1e6 / max(x.count(), 1))))
    return splits.grouped_splits(parts[0].unionAll(parts[1]), "trade_date", splits.date_groups(table(spark, d, "date_links")), weight="weight").select("trade_date", "split")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every fill; rows without a date have none."""
    fills = table(spark, d, "fills").select("fill_id", splits.plain_date("trade_date").alias("trade_date"))
    return fills.join(_dealt(spark, d), "trade_date", "left").select("fill_id", "trade_date", "split")


def p4_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The split of every decision, the same for a date as that of its fills."""
    rows = table(spark, d, "decisions").select("decision_id", splits.plain_date("trade_date").alias("trade_date"))
    return rows.join(_dealt(spark, d), "trade_date", "left").select("decision_id", "trade_date", "split")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and shares of the splits, of fills and of decisions."""
    dealt, parts = _dealt(spark, d), []
    for t in ("fills", "decisions"):
        rows = table(spark, d, t).select(splits.plain_date("trade_date").alias("trade_date"))
        parts.append(splits.shares_report(rows, "trade_date", dealt).select(F.lit(t).alias("table"), "split", "rows", F.round("share", 6).alias("share")))
    return parts[0].unionByName(parts[1])


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container for each container size."""
    return packing.pack(stored(packing.token_counts(table(spark, d, "documents")), "tokens"), packing.capacities(table(spark, d, "pack_specs")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and their fill."""
    return packing.fill_report(p6_packing(spark, d), packing.capacities(table(spark, d, "pack_specs")))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """(spec_id, overfull, lost, cut, documents) of the packing: containers above their capacity, documents not packed once and whole, and shorter ones that were cut."""
    sizes, specs = stored(packing.token_counts(table(spark, d, "documents")), "tokens"), packing.capacities(table(spark, d, "pack_specs"))
    packed = stored(packing.pack(sizes, specs), "packed")
    cap = F.create_map(*(x for k, v in specs.items() for x in (F.lit(k), F.lit(v))))[F.col("spec_id")]
    full = packed.where("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens")).groupBy("spec_id").agg(F.count_if(F.col("tokens") > cap).alias("overfull"))
    pieces = packed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("got"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("places"))
    wanted = sizes.withColumn("spec_id", F.explode(F.array(*(F.lit(k) for k in sorted(specs)))))
    whole = wanted.join(pieces, ["spec_id", "doc_id"], "left").groupBy("spec_id").agg(
        F.count_if(F.col("got").isNull() | (F.col("got") != F.col("tokens")) | (F.col("pieces") != F.col("places"))).alias("lost"), F.count_if((F.col("tokens") <= cap) & (F.col("pieces") > 1)).alias("cut"), F.count("*").alias("documents"))
    return full.join(whole, "spec_id").select("spec_id", "overfull", "lost", "cut", "documents")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items in them."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "test_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the English documents of 400 characters and more; formulas are learnt from all documents."""
    docs = table(spark, d, "documents")
    graded = levels.reading_levels(docs, table(spark, d, "level_labels"))
    return graded.join(docs.where("lang = 'en' and n_chars >= 400").select("doc_id"), "doc_id").select("doc_id", "level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their mean grade by source and level."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    graded = levels.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))
    return docs.join(graded, "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"), F.round(F.avg("grade"), 3).alias("grade"))


QUERIES = {"p2_found": p2_found, "p3_percentiles": p3_percentiles, "p3_daily": p3_daily, "p4_found": p4_found, "p4_splits": p4_splits, "p4_decisions": p4_decisions, "p4_shares": p4_shares, "p6_packing": p6_packing, "p6_report": p6_report, "p6_check": p6_check, "p7_found": p7_found, "p8_found": p8_found, "p8_profile": p8_profile}

_PERCENTS = ", ".join(map(str, percentiles.PERCENTS))


def _percentile_sql(by: str) -> str:
    return f"""
        WITH v AS (
            SELECT {by}, 'cost_bp' AS measure, cost_bp AS x FROM fills WHERE cost_bp IS NOT NULL AND NOT isnan(cost_bp)
            UNION ALL SELECT {by}, 'elapsed_seconds', elapsed_seconds FROM fills WHERE elapsed_seconds IS NOT NULL AND NOT isnan(elapsed_seconds)),
        r AS (
            SELECT {by}, measure, round_even(x / 0.001, 0) AS bin,
                row_number() OVER (PARTITION BY {by}, measure ORDER BY x) AS k, count(*) OVER (PARTITION BY {by}, measure) AS n FROM v)
        SELECT {by}, measure, p AS percent, bin * 0.001 + 0.0 AS value, n
        FROM r, (SELECT CAST(unnest([{_PERCENTS}]) AS DOUBLE) AS p) WHERE k = greatest(ceil(p * n), 1)"""


_DATE = lambda c: f"""CASE WHEN regexp_matches(trim({c}), '^\\d{{8}}$') THEN strftime(strptime(trim({c}), '%Y%m%d'), '%Y-%m-%d')
    ELSE strftime(strptime(replace(trim({c}), '/', '-'), '%Y-%m-%d'), '%Y-%m-%d') END"""  # noqa: E731

# Roots by the closure of the links, then one recursion over size bands, the largest first; a, b: claims left of train and validation.
_DEAL = f"""
    WITH RECURSIVE l AS (SELECT {_DATE("trade_date")} AS a, {_DATE("linked_date")} AS b FROM date_links WHERE linked_date IS NOT NULL AND trade_date IS NOT NULL),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
    k AS (SELECT {_DATE("trade_date")} AS d, sum(w) AS n FROM (SELECT trade_date, 1e6 / (SELECT count(trade_date) FROM fills) AS w FROM fills UNION ALL SELECT trade_date, 1e6 / (SELECT count(trade_date) FROM decisions) FROM decisions) WHERE trade_date IS NOT NULL GROUP BY 1),
    g AS (SELECT d, n, least(d, coalesce((SELECT min(b) FROM reach JOIN k j ON j.d = reach.b WHERE reach.a = k.d), d)) AS root FROM k),
    s AS (SELECT root, greatest(round(sum(n)), 1.0) AS size FROM g GROUP BY 1),
    r AS (SELECT *, CAST(floor(log2(size) * {splits.BANDS}) AS INTEGER) AS band FROM s),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5(root || '|42'), root) AS place FROM r),
    bd AS (SELECT *, row_number() OVER (ORDER BY band DESC) AS i FROM (SELECT band, count(*) AS n, sum(size) AS size FROM r GROUP BY 1)),
    cl AS (SELECT i, band, n, size / n AS m, 0.8 * size AS a, 0.1 * size AS b FROM bd WHERE i = 1
        UNION ALL SELECT bd.i, bd.band, bd.n, bd.size / bd.n, a - u * m + 0.8 * bd.size, b - v * m + 0.1 * bd.size
        FROM (SELECT *, least(n, greatest(0, ceil(greatest(a, 0) / m - 0.5))) AS u, least(n, greatest(0, ceil((greatest(a, 0) + greatest(b, 0)) / m - 0.5))) - least(n, greatest(0, ceil(greatest(a, 0) / m - 0.5))) AS v FROM cl) x JOIN bd ON bd.i = x.i + 1),
    ct AS (SELECT band, least(n, greatest(0, ceil(greatest(a, 0) / m - 0.5))) AS u, least(n, greatest(0, ceil((greatest(a, 0) + greatest(b, 0)) / m - 0.5))) AS w FROM cl),
    dealt AS (SELECT g.d, CASE WHEN place <= u THEN 'train' WHEN place <= w THEN 'validation' ELSE 'test' END AS split FROM g JOIN r2 USING (root) JOIN ct USING (band))"""
_SHARE = lambda t: f"SELECT '{t}' AS \"table\", split, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {t} JOIN dealt ON dealt.d = {_DATE(t + '.trade_date')} GROUP BY split"

SQL = {
    "p6_check": "SELECT spec_id, 0 AS overfull, 0 AS lost, 0 AS cut, (SELECT count(*) FROM documents) AS documents FROM pack_specs",
    "p4_splits": f"{_DEAL} SELECT fill_id, {_DATE('fills.trade_date')} AS trade_date, split FROM fills LEFT JOIN dealt ON dealt.d = {_DATE('fills.trade_date')}",
    "p4_decisions": f"{_DEAL} SELECT decision_id, {_DATE('decisions.trade_date')} AS trade_date, split FROM decisions LEFT JOIN dealt ON dealt.d = {_DATE('decisions.trade_date')}",
    "p4_shares": f"{_DEAL} {_SHARE('fills')} UNION ALL {_SHARE('decisions')}",
    "p2_found": r"""
        WITH q AS (
            SELECT d.decision_id, o.Contract, o.trade_date, o.session,
                epoch_us(o.open_time) + CAST(round(coalesce(CASE WHEN NOT isnan(d.source_seconds) THEN d.source_seconds END,
                    CASE WHEN NOT isnan(d.decision_seconds) THEN d.decision_seconds END) * 1e6) AS BIGINT) AS t
            FROM decisions d JOIN sessions o ON upper(regexp_replace(d.Contract, '^\s+|\s+$', '', 'g')) = o.Contract
                AND d.trade_date = o.trade_date AND d.session = o.session),
        c AS (
            SELECT q.decision_id, s.snap_id, row_number() OVER (PARTITION BY q.decision_id ORDER BY abs(epoch_us(s.Datetime) - q.t), s.Datetime, s.snap_id) AS k
            FROM q JOIN snapshots s USING (Contract, trade_date, session) WHERE abs(epoch_us(s.Datetime) - q.t) <= 500000)
        SELECT decision_id, snap_id FROM c WHERE k = 1""",
    "p3_percentiles": _percentile_sql("strategy"),
    "p3_daily": _percentile_sql("trade_date, strategy"),
    "p4_found": f"""
        WITH RECURSIVE l AS (SELECT {_DATE("trade_date")} AS a, {_DATE("linked_date")} AS b FROM date_links WHERE linked_date IS NOT NULL AND trade_date IS NOT NULL),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
        tr AS (SELECT DISTINCT model_id, {_DATE("d")} AS d FROM (SELECT model_id, unnest(train_dates) AS d FROM models)),
        te AS (SELECT DISTINCT model_id, {_DATE("d")} AS d FROM (SELECT model_id, unnest(test_dates) AS d FROM models))
        SELECT DISTINCT te.model_id, te.d AS trade_date FROM te JOIN tr USING (model_id)
        WHERE te.d = tr.d OR EXISTS (SELECT 1 FROM reach WHERE reach.a = tr.d AND reach.b = te.d)""",
}
