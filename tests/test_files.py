import datetime as dt
import math

from pyspark.sql import functions as F

from tests.data import frames, walk
from tickweave.sources import files
from tickweave.streaming import live


def test_publish_replaces_the_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, "x", 1.5), (2, None, float("nan"))], "i int, g string, v double")
    note = files.publish(a, path, about={"limit": float("inf")})
    assert note["rows"] == 2 and note["limit"] is None and files.manifest(spark, path) == note
    assert files.same_rows(spark.read.parquet(path), a)
    again = files.publish(a.unionByName(a), path, ["g"])
    assert again["rows"] == 4 and spark.read.parquet(path).count() == 4 and again["fingerprint"] != note["fingerprint"]
    assert files.fingerprint(a) == files.fingerprint(a.orderBy(F.desc("i")).select("v", "g", "i")) != files.fingerprint(a.limit(1))
    assert not files.same_rows(a, a.unionByName(a)) and not files.same_rows(a, a.drop("v"))
    assert sum(x["rows"] for x in files.footers(spark, f"{tmp_path}/t")) == 4


def test_resume_adds_only_missing_days(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    d = lambda *days: spark.createDataFrame([(x, i) for x in days for i in range(3)], "day string, i int")
    assert files.append_missing(d("a", "b"), path, "day") == 2 and files.append_missing(d("a", "b", "c"), path, "day") == 1 and files.append_missing(d("c"), path, "day") == 0
    assert spark.read.parquet(path).count() == 9


def test_text_formats(spark, tmp_path):
    x = spark.createDataFrame([(1, "ä, \"b\"", 123.456789, [1, 2]), (2, None, float("nan"), None)], "i int, s string, v double, a array<int>")
    files.write_csv(x, f"{tmp_path}/c", digits=4)
    got = {r.i: r for r in files.read_csv(spark, f"{tmp_path}/c", "i int, s string, v double, a string").collect()}
    assert got[1].s == "ä, \"b\"" and got[1].v == 123.5 and got[1].a == "[1,2]" and got[2].s is None and math.isnan(got[2].v)
    files.write_lines(x, f"{tmp_path}/j")
    assert [r.v for r in files.read_lines(spark, f"{tmp_path}/j", "i int, v double").orderBy("i").collect()] == [123.456789, None]
    assert files.clean({"a": [float("nan"), 1.0, (float("inf"),)]}) == {"a": [None, 1.0, [None]]}
    assert len(files.file_digest(__file__)) == 64


def test_live_equals_batch(spark, tmp_path):
    s, _, _ = frames(spark, walk(200, seed=4))
    s.repartition(3).write.parquet(f"{tmp_path}/snapshots.parquet")
    feed = live.feed(spark, str(tmp_path), "snapshots")
    assert files.same_rows(live.drained(live.bars(feed)), live.bars(s))
    got = {r.snap_id: r.segment for r in live.drained(live.segments(live.feed(spark, str(tmp_path), "snapshots")), "append").collect()}
    last, n = None, 0
    for r in s.orderBy("Datetime", "snap_id").collect():
        n += last is None or r.Datetime - last > dt.timedelta(seconds=1)
        last = r.Datetime
        assert got[r.snap_id] == n
