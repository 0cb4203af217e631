import numpy as np
import pyarrow as pa
import pytest

from tests.data import OPEN, frames, snap
from tickweave.operators.grid import HALF, Laid, estimated, held_out_errors, regular_grid, solved, source_factors, start, time_sums


def test_observed_cells_are_exact_and_gaps_filled_or_marked(spark):
    rows = [snap(i, i + 0.25, 100 + 0.2 * (i % 5)) for i in range(60) if i not in (10, 11, 40)]
    rows += [snap(900, 3.9, 777.0), snap(901, 5.5, None), snap(902, 6.5, float("nan")), snap(903, -2.0), snap(904, 60.0), snap(905, None), snap(906, 10.5, -5.0)]
    s, sess, _ = frames(spark, rows, [(1, "A", "2026-01-05", "0930", OPEN, 60, None), (2, "A", "2026-01-05", "1000", OPEN, 60, None), (3, None, None, None, None, None, None), (4, "A", "2026-01-05", "1100", OPEN, None, None)])
    out = {(r.session, r.period_second): r for r in regular_grid(s, sess).collect()}
    assert len(out) == 120
    assert out["0930", 3].LastPrice == 777.0 and out["0930", 3].LastPrice_status == "observed"
    assert [k for (n, k), r in sorted(out.items()) if n == "0930" and r.LastPrice_status != "observed"] == [10, 11, 40]
    assert out["0930", 10].LastPrice_status == "filled" and 99.8 < out["0930", 10].LastPrice < 101.0
    assert all(r.LastPrice_status == "unsupported" and r.LastPrice is None for (n, _), r in out.items() if n == "1000")


def test_last_reading_of_a_second_and_ties(spark):
    rows = [snap(2, 1.5, 101.0), snap(1, 1.5, 102.0), snap(3, 1.2, 103.0)]
    s, sess, _ = frames(spark, rows)
    assert [r.LastPrice for r in regular_grid(s, sess).where("period_second = 1").collect()] == [101.0]


def test_empty_tables(spark):
    s, sess, _ = frames(spark, [])
    assert regular_grid(s.limit(0), sess.limit(0)).count() == 0
    assert regular_grid(s, sess).where("LastPrice_status = 'unsupported'").count() == 120


def test_fill_comes_near_a_smooth_path(spark):
    rows = [snap(i, i + 0.25, float(100 + 3 * np.sin(i / 9)), qb=float(20 + i % 3)) for i in range(118) if i not in (50, 51, 52, 80)]
    s, sess, _ = frames(spark, rows)
    out = {r.period_second: r for r in regular_grid(s, sess).collect()}
    for k in (50, 51, 52, 80):
        assert out[k].LastPrice_status == "filled" and abs(out[k].LastPrice - (100 + 3 * np.sin(k / 9))) < 0.4 and 19 < out[k].BidVolume1 < 23
    rows = [snap(i, i + 0.25, 50.0) for i in range(118) if i != 30]
    assert {r.period_second: r.LastPrice for r in regular_grid(frames(spark, rows)[0], sess).collect()}[30] == pytest.approx(50)


def test_fill_does_not_depend_on_how_sources_are_laid_out(spark):
    rows, ses = [], []
    for c in range(70):
        name = f"{900 + c}"
        ses.append((c, "A", "2026-01-05", name, OPEN, 60, None))
        g = np.random.default_rng(c)
        path = 100 + np.cumsum(g.normal(0, 0.2, 60))
        rows += [snap(c * 100 + i, i + 0.25, float(path[i]), qb=float(g.integers(1, 30)), session=name) for i in range(60) if g.random() > 0.15]
    s, sess, _ = frames(spark, rows, ses)
    out = []
    for k in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", k)
        try:
            out.append({(r.session, r.period_second): (r.LastPrice_status, r.LastPrice) for r in regular_grid(s.repartition(k), sess).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(out[0]) == 4200 and {k: v[0] for k, v in out[0].items()} == {k: v[0] for k, v in out[1].items()}
    assert all(v[1] == pytest.approx(out[1][k][1], abs=1e-6) for k, v in out[0].items() if v[1] is not None)
    errors = {r.field: r for r in held_out_errors(s, sess, share=4).collect()}
    assert errors["LastPrice"].cells > 200 and errors["BidVolume1"].als < 0.9 * errors["BidVolume1"].linear and errors["LastPrice"].als < 1.1 * errors["LastPrice"].linear


def test_alternating_least_squares_lowers_the_error_and_recovers_low_rank():
    g = np.random.default_rng(0)
    t = 2 * HALF + 1
    full = g.normal(0, 1, (3000, 2)) @ g.normal(0, 1, (2, t))
    x = np.where(g.random(full.shape) < 0.3, np.nan, full + g.normal(0, 0.05, full.shape))
    v, noise = start(4)
    source = np.repeat(np.arange(150), 20)
    for _ in range(25):
        v, noise = solved(time_sums(x[:1000], source[:1000], v, noise) + time_sums(x[1000:], source[1000:] - 50, v, noise), v)
    u = source_factors(x, source, v, noise)[0]
    rmse = np.sqrt(np.mean((u @ v.T - full)[np.isnan(x)] ** 2))
    assert noise < 0.01 and rmse < 0.1 * np.sqrt(np.mean(full**2))


def test_support():
    cell = pa.list_(pa.struct([("second", pa.int32()), ("f", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([40, 5, 30], pa.int32()), pa.array([[(0, 1.0), (1, 2.0), (2, 3.0)], [], [(k, 7.0) for k in range(30) if k not in (3, 20)]], cell)], ["seconds", "cells"])
    for b, shift in ((batch, 0), (batch.slice(2), 2)):
        laid = Laid(b, "f")
        ok, at, source = laid.supported(5), *laid.places()
        assert source.tolist() == np.repeat(np.arange(3 - shift), [40, 5, 30][shift:]).tolist()
        if not shift:
            assert ok[at[7]] and not ok[at[8]] and not ok[at[40:45]].any() and laid.centre.tolist() == [2, 0, 7]
        gaps = at[np.isnan(laid.x[at]) & ok[at] & (source == 2 - shift)]
        assert len(gaps) == 2 and np.allclose(estimated(laid, gaps, np.full(2, 2 - shift), *start(4), np.zeros(3)), 7)
        assert sum(len(w) for w, _ in laid.pieces()) <= sum(-(-n // 5) for n in laid.n)
