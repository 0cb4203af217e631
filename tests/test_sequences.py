import math

import numpy as np
import pytest

from tests.data import frames, snap, walk
from tickweave.operators import derived, factors, sequences
from tickweave.operators.labels import Schedule, schedule
from tickweave.operators.lens import quotes


def test_recovery_by_hand(spark):
    """Drops at 1, 4 and 7 s: the first recovers after 1.5 s, the second by half, the third leaves its quote."""
    rows = []
    for i in range(50):
        t, qb, bid = i * 0.5, 20.0, 99.8
        qb = 10.0 if 1.0 <= t < 2.5 else 10.0 if 4.0 <= t < 5.0 else 15.0 if 5.0 <= t < 6.5 else 10.0 if 7.0 <= t < 8 else 20.0
        bid = 99.6 if 8.0 <= t else 99.8
        rows.append(snap(i, t, 100.0, bid, 100.2, qb, 30.0, 100))
    q = quotes(*frames(spark, rows))
    r = {x.t: x for x in sequences.queue_recovery(q).collect()}[10_000_000]
    assert (r.B09_BidMatureCount_h10s, r.B09_BidExitCount_h10s, r.B09_BidSameCount_h10s, r.B09_BidSuccessCount_h10s, r.B09_BidUnrecoveredCount_h10s) == (3, 1, 2, 1, 1)
    assert r.B09_BidExitShare_h10s == pytest.approx(1 / 3) and r.B09_BidRecovery_h10s is None and r.B09_AskMatureCount_h10s == 0
    early = {x.t: x for x in sequences.queue_recovery(q).collect()}[8_500_000]
    assert early.B09_BidMatureCount_h10s == 2 and early.B09_BidImmatureCount_h10s == 1


def test_lagged_pairs_by_loop(spark):
    q = quotes(*frames(spark, walk(200, seed=11)))
    data = [r.asDict() for r in q.orderBy("rn").collect()]
    got = {r.snap_id: r for r in sequences.lagged_flow(q).collect()}
    seen = 0
    for i, r in enumerate(data):
        g = got[r["snap_id"]]
        k = i
        while k > 0 and data[k]["edge_full"] and data[k - 1]["t"] >= r["t"] - 10_000_000:
            k -= 1
        if not r["valid_full"] or (r["t"] - data[k]["t"]) < 8_000_000:
            assert g["D09_LagPairCount_h10s_lag2s"] is None
            continue
        x, y, w = [], [], []
        for j in range(k + 1, i + 1):
            end = next((m for m in range(j, i + 1) if data[m]["t"] >= data[j]["t"] + 2_000_000), None)
            if end is None or data[end]["t"] - data[j]["t"] - 2_000_000 > 500_000:
                continue
            x.append(data[j]["ofi"] / ((data[j]["depth"] + data[j - 1]["depth"]) / 2 * data[j]["dt"]))
            y.append((data[end]["p"] - data[j]["p"]) / ((data[end]["t"] - data[j]["t"]) / 1e6))
            w.append(data[j]["dt"])
        assert g["D09_LagPairCount_h10s_lag2s"] == len(x)
        if len(x) >= 8 and np.std(y) > 0:
            x, y, w = (np.array(v) for v in (x, y, np.array(w) / sum(w)))
            x, y = x - w @ x, y - w @ y
            assert g["D09_LagOFICorr_h10s_lag2s"] == pytest.approx(w @ (x * y) / math.sqrt((w @ x**2) * (w @ y**2)))
            seen += 1
    assert seen > 5


def test_no_later_row_matters(spark):
    raw = walk(160, seed=7)
    cut = sorted(r[4] for r in raw)[90]
    a, b = quotes(*frames(spark, [r for r in raw if r[4] <= cut])), quotes(*frames(spark, raw))
    last = max(r.t for r in a.collect())
    for f in (sequences.history_percentiles, sequences.queue_recovery, sequences.lagged_flow):
        x, y = ({r.snap_id: r[5:] for r in f(q).where(f"t < {last}").collect()} for q in (a, b))
        assert x == y and len(x) > 50


def test_bounded_factors_use_only_their_rows(spark):
    raw = walk(160, seed=9)
    snaps, sessions, contracts = frames(spark, raw)
    q, t = quotes(snaps, sessions, contracts), schedule(sessions, Schedule(5.0, 5.0, (0.0,)))
    got = {r.task: r for r in derived.bounded_factors(q, t, 3).collect()}
    data = [r.asDict() for r in q.orderBy("rn").collect()]
    seen = 0
    for task, g in got.items():
        inside = [r for r in data if task <= r["t"] <= task + 3_000_000]
        assert g.rows == len(inside)
        last = inside[-1]
        if task + 3_000_000 - last["t"] > 500_000:
            assert g.F01_QI is None and g.source_age is None
            continue
        assert g.F01_QI == last["qi"]
        k = len(inside) - 1
        while k > 0 and inside[k]["edge_price"]:
            k -= 1
        if last["valid_price"] and last["t"] - inside[k]["t"] >= 2_400_000:
            assert g.F05_Momentum == last["p"] - inside[k]["p"]
            seen += 1
        else:
            assert g.F05_Momentum is None
        assert g.X_OFI_Volume == (None if g.F03_OFI_latest is None or g.D01_LogVolumeRate is None else pytest.approx(g.F03_OFI_latest * g.D01_LogVolumeRate))
    assert seen > 3


def test_variants_follow_their_parents(spark):
    q = quotes(*frames(spark, walk(150, seed=2)))
    x = {r.snap_id: r for r in derived.variants(q).collect()}
    f = {r.snap_id: r for r in factors.window_factors(q, [("queue", "A03", "QIMean"), ("queue", "A03", "QIStd"), ("price", "M01", "MADeviation"), ("ofi", "A07", "OFIDirection")], (5,)).collect()}
    ok = 0
    for k, r in x.items():
        m, s, d, o = f[k].A03_QIMean_h5s, f[k].A03_QIStd_h5s, f[k].M01_MADeviation_h5s, f[k].A07_OFIDirection_h5s
        if m is None:
            assert r.A03_QIStability_h5s is None and r.A03_QIStability_h5s__status == f"PARENT_INVALID:A03_QIMean_h5s:{f[k].A03_QIMean_h5s__status}"
        else:
            assert r.A03_QIStability_h5s == pytest.approx(m / (1 + s)) and r.A03_QIStability_h5s__status == "ok"
        if d is not None and o is not None:
            assert r.M01_TrendConfirmed_h5s + r.M01_CounterflowDeviation_h5s == (pytest.approx(d) if d * o != 0 else 0)
            ok += 1
    assert ok > 20
    assert derived.more_variants(q, sequences.history_percentiles(q)).count() == q.count()
    assert derived.mean_gap(q).count() == q.count()


@pytest.mark.parametrize("most", [1200, 3000])
def test_long_sessions_in_parts(spark, most):
    """A session of many rows a second, handed over in parts, has the values of the whole."""
    g = np.random.default_rng(8)
    rows, v, p = [], 1000, 500
    for i in range(9_000):  # 200 rows a second: the halo's 1,000 rows are 5 s
        p, v = p + int(g.random() > 0.995) - int(g.random() > 0.995), v + int(g.integers(0, 4))
        rows.append(snap(i, 0.1 + i * 0.005, (p + int(g.integers(0, 2))) * 0.2, p * 0.2, (p + 1 + int(g.random() > 0.8)) * 0.2, float(g.integers(5, 30)), float(g.integers(5, 30)), v))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        q = quotes(*frames(spark, rows)).cache()
        for f in (sequences.history_percentiles, sequences.queue_recovery, sequences.lagged_flow):
            a, b = ({r.snap_id: r[5:] for r in f(q, most=m).collect()} for m in (1_000_000, most))
            assert a.keys() == b.keys() and len(a) == 9_000
            x, y = (np.array([s[k] for k in sorted(s)], dtype=float) for s in (a, b))
            np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)
            assert np.isfinite(x).any(axis=0).sum() >= 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
