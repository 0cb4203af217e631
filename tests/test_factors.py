"""Windowed factors against a plain loop over each row's window, and causality."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.data import frames, snap, walk
from tickweave.functions.catalog import WINDOWED
from tickweave.operators import factors
from tickweave.operators.lens import GROUPS, JOINT, quotes


@pytest.fixture(scope="module")
def rows(spark):
    return quotes(*frames(spark, walk(150, seed=5))).cache()


def lens(rows):
    return [r.asDict() for r in rows.orderBy("rn").collect()]


def windows(data, group, h):
    """(row, indices of its window) for valid rows, by walking back over legal steps."""
    for i, r in enumerate(data):
        if r[f"valid_{group}"]:
            k = i
            while data[k][f"edge_{group}"] and data[k - 1]["t"] >= r["t"] - h * 1_000_000:
                k -= 1
            yield i, list(range(k, i + 1))


def test_edges_by_definition(rows):
    data = lens(rows)
    for a, b in zip(data, data[1:]):
        step = b["source_row"] - a["source_row"] == 1 and 0 < b["t"] - a["t"] <= 1_000_000
        assert b["edge_price"] == (step and a["valid_price"] and b["valid_price"])
        assert b["edge_volume"] == (step and a["valid_volume"] and b["valid_volume"] and b["v"] >= a["v"])
    assert any(not r["valid_price"] for r in data) and any(not r["edge_price"] for r in data[1:])


def test_means_moves_and_extremes(rows):
    data, h = lens(rows), 5
    keys = [("price", "M01", "MADeviation"), ("price", "C01", "PriceRV"), ("price", "C03", "Range"), ("price", "C04", "Drawdown"), ("price", "C04", "Runup"), ("price", "C06", "SignedRun"), ("price", "C06", "ReversalShare"), ("price", "M11", "TrendSlope"), ("price", "M03", "StandardDeviation")]
    got = {r.snap_id: r for r in factors.window_factors(rows, keys, (h,)).collect()}
    seen = 0
    for i, ix in windows(data, "price", h):
        r, g = data[i], got[data[i]["snap_id"]]
        p, t = np.array([data[k]["p"] for k in ix]), np.array([data[k]["t"] for k in ix]) / 1e6
        if data[ix[-1]]["t"] - data[ix[0]]["t"] < 800_000 * h:
            assert g["M01_MADeviation_h5s"] is None and g["M01_MADeviation_h5s__status"] == ("NO_COVERAGE" if len(ix) == 1 else "WARMUP")
            continue
        w, d = np.diff(t), np.diff(p)
        mean = np.dot(w, p[:-1]) / w.sum()
        assert g["M01_MADeviation_h5s"] == pytest.approx(p[-1] - mean)
        assert g["C01_PriceRV_h5s"] == pytest.approx(math.sqrt(np.dot(d, d) / w.sum()))
        assert g["C03_Range_h5s"] == p.max() - p.min()
        assert g["C04_Drawdown_h5s"] == max(np.maximum.accumulate(p) - p) and g["C04_Runup_h5s"] == max(p - np.minimum.accumulate(p))
        s = np.sign(d[d != 0])
        if len(s):
            run = 1
            while run < len(s) and s[-1 - run] == s[-1]:
                run += 1
            assert g["C06_SignedRun_h5s"] == s[-1] * run
        if len(s) >= 2:
            assert g["C06_ReversalShare_h5s"] == pytest.approx(np.mean(s[1:] != s[:-1]))
        sd = math.sqrt(np.dot(w, (p[:-1] - mean) ** 2) / w.sum())
        if sd > 0:
            assert g["M03_StandardDeviation_h5s"] == pytest.approx((p[-1] - mean) / sd, abs=1e-6)
        z = t[:-1] - np.dot(w, t[:-1]) / w.sum()
        assert g["M11_TrendSlope_h5s"] == pytest.approx(np.dot(w * z, p[:-1] - mean) / np.dot(w, z * z), abs=1e-6)
        seen += 1
    assert seen > 30


def test_joint_groups_and_status(rows):
    data = lens(rows)
    got = {r.snap_id: r for r in factors.window_factors(rows, [("volume_depth", "D06", "PreQIVolume"), ("price_ofi", "D07", "UnchangedPriceOFIRate")], (5,)).collect()}
    for i, ix in windows(data, "volume_depth", 5):
        t = [data[k]["t"] / 1e6 for k in ix]
        dv = np.array([data[k]["v"] - data[k - 1]["v"] for k in ix[1:]])
        if data[ix[-1]]["t"] - data[ix[0]]["t"] >= 4_000_000 and dv.sum() > 0:
            qi = np.array([data[k]["qi"] for k in ix[:-1]])
            assert got[data[i]["snap_id"]]["D06_PreQIVolume_h5s"] == pytest.approx(np.dot(dv, qi) / dv.sum())
    for r in data:
        g = got[r["snap_id"]]
        for n in ("D06_PreQIVolume_h5s", "D07_UnchangedPriceOFIRate_h5s"):
            assert (g[n] is not None) == (g[f"{n}__status"] == "ok")
        if not r["valid_price_ofi"]:
            assert g["D07_UnchangedPriceOFIRate_h5s__status"] == "INVALID_INPUT"


def test_no_factor_reads_the_future(spark, rows):
    raw = walk(150, seed=5)
    cut = sorted(r[4] for r in raw)[80]
    before = quotes(*frames(spark, [r for r in raw if r[4] <= cut]))
    keys = [k for k in WINDOWED if k[0] in ("price", "ofi")]
    pick = lambda q: {r.snap_id: tuple(None if v is None else round(v, 9) for v in r[5:]) for r in factors.window_factors(q, keys, (5,), status=False).collect()}
    a, b = pick(before), pick(rows)
    late = {r["snap_id"] for r in lens(rows) if r["t"] >= max(x["t"] for x in lens(before))}
    assert a and all(b[k] == v for k, v in a.items() if k not in late)
    for f in (factors.opening_factors, factors.age_factors, factors.mean_state_factors, factors.segment_factors):
        x = {r.snap_id: r[4:] for r in f(before).collect()}
        y = {r.snap_id: r[4:] for r in f(rows).collect()}
        assert all(y[k] == v for k, v in x.items() if k not in late)


def test_every_group_has_quality(rows):
    for g in (*GROUPS, *JOINT):
        r = factors.quality_factors(rows, g, (5,)).agg(F.max(f"R06_{g}_Coverage_h5s"), F.min(f"R06_{g}_Count_h5s")).first()
        assert r[0] <= 5.0 and r[1] >= 0


def test_mean_states_by_loop(rows):
    data = lens(rows)
    m = {r.snap_id: r["M01_MADeviation_h5s"] for r in factors.window_factors(rows, [("price", "M01", "MADeviation")], (5,)).collect()}
    got = {r.snap_id: r for r in factors.mean_state_factors(rows).collect()}
    for i, r in enumerate(data):
        v = m[r["snap_id"]]
        g = got[r["snap_id"]]
        if v is None:
            assert g["M07_MeanState_h5s_g5s"] is None
            continue
        k = i
        while k > 0 and data[k]["edge_price"] and m[data[k - 1]["snap_id"]] is not None:
            k -= 1
        state = [np.sign(x) if abs(x) > 0.5 else 0 for x in (m[data[j]["snap_id"]] for j in range(k, i + 1))]
        assert g["M07_MeanState_h5s_g5s"] == state[-1]
        change = [j for j in range(1, len(state)) if state[j] != state[j - 1]]
        assert g["M07_MeanStateAge_h5s_g5s"] == (pytest.approx((r["t"] - data[k + change[-1]]["t"]) / 1e6) if change else None)
        last, cross = 0, None
        for j, s in enumerate(state):
            if s and last == -s:
                cross = j
            last = s or last
        assert g["M08_CrossAge_h5s_g5s"] == (None if cross is None else pytest.approx((r["t"] - data[k + cross]["t"]) / 1e6))


def test_repeats_and_empty(spark):
    raw = [snap(i, i * 0.5) for i in range(10)]
    q = quotes(*frames(spark, raw + [(99, *raw[4][1:])]))
    assert q.count() == 10 and q.where("valid_price").count() == 10
    twice = quotes(*frames(spark, raw + [snap(98, 2.0, row=77)]))
    assert twice.where("t = 2000000 and valid_price").count() == 0 and twice.where("t = 2000000").count() == 2
    empty = quotes(*(x.limit(0) for x in frames(spark, raw)))
    assert factors.row_factors(empty).count() == 0 and factors.opening_factors(empty).count() == 0


def test_bounded_factors_do_not_depend_on_parts_and_send_no_tasks(spark):
    from tickweave.operators import derived
    from tickweave.plans.features import rows
    from tickweave.plans.labels import tasks
    from tests.oracle import SF

    q, t = rows(spark, SF), tasks(spark, SF)
    get = lambda most: {tuple(r[:4]): tuple(r[4:]) for r in derived.bounded_factors(q, t, most=most).collect()}
    whole = derived.bounded_factors(q, t)
    assert whole.count() > 1000 and get(100_000) == get(30) == get(7)
    # the driver must not collect what was exploded from a small table
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert not [part for part in plan.split("BroadcastExchange")[1:] if "Generate" in part.split("Exchange")[0]]
