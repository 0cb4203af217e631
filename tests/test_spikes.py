import numpy as np
import pytest

from tests.data import frames, snap
from tickweave.operators.spikes import implausible_values


def market(seed=3, n=200, contract="A", session="0930", first=0):
    """A clean path: trades at the quotes, volume that only grows, sizes that change."""
    g = np.random.default_rng(seed)
    p, v, last, rows = 500, 1000, 500, []
    for i in range(n):
        p += int(g.integers(-1, 2))
        a = p + int(g.integers(1, 3))
        if g.random() < 0.6:
            v += int(g.integers(1, 20))
            last = p if g.random() < 0.5 else a
        rows.append([first + i, 0.3 + 0.5 * i, last * 0.2, p * 0.2, a * 0.2, float(g.integers(1, 30)), float(g.integers(1, 30)), v])
    return rows


def build(rows, contract="A", session="0930"):
    return [snap(r[0], r[1], *r[2:8], row=k, contract=contract, session=session) for k, r in enumerate(rows)]


def flags(spark, rows):
    s, _, c = frames(spark, rows)
    return {(r.snap_id, r.field) for r in implausible_values(s, c).collect()}


def test_clean_market_has_no_flags(spark):
    assert flags(spark, build(market())) == set()


def test_each_kind_of_fault(spark):
    m = market()
    m[20][2] += 12.0  # a lone spike
    m[40][2], m[41][2] = m[40][2] - 9.0, m[41][2] - 9.0  # two in a row
    m[60][3], m[60][4] = m[60][4], m[60][3]  # bid and ask exchanged
    m[80][4] = -1.0
    m[90][7] = 3  # the counter falls for a row
    m[100][7] *= 50
    for i in range(121, 160):
        m[i][2] = m[120][2]  # the last price sticks
    out = flags(spark, build(m))
    assert {(20, "LastPrice"), (40, "LastPrice"), (41, "LastPrice"), (60, "BidPrice1"), (60, "AskPrice1"), (80, "AskPrice1"), (90, "Volume"), (100, "Volume")} <= out
    stuck = {s for s, f in out if f == "LastPrice" and s > 100}
    assert set(range(121, 160)) <= stuck and not any(s < 116 or s > 164 for s in stuck)  # rests on either side join the stretch
    assert len([x for x in out if x[1] in ("BidPrice1", "AskPrice1")]) == 3 and len([x for x in out if x[1] == "Volume"]) == 2


def test_lasting_moves_halts_and_large_trades_are_kept(spark):
    m = market()
    for r in m[100:]:
        r[2], r[3], r[4] = r[2] + 20, r[3] + 20, r[4] + 20
    for r in m[50:]:
        r[7] += 700
    halt = [[m[150][0] + 1000 + k, m[150][1] + 0.01 * (k + 1), *m[150][2:]] for k in range(40)]
    assert flags(spark, build(m[:151] + halt + m[151:])) == set()


def test_missing_values_copies_and_empty(spark):
    m = market()
    for i, f in ((10, 2), (11, 3), (12, 4), (13, 7), (14, 5)):
        m[i][f] = None
    m[15][2] = float("nan")
    m[30][2] = 0.0
    rows = build([r for r in m if r[7] is not None])
    copy = next(r for r in rows if r[0] == 30)
    rows += [(5000, *copy[1:]), (5001, None, *copy[2:]), (5002, *copy[1:4], None, *copy[5:])]
    assert flags(spark, rows) == {(30, "LastPrice"), (5000, "LastPrice")}
    s, _, c = frames(spark, rows)
    nulls = frames(spark, [(None, *r[1:]) for r in rows[:3]] + [(*r[:1], None, *r[2:]) for r in rows[:3]] + [(*r[:2], None, None, *r[4:11], None, None, *r[13:]) for r in rows])[0]
    assert {r.snap_id for r in implausible_values(nulls, c).collect()} == {30, 5000}  # of rows without a feed number each is judged alone
    assert implausible_values(s.limit(0), c).count() == 0
    assert implausible_values(s, c.limit(0)).count() >= 2  # without a tick size the smallest move stands in


def test_many_sessions_equal_one_by_one(spark):
    rows, want = [], set()
    for k, name in enumerate(("0930", "1000", "1030")):
        m = market(seed=k, first=k * 1000)
        m[50][3] -= 8.0
        rows += build(m, session=name)
        want.add((k * 1000 + 50, "BidPrice1"))
    assert flags(spark, rows) == want




@pytest.mark.parametrize("most", [60, 150])
def test_parts_of_a_session_give_the_same_rows(spark, most):
    rows = []
    for k in range(3):
        m = market(seed=10 + k, n=700, first=k * 10_000)
        g = np.random.default_rng(k)
        for i in g.integers(0, 700, 12):
            m[i][int(g.integers(2, 5))] += float(g.integers(-90, 90)) * 0.2
        for i in range(150, 420):  # longer than any part
            m[i][2] = m[149][2]
        for i in range(450, 480):
            m[i][7] = m[449][7]
        m[1][7] *= 90
        m[699][7] *= 90
        for i in range(300, 310):
            m[i][2] = None
        b = build(m, session=str(k))
        rows += b + [(5000 + k * 10_000 + j, *b[j][1:]) for j in range(200, 260)]
    s, _, c = frames(spark, rows)
    s = s.repartition(1)
    want = {tuple(r) for r in implausible_values(s, c).collect()}
    assert {r for _, _, r in want} == {"hard", "spike", "stuck", "edge"} - ({"edge"} if not any(r == "edge" for _, _, r in want) else set())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert {tuple(r) for r in implausible_values(s, c, most=most).collect()} == want
        assert {tuple(r) for r in implausible_values(s, c.limit(0), most=most).collect()} == {tuple(r) for r in implausible_values(s, c.limit(0)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
