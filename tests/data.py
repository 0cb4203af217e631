"""Small snapshot fixtures."""

import datetime as dt

import numpy as np

SNAP = "snap_id bigint, Contract string, trade_date string, session string, Datetime timestamp, LastPrice double, BidPrice1 double, AskPrice1 double, BidVolume1 double, AskVolume1 double, Volume bigint, source_row bigint, received_at timestamp, open_time string, tick string"
SESS = "session_id bigint, Contract string, trade_date string, session string, open_time timestamp, session_seconds int, session_kind string"
CONT = "Contract string, product string, venue string, tick_size double, lot_size int, listed_date string, LastPrice string"
OPEN = dt.datetime(2026, 1, 5, 1, 30, tzinfo=dt.timezone.utc)


def at(seconds):
    return OPEN + dt.timedelta(microseconds=round(seconds * 1e6))


def snap(i, seconds, last=100.0, bid=99.8, ask=100.2, qb=20.0, qa=30.0, volume=None, row=None, contract="A", session="0930"):
    """A row of the snapshot table, with two columns whose names clash with other tables'."""
    return (i, contract, "2026-01-05", session, None if seconds is None else at(seconds), last, bid, ask, qb, qa, i + 100 if volume is None else volume, i if row is None else row, at(0), "x", "y")


def walk(n=120, seed=1, step=0.5, contract="A", session="0930", first=0):
    """A random path in ticks of 0.2 with gaps, missing and invalid values, and repeated times."""
    g = np.random.default_rng(seed)
    t, p, v, rows, row = 0.1, 500, 1000, [], 0
    for i in range(n):
        t += step if g.random() > 0.05 else 1.7
        row += 1 if g.random() > 0.03 else 2
        p += int(g.integers(-2, 3))
        v += int(g.integers(0, 5)) * int(g.random() > 0.3)
        s = int(g.integers(1, 3))
        last = (p + int(g.integers(0, s + 1))) * 0.2
        bid, ask = p * 0.2, (p + s) * 0.2
        if g.random() < 0.03:
            last = [None, float("nan"), -1.0, 100.05][int(g.integers(0, 4))]
        if g.random() < 0.03:
            ask = None
        rows.append(snap(first + i, t, last, bid, ask, float(g.integers(1, 30)), float(g.integers(1, 30)), v, row, contract, session))
        if g.random() < 0.03:
            rows.append(rows[-1][:0] + (first + 10_000 + i,) + rows[-1][1:])
        if g.random() < 0.02:
            row += 1
            rows.append(snap(first + 20_000 + i, t, last, bid, ask, 5.0, 5.0, v, row, contract, session))
    return rows


def frames(spark, rows, sessions=((1, "A", "2026-01-05", "0930", OPEN, 120, None),), contracts=(("A", None, None, 0.2, 1, None, "clash"),)):
    return spark.createDataFrame(rows, SNAP), spark.createDataFrame(list(sessions), SESS), spark.createDataFrame(list(contracts), CONT)
