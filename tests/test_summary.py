import pytest

from tickweave.operators.summary import FILLS, order_summary, pairing

SCHEMA = "trade_date string, nominal_second int, direction int, strategy string, fill_stage string, fill_kind string, cost double, elapsed double, reason string"
NAMES = ("M", "C")
TASK = ["trade_date", "nominal_second"]


def rows():
    out = []
    for day, seconds in (("d1", (10,)), ("d2", (10, 70, 80))):
        for s in seconds:
            for side in (-1, 1):
                out.append((day, s, side, "M", "immediate", "market", 2.0, 1.0, "clash"))
                out.append((day, s, side, "C", "initial" if side == 1 else "deadline", "limit" if side == 1 else "market", 1.0 if day == "d1" else 3.0, 2.0 if side == 1 else 10.5, "clash"))
    return out


def reasons(spark, data):
    return {(r.trade_date, r.nominal_second): r.reason for r in pairing(spark.createDataFrame(data, SCHEMA), TASK, NAMES).collect()}


def test_pairing_contract(spark):
    assert set(reasons(spark, rows()).values()) == {"ok"} and len(reasons(spark, rows())) == 4
    assert reasons(spark, rows()[1:])["d1", 10] == "UNPAIRED"
    assert reasons(spark, rows() + rows()[:1])["d1", 10] == "REPEATED"
    assert reasons(spark, [r for r in rows() if r[2] == 1])["d2", 70] == "UNPAIRED"
    assert reasons(spark, [*rows(), ("d1", 10, 1, "X", None, None, 1.0, 1.0, None)])["d1", 10] == "UNEXPECTED"
    assert reasons(spark, [*rows(), ("d1", 10, None, "C", None, None, 1.0, 1.0, None)])["d1", 10] == "UNEXPECTED"
    assert reasons(spark, []) == {}


def test_summary_is_equal_over_dates(spark):
    data = [(*r[:4], "unknown", r[5], *r[6:]) if r[0] == "d2" and r[1] == 80 and r[3] == "M" else r for r in rows()] + [("d3", 5, 1, "M", "immediate", "market", 9.0, 1.0, None)]
    got = {(r.scope, r.side, r.strategy): r for r in order_summary(spark.createDataFrame(data, SCHEMA), TASK, NAMES, ("M",), {"minute": (0, 60), "hour": (0, 3600)}).collect()}
    c, m = got["hour", "both", "C"], got["hour", "both", "M"]
    assert (c.days, c.orders, c.tasks) == (2, 8, 4) and c.cost == pytest.approx(2.0) and c.saving_on_M == pytest.approx(0.0) and c.better_days_than_M == 1
    assert c.initial_limit == 0.5 and c.deadline_market == 0.5 and c.early == 0.5 and m.early == 1.0
    assert m.other == pytest.approx((0 + 1 / 3) / 2) and all(sum(r[k] for k in (*FILLS, "other")) == pytest.approx(1) for r in got.values())
    assert got["minute", "sell", "C"].orders == 2 and got["minute", "sell", "C"].early == 0
    assert order_summary(spark.createDataFrame([], SCHEMA), TASK, NAMES, ("M",), {"hour": (0, 3600)}).count() == 0
