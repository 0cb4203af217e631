"""SQL for DuckDB of the windowed formulas: each window is a self-join of its rows."""

from __future__ import annotations

import re

from tickweave.functions.catalog import WINDOWED
from tickweave.operators.factors import PRIMITIVE
from tickweave.operators.lens import quotes_sql

ROUND = 6


def rounded_sql(x: str, digits: int = ROUND) -> str:
    """``x`` rounded off its ties, so that the last bit of a sum does not decide; whole numbers beyond a million."""
    return f"(CASE WHEN abs({x}) > 1e6 THEN round({x}, 0) ELSE round(({x}) + 1.234e-8, {digits}) END + 0.0)"


def aggregate_sql(op: str, x: str | None, group: str, h: float) -> str:
    """A primitive as an aggregate over the rows j of the window of row i."""
    edge = f"FILTER (WHERE j.edge_{group} AND j.l_t >= i.t - {int(h * 1e6)})"
    x = re.sub(r"\b([a-z]\w*)\b(?!\()", lambda m: m[0] if m[0] in ("when", "then", "else", "end", "and", "or", "case") else f"j.{m[0]}", x.replace("CASE", "case").replace("WHEN", "when").replace("THEN", "then").replace("ELSE", "else").replace("END", "end").replace(" AND ", " and ").replace(" OR ", " or ")) if x else x
    x = re.sub(r"(\d)j\.e(\d)", r"\1e\2", x) if x else x
    if op == "sum":
        return f"coalesce(sum({x}) {edge}, 0.0)"
    if op == "n":
        return f"CAST(count(*) {edge} AS DOUBLE)"
    if op == "cov":
        return "(max(i.t) - min(j.t)) / 1e6"
    if op == "first":
        return f"arg_min({x}, j.rn)"
    if op in ("max", "min"):
        return f"{op}({x})"
    if op == "peak":
        return f"max({x}) {edge}"
    if op in ("drawdown", "runup"):
        best, move = ("list_max", "list_max(l[1:k]) - l[k]") if op == "drawdown" else ("list_min", "l[k] - list_min(l[1:k])")
        l = f"list({x} ORDER BY j.rn)"
        return f"list_max(list_transform(range(1, CAST(count(*) AS BIGINT) + 1), lambda k: {move.replace('l[', l + '[')}))"
    l = f"list({x} ORDER BY j.rn) FILTER (WHERE j.edge_{group} AND j.l_t >= i.t - {int(h * 1e6)} AND {x} <> 0)"
    n = f"CAST(count(*) FILTER (WHERE j.edge_{group} AND j.l_t >= i.t - {int(h * 1e6)} AND {x} <> 0) AS BIGINT)"
    if op == "turns":
        return f"CAST(coalesce(list_sum(list_transform(range(2, {n} + 1), lambda k: CASE WHEN ({l})[k] <> ({l})[k - 1] THEN 1 ELSE 0 END)), 0) AS DOUBLE)"
    # the last run: as many steps as come after the last one of the other sign
    return f"(({l})[{n}] * ({n} - coalesce(list_max(list_filter(range(1, {n} + 1), lambda k: ({l})[k] <> ({l})[{n}])), 0)))"


def windowed_sql(keys: list[tuple[str, str, str]], h: int) -> str:
    """snap_id and the rounded values of windowed factors of one group."""
    (group,) = {k[0] for k in keys}
    place: dict[tuple, str] = {("cov", None): "c0"}
    finals = []
    for g, f, s in keys:
        text = PRIMITIVE.sub(lambda m: place.setdefault((m[1], m[2]), f"c{len(place)}"), WINDOWED[g, f, s][0])
        finals.append((f"{f}_{s}_h{h}s", text))
    z = ", z AS (SELECT *, CASE WHEN edge_price THEN lag(z) OVER (PARTITION BY Contract, trade_date, session, seg_price ORDER BY rn) END AS l_z FROM (SELECT *, p - first_value(p) OVER (PARTITION BY Contract, trade_date, session, seg_price ORDER BY rn) AS z FROM q))" if group == "price" else ""
    src = "z" if z else "q"
    values = ", ".join(f"{rounded_sql(n)} AS {n}" for n, _ in finals)
    exact = ", ".join(f"CASE WHEN valid AND c0 > 0 AND c0 >= {0.8 * h} THEN {t} END AS {n}" for n, t in finals)
    aggs = ", ".join(f"{aggregate_sql(op, x, group, h)} AS {a}" for (op, x), a in place.items())
    return f"""WITH {quotes_sql()}{z},
    w AS (SELECT i.snap_id AS id, {aggs} FROM {src} i JOIN {src} j ON i.Contract = j.Contract AND i.trade_date = j.trade_date AND i.session = j.session
        AND i.seg_{group} = j.seg_{group} AND j.rn <= i.rn AND j.t >= i.t - {int(h * 1e6)} WHERE i.valid_{group} AND j.valid_{group} GROUP BY i.snap_id)
    SELECT snap_id, {values} FROM (SELECT snap_id, {exact} FROM (SELECT *, valid_{group} AS valid FROM {src}) LEFT JOIN w ON w.id = snap_id)"""
