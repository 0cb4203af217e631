"""Queries of factors over a row's history in order, of factors of factors, and of task-bounded factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickweave.functions.catalog import WINDOWED
from tickweave.operators import derived, sequences
from tickweave.operators.factors import PRIMITIVE
from tickweave.operators.labels import Schedule
from tickweave.operators.lens import KEYS, quotes_sql
from tickweave.plans.features import rounded, rows
from tickweave.plans.fills import out
from tickweave.plans.labels import PLAN, TASKS, tasks
from tickweave.plans.oracle import aggregate_sql, rounded_sql


def hist_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Spread, depth, volume rate and variation against the session so far."""
    return rounded(sequences.history_percentiles(rows(spark, d)))


def queue_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Recovery of queues after drops."""
    return rounded(sequences.queue_recovery(rows(spark, d)))


def lag_corr(spark: SparkSession, d: str) -> DataFrame:
    """Order flow and the price after it."""
    return rounded(sequences.lagged_flow(rows(spark, d)))


def directional(spark: SparkSession, d: str) -> DataFrame:
    """Directional variants with the status of their parents."""
    return rounded(derived.variants(rows(spark, d)))


def directional_more(spark: SparkSession, d: str) -> DataFrame:
    """Directional variants of ages, states, percentiles and segments."""
    q = rows(spark, d)
    return rounded(derived.more_variants(q, sequences.history_percentiles(q)))


def mean_gap(spark: SparkSession, d: str) -> DataFrame:
    """Short against long moving mean."""
    return rounded(derived.mean_gap(rows(spark, d)))


def bounded(spark: SparkSession, d: str, plan: Schedule = PLAN) -> DataFrame:
    """Factors of each task's own three seconds."""
    return out(derived.bounded_factors(rows(spark, d), tasks(spark, d, plan)))


QUERIES = {"hist_percentile": hist_percentile, "queue_recovery": queue_recovery, "lag_corr": lag_corr, "factor_directional": directional, "factor_directional_more": directional_more, "factor_mean_gap": mean_gap, "factor_bounded": bounded}


def _window(name: str, group: str, formula: str, h: int, value: str) -> str:
    place: dict[tuple, str] = {("cov", None): "c0"}
    text = PRIMITIVE.sub(lambda m: place.setdefault((m[1], m[2]), f"c{len(place)}"), formula)
    aggs = ", ".join(f"{aggregate_sql(op, x, group, h)} AS {a}" for (op, x), a in place.items())
    return f"""{name} AS (SELECT id, c0, CASE WHEN c0 > 0 AND c0 >= {0.8 * h} THEN {text} END AS {value} FROM (SELECT i.snap_id AS id, any_value(i.p) AS p, {aggs} FROM q i JOIN q j USING (Contract, trade_date, session, seg_{group})
        WHERE j.rn <= i.rn AND j.t >= i.t - {h * 1000000} AND i.valid_{group} AND j.valid_{group} GROUP BY 1))"""


_HIST = (("Spread", "CASE WHEN valid_book THEN spread END", "edge_book", "Difference", "", "{x} - {m}"), ("Depth", "CASE WHEN valid_queue THEN depth END", "edge_queue", "LogRatio", "", "CASE WHEN {m} > 0 AND {x} > 0 THEN ln({x} / {m}) END"), ("VolumeRate", "vr", "edge_volume", "Ratio", "_h5s", "CASE WHEN {m} > 0 THEN {x} / {m} END"), ("PriceRV", "rv", "edge_price", "Ratio", "_h5s", "CASE WHEN {m} > 0 THEN {x} / {m} END"))


def _hist_sql() -> str:
    tables, cols, joins = [], [], []
    for n, (name, x, edge, how, s, f) in enumerate(_HIST):
        tables.append(f"""x{n} AS (SELECT *, {x} AS x FROM v), y{n} AS (SELECT *, lag(x) OVER (PARTITION BY Contract, trade_date, session ORDER BY rn) AS lx FROM x{n}),
        z{n} AS (SELECT i.snap_id AS id, any_value(i.x) AS x, sum(j.dt * j.lx) / sum(j.dt) AS m, sum(j.dt * CASE WHEN j.lx < i.x THEN 1 WHEN j.lx = i.x THEN 0.5 ELSE 0 END) / sum(j.dt) AS share FROM y{n} i JOIN y{n} j USING (Contract, trade_date, session)
            WHERE j.rn <= i.rn AND j.{edge} AND j.lx IS NOT NULL AND i.x IS NOT NULL GROUP BY 1)""")
        value = f.format(x=f"z{n}.x", m=f"z{n}.m")
        cols.append(f"{rounded_sql(value)} AS R04_{name}{how}{s}, {rounded_sql(f'z{n}.share')} AS R04_{name}Percentile{s}")
        joins.append(f"LEFT JOIN z{n} ON z{n}.id = q.snap_id")
    return f"""WITH {quotes_sql()}, {_window('wv', 'volume', WINDOWED['volume', 'D01', 'VolumeRate'][0], 5, 'vr')}, {_window('wp', 'price', WINDOWED['price', 'C01', 'PriceRV'][0], 5, 'rv')},
        v AS (SELECT q.*, vr, rv FROM q LEFT JOIN wv ON wv.id = snap_id LEFT JOIN wp ON wp.id = snap_id), {', '.join(tables)} SELECT q.snap_id, {', '.join(cols)} FROM q {' '.join(joins)}"""


def _values(name: str, keys: list[tuple[str, str, str]], h: int) -> str:
    """Tables ``<name>_w`` and ``<name>``: snap_id, cov, and the factors of one group where the window is usable."""
    (group,) = {k[0] for k in keys}
    place: dict[tuple, str] = {("cov", None): "c0"}
    cols = [f"CASE WHEN valid_{group} AND c0 > 0 AND c0 >= {0.8 * h} THEN {PRIMITIVE.sub(lambda m: place.setdefault((m[1], m[2]), f'c{len(place)}'), WINDOWED[k][0])} END AS {k[1]}_{k[2]}_h{h}s" for k in keys]
    aggs = ", ".join(f"{aggregate_sql(op, x, group, h)} AS {a}" for (op, x), a in place.items())
    return f"""{name}_w AS (SELECT i.snap_id AS id, {aggs} FROM q i JOIN q j USING (Contract, trade_date, session, seg_{group}) WHERE j.rn <= i.rn AND j.t >= i.t - {h * 1000000} AND i.valid_{group} AND j.valid_{group} GROUP BY 1),
        {name} AS (SELECT snap_id, c0 AS cov_{name}, {', '.join(cols)} FROM q LEFT JOIN {name}_w ON id = snap_id)"""


def _directional_sql(h: int = 5) -> str:
    need = {p.format(h=h) for inputs, _ in derived.VARIANTS.values() for p in inputs}
    groups: dict[str, list] = {}
    status = {"F01_QI": "CASE WHEN NOT valid_queue THEN 'INVALID_INPUT' ELSE 'NO_HISTORY' END", "A01_Spread": "CASE WHEN NOT valid_book THEN 'INVALID_INPUT' ELSE 'NO_HISTORY' END"}
    for k in WINDOWED:
        if f"{k[1]}_{k[2]}_h{h}s" in need:
            groups.setdefault(k[0], []).append(k)
            status[f"{k[1]}_{k[2]}_h{h}s"] = f"CASE WHEN NOT valid_{k[0]} THEN 'INVALID_INPUT' WHEN cov_g_{k[0]} = 0 THEN 'NO_COVERAGE' WHEN cov_g_{k[0]} < {0.8 * h} THEN 'WARMUP' ELSE '{WINDOWED[k][1]}' END"
    cols = []
    for name, (inputs, formula) in derived.VARIANTS.items():
        n, parents = name.format(h=h), [p.format(h=h) for p in inputs]
        whole = " AND ".join(f"{p} IS NOT NULL" for p in parents)
        cols.append(f"{rounded_sql(f'CASE WHEN {whole} THEN {formula.format(h=h)} END')} AS {n}, CASE {' '.join(f"WHEN {p} IS NULL THEN 'PARENT_INVALID:{p}:' || {status[p]}" for p in parents)} ELSE 'ok' END AS {n}__status")
    tables = ", ".join(_values(f"g_{g}", ks, h) for g, ks in groups.items())
    flat = "f AS (SELECT q.*, CASE WHEN valid_queue THEN qi END AS F01_QI, CASE WHEN valid_book THEN spread END AS A01_Spread, " + ", ".join(f"g_{g}.* EXCLUDE (snap_id)" for g in groups) + " FROM q " + " ".join(f"JOIN g_{g} ON g_{g}.snap_id = q.snap_id" for g in groups) + ")"
    return f"WITH {quotes_sql()}, {tables}, {flat} SELECT snap_id, {', '.join(cols)} FROM f"


def _mean_states_sql(h: int = 5, outer: int = 5) -> str:
    s, us = f"_h{h}s_g{outer}s", outer * 1000000
    part, lag = "PARTITION BY Contract, trade_date, session", f"_h{h}s_lag2s"
    edge = f"FILTER (WHERE j.edge_m AND j.l_t >= i.t - {us})"
    ok = f"c > 0 AND c >= {0.8 * outer}"
    out = {
        f"M07_AboveShare{s}": f"CASE WHEN {ok} THEN above / c END", f"M07_BelowShare{s}": f"CASE WHEN {ok} THEN below / c END", f"M08_CrossUpRate{s}": f"CASE WHEN {ok} THEN ups / c END", f"M08_CrossDownRate{s}": f"CASE WHEN {ok} THEN downs / c END",
        f"M09_AbsDeviationMean{s}": f"CASE WHEN {ok} THEN absolute / c END", f"M09_DeviationStd{s}": f"CASE WHEN {ok} THEN sqrt(greatest(squares / c - (plain / c) * (plain / c), 0.0)) END", f"M09_MaxPositive{s}": f"CASE WHEN {ok} THEN greatest(hi, 0.0) END", f"M09_MinNegative{s}": f"CASE WHEN {ok} THEN least(lo, 0.0) END",
        f"M07_MeanState{s}": "state * 1e0", f"M07_MeanStateAge{s}": "(t - changed) / 1e6", f"M08_CrossAge{s}": "(t - crossed) / 1e6", f"M07_MeanStateAgeLowerBound{s}": "(t - coalesce(changed, began)) / 1e6", f"M07_MeanStateAgeLeftCensored{s}": "CASE WHEN m IS NOT NULL THEN CASE WHEN changed IS NULL THEN 1e0 ELSE 0e0 END END",
        f"M08_CrossAgeLowerBound{s}": "(t - coalesce(crossed, began)) / 1e6", f"M08_CrossAgeLeftCensored{s}": "CASE WHEN m IS NOT NULL THEN CASE WHEN crossed IS NULL THEN 1e0 ELSE 0e0 END END", f"R06_DerivedCoverage{s}": "c",
        f"M04_DeviationSpeed{lag}": "(m - om) / ((t - ot) / 1e6)", f"M04_AbsDeviationSpeed{lag}": "(abs(m) - abs(om)) / ((t - ot) / 1e6)", f"M05_MeanSpeed{lag}": "(ma - oma) / ((t - ot) / 1e6)",
    }
    return f"""WITH {quotes_sql()}, {_values('g', [('price', 'M01', 'MADeviation')], h)},
    a AS (SELECT q.*, M01_MADeviation_h{h}s AS m, p - M01_MADeviation_h{h}s AS ma FROM q JOIN g USING (snap_id)),
    b AS (SELECT *, lag(m) OVER w AS lm, edge_price AND m IS NOT NULL AND lag(m) OVER w IS NOT NULL AS edge_m, CASE WHEN m > 0.5 THEN 1 WHEN m < -0.5 THEN -1 WHEN m IS NOT NULL THEN 0 END AS state FROM a WINDOW w AS ({part} ORDER BY rn)),
    e AS (SELECT *, sum(CASE WHEN edge_m THEN 0 ELSE 1 END) OVER ({part} ORDER BY rn) AS seg_m FROM b WHERE m IS NOT NULL),
    d AS (SELECT *, lag(state) OVER w AS ls, last_value(nullif(state, 0) IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS side, min(t) OVER ({part}, seg_m) AS began FROM e WINDOW w AS ({part}, seg_m ORDER BY rn)),
    u AS (SELECT *, CASE WHEN state = 1 AND side = -1 THEN 1 ELSE 0 END AS up, CASE WHEN state = -1 AND side = 1 THEN 1 ELSE 0 END AS down FROM d),
    v AS (SELECT *, max(CASE WHEN state <> ls THEN t END) OVER ({part}, seg_m ORDER BY rn) AS changed, max(CASE WHEN up + down > 0 THEN t END) OVER ({part}, seg_m ORDER BY rn) AS crossed FROM u),
    w AS (SELECT i.snap_id AS id, (max(i.t) - min(j.t)) / 1e6 AS c, coalesce(sum(CASE WHEN j.ls = 1 THEN j.dt ELSE 0 END) {edge}, 0) AS above, coalesce(sum(CASE WHEN j.ls = -1 THEN j.dt ELSE 0 END) {edge}, 0) AS below, coalesce(sum(j.up) {edge}, 0) AS ups, coalesce(sum(j.down) {edge}, 0) AS downs,
        sum(abs(j.lm) * j.dt) {edge} AS absolute, sum(j.lm * j.lm * j.dt) {edge} AS squares, sum(j.lm * j.dt) {edge} AS plain, max(j.m) AS hi, min(j.m) AS lo FROM v i JOIN v j USING (Contract, trade_date, session, seg_m) WHERE j.rn <= i.rn AND j.t >= i.t - {us} GROUP BY 1),
    o AS (SELECT i.snap_id AS id, max(j.t) AS ot, arg_max(j.m, j.rn) AS om, arg_max(j.ma, j.rn) AS oma FROM v i JOIN v j USING (Contract, trade_date, session, seg_m) WHERE j.t BETWEEN i.t - 2500000 AND i.t - 2000000 GROUP BY 1)
    SELECT q.snap_id, {', '.join(f'{rounded_sql(e)} AS {n}' for n, e in out.items())} FROM q LEFT JOIN (SELECT snap_id, m, ma, state, changed, crossed, began FROM v) v ON v.snap_id = q.snap_id LEFT JOIN w ON w.id = q.snap_id LEFT JOIN o ON o.id = q.snap_id"""


def _bounded_sql(window: int = 3) -> str:
    us, k = window * 1000000, ", ".join(KEYS)
    forms = {f"{f}_{s}": (g, WINDOWED[g, f, s][0]) for g, f, s in WINDOWED if f"{f}_{s}" in derived.BOUNDED}
    forms |= {"F03_OFI_window": ("ofi", "{sum:ofi}"), "D01_LogVolumeRate": ("volume", "ln(1 + {sum:dv} / nullif({cov}, 0))")}
    tables, joins, cols = [], [], {}
    for g in dict.fromkeys(v[0] for v in forms.values()):
        place: dict[tuple, str] = {("cov", None): f"{g}_0"}
        for n, (group, formula) in forms.items():
            if group == g:
                cols[n] = f"CASE WHEN valid_{g} AND {g}_0 > 0 AND {g}_0 >= {0.8 * window} THEN {PRIMITIVE.sub(lambda m: place.setdefault((m[1], m[2]), f'{g}_{len(place)}'), formula)} END"  # noqa: B023
        aggs = ", ".join(f"{aggregate_sql(op, x, g, window).replace(f'j.l_t >= i.t - {us}', 'j.l_t >= i.task')} AS {a}" for (op, x), a in place.items())
        tables.append(f"b_{g} AS (SELECT {', '.join('i.' + c for c in KEYS)}, i.task, {aggs} FROM bt i JOIN q j ON {' AND '.join(f'i.{c} = j.{c}' for c in KEYS)} AND i.seg_{g} = j.seg_{g} AND j.rn <= i.rn AND j.t >= i.task WHERE i.valid_{g} AND j.valid_{g} GROUP BY ALL)")
        joins.append(f"LEFT JOIN b_{g} USING ({k}, task)")
    own = "coalesce(l_t >= task, false)"
    single = {"F03_OFI_latest": f"CASE WHEN edge_ofi AND {own} THEN ofi END", "F04_QuoteShift": f"CASE WHEN edge_book AND {own} THEN (a - l_a + b - l_b) / 2 END", "F07_QuotePosition": "CASE WHEN valid_position THEN position END", "F01_QI": "CASE WHEN valid_queue THEN qi END", "A02_LogDepth": "CASE WHEN valid_queue THEN ln(1 + depth) END", "F02_QIChange": f"CASE WHEN edge_queue AND {own} THEN qi - l_qi END", "A01_Spread": "CASE WHEN valid_book THEN spread END"}
    names = {**single, **cols}
    inner = ", ".join(f"CASE WHEN task + {us} - t <= 500000 THEN {e} END AS {n}" for n, e in names.items())
    crossed = ", ".join(f"{rounded_sql(f'{x} * {y}')} AS {n}" for n, (x, y) in derived.CROSS.items())
    return f"""WITH {quotes_sql()}, {TASKS}, tk AS (SELECT DISTINCT {k}, task FROM tasks), bt AS (SELECT task, q.*, count(*) OVER (PARTITION BY {', '.join('x.' + c for c in KEYS)}, task) AS rows FROM tk x JOIN q ON {' AND '.join(f'x.{c} = q.{c}' for c in KEYS)} AND q.t BETWEEN task AND task + {us}
        QUALIFY row_number() OVER (PARTITION BY {', '.join('x.' + c for c in KEYS)}, task ORDER BY rn DESC) = 1), {', '.join(tables)}, f AS (SELECT {k}, task, rows, CASE WHEN task + {us} - t <= 500000 THEN (task + {us} - t) / 1e6 END AS source_age, {inner} FROM bt {' '.join(joins)})
    SELECT {k}, task, rows, {rounded_sql('source_age')} AS source_age, {', '.join(f'{rounded_sql(n)} AS {n}' for n in names)}, {crossed} FROM f"""


_M = WINDOWED["price", "M01", "MADeviation"][0]
SQL = {
    "factor_bounded": _bounded_sql(),
    "factor_directional": _directional_sql(),
    "factor_mean_states": _mean_states_sql(),
    "hist_percentile": _hist_sql(),
    "factor_mean_gap": f"""WITH {quotes_sql()}, {_window('s', 'price', _M, 5, 'm')}, {_window('l', 'price', _M, 10, 'm')} SELECT snap_id, {rounded_sql('l.m - s.m')} AS M06_MeanGap_h10s_short5s, CASE WHEN valid_price THEN CASE WHEN s.c0 = l.c0 THEN 1e0 ELSE 0e0 END END AS M06_SameWindow_h10s_short5s FROM q LEFT JOIN s ON s.id = snap_id LEFT JOIN l ON l.id = snap_id""",
}


_K = ", ".join(KEYS)
_ON = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in KEYS)


def _windows(group: str) -> str:
    """Rows whose last 10 s of their segment are seen to four fifths: i, and the first row s of the window."""
    return f"""firsts AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY {_K}, t ORDER BY rn) = 1),
    wi AS (SELECT {", ".join(f"i.{k}" for k in KEYS)}, i.rn, i.t, min(j.rn) AS s_rn, min(j.t) AS s_t FROM q i JOIN q j ON {_ON("i", "j")} AND i.seg_{group} = j.seg_{group} AND j.rn <= i.rn AND j.t >= i.t - 10000000
        WHERE i.valid_{group} AND j.valid_{group} GROUP BY ALL HAVING (i.t - min(j.t)) * 10 >= 80000000)"""


def _recovery_sql() -> str:
    drop = lambda side, size, quote: f"SELECT '{side}' AS side, {_K}, seg_ofi AS seg, rn, t, l_{size} AS was, {size} AS low, {quote} AS quote FROM q WHERE edge_ofi AND {quote} = l_{quote} AND {size} < l_{size} AND (l_{size} - {size}) / l_{size} >= 0.1 - 1e-12"
    key = ", ".join(f"c.{k}" for k in KEYS)
    counts = {"MatureCount": "count(*) FILTER (WHERE mature AND NOT gapped)", "SameCount": "count(*) FILTER (WHERE mature AND kept)", "ExitCount": "count(*) FILTER (WHERE mature AND away)", "SuccessCount": "count(*) FILTER (WHERE mature AND kept AND back IS NOT NULL)", "ImmatureCount": "count(*) FILTER (WHERE NOT mature)", "GappedCount": "count(*) FILTER (WHERE mature AND gapped)", "UnrecoveredCount": "count(*) FILTER (WHERE mature AND kept AND back IS NULL)"}
    cells = []
    for side in ("Bid", "Ask"):
        at = lambda e: e.replace("mature", f"(mature AND side = '{side}')").replace("WHERE NOT (mature", f"WHERE side = '{side}' AND NOT (mature")
        same = at(counts["SameCount"])
        cells += [f"CAST({at(e)} AS DOUBLE) AS B09_{side}{n}_h10s" for n, e in counts.items()]
        for n, e in (("Recovery", "avg(share) FILTER (WHERE mature AND kept)"), ("FullShare", "avg(CASE WHEN share = 1 THEN 1.0 ELSE 0 END) FILTER (WHERE mature AND kept)"), ("SuccessTime", "avg(back) FILTER (WHERE mature AND kept)")):
            cells.append(f"CASE WHEN {same} >= 3 THEN {at(e)} END AS B09_{side}{n}_h10s")
        cells.append(f"CASE WHEN {at(counts['MatureCount'])} >= 3 THEN {at(counts['ExitCount'])} / {at(counts['MatureCount'])} END AS B09_{side}ExitShare_h10s")
    names = [c.rsplit(" AS ", 1)[1] for c in cells]
    more = [(f"B09_{k}Difference_h10s", f"B09_Bid{k}_h10s - B09_Ask{k}_h10s") for k in ("Recovery", "FullShare", "SuccessTime")]
    return f"""WITH RECURSIVE {quotes_sql()}, {_windows("ofi")},
    c AS ({drop("Bid", "qb", "b")} UNION ALL {drop("Ask", "qa", "a")}),
    nx AS (SELECT c.side, {key}, c.seg, c.rn, min(d.rn) AS next FROM c JOIN c d ON {_ON("c", "d")} AND c.side = d.side AND c.seg = d.seg AND c.t + 2000000 <= d.t GROUP BY ALL),
    ac AS (SELECT side, {_K}, seg, min(rn) AS rn FROM c GROUP BY ALL UNION ALL SELECT nx.side, {", ".join(f"nx.{k}" for k in KEYS)}, nx.seg, nx.next FROM ac JOIN nx USING (side, {_K}, seg, rn)),
    ev AS (SELECT c.*, c.t + 2000000 AS due FROM ac JOIN c USING (side, {_K}, seg, rn)),
    en AS (SELECT ev.*, f.rn AS e_rn, coalesce(f.t - due > 500000 OR f.seg_ofi <> seg, false) AS gapped FROM ev ASOF LEFT JOIN firsts f ON {_ON("ev", "f")} AND ev.due <= f.t),
    ft AS (SELECT c.side, {key}, c.rn, bool_or(CASE WHEN c.side = 'Bid' THEN r.b ELSE r.a END IS DISTINCT FROM quote) AS away, max(CASE WHEN r.rn >= c.rn THEN CASE WHEN c.side = 'Bid' THEN r.qb ELSE r.qa END END) AS top,
            min(CASE WHEN r.rn >= c.rn AND CASE WHEN c.side = 'Bid' THEN r.qb ELSE r.qa END >= was THEN r.t END) AS back_t
        FROM en c JOIN q r ON {_ON("c", "r")} AND r.rn BETWEEN c.rn - 1 AND c.e_rn WHERE NOT gapped AND e_rn IS NOT NULL GROUP BY ALL),
    fa AS (SELECT en.*, coalesce(away, false) AS away, ft.rn IS NOT NULL AND NOT away AS kept, least(1.0, greatest(0.0, (top - low) / (was - low))) AS share, CASE WHEN NOT away THEN (back_t - t) / 1e6 END AS back FROM en LEFT JOIN ft USING (side, {_K}, rn)),
    vw AS (SELECT {", ".join(f"w.{k}" for k in KEYS)}, w.rn AS i_rn, fa.*  EXCLUDE ({_K}), fa.due <= w.t AS mature FROM wi w LEFT JOIN fa ON {_ON("w", "fa")} AND fa.rn > w.s_rn AND fa.rn <= w.rn),
    ag AS (SELECT {_K}, i_rn AS rn, {", ".join(cells)} FROM vw GROUP BY {_K}, i_rn)
    SELECT q.snap_id, {", ".join(f"{rounded_sql(n)} AS {n}" for n in names)}, {", ".join(f"{rounded_sql(e)} AS {n}" for n, e in more)} FROM q LEFT JOIN ag USING ({_K}, rn)"""


SQL["queue_recovery"] = _recovery_sql()
SQL["lag_corr"] = f"""WITH {quotes_sql()}, {_windows("full")},
    st AS (SELECT *, t + 2000000 AS due FROM q WHERE edge_full),
    en AS (SELECT {", ".join(f"st.{k}" for k in KEYS)}, st.rn, st.due, st.dt AS w, st.ofi / ((st.l_depth + st.depth) / 2 * st.dt) AS u, (f.p - st.p) / ((f.t - st.t) / 1e6) AS v, f.t - due AS late
        FROM st ASOF JOIN firsts f ON {_ON("st", "f")} AND st.due <= f.t WHERE f.t - due <= 500000 AND f.valid_full AND f.seg_full = st.seg_full),
    pr AS (SELECT {", ".join(f"i.{k}" for k in KEYS)}, i.rn, w, u, v, late FROM wi i LEFT JOIN en ON {_ON("i", "en")} AND en.rn > i.s_rn AND en.rn <= i.rn AND en.due <= i.t),
    mu AS (SELECT *, sum(w * u) OVER g / sum(w) OVER g AS mu, sum(w * v) OVER g / sum(w) OVER g AS mv FROM pr WINDOW g AS (PARTITION BY {_K}, rn)),
    ag AS (SELECT {_K}, rn, count(w) AS n, max(late) / 1e6 AS worst, sum(w * (u - mu) * (v - mv)) / sum(w) AS c, sqrt(sum(w * (u - mu) * (u - mu)) * sum(w * (v - mv) * (v - mv))) / sum(w) AS s FROM mu GROUP BY {_K}, rn)
    SELECT q.snap_id, {rounded_sql("CASE WHEN n >= 8 AND s > 1e-12 THEN least(1.0, greatest(-1.0, c / s)) END")} AS D09_LagOFICorr_h10s_lag2s, {rounded_sql("CAST(n AS DOUBLE)")} AS D09_LagPairCount_h10s_lag2s, {rounded_sql("worst")} AS D09_LagAlignmentMax_h10s_lag2s FROM q LEFT JOIN ag USING ({_K}, rn)"""
