"""Small date-weighted classification models, fitted within trust regions over per-partition sums: no training rows reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators.totals import running_totals
from tickweave.runtime import stored

CLASSES = (-1, 0, 1)


def folds(days: Sequence[str], train: int = 20, test: int = 5) -> list[tuple[list[str], list[str]]]:
    """Walk-forward splits: the first ``train`` days and those after, ``test`` at a time; the training part grows."""
    order = np.unique(np.asarray(days, dtype=object).astype(str)).tolist()
    number = max(0, -(-(len(order) - train) // test))
    return [(order[: train + k * test], order[train + k * test :][:test]) for k in range(number)]


def day_weighted(df: DataFrame, day: str, name: str = "w") -> DataFrame:
    """Weights that make every day count the same and sum to 1."""
    n = df.groupBy(day).agg(F.count("*").alias("_n"))
    total = n.count() or 1
    return df.join(n, day).withColumn(name, F.lit(1.0) / F.col("_n") / total).drop("_n")


def summed(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a vector that ``fn`` makes of each batch: added up per partition, then per position by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = fn(b)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    rows = df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows])


#: Orthonormal contrasts of the three classes: coefficients that sum to 0 over classes are two numbers a feature, whose squares add up alike.
CONTRASTS = np.array([[-1, 1], [0, -2], [1, 1]]) / np.sqrt([2, 6])


def curvature(phi: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(1 + m + m m) sums over rows: weighted log loss of the softmax with contrast coefficients ``phi`` (2, d), its slope and its second derivatives, m = 2 d.

    ``y`` is the class number. One pass without a loop over classes: the scores' covariance is taken in the two contrasts.
    """
    x = np.ascontiguousarray(x.T)
    z = CONTRASTS @ phi @ x
    z -= z.max(axis=0)
    p = np.exp(z)
    total = p.sum(axis=0)
    p /= total
    loss = w @ (np.log(total) - z[y, np.arange(len(y))])
    q = CONTRASTS.T @ p
    slope = ((q - CONTRASTS.T[:, y]) * w) @ x.T
    second = np.empty((*phi.shape, *phi.shape))
    for c, e in ((0, 0), (0, 1), (1, 1)):
        spread = ((CONTRASTS[:, c] * CONTRASTS[:, e]) @ p - q[c] * q[e]) * w
        second[c, :, e] = second[e, :, c] = (x * spread) @ x.T
    return np.concatenate([[loss], slope.ravel(), second.ravel()])


@dataclass
class Model:
    """A fitted softmax: standardisation, coefficients per class, intercepts, and the greatest slope that was left."""

    features: list[str]
    c: float
    mean: list[float]
    scale: list[float]
    coef: list[list[float]]
    intercept: list[float]
    gradient: float = 0.0
    days: list[str] = field(default_factory=list)


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])


def prepared(df: DataFrame, features: Sequence[str], label: str, day: str) -> DataFrame:
    """(features, _day, _y, _w) of the rows with all features and a label, written once; every day weighs the same."""
    x = df.select(*features, F.col(label).cast("int").alias("_y"), F.col(day).alias("_day")).dropna().where("_y in (-1, 0, 1)")
    return stored(day_weighted(x, "_day", "_w"), "training")


class _Search:
    """One fit under way: a trust region around contrast coefficients, in which the quadratic model of the loss is minimised."""

    def __init__(self, columns: list[int], c: float):
        self.columns, self.c = columns, c
        self.phi = np.zeros((2, len(columns) + 1))
        self.trial, self.damp, self.state, self.done, self.why = self.phi, 1e-3, None, False, ""

    def told(self, sums: np.ndarray, rows: float, tolerance: float) -> None:
        """Takes the sums at ``trial``, moves there if the loss fell as foreseen in part, and sets the next trial."""
        m = self.phi.size
        ridge = np.full(self.phi.shape, 1 / (self.c * rows))
        ridge[:, -1] = 0
        loss = sums[0] + (ridge * self.trial**2).sum() / 2
        slope = sums[1 : m + 1] + (ridge * self.trial).ravel()
        second = sums[m + 1 :].reshape(m, m) + np.diag(ridge.ravel())
        if self.state is None or loss <= self.state[0] - 0.05 * self.gain or np.abs(slope).max() < tolerance:
            self.damp = 0.0 if self.state is not None and self.damp < 1e-6 else self.damp / 10
            self.phi, self.state = self.trial, (loss, slope, second)
        else:
            self.damp = max(self.damp * 8, 1e-6)
        loss, slope, second = self.state
        self.done = bool(np.abs(slope).max() < tolerance)
        if self.done:
            return
        if self.damp > 1e12:
            self.done, self.why = True, "no step lowers the loss"
            return
        step = np.linalg.lstsq(second + self.damp * np.eye(m), slope, rcond=None)[0]
        self.gain = float(step @ slope - step @ second @ step / 2)
        self.trial = self.phi - step.reshape(self.phi.shape)


def fit_many(clean: DataFrame, features: Sequence[str], wanted: Sequence[tuple[Sequence[str], float]], tolerance: float = 1e-8, most: int = 100) -> list[Model | str]:
    """The fitted model of each (features, c) on the same ``prepared`` rows, or why there is none: a pass serves all fits that are still under way.

    Ridge softmax of classes -1, 0, 1 with equal days; the intercept is free, coefficients sum to 0 over classes, penalty 1 / (2 c rows).
    Per pass and fit some (2 features)^2 sums reach the driver, rows never.
    """
    features = list(features)
    d = len(features)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        w, x = b.column("_w").to_numpy(), _matrix(b, features)
        return np.concatenate([[b.num_rows], w @ x, np.bincount(b.column("_y").to_numpy() + 1, minlength=3)])

    first = summed(clean, moments)
    if not len(first) or (first[-3:] == 0).any():
        return ["the training rows must hold all three classes"] * len(wanted)
    rows, mean = first[0], first[1 : d + 1]
    scale = np.sqrt(summed(clean, lambda b: b.column("_w").to_numpy() @ (_matrix(b, features) - mean) ** 2))
    scale[scale < 1e-12] = 1
    runs = [_Search([features.index(f) for f in names], c) for names, c in wanted]
    for _ in range(most):
        active = [r for r in runs if not r.done]
        if not active:
            break
        jobs = [(r.columns, r.trial) for r in active]

        def part(b: pa.RecordBatch, jobs: list = jobs) -> np.ndarray:
            x = np.column_stack([(_matrix(b, features) - mean) / scale, np.ones(b.num_rows)])
            y, w = b.column("_y").to_numpy() + 1, b.column("_w").to_numpy()
            return np.concatenate([curvature(phi, x[:, [*columns, d]], y, w) for columns, phi in jobs])

        sums = summed(clean, part)
        sizes = np.cumsum([0, *(1 + r.phi.size + r.phi.size**2 for r in active)])
        for r, a, b in zip(active, sizes, sizes[1:]):
            r.told(sums[a:b], rows, tolerance)
    out: list[Model | str] = []
    for r, (names, c) in zip(runs, wanted):
        if not r.done or r.why:
            out.append(r.why or "the fit did not converge")
            continue
        theta = CONTRASTS @ r.phi
        out.append(Model(list(names), c, mean[r.columns].tolist(), scale[r.columns].tolist(), theta[:, :-1].tolist(), theta[:, -1].tolist(), float(np.abs(r.state[1]).max())))
    return out


def fit_folds(counted: DataFrame, features: Sequence[str], label: str, day: str, parts: Sequence[Sequence[str]], c: float = 1.0, tolerance: float = 1e-8, most: int = 100) -> list[Model | str]:
    """``fit`` on the days of each of ``parts``, or why there is no model: a pass over ``counted`` rows (each stands for ``n`` alike) serves all that are under way."""
    features, names = list(features), sorted({k for p in parts for k in p})
    d, number = len(features), {k: i for i, k in enumerate(names)}
    x = counted.select(*features, F.col(label).cast("int").alias("_y"), F.col(day).alias("_day"), "n").dropna().where(F.col("_y").isin(*CLASSES) & F.col("_day").isin(names))
    rows = {r[0]: r[1] for r in x.groupBy("_day").agg(F.sum("n")).collect()}
    if not rows:
        return ["the training rows must hold all three classes"] * len(parts)
    places = F.create_map(*(F.lit(v) for k in rows for v in (k, number[k])))
    share = F.create_map(*(F.lit(v) for k, r in rows.items() for v in (k, float(r))))
    clean = stored(x.select(*features, "_y", places[F.col("_day")].alias("_at"), "n", (F.col("n") / share[F.col("_day")]).alias("_w")), "training")
    member = np.array([[k in set(p) and k in rows for k in names] for p in parts])

    def moments(b: pa.RecordBatch) -> np.ndarray:
        at, w, x, y = b.column("_at").to_numpy(), b.column("_w").to_numpy(), _matrix(b, features), b.column("_y").to_numpy()
        cells = [np.bincount(at, v, len(names)) for v in (*(w * f for f in x.T), *((y == k).astype(float) for k in CLASSES))]
        return np.concatenate(cells)

    first = summed(clean, moments).reshape(d + 3, len(names))
    days = np.maximum(member.sum(axis=1), 1)
    mean = member @ first[:d].T / days[:, None]
    whole = (member @ first[d:].T > 0).all(axis=1)

    def spread(b: pa.RecordBatch) -> np.ndarray:
        at, w, x = b.column("_at").to_numpy(), b.column("_w").to_numpy(), _matrix(b, features)
        return np.concatenate([np.where(member[f][at], w, 0) @ (x - mean[f]) ** 2 for f in range(len(parts))])

    scale = np.sqrt(summed(clean, spread).reshape(len(parts), d) / days[:, None])
    scale[scale < 1e-12] = 1
    total = [float(sum(rows.get(k, 0) for k in set(p))) for p in parts]
    runs = [_Search(list(range(d)), c) for _ in parts]
    for _ in range(most):
        active = [f for f, r in enumerate(runs) if whole[f] and not r.done]
        if not active:
            break
        jobs = [(f, runs[f].trial) for f in active]

        def part(b: pa.RecordBatch, jobs: list = jobs) -> np.ndarray:
            at, w, x, y = b.column("_at").to_numpy(), b.column("_w").to_numpy(), _matrix(b, features), b.column("_y").to_numpy() + 1
            out = []
            for f, phi in jobs:
                own = np.flatnonzero(member[f][at])
                out.append(curvature(phi, np.column_stack([(x[own] - mean[f]) / scale[f], np.ones(len(own))]), y[own], w[own] / days[f]))
            return np.concatenate(out)

        sums = summed(clean, part).reshape(len(active), -1)
        for f, v in zip(active, sums):
            runs[f].told(v, total[f], tolerance)
    out: list[Model | str] = []
    for f, r in enumerate(runs):
        if not whole[f]:
            out.append("the training rows must hold all three classes")
        elif not r.done or r.why:
            out.append(r.why or "the fit did not converge")
        else:
            theta = CONTRASTS @ r.phi
            out.append(Model(features, c, mean[f].tolist(), scale[f].tolist(), theta[:, :-1].tolist(), theta[:, -1].tolist(), float(np.abs(r.state[1]).max())))
    return out


def fit(df: DataFrame, features: Sequence[str], label: str, day: str, c: float = 1.0, tolerance: float = 1e-8) -> Model:
    """One model, see ``fit_many``. Rows with a missing feature or label are left out; all three classes must occur."""
    features = list(features)
    (model,) = fit_many(prepared(df, features, label, day), features, [(features, c)], tolerance)
    if isinstance(model, str):
        raise ValueError(model)
    return model


def scores(model: Model, prefix: str = "p") -> dict[str, Column]:
    """Columns of the class probabilities of a frozen model: expressions only, so that scoring stays in the JVM."""
    number = lambda v: F.lit(float(v))
    return _softmax([(number(i), [(f, number(m), number(s), number(b)) for f, m, s, b in zip(model.features, model.mean, model.scale, coef)]) for coef, i in zip(model.coef, model.intercept)], prefix)


def _softmax(classes: Sequence[tuple[Column, Sequence[tuple[str, Column, Column, Column]]]], prefix: str) -> dict[str, Column]:
    """Probabilities by each class's intercept and (feature, mean, scale, coefficient)."""
    z = []
    for e, terms in classes:
        for f, m, s, b in terms:
            e = e + (F.col(f) - m) / s * b
        z.append(e)
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    return {f"{prefix}_{n}": F.exp(x - top) / total for n, x in zip(("down", "flat", "up"), z)}


def scored_by_day(df: DataFrame, day: str, models_: Sequence[tuple[Model, Sequence[str]]], prefix: str = "p") -> DataFrame:
    """``df`` with ``model`` (numbers from 1) and its probabilities, a row for each of ``models_`` (same features) whose days hold the row's: ``scores`` with its numbers looked up."""
    features = models_[0][0].features if models_ else []
    rows = [(k, i + 1, [float(v) for v in m.mean], [float(v) for v in m.scale], [[float(v) for v in c] for c in m.coef], [float(v) for v in m.intercept]) for i, (m, days) in enumerate(models_) for k in days]
    by = df.sparkSession.createDataFrame(rows, f"`{day}` string, model int, _mean array<double>, _scale array<double>, _coef array<array<double>>, _intercept array<double>")
    p = _softmax([(F.col("_intercept")[k], [(f, F.col("_mean")[j], F.col("_scale")[j], F.col("_coef")[k][j]) for j, f in enumerate(features)]) for k in range(3)], prefix)
    return df.join(F.broadcast(by), day).withColumns(p).drop("_mean", "_scale", "_coef", "_intercept")


def predicted(prefix: str = "p") -> Column:
    """The likeliest class, the lower one of equals."""
    d, f, u = (F.col(f"{prefix}_{n}") for n in ("down", "flat", "up"))
    return F.when((d >= f) & (d >= u), -1).when(f >= u, 0).otherwise(1)


def log_loss(y: str = "y", prefix: str = "p") -> Column:
    p = F.when(F.col(y) == -1, F.col(f"{prefix}_down")).when(F.col(y) == 0, F.col(f"{prefix}_flat")).otherwise(F.col(f"{prefix}_up"))
    return -F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-15)))


def metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y", prefix: str = "p") -> DataFrame:
    """n, accuracy, balanced accuracy, log loss, Brier score, recall and precision per class, share of flat."""
    x = df.where(F.col(y).isNotNull()).withColumns({"_c": predicted(prefix), "_l": log_loss(y, prefix)})
    b = sum((F.pow(F.col(f"{prefix}_{n}") - F.when(F.col(y) == k, 1.0).otherwise(0.0), F.lit(2.0)) for k, n in zip(CLASSES, ("down", "flat", "up"))), F.lit(0.0))
    hit = lambda k: F.sum(F.when((F.col(y) == k) & (F.col("_c") == k), 1.0).otherwise(0.0))
    of = lambda c, k: F.sum(F.when(F.col(c) == k, 1.0).otherwise(0.0))
    cols = [F.count("*").alias("n"), F.avg(F.when(F.col("_c") == F.col(y), 1.0).otherwise(0.0)).alias("accuracy"), F.avg("_l").alias("logloss"), F.avg(b).alias("brier"), F.avg(F.when(F.col(y) == 0, 1.0).otherwise(0.0)).alias("flat_share")]
    for k, n in zip(CLASSES, ("down", "flat", "up")):
        cols += [F.try_divide(hit(k), of(y, k)).alias(f"{n}_recall"), F.try_divide(hit(k), of("_c", k)).alias(f"{n}_precision")]
    g = x.groupBy(*by).agg(*cols)
    r = [F.col(f"{n}_recall") for n in ("down", "flat", "up")]
    have = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in r[1:]), F.when(r[0].isNotNull(), 1).otherwise(0))
    return g.withColumn("balanced_accuracy", F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in r[1:]), F.coalesce(r[0], F.lit(0.0))), have))


def daily_log_loss(df: DataFrame, day: str, y: str = "y", prefix: str = "p") -> float:
    """Mean over days of the days' mean log loss."""
    x = df.where(F.col(y).isNotNull()).groupBy(day).agg(F.avg(log_loss(y, prefix)).alias("l")).agg(F.avg("l").alias("l")).first()
    return float("nan") if x is None or x["l"] is None else x["l"]


def threshold_coverage(df: DataFrame, day: str, thresholds: Sequence[float], y: str = "y", prefix: str = "p") -> DataFrame:
    """Per confidence threshold: signals, their share, and accuracy pooled and with equal days. Each row takes part at every threshold it reaches."""
    up, down = F.col(f"{prefix}_up"), F.col(f"{prefix}_down")
    x = df.where(F.col(y).isNotNull()).withColumns({"_s": F.when(up >= down, 1).otherwise(-1), "_m": F.greatest(up, down)})
    x = x.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))).withColumn("_k", F.col("_m") >= F.col("threshold"))
    hit = F.when(F.col("_k"), F.when(F.col("_s") == F.col(y), 1.0).otherwise(0.0))
    daily = x.groupBy("threshold", day).agg(F.count("*").alias("n"), F.count_if("_k").alias("k"), F.sum(hit).alias("h"), F.avg(hit).alias("a"))
    return daily.groupBy("threshold").agg(F.sum("k").alias("signals"), F.try_divide(F.sum("k"), F.sum("n")).alias("coverage"), F.try_divide(F.sum("h"), F.sum("k")).alias("pooled_accuracy"), F.avg("a").alias("accuracy"), F.count("a").alias("days"))


def class_prior(df: DataFrame, day: str, y: str = "y") -> DataFrame:
    """(class, prior): date-weighted shares of the classes with a touch of smoothing."""
    w = day_weighted(df.where(F.col(y).isin(*CLASSES)), day, "_w")
    s = w.groupBy(F.col(y).alias("class")).agg(F.sum("_w").alias("s"), F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(k,) for k in CLASSES], "class int")
    total = w.agg(F.count("*").alias("rows"))
    x = every.join(s, "class", "left").join(F.broadcast(total)).select("class", (F.coalesce("s", F.lit(0.0)) * F.col("rows") + 1e-6).alias("s"))
    return x.select("class", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("prior"))


def cross_products(df: DataFrame, features: Sequence[str], day: str) -> np.ndarray:
    """(d, d) date-weighted covariances of features over the rows that have all of them; empty without rows. Sums go to the driver, rows do not."""
    features = list(features)
    clean = stored(day_weighted(df.select(*features, F.col(day).alias("_day")).dropna(), "_day", "_w"), "products")
    m = summed(clean, lambda b: b.column("_w").to_numpy() @ _matrix(b, features))
    if not len(m):
        return np.empty((0, 0))
    return summed(clean, lambda b: np.einsum("n,ni,nj->ij", b.column("_w").to_numpy(), _matrix(b, features) - m, _matrix(b, features) - m).ravel()).reshape(len(features), -1)


def collinearity(g: np.ndarray, most_vif: float = 5.0, most_pair: float = 0.9) -> dict:
    """VIF, condition number, greatest pair correlation and status of covariances: CONSTANT, DEPENDENT, COLLINEAR or OK.

    All from one Cholesky factor of the correlations: a vanishing pivot is dependence, the inverse factor's columns give the VIF.
    """
    bad = lambda status, pair=float("nan"): {"status": status, "vif": float("inf"), "condition": float("inf"), "pair": pair}
    sd = np.sqrt(np.diag(g)) if g.size else np.zeros(1)
    if (sd < 1e-12).any():
        return bad("CONSTANT")
    r = g / sd[:, None] / sd
    try:
        lower = np.linalg.cholesky(r)
    except np.linalg.LinAlgError:
        return bad("DEPENDENT", 1.0)
    if lower.diagonal().min() ** 2 <= 1e-10:
        return bad("DEPENDENT", 1.0)
    vif = float((np.linalg.inv(lower) ** 2).sum(axis=0).max())
    pair = float(np.abs(np.tril(r, -1)).max()) if len(r) > 1 else 0.0
    return {"status": "OK" if vif <= most_vif + 1e-9 and pair < most_pair else "COLLINEAR", "vif": vif, "condition": float(np.linalg.cond(lower)), "pair": pair}


def design(df: DataFrame, features: Sequence[str], day: str, most_vif: float = 5.0, most_pair: float = 0.9) -> dict:
    """``collinearity`` of date-weighted features."""
    return collinearity(cross_products(df, features, day), most_vif, most_pair)


def explained(df: DataFrame, core: Sequence[str], feature: str, day: str) -> float:
    """Share of a feature's date-weighted variance that a linear fit on the core explains, from summed products; nan if it does not vary."""
    cols = [*core, feature]
    clean = day_weighted(df.select(*cols, F.col(day).alias("_day")).dropna(), "_day", "_w")
    k = len(cols) + 1

    def part(b: pa.RecordBatch) -> np.ndarray:
        x = np.column_stack([np.ones(b.num_rows), _matrix(b, cols)])
        return (x.T @ (x * b.column("_w").to_numpy()[:, None])).ravel()

    g = summed(clean, part)
    if not len(g):
        return float("nan")
    g = g.reshape(k, k)
    total = g[-1, -1] - g[0, -1] ** 2
    if total <= 1e-12:
        return float("nan")
    b = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
    return float(min(1.0, max(0.0, 1 - (g[-1, -1] - b @ g[:-1, -1]) / total)))


def pool(df: DataFrame, features: Sequence[str], least: float = 0.9) -> DataFrame:
    """(feature, coverage, status) with LOW_COVERAGE_OR_CONSTANT for features that too few rows have or that do not vary."""
    f = list(features)
    x = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in f))).alias("x")).select("x.*")
    g = x.groupBy("feature").agg((F.count("v") / F.count("*")).alias("coverage"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ok = (F.col("coverage") >= least) & (F.col("lo") < F.col("hi"))
    return g.select("feature", "coverage", F.when(ok, "OK").otherwise("LOW_COVERAGE_OR_CONSTANT").alias("status"))


CS = (0.1, 1.0, 10.0)


def _daily_losses(rows: DataFrame, day: str, label: str, fitted: Sequence[Model | str]) -> list[float]:
    """Mean over days of the days' mean log loss of each model, in one pass; infinity where there is no model."""
    good = [(i, m) for i, m in enumerate(fitted) if isinstance(m, Model)]
    out = [float("inf")] * len(fitted)
    if good:
        losses = []
        for i, m in good:
            p = list(scores(m).values())
            losses.append(F.avg(-F.ln(F.greatest(F.least(F.element_at(F.array(*p), F.col(label) + 2), F.lit(1.0)), F.lit(1e-15)))).alias(f"l{i}"))
        one = rows.where(F.col(label).isNotNull()).groupBy(day).agg(*losses).agg(*(F.avg(f"l{i}").alias(f"l{i}") for i, _ in good)).first()
        for i, _ in good:
            out[i] = float("inf") if one is None or one[f"l{i}"] is None else one[f"l{i}"]
    return out


def validated(df: DataFrame, wanted: Sequence[tuple[Sequence[str], float]], label: str, day: str, held: int = 5) -> list[tuple[Model | str, float]]:
    """Each (features, c) fitted on all but the last ``held`` days, with its daily log loss on those; all on the rows that have every feature named."""
    features = sorted({f for names, _ in wanted for f in names})
    days = sorted(r[0] for r in df.select(day).where(F.col(day).isNotNull()).distinct().collect())
    rows = df.dropna(subset=[*features, label])
    fitted = fit_many(prepared(rows.where(F.col(day).isin(days[:-held])), features, label, day), features, wanted)
    return list(zip(fitted, _daily_losses(rows.where(F.col(day).isin(days[-held:])), day, label, fitted)))


def tune(df: DataFrame, features: Sequence[str], label: str, day: str, held: int = 5, cs: Sequence[float] = CS) -> tuple[float, list[tuple[float, float]]]:
    """The c of least daily log loss on the last ``held`` days, fitted on those before; and all trials (c, loss)."""
    trials = validated(df, [(list(features), c) for c in cs], label, day, held)
    if not any(isinstance(m, Model) for m, _ in trials):
        raise ValueError(str(trials[0][0]))
    losses = [(c, loss) for c, (_, loss) in zip(cs, trials)]
    return min(losses, key=lambda t: t[1])[0], losses


def search(df: DataFrame, core: Sequence[str], more: Sequence[str], label: str, day: str, held: int = 5, adds: int = 2, tolerance: float = 0.002, width: int = 2, cs: Sequence[float] = CS) -> dict:
    """The core with up to ``adds`` of ``more``, by a beam: of each size the ``width`` best go on to the next, with every feature they lack.

    Candidates must pass the collinearity gate (from one table of products); those of a size are fitted together, with every c. Within
    ``tolerance`` of the best validation loss the fewest features win, then the loss, then the names.
    """
    core, more = list(core), sorted(set(more) - set(core))
    every = [*core, *more]
    rows = df.dropna(subset=every)
    g = cross_products(rows, every, day)
    tried, beam = [], [()]
    for size in range(adds + 1):
        level = [()] if not size else sorted({tuple(sorted({*b, f})) for b in beam for f in more if f not in b})
        fits = []
        for extra in level:
            names = [*core, *extra]
            at = [every.index(f) for f in names]
            gate = collinearity(g[np.ix_(at, at)])["status"] if len(names) > 1 and g.size else "OK"
            (fits if gate == "OK" else tried).append({"features": names, "status": "OK" if gate == "OK" else "REJECTED_COLLINEAR", "loss": float("inf"), "c": None, "extra": extra})
        results = validated(rows, [(f["features"], c) for f in fits for c in cs], label, day, held) if fits else []
        for k, f in enumerate(fits):
            mine = [(loss, c) for c, (m, loss) in zip(cs, results[k * len(cs) : (k + 1) * len(cs)]) if isinstance(m, Model)]
            f["loss"], f["c"] = min(mine) if mine else (float("inf"), None)
            f["status"] = "OK" if mine else "FIT_FAILED"
        tried += fits
        beam = [f["extra"] for f in sorted((f for f in fits if f["status"] == "OK"), key=lambda f: (f["loss"], f["features"]))[:width]]
        if not beam:
            break
    tried = [{k: v for k, v in f.items() if k != "extra"} for f in tried]
    good = [t for t in tried if t["status"] == "OK"]
    if not good:
        raise ValueError("no candidate can be fitted")
    floor = min(t["loss"] for t in good)
    chosen = min((t for t in good if t["loss"] <= floor + tolerance), key=lambda t: (len(t["features"]), t["loss"], t["features"]))
    return {"chosen": chosen, "tried": tried}


def confidence_threshold(rows: DataFrame, share: float, prefix: str = "p") -> float | None:
    """The confidence that ``share`` of the rows fall below: fixed on validation rows, for use on later ones."""
    return rows.select(F.expr(f"percentile(greatest({prefix}_up, {prefix}_down), {float(share)}D)")).first()[0]


def confidence_thresholds(rows: DataFrame, by: str, share: float, n: str = "n", prefix: str = "p") -> DataFrame:
    """(by, least): ``confidence_threshold`` of each group of rows that stand for ``n`` alike, by running totals instead of one sort a group."""
    counts = rows.groupBy(by, F.greatest(f"{prefix}_up", f"{prefix}_down").alias("_s")).agg(F.sum(n).alias("_n"))
    t = running_totals(counts, [by], ["_s"], "_n", "_t").withColumn("_at", (F.col("_t_all") - 1) * float(share))
    first = lambda rank: F.min(F.when(F.col("_t") > rank, F.col("_s")))
    g = t.groupBy(by).agg(F.first("_at").alias("_at"), first(F.floor("_at")).alias("_lo"), first(F.ceil("_at")).alias("_hi"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_lo") + (F.col("_at") - F.floor("_at")) * F.col("_hi")
    return g.select(by, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias("least"))


def by_fold(df: DataFrame, models_: Sequence[Model], day: str, prefix: str = "p") -> DataFrame:
    """``df`` scored by the model whose ``days`` hold the row's day; rows of other days have no score. Models are few: the lookup is an expression."""
    out = {}
    each = [(F.col(day).isin(m.days), scores(m, prefix)) for m in models_]
    for n in ("down", "flat", "up"):
        c = F.lit(None).cast("double")
        for when, s in each:
            c = F.when(when, s[f"{prefix}_{n}"]).otherwise(c)
        out[f"{prefix}_{n}"] = c
    return df.withColumns(out)
