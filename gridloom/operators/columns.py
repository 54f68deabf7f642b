"""Columns of the key space and the piecewise linear model of each: key -> position in its column.

A model is f(t) = sum_j alpha_j * max(0, t - beta_j) over t = key - least key of the column. It is valid if the knots beta rise
and the running sums of alpha, its slopes, are not negative.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import GridConfig
from .order import ranked

#: Points of a column that the exploratory network is trained on, at evenly spaced positions.
MLP_POINTS = 20_000


def boundaries(ranks: DataFrame, config: GridConfig) -> list[float]:
    """Where columns 1, 2, ... begin: the first key above the midpoint between the neighbours at each ``i * (n // models)``.

    ``ranks``: (key, rank), rank from 1. Fewer points than models give one column. At most ``models`` keys reach the driver.
    """
    n = ranks.count()
    step = n // config.models
    if not step:
        return []
    near = ranks.where(((F.col("rank") - 1) % step).isin(0, step - 1) & (F.col("rank") > 1)).where(F.col("rank") <= (config.models - 1) * step + 1).select("rank", "key").collect() if step > 1 else ranks.where(F.col("rank") <= config.models).select("rank", "key").collect()
    keys = {r["rank"]: r["key"] for r in near}
    mids = [(keys[i * step] + keys[i * step + 1]) / 2 for i in range(1, config.models)]
    first = ranks.agg(*(F.min(F.when(F.col("key") > m, F.col("key"))).alias(f"b{i}") for i, m in enumerate(mids))).first() if mids else []
    return [b for b in first if b is not None]


def column_of(key: Column, starts: list[float]) -> Column:
    if not starts:
        return F.lit(0).cast("long")
    return F.size(F.filter(F.array(*map(F.lit, starts)), lambda b: b <= key)).cast("long")


def with_columns_of(ranks: DataFrame, starts: list[float]) -> DataFrame:
    return ranks.withColumn("col_id", column_of(F.col("key"), starts))


def column_stats(placed: DataFrame, config: GridConfig) -> DataFrame:
    """(col_id, n, min_key, max_key, end): end counts the points up to the column's last. As many rows as columns."""
    from pyspark.sql import Window

    own = placed.groupBy("col_id").agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return own.withColumn("end", F.sum("n").over(Window.orderBy("col_id")))


def training_pairs(placed: DataFrame, stats: DataFrame) -> DataFrame:
    """(col_id, n, pos, t): positions from 0 in the column, keys less the column's least. ``placed`` holds global ranks."""
    own = placed.join(F.broadcast(stats.select("col_id", "n", "min_key", "end")), "col_id")  # one row for each column
    return own.select("col_id", "n", (F.col("rank") - 1 - F.col("end") + F.col("n")).alias("pos"), (F.col("key") - F.col("min_key")).alias("t"))


def knots(pairs: DataFrame, config: GridConfig) -> DataFrame:
    """(col_id, n, i, beta, pos): knots at every ``n // sigma``-th position; columns of fewer than sigma points: all points."""
    step = F.greatest(F.floor(F.col("n") / config.sigma).cast("long"), F.lit(1).cast("long"))
    at = pairs.withColumn("i", F.floor(F.col("pos") / step).cast("long")).where((F.col("pos") % step == 0) & (F.col("i") < config.sigma))
    return at.select("col_id", "n", "i", F.col("t").alias("beta"), "pos")


def interpolate(knot_rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(col_id, min_key, n, betas, alphas): the polyline through the knots and on to (greatest key, n - 1); flat over ties."""
    lists = knot_rows.groupBy("col_id").agg(F.array_sort(F.collect_list(F.struct("i", "beta", "pos"))).alias("k"))
    own = lists.join(stats.select("col_id", "n", "min_key", "max_key"), "col_id")
    end = F.array(F.struct(F.lit(-1).cast("long").alias("i"), (F.col("max_key") - F.col("min_key")).alias("beta"), (F.col("n") - 1).alias("pos")))
    own = own.withColumn("p", F.concat("k", end))
    slopes = F.transform(F.sequence(F.lit(0), F.size("k") - 1), lambda i: F.when(F.get("p", i + 1)["beta"] > F.get("p", i)["beta"], (F.get("p", i + 1)["pos"] - F.get("p", i)["pos"]) / (F.get("p", i + 1)["beta"] - F.get("p", i)["beta"])).otherwise(F.lit(0.0)))
    own = own.withColumn("slopes", slopes)
    alphas = F.transform("slopes", lambda s, i: s - F.coalesce(F.get("slopes", i - 1), F.lit(0.0)))
    return own.select("col_id", "min_key", "n", F.transform("k", lambda e: e["beta"]).alias("betas"), alphas.alias("alphas"))


def relu(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def predict(t: Column, alphas: str = "alphas", betas: str = "betas") -> Column:
    """The model's position, summed in knot order."""
    terms = F.zip_with(alphas, betas, lambda a, b: a * relu(t - b))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def losses(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(col_id, loss): squared differences between position and prediction, clipped to [0, n]."""
    own = pairs.join(weights.select("col_id", "alphas", "betas"), "col_id")
    miss = F.greatest(F.least(predict(F.col("t")), F.col("n").cast("double")), F.lit(0.0)) - F.col("pos")
    return own.groupBy("col_id").agg(F.sum(miss * miss).alias("loss"))


def is_valid(alphas: str = "alphas", betas: str = "betas") -> Column:
    """Knots strictly rise and no slope is negative."""
    slopes = F.transform(F.sequence(F.lit(1), F.size(alphas)), lambda i: F.aggregate(F.slice(alphas, 1, i), F.lit(0.0), lambda s, v: s + v))
    rising = F.forall(F.sequence(F.lit(0), F.size(betas) - 1), lambda i: (i == 0) | (F.get(betas, i) > F.get(betas, i - 1)))
    return rising & F.forall(slopes, lambda s: s >= -1e-9)


@dataclass
class Sums:
    """What the squared loss of a column needs to know about its points, for some knots: sums over all of them.

    With b_j = max(0, t - beta_j): ``gram`` of b_j b_k, ``right`` of b_j pos, ``square`` of pos^2, and for t > beta_j ``above`` of
    b_k and ``beyond`` of pos.
    """

    gram: np.ndarray
    right: np.ndarray
    square: float
    above: np.ndarray
    beyond: np.ndarray

    @staticmethod
    def of(t: np.ndarray, pos: np.ndarray, betas: np.ndarray) -> Sums:
        basis = np.maximum(t[:, None] - betas, 0)
        open_ = (basis > 0).astype(float)
        return Sums(basis.T @ basis, basis.T @ pos, float(pos @ pos), open_.T @ basis, open_.T @ pos)

    def flat(self) -> np.ndarray:
        return np.concatenate((self.gram.ravel(), self.right, [self.square], self.above.ravel(), self.beyond))

    @staticmethod
    def read(flat: np.ndarray, k: int) -> Sums:
        gram, right, square, above, beyond = np.split(flat, np.cumsum([k * k, k, 1, k * k]))
        return Sums(gram.reshape(k, k), right, float(square[0]), above.reshape(k, k), beyond)

    def loss(self, alphas: np.ndarray) -> float:
        return float(alphas @ self.gram @ alphas - 2 * alphas @ self.right + self.square)

    def solve(self) -> np.ndarray:
        """Least-squares alphas whose running sums, the slopes, are not negative: plain if that holds, else by descent in the slopes."""
        k = len(self.right)
        scale = np.trace(self.gram) / k or 1.0
        alphas = np.linalg.solve(self.gram + 1e-10 * scale * np.eye(k), self.right)
        if np.isfinite(alphas).all() and np.cumsum(alphas).min() >= 0:
            return alphas
        step = np.eye(k) - np.eye(k, k=-1)
        gram, right = step.T @ self.gram @ step, step.T @ self.right
        slopes = np.maximum(np.cumsum(np.where(np.isfinite(alphas), alphas, 0.0)), 0)
        for _ in range(500):
            before = slopes.copy()
            for j in range(k):
                if gram[j, j] > 0:
                    slopes[j] = max(0.0, slopes[j] + (right[j] - gram[j] @ slopes) / gram[j, j])
            if np.abs(slopes - before).max() <= 1e-12 * max(1.0, np.abs(slopes).max()):
                break
        return np.diff(slopes, prepend=0.0)

    def pull(self, alphas: np.ndarray) -> np.ndarray:
        """The direction in which each knot should move for the loss to fall."""
        return 2 * alphas * (self.above @ alphas - self.beyond)


@dataclass
class Fit:
    """The best model of a column so far, and the knots under trial."""

    width: float
    alphas: np.ndarray
    betas: np.ndarray
    trial: np.ndarray
    loss: float = np.inf
    step: float = 0.25
    done: bool = False
    pull: np.ndarray | None = None

    def take(self, sums: Sums) -> None:
        """Judge the trial by its sums and propose the next knots: downhill, half as far after a failure."""
        alphas = sums.solve()
        loss = sums.loss(alphas)
        if loss < self.loss:
            self.done = self.loss - loss <= 1e-6 * self.loss if np.isfinite(self.loss) else False
            self.alphas, self.betas, self.loss, self.pull = alphas, self.trial, loss, sums.pull(alphas)
            self.step *= 1.5
        else:
            self.step /= 2
            self.done = self.step < 1e-3
        size = np.abs(self.pull).max()
        if not size or len(self.betas) < 2:
            self.done = True
            return
        gap = self.width / len(self.betas)
        moved = np.maximum.accumulate(np.clip(self.betas + self.step * gap * self.pull / size, 0, self.width))
        moved[0] = self.betas[0]
        # knots stay apart
        fixed = np.maximum.accumulate(moved - np.arange(len(moved)) * 1e-6 * gap) + np.arange(len(moved)) * 1e-6 * gap
        self.trial = fixed


def _summed(pairs: DataFrame, fits: dict[int, Fit]) -> dict[int, Sums]:
    """The sums of every open column, by one pass over the points: partial sums of Arrow batches, then an aggregate."""
    knots_of = {c: f.trial for c, f in fits.items() if not f.done}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            col, t, pos = (batch.column(c).to_numpy() for c in ("col_id", "t", "pos"))
            order = np.argsort(col, kind="stable")
            cuts = np.flatnonzero(np.diff(col[order], prepend=np.iinfo(np.int64).min))
            for a, b in zip(cuts, np.append(cuts[1:], len(col))):
                c = int(col[order[a]])
                if c in knots_of:
                    own = Sums.of(t[order[a:b]], pos[order[a:b]].astype(float), knots_of[c]).flat()
                    held[c] = held[c] + own if c in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["col_id", "sums"])

    parts = pairs.select("col_id", "t", "pos").mapInArrow(run, "col_id long, sums array<double>")
    rows = parts.select("col_id", F.posexplode("sums").alias("i", "v")).groupBy("col_id", "i").agg(F.sum("v").alias("v"))
    rows = rows.groupBy("col_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("sums"))
    # one row for each column, as long as twice the square of its knots
    return {r["col_id"]: Sums.read(np.array(r["sums"]), len(knots_of[r["col_id"]])) for r in rows.collect()}


def train(pairs: DataFrame, stats: DataFrame, config: GridConfig, rounds: int = 12) -> DataFrame:
    """As :func:`interpolate`, by least squares with moving knots over all points: each round is one aggregate pass for all columns.

    Slopes solve the normal equations, or, where one would be negative, the same under that bound; knots then move downhill. A
    column ends no worse than the polyline through its first knots.
    """
    first = interpolate(knots(pairs, config), stats)
    start = {r["col_id"]: r for r in first.join(stats.select("col_id", "max_key"), "col_id").collect()}  # one row for each column
    fits = {c: Fit(r["max_key"] - r["min_key"], np.array(r["alphas"]), np.unique(r["betas"]), np.unique(r["betas"])) for c, r in start.items()}
    for _ in range(rounds):
        if all(f.done for f in fits.values()):
            break
        for c, sums in _summed(pairs, fits).items():
            fits[c].take(sums)
    rows = [(c, start[c]["min_key"], start[c]["n"], f.betas.tolist(), f.alphas.tolist()) for c, f in fits.items()]
    return pairs.sparkSession.createDataFrame(rows, "col_id long, min_key double, n long, betas array<double>, alphas array<double>")


def fit_mlp(t: np.ndarray, pos: np.ndarray, hidden: int = 8, rounds: int = 300, rate: float = 0.01) -> tuple[np.ndarray, float]:
    """A monotone network 1 -> hidden -> hidden -> 1: weights are exponentials, so outputs never fall. (parameters, loss)."""
    x = (t - t[0]) / max(t[-1] - t[0], 1e-6)
    y = pos / max(len(pos) - 1, 1)
    g = np.random.default_rng(0)
    shapes = [(1, hidden), (hidden,), (hidden, hidden), (hidden,), (hidden, 1), (1,)]
    sizes = [int(np.prod(s)) for s in shapes]
    p = np.concatenate([g.normal(-1.0, 0.3, z) if k % 2 == 0 else -g.random(z) for k, z in enumerate(sizes)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        out, grads = _mlp(p, x, shapes, y)
        m, v = 0.9 * m + 0.1 * grads, 0.999 * v + 0.001 * grads**2
        p = p - rate * 0.5 * (1 + np.cos(np.pi * k / rounds)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    out, _ = _mlp(p, x, shapes, y)
    return p, float(((out * max(len(pos) - 1, 1) - pos) ** 2).sum())


def _mlp(p: np.ndarray, x: np.ndarray, shapes: list, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    cut = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    w1, b1, w2, b2, w3, b3 = (p[a:b].reshape(s) for a, b, s in zip(cut, cut[1:], shapes))
    e1, e2, e3 = np.exp(w1), np.exp(w2), np.exp(w3)
    h1 = np.maximum(x[:, None] @ e1 + b1, 0)
    h2 = np.maximum(h1 @ e2 + b2, 0)
    out = (h2 @ e3 + b3)[:, 0]
    if y is None:
        return out, None
    d = (2 * (out - y) / len(y))[:, None]
    d2 = (d @ e3.T) * (h2 > 0)
    d1 = (d2 @ e2.T) * (h1 > 0)
    grads = [x[None, :] @ d1 * e1, d1.sum(0), h1.T @ d2 * e2, d2.sum(0), h2.T @ d * e3, d.sum(0)]
    return out, np.concatenate([q.ravel() for q in grads])


def mlp_outputs(p: np.ndarray, x: np.ndarray, hidden: int = 8) -> np.ndarray:
    return _mlp(p, x, [(1, hidden), (hidden,), (hidden, hidden), (hidden,), (hidden, 1), (1,)])[0]


def train_mlp(pairs: DataFrame, hidden: int = 8, rounds: int = 300) -> DataFrame:
    """(col_id, parameters, loss): a monotone network for each column; exploratory, lookups do not use it."""
    thin = F.greatest(F.floor(F.col("n") / MLP_POINTS).cast("long"), F.lit(1).cast("long"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        p, loss = fit_mlp(group.t.to_numpy(), np.arange(len(group), dtype=float), hidden, rounds)
        return pd.DataFrame({"col_id": [int(group.col_id.iloc[0])], "parameters": [p.tolist()], "loss": [loss]})

    return pairs.where(F.col("pos") % thin == 0).groupBy("col_id").applyInPandas(fit, "col_id long, parameters array<double>, loss double")


def random_weights(stats: DataFrame, config: GridConfig, seed: int = 0) -> DataFrame:
    """Valid weights without training, for timing: knots evenly spaced, slopes at random."""
    i = F.sequence(F.lit(0), F.lit(config.sigma - 1))
    span = (F.col("max_key") - F.col("min_key")) / config.sigma
    return stats.select("col_id", "min_key", "n", F.transform(i, lambda k: k * span).alias("betas"), F.transform(i, lambda k: F.abs(F.xxhash64(F.lit(seed), "col_id", k) % 1000) / 1000.0).alias("alphas"))
