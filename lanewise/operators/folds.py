"""Leave-one-group-out logistic models of all groups in one fit.

Every group is held out once, so there are as many models as groups. A Newton step needs, for each model, the gradient and the
curvature over all rows but its own group's. Both are sums over rows: one pass evaluates all models on each batch of rows with matrix
products, adds the batch up, and sends one small block a task through the shuffle. Twenty groups cost passes, not fits: about as many
as one model needs, and no row is copied. Groups are taken to be few (sites, matches, sources), at most MOST_GROUPS.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_GROUPS, STEPS, TOLERANCE, FARTHEST = 1000, 60, 1e-10, 30.0


@dataclass
class Folds:
    """Model i leaves groups[i] out: mu and sd of its training rows, weights on that scale with the intercept first."""
    groups: np.ndarray
    n_train: np.ndarray
    mu: np.ndarray
    sd: np.ndarray
    weights: np.ndarray

    def rows(self) -> list[tuple]:
        return [(int(g), int(n), m.tolist(), s.tolist(), w.tolist()) for g, n, m, s, w in zip(self.groups, self.n_train, self.mu, self.sd, self.weights)]

    def table(self, like: DataFrame) -> DataFrame:
        """One row a group: group_id, n_train, mu, sd, weights."""
        return like.sparkSession.createDataFrame(self.rows(), "group_id long, n_train long, mu array<double>, sd array<double>, weights array<double>")


def _sums(df: DataFrame, features: list[str], label: str, folds: Folds) -> np.ndarray:
    """(model, 1 + k + k * k + 1): per model the log-loss, gradient and curvature over its training rows, at its weights."""
    k, names = len(features) + 1, ["group_id", label, *features]
    groups, mu, sd, w = folds.groups, folds.mu, folds.sd, folds.weights

    def add_up(batches):
        total = np.zeros((len(groups), 1 + k + k * k))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                y = b.column(label).to_numpy(zero_copy_only=False).astype(float)
                x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in features], 1).astype(float)
                own = b.column("group_id").to_numpy(zero_copy_only=False)[:, None] != groups[None, :]
                for i in range(len(groups)):
                    z = np.concatenate([np.ones((len(y), 1)), (x - mu[i]) / sd[i]], 1)[own[:, i]]
                    t = z @ w[i]
                    p = 1 / (1 + np.exp(-t))
                    yi = y[own[:, i]]
                    total[i, 0] += (np.logaddexp(0, t) - yi * t).sum()
                    total[i, 1:1 + k] += z.T @ (p - yi)
                    total[i, 1 + k:] += ((z * (p * (1 - p))[:, None]).T @ z).ravel()
        index = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total.ravel())], ["i", "v"])

    got = df.select(*names).mapInArrow(add_up, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()      # a block's numbers
    out = np.zeros(len(groups) * (1 + k + k * k))
    out[got["i"].to_numpy(np.int64)] = got["v"].to_numpy()
    return out.reshape(len(groups), -1)


def leave_one_out(df: DataFrame, features: list[str], label: str, stats: DataFrame, l2: float = 1.0) -> Folds:
    """Models with the least log-loss + (l2 / 2) |w|², intercept free, of df(group_id, label 0 or 1, features).

    stats has a row for each group: group_id, n_train, mu_<feature>, sd_<feature> over all other groups. Steps that do not lower the loss are halved.
    A model whose training rows have one class only keeps an intercept of FARTHEST in its favour; one without rows is 0.
    """
    rows = stats.orderBy("group_id").limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"leave-one-group-out takes at most {MOST_GROUPS} groups")
    k = len(features) + 1
    pick = lambda c: np.array([[r[f"{c}_{f}"] if r[f"{c}_{f}"] is not None else float(c == "sd") for f in features] for r in rows], float).reshape(len(rows), k - 1)
    folds = Folds(np.array([r.group_id for r in rows], np.int64), np.array([r.n_train or 0 for r in rows], np.int64), pick("mu"), pick("sd"), np.zeros((len(rows), k)))
    if not rows:
        return folds
    ridge = np.diag([0.0] + [l2] * (k - 1))
    penalty = lambda w: l2 / 2 * (w[:, 1:] ** 2).sum(1)
    best, loss, step, blocks = folds.weights.copy(), np.full(len(rows), np.inf), np.zeros_like(folds.weights), None
    for _ in range(STEPS):
        s = _sums(df, features, label, folds)
        now = s[:, 0] + penalty(folds.weights)
        better = now <= loss + 1e-12 * np.abs(now)
        blocks = s if blocks is None else np.where(better[:, None], s, blocks)
        best[better], loss = folds.weights[better], np.where(better, now, loss)
        for i in range(len(rows)):
            if better[i]:
                g = blocks[i, 1:1 + k] + ridge @ best[i]
                h = blocks[i, 1 + k:].reshape(k, k) + ridge
                step[i] = -np.linalg.solve(h + 1e-12 * np.eye(k), g) if folds.n_train[i] else 0
            else:
                step[i] /= 2
        folds.weights = best + step
        folds.weights[:, 0] = np.clip(folds.weights[:, 0], -FARTHEST, FARTHEST)
        if np.abs(folds.weights - best).max() < TOLERANCE:
            break
    folds.weights = best
    return folds


def probability(features: list[str], mu: Column, sd: Column, weights: Column) -> Column:
    """A model's probability of 1, in column arithmetic; mu, sd and weights are arrays."""
    z = F.get(weights, F.lit(0))
    for i, f in enumerate(features):
        z = z + F.get(weights, F.lit(i + 1)) * ((F.col(f) - F.get(mu, F.lit(i))) / F.get(sd, F.lit(i)))
    return 1 / (1 + F.exp(-z))


def held_out(df: DataFrame, features: list[str], folds: Folds) -> DataFrame:
    """df with p, each row by the model that never saw its group."""
    models = F.broadcast(folds.table(df).select("group_id", "mu", "sd", "weights"))      # MOST_GROUPS rows at most
    return df.join(models, "group_id").withColumn("p", probability(features, F.col("mu"), F.col("sd"), F.col("weights"))).drop("mu", "sd", "weights")


def training(df: DataFrame, features: list[str], folds: Folds, *keep: str) -> DataFrame:
    """keep, fold, p: the rows each model was fit on, by that model."""
    if not len(folds.groups):
        return df.select(*keep, F.col("group_id").alias("fold"), F.lit(0.5).alias("p")).where("false")
    models = F.array(*[F.struct(F.lit(g).cast("long").alias("fold"), *[F.array(*map(F.lit, v)).alias(n) for n, v in zip(("mu", "sd", "weights"), vs)])
                       for g, _, *vs in folds.rows()])
    each = df.select("group_id", *keep, *features, F.explode(models).alias("m")).where("m.fold <> group_id")
    return each.select(*keep, "m.fold", probability(features, F.col("m.mu"), F.col("m.sd"), F.col("m.weights")).alias("p"))
