"""Linear classifiers from aggregated moments, for many fits at once.

Ridge and the discriminant follow from the count, mean and covariance of every class in every fold: one
aggregation, from which a fit without a fold or without some features takes its part. Logistic regression
takes Newton steps; a step is one aggregation of gradient and curvature for all fits. Shuffled and
collected are d x d numbers per fold, class or fit, whatever the number of rows; the driver solves d x d.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.operators.columns import quoted
from scarpline.operators.fitting import Job, Rows


def class_moments(df: DataFrame, features: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """(label, n, m_i, c_i_j): count, means and population covariances of each class."""
    means = [F.avg(quoted(f)).alias(f"m_{i}") for i, f in enumerate(features)]
    pairs = [
        F.covar_pop(quoted(features[i]), quoted(features[j])).alias(f"c_{i}_{j}")
        for i in range(len(features)) for j in range(i, len(features))
    ]
    return df.groupBy(*(by or []), quoted(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), *means, *pairs
    )


def gramian(df: DataFrame, features: list[str], label: str, positive: float = 1.0) -> DataFrame:
    """(i, j, value): the normal-equation sums of features, a constant (1) and the signed target.

    The long form lists ``x_i * x_j`` sums once per pair; ``1`` and ``y`` are names like features.
    """
    signed = F.when(quoted(label) == positive, 1.0).otherwise(-1.0)
    terms = [("1", F.lit(1.0)), *[(f, quoted(f).cast("double")) for f in features], ("y", signed)]
    pairs = [(a, b) for k, a in enumerate(terms) for b in terms[k:]]
    wide = df.agg(*[F.sum(a[1] * b[1]).alias(f"s{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[
        F.struct(F.lit(a[0]).alias("i"), F.lit(b[0]).alias("j"), F.col(f"s{k}").alias("value"))
        for k, (a, b) in enumerate(pairs)
    ])
    return wide.select(F.inline(cells))


Moments = tuple[int, np.ndarray, np.ndarray]


def merged(parts: list[Moments]) -> Moments:
    """Count, mean and population covariance of several sets of rows together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    cov = sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n
    return n, mean, cov


class FoldMoments:
    """Moments of every class in every fold, collected once."""

    def __init__(self, df: DataFrame, features: list[str], label: str, fold: str | None = None) -> None:
        d = len(features)
        self.features, self.parts = features, {}
        rows = class_moments(df.where(quoted(label).isNotNull()), features, label, [fold] if fold else None).collect()
        for row in rows:
            mean = np.array([row[f"m_{i}"] for i in range(d)], dtype=float)
            cov = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    cov[i, j] = cov[j, i] = row[f"c_{i}_{j}"]
            self.parts[row[fold] if fold else None, float(row["label"])] = (row["n"], mean, cov)

    def classes(self, job: Job) -> tuple[Moments, Moments]:
        """Moments of label 0 and 1 over the rows and features of one fit."""
        labels = sorted({label for _, label in self.parts})
        if labels != [0.0, 1.0]:
            if len(labels) == 2:
                raise ValueError("labels must be 0 and 1, see models.binary_labels")
            raise ValueError(f"a binary target is needed, found {len(labels)} classes")
        at = [self.features.index(f) for f in job.features]
        out = []
        for label in labels:
            seen = [p for (fold, y), p in self.parts.items() if y == label and (
                job.held_out is None or fold != job.held_out)]
            if not seen:
                raise ValueError("a binary target is needed, found one class")
            n, mean, cov = merged(seen)
            out.append((n, mean[at], cov[np.ix_(at, at)]))
        return out[0], out[1]


def ridge_weights(classes: tuple[Moments, Moments], alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of ridge regression on a -1/+1 target.

    Total scatter and target products follow from the class moments, which are centred and so
    do not lose digits to large means.
    """
    (n0, m0, c0), (n1, m1, c1) = classes
    n, gap = n0 + n1, m1 - m0
    scatter = n0 * c0 + n1 * c1 + (n0 * n1 / n) * np.outer(gap, gap)
    target = 2.0 * (n0 * n1 / n) * gap
    weights = np.linalg.solve(scatter + alpha * np.eye(len(gap)), target)
    center = (n0 * m0 + n1 * m1) / n
    return weights, (n1 - n0) / n - float(weights @ center)


def discriminant_weights(classes: tuple[Moments, Moments]) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear discriminant with a pooled covariance."""
    (n0, m0, c0), (n1, m1, c1) = classes
    pooled = (n0 * c0 + n1 * c1) / max(n0 + n1 - 2, 1)
    weights = np.linalg.pinv(pooled) @ (m1 - m0)
    return weights, -0.5 * float(weights @ (m0 + m1)) + float(np.log(n1 / n0))


def fit_ridge(df: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    return ridge_weights(FoldMoments(df, features, label).classes(Job(tuple(features))), alpha)


def fit_discriminant(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, float]:
    return discriminant_weights(FoldMoments(df, features, label).classes(Job(tuple(features))))


def _curvature(table: DataFrame, weights: dict[int, np.ndarray], jobs: list[Job], at: list[list[int]],
               center: np.ndarray, scale: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Summed log loss, gradient and curvature of the named fits at their weights: one aggregation."""
    d = len(center)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = Rows.of(batch, d)
            z = (rows.x - center) / scale
            for k, w in weights.items():
                mine = rows.seen_by(jobs[k])
                design = np.column_stack([z[mine][:, at[k]], np.ones(int(mine.sum()))])
                y, margin = rows.label[mine], design @ w
                p = 1.0 / (1.0 + np.exp(-margin))
                loss = np.logaddexp(0.0, margin).sum() - (y * margin).sum()
                sums = np.concatenate([
                    [loss], design.T @ (p - y), (design.T @ (design * (p * (1 - p))[:, None])).ravel()])
                totals[k] = totals.get(k, 0.0) + sums
        for k, sums in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), k, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)),
                 pa.array(sums)], ["job", "cell", "value"])

    found = table.mapInArrow(partial, "job int, cell int, value double").groupBy("job", "cell").agg(
        F.sum("value").alias("value")).toArrow()
    job, cell, value = (found.column(c).to_numpy() for c in ("job", "cell", "value"))
    out = {}
    for k, w in weights.items():
        m = len(w)
        sums = np.zeros(1 + m + m * m)
        sums[cell[job == k]] = value[job == k]
        out[k] = float(sums[0]), sums[1:1 + m], sums[1 + m:].reshape(m, m)
    return out


def newton_logistic(
    table: DataFrame, features: list[str], jobs: list[Job], c: float = 1.0, max_iter: int = 1000,
    tolerance: float = 1e-9,
) -> list[tuple[np.ndarray, float]]:
    """Weights and intercept of L2-penalised logistic regression of every job, over a ``training_table``.

    The penalty is ``1 / (2 c)`` times the squared weights against the summed loss; the intercept is free.
    Steps are taken in standardised features, and halved where the loss would rise.
    """
    d = len(features)
    stats = table.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (
        ("m", F.avg), ("s", F.stddev_pop))]).first()
    sizes = {(r["fold"], r["label"]): r["count"] for r in table.groupBy("fold", "label").count().collect()}
    for job in jobs:
        if len({y for (fold, y) in sizes if job.held_out is None or fold != job.held_out}) != 2:
            raise ValueError("a binary target is needed, found one class")
    center = np.array([stats[f"m{i}"] for i in range(d)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(d)])
    at = [[features.index(f) for f in job.features] for job in jobs]
    penalty = [np.append(1.0 / (c * scale[a] ** 2), 0.0) for a in at]
    weights = [np.zeros(len(a) + 1) for a in at]
    step: list[np.ndarray | None] = [None] * len(jobs)
    best = [np.inf] * len(jobs)
    active = set(range(len(jobs)))
    for _ in range(max_iter):
        found = _curvature(table, {k: weights[k] for k in sorted(active)}, jobs, at, center, scale)
        for k, (loss, slope, curve) in found.items():
            loss += 0.5 * float(penalty[k] @ weights[k] ** 2)
            if loss > best[k] + 1e-9 * abs(best[k]):
                step[k] = step[k] / 2
                weights[k] = weights[k] - step[k]
                continue
            best[k] = loss
            step[k] = -np.linalg.lstsq(curve + np.diag(penalty[k]), slope + penalty[k] * weights[k], rcond=None)[0]
            weights[k] = weights[k] + step[k]
            if np.abs(step[k]).max() < tolerance:
                active.discard(k)
        if not active:
            break
    out = []
    for k, a in enumerate(at):
        plain = weights[k][:-1] / scale[a]
        out.append((plain, float(weights[k][-1] - plain @ center[a])))
    return out
