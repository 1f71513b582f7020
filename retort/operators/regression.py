"""Detrending by least squares and kernel ridge regression."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.kernels import kernel_array
from retort.operators import molecules
from retort.operators.pairs import distances, length_scale
from retort.plans.lineage import cut


def _products(features: list[str], label: Column) -> list[Column]:
    return [F.sum(F.col(f).cast("double") * label) for f in features]


def normal_equations(rows: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray]:
    """A'A and A'y in one pass; k * (k + 3) / 2 sums reach the driver."""
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.where(F.col(label).isNotNull()).agg(*(F.sum(F.col(features[i]).cast("double") * F.col(features[j])).alias(f"a{i}_{j}") for i, j in pairs), *(c.alias(f"b{i}") for i, c in enumerate(_products(features, F.col(label))))).first()
    a = np.zeros((k, k))
    for i, j in pairs:
        a[i, j] = a[j, i] = sums[f"a{i}_{j}"] or 0.0
    return a, np.array([sums[f"b{i}"] or 0.0 for i in range(k)])


def least_norm(a: np.ndarray):
    """Solves A'A w = b for the w of smallest norm, as a function of b.

    Columns are scaled to length 1 before their rank is judged, as one of large numbers beside a constant isn't dependent.
    """
    size = np.sqrt(np.diag(a))
    size[size == 0] = 1.0
    values, vectors = np.linalg.eigh(a / np.outer(size, size))
    kept = values > 1e-12 * max(values[-1], 0.0) if len(values) else np.zeros(0, bool)
    free = vectors[:, ~kept] / size[:, None]

    def solve(b: np.ndarray) -> np.ndarray:
        w = vectors[:, kept] @ ((vectors[:, kept].T @ (b / size)) / values[kept]) / size
        return w - free @ np.linalg.lstsq(free, w, rcond=None)[0] if free.size else w

    return solve


def detrend(rows: DataFrame, features: list[str], label: str, train: str | None = None) -> DataFrame:
    """Adds ``trend`` and ``residual``: the least-squares fit of smallest norm, on the training rows.

    The minimum norm matters: blocks of one-hot columns depend on each other. A second pass fits what the first one left, as
    sums over many rows round. Rows without label or one of the features don't count.
    """
    fitted = rows.where(train) if train else rows
    fitted = fitted.dropna(subset=[label, *features])
    trend = lambda w: sum((F.col(f).cast("double") * float(c) for f, c in zip(features, w, strict=True)), F.lit(0.0))
    a, b = normal_equations(fitted, features, label)
    solve = least_norm(a)
    w = solve(b)
    left = fitted.agg(*_products(features, F.col(label) - trend(w))).first() if features else []
    w = w + solve(np.array([x or 0.0 for x in left]))
    return rows.withColumn("trend", trend(w)).withColumn("residual", F.col(label) - F.col("trend"))


def null_model(rows: DataFrame, label: str, train: str) -> DataFrame:
    """Error of predicting the mean of the training rows: ``is_train, rmse, mae``."""
    mean = rows.where(train).agg(F.avg(label).alias("_m"))
    gap = F.col(label) - F.col("_m")
    return rows.join(F.broadcast(mean)).groupBy(F.expr(train).alias("is_train")).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def detrend_design(rows: DataFrame, key: str, blocks: list[str], atoms: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The rows with the columns of the active blocks, always in the order atomic, pairs, charge, spin, and their names.

    ``atomic`` counts each element, by atomic number; ``pairs`` is the pairwise feature; ``charge`` and ``spin`` have a column per
    observed state. atoms: the key, ``i``, ``z, x, y, zc``. Elements and states are few, so their list reaches the driver.
    """
    out, names = rows, []
    if unknown := set(blocks) - {"atomic", "pairs", "charge", "spin"}:
        raise ValueError(f"no such block: {sorted(unknown)}")
    if "atomic" in blocks:
        elements = molecules.few_states(atoms, "z")
        counts = molecules.element_matrix(atoms, key, "z", elements).toDF(key, *(f"n_{e:g}" for e in elements))
        out, names = out.join(counts, key, "left").na.fill(0, counts.columns[1:]), names + counts.columns[1:]
    if "pairs" in blocks:
        out = out.join(molecules.pair_feature(atoms, key, "i").withColumnRenamed("feature", "pairs"), key, "left").na.fill(0.0, ["pairs"])
        names.append("pairs")
    for block, column in (("charge", "charge"), ("spin", "spin_multiplicity")):
        if block in blocks:
            out = molecules.one_hot(out, column)
            names += [c for c in out.columns if c.startswith(f"{column}_") and c not in rows.columns]
    return out, names


#: Rows of a training set at most: solving takes one task, and time with the third power of its size.
MOST = 4096
# Fixed values of the published program: length scales by factors of the heuristic one, and regularisers.
FACTORS, LAMBDAS = [2.0**e for e in range(-1, 20)], [10.0**p for p in range(-10, -1)]


def _gathered(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = train.select("id", "v", "y").limit(MOST + 1).toPandas()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} training rows")
    rows = rows.sort_values("id")
    return np.array(rows["v"].tolist(), float).reshape(len(rows), -1), rows["y"].to_numpy(float)


def _centered(k: np.ndarray) -> np.ndarray:
    return k - k.mean(1, keepdims=True) - k.mean(0, keepdims=True) + k.mean()


def _usable(k: np.ndarray) -> bool:
    """Whether a kernel tells molecules apart, and doesn't keep all of them apart."""
    off = k - np.diag(np.diag(k))
    return len(k) > 1 and off.max() >= 1e-4 and k.min() <= 0.999


def _split_errors(k: np.ndarray, y: np.ndarray, lams: list[float], splits: int, share: float, seed: int) -> list[tuple]:
    """Errors (lambda, split, rmse, mae, train_rmse, train_mae) on random splits of a centered kernel; none if it is too ill-conditioned.

    A regulariser that has come to rest gets no more splits: over 5, and the medians of every other one within 5 %. One
    eigendecomposition serves all splits: with M the inverse of K + lambda, that of its training part is
    M_tt - M_tv M_vv^-1 M_vt.
    """
    values, vectors = np.linalg.eigh(k)
    n = int(len(y) * share)
    if len(y) < 3 or n < 1 or values[-1] / values[1] > 1e15:
        return []
    out, seen, order = [], {lam: [] for lam in lams}, np.arange(len(y))
    rng = np.random.default_rng(seed)
    for split in range(splits):
        rng.shuffle(order)
        fit, valid = order[:-n], order[-n:]
        q_fit, q_valid = vectors[fit], vectors[valid]
        for lam in lams:
            past = seen[lam]
            if len(past) > 5 and abs(np.median(past[::2]) - np.median(past[1::2])) < 0.05 * np.median(past):
                continue
            scale = 1 / (values + lam)
            whole = scale * (q_fit.T @ y[fit])
            try:
                inner = np.linalg.solve((q_valid * scale) @ q_valid.T, q_valid @ whole)
            except np.linalg.LinAlgError:
                continue
            alpha = q_fit @ (whole - scale * (q_valid.T @ inner))
            gap, own = k[np.ix_(valid, fit)] @ alpha - y[valid], k[np.ix_(fit, fit)] @ alpha - y[fit]
            past.append(float(np.sqrt((gap**2).mean())))
            out.append((lam, split, past[-1], float(np.abs(gap).mean()), float(np.sqrt((own**2).mean())), float(np.abs(own).mean())))
    return out


def hyperparameters(train: DataFrame, kernel: str, scales: list[float], lams: list[float] | None = None, splits: int = 50, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Cross-validation errors: ``sigma, lam, split, rmse, mae, train_rmse, train_mae``; a task per length scale.

    train: ``id, v, y``, at most MOST rows, sent to every task; labels are used less their mean, kernels centered. Length
    scales whose kernel is nearly constant, diagonal or singular give no rows.
    """
    spark = train.sparkSession
    x, y = _gathered(train)
    shared = spark.sparkContext.broadcast((x, y))
    jobs = spark.createDataFrame([(float(s),) for s in scales], "sigma double").repartition(len(scales), "sigma")
    wanted = lams or LAMBDAS

    def one(batches):
        x, y = shared.value
        for batch in batches:
            for sigma in batch["sigma"]:
                k = kernel_array(kernel, distances(x, x) / sigma) if len(x) else np.zeros((0, 0))
                rows = _split_errors(_centered(k), y - y.mean(), wanted, splits, share, seed) if _usable(k) else []
                yield pd.DataFrame([(sigma, *r) for r in rows], columns=["sigma", "lam", "split", "rmse", "mae", "train_rmse", "train_mae"])

    return jobs.mapInPandas(one, "sigma double, lam double, split int, rmse double, mae double, train_rmse double, train_mae double")


def swept(scales: list[float], tried: list[float], heuristic: float) -> list[float]:
    """The length scales that a sweep reaches: upwards from the heuristic one, downwards below it, each way until one fails."""
    up, down = sorted(s for s in scales if s >= heuristic), sorted((s for s in scales if s < heuristic), reverse=True)
    return [s for way in (up, down) for s in itertools.takewhile(lambda s: s in tried, way)]


def predict(train: DataFrame, rows: DataFrame, kernel: str, sigma: float, lam: float) -> DataFrame:
    """Predictions of ``(id, v)`` by a model fitted to ``(id, v, y)``: ``id, prediction``. A map over the rows.

    The kernel is centered by the training set's means, and labels are shifted by theirs. At most MOST training rows.
    """
    x, y = _gathered(train)
    k = kernel_array(kernel, distances(x, x) / sigma)
    alpha = np.linalg.solve(_centered(k) + lam * np.eye(len(y)), y - y.mean())
    shared = train.sparkSession.sparkContext.broadcast((x, alpha, y.mean(), k.mean(0), k.mean()))

    def one(batches):
        x, alpha, shift, columns, grand = shared.value
        for batch in batches:
            k = kernel_array(kernel, distances(np.array(batch["v"].tolist(), float).reshape(len(batch), -1), x) / sigma)
            yield pd.DataFrame({"id": batch["id"], "prediction": (k - k.mean(1, keepdims=True) - columns + grand) @ alpha + shift})

    return rows.select("id", "v").mapInPandas(one, "id long, prediction double")


def spectrum(train: DataFrame, kernel: str, sigma: float) -> list[float]:
    """Eigenvalues of the centered kernel of a training set, ascending."""
    x, _ = _gathered(train)
    return np.linalg.eigvalsh(_centered(kernel_array(kernel, distances(x, x) / sigma))).tolist()


def errors(predicted: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Root mean square and mean absolute error; rows without a label don't count."""
    gap = F.col("prediction") - F.col(label)
    return predicted.groupBy(*(by or [])).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def learning_curve(train: DataFrame, holdout: DataFrame, kernel: str, sizes: list[int], splits: int = 50, features: list[str] | None = None) -> DataFrame:
    """Per training size the best hyper-parameters and errors: ``ntrain, sigma, lam, val_rmse, val_mae, test_rmse, test_mae``.

    train: ``position`` (from 1), ``id, v, y`` and the detrending ``features``; holdout: the same but the position. A size takes the
    first positions, is detrended by its own fit, swept over length scales around its heuristic one, and judged by the
    median over splits (5 at least). Size 1 is the null model, which predicts the mean of all training rows.
    """
    spark, rows, features = train.sparkSession, [], features or []
    null = {r["is_train"]: r for r in null_model(train.select("y", F.lit(True).alias("t")).unionByName(holdout.select("y", F.lit(False).alias("t"))), "y", "t").collect()}
    rows.append((1, None, None, null[True]["rmse"], null[True]["mae"], null[False]["rmse"], null[False]["mae"]))
    for n in sizes:
        part, held = train.where(F.col("position") <= n), holdout
        if features:
            both = detrend(part.withColumn("_t", F.lit(True)).drop("position").unionByName(held.withColumn("_t", F.lit(False)), allowMissingColumns=True), features, "y", "_t").drop("y").withColumnRenamed("residual", "y")
            part, held = both.where("_t"), both.where("NOT _t")
        part = cut(part.select("id", "v", "y"))
        scale = length_scale(part.select("id", "v")).first()["scale"] or 1.0
        scales = [scale * f for f in FACTORS]
        tried = cut(hyperparameters(part, kernel, scales, splits=splits))
        reached = swept(scales, [r[0] for r in tried.select("sigma").distinct().collect()], scale)
        medians = tried.where(F.col("sigma").isin(reached)).groupBy("sigma", "lam").agg(F.median("rmse").alias("rmse"), F.median("mae").alias("mae"), F.count("*").alias("n")).where("n >= 5")
        best = medians.orderBy("rmse", "sigma", "lam").first()
        if best is None:
            continue
        error = errors(predict(part, held, kernel, best["sigma"], best["lam"]).join(held.select("id", "y"), "id"), "y").first()
        rows.append((n, best["sigma"], best["lam"], best["rmse"], best["mae"], error["rmse"], error["mae"]))
    return spark.createDataFrame(rows, "ntrain int, sigma double, lam double, val_rmse double, val_mae double, test_rmse double, test_mae double")
