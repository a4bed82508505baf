"""Least squares from product sums: one pass over the rows, then K x K numbers on the driver."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _products(centre):
    def run(frames):
        k = len(centre) + 1
        total = np.zeros((k, k))
        for frame in frames:
            x = np.c_[np.ones(len(frame)), frame.to_numpy(np.float64) - centre]
            total += x.T @ x
        if total[0, 0]:
            yield pd.DataFrame({"i": range(k), "sums": list(total)})

    return run


def added(frame, products):
    """Rows (i, sums) of `products`, a function over the frames of a task, added up to one row per i.

    Splits are read by at most `bookflow.sumTasks` tasks (by default 256, or four per core if that is more), so what is shuffled
    depends on the columns and on that number, not on the number of splits. Vectors of one i are added whole, as they come.
    """
    spark = frame.sparkSession
    tasks = int(spark.conf.get("bookflow.sumTasks", str(max(256, 4 * spark.sparkContext.defaultParallelism))))
    parts = frame.coalesce(tasks).mapInPandas(products, "i int, sums array<double>")
    return parts.repartition("i").mapInPandas(_sum_vectors, parts.schema)


def column_means(frame):
    """Mean of the known values of each column, 0 where there is none, as an array."""
    k = len(frame.columns)

    def run(frames):
        total = np.zeros((2, k))
        for part in frames:
            x = part.to_numpy(np.float64)
            known = ~np.isnan(x)
            total += [known.sum(axis=0), np.where(known, x, 0.0).sum(axis=0)]
        yield pd.DataFrame({"i": [0], "sums": [total.ravel()]})

    row = added(frame, run).first()
    n, total = np.array(row.sums if row else np.zeros(2 * k)).reshape(2, k)
    return total / np.maximum(n, 1.0)


def _sum_vectors(frames):
    total = {}
    for frame in frames:
        for i, v in zip(frame["i"], frame["sums"]):
            if i in total:
                total[i] += v
            else:
                total[i] = np.array(v, np.float64)
    if total:
        yield pd.DataFrame({"i": list(total), "sums": list(total.values())})


def moments(df, names):
    """(rows, means, covariances over n) of columns without missing values; one row per column is collected."""
    x = df.select(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    means = column_means(x)
    total = np.zeros((len(names) + 1, len(names) + 1))
    for r in added(x, _products(means)).collect():  # columns x columns numbers
        total[r.i] = r.sums
    n = total[0, 0]
    shift = total[0, 1:] / max(n, 1.0)
    return int(n), means + shift, total[1:, 1:] / max(n, 1.0) - np.outer(shift, shift)


def ridge_fit(df, names, label, alpha):
    """(intercept, coefficients) of squared error plus `alpha` times the squared coefficients of standardised columns."""
    n, mean, cov = moments(df, [*names, label])
    k = len(names)
    scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0.0))
    scale[scale == 0] = 1.0  # a constant column is 0 once centred
    z = cov[:k, :k] / np.outer(scale, scale)
    system = n * z + alpha * np.eye(k)
    w = np.linalg.lstsq(system, n * cov[:k, k] / scale, rcond=None)[0] / scale
    return float(mean[k] - w @ mean[:k]), w


def predicted(names, fit):
    intercept, w = fit
    return sum((F.col(n) * float(x) for n, x in zip(names, w)), F.lit(intercept))
