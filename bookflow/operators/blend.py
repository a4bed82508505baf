"""Blending of prediction vectors from product sums.

The Gram matrix of K vectors (with the target as one of them) is one aggregation over the rows;
weights, grids and solves then work on K x K numbers, never on rows.
"""

import itertools

import numpy as np
from pyspark.sql import functions as F

from ..schema import MONTH
from .linear import predicted, ridge_fit
from .preprocess import _with_row, centred, equal_blocks
from .quantile import exact_quantiles

c = F.col


def gram(df, names, keys=()):
    """Product sums of every pair of columns, `g_<i>_<j>` for i <= j, per group."""
    pairs = itertools.combinations_with_replacement(range(len(names)), 2)
    x = [c(n).cast("double") for n in names]
    return df.groupBy(*keys).agg(*[F.sum(x[i] * x[j]).alias(f"g_{i}_{j}") for i, j in pairs])


def gram_matrix(df, names):
    """The same as a K x K array on the driver; K is the number of columns."""
    row = gram(df, names).head()
    k = len(names)
    out = np.empty((k, k))
    for i, j in itertools.combinations_with_replacement(range(k), 2):
        out[i, j] = out[j, i] = row[f"g_{i}_{j}"]
    return out


def gram_pairs(df, names):
    """Gram entries as rows (a, b, dot, cosine)."""
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    at = lambda i, j: c(f"g_{min(i, j)}_{max(i, j)}")
    rows = F.array(
        *[
            F.struct(
                F.lit(names[i]).alias("a"),
                F.lit(names[j]).alias("b"),
                at(i, j).alias("dot"),
                F.coalesce(F.try_divide(at(i, j), F.sqrt(at(i, i) * at(j, j))), F.lit(0.0)).alias("cosine"),
            )
            for i, j in pairs
        ]
    )
    return gram(df, names).select(F.explode(rows).alias("_r")).select("_r.*")


def transfer_geometry(valid, test, names):
    """Pairwise cosines of the vectors on two sets of rows and their change."""
    a = gram_pairs(valid, names).select("a", "b", c("cosine").alias("valid"))
    b = gram_pairs(test, names).select("a", "b", c("cosine").alias("test"))
    return a.join(b, ["a", "b"]).withColumn("change", c("test") - c("valid"))


def nonnegative_ridge(matrix, target_products, ridge=0.0, rounds=10_000):
    """Weights >= 0 minimising |Xw - y|^2 + ridge * mean diagonal * |w|^2, scaled to sum 1.

    Coordinate descent on the normal equations; K x K input.
    """
    g = np.array(matrix, float)
    g = g + ridge * np.trace(g) / len(g) * np.eye(len(g))
    b = np.asarray(target_products, float)
    w = np.zeros(len(b))
    for _ in range(rounds):
        old = w.copy()
        for i in range(len(b)):
            w[i] = max(0.0, w[i] + (b[i] - g[i] @ w) / g[i, i]) if g[i, i] > 0 else 0.0
        if np.abs(w - old).max() <= 1e-14 * max(1.0, np.abs(w).max()):
            break
    if not w.sum() > 0:
        raise ValueError("all weights are zero")
    return w / w.sum()


def stack_weights(df, names, target="target", ridge=0.0):
    """Non-negative ridge weights of the prediction columns: rows (name, weight)."""
    m = gram_matrix(df, [*names, target])
    k = len(names)
    w = nonnegative_ridge(m[:k, :k], m[:k, k], ridge)
    return df.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(names, w)], "name string, weight double")


def weight_grid(spark, names, units):
    """All weight vectors on the simplex with step 1/units, built by Spark, one column per name."""
    out = spark.range(units + 1).select(c("id").alias("u0"))
    for i in range(1, len(names) - 1):
        used = sum((c(f"u{j}") for j in range(i)), F.lit(0))
        out = out.withColumn(f"u{i}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(units) - used)))
    last = len(names) - 1
    rest = F.lit(units) - sum((c(f"u{j}") for j in range(last)), F.lit(0))
    out = out.withColumn(f"u{last}", rest)
    return out.select(*[(c(f"u{i}") / float(units)).alias(f"w_{n}") for i, n in enumerate(names)])


def _blend_cosine(names, w):
    """Cosine of a weighted sum with the target (last Gram index); w maps a name to its weight."""
    k = len(names)
    at = lambda i, j: c(f"g_{min(i, j)}_{max(i, j)}")
    py = sum((w(names[i]) * at(i, k) for i in range(k)), F.lit(0.0))
    pp = sum((w(names[i]) * w(names[j]) * at(i, j) for i in range(k) for j in range(k)), F.lit(0.0))
    return py / F.sqrt(F.greatest(pp * at(k, k), F.lit(1e-30)))


def blend_scores(df, names, weights, keys=("window",), target="target"):
    """Score of every weight vector in every window: rows (window, w_..., score).

    The Gram table has one row per window and is broadcast against the weights table.
    """
    g = gram(df, [*names, target], keys)
    t = weights.crossJoin(F.broadcast(g))
    return t.select(*keys, *[c(f"w_{n}") for n in names], _blend_cosine(names, lambda n: c(f"w_{n}")).alias("score"))


def best_weights(scores, names, window):
    """Best weight vector of one window, by score and then by weights."""
    rows = scores.filter(c("window") == window)
    return rows.orderBy(F.desc("score"), *[F.desc(f"w_{n}") for n in names]).limit(1)


def guarded_grid(df, names, weights, baseline, months, slack=0.0, target="target"):
    """Weights that lose nothing against a baseline in any of the months: overall score and the
    smallest monthly change; baseline: {name: weight}."""
    base = lambda n: F.lit(float(baseline[n]))
    w = lambda n: c(f"w_{n}")
    monthly = gram(df.filter(c(MONTH).isin(list(months))), [*names, target], (MONTH,))
    change = _blend_cosine(names, w) - _blend_cosine(names, base)
    t = weights.crossJoin(F.broadcast(monthly)).groupBy(*[f"w_{n}" for n in names]).agg(F.min(change).alias("min_change"))
    whole = gram(df, [*names, target])
    t = t.filter(c("min_change") >= -slack).crossJoin(F.broadcast(whole))
    return t.select(*[f"w_{n}" for n in names], "min_change", _blend_cosine(names, w).alias("score"))


def line_search(df, names, start, end, points=101, target="target"):
    """Scores on the straight line between two weight vectors."""
    t = df.sparkSession.range(points).select((c("id") / float(points - 1)).alias("share"))
    w = lambda n: F.lit(float(start[n])) * (1 - c("share")) + F.lit(float(end[n])) * c("share")
    t = t.crossJoin(F.broadcast(gram(df, [*names, target])))  # one row
    return t.select("share", _blend_cosine(names, w).alias("score"))


# per-row member combination ----------------------------------------------------------------------


def member_aggregates(df, names):
    """Mean, median, two trimmed means and a 75/25 mix of the member columns of a row."""
    s = F.array_sort(F.array(*[c(n).cast("double") for n in names]))
    k = len(names)
    mean_of = lambda lo, n: F.aggregate(F.slice(s, lo, n), F.lit(0.0), lambda a, x: a + x) / float(n)
    mean = mean_of(1, k)
    median = mean_of((k + 1) // 2, 2 - k % 2)
    return df.withColumns(
        {
            "mean": mean,
            "median": median,
            "trimmed_1": mean_of(2, k - 2),
            "trimmed_2": mean_of(3, k - 4) if k > 4 else F.lit(None).cast("double"),
            "mean_median": 0.75 * mean + 0.25 * median,
        }
    )


def disagreement_shrink(mean, lam=1.0, q=0.25):
    """Shrink a mean prediction where models disagree; mean has `pred` and `sd`.

    soft: 1 / (1 + lam * sd / mean sd); hard: halved above the 1-q quantile of sd.
    """
    stats = mean.agg(F.avg("sd").alias("_avg")).crossJoin(exact_quantiles(mean, c("sd"), {"_cut": 1 - q}))
    return _with_row(mean, stats).withColumns(
        {
            "soft": c("pred") / (1.0 + lam * c("sd") / (c("_avg") + 1e-12)),
            "hard": c("pred") * F.when(c("sd") > c("_cut"), 0.5).otherwise(1.0),
        }
    ).drop("_avg", "_cut")


# regimes -----------------------------------------------------------------------------------------


def regimes(df, volatility, fit):
    """Tertile of a volatility column by thresholds of the fitting rows (missing takes the median)."""
    s = exact_quantiles(fit, c(volatility), {"_t1": 1 / 3, "_t2": 2 / 3, "_med": 0.5})
    v = F.coalesce(c(volatility), c("_med"))
    code = F.when(v < c("_t1"), 0).when(v < c("_t2"), 1).otherwise(2)
    return _with_row(df, s).withColumn("regime", code).drop("_t1", "_t2", "_med")


def regime_scores(df, names, recipes, target="target"):
    """Score of every fixed recipe in every regime; recipes: {recipe: {name: weight}}."""
    rows = [(r, *[float(w.get(n, 0.0)) for n in names]) for r, w in recipes.items()]
    schema = "recipe string, " + ", ".join(f"w_{n} double" for n in names)
    t = df.sparkSession.createDataFrame(rows, schema)
    t = t.crossJoin(F.broadcast(gram(df, [*names, target], ("regime",))))
    return t.select("regime", "recipe", *[f"w_{n}" for n in names], _blend_cosine(names, lambda n: c(f"w_{n}")).alias("score"))


def regime_blend(df, names, recipes, fit_filter, target="target"):
    """Each row blended by the recipe that scores best in its regime on the fitting rows."""
    scores = regime_scores(df.filter(fit_filter), names, recipes, target)
    best = scores.groupBy("regime").agg(
        F.max_by(F.struct("recipe", *[f"w_{n}" for n in names]), F.struct("score", "recipe")).alias("best")
    )
    out = df.join(F.broadcast(best), "regime", "left")  # three rows
    blend = sum((c(f"best.w_{n}") * c(n) for n in names), F.lit(0.0))
    return out.withColumns({"recipe": c("best.recipe"), "blend": blend}).drop("best")


def high_volatility_expert(df, volatility, fit, base, expert):
    """Base prediction, replaced by the expert above the 75 % train quantile of volatility."""
    cut = exact_quantiles(fit, c(volatility), {"_q75": 0.75})
    return _with_row(df, cut).withColumn("gated", F.when(c(volatility) > c("_q75"), c(expert)).otherwise(c(base))).drop("_q75")


def soft_gate(df, names, volatility, anchors, weights):
    """Weights interpolated linearly between volatility anchors, flat outside them.

    anchors: rising values; weights: one {name: weight} per anchor.
    """
    v = c(volatility)

    def at(n):
        w = [float(x[n]) for x in weights]
        out = F.when(v <= anchors[0], w[0])
        for (a, b), (x, y) in zip(zip(anchors, anchors[1:]), zip(w, w[1:])):
            out = out.when(v <= b, x + (y - x) * (v - a) / (b - a))
        return out.otherwise(w[-1])

    return df.withColumn("gated", sum((at(n) * c(n) for n in names), F.lit(0.0)))


def gate_anchors(df, volatility):
    """Median volatility of each regime, ascending."""
    q = exact_quantiles(df, c(volatility), {"anchor": 0.5}, ("regime",))
    return [r.anchor for r in q.orderBy("regime").collect()]  # three rows


# month level -------------------------------------------------------------------------------------


def month_table(df, features, target="target"):
    """Mean and deviation of every feature and the mean target, per month."""
    return df.groupBy(MONTH).agg(
        F.avg(target).alias("mean_target"),
        *[F.avg(n).alias(f"{n}_mean") for n in features],
        *[F.stddev_pop(n).alias(f"{n}_std") for n in features],
    )


def common_component(df, features, pred, train_end, alpha=100.0, target="target"):
    """Replace the month mean of a prediction by one regressed on month summaries.

    The regression sees one row per month up to `train_end`; `alpha` is the ridge penalty
    on standardised summaries; a summary missing in a month is the median of the training months.
    """
    t = month_table(df, features, target)
    inputs = [n for n in t.columns if n not in (MONTH, "mean_target")]
    # a summary no month has, or only months after training have, is 0
    medians = t.filter(c(MONTH) <= train_end).agg(*[F.median(n).alias(n) for n in inputs]).first()  # one number per summary
    t = t.na.fill({n: 0.0 if medians[n] is None else float(medians[n]) for n in inputs})
    train = t.filter(c(MONTH) <= train_end)
    common = t.select(MONTH, predicted(inputs, ridge_fit(train, inputs, "mean_target", alpha)).alias("common"))
    out = centred(df, pred, (MONTH,)).join(F.broadcast(common), MONTH, "left")  # one row per month
    return out.withColumn("adjusted", c("centred") + c("common")).drop("centred", "common")


def centring_variants(df, pred, blocks=6):
    """Prediction centred over everything, per month and per equal sequential block of ids."""
    out = centred(df, pred).withColumnRenamed("centred", "global_centred")
    out = centred(out, pred, (MONTH,)).withColumnRenamed("centred", "month_centred")
    out = centred(equal_blocks(out, blocks), pred, ("block",)).withColumnRenamed("centred", "block_centred")
    return out


# scores of other vectors from geometry -----------------------------------------------------------


def geometry_fit(matrix, scores, ridges=None):
    """Ridge on the Gram matrix of scored vectors, the penalty with the least leave-one-out error.

    One factorisation serves all penalties: leaving a vector out changes its score by its coefficient over the diagonal
    of the inverse. Returns (penalty, coefficients, mean absolute error); K x K input.
    """
    values, vectors = np.linalg.eigh(np.clip(np.asarray(matrix, float), -1.0, 1.0))
    ridges = np.logspace(-7, 0, 29) if ridges is None else np.asarray(ridges, float)
    inverse = 1.0 / (values[:, None] + ridges)  # vectors x penalties
    coefficients = vectors @ ((vectors.T @ np.asarray(scores, float))[:, None] * inverse)
    left_out = np.abs(coefficients / (vectors**2 @ inverse))
    mae, rmse = left_out.mean(0), np.sqrt((left_out**2).mean(0))
    at = np.lexsort((ridges, rmse, mae))[0]
    return float(ridges[at]), coefficients[:, at], float(mae[at])


def estimate_scores(df, scored, candidates, scores):
    """Estimated score of each candidate column from its cosines with the scored columns."""
    names = [*scored, *candidates]
    m = gram_matrix(df, names)
    d = np.sqrt(np.diag(m))
    g = m / np.outer(d, d)
    k = len(scored)
    ridge, coef, error = geometry_fit(g[:k, :k], [scores[n] for n in scored])
    rows = [(n, float(g[k + i, :k] @ coef), ridge, error) for i, n in enumerate(candidates)]
    return df.sparkSession.createDataFrame(rows, "name string, estimate double, ridge double, loo_error double")


def rounding_noise(spark, coefficients, draws=20_000, width=0.0005, seed=17):
    """Distribution of a score difference when the scores behind it carry uniform noise.

    coefficients: weight of each score in the difference (K numbers); noise is hashed from
    (draw, score), so it repeats anywhere.
    """
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(coefficients)], "i int, w double")
    d = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(rows))
    h = ((c("draw") * 7919 + c("i") * 104729 + seed) * 1103515245 + 12345).bitwiseAND(0x7FFFFFFF)
    u = F.floor(h / 256) / float(2**23) * 2.0 - 1.0
    delta = d.groupBy("draw").agg(F.sum(c("w") * u * width).alias("noise"))
    q = exact_quantiles(delta, c("noise"), {"q01": 0.01, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99})
    return q.crossJoin(delta.agg(F.avg((c("noise") > 0).cast("double")).alias("positive_share")))
