"""Train-fitted preprocessing of feature, target and prediction columns.

Statistics are one row, so they are joined by a broadcast cross join of that row. Ranks run over a
value-ordered Timeline: a month, or the whole table, may be any share of the data.
"""

from pyspark.sql import functions as F

from ..functions.expr import clip
from ..schema import KEY, MONTH
from .quantile import even_quantiles, exact_quantiles, quantiles_of, value_ranks
from .timeline import Timeline, lookup

c = F.col


def _with_row(df, stats):
    return df.crossJoin(F.broadcast(stats))


def standardise(df, names, fit_ids, clip_at=10.0, floor=1e-6):
    """(x - mean) / (deviation + floor) with moments of the fitting samples, clipped."""
    fit = df.join(fit_ids, KEY, "left_semi")
    stats = fit.agg(
        *[F.avg(n).alias(f"_m_{n}") for n in names],
        *[F.avg(c(n) * c(n)).alias(f"_q_{n}") for n in names],
    )
    sd = lambda n: F.sqrt(F.greatest(c(f"_q_{n}") - c(f"_m_{n}") * c(f"_m_{n}"), F.lit(0.0))) + floor
    z = {n: clip((c(n) - c(f"_m_{n}")) / sd(n), -clip_at, clip_at) for n in names}
    return _with_row(df, stats).select(*[z[n].alias(n) if n in z else c(n) for n in df.columns])


def robust_scale(df, names, fit):
    """(x - median) / IQR, then x / sqrt(1 + (x / 3)^2).

    A column without spread between its quartiles uses half its range, a constant one gives 0.
    """
    quartiles = {f"_{k}_{n}": (c(n), q) for n in names for k, q in (("lo", 0.25), ("med", 0.5), ("hi", 0.75))}
    stats = _with_row(
        quantiles_of(fit, quartiles),
        fit.agg(*[F.max(n).alias(f"_max_{n}") for n in names], *[F.min(n).alias(f"_min_{n}") for n in names]),
    )

    def scaled(n):
        iqr = c(f"_hi_{n}") - c(f"_lo_{n}")
        spread = F.when(iqr == 0, 0.5 * (c(f"_max_{n}") - c(f"_min_{n}"))).otherwise(iqr)
        s = F.when(spread == 0, 0.0).otherwise((c(n) - c(f"_med_{n}")) / (spread + 1e-30))
        return s / F.sqrt(1 + (s / 3) * (s / 3))

    z = {n: scaled(n) for n in names}
    return _with_row(df, stats).select(*[z[n].alias(n) if n in z else c(n) for n in df.columns])


# Coefficients of Acklam's published rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
      -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
      -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
      4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefficients, x):
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + k
    return out


def normal_quantile(p):
    """Inverse of the standard normal distribution, error below 1.2e-9 of the value."""
    low, high = 0.02425, 1 - 0.02425
    tail = lambda q: _poly(_C, q) / _poly((*_D, 1.0), q)
    r = p - 0.5
    centre = _poly(_A, r * r) * r / _poly((*_B, 1.0), r * r)
    return (
        F.when(p < low, tail(F.sqrt(-2 * F.log(p))))
        .when(p > high, -tail(F.sqrt(-2 * F.log(1 - p))))
        .otherwise(centre)
    )


def normal_scores(df, name, fit, count=1001, bound=1e-6):
    """Column mapped through its train distribution to a normal score, with a missing flag.

    A missing value takes the train median. Ties of knots take the middle of their range.
    """
    out = _with_row(df, even_quantiles(fit, c(name), count, f"_knots_{name}"))
    knots = c(f"_knots_{name}")
    x = F.coalesce(c(name), F.element_at(knots, (count + 1) // 2))
    below = F.size(F.filter(knots, lambda k: k < x))
    upto = F.size(F.filter(knots, lambda k: k <= x))
    lo, hi = F.try_element_at(knots, below), F.try_element_at(knots, below + 1)
    inner = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)
    on_knot = upto > below
    place = F.when(on_knot, (below + upto - 1) / 2.0).when(below == 0, 0.0).when(below == count, float(count - 1))
    p = place.otherwise(below - 1 + inner) / float(count - 1)
    return out.withColumns(
        {f"{name}_score": normal_quantile(clip(p, bound, 1 - bound)), f"{name}_missing": c(name).isNull().cast("int")}
    ).drop(f"_knots_{name}")


# vectors -----------------------------------------------------------------------------------------


def vector_forms(df, pred):
    """The prediction centred, at unit norm, centred at unit norm, and at unit root mean square."""
    s = df.agg(F.avg(pred).alias("_m"), F.sqrt(F.sum(c(pred) * c(pred))).alias("_n"), F.count(F.lit(1)).alias("_k"),
               F.sqrt(F.sum(c(pred) * c(pred)) - F.count(F.lit(1)) * F.avg(pred) * F.avg(pred)).alias("_cn"))
    return _with_row(df, s).withColumns(
        {
            "centred": c(pred) - c("_m"),
            "unit": c(pred) / c("_n"),
            "centred_unit": (c(pred) - c("_m")) / c("_cn"),
            "rms": c(pred) / (c("_n") / F.sqrt("_k")),
        }
    ).drop("_m", "_n", "_k", "_cn")


def average_rank(df, x, keys=(), name="rank"):
    """Rank from 1 where ties share their mean rank, and the number of ranked rows `rows`.

    Ranks are computed on distinct values and looked up, so copies cost one row.
    """
    own = tuple(keys) or ("_all",)
    src = df if keys else df.withColumn("_all", F.lit(0))
    src = src.withColumn("_x", x)
    ranks = value_ranks(src, c("_x"), own).select(
        *own, "_x", (c("upto") - (c("n") - 1) / 2.0).alias(name), c("rows").alias("rows")
    )
    out = lookup(src, ranks, [*own, "_x"], keys=(*own, "_x"), salt_by=(KEY,)).drop("_x")
    return out if keys else out.drop("_all")


def shape_transforms(df, pred):
    """Winsorised at four levels, two signed powers, rank-uniform and rank-normal forms."""
    levels = {"001": 0.001, "005": 0.005, "01": 0.01, "02": 0.02}
    probs = {f"_l{k}": q for k, q in levels.items()} | {f"_h{k}": 1 - q for k, q in levels.items()}
    out = _with_row(df, exact_quantiles(df, c(pred), probs))
    x = c(pred)
    bounded = lambda k: F.least(F.greatest(x, c(f"_l{k}")), c(f"_h{k}"))
    out = out.withColumns({f"winsor_{k}": bounded(k) for k in levels})
    out = out.withColumns(
        {f"power_{n}": F.signum(x) * F.pow(F.abs(x), F.lit(e)) for n, e in (("075", 0.75), ("125", 1.25))}
    ).drop(*probs)
    out = average_rank(out, x, name="_r")
    u = (c("_r") - 0.5) / c("rows")
    return out.withColumns(
        {"rank_uniform": u - 0.5, "rank_normal": normal_quantile(clip(u, 1e-6, 1 - 1e-6))}
    ).drop("_r", "rows")


# cross-section within a group --------------------------------------------------------------------


def _stacked(df, names, *keep):
    """Rows (keep..., number of the column, its value), so that one ranking serves all columns."""
    pairs = F.array(*[F.struct(F.lit(i).alias("_f"), c(n).cast("double").alias("_v")) for i, n in enumerate(names)])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")


def _unstacked(long, columns):
    """{name: (number of the column, value)} -> one row per sample."""
    return long.groupBy(KEY).agg(*[F.max(F.when(c("_f") == i, x)).alias(n) for n, (i, x) in columns.items()])


def group_ranks(df, names, group=(MONTH,)):
    """Average-tie rank share, signed rank 2r/(n+1)-1 and clipped z-score of each column per group.

    Missing values get 0.
    """
    long = average_rank(_stacked(df, names, KEY, *group), c("_v"), (*group, "_f"), name="_r")
    ranks = _unstacked(long, {f"_r{i}": (i, c("_r")) for i in range(len(names))} | {f"_k{i}": (i, c("rows")) for i in range(len(names))})
    out = df.join(ranks, KEY, "left")
    for i, n in enumerate(names):
        signed = F.coalesce(2.0 * c(f"_r{i}") / (c(f"_k{i}") + 1.0) - 1.0, F.lit(0.0))
        out = out.withColumns({f"{n}_pct": c(f"_r{i}") / c(f"_k{i}"), f"{n}_rank": signed}).drop(f"_r{i}", f"_k{i}")
    stats = df.groupBy(*group).agg(
        *[F.avg(n).alias(f"_m_{n}") for n in names], *[F.stddev_pop(n).alias(f"_s_{n}") for n in names]
    )
    out = lookup(out, stats, list(group), keys=group, salt_by=(KEY,))
    z = {
        f"{n}_z": F.coalesce(clip((c(n) - c(f"_m_{n}")) / F.greatest(c(f"_s_{n}"), F.lit(1e-8)), -10, 10), F.lit(0.0))
        for n in names
    }
    return out.withColumns(z).drop(*[f"_{k}_{n}" for n in names for k in "ms"])


def ordinal_ranks(df, names, group=(MONTH,)):
    """Centred ordinal rank r / (n - 1) - 0.5 per group (ties by sample id), as `<name>_pct`."""
    keys = (*group, "_f")
    line = Timeline.of(_stacked(df, names, KEY, *group), keys=keys, order=(c("_v"), c(KEY))).position("_r").key_total("_k", F.lit(1))
    rank = (c("_r") - 1) / F.greatest(c("_k") - 1, F.lit(1)) - 0.5
    return df.join(_unstacked(line.finished(), {f"{n}_pct": (i, rank) for i, n in enumerate(names)}), KEY, "left")


def row_ranks(df, names):
    """Rank of each column among the columns of its row, k / (m - 1) - 0.5; ties by position."""
    order = F.array_sort(F.array(*[F.struct(c(n).cast("double").alias("v"), F.lit(i).alias("i")) for i, n in enumerate(names)]))
    place = F.transform(order, lambda s: s["i"])
    top = float(len(names) - 1)
    return df.withColumn("_place", place).withColumns(
        {f"{n}_row": (F.array_position("_place", F.lit(i)) - 1) / top - 0.5 for i, n in enumerate(names)}
    ).drop("_place")


def cross_section(df, names, z_names, group=(MONTH,)):
    """Group ranks of `names`, group z-scores of `z_names`, row-wise ranks of `names`."""
    out = ordinal_ranks(df, names, group)
    stats = df.groupBy(*group).agg(
        *[F.avg(n).alias(f"_m_{n}") for n in z_names], *[F.stddev_pop(n).alias(f"_s_{n}") for n in z_names]
    )
    out = lookup(out, stats, list(group), keys=group, salt_by=(KEY,))
    out = out.withColumns({f"{n}_z": (c(n) - c(f"_m_{n}")) / (c(f"_s_{n}") + 1e-8) for n in z_names})
    return row_ranks(out.drop(*[f"_{k}_{n}" for n in z_names for k in "ms"]), names)


def equal_positions(df):
    """0-based place of each row in the id order as `pos`, with the number of rows as `rows`."""
    df = df.withColumn("_all", F.lit(0))
    line = Timeline.of(df, keys=("_all",), by=c(KEY).cast("double"), order=(c(KEY),))
    line = line.position("pos").key_total("rows", F.lit(1)).with_columns({"pos": c("pos") - 1})
    return line.drop("_all").finished()


def equal_blocks(df, blocks):
    """Number of the equal-size sequential block of each row, by sample id, as `block`."""
    rows = equal_positions(df)
    return rows.withColumn("block", F.floor(c("pos") * blocks / c("rows")).cast("int")).drop("pos", "rows")


def centred(df, pred, group=()):
    """Prediction minus its mean, over everything or per group, as `centred`."""
    if not group:
        return _with_row(df, df.agg(F.avg(pred).alias("_m"))).withColumn("centred", c(pred) - c("_m")).drop("_m")
    means = df.groupBy(*group).agg(F.avg(pred).alias("_m"))
    return lookup(df, means, list(group), keys=tuple(group), salt_by=(KEY,)).withColumn(
        "centred", c(pred) - c("_m")
    ).drop("_m")


# targets and weights -----------------------------------------------------------------------------


def target_transforms(df, fit, volatility=None):
    """Target winsorised at train quantiles, at a symmetric bound, as month rank, mixed with its
    rank, and scaled by volatility where a volatility column is given."""
    y = c("target")
    stats = _with_row(
        exact_quantiles(fit, y, {"_lo": 0.005, "_hi": 0.995}), exact_quantiles(fit, F.abs(y), {"_abs": 0.995})
    )
    out = _with_row(df, stats).withColumns(
        {
            "winsor": F.least(F.greatest(y, c("_lo")), c("_hi")),
            "symmetric": F.least(F.greatest(y, -c("_abs")), c("_abs")),
        }
    ).drop("_lo", "_hi", "_abs")
    out = average_rank(out, y, (MONTH,), "_r")
    # rank on [-1, 1] within the month, rescaled to the deviation of the target there
    rank = F.when(c("rows") > 1, 2.0 * (c("_r") - 1) / (c("rows") - 1) - 1.0).otherwise(0.0)
    out = out.withColumns({"month_rank": rank, "rank_mix": 0.75 * y + 0.25 * rank}).drop("_r", "rows")
    if volatility is not None:
        med = exact_quantiles(fit, c(volatility), {"_med": 0.5})
        scale = clip(c(volatility) / c("_med"), 0.5, 2.0)
        out = _with_row(out, med).withColumn("vol_scaled", y / scale).drop("_med")
    return out


def sample_weights(df, first_month, last_month, ratio=None, threshold=0.001):
    """Linear month ramp, half weight for small targets, and a capped density ratio p / (1 - p)."""
    ramp = 0.5 + 0.5 * (c(MONTH) - first_month) / float(max(last_month - first_month, 1))
    out = df.withColumns(
        {"w_ramp": ramp, "w_size": F.when(F.abs(c("target")) > threshold, 1.0).otherwise(0.5)}
    )
    if ratio is not None:
        out = out.withColumn("_d", c(ratio) / (1 - c(ratio)))
        out = _with_row(out, exact_quantiles(out, c("_d"), {"_cap": 0.99}))
        out = out.withColumn("_d", F.least(c("_d"), c("_cap")))
        out = _with_row(out, out.agg(F.avg("_d").alias("_mean"))).withColumn("w_density", c("_d") / c("_mean"))
        out = out.drop("_d", "_cap", "_mean")
    return out
