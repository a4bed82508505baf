"""Aggregate expressions. Each is built from mergeable built-ins, so Spark combines map-side."""

from pyspark.sql import functions as F

from .expr import at_least


def sum_if(cond, x):
    """Sum of x where cond holds, 0 for none."""
    return F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))


def count_if(cond):
    return F.count_if(cond).cast("double")


def sum0(x):
    return F.coalesce(F.sum(x), F.lit(0.0))


def first_value(x, rank):
    """Value at the smallest rank, skipping rows where the value is null."""
    return F.min_by(x, F.when(x.isNotNull(), rank))


def last_value(x, rank):
    return F.max_by(x, F.when(x.isNotNull(), rank))


def weighted_mean(x, w):
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def decayed_sum(x, t, tau):
    return F.sum(x * F.exp(-t / float(tau)))


def decayed_mean(x, t, tau):
    return weighted_mean(x, F.exp(-t / float(tau)))


def ols_slope(y, x, floor=1e-9):
    """Slope of y on x from moments, the variance of x not below `floor`."""
    n = at_least(F.count(F.lit(1)), 1.0)
    mx = F.sum(x) / n
    return (F.sum(x * y) / n - mx * F.sum(y) / n) / at_least(F.sum(x * x) / n - mx * mx, floor)


def origin_slope(y, x):
    return F.sum(x * y) / at_least(F.sum(x * x), 1e-12)


def inner_product(x, y):
    """Normalised, uncentred inner product; null when either side is all zero."""
    den = F.sqrt(F.sum(x * x) * F.sum(y * y))
    return F.when(den > 1e-12, F.sum(x * y) / den)


def moment_std(x, x2, n):
    """Population standard deviation from sum, sum of squares and count."""
    m = x / n
    return F.sqrt(at_least(x2 / n - m * m, 0.0))


def correlation(x, y):
    """Pearson correlation over rows where both are known; null when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(u, v), F.stddev_pop(u) * F.stddev_pop(v))
