"""Drift, redundancy and change reports over many feature columns.

Features are stacked to rows (feature, value), so one aggregation serves all of them; the rest is
a table with one row per feature.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import null_if_nan
from ..functions.stats import correlation
from ..schema import KEY
from .linear import added, column_means
from .preprocess import equal_positions
from .quantile import exact_quantiles
from .timeline import Timeline

c = F.col
QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
FEATURE = ("feature",)


def stacked(df, names, *keep):
    """Rows (keep..., feature, value); NaN becomes null."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), null_if_nan(c(n).cast("double")).alias("value")) for n in names])
    return df.select(*keep, F.explode(pairs).alias("_v")).select(*keep, "_v.feature", "_v.value")


def psi_edges(reference, names, bins=10):
    """Distinct inner edges of the reference quantile bins per feature, as an array."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    q = exact_quantiles(stacked(reference, names), c("value"), probs, FEATURE)
    edges = F.array_distinct(F.array(*[c(k) for k in probs]))
    return q.select("feature", edges.alias("edges"))


def histogram(df, names, edges):
    """Share of known values per (feature, bin); the bin of a value is the number of inner edges
    at or below it, the outer bins are open."""
    inner = F.slice(c("edges"), 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    rows = stacked(df, names).filter(c("value").isNotNull()).join(F.broadcast(edges), "feature")  # one row per feature
    b = F.size(F.filter(inner, lambda e: e <= c("value")))
    counts = rows.groupBy("feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))  # a few bins per feature
    return counts.select("feature", "bin", (c("n") / total).alias("share"))


def psi(reference, other, names, bins=10, floor=1e-6):
    """Population stability index of each feature of `other` against `reference`."""
    edges = psi_edges(reference, names, bins)
    every = edges.select("feature", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    share = lambda d, k: histogram(d, names, edges).withColumnRenamed("share", k)
    t = every.join(share(reference, "r"), ["feature", "bin"], "left").join(share(other, "o"), ["feature", "bin"], "left")
    at = lambda k: F.greatest(F.coalesce(c(k), F.lit(0.0)), F.lit(floor))
    return t.groupBy("feature").agg(F.sum((at("o") - at("r")) * F.log(at("o") / at("r"))).alias("psi"))


REFERENCE = "reference"
EDGES = {f"e{i}": i / 10 for i in range(11)}


def window_profiles(frames, names):
    """Quantiles, moments, missing and extreme shares, and bin shares of every feature in every frame.

    frames: {label: table}, one of them REFERENCE, whose median, deviation and decile edges measure the others. The label is a
    key column, so one ranking serves all frames, features and probabilities, and two more passes all the rest.
    """
    rows = reduce(lambda a, b: a.unionByName(b), [stacked(d.withColumn("window", F.lit(w)), names, "window") for w, d in frames.items()])
    ranks = exact_quantiles(rows, c("value"), QUANTILES | EDGES, ("window", "feature"))
    own = ranks.filter(c("window") == REFERENCE)
    inner = F.array_sort(F.array_distinct(F.array(*[c(e) for e in EDGES])))
    inner = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    spread = rows.filter(c("window") == REFERENCE).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    measure = spread.join(own.select("feature", c("q50").alias("median"), inner.alias("edges")), "feature", "left")
    x = rows.join(F.broadcast(measure), "feature")  # one row per feature
    z = F.abs((F.coalesce(c("value"), c("median")) - c("mean")) / F.when(c("std") >= 1e-6, c("std")).otherwise(1.0))
    place = F.when(c("value").isNotNull(), F.size(F.filter("edges", lambda e: e <= c("value")))).otherwise(-1)
    bins = x.groupBy("window", "feature", "std", F.size("edges").alias("inner"), place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count_if(z > 5).alias("z5"), F.count_if(z > 10).alias("z10")
    )  # at most twelve rows per window and feature
    known = F.sum(F.when(c("bin") >= 0, c("n")))
    shares = F.map_from_entries(F.collect_list(F.when(c("bin") >= 0, F.struct("bin", "n"))))
    out = bins.groupBy("window", "feature", "std", "inner").agg(
        F.sum("n").alias("rows"), known.alias("known"), (F.sum("total") / known).alias("avg"), shares.alias("bins"),
        (F.sum(F.when(c("bin") < 0, c("n")).otherwise(0)) / F.sum("n")).alias("missing_rate"),
        (F.sum("z5") / F.sum("n")).alias("abs_z_gt_5_rate"), (F.sum("z10") / F.sum("n")).alias("abs_z_gt_10_rate"),
    )
    return out.join(ranks.select("window", "feature", *QUANTILES), ["window", "feature"], "left")


def drift_windows(reference, windows, names, floor=1e-6):
    """One row per window and feature: PSI, shifts of median and mean, IQR ratio, missing change, score.

    windows: {label: table}. The weights of the score are fixed values of the report.
    """
    t = window_profiles({REFERENCE: reference} | windows, names)
    kept = ("rows", "known", "avg", "bins", "missing_rate", "abs_z_gt_10_rate", "abs_z_gt_5_rate", "q25", "q50", "q75")
    r = t.filter(c("window") == REFERENCE).select("feature", "std", "inner", *[c(n).alias(f"r_{n}") for n in kept])
    o = t.filter(c("window") != REFERENCE).select("window", "feature", *[c(n).alias(f"o_{n}") for n in kept])
    t = o.join(r, "feature")
    iqr, oiqr = c("r_q75") - c("r_q25"), c("o_q75") - c("o_q25")
    den = F.greatest(F.abs(iqr), c("std") * 0.05, F.lit(1e-12))
    shift = F.abs(c("o_q50") - c("r_q50")) / den
    mean_shift = F.abs(c("o_avg") - c("r_avg")) / F.greatest(c("std"), F.lit(1e-12))
    share = lambda p, b: F.greatest(F.coalesce(F.try_element_at(c(f"{p}_bins"), b), F.lit(0)) / c(f"{p}_known"), F.lit(floor))
    part = lambda b: (share("o", b) - share("r", b)) * F.ln(share("o", b) / share("r", b))
    index = F.aggregate(F.sequence(F.lit(0), c("inner")), F.lit(0.0), lambda total, b: total + part(b))
    t = t.withColumn("psi", index)
    score = (
        F.coalesce(c("psi"), F.lit(0.0))
        + F.least(shift, F.lit(10.0)) * 0.25
        + F.least(mean_shift, F.lit(10.0)) * 0.25
        + F.abs(c("o_missing_rate") - c("r_missing_rate")) * 5.0
        + F.least(c("o_abs_z_gt_10_rate"), F.lit(0.2)) * 5.0
    )
    return t.select(
        "window",
        "feature",
        "psi",
        shift.alias("median_shift_iqr"),
        mean_shift.alias("mean_shift_std"),
        F.when(F.abs(iqr) > 1e-12, oiqr / iqr).alias("iqr_ratio"),
        c("r_missing_rate").alias("reference_missing"),
        c("o_missing_rate").alias("other_missing"),
        c("o_abs_z_gt_5_rate").alias("abs_z_gt_5_rate"),
        c("o_abs_z_gt_10_rate").alias("abs_z_gt_10_rate"),
        score.alias("drift_score"),
    )


def drift_report(reference, other, names):
    """The report for a single window."""
    return drift_windows(reference, {"other": other}, names).drop("window")


# redundancy --------------------------------------------------------------------------------------


def _pair_sums(names, centre):
    """Per task and row column: counts, sums, squares and products over rows where both columns are known."""
    k = len(names)

    def run(frames):
        sums = np.zeros((6, k, k))
        for frame in frames:
            x = frame.to_numpy(np.float64) - centre
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(np.float64)
            squares = x * x
            sums += [m.T @ m, x.T @ m, m.T @ x, squares.T @ m, m.T @ squares, x.T @ x]
        if sums[0].any():
            yield pd.DataFrame({"i": range(k), "sums": list(sums.transpose(1, 0, 2).reshape(k, -1))})

    return run


def pair_moments(df, names):
    """(i, j, n, corr) of every ordered pair of columns in one pass; missing values are left out pairwise.

    A task holds six matrices of columns by columns and gives one row per column, which are added as vectors (`added`). Values
    are taken from their column means first, so that products keep their digits. `corr` is null when a side is constant.
    """
    names, k = list(names), len(names)
    x = df.select(*[null_if_nan(c(n).cast("double")).alias(f"x{i}") for i, n in enumerate(names)])
    centre = column_means(x)
    parts = F.arrays_zip(*[F.slice("sums", p * k + 1, k).alias(f"s{p}") for p in range(6)])
    pairs = added(x, _pair_sums(names, centre)).select("i", F.posexplode(parts).alias("j", "_s")).select("i", "j", "_s.*")
    n, sx, sy, sxx, syy, sxy = (c(f"s{p}") for p in range(6))
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    flat = (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy)
    corr = F.when((n > 0) & ~flat, (sxy - sx * sy / n) / F.sqrt(vx * vy))
    return pairs.where(n > 0).select("i", "j", n.cast("long").alias("n"), corr.alias("corr"))


def correlation_pairs(df, names, min_periods=1):
    """Pearson correlation of every pair of columns, one row per pair; null below `min_periods` common rows."""
    name = lambda i: F.element_at(F.array(*[F.lit(x) for x in names]), i + 1)
    m = pair_moments(df, names).where("i < j")
    every = df.sparkSession.range(len(names)).select(c("id").cast("int").alias("i"))
    every = every.select("i", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("j")).where("i < j")
    corr = F.when(c("n") >= min_periods, c("corr")).alias("corr")
    return every.join(m, ["i", "j"], "left").select(name(c("i")).alias("a"), name(c("j")).alias("b"), corr)


def correlation_matrix(df, names, min_periods=1):
    """Pairwise correlations as an array of columns by columns, NaN where unknown."""
    out = np.full((len(names), len(names)), np.nan)
    for r in pair_moments(df, names).where(c("n") >= min_periods).collect():  # columns x columns numbers
        out[r.i, r.j] = np.nan if r["corr"] is None else r["corr"]
    return out


def prune_correlated(matrix, names, gains, threshold=0.995):
    """Strikes out, for each column by falling gain, all later ones that correlate with it at `threshold` or more.

    Works on the column-by-column matrix only. Returns (kept, [(removed, closest kept column, correlation)]).
    """
    strength = np.abs(np.nan_to_num(np.asarray(matrix, float)))
    order = sorted(range(len(names)), key=lambda i: (-gains.get(names[i], 0.0), names[i]))
    later, struck = set(order), {}
    for i in order:
        later.discard(i)
        if i in struck:
            continue
        for j in later.intersection(np.flatnonzero(strength[i] >= threshold).tolist()):
            if strength[i, j] > struck.get(j, (0.0,))[0]:
                struck[j] = (float(strength[i, j]), names[i])
    return [names[i] for i in order if i not in struck], [(names[i], *struck[i][::-1]) for i in order if i in struck]


def prune_by_gain(gains, share=0.1):
    """Names left after dropping the lowest `share` of features by gain."""
    ordered = sorted(gains, key=lambda n: (gains[n], n))
    return [n for n in gains if n not in set(ordered[: int(len(ordered) * share)])]


def pack_overlap(left, right, left_names, right_names, threshold=0.999):
    """For each right column its closest left column, whether it is constant, and a drop reason."""
    names, k = [*left_names, *right_names], len(left_names)
    both = left.select(KEY, *[c(n).alias(f"_l{i}") for i, n in enumerate(left_names)])
    both = both.join(right.select(KEY, *[c(n).alias(f"_r{i}") for i, n in enumerate(right_names)]), KEY)
    columns = [*[f"_l{i}" for i in range(k)], *[f"_r{i}" for i in range(len(right_names))]]
    name = lambda i: F.element_at(F.array(*[F.lit(n) for n in names]), i + 1)
    pairs = pair_moments(both, columns).where((c("i") >= k) & (c("j") < k))
    best = pairs.groupBy("i").agg(F.max(F.struct(F.coalesce(F.abs("corr"), F.lit(0.0)).alias("r"), name(c("j")).alias("n"))).alias("best"))
    spread = stacked(both, columns[k:]).groupBy("feature").agg((F.max("value") == F.min("value")).alias("constant"))
    spread = spread.select((F.substring("feature", 3, 9).cast("int") + k).alias("i"), F.coalesce("constant", F.lit(True)).alias("constant"))
    t = spread.join(best, "i", "left").withColumn("feature", name(c("i")))
    none = F.struct(F.lit(0.0).alias("r"), F.lit(max(left_names)).alias("n"))  # no common row with any left column
    t = t.withColumn("best", F.coalesce("best", none))
    reason = F.when(c("constant"), "constant").when(c("best.r") >= threshold, "duplicate").otherwise("keep")
    return t.select("feature", "constant", c("best.n").alias("partner"), c("best.r").alias("correlation"), reason.alias("reason"))


def version_diff(old, new, names, gains=None, rtol=1e-5, atol=1e-8):
    """How much each feature changed between two builds of a table, and its priority for review."""
    gains = gains or {}
    whole = sum(gains.values()) or 1.0
    a = stacked(old, names, KEY).withColumnRenamed("value", "a")
    b = stacked(new, names, KEY).withColumnRenamed("value", "b")
    t = a.join(b, [KEY, "feature"])
    x, y = c("a"), c("b")
    near = F.abs(x - y) <= atol + rtol * F.abs(y)
    same = F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), False).otherwise(near)
    both = x.isNotNull() & y.isNotNull()
    s = t.groupBy("feature").agg(
        correlation(x, y).alias("correlation"),
        F.avg((~same).cast("double")).alias("changed_fraction"),
        F.avg(F.abs(x - y)).alias("mean_absolute_change"),
        F.stddev_pop(F.when(both, x)).alias("_s"),
        F.avg(x.isNull().cast("double")).alias("old_missing"),
        F.avg(y.isNull().cast("double")).alias("new_missing"),
    )
    share = reduce(lambda w, n: w.when(c("feature") == n, gains.get(n, 0.0) / whole), names[1:], F.when(c("feature") == names[0], gains.get(names[0], 0.0) / whole))
    nmae = c("mean_absolute_change") / (c("_s") + 1e-12)
    return s.withColumns(
        {"normalized_mae": nmae, "gain_share": share, "priority": share * F.least(nmae, F.lit(5.0)) * c("changed_fraction")}
    ).drop("_s")


# boundaries and samples --------------------------------------------------------------------------


def boundary_scores(df, names, window, block_rows=100_000):
    """Change score at each row of the id order: root mean square over features of the difference
    between the mean of the next `window` rows and of the previous `window` rows.

    Ids are cut into blocks, each with a halo of `window` rows from its neighbours.
    """
    block_rows = max(block_rows, window)
    rows = equal_positions(df.select(KEY, *names))
    block = F.floor(c("pos") / block_rows)
    here = F.array(F.struct(block.alias("b"), F.lit(True).alias("own")))
    halo = lambda cond, b: F.when(cond, F.array(F.struct(b.alias("b"), F.lit(False).alias("own")))).otherwise(F.array())
    inside = c("pos") % block_rows
    copies = F.concat(
        here, halo((inside < window) & (block > 0), block - 1), halo(inside >= block_rows - window, block + 1)
    )
    spread = rows.withColumn("_c", F.explode(copies)).select("*", "_c.b", "_c.own")
    # means of both sides from running sums and counts at three places
    order = Window.partitionBy("b").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_s{i}": F.coalesce(F.sum(n).over(upto), F.lit(0.0)) for i, n in enumerate(names)}
    spread = spread.withColumns(sums | {f"_k{i}": F.count(n).over(upto) for i, n in enumerate(names)})

    def mean(i, ahead):
        end, start = (F.lead(f"_{x}{i}", window - 1).over(order) if ahead else F.lag(f"_{x}{i}", 1).over(order) for x in "sk"), (
            F.coalesce(F.lag(f"_{x}{i}", 1 if ahead else window + 1).over(order), F.lit(0)) for x in "sk"
        )
        total, known = (a - b for a, b in zip(end, start))
        return F.when(known > 0, total / known)

    gap = [mean(i, True) - mean(i, False) for i in range(len(names))]
    score = F.sqrt(sum((g * g for g in gap), F.lit(0.0)) / float(len(names)))
    out = spread.withColumn("score", score)
    whole = (c("pos") >= window) & (c("pos") <= c("rows") - window)
    return out.filter(c("own") & whole).select(KEY, "pos", "score")


def hash_order(key, seed):
    """Pseudo-random order of integer ids that any engine can repeat."""
    mixed = (F.pmod(key.cast("long"), F.lit(1000003)) * 7919 + seed) * 1103515245 + 12345
    return F.pmod(mixed.bitwiseAND(0x7FFFFFFF) * 48271, F.lit(2147483647))


def stratified_sample(df, group, size, seed=7):
    """At most `size` rows per group, picked by hashed id."""
    h = hash_order(c(KEY), seed)
    rows = df.withColumn("_h", h)
    line = Timeline.of(rows, keys=(group,), by=c("_h").cast("double"), order=(c("_h"), c(KEY))).position("_p")
    return line.filter(c("_p") <= size).drop("_h", "_p").finished()


def spaced_sample(df, group, size):
    """At most `size` rows per group, evenly spaced over its id order."""
    line = Timeline.of(df, keys=(group,), by=c(KEY).cast("double"), order=(c(KEY),)).position("_p").key_total("_n", F.lit(1))
    k = F.least(F.lit(size), c("_n"))
    # row p is taken when some j < k has floor(j * (n - 1) / (k - 1)) = p - 1
    step = F.when(k > 1, (c("_n") - 1) / (k - 1)).otherwise(1.0)
    first = F.ceil((c("_p") - 1) / step)
    taken = (first < k) & (F.floor(first * step) == c("_p") - 1)
    return line.filter(taken).drop("_p", "_n").finished()


def row_sample(df, size, seed=7):
    """`size` rows by hashed id."""
    return df.orderBy(hash_order(c(KEY), seed), KEY).limit(size)
