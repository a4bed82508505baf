"""Scoring of prediction frames from per-month sufficient statistics.

One pass over the predictions gives n, sums and products per month; every panel, leave-one-month-
out score, paired delta and bootstrap draw is arithmetic on that table, which has one row per
month.
"""

from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..schema import KEY, MONTH
from .joins import strict_align
from .lineage import cut
from .quantile import exact_quantiles

c = F.col


def finite(x):
    """The value itself; a missing or non-finite one is an error."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("non-finite score input"))).otherwise(x)


def moments(df, preds, keys=(MONTH,), target="target"):
    """n, target sums and, per prediction p, `p_s`, `p_ss`, `p_sy`, per group."""
    y = finite(c(target).cast("double"))
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")]
    for p in preds:
        x = finite(c(p).cast("double"))
        aggs += [F.sum(x).alias(f"{p}_s"), F.sum(x * x).alias(f"{p}_ss"), F.sum(x * y).alias(f"{p}_sy")]
    return df.groupBy(*keys).agg(*aggs)


def moment_names(preds):
    return ["n", "y", "yy"] + [f"{p}_{k}" for p in preds for k in ("s", "ss", "sy")]


def cosine(p, of=c):
    """Uncentred cosine from moments, 0 when degenerate. `of` maps a moment name to a column."""
    den = F.sqrt(F.greatest(of(f"{p}_ss"), F.lit(0.0)) * F.greatest(of("yy"), F.lit(0.0)))
    return F.when(den > 0, of(f"{p}_sy") / den).otherwise(0.0)


def pearson(p, of=c):
    """Cosine of the centred vectors from moments; a variance lost in rounding counts as 0."""
    n = of("n")
    xx = of(f"{p}_ss") - of(f"{p}_s") * of(f"{p}_s") / n
    yy = of("yy") - of("y") * of("y") / n
    spread = (xx > 1e-12 * of(f"{p}_ss")) & (yy > 1e-12 * of("yy"))
    return F.when(spread, (of(f"{p}_sy") - of(f"{p}_s") * of("y") / n) / F.sqrt(xx * yy)).otherwise(0.0)


SCORERS = {"cosine": cosine, "pearson": pearson}


def scopes(table, names, without=66):
    """Moments of every scope: overall, each month, each month left out, and without one month."""
    total = table.agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    both = table.crossJoin(F.broadcast(total))  # one row
    month = table.select(F.lit("month").alias("scope"), MONTH, *names)
    lomo = both.select(F.lit("lomo").alias("scope"), MONTH, *[(c(f"_t_{n}") - c(n)).alias(n) for n in names])
    none = F.lit(-1).alias(MONTH)
    whole = table.agg(*[F.sum(n).alias(n) for n in names]).select(F.lit("overall").alias("scope"), none, *names)
    rest = table.filter(c(MONTH) != without).agg(*[F.sum(n).alias(n) for n in names])
    rest = rest.select(F.lit("without").alias("scope"), none, *names)
    out = reduce(lambda a, b: a.unionByName(b), [month, lomo, whole, rest])
    return out.filter(c("n") > 0)


def panel(df, pred, without=66):
    """Cosine and Pearson per scope, with prediction mean and deviation."""
    t = scopes(moments(df, [pred]), moment_names([pred]), without)
    m = c(f"{pred}_s") / c("n")
    return t.select(
        "scope",
        MONTH,
        "n",
        cosine(pred).alias("cosine"),
        pearson(pred).alias("pearson"),
        m.alias("prediction_mean"),
        F.sqrt(F.greatest(c(f"{pred}_ss") / c("n") - m * m, F.lit(0.0))).alias("prediction_std"),
    )


def panel_summary(df, pred, metric="cosine", without=66):
    """One row: overall score, worst month and its score, without-month score, LOMO minimum."""
    t = panel(df, pred, without)
    at = lambda s: F.when(c("scope") == s, c(metric))
    worst = F.when(c("scope") == "month", F.struct(c(metric).alias("s"), c(MONTH).alias("m")))
    return t.agg(
        F.max(at("overall")).alias("overall"),
        F.min(worst)["s"].alias("worst_score"),
        F.min(worst)["m"].alias("worst_month"),
        F.max(at("without")).alias("without"),
        F.min(at("lomo")).alias("lomo_min"),
        F.avg(at("month")).alias("month_mean"),
    )


def paired_panel(df, base, candidate, metric="cosine", without=66):
    """Score of both predictions and their difference per scope."""
    t = scopes(moments(df, [base, candidate]), moment_names([base, candidate]), without)
    f = SCORERS[metric]
    return t.select(
        "scope", MONTH, f(base).alias("base"), f(candidate).alias("candidate"), (f(candidate) - f(base)).alias("delta")
    )


def bootstrap_deltas(df, base, candidate, draws=1000, seed=17, metric="cosine"):
    """Score difference of each draw of months with replacement.

    The month of a slot is a hash of (draw, slot, seed), so draws are repeatable anywhere.
    """
    names = moment_names([base, candidate])
    table = moments(df, [base, candidate])
    order = Window.orderBy(MONTH)  # one row per month
    table = table.withColumn("pick", F.row_number().over(order) - 1)
    size = table.agg(F.count(F.lit(1)).alias("m"))
    h = ((c("draw") * 7919 + c("slot") * 104729 + seed) * 1103515245 + 12345).bitwiseAND(0x7FFFFFFF)
    slots = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size))
    slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), c("m") - 1)))
    picks = slots.select("draw", F.pmod(F.floor(h / 65536), c("m")).cast("int").alias("pick"))
    t = picks.join(F.broadcast(table), "pick").groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])
    f = SCORERS[metric]
    return t.select("draw", (f(candidate) - f(base)).alias("delta"))


def bootstrap_interval(df, base, candidate, draws=1000, seed=17, metric="cosine"):
    d = bootstrap_deltas(df, base, candidate, draws, seed, metric)
    return exact_quantiles(d, c("delta"), {"low": 0.025, "high": 0.975})


def compare_runs(left, right, metric="cosine", without=66):
    """Paired panel of two frames (sample_id, month, target, prediction); all rows must match."""
    keys = [KEY, MONTH, "target"]
    both = strict_align(
        left.withColumnRenamed("prediction", "base"), right.withColumnRenamed("prediction", "candidate"), keys
    )
    return paired_panel(both, "base", "candidate", metric, without)


# ensembles ---------------------------------------------------------------------------------------


#: Models of a sample that one mask tells apart.
MASK = 64


def prediction_mean(long, model_keys, group=()):
    """Mean and number of models per sample; a model contributes a sample at most once.

    The models are numbered and those of a sample are bits of a mask, so rows are summed where they are read, and one row per
    sample and task is shuffled. More than 64 models take a mask for each 64 and a second sum.
    """
    of = [*group, KEY]
    number = F.row_number().over(Window.orderBy(*model_keys)) - 1  # one row per model
    models = cut(long.select(*model_keys).distinct().select(*[c(k).alias(f"_of_{k}") for k in model_keys], number.alias("_model")))
    many = models.count() > MASK
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_of_{k}")) for k in model_keys])
    rows = long.join(F.broadcast(models), same).withColumn("_mask", F.expr(f"_model div {MASK}"))
    once = rows.groupBy(*of, *["_mask"] * many).agg(
        F.sum(finite(c("pred"))).alias("pred"),
        F.count(F.lit(1)).alias("k"),
        F.bit_or(F.expr(f"shiftleft(1L, _model % {MASK})")).alias("_bits"),
    )
    different = F.bit_count("_bits").cast("long")
    checked = F.when(c("k") > different, F.raise_error(F.lit("duplicate model prediction"))).otherwise(c("pred"))
    once = once.select(*of, checked.alias("pred"), different.alias("models"))
    if many:
        once = once.groupBy(*of).agg(F.sum("pred").alias("pred"), F.sum("models").alias("models"))
    return once.select(*of, (c("pred") / c("models")).alias("pred"), "models")


def coverage(mean, expected, group=()):
    """Rows, and rows with fewer or more models than expected, per group."""
    return mean.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(c("models") < expected).alias("short"),
        F.count_if(c("models") > expected).alias("over"),
    )


def clip_bounds(df, pred, low=0.001, high=0.999):
    """Frozen clipping bounds of a prediction: one row (low, high)."""
    return exact_quantiles(df, c(pred), {"low": low, "high": high})


def postprocess(df, pred, bounds=None, nodata=None, out="pred"):
    """Clip to frozen bounds, and only then set samples without data to 0."""
    x = c(pred)
    if bounds is not None:
        df = df.crossJoin(F.broadcast(bounds))  # one row
        x = F.when(x < c("low"), c("low")).when(x > c("high"), c("high")).otherwise(x)
    if nodata is not None:
        x = F.when(c(nodata), 0.0).otherwise(x)
    df = df.withColumn(out, x)
    return df.drop("low", "high") if bounds is not None else df


def postprocess_variants(df, pred, bounds, nodata):
    """Raw, clipped, zeroed and both, as columns of one frame."""
    df = df.withColumn("v_raw", c(pred))
    df = postprocess(df, pred, bounds, None, "v_clip")
    df = postprocess(df, pred, None, nodata, "v_zero")
    return postprocess(df, pred, bounds, nodata, "v_both")


def postprocess_ablation(df, pred, bounds, nodata, without=66):
    """Score of each variant overall and without one month, and how many rows were changed."""
    names = ["v_raw", "v_clip", "v_zero", "v_both"]
    v = postprocess_variants(df, pred, bounds, nodata)
    t = scopes(moments(v, names), moment_names(names), without).filter(c("scope").isin("overall", "without"))
    scores = t.select("scope", *[cosine(n).alias(n) for n in names])
    changed = v.agg(*[F.avg((c(n) != c("v_raw")).cast("double")).alias(f"changed_{n[2:]}") for n in names[1:]])
    return scores.crossJoin(F.broadcast(changed))  # one row


def recency_ensemble(long, folds, half_life, by=(), incomplete="raise"):
    """Equal mean and recency-weighted mean over folds and seeds, for each sample and value of the columns `by` (arms).

    long: sample_id, *by, fold, seed, pred; folds: fold, train_end (a few rows). A fold weighs
    2 ** ((train_end - latest) / half_life), normalised; seeds of a fold share its weight.
    Every sample needs every fold and seed that the table knows. A sample which lacks some is an error, or with
    incomplete="report" a row without means; `models` and `complete` tell such rows from the others.
    """
    if not half_life > 0:
        raise ValueError("half-life must be positive")
    if incomplete not in ("raise", "report"):
        raise ValueError("incomplete must be raise or report")
    latest = folds.agg(F.max("train_end").alias("latest"))
    w = folds.crossJoin(latest).withColumn("w", F.pow(F.lit(2.0), (c("train_end") - c("latest")) / float(half_life)))
    total = w.agg(F.sum("w").alias("tw"))
    w = w.crossJoin(total).select("fold", (c("w") / c("tw")).alias("w"))
    shape = long.agg(
        F.countDistinct("fold").alias("nf"), F.countDistinct("seed").alias("ns")
    )
    t = (
        long.join(F.broadcast(w), "fold")  # one row per fold
        .crossJoin(F.broadcast(shape))
        .groupBy(KEY, *by)
        .agg(
            F.avg(finite(c("pred"))).alias("base"),
            F.sum(c("pred") * c("w") / c("ns")).alias("recency"),
            F.count(F.lit(1)).alias("k"),
            F.max(c("nf") * c("ns")).alias("need"),
        )
    )
    whole = c("k") == c("need")
    if incomplete == "report":
        means = [F.when(whole, c(n)).alias(n) for n in ("base", "recency")]
        return t.select(KEY, *by, *means, c("k").alias("models"), whole.cast("int").alias("complete"))
    gap = F.when(~whole, F.raise_error(F.lit("incomplete fold and seed coverage")))
    return t.select(KEY, *by, "base", gap.otherwise(c("recency")).alias("recency"))


def promotion_gates(paired, min_delta=0.0, min_positive_months=1):
    """Boolean gates over a paired panel: overall gain, positive months, all LOMO positive."""
    at = lambda s: c("scope") == s
    g = paired.agg(
        F.max(F.when(at("overall"), c("delta"))).alias("delta"),
        F.count_if(at("month") & (c("delta") > 0)).alias("positive_months"),
        F.min(F.when(at("lomo"), c("delta"))).alias("lomo_min"),
    )
    out = g.withColumns(
        {
            "gain": c("delta") >= min_delta,
            "months": c("positive_months") >= min_positive_months,
            "lomo": c("lomo_min") > 0,
        }
    )
    return out.withColumn("passed", c("gain") & c("months") & c("lomo"))


#: Rows that are compared with each other in one task of a Pareto front.
PARETO_BLOCK = 2_000


def _front(metrics):
    """Rows of a part that no other row of it reaches in all metrics; equal rows stay."""

    def run(part):
        x = part[metrics].to_numpy(float)
        order = np.argsort(-x.sum(1), kind="stable")  # only a row of a larger sum can be above another
        best = np.empty((0, len(metrics)))
        keep = []
        for i in order:
            above = (best >= x[i]).all(1) & (best > x[i]).any(1)
            if not above.any():
                keep.append(i)
                best = np.vstack([best, x[i]])
        return part.iloc[keep]

    return run


def _beaten(metrics, name, eps):
    """Names of rows of the left part that a row of the right part dominates."""

    def run(rows, front):
        if not len(rows) or not len(front):
            return rows[[name, "_g"]].iloc[:0]
        lost = np.zeros(len(rows), bool)
        x, own = rows[metrics].to_numpy(float), rows[name].to_numpy()
        for y, other in zip(front[metrics].to_numpy(float), front[name].to_numpy()):
            gap = y - x
            lost |= (gap >= -eps).all(1) & (gap > eps).any(1) & (own != other)
        return rows[[name, "_g"]][lost]

    return run


def pareto(df, metrics, name="name", group="group", eps=1e-12, block=PARETO_BLOCK):
    """Rows not dominated within their group on all metrics.

    Fronts of parts of a group are taken first, twice; whatever row dominates another, one of the fronts does so too. Then blocks of rows
    are compared with blocks of what is left of the fronts, so no task holds a group and no pairs are written. A missing metric dominates nothing.
    """
    rows = df.select(F.col(group).alias("_g"), name, *[c(m).cast("double").alias(m) for m in metrics])
    whole = rows.dropna(subset=list(metrics))
    front, schema = whole, whole.schema
    for _ in range(2):
        parts = front.groupBy("_g").agg(F.ceil(F.count("*") / block).alias("_parts"))
        dealt = front.join(parts, "_g").withColumn("_part", F.pmod(F.xxhash64(name, *metrics), F.col("_parts"))).drop("_parts")
        front = cut(dealt.groupBy("_g", "_part").applyInPandas(lambda p: _front(metrics)(p.drop(columns="_part")), schema))
    counts = front.groupBy("_g").agg(F.ceil(F.count("*") / block).alias("_fronts"))
    counts = cut(whole.groupBy("_g").agg(F.ceil(F.count("*") / (10 * block)).alias("_rows")).join(counts, "_g"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64(name), F.col(n))
    left = whole.join(counts, "_g").select("_g", name, *metrics, part("_rows").alias("_a"), every("_fronts").alias("_b"))
    right = front.join(counts, "_g").select("_g", name, *metrics, part("_fronts").alias("_b"), every("_rows").alias("_a"))
    key = ("_g", "_a", "_b")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_beaten(list(metrics), name, eps), whole.select(name, "_g").schema)
    marked = found.distinct().withColumnRenamed("_g", group).withColumn("_lost", F.lit(True))
    return df.join(marked, [group, name], "left").withColumn("nondominated", c("_lost").isNull()).drop("_lost")


def window_panels(df, preds, panels):
    """Each prediction on each named month range: score, month spread, quartile and worst month.

    panels: {name: (first, last)}. A panel with a missing month reports its number and no score.
    """
    table = moments(df, preds)
    spark = df.sparkSession
    ranges = spark.createDataFrame([(k, a, b, b - a + 1) for k, (a, b) in panels.items()], "panel string, a int, b int, months int")
    inside = table.join(F.broadcast(ranges), (c(MONTH) >= c("a")) & (c(MONTH) <= c("b")))  # a few rows
    parts = []
    for p in preds:
        per = inside.withColumn("score", cosine(p))
        names = moment_names([p])
        agg = per.groupBy("panel", "months").agg(
            *[F.sum(n).alias(n) for n in names],
            F.count(F.lit(1)).alias("seen"),
            F.stddev_pop("score").alias("month_std"),
            F.percentile("score", F.lit(0.25)).alias("month_q25"),
            F.min("score").alias("month_worst"),
        )
        full = c("seen") == c("months")
        only = lambda x: F.when(full, x)
        parts.append(
            agg.select(
                "panel",
                F.lit(p).alias("name"),
                (c("months") - c("seen")).alias("missing_months"),
                only(cosine(p)).alias("score"),
                *[only(c(k)).alias(k) for k in ("month_std", "month_q25", "month_worst")],
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


# temporal splits ---------------------------------------------------------------------------------

# Fixed values: (train end, first and last early-stopping month) of the five folds at origin 70.
FOLDS = ((37, 40, 44), (47, 50, 54), (52, 55, 59), (57, 60, 64), (62, 65, 70))


def jobs(spark, arms, seeds, origins):
    """Arm x seed x fold x origin with month bounds; origins: [(origin, score start, score end)]."""
    if len(set(arms)) != len(arms) or len(set(seeds)) != len(seeds):
        raise ValueError("duplicate arms or seeds")
    spans = sorted((a, b) for _, a, b in origins)
    if any(a > b for a, b in spans) or any(x[1] >= y[0] for x, y in zip(spans, spans[1:])):
        raise ValueError("score windows overlap or are empty")
    rows = [
        (arm, seed, fold, origin, end + origin - 70, lo + origin - 70, hi + origin - 70, a, b)
        for origin, a, b in origins
        for seed in seeds
        for fold, (end, lo, hi) in enumerate(FOLDS)
        for arm in arms
    ]
    return spark.createDataFrame(
        rows,
        "arm string, seed int, fold int, origin int, train_end int, es_start int, es_end int, "
        "score_start int, score_end int",
    )


def split_counts(label, plan):
    """Samples of each job in train, early-stopping and score windows, and leak checks.

    Month counts are joined to the jobs, so the label table is read once.
    """
    counts = label.groupBy(MONTH).agg(F.count(F.lit(1)).alias("n"))
    m = c(MONTH)
    masks = {
        "train": (m >= 0) & (m <= c("train_end")),
        "early": (m >= c("es_start")) & (m <= c("es_end")),
        "score": (m >= c("score_start")) & (m <= c("score_end")),
    }
    t = plan.crossJoin(F.broadcast(counts))  # jobs x months, both fixed in size
    keys = ["arm", "seed", "fold", "origin"]
    s = t.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(x, c("n"))), F.lit(0)).alias(k) for k, x in masks.items()],
        F.coalesce(F.sum(F.when((masks["train"] | masks["early"]) & masks["score"], c("n"))), F.lit(0)).alias("leak"),
        F.max((c("train_end") >= c("es_start") - 1) | (c("es_end") > c("origin")) | (c("score_start") <= c("origin"))).alias(
            "broken_embargo"
        ),
    )
    return s.withColumn("valid", (c("train") > 0) & (c("early") > 0) & (c("score") > 0) & (c("leak") == 0) & ~c("broken_embargo"))
