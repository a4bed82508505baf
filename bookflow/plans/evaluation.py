"""Scoring, ensembles and temporal splits with their check SQL."""

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..sources.adapters import predictions
from .registry import present, register
from .sql import cols, query

SCOPE = ("scope", "month")


def moment_sql(preds):
    out = {"n": "count(*)", "y": "sum(target)", "yy": "sum(target * target)"}
    for p in preds:
        out |= {f"{p}_s": f"sum({p})", f"{p}_ss": f"sum({p} * {p})", f"{p}_sy": f"sum({p} * target)"}
    return out


def scope_steps(preds, source="pr", without=66):
    m = cols(moment_sql(preds))
    return [
        f"""sc AS (SELECT 'overall' AS scope, -1 AS month, {m} FROM {source} UNION ALL SELECT 'month', month, {m} FROM {source} GROUP BY month
        UNION ALL SELECT 'without', -1, {m} FROM {source} WHERE month <> {without}
        UNION ALL SELECT 'lomo', x.month, {m} FROM {source} p JOIN (SELECT DISTINCT month FROM {source}) x ON p.month <> x.month GROUP BY x.month)"""
    ]


def cosine_sql(p):
    return f"({p}_sy / sqrt({p}_ss * yy))"


def pearson_sql(p):
    xx, yy = f"({p}_ss - {p}_s * {p}_s / n)", "(yy - y * y / n)"
    return f"CASE WHEN {xx} > 1e-12 * {p}_ss AND {yy} > 1e-12 * yy THEN ({p}_sy - {p}_s * y / n) / sqrt({xx} * {yy}) ELSE 0 END"


@register(
    "month_moments",
    query(["pr"], f"SELECT month, {cols(moment_sql(['pred_a', 'pred_b']))} FROM pr GROUP BY month", keys=("month",)),
)
def month_moments(spark, path):
    return present(ev.moments(predictions(spark, path), ["pred_a", "pred_b"]), ("month",))


@register(
    "score_panel",
    query(
        ["pr"],
        f"""SELECT scope, month, n, {cosine_sql('pred_a')} AS cosine, {pearson_sql('pred_a')} AS pearson, pred_a_s / n AS prediction_mean,
        sqrt(greatest(pred_a_ss / n - pow(pred_a_s / n, 2), 0)) AS prediction_std FROM sc""",
        keys=SCOPE,
        steps=scope_steps(["pred_a"]),
    ),
)
def score_panel(spark, path):
    return present(ev.panel(predictions(spark, path), "pred_a"), SCOPE)


@register(
    "panel_summary",
    query(
        ["pr"],
        """SELECT 0 AS k, max(s) FILTER (WHERE scope = 'overall') AS overall, min(s) FILTER (WHERE scope = 'month') AS worst_score,
        first(month ORDER BY s, month) FILTER (WHERE scope = 'month') AS worst_month, max(s) FILTER (WHERE scope = 'without') AS without,
        min(s) FILTER (WHERE scope = 'lomo') AS lomo_min, avg(s) FILTER (WHERE scope = 'month') AS month_mean FROM s0""",
        keys=("k",),
        steps=scope_steps(["pred_a"]) + [f"s0 AS (SELECT scope, month, {cosine_sql('pred_a')} AS s FROM sc)"],
    ),
)
def panel_summary(spark, path):
    return present(ev.panel_summary(predictions(spark, path), "pred_a").selectExpr("0 AS k", "*"), ("k",))


PAIRED = scope_steps(["pred_a", "pred_b"]) + [
    f"pp AS (SELECT scope, month, {cosine_sql('pred_a')} AS base, {cosine_sql('pred_b')} AS candidate FROM sc)"
]


@register(
    "paired_panel",
    query(["pr"], "SELECT scope, month, base, candidate, candidate - base AS delta FROM pp", keys=SCOPE, steps=PAIRED),
)
def paired_panel(spark, path):
    return present(ev.paired_panel(predictions(spark, path), "pred_a", "pred_b"), SCOPE)


@register(
    "month_bootstrap",
    query(
        ["pr"],
        "SELECT 0 AS k, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM dr",
        keys=("k",),
        steps=[
            f"mm AS (SELECT month, {cols(moment_sql(['pred_a', 'pred_b']))}, row_number() OVER (ORDER BY month) - 1 AS pick FROM pr GROUP BY month)",
            """pk AS (SELECT draw, (floor((((draw * 7919 + slot * 104729 + 17) * 1103515245 + 12345) & 2147483647) / 65536)::BIGINT) % m AS pick
            FROM (SELECT unnest(range(1000)) AS draw), (SELECT m, unnest(range(m)) AS slot FROM (SELECT count(*) AS m FROM mm)))""",
            "ds AS (SELECT draw, " + ", ".join(f"sum({n}) AS {n}" for n in moment_sql(["pred_a", "pred_b"])) + " FROM pk JOIN mm USING (pick) GROUP BY draw)",
            f"dr AS (SELECT {cosine_sql('pred_b')} - {cosine_sql('pred_a')} AS d FROM ds)",
        ],
    ),
)
def month_bootstrap(spark, path):
    out = ev.bootstrap_interval(predictions(spark, path), "pred_a", "pred_b")
    return present(out.selectExpr("0 AS k", "*"), ("k",))


@register(
    "compare_runs",
    query(["pr"], "SELECT scope, month, base, candidate, candidate - base AS delta FROM pp", keys=SCOPE, steps=PAIRED),
)
def compare_runs(spark, path):
    p = predictions(spark, path)
    side = lambda n: p.select("sample_id", "month", "target", F.col(n).alias("prediction"))
    return present(ev.compare_runs(side("pred_a"), side("pred_b")), SCOPE)


@register(
    "promotion_gates",
    query(
        ["pr"],
        """SELECT 0 AS k, delta, positive_months, lomo_min, (delta >= -1)::INT AS gain, (positive_months >= 3)::INT AS months,
        (lomo_min > 0)::INT AS lomo, (delta >= -1 AND positive_months >= 3 AND lomo_min > 0)::INT AS passed FROM
        (SELECT max(candidate - base) FILTER (WHERE scope = 'overall') AS delta, count(*) FILTER (WHERE scope = 'month' AND candidate > base)
        AS positive_months, min(candidate - base) FILTER (WHERE scope = 'lomo') AS lomo_min FROM pp)""",
        keys=("k",),
        steps=PAIRED,
    ),
)
def promotion_gates(spark, path):
    g = ev.promotion_gates(ev.paired_panel(predictions(spark, path), "pred_a", "pred_b"), -1.0, 3)
    return present(g.selectExpr("0 AS k", "*"), ("k",))


def long_predictions(spark, path):
    """Predictions of 2 arms x 2 seeds x 5 folds in long form; arm b lacks a third of seed 2."""
    p = predictions(spark, path)
    models = F.array(
        *[
            F.struct(
                F.lit(a).alias("arm"), F.lit(s).alias("seed"), F.lit(f).alias("fold"),
                (F.col(f"pred_{a}") + 0.01 * s * (F.col("sample_id") % 7) + 0.005 * f * (F.col("sample_id") % 5)).alias("pred"),
            )
            for a in "ab" for s in (1, 2) for f in range(5)
        ]
    )
    out = p.select("sample_id", "month", "target", F.explode(models).alias("_m")).select("sample_id", "month", "target", "_m.*")
    return out.filter(~((F.col("arm") == "b") & (F.col("seed") == 2) & (F.col("sample_id") % 3 == 0)))


LONG = """lp AS (SELECT sample_id, month, target, arm, seed, fold, CASE WHEN arm = 'a' THEN pred_a ELSE pred_b END
  + 0.01::DOUBLE * seed * (sample_id % 7) + 0.005::DOUBLE * fold * (sample_id % 5) AS pred FROM pr CROSS JOIN (VALUES ('a'), ('b')) x(arm)
  CROSS JOIN (VALUES (1), (2)) y(seed) CROSS JOIN range(5) z(fold) WHERE NOT (arm = 'b' AND seed = 2 AND sample_id % 3 = 0))"""


@register(
    "prediction_mean",
    query(
        ["pr"],
        "SELECT arm, sample_id, avg(pred) AS pred, count(*) AS models FROM lp GROUP BY arm, sample_id",
        keys=("arm", "sample_id"),
        steps=[LONG],
    ),
)
def prediction_mean(spark, path):
    out = ev.prediction_mean(long_predictions(spark, path), ["seed", "fold"], ["arm"])
    return present(out, ("arm", "sample_id"))


@register(
    "ensemble_coverage",
    query(
        ["pr"],
        """SELECT arm, count(*) AS rows, count(*) FILTER (WHERE models < 10) AS short, count(*) FILTER (WHERE models > 10) AS over FROM
        (SELECT arm, sample_id, count(*) AS models FROM lp GROUP BY arm, sample_id) GROUP BY arm""",
        keys=("arm",),
        steps=[LONG],
    ),
)
def ensemble_coverage(spark, path):
    mean = ev.prediction_mean(long_predictions(spark, path), ["seed", "fold"], ["arm"])
    return present(ev.coverage(mean, 10, ["arm"]), ("arm",))


@register(
    "arm_scores",
    query(
        ["pr"],
        """SELECT arm, sum(p * target) / sqrt(sum(p * p) * sum(target * target)) AS cosine, count(*) AS n FROM
        (SELECT arm, sample_id, any_value(target) AS target, avg(pred) AS p FROM lp GROUP BY arm, sample_id) GROUP BY arm""",
        keys=("arm",),
        steps=[LONG],
    ),
)
def arm_scores(spark, path):
    mean = ev.prediction_mean(long_predictions(spark, path), ["seed", "fold"], ["arm"])
    scored = mean.join(predictions(spark, path).select("sample_id", "target"), "sample_id")
    m = ev.moments(scored, ["pred"], ("arm",))
    return present(m.select("arm", ev.cosine("pred").alias("cosine"), "n"), ("arm",))


NODATA = "sample_id % 11 = 0"
BOUNDS = "bd AS (SELECT quantile_cont(pred_a, 0.05) AS lo, quantile_cont(pred_a, 0.9) AS hi FROM pr WHERE month < 40)"


@register(
    "postprocess",
    query(
        ["pr"],
        f"SELECT sample_id, 1000 * CASE WHEN {NODATA} THEN 0 ELSE greatest(least(pred_a, hi), lo) END AS pred FROM pr, bd",
        steps=[BOUNDS],
    ),
)
def postprocess(spark, path):
    p = predictions(spark, path).withColumn("nodata", F.expr(NODATA))
    b = ev.clip_bounds(p.filter("month < 40"), "pred_a", 0.05, 0.9)
    return present(ev.postprocess(p, "pred_a", b, "nodata").select("sample_id", (F.col("pred") * 1000).alias("pred")))


@register(
    "postprocess_ablation",
    query(
        ["pr"],
        "SELECT scope, "
        + ", ".join(f"{cosine_sql('v_' + n)} AS v_{n}" for n in ("raw", "clip", "zero", "both"))
        + ", (SELECT avg((v_clip <> v_raw)::INT) FROM vv) AS changed_clip, (SELECT avg((v_zero <> v_raw)::INT) FROM vv) AS changed_zero, "
        "(SELECT avg((v_both <> v_raw)::INT) FROM vv) AS changed_both FROM sc WHERE scope IN ('overall', 'without')",
        keys=("scope",),
        steps=[
            BOUNDS,
            f"""vv AS (SELECT *, pred_a AS v_raw, greatest(least(pred_a, hi), lo) AS v_clip, CASE WHEN {NODATA} THEN 0 ELSE pred_a END AS v_zero,
            CASE WHEN {NODATA} THEN 0 ELSE greatest(least(pred_a, hi), lo) END AS v_both FROM pr, bd)""",
        ]
        + scope_steps(["v_raw", "v_clip", "v_zero", "v_both"], "vv"),
    ),
)
def postprocess_ablation(spark, path):
    p = predictions(spark, path).withColumn("nodata", F.expr(NODATA))
    b = ev.clip_bounds(p.filter("month < 40"), "pred_a", 0.05, 0.9)
    return present(ev.postprocess_ablation(p, "pred_a", b, "nodata"), ("scope",))


@register(
    "recency_ensemble",
    query(
        ["pr"],
        "SELECT sample_id, arm, CASE WHEN count(*) = 10 THEN avg(pred) END AS base, CASE WHEN count(*) = 10 THEN sum(pred * w / 2) END AS recency, "
        "count(*) AS models, (count(*) = 10)::INT AS complete FROM lp JOIN w USING (fold) GROUP BY sample_id, arm",
        keys=("sample_id", "arm"),
        steps=[
            LONG,
            """w AS (SELECT fold, pow(2, (e - 62) / 20.0::DOUBLE) / sum(pow(2, (e - 62) / 20.0::DOUBLE)) OVER () AS w FROM
            (VALUES (0, 37), (1, 47), (2, 52), (3, 57), (4, 62)) f(fold, e))""",
        ],
    ),
)
def recency_ensemble(spark, path):
    folds = spark.createDataFrame([(i, f[0]) for i, f in enumerate(ev.FOLDS)], "fold int, train_end int")
    out = ev.recency_ensemble(long_predictions(spark, path), folds, 20, by=("arm",), incomplete="report")
    return present(out, ("sample_id", "arm"))


def _month_scores(spark, path):
    p = predictions(spark, path)
    t = ev.moments(p, ["pred_a", "pred_b"])
    return t.select(
        F.col("month").alias("name"), (F.col("month") % 4).alias("group"), ev.cosine("pred_a").alias("a"), ev.cosine("pred_b").alias("b"),
        ev.pearson("pred_a").alias("c"),
    )


@register(
    "pareto_front",
    query(
        ["pr"],
        """SELECT name, "group", a, b, c, (NOT EXISTS (SELECT 1 FROM ms o WHERE o."group" = ms."group" AND o.name <> ms.name
        AND o.a - ms.a >= -1e-12 AND o.b - ms.b >= -1e-12 AND o.c - ms.c >= -1e-12
        AND (o.a - ms.a > 1e-12 OR o.b - ms.b > 1e-12 OR o.c - ms.c > 1e-12)))::INT AS nondominated FROM ms""",
        keys=("name", '"group"'),
        steps=[
            f"mm AS (SELECT month, {cols(moment_sql(['pred_a', 'pred_b']))} FROM pr GROUP BY month)",
            f"""ms AS (SELECT month AS name, month % 4 AS "group", {cosine_sql('pred_a')} AS a, {cosine_sql('pred_b')} AS b, {pearson_sql('pred_a')} AS c FROM mm)""",
        ],
    ),
)
def pareto_front(spark, path):
    return present(ev.pareto(_month_scores(spark, path), ["a", "b", "c"]), ("name", "group"))


PANELS = {"early": (0, 29), "middle": (30, 59), "late": (60, 79), "open": (70, 95)}


def _window_panels_sql():
    parts = []
    for name, (a, b) in PANELS.items():
        for p in ("pred_a", "pred_b"):
            n = b - a + 1
            score = f"sum({p}_sy) / sqrt(sum({p}_ss) * sum(yy))"
            only = lambda x: f"CASE WHEN count(*) = {n} THEN {x} END"
            s = cosine_sql(p)
            parts.append(
                f"SELECT '{name}' AS panel, '{p}' AS name, {n} - count(*) AS missing_months, {only(score)} AS score, "
                f"{only(f'stddev_pop({s})')} AS month_std, {only(f'quantile_cont({s}, 0.25)')} AS month_q25, {only(f'min({s})')} AS month_worst "
                f"FROM mm WHERE month BETWEEN {a} AND {b}"
            )
    return query(
        ["pr"], " UNION ALL ".join(parts), keys=("panel", "name"),
        steps=[f"mm AS (SELECT month, {cols(moment_sql(['pred_a', 'pred_b']))} FROM pr GROUP BY month)"],
    )


@register("window_panels", _window_panels_sql())
def window_panels(spark, path):
    return present(ev.window_panels(predictions(spark, path), ["pred_a", "pred_b"], PANELS), ("panel", "name"))


ORIGINS = [(59, 62, 66), (64, 67, 70)]


@register(
    "split_counts",
    query(
        ["pr"],
        """SELECT arm, seed, fold, origin, coalesce(sum(n) FILTER (WHERE month BETWEEN 0 AND te), 0) AS train,
        coalesce(sum(n) FILTER (WHERE month BETWEEN es AND ee), 0) AS early, coalesce(sum(n) FILTER (WHERE month BETWEEN ss AND se), 0) AS score,
        coalesce(sum(n) FILTER (WHERE month BETWEEN ss AND se AND (month BETWEEN 0 AND te OR month BETWEEN es AND ee)), 0) AS leak,
        max((te >= es - 1 OR ee > origin OR ss <= origin)::INT) AS broken_embargo, 1 AS valid FROM jb, mc GROUP BY ALL""",
        keys=("arm", "seed", "fold", "origin"),
        steps=[
            "mc AS (SELECT month, count(*) AS n FROM pr GROUP BY month)",
            """jb AS (SELECT arm, seed, fold, origin, e + origin - 70 AS te, lo + origin - 70 AS es, hi + origin - 70 AS ee, ss, se FROM
            (VALUES (0, 37, 40, 44), (1, 47, 50, 54), (2, 52, 55, 59), (3, 57, 60, 64), (4, 62, 65, 70)) f(fold, e, lo, hi)
            CROSS JOIN (VALUES (59, 62, 66), (64, 67, 70)) o(origin, ss, se) CROSS JOIN (VALUES ('base'), ('flow')) a(arm) CROSS JOIN (VALUES (1), (2)) s(seed))""",
        ],
    ),
)
def split_counts(spark, path):
    plan = ev.jobs(spark, ["base", "flow"], [1, 2], ORIGINS)
    return present(ev.split_counts(predictions(spark, path), plan), ("arm", "seed", "fold", "origin"))
