"""Preprocessing, drift and blending with their check SQL."""

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import blend, columns, drift, preprocess
from ..sources.adapters import predictions
from .registry import present, register
from .sql import clip, cols, query

KEY_MONTH = ("sample_id", "month")
FEATURES = ["pred_a", "pred_b", "gap", "holey"]

FT = """ft AS (SELECT *, pred_a - pred_b AS gap, CASE WHEN sample_id % 7 = 0 THEN NULL ELSE pred_a * pred_a END AS holey,
  abs(pred_a) + abs(pred_b) AS vol FROM pr)"""


def features(spark, path):
    c = F.col
    return predictions(spark, path).withColumns(
        {
            "gap": c("pred_a") - c("pred_b"),
            "holey": F.when(c("sample_id") % 7 != 0, c("pred_a") * c("pred_a")),
            "vol": F.abs("pred_a") + F.abs("pred_b"),
        }
    )


def poly(cs, x):
    out = repr(cs[0]) + "::DOUBLE"
    for k in cs[1:]:
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def normal_sql(p):
    P = preprocess
    r = f"({p} - 0.5)"
    tail = lambda q: f"({poly(P._C, q)} / {poly((*P._D, 1.0), q)})"
    mid = f"({poly(P._A, f'({r} * {r})')} * {r} / {poly((*P._B, 1.0), f'({r} * {r})')})"
    return (
        f"CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 0.97575 THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} "
        f"ELSE {mid} END"
    )


RS = {n: f"r_{n}" for n in ("pred_a", "pred_b")}


@register(
    "robust_scale",
    query(
        ["pr"],
        "SELECT sample_id, " + cols({n: f"{r} / sqrt(1 + pow({r} / 3, 2))" for n, r in RS.items()}) + " FROM z",
        steps=[
            "st AS (SELECT " + ", ".join(f"quantile_cont({n}, 0.25) AS l_{n}, quantile_cont({n}, 0.5) AS m_{n}, quantile_cont({n}, 0.75) AS h_{n}" for n in RS) + " FROM pr WHERE month < 40)",
            "z AS (SELECT sample_id, " + ", ".join(f"({n} - m_{n}) / (h_{n} - l_{n} + 1e-30) AS {r}" for n, r in RS.items()) + " FROM pr, st)",
        ],
    ),
)
def robust_scale(spark, path):
    p = predictions(spark, path)
    return present(preprocess.robust_scale(p, list(RS), p.filter("month < 40")).select("sample_id", *RS))


@register(
    "normal_scores",
    query(
        ["pr"],
        f"SELECT sample_id, {normal_sql('p')} AS holey_score, (x0 IS NULL)::INT AS holey_missing FROM pp",
        steps=[
            FT,
            "kn AS (SELECT quantile_cont(holey, [i / 100.0::DOUBLE FOR i IN range(101)]) AS k FROM ft WHERE month < 40)",
            "x1 AS (SELECT sample_id, holey AS x0, coalesce(holey, k[51]) AS x, k FROM ft, kn)",
            "x2 AS (SELECT *, len(list_filter(k, lambda v: v < x)) AS b, len(list_filter(k, lambda v: v <= x)) AS u FROM x1)",
            """x3 AS (SELECT *, CASE WHEN u > b THEN (b + u - 1) / 2.0::DOUBLE WHEN b = 0 THEN 0 WHEN b = 101 THEN 100
              ELSE b - 1 + (x - k[b]) / (k[b + 1] - k[b]) END / 100.0::DOUBLE AS q FROM x2)""",
            "pp AS (SELECT *, greatest(least(q, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS p FROM x3)",
        ],
    ),
)
def normal_scores(spark, path):
    p = features(spark, path)
    out = preprocess.normal_scores(p, "holey", p.filter("month < 40"), 101)
    return present(out.select("sample_id", "holey_score", "holey_missing"))


@register(
    "vector_forms",
    query(
        ["pr"],
        """SELECT sample_id, pred_a - m AS centred, pred_a / nrm AS unit, (pred_a - m) / cn AS centred_unit, pred_a / (nrm / sqrt(k)) AS rms FROM pr,
        (SELECT avg(pred_a) AS m, sqrt(sum(pred_a * pred_a)) AS nrm, sqrt(var_pop(pred_a) * count(*)) AS cn, count(*) AS k FROM pr)""",
    ),
)
def vector_forms(spark, path):
    out = preprocess.vector_forms(predictions(spark, path), "pred_a")
    return present(out.select("sample_id", "centred", "unit", "centred_unit", "rms"))


def average_rank_sql(x, part=""):
    over = f"PARTITION BY {part} " if part else ""
    return (
        f"(rank() OVER ({over}ORDER BY {x}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{x}) - 1) / 2.0::DOUBLE)"
    )


@register(
    "shape_transforms",
    query(
        ["pr"],
        "SELECT sample_id, "
        + ", ".join(f"greatest(least(x, h{k}), l{k}) AS winsor_{k}" for k in ("001", "005", "01", "02"))
        + f""", sign(x) * pow(abs(x), 0.75) AS power_075, sign(x) * pow(abs(x), 1.25) AS power_125, u - 0.5 AS rank_uniform,
        {normal_sql('greatest(least(u, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)')} AS rank_normal FROM rk, q""",
        steps=[
            f"rk AS (SELECT sample_id, pred_b AS x, ({average_rank_sql('pred_b')} - 0.5) / count(*) OVER () AS u FROM pr)",
            "q AS (SELECT "
            + ", ".join(f"quantile_cont(pred_b, {v}) AS l{k}, quantile_cont(pred_b, {1 - v}) AS h{k}" for k, v in {"001": 0.001, "005": 0.005, "01": 0.01, "02": 0.02}.items())
            + " FROM pr)",
        ],
    ),
)
def shape_transforms(spark, path):
    out = preprocess.shape_transforms(predictions(spark, path), "pred_b")
    names = [f"winsor_{k}" for k in ("001", "005", "01", "02")] + ["power_075", "power_125", "rank_uniform", "rank_normal"]
    return present(out.select("sample_id", *names))


# columns with many ties: rounded predictions
TIED = """td AS (SELECT sample_id, month, round(pred_a, 2) AS x, CASE WHEN sample_id % 7 = 0 THEN NULL ELSE round(pred_b, 1) END AS y FROM pr)"""


def tied(spark, path):
    c = F.col
    return predictions(spark, path).select(
        "sample_id", "month", F.round("pred_a", 2).alias("x"), F.when(c("sample_id") % 7 != 0, F.round("pred_b", 1)).alias("y")
    )


def _group_ranks_sql():
    out, pre = {}, {}
    for n in ("x", "y"):
        pre[f"r_{n}"] = f"CASE WHEN {n} IS NOT NULL THEN {average_rank_sql(n, f'month, ({n} IS NULL)')} END"
        pre[f"k_{n}"] = f"count({n}) OVER (PARTITION BY month)"
        pre[f"m_{n}"] = f"avg({n}) OVER (PARTITION BY month)"
        pre[f"s_{n}"] = f"greatest(stddev_pop({n}) OVER (PARTITION BY month), 1e-8)"
        out |= {
            f"{n}_pct": f"r_{n} / k_{n}", f"{n}_rank": f"coalesce(2 * r_{n} / (k_{n} + 1) - 1, 0)",
            f"{n}_z": f"CASE WHEN {n} IS NULL THEN 0 ELSE {clip(f'({n} - m_{n}) / s_{n}', -10, 10)} END",
        }
    return query(["pr"], f"SELECT sample_id, month, {cols(out)} FROM rr", keys=KEY_MONTH, steps=[TIED, f"rr AS (SELECT *, {cols(pre)} FROM td)"])


@register("group_ranks", _group_ranks_sql())
def group_ranks(spark, path):
    out = preprocess.group_ranks(tied(spark, path), ["x", "y"])
    return present(out.drop("x", "y"), KEY_MONTH)


def _cross_section_sql(group):
    names = ("pred_a", "pred_b", "gap")
    out = {f"{n}_pct": f"(row_number() OVER (PARTITION BY {group} ORDER BY {n}, sample_id) - 1) / greatest(count(*) OVER (PARTITION BY {group}) - 1, 1) - 0.5" for n in names}
    out["pred_a_z"] = f"(pred_a - avg(pred_a) OVER (PARTITION BY {group})) / (stddev_pop(pred_a) OVER (PARTITION BY {group}) + 1e-8)"
    for i, n in enumerate(names):
        less = " + ".join(f"({m} < {n} OR ({m} = {n} AND {j} < {i}))::INT" for j, m in enumerate(names) if m != n)
        out[f"{n}_row"] = f"({less}) / 2 - 0.5"
    return f"SELECT sample_id, month, {cols(out)} FROM "


@register("cross_section", query(["pr"], _cross_section_sql("month") + "ft", keys=KEY_MONTH, steps=[FT]))
def cross_section(spark, path):
    names = ["pred_a", "pred_b", "gap"]
    out = preprocess.cross_section(features(spark, path).select("sample_id", "month", *names), names, ["pred_a"])
    return present(out.drop(*names), KEY_MONTH)


@register(
    "cross_section_blocks",
    query(
        ["pr"],
        _cross_section_sql("block") + "(SELECT *, floor((row_number() OVER (ORDER BY sample_id) - 1) * 6 / count(*) OVER ()) AS block FROM ft)",
        keys=KEY_MONTH,
        steps=[FT],
    ),
)
def cross_section_blocks(spark, path):
    names = ["pred_a", "pred_b", "gap"]
    rows = preprocess.equal_blocks(features(spark, path).select("sample_id", "month", *names), 6)
    out = preprocess.cross_section(rows, names, ["pred_a"], ("block",))
    return present(out.drop(*names, "block"), KEY_MONTH)


@register("cross_section_pooled", query(["pr"], _cross_section_sql("one") + "(SELECT *, 1 AS one FROM ft)", keys=KEY_MONTH, steps=[FT]))
def cross_section_pooled(spark, path):
    names = ["pred_a", "pred_b", "gap"]
    rows = features(spark, path).select("sample_id", "month", *names).withColumn("one", F.lit(1))
    out = preprocess.cross_section(rows, names, ["pred_a"], ("one",))
    return present(out.drop(*names, "one"), KEY_MONTH)


@register(
    "centring_variants",
    query(
        ["pr"],
        """SELECT sample_id, pred_a - avg(pred_a) OVER () AS global_centred, pred_a - avg(pred_a) OVER (PARTITION BY month) AS month_centred,
        pred_a - avg(pred_a) OVER (PARTITION BY b) AS block_centred FROM
        (SELECT *, floor((row_number() OVER (ORDER BY sample_id) - 1) * 6 / count(*) OVER ()) AS b FROM pr)""",
    ),
)
def centring_variants(spark, path):
    out = blend.centring_variants(predictions(spark, path), "pred_a")
    return present(out.select("sample_id", "global_centred", "month_centred", "block_centred"))


@register(
    "target_transforms",
    query(
        ["pr"],
        """SELECT sample_id, month, 1000 * greatest(least(target, hi), lo) AS winsor, 1000 * greatest(least(target, ab), -ab) AS symmetric, rk AS month_rank,
        0.75 * target + 0.25 * rk AS rank_mix, target / greatest(least(vol / med, 2), 0.5) AS vol_scaled FROM t1, q""",
        keys=KEY_MONTH,
        steps=[
            FT,
            """q AS (SELECT quantile_cont(target, 0.005) AS lo, quantile_cont(target, 0.995) AS hi, quantile_cont(abs(target), 0.995) AS ab,
            quantile_cont(vol, 0.5) AS med FROM ft WHERE month < 40)""",
            f"t1 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY month) > 1 THEN 2 * ({average_rank_sql('target', 'month')} - 1) / (count(*) OVER (PARTITION BY month) - 1) - 1 ELSE 0 END AS rk FROM ft)",
        ],
    ),
)
def target_transforms(spark, path):
    p = features(spark, path)
    out = preprocess.target_transforms(p, p.filter("month < 40"), "vol")
    out = out.withColumns({n: F.col(n) * 1000 for n in ("winsor", "symmetric")})
    return present(out.select("sample_id", "month", "winsor", "symmetric", "month_rank", "rank_mix", "vol_scaled"), KEY_MONTH)


@register(
    "sample_weights",
    query(
        ["pr"],
        """SELECT sample_id, 0.5 + 0.5 * month / 79 AS w_ramp, CASE WHEN abs(target) > 0.05 THEN 1 ELSE 0.5 END AS w_size,
        least(d, cap) / avg(least(d, cap)) OVER () AS w_density FROM (SELECT *, p / (1 - p) AS d FROM (SELECT *, 1 / (1 + exp(-pred_a)) AS p FROM pr)),
        (SELECT quantile_cont(exp(pred_a), 0.99) AS cap FROM pr)""",
    ),
)
def sample_weights(spark, path):
    p = predictions(spark, path).withColumn("p", 1 / (1 + F.exp(-F.col("pred_a"))))
    out = preprocess.sample_weights(p, 0, 79, "p", 0.05)
    return present(out.select("sample_id", "w_ramp", "w_size", "w_density"))


# drift -------------------------------------------------------------------------------------------

STACK = """lo AS (SELECT sample_id, month, feature, value FROM (SELECT sample_id, month, unnest(['pred_a', 'pred_b', 'gap', 'holey']) AS feature,
  unnest([pred_a, pred_b, gap, holey]) AS value FROM ft))"""
PSI = [
    "ed AS (SELECT feature, list_distinct(quantile_cont(value, [i / 10.0::DOUBLE FOR i IN range(11)])) AS e FROM lo WHERE month < 40 GROUP BY feature)",
    "ed2 AS (SELECT feature, list_sort(e)[2:len(e) - 1] AS e FROM ed)",
    """hb AS (SELECT feature, month < 40 AS ref, len(list_filter(e, lambda v: v <= value)) AS bin, count(*) AS n FROM lo JOIN ed2 USING (feature)
      WHERE value IS NOT NULL GROUP BY ALL)""",
    "hs AS (SELECT feature, ref, bin, n / sum(n) OVER (PARTITION BY feature, ref) AS s FROM hb)",
    """ps AS (SELECT feature, sum((o - r) * ln(o / r)) AS psi FROM (SELECT feature, bin, greatest(coalesce(max(s) FILTER (WHERE ref), 0), 1e-6) AS r,
      greatest(coalesce(max(s) FILTER (WHERE NOT ref), 0), 1e-6) AS o FROM (SELECT feature, unnest(range(len(e) + 1)) AS bin FROM ed2)
      LEFT JOIN hs USING (feature, bin) GROUP BY feature, bin) GROUP BY feature)""",
]


@register("population_stability", query(["pr"], "SELECT feature, psi FROM ps", keys=("feature",), steps=[FT, STACK, *PSI]))
def population_stability(spark, path):
    f = features(spark, path)
    return present(drift.psi(f.filter("month < 40"), f.filter("month >= 40"), FEATURES), ("feature",))


def _drift_sql(months=None):
    z = "abs((coalesce(value, med) - mu) / CASE WHEN sd >= 1e-6 THEN sd ELSE 1 END)"
    q = lambda p: f"quantile_cont(value, {p})"
    return query(
        ["pr"],
        """SELECT feature, psi, shift AS median_shift_iqr, mshift AS mean_shift_std, CASE WHEN abs(r75 - r25) > 1e-12 THEN (o75 - o25) / (r75 - r25) END AS iqr_ratio,
        rmiss AS reference_missing, omiss AS other_missing, o5 AS abs_z_gt_5_rate, o10 AS abs_z_gt_10_rate,
        coalesce(psi, 0) + least(shift, 10) * 0.25 + least(mshift, 10) * 0.25 + abs(omiss - rmiss) * 5 + least(o10, 0.2) * 5 AS drift_score FROM
        (SELECT *, abs(o50 - r50) / greatest(abs(r75 - r25), sd * 0.05, 1e-12) AS shift, abs(oavg - ravg) / greatest(sd, 1e-12) AS mshift FROM
        rs JOIN os USING (feature) JOIN ps USING (feature) JOIN sl USING (feature))""",
        keys=("feature",),
        steps=[FT, STACK if months is None else STACK.replace("FROM ft)", f"FROM ft WHERE month < 40 OR month BETWEEN {months[0]} AND {months[1]})"), *PSI]
        + [
            "sl AS (SELECT feature, quantile_cont(value, 0.5) AS med, avg(value) AS mu, stddev_pop(value) AS sd FROM lo WHERE month < 40 GROUP BY feature)",
            f"rs AS (SELECT feature, {q(0.25)} AS r25, {q(0.5)} AS r50, {q(0.75)} AS r75, avg(value) AS ravg, avg((value IS NULL)::INT) AS rmiss FROM lo WHERE month < 40 GROUP BY feature)",
            f"""os AS (SELECT feature, {q(0.25)} AS o25, {q(0.5)} AS o50, {q(0.75)} AS o75, avg(value) AS oavg, avg((value IS NULL)::INT) AS omiss,
              avg(({z} > 5)::INT) AS o5, avg(({z} > 10)::INT) AS o10 FROM lo JOIN sl USING (feature) WHERE month >= 40 GROUP BY feature)""",
        ],
    )


@register("drift_report", _drift_sql())
def drift_report(spark, path):
    f = features(spark, path)
    return present(drift.drift_report(f.filter("month < 40"), f.filter("month >= 40"), FEATURES), ("feature",))


DRIFT_WINDOWS = [(40, 47), (48, 55), (56, 63), (64, 71), (72, 99)]


@register("drift_windows", " UNION ALL ".join(f"SELECT 'm{a}' AS \"window\", * FROM ({_drift_sql((a, b))})" for a, b in DRIFT_WINDOWS))
def drift_windows(spark, path):
    f = features(spark, path)
    windows = {f"m{a}": f.filter(F.col("month").between(a, b)) for a, b in DRIFT_WINDOWS}
    return present(drift.drift_windows(f.filter("month < 40"), windows, FEATURES), ("window", "feature"))


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@register(
    "correlation_pairs",
    query(
        ["pr"],
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM ft" for a, b in PAIRS),
        keys=("a", "b"),
        steps=[FT],
    ),
)
def correlation_pairs(spark, path):
    return present(drift.correlation_pairs(features(spark, path), FEATURES), ("a", "b"))


def _pruned(spark, path):
    f = features(spark, path).withColumn("copy", F.col("pred_a") * 2 + 1)
    names = ["pred_a", "pred_b", "gap", "holey", "copy"]
    gains = {"pred_a": 5.0, "copy": 9.0, "gap": 1.0, "pred_b": 3.0}
    return drift.prune_correlated(drift.correlation_matrix(f, names), names, gains, 0.9)


@register(
    "correlation_prune",
    query(
        ["pr"],
        """SELECT * FROM (WITH RECURSIVE k AS (SELECT 1 AS i, ['copy'] AS kept UNION ALL SELECT i + 1,
        CASE WHEN (SELECT coalesce(max(abs(r)), 0) FROM cm WHERE a = nm[i + 1] AND list_contains(k.kept, b)) >= 0.9 THEN kept
          ELSE list_append(kept, nm[i + 1]) END FROM k, (SELECT ['copy', 'pred_a', 'pred_b', 'gap', 'holey'] AS nm) WHERE i < 5)
        SELECT x AS feature, 1 AS kept FROM (SELECT unnest(kept) AS x FROM k WHERE i = 5))""",
        keys=("feature",),
        steps=[
            FT,
            "f5 AS (SELECT pred_a, pred_b, gap, holey, pred_a * 2 + 1 AS copy FROM ft)",
            "cm AS ("
            + " UNION ALL ".join(
                f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM f5" for a in ("pred_a", "pred_b", "gap", "holey", "copy")
                for b in ("pred_a", "pred_b", "gap", "holey", "copy") if a != b
            )
            + ")",
        ],
    ),
)
def correlation_prune(spark, path):
    kept, _ = _pruned(spark, path)
    return present(spark.createDataFrame([(n, 1) for n in kept], "feature string, kept int"), ("feature",))


@register(
    "pack_overlap",
    query(
        ["pr"],
        """SELECT feature, (constant)::INT AS constant, correlation, (reason = 'duplicate')::INT AS duplicate FROM (SELECT feature, constant, correlation,
        CASE WHEN constant THEN 'constant' WHEN correlation >= 0.999 THEN 'duplicate' ELSE 'keep' END AS reason FROM (
        SELECT 'scaled' AS feature, FALSE AS constant, greatest(abs(corr(pred_a * 3, pred_a)), abs(corr(pred_a * 3, pred_b))) AS correlation FROM pr
        UNION ALL SELECT 'other', FALSE, greatest(abs(corr(target * target, pred_a)), abs(corr(target * target, pred_b))) FROM pr
        UNION ALL SELECT 'flat', TRUE, 0))""",
        keys=("feature",),
    ),
)
def pack_overlap(spark, path):
    p = predictions(spark, path)
    right = p.select("sample_id", (F.col("pred_a") * 3).alias("scaled"), (F.col("target") * F.col("target")).alias("other"), F.lit(1.0).alias("flat"))
    out = drift.pack_overlap(p, right, ["pred_a", "pred_b"], ["scaled", "other", "flat"])
    return present(
        out.select("feature", F.col("constant").cast("int").alias("constant"), "correlation", (F.col("reason") == "duplicate").cast("int").alias("duplicate")),
        ("feature",),
    )


@register(
    "version_diff",
    query(
        ["pr"],
        """SELECT feature, corr(a, b) AS correlation, avg((NOT same)::INT) AS changed_fraction, avg(abs(a - b)) AS mean_absolute_change,
        avg((a IS NULL)::INT) AS old_missing, avg((b IS NULL)::INT) AS new_missing, avg(abs(a - b)) / (stddev_pop(a) FILTER (WHERE b IS NOT NULL) + 1e-12) AS normalized_mae,
        max(gs) AS gain_share, max(gs) * least(avg(abs(a - b)) / (stddev_pop(a) FILTER (WHERE b IS NOT NULL) + 1e-12), 5) * avg((NOT same)::INT) AS priority
        FROM (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN TRUE WHEN a IS NULL OR b IS NULL THEN FALSE ELSE abs(a - b) <= 1e-8 + 1e-5 * abs(b) END AS same FROM (
        SELECT 'pred_a' AS feature, 0.75 AS gs, pred_a AS a, CASE WHEN sample_id % 5 = 0 THEN pred_a * 1.1 ELSE pred_a END AS b FROM ft
        UNION ALL SELECT 'holey', 0.25, holey, CASE WHEN sample_id % 3 = 0 THEN NULL ELSE holey END FROM ft)) GROUP BY feature""",
        keys=("feature",),
        steps=[FT],
    ),
)
def version_diff(spark, path):
    old = features(spark, path).select("sample_id", "pred_a", "holey")
    c = F.col
    new = old.select(
        "sample_id",
        F.when(c("sample_id") % 5 == 0, c("pred_a") * 1.1).otherwise(c("pred_a")).alias("pred_a"),
        F.when(c("sample_id") % 3 != 0, c("holey")).alias("holey"),
    )
    return present(drift.version_diff(old, new, ["pred_a", "holey"], {"pred_a": 3.0, "holey": 1.0}), ("feature",))


@register(
    "boundary_scores",
    query(
        ["pr"],
        """SELECT sample_id, pos, sqrt((ga * ga + gb * gb) / 2) AS score FROM (SELECT *, avg(pred_a) OVER r - avg(pred_a) OVER l AS ga,
        avg(pred_b) OVER r - avg(pred_b) OVER l AS gb FROM (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS pos, count(*) OVER () AS n FROM pr)
        WINDOW l AS (ORDER BY pos ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING), r AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 127 FOLLOWING))
        WHERE pos >= 128 AND pos <= n - 128""",
        keys=("sample_id", "pos"),
    ),
)
def boundary_scores(spark, path):
    return present(drift.boundary_scores(predictions(spark, path), ["pred_a", "pred_b"], 128, 1000), ("sample_id", "pos"))


HASH = "((((sample_id % 1000003) * 7919 + 7) * 1103515245 + 12345) & 2147483647) * 48271 % 2147483647"


@register(
    "stratified_sample",
    query(
        ["pr"],
        f"""SELECT sample_id, month, 1000 * pred_a AS pred_a FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY {HASH}, sample_id) AS p FROM pr) WHERE p <= 5""",
        keys=KEY_MONTH,
    ),
)
def stratified_sample(spark, path):
    return present(drift.stratified_sample(predictions(spark, path), "month", 5).select("sample_id", "month", (F.col("pred_a") * 1000).alias("pred_a")), KEY_MONTH)


@register(
    "spaced_sample",
    query(
        ["pr"],
        """SELECT sample_id, month, 1000 * pred_a AS pred_a FROM nn WHERE pos IN (SELECT floor(j * (n - 1) / (least(4, n) - 1)) FROM range(4) t(j) WHERE j < least(4, n)) OR n = 1""",
        keys=KEY_MONTH,
        steps=["nn AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY sample_id) - 1 AS pos, (count(*) OVER (PARTITION BY month))::DOUBLE AS n FROM pr)"],
    ),
)
def spaced_sample(spark, path):
    return present(drift.spaced_sample(predictions(spark, path), "month", 4).select("sample_id", "month", (F.col("pred_a") * 1000).alias("pred_a")), KEY_MONTH)


@register("row_sample", query(["pr"], f"SELECT sample_id, 1000 * pred_a AS pred_a FROM pr ORDER BY {HASH}, sample_id LIMIT 200"))
def row_sample(spark, path):
    return present(drift.row_sample(predictions(spark, path), 200).select("sample_id", (F.col("pred_a") * 1000).alias("pred_a")))


@register(
    "hash_split",
    query(["pr"], "SELECT part, count(*) AS n, sum(target) AS y FROM (SELECT *, ((sample_id * 1103515245 + 12345) & 2147483647) % 5 AS part FROM pr) GROUP BY part", keys=("part",)),
)
def hash_split(spark, path):
    p = predictions(spark, path).withColumn("part", X.hash_split(F.col("sample_id")))
    return present(p.groupBy("part").agg(F.count("*").alias("n"), F.sum("target").alias("y")), ("part",))


# blending ----------------------------------------------------------------------------------------

VECTORS = ["pred_a", "pred_b", "gap"]
ALL3 = [(a, b) for i, a in enumerate(VECTORS) for b in VECTORS[i:]]


def pairs_sql(source, score="cosine", dot=True):
    d = "sum({a} * {b}) AS dot, " if dot else ""
    return " UNION ALL ".join(
        (f"SELECT '{a}' AS a, '{b}' AS b, " + d + f"sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})) AS {score} FROM {source}").format(a=a, b=b)
        for a, b in ALL3
    )


@register("gram_pairs", query(["pr"], pairs_sql("ft"), keys=("a", "b"), steps=[FT]))
def gram_pairs(spark, path):
    return present(blend.gram_pairs(features(spark, path), VECTORS), ("a", "b"))


@register(
    "transfer_geometry",
    query(
        ["pr"],
        "SELECT a, b, valid, test, test - valid AS change FROM v JOIN t USING (a, b)",
        keys=("a", "b"),
        steps=[
            FT, "f1 AS (SELECT * FROM ft WHERE month < 40)", "f2 AS (SELECT * FROM ft WHERE month >= 40)",
            f"v AS ({pairs_sql('f1', 'valid', False)})", f"t AS ({pairs_sql('f2', 'test', False)})",
        ],
    ),
)
def transfer_geometry(spark, path):
    f = features(spark, path)
    return present(blend.transfer_geometry(f.filter("month < 40"), f.filter("month >= 40"), VECTORS), ("a", "b"))


@register(
    "stack_weights",
    query(
        ["pr"],
        """SELECT unnest(['pred_a', 'pred_b']) AS name, unnest([w1 / (w1 + w2), w2 / (w1 + w2)]) AS weight FROM (SELECT CASE WHEN u2 < 0 THEN by1 / g11 WHEN u1 < 0 THEN 0
        ELSE u1 END AS w1, CASE WHEN u1 < 0 THEN by2 / g22 WHEN u2 < 0 THEN 0 ELSE u2 END AS w2 FROM (SELECT *, (g22 * by1 - g12 * by2) / (g11 * g22 - g12 * g12) AS u1,
        (g11 * by2 - g12 * by1) / (g11 * g22 - g12 * g12) AS u2 FROM (SELECT aa + 0.01::DOUBLE * (aa + bb) / 2 AS g11, bb + 0.01::DOUBLE * (aa + bb) / 2 AS g22, ab AS g12, by1, by2
        FROM (SELECT sum(pred_a * pred_a) AS aa, sum(pred_b * pred_b) AS bb, sum(pred_a * pred_b) AS ab, sum(pred_a * target) AS by1, sum(pred_b * target) AS by2 FROM pr))))""",
        keys=("name",),
    ),
)
def stack_weights(spark, path):
    return present(blend.stack_weights(features(spark, path), ["pred_a", "pred_b"], ridge=0.01), ("name",))


W3 = {f"w_{n}": f"{k} / 20.0::DOUBLE" for n, k in zip(VECTORS, ("i", "j", "(20 - i - j)"))}
BLEND = "(w_pred_a * pred_a + w_pred_b * pred_b + w_gap * gap)"
GRID = f"wg AS (SELECT {cols(W3)} FROM range(21) a(i), range(21) b(j) WHERE i + j <= 20)"


def _blend_grid_sql():
    p = {f"g{a}{b}": f"sum({x} * {y})" for a, x in enumerate([*VECTORS, "target"]) for b, y in enumerate([*VECTORS, "target"]) if a <= b}
    w = [f"w_{n}" for n in VECTORS]
    py = " + ".join(f"{w[i]} * g{i}3" for i in range(3))
    pp = " + ".join(f"{w[i]} * {w[j]} * g{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3))
    return cols(p), f"({py}) / sqrt(greatest(({pp}) * g33, 1e-30))"


GSUMS, BLEND_SCORE = _blend_grid_sql()
WINDOW = "CASE WHEN month < 40 THEN 'fit' ELSE 'forward' END AS window_"


@register(
    "blend_grid",
    query(
        ["pr"],
        f"SELECT window_ AS period, w_pred_a * 20 AS u_a, w_pred_b * 20 AS u_b, {BLEND_SCORE} AS score FROM wg, gs",
        keys=("period",),
        steps=[FT, GRID, f"gs AS (SELECT {WINDOW}, {GSUMS} FROM ft GROUP BY ALL)"],
    ),
)
def blend_grid(spark, path):
    f = features(spark, path).withColumn("window", F.when(F.col("month") < 40, "fit").otherwise("forward"))
    s = blend.blend_scores(f, VECTORS, blend.weight_grid(spark, VECTORS, 20))
    out = s.select(F.col("window").alias("period"), (F.col("w_pred_a") * 20).alias("u_a"), (F.col("w_pred_b") * 20).alias("u_b"), "score")
    return present(out, ("period",))


BASE_W = {"pred_a": 0.4, "pred_b": 0.4, "gap": 0.2}
BASE_SCORE = BLEND_SCORE
for _n, _w in BASE_W.items():
    BASE_SCORE = BASE_SCORE.replace(f"w_{_n} ", f"{_w} ")


@register(
    "guarded_grid",
    query(
        ["pr"],
        f"SELECT w_pred_a * 20 AS u_a, w_pred_b * 20 AS u_b, mc AS min_change, {BLEND_SCORE} AS score FROM gm, ga WHERE mc >= -0.02",
        keys=(),
        steps=[
            FT, GRID, f"gt AS (SELECT month, {GSUMS} FROM ft WHERE month IN (62, 63, 64) GROUP BY month)", f"ga AS (SELECT {GSUMS} FROM ft)",
            f"gm AS (SELECT w_pred_a, w_pred_b, w_gap, min({BLEND_SCORE} - {BASE_SCORE}) AS mc FROM wg, gt GROUP BY ALL)",
        ],
    ).replace("EXCLUDE ()", "").replace("SELECT , round", "SELECT round"),
)
def guarded_grid(spark, path):
    f = features(spark, path)
    out = blend.guarded_grid(f, VECTORS, blend.weight_grid(spark, VECTORS, 20), BASE_W, (62, 63, 64), 0.02)
    return present(out.select((F.col("w_pred_a") * 20).alias("u_a"), (F.col("w_pred_b") * 20).alias("u_b"), "min_change", "score"), ())


@register(
    "line_search",
    query(
        ["pr"],
        """SELECT i, sum(b * target) / sqrt(sum(b * b) * sum(target * target)) AS score FROM (SELECT i, target,
        (0.4 + 0.5 * i / 100.0::DOUBLE) * pred_a + (0.6 - 0.5 * i / 100.0::DOUBLE) * pred_b AS b FROM pr, range(101) r(i)) GROUP BY i""",
        keys=("i",),
    ),
)
def line_search(spark, path):
    out = blend.line_search(predictions(spark, path), ["pred_a", "pred_b"], {"pred_a": 0.4, "pred_b": 0.6}, {"pred_a": 0.9, "pred_b": 0.1})
    return present(out.select(F.round(F.col("share") * 100).cast("long").alias("i"), "score"), ("i",))


MEMBERS = [f"m{i}" for i in range(6)]


@register(
    "member_aggregates",
    query(
        ["pr"],
        """SELECT sample_id, list_avg(s) AS mean, (s[3] + s[4]) / 2 AS median, list_avg(s[2:5]) AS trimmed_1, list_avg(s[3:4]) AS trimmed_2,
        0.75 * list_avg(s) + 0.25 * (s[3] + s[4]) / 2 AS mean_median FROM (SELECT sample_id, list_sort([pred_a + 0.01::DOUBLE * i * (sample_id % 5) - 0.02::DOUBLE * ((sample_id + i) % 3)
        FOR i IN range(6)]) AS s FROM pr)""",
    ),
)
def member_aggregates(spark, path):
    k = F.col("sample_id")
    p = predictions(spark, path).withColumns(
        {f"m{i}": F.col("pred_a") + 0.01 * i * (k % 5) - 0.02 * ((k + i) % 3) for i in range(6)}
    )
    out = blend.member_aggregates(p, MEMBERS)
    return present(out.select("sample_id", "mean", "median", "trimmed_1", "trimmed_2", "mean_median"))


@register(
    "disagreement_shrink",
    query(
        ["pr"],
        """SELECT sample_id, m / (1 + 2 * sd / (av + 1e-12)) AS soft, m * CASE WHEN sd > cut THEN 0.5 ELSE 1 END AS hard FROM s,
        (SELECT avg(sd) AS av, quantile_cont(sd, 0.75) AS cut FROM s)""",
        steps=["s AS (SELECT sample_id, (pred_a + pred_b + gap) / 3 AS m, list_stddev_pop([pred_a, pred_b, gap]) AS sd FROM ft)"],
    ).replace("s AS (SELECT sample_id, (pred_a", FT + ", s AS (SELECT sample_id, (pred_a"),
)
def disagreement_shrink(spark, path):
    f = features(spark, path)
    long = f.select("sample_id", F.explode(F.array(*VECTORS)).alias("pred"))
    mean = long.groupBy("sample_id").agg(F.avg("pred").alias("pred"), F.stddev_pop("pred").alias("sd"))
    return present(blend.disagreement_shrink(mean, 2.0, 0.25).select("sample_id", "soft", "hard"))


RECIPES = {"base": {"pred_a": 0.5, "pred_b": 0.5}, "more_a": {"pred_a": 0.8, "pred_b": 0.2}, "more_b": {"pred_a": 0.2, "pred_b": 0.8},
           "gap": {"pred_a": 0.6, "gap": 0.4}}


def _recipe_sql(r):
    return " + ".join(f"{w}::DOUBLE * {n}" for n, w in RECIPES[r].items())


@register(
    "regime_blend",
    query(
        ["pr"],
        "SELECT sample_id, regime, CASE best " + " ".join(f"WHEN '{r}' THEN {_recipe_sql(r)}" for r in RECIPES) + " END AS blend FROM rg JOIN bs USING (regime)",
        keys=("sample_id",),
        steps=[
            FT,
            "th AS (SELECT quantile_cont(vol, 1/3.0::DOUBLE) AS t1, quantile_cont(vol, 2/3.0::DOUBLE) AS t2 FROM ft WHERE month < 40)",
            "rg AS (SELECT ft.*, CASE WHEN vol < t1 THEN 0 WHEN vol < t2 THEN 1 ELSE 2 END AS regime FROM ft, th)",
            "rs AS ("
            + " UNION ALL ".join(
                f"SELECT regime, '{r}' AS recipe, sum(b * target) / sqrt(sum(b * b) * sum(target * target)) AS s FROM (SELECT regime, target, {_recipe_sql(r)} AS b FROM rg WHERE month < 40) GROUP BY regime"
                for r in RECIPES
            )
            + ")",
            "bs AS (SELECT regime, first(recipe ORDER BY s DESC, recipe DESC) AS best FROM rs GROUP BY regime)",
        ],
    ),
)
def regime_blend(spark, path):
    f = features(spark, path)
    rg = blend.regimes(f, "vol", f.filter("month < 40"))
    return present(blend.regime_blend(rg, VECTORS, RECIPES, "month < 40").select("sample_id", "regime", "blend"))


@register(
    "volatility_expert",
    query(
        ["pr"],
        "SELECT sample_id, 100000 * CASE WHEN vol > q THEN pred_b ELSE pred_a END AS gated FROM ft, (SELECT quantile_cont(vol, 0.75) AS q FROM ft WHERE month < 40)",
        steps=[FT],
    ),
)
def volatility_expert(spark, path):
    f = features(spark, path)
    return present(blend.high_volatility_expert(f, "vol", f.filter("month < 40"), "pred_a", "pred_b").select("sample_id", (F.col("gated") * 100000).alias("gated")))


@register(
    "soft_gate",
    query(
        ["pr"],
        """SELECT sample_id, w * pred_a + (1 - w) * pred_b AS gated FROM (SELECT *, CASE WHEN vol <= 0.05 THEN 0.8 WHEN vol <= 0.1 THEN 0.8 - 0.3 * (vol - 0.05) / 0.05
        WHEN vol <= 0.2 THEN 0.5 - 0.4 * (vol - 0.1) / 0.1 ELSE 0.1 END AS w FROM ft)""",
        steps=[FT],
    ),
)
def soft_gate(spark, path):
    weights = [{"pred_a": a, "pred_b": 1 - a} for a in (0.8, 0.5, 0.1)]
    out = blend.soft_gate(features(spark, path), ["pred_a", "pred_b"], "vol", [0.05, 0.1, 0.2], weights)
    return present(out.select("sample_id", "gated"))


@register("common_component")
def common_component(spark, path):
    f = features(spark, path)
    return present(blend.common_component(f, ["pred_b", "gap"], "pred_a", 60).select("sample_id", "adjusted"))


@register(
    "common_component_one",
    query(
        ["pr"],
        """SELECT sample_id, pred_a - m + y + wa / sa * (a - ma) + wb / sb * (b - mb) AS adjusted FROM ft JOIN mt USING (month), (SELECT *,
        ((n + 100) * ta - n * r * tb) / d AS wa, ((n + 100) * tb - n * r * ta) / d AS wb FROM (SELECT *, n * corr_a * sy AS ta, n * corr_b * sy AS tb,
        (n + 100) * (n + 100) - n * r * n * r AS d FROM (SELECT count(*)::DOUBLE AS n, avg(t) AS y, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb,
        stddev_pop(t) AS sy, corr(a, b) AS r, corr(a, t) AS corr_a, corr(b, t) AS corr_b FROM mt WHERE month <= 60)))""",
        steps=[FT, "mt AS (SELECT month, avg(target) AS t, avg(pred_a) AS m, avg(pred_b) AS a, stddev_pop(pred_b) AS b FROM ft GROUP BY month)"],
    ),
)
def common_component_one(spark, path):
    return present(blend.common_component(features(spark, path), ["pred_b"], "pred_a", 60).select("sample_id", "adjusted"))


@register("geometry_estimate")
def geometry_estimate(spark, path):
    f = features(spark, path)
    k = F.col("sample_id")
    f = f.withColumns({f"v{i}": F.col("pred_a") * (0.1 * i) + F.col("pred_b") + 0.01 * ((k * (i + 3)) % 11) for i in range(9)})
    scores = {f"v{i}": 0.1 + 0.005 * i for i in range(9)}
    return present(blend.estimate_scores(f, list(scores), ["pred_a", "pred_b"], scores), ("name",))


@register(
    "rounding_noise",
    query(
        ["pr"],
        "SELECT 0 AS k, "
        + ", ".join(f"1000 * quantile_cont(noise, {p}) AS q{q}" for p, q in ((0.01, "01"), (0.05, "05"), (0.5, "50"), (0.95, "95"), (0.99, "99")))
        + ", avg((noise > 0)::INT) AS positive_share FROM nz",
        keys=("k",),
        steps=[
            FT,
            "cf AS (SELECT [1.0, sum(pred_a * pred_b) / sum(pred_a * pred_a), sum(pred_a * gap) / sum(pred_a * pred_a)] AS w FROM ft)",
            """nz AS (SELECT draw, sum(w[i + 1] * ((floor((((draw * 7919 + i * 104729 + 17) * 1103515245 + 12345) & 2147483647) / 256)) / 8388608 * 2 - 1) * 0.0005::DOUBLE) AS noise
            FROM range(20000) d(draw), range(3) r(i), cf GROUP BY draw)""",
        ],
    ),
)
def rounding_noise(spark, path):
    g = blend.gram_matrix(features(spark, path), VECTORS)
    out = blend.rounding_noise(spark, list(g[0] / g[0, 0]))
    scaled = {n: F.col(n) * 1000 for n in out.columns if n != "positive_share"}
    return present(out.withColumns(scaled).selectExpr("0 AS k", "*"), ("k",))


@register(
    "top_features",
    query(
        ["pr"],
        " UNION ALL ".join(f"SELECT '{n}' AS feature, abs(corr({n}, target)) AS score FROM ft" for n in FEATURES) + " ORDER BY score DESC, feature LIMIT 2",
        keys=("feature",),
        steps=[FT],
    ),
)
def top_features(spark, path):
    pairs = drift.correlation_pairs(features(spark, path), [*FEATURES, "target"]).filter("b = 'target'")
    scores = pairs.select(F.col("a").alias("feature"), F.abs("corr").alias("score"))
    return present(columns.top_features(scores, 2), ("feature",))
