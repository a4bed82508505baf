"""Checks of the input contract: ranges, encodings, finiteness, order and keys.

Every check is one aggregation that counts violations, so a check never moves rows.
"""

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..schema import KEY, SEQ, TIME
from .quantile import exact_quantiles
from .timeline import Timeline

c = F.col


def _bad_number(name):
    x = c(name).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def contract_counts(df, span, codes=("side",), may_miss=()):
    """One row of violation counts: missing numbers, times outside the span, unknown codes.

    may_miss names columns whose missing value means "no data"; they are counted apart.
    """
    return df.agg(*_rules(df, span, codes, may_miss))


def observed(df, span, codes=("side",), may_miss=()):
    """(the same rows, Observation): the counts of `contract_counts` are taken by the action that reads the rows, not by a scan of their own."""
    seen = Observation()
    return df.observe(seen, *_rules(df, span, codes, may_miss)), seen


def broken(counts):
    """The rules that a dict of counts breaks, with their counts."""
    return {n: k for n, k in counts.items() if k and (n.startswith(("bad_", "code_")) or n == "outside_span")}


def _rules(df, span, codes, may_miss):
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (KEY, SEQ)]
    t = c(TIME).cast("double")
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(c(KEY).isNull() | (c(KEY) < 0)).alias("bad_id")]
    aggs += [F.count_if(_bad_number(n)).alias(("nodata_" if n in may_miss else "bad_") + n) for n in numeric]
    aggs += [F.count_if((t < 0) | (t > span)).alias("outside_span")]
    return aggs + [F.count_if(~c(n).isin(0, 1)).alias(f"code_{n}") for n in codes if n in df.columns]


def checked(df, span, codes=("side",), may_miss=()):
    """The same rows, with an error raised on the first violation that is read."""
    t = c(TIME).cast("double")
    bad = c(KEY).isNull() | (c(KEY) < 0) | (t < 0) | (t > span)
    for n in codes:
        bad = bad | ~c(n).isin(0, 1)
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType) and f.name not in (KEY, SEQ, *may_miss):
            bad = bad | _bad_number(f.name)
    return df.filter(F.when(bad, F.raise_error(F.lit("input contract broken"))).otherwise(F.lit(True)))


def coded(df, *codes):
    """The same rows, with an error raised on the first unknown or missing code that is read."""
    bad = F.lit(False)
    for n in codes:
        bad = bad | F.coalesce(~c(n).isin(0, 1), F.lit(True))
    return df.filter(F.when(bad, F.raise_error(F.lit("unknown side or action"))).otherwise(F.lit(True)))


def level_profile(market):
    """One row: empty levels (price 0) per side and level, and the share of samples with any."""
    prices = [f"{s}_price_{n}" for n in (1, 2) for s in ("ask", "bid")]
    empty = {p: c(p) == 0 for p in prices}
    anything = empty["ask_price_1"] | empty["bid_price_1"]
    per = market.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(e).alias(p) for p, e in empty.items()],
        F.count_if(anything).alias("any"),
        F.count_if(c("transaction_avgprice").isNull() | F.isnan(c("transaction_avgprice"))).alias("untraded"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("rows").alias("rows"),
        *[F.sum(p).alias(f"empty_{p}") for p in prices],
        F.sum("untraded").alias("untraded"),
        (F.sum("any") / F.sum("rows")).alias("empty_row_share"),
        F.avg((c("any") > 0).cast("double")).alias("empty_sample_share"),
    )


def stream_profile(df, code_columns=()):
    """One row: samples, rows, rows per sample, time range, and the values of code columns."""
    t = c(TIME).cast("double")
    per = df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(t).alias("lo"),
        F.max(t).alias("hi"),
    )
    out = per.agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("n").alias("rows"),
        F.min("n").alias("rows_min"),
        F.max("n").alias("rows_max"),
        F.avg("n").alias("rows_mean"),
        F.min("lo").alias("time_min"),
        F.max("hi").alias("time_max"),
    )
    out = out.crossJoin(exact_quantiles(per, c("n"), {"rows_q25": 0.25, "rows_median": 0.5, "rows_q75": 0.75}))  # one row each
    if not code_columns:
        return out
    # counted by value, so no task holds the values of a column that turns out not to be a code
    return out.crossJoin(df.agg(*[F.countDistinct(n).alias(f"values_{n}") for n in code_columns]))  # one row each


def probe(df, keys=(KEY,), lg_k=12, k=200):
    """One row per stream that can be kept and merged with others: rows, types, and sketches of distinct keys and of numeric columns."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)).alias("types"),
        F.hll_sketch_agg(F.hash(*keys) if len(keys) > 1 else c(keys[0]).cast("long"), F.lit(lg_k)).alias("keys"),
        *[F.kll_sketch_agg_double(c(n).cast("double"), F.lit(k)).alias(f"sketch_{n}") for n in numeric],
    )


def merged_probes(probes):
    """One probe of several of the same types; other types are an error."""
    sketches = [n for n in probes.columns if n.startswith("sketch_")]
    one = F.when(F.count_distinct("types") <= 1, F.min("types")).otherwise(F.raise_error(F.lit("streams differ in their types")))
    return probes.agg(F.sum("rows").alias("rows"), one.alias("types"), F.hll_union_agg("keys").alias("keys"), *[F.kll_merge_agg_double(n).alias(n) for n in sketches])


def probed(probe, probs=(0.25, 0.5, 0.75)):
    """Figures of a probe: rows, types, distinct keys (1.6 % standard error), quantiles (about 1.3 % of the ranks off) as arrays by column."""
    at = F.array(*[F.lit(float(p)) for p in probs])
    quantiles = [F.kll_sketch_get_quantile_double(n, at).alias(n.removeprefix("sketch_")) for n in probe.columns if n.startswith("sketch_")]
    return probe.select("rows", "types", F.hll_sketch_estimate("keys").alias("keys"), *quantiles)


def order_audit(df):
    """One row: rows whose countdown rises against the previous row by `event_seq`, and the samples
    they are in."""
    seq = c(SEQ)
    line = Timeline.of(df.select(KEY, SEQ, TIME), by=seq.cast("double"), order=(seq,)).previous([TIME])
    rises = X.col(TIME) > X.col(f"prev_{TIME}")
    per = line.rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(rises).alias("rises"))
    return per.agg(
        F.sum("n").alias("rows"), F.sum("rises").alias("rises"), F.count_if(c("rises") > 0).alias("bad_samples")
    )


def dense_ids(df):
    """One row: rows, distinct ids, smallest and largest id, and whether they are 0 .. n-1."""
    s = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(KEY).alias("ids"),
        F.min(KEY).alias("first"),
        F.max(KEY).alias("last"),
    )
    dense = (c("rows") == c("ids")) & (c("first") == 0) & (c("last") == c("rows") - 1)
    return s.withColumn("dense", dense.cast("int"))


def key_sets(left, right):
    """One row: ids in both, only left, only right; equal sets have 0 in the last two."""
    a = left.select(KEY).distinct().withColumn("l", F.lit(1))
    b = right.select(KEY).distinct().withColumn("r", F.lit(1))
    t = a.join(b, KEY, "full_outer")
    return t.agg(
        F.count_if(c("l").isNotNull() & c("r").isNotNull()).alias("both"),
        F.count_if(c("r").isNull()).alias("left_only"),
        F.count_if(c("l").isNull()).alias("right_only"),
    )


def union_disjoint(parts, keys=(KEY,)):
    """Union of slices that must not share a key; a shared key raises when it is read."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    twice = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter(c("_k") > 1)
    flagged = out.join(twice, list(keys), "left")
    bad = F.when(c("_k").isNotNull(), F.raise_error(F.lit("slices overlap"))).otherwise(F.lit(True))
    return flagged.filter(bad).drop("_k")


def manifest(df, key=KEY):
    """One row about a feature table: rows, distinct ids, columns, non-finite values, fingerprint.

    The fingerprint folds row hashes by XOR, so it does not depend on row order or partitioning.
    """
    names = sorted(n for n in df.columns if n != key)
    number = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = sum((_bad_number(n).cast("int") for n in number), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(key).alias("ids"),
        F.lit(len(names)).alias("columns"),
        F.sum(bad).alias("bad_values"),
        F.bit_xor(F.xxhash64(key, *names)).alias("fingerprint"),
    )
