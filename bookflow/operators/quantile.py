"""Exact quantiles. Where a key has few rows, its values are aggregated and sorted in one step; keys above the slice limit,
and tables without keys, go by rank: equal values are counted first, then ranked per (key, value slice), so no task ever
holds all values of a large key."""

from pyspark.sql import functions as F

from .timeline import Timeline, large_keys


def _ranked(df, value, keys):
    counts = (
        df.filter(value.isNotNull())
        .groupBy(*keys, value.alias("_x"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    line = Timeline.of(counts, keys=keys, order=(F.col("_x"),))
    return line.running_sum({"upto": F.col("n")}).key_total("rows", F.col("n"))


def value_ranks(df, value, keys):
    """Distinct values per key with `n` copies, `upto` rows at or below, `rows` in the key."""
    return _ranked(df, value, keys).finished()


def _at_rank(r):
    return F.max(F.when((F.col("upto") - F.col("n") <= r) & (r < F.col("upto")), F.col("_x")))


def exact_quantiles(df, value, probs, keys=(), interpolation="linear"):
    """{name: probability} -> one row per key. linear interpolates, nearest takes one value."""
    if not keys:
        one = exact_quantiles(df.withColumn("_all", F.lit(0)), value, probs, ("_all",), interpolation)
        return one.drop("_all")
    aggs = []
    for name, p in probs.items():
        h = (F.col("rows") - 1) * F.lit(float(p))
        if interpolation == "nearest":
            aggs.append(_at_rank(F.round(h)).alias(name))
        else:
            lo = F.floor(h)
            aggs += [
                _at_rank(lo).alias(f"_lo_{name}"),
                _at_rank(F.ceil(h)).alias(f"_hi_{name}"),
                F.max(h - lo).alias(f"_f_{name}"),
            ]
    t = value_ranks(df, value, keys).groupBy(*keys).agg(*aggs)
    if interpolation == "nearest":
        return t
    return t.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


def quantiles_of(df, values, keys=()):
    """{name: (value column, probability)} for several columns in one pass, one row per key; linear interpolation.

    With keys, those of at most `bookflow.rowsPerSlice` rows take one aggregation that keeps (value, count) of each column;
    the larger ones, if there are any, are ranked beside it.
    """
    if not keys:
        return _ranked_of(df, values, keys)
    large, schema = large_keys(df, keys)
    if not large:
        return _gathered(df, values, keys)
    # at most MAX_LARGE_KEYS rows, whatever the size of the data
    listed = F.broadcast(df.sparkSession.createDataFrame(large, schema).select(*keys))
    small = _gathered(df.join(listed, list(keys), "left_anti"), values, keys)
    return small.unionByName(_ranked_of(df.join(listed, list(keys), "left_semi"), values, keys))


def _gathered(df, values, keys):
    probs, column, sets = {}, {}, []
    for value, p in values.values():
        probs.setdefault(str(value), []).append(p)
    for value, _ in values.values():
        if str(value) not in column:
            column[str(value)] = f"_q{len(column)}"
            at = F.array(*[F.lit(float(p)) for p in probs[str(value)]])
            sets.append(F.percentile(value.cast("double"), at).alias(column[str(value)]))
    picked = [F.element_at(column[str(v)], probs[str(v)].index(p) + 1).alias(name) for name, (v, p) in values.items()]
    return df.groupBy(*keys).agg(*sets).select(*keys, *picked)


def _ranked_of(df, values, keys):
    """The columns are stacked to (key, column number, value), so all are ranked together."""
    columns, number = [], {}
    for name, (value, _) in values.items():
        if str(value) not in number:
            number[str(value)] = len(columns)
            columns.append(value)
    pairs = [F.struct(F.lit(i).alias("_i"), v.cast("double").alias("v")) for i, v in enumerate(columns)]
    rows = df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.*")
    probs = {f"p{i}": p for i, p in enumerate(sorted({p for _, p in values.values()}))}
    at = {p: n for n, p in probs.items()}
    q = exact_quantiles(rows, F.col("v"), probs, (*keys, "_i"))
    return q.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_i") == number[str(v)], F.col(at[p]))).alias(name)
            for name, (v, p) in values.items()
        ]
    )


def even_quantiles(df, value, count, name="knots"):
    """Quantiles at `count` even probabilities 0 .. 1, as one row with one array.

    A distinct value covers a run of knots that follows from its ranks, so the work is one row per
    distinct value plus one per knot.
    """
    line = _ranked(df.withColumn("_all", F.lit(0)), value, ("_all",)).following(["_x"], prefix="next")
    step = (F.col("rows") - 1) / float(count - 1)
    lo, hi = F.col("upto") - F.col("n"), F.col("upto")
    # knot i sits at rank i * step; those with lo <= rank < hi start at this value
    first = F.when(step > 0, F.ceil(lo / step)).otherwise(0)
    last = F.when(step > 0, F.least(F.ceil(hi / step) - 1, F.lit(count - 1))).otherwise(count - 1)
    rows = line.rows.withColumns({"_first": first, "_last": last, "_step": step})
    rows = rows.filter(F.col("_first") <= F.col("_last"))
    rows = rows.withColumn("i", F.explode(F.sequence("_first", "_last")))
    rank = F.col("i") * F.col("_step")
    inside = F.floor(rank) + 1 < F.col("upto")
    upper = F.when(inside, F.col("_x")).otherwise(F.coalesce(F.col("next_x"), F.col("_x")))
    q = F.col("_x") + (upper - F.col("_x")) * (rank - F.floor(rank))
    pairs = rows.select(F.struct("i", q.alias("q")).alias("v"))
    return pairs.agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["q"]).alias(name))
