"""Joins beyond plain equi-joins: as-of, nearest in time, strict alignment, densified grids."""

from functools import reduce

from pyspark.sql import functions as F

from ..schema import KEY, SEQ, TIME
from .timeline import Timeline


def asof_join(left, right, payload, by=KEY, strict=True, tolerance=None, forward=True):
    """Every left row with the payload columns of the latest earlier right row of its sample.

    Time counts down, so earlier means more seconds. strict leaves out rows of the same instant;
    forward=False takes the next later row. Among right rows of one instant the last by
    `event_seq` counts as latest. Adds `match_seconds`; no match within tolerance gives null.

    Both sides go through one exchange as one stream; the match is a carried-forward value.
    """
    left_names = [c for c in left.columns if c != by]
    packed = F.struct(*[F.col(n) for n in payload], F.col(TIME).cast("double").alias("match_seconds"))
    quotes = right.select(by, F.col(TIME).cast("double").alias("_t"), F.col(SEQ).alias("_rs"), packed.alias("_m"))
    events = left.select(
        by, F.col(TIME).cast("double").alias("_t"), F.col(SEQ).alias("_ls"), F.struct(*left_names).alias("_e")
    )
    both = events.unionByName(quotes, allowMissingColumns=True)
    # at one instant: events first when equal times must not match
    events_first = strict == forward
    kind = F.when(F.col("_e").isNotNull(), 0 if events_first else 1).otherwise(1 if events_first else 0)
    time = -F.col("_t")
    line = Timeline.of(both, keys=(by,), by=time, order=(time, kind, F.col("_ls"), F.col("_rs")))
    line = line.last_known("_hit", F.col("_m"), forward=forward)
    out = line.rows.filter(F.col("_e").isNotNull())
    if tolerance is not None:
        near = F.abs(F.col("_hit.match_seconds") - F.col("_t")) <= tolerance
        out = out.withColumn("_hit", F.when(near, F.col("_hit")))
    return out.select(
        by,
        *[F.col(f"_e.{n}").alias(n) for n in left_names],
        *[F.col(f"_hit.{n}").alias(n) for n in [*payload, "match_seconds"]],
    )


def nearest_in_time(rows, value, targets, by=KEY):
    """{name: seconds}: value of the row nearest to each target time, the later row on a tie."""
    t = F.col(TIME).cast("double")
    return rows.groupBy(by).agg(
        *[F.max_by(value, F.struct(-F.abs(t - h), -t, F.col(SEQ))).alias(n) for n, h in targets.items()]
    )


def strict_align(left, right, keys):
    """Full outer join that must match on every key: rows of one side alone raise an error."""
    marked = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), keys, "full_outer")
    partial = F.col("_l").isNull() | F.col("_r").isNull()
    checked = F.when(partial, F.raise_error(F.lit("prediction frames overlap only in part"))).otherwise(F.lit(True))
    return marked.filter(checked).drop("_l", "_r")


def alignment(left, right, keys):
    """Counts of keys in both, only left and only right; one row."""
    marked = left.select(*keys).withColumn("_l", F.lit(1)).join(
        right.select(*keys).withColumn("_r", F.lit(1)), keys, "full_outer"
    )
    return marked.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )


def grid(spine, bins, name="bin"):
    """Every id of the spine with every bin 0 .. bins-1."""
    return spine.select(KEY, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias(name))


def densify(spine, bins, *tables, name="bin", fill=None):
    """Full id x bin grid with the columns of per-(id, bin) tables."""
    out = reduce(lambda a, b: a.join(b, [KEY, name], "left"), tables, grid(spine, bins, name))
    return out if fill is None else out.na.fill(fill)
