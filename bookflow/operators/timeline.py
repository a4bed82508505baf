"""Per-sample time order that stays balanced when one sample holds most of the rows.

Rows of keys above a row limit are range-partitioned by key and full order, ties included, so a burst of equal instants or
an outlier is split like anything else; a slice is one such partition. They are written to the shared folder once, which
fixes the slices. Windows then run per (key, slice). What a slice needs from the slices before it - the last rows, a running
total - is a small "carry": aggregated per slice, folded over the slices of the key, and joined back by broadcast. Without
such keys, windows simply run per key and no carry is planned. Both ways give the same values.

Finding the large keys is one narrow aggregation, run when a Timeline is made and remembered for that DataFrame object, whose
list of files is fixed. The limit is max(conf `bookflow.rowsPerSlice`, rows / 100 000): at most 100 000 keys can exceed it and
their slices number at most 200 000 in all, which bounds what is collected and broadcast whatever the size of the data.
"""

from dataclasses import dataclass, replace
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, SEQ, TIME
from .lineage import cut

SLICE = "_slice"
MAX_LARGE_KEYS = 100_000
MAX_CARRIES = 2  # each carry reads the rows twice, so chained ones multiply

_sizes = WeakKeyDictionary()


def rows_per_slice(spark):
    return int(spark.conf.get("bookflow.rowsPerSlice", "2000000"))


def large_keys(df, keys):
    """Keys above the limit with their number of slices, as rows; none as a rule."""
    per_slice = rows_per_slice(df.sparkSession)
    known = _sizes.setdefault(df, {})
    if (tuple(keys), per_slice) not in known:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        limit = F.greatest(F.lit(float(per_slice)), F.col("rows") / MAX_LARGE_KEYS)
        whole = F.broadcast(sizes.agg(F.sum("n").alias("rows")))  # one row
        large = sizes.crossJoin(whole).filter(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_slices"))
        known[(tuple(keys), per_slice)] = (large.collect(), large.schema)
    return known[(tuple(keys), per_slice)]


def lookup(rows, reference, on, keys=(KEY,), salt_by=(SEQ,)):
    """Left join of many rows to a reference with at most one row per `on`.

    Rows of a large key are salted by hash and its few reference rows are repeated per salt, so
    the join never puts one key on one task.
    """
    found, schema = large_keys(rows, keys)
    if not found:
        return rows.join(reference, list(on), "left")
    large = F.broadcast(rows.sparkSession.createDataFrame(found, schema))
    parts = F.coalesce(F.col("_slices"), F.lit(1))
    left = rows.join(large, list(keys), "left").withColumn(
        SLICE, F.pmod(F.xxhash64(*salt_by), parts).cast("int")
    )
    right = reference.join(large, list(keys), "left").withColumn(
        SLICE, F.explode(F.sequence(F.lit(0), parts - 1))
    )
    joined = left.drop("_slices").join(right.drop("_slices"), [*on, SLICE], "left")
    return joined.drop(SLICE)


@dataclass(frozen=True)
class Timeline:
    """Rows, the keys they belong to, and their ascending order inside a key."""

    rows: DataFrame
    keys: tuple
    order: tuple
    sliced: bool
    carries: int = 0

    @classmethod
    def of(cls, df, keys=(KEY,), by=None, order=None):
        """Chronological by default: seconds descending, ties by `event_seq`.

        Another order is given whole, or by its leading number `by`.
        """
        by = -F.col(TIME).cast("double") if by is None else by
        order = (by, F.col(SEQ)) if order is None else tuple(order)
        keys = tuple(keys)
        found, schema = large_keys(df, keys)
        if not found:
            return cls(df, keys, order, False)
        large = F.broadcast(df.sparkSession.createDataFrame(found, schema).select(*keys))
        slices = sum(r["_slices"] for r in found)
        hot = df.join(large, list(keys), "left_semi").repartitionByRange(slices, *keys, *order)
        hot = cut(hot.withColumn(SLICE, F.spark_partition_id()))
        rest = df.join(large, list(keys), "left_anti").withColumn(SLICE, F.lit(-1))
        return cls(hot.unionByName(rest), keys, order, True)

    @property
    def parts(self):
        return (*self.keys, SLICE) if self.sliced else self.keys

    def rank(self) -> Column:
        return F.struct(*[o.alias(f"o{i}") for i, o in enumerate(self.order)])

    def window(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def before(self):
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def upto(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_rows(self, df):
        return replace(self, rows=df)

    def select(self, *cols):
        return self.with_rows(self.rows.select(*self.parts, *cols))

    def filter(self, cond):
        return self.with_rows(self.rows.filter(cond))

    def with_columns(self, cols):
        return self.with_rows(self.rows.withColumns(cols))

    def drop(self, *names):
        return self.with_rows(self.rows.drop(*names))

    def _folded(self, per_slice, folds, forward, reach):
        direction = F.col(SLICE) if forward else -F.col(SLICE)
        w = Window.partitionBy(*self.keys).orderBy(direction).rowsBetween(reach, -1)
        folded = per_slice.select(
            *self.keys, SLICE, *[f(F.col(n)).over(w).alias(n) for n, f in folds.items()]
        )
        joined = self.rows.join(F.broadcast(folded), [*self.keys, SLICE], "left")
        return replace(self, rows=joined, carries=self.carries + 1)

    def settled(self):
        """The same rows, checkpointed once enough carries have piled up in their plan."""
        if not self.sliced or self.carries < MAX_CARRIES:
            return self
        return replace(self, rows=cut(self.rows), carries=0)

    def finished(self):
        """Rows without the slice column; sliced ones are checkpointed for the next user."""
        return cut(self.rows.drop(SLICE)) if self.sliced and self.carries else self.rows

    def carry(self, parts, forward=True):
        """Columns holding per-slice aggregates folded over the earlier (or later) slices.

        parts: {name: (aggregate, fold)}, fold being a window aggregate over slice results.
        Null where there is no such slice, and everywhere when nothing is sliced.
        """
        if not self.sliced:
            kinds = self.rows.groupBy(*self.keys).agg(*[a.alias(n) for n, (a, _) in parts.items()]).schema
            return self.with_columns({n: F.lit(None).cast(kinds[n].dataType) for n in parts})
        per_slice = (
            self.rows.filter(F.col(SLICE) >= 0)
            .groupBy(*self.parts)
            .agg(*[agg.alias(name) for name, (agg, _) in parts.items()])
        )
        folds = {n: fold for n, (_, fold) in parts.items()}
        return self._folded(per_slice, folds, forward, Window.unboundedPreceding)

    def previous(self, names, prefix="prev_"):
        """Value of each named column in the previous row of the key; null in the first row."""
        return self.shifted(names, {1: prefix})

    def following(self, names, prefix="next_"):
        return self.shifted(names, {-1: prefix})

    def shifted(self, names, prefixes):
        """{k: prefix}: columns of the row k places earlier, or later for negative k."""
        line = self.settled()
        for forward in (True, False):
            wanted = {abs(k): p for k, p in prefixes.items() if (k > 0) == forward}
            if wanted:
                line = line._shift(list(names), wanted, forward)
        return line

    def _shift(self, names, wanted, forward):
        move = F.lag if forward else F.lead
        if not self.sliced:
            w = self.window()
            return self.with_columns({p + n: move(n, k).over(w) for k, p in wanted.items() for n in names})
        reach = max(wanted)
        packed = F.struct(*names)
        order = self.order if forward else [o.desc() for o in self.order]
        w = Window.partitionBy(*self.parts).orderBy(*order)
        far = Window.partitionBy(*self.parts).orderBy(*([o.desc() for o in self.order] if forward else self.order))
        # the `reach` rows of a slice nearest to its neighbour, nearest first
        edge = (
            self.rows.filter(F.col(SLICE) >= 0)
            .withColumn("_n", F.row_number().over(far))
            .filter(F.col("_n") <= reach)
            .groupBy(*self.parts)
            .agg(F.array_sort(F.collect_list(F.struct("_n", packed.alias("v")))).alias("_edge"))
        )
        near = lambda e: F.collect_list(F.reverse(e))
        line = self._folded(edge, {"_edge": near}, forward, -reach)
        df = line.rows
        df = df.withColumn("_edge", F.reverse(F.flatten("_edge"))).withColumn("_i", F.row_number().over(w))
        out = {}
        for k, p in wanted.items():
            inside = F.lag(packed, k).over(w)
            index = F.lit(k + 1) - F.col("_i")
            outside = F.when(index >= 1, F.try_element_at("_edge", index).getField("v"))
            df = df.withColumn(f"_v{k}", F.coalesce(inside, outside))
            out |= {p + n: F.col(f"_v{k}").getField(n) for n in names}
        return line.with_rows(df.withColumns(out).drop("_edge", "_i", *[f"_v{k}" for k in wanted]))

    def lags(self, name, n):
        """Columns `<name>_lag1` .. `<name>_lag<n>`."""
        line = self.shifted([name], {k: f"_lag{k}_" for k in range(1, n + 1)})
        for k in range(1, n + 1):
            line = line.with_rows(line.rows.withColumnRenamed(f"_lag{k}_{name}", f"{name}_lag{k}"))
        return line

    def running_sum(self, sums, inclusive=True):
        """{output name: column}: sum from the first row of the key up to this one."""
        w = self.upto() if inclusive else self.before()
        line = self.settled().with_columns({f"_v_{n}": x for n, x in sums.items()})
        line = line.carry({f"_c_{n}": (F.sum(f"_v_{n}"), F.sum) for n in sums})
        zero = F.lit(0)
        line = line.with_columns(
            {
                n: F.coalesce(F.sum(f"_v_{n}").over(w), zero) + F.coalesce(F.col(f"_c_{n}"), zero)
                for n in sums
            }
        )
        return line.drop(*[f"_v_{n}" for n in sums], *[f"_c_{n}" for n in sums])

    def key_total(self, name, x):
        """Sum of `x` over all rows of the key, on every row."""
        line = self.settled().with_columns({"_v": x})
        near = F.coalesce(F.sum("_v").over(Window.partitionBy(*self.parts)), F.lit(0))
        if not self.sliced:
            return line.with_columns({name: near}).drop("_v")
        # one row per large key
        totals = line.rows.filter(F.col(SLICE) >= 0).groupBy(*self.keys).agg(F.sum("_v").alias("_t"))
        joined = line.rows.join(F.broadcast(totals), list(self.keys), "left")
        line = replace(line, rows=joined, carries=line.carries + 1)
        whole = F.when(F.col(SLICE) >= 0, F.coalesce("_t", F.lit(0))).otherwise(near)
        return line.with_columns({name: whole}).drop("_v", "_t")

    def running_extreme(self, name, x, largest=True):
        f = F.max if largest else F.min
        pick = F.greatest if largest else F.least
        line = self.settled().with_columns({"_v": x}).carry({"_c": (f("_v"), f)})
        return line.with_columns({name: pick(f("_v").over(self.upto()), F.col("_c"))}).drop("_v", "_c")

    def last_known(self, name, x, strict=True, forward=True):
        """Latest non-null `x` of earlier rows (or up to this row when not strict).

        forward=False looks at later rows instead.
        """
        line = self.settled().with_columns({"_v": x})
        pick = F.max_by if forward else F.min_by
        seen = pick("_v", F.when(F.col("_v").isNotNull(), self.rank()))
        line = line.carry({"_c": (seen, lambda c: F.last(c, True))}, forward)
        if forward:
            near = F.last("_v", True).over(self.before() if strict else self.upto())
        else:
            w = self.window().rowsBetween(1 if strict else 0, Window.unboundedFollowing)
            near = F.first("_v", True).over(w)
        return line.with_columns({name: F.coalesce(near, F.col("_c"))}).drop("_v", "_c")

    def position(self, name="pos"):
        """1-based chronological row number inside the key."""
        return self.running_sum({name: F.lit(1)})

    def runs(self, state, name="run"):
        """Number of the run of equal `state` values the row belongs to."""
        line = self.with_columns({"_s": state}).previous(["_s"], prefix="_q")
        changed = F.when(F.col("_q_s").isNull() | (F.col("_q_s") != F.col("_s")), 1).otherwise(0)
        return line.running_sum({name: changed}).drop("_s", "_q_s")
