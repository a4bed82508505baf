"""Shards of near equal bytes by a k-d tree over document metadata.

The items are groups of equal texts, so that copies land in one shard; a group above `group_share` of the target is
dealt into parts. Each node is split along its widest dimension at the weighted quantile that halves its leaves, until it
is the leaf it was meant to be (`shards`) or its bytes are within `target_bytes`. A quantile is found by histograms: bytes
per (node, bin) are summed, the bin that holds the quantile becomes the next range, until what is left in it is below
`tolerance` of a leaf. The tree is a table: an item carries its node, and a level's items, statistics and cuts are written
before the next level reads them. The driver sees counts and one row of the extents of the dimensions.

Defined results: null texts have no bytes, size counts 1 for each row; null metadata is a value of its own; ties in a
dimension are split by the hash of the group; a leaf is above `target_bytes` only if it is one group, or one part of one,
that can't be split; repeated rows are rows of their own; an empty table gives an empty one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.timeline import lookup
from .common import FEW, few, fraction, held, utf8_bytes

BINS = 1024
#: Coordinates and tie hashes have 31 bits each; together they are the order along a dimension.
BITS = 31
#: A node is its path from the root, first step in the highest of so many bits.
DEPTH = 62


def category(column):
    """Coordinate of a text column: a place of its own for each value, in no order."""
    return fraction(F.coalesce(F.concat(F.lit("="), column), F.lit("null")))


def extent(column):
    """Coordinate of a non-negative number on a logarithmic scale."""
    return F.log2(F.coalesce(column, F.lit(0)) + 1) / 64


def kd_shards(docs, shards=None, target_bytes=None, dimensions=None, group_share=0.02, tolerance=0.0005):
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    `dimensions` maps names to coordinates in [0, 1); by default source, language and size. Give the number of shards, or
    the bytes a leaf may reach.
    """
    size = utf8_bytes(F.col("text")) + 1
    dimensions = dimensions or {"source": category(F.col("source")), "lang": category(F.col("lang")), "size": extent(size)}
    dims = [f"x{i}" for i in range(len(dimensions))]
    rows = held(
        docs.select(
            "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("copy"),
            *[F.floor(x * (1 << BITS)).cast("long").alias(d) for d, x in zip(dims, dimensions.values())],
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("size")).first()[0]
    leaves = shards or max(1, -(-(total or 0) // target_bytes))
    target = (total or 0) / leaves
    # a group in as many parts as it needs to stay below its share of a shard; equal texts share the coordinates of their
    # group, else a split by source would part them
    groups = rows.groupBy("copy").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[F.min(d).alias(f"least_{d}") for d in dims])
    parts = F.greatest(F.lit(1), F.least("n", F.ceil(F.col("bytes") / F.lit(max(target * group_share, 1.0)))))
    groups = held(groups.where("n > 1").select("copy", parts.alias("parts"), *[f"least_{d}" for d in dims]), "groups")
    share = F.pmod(F.xxhash64("doc_id", "row"), F.coalesce("parts", F.lit(1)))
    tie = F.shiftrightunsigned(F.xxhash64("copy", share), 64 - BITS)
    items = lookup(rows, groups, ("copy",), ("copy",), ("row",)).select(
        "doc_id", "size", "text_crc32", "part", "row", tie.alias("tie"), *[F.coalesce(f"least_{d}", d).alias(d) for d in dims],
        F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("first"), F.lit(leaves).cast("long").alias("leaves"),
    )
    tree = _Tree(held(items, "items"), dims, target * tolerance, None if shards else target_bytes)
    while tree.split_level():
        pass
    if shards:
        return _slots(tree.items.withColumn("shard", F.col("first")))
    # one row per leaf
    leaf = tree.items.select("node").distinct().withColumn("shard", F.row_number().over(Window.orderBy("node")) - 1)
    return _slots(tree.items.join(few(held(leaf, "leaves")), "node"))


class _Tree:
    """Items with their node, its first leaf and number of leaves. Cuts are joined by node: broadcast while they are few,
    else by an exchange on nodes, each of which then has a small part of the bytes."""

    def __init__(self, items, dims, slack, target_bytes):
        self.items, self.dims, self.slack, self.target_bytes = items, dims, max(1.0, slack), target_bytes
        self.spread, self.depth = None, 0

    def split_level(self):
        """Splits each node that has more than one leaf; False if there is none."""
        if self.depth == DEPTH:
            return False
        ranges = [f(x).alias(f"{end}_{x}") for x in (*self.dims, "tie") for end, f in (("lo", F.min), ("hi", F.max))]
        stats = self.items.groupBy("node", "first", "leaves").agg(F.sum("size").alias("bytes"), *ranges)
        if self.target_bytes:
            stats = stats.withColumn("leaves", F.ceil(F.col("bytes") / F.lit(self.target_bytes)).cast("long"))
        stats = held(stats, "nodes")
        wide = {x: F.col(f"hi_{x}") - F.col(f"lo_{x}") for x in (*self.dims, "tie")}
        if self.spread is None:  # extents of the root: one row
            root = stats.select(*[wide[d].alias(d) for d in self.dims]).first()
            self.spread = {d: max(1, root[d]) if root else 1 for d in self.dims}
        widths = F.array(*[wide[d] / F.lit(self.spread[d]) for d in self.dims])
        dim = (F.array_position(widths, F.array_max(widths)) - 1).cast("int")
        ends = [F.shiftleft(F.element_at(F.array(*[f"{end}_{d}" for d in self.dims]), F.col("dim") + 1), BITS) for end in ("lo", "hi")]
        several = sum(wide.values()) > 0
        null = F.lit(None).cast("long")
        state = stats.where((F.col("leaves") > 1) & several).withColumn("dim", dim).select(
            "node", "leaves", "dim", ends[0].alias("lo"), (ends[1] + (1 << BITS) - 1).alias("hi"), F.lit(0).cast("long").alias("below"),
            (F.col("bytes") * F.expr("leaves DIV 2") / F.col("leaves")).alias("want"), null.alias("prior"), null.alias("top"),
        )
        state = held(state, "open")
        cuts, n = None, state.count()
        if not n:
            return False
        while n:
            state = held(self._narrow(state, n), "cuts")
            done = state.where("done").select("node", F.col("leaves").alias("of"), "dim", "cut")
            cuts = done if cuts is None else cuts.unionByName(done)
            state = state.where("NOT done")
            n = state.count()
        cuts = cuts.where("cut IS NOT NULL")
        right = F.coalesce(self._key(F.col("dim")) > F.col("cut"), F.lit(False))
        left = F.expr("of DIV 2")
        step = F.lit(1 << (DEPTH - 1 - self.depth)).cast("long")
        moved = self.items.join(few(cuts), "node", "left").withColumn("right", right)
        moved = moved.withColumns({
            "node": F.col("node") + F.when(F.col("right"), step).otherwise(0),
            "first": F.col("first") + F.when(F.col("right"), left).otherwise(0),
            "leaves": F.when(F.col("cut").isNull(), 1).when(F.col("right"), F.col("of") - left).otherwise(left).cast("long"),
        })
        self.items = held(moved.select(*self.items.columns), "items")
        self.depth += 1
        return True

    def _narrow(self, state, n):
        """One histogram pass: the bin of each node in which its quantile lies, and the cut if the bin is fine enough.

        A cut leaves keys on both sides: `top`, the largest key of the node, is never one, nor is there a cut below the
        smallest. A node of one key has none.
        """
        wanted = state.select("node", "leaves", "dim", "lo", "hi", "below", "want", F.col("prior").alias("earlier"), F.col("top").alias("known_top"))
        wanted = wanted.withColumn("step", F.expr(f"greatest(1, (hi - lo) DIV {BINS} + 1)"))
        by = ("node", "leaves", "dim", "below", "want", "earlier", "known_top")
        bins = (
            self.items.select("node", "size", "tie", *self.dims)
            .join(F.broadcast(wanted) if n <= FEW else wanted, "node")
            .withColumn("key", self._key(F.col("dim")))
            .where("key BETWEEN lo AND hi")
            .groupBy(*by, F.expr("(key - lo) DIV step").alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("last"))
        )
        w = Window.partitionBy("node").orderBy("bin")  # at most BINS + 1 rows of a node
        bins = bins.withColumn("reached", F.col("below") + F.sum("bytes").over(w)).withColumn("before", F.col("reached") - F.col("bytes"))
        bins = bins.withColumn("prior", F.coalesce(F.lag("last").over(w), "earlier"))
        bins = bins.withColumn("top", F.coalesce("known_top", F.max("last").over(Window.partitionBy("node"))))
        bins = bins.where("reached >= want").withColumn("nth", F.row_number().over(w)).where("nth = 1")
        single = F.col("least") == F.col("last")
        under = F.col("prior").isNotNull() & ((F.col("want") - F.col("before") < F.col("reached") - F.col("want")) | (F.col("last") == F.col("top")))
        cut = F.when(under, F.col("prior")).when(F.col("last") < F.col("top"), F.col("last"))
        fine = single | ((F.col("bytes") <= self.slack) & cut.isNotNull())
        return bins.select("node", "leaves", "dim", F.col("least").alias("lo"), F.col("last").alias("hi"), F.col("before").alias("below"), "want", "prior", "top", cut.alias("cut"), fine.alias("done"))

    def _key(self, dim):
        x = F.lit(None).cast("long")
        for i, d in enumerate(self.dims):
            x = F.when(dim == i, F.col(d)).otherwise(x)
        return F.shiftleft(x, BITS) + F.col("tie")


def _slots(rows):
    """Numbers rows in each shard: ranks inside (shard, input split), behind the counts of the earlier splits."""
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "part", "row")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", before.alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    out = rows.withColumn("rank", rank).join(starts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot"))
