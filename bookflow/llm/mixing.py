"""Mixes sources to target weights by blocks of words, with DataFrame functions only.

The words of a source, document after document, form blocks of `block` words. The mix is a row of output slots, dealt to
output shards; a shard's slots are drawn from the sources multinomially, of which the whole parts of the expected counts
are given and the rest is drawn (residual sampling: the same means, less variance). Slot j of a source takes the block that
a pseudorandom permutation of the source's block numbers maps j to; after all blocks are taken a new permutation begins, up
to `most` of them. Taken blocks are counted by number and joined to the documents that lie in them.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating; they share `share` of all words by weight, none gets
more than `most` times its words, and what is above is shared again by weight.

Words before a document in its source come from two-level prefix sums: over hash buckets of the source, and inside a bucket
by doc_id. So a source with a third of all rows is spread over all tasks. Only hashes of ids decide, so reruns agree.

Defined results: null and empty texts have no words, and nothing of them is taken; a null source is a source; a source
without words has target 0; repeated rows are rows of their own; an empty table gives an empty mix.
"""

import math
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WHITE, WORD, fraction, held

WEIGHTS = (3, 1, 2)
#: Slots of an output shard.
SHARD_SLOTS = 65_536
ROUNDS = 16
#: Stands for a null id in keys.
NO_ID = -(1 << 63)


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(index, size, *keys, rounds=ROUNDS):
    """A pseudorandom permutation of 0..size-1 for each value of the keys: a swap-or-not shuffle."""
    # aggregate() keeps the rounds' expression from doubling with each round
    rounds_ = F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(rounds_, index.cast("long"), lambda x, r: _turn(x, r, size, keys))


def _turn(x, r, size, keys):
    partner = F.pmod(F.pmod(F.xxhash64(F.lit("key"), r, *keys), size) - x, size)
    return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(x, partner), *keys) % 2 == 0, partner).otherwise(x)


def _copy():
    return F.xxhash64("text", "source")


class Mixture:
    """docs(doc_id, text, source); `seed` changes the draw."""

    def __init__(self, docs, weights=WEIGHTS, share=1.5, most=2, block=128, seed=0):
        self.most, self.block, self.seed = most, block, seed
        self.rows = held(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _copy().alias("copy")), "sizes")
        self.sources = held(self._sources(weights, share), "sources")
        self.offsets = held(self._offsets(), "offsets")

    def _sources(self, weights, share):
        """One row per source: sid, words, weight, target, blocks, slots a shard, residual interval, shards."""
        by_name = Window.orderBy(F.col("source").asc_nulls_last())
        s = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        s = s.withColumn("sid", F.row_number().over(by_name) - 1)
        pick = reduce(lambda x, i: F.when(F.col("sid") % len(weights) == i, weights[i]).otherwise(x), range(len(weights)), F.lit(None))
        s = s.withColumn("weight", pick.cast("double")).withColumn("ratio", F.col("source_size") / F.col("weight"))
        # sources reach their limit in order of ratio; those before are full, the rest shares what is left by weight
        whole, order = Window.partitionBy(), Window.orderBy("ratio", "sid")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        limit = F.lit(self.most) * F.col("source_size")
        s = s.withColumn("budget", F.lit(share) * F.sum("source_size").over(whole)).withColumn("limit", limit)
        s = s.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0))).withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        level = (F.col("budget") - F.col("full")) / F.col("rest")
        s = s.withColumn("level", level).withColumn("is_full", F.col("level") * F.col("weight") >= F.col("limit"))
        # the level of the first source that isn't full holds for it and all after it
        s = s.withColumn("final", F.min(F.when(~F.col("is_full"), F.struct("ratio", "sid", "level"))).over(whole)["level"])
        s = s.withColumn("target", F.when(F.col("is_full"), F.col("limit")).otherwise(F.col("final") * F.col("weight")).cast("double"))
        s = s.withColumn("blocks", F.ceil(F.col("source_size") / self.block))
        s = s.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
        s = s.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("expected").over(whole) / SHARD_SLOTS)))
        s = s.withColumn("mean", F.col("expected") / F.col("shards")).withColumn("given", F.floor("mean"))
        s = s.withColumn("part", F.col("mean") - F.col("given"))
        s = s.withColumn("hi", F.sum("part").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
        s = s.withColumn("draws", F.round(F.sum("part").over(whole)).cast("int")).withColumn("all", F.sum("part").over(whole))
        return s.select("source", "sid", "source_size", "weight", "target", "blocks", "shards", "given", (F.col("hi") - F.col("part")).alias("lo"), "hi", "draws", "all")

    def _offsets(self):
        """Rows with `off`, the words before them in their source."""
        buckets = max(1, math.isqrt(self.rows.count()))  # as many as rows in each, so neither sum grows with all rows
        ids = self.sources.select(F.col("source").alias("own"), "sid", "source_size", "target")
        rows = self.rows.join(ids, F.col("source").eqNullSafe(F.col("own"))).drop("source", "own")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)))
        before = F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")
        starts = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", before.alias("start"))
        w = Window.partitionBy("sid", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "copy", "size")
        rows = rows.withColumn("inside", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        off = (F.col("start") + F.col("inside")).alias("off")
        return rows.join(starts, ["sid", "bucket"]).select("doc_id", "copy", "size", "sid", "source_size", "target", off)

    def draws(self):
        """(sid, shard, n, first): slots of each source in each output shard, numbered on through the shards."""
        s = self.sources.where("blocks > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
        u = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda i: fraction(F.lit(self.seed), F.col("shard"), i) * F.col("all"))
        hit = F.when(F.col("draws") > 0, F.size(F.filter(u, lambda x: (x >= F.col("lo")) & (x < F.col("hi"))))).otherwise(0)
        s = s.withColumn("n", F.col("given") + hit)
        first = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
        return s.select("sid", "shard", "blocks", "n", first.alias("first"))

    def slots(self):
        """The mix: (sid, shard, slot, pass, block). No block is taken more than `most` times."""
        s = self.draws().withColumn("stop", F.least(F.col("first") + F.col("n"), F.lit(self.most) * F.col("blocks"))).where("stop > first")
        # a source's shards are spread again, and long runs cut, before they are written out slot by slot
        run = 4096
        runs = F.sequence(F.col("first"), F.col("stop") - 1, F.lit(run).cast("long"))
        s = s.select("sid", "shard", "blocks", "stop", F.explode(runs).alias("run"))
        # by a stated number: a few rows of runs would else be gathered in one task, which then writes all slots
        s = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "shard", "run")
        s = s.select("sid", "shard", "blocks", F.explode(F.sequence("run", F.least(F.col("run") + run, F.col("stop")) - 1)).alias("slot"))
        s = s.withColumn("pass", F.expr("slot DIV blocks"))
        block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(self.seed), F.col("sid"), F.col("pass"))
        return s.select("sid", "shard", "slot", "pass", block.alias("block"))

    def pieces(self):
        """Parts of documents by block: (row columns, block, from_word, words, times), times being how often the mix takes it."""
        times = self.slots().groupBy("sid", "block").agg(F.count("*").alias("times"))
        b = self.block
        blocks = F.expr(f"CASE WHEN size > 0 THEN sequence(off DIV {b}, (off + size - 1) DIV {b}) END")
        parts = self.offsets.select("*", F.explode_outer(blocks).alias("block"))
        start = F.greatest(F.col("block") * b, F.col("off"))
        stop = F.least((F.col("block") + 1) * b, F.col("off") + F.col("size"))
        parts = parts.withColumn("from_word", start - F.col("off")).withColumn("words", stop - start)
        # what generates the slots is a small table, so their number can't be seen in the plan: never to be broadcast
        return parts.join(times.hint("merge"), ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def documents(self):
        """doc_id, size, source_size, target, taken of each row."""
        row = ("doc_id", "copy", "size", "sid", "off", "source_size", "target")
        # rows without words share a place; a count keeps each of them
        taken = F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken")
        some = self.pieces().where("size > 0").groupBy(*row).agg(taken)
        none = self.offsets.where("size = 0").select(*row, F.lit(0).cast("long").alias("taken"))
        return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")

    def texts(self, docs):
        """The mix as documents: rows of docs once for each pass that takes words of them, with the words it takes as text.

        Columns are those of docs. Words keep the white space behind them; a row that is taken whole keeps its text.
        """
        spans = F.array_sort(F.collect_list(F.struct("from_word", "words", "times"))).alias("_spans")
        taken = self.pieces().where("times > 0").groupBy("doc_id", "copy", "size", "sid", "off").agg(spans)
        again = F.row_number().over(Window.partitionBy("_id", "_copy").orderBy("_at"))
        taken = taken.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("copy").alias("_copy"), F.col("off").alias("_at"), "size", "_spans")
        taken = taken.withColumn("_again", again).drop("_at")
        names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
        rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), _copy().alias("_copy"), *[F.col(c).alias(n) for c, n in names.items()])
        rows = rows.withColumn("_at", F.col("_copy")).withColumn("_again", again).drop("_at")
        text = F.col(names["text"])
        passes = F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))).alias("_pass")
        mix = rows.join(taken, ["_id", "_copy", "_again"]).select(*names.values(), "size", "_spans", passes)
        mix = mix.withColumn("_own", F.filter("_spans", lambda s: s["times"] > F.col("_pass"))).where("size(_own) > 0")
        words = F.aggregate("_own", F.lit(0).cast("long"), lambda n, s: n + s["words"])
        parts = F.regexp_extract_all(text, F.lit(rf"{WORD}[{WHITE}]*"), F.lit(0))
        cut = F.transform("_own", lambda s: F.array_join(F.slice("_parts", (s["from_word"] + 1).cast("int"), s["words"].cast("int")), ""))
        partly = words < F.col("size")
        mix = mix.withColumn("_parts", F.when(partly, parts)).withColumn("_text", F.when(partly, F.array_join(cut, "")).otherwise(text))
        out = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
        return mix.select(*[out.get(c, F.col(n)).alias(c) for c, n in names.items()])
