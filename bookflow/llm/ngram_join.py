"""Near-duplicate texts by Jaccard of word n-grams, found by MinHash bands.

1. Each text becomes its set of n-grams (hashes of n lower-cased words), known by a 128-bit digest, and the minima of the
   set under `hashes` random functions, cut into bands. Rows and bands are chosen for the recall asked for: the most rows
   per band with which a pair at the threshold still meets in some band with that probability.
2. Texts of one digest are one class, so copies go on as one row. Classes that share a band are linked to the smallest of
   them: a star, not all pairs. Connected components of the stars hold all candidate pairs.
3. Inside a component all pairs are compared on full n-gram sets, in blocks of classes: a component of any size is dealt
   out by pairs of blocks, and a task sees two blocks. A block gives its link counts and a tree of its links, no pairs.
4. Components of the links found give the class ids.

Classes are numbered when their table is written, one number for each 128-bit digest, so ids decide nothing while they are
compared: rows without an id and different texts under one id are linked like all others. A class and a component get the
smallest id of their rows, null if none has one.

Defined results: null and empty texts have no n-grams and are one class; a text of fewer than n words is one n-gram of all
its words; repeated rows are rows of their own and no link; n_links counts the other texts of a row's class and the texts
of linked classes; an empty table gives an empty one.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import arrow, held, steps
from .components import components

N = 5
THRESHOLD = 0.8
#: Classes in a block of a component, and in a work unit of small components; a block of long texts is fuller in bytes of n-grams.
BLOCK = 128
BLOCK_BYTES = 16 << 20
SEED = 20240229

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS = {}


def mixed(h):
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


def powers(n):
    """Odd multipliers by position in a word; words longer than the table share its last part in turn."""
    if n not in _POWERS:
        _POWERS[n] = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _POWERS[n]


def word_hashes(raw):
    """64-bit hashes of the words of lower-cased bytes: sums of bytes weighted by place, and the length, mixed."""
    data = np.frombuffer(raw, np.uint8)
    solid = (data != 32) & ((data < 9) | (data > 13))
    if not solid.any():
        return np.zeros(0, np.uint64)
    edges = np.flatnonzero(np.diff(np.r_[False, solid, False].astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    length = last - first
    begin = np.zeros(len(data), np.int64)
    begin[first] = first
    place = np.arange(len(data)) - np.maximum.accumulate(begin)
    weights = powers(4096)[place & 4095] + (place >> 12).astype(np.uint64)
    terms = np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * weights, np.uint64(0))
    return mixed(np.add.reduceat(terms, first) + length.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def ngrams(text, n=N):
    """Sorted distinct n-gram hashes of a text."""
    words = word_hashes((text or "").lower().encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    k = max(1, len(words) - n + 1)
    grams = np.zeros(k, np.uint64)
    for i in range(min(n, len(words))):
        grams = mixed(grams + words[i : i + k] + np.uint64(i + 1))
    return np.unique(grams)


def bands_for(threshold, recall, hashes):
    """(bands, rows): the most rows per band that keep the recall at the threshold with that many hash functions."""
    fits = [(hashes // r, r) for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall]
    return max(fits, key=lambda x: x[1]) if fits else (hashes, 1)


class Signer:
    def __init__(self, bands, rows):
        rng = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def bands_of(self, sets):
        """Band hashes (texts x bands) of non-empty sets."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.zeros((len(sets), self.bands), np.uint64)
        x = np.empty_like(flat)
        for i, (a, b) in enumerate(zip(self.a, self.b)):
            np.multiply(flat, a, out=x)
            np.add(x, b, out=x)
            least = np.minimum.reduceat(x, starts)
            band = i // self.rows
            out[:, band] = mixed(out[:, band] + least + np.uint64(i + 1))
        return out.view(np.int64)


def _signed(n, bands, rows):
    def run(batches):
        signer = Signer(bands, rows)
        for batch in steps(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            sets = [ngrams(t, n) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            found = [None] * len(texts)
            if some:
                for i, row in zip(some, signer.bands_of([sets[i] for i in some])):
                    found[i] = row
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            out = {"doc_id": batch.column("doc_id"), "copy": batch.column("copy"), "digest": digest, "n_grams": [len(s) for s in sets], "bands": found}
            yield arrow(out, {"digest": pa.binary(), "n_grams": pa.int64(), "bands": pa.list_(pa.int64())})

    return run


def _sets(n):
    def run(batches):
        for batch in steps(batches, "text"):
            sets = [ngrams(t, n).tobytes() for t in batch.column("text").to_pylist()]
            yield arrow({c: batch.column(c) for c in batch.schema.names if c != "text"} | {"grams": sets}, {"grams": pa.binary()})

    return run


def intersections(sets):
    """Sizes of all pairwise intersections of sorted arrays, from incidence matrices of the n-grams that two or more hold."""
    k = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code, owner = code[shared], owner[shared]
    out = np.zeros((k, k), np.float64)
    _, code = np.unique(code, return_inverse=True)
    width = int(code.max()) + 1 if len(code) else 0
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = 8192
    edges = np.searchsorted(code, np.arange(0, width + step, step))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            m = np.zeros((k, min(step, width - i * step)), np.float32)
            m[owner[a:b], code[a:b] - i * step] = 1
            out += m @ m.T
    return out


def compared(block, threshold):
    """Links of one unit: rows of (component, a, b) groups; pairs inside block a if a = b, else between the blocks."""
    out = []
    for (_, a, b), group in block.groupby(["component", "block_a", "block_b"], sort=False):
        if len(group) < 2:
            continue
        sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
        size = np.array([len(s) for s in sets])
        common = intersections(sets)
        near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(near, False)
        if a != b:
            left = group["own_block"].to_numpy() == a
            near &= left[:, None] != left[None, :]
        if not near.any():
            continue
        ids = group["class_id"].to_numpy()
        links = (near * group["n_texts"].to_numpy()[None, :]).sum(1)
        # the tree of links: each class and the smallest class reached from it
        root = np.arange(len(ids))
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = rank.copy()
        while True:
            reach = np.where(near, root[None, :], len(ids)).min(1)
            new = np.minimum(root, reach)
            new = new[order[new]]
            if (new == root).all():
                break
            root = new
        linked = near.any(1)
        out.append(pd.DataFrame({"class_id": ids[linked], "root": ids[order[root]][linked], "links": links[linked].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"class_id": [], "root": [], "links": []}).astype(np.int64)


def near_duplicates(docs, n=N, threshold=THRESHOLD, recall=0.9995, hashes=256, block=BLOCK):
    """docs(doc_id, text) -> doc_id, class_id (smallest doc_id of its component), set_id (of its n-gram set), n_links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed, named = _grouped(docs, n, threshold, recall, hashes, block)
    return signed.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "set_id", "n_links")


def _own(doc_id):
    """The id as a join key that is never null."""
    return F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))


def _copy(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def representatives(docs, n=N, threshold=THRESHOLD, recall=0.9995, hashes=256, block=BLOCK):
    """docs(doc_id, text, ...) -> one row of each component, unchanged: smallest id, nulls last, then smallest digest of the text.

    Repeated rows are made one before the exchange; the exchange of texts by (id, text digest) also serves the choice.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(_own(F.col("doc_id")).alias("_own"), _copy(F.col("text")).alias("_copy"), *[F.col(c).alias(m) for c, m in names.items()])
    signed, named = _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, threshold, recall, hashes, block)
    # the first (id, digest) of each component, by partial aggregates; a pair of them is in one class of texts
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("copy").alias("copy"))
    chosen = signed.select("doc_id", "copy", "digest").join(named.select("digest", "component"), "digest").groupBy("component").agg(F.min(order).alias("s"))
    chosen = held(chosen.select(_own(F.col("s.id")).alias("_own"), F.col("s.copy").alias("_copy")), "chosen")
    once = rows.groupBy("_own", "_copy").agg(F.min(F.struct(*[F.col(names[c]) for c in docs.columns if c != "text"], F.col(names["text"]))).alias("s"))
    near = once.join(chosen.hint("merge"), ["_own", "_copy"], "left_semi")
    return near.select(*[F.col(f"s.{m}").alias(c) for c, m in names.items()])


def _grouped(docs, n, threshold, recall, hashes, block):
    """(signed rows: doc_id, copy, digest; classes: digest, component, class_id, set_id, n_links)."""
    bands, rows = bands_for(threshold, recall, hashes)
    texts = docs.select("doc_id", _copy(F.col("text")).alias("copy"), "text")
    signed = held(texts.mapInArrow(_signed(n, bands, rows), "doc_id long, copy binary, digest binary, n_grams long, bands array<bigint>"), "signed")
    # classes: one n-gram set each; n_texts counts different texts. Its text is the one of the smallest id, or of the smallest digest
    copies = signed.groupBy("digest", "copy").agg(F.min("doc_id").alias("doc_id"), F.first("n_grams").alias("n_grams"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("copy").alias("copy"))).alias("s")
    classes = copies.groupBy("digest").agg(first, F.count("*").alias("n_texts"), F.first("n_grams").alias("n_grams"))
    # numbers are exact: they are given once, when the table is written
    classes = held(classes.select("digest", F.monotonically_increasing_id().alias("set_key"), F.col("s.id").alias("set_id"), F.col("s.copy").alias("set_copy"), "n_texts", "n_grams"), "classes")
    mine = classes.where("n_grams > 0").select("digest", F.col("set_copy").alias("copy"), "set_key")
    own = signed.where("bands IS NOT NULL").join(mine.hint("merge"), ["digest", "copy"]).select("set_key", "bands").dropDuplicates(["set_key"])
    own = held(own, "class_bands")
    keys = own.select("set_key", F.posexplode("bands").alias("band", "value")).select("set_key", F.xxhash64("band", "value").alias("bucket"))
    stars = keys.groupBy("bucket").agg(F.min("set_key").alias("centre"), F.count("*").alias("size")).where("size > 1").select("bucket", "centre")
    edges = keys.join(held(stars, "buckets"), "bucket").where("set_key <> centre").select(F.col("set_key").alias("a"), F.col("centre").alias("b")).distinct()
    found = components(held(edges, "candidates"))
    links = held(_verified(docs, classes.drop("digest", "set_id"), found, n, threshold, block), "links")
    counted = links.groupBy("class_id").agg(F.sum("links").alias("links"))
    joined = components(held(links.where("class_id <> root").select(F.col("class_id").alias("a"), F.col("root").alias("b")).distinct(), "tree"))
    named = classes.join(counted.withColumnRenamed("class_id", "set_key"), "set_key", "left").join(joined.withColumnRenamed("id", "set_key"), "set_key", "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links")
    named = held(named.select("digest", "set_id", F.coalesce("component", "set_key").alias("component"), links), "named")
    least = named.groupBy("component").agg(F.min("set_id").alias("class_id"))
    return signed, held(named.join(least, "component").select("digest", "component", "class_id", "set_id", "n_links"), "classed")


def _verified(docs, classes, found, n, threshold, block):
    """(class_id, root, links) of all blocks; a class of a large component is in as many pairs of blocks as there are blocks.

    Texts go through one exchange by their digest, of which only those of classes in components come out; copies are made
    one before it. The plan is the same at every size. A block holds `block` classes or BLOCK_BYTES of n-grams on average.
    """
    placed = found.join(classes, F.col("id") == F.col("set_key")).select("set_key", "set_copy", "component", "n_texts", "n_grams")
    sizes = placed.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_grams") * 8 / BLOCK_BYTES)).alias("blocks"))
    placed = held(placed.join(sizes, "component"), "placed")
    texts = docs.groupBy(_copy(F.col("text")).alias("set_copy")).agg(F.first("text").alias("text"))
    here = texts.join(placed.hint("merge"), "set_copy").select("set_key", "component", "blocks", "n_texts", "text")
    sets = here.mapInArrow(_sets(n), "set_key long, component long, blocks long, n_texts long, grams binary")
    sets = sets.withColumn("own_block", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = sets.select(F.col("set_key").alias("class_id"), "component", "n_texts", "grams", "own_block", other)
    dealt = dealt.withColumn("block_a", F.least("own_block", "other")).withColumn("block_b", F.greatest("own_block", "other")).drop("other")
    # small components share a unit of work; a pair of blocks of a large one is dealt like them
    whole = placed.agg(F.ceil(F.greatest(F.sum("blocks") / block, F.sum(F.col("blocks") * F.col("n_grams")) * 8 / BLOCK_BYTES))).first()[0] or 0
    unit = F.pmod(F.xxhash64("component", "block_a", "block_b"), F.lit(max(1, int(whole))))
    return dealt.withColumn("unit", unit).groupBy("unit").applyInPandas(lambda g: compared(g, threshold), "class_id long, root long, links long")
