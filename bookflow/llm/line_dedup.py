"""Line dedup that can be taken back: cuckoo filters over exact reference counts.

The state is a folder all executors share. `references` holds (key, doc_id, count) rows: +n when a document with n such
lines is inserted, -n when it is deleted; their sums are the exact counts. `filters` holds one cuckoo filter per shard of
the key space as a row of bytes. An insertion asks the filters first: keys they don't know are new and need no look-up in
the references; keys they may know are counted exactly. `candidates` are the keys that more than one document can hold:
those of two documents of one batch, and those a filter knew and the references confirmed. Only they are looked up when
lines are dropped. A deletion takes the keys whose count falls to nothing out of the filters again, so lines that were
dropped for the sake of a deleted document come back.

Keys are the 128-bit BLAKE2b digests of lines, stripped and lower-cased in A-Z. A shard's filter is made by one task; the
shards grow with the keys, before a batch is asked, so a task's keys are bounded by a multiple of `SHARD_KEYS`. A line
that every document holds is one row per document in the references, spread by (key, doc_id), and is pre-aggregated
before it is gathered by key. The lost keys of a document are gathered if its id is one row's only; rows of shared or
null ids ask for their own keys, so that no document of many rows is gathered.

Defined results: a null or empty text is one empty line; rows with equal doc_id are one document and lose the same lines;
rows of null doc_id are one document too, which comes after all others; lines of fewer than `least` code points always
stay; an empty table gives an empty one. Deleting an unknown document changes nothing.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import arrow, few, held, steps

BLANK = b" \t\n\x0b\x0c\r"
LEAST = 10
#: Keys a filter shard is made for.
SHARD_KEYS = 200_000
#: A filter is made with room for as many times its keys, and a shard takes as many times `SHARD_KEYS`.
ROOM = 2
SLOTS = 4


def line_key(line, least=LEAST):
    """Digest of a line's key, or None for a line that is too short."""
    key = line.strip(BLANK).lower()
    n = len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))
    return hashlib.blake2b(key, digest_size=16).digest() if n >= least else None


def lines_of(text):
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _keys(least):
    def run(batches):
        kinds = {"doc_id": pa.int64(), "key": pa.binary(), "n": pa.int64()}
        for batch in steps(batches, "text"):
            out = {k: [] for k in kinds}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = {}
                for line in lines_of(text):
                    key = line_key(line, least)
                    if key is not None:
                        found[key] = found.get(key, 0) + 1
                out["doc_id"] += [doc_id] * len(found)
                out["key"] += found.keys()
                out["n"] += found.values()
            yield arrow(out, kinds)

    return run


def _row_keys(least):
    """The distinct keys of each row, for rows that share an id."""

    def run(batches):
        kinds = {"row": pa.int64(), "_own_id": pa.int64(), "key": pa.binary()}
        for batch in steps(batches, "text"):
            out = {k: [] for k in kinds}
            for row, own, text in zip(*(batch.column(c).to_pylist() for c in ("row", "_own_id", "text"))):
                keys = {line_key(line, least) for line in lines_of(text)} - {None}
                out["row"] += [row] * len(keys)
                out["_own_id"] += [own] * len(keys)
                out["key"] += keys
            yield arrow(out, kinds)

    return run


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in either of two buckets. Inserts many keys at a time."""

    def __init__(self, table):
        self.table = table  # (buckets, SLOTS) uint16, 0 is free; the number of buckets is a power of two

    @classmethod
    def of(cls, keys, room=1):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, room * len(keys)) / (0.8 * SLOTS)))))
        while True:
            out = cls(np.zeros((buckets, SLOTS), np.uint16))
            if out.insert(keys):
                return out
            buckets *= 2

    @classmethod
    def read(cls, data):
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def places(self, keys):
        """Fingerprints and first buckets of 16-byte digests."""
        words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        prints = (words[:, 1] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (words[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def other(self, prints, buckets):
        mixed = prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return buckets ^ ((mixed >> np.uint64(24)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _put(self, prints, buckets):
        """Puts what finds a free slot, at most as many a bucket as are free; returns a mask of the rest."""
        order = np.argsort(buckets, kind="stable")
        b = buckets[order]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
        free = self.table[b] == 0
        fits = rank < free.sum(1)
        slot = (np.cumsum(free[fits], 1) == (rank[fits] + 1)[:, None]).argmax(1)
        self.table[b[fits], slot] = prints[order[fits]]
        left = np.ones(len(b), bool)
        left[order[fits]] = False
        return left

    def insert(self, keys, rounds=200):
        """False if some keys found no place: the filter is then too full and has to be made anew."""
        prints, buckets = self.places(keys)
        for use in (buckets, None):
            at = buckets if use is not None else self.other(prints, buckets)
            left = self._put(prints, at)
            prints, buckets = prints[left], buckets[left]
        for turn in range(rounds):
            if not len(prints):
                return True
            # one eviction a bucket and turn; the evicted go to their other bucket
            _, one = np.unique(buckets, return_index=True)
            slot = turn % SLOTS
            out = self.table[buckets[one], slot].copy()
            self.table[buckets[one], slot] = prints[one]
            prints, buckets = prints.copy(), buckets.copy()
            prints[one] = out
            buckets[one] = self.other(out, buckets[one])
            left = self._put(prints, buckets)
            prints, buckets = prints[left], buckets[left]
        return False

    def holds(self, keys):
        """False: certainly not inserted. True: probably."""
        prints, buckets = self.places(keys)
        here = (self.table[buckets] == prints[:, None]).any(1)
        return here | (self.table[self.other(prints, buckets)] == prints[:, None]).any(1)

    def delete(self, keys):
        """Takes out one fingerprint for each key, which must have been inserted."""
        prints, first = self.places(keys)
        for p, a, b in zip(prints, first, self.other(prints, first)):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == p)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


class LineIndex:
    """Inserted documents' lines; all methods return or write tables, the driver sees none of their rows."""

    REFERENCES = "key binary, doc_id long, n long"
    FILTERS = "shard int, keys long, filter binary"

    def __init__(self, spark, least=LEAST, shards=None):
        self.spark, self.least, self.shards = spark, least, shards or 1
        self.references = None  # signed counts: a table for each change
        self.candidates = None  # keys that several documents may hold: a table for each insertion
        self.ids = None  # rows of each inserted doc_id: a table for each insertion
        self.filters = None
        self.keys = self.changes = 0

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def insert(self, docs):
        """Adds documents(doc_id, text). Returns keys(key, known) of the batch: known if earlier documents hold the key."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        lines = docs.mapInArrow(_keys(self.least), "doc_id long, key binary, n long").groupBy("key", "doc_id").agg(F.sum("n").alias("n"))
        batch = held(lines, "references")
        ids = held(docs.groupBy("doc_id").agg(F.count("*").alias("rows")), "ids")
        self.changes += 1
        keys = held(batch.groupBy("key").agg((F.count("*") > 1).alias("shared")), "batch_keys")
        n = keys.count()
        known = self._known(keys, n) if self.filters is not None else keys.select("key", "shared", F.lit(False).alias("known"))
        self.keys += n
        candidates = known.where("shared OR known").select("key")
        if self.filters is None:
            self.references, self.candidates, self.ids = batch, candidates, ids
            self._make_filters()
            return known.select("key", "known")
        self._grow(known.where("NOT known").select("key"))
        self.references = self.references.unionByName(batch)
        self.candidates = self.candidates.unionByName(candidates)
        self.ids = self.ids.unionByName(ids)
        if self.filters.where("keys < 0").limit(1).count():
            self._make_filters()
        return known.select("key", "known")

    def _known(self, keys, n):
        """Which keys earlier documents hold: those a filter may know are counted in the references, no others."""
        if self.keys + n > ROOM * SHARD_KEYS * self.shards:
            self._make_filters(self.keys + n)
        asked = self._beside_filters(keys, _asked, "key binary, shared boolean, maybe boolean")
        asked = held(asked, "asked")
        counted = self._counts(self.references.join(asked.where("maybe").select("key"), "key", "left_semi"))
        hits = counted.where("n > 0").select("key", F.lit(True).alias("hit"))
        return held(asked.join(hits, "key", "left").select("key", "shared", F.coalesce("hit", F.lit(False)).alias("known")), "known")

    def _beside_filters(self, keys, fn, schema):
        """`fn` of the keys of a shard and its filter."""
        return keys.withColumn("shard", self._shard()).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(fn, schema)

    def _grow(self, new):
        self.filters = held(self._beside_filters(new, _grown, self.FILTERS), "filters")

    def _make_filters(self, keys=None):
        """All filters from the exact counts, in as many shards as the keys need."""
        live = self._counts(self.references).where("n > 0").select("key")
        self.shards = max(self.shards, -(-(keys or self.keys) // SHARD_KEYS))
        self.filters = held(live.select("key", self._shard()).groupBy("shard").applyInPandas(_made, self.FILTERS), "filters")

    def delete(self, doc_ids):
        """Takes the documents of doc_ids(doc_id) back, with all their lines; a null takes back the rows without an id."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("_gone")).distinct()
        gone = self.references.join(ids, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi")
        gone = held(gone.groupBy("key", "doc_id").agg((-F.sum("n")).alias("n")).where("n <> 0"), "deleted")
        self.references = self.references.unionByName(gone)
        self.changes += 1
        touched = self.references.join(gone.select("key").distinct(), "key", "left_semi")
        empty = self._counts(touched).where("n = 0").select("key")
        self.filters = held(self._beside_filters(empty, _shrunk, self.FILTERS), "filters")

    @staticmethod
    def _counts(references):
        return references.groupBy("key").agg(F.sum("n").alias("n"))

    def dropped(self):
        """(doc_id, key): lines that a document loses, as another of smaller doc_id holds them. Only candidates are looked up."""
        live = self.references.join(self.candidates.distinct(), "key", "left_semi")
        if self.changes > 1:
            live = live.groupBy("key", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        live = held(live.select("key", "doc_id"), "live")
        one = live.groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("keeper"))
        shared = held(one.where("docs > 1").select("key", "keeper"), "shared_lines")
        return live.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "key")

    def apply(self, docs, carried=("doc_id",)):
        """docs with `text` without the lines they lose, and n_lines, n_dropped. `carried` columns are kept as they are."""
        carried = list(carried)
        kinds = dict(docs.select(*carried, "text").dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried if c != "text") + ", text string, n_lines long, n_dropped long"
        own = F.col("doc_id").cast("long").alias("_own_id")
        docs = docs.select(*carried, "text", own)
        without = _without([c for c in carried if c != "text"], self.least)
        lost = held(self.dropped().select(F.col("doc_id").alias("_lost_id"), "key"), "lost")
        many = held(self.ids.groupBy("doc_id").agg(F.sum("rows").alias("rows")).where("rows > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_many")), "shared_ids")
        mine = F.col("_own_id").eqNullSafe(F.col("_lost_id"))
        of_many = F.col("_own_id").eqNullSafe(F.col("_many"))
        lost_many = F.col("_lost_id").eqNullSafe(F.col("_many"))
        shared_ids = bool(many.limit(1).count())
        single, alone = (docs.join(few(many), of_many, "left_anti"), lost.join(few(many), lost_many, "left_anti")) if shared_ids else (docs, lost)
        gone = alone.groupBy("_lost_id").agg(F.collect_list("key").alias("_lost_keys"))  # lines of one row
        out = single.join(gone, mine, "left").select(*carried, "text", "_lost_keys").mapInArrow(without, schema)
        if not shared_ids:
            return out
        rows = held(docs.join(few(many), of_many, "left_semi").withColumn("row", F.monotonically_increasing_id()), "rows_of_shared_ids")
        keys = rows.select("row", "_own_id", "text").mapInArrow(_row_keys(self.least), "row long, _own_id long, key binary")
        taken = keys.join(lost.join(few(many), lost_many, "left_semi").withColumnRenamed("key", "_key"), mine & (F.col("key") == F.col("_key")))
        taken = taken.groupBy("row").agg(F.collect_list("key").alias("_lost_keys"))  # lines of one row
        return out.unionByName(rows.join(taken, "row", "left").select(*carried, "text", "_lost_keys").mapInArrow(without, schema))


def _filters(shard, table, n):
    return pd.DataFrame({"shard": [shard], "keys": [n], "filter": [table.table.tobytes()]})


def _made(keys):
    return _filters(keys["shard"].iloc[0], CuckooFilter.of(list(keys["key"]), ROOM), len(keys))


def _asked(keys, filters):
    if keys.empty:
        return pd.DataFrame({"key": [], "shared": [], "maybe": []})
    maybe = CuckooFilter.read(filters["filter"].iloc[0]).holds(list(keys["key"])) if len(filters) else np.zeros(len(keys), bool)
    return pd.DataFrame({"key": keys["key"], "shared": keys["shared"], "maybe": maybe})


def _grown(keys, filters):
    shard = (keys if len(keys) else filters)["shard"].iloc[0]
    if keys.empty:
        return filters
    if filters.empty:
        return _filters(shard, CuckooFilter.of(list(keys["key"]), ROOM), len(keys))
    have, n = CuckooFilter.read(filters["filter"].iloc[0]), int(filters["keys"].iloc[0])
    if n + len(keys) <= 0.9 * have.table.size:
        if have.insert(list(keys["key"])):
            return _filters(shard, have, n + len(keys))
    return pd.DataFrame({"shard": [shard], "keys": [-1], "filter": [b""]})  # too full: insert() makes all filters anew


def _shrunk(keys, filters):
    if keys.empty or filters.empty:
        return filters
    have = CuckooFilter.read(filters["filter"].iloc[0])
    have.delete(list(keys["key"]))
    return _filters(filters["shard"].iloc[0], have, int(filters["keys"].iloc[0]) - len(keys))


def _without(carried, least):
    def run(batches):
        kinds = {"text": pa.string(), "n_lines": pa.int64(), "n_dropped": pa.int64()}
        for batch in steps(batches, "text"):
            texts, counts, dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("_lost_keys").to_pylist()):
                lines = lines_of(text)
                kept = lines
                if keys:
                    keys = set(keys)
                    kept = [line for line in lines if line_key(line, least) not in keys]
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield arrow({c: batch.column(c) for c in carried} | {"text": texts, "n_lines": counts, "n_dropped": dropped}, kinds)

    return run
