"""Phrase collocation mining with counting quotient filters.

1. Texts are read once and kept as blocks: the numbers of a block's words in order, with a break between pieces of text,
   and its dictionary. A block has about `block_bytes` of text and is the only thing a task holds of it.
2. The words of the dictionaries are dealt to shards by language and word, once. A shard counts its words over all blocks, gives those
   of `least` occurrences or more a number, and tells each block the numbers of its words in one packed row.
3. An n-gram is packed as two numbers: that of its first and that of its last n - 1 words (for n = 2 the two word ids). Both
   must be frequent, as a phrase is no more frequent than its parts; so nothing that could reach `least` is left out.
   Each block counts its pairs in counting quotient filters (`quotient_filter`), one a shard; a shard merges the filters
   of all blocks, keeps what is frequent, and tells each block which of its pairs that are. One round for each length.
4. Frequent phrases carry the counts of all their beginnings and ends, from which all cuts are scored.

No table grows in one place: blocks and shards are bounded by their parameters, pairs are spread over the shards evenly
whatever word is frequent, and what goes back to a block is what it sent. Nothing but one row per language is broadcast, and that only
after it is counted. Every round is written to the shared folder.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count again; an empty table
gives an empty one. Scores are exact decimals.
"""

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import few, held, steps

UNKNOWN = "und"
LEAST = 100
LONGEST = 5
TOP = 2000
BLOCK_BYTES = 4 << 20
#: Pairs, before equal ones are joined, that a shard gets on average.
SHARD_PAIRS = 1_000_000
#: Shards of words at least, so that many tasks share a small table.
WORD_SHARDS = 64

#: Bytes that end a piece of text. The byte 0xFF, which no UTF-8 text has, stands for them.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BREAKS, b"\xff" * len(_BREAKS))


class _Words(dict):
    """Numbers of the words of one language in a block; a new word gets the next one of the block."""

    def __init__(self, lang, names):
        super().__init__({b"\xff": -1})
        self.lang, self.names = lang, names

    def __missing__(self, word):
        number = self[word] = len(self.names)
        self.names.append((self.lang, word))
        return number


class _Block:
    def __init__(self):
        self.names, self.parts, self.bytes = [], [], 0
        self.langs = {}

    def add(self, lang, text):
        words = self.langs.get(lang)
        if words is None:
            words = self.langs[lang] = _Words(lang, self.names)
        tokens = text.lower().translate(_TABLE).replace(b"\xff", b" \xff ").split()
        tokens.append(b"\xff")
        self.parts.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
        self.bytes += len(text)

    def batch(self, number):
        numbers = np.concatenate(self.parts)
        count = np.bincount(numbers[numbers >= 0], minlength=len(self.names))
        # frequent words get small numbers, which pack better
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order) + 1, np.int32)
        rank[order] = np.arange(len(order))
        rank[-1] = -1
        entry = pa.StructArray.from_arrays(
            [pa.array([self.names[k][0] for k in order], pa.string()), pa.array([self.names[k][1] for k in order], pa.binary()), pa.array(count[order], pa.int64())],
            ["lang", "word", "count"],
        )
        entries = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), entry)
        numbers = _tight(rank[numbers])
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_stored(numbers)], pa.binary()), pa.array([len(numbers)], pa.int64()), entries], ["block", "numbers", "n", "entries"])


def _tight(numbers):
    """Without breaks at the ends and after other breaks."""
    keep = (numbers >= 0) | np.r_[False, numbers[:-1] >= 0]
    return numbers[keep]


def _blocks(limit):
    def run(batches):
        task, made, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in steps(batches, "text", limit):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if block.bytes >= limit:
                    yield block.batch((task << 32) + made)
                    made, block = made + 1, _Block()
                if text:
                    block.add(lang, text)
        if block.parts:
            yield block.batch((task << 32) + made)

    return run


def _stored(numbers):
    """Numbers packed by zstd, in four bytes each if all fit, else in eight; the head tells the size of one and of all."""
    size = 4 if numbers.max(initial=0) < 1 << 31 else 8
    raw = numbers.astype(f"<i{size}").tobytes()
    return struct.pack("<Bq", size, len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _numbers(raw):
    size, whole = struct.unpack_from("<Bq", raw)
    return np.frombuffer(pa.decompress(raw[9:], whole, "zstd", asbytes=True), f"<i{size}").astype(np.int64)


def _block(block, numbers):
    numbers = _tight(numbers)
    return pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([_stored(numbers)], pa.binary()), pa.array([len(numbers)], pa.int64())], ["block", "numbers", "n"])


def _pairs(numbers):
    """Neighbours of which both are frequent."""
    both = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
    return both, numbers[both], numbers[both + 1]


def _filters(width, shard_bits):
    def run(batches):
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("numbers")):
                _, a, b = _pairs(_numbers(raw.as_py()))
                if not len(a):
                    continue
                left, right, count = qf.sorted_counts(*qf.permute(a, b, width), np.ones(len(a), np.int64), width)
                shard = (left >> np.uint64(width - shard_bits)).astype(np.int64)
                edges = np.searchsorted(shard, np.arange((1 << shard_bits) + 1))
                some = [k for k in range(1 << shard_bits) if edges[k] < edges[k + 1]]
                made = [qf.encode(*(x[edges[k] : edges[k + 1]] for x in (left, right, count)), width, shard_bits) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array(made, pa.binary())], ["shard", "block", "filter"])

    return run


def _merged(width, shard_bits, least):
    """Merge the filters of a shard.

    Rows: block -1 with the frequent pairs and their counts; then for each block the places in its own filter (left) whose pairs
    are frequent, and their places among the frequent ones (value).
    """

    def run(key, table):
        shard = key[0].as_py()
        parts = [qf.decode(raw, width, shard_bits, shard) for raw in table.column("filter").to_pylist()]
        left, right, count = qf.sorted_counts(*(np.concatenate(x) for x in zip(*parts)), width)
        some = count >= least
        left, right, count = left[some], right[some], count[some]
        rows = [(-1, _stored(left.astype(np.int64)), _stored(right.astype(np.int64)), _stored(count))] if len(left) else []
        for block, (a, b, _) in zip(table.column("block").to_pylist(), parts):
            own, at = _place(a, b, left, right, width)
            if len(own):
                rows.append((block, _stored(np.diff(own, prepend=0)), b"", _stored(np.diff(at, prepend=0))))
        blocks, lefts, rights, values = zip(*rows) if rows else ((),) * 4
        columns = [pa.array([shard] * len(rows), pa.int32()), pa.array(blocks, pa.int64()), *(pa.array(x, pa.binary()) for x in (lefts, rights, values)), pa.array([len(left)] * len(rows), pa.int64())]
        return pa.Table.from_arrays(columns, ["shard", "block", "left", "right", "value", "kept"])

    return run


def _place(a, b, left, right, width):
    """(which of the sorted pairs a, b are among the sorted pairs left, right; where there), both rising."""
    if not len(left) or not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if width <= 32:
        x, y = (a << np.uint64(width)) | b, (left << np.uint64(width)) | right
    else:
        order, first = qf.ordered(np.r_[a, left], np.r_[b, right], width)
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(first)
        x, y = code[: len(a)], code[len(a) :]
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    own = np.flatnonzero(y[at] == x)
    return own, at[own]


def _renumbered(width, shard_bits, stride):
    """A block's numbers of the n-grams that begin at each place; n-grams that are not frequent are breaks."""

    def run(batches):
        for batch in batches:
            for block, raw, found in zip(*(batch.column(c) for c in ("block", "numbers", "found"))):
                numbers = _numbers(raw.as_py())
                at, a, b = _pairs(numbers)
                left, right = qf.permute(a, b, width)
                order, first = qf.ordered(left, right, width)
                shard = (left[order[first]] >> np.uint64(width - shard_bits)).astype(np.int64)
                begin = np.searchsorted(shard, np.arange(1 << shard_bits))
                name = np.full(len(shard), -1, np.int64)
                for f in found.as_py():
                    own, value = np.cumsum(_numbers(f["left"])), np.cumsum(_numbers(f["value"]))
                    name[begin[f["shard"]] + own] = value + f["shard"] * stride
                out = np.full(len(numbers), -1, np.int64)
                out[at[order]] = name[np.cumsum(first) - 1]
                yield _block(block, out)

    return run


def _words(least):
    """Count the words of a shard.

    Rows: block -1 with each frequent word, its count a and its place among them; then for each block the places of its frequent
    words in its dictionary, rising, and their places among the frequent ones (names).
    """

    def run(key, table):
        lang, word = (table.column(c).cast(pa.large_binary()) for c in ("lang", "word"))
        # no text has the byte 0xFF
        code = pc.binary_join_element_wise(lang, word, pa.scalar(b"\xff", pa.large_binary())).combine_chunks().dictionary_encode()
        kind, count = code.indices.to_numpy().astype(np.int64), table.column("count").to_numpy()
        sums = np.zeros(len(code.dictionary), np.int64)
        np.add.at(sums, kind, count)
        some = np.flatnonzero(sums >= least)
        name = np.full(len(sums), -1, np.int64)
        name[some] = np.arange(len(some))
        frequent = [w.split(b"\xff", 1) for w in code.dictionary.take(pa.array(some)).to_pylist()]
        number, block, local = name[kind], table.column("block").to_numpy(), table.column("local").to_numpy()
        own = np.flatnonzero(number >= 0)
        own = own[np.lexsort((local[own], block[own]))]
        blocks, begin = np.unique(block[own], return_index=True)
        parts = [own[a:b] for a, b in zip(begin, [*begin[1:], len(own)])]
        none = [None] * len(parts)
        columns = [
            pa.array([key[0].as_py()] * (len(some) + len(parts)), pa.int64()),
            pa.array(np.r_[np.full(len(some), -1), blocks], pa.int64()),
            pa.array([None] * len(some) + [_stored(np.diff(local[x].astype(np.int64), prepend=0)) for x in parts], pa.binary()),
            pa.array([None] * len(some) + [_stored(number[x]) for x in parts], pa.binary()),
            pa.array([x.decode() for x, _ in frequent] + none, pa.string()),
            pa.array([x for _, x in frequent] + none, pa.binary()),
            pa.array(sums[some].tolist() + none, pa.int64()),
            pa.array([*range(len(some)), *none], pa.int64()),
            pa.array([len(some)] * (len(some) + len(parts)), pa.int64()),
        ]
        return pa.Table.from_arrays(columns, ["shard", "block", "places", "names", "lang", "word", "a", "place", "kept"])

    return run


def _named(stride):
    """Numbers of words instead of their places in the block's dictionary."""

    def run(batches):
        for batch in batches:
            for block, raw, found in zip(*(batch.column(c) for c in ("block", "numbers", "found"))):
                numbers = _numbers(raw.as_py())
                parts = [(np.cumsum(_numbers(f["places"])), _numbers(f["names"]) + f["shard"] * stride) for f in found.as_py()]
                place, number = (np.concatenate(x) for x in zip(*parts))
                name = np.full(max(int(numbers.max(initial=-1)), int(place.max(initial=-1))) + 2, -1, np.int64)
                name[place] = number
                name[-1] = -1
                yield _block(block, name[numbers])

    return run


def _entries(width, stride):
    """Rows of frequent n-grams: number, a, left, right."""

    def run(batches):
        for batch in batches:
            for shard, *raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "left", "right", "value"))):
                left, right, count = map(_numbers, raw)
                a, b = qf.restore(left, right, width)
                number = np.arange(len(count), dtype=np.int64) + shard * stride
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (number, count, a, b)], ["number", "a", "left", "right"])

    return run


def blocks(docs, block_bytes=BLOCK_BYTES):
    """docs(text, lang) -> block, numbers (of its words, -1 between pieces), entries (lang, word, count: its dictionary)."""
    rows = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return held(rows.mapInArrow(_blocks(block_bytes), "block long, numbers binary, n long, entries array<struct<lang:string,word:binary,count:bigint>>"), "blocks")


def frequent_phrases(docs, least=LEAST, longest=LONGEST, block_bytes=BLOCK_BYTES, shard_pairs=SHARD_PAIRS):
    """docs(text, lang) -> (tables of frequent phrases for 1, 2, ... `longest` words, table of words in all per language).

    Columns: number, lang, a, words (array), firsts and lasts (counts of the first, of the last 1, 2, ... words), left and
    right (numbers of the first and last n - 1 words; not for single words).
    """
    cut = blocks(docs, block_bytes)
    words = cut.select("block", F.posexplode("entries").alias("local", "e")).select("block", "local", "e.lang", "e.word", "e.count")
    # long words weigh more, as a shard holds the bytes of its words
    weight = F.sum(1 + F.shiftright(F.octet_length("word"), 6))
    total = held(words.groupBy("lang").agg(F.sum("count").alias("n"), weight.alias("weight")), "totals")
    shards = max(WORD_SHARDS, 1 << ((total.agg(F.sum("weight")).first()[0] or 0) // shard_pairs).bit_length())
    total = total.drop("weight")
    dealt = words.withColumn("shard", F.pmod(F.xxhash64("lang", "word"), F.lit(shards))).groupBy("shard")
    vocabulary = "shard long, block long, places binary, names binary, lang string, word binary, a long, place long, kept long"
    counted = held(dealt.applyInArrow(_words(least), vocabulary), "words")
    stride = counted.agg(F.max("kept")).first()[0]
    if not stride:
        return [], total
    single = F.array("a")
    number = F.col("shard") * stride + F.col("place")
    phrases = counted.where("block = -1").select(number.alias("number"), "lang", "a", F.array(F.col("word").cast("string")).alias("words"), single.alias("firsts"), single.alias("lasts"))
    tables = [held(phrases, "phrases1")]
    back = counted.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "places", "names")).alias("found"))
    text = held(cut.select("block", "numbers").join(back.hint("merge"), "block").mapInArrow(_named(stride), "block long, numbers binary, n long"), "numbers1")
    top = shards * stride - 1
    for n in range(2, longest + 1):
        width = max(1, int(top).bit_length())
        places = text.agg(F.sum("n")).first()[0] or 0
        shard_bits = min(width, (places // shard_pairs).bit_length())
        filters = text.mapInArrow(_filters(width, shard_bits), "shard int, block long, filter binary")
        merged = filters.groupBy("shard").applyInArrow(_merged(width, shard_bits, least), "shard int, block long, left binary, right binary, value binary, kept long")
        merged = held(merged, f"merged{n}")
        stride = merged.agg(F.max("kept")).first()[0]
        if not stride:
            break
        found = merged.where("block = -1").mapInArrow(_entries(width, stride), "number long, a long, left long, right long")
        shorter = tables[-1]
        first = shorter.select(F.col("number").alias("left"), "lang", F.col("words").alias("head"), F.col("firsts").alias("heads"))
        last = shorter.select(F.col("number").alias("right"), F.slice("words", -1, 1).alias("tail"), F.col("lasts").alias("tails"))
        longer = found.join(first, "left").join(last, "right")
        grown = lambda counts: F.concat(counts, F.array("a"))
        longer = longer.select("number", "lang", "a", F.concat("head", "tail").alias("words"), grown(F.col("heads")).alias("firsts"), grown(F.col("tails")).alias("lasts"), "left", "right")
        tables.append(held(longer, f"phrases{n}"))
        if n < longest:
            back = merged.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "left", "value")).alias("found"))
            text = held(text.select("block", "numbers").join(back.hint("merge"), "block").mapInArrow(_renumbered(width, shard_bits, stride), "block long, numbers binary, n long"), f"numbers{n}")
            top = (1 << shard_bits) * stride - 1
    return tables, total


def collocations(docs, least=LEAST, longest=LONGEST, top=TOP, block_bytes=BLOCK_BYTES, shard_pairs=SHARD_PAIRS):
    """docs(text, lang) -> lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    tables, total = frequent_phrases(docs, least, longest, block_bytes, shard_pairs)
    spark = docs.sparkSession
    if len(tables) < 2:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = None
    for k, table in enumerate(tables[1:], 1):
        rows = table.select("number", "lang", "a", "words", "firsts", "lasts")
        if k + 1 < len(tables):
            # a longer phrase is as frequent only if one with one word more is
            longer = tables[k + 1]
            cover = longer.select(F.col("left").alias("number"), "a").unionByName(longer.select(F.col("right").alias("number"), "a"))
            cover = cover.groupBy("number").agg(F.max("a").alias("longer"))
            rows = rows.join(cover, "number", "left").where("longer IS NULL OR 100 * longer < 100 * a").drop("longer")
        rows = rows.drop("number")
        found = rows if found is None else found.unionByName(rows)
    found = found.join(few(total), "lang")
    exact = lambda x: x.cast("decimal(38,0)")
    size = F.size("words")

    def cut(k):
        first, rest = F.element_at("firsts", k), F.element_at("lasts", size - k)
        return F.struct(first.alias("l"), rest.alias("r"), k.alias("k"))

    cuts = F.transform(F.sequence(F.lit(1), size - 1), cut)
    one = found.select("lang", "a", "n", F.array_join("words", " ").alias("phrase"), F.explode(cuts).alias("cut")).select("lang", "a", "n", "phrase", "cut.*")
    one = one.withColumn("up", exact(F.lit(1000)) * exact(F.col("a")) * exact(F.col("n"))).withColumn("down", exact(F.col("l")) * exact(F.col("r")))
    one = one.withColumn("score", F.expr("up div down").cast("long"))
    best = one.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    best = best.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # the best of parts first, so that no task ranks all phrases of a language
    for parts in (4096, 64):
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
