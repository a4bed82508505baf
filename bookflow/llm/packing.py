"""Packing by concatenation: documents end to end, cut into fixed windows.

Two passes over prefix sums. The first encodes each document once and writes its ids with its place inside the input
split; the second adds the totals of the earlier splits, which gives each document its place in the whole, and cuts it
where windows end. No row is shuffled: only the totals, one row per split, are sorted and sent to all tasks.

Defined results: a null text is empty, and a document has at least its end token; repeated rows are packed again; a
document of any length is cut as often as it needs; an empty table gives no pieces. The order is that of the input
splits, so the same table gives the same pieces.
"""

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import arrow, held, steps

#: Characters for which lower-casing and Unicode composition act on each alone; other texts go to the library whole.
ODD = re.compile("[^\t\n\r\x20-\x7e¡-įı-ž‐-‧]")
LETTERS = re.compile("[a-z]+")
#: Words kept in a worker's cache; beyond it the cache starts anew.
CACHED = 1_000_000


class Words(dict):
    """Ids of white-space delimited words as little-endian uint32 bytes, each encoded by the library when first met.

    For vocabularies that drop white space and lower-case, a text's ids are its words' ids end to end.
    """

    def __init__(self, path):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        probe = "some words; UPPER\nand more, it's 12 x"
        self.by_word = self.whole(probe) == b"".join(map(self.whole, probe.lower().split()))
        self.bare = all(self.whole(w) == self.letters(w) for w in ("some", "unfathomable", "q")) and not any(x in s for s in self.special for x in ".,")

    def whole(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, word):
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()

    def __missing__(self, word):
        if len(self) >= CACHED:
            self.clear()
        if self.bare and len(word) > 1 and word[-1] in ".," and word[-2].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif self.bare and LETTERS.fullmatch(word):
            ids = self.letters(word)
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def encode(self, text):
        low = text.lower()
        if not self.by_word or ODD.search(text) or any(s in low for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, low.split()))


@lru_cache(maxsize=2)
def words(path):
    return Words(path)


def _encoded(path, end_id):
    def run(batches):
        from pyspark import TaskContext

        encode, part, at = words(path).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in steps(batches, "text"):
            ids = [encode(t or "") + end for t in batch.column("text").to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            columns = [batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "at", "doc_tokens", "ids"])

    return run


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ends_document boolean, ids binary"


def _cut(window):
    kinds = {k: pa.int64() for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")}
    kinds |= {"ends_document": pa.bool_(), "ids": pa.binary()}

    def run(batches):
        for batch in steps(batches, "ids"):
            doc_ids, n, at = batch.column("doc_id").to_pylist(), batch.column("doc_tokens").to_pylist(), batch.column("at").to_pylist()
            out = {k: [] for k in kinds}
            for doc_id, size, place, ids in zip(doc_ids, n, at, batch.column("ids")):
                ids, a = ids.as_buffer(), 0
                while a < size:
                    sequence, offset = divmod(place + a, window)
                    b = min(size, a + window - offset)
                    row = (doc_id, a, b - a, size, sequence, offset, b == size, ids.slice(4 * a, 4 * (b - a)).to_pybytes())
                    for values, v in zip(out.values(), row):
                        values.append(v)
                    a = b
            yield arrow(out, kinds)

    return run


def pack(docs, path, window=2048, end_id=1):
    """docs(doc_id long, text) -> pieces(doc_id, start, length, doc_tokens, sequence_id, offset, ends_document, ids).

    `ids` holds the piece as little-endian unsigned 32-bit ids. A sequence is the pieces of one `sequence_id` by offset;
    only the last one may be short.
    """
    placed = "doc_id long, part long, at long, doc_tokens long, ids binary"
    encoded = held(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(path, end_id), placed), "encoded")
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    before = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    # one row of 16 bytes per input split
    whole = encoded.join(F.broadcast(before), "part").select("doc_id", "doc_tokens", (F.col("at") + F.col("before")).alias("at"), "ids")
    return whole.mapInArrow(_cut(window), PIECES)
