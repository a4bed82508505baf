"""Quality rules on what a public vocabulary makes of a text.

Each word is encoded by the vocabulary (sentencepiece, with byte fallback). A document has three figures: characters per
token, the share of byte-fallback tokens, and the entropy of its tokens in bits. Every language (or any other grouping
column) and length gets a rejection band per figure: quartiles of its documents, exact to a bin of 1/4000 of the scale, and
`reach` interquartile ranges beyond them (3: the outer fences of a box plot). A document is kept if its base rules hold and all figures lie in the band.

Level and spread of the figures depend on the number of tokens, so the quartiles are those of documents of like length:
lengths are quarter octaves of tokens, and a length with fewer than `least_docs` documents takes in the nearest lengths, as
many on either side as it needs, up to the whole language.

Defined results: null and empty texts have no words, fail the base rules and take no part in the bands; a null language
is a language of its own; repeated rows count as often as they stand; an empty table gives an empty one. A language
whose quartiles fall together gets the least width of a figure, which is a parameter.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import arrow, few, held, steps

SYMBOLS = b"#*$%&|<>"
CACHED = 1_000_000
#: figure -> (upper end of its scale, least interquartile range)
FIGURES = {"chars_per_token": (16.0, 0.03), "byte_share": (1.0, 0.005), "entropy": (20.0, 0.1)}
STEPS = 4000


class Pieces(dict):
    """Ids of single words as uint16 bytes, encoded when first met."""

    def __init__(self, path):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.kind = np.uint16 if n <= 1 << 16 else np.uint32

    def __missing__(self, word):
        if len(self) >= CACHED:
            self.clear()
        ids = self[word] = np.array(self.model.encode(word.decode("utf-8", "replace")), self.kind).tobytes()
        return ids


@lru_cache(maxsize=2)
def pieces(path):
    return Pieces(path)


def repeated_words(words):
    """How many words stand in a window of three words that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    codes, distinct = pd.factorize(np.array(words, object))
    codes = codes.astype(np.int64)
    pairs, _ = pd.factorize(codes[:-1] * len(distinct) + codes[1:])
    windows, uniques = pd.factorize(pairs[:-1].astype(np.int64) * len(distinct) + codes[2:])
    if len(uniques) == len(windows):
        return 0
    again = np.bincount(windows)[windows] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def repeated_lines(text):
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _figures(path, text, carried):
    def run(batches):
        vocabulary = pieces(path)
        for batch in steps(batches, text):
            rows = []
            for t in batch.column(text).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                packed = b"".join(words)
                n_chars = len(packed) if packed.isascii() else int((np.frombuffer(packed, np.uint8) & 0xC0 != 0x80).sum())
                n_symbols = len(packed) - len(packed.translate(None, SYMBOLS))
                ids = np.frombuffer(b"".join(map(vocabulary.__getitem__, words)), vocabulary.kind)
                n_tokens = len(ids)
                figures = (None, None, None)
                if n_tokens:
                    counts = np.unique(ids, return_counts=True)[1]
                    entropy = float(np.log2(n_tokens) - (counts * np.log2(counts)).sum() / n_tokens)
                    figures = (n_chars / n_tokens, float(vocabulary.is_byte[ids].mean()), entropy)
                rows.append((len(words), n_chars, n_symbols, repeated_lines(raw), repeated_words(words), n_tokens, *figures))
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3
            columns = [pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *FIGURES]
            yield arrow({k: batch.column(k) for k in carried} | dict(zip(names, columns)), {})

    return run


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, " + ", ".join(f"{f} double" for f in FIGURES)


def measures(docs, path, text="text", group="lang", carried=("doc_id",)):
    """docs(text, group, ...) -> the carried columns, group and the figures of each row, as a held table."""
    docs = docs.select(*dict.fromkeys([*carried, group, text]))
    carried = list(dict.fromkeys([*carried, group]))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", " + MEASURES
    return held(docs.mapInArrow(_figures(path, text, carried), schema), "measures")


def base_failed(min_words=50, repeat_percent=50):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def length_bin():
    """Quarter octaves of the number of tokens; null without tokens."""
    return F.when(F.col("n_tokens") > 0, F.floor(4 * F.log2("n_tokens")))


def bands(measured, group="lang", least_docs=100):
    """Per group and length, the quartiles of each figure over documents of like length that pass the base rules, from counts per bin."""
    own = measured.where(F.col("n_tokens") > 0).select(F.col(group).alias("band_group"), length_bin().alias("length"), (~base_failed()).alias("passes"), *FIGURES)
    figure = F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), F.floor(F.col(f) / top * STEPS).alias("bin")) for f, (top, _) in FIGURES.items()])).alias("s")
    bins = own.select("band_group", "length", "passes", figure).groupBy("band_group", "length", "s.figure", "s.bin").agg(F.count_if("passes").alias("n"))
    bins = held(bins, "bins")
    # every length with the lengths around it, as far as it has to look; a group has some 100 lengths at most
    sizes = held(bins.where(F.col("figure") == next(iter(FIGURES))).groupBy("band_group", "length").agg(F.sum("n").alias("docs")), "lengths")
    near = sizes.select("band_group", "length").join(
        sizes.select(F.col("band_group").alias("near_group"), F.col("length").alias("near"), "docs"), F.col("band_group").eqNullSafe(F.col("near_group"))
    )
    near = near.withColumn("far", F.abs(F.col("near") - F.col("length")))
    upto = F.sum("docs").over(Window.partitionBy("band_group", "length").orderBy("far"))
    at_far = F.sum("docs").over(Window.partitionBy("band_group", "length", "far"))
    near = near.withColumn("before", upto - at_far).where(F.col("before") < least_docs).select("near_group", "near", F.col("length").alias("for"))
    looked = bins.where("n > 0").join(few(held(near, "near")), F.col("band_group").eqNullSafe(F.col("near_group")) & (F.col("length") == F.col("near")))
    looked = looked.groupBy("band_group", "for", "figure", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("band_group", "for", "figure")  # at most STEPS rows, entropy and characters per token a few more
    looked = looked.withColumn("all", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bin")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    quartiles = looked.groupBy("band_group", "for", "figure").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    out = []
    for f, (top, least) in FIGURES.items():
        mine = F.col("figure") == f
        q1, q3 = (F.max(F.when(mine, (F.col(q) + 0.5) * top / STEPS)) for q in ("q1", "q3"))
        out += [q1.alias(f"band_{f}_q1"), F.greatest(q3 - q1, F.lit(least)).alias(f"band_{f}_range"), q3.alias(f"band_{f}_q3")]
    return quartiles.groupBy("band_group", F.col("for").alias("band_length")).agg(*out)


def judged(measured, group="lang", reach=3.0, least_docs=100):
    """Adds base_failed, a flag per figure and kept."""
    limits = few(held(bands(measured, group, least_docs), "bands"))
    like = F.col(group).eqNullSafe(F.col("band_group")) & (length_bin() == F.col("band_length"))
    out = measured.join(limits, like, "left").withColumn("base_failed", base_failed())
    inside = []
    for f in FIGURES:
        room = F.lit(reach) * F.col(f"band_{f}_range")
        x = F.col(f).between(F.col(f"band_{f}_q1") - room, F.col(f"band_{f}_q3") + room)
        out = out.withColumn(f"{f}_inside", F.coalesce(x, F.lit(False)))
        inside.append(F.col(f"{f}_inside"))
    kept = ~F.col("base_failed") & inside[0] & inside[1] & inside[2]
    return out.withColumn("kept", kept).drop(*limits.columns)
