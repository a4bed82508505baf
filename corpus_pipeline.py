"""The corpus pipeline: five operators over documents, each writing what the next one reads.

Quality rules drop documents, line dedup drops lines, the n-gram join keeps the document with the smallest id of each
group, the mixture takes words of each source to its target, and packing cuts what is left into sequences.
"""

import public_tokenizers
from pyspark.sql import functions as F

from bookflow.llm.common import documents, held
from bookflow.llm.fertility import judged, measures
from bookflow.llm.line_dedup import LineIndex
from bookflow.llm.mixing import Mixture
from bookflow.llm.ngram_join import representatives
from bookflow.llm.packing import pack


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the fertility bands of their language."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    measured = measures(renamed, public_tokenizers.path("piece_bpe_32k.model"), names["text"], names["lang"], tuple(names.values()))
    return judged(measured, names["lang"]).where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def line_dedup(spark, docs, sf_dir):
    """Documents without the lines that a document of smaller id holds."""
    index = LineIndex(spark)
    index.insert(docs)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()])
    kept = index.apply(renamed, tuple(names.values()))
    out = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return kept.select(*[(out[c] if c in out else F.col(names[c])).alias(c) for c in docs.columns])


def ngram_join(spark, docs, sf_dir):
    """The document of the smallest id of each group of near duplicates, once; ids may be null or shared."""
    return representatives(docs)


def mixture(spark, docs, sf_dir):
    """Documents and parts of them, so that each source comes near its target."""
    return Mixture(docs).texts(docs)


def packing(spark, docs, sf_dir):
    """Pieces of documents in sequences of 2048 tokens."""
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram join", ngram_join),
    ("mixture", mixture),
    ("packing", packing),
]
#: MinHash, byte-pair encoding and hashed draws have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = held(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
