"""Token counts through a cache of digests.

A text is known by the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its vocabulary file, its kind and
its options. Counts are joined from the cache; of the texts it lacks, one copy each is encoded, and the new counts are
appended. The content is normalised only as far as no count can change: a null is the empty text. Copies are collapsed
before the shuffle, so a text that a third of the rows repeat is sent once a task and encoded once.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows keep their rows; an empty table gives an
empty one. Appending the same counts twice, as after a failed job, does no harm: the cache is read distinct.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from .common import arrow, held, steps, utf8_bytes

CACHE = "content string, tokenizer string, n_tokens long"


@lru_cache(maxsize=4)
def loaded(path):
    """The tokenizer of a vocabulary file, as `texts -> lists of ids`: sentencepiece for .model, tokenizers for .json."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, add_bos=False, add_eos=False, num_threads=1)
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_version(path):
    with open(path, "rb") as f:
        return hashlib.sha256(path.rsplit(".", 1)[-1].encode() + b"|no special tokens|" + f.read()).hexdigest()


def content_digest(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _count(path):
    def run(batches):
        encode = loaded(path)
        for batch in steps(batches, "text", 1 << 20):
            counts = [len(ids) for ids in encode(batch.column("text").to_pylist())]
            yield arrow({"content": batch.column("content"), "n_tokens": counts}, {"n_tokens": pa.int64()})

    return run


def token_counts(docs, path, cache=None):
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens.

    `cache` is a Parquet folder, which is read if it has rows and appended to; without one a new table takes its place.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    rows = docs.select("doc_id", content_digest(F.col("text")).alias("content"), utf8_bytes(F.col("text")).alias("n_bytes"))
    texts = docs.select(content_digest(F.col("text")).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    misses = texts.groupBy("content").agg(F.first("text").alias("text"))  # copies are one text before the cache is asked
    known = None if cache is None else _stored(spark, cache)
    if known is not None:
        known = known.where(F.col("tokenizer") == version).select("content", "n_tokens").distinct()
        misses = misses.join(known.select("content"), "content", "left_anti")
    counted = misses.mapInArrow(_count(path), "content string, n_tokens long").select("content", F.lit(version).alias("tokenizer"), "n_tokens")
    if cache is None:
        counts = held(counted, "token_cache").select("content", "n_tokens")
    else:
        counted.write.mode("append").parquet(cache)
        counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).select("content", "n_tokens").distinct()
    return rows.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")


def _stored(spark, cache):
    """The cache as a table; None where nothing is stored yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
