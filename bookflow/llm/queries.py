"""Registered queries of the package: name -> (Spark query, check SQL or None)."""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from ..operators.lineage import checkpoint_root
from .collocations import collocations
from .common import documents
from .credentials import secret_scan
from .fertility import judged, measures
from .fill_middle import fill_middle, restored
from .kd_shards import kd_shards
from .licenses import license_scan
from .line_dedup import LineIndex
from .mixing import Mixture
from .ngram_join import near_duplicates
from .packing import pack
from .pu_quality import pu_scores
from .spot_signatures import edited_fingerprints
from .token_counts import token_counts

_ENTRIES = {}


def query(name, sql=None):
    def add(fn):
        _ENTRIES[name] = (fn, sql)
        return fn

    return add


def entries():
    return dict(_ENTRIES)


@query("op1_mixture")
def op1(spark, path):
    return Mixture(documents(spark, path)).documents()


@query("op2_kd_shards")
def op2(spark, path):
    out = kd_shards(documents(spark, path), shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_token_counts")
def op3(spark, path):
    docs, vocabulary = documents(spark, path), public_tokenizers.path("piece_bpe_32k.model")
    cache = f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/token_cache"
    # an eighth of the rows came earlier: the call over the whole table finds their counts stored and adds the missing ones
    token_counts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0), vocabulary, cache)
    out = token_counts(docs, vocabulary, cache)
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op4_license_scan")
def op4(spark, path):
    return license_scan(documents(spark, path))


LINES_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT r, doc_id, line, pos, coalesce(keeper <> doc_id, false) AS lost FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""


@query("op5_line_dedup", LINES_SQL)
def op5(spark, path):
    docs = documents(spark, path)
    index = LineIndex(spark)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for batch in (0, 1):  # all documents, in two insertions: the second asks the filters of the first
        index.insert(docs.where(half == batch))
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_spot_signatures")
def op6(spark, path):
    return edited_fingerprints(documents(spark, path))


@query("op7_fertility_rules")
def op7(spark, path):
    out = judged(measures(documents(spark, path), public_tokenizers.path("piece_bpe_32k.model")))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*base, "chars_per_token", "byte_share", "entropy")


@query("op10_packed_sequences")
def op10(spark, path):
    out = pack(documents(spark, path), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_ngram_join")
def op8(spark, path):
    return near_duplicates(documents(spark, path))


@query("op9_pu_quality")
def op9(spark, path):
    return pu_scores(documents(spark, path), spark.read.parquet(f"{path}/labels.parquet"))


@query("op11_secret_ownership")
def op11(spark, path):
    out = secret_scan(documents(spark, path))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "live", "copied")


FILL_SQL = r"""
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
    FROM documents
),
u AS (
    SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
        text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 AS plain,
        ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 AS spm
    FROM t
),
p AS (
    SELECT doc_id, n, text, plain, spm, array_to_string(units[:least(c1, c2)], '') AS prefix,
        array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix FROM u
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
    sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p"""


@query("op12_fill_middle", FILL_SQL)
def op12(spark, path):
    out = fill_middle(documents(spark, path))
    digest = lambda c: F.sha2(c, 256)
    restore = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(restore).alias("restored_sha256"))


COLLOCATIONS_SQL = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
    FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) AS words FROM w, range(1, 6) AS ks(k)),
f AS (SELECT lang, words, k, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
longer AS (SELECT lang, unnest([words[1:k - 1], words[2:k]]) AS words, a AS b FROM c WHERE k > 2),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, words, max(b) AS b FROM longer GROUP BY ALL) x USING (lang, words) WHERE b IS NULL OR 100 * b < 100 * a),
cuts AS (SELECT kept.*, unnest(range(1, k)) AS pos FROM kept),
scored AS (
    SELECT cuts.lang, cuts.words, cuts.a, cuts.pos, l.a AS l, r.a AS r, n.n, ((1000::HUGEINT * cuts.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.words = cuts.words[1:cuts.pos] JOIN f r ON r.lang = cuts.lang AND r.words = cuts.words[cuts.pos + 1:cuts.k] JOIN n ON n.lang = cuts.lang
),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, pos) AS nth FROM scored),
ranked AS (SELECT *, array_to_string(words, ' ') AS phrase FROM best WHERE nth = 1)
SELECT * FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked
) WHERE rank <= 2000"""


@query("op13_collocations", COLLOCATIONS_SQL)
def op13(spark, path):
    return collocations(documents(spark, path))
