"""Spot signatures: chains of content words that follow common words, with DataFrame functions only.

A text is its set of signatures: each anchor (a common word) with the next `CHAIN` words that are not anchors. Sets are
kept as sorted distinct 32-bit hashes, and the fingerprint is their list as text, so equal texts have equal
fingerprints and the likeness of two fingerprints is the Jaccard coefficient of their sets. Sets whose lengths lie in
partitions that are not neighbours can't reach the threshold; `likeness` prunes by length before it intersects.

A text without signatures, such as one word or a table of symbols, has the hash of the whole text as its only one, so it
is like nothing but its copies. Null and empty texts are equal. Repeated rows are rows of their own.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import held

#: Common words of English, German, French and Spanish, the anchors: fixed values.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you "
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat im in ist mit nach nicht noch sein sich sie sind und "
    "uns von vor war wie wird zu zum zur au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur mais ne nous ou par pas plus pour "
    "qui que sa se ses son sont sur un une vous al como con del el ella ellos era esta este ha las lo los más me muy no nos o para pero por se sin su sus una y ya"
).split()
CHAIN = 2
PARTITION_FLOOR = 0.8
NONE = -(1 << 63)


def any_of(words):
    """A regular expression for any of the words, by common beginnings."""
    tree = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node):
        ends = "" in node
        parts = [c + text(below) for c, below in sorted(node.items()) if c]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + "?+" * ends

    return text(tree)


def signatures(text, anchors=ANCHORS, chain=CHAIN):
    """Sorted distinct hashes of a text's spot signatures."""
    anchor = any_of(set(anchors)) + "(?= )"
    follow = rf"(?: {anchor})*+ [^ ]++"
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " "), F.lit(" "))
    found = F.regexp_extract_all(plain, F.lit(rf" (?=({anchor}{follow * chain}))"), F.lit(1))
    hashes = F.array_sort(F.array_distinct(F.transform(found, lambda s: F.hash(F.regexp_replace(s, f" {anchor}", "")))))
    whole = F.array(F.hash(F.lit("whole text"), text))
    # named by a lambda, so that the search runs once
    return F.element_at(F.transform(F.array(hashes), lambda h: F.when(F.size(h) > 0, h).otherwise(whole)), 1)


def fingerprint(hashes):
    return F.array_join(hashes.cast("array<string>"), ",")


def length_partition(hashes, threshold=PARTITION_FLOOR):
    """Sets that reach the threshold lie in the same or in neighbouring partitions."""
    return F.floor(F.log(F.size(hashes).cast("double")) / F.log(F.lit(1 / threshold))).cast("int")


def likeness(a, b, threshold=0.0):
    """Jaccard coefficient of two sets, 0 where their lengths already keep it below the threshold."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(small < threshold * large, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


#: Equal rows have equal keys; a null id is the smallest.
KEY = ("id", "copy")


def _keyed(docs):
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NONE)).alias("id"), F.xxhash64("doc_id", "text").alias("copy"), "text")


def successors(docs):
    """Keys of rows with the key of the row before them, of which they are the next, and its number of code points.

    Rows are in descending order of doc_id, nulls last; the next of the last is the first. Equal rows are one here. Only
    keys are sorted.
    """
    order = [F.col("id").desc(), "copy"]
    keys = _keyed(docs).select(*KEY, F.char_length("text").alias("n_chars")).distinct()
    keys = held(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    row = F.struct(*KEY, "n_chars")
    lasts = keys.groupBy("part").agg(F.max(F.struct(F.bitwise_not("id"), "copy", "id", "n_chars")).alias("last"))
    # one row per partition of the order
    lasts = lasts.select("part", F.struct(*[F.col(f"last.{c}").alias(c) for c in (*KEY, "n_chars")]).alias("last"))
    whole = Window.orderBy("part")
    final = F.last("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lasts = lasts.select("part", F.coalesce(F.lag("last").over(whole), final).alias("before"))
    inside = keys.withColumn("own", F.lag(row).over(Window.partitionBy("part").orderBy(*order)))
    prior = F.coalesce("own", "before")
    return inside.join(lasts, "part").select(*KEY, *[prior[c].alias(f"prior_{c}") for c in (*KEY, "n_chars")])


def edited_fingerprints(docs):
    """docs(doc_id, text) -> fingerprints of each text and of its edited text, and their likeness.

    The edited text keeps the first half of its code points; floor(n / 2) of the next document follow. Texts go through one
    exchange by key, which both sides use; the next document's part that is wanted goes through a second one.
    """
    rows = _keyed(docs).withColumn("own", signatures(F.col("text")))
    again = F.row_number().over(Window.partitionBy(*KEY).orderBy("copy"))  # among equal rows
    half = F.floor(F.col("prior_n_chars") / 2).cast("int")
    given = rows.join(held(successors(docs), "next").hint("merge"), list(KEY)).withColumn("again", again).where("again = 1")
    given = given.select(*[F.col(f"prior_{c}").alias(c) for c in KEY], F.col("text").substr(F.lit(1), half).alias("tail"), F.col("own").alias("next_set"), F.col("doc_id").alias("next_id"))
    n = F.char_length("text")
    out = rows.join(given.hint("merge"), list(KEY)).withColumn("again", again)
    # the next of equal rows but the last is its like
    more = F.count("*").over(Window.partitionBy(*KEY)) > F.col("again")
    tail = F.when(more, F.col("text").substr(F.lit(1), F.floor(n / 2).cast("int"))).otherwise(F.col("tail"))
    edited = F.concat(F.col("text").substr(F.lit(1), (n - F.floor(n / 2)).cast("int")), tail)
    out = out.withColumn("more", more).select("doc_id", n.cast("long").alias("n_chars"), "own", edited.alias("edited"), *[F.when(F.col("more"), F.col(own)).otherwise(F.col(x)).alias(x) for own, x in (("own", "next_set"), ("doc_id", "next_id"))])
    out = out.select("*", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("other"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_set")).alias("near_next"),
        length_partition(F.col("own")).alias("length_partition"), "next_id",
    )
