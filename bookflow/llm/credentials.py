"""Secret scan with ownership frequency over the whole corpus, with DataFrame functions only.

1. Every text is searched for candidates: the three base kinds (assignments, access keys, hexadecimal strings) and two
   wider ones, strings in the format of a known issuer and long strings that mix letters and digits. Matches are leftmost
   and do not overlap within a kind; their places are the running sums of what stands before and in them.
2. Candidates are known by a hash of their value. For each hash the distinct owners and distinct repositories that hold it are
   counted, in three aggregations that combine before each shuffle. A value of few owners is owner-specific; one that many
   owners or repositories hold is a widely copied example, such as a key out of a manual.
3. A candidate is `live` if its value looks random - enough different characters and bits per character, no run of the
   alphabet - and is owner-specific; it is `copied` if it is widely held.

Base spans are always reported. Spans of the wider kinds are added where they are live and no base span of the row covers
them. A span is the whole match, `kind:start:end` in code points, end exclusive; an assignment's value is its last part.

Texts never move: the search writes one short row per document, and only candidates are exploded. A value that a third of all
rows hold is counted by (value, owner, repository) first, then joined by a plain exchange.

Defined results: null and empty texts have no spans; an owner or repository that is null counts as one of its own; repeated
rows are rows of their own; an empty table gives an empty one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import held

#: The base kinds, as (pattern, shortest value). Lengths of access keys and hexadecimal strings stand in their patterns, as a
#: match takes the whole run; an assignment that is too short still takes its characters, so it is dropped only after the search.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 18),
    "hex": (r"[0-9a-f]{16,}", 16),
}
#: What stands before an assignment's value; the value is the rest, as it holds neither white space nor quotes nor colons.
BEFORE_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Prefixes of public issuers' formats (code hosts, payments, chat, clouds, mail, packages, signed tokens) and key blocks.
ISSUERS = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|"
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[\x20\x09-\x0D]{1,4}[A-Za-z0-9+/=]{16,}"
)
WIDER = {"issuer": (rf"(?:{ISSUERS})", 1), "mixed": (r"[A-Za-z0-9+_=-]{20,}+", 20)}
KINDS = {**BASE, **WIDER}
#: Owners, repositories from which on a value counts as widely copied.
OWNERS, REPOSITORIES = 3, 20
#: Bits per character and different characters of a value that looks random.
BITS, DIFFERENT = 2.75, 7


def _listed(kind, text, pattern):
    """The matches of a kind with what stands before each, and one without a match for what stands behind the last."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("match"), F.split(text, pattern, -1).alias("gap"))
    return F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.char_length(x["gap"]).alias("gap"), x["match"].alias("match")))


def found(docs, owner="source", repository="doc_id"):
    """docs -> row, doc_id, owner, repository, candidates(kind, match, gap, place): one row per document, kept in the shared folder.

    gap is the number of code points between a match and the one of its kind before it.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    lists = [_listed(k, F.col("text"), pattern) for k, (pattern, _) in enumerate(KINDS.values())]
    candidates = F.filter(F.concat(*lists), lambda x: x["match"].isNotNull())
    return held(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", candidates.alias("candidates")), "candidates")


def _spans(rows):
    """One row per candidate of sufficient length: row, owner, repository, kind, start, end, value."""
    each = rows.select("row", "owner", "repository", F.explode("candidates").alias("c")).select("row", "owner", "repository", "c.*")
    size = F.char_length("match")
    before = Window.partitionBy("row", "kind").orderBy("place")
    each = each.withColumn("end", F.sum(F.col("gap").cast("long") + size).over(before.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - size)
    names = list(KINDS)
    value = F.when(F.col("kind") == names.index("assign"), F.regexp_replace("match", BEFORE_VALUE, "")).otherwise(F.col("match"))
    least = F.element_at(F.array(*[F.lit(n) for _, n in KINDS.values()]), F.col("kind") + 1)
    out = each.select("row", "owner", "repository", "kind", "start", "end", value.alias("value")).where(F.char_length("value") >= least)
    both = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return out.where((F.col("kind") != names.index("mixed")) | both)


def entropy(value):
    """Bits per character of a value."""
    size = F.char_length(value).cast("double")
    share = lambda c: (size - F.char_length(F.replace(value, c, F.lit("")))) / size
    parts = F.transform(F.array_distinct(F.split(value, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def looks_random(value):
    different = F.size(F.array_remove(F.array_distinct(F.split(value, "")), ""))
    plain = F.lower(value).rlike("0123456789|abcdefgh|(.)\\1{5}|example|changeme|placeholder|your[_-]?")
    return (different >= DIFFERENT) & (entropy(value) >= BITS) & ~plain


def ownership(spans):
    """spans(digest, owner, repository) -> digest, owners, repositories: distinct ones that hold the value."""
    held_by = spans.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = held_by.groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secret_scan(docs, owner="source", repository="doc_id", owners=OWNERS, repositories=REPOSITORIES):
    """docs(doc_id, text, owner, repository) -> one row per document.

    doc_id, n_assign, n_access, n_hex, base and spans (lists `kind:start:end`, comma-joined), live and copied (those of all candidates that
    are owner-specific and look random, or are widely held).
    """
    rows = found(docs, owner, repository)
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = held(_spans(rows).withColumn("digest", F.unhex(F.sha2("value", 256))), "spans")
    judged = spans.groupBy("digest").agg(F.first("value").alias("value")).select("digest", looks_random(F.col("value")).alias("random"))
    judged = held(ownership(spans).join(judged, "digest"), "values")
    spans = spans.drop("value", "owner", "repository").join(judged, "digest")
    copied = (F.col("owners") >= owners) | (F.col("repositories") >= repositories)
    spans = spans.withColumn("copied", copied).withColumn("live", F.col("random") & ~copied).withColumn("base", F.col("kind") < len(BASE))
    # a wider span is added where no base span of its row overlaps it: base spans that begin before its end, by their furthest end
    inside = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    backwards = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("end").desc())
    following = F.min(F.when(F.col("base"), F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    alone = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("alone", alone)
    spans = spans.select("row", "kind", "start", "end", "base", "live", "copied", (F.col("base") | (F.col("live") & F.col("alone"))).alias("shown"))
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base", "live", "copied", "shown"))).alias("all"))

    def listed(test):
        return F.array_join(F.transform(F.filter("all", test), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")

    some = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    out = rows.select("row", "doc_id").join(lists, "row", "left").withColumn("all", F.coalesce("all", F.array().cast(lists.schema["all"].dataType)))
    return out.select(
        "doc_id", some(0).alias("n_assign"), some(1).alias("n_access"), some(2).alias("n_hex"), listed(lambda x: x["base"]).alias("base"),
        listed(lambda x: x["shown"]).alias("spans"), listed(lambda x: x["live"]).alias("live"), listed(lambda x: x["copied"]).alias("copied"),
    )
