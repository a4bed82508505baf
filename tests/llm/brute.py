"""Plain Python versions of the corpus operators, and a small table of hard cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("size", "shard", "n_words", "copy", "key", "target", "part", "row", "_c0", "_id", "kept", "words")]
)
CLASH = ("x",) * 12
WORDS = "the of and in a quick brown fox jumps over lazy dog while many rivers run deep below old stone bridges near green hills".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(1000)) if rng.random() < 0.5 else "") for _ in range(n))


def hard_rows():
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    words[60] = "changed"
    near = " ".join(words)
    odd = "ÄÖ ß ΣΑΣ İstanbul é J̌ <|endoftext|> text. x y \x1c z <|ENDOFTEXT|> it's WE'LL \U0001f600 12,5.,"
    texts = [
        (1, None), (2, ""), (3, " \n\t\r\n "), (4, prose(rng, 9000)), (5, base), (6, base), (7, near), (8, base.upper()), (9, "one"), (10, odd), (11, "### $$$ | | |"),
        (5, base), (None, "a text without an id but with some words in it"), (12, "same line of text here\nshort\nsame line of text here\n" + prose(rng, 60)),
        (13, "  SAME line of text here\t\nother words\n"), (14, "same line of text here"), (15, "a b c"), (16, "a b c"), (17, "licensed under CC BY-NC 4.0. All rights reserved"),
        (18, "one two three one two three four\none two three\n\n"), (19, "\n".join(prose(rng, 30) for _ in range(12))), (20, "x" * 70000 + " " + "é" * 9000),
    ]
    langs, sources = ["en", "de", None], ["s1", "s2", None, "\U0001f600", "￿"]
    return [(i, t, langs[k % 3], sources[k % 5], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def table(spark, path, rows):
    spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(text):
    return zlib.crc32((text or "").encode())


def targets(rows):
    size = defaultdict(int)
    for _, text, _, source, _ in rows:
        size[source] += len(words(text))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        out = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and out[s] > 2 * size[s]}
        if not over:
            return size, out
        full |= over


def line_key(line):
    key = line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    return key if len(key) >= 10 else None


def deduped(rows):
    """(doc_id, n_lines, n_dropped, text) of each row."""
    holders = defaultdict(set)
    order = lambda i: (i is None, i or 0)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if (k := line_key(line)) is not None:
                holders[k].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := line_key(x)) is None or len(holders[k]) < 2 or i == min(holders[k], key=order)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grams(text, n=5):
    w = words((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_groups(rows, threshold=0.8):
    """doc_id -> (class id, number of linked other texts), by all pairs of different texts; rows need ids."""
    texts = defaultdict(set)
    for i, text, *_ in rows:
        texts[text or ""].add(i)
    names = list(texts)
    sets, parent, links = [grams(t) for t in names], list(range(len(names))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(names)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    smallest = defaultdict(list)
    for k, t in enumerate(names):
        smallest[root(k)] += texts[t]
    return {i: (min(smallest[root(k)]), links[k]) for k, t in enumerate(names) for i in texts[t]}


def repeated(w):
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})
