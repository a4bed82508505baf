"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled good; all other text is unlabelled, also where a label says bad. The model is
linear in numbers that describe a text. It minimises the non-negative unbiased risk

    pi E_p[l(f)] + max(0, E_u[l(-f)] - pi E_p[l(-f)])

with the logistic loss l; where the second part falls below 0 a step climbs it back. The class prior pi is estimated first:
a plain classifier of positives against unlabelled text ranks both, and pi is the least ratio of unlabelled to positive
shares above a rank, over ranks that keep enough positives.

Features are counted over whole texts in tasks, once, and kept as a table. The fit takes at most `positives` and
`unlabelled` rows, those with the smallest hashes of id and text, which the driver holds as numbers (`FEATURES` doubles a
row); everything is scored.

Defined results: null and empty texts have features of zero words and get a score like any text; a null id counts as a row
outside the held-out part; repeated rows get equal scores; without a positive the score is the prior, 0.5; an empty table
gives an empty one.
"""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import arrow, fraction, held, steps

_KINDS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&", b"|<>[]{}\\/=_~^@+", b"!?", b".,;:", b"'\"()-", b" \t", b"\n")):
    for _b in _set:
        _KINDS[_b] = _i + 1
_KINDS[128:] = 11
NAMES = (
    "other_share", "lower_share", "upper_share", "digit_share", "symbol_share", "markup_share", "exclaim_share", "stop_share", "quote_share",
    "blank_share", "newline_share", "wide_share", "log_words", "word_length", "distinct_share", "top_word_share", "same_as_before",
    "line_words", "distinct_lines", "capital_words", "upper_words", "odd_ends", "stopped_words", "long_words", "short_words", "word_entropy",
    "links", "letter_entropy",
)
FEATURES = len(NAMES)
URL = re.compile(rb"https?://|www\.|@[a-z0-9-]+\.")
#: Bytes that commonly end a word.
_ENDS = np.zeros(256, bool)
_ENDS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?)\"'")] = True
_ENDS[128:] = True


def features(text):
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return np.zeros(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    histogram = np.bincount(data, minlength=256)
    shares = np.bincount(_KINDS, histogram, minlength=12) / n
    words = raw.split()
    k = len(words)
    if not k:
        return np.r_[shares, np.zeros(FEATURES - 12)]
    codes, distinct = pd.factorize(np.array(words, object))
    counts = np.bincount(codes)
    length = np.fromiter(map(len, words), np.int64, k)
    first = np.fromiter((w[0] for w in words), np.uint8, k)
    last = np.fromiter((w[-1] for w in words), np.uint8, k)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    p = counts / k
    letters = histogram[histogram > 0] / n
    entropy = -(p * np.log2(p)).sum() / max(1.0, np.log2(k))
    return np.r_[
        shares, np.log1p(k), length.mean(), len(distinct) / k, p.max(), (codes[1:] == codes[:-1]).mean() if k > 1 else 0.0,
        np.log1p(k / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), (_KINDS[first] == 2).mean(),
        (_KINDS[first] == 2)[_KINDS[last] == 2].sum() / k, (~_ENDS[last]).mean(), np.isin(last, list(b".,;:!?")).mean(),
        (length > 25).mean(), (length <= 2).mean(), entropy, len(URL.findall(raw)) / k, -(letters * np.log2(letters)).sum(),
    ]


def _featured(batches):
    for batch in steps(batches, "text"):
        texts = batch.column("text").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        values = np.stack([features(t or "") for t in texts])
        held_out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, FEATURES, dtype=np.int32)), pa.array(values.astype(np.float32).ravel()))
        yield arrow({"doc_id": batch.column("doc_id"), "copy": batch.column("copy"), "held_out": held_out, "x": flat}, {"held_out": pa.bool_()})


def expand(x):
    """Standardised features, clipped, with their squares."""
    x = np.clip(x, -8, 8)
    return np.c_[x, x * x, np.ones(len(x))]


def _log_loss_slope(f, sign):
    """Derivative by f of log(1 + exp(-sign f))."""
    return -sign / (1 + np.exp(np.clip(sign * f, -60, 60)))


def _loss(f, sign):
    return np.logaddexp(0, -sign * f)


def descend(gradient, size, steps_=600, rate=0.05):
    """Adam."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps_ + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def prior(p, u, least_share=0.3):
    """Class prior: least ratio of the shares of u and p whose rank is above a threshold."""
    edges = np.quantile(p, np.linspace(0, 1 - least_share, 200))
    above_p = 1 - np.searchsorted(np.sort(p), edges) / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), edges) / len(u)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


class Model:
    """Weights on standardised features, with the estimated prior."""

    def __init__(self, positives, unlabelled, ridge=1e-3):
        self.pi, self.w = 0.5, None
        if not len(positives) or not len(unlabelled):
            return
        both = np.r_[positives, unlabelled]
        self.mean, self.scale = both.mean(0), np.maximum(both.std(0), 1e-6)
        p, u = self._design(positives), self._design(unlabelled)
        plain = descend(lambda w: p.T @ _log_loss_slope(p @ w, 1) / len(p) + u.T @ _log_loss_slope(u @ w, -1) / len(u) + ridge * w, p.shape[1], 300)
        self.pi = prior(p @ plain, u @ plain)

        def gradient(w):
            fp, fu = p @ w, u @ w
            good = self.pi * p.T @ _log_loss_slope(fp, 1) / len(p)
            bad = u.T @ _log_loss_slope(fu, -1) / len(u) - self.pi * p.T @ _log_loss_slope(fp, -1) / len(p)
            if _loss(fu, -1).mean() - self.pi * _loss(fp, -1).mean() < 0:
                return -bad + ridge * w
            return good + bad + ridge * w

        self.w = descend(gradient, p.shape[1])

    def _design(self, x):
        return expand((x - self.mean) / self.scale)

    def score(self, x):
        if self.w is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -60, 60)))


def pu_scores(docs, labels, positives=20_000, unlabelled=40_000, threshold=0.3):
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    rows = held(ids.mapInArrow(_featured, "doc_id long, copy long, held_out boolean, x array<float>"), "features")
    learnt = rows.where("NOT held_out").withColumn("rank", F.xxhash64(F.lit("sample"), "doc_id", "copy"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    model = Model(_sample(learnt.join(good, "doc_id", "left_semi"), positives), _sample(learnt, unlabelled))

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
            score = model.score(x) if len(x) else np.zeros(0)
            out = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score), "predicted": (score >= threshold).astype(np.int32)}
            yield arrow(out, {"predicted": pa.int32()})

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def _sample(rows, n):
    """The n rows of the smallest hashes; a threshold on the hash keeps what is sorted near n whatever the table holds."""
    total = rows.count()
    if total > n:
        rows = rows.where(fraction("rank") < min(1.0, (1.1 * n + 1000) / total))
    found = rows.orderBy(fraction("rank"), "doc_id").limit(n).select("x").toPandas()["x"]
    return np.stack(found).astype(np.float64) if len(found) else np.zeros((0, FEATURES))
