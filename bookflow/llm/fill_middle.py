"""Fill-in-the-middle transformation, with token counts of content-defined chunks kept in a memo.

1. A rolling hash over 32 bytes cuts a text into chunks, so passages that documents share give equal chunks wherever they
   stand. Chunks end between code points and have MIN_CHUNK to MAX_CHUNK bytes, but for the last.
2. The summary of a chunk - its words, its code points, and whether white space stands at either end - is kept in a memo of
   the worker under the chunk's content; a chunk seen before is compared with that content, never by a hash alone.
3. Summaries combine from left to right: a word that runs over a boundary counts once. The sums give the number of tokens
   and the chunk in which each cut lies; only there words are looked for.

A token is a word with the white space before it, or white space at the end of the text. The draws of a document come from
the SHA-256 of the seed and its id, so they do not depend on order or partitions.

No row moves: a lost executor costs its tasks only. The memo starts anew at `MEMO_BYTES` of content.

Defined results: null and empty texts stay plain with 0 tokens; a null id is drawn like an empty one; texts that hold one of
the three marks stay plain; equal rows have equal results; an empty table gives an empty one.
"""

import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import arrow, steps

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW = 32
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 512, 2048, 16384
MEMO_BYTES = 32 << 20
SEGMENT = 1 << 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CONTINUED = bytes(range(0x80, 0xC0))
_GEAR = np.random.default_rng(20240307).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def rolling(data):
    """Hashes of the last `WINDOW` bytes at each place: byte values times powers of two, summed by doubling the window."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h


def chunk_ends(raw):
    """Ends of the chunks of a text in UTF-8. The text is read in segments, so hashes take a bounded space."""
    data = np.frombuffer(raw, np.uint8)
    ends, last = [], 0

    def cut(at):
        while at < len(raw) and 0x80 <= raw[at] < 0xC0:
            at += 1
        ends.append(at)
        return at

    for start in range(0, len(data), SEGMENT):
        before = max(0, start - WINDOW + 1)
        h = rolling(data[before : start + SEGMENT])[start - before :]
        # the upper bits depend on the whole window
        for at in (np.flatnonzero(h >> np.uint32(21) == 0) + start + 1).tolist():
            while at - last > MAX_CHUNK:
                last = cut(last + MAX_CHUNK)
            if at - last >= MIN_CHUNK:
                last = cut(at)
    while len(raw) - last > MAX_CHUNK:
        last = cut(last + MAX_CHUNK)
    if last < len(raw):
        ends.append(len(raw))
    return ends


def summary(chunk):
    """(words, code points, white space first, white space last)."""
    return len(chunk.split()), len(chunk.translate(None, _CONTINUED)), chunk[:1].isspace(), chunk[-1:].isspace()


class Memo:
    """Summaries by content of chunks; equality of the content decides."""

    def __init__(self, limit=MEMO_BYTES):
        self.limit, self.bytes, self.found, self.known = limit, 0, 0, {}

    def __call__(self, chunk):
        s = self.known.get(chunk)
        if s is not None:
            self.found += 1
            return s
        s = summary(chunk)
        if self.bytes + len(chunk) > self.limit:
            self.known, self.bytes = {}, 0
        self.known[chunk] = s
        self.bytes += len(chunk)
        return s


class Cuts:
    """Token count and places of token ends of one text, from the summaries of its chunks."""

    def __init__(self, raw, memo):
        self.raw = raw
        ends = chunk_ends(raw)
        self.starts = [0, *ends[:-1]]
        self.ends = ends
        self.words, self.chars, self.joined = [0], [0], []  # sums before each chunk; whether its first word began earlier
        open_word, blank = False, True
        for a, b in zip(self.starts, ends):
            words, chars, first, blank = memo(raw[a:b])
            self.joined.append(open_word and not first)
            self.words.append(self.words[-1] + words - self.joined[-1])
            self.chars.append(self.chars[-1] + chars)
            open_word = not blank
        self.tokens = self.words[-1] + (1 if raw and blank else 0)

    def end(self, tokens):
        """(byte, code point) behind so many tokens."""
        if tokens == 0:
            return 0, 0
        if tokens > self.words[-1]:
            return len(self.raw), self.chars[-1]
        k = int(np.searchsorted(self.words, tokens)) - 1
        word = tokens - self.words[k] + self.joined[k]
        match = next(islice(_WORD.finditer(self.raw, self.starts[k], self.ends[k]), word - 1, None))
        at = match.end()
        while at == self.ends[k] and k + 1 < len(self.ends) and self.joined[k + 1]:  # the word runs on
            k += 1
            at = _WORD.match(self.raw, self.starts[k], self.ends[k]).end()
        return at, self.chars[k] + len(self.raw[self.starts[k] : at].translate(None, _CONTINUED))


def draws(seed, doc_id):
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(raw, doc_id, memo, seed, rate, spm_rate):
    """(tokens, form, code points of the prefix, of the middle, output) of a text in UTF-8."""
    cuts = Cuts(raw, memo)
    n, h = cuts.tokens, draws(seed, doc_id)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not raw or h[2] % 100 >= rate or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = cuts.end(first), cuts.end(last)
    prefix, suffix, middle = marks[0] + raw[:a], marks[1] + raw[b:], marks[2] + raw[a:b]
    form, parts = ("spm", (suffix, prefix, middle)) if h[3] % 100 < spm_rate else ("psm", (prefix, suffix, middle))
    return n, form, a_chars, b_chars - a_chars, b"".join(parts)


def fill_middle(docs, seed=42, rate=50, spm_rate=80):
    """docs(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output."""

    def run(batches):
        memo = Memo()
        for batch in steps(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = [transformed(t or b"", i, memo, seed, rate, spm_rate) for t, i in zip(texts, batch.column("doc_id").to_pylist())]
            n, form, prefix, middle, output = (list(c) for c in zip(*rows))
            long = pa.int64()
            columns = {"doc_id": batch.column("doc_id"), "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle}
            columns["output"] = pa.array(output, pa.binary()).cast(pa.string())
            yield arrow(columns, {"n": long, "form": pa.string(), "prefix_chars": long, "middle_chars": long})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output, form):
    """The text that an output of this form was made from; the marks stand once each, as no text with a mark is changed."""

    def halves(text, mark):
        head = F.substring_index(text, mark, 1)
        return head, text.substr(F.char_length(head) + 1 + len(mark), F.char_length(text))

    first, tail = halves(output.substr(F.lit(1 + len(PREFIX)), F.char_length(output)), SUFFIX)
    suffix, middle = halves(tail, MIDDLE)
    psm = F.concat(first, middle, suffix)
    first, tail = halves(output.substr(F.lit(1 + len(SUFFIX)), F.char_length(output)), PREFIX)
    prefix, middle = halves(tail, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, first)).otherwise(output)
