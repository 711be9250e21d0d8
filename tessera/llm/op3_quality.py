"""Quality rules: base measures, and repetition by suffix array and LCP intervals.

The suffixes of each document's word sequence are ranked by prefix doubling (all
documents of a slice together; suffixes of different documents never tie), and the
ladder of ranks gives the longest common prefix of neighbours. L(i), the depth of
the deepest LCP interval that holds suffix i, is the longest repeat starting at
word i; the union of [i, i + L(i)) over all i with L(i) >= min_repeat is what the
maximal repeats cover. A document is rejected if that part is too large, or if the
longest repeat is both long and a large part of the document.

Rows are independent. Null text counts as empty; a document without words has
zeros everywhere and base_failed (fewer than 10 words); repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

#: Words of the shortest repeat that counts, percent covered allowed, words and percent of the longest repeat.
MIN_REPEAT, MAX_COVERED, LONG_WORDS, LONG_PERCENT = 10, 15, 50, 10
#: Bytes of text ranked together.
SLICE = 1_000_000
SYMBOLS = re.compile(r"[#*$%&|<>]")
NO_SPACE = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def longest_repeats(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """L(i) for every word: the longest sequence from i that starts elsewhere in its document too."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    stop = np.searchsorted(doc, doc, side="right")  # end of each word's document
    rank = dense(doc * (int(codes.max()) + 1) + codes)
    ladder = [rank]
    h = 1
    while True:
        tied = np.flatnonzero(np.bincount(rank)[rank] > 1)
        if not len(tied):
            break
        beyond = np.where(tied + h < stop[tied], rank[np.minimum(tied + h, n - 1)] + 1, 0)
        # Ranks of length 2h: those that no longer tie keep a number of their own.
        finer = rank * 2
        sub = dense(rank[tied] * (n + 2) + beyond)
        first = np.full(n, n, np.int64)
        np.minimum.at(first, rank[tied], sub)
        wide = np.int64(n + 1)
        key = rank * wide
        key[tied] += sub - first[rank[tied]]
        finer = dense(key)
        ladder.append(finer)
        rank, h = finer, 2 * h
    order = np.argsort(rank, kind="stable")  # the suffix array
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(ladder[0][a] == ladder[0][b])
    for level in range(len(ladder) - 1, -1, -1):
        i, j, h = a[live] + lcp[live], b[live] + lcp[live], 1 << level
        # Both stretches of h words must lie in the document: a shorter rank may end with it.
        inside = (i + h <= stop[a[live]]) & (j + h <= stop[b[live]])
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        r = ladder[level]
        lcp[live[inside & (r[i] == r[j])]] += h
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Booleans of n places: those inside any [start, start + length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge)[:-1] > 0


def measures(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for d in words for w in d]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(words)), n_words)
    longest = longest_repeats(codes, doc)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flags], minlength=len(words)).astype(np.int64)

    five, long = np.flatnonzero(longest >= 5), np.flatnonzero(longest >= min_repeat)
    top = np.zeros(len(words), np.int64)
    np.maximum.at(top, doc[long], longest[long])
    dup_lines = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.translate(NO_SPACE)]
        dup_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words,
        "word_chars": np.array([len((t or "").translate(NO_SPACE)) for t in texts], np.int64),
        "n_symbols": np.array([len(SYMBOLS.findall(t or "")) for t in texts], np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": per_doc(covered(five, np.full(len(five), 5), len(flat))),
        "covered_words": per_doc(covered(long, longest[long], len(flat))),
        "longest_repeat": top,
    }


def judge(batches: Iterator[pa.RecordBatch], limits: tuple[int, int, int, int], keep: list[str] | None) -> Iterator[pa.RecordBatch]:
    min_repeat, max_covered, long_words, long_percent = limits
    for batch in batches:
        for part in slices(batch, "__text", SLICE):
            m = measures(part.column("__text").to_pylist(), min_repeat)
            n = m["n_words"]
            failed = (n < 10) | (100 * m["n_repeat_words"] > 20 * n)
            repeats = (100 * m["covered_words"] > max_covered * n) | ((m["longest_repeat"] > long_words) & (100 * m["longest_repeat"] > long_percent * n))
            kept = pa.array(~failed & ~repeats)
            if keep is not None:
                yield part.select(keep).filter(kept)
                continue
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            more = ["covered_words", "longest_repeat"]
            columns = [part.column("doc_id"), *(pa.array(m[c]) for c in names), pa.array(failed), kept, *(pa.array(m[c]) for c in more)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept", *more])


LIMITS = (MIN_REPEAT, MAX_COVERED, LONG_WORDS, LONG_PERCENT)


def quality_rules(docs: DataFrame, limits: tuple[int, int, int, int] = LIMITS) -> DataFrame:
    """Measures and verdict of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
    rows = bounded(docs).select("doc_id", F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(lambda it: judge(it, limits, None), schema)


def keep_good(docs: DataFrame, limits: tuple[int, int, int, int] = LIMITS) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    names = docs.columns
    rows = bounded(docs).withColumn("__text", F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: judge(it, limits, names), docs.schema)
