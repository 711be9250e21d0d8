"""Substring dedup over words by prefix-partitioned suffix trees.

The suffixes are those that start a window of 35 words; what matters of each are these words. They are
strings of five labels: hashes of 8 words each, from places 0, 8, 16, 24 and 27.

1. Prefix counts. Every block sends, for each different 8-word prefix of its suffixes, how many
   different suffixes it has with it. The prefix's bucket adds up, and answers: 0, no other block
   has the prefix (no inner node of another document's suffixes can lie below it); 1, a tree below this
   prefix fits in memory (GROUP_LIMIT suffixes); 2 or 3, it doesn't, and the prefix has to be longer: 16
   words, whose group is smaller than GROUP_LIMIT * LONGER, or all 35.
2. Trees. Each different suffix with an answer above 0 is sent, as its labels, to the bucket of its prefix
   of the length told. The bucket sorts the suffixes of its prefixes; the intervals of longest common
   prefixes are the inner nodes of their suffix trees (`inner_nodes`). A node 35 words deep is a repeat, and so
   are all leaves below it. Answers: one bit for each suffix.
3. Every word that a repeated window covers is removed; consecutive repeated windows merge to maximal ones.

Suffixes equal within a block are one leaf with a count there, so a block sends a passage once however many
copies it has. Labels are compared by 24 bits each and the prefix by 32 within its bucket: 128 bits and the
bucket's own tell two windows apart, and they are hashes of words by xxh3, joined by nonlinear steps (hashing.py).

Null or empty text has no words; documents below 35 words are kept whole; a repeated row repeats the windows of
its twin, so both lose them, ties cannot arise; null doc_ids are documents like others; very long texts are
never cut (a block holds at least one whole text); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, BLOCK, BLOCK_BYTES, MESSAGE, Deal, answers_of, bucket_of, cut, low, name_in_bucket, planes, steps, table, texts_of, unplanes
from .hashing import joined, longer, mix, word_hashes

WINDOW, PREFIX = 35, 8
#: Places of the labels after the prefix, and the words that suffixes share whose prefix and first k labels are equal.
PLACES, DEPTHS = (8, 16, 24, 27), (0, 8, 16, 24, 32, 35)
#: Suffixes of one prefix that a tree may have, and the factor beyond which 16 words aren't enough either.
GROUP_LIMIT, LONGER = 200_000, 16
NAME, LABEL, COUNT = 4, 3, 4
UNIQUE, SHORT, LONG, WHOLE = range(4)


def eight_words(words: list[bytes]) -> np.ndarray:
    """Hashes of all stretches of eight words."""
    h = word_hashes(words)
    for have in (1, 2, 4):
        h = longer(h, have, 2 * have)
    return h


class Suffixes:
    """The different suffixes of a block in the order of their prefixes' hashes, by bucket, and the places of each."""

    def __init__(self, rows: pa.Table, buckets: int):
        words = [t.split() for t in texts_of(rows)]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        eight = eight_words([w for d in words for w in d])
        self.first = np.r_[0, np.cumsum(self.sizes)]
        ends = np.repeat(self.first[1:], self.sizes)
        start = np.flatnonzero(np.arange(len(ends)) + WINDOW <= ends)
        prefix = mix(eight[start])
        order = np.argsort(prefix, kind="stable")
        start, prefix = start[order], prefix[order]
        tied = np.r_[False, prefix[1:] == prefix[:-1]] if len(prefix) else np.zeros(0, bool)
        some = np.flatnonzero(tied | np.r_[tied[1:], False])  # few: suffixes that share their prefix
        if len(some):
            labels = [eight[start[some] + p] for p in PLACES]
            start[some] = start[some][np.lexsort((*labels[::-1], prefix[some]))]
        labels = [eight[start + p] for p in PLACES]
        new = ~tied
        for x in labels:
            new[1:] |= x[1:] != x[:-1]
        self.start, self.leaf = start, np.cumsum(new) - 1
        lead = np.flatnonzero(new)
        self.copies = np.diff(np.r_[lead, len(start)])
        self.prefix, self.labels = prefix[lead], [x[lead] for x in labels]
        self.where = bucket_of(self.prefix, buckets)
        self.name = name_in_bucket(self.prefix, self.where, buckets)
        self.new_name = np.r_[True, (self.name[1:] != self.name[:-1]) | (self.where[1:] != self.where[:-1])] if len(lead) else np.zeros(0, bool)

    def codes(self, answers: pa.Table) -> np.ndarray:
        """The answer to each suffix's prefix."""
        told = answers_of(answers, 1)
        lead = np.flatnonzero(self.new_name)
        code = np.zeros(len(lead), np.uint8)
        for bucket, part in cut(self.where[lead]):
            code[part] = np.frombuffer(told[bucket], np.uint8)
        return code[np.cumsum(self.new_name) - 1]

    def asked(self, code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, bucket) of the suffixes for the trees, by bucket."""
        which = np.flatnonzero(code)
        where = self.where[which]
        for length, labels in ((LONG, self.labels[:1]), (WHOLE, self.labels)):
            far = code[which] == length
            if far.any():
                h = self.prefix[which[far]]
                for x in labels:
                    h = joined(h, x[which[far]])
                where[far] = bucket_of(mix(h), buckets)
        order = np.argsort(where, kind="stable")
        return which[order], where[order]


def send_counts(rows: pa.Table, buckets: int) -> pa.Table:
    held = Suffixes(rows, buckets)
    lead = np.flatnonzero(held.new_name)
    count = np.diff(np.r_[lead, len(held.prefix)])
    block = rows.column(BLOCK)[0].as_py()
    return table([(b, block, planes([(steps(held.name[lead[part]]), NAME), (count[part], COUNT)])) for b, part in cut(held.where[lead])], MESSAGE)


def answer_counts(rows: pa.Table, limit: int, longer_by: int) -> pa.Table:
    """For each prefix of each block, in its order: how long the prefix has to be."""
    names, counts, sizes = [], [], []
    for payload in rows.column("payload").to_pylist():
        step, count = unplanes(payload, [NAME, COUNT])
        names.append(np.cumsum(step, dtype=np.uint64))
        counts.append(count)
        sizes.append(len(count))
    name, count = np.concatenate(names), np.concatenate(counts)
    order = np.argsort(name, kind="stable")
    new = np.r_[True, name[order][1:] != name[order][:-1]]
    of = np.cumsum(new) - 1
    total = np.bincount(of, weights=count[order])
    code = np.select([np.bincount(of) == 1, total <= limit, total <= limit * longer_by], [UNIQUE, SHORT, LONG], WHOLE).astype(np.uint8)
    answer = np.empty(len(name), np.uint8)
    answer[order] = code[of]
    parts = np.split(answer, np.cumsum(sizes)[:-1])
    bucket = rows.column("bucket")[0].as_py()
    return table([(b, bucket, 1, p.tobytes()) for b, p in zip(rows.column("block").to_pylist(), parts, strict=True)], ANSWER)


def send_suffixes(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not rows.num_rows:
        return table([], MESSAGE)
    held = Suffixes(rows, buckets)
    which, where = held.asked(held.codes(answers), buckets)
    block = rows.column(BLOCK)[0].as_py()
    out = []
    for bucket, part in cut(where):
        of = which[part]
        out.append((bucket, block, planes([(held.name[of], NAME), *((low(x[of], LABEL), LABEL) for x in held.labels)])))
    return table(out, MESSAGE)


def inner_nodes(fields: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The forest of suffix trees of strings given by their fields.

    (order of the leaves, common fields of neighbours, inner nodes as (fields deep, first leaf, last leaf + 1), every node before those below it).
    """
    order = np.lexsort(fields[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    common = np.zeros(len(same), np.int64)
    for x in fields:
        same &= x[order][1:] == x[order][:-1]
        common += same
    nodes: list[tuple[int, int, int]] = []
    for depth in range(1, len(fields) + 1):
        deep = np.r_[False, common >= depth, False]
        lo, hi = np.flatnonzero(deep[1:] & ~deep[:-1]), np.flatnonzero(~deep[1:] & deep[:-1])
        nodes += zip([depth] * len(lo), lo.tolist(), (hi + 1).tolist(), strict=True)
    # An interval that is one at a greater depth too is the deeper node's edge, not a node.
    deepest = {(lo, hi): depth for depth, lo, hi in nodes}
    return order, common, sorted(((d, lo, hi) for (lo, hi), d in deepest.items()), key=lambda x: (x[1], -x[2], x[0]))


def answer_trees(rows: pa.Table) -> pa.Table:
    """For each suffix of each block, in its order: whether it lies below a node 35 words deep."""
    parts = [unplanes(p, [NAME] + [LABEL] * len(PLACES)) for p in rows.column("payload").to_pylist()]
    fields = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order, _, nodes = inner_nodes(fields)
    edge = np.zeros(len(order) + 1, np.int64)
    deep = np.array([(lo, hi) for depth, lo, hi in nodes if DEPTHS[depth] >= WINDOW], np.int64).reshape(-1, 2)
    edge[deep[:, 0]] += 1
    np.subtract.at(edge, deep[:, 1], 1)
    found = np.zeros(len(order), np.uint8)
    found[order] = np.cumsum(edge)[:-1] > 0
    sizes = [len(p[0]) for p in parts]
    bucket = rows.column("bucket")[0].as_py()
    return table([(b, bucket, 2, np.packbits(p).tobytes()) for b, p in zip(rows.column("block").to_pylist(), np.split(found, np.cumsum(sizes)[:-1]), strict=True)], ANSWER)


def covered(rows: pa.Table, answers: pa.Table, buckets: int) -> Iterator[np.ndarray]:
    """Of each document's words, whether a repeated window covers them."""
    held = Suffixes(rows, buckets)
    repeated = held.copies > 1
    if len(repeated):
        told = answers_of(answers, 2)
        which, where = held.asked(held.codes(answers), buckets)
        for bucket, part in cut(where):
            repeated[which[part]] |= np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=part.stop - part.start).astype(bool)
    edge = np.zeros(int(held.first[-1]) + 1, np.int64)
    start = held.start[repeated[held.leaf]]
    edge[start] += 1
    edge[start + WINDOW] -= 1  # starts are all different
    inside = np.cumsum(edge)[:-1] > 0
    for a, b in zip(held.first[:-1].tolist(), held.first[1:].tolist(), strict=True):
        yield inside[a:b]


def digest(rows: pa.Table, gone: Iterator[np.ndarray]) -> pa.Table:
    n_words, n_removed, kept = [], [], []
    for text, lost in zip(texts_of(rows), gone, strict=True):
        words = text.split()
        n_words.append(len(words))
        n_removed.append(int(lost.sum()))
        left = [w for w, g in zip(words, lost.tolist(), strict=True) if not g] if n_removed[-1] else words
        kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
    return pa.Table.from_arrays([rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def texts_left(rows: pa.Table, gone: Iterator[np.ndarray]) -> pa.Table:
    out = []
    for text, lost in zip(texts_of(rows), gone, strict=True):
        out.append(b" ".join([w for w, g in zip(text.split(), lost.tolist(), strict=True) if not g]).decode("utf-8", "replace"))
    return pa.Table.from_arrays([rows.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def substring_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, with_text: bool = False, group_limit: int = GROUP_LIMIT, longer_by: int = LONGER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; with_text: doc_id and the words left."""
    deal = Deal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), block_bytes)
    n = deal.n
    counts = deal.answer(deal.send(lambda t: send_counts(t, n)), lambda t: answer_counts(t, group_limit, longer_by))
    trees = deal.answer(deal.told(counts, lambda t, a: send_suffixes(t, a, n), "bucket int, block int, payload binary"), answer_trees)
    finish = texts_left if with_text else digest
    schema = "doc_id long, text string" if with_text else "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return deal.told(counts.unionByName(trees), lambda t, a: finish(t, covered(t, a, n)), schema)
