"""Suffix-array dedup over bytes by prefix-free parsing.

Parsing. The trigger of a 50-byte string is the stretch of 18 bytes in it with the least hash, the first
on a tie; equal strings have equal triggers at equal places. A phrase is what consecutive strings with one
trigger cover: left context, trigger, right context. Every string belongs to one phrase. (Triggers by a fixed
remainder of a hash would leave some strings without one.) The parse of a document is its sequence of
phrases, the dictionary the different phrases, each with the smallest document that holds it.

1. Dictionary. Every block sends its different phrases (trigger, contents, smallest document) to the bucket of
   the trigger, which merges them: a phrase that a smaller document holds is a repeat as a whole. Phrases whose
   trigger no other phrase has are settled with that, and their suffixes needn't be sorted.
2. Corpus order. The other phrases' bytes are sent, one copy of each different phrase. The bucket sorts the
   dictionary (left contexts, from the trigger outwards) and the parse (what follows from the trigger on), both with
   the lengths of common prefixes (`corpus_order`). A string with L bytes before its trigger is a pair: the node L bytes
   deep on the one side and 50 - L deep on the other. The pairs give the order of all strings with L bytes before
   their triggers; equal strings have equal L, so they are neighbours there with 50 bytes in common, and
   the smallest document of each tells which of them go.
   Beyond GROUP_LIMIT phrases of one trigger, each string is a phrase of its own and goes to the bucket of its bytes.
3. The documents' blocks carry the answers back along the parse and cut the bytes out.

In step 1 phrases are compared by 72 bits of hashes within a trigger's 32 bits and bucket; the hashes are built
of nonlinear steps from exact groups of eight bytes (hashing.py). Step 2 compares bytes.

Null text is empty; a document below 50 bytes is kept whole; rows with equal doc_id are one place in
the order, so none of them is earlier, repeated rows included; null doc_ids come after all others and are one place too.
The bytes left may cut a character; as text they are read without the broken ones. Very long texts are never cut, other
columns stay as they are whatever their names, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, BLOCK, BLOCK_BYTES, Deal, answers_of, bucket_of, cut, low, name_in_bucket, planes, steps, table, texts_of, unplanes
from .hashing import eight_bytes, first_least, joined, longer, mix

STRING, TRIGGER = 50, 18
#: Bytes of text parsed at once (a longer text is a slice of its own), and phrases of one trigger beyond which strings travel one by one.
SLICE, GROUP_LIMIT = 500_000, 20_000
NAME, CONTENT = 4, 9
ALL, NEED, SPLIT = 1, 2, 4
LAST_DOC = np.iinfo(np.int64).max
DICTIONARY = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("width", pa.int32()), ("payload", pa.binary())])
PIECES = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("heads", pa.binary()), ("pieces", pa.binary())])


def triggers(data: np.ndarray, bits: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each string's trigger, hash of each place's 18 bytes, hash of each string) of a byte array."""
    eight = mix(eight_bytes(data))
    sixteen = longer(eight, 8, 16)
    gram = joined(sixteen[: max(0, len(data) - TRIGGER + 1)], eight[TRIGGER - 8 :])
    thirty_two = longer(sixteen, 16, 32)
    n = max(0, len(data) - STRING + 1)
    whole = joined(thirty_two[:n], gram[STRING - TRIGGER :][:n])
    return first_least(mix(gram), STRING - TRIGGER + 1, bits), gram, whole


class Phrases:
    """The parse of a slice of documents: of every phrase its first and last string, trigger, document and hashes."""

    def __init__(self, data: np.ndarray, first: np.ndarray):
        self.start = self.last = self.doc = self.trigger = np.zeros(0, np.int64)
        self.group = self.content = self.content2 = np.zeros(0, np.uint64)
        if len(data) < STRING:
            return
        trigger, gram, whole = triggers(data)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        ok = np.arange(len(trigger)) + STRING <= first[1:][doc[: len(trigger)]]
        changes = trigger[1:] != trigger[:-1]
        begins, ends = ok.copy(), ok.copy()
        begins[1:] &= ~ok[:-1] | changes
        ends[:-1] &= ~ok[1:] | changes
        self.start, self.last = np.flatnonzero(begins), np.flatnonzero(ends)
        self.trigger, self.doc = trigger[self.start], doc[self.start]
        self.group = mix(gram[self.trigger] ^ np.uint64(0x9E3779B97F4A7C15))  # triggers have small hashes; groups should spread evenly
        a, b = whole[self.start], whole[self.last]
        shape = ((self.trigger - self.start) << 8 | (self.last - self.start)).astype(np.uint64)
        self.content = mix(joined(a, joined(b, mix(shape + np.uint64(1)))))
        self.content2 = mix(joined(b, joined(a, mix(shape + np.uint64(3)))))


class Parse:
    """A block's phrases, and its dictionary: the different ones by bucket of their triggers."""

    def __init__(self, rows: pa.Table, buckets: int):
        self.ids = np.array([LAST_DOC if d is None else d for d in rows.column("doc_id").to_pylist()], np.int64)
        self.texts = texts_of(rows)
        self.parts: list[tuple[int, int, np.ndarray, bytes]] = []
        found: list[Phrases] = []
        for a, b in self.slices():
            data = b"".join(self.texts[a:b])
            first = np.r_[0, np.cumsum([len(t) for t in self.texts[a:b]])].astype(np.int64)
            found.append(Phrases(np.frombuffer(data, np.uint8), first))
            self.parts.append((a, b, first, data))

        def every(name: str, kind: type) -> np.ndarray:
            return np.concatenate([getattr(p, name) for p in found]).astype(kind) if found else np.zeros(0, kind)

        self.edges = np.cumsum([0, *(len(p.start) for p in found)])
        self.start, self.last, self.trigger = (every(n, np.int64) for n in ("start", "last", "trigger"))
        group, content, content2 = (every(n, np.uint64) for n in ("group", "content", "content2"))
        self.doc = self.ids[np.concatenate([p[0] + f.doc for p, f in zip(self.parts, found, strict=True)])] if found else self.ids[:0]
        content2 = low(content2, CONTENT - 8)
        order = np.lexsort((self.doc, content2, content, group))
        ordered = group[order], content[order], content2[order]
        new = np.zeros(len(order), bool)
        for x in ordered:
            new[1:] |= x[1:] != x[:-1]
        new[:1] = True
        lead = np.flatnonzero(new)
        #: Each different phrase in order of trigger and content; the one that stands for it is in its smallest document.
        self.group, self.content, self.content2 = (x[lead] for x in ordered)
        self.lead = order[lead]
        self.least = self.doc[self.lead]
        self.own = np.empty(len(order), np.int64)
        self.own[order] = np.cumsum(new) - 1
        self.where = bucket_of(self.group, buckets)

    def slices(self) -> Iterator[tuple[int, int]]:
        start = held = 0
        for i, t in enumerate(self.texts):
            if held and held + len(t) > SLICE:
                yield start, i
                start, held = i, 0
            held += len(t)
        if start < len(self.texts):
            yield start, len(self.texts)

    def flags(self, answers: pa.Table) -> np.ndarray:
        """What is told of each different phrase."""
        told = answers_of(answers, 1)
        flag = np.zeros(len(self.lead), np.uint8)
        for bucket, part in cut(self.where):
            flag[part] = np.frombuffer(told[bucket], np.uint8)
        return flag

    def asked(self, flag: np.ndarray, buckets: int) -> Iterator[tuple[int, list[tuple[int, int, int]], list[bytes]]]:
        """(bucket, [(phrase, first string, strings)], their bytes) of the phrases that must be sorted."""
        sent: dict[int, tuple[list, list]] = {}
        which = np.flatnonzero(flag & NEED)
        runs = self.lead[which]
        part = np.searchsorted(self.edges, runs, "right") - 1
        for c, f, s, e, p, to in zip(*(x.tolist() for x in (which, flag[which], self.start[runs], self.last[runs], part, self.where[which])), strict=True):
            data = self.parts[p][3]
            if f & SPLIT:
                for j in range(s, e + 1):
                    piece = data[j : j + STRING]
                    heads, pieces = sent.setdefault(xxhash.xxh3_64_intdigest(piece) % buckets, ([], []))
                    heads.append((c, j - s, 1))
                    pieces.append(piece)
            else:
                heads, pieces = sent.setdefault(to, ([], []))
                heads.append((c, 0, e - s + 1))
                pieces.append(data[s : e + STRING])
        for to, (heads, pieces) in sorted(sent.items()):
            yield to, heads, pieces


def send_dictionary(rows: pa.Table, buckets: int) -> pa.Table:
    held = Parse(rows, buckets)
    name = name_in_bucket(held.group, held.where, buckets)
    block = rows.column(BLOCK)[0].as_py()
    out: list[tuple] = []
    for bucket, part in cut(held.where):
        least = held.least[part]
        base = int(least.min())
        over = least.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)
        width = 4 if int(over.max()) < 1 << 32 else 8
        out.append((bucket, block, base, width, planes([(steps(name[part]), NAME), (held.content[part], 8), (held.content2[part], CONTENT - 8), (over, width)])))
    return table(out, DICTIONARY)


def answer_dictionary(rows: pa.Table, limit: int) -> pa.Table:
    """For each phrase of each block, in its order: whether a smaller document holds it, and whether its bytes are needed."""
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    sizes = []
    for i, (base, width, payload) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("base", "width", "payload")), strict=True)):
        step, content, content2, over = unplanes(payload, [NAME, 8, CONTENT - 8, width])
        sizes.append(len(step))
        row = np.cumsum(step, dtype=np.uint64), content, content2, (over + np.uint64(base & (1 << 64) - 1)).astype(np.int64), np.full(len(step), i)
        for held, x in zip(columns, row, strict=True):
            held.append(x)
    group, content, content2, least, sender = map(np.concatenate, columns)
    order = np.lexsort((sender, least, content2, content, group))
    group, content, content2, least = group[order], content[order], content2[order], least[order]
    new_group = np.r_[True, group[1:] != group[:-1]]
    new = new_group | np.r_[True, (content[1:] != content[:-1]) | (content2[1:] != content2[:-1])]
    of_group = np.cumsum(new_group) - 1
    phrases = np.bincount(of_group, weights=new)[of_group]
    first = np.flatnonzero(new)
    smallest = least[first][np.cumsum(new) - 1]
    need = np.select([phrases > limit, phrases > 1], [NEED | SPLIT, NEED], 0)
    flag = np.empty(len(group), np.uint8)
    flag[order] = np.where(least > smallest, ALL, need)
    bucket = rows.column("bucket")[0].as_py()
    return table([(b, bucket, 1, p.tobytes()) for b, p in zip(rows.column("block").to_pylist(), np.split(flag, np.cumsum(sizes)[:-1]), strict=True)], ANSWER)


def send_pieces(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The bytes of one phrase for each that must be sorted, with its smallest document and its trigger's place."""
    if not rows.num_rows:
        return table([], PIECES)
    held = Parse(rows, buckets)
    block = rows.column(BLOCK)[0].as_py()
    out = []
    for bucket, heads, pieces in held.asked(held.flags(answers), buckets):
        c, shift, n = np.array(heads, np.int64).T
        place = held.trigger[held.lead[c]] - held.start[held.lead[c]] - shift
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        columns = planes([(held.least[c].astype(np.uint64), 8), (n.astype(np.uint64), 1), (place.astype(np.uint64), 1), (size.astype(np.uint64), 1)])
        out.append((bucket, block, columns, b"".join(pieces)))
    return table(out, PIECES)


def in_order(keys: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bytes common to neighbours) of byte strings given as numbers of eight bytes, zero beyond their lengths."""
    order = np.lexsort((length, *keys[::-1]))
    common = np.zeros(max(0, len(order) - 1), np.int64)
    alive = np.ones(len(common), bool)
    for key in keys:
        x = key[order][1:] ^ key[order][:-1]
        for shift in (1, 2, 4, 8, 16, 32):
            x |= x >> np.uint64(shift)
        common += np.where(alive, 8 - (np.bitwise_count(x).astype(np.int64) + 7) // 8, 0)
        alive &= x == 0
    return order, np.minimum(common, np.minimum(length[order][1:], length[order][:-1]))


def numbers(data: np.ndarray, start: np.ndarray, length: np.ndarray, most: int) -> list[np.ndarray]:
    """The strings of at most `most` bytes that start there, as numbers of eight bytes."""
    eight = eight_bytes(np.r_[data, np.zeros(most + 8, np.uint8)])
    out = []
    for at in range(0, most, 8):
        left = np.clip(length - at, 0, 8)
        x = eight[np.minimum(start + at, len(eight) - 1)]
        mask = np.where(left > 0, ~np.uint64(0) << ((8 - left) * 8 % 64).astype(np.uint64), np.uint64(0))
        out.append(x & mask)
    return out


def corpus_order(data: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, string in it, number): the strings of the phrases; equal numbers mean equal strings.

    Phrase i is data[first[i] : first[i + 1]], holds count[i] strings and its trigger at place[i].
    """
    size = np.diff(first)
    at = first[:-1] + place
    # The parse: what follows from the trigger on. The dictionary: what stands before it, outwards.
    after, after_common = in_order(numbers(data, at, size - place, STRING), size - place)
    before, before_common = in_order(numbers(data[::-1], len(data) - at, place, STRING - TRIGGER), place)
    phrase, string, number = [], [], []
    total = 0
    for n_left in range(STRING - TRIGGER + 1):
        which = np.flatnonzero((place >= n_left) & (place - n_left < count))
        if not len(which):
            continue
        node_after, node_before = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        node_after[after] = np.cumsum(np.r_[0, after_common < STRING - n_left])
        node_before[before] = np.cumsum(np.r_[0, before_common < n_left])
        pair = np.unique(node_before[which] * (len(size) + 1) + node_after[which], return_inverse=True)[1]
        phrase.append(which)
        string.append(place[which] - n_left)
        number.append(pair + total)
        total += int(pair.max()) + 1
    return np.concatenate(phrase), np.concatenate(string), np.concatenate(number)


def answer_pieces(rows: pa.Table) -> pa.Table:
    """For each sent phrase of each block, in its order: the strings in it that a smaller document holds, one bit each."""
    parts = [unplanes(heads, [8, 1, 1, 1]) for heads in rows.column("heads").to_pylist()]
    doc, count, place, size = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
    data = np.frombuffer(b"".join(rows.column("pieces").to_pylist()), np.uint8)
    phrase, string, number = corpus_order(data, np.r_[0, np.cumsum(size)], count, place)
    least = np.full(int(number.max()) + 1, LAST_DOC, np.int64)
    np.minimum.at(least, number, doc[phrase])
    hit = doc[phrase] > least[number]
    mask = np.zeros(len(size), np.uint64)
    np.bitwise_or.at(mask, phrase[hit], np.uint64(1) << string[hit].astype(np.uint64))
    bucket = rows.column("bucket")[0].as_py()
    return table([(b, bucket, 2, planes([(p, 5)])) for b, p in zip(rows.column("block").to_pylist(), np.split(mask, np.cumsum([len(p[0]) for p in parts])[:-1]), strict=True)], ANSWER)


def covered(rows: pa.Table, answers: pa.Table, buckets: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each document's bytes, and whether an earlier string covers them."""
    held = Parse(rows, buckets)
    flag = held.flags(answers)
    bits = np.zeros(len(flag), np.uint64)
    told = answers_of(answers, 2)
    for bucket, heads, _ in held.asked(flag, buckets):
        c, shift, _ = np.array(heads, np.int64).T
        np.bitwise_or.at(bits, c, unplanes(told[bucket], [5])[0] << shift.astype(np.uint64))
    whole = (flag & ALL > 0)[held.own] | (held.doc > held.least[held.own])
    for (a, b, first, data), lo, hi in zip(held.parts, held.edges[:-1], held.edges[1:], strict=True):
        edge = np.zeros(len(data) + 1, np.int64)
        start, last, every = held.start[lo:hi], held.last[lo:hi], whole[lo:hi]
        np.add.at(edge, start[every], 1)
        np.add.at(edge, last[every] + STRING, -1)
        some = np.where(every, np.uint64(0), bits[held.own[lo:hi]])
        for bit in range(STRING - TRIGGER + 1):
            s = start[some >> np.uint64(bit) & np.uint64(1) > 0] + bit
            np.add.at(edge, s, 1)
            np.add.at(edge, s + STRING, -1)
        inside = np.cumsum(edge)[:-1] > 0
        for d in range(a, b):
            yield held.texts[d], inside[first[d - a] : first[d - a + 1]]


def over_blocks(docs: DataFrame, finish: Callable[[pa.Table, Iterator], pa.Table], schema: str, block_bytes: int, group_limit: int) -> DataFrame:
    deal = Deal(docs, block_bytes)
    n = deal.n
    flags = deal.answer(deal.send(lambda t: send_dictionary(t, n), DICTIONARY), lambda t: answer_dictionary(t, group_limit))
    masks = deal.answer(deal.told(flags, lambda t, a: send_pieces(t, a, n), "bucket int, block int, heads binary, pieces binary"), answer_pieces)
    return deal.told(flags.unionByName(masks), lambda t, a: finish(t, covered(t, a, n)), schema)


def digest(rows: pa.Table, found: Iterator) -> pa.Table:
    out = []
    for text, gone in found:
        lost = int(gone.sum())
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)) if lost else 0
        left = np.frombuffer(text, np.uint8)[~gone].tobytes() if lost else text
        out.append((len(text), lost, spans, hashlib.sha256(left).hexdigest()))
    columns = list(zip(*out, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.Table.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_blocks(rows, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block_bytes, group_limit)


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The documents with repeated bytes taken out of text, other columns as they are; n_chars follows."""
    names = docs.columns

    def finish(rows: pa.Table, found: Iterator) -> pa.Table:
        whole = rows.column("text").to_pylist()
        texts = [np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else whole[d] for d, (text, gone) in enumerate(found)]
        columns = {c: rows.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in names:
            was = rows.column("n_chars").to_pylist()
            columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, was, strict=True)], rows.column("n_chars").type)
        return pa.Table.from_arrays([columns[c] for c in names], names)

    return over_blocks(docs, finish, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes), block_bytes, group_limit)
