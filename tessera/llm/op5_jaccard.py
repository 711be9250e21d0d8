"""N-gram Jaccard join by T-occurrence search (DivideSkip), and its components.

Documents with equal shingle sets are one class, so copies are never paired. Two classes
link if their sets' overlap reaches ceil(0.8 / 1.8 * (|x| + |y|)).

1. One scan gives every document's class and size, and the shingles that are frequent in
   their surroundings. The most frequent HOT of them (a bounded list) go last in the
   order of all shingles; any common order gives the same result.
2. In that order two linked classes share one of their first n - ceil(0.8 n) + 1 shingles: of a
   class's lists these are the short ones, the others the T - 1 long ones that cannot
   make a candidate alone. Only short lists are sent, by bucket of their shingle, once for each
   class and block of documents. A list's members (cut where sizes are too far apart to
   link) all meet at the list's centre, its smallest class.
3. Members first send the centres a bitmap of their set, some 3 bits for each element. Two sets differ in
   at least as many elements as their bitmaps in bits, so the centre knows without error who
   can't link to any other (documents that share one passage, say), and asks the rest for their sets.
   Each set then searches the others: the short lists of the group are merged by a heap, which counts each
   candidate; candidates are probed in the long lists by binary search, and members already
   connected are skipped. What leaves is a spanning forest, not pairs. A centre with more than TILE members is split into tiles, and
   every two tiles meet in a task of their own.
4. Components of the forests by alternating large-star and small-star steps, written to the
   shared folder after each; labels are the smallest doc_id. Vertices, classes and components with many
   rows are dealt to several tasks (common.hot_join).

Shingles are 63-bit hashes made of xxh3 of the words by nonlinear steps, classes 64-bit hashes of sets.

A document without words has no shingles and links with nothing; fewer than five words
are one shingle. A row without doc_id takes part, but cannot name its component; rows that
repeat a doc_id are documents of their own that share the name. Rows repeated whole are copies. Null text is
empty; very long texts are never cut; ties have no say in components; other columns are ignored (keep_first
keeps them, whatever their names but __id, __sig, gone and times); an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, BLOCK_BYTES, Deal, ddl, planes, table, unplanes
from .common import bounded, hot_join, materialize, shared_dir, slices
from .hashing import longer, mix, word_hashes

SIZE, PERCENT = 5, 80
HOT, TILE, SLICE = 50_000, 4_096, 500_000
TOP = np.uint64(1 << 63)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of all texts, sorted and without repeats; shingles are 63-bit numbers."""
    words = [t.lower().split() for t in texts]  # bytes.lower changes A-Z only
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.r_[0, np.cumsum(n)]
    doc = np.repeat(np.arange(len(texts)), n)
    one = word_hashes([w for d in words for w in d])
    two = longer(one, 1, 2)
    four = longer(two, 2, 4)
    by_length = {1: one, 2: two, 3: longer(two, 2, 3), 4: four, SIZE: longer(four, 4, SIZE)}
    whole = np.flatnonzero(np.arange(len(doc)) + SIZE <= first[1:][doc])
    docs, grams = [doc[whole]], [mix(by_length[SIZE][whole] + np.uint64(SIZE))]
    for k in range(1, SIZE):
        few = np.flatnonzero(n == k)
        docs.append(few)
        grams.append(mix(by_length[k][first[few]] + np.uint64(k)))
    doc, gram = np.concatenate(docs), np.concatenate(grams) >> np.uint64(1)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], gram[new]


def classes(doc: np.ndarray, gram: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and class (a fingerprint of the whole set) of each document."""
    n = np.bincount(doc, minlength=n_docs).astype(np.int64)
    total = np.zeros(n_docs, np.uint64)
    np.add.at(total, doc, mix(gram + np.uint64(0x51ED270B)))
    return n, mix(total ^ mix(n.astype(np.uint64)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


SCAN = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("gram", pa.int64()), ("times", pa.int64())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, sig, n, cls) of documents, and (gram, times) of shingles that several classes of a slice share."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            doc, gram = shingles(texts)
            n, cls = classes(doc, gram, len(texts))
            blank = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sig"), pa.array(n), pa.array(signed(cls)), blank, blank], schema=SCAN)
            lead = np.zeros(len(texts), bool)
            lead[np.unique(cls, return_index=True)[1]] = True
            found, times = np.unique(gram[lead[doc]], return_counts=True)
            many = times > 2
            if many.any():
                blank = pa.nulls(int(many.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([blank, blank, blank, blank, pa.array(signed(found[many])), pa.array(times[many].astype(np.int64))], schema=SCAN)


class Sets:
    """The different shingle sets of a block, hot shingles last: class, size and elements."""

    def __init__(self, rows: pa.Table, hot: np.ndarray):
        texts = sorted((t or "").encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist())
        held: dict[int, np.ndarray] = {}
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= SLICE):
                size += len(texts[stop])
                stop += 1
            doc, gram = shingles(texts[start:stop])
            if not len(doc):  # only texts without words
                start = stop
                continue
            _, cls = classes(doc, gram, stop - start)
            at = np.searchsorted(hot, gram)
            late = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == gram) if len(hot) else np.zeros(len(gram), bool)
            gram = np.where(late, gram | TOP, gram)
            gram = gram[np.argsort(2 * doc + late, kind="stable")]  # sorted runs: the hot ones only move behind the others
            for d, piece in zip(np.unique(doc), np.split(gram, np.flatnonzero(np.diff(doc)) + 1), strict=True):
                held.setdefault(int(cls[d]), piece)
            start = stop
        self.sets = held


ONE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
ASK = pa.schema([("block", pa.int32()), ("payload", pa.binary())])
TWO = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap with any set that links to one of n elements."""
    return -(-n * PERCENT // 100)


def send_lists(rows: pa.Table, hot: np.ndarray, buckets: int) -> pa.Table:
    """The short lists' postings of a block, by bucket of the shingle."""
    sets = Sets(rows, hot).sets
    if not sets:
        return table([], ONE)
    n = np.fromiter(map(len, sets.values()), np.int64, len(sets))
    short = n - needed(n) + 1
    gram = np.concatenate([s[:k] for s, k in zip(sets.values(), short.tolist(), strict=True)])
    cls = np.repeat(np.fromiter(sets, np.uint64, len(sets)), short)
    size = np.repeat(n, short).astype(np.uint64)
    spread = mix(gram)
    where = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((spread, where))
    where = where[order]
    block = rows.column(BLOCK)[0].as_py()
    out = [(int(where[p[0]]), block, planes([(spread[q], 5), (cls[q], 8), (size[q], 4)])) for p in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where)) + 1) for q in (order[p],)]
    return table(out, ONE)


def centres(rows: pa.Table, tile: int) -> pa.Table:
    """For each list of a bucket with several classes: tells the members' blocks (class, centre, tiles)."""
    gram, cls, size, block = [], [], [], []
    for b, payload in zip(rows.column("block").to_pylist(), rows.column("payload").to_pylist(), strict=True):
        g, c, s = unplanes(payload, [5, 8, 4])
        gram.append(g)
        cls.append(c)
        size.append(s.astype(np.int64))
        block.append(np.full(len(g), b, np.int64))
    gram, cls, size, block = map(np.concatenate, (gram, cls, size, block))
    order = np.lexsort((block, cls, size, gram))
    gram, cls, size, block = gram[order], cls[order], size[order], block[order]
    one = np.r_[True, (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1]) | (size[1:] != size[:-1])]  # the first block of a class speaks for it
    gram, cls, size, block = gram[one], cls[one], size[one], block[one]
    cut = np.r_[True, (gram[1:] != gram[:-1]) | (100 * size[:-1] < PERCENT * size[1:])]
    group = np.cumsum(cut) - 1
    first = np.flatnonzero(cut)
    members = np.diff(np.r_[first, len(cls)])
    centre = np.minimum.reduceat(cls, first)
    many = np.flatnonzero(members[group] > 1)
    tiles = -(-members // tile)
    told = np.unique(np.stack([block[many].astype(np.uint64), cls[many], centre[group[many]], tiles[group[many]].astype(np.uint64)]), axis=1) if len(many) else np.zeros((4, 0), np.uint64)
    out = []
    for p in np.split(np.arange(told.shape[1]), np.flatnonzero(np.diff(told[0].astype(np.int64))) + 1) if told.shape[1] else []:
        out.append((int(told[0, p[0]]), planes([(told[1, p], 8), (told[2, p], 8), (told[3, p], 4)])))
    return table(out, ASK)


def told(answers: pa.Table, widths: list[int]) -> list[tuple[int, ...]]:
    parts = [np.stack(unplanes(p, widths)) for p in answers.column("payload").to_pylist()]
    return sorted(set(zip(*np.concatenate(parts, axis=1).tolist(), strict=True))) if parts else []


def width_of(n: int) -> int:
    """Bits of the bitmap of n elements: the power of two from 4n up, 64 at least."""
    return max(64, 1 << (4 * n - 1).bit_length())


def bitmap(elements: np.ndarray) -> np.ndarray:
    width = width_of(len(elements))
    at = (mix(elements) & np.uint64(width - 1)).astype(np.int64)
    flags = np.zeros(width, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def send_sketches(rows: pa.Table, asked: pa.Table, hot: np.ndarray, buckets: int) -> pa.Table:
    """The bitmaps of a block's asked sets, to their centres."""
    wanted = told(asked, [8, 8, 4])
    if not wanted or not rows.num_rows:
        return table([], TWO)
    sets = Sets(rows, hot).sets
    block = rows.column(BLOCK)[0].as_py()
    maps: dict[int, bytes] = {}
    sent: dict[int, list[tuple[int, int, int, bytes]]] = defaultdict(list)
    for c, centre, tiles in wanted:
        if c not in maps:
            maps[c] = bitmap(sets[c]).tobytes()
        own = c % tiles
        for other in range(tiles):
            i, j = sorted((own, other))
            key = int(mix(np.array([centre + (tiles << 40) + (i << 20) + j & (1 << 64) - 1], np.uint64))[0])
            sent[key % buckets].append((key, c, len(sets[c]), maps[c]))
    return message(sent, block)


def message(sent: dict[int, list[tuple[int, int, int, bytes]]], block: int) -> pa.Table:
    out = []
    for to, items in sent.items():
        keys, cls, n, data = zip(*items, strict=True)
        out.append((to, block, planes([(np.array(keys, np.uint64), 8), (np.array(cls, np.uint64), 8), (np.array(n, np.uint64), 4)]), b"".join(data)))
    return table(out, TWO)


def near(rows: pa.Table) -> pa.Table:
    """Tells the blocks which sets may link to another at their centre: (class, key of the centre)."""
    groups: dict[int, dict[int, tuple[int, np.ndarray, int]]] = defaultdict(dict)
    for block, keys, data in zip(rows.column("block").to_pylist(), rows.column("keys").to_pylist(), rows.column("sets").to_pylist(), strict=True):
        at = 0
        for k, c, n in zip(*(x.tolist() for x in unplanes(keys, [8, 8, 4])), strict=True):
            size = width_of(n) // 8
            groups[k][c] = (n, np.frombuffer(data, "<u8", size // 8, at), block)
            at += size
    told: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for key, members in groups.items():
        names = sorted(members, key=lambda c: members[c][0])
        n = np.array([members[c][0] for c in names], np.int64)
        widths = np.array([width_of(int(x)) for x in n], np.int64)
        far = np.searchsorted(100 * n, PERCENT * n)  # the first that is large enough for each
        hit = np.zeros(len(names), bool)
        for w in np.unique(widths):  # compared at half the larger one's width, or 64 bits
            half = max(64, int(w) // 2)
            lo, hi = np.searchsorted(widths, half), np.searchsorted(widths, w, "right")
            folded = np.stack([np.bitwise_or.reduce(members[c][1].reshape(-1, half // 64), axis=0) for c in names[lo:hi]])
            for i in range(max(lo, int(np.searchsorted(widths, w))), hi):
                a = max(lo, int(far[i]))
                if a < i:
                    apart = np.bitwise_count(folded[a - lo : i - lo] ^ folded[i - lo]).sum(axis=1)
                    both = n[a:i] + n[i]
                    can = apart <= both - 2 * -(-both * PERCENT // (100 + PERCENT))
                    if can.any():
                        hit[i] = True
                        hit[a:i] |= can
        for i in np.flatnonzero(hit):
            told[members[names[i]][2]].append((names[i], key))
    return table([(b, planes([(np.array(x, np.uint64), 8) for x in zip(*items, strict=True)])) for b, items in told.items()], ASK)


def send_sets(rows: pa.Table, asked: pa.Table, hot: np.ndarray, buckets: int) -> pa.Table:
    """The sets of a block that may link, to their centres."""
    wanted = told(asked, [8, 8])
    if not wanted or not rows.num_rows:
        return table([], TWO)
    sets = Sets(rows, hot).sets
    sent: dict[int, list[tuple[int, int, int, bytes]]] = defaultdict(list)
    for c, key in wanted:
        sent[key % buckets].append((key, c, len(sets[c]), sets[c].astype("<u8").tobytes()))
    return message(sent, rows.column(BLOCK)[0].as_py())


def t_occurrence(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sorted sets."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    flat = np.concatenate([sets[i] for i in order])
    token = np.unique(flat, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(order)), sizes)
    by_token = np.argsort(token, kind="stable")
    edges = np.r_[0, np.cumsum(np.bincount(token))]
    posting = owner[by_token]  # each token's list, members in order of size
    first = np.cumsum(sizes) - sizes
    mine = [np.sort(token[a : a + n]) for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
    root = list(range(len(order)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    named = token[by_token] * len(order) + posting  # all lists after another, sorted: one binary search probes any of them
    for x in range(1, len(order)):
        tokens, n = mine[x], int(sizes[x])
        least = needed(n)
        rank = np.argsort(edges[tokens + 1] - edges[tokens], kind="stable")
        short, long = tokens[rank[: n - least + 1]], tokens[rank[n - least + 1 :]]
        heads = [posting[edges[t] : np.searchsorted(named, t * len(order) + x)].tolist() for t in short.tolist()]
        for y, again in groupby(heapq.merge(*[h for h in heads if h])):
            overlap = sum(1 for _ in again)
            m = int(sizes[y])
            if 100 * m < PERCENT * n or find(x) == find(y):
                continue
            wanted = long * len(order) + y
            at = np.minimum(np.searchsorted(named, wanted), len(named) - 1)
            overlap += int(np.count_nonzero(named[at] == wanted))
            if 100 * overlap >= PERCENT * (n + m - overlap):
                root[find(x)] = find(y)
                out.append((order[x], order[y]))
    return out


def link(rows: pa.Table) -> pa.Table:
    groups: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    for keys, data in zip(rows.column("keys").to_pylist(), rows.column("sets").to_pylist(), strict=True):
        key, cls, n = unplanes(keys, [8, 8, 4])
        flat = np.frombuffer(data, "<u8")
        edges = np.r_[0, np.cumsum(n.astype(np.int64))].tolist()
        for i, (k, c) in enumerate(zip(key.tolist(), cls.tolist(), strict=True)):
            groups[k][c] = flat[edges[i] : edges[i + 1]]
    a, b = [], []
    done: set[tuple[int, ...]] = set()
    for members in groups.values():
        if len(members) < 2:
            continue
        names = sorted(members)
        if (same := tuple(names)) in done:
            continue
        done.add(same)
        for x, y in t_occurrence([members[c] for c in names]):
            a.append(names[x])
            b.append(names[y])
    return pa.Table.from_arrays([pa.array(signed(np.array(v, np.uint64))) for v in (a, b)], schema=LINK)


def components(links: DataFrame, at: str) -> DataFrame:
    """(v, label): label is the least class of the component, by alternating star steps."""
    edges = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), f"{at}/edges-0")
    turn = 0
    while True:
        # Large star: neighbours above a vertex go to its least neighbour; small star: those below.
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("least"), F.count("*").alias("times"))
        found = hot_join(both, least, "v", "u").select("u", "v", F.least("v", "least").alias("m"))
        large = found.where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        below = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("times"))
        found = hot_join(large, below, "v", "u")
        small = found.select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        turn += 1
        after = materialize(small.select("e.v", "e.u").where("u <> v").distinct(), f"{at}/edges-{turn}")
        total = F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        if after.agg(F.count("*"), total).first() == edges.agg(F.count("*"), total).first():
            return after.select("v", F.col("u").alias("label"))
        edges = after


def text_sig() -> Column:
    """Tells apart the texts of rows that share a doc_id, or have none."""
    return F.xxhash64(F.col("text").cast("string"))


def labelled(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot_limit: int = HOT, tile: int = TILE) -> DataFrame:
    """doc_id, sig, n and, where n > 0, the component's smallest doc_id, the class's, and the component's first row."""
    at = shared_dir(docs.sparkSession)
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialize(rows.withColumn("sig", text_sig()).mapInArrow(scan, ddl(SCAN)), f"{at}/scan")
    frequent = seen.where("times IS NOT NULL").groupBy("gram").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "gram").limit(hot_limit)
    hot = np.sort(np.array([r["gram"] for r in frequent.collect()], np.int64).view(np.uint64))  # hot_limit numbers at most
    deal = Deal(rows, block_bytes)
    n = deal.n
    lists = deal.send(lambda t: send_lists(t, hot, n), ONE)
    asked = deal.answer(lists, lambda t: centres(t, tile), ASK)
    sketches = deal.told(asked, lambda t, a: send_sketches(t, a, hot, n), ddl(TWO))
    close = deal.answer(sketches, near, ASK)
    sets = deal.told(close, lambda t, a: send_sets(t, a, hot, n), ddl(TWO))
    links = materialize(deal.answer(sets, link, LINK), f"{at}/links")
    labels = components(links, at)

    found = seen.where("cls IS NOT NULL").select("doc_id", "sig", "n", "cls")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sig")
    least = found.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(own).alias("own_first"), F.count("*").alias("of_class"))
    grouped = least.join(labels, F.col("cls") == F.col("v"), "left").select("cls", F.coalesce("label", "cls").alias("label"), "least", "own_first", "of_class")
    names = grouped.groupBy("label").agg(F.min("least").alias("component"), F.min("own_first").alias("first"), F.count("*").alias("times"))
    of_class = materialize(hot_join(grouped, names, "label", "cls").select("cls", "component", "least", "first", F.col("of_class").alias("times")), f"{at}/classes")
    joined = hot_join(found.where("n > 0"), of_class, "cls", "doc_id", "sig").select("doc_id", "sig", "n", "component", "least", "first")
    wordless = found.where("n = 0").select("doc_id", "sig", "n", *(F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in ("component", "least", "first")))
    return joined.unionByName(wordless)


def jaccard_components(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot_limit: int = HOT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set; its own where the set is empty)."""
    of = lambda name: F.when(F.col("n") > 0, F.col(name)).otherwise(F.col("doc_id"))
    return labelled(docs, block_bytes, hot_limit, tile).select("doc_id", F.col("n").alias("n_shingles"), of("component").alias("component_id"), of("least").alias("class_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id (null last), then by its text's hash; of equal rows any one."""
    at = shared_dir(docs.sparkSession)
    pairs = labelled(docs).where("n > 0").groupBy("doc_id", "sig").agg(F.count("*").alias("times"), F.min("first").alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sig") == F.col("first.sig"))
    told = pairs.select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), (~stays).alias("gone"), "times").where("gone OR times > 1")
    told = materialize(told, f"{at}/told")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_sig() == F.col("__sig"))
    left = docs.join(told.where("gone"), same, "left_anti")
    twice = told.where("NOT gone")
    if twice.isEmpty():
        return left
    one = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same, "left_anti").unionByName(one)
