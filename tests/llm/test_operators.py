"""The operators against brute force: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tessera.llm import blocks, hashing, op1_bpe, op2_substrings, op3_quality, op4_decontaminate, op5_jaccard, op6_counts, op7_sharding, op8_html, op9_parsing, op10_records

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, block int, h long, source string"


def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdéfg") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = [rng.choice(vocab) for _ in range(70)]
    texts = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 260))]
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        texts.append(" ".join(words) + (".\n" if i % 3 else "!"))
    texts += [texts[3]] * 5 + [texts[4].upper(), texts[8] + " tail", " ".join(passage * 3), "ab " * 120, "x" * 5000, "", None, " \t\n", "one two", "a <|endoftext|> b It's 42 ΣΑΣ"]
    for k in range(12):  # near copies
        words = texts[12].split()
        words[k] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t, i % 3, i, "s") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[6], 1, 1, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted(map(repr, map(tuple, df.select(*(columns or ("*",))).collect())))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_bpe(docs, empty):
    t = tokenizers.Tokenizer.from_file(WORD)
    want = []
    for d, x, *_ in corpus():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert rows_of(op1_bpe.bpe_encode_decode(docs, WORD), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(map(repr, want))
    assert op1_bpe.bpe_encode_decode(empty, WORD, with_texts=True).count() == 0


def test_bpe_random_words():
    from tessera.llm.bpe import load

    rng = random.Random(3)
    for path in (WORD, BYTE):
        own, lib = load(path), tokenizers.Tokenizer.from_file(path)
        for _ in range(400):
            x = "".join(rng.choice("abct eings'<>/w1é€😀\n") for _ in range(rng.choice((3, 9, 70))))
            assert [i for w in own.merges.encode_words(own.pretokens(x)) for i in w] == lib.encode(x, add_special_tokens=False).ids


def test_token_counts(docs, empty):
    t = tokenizers.Tokenizer.from_file(BYTE)
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x, *_ in corpus()]
    assert rows_of(op6_counts.token_counts(docs, BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(map(repr, want))
    assert op6_counts.token_counts(empty, BYTE).count() == 0


def test_records(docs, empty):
    t = tokenizers.Tokenizer.from_file(BYTE)
    start, want = 0, []
    for d, x, *_ in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(op10_records.token_records(docs, BYTE), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(map(repr, want))
    assert op10_records.token_records(empty, BYTE).count() == 0


def test_records_of_long_white_space():
    """Runs of over a million spaces or mixed white space: before a word, before a special string, at the end, at a cut's edge."""
    t = tokenizers.Tokenizer.from_file(BYTE)
    n, mixed = 1_200_000, " \n\t\u2003\xa0" * 240_001
    texts = ["a" + " " * n + "b c", "\n" * n, "x" + mixed, mixed + "'s 12", " " * n + "<|endoftext|>" + "\n" * n + "!"]
    texts += [" " * k + "b" for k in (99_999, 100_000, 100_001)]
    for x in texts:
        assert op10_records.encode(BYTE, x, 2).tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]


def test_damaged_record_is_found():
    frame = op10_records.frames([b"payload"])[0]
    assert op10_records.unframe([frame]) == [b"payload"]
    with pytest.raises(ValueError):
        op10_records.unframe([frame[:14] + b"X" + frame[15:]])


def test_crc32c_known_values():
    from tessera.llm.crc import crc32c

    assert crc32c([b"123456789", b"", b"a", b"\0" * 32]).tolist() == [0xE3069283, 0, 0xC1D04330, 0x8A9136AA]


def test_quality(docs, empty):
    want = []
    for d, x, *_ in corpus():
        w = (x or "").encode().split()
        five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want.append((d, len(w), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    assert rows_of(op3_quality.quality_rules(docs), "doc_id", "n_words", "n_repeat_words", "base_failed") == sorted(map(repr, want))
    assert op3_quality.keep_good(empty).columns == empty.columns and op3_quality.keep_good(empty).count() == 0
    assert op3_quality.keep_good(docs).count() == op3_quality.quality_rules(docs).where("kept").count()


def test_longest_repeats():
    rng = random.Random(5)
    for _ in range(60):
        w = [rng.randint(0, 3) for _ in range(rng.randint(1, 40))]
        want = [max((k for k in range(1, len(w) - i + 1) if any(w[j : j + k] == w[i : i + k] for j in range(len(w) - k + 1) if j != i)), default=0) for i in range(len(w))]
        assert op3_quality.longest_repeats(np.array(w), np.zeros(len(w), np.int64)).tolist() == want


def windows(rows, n):
    seen = defaultdict(list)
    for at, (d, units) in enumerate(rows):
        for i in range(len(units) - n + 1):
            seen[tuple(units[i : i + n])].append(d if d is not None else 1 << 62)
    return seen


@pytest.mark.parametrize(("limit", "longer_by"), [(200_000, 16), (1, 1_000_000), (0, 1)])  # prefixes of 8, 16 and 35 words
def test_substrings(docs, empty, limit, longer_by):
    rows = [(d, (x or "").encode().split()) for d, x, *_ in corpus()]
    seen, want = windows(rows, 35), []
    for d, w in rows:
        gone = {j for i in range(len(w) - 34) if len(seen[tuple(w[i : i + 35])]) > 1 for j in range(i, i + 35)}
        want.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = op2_substrings.substring_dedup(docs, block_bytes=2_000, group_limit=limit, longer_by=longer_by)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(repr, want))
    assert op2_substrings.substring_dedup(empty).count() == 0


def test_inner_nodes():
    rng = np.random.default_rng(3)
    strings = [tuple(x) for x in rng.integers(0, 3, (300, 5)).tolist()]
    order, common, nodes = op2_substrings.inner_nodes([np.array(x, np.uint64) for x in zip(*strings, strict=True)])
    ordered = [strings[i] for i in order]
    assert ordered == sorted(strings)
    shared = [next((k for k in range(5) if a[k] != b[k]), 5) for a, b in zip(ordered, ordered[1:])]
    assert common.tolist() == shared
    want = {}
    for k in range(1, 6):
        for head in {x[:k] for x in strings}:
            at = [i for i, x in enumerate(ordered) if x[:k] == head]
            if len(at) > 1:
                want[at[0], at[-1] + 1] = k  # the deepest of equal intervals stays
    assert {(lo, hi): k for k, lo, hi in nodes} == want and len(nodes) == len(want)


@pytest.mark.parametrize("limit", [20_000, 0])  # 0: strings whose trigger has several phrases travel one by one
def test_parsing(docs, empty, limit):
    rows = [(d, (x or "").encode()) for d, x, *_ in corpus()]
    seen, want = windows(rows, 50), []
    for d, b in rows:
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if min(seen[tuple(b[i : i + 50])]) < (d if d is not None else 1 << 62):
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    got = op9_parsing.suffix_dedup(docs, block_bytes=2_000, group_limit=limit)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(map(repr, want))
    left = op9_parsing.remove_repeats(docs, block_bytes=2_000)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert op9_parsing.remove_repeats(empty).count() == 0


def test_corpus_order():
    """Strings of a parse have equal numbers if and only if their bytes are equal; every string is in one phrase."""
    rng = random.Random(9)
    for letters, size in (("ab", 900), ("a", 300), ("abcdefgh", 4000)):
        text = "".join(rng.choice(letters) for _ in range(size))
        text = (text + text[100:260] + "#" + text[:150] * 2).encode()
        p = op9_parsing.Phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert sorted(i for a, b in zip(p.start, p.last) for i in range(a, b + 1)) == list(range(len(text) - 49))
        for a, b, t in zip(p.start.tolist(), p.last.tolist(), p.trigger.tolist()):
            for i in range(a, b + 1):
                assert i <= t <= i + 32
        pieces = [text[a : b + 50] for a, b in zip(p.start, p.last)]
        first = np.r_[0, np.cumsum([len(x) for x in pieces])]
        phrase, string, number = op9_parsing.corpus_order(np.frombuffer(b"".join(pieces), np.uint8), first, p.last - p.start + 1, p.trigger - p.start)
        strings = [pieces[i][j : j + 50] for i, j in zip(phrase, string)]
        assert len(strings) == len(text) - 49
        assert len(set(zip(strings, number.tolist()))) == len(set(strings)) == len(set(number.tolist()))


def test_sorted_sides():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 32))).encode() for _ in range(400)] + [b"a\0", b"a", b"a"]
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(x) for x in strings])
    order, common = op9_parsing.in_order(op9_parsing.numbers(data, np.cumsum(size) - size, size, 32), size)
    ordered = [strings[i] for i in order]
    assert ordered == sorted(strings)
    assert common.tolist() == [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(ordered, ordered[1:])]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_made_to_defeat_polynomial_hashes(spark):
    """A Thue-Morse word and its complement have equal values under any polynomial modulo a power of two."""
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    schema = "doc_id long, text string"
    got = op5_jaccard.jaccard_components(spark.createDataFrame([(1, x), (2, y), (3, " ".join([x] * 3)), (4, " ".join([y] * 3))], schema))
    assert rows_of(got, "doc_id", "component_id") == sorted(repr((d, d)) for d in (1, 2, 3, 4))
    head = " ".join(f"w{i}" for i in range(34))
    got = op2_substrings.substring_dedup(spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}")], schema), block_bytes=1_000)
    assert rows_of(got, "doc_id", "n_removed") == sorted(repr((d, 0)) for d in (1, 2))
    words = [" ".join(w) for w in (thue_morse(64, "a", "b"), thue_morse(64, "b", "a"))]
    got = op2_substrings.substring_dedup(spark.createDataFrame(list(enumerate(words)), schema), block_bytes=50)
    same = {tuple(w.split()[i : i + 35]) for w in words[:1] for i in range(30)} & {tuple(w.split()[i : i + 35]) for w in words[1:] for i in range(30)}
    assert not same and rows_of(got, "n_removed") == ["(0,)", "(0,)"]
    got = op9_parsing.suffix_dedup(spark.createDataFrame([(1, x[:64]), (2, y[:64])], schema), block_bytes=50)
    first, second = ({w[i : i + 50] for i in range(15)} for w in (x[:64], y[:64]))
    assert not first & second and rows_of(got, "n_removed") == ["(0,)", "(0,)"]


def test_positions_beyond_their_bits():
    rng = np.random.default_rng(2)
    for top in (2, 1 << 40):  # many ties, none
        grams = rng.integers(0, top, 900).astype(np.uint64) << np.uint64(8)
        want = [i + int(np.argmin(grams[i : i + 28])) for i in range(len(grams) - 27)]
        assert hashing.first_least(grams, 28, 8).tolist() == want == hashing.first_least(grams, 28, 5).tolist()
    assert hashing.first_least(grams[:20], 28, 8).tolist() == []


def test_passage_beyond_the_bits_of_a_place():
    """A passage past byte 2**24 of one text has the triggers and phrases of its copy in a short one."""
    passage = np.random.default_rng(4).integers(0, 256, 200).astype(np.uint8)
    far = np.concatenate([np.full((1 << 24) + 3, 7, np.uint8), passage])
    long, short = (op9_parsing.Phrases(v, np.array([0, len(v)])) for v in (far, passage))
    inner = slice(1, -1)  # phrases that lie inside the passage
    assert len(short.group) > 5 and set(short.group.tolist()) <= set(long.group.tolist())
    assert set(short.content[inner].tolist()) <= set(long.content.tolist())
    assert int(long.trigger.max()) > 1 << 24


def test_names_in_buckets():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64))
    for n in (1, 2, 3, 7, 64, 1000):
        where = blocks.bucket_of(h, n)
        name = blocks.name_in_bucket(h, where, n)
        assert where.min() >= 0 and where.max() < n and int(name.max()) < 1 << 32
        for _, part in blocks.cut(where):
            assert (np.diff(name[part].astype(np.int64)) >= 0).all()


def test_jaccard(docs, empty):
    rows = corpus()
    sets = []
    for _, x, *_ in rows:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    want = [(d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d) for i, (d, *_) in enumerate(rows)]
    got = op5_jaccard.jaccard_components(docs, block_bytes=2_000)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(map(repr, want))
    assert op5_jaccard.jaccard_components(empty).count() == 0


def test_jaccard_wordless_slices(spark):
    """Slices without a shingle: a block of wordless texts, and wordless texts before one longer than a slice."""
    schema = "doc_id long, text string"
    wordless = [(1, ""), (2, None), (3, " \t\n")]
    got = op5_jaccard.jaccard_components(spark.createDataFrame(wordless, schema))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(repr((d, 0, d)) for d, _ in wordless)
    long = " ".join(f"w{i}" for i in range(80_000))
    assert len(long) > op5_jaccard.SLICE
    got = op5_jaccard.jaccard_components(spark.createDataFrame([*wordless, (4, long), (5, long + " end")], schema))
    want = [*((d, 0, d) for d, _ in wordless), (4, 79_996, 4), (5, 79_997, 4)]
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(map(repr, want))


def test_keep_first_row_by_row(spark):
    """One row of each component stays, whatever ids its rows share or lack; rows of other components are left alone."""
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    schema = "doc_id long, text string, source string"
    rows = [
        (1, words("a"), "s"), (1, words("a"), "s"), (1, words("a") + " z", "s"),  # a repeated row and a near copy under one id
        (None, words("b"), "s"), (None, words("b"), "s"), (None, words("b") + " z", "s"),  # all ids null
        (2, words("c"), "s"), (None, words("c"), "s"), (None, words("d"), "s"),  # a null id copies 2; another is unique
        (3, words("e"), "s"), (4, words("e"), "s"), (4, words("f"), "s"),  # one of two rows with id 4 copies 3
        (5, "", "s"), (5, "", "s"), (None, None, "s"), (None, None, "s"),  # wordless rows link with nothing
    ]
    got = op5_jaccard.keep_first(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["doc_id", "text", "source"]
    kept = Counter((r["doc_id"], (r["text"] or "")[:1]) for r in got.collect())
    assert kept == {(1, "a"): 1, (None, "b"): 1, (2, "c"): 1, (None, "d"): 1, (3, "e"): 1, (4, "f"): 1, (5, ""): 2, (None, ""): 2}


def test_jaccard_tiles(docs):
    whole = rows_of(op5_jaccard.jaccard_components(docs, block_bytes=2_000), "doc_id", "component_id")
    assert rows_of(op5_jaccard.jaccard_components(docs, block_bytes=2_000, hot_limit=0, tile=3), "doc_id", "component_id") == whole


def test_t_occurrence():
    rng = random.Random(4)
    base = rng.sample(range(10_000), 60)
    sets = [np.array(sorted({*rng.sample(base, rng.randint(50, 60)), *rng.sample(range(10_000, 10_020), rng.randint(0, 6))}), np.uint64) for _ in range(50)]
    links = [(i, j) for i in range(50) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def groups(pairs):
        root = list(range(50))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in pairs:
            root[find(i)] = find(j)
        return {frozenset(k for k in range(50) if find(k) == find(i)) for i in range(50)}

    found = op5_jaccard.t_occurrence(sets)
    assert set(map(lambda p: tuple(sorted(p, reverse=True)), found)) <= set(links) and groups(found) == groups(links)


def test_hot_join(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(k, k) for k in range(2, 40)], "k long, x long").repartition(3)
    right = left.groupBy("k").agg(F.count("*").alias("times"), F.max("x").alias("top"))
    got = common.hot_join(left, right, "k", "x")
    assert got.columns == ["k", "x", "top"]
    assert rows_of(got) == rows_of(left.join(right.drop("times"), "k"))


def test_decontaminate(spark, docs, empty):
    rows = corpus()
    items = [(1, " ".join(rows[0][1].split()[5:40])), (2, "one two"), (3, None), (4, "absentterm " * 12), (10, rows[12][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    import re

    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(low))
    by = defaultdict(set)
    for i, x in items:
        w = words(x)
        for k in range(max(1, len(w) - 9) if w else 0):
            by[tuple(w[k : k + 10])].add(i)
    want = []
    for d, x, *_ in rows:
        w, hit, found = words(x), set(), set()
        for n in set(map(len, by)):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in by:
                    hit |= set(range(k, k + n))
                    found |= by[tuple(w[k : k + n])]
        want.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    got = op4_decontaminate.decontaminate(docs, bench)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(map(repr, want))
    assert op4_decontaminate.keep_clean(docs, bench).count() == sum(not r[-1] for r in want)
    assert op4_decontaminate.decontaminate(empty, bench).count() == 0
    assert not [n for n in ("Python", "Arrow", "Pandas") if n in got._jdf.queryExecution().toString()]
    none = op4_decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(rows) and none.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def test_decontaminate_shuffled_and_nameless(spark, docs, monkeypatch):
    """The joins beyond the broadcast's limits give the same rows; an item without item_id counts."""
    items = spark.createDataFrame([(1, corpus()[0][1]), (None, corpus()[12][1])], "item_id long, text string")
    want = rows_of(op4_decontaminate.decontaminate(docs, items))
    assert any("(0, " in r and "True" in r for r in want)
    monkeypatch.setattr(op4_decontaminate, "BROADCAST_BYTES", 0)
    assert rows_of(op4_decontaminate.decontaminate(docs, items)) == want
    hit = op4_decontaminate.decontaminate(docs, items).where("doc_id = 12").first()
    assert hit["n_items"] == 2 and hit["items_sha256"] == sha(",1")


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = item.replace("gamma", "gamma inserted")
    far = item.replace("gamma", "gamma one two three four five six")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, near), (3, far), (4, "alpha kappa " * 3), (5, "beta " * 60 + "gamma " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha " + item[6:])], "item_id long, text string")
    filler = [(10 + i, f"{w} " * 9) for i, w in enumerate(item.split()) if w not in ("beta", "theta")]  # beta and theta are the rarest
    docs = docs.where("doc_id <> 5").unionByName(spark.createDataFrame(filler, docs.schema))
    found = lambda slop: sorted((r["doc_id"], r["start"], r["exact"]) for r in op4_decontaminate.find(docs, bench, slop)[2].collect())
    assert found(0) == [(1, 2, True)]
    assert found(1) == [(1, 2, True), (2, 1, False)]
    assert found(6) == [(1, 2, True), (2, 1, False), (3, 1, False)]


def test_sharding(docs, empty):
    got = op7_sharding.assign_shards(docs, 8)
    rows = got.collect()
    n = Counter(r["shard"] for r in rows)
    assert len(rows) == len(corpus()) and max(n.values()) - min(n.values()) <= 1
    for s, k in n.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k))
    assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32((x or "").encode()) for _, x, *_ in corpus())
    assert op7_sharding.assign_shards(empty).count() == 0


def test_html(spark):
    page = (
        '<html><head><title>t</title></head><body><nav><a href="/x">menu</a></nav><header>site</header><div class="cookie-notice">we use</div>'
        "<article><h1>Head &amp; line</h1><p>one <b>two</b><br>three<p>four &#x41;<aside>side</aside><form>f</form><script>var a='</p>'</script></article>"
        '<div id="comments">me too</div><footer>end</footer>'
    )
    rows = [(1, "http://a.b/1", page), (2, None, None), (3, "", ""), (3, "", "")]
    rows += [(10 + i, "http://c.d/x", f"<body><div>same on all</div><p>own text {i}</p></body>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in op8_html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Head & line\none two three\nfour A" and got[2] == got[3] == ""
    assert all(got[10 + i] == f"own text {i}" for i in range(8))  # a node that all pages repeat is unimportant
