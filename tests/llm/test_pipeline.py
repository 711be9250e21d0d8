"""The pipeline against brute force: what each stage leaves, and the rows of run()."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def repeated(w, n):
    """Starts of the windows of n words that are found twice or more."""
    seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return [i for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1]


def good(text):
    w = text.encode().split()
    n = len(w)
    spread = lambda k: len({j for i in repeated(w, k) for j in range(i, i + k)})
    if n < 10 or 100 * spread(5) > 20 * n or 100 * spread(10) > 15 * n:
        return False
    return not repeated(w, max(50, n // 10) + 1)  # a repeat of over 50 words and 10 %


def shingles(text):
    w = text.translate(LOW).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def firsts(docs):
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    sets = {d: shingles(t) for d, t in docs.items()}
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: t for d, t in docs.items() if find(d) == d}


def without_repeats(docs):
    first, left = {}, {}
    for d in sorted(docs):
        b = docs[d].encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in docs.items():
        b, gone = t.encode(), set()
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone.update(range(i, i + 50))
        left[d] = bytes(c for i, c in enumerate(b) if i not in gone)
    return left


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def clean(docs, items):
    phrases = set()
    for t in items:
        w = plain_words(t)
        phrases |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = set(map(len, phrases))

    def hit(w):
        return any(tuple(w[i : i + n]) in phrases for n in sizes for i in range(len(w) - n + 1))

    return {d: t for d, t in docs.items() if not hit(plain_words(t))}


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows, each over what the one before left."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    found.append(docs.cache())
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        found.append(docs)
    return found


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, stages):
    assert [name for name, _ in p.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_passages", "token_ids"]
    assert all(s.columns == stages[0].columns for s in stages)
    first, quality, near, cut, last = map(texts, stages)
    assert quality == {d: t for d, t in first.items() if good(t or "")}
    assert near == firsts(quality)
    want = without_repeats(near)
    assert {d: (t or "").encode() for d, t in cut.items()} == {d: b.decode("utf-8", "ignore").encode() for d, b in want.items()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert last == clean(cut, items)
    assert len(first) > len(quality) > len(near) > len(last) > 0 and near != cut  # every decision takes effect


def test_run(spark, stages):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, x in texts(stages[-1]).items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[d] = (len(ids), list(ids), *(hashlib.sha256(v.encode()).hexdigest() for v in (" ".join(map(str, ids)), decoded)))
    got = p.run(spark, SF).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["n_tokens"], list(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, block int, term string"


def awkward():
    """Nulls in every column, empty and long texts, repeated ids and rows, columns named as the operators name theirs."""
    words = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    texts = {1: words("a"), 2: words("a") + " z", 3: words("b"), 4: words("c") + " " + words("d"), 5: words("e") + " " + words("d"), 6: words("long", 30_000), 7: None, 8: "", 9: "few words"}
    rows = [(d, t, "en", "s", len(t or ""), d, 1, "t") for d, t in texts.items()]
    rows += [rows[2], rows[2], (3, words("f"), "en", "s", 1, 1, 1, "t"), (None, words("g"), None, None, None, None, None, None), (None, words("g"), None, None, None, None, None, None)]
    rows += [(None, words("b"), "en", "s", 1, 1, 1, "t"), (None, None, None, None, None, None, None, None), (20, words("item", 12), None, "s", None, 1, 1, None)]
    return rows


def test_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"ITEM{i}" for i in range(12))), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    left, rows = docs, []
    for _, stage in p.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == docs.columns
        rows.append(sorted(((r["doc_id"], (r["text"] or "")[:2]) for r in left.collect()), key=repr))
    quality, near, cut, clean = rows
    assert quality == sorted([(1, "a0"), (2, "a0"), (3, "b0"), (3, "b0"), (3, "b0"), (3, "f0"), (4, "c0"), (5, "e0"), (6, "lo"), (20, "it"), (None, "b0"), (None, "g0"), (None, "g0")], key=repr)
    assert near == sorted([(1, "a0"), (3, "b0"), (3, "f0"), (4, "c0"), (5, "e0"), (6, "lo"), (20, "it"), (None, "g0")], key=repr)
    assert cut == near and clean == [r for r in near if r != (20, "it")]
    kept = {r["doc_id"]: r for r in left.collect()}
    assert "d20" in kept[4]["text"] and "d20" not in kept[5]["text"] and kept[5]["n_chars"] == len(kept[5]["text"])
    last = p.token_ids(spark, left, str(tmp_path)).collect()
    assert len(last) == len(clean) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in last)


def test_stages_that_keep_empty_texts(spark, tmp_path):
    """Rows without words pass every stage but the quality rules as they are."""
    spark.createDataFrame([(1, "one item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, None, "en", None, 0, 1, 1, "t"), (1, "", "en", None, 0, 1, 1, "t"), (None, " ", None, None, 1, 1, 1, "t"), (None, None, None, None, None, None, None, None)], SCHEMA)
    for _, stage in p.STAGES[1:4]:
        got = stage(spark, docs, str(tmp_path))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))
    assert {r["n_tokens"] for r in p.token_ids(spark, docs, str(tmp_path)).collect()} == {0}
    assert p.quality_rules(spark, docs, str(tmp_path)).count() == 0


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.select("doc_id", "text").withColumnRenamed("doc_id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in p.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
