"""Benchmark decontamination by a distributed positional inverted index.

Every window (10 consecutive words of a benchmark item; a shorter item is one window)
is searched from its rarest terms:

1. counts: how often each benchmark term occurs in the corpus;
2. index: postings (term, document, position) of the terms that are the rarest or second
   rarest of some window, written to the shared folder; a posting is that and no more;
3. search: the list of a window's rarest term, moved back by the term's offset, is
   intersected with the moved list of the second. With `slop` the two may be that many places
   apart (proximity matches);
4. exact phrases: the documents that hold a place found, and only these, are read again, and all
   words of the phrase are compared there.

No list is gathered anywhere: lists meet windows by a broadcast of the windows, whose rows and
bytes are checked (beyond the limits the joins are shuffled ones), and are intersected by document
and place, so frequent passages spread evenly. Only built-in functions run here.

Null or empty text has no words and no hits. A document is a (doc_id, text) pair: rows
that repeat one get the same result each. Null doc_ids are documents like others; a very long text is one row
for each posting, never one for a window of context. Items without words, null items and repeated items are
allowed; items without item_id are one item of the empty name. Ties between equally rare terms go to the earlier
one, which has no effect on results. Other columns are ignored (keep_clean keeps them, whatever their names but
__h, __d and __b). An empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, same_document, shared_dir

WINDOW = 10
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Words once A-Z are lower case; upper-case letters are let through here and lowered word by word.
#: Said by what a word holds: the engine matches a negated class ten times slower.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
#: Begins the mark after the last word of every document, so that the index tells the lengths too; a number from 0 to
#: ENDS - 1 follows, so that marks are no hot key where terms are joined by a shuffle.
END, ENDS = "!", 4096
KEY = ["doc_id", "h"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z only; the translation is slow, so plain ASCII takes the other way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def sized(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """Marked for broadcast if it has few rows and bytes; what it holds grows with the benchmark only."""
    n, held = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= (BROADCAST_ROWS if rows is None else rows) and (held or 0) <= (BROADCAST_BYTES if size is None else size) else df


def document_key(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, h, pos) of the given terms; pos counts from 1. Every row of docs has one posting of an END mark, after its last word."""
    text = F.coalesce("text", F.lit(""))
    mark = F.concat(F.lit(END), F.pmod(F.col("h"), F.lit(ENDS)).cast("string"))
    rows = document_key(docs).select(*KEY, F.concat(words(text), F.array(mark)).alias("words"))
    # The outer form, since the plain one adds a filter that would match the pattern twice.
    tokens = rows.select(*KEY, F.posexplode_outer("words").alias("p", "w")).select(*KEY, (F.col("p") + 1).alias("pos"), lowered(F.col("w")).alias("w"))
    found = tokens.join(terms, F.col("w") == F.col("term"), "left").where(F.col("term").isNotNull() | F.col("w").startswith(END))
    return found.select(F.col("w").alias("term"), *KEY, "pos")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    tokens = docs.select(F.explode_outer(words(F.col("text").cast("string"))).alias("w")).select(lowered(F.col("w")).alias("w"))
    return tokens.join(terms, F.col("w") == F.col("term")).groupBy("term").agg(F.count("*").alias("n"))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win, item_id, phrase): every window of every item; equal phrases share a number."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.transform(words(F.col("text").cast("string")), lowered).alias("words"))
    items = items.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    found = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(size)))).alias("phrase")).distinct()
    return found.select(F.sha2(F.concat_ws(" ", "phrase"), 256).alias("win"), "item_id", "phrase")


def rarest(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """For each phrase its two rarest terms and their offsets; phrases with a term that the corpus lacks go."""
    terms = phrases.select("win", "phrase", F.posexplode("phrase").alias("offset", "term"))
    known = terms.join(sized(counts), "term", "left").groupBy("win").agg(
        F.first("phrase").alias("phrase"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("order")
    )
    first, second = F.col("order")[0], F.try_element_at("order", F.lit(2))
    return known.where(first["n"] > 0).select(
        "win", "phrase", first["term"].alias("term1"), first["offset"].alias("offset1"), second["term"].alias("term2"), second["offset"].alias("offset2")
    )


def search(index: DataFrame, lists: DataFrame, slop: int = 0) -> DataFrame:
    """(win, doc_id, h, start): places where the lists of the two rarest terms meet, at most slop places apart."""
    one = sized(lists.select("win", "offset1", "term1", F.col("term2").isNull().alias("single")))
    two = sized(lists.where("term2 IS NOT NULL").select(F.col("win").alias("win2"), "offset2", "term2"))
    first = index.join(one, F.col("term") == F.col("term1")).select("win", *KEY, (F.col("pos") - F.col("offset1")).alias("start"), "single").where("start >= 1")
    second = index.join(two, F.col("term") == F.col("term2")).select("win2", F.col("doc_id").alias("doc2"), F.col("h").alias("h2"), (F.col("pos") - F.col("offset2")).alias("start2"))
    same = (F.col("win") == F.col("win2")) & (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("doc2"))
    near = F.col("start") == F.col("start2") if not slop else F.abs(F.col("start") - F.col("start2")) <= slop
    met = first.where("NOT single").join(second, same & near, "left_semi").unionByName(first.where("single"))
    return met.select("win", *KEY, "start").distinct()  # rows that repeat a document repeat its postings


def verified(docs: DataFrame, places: DataFrame, lists: DataFrame, at: str) -> DataFrame:
    """(win, doc_id, h, start, n, exact): places with the phrase's length and whether all its words stand there.

    What is looked for is written first, so that Spark knows its size and shuffles the documents only if it must.
    """
    wanted = places.join(sized(lists.select("win", "phrase")), "win").groupBy(*KEY).agg(F.collect_list(F.struct("win", "start", "phrase")).alias("places"))
    wanted = materialize(wanted, at)
    rows = document_key(docs).withColumnsRenamed({"doc_id": "__d", "h": "__h"})
    read = wanted.join(rows, (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__d"))).select(*KEY, "places", "text")
    read = read.select(*KEY, "places", F.explode(F.array(F.transform(words(F.col("text")), lowered))).alias("words"))  # a generator, lest the words be found anew for each place
    told = F.transform(
        "places", lambda p: F.struct(p["win"].alias("win"), p["start"].alias("start"), F.size(p["phrase"]).alias("n"), (F.slice("words", p["start"], F.size(p["phrase"])) == p["phrase"]).alias("exact"))
    )
    return read.select(*KEY, told.alias("told")).select(*KEY, F.explode("told").alias("p")).select("p.win", *KEY, "p.start", "p.n", "p.exact").distinct()


def find(docs: DataFrame, benchmark: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows of items, the index, matches); matches are exact phrases, with slop proximity matches as well."""
    at = shared_dir(docs.sparkSession)
    windows = materialize(item_windows(benchmark), f"{at}/windows")
    phrases = windows.dropDuplicates(["win"]).select("win", "phrase")
    terms = phrases.select(F.explode("phrase").alias("term")).distinct()
    counts = materialize(term_counts(docs, sized(terms)), f"{at}/counts")
    lists = materialize(rarest(phrases, counts), f"{at}/lists")
    wanted = lists.select(F.col("term1").alias("term")).unionByName(lists.select(F.col("term2").alias("term"))).where("term IS NOT NULL").distinct()
    index = materialize(postings(docs, sized(wanted)), f"{at}/postings")
    places = materialize(search(index, lists, slop), f"{at}/places")
    matches = verified(docs, places, lists, f"{at}/wanted")
    return windows, index, materialize(matches if slop else matches.where("exact"), f"{at}/matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows, index, matches = find(docs, benchmark)
    # Words inside occurrences: each adds what lies beyond all earlier ones.
    spans = matches.groupBy(*KEY, "start").agg(F.max("n").alias("n"))
    earlier = Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = spans.withColumn("reach", F.coalesce(F.max(end).over(earlier), F.lit(0)))
    hits = fresh.groupBy(*KEY).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reach"))).cast("long").alias("n_hit"))
    of_item = windows.select("win", "item_id")
    items = matches.select("win", *KEY).distinct().join(sized(of_item), "win").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = same_document(hits, items, KEY, "left")
    rows = index.where(F.col("term").startswith(END)).select(*KEY, (F.col("pos") - 1).cast("long").alias("n_words"))
    joined = same_document(rows, found, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    held = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", held), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with their columns."""
    _, _, matches = find(docs, benchmark)
    bad = matches.select(*KEY).distinct()
    rows = docs.withColumn("__h", F.xxhash64(F.col("text").cast("string")))
    bad = bad.withColumnsRenamed({"doc_id": "__d", "h": "__b"})
    return rows.join(bad, (F.col("__h") == F.col("__b")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left_anti").drop("__h")
