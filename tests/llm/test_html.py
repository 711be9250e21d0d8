"""HTML extraction against a plain reading of the same rules, and on awkward pages."""

import math
import random
import time
from collections import defaultdict
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tessera.llm import op8_html

SCHEMA = "page_id long, url string, html string, node long, `__host` long, low string"
OUTSIDE = {"nav", "footer", "aside", "form"}


class Plain(HTMLParser):
    """Blocks (chain of names, said, in article, text) and child sequences of well-formed pages with the elements used here."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.blocks, self.children = [("", False, set())], [], []
        self.kids, self.marked = [[]], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        name, article, said = self.stack[-1]
        kind = dict(attrs).get("class", "")
        said = said | ({"noise"} if tag in OUTSIDE or "sponsored" in kind else {"doubt"} if "notice" in kind else {"classed"} if kind else set())
        self.kids[-1].append(tag)
        self.marked |= tag == "article"
        self.stack.append((f"{name}/{tag}.{kind}", article or tag == "article", said))
        self.kids.append([])

    def handle_endtag(self, tag):
        self.children.append((self.stack.pop()[0], tuple(self.kids.pop())))

    def handle_data(self, data):
        if data.split():
            name, article, said = self.stack[-1]
            self.blocks.append((name, said, article, " ".join(data.split())))


def importances(pages):
    nodes = defaultdict(lambda: (defaultdict(set), defaultdict(set)))
    for host, page in pages:
        read = Plain(page)
        for name, _, _, text in read.blocks:
            nodes[host, name][0][text].add(page)
        for name, kids in read.children:
            if any(b[0] == name for b in read.blocks):
                nodes[host, name][1][kids].add(page)
    out = {}
    for key, (texts, kids) in nodes.items():
        m = len(set().union(*texts.values()))
        if m == 1:
            out[key] = 1.0
            continue
        total = sum(map(len, texts.values()))
        content = 1 - sum(len(p) * math.log(len(p), m) for p in texts.values()) / total
        shown = sum(map(len, kids.values()))
        shape = -sum(len(p) / shown * math.log(len(p) / shown, m) for p in kids.values())
        g = 0.9 ** len(kids)
        plain = (1 - g) * shape + g * content
        out[key] = (plain * math.log2(m) + 0.5) / (math.log2(m) + 0.5)
    return out


def site(rng, host, pages):
    menu = ["Home", "News", "About us", "Contact"]
    for i in range(pages):
        words = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n))
        parts = ["<div>" + "".join(f"<div class=x{host}>{w}</div>" for w in menu[: rng.randint(2, 4)]) + "</div>"]
        body = "".join(f"<p>{words(9)}</p>" for _ in range(rng.randint(1, 4)))
        body += f"<div class=tail>{'Read more here' if rng.random() < 0.95 else words(4)}</div>"
        body += rng.choice(("", f"<div class=notice>{words(3)}</div>", "<div class=notice>same notice</div>", f"<div class=sponsored>{words(3)}</div>"))
        parts.append(f"<article><h1>{words(3)}</h1>{body}</article>" if host % 2 else f"<div class=c><h2>{words(3)}</h2>{body}</div>")
        parts.append(f"<footer>{words(5)}</footer>")
        yield f"<html><body>{''.join(parts)}</body></html>"


def test_against_a_plain_reading(spark):
    rng = random.Random(11)
    rows = [(f"h{h}", page) for h, n in enumerate((40, 30, 9, 7, 3, 1)) for page in site(rng, h, n)]
    rows += [rows[0]] * 5 + [rows[45]] * 20  # whole copies count once in the tree
    known, want = importances(rows), []
    for i, (host, page) in enumerate(rows):
        read, kept = Plain(page), []
        for name, said, article, text in read.blocks:
            if "noise" in said or read.marked and not article:
                continue
            weight = 0.6 if "doubt" in said else 1.0
            if article and not said or weight * known[host, name] >= 0.2:
                kept.append(text)
        want.append((i, "\n".join(kept), len("\n".join(kept))))
    pages = spark.createDataFrame([(i, f"https://u:p@{h.upper()}:80/{i}", p, 1, 2, "x") for i, (h, p) in enumerate(rows)], SCHEMA).repartition(4)
    got = op8_html.extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()) == want
    tree = op8_html.style_tree(op8_html.with_hosts(pages)).collect()
    assert sorted(round(r["importance"], 9) for r in tree) == sorted(round(v, 9) for v in known.values())
    # Menus without telling names went by the tree alone, and so did the tail inside articles.
    assert not [t for _, t, _ in want[:70] if "Home" in t] and sum("Read more here" in t for _, t, _ in want[:70]) == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", p, 1, 2, "x") for i, p in enumerate(site(rng, 2, 30))], SCHEMA)
    want = sorted(map(tuple, op8_html.extract_main_text(pages).collect()))
    monkeypatch.setattr(op8_html, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, op8_html.extract_main_text(pages).collect())) == want


def test_empty_table_nulls_and_repeats(spark):
    assert op8_html.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, 1, 1, "x"), (1, None, "", 1, 1, "x"), (2, "no url", "plain &amp; text", 1, 1, None), (2, "no url", "plain &amp; text", 1, 1, None)]
    got = sorted(map(repr, map(tuple, op8_html.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(map(repr, [(None, None, "", 0), (1, None, "", 0), (2, "no url", "plain & text", 12), (2, "no url", "plain & text", 12)]))


def texts(page):
    return [t for _, _, t in op8_html.Page(page).judged()]


def test_broken_markup():
    assert texts("a < b<p>c<!-- never closed") == ["a < b", "c"]
    assert texts("<p title='x>y'>one<p>two</div></b></p>three") == ["one", "two", "three"]
    assert texts('<p title="never closed>one</p>two') == ["one", "two"]
    assert texts("<article><p>it's <button>Go</button>5 o'clock<span class=ad>buy <span>now</span> !</span> sharp</article>x") == ["it's 5 o'clock sharp"]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]


def test_deep_and_long_pages_take_linear_time():
    began = time.time()
    for page in ("<div>x" * 100_000, "<blockquote><p>x" * 50_000 + "</b>" * 50_000, "<li><span class=ad>" * 50_000 + '<a href="x' * 50_000, "<p>" + "word " * 1_000_000):
        op8_html.Page(page)
    assert time.time() - began < 60
    assert len(texts("<div>x" * 100_000)) == 100_000


def test_copies_of_one_article_stay(spark):
    page = "<html><body><div class=m>menu</div><article><h1>Head</h1><p>text</p></article></body></html>"
    rows = [(i, f"http://a.b/{i}", page.replace("menu", f"menu {i}"), 0, 0, "") for i in range(40)]
    got = op8_html.extract_main_text(spark.createDataFrame(rows, SCHEMA))
    assert got.select("text").distinct().collect() == [("Head\ntext",)]
    assert got.where(F.col("n_chars") != F.length("text")).count() == 0
