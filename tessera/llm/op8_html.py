"""HTML extraction by a site style tree.

Pages of one host are merged into a tree of style nodes. A node is an element under its
chain of ancestors, each known by tag and classes; the chain is hashed as the page is read. A node
has two kinds of evidence, each counted once for every different page (copies of a whole
page are one page):

* presentation: the sequences of child elements it shows. With m pages and p_s the share of
  those with sequence s, its importance is the entropy of p to base m: 0 if all pages look alike;
* content: the texts directly in it. The entropy of a text that n pages repeat, spread over these
  pages, is log n to base m; the importance is one minus the mean of that over the node's texts:
  0 if all pages say the same, 1 if no page repeats another.

A node's composite importance is (1 - G^l) * presentation + G^l * content with l the number of
its sequences, drawn towards 1 by PRIOR_BITS of evidence (log2 m bits speak against), so that a
node seen on few pages stays, with no number of pages at which the rule changes.

Marks are a prior that the importance is weighed with:

* elements and names HTML reserves for what is no content (menus, footers, forms, adverts,
  comments, scripts ...) weigh 0, and on a page that marks its article so does what lies outside it;
* ambiguous names (notice, share, legal ...) weigh AMBIGUOUS;
* plain elements without a class inside a marked article weigh 1 and are not judged: a host may hold
  copies of one article only;
* all other nodes, in or outside an article, weigh 1 and are judged by the tree.

A block goes if weight * importance is below MIN_IMPORTANCE.

The tree's rows (host, node, kind, value, page) are made distinct and counted with partial sums; a
host with a third of all pages is no hot group. What is joined back is the importance of nodes that may
fail, one row a host; it is broadcast if its measured size is small, else joined on salted keys.

Null or empty html gives empty text; null urls share one host; repeated rows give repeated rows and
count as one page in the tree; broken markup is read to its end, an unclosed comment, script or quote
takes the rest; very long and very deep pages take time in proportion to their length; other columns
of the pages, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, shared_dir, slices

#: Weighted importance that a block needs, base of the composite's weights, bits that speak for every node, weight of ambiguous names.
MIN_IMPORTANCE, GAMMA, PRIOR_BITS, AMBIGUOUS = 0.2, 0.9, 0.5, 0.6
BROADCAST_ROWS = 100_000
SALTS = 32

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open p; and elements that end an open one of the same kind.
ENDS_P = BLOCK - frozenset("body caption head html option tbody td tfoot th thead title tr".split())
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
IMPLIED = frozenset("p li dd dt tr td th option".split())
FENCE = frozenset("ul ol dl table article section main div body menu".split())
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select option textarea dialog menu head search audio video label input fieldset".split())
RESERVED_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr sidebar nav navbar navigation breadcrumb breadcrumbs masthead comment comments respond replies disqus newsletter pagination pager".split()
)
AMBIGUOUS_NAMES = frozenset(
    "banner promo promotion notice notices alert popup modal overlay aside widget menu topbar header footer bottom reply discussion share sharing social related recommended subscribe subscription signup login search form toc copyright legal".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: What follows a tag's name, quotes respected after an equals sign only.
REST = re.compile(r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))[^>=]*+)*+>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""")
NAME_PARTS = re.compile(r"[^a-z0-9]+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

#: What the marks say of a node.
PLAIN, CLASSED, DOUBTFUL, NOISE = range(4)
#: Kinds of the tree's rows.
TEXT, CHILDREN, SEEN = range(3)


def mark(tag: str, attributes: str) -> tuple[str, int]:
    """The node's name in the style tree, and what its marks say."""
    said = NOISE if tag in NOISE_TAGS else PLAIN
    if not attributes or "=" not in attributes:
        return tag, NOISE if attributes and attributes.strip(" />").lower() == "hidden" else said
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
    kind = found.get("class", "").lower().split()
    names = set(NAME_PARTS.split(f"{' '.join(kind)} {found.get('id', '').lower()}"))
    if found.get("role", "").lower() in NOISE_ROLES or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or not RESERVED_NAMES.isdisjoint(names):
        said = NOISE
    elif said == PLAIN and not AMBIGUOUS_NAMES.isdisjoint(names):
        said = DOUBTFUL
    elif said == PLAIN and kind:
        said = CLASSED
    return ".".join([tag, *sorted(kind)]), said


def digest(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) - (1 << 63)


class Page:
    """A page's blocks [(node, said, in article, text)] and its style nodes [(node, children)]."""

    def __init__(self, page: str | None):
        self.blocks: list[tuple[int, int, bool, str]] = []
        self.styles: list[tuple[int, str]] = []
        self.marked = False
        # tag, node, said, in article, children, and for implied ends: where the nearest open element of each kind is in this scope
        self.stack: list[tuple[str, int, int, bool, list[str], dict[str, int]]] = [("", 0, PLAIN, False, [], {})]
        self.places: dict[str, list[int]] = {}
        self.held: list[str] = []
        self.hidden: tuple[str, int] | None = None  # an inline element whose text is no content, and how deep it is nested in itself
        self.read(page or "")

    def flush(self) -> None:
        if self.held:
            line = " ".join(entities.unescape("".join(self.held)).split())
            self.held.clear()
            if line:
                _, node, said, article, _, _ = self.stack[-1]
                self.blocks.append((node, said, article, line))

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, node, _, _, children, _ = self.stack.pop()
            self.places[tag].pop()
            self.styles.append((node, " ".join(children)))
        self.hidden = None

    def read(self, text: str) -> None:
        at, quotes = 0, True
        while at < len(text):
            lt = text.find("<", at)
            if lt < 0:
                lt = len(text)
            if lt > at and not self.hidden:
                self.held.append(text[at:lt])
            at = lt
            m = NAME.match(text, at + 1)
            if not m:
                if text.startswith("<!--", at):
                    end = text.find("-->", at + 4)
                    at = len(text) if end < 0 else end + 3
                elif text.startswith("<![CDATA[", at):
                    end = text.find("]]>", at)
                    at = len(text) if end < 0 else end + 3
                elif text.startswith(("<!", "<?", "</"), at):
                    end = text.find(">", at)
                    at = len(text) if end < 0 else end + 1
                elif at < len(text):
                    if not self.hidden:
                        self.held.append("<")
                    at += 1
                continue
            rest = REST.match(text, m.end()) if quotes else None
            if rest:
                at = rest.end()
            else:  # a quote that is never closed, or no end at all: from here on quotes mean nothing
                quotes = False
                end = text.find(">", m.end())
                at = len(text) if end < 0 else end + 1
                if end < 0:
                    break
            if m[1]:
                self.end(m[2].lower())
            else:
                at = self.start(m[2].lower(), text[m.end() : at - 1], text, at)
        self.flush()
        self.close(1)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
            if self.places.get(tag):
                self.close(self.places[tag][-1])
        elif self.hidden and tag == self.hidden[0]:
            self.hidden = (tag, self.hidden[1] - 1) if self.hidden[1] > 1 else None

    def start(self, tag: str, attributes: str, text: str, at: int) -> int:
        if tag in RAW:
            if tag in BLOCK:
                self.flush()
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            return end.end() if end else len(text)
        if tag == "br":
            self.held.append(" ")
        if tag not in BLOCK:
            if self.hidden:
                self.hidden = (self.hidden[0], self.hidden[1] + (tag == self.hidden[0]))
            elif tag not in VOID and not attributes.endswith("/") and mark(tag, attributes)[1] == NOISE:
                self.hidden = tag, 1
            return at
        self.flush()
        for kinds in (("p",) if tag in ENDS_P else ()), SAME.get(tag, ()):
            open_at = [self.stack[-1][5][k] for k in kinds if k in self.stack[-1][5]]
            if open_at:
                self.close(max(open_at) if kinds != ("tr", "td", "th") else min(open_at))
        _, above, said, article, children, near = self.stack[-1]
        children.append(tag)
        if tag in VOID:
            return at
        name, own = mark(tag, attributes)
        if tag in ("article", "main") and max(said, own) < NOISE:
            article = self.marked = True
        elif tag in ("html", "body"):
            own = PLAIN
        elif tag == "header" and not article:
            own = NOISE
        depth = len(self.stack)
        near = {} if tag in FENCE else near
        if tag in IMPLIED:
            near = {**near, tag: depth}
        self.places.setdefault(tag, []).append(depth)
        self.stack.append((tag, digest(name, above & (1 << 64) - 1), max(said, own), article, [], near))
        return at

    def judged(self) -> Iterator[tuple[float, int, str]]:
        """(weight, node, text) of the blocks that marks don't exclude; weight 0: not judged, stays."""
        for node, said, article, text in self.blocks:
            if said == NOISE or self.marked and not article:
                continue
            if said == DOUBTFUL:
                yield AMBIGUOUS, node, text
            else:
                yield 0.0 if article and said == PLAIN else 1.0, node, text


TREE = pa.schema([("host", pa.int64()), ("node", pa.int64()), ("kind", pa.int8()), ("value", pa.int64()), ("page", pa.int64())])


def tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The style tree's rows of all nodes of all pages; a page has each once."""
    for batch in batches:
        for part in slices(batch, "html"):
            seen: set[tuple[int, int, int, int, int]] = set()
            for host, page in zip(part.column("__host").to_pylist(), part.column("html").to_pylist(), strict=True):
                read, name = Page(page), digest(page or "")
                seen.update((host, node, TEXT, digest(text), name) for node, _, _, text in read.blocks)
                seen.update((host, node, SEEN, 0, name) for node, _, _, _ in read.blocks)
                with_text = {node for node, _, _, _ in read.blocks}
                seen.update((host, node, CHILDREN, digest(children), name) for node, children in read.styles if node in with_text)
            columns = list(zip(*seen, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TREE, strict=True)], schema=TREE)


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, m (pages that show the node), presentation, content, importance; for pages with __host and html."""
    rows = pages.select("__host", "html").mapInArrow(tree_batches, "host long, node long, kind byte, value long, page long").distinct()
    values = rows.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"))
    of = lambda kind, what: F.sum(F.when(F.col("kind") == kind, what))
    n = F.col("n").cast("double")
    sums = values.groupBy("host", "node").agg(
        of(SEEN, n).alias("m"), of(TEXT, n).alias("texts"), of(TEXT, n * F.log2("n")).alias("repeats"),
        of(CHILDREN, n).alias("shown"), of(CHILDREN, n * F.log2("n")).alias("alike"), of(CHILDREN, F.lit(1)).alias("l"),
    )
    bits = F.log2("m")
    presentation = F.when(bits > 0, (F.log2("shown") - F.col("alike") / F.col("shown")) / bits).otherwise(1.0)
    content = F.when(bits > 0, 1 - F.col("repeats") / (F.col("texts") * bits)).otherwise(1.0)
    found = sums.where("m IS NOT NULL").select("host", "node", "m", "l", bits.alias("bits"), presentation.alias("presentation"), content.alias("content"))
    share = F.pow(F.lit(GAMMA), F.coalesce("l", F.lit(0)))
    plain = (1 - share) * F.coalesce("presentation", F.lit(0.0)) + share * F.col("content")
    return found.select("host", "node", "m", "presentation", "content", ((plain * F.col("bits") + PRIOR_BITS) / (F.col("bits") + PRIOR_BITS)).alias("importance"))


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = []
            for page, low in zip(part.column("html").to_pylist(), part.column("low").to_pylist(), strict=True):
                known = {e["node"]: e["importance"] for e in low or ()}
                texts.append("\n".join(text for weight, node, text in Page(page).judged() if not weight or weight * known.get(node, 1.0) >= MIN_IMPORTANCE))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )


def with_hosts(pages: DataFrame) -> DataFrame:
    """page_id, url, html and __host, a hash of the url's lower-case host."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    return bounded(pages).select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64(host).alias("__host"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = with_hosts(pages)
    weak = style_tree(rows).where(F.col("importance") * AMBIGUOUS < MIN_IMPORTANCE)
    low = materialize(weak.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("low")), f"{shared_dir(pages.sparkSession)}/low")
    size = low.agg(F.sum(F.size("low")).alias("n")).first()["n"] or 0
    if size <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(low), F.col("__host") == F.col("host"), "left")
    else:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)))
        spread = low.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, (F.col("__host") == F.col("host")) & (F.col("__salt") == F.col("__s")), "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "low").mapInArrow(extract_batches, f"page_id {kind}, url string, text string, n_chars long")
