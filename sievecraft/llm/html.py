"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. Each block has its number of words and its link density, those of the
blocks before and after it, and hints: its place inside an article, tags and class names that speak against it, a
heading, the end of a sentence, a rights notice outside an article. A decision tree, trained on the small labelled table below, keeps or
drops each block; in pages without hints it goes by the neighbours, and a name that may mean something else weighs half.

Reading takes time in proportion to the page at any depth of tags: each open tag carries what those around it say, and
the places of open tags are listed by name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecraft.llm.common import map_arrow, slabs, texts

#: A tag whose quotes are closed, and any other. Quantifiers never give back, so a match takes one pass.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
OPEN_QUOTE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NOTICE = re.compile(r"©|\(c\)\s*\d{4}|\bcopyright\b|all rights reserved", re.I)
#: Tags whose content is raw text that is not shown; tags whose content is not shown as text; those among
#: these that end where a block begins; those that do so where they are not closed; tags that bound blocks; tags that never close.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SILENT = frozenset("noscript template svg math object canvas head select option optgroup datalist button audio video".split())
SHORT = frozenset("svg math select option optgroup datalist".split())
CLOSED = frozenset("button audio video canvas object noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Surroundings that speak for and against a block, as tags and as words of class, id and role; words that
#: speak against articles too; words that make a class name tell a state of the page and not what it holds.
FOR, AGAINST = frozenset(["article", "main"]), frozenset("nav header footer aside form fieldset menu dialog".split())
AGAINST_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disqus footer form gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup privacy promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets".split()
)
THREAD_WORDS = frozenset("comment comments commentlist disqus related recommended reply replies respond sidebar teaser widget widgets".split())
FOR_WORDS = frozenset("article articlebody content entry main post story".split())
#: Words that say where something stands or how it looks, and leave a name's meaning as it is.
FORM_WORDS = frozenset("area bar block body bottom box btn button buttons center close col column container content entry fixed form footer global group header holder icon icons inner item items label left link links list main message module notice outer page panel post posts primary right row secondary section site slot small text title toggle top unit wrap wrapper zone".split())
STATE_WORDS = frozenset("has with without no is not js".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "outside", "against", "heading", "sentence", "notice")


def hints(attributes: str) -> tuple[bool, float, bool]:
    """Whether the names of a tag speak for its content, how much against it, and whether against articles inside it. A name
    of which a part is an unknown word, or one that speaks for the content, may mean something else and counts half."""
    good, bad, thread = False, 0.0, False
    for value in HINT.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            if not words or words[0] in STATE_WORDS or "with" in words:
                continue
            favour = not FOR_WORDS.isdisjoint(words)
            against = {w for w in words if w in AGAINST_WORDS and not (favour and w == "header")}  # an article's own header
            plain = all(w in AGAINST_WORDS or w in FORM_WORDS for w in words)
            sure = against and (plain and not favour or not THREAD_WORDS.isdisjoint(words) and all(w in AGAINST_WORDS or w in FORM_WORDS or w in FOR_WORDS for w in words))
            good |= favour and not against
            bad = max(bad, 1.0 if sure else 0.5 if against else 0.0)
            thread |= bool(sure) and not THREAD_WORDS.isdisjoint(words)
    return good, bad, thread


class Open(NamedTuple):
    """An open tag and what it and those around it say: `against` within the innermost article, `thread` outside it."""

    tag: str
    inside: bool
    heading: bool
    against: float
    thread: bool
    threads: bool  # at any depth


class Page:
    """Reads a page once from front to back and keeps its text blocks with what their surroundings say."""

    def __init__(self, page: str):
        self.page = page
        self.out: list[tuple[str, int, float, bool, float, bool]] = []
        self.stack = [Open("", False, False, 0.0, False, False)]
        self.places: dict[str, list[int]] = {}  # of the open tags of a name
        self.bounds: list[int] = []  # places of the open tags that bound blocks
        self.next_of: dict[str, int] = {}  # where a name's next tag was found that is not yet read
        self.parts: list[str] = []
        self.linked = self.links = self.silent = 0
        self.read(page)
        self.close()

    def close(self) -> None:
        """Ends the block."""
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                top = self.stack[-1]
                # What stands around the innermost article says nothing about it, unless articles are what it holds.
                self.out.append((text, len(text.split()), min(1.0, self.linked / len(text)), top.inside, 1.0 if top.thread else top.against, top.heading))
        self.parts.clear()
        self.linked = 0

    def add(self, text: str) -> None:
        if not self.silent:
            self.parts.append(text)
            if self.links:
                self.linked += len(text.strip())

    def pop(self, k: int) -> None:
        """Closes the open tags from place k on."""
        for x in self.stack[k:]:
            self.places[x.tag].pop()
            self.links -= x.tag == "a"
            self.silent -= x.tag in SILENT
        while self.bounds and self.bounds[-1] >= k:
            self.bounds.pop()
        del self.stack[k:]

    def last(self, tags: frozenset | tuple) -> int | None:
        """Place of the innermost open tag among some."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=None)

    def push(self, x: Open) -> None:
        self.places.setdefault(x.tag, []).append(len(self.stack))
        if x.tag in BLOCK:
            self.bounds.append(len(self.stack))
        self.stack.append(x)
        self.links += x.tag == "a"
        self.silent += x.tag in SILENT

    def is_closed(self, tag: str, at: int) -> bool:
        """Whether the next tag of this name closes it. Every stretch of the page is searched once for each name."""
        found = self.next_of.get(tag, -1)
        if found < at:
            match = re.compile(rf"</?{tag}\b", re.I).search(self.page, at)
            found = self.next_of[tag] = match.start() if match else len(self.page)
        return self.page.startswith("</", found)

    def open(self, tag: str, attributes: str, at: int) -> None:
        if tag in ("p", "li", "dd", "dt", "tr", "td", "th") or tag in BLOCK and self.stack[-1].tag == "p":
            own = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "tr": ("tr",)}.get(tag, ("p",))
            k = self.last(own)
            # Not over a tag that bounds blocks, but for paragraphs.
            if k is not None and all(self.stack[j].tag == "p" for j in self.inner(k)):
                self.pop(k)
        good, bad, thread = hints(attributes) if attributes else (False, 0.0, False)
        whole = tag in ("body", "html") or tag in FOR and not thread
        against = 0.0 if whole else 1.0 if tag in AGAINST else bad
        if tag == "header" and not bad and self.places.get("article"):
            against = 0.0  # an article's own heading
        around, thread = self.stack[-1], thread and not whole
        inside = not against and (tag in FOR or tag in ("div", "section") and good)
        shown = tag if tag not in CLOSED or self.is_closed(tag, at) else "option"  # ends where a block begins
        within = against if tag in FOR else max(against, around.against)
        self.push(Open(shown, around.inside or inside, around.heading or tag[:1] == "h" and tag[1:].isdigit(), within, around.threads if tag in FOR else around.thread, around.threads or thread))

    def inner(self, k: int) -> Iterator[int]:
        """Places further in than k of tags that bound blocks, the innermost first."""
        for j in reversed(self.bounds):
            if j <= k:
                return
            yield j

    def tag(self, page: str, at: int, end: str, tag: str, attributes: str) -> int:
        """Takes a tag that ends before `at`; the place to read on from."""
        if tag in RAW:
            if not end and not attributes.rstrip().endswith("/"):
                shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = shut.end() if shut else len(page)
                self.parts.append(" ")
            return at
        if tag in BLOCK:
            if not end:
                while (k := self.last(SHORT)) is not None:
                    self.pop(k)
            if tag == "body" and (k := self.last(("head",))) is not None:
                self.pop(k)
            self.close()
        elif tag == "br" or tag in SILENT:
            self.parts.append(" ")
        if end:
            k = self.last((tag,))
            if k is not None:
                self.pop(k)
        elif tag not in VOID and not attributes.endswith("/"):
            self.open(tag, attributes, at)
        return at

    def read(self, page: str) -> None:
        at, quotes_end = 0, True
        while (start := page.find("<", at)) >= 0:
            if start > at:
                self.add(page[at:start])
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                at = stop + 3 if stop >= 0 else len(page)
                continue
            if page.startswith(("<!", "<?"), start):
                stop = page.find(">", start)
                at = stop + 1 if stop >= 0 else len(page)
                continue
            found = TAG.match(page, start) if quotes_end else None
            if not found and (page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] == "/"):
                if page.find(">", start) < 0:
                    self.add(page[start:])
                    return
                found = OPEN_QUOTE.match(page, start)
                # No tag from here on has its quotes closed before the page ends: do not look for that again.
                quotes_end = quotes_end and not found
            if found:
                at = self.tag(page, found.end(), found[1], found[2].lower(), found[3])
            else:
                self.add("<")
                at = start + 1
        self.add(page[at:])


def blocks(page: str) -> list[tuple[str, np.ndarray]]:
    """Text and features of each block of a page, in order."""
    out = Page(page).out
    if not out:
        return []
    words, links, inside = (np.array([b[k] for b in out], float) for k in (1, 2, 3))
    pad = lambda x: np.concatenate(([0.0], x, [0.0]))
    against, heading = np.array([b[4] for b in out], float), np.array([b[5] for b in out], float)
    sentence, notice = np.array([b[0][-1] in ".!?:;\"')" for b in out], float), np.array([not b[3] and len(b[0]) < 200 and bool(NOTICE.search(b[0])) for b in out], float)
    outside = (1 - inside) * ((inside * (against < 1)).sum() > 0)
    table = np.stack([words, links, pad(words)[:-2], pad(links)[:-2], pad(words)[2:], pad(links)[2:], inside, outside, against, heading, sentence, notice], 1)
    return [(b[0], row) for b, row in zip(out, table, strict=True)]


_W = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def _words(n: int, stop: str = ".") -> str:
    return " ".join(_W[k % 20] for k in range(n)) + stop


def _menu(n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_W[k]}</a></li>' for k in range(n)) + "</ul>"


def labelled_table() -> list[tuple[np.ndarray, int]]:
    """The labelled blocks: features and whether the block is main text. Built from typical pages, with and without hints,
    whose blocks are marked in order, in four lengths of paragraphs."""
    out = []
    for long, short in ((90, 30), (60, 12), (25, 6), (12, 4)):
        p, q, h = f"<p>{_words(long)}</p>", f"<p>{_words(short)}</p>", f"<h2>{_words(5, '')}</h2>"
        label, rights = f"<div>{_words(2, '')}</div>", "<div>© 2020 one two</div>"
        pages = [
            # With hints: an article, or names of classes.
            (f"<body><nav>{_menu(4)}</nav><div class=ad>{_words(short)}</div><article><h1>{_words(6, '')}</h1>{p}{q}{p}</article><footer>{_words(9)}</footer></body>", "0000" + "0" + "1111" + "0"),
            (f"<main><h1>{_words(4, '')}</h1>{q}{p}<ul><li>{_words(short)}</li><li>{_words(3, '')}</li></ul>{p}</main><aside>{q}{_menu(3)}</aside>", "111111" + "0000"),
            (f"<header>{_words(3, '')}</header><article><header><h1>{_words(7, '')}</h1></header>{p}<form>{_words(4, ':')}</form>{p}<div class=comments>{p}{q}</div></article>", "0" + "11" + "0" + "1" + "00"),
            (f"<div class=cookie-notice>{_words(20)}</div><article>{q}</article><section id=comments><p>{_words(30)}</p></section>", "010"),
            (f"{label}<div>{_words(long)}</div><div>{_menu(2)}</div><article>{p}</article><div>{_words(short)}</div>", "0000" + "1" + "0"),
            (f"<article><p>{_words(3)}</p><p>{_words(1)}</p><p><a href=x>{_words(2, '')}</a></p>{p}</article><div class=related>{_menu(3)}{p}</div>", "1111000" + "0"),
            (f"<div class=content>{h}{p}{q}</div><div class=sidebar>{h}{p}{p}</div>{rights}", "111" + "000" + "0"),
            (f"<article>{p}{p}<p>{_words(3)}</p></article><article class=comment><p>{_words(long)}</p></article>", "1110"),
            # Without hints only the blocks themselves and their neighbours tell.
            (f"<div>{_menu(5)}</div><div>{h}{p}{p}{p}</div><div>{_menu(3)}</div>", "00000" + "1111" + "000"),
            (f"{label}<div>{_menu(3)}</div><div><h1>{_words(4, '')}</h1>{p}{q}<p>{_words(2)}</p>{p}{h}{p}</div>{label}<div>{_menu(3)}</div>{rights}", "0" + "000" + "1111111" + "0" + "000" + "0"),
            (f"<table><tr><td>{_menu(3)}</td><td>{p}{p}{q}{p}</td></tr></table>{label}<div>{_menu(2)}</div>", "000" + "1111" + "0" + "00"),
            (f"<div><p><a href=x>{_words(long)}</a></p><p><a href=y>{_words(long)}</a></p></div><div>{p}{p}</div><div>{_menu(2)}</div>", "00" + "11" + "00"),
            (f"<div>{_menu(3)}{label}{_menu(3)}{label}{_menu(2)}</div><div>{p}{q}{p}</div>{rights}", "000" + "0" + "000" + "0" + "00" + "111" + "0"),
            (f"<div><h1>{_words(3, '')}</h1>{p}<ul><li>{_words(3, '')}</li><li>{_words(4, '')}</li></ul>{p}<p>{_words(3)}</p></div>{rights}", "11" + "11" + "11" + "0"),
            (f"<h1>{_words(4, '')}</h1>{p}{p}", "111"),
            (f"<div>{_words(4, '')}</div><div>{_menu(3)}</div><div>{_words(5)}</div><div>{_menu(2)}</div><div>{p}<p>{_words(4, '')}</p>{p}<p>{_words(1)}</p>{p}</div>", "0" + "000" + "0" + "00" + "11111"),
            (f"<div><h3><a href=x>{_words(6, '')}</a></h3><p>{_words(12)}</p><h3><a href=y>{_words(5, '')}</a></h3><p>{_words(14)}</p><h3><a href=z>{_words(7, '')}</a></h3></div><div>{p}<div>{_words(2, '')}</div>{p}{p}</div>", "00000" + "1111"),
            (f"<div>{_menu(2)}</div><div>{_words(3)}</div><div>{_menu(2)}</div><div><h2>{_words(1, '')}</h2>{p}{p}<h2>{_words(2, '')}</h2>{p}</div><div>{_words(5)}</div><div>{_menu(3)}</div>", "00" + "0" + "00" + "11111" + "0" + "000"),
            (f"{p}", "1"),
            # Names that may mean something else: what is long and without links stays.
            (f"<div class=social-studies>{p}{p}</div><div>{_menu(3)}</div>", "11" + "000"),
            (f"<div id=legal-news>{h}{p}{q}{p}</div><div class=social-tools><div>{_words(2, '')}</div><div>{_words(3, '')}</div></div>", "1111" + "00"),
            (f"<div class=share-tools><div>{_words(2, '')}</div><div>{_words(1, '')}</div></div><div>{h}{p}{p}</div><div class=search-hints><a href=x>{_words(short)}</a></div>", "00" + "111" + "0"),
            # Short lines tell by those around them: among paragraphs they belong to the text, among themselves they do not.
            (f"<div>{h}{p}<p>{_words(3)}</p>{p}{p}</div><div>{_menu(2)}</div><div>{_words(3, '')}</div><div>{_words(4)}</div><div>{_words(3)}</div><div>{_words(2)}</div>", "11111" + "00" + "0000"),
            (f"<div>{_menu(2)}</div><div>{_words(2, '')}</div><div>{_words(4, '')}</div><div>{_words(3)}</div><div>{_menu(2)}</div><div>{p}<p>{_words(2)}</p>{p}<p>{_words(4)}</p>{p}</div>{rights}", "00" + "000" + "00" + "11111" + "0"),
            (f"<div>{_words(1, '')}</div><div><h1>{_words(4, '')}</h1>{p}<p>{_words(1)}</p>{p}</div>{rights}", "1" + "1111" + "0"),
            # Short articles, and short comments inside them.
            (f"<nav>{_menu(3)}</nav><div class=cookie-notice>{_words(3)}</div><article><h1>{_words(1, '')}</h1><p>{_words(4)}</p><p>{_words(1)}</p><form>{_words(2, '')}</form><div class=comments><p>{_words(2)}</p><p>{_words(6)}</p></div></article><aside>{_words(1, '')}</aside>", "000" + "0" + "111" + "0" + "00" + "0"),
            (f"<nav>{_words(1, '')}</nav><article><h1>{_words(3, '')}</h1>{_words(2, '')}<p>{_words(1, '')}</p></article>", "0" + "111"),
            (f"<div>{_words(3, '')}</div><main><h1>{_words(2, '')}</h1><p>{_words(4, '')}</p><ul><li>{_words(1, '')}</li><li>{_words(3, '')}</li></ul></main><div>{_words(2, '')}</div>", "0" + "1111" + "0"),
            (f"<article><p>{_words(3)}</p><p>{_words(2)}</p><p>{_words(5)}</p><p>{_words(1)}</p><div class=replies><p>{_words(3)}</p></div></article><footer>{_words(4)}</footer>", "1111" + "0" + "0"),
        ]
        for page, marks in pages:
            found = blocks(page)
            if len(found) != len(marks):
                raise AssertionError((page, [b[0] for b in found], marks))
            out += [(row, int(mark)) for (_, row), mark in zip(found, marks, strict=True)]
    return out


def train(spark: SparkSession, depth: int = 10) -> list[tuple]:
    """Nodes of the decision tree that Spark fits on the labelled table: (feature, threshold, left, right) or (keep,)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense(row.tolist()), float(mark)) for row, mark in labelled_table()]
    model = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(spark.createDataFrame(rows, ["features", "label"]).coalesce(1))
    nodes: list[tuple] = []

    def walk(node) -> int:
        k = len(nodes)
        nodes.append(())
        if node.getClass().getSimpleName() == "LeafNode":
            nodes[k] = (int(node.prediction()),)
        else:
            split = node.split()
            nodes[k] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))
        return k

    walk(model._java_obj.rootNode())
    return nodes


def keep(nodes: list[tuple], row: np.ndarray) -> bool:
    k = 0
    while len(nodes[k]) > 1:
        feature, threshold, left, right = nodes[k]
        k = left if row[feature] <= threshold else right
    return bool(nodes[k][0])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' other columns and text, the kept blocks joined by line ends; `html` goes.

    Null or empty html and pages without main text give the empty text. Character references are decoded and
    white space inside a block becomes one blank. Repeated rows and null keys each give a row; a column named
    `text` is replaced.
    """
    nodes = train(pages.sparkSession)
    others = [f for f in pages.schema.fields if f.name not in (html, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, html):
            out = ["\n".join(text for text, row in blocks(page) if keep(nodes, row)) for page in texts(batch, html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], pa.array(out, pa.string())], names=[*[f.name for f in others], "text"])

    schema = T.StructType([*others, T.StructField("text", T.StringType())])
    return map_arrow(pages.select(*[F.col(f.name) for f in others], html), run, schema)
