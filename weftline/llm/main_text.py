"""Main text of HTML pages by tree scoring (operator 10).

A page's tags are read with Python's HTML parser into a tree of blocks; open
paragraphs end as HTML says.  Elements that hold no article text (scripts,
styles, forms, navigation, headers and footers of the page, asides, and those
whose class, id or role names an advert, a notice, comments, sharing or a menu) are
left out with all that is in them.

Each paragraph gives points to its ancestors: one, one for each comma, one for
each 100 characters up to MOST_BY_LENGTH; all to its parent, half to the parent
of that, a quarter to the next, and so on.  A container's points are multiplied
by the share of its text outside links.  The best container is kept, or the
article or main element that it is in, and siblings of that which score at least
a fifth as much, or are unlinked blocks of their own (headings, also in a wrapper, paragraphs, lists
and the like; sections beside a section).  All blocks in these are the text, in page order.

Sums go up and verdicts go down the tree once, so the time is linear in the page.
Where a form hides HIDDEN_TIMES the text that is left, it is read again as a container (its
controls and labels stay out).  Where class and id names leave no text, or little on a page without article and main
elements and HIDDEN_TIMES as much hidden by them, the page is read again without them, and the
reading of the better container counts.

Defined results: a null or empty page, and one without a paragraph, has the
text ''; ties between containers go to the one that begins first; white space is
what Unicode calls so; repeated rows are read alike, each by itself; an empty table
gives no rows; other columns are passed on, those named like an output are replaced.
Text outside of any tag counts as a paragraph of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks, replaced

MOST_BY_LENGTH = 3
# fixed values of HTML: elements without content, elements that end an open paragraph, and block elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - frozenset("body html caption dd dt li tbody td tfoot th thead tr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea select title head video audio".split())
DROPPED = RAW | frozenset("nav footer aside button dialog menu input".split())
#: Left out with their form; a form itself is left out where it isn't read as a container.
OF_FORMS = frozenset("fieldset label".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A page is read again where what was hidden has so many times the text that is left, and so many characters.
HIDDEN_TIMES, HIDDEN_CHARS, LITTLE = 4, 400, 200
LEAVES = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl pre blockquote figure table".split())
# fixed values: parts of class, id and role names that aren't the article whatever stands beside them
UNWANTED = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent popup modal newsletter subscribe subscription comment comments respond replies disqus sharing menu nav navbar navigation breadcrumb breadcrumbs sidebar widget recommended recommendations footer masthead topbar toolbar pagination pager login signup complementary contentinfo".split()
)
# fixed values: parts that aren't the article alone or beside those of PLACES, and parts that say the opposite
WEAK = frozenset("header social share related recommend side notice search".split())
PLACES = frozenset("site page top main global box bar buttons links posts stories list area container wrapper block section icons form media news message".split())
MODIFIERS = frozenset("with has no without not is".split())


def unwanted(names: str) -> bool:
    """Whether one of the names (class, id, role) of an element says that it isn't the article."""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if MODIFIERS.isdisjoint(parts) and (not UNWANTED.isdisjoint(parts) or (not WEAK.isdisjoint(parts) and all(x in WEAK or x in PLACES for x in parts))):
            return True
    return False


class _Node:
    __slots__ = ("tag", "parent", "parts", "drop", "why", "article", "own", "points", "chars", "linked", "heads", "keep")

    def __init__(self, tag: str, parent: _Node | None, drop: bool):
        self.tag, self.parent, self.drop, self.keep = tag, parent, drop, False
        self.article = tag == "article" or (parent is not None and parent.article)
        self.parts: list[_Node | str] = []
        self.own = self.points = 0.0  # as a paragraph, and from what is in it
        self.chars = self.linked = self.heads = 0
        self.why = parent.why if parent is not None and drop else ""  # what hides it: a form, a name, or something else

    @property
    def score(self) -> float:
        return self.points * (1 - self.linked / self.chars) if self.chars else 0.0


class _Reader(HTMLParser):
    """Builds the tree; character references are decoded by the parser."""

    def __init__(self, by_name: bool, forms: bool = True):
        super().__init__(convert_charrefs=True)
        self.by_name, self.forms, self.found_article = by_name, forms, False
        self.hidden = Counter()  # characters of text, by what hides them
        self.root = self.at = _Node("html", None, False)
        self.nodes, self.open = [self.root], Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.at.parts.append(" ")
        if tag in ENDS_P:
            self._end("p", BLOCK - {"p"})
        if tag in ("li", "dd", "dt", "tr", "td", "th"):
            self._end(tag, {"ul", "ol", "dl", "table", "menu"})
        if tag in VOID:
            return
        drop = self.at.drop or tag in DROPPED or (tag == "header" and not self.at.article) or (tag in OF_FORMS and bool(self.open["form"]))
        drop = drop or any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none", v)) for k, v in attrs)
        why = "" if drop else "form" if tag == "form" and self.forms else ""
        if not drop and not why and self.by_name and tag not in ("article", "main") and unwanted(" ".join(v for k, v in attrs if k in ("class", "id", "role") and v)):
            why = "name"
        node = _Node(tag, self.at, drop or bool(why))
        if why:
            node.why = why
        elif drop and not self.at.drop or tag in DROPPED:
            node.why = "other"
        self.found_article |= tag in ("article", "main") and not node.drop
        self.at.parts.append(node)
        self.nodes.append(node)
        self.open[tag] += 1
        self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and tag not in ("html", "body"):
            self._end(tag, BLOCK if tag not in BLOCK else frozenset())

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)
        if self.at.drop:
            self.hidden[self.at.why] += len(data.strip())

    def _end(self, tag: str, stop: frozenset[str] | set[str]) -> None:
        """Closes the nearest open ``tag``, and all in it, unless an element of ``stop`` is in between."""
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag and node.tag not in stop:
            node = node.parent
        if node.tag == tag:
            while self.at is not node.parent:
                self.open[self.at.tag] -= 1
                self.at = self.at.parent


def _blocks(root: _Node) -> list[tuple[_Node, str]]:
    """(block element, text) of each run of text between the starts and ends of blocks, in page order."""
    out: list[tuple[_Node, str]] = []
    held: list[str] = []
    linked = 0

    def flush(owner: _Node) -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append((owner, text))
            owner.chars += len(text)
            owner.linked += min(linked, len(text))
        held.clear()
        linked = 0

    # an explicit stack: pages may nest deeper than Python's recursion
    stack: list[tuple[_Node, Iterator, _Node, bool]] = [(root, iter(root.parts), root, False)]
    while stack:
        node, parts, owner, in_link = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if node is owner:
                flush(owner)
        elif isinstance(part, str):
            held.append(part)
            linked += len(part.strip()) if in_link else 0
        elif not part.drop:
            block = part.tag in BLOCK
            if block:
                flush(owner)
            stack.append((part, iter(part.parts), part if block else owner, in_link or part.tag == "a"))
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    text, reader = _read(html, True, True)
    if reader.hidden["form"] > max(HIDDEN_CHARS, HIDDEN_TIMES * len(text)):  # a form around the page
        text, reader = _read(html, True, False)
    little = len(text) < LITTLE and not reader.found_article and reader.hidden["name"] > max(HIDDEN_CHARS, HIDDEN_TIMES * len(text))
    if reader.hidden["name"] and (not text or little):  # a name that holds the article
        again, other = _read(html, False, reader.forms)
        text = again if not text or other.best > HIDDEN_TIMES * reader.best else text
    return text


def _read(html: str, by_name: bool, forms: bool) -> tuple[str, _Reader]:
    """The main text, and the reader with what it hid and the best score."""
    reader = _Reader(by_name, forms)
    reader.feed(html)
    reader.close()
    blocks, root = _blocks(reader.root), reader.root
    reader.best = 0.0
    if not blocks:
        return "", reader
    for node, text in blocks:
        node.heads += len(text) if node.tag in HEADS else 0
        node.own += 1 + text.count(",") + min(MOST_BY_LENGTH, len(text) / 100)
    root.points = root.own
    for node in reversed(reader.nodes[1:]):  # children come after their parents
        up = node.parent
        up.points += node.own + node.points / 2
        up.chars += node.chars
        up.linked += node.linked
        up.heads += node.heads
    best = max(reader.nodes, key=lambda n: n.score)
    reader.best = best.score
    at = best
    while at is not None and at.tag not in ("article", "main"):
        at = at.parent
    whole = at or best
    whole.keep = True
    for node in whole.parent.parts if whole.parent is not None else ():
        if isinstance(node, _Node) and node.chars and not node.drop:
            own = node.tag in LEAVES or node.heads == node.chars or node.tag == whole.tag == "section"
            if node.score >= max(best.score / 5, 2) or (own and node.linked < node.chars / 4):
                node.keep = True
    for node in reader.nodes[1:]:
        node.keep = node.keep or node.parent.keep
    return "\n\n".join(text for node, text in blocks if node.keep), reader


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` without ``html_col``, with text and n_chars (code points)."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    position = df.columns.index(html_col)
    schema = replaced(T.StructType([f for f in df.schema.fields if f.name != html_col]), *fields)
    keep = [i for i, c in enumerate(df.columns) if c in schema.names[:-2] and i != position]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, position):
            texts = [main_text(x) for x in batch.column(position).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], schema.names)

    return df.mapInArrow(compute, schema)
