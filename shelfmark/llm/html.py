"""The main text of web pages, by a tagger over the leaf blocks of the DOM.

A page becomes its leaf blocks: the text between two borders of block elements,
with the elements above it. A linear-chain conditional random field labels each
block as of the article or not, from the tags and class words above it and from
its text; Viterbi's algorithm finds the best labels of a page.

It is fitted on a bounded sample of pages whose mark-up tells the article (an
``article`` or ``main`` element). So that other mark-up is known too, each
sampled page is also laid out anew a few times, its own texts going into other
elements under other class names, with the labels they had.

Defined results: a null or empty page, or one without an article, has empty
text; repeated rows are extracted each; mark-up that is not closed runs to where
HTML closes it; an empty table gives an empty one; other columns are carried.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.crf import Crf

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|data-gold)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-zA-Z]+")

# fixed values: kinds of HTML elements
UNSEEN = set("script style noscript template head title iframe object svg math canvas audio video "
             "select option button textarea input datalist map".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset "
            "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
            "menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
# an element of the first kind ends an open one of the second, up to the third
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
          "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}

# of these, those that hold other elements and no text of their own
HOLDERS = BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre",
                   "blockquote", "table", "tbody", "thead", "tr", "td", "th", "figcaption"}

# the sample that the tagger is fitted on
SAMPLE_PAGES = 200
SAMPLE_CHARS = 200_000  # longer pages are not drawn for it
LAYOUTS = 5
LONGEST = 120  # blocks of a page that are fitted on


class Element:
    """An open element: what holds for all blocks in it, told from its parent's, so
    that a block costs the same however deep it stands."""

    __slots__ = ("tag", "block", "tags", "words", "nearest", "gold", "below")

    def __init__(self, parent: Element | None, tag: str, words: tuple[str, ...], gold: str | None):
        self.tag = tag
        self.block = tag if tag in BLOCK else parent.block if parent else "body"
        self.tags: frozenset[str] = parent.tags if parent else frozenset()
        if tag not in self.tags:
            self.tags |= {tag}
        self.words: frozenset[str] = parent.words if parent else frozenset()
        if not self.words.issuperset(words):
            self.words |= set(words)
        self.nearest = words or (parent.nearest if parent else ())
        self.gold = gold or (parent.gold if parent else None)
        # what stands between the article and here: how many elements that hold
        # others, and whether one has class words
        inside = parent.below if parent else None
        if tag in ("article", "main"):
            self.below: tuple[int, bool] | None = (0, False)
        elif inside is not None and tag in HOLDERS:
            self.below = (min(inside[0] + 1, 3), inside[1] or bool(words))
        else:
            self.below = inside


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    within: Element | None

    @property
    def gold(self) -> str | None:
        """What a laid-out page says of the block."""
        return self.within.gold if self.within else None


class Stack:
    """The open elements, found by tag without a walk over all of them."""

    def __init__(self):
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, words: tuple[str, ...], gold: str | None) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(Element(self.open[-1] if self.open else None, tag, words, gold))

    def pop(self) -> str:
        tag = self.open.pop().tag
        self.places[tag].pop()
        return tag

    def last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def find(self, tags: set[str], within: set[str]) -> int | None:
        """The place of the innermost open one of ``tags`` that is not outside the
        innermost one of ``within``."""
        at = self.last(tags)
        return at if at >= 0 and at >= self.last(within) else None

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))


def _attributes(text: str) -> tuple[tuple[str, ...], str | None]:
    words, gold = [], None
    if "=" in text:
        for name, value in _ATTRIBUTE.findall(text):
            value = value.strip("\"'")
            if name.lower() == "data-gold":
                gold = value
            else:
                words += [w.lower() for w in _WORD.findall(value)]
    return tuple(words), gold


def leaf_blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page, without elements whose text is not shown. Of class
    words only the ``known`` ones are kept, where they are given."""
    blocks: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    linked = hidden = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, linked, stack.open[-1] if stack.open else None))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if stack.has("a"):
                linked += len(text)

    def close(at: int) -> None:
        nonlocal hidden
        if any(e.tag in BLOCK for e in stack.open[at:]):
            flush()
        while len(stack.open) > at:
            hidden -= stack.pop() in UNSEEN

    find = stack.find

    at = 0
    while at < len(html):
        m = _MARKUP.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = find({tag}, set() if tag in BLOCK else {"td", "th", "table"})
            if k is not None:
                close(k)
            continue
        if tag in BLOCK:
            k = find({"p"}, {"button", "table", "td", "th"})
            if k is not None:
                close(k)
            if tag in CLOSES:
                k = find(*CLOSES[tag])
                if k is not None:
                    close(k)
            flush()
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag == "body" and stack.open:
            k = find({"head"}, set())
            if k is not None:
                close(k)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        words, gold = _attributes(m[3])
        if known is not None:
            words = tuple(w for w in words if w in known)
        stack.push(tag, words, gold)
        hidden += tag in UNSEEN
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """The features of each block of a page."""
    result = []
    nothing = Element(None, "", (), None)
    whole = {t for within in {id(b.within): b.within for b in blocks if b.within}.values() for t in within.tags}
    marks = "article" in whole or "main" in whole
    of_element: dict[int, list[str]] = {}
    for k, b in enumerate(blocks):
        within = b.within or nothing
        shared = of_element.get(id(within))
        if shared is None:
            inside = within.below is not None
            outer = not OUTER.isdisjoint(within.tags)
            shared = [f"above={t}" for t in sorted(within.tags)]
            shared += [f"class={w}" for w in sorted(within.words)]
            shared += [f"nearest={w}" for w in within.nearest]
            shared += [f"marked={marks},{inside},{outer}", f"own,marked={within.block},{marks},{inside}"]
            shared += [f"below={within.below},{outer},{bool(within.words)}"]
            of_element[id(within)] = shared
        own = within.block
        n = len(b.text)
        count = b.text.count(" ") + 1
        link = 4 * b.linked // n
        stops = sum(map(b.text.count, ".!?"))
        f = [f"own={own}", f"words={count.bit_length()}", f"link={link}", f"end={b.text[-1] in '.!?'}"]
        f += [f"own,words={own},{count.bit_length()}", f"link,words={link},{count.bit_length()}"]
        f += [f"stops={min(stops, 4)}", f"place={10 * k // len(blocks)}", "bias"]
        f.append(f"mark={b.text[0] if b.text[0] in '©®|»«•' else ''}")
        result.append(f + shared)
    return result


# fixed value: elements whose texts are not of the article
OUTER = frozenset(("nav", "aside", "footer", "form"))

# fixed values: names that pages give to their parts
MAIN_NAMES = ("content", "post", "entry-content", "article-body", "story", "main-content",
              "post-body", "page-content", "text", "body-copy", "post-content", "entry")
ASIDE_NAMES = ("sidebar", "widget", "related", "recommended", "popular", "tags", "side", "rail")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo")
NOTICE_NAMES = ("notice", "cookie", "cookie-banner", "alert", "consent", "gdpr", "message", "popup")
COMMENT_NAMES = ("comments", "comment-list", "responses", "disqus", "discussion", "replies")
MENU_NAMES = ("menu", "nav", "navbar", "breadcrumb", "topbar", "navigation", "links")
HEADER_NAMES = ("header", "masthead", "site-header", "top", "branding", "logo")
FOOTER_NAMES = ("footer", "site-footer", "bottom", "copyright", "legal", "credits")
FORM_NAMES = ("newsletter", "subscribe", "search", "login", "contact", "signup")


def _plain(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def laid_out(main: list[tuple[str, str]], other: list[str], rng: random.Random) -> str:
    """A page of the (tag, text) blocks ``main`` and the texts ``other``, in mark-up
    drawn by ``rng``. What is of the article is marked as gold."""

    def short(least: int, most: int) -> str:
        words = rng.choice(other).split() or ["x"]
        at = rng.randrange(len(words))
        return _plain(" ".join(words[at : at + rng.randint(least, most)]))

    def named(names, tags=("div", "section")) -> tuple[str, str]:
        tag = rng.choice(tags)
        kind = rng.choice(("class", "class", "id"))
        return f'<{tag} {kind}="{rng.choice(names)}">', f"</{tag}>"

    def wrap(pair: tuple[str, str], inner: str) -> str:
        return pair[0] + inner + pair[1]

    def links(least: int, most: int) -> str:
        items = [f'<a href="/{i}">{short(1, 4)}</a>' for i in range(rng.randint(least, most))]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice((" | ", " ", " &raquo; ")).join(items)

    def paragraphs(least: int, most: int) -> str:
        tag = rng.choice(("p", "p", "div", "li"))
        return "".join(f"<{tag}>{short(3, 60)}</{tag}>" for _ in range(rng.randint(least, most)))

    def bare(tag: str) -> tuple[str, str]:
        return f"<{tag}>", f"</{tag}>"

    def menu() -> str:
        return wrap(rng.choice((bare("nav"), named(MENU_NAMES))), links(3, 8))

    def header() -> str:
        inner = rng.choice((f"<h1>{short(1, 4)}</h1>", f"<p>{short(2, 10)}</p>", short(1, 5)))
        return wrap(rng.choice((bare("header"), named(HEADER_NAMES))), inner)

    def footer() -> str:
        inner = rng.choice((f"&copy; 2024 {short(1, 12)}", f"<p>{short(3, 25)}</p>", links(2, 6)))
        return wrap(rng.choice((bare("footer"), named(FOOTER_NAMES))), inner)

    def side() -> str:
        inner = f"<h3>{short(1, 4)}</h3>" + rng.choice((links(2, 8), paragraphs(1, 3)))
        return wrap(rng.choice((bare("aside"), named(ASIDE_NAMES))), inner)

    def advert() -> str:
        return wrap(named(AD_NAMES), rng.choice((short(3, 25), f"<p>{short(3, 40)}</p>")))

    def notice() -> str:
        return wrap(named(NOTICE_NAMES), rng.choice((short(4, 30), f"<p>{short(4, 30)}</p>")))

    def form() -> str:
        inner = f"<label>{short(1, 4)}</label><input type=text><p>{short(2, 20)}</p>"
        return f'<form class="{rng.choice(FORM_NAMES)}">{inner}<button>{short(1, 2)}</button></form>'

    def comments() -> str:
        return wrap(named(COMMENT_NAMES), f"<h2>{short(1, 3)}</h2>" + paragraphs(1, 6))

    body = ""
    for k, (tag, text) in enumerate(main):
        tag = tag if tag[0] == "h" else rng.choice(("p", "p", "p", "p", "div", "blockquote", "li"))
        body += f"<{tag}>{_plain(text)}</{tag}>"
        if k and rng.random() < 0.2:
            body += '<div data-gold="other">' + rng.choice((advert, side, notice, form))() + "</div>"
    style = rng.random()
    before = [p for p in (header, menu, notice, advert) if rng.random() < 0.6]
    after = [p for p in (comments, side, advert, menu, form, notice, footer) if rng.random() < 0.6]
    rng.shuffle(before)
    if style < 0.15:  # laid out by a table, without names
        cell = '<td valign="top">'
        left = "".join(f"{cell}{rng.choice((links(2, 8), short(2, 12)))}</td>" for _ in range(rng.randint(0, 2)))
        top = f'<tr><td colspan="3">{rng.choice((short(1, 6), links(2, 6)))}</td></tr>' * (rng.random() < 0.7)
        end = f'<tr><td colspan="3">{rng.choice((short(2, 12), links(2, 5)))}</td></tr>' * (rng.random() < 0.7)
        return (
            f"<html><body><table>{top}<tr>{left}<td data-gold=\"main\">{body}</td></tr>{end}</table></body></html>"
        )
    if style < 0.3:  # nothing around it but the body
        before = [p() for p in before] if rng.random() < 0.4 else []
        after = [p() for p in after] if rng.random() < 0.4 else []
        tail = f"<p>{links(2, 4)}</p>" * (rng.random() < 0.3)
        bare_body = body.replace("<p>", '<p data-gold="main">').replace("<h", '<h data-gold="main" x')
        bare_body = re.sub(r"<h data-gold=\"main\" x(\d)>", r'<h\1 data-gold="main">', bare_body)
        bare_body = re.sub(r"<(div|blockquote|li)>", r'<\1 data-gold="main">', bare_body)
        return "<html><body>" + "".join(before) + bare_body + tail + "".join(after) + "</body></html>"
    if style < 0.65:
        body = rng.choice((f"<article>{body}</article>", f"<main>{body}</main>"))
    else:
        body = wrap(named(MAIN_NAMES + ("x", "c", "b")), body)
    if rng.random() < 0.3:
        body = wrap(named(("wrapper", "container", "page", "row", "col")), body)
    parts = [f'<div data-gold="main">{body}</div>']
    parts = [p() for p in before] + parts + [p() for p in after]
    return "<html><body>" + "".join(parts) + "</body></html>"


def marked_labels(blocks: list[Block]) -> list[int]:
    """Labels by the page's own mark-up."""
    return [
        int(b.within is not None and b.within.below is not None and OUTER.isdisjoint(b.within.tags))
        for b in blocks
    ]


def training_pages(pages: list[str], layouts: int) -> tuple[list, list]:
    """Features and labels of ``pages`` and of their new layouts."""
    sequences, labels = [], []

    def take(blocks: list[Block], own: list[int]) -> None:
        sequences.append(features(blocks)[:LONGEST])
        labels.append(own[:LONGEST])

    read = []
    for html in pages:
        blocks = leaf_blocks(html)
        own = marked_labels(blocks)
        if any(own) and not all(own):
            read.append((blocks, own))
            take(blocks, own)
    prose = [b.text for blocks, own in read for b, y in zip(blocks, own) if len(b.text) > 40]
    for k, (blocks, own) in enumerate(read):
        main = [(b.within.tag, b.text) for b, y in zip(blocks, own) if y]
        other = [b.text for b, y in zip(blocks, own) if not y] + prose[k % max(1, len(prose)) :][:20]
        for turn in range(layouts):
            rng = random.Random(1000 * k + turn)
            start = rng.randrange(len(main)) if turn % 2 else 0
            page = leaf_blocks(laid_out(main[start : start + rng.randint(1, 12)], other, rng))
            take(page, [int(b.gold == "main") for b in page])
    return sequences, labels


def fit_tagger(
    pages: DataFrame,
    id: str = "page_id",
    html: str = "html",
    sample_pages: int = SAMPLE_PAGES,
    layouts: int = LAYOUTS,
) -> Crf:
    """The tagger fitted on at most ``sample_pages`` of the pages that mark their
    article, those of the least hash among about four times as many, and on
    ``layouts`` new layouts of each."""
    marked = F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= SAMPLE_CHARS)
    place = F.xxhash64(id, html)
    share = min(1.0, 4 * sample_pages / max(pages.count(), 1))
    drawn = (
        pages.select(F.col(html).alias("html"), place.alias("place"))
        .where(F.pmod("place", F.lit(1 << 30)) <= int(share * (1 << 30)))
        .where(marked)
        .orderBy("place", "html")
        .limit(sample_pages)
    )
    return Crf(2).fit(*training_pages([r.html for r in drawn.collect()], layouts))


def known_words(tagger: Crf) -> frozenset[str]:
    """The class words that the tagger has learnt of."""
    return frozenset(f.partition("=")[2] for f in tagger.scores if f.startswith(("class=", "nearest=")))


def main_text(html: str | None, tagger: Crf, known: frozenset[str] | None = None) -> str:
    blocks = leaf_blocks(html, known_words(tagger) if known is None else known) if html else []
    labels = tagger.decode(features(blocks))
    return " ".join(b.text for b, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, tagger: Crf, html: str = "html") -> DataFrame:
    """``pages`` without the mark-up, with its main ``text``; a column of that name
    gives way to it."""
    kept = [c for c in pages.columns if c != html and c.lower() != "text"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(tagger)
        for batch in batches:
            found = [main_text(v.as_py(), tagger, known) for v in batch.column(len(kept))]
            columns = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.string())], names=[*kept, "text"]
            )

    schema = T.StructType([pages.schema[c] for c in kept]).add("text", "string")
    return pages.select(*kept, html).mapInArrow(texts, schema)
