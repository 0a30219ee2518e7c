"""Main-text extraction: the maximum-scoring run of a page's blocks.

A page is a sequence of words and tags. Words score positive and tags negative, by log odds learned from labelled pages:
how often a word or tag of that kind lies in the main text, against how often it lies outside. A word's kind is where it stands: in what element, in a
long or short block, in a link, before or after the first heading, in a notice of rights, and where names put it, if the page names its parts. One linear scan over the blocks
finds the contiguous run with the highest score; where none is above zero, that is the whole page. The run then grows to all blocks of the
smallest element that holds it, if that is less than the page's body, and parts that are marked as something else
(menus, headers, footers, sidebars, notices, adverts, forms, comments) are left out.

Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds in page
order. Null or empty pages give an empty text. Truncated pages and unclosed tags are read as browsers do. Rows are independent:
ties, repeats, very long pages and further columns need nothing more; columns named text or n_chars are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

# Names of HTML.
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("noscript template iframe object svg math canvas audio video select button".split())
#: Skipped elements out of which no end tag reaches, those that end raw text inside them, and parts of drawings and formulas that hold HTML.
CLOSED = frozenset("noscript template iframe object select".split())
FOREIGN = frozenset("svg math".split())
POINTS = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
#: Tags that end a drawing or formula, and tags that end a skipped element without an end tag.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav aside footer form dialog menu fieldset head".split())
MAIN = frozenset("article main".split())
#: Parts of a class, id or role that mark what is not the main text, those that do so even on an article, headers, and what is the main text.
STRONG = (
    r"ads?|ad(?:box|slot|unit|space|wrap\w*|container)|advert\w*|adsense|sponsor\w*|promo\w*|\w*comment\w*|respond|responses?|repl(?:y|ies)|discussions?|disqus\w*|reviews?|feedback|related|recommend\w*|teasers?"
)
MARKED_NAMES = (
    STRONG + r"|side-?bar\w*|side|rail|aside|(?:top|main|site|sub|foot)?(?:nav|menu)(?:bar|igation|s|list|item|links)?|breadcrumbs?|footer|footnav|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|disclaimer|announcement|paywall|toast"
    r"|newsletter|subscri\w*|signup|sign-up|login|search\w*|share\w*|sharing|social\w*|widgets?|popup|pop-up|modal|overlay|pagination|pager|copyright|legal|skip|complementary|navigation|contentinfo|form|banner"
)
_part = lambda names: re.compile(rf"(?:^|[_-])(?:{names})(?=$|[_-])", re.I)
MARKED, MARKED_ARTICLE, HEADER, CONTENT = map(_part, (MARKED_NAMES, STRONG, "header|banner|branding|logo", r"main|article\w*|content|post|entry|story|body|text"))
#: Names that only tell that something is or isn't elsewhere.
ABOUT = re.compile(r"(?:has|with|no|without|is|not)-", re.I)
#: What hides an element: a whole name, an attribute, a style.
HIDDEN_NAME = re.compile(r"(?:visually-?)?hidden", re.I)
HIDDEN_STYLE = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Node:
    name: str
    parent: Node | None
    skip: bool
    main: bool  # in the main text's element, by name
    own: bool  # is such an element itself
    depth: int
    dead: bool = False  # in a skipped element, or one itself
    shut: bool = False  # a skipped element that has its end tag
    loose: bool = False  # a skipped element that has none


@dataclass
class Tag:
    begin: int
    end: int
    name: str
    closes: bool = False
    attributes: str = ""
    alone: bool = False  # has no content: raw text that is left out, or closed by itself in a drawing or formula
    breaks: int = 0  # how many drawings and formulas it ends
    shut: bool = False  # a skipped element's start whose end follows


@dataclass
class Block:
    node: Node
    text: list[str] = field(default_factory=list)
    linked: int = 0
    words: int = 0
    tags: list[str] = field(default_factory=list)
    place: str = "without"  # a first or second heading on the page; before it, or after


def tags(page: str) -> list[Tag]:
    """The page's tags and comments (without a name) in order. Raw text goes with its start tag, to its end tag or else the end of the page."""
    out: list[Tag] = []
    unclosed: dict[str, list[Tag]] = {}
    inside: list[str] = []  # drawings, formulas and the parts of them that hold HTML
    at = 0
    while m := TOKEN.search(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        t = Tag(m.start(), at, name, bool(m[1]), m[3] or "")
        out.append(t)
        if t.closes:
            if name in inside:
                while inside.pop() != name:
                    pass
            if unclosed.get(name):
                unclosed[name].pop().shut = True
            continue
        foreign = bool(inside) and inside[-1] in FOREIGN
        if foreign and name in BREAKOUT:
            while inside and inside[-1] in FOREIGN:
                inside.pop()
                t.breaks += 1
            foreign = False
        t.alone = (foreign or name in FOREIGN) and t.attributes.endswith("/")
        if name in RAW and not t.alone:
            bounds = [x for x in ("noscript", "iframe") if unclosed.get(x)] + [x for x in inside if x in FOREIGN]
            stop = rf"|(?=</(?:{'|'.join(bounds)})[\s/>])" if bounds else ""
            found = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z){stop}", re.I).search(page, at)
            at = t.end = found.end() if found else len(page)
            t.alone = True
        elif not t.alone:
            if name in FOREIGN or inside and name in POINTS:
                inside.append(name)
            if name in SKIPPED:
                unclosed.setdefault(name, []).append(t)
    return out


def _hidden(attributes: str) -> bool:
    for name, x, y, z in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), x or y or z
        if name == "hidden" or name == "style" and HIDDEN_STYLE.search(value) or name == "aria-hidden" and value.strip().lower() == "true":
            return True
    return False


def _open(name: str, attributes: str, parent: Node, shut: bool = False) -> Node:
    """A new element. A name that marks something else counts unless another of the element's names is one of the main text's."""
    if parent.dead or name in SKIPPED:
        begins = name in SKIPPED
        return Node(name, parent, True, parent.main, False, parent.depth + 1, True, begins and shut, begins and not shut)
    named = [t for x, y, z in NAMED.findall(attributes) for t in (x or y or z).split() if not ABOUT.match(t)] if attributes else []
    content = any(CONTENT.search(t) and not MARKED.search(t) for t in named)
    main = name in MAIN or name in ("div", "section", "td") and content
    inside = parent.main or main
    skip = parent.skip or name in ASIDE or not parent.main and (name == "header" or any(HEADER.search(t) for t in named) and not content)
    if name in MAIN:
        skip = skip or any(MARKED_ARTICLE.search(t) for t in named)
    elif name not in ("html", "body"):
        skip = skip or not content and any(MARKED.search(t) for t in named) or any(HIDDEN_NAME.fullmatch(t) for t in named) or bool(attributes and _hidden(attributes))
    return Node(name, parent, skip, inside, main, parent.depth + 1)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with the tags that stand before each."""
    at = root = Node("", None, False, False, False, 0)
    out, now, last = [], Block(root), 0

    def say(text: str) -> None:
        if text and not at.dead:
            now.text.append(text)
            n = len(text.split())
            now.words += n
            x = at
            while x is not None and x.name in INLINE:
                if x.name == "a":
                    now.linked += n
                    break
                x = x.parent

    def cut(tag: str) -> None:
        nonlocal now
        if now.words:
            out.append(now)
            now = Block(at)
        now.node = at
        if tag:
            now.tags.append(tag)

    for m in tags(page):
        say(page[last : m.begin])
        last = m.end
        name = m.name
        if not name:
            continue
        if m.closes and name != "br":
            x = at
            while x is not None and x.name != name:
                x = None if x.shut and x.name in CLOSED else x.parent
            if x is not None and x.dead:
                at = x.parent
            elif x is not None and x.parent is not None:
                if name in INLINE:
                    block_between, y = False, at
                    while y is not x:
                        block_between, y = block_between or y.shut or y.name not in INLINE and not y.dead, y.parent
                    if not block_between:
                        at = x.parent
                else:
                    at = x.parent
                    cut("/" + name)
            continue
        for _ in range(m.breaks):
            x = at
            while x is not None and x.name not in FOREIGN:
                x = x.parent
            at = x.parent if x is not None else at
        if at.dead and name in BLOCKS:
            x = at  # it ends the skipped elements that have no end tag
            while x.dead and not x.shut:
                if x.loose:
                    at = x.parent
                x = x.parent
        if name == "br":
            if not at.dead:
                now.text.append(" ")
            continue
        if m.alone:
            continue
        if at.dead or name in SKIPPED:
            if name not in VOID:
                at = _open(name, "", at, m.shut)
            continue
        if name not in INLINE:
            x = at  # an open paragraph ends where a block begins
            while x is not None and x.name in INLINE:
                x = x.parent
            if x is not None and x.name == "p":
                at = x.parent
            elif x is not None and x.name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                at = x.parent
            cut(name)
        if name not in VOID:
            at = _open(name, m.attributes, at)
            if name not in INLINE:
                now.node = at
    if not page[last:].startswith("<"):
        say(page[last:])
    if now.words:
        out.append(now)
    if (first := next((k for k, b in enumerate(out) if b.node.name in ("h1", "h2")), None)) is not None:
        for k, b in enumerate(out):
            b.place = "before" if k < first else "after"
    return out


#: Kinds of elements that hold words, and words from which on a block is long.
HOLDERS = {"p": "p", "blockquote": "p", "li": "li", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "pre": "pre", **{f"h{n}": "h" for n in range(1, 7)}}
LONG = 15
#: How a notice of rights begins.
NOTICE = re.compile(r"\s*(?:©|&copy;|&#169;|&#xa9;|\(c\)\s|copyright\b)", re.I)


def features(b: Block) -> Counter[str]:
    """How many words and tags of each kind a block has: words by where names put them, by the element and length of their block (or as a notice of rights),
    by whether they are links, and by whether they come before the page's first heading; tags by their name."""
    where = "skip" if b.node.skip else "main" if b.node.main else "page"
    shape = "notice" if NOTICE.match("".join(b.text)) else f"{HOLDERS.get(b.node.name, 'div')} {'long' if b.words >= LONG else 'short'}"
    out = Counter({f"word {where}": b.words - b.linked, f"linked word {where}": b.linked, f"in {shape}": b.words - b.linked, f"linked in {shape}": b.linked, f"at {b.place}": b.words})
    for t in b.tags:
        out[f"tag {t}" if t.lstrip("/") in KNOWN_TAGS else "tag other"] += 1
    return +out


KNOWN_TAGS = frozenset("p div section article main header footer nav aside ul ol li table tr td form h1 h2 h3 h4 blockquote pre body html".split())


def labelled_pages() -> Iterator[tuple[str, str]]:
    """Small pages of common layouts, with the main text of each: blocks between the marks of each template. Half of the layouts name nothing."""
    prose = [
        "The council agreed on the new bridge after two long evenings of talks, and the mayor thanked all who had come.",
        "Work begins in spring, and the old crossing stays open until it is done, with one lane for cars and one for bicycles.",
        "Residents had asked for a wider path for some years.",
        "It will cost less than the first plan, said the mayor, because the old piers can carry the new deck for many years.",
        "Trains run as usual.",
    ]
    shells = [
        ("<html><head><title>{h}</title></head><body><nav><ul>{menu}</ul></nav><article><h1>{h}</h1>", "</article><footer><p>Copyright 2020 All rights</p></footer></body></html>"),
        ("<html><body><div><a href=/>Home</a> <a href=/a>News</a> <a href=/b>Contact us</a></div><div><h1>{h}</h1>", "</div><div><ul>{menu}</ul></div><div>Terms of use</div></body></html>"),
        ("<body><table><tr><td><ul>{menu}</ul></td><td><h2>{h}</h2>", "</td></tr></table><p><a href=/c>Back</a></p></body>"),
        ("<body><header><a href=/>Site</a></header><main><h1>{h}</h1>", "</main><aside><h3>More</h3><ul>{menu}</ul></aside><form>Sign up <input></form><footer>Imprint</footer></body>"),
        ("<body><ul>{menu}</ul><div id=content><h1>{h}</h1>", "</div><div class=comments><p>Nice one, thanks for the article</p><p>I don't agree</p></div><div>{menu}</div></body>"),
        ("<body><div><ul>{menu}</ul></div><div>{ad}</div><div><h1>{h}</h1>", "</div><div>{foot}</div></body>"),
        ("<body><ul>{menu}</ul><div>{ad}</div><div><div>{ad}</div></div><div><h1>{h}</h1>", "</div><div>{foot}</div><div>{ad}</div></body>"),
        ("<body><div><a href=/>Home</a> <a href=/x>Plans</a></div><div>{ad} <a href=/y>More</a></div><div><h2>{h}</h2>", "</div><div>{ad}</div><div><a href=/t>Terms</a> {foot}</div></body>"),
    ]
    for n, (before, after) in enumerate(shells * 3):
        menu = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(4 + n % 5))
        paragraphs = prose[: 2 + n % 4]
        wrap = ["<p>{}</p>", "<p>{}", "<div>{}</div>"][n // len(shells)]
        fill = {"h": "A bridge for the town", "menu": menu, "ad": "Order the new bicycle now and save.", "foot": "Copyright 2020 The Bridge Courier, all rights reserved."}
        yield before.format(**fill) + "".join(wrap.format(p) for p in paragraphs) + after.format(**fill), "\n".join(["A bridge for the town", *paragraphs])


#: Groups of kinds; odds are taken inside each.
GROUPS = ("word", "linked word", "in", "linked in", "at", "tag")


def _group(kind: str) -> str:
    return next(g for g in sorted(GROUPS, key=len, reverse=True) if kind.startswith(g + " "))


def learn(pages: Iterable[tuple[str, str]], smoothing: float = 0.5) -> dict[str, float]:
    """Log odds of each kind of word and tag among words, or tags; those of words lie between -4 and 4, of tags between -2 and -0.1."""
    inside, outside = Counter(), Counter()
    for page, text in pages:
        wanted = set(text.split("\n"))
        for b in blocks(page):
            (inside if block_text(b) in wanted else outside).update(features(b))
    total = {(g, side): sum(n for k, n in c.items() if _group(k).split()[-1] == g.split()[-1]) for g in GROUPS for side, c in (("in", inside), ("out", outside))}
    out = {}
    for kind in {*inside, *outside}:
        g = _group(kind)
        odds = math.log((inside[kind] + smoothing) / (total[g, "in"] + 1)) - math.log((outside[kind] + smoothing) / (total[g, "out"] + 1))
        out[kind] = min(-0.1, max(-2.0, odds)) if g == "tag" else max(-4.0, min(4.0, odds))
    return out


def block_text(b: Block) -> str:
    return " ".join(entities.unescape("".join(b.text)).split())


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the highest sum: where it begins and ends; the first and longest of equals; (0, 0) if no sum is positive."""
    best, where, total, begin = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, begin = 0.0, k
        total += s
        if total > best or total == best and where[0] == begin and where[1]:
            best, where = total, (begin, k + 1)
    return where


_weights: list[dict[str, float]] = []


def default_weights() -> dict[str, float]:
    if not _weights:
        _weights.append(learn(labelled_pages()))
    return _weights[0]


def _common(a: Node, b: Node) -> Node:
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    weights = default_weights() if weights is None else weights
    found = blocks(page) if page else []
    scores = [sum(n * weights.get(kind, -0.5) for kind, n in features(b).items()) for b in found]
    begin, end = best_run(scores)
    if begin == end:  # nothing scores above zero: all that nothing marks
        begin, end = 0, len(found)
    run = [b for b in found[begin:end] if not b.node.skip]
    if any(b.node.main for b in run):
        run = [b for b in run if b.node.main]
    if run:
        holder = run[0].node
        for b in run[1:]:
            holder = _common(holder, b.node)
        while holder.main and not holder.own:  # up to the element that is named as the main text's
            holder = holder.parent
        if holder.name not in ("", "html", "body"):
            run = []
            for b in found:
                x = b.node
                while x.depth > holder.depth:
                    x = x.parent
                if x is holder and not b.node.skip:
                    run.append(b)
    return "\n".join(t for b in run if (t := block_text(b)))


def extract(df: DataFrame, html: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """df without its html and with the main text and its number of code points."""
    ship(df.sparkSession)
    weights = default_weights() if weights is None else weights
    drop = (html, "text", "n_chars")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [main_text(p, weights) for p in b.column(b.schema.names.index(html)).to_pylist()]
                kept = [n for n in b.schema.names if n not in drop]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)) for n in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    return df.mapInArrow(run, df.drop(*drop).schema.add("text", "string").add("n_chars", "long"))
