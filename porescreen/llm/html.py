"""Main text of web pages: blocks classified by rules, short ones by their neighbours."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porescreen.llm.common import text_of

# Frequent words of English, German, French and Spanish, whose share tells prose from lists of names.
STOP_WORDS = frozenset((
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die das und in zu den ist von mit des auf für im ein eine nicht dem sich als auch es an werden aus er hat dass "
    "le la les de des et un une en du que qui dans est pour pas par sur au avec ce il plus se ne son "
    "el los las del y en que una por con para su se no lo al como más es un o").split())
# Elements of HTML by their role.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template", "select", "object", "math", "xmp")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARGINAL = frozenset("nav footer aside form button dialog menu head".split())
ARTICLE = frozenset("article main".split())
# Parts of class, id and role names that mark what surrounds an article.
MARGINAL_NAMES = frozenset((
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead header comment comments reply replies disqus respond cookie "
    "cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login search share "
    "sharing social related recommended widget toolbar pagination pager copyright legal complementary contentinfo").split())
#: Of these, names that count however much of the page an element holds.
COMMENT_NAMES = frozenset("comment comments reply replies disqus respond".split())
#: Elements that end when one of the same kind begins.
SIBLINGS = frozenset("p li dt dd tr td th option".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Link share above which a block is no prose; characters below which a block is short; share of stop words of prose.
LINKS, SHORT, STOPS = 0.5, 70, 0.12
GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    inside: bool
    marginal: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    label: int = OPEN
    text: str = ""
    within: tuple[int, ...] = ()


def _marginal_names(attributes: str) -> set[str]:
    """The parts of class, id and role that mark what surrounds an article."""
    found = set()
    for value in _NAMES.findall(attributes):
        for name in "".join(value).replace("-", " ").replace("_", " ").split():
            found.update(p.lower() for p in _PART.findall(name))
    return found & MARGINAL_NAMES


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order: runs of text that no block element interrupts.

    An element that is marginal by its name alone is not so if it holds an article, or two thirds of the text of a page
    that has no article elsewhere."""
    out: list[Block] = []
    # Element, within something marginal, within an article, numbers of the elements around it that a name marks.
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []
    named: list[tuple[bool, bool]] = []  # of each such element: whether it holds comments, and an article
    current: Block | None = None
    links, at = 0, 0

    def add(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        text = unescape(raw)
        if current is None:
            if not text.strip():
                return
            top = stack[-1] if stack else ("", False, False, ())
            current = Block(top[2], top[1], any(re.fullmatch("h[1-6]", s[0]) for s in stack[-3:]), within=top[3])
            out.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    while at < len(html):
        found = _TOKEN.search(html, at)
        if not found:
            add(html[at:])
            break
        add(html[at:found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1]), found[3] or ""
        if name == "br":
            add(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        if name not in INLINE:
            current = None
            links = 0 if closing else links
        if name in RAW and not closing and not attributes.rstrip().endswith("/"):
            end = _RAW_ENDS[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name not in INLINE:
            while stack and stack[-1][0] in INLINE:
                stack.pop()
            if name in SIBLINGS and stack and stack[-1][0] == name:
                stack.pop()
        _, marginal, inside, within = stack[-1] if stack else ("", False, False, ())
        own = name in MARGINAL or (name == "header" and not inside) or bool(_HIDDEN.search(attributes))
        if name in ARTICLE and not own:
            for k in within:
                named[k] = named[k][0], True
        marks = set() if name in ("html", "body", "main") else _marginal_names(attributes) - ({"header"} if inside else set())
        if marks:
            within = (*within, len(named))
            named.append((bool(marks & COMMENT_NAMES), False))
        stack.append((name, marginal or own, inside or (name in ARTICLE and not own and not (marks & COMMENT_NAMES)), within))
    for block in out:
        block.text = " ".join("".join(block.parts).split())
    out = [b for b in out if b.text]
    held, total = [0] * len(named), sum(len(b.text) for b in out if not b.marginal)
    for block in out:
        for k in () if block.marginal else block.within:
            held[k] += len(block.text)
    articles = any(b.inside and not b.marginal and not b.within for b in out)
    counts = [comments or not (article or (3 * size >= 2 * total and not articles)) for (comments, article), size in zip(named, held)]
    for block in out:
        block.marginal = block.marginal or any(counts[k] for k in block.within)
    return out


def classify(page: list[Block]) -> None:
    """First pass: blocks that their own features decide. Second pass: the others follow the nearest decided ones."""
    prose = [(b.inside, len(b.text)) for b in page if not b.marginal and b.linked <= LINKS * max(1, sum(map(len, b.parts)))]
    # What stands outside an article is left out only if the article holds half of the prose.
    held = sum(n for inside, n in prose if inside)
    has_article = 0 < held and 2 * held >= sum(n for _, n in prose)
    for b in page:
        words = b.text.lower().split()
        stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))
        linked = b.linked / max(1, sum(map(len, b.parts)))
        if b.marginal or linked > LINKS or (has_article and not b.inside):
            b.label = BAD
        elif len(b.text) >= SHORT:
            b.label = GOOD if stops >= STOPS or b.inside else BAD if stops < STOPS / 3 else OPEN
        elif not b.inside and linked > 0:
            b.label = BAD
    decided = [b.label for b in page]
    everywhere = _nearest(decided, [True] * len(page))
    # Neighbours of the same article only: what surrounds it was decided by being outside.
    within = _nearest(decided, [b.inside and not b.marginal for b in page])
    for i, b in enumerate(page):
        if decided[i] != OPEN:
            continue
        before, after = (within if b.inside else everywhere)[i]
        near = [k for k in (before, after) if k is not None]
        if not near:
            b.label = GOOD if b.inside or not any(decided) else BAD
        elif b.heading and after is not None:
            b.label = decided[after]
        else:
            least = min(abs(k - i) for k in near)
            b.label = max(decided[k] for k in near if abs(k - i) == least)


def _nearest(decided: list[int], counts: list[bool]) -> list[tuple[int | None, int | None]]:
    """For each block the nearest decided ones before and after it, of those that count."""
    before, after, last = [], [None] * len(decided), None
    for i, label in enumerate(decided):
        before.append(last)
        last = i if label != OPEN and counts[i] else last
    last = None
    for i in range(len(decided) - 1, -1, -1):
        after[i] = last
        last = i if decided[i] != OPEN and counts[i] else last
    return list(zip(before, after))


def main_text(html: str) -> str:
    page = blocks(html)
    classify(page)
    return " ".join(b.text for b in page if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from the whole html.

    Null or empty html, and pages without main text, give the empty text and 0. Repeated pages and pages without an
    id come back like any others; other columns are ignored; an empty table gives no rows. Broken markup never fails:
    an element that is not closed ends with its parent, an unfinished tag or comment with the page.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in text_of(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
