"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one classifies each block by itself, by its length, the share of
its characters in links and the share of stop words among its words: long with many stop words is good; linked for the
most part, or long without stop words, is bad; the others are short or near-good and so undecided. In an <article> or
<main> element linked blocks and long ones without stop words (headings, lists, tables, code) are undecided too. What
tags, roles, classes or ids mark as navigation, footer, form, advert, notice, reader comments and the like is bad as
well, and says nothing about its neighbours; inside an article only the marks that no part of an article bears count.

Pass two: an undecided block takes the label of its nearest decided neighbours before and after, at any distance. Those
of an article look at decided blocks of articles first, and are good where there is none. Where both sides differ, a
near-good block is good and a short one goes with the closer; headings go with the block that follows.

Results for odd input: null html counts as empty; a page without main text gives the empty string; repeated rows give
equal rows; an empty table gives an empty one; a column that has the name of a new one is replaced. Unclosed tags end
with the page, tags closed without being open are skipped.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import appended, field
from palimpsest.runtime import table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=\"'/>]+)")

#: Elements whose content is not text, by their own end tags only.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select xmp noembed noframes audio video".split())
#: Elements that a slash at the end of their start tag closes.
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("nav footer aside form button menu dialog fieldset head header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Parts of class names and ids, between other characters than letters.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner bottombar breadcrumb breadcrumbs byline caption captions comment comments commentlist consent cookie cookies copyright "
    "credit credits disqus discussion feedback foot footer form gdpr head header hidden legal login masthead menu meta modal nav navbar navi navigation newsletter notice notices notification overlay "
    "pager pagination paywall popup popular privacy promo promoted promotion recommend recommended related reply replies reader readers respond responses search share sharing shoutbox sidebar sidenav "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar trackback tracking warning widget widgets".split()
)
OF_ARTICLES = frozenset("ad advert comment comments promo related reply teaser widget".split())
#: Parts that count for elements inside an article.
INSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus discussion gdpr hidden login menu modal nav navbar "
    "navigation newsletter notice overlay pager pagination paywall popup promo promoted promotion recommend recommended related reply replies respond responses search share sharing sidebar sidenav "
    "signup social sponsor sponsored subscribe subscription toolbar trackback tracking widget widgets".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Common function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its me more my no not of on one only or other our out over "
    "she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais me même ne nous on ont ou où par pas plus pour qu que qui sa se ses si son sont sur tout un une vous y à été être "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat hatte ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wird wir zu zum zur "
    "al algo como con cual de del desde donde el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te un una y ya".split()
)
LETTERS = re.compile(r"[^\W\d_]+")
COPYRIGHT = re.compile(r"©|\(c\) |copyright\b", re.I)

#: Characters of a short and of a long block, link share above which a block is bad, stop-word share of good and near-good blocks.
SHORT, LONG, LINKS, NEAR_STOPS = 70, 200, 0.33, 0.20


class Block:
    __slots__ = ("heading", "inside", "label", "linked", "never", "parts")

    def __init__(self, never: bool, inside: bool, heading: bool) -> None:
        self.never, self.inside, self.heading, self.parts, self.linked, self.label = never, inside, heading, [], 0, ""


def names_never(tag: str, attributes: str, inside: int) -> bool:
    if tag in NEVER and not (tag == "header" and inside):
        return True
    words = OF_ARTICLES if tag in ("article", "main") else INSIDE if inside else WORDS
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value, bare in ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), value.strip("\"'").lower()
        if name in ("class", "id") and any(w in words for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))):
            return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def closes_itself(attributes: str) -> bool:
    """Whether a start tag ends in a slash that is not the end of an unquoted value."""
    return attributes.endswith("/") and not re.search(r"=\s*[^\s\"']\S*\Z", re.sub(r"\"[^\"]*\"|'[^']*'", '""', attributes))


def blocks_of(page: str) -> list[tuple[Block, str]]:
    """The page's blocks in order, with their text: references decoded, white space as one space, trimmed, none empty."""
    found: list[Block] = []
    open_tags: list[tuple[str, bool, bool]] = []  # tag, starts what never holds the article, starts the article
    never = inside = links = 0
    now: Block | None = None
    heading = False
    at, size = 0, len(page)

    def text(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        if now is None:
            now = Block(never > 0, inside > 0, heading)
            found.append(now)
        now.parts.append(raw)
        if links:
            now.linked += len(raw.strip())

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == tag:
                    for name, n, a in open_tags[depth:]:
                        never, inside, links = never - n, inside - a, links - (name == "a")
                    del open_tags[depth:]
                    break
            if tag not in INLINE:
                now = None
                if tag in HEADINGS:
                    heading = False
            continue
        if tag in FOREIGN and closes_itself(m[3]):
            now = None
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            if tag not in INLINE:
                now = None
            continue
        if tag not in INLINE:
            now = None
            heading = tag in HEADINGS or heading and tag == "br"
        if tag in VOID:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_tags:  # these end their own kind and what is in it
            for depth in range(len(open_tags) - 1, -1, -1):
                name = open_tags[depth][0]
                if name == tag:
                    for other, n, a in open_tags[depth:]:
                        never, inside, links = never - n, inside - a, links - (other == "a")
                    del open_tags[depth:]
                    break
                if name not in INLINE and name != "p":
                    break
        if tag == "body":
            open_tags.clear()
            never = inside = links = 0
        starts = names_never(tag, m[3], inside) if tag not in ("html", "body") else False
        article = tag in ("article", "main")
        open_tags.append((tag, starts, article))
        never, inside, links = never + starts, inside + article, links + (tag == "a")
    out = []
    for b in found:
        t = " ".join(html.unescape("".join(b.parts)).split())
        if t:
            out.append((b, t))
    return out


def classify(blocks: list[tuple[Block, str]]) -> None:
    """Pass one."""
    for b, t in blocks:
        density = b.linked / max(1, len(t))
        words = LETTERS.findall(t.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if b.never or len(t) < SHORT and COPYRIGHT.match(t) and not b.inside:
            b.label = "bad"
        elif density > LINKS:
            b.label = "short" if b.inside else "bad"
        elif len(t) < SHORT:
            b.label = "short"
        elif stops >= NEAR_STOPS:
            b.label = "good" if len(t) >= LONG else "near"
        elif len(t) >= LONG and not b.inside:
            b.label = "bad"
        else:
            b.label = "short"


def neighbours(blocks: list[tuple[Block, str]], inside: bool) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """Distance and label of the nearest decided blocks before and after each, with `inside` of those in articles; '' if there is none."""
    n = len(blocks)
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        side, at, label = [(0, "")] * n, 0, ""
        for i in order:
            side[i] = (abs(i - at), label)
            b = blocks[i][0]
            if b.label in ("good", "bad") and not b.never and (b.inside or not inside):
                at, label = i, b.label
        sides.append(side)
    return list(zip(*sides, strict=True))


def settle(blocks: list[tuple[Block, str]]) -> None:
    """Pass two: first the near-good blocks, then the short ones. What one of these steps decides is no neighbour in it."""
    for ambiguous in ("near", "short"):
        for (b, _), every, own in list(zip(blocks, neighbours(blocks, False), neighbours(blocks, True), strict=True)):
            if b.label != ambiguous:
                continue
            (i, before), (j, after) = own if b.inside else every
            if b.inside and not before and not after:
                b.label = "good"
            elif ambiguous == "near":
                b.label = "bad" if before == after == "bad" else "good"
            elif b.heading:
                b.label = after or (before if b.inside else "bad")
            elif before == after or not before or not after:
                b.label = before or after or "bad"
            else:
                b.label = before if i < j else after if j < i else "bad"


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    classify(blocks)
    settle(blocks)
    return "\n\n".join(t for b, t in blocks if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with `text` and n_chars (long, code points of the text)."""

    def make():
        def work(values):
            texts = [main_text(x) if x else "" for x in values[html_col].to_pylist()]
            return [texts, list(map(len, texts))]

        return work

    return appended(pages, [html_col], [field("text", T.StringType()), field("n_chars", T.LongType())], make, drop=(html_col,))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
