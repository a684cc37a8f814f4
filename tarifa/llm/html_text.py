"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block from its
stop-word density, its length, its link density and the containers it is in:

* in a menu, header, footer, sidebar, notice, advert, form or comment container: bad. A container is one by its element, or by a
  class, id or role all of whose parts are container words or their companions (``cookie-notice``, ``site-footer``; neither
  ``has-sidebar`` nor ``content-with-sidebar``); an article is one only as a reader's comment;
* link density over ``MAX_LINK_DENSITY``: bad;
* stop-word density of ``STOP_LOW`` or more and at least ``LONG`` characters: good;
* outside an article container, ``LONG`` or more characters of Latin script with no stop word and no
  sentence mark: bad;
* all others are ambiguous.

The second pass gives each ambiguous block the label of the nearest decided block of the same
region (an article region, or the rest of the page); of two equally near neighbours a good one
wins. A region without a decided block is good inside an article container. Where the page has no good block at all,
all of its blocks are but those of links. Where class names alone would leave out every article of a page, they are
not looked at, but for those of comments.

A form is a bad container too, unless it is around the page (an article begins in it, or most of the page's running text is in it).
A link that ends counts for all blocks within it, one that doesn't to the end of its block; an anchor without an address is none.

Both passes take time in proportion to the page, whatever its markup: a quote opens a value only after an equals sign, and one
that doesn't close is a character like others.

Edge cases: null or empty html gives an empty text; markup that never closes is closed at the end of the page, but of an
unclosed svg, video or the like only the tag is skipped, and a tag without its ``>`` is text; nothing is cut by length;
repeated rows are each extracted; an empty table gives an empty one; columns other than the three named are left out.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tarifa.llm.common import documents, table

LONG, STOP_LOW, MAX_LINK_DENSITY = 40, 0.08, 0.5

#: Function words of the languages that pages come in.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for was on as are with they be at this have from or had by not but what all were we when your
    can said there use an each which she do how their if will up other about out many then them these so some her would make like
    him into has look more see no could my than been who its now did get may i you he
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird
    bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein
    de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son lui nous comme mais on
    si leur y dont aux cette ses être fait elle
    el los las y del se por con no su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me
    hasta hay donde quien desde todo nos durante todos uno
    """.split()
)

#: Elements that are left out with all they hold. Those of _TEXT_ONLY hold no markup: unclosed, they reach to the end of the
#: page, as in browsers; of the others an unclosed tag alone is skipped. Those of _FOREIGN may close themselves.
_TEXT_ONLY = frozenset("script style noscript textarea iframe title".split())
_FOREIGN = frozenset("svg math".split())
_RAW = _TEXT_ONLY | _FOREIGN | frozenset("template select object canvas audio video".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][\w:-]*)|[!?/])")
#: Up to a tag's end or to a quote that opens a value: one right after the equals sign.
_UNQUOTED = re.compile(r"[^>=]*+(?:=(?!\s*+[\"'])[^>=]*+)*+(?:=\s*+(?=[\"']))?+")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SENTENCE = re.compile(r"[.!?:;\u2026\u3002\uff01\uff1f\uff1b\uff1a\uff0e\u061f\u06d4\u0964\u0589]")
_FOREIGN_LETTER = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff]")
_MARKS = ".,;:!?()[]{}\"'&%$*#|/<>…«»“”„-–—"

_BLOCK = frozenset(
    """
    address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary
    table tbody td tfoot th thead tr ul
    """.split()
)
#: Elements that the stack keeps; the others of _BLOCK only end a block.
_HELD = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
_BAD_TAGS = frozenset("nav footer aside dialog menu head button fieldset".split())
_BAD_PARTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted nav navbar navigation
    menu menus breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice notices notification alert banner
    comment comments commentlist disqus reply replies respond newsletter subscribe subscription signup login share sharing social
    related recommended recommendations pager pagination popup modal overlay toolbar widget widgets copyright masthead contentinfo
    complementary search tagcloud skip
    """.split()
)
_COMMENT_PARTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that may stand beside a container word in its name.
_COMPANIONS = frozenset(
    """
    area bar block body bottom box card center col column container content details div element entry field fixed footer form global group
    header head holder id inner inline item items layout left link links list main message meta module new node outer page panel post
    primary right row secondary section side site slot small sticky text thread title top unit user widget wrap wrapper
    """.split()
)
_BAD_OUTSIDE = frozenset("header top bottom".split())
_HIDDEN_CLASSES = frozenset("hidden hide invisible sr-only visually-hidden screen-reader-text".split())
_ARTICLE_NAMES = frozenset("articlebody postcontent entrycontent maincontent".split())


@dataclass
class _Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    bad: bool = False
    region: int = 0
    form: int = 0
    text: str = ""
    label: int = 0  # 1 good, -1 bad, 0 ambiguous


def _attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _named(names: str, words: frozenset[str]) -> bool:
    """Whether one of the names consists of container words and companions, one of ``words`` among them."""
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if any(p in words for p in parts) and all(p in words or p in _BAD_PARTS or p in _COMPANIONS or p.isdigit() for p in parts):
            return True
    return False


def _bad_container(tag: str, attributes: dict[str, str], in_article: bool, lenient: bool) -> bool:
    if tag in _BAD_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    classes = attributes.get("class", "")
    if attributes.get("hidden", "until-found").lower() != "until-found" or attributes.get("aria-hidden", "").lower() == "true" or _HIDING.search(attributes.get("style", "")):
        return True
    if not _HIDDEN_CLASSES.isdisjoint(classes.lower().split()):
        return True
    names = " ".join((classes, attributes.get("id", ""), attributes.get("role", ""), attributes.get("aria-label", "").replace(" ", "-")))
    if tag == "article" or lenient:
        return _named(names, _COMMENT_PARTS)
    return _named(names, _BAD_PARTS) or not in_article and not _BAD_OUTSIDE.isdisjoint(names.lower().split())


def _is_article(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("id", "").lower() == "main":
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return any(re.sub(r"[^a-z]", "", name) in _ARTICLE_NAMES for name in names)


def _tag_end(page: str, at: int, quotes: dict[str, int], dead: set[int]) -> int:
    """Where the tag's ``>`` is, -1 if all that follow lie within quoted values.

    A quote opens a value only after an equals sign; one that never closes is a character like others. ``quotes`` has the
    last place of each kind of quote, ``dead`` the opening ones from which no end is reached, so that no part of a page is read again and again.
    """
    seen = []
    while True:
        at = _UNQUOTED.match(page, at).end()
        if page.startswith(">", at):
            return at
        if at >= len(page) or at in dead:
            dead.update(seen)
            return -1
        seen.append(at)
        at = page.find(page[at], at + 1) + 1 if at < quotes[page[at]] else at + 1


def _tokens(page: str) -> Iterator[tuple[str, str | None, bool, str, int, int]]:
    """Text before a tag, the tag's name (None: a comment or the like), whether it ends, its attributes, where it stops and begins.

    The consumer may send a place from which to go on.
    """
    at, last = 0, page.rfind(">")
    quotes, dead = {q: page.rfind(q) for q in "\"'"}, set()
    while m := _OPEN.search(page, at):
        begin, tag = m.start(), m[2]
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            stop = len(page) if stop < 0 else stop + 3
            attributes = ""
        elif begin > last:
            break
        else:
            end = _tag_end(page, m.end(), quotes, dead) if tag is not None else -1
            if end < 0:
                end = page.find(">", m.end())
            attributes, stop = page[m.end() : end], end + 1
        go = yield page[at:begin], tag.lower() if tag else None, bool(m[1]), attributes, stop, begin
        at = stop if go is None else go
    yield page[at:], None, False, "", len(page), len(page)


def _blocks(page: str, lenient: bool = False) -> tuple[list[_Block], bool]:
    """Blocks of a page, and whether an article lies within a container that is bad by its name."""
    out: list[_Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, within a bad container, region, outermost form
    held: Counter[str] = Counter()
    regions, forms, link, now, lost = 0, 0, 0, _Block(), False
    whole: set[int] = set()  # forms that an article begins in
    links = [(m.start(), bool(m[1])) for m in _LINK.finditer(page)]
    ended = {place: after for (place, ends), (_, after) in zip(links, links[1:]) if not ends}  # of each link's start tag: whether an end tag is next

    def close() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = _Block(bad=stack[-1][1], region=stack[-1][2], form=stack[-1][3]) if stack else _Block()

    endless: set[str] = set()  # elements without an end tag from here on
    tokens, go = _tokens(page), None
    while True:
        try:
            piece, tag, ends, raw, at, begin = tokens.send(go)
        except StopIteration:
            break
        go = None
        if piece:
            now.parts.append(piece)
            if link:
                now.linked += len(piece.strip())
        if tag is None:
            continue
        if tag in _RAW:
            if not ends and tag not in endless and not (tag in _FOREIGN and raw.endswith("/")):
                end = _RAW_END[tag].search(page, at)
                if end:
                    go = end.end()
                elif tag in _TEXT_ONLY:
                    go = len(page)
                else:
                    endless.add(tag)
        elif tag == "a":
            # 1: to the next block at most, as it doesn't end; 2: up to its end, blocks within it too; an anchor without address is none
            link = 0 if ends or "href" not in _attributes(raw) else 2 if ended.get(begin) else 1
        elif tag == "br":
            now.parts.append(" ")
        elif tag == "button":
            close()
            now.bad = now.bad or not ends
        elif tag in _BLOCK:
            if ends:
                if held[tag]:
                    while True:
                        gone = stack.pop()[0]
                        held[gone] -= 1
                        if gone == tag:
                            break
                close()
            else:
                bad, region, form = stack[-1][1:] if stack else (False, 0, 0)
                inside = region > 0
                attributes = _attributes(raw) if raw else {}
                mine = bad or _bad_container(tag, attributes, inside, lenient)
                if tag in _HELD:
                    if not inside and _is_article(tag, attributes):
                        if mine:
                            lost = True
                        else:
                            regions += 1
                            region = regions
                            whole.add(form)
                    if tag == "form" and not form:
                        forms += 1
                        form = forms
                    stack.append((tag, mine, region, form))
                    held[tag] += 1
                    close()
                else:
                    close()
                    now.bad = mine
            link = 2 if link == 2 else 0
    close()
    if forms:
        _judge_forms(out, whole)
    return out, lost


def _judge_forms(blocks: list[_Block], whole: set[int]) -> None:
    """A form is a bad container, unless it is around the page: an article begins in it, or it holds most of the page's running text."""
    prose: Counter[int] = Counter()
    for b in blocks:
        if not b.bad:
            text = " ".join(html_lib.unescape("".join(b.parts)).split())
            if len(text) >= LONG and 2 * b.linked < len(text) and _stop_density(text) >= STOP_LOW:
                prose[b.form] += len(text)
    for b in blocks:
        if b.form and b.form not in whole and 2 * prose[b.form] <= prose.total():
            b.bad = True


def _stop_density(text: str) -> float:
    text = text.lower()
    for mark in _MARKS:
        if mark in text:
            text = text.replace(mark, " ")
    found = text.split()
    return sum(map(STOP_WORDS.__contains__, found)) / max(1, len(found))


def _good(page: str, lenient: bool) -> tuple[list[_Block], bool]:
    """Blocks with text outside bad containers, and whether every article of the page is lost to a container's name."""
    found, lost = _blocks(page, lenient)
    kept = []
    for b in found:
        raw = "".join(b.parts)
        b.text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
        if b.text and not b.bad:
            kept.append(b)
    return kept, lost and not any(b.region for b in kept)


def _inherit(labels: list[int]) -> list[int]:
    """Each 0 replaced by the nearest other label, the good one of two equally near; all 0 stays."""
    near = [(len(labels) + 1, 0)] * len(labels)
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        away, label = len(labels) + 1, 0
        for i in order:
            away, label = (0, labels[i]) if labels[i] else (away + 1, label)
            if label and (away, -label) < (near[i][0], -near[i][1]):
                near[i] = (away, label)
    return [label for _, label in near]


def extract(page: str | None) -> str:
    """Main text: the good blocks in page order, joined by one space."""
    if not page:
        return ""
    kept, lost = _good(page, False)
    if lost:
        kept, _ = _good(page, True)
    article = any(b.region for b in kept)
    regions: dict[int, list[_Block]] = {}
    for b in kept:
        if article and not b.region:
            b.label = -1
            continue
        regions.setdefault(b.region, []).append(b)
        n = len(b.text)
        if b.linked > MAX_LINK_DENSITY * n:
            b.label = -1
        elif n >= LONG:
            density = _stop_density(b.text)
            if density >= STOP_LOW:
                b.label = 1
            elif not b.region and not density and not _SENTENCE.search(b.text) and not _FOREIGN_LETTER.search(b.text):
                b.label = -1
    for region, own in regions.items():
        for b, label in zip(own, _inherit([b.label for b in own])):
            b.label = label or (1 if region else 0)
    if not any(b.label > 0 for b in kept):
        for b in kept:
            b.label = 1 if b.linked <= MAX_LINK_DENSITY * len(b.text) and (b.region or not article) else -1
    return " ".join(b.text for b in kept if b.label > 0)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = documents(pages, (page_id, url, html)).toDF("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op4_html(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
