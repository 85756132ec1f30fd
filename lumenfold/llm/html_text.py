"""Main text of web pages by two passes over blocks: stop words, length and links, then the nearest decided neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words by language; a page whose language is not among them is held against all.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este".split(),
}
_LISTS = {k: frozenset(v) for k, v in STOP_WORDS.items()}
_LISTS[""] = frozenset().union(*_LISTS.values())

#: Elements that stand in a line of text; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page; up to their end tag no tag counts.
RAW = frozenset("script style title textarea noscript template iframe svg xmp noembed noframes math object audio video canvas".split())
#: Elements that hold no main text, whatever stands in them.
ASIDE = frozenset("nav footer aside form menu dialog select option button fieldset head".split())
MAIN = frozenset(("article", "main"))
#: Words of classes and ids, roles: of parts that hold no main text. Weak ones do not count beside a word of GOOD.
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion comment comments "
    "disqus reply replies respond sidebar cookie cookies consent gdpr popup modal overlay nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe signup login "
    "pagination pager toolbar copyright disclaimer search contentinfo complementary hidden".split()
)
WEAK = frozenset("header banner notice notices alert widget tags teaser promo toc".split())
GOOD = frozenset("article content main body post entry story text".split())

#: A tag; where a quote is never closed, one that ends at the first sign.
_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>")
_LOOSE_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*)>|<[!?/][^>]*>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|lang)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|$)", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")

#: First pass. Blocks of at most SHORT characters are left to their neighbours unless something speaks against them.
SHORT, MOST_LINKS, STOPS_LOW, STOPS_INSIDE = 70, 0.33, 0.12, 0.04
BAD_BLOCK, OPEN_BLOCK, GOOD_BLOCK = -1, 0, 1


def _against(name: str, rest: str, inside: bool) -> bool:
    """Does what the element is called speak against its content? inside: within an article."""
    if name in ASIDE or (name == "header" and not inside):
        return True
    if not rest or name in ("html", "body"):
        return False
    words = set()
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif key != "lang":
            words.update(x.lower() for x in _NAME_PART.findall(value))
    return bool(words & BAD) or bool(words & WEAK and not words & GOOD and not (inside and "header" in words))


def cut(html: str) -> Iterator[tuple[str, int, bool, bool, int]]:
    """text, characters in links, against, inside an article, number of its container: the blocks of a page in order.

    Time is in proportion to the page's length: an end that was once not found is not looked for again.
    """
    stack, opened, bad, inside, links = [], {}, 0, 0, 0
    pieces, linked, numbers = [], 0, count(1)
    missing, at, n, tag = set(), 0, len(html), _TAG

    def shut(until: str) -> None:
        nonlocal bad, inside, links
        while stack:
            name, was_bad, _ = stack.pop()
            opened[name] -= 1
            bad -= was_bad
            inside -= name in MAIN
            links -= name == "a"
            if name == until:
                return

    def flush() -> Iterator[tuple[str, int, bool, bool, int]]:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            yield text, linked, bad > 0, inside > 0, stack[-1][2] if stack else 0
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw)
            pieces.append(text)
            if links:
                linked += len(" ".join(text.split()))

    def beyond(mark: str, start: int, fold: bool = False) -> int:
        """Where mark ends after start, or the page's end."""
        if mark in missing:
            return n
        if fold:
            found = re.compile(mark + r"(?=[\s/>])[^>]*>?", re.I).search(html, start)
            if found:
                return found.end()
        elif (place := html.find(mark, start)) >= 0:
            return place + len(mark)
        missing.add(mark)
        return n

    while at < n:
        sign = html.find("<", at)
        say(html[at : sign if sign >= 0 else n])
        if sign < 0:
            break
        at = sign + 4
        if html.startswith("<!--", sign):
            at = beyond("-->", at - 2 if html.startswith(">", at) else at)
            continue
        if not re.match(r"[a-zA-Z!?/]", html[sign + 1 : sign + 2]):
            pieces.append("<")
            at = sign + 1
            continue
        token = tag.match(html, sign)
        if not token and tag is _TAG:
            tag = _LOOSE_TAG
            token = tag.match(html, sign)
        if not token:  # the page ends within a tag
            break
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not token["end"] and not token["rest"].endswith("/"):
                at = beyond("</" + name, at, True)
            if name not in INLINE:
                pieces.append(" ")
            continue
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                pieces.append(" " if name == "br" else "")
                continue
        else:
            yield from flush()
        if token["end"]:
            if opened.get(name):
                if name in INLINE and stack[-1][0] != name:
                    # an inline end tag closes its element only if no block began within it
                    depth = next((k for k in range(1, min(len(stack), 8) + 1) if stack[-k][0] == name), 0)
                    if not depth or any(stack[-k][0] not in INLINE for k in range(1, depth)):
                        continue
                shut(name)
            continue
        if name in VOID or token["rest"].endswith("/"):
            continue
        if name not in INLINE and opened.get("p"):
            shut("p")
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            shut(name)
        was_bad = _against(name, token["rest"], inside > 0)
        if name in MAIN:
            while stack and bad and any(x[0] in ("nav", "header", "form") and x[1] for x in stack[-3:]):
                shut(stack[-1][0])
            inside += 1
        stack.append((name, was_bad, next(numbers) if name not in INLINE and name != "p" and name[0] != "h" else (stack[-1][2] if stack else 0)))
        opened[name] = opened.get(name, 0) + 1
        bad += was_bad
        links += name == "a"
    yield from flush()


def language(html: str) -> str:
    found = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", html, re.I)
    return found[1].lower() if found and found[1].lower() in STOP_WORDS else ""


def judged(html: str) -> list[tuple[str, float, float, int, bool]]:
    """text, link density, stop-word density, first label, kept: each block of a page.

    First pass: a block is bad in a part that is no main text by its element, class, role or hiddenness, outside of the
    article where the page has one, behind a copyright sign, or if over a third of it is links. It is good if it is
    longer than SHORT and has enough stop words (fewer are asked for inside an article). The rest is left open.
    Second pass: an open block takes the label of the nearest decided block; one in its own container counts as nearer
    than any other, and of two at the same distance the good one counts. Where nothing at all is decided good, open
    blocks of an article are good, others bad.
    """
    stops = _LISTS[language(html)]
    blocks = list(cut(html))
    has_main = any(b[3] and not b[2] for b in blocks)
    told = []
    for text, linked, against, inside, where in blocks:
        words = _WORD.findall(text.lower())
        density = sum(map(stops.__contains__, words)) / max(1, len(words))
        links = linked / len(text)
        if against or links > MOST_LINKS or text[0] == "©" or (has_main and not inside):
            label = BAD_BLOCK
        elif len(text) <= SHORT:
            label = BAD_BLOCK if linked and not inside else OPEN_BLOCK
        else:
            label = GOOD_BLOCK if density >= (STOPS_INSIDE if inside else STOPS_LOW) else OPEN_BLOCK
        told.append((text, links, density, label, inside, where))
    before, after = _nearest(told), _nearest(told[::-1])[::-1]
    out = []
    for k, (text, links, density, label, inside, _) in enumerate(told):
        if label == OPEN_BLOCK:
            near = [x for x in (before[k], (after[k][0], len(told) - 1 - after[k][1], after[k][2]) if after[k] else None) if x]
            best = min((not same, abs(k - place), -said) for said, place, same in near) if near else None
            kept = -best[2] == GOOD_BLOCK if best and (-best[2] == GOOD_BLOCK or not inside) else inside
        else:
            kept = label == GOOD_BLOCK
        out.append((text, links, density, label, kept))
    return out


def _nearest(told: list[tuple]) -> list[tuple[int, int, bool] | None]:
    """label, place, in the same container: of the last decided block before each block, one in its container first."""
    last, here, out = None, {}, []
    for k, (*_, label, _, where) in enumerate(told):
        own = here.get(where)
        out.append((*own, True) if own else (*last, False) if last else None)
        if label != OPEN_BLOCK:
            last = here[where] = (label, k)
    return out


BLOCK = "struct<text: string, links: double, stops: double, label: int, kept: boolean>"


def extract(pages: DataFrame, rows: int = 200) -> DataFrame:
    """page_id, url, blocks, text, n_chars for each row of pages (page_id, url, html).

    blocks are those of judged(), in page order; text joins the kept ones by line feeds, and n_chars counts its code
    points. Markup goes, character references are decoded, white space within a block becomes one space. A null or empty
    page, or one without main text, has an empty text. Pages are cut where they are read, `rows` at once, without a
    shuffle; repeated rows give repeated rows, null ids stay null, further columns are ignored, an empty table is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("links", pa.float64()), ("stops", pa.float64()), ("label", pa.int32()), ("kept", pa.bool_())]))
        keys = [f.name for f in kind.value_type]
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                found = [[dict(zip(keys, b, strict=True)) for b in judged(h.as_py() or "")] for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], names=["page_id", "url", "blocks"])

    kinds = dict(pages.dtypes)
    cut_up = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, blocks array<{BLOCK}>")
    kept = F.transform(F.filter("blocks", lambda b: b["kept"]), lambda b: b["text"])
    return cut_up.withColumn("text", F.array_join(kept, "\n")).withColumn("n_chars", F.length("text").cast("long"))
