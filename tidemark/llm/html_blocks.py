"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line that belongs to page furniture (menus,
headers, footers, sidebars, notices, adverts, forms, comments; told by element, role, class or id) has no length
and leaves a gap. An element that has more than half of the page's text outside links, and in it the page's
article, main or h1 element or some lines, is no furniture, whatever it is called; neither are elements called comments if
no sentence stands outside furniture. Only hidden elements and controls never are text. Lengths are summed over a sliding window of lines; a run of windows with text starts at a surge
point and ends at a dive point. The body is the deepest element that has more than half of the page's text outside
links, or the article or main element around it. The main text goes from the surge of the first to the dive of the last
run that is of the body or reads like text: no more than half of it stands in links, and it has a dense window, a
sentence or words that lie in the page itself where no element is the body. No run is judged by its share of another, and
lines between are kept whole, short ones too. Left out are runs outside the body that are links mostly, or a few words.

Pages are judged each on its own inside a task, in time and memory that grow with their length: there is no shuffle, and
memory is bounded by the longest page.

Defined cases: a null page counts as empty; a page without text gives an empty string; unclosed and stray tags are
tolerated, and what follows the last ``>`` is text; repeated rows are extracted alike; other columns pass through, and an
input column ``text`` or ``n_chars`` is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SOME = 4  # lines of an element that is called furniture and holds the text
DENSE = 80  # characters outside links of a window that is text, wherever it stands
#: Elements by what they do to the text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br meta link input area base col embed param source track".split()
)
BOXES = frozenset("article main section div td center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe math object".split())
FURNITURE = frozenset("head nav footer aside form button select dialog menu fieldset canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements that are never the text, however much they hold.
HIDDEN = frozenset("head button select dialog canvas audio video".split())
#: Words of class and id that mark furniture: what readers wrote; the others; those that a word of CONTENT beside
#: them overrules.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr "
    "sidebar newsletter breadcrumb breadcrumbs navbar navigation pagination pager popup modal".split()
)
WEAK = frozenset(
    "nav menu header footer masthead banner notice notices alert share sharing social related recommended widget login signup "
    "subscribe subscription form search toolbar legal copyright disclaimer outbrain taboola hidden aside".split()
)
CONTENT = frozenset("content article main body post story entry text".split())
#: Classes that say what an element is about or has beside it, not what it is.
_ABOUT = re.compile(r"(?:has|with|no|category|tag|show|hide|allow|enable)-\S*|\S*-(?:open|closed|enabled|disabled|allowed|on|off)")
NO, SOFT, END, TALK, HARD = range(5)

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag: a quote counts where it follows an equals sign and is closed.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: One attribute after the other: a name, and a value with or without quotes.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_LETTER = re.compile(r"\w")


def furniture(name: str, attributes: str, inside: bool) -> int:
    """What an element is: NO furniture, SOFT (unless it holds most of the text), END (the same, but it has to hold an article or h1,
    too), TALK (what readers wrote, unless it holds most of the text and a heading, or nothing else reads like text) or HARD."""
    if name in HIDDEN:
        return HARD
    found = END if name in ("nav", "footer", "aside", "menu") else SOFT if name in FURNITURE or (name == "header" and not inside) else NO
    if not attributes or name in ("body", "html"):
        return found
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'")).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return HARD
        if key == "style" and _UNSEEN.search(value):
            return HARD
        if key == "role" and value in ROLES:
            found = max(found, SOFT)
        if key in ("class", "id") and name != "main":
            words = set(_WORD.findall(" ".join(x for x in value.split() if not _ABOUT.fullmatch(x))))
            if words & COMMENTS:
                found = max(found, TALK)
            elif words & STRONG or (words & WEAK and not words & CONTENT):
                found = max(found, END if words & {"footer", "nav", "menu", "cookie", "cookies", "ad", "ads"} else SOFT)
    return found


def is_sentence(text: str) -> bool:
    """Whether a text ends as sentences do; looked at from its end, so long lines cost no more than short ones."""
    end = text.rstrip("\"'”’»)]")
    return end[-1:] in tuple(".!?…。！？") and _LETTER.search(end, 0, len(end) - 1) is not None


def tags(page: str):
    """(start, end, "/" or "", name, attributes) of every tag in order; comments and declarations have no name."""
    at, size, cdata = 0, len(page), True
    while (at := page.find("<", at)) >= 0:
        name = _NAME.match(page, at + 1)
        if name:
            rest = _REST.match(page, name.end())
            if not rest:  # the tag never ends: the rest is text
                return
            yield at, rest.end(), name[1], name[2].lower(), rest[1]
            at = rest.end()
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, "", "", ""
            at = end
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find("]]>", at) if cdata and page.startswith("<![CDATA[", at) else -1
            cdata = cdata and (end >= 0 or not page.startswith("<![CDATA[", at))
            end = page.find(">", at) + 1 if end < 0 else end + 3
            if not end:
                return
            yield at, end, "", "", ""
            at = end
        else:
            at += 1


def lines_of(page: str) -> tuple[list[tuple[str, int, int]], list[int], list[bool]]:
    """(text, characters inside links, box) of each block, and of each box the one around it and whether it is an article.

    Boxes are numbered as they open, the page itself is 0. Furniture gives empty lines.
    """
    lines: list[tuple[str, int, int, int]] = []  # with the innermost furniture around
    around, articles = [0], [False]
    kinds, outer = [NO], [0]  # of each furniture element: its kind, the one around it
    holds: set[int] = set()  # furniture elements with an article, main or h1 element right in them
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, furniture, article, box
    opened: Counter[str] = Counter()
    blocks: list[int] = []  # places of open elements that are not inline, and of paragraphs
    paragraphs: list[int] = []
    linked = links = inside = box = within = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            lines.append((text, min(linked, len(text)), box, within))
        held.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal within, inside, box, links
        while len(stack) > to:
            name, is_furniture, article, is_box = stack.pop()
            opened[name] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if paragraphs and paragraphs[-1] == len(stack):
                paragraphs.pop()
            if is_furniture:
                within = outer[within]
            if article:
                close()
                inside -= 1
            if is_box:
                box = around[box]
            if name == "a":
                links -= 1

    at, skip_to = 0, 0
    for start, end, slash, name, attributes in tags(page):
        if start < skip_to:
            continue
        if start > at:
            held.append(page[at:start])
            linked += (start - at) * (links > 0)
        at = end
        if not name:
            continue
        if slash:
            if name not in INLINE:
                close()
            if opened[name]:
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                pop(to)
            continue
        if name in RAW:
            shut = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = skip_to = shut.end() if shut else len(page)
            continue
        if name == "br":
            held.append(" ")
        if name not in INLINE:
            close()
        if name in VOID or attributes.endswith("/") and name in INLINE:
            continue
        if name == "p" and paragraphs and blocks[-1] == paragraphs[-1]:
            pop(paragraphs[-1])
        elif name in ("li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        kind = furniture(name, attributes, inside > 0)
        article, is_box = name in ("article", "main") and not kind, name in BOXES
        if article or name == "h1":
            holds.add(within)
        if kind or article:
            close()
        if name not in INLINE:
            blocks.append(len(stack))
        if name == "p":
            paragraphs.append(len(stack))
        stack.append((name, kind != NO, article, is_box))
        opened[name] += 1
        if kind:
            kinds.append(kind)
            outer.append(within)
            within = len(kinds) - 1
            lines.append(("", 0, box, within))
        inside += article
        if is_box:
            around.append(box)
            articles.append(article)
            box = len(around) - 1
        links += name == "a"
    if at < len(page):
        held.append(page[at:])
        linked += (len(page) - at) * (links > 0)
    close()
    return shown(lines, kinds, outer, holds), around, articles


def shown(lines: list[tuple[str, int, int, int]], kinds: list[int], outer: list[int], holds: set[int]) -> list[tuple[str, int, int]]:
    """The lines outside furniture, with a gap where furniture stood."""
    weight, many = [0] * len(kinds), [0] * len(kinds)
    for text, linked, _, within in lines:
        weight[within] += len(text) - linked
        many[within] += bool(text)
    hidden = [False] * len(kinds)
    for i in range(1, len(kinds)):
        hidden[i] = hidden[outer[i]] or kinds[i] == HARD
    whole = sum(w for w, h in zip(weight, hidden, strict=True) if not h)
    speaks = any(not within and 2 * linked <= len(text) and is_sentence(text) for text, linked, _, within in lines)
    for i in range(len(kinds) - 1, 0, -1):
        if not hidden[i]:
            weight[outer[i]] += weight[i]
            many[outer[i]] += many[i]
            if i in holds:
                holds.add(outer[i])
    for i in range(1, len(kinds)):
        is_text = 2 * weight[i] > whole and (i in holds or kinds[i] == SOFT and many[i] >= SOME or kinds[i] == TALK and not speaks)
        hidden[i] = hidden[outer[i]] or kinds[i] == HARD or not is_text
    found: list[tuple[str, int, int]] = []
    for text, linked, box, within in lines:
        if not hidden[within]:
            found += [(text, linked, box)] * bool(text)
        elif not found or found[-1][0]:
            found += [("", 0, box)] * WINDOW
    return found


def body_of(lines: list[tuple[str, int, int]], around: list[int], articles: list[bool]) -> range:
    """The boxes of the body; the page alone without those in it where no box has more than half of the text."""
    weights, sizes = [0] * len(around), [1] * len(around)
    for text, linked, box in lines:
        weights[box] += len(text) - linked
    for i in range(len(around) - 1, 0, -1):
        weights[around[i]] += weights[i]
        sizes[around[i]] += sizes[i]
    # boxes with more than half lie in one another, and inner ones have larger numbers
    body = max((i for i, w in enumerate(weights) if 2 * w > weights[0]), default=0)
    at = body
    while at and not articles[at]:
        at = around[at]
    body = at or body
    return range(body, body + sizes[body]) if body else range(1)


def main_text(page: str | None) -> str:
    lines, around, articles = lines_of(page or "")
    lengths = [len(text) for text, _, _ in lines]
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    runs, start = [], 0
    while start < len(lines):
        if not lengths[start]:
            start += 1
            continue
        dive = start  # the surge point is start; the dive point is where a whole window is empty
        while dive < len(lines) and sums[dive]:
            dive += 1
        runs.append((start, dive))
        start = dive
    if not runs:
        return ""
    body = body_of(lines, around, articles)

    def is_text(start: int, dive: int) -> bool:
        run = lines[start:dive]
        of_body = any(text and box in body for text, _, box in run)
        if of_body and body.start:
            return True
        plain = [len(text) - linked for text, linked, _ in run]
        if 2 * sum(plain) < sum(lengths[start:dive]):
            return False
        dense = any(sum(plain[i : i + WINDOW]) >= DENSE for i in range(len(plain)))
        return of_body or dense or any(2 * n >= len(text) and is_sentence(text) for n, (text, _, _) in zip(plain, run, strict=True))

    # furniture inside the text makes a gap, too: the main text goes from the first to the last run of text
    found = [run for run in runs if is_text(*run)] or runs
    return "\n\n".join(text for text, _, _ in lines[found[0][0] : found[-1][1]] if text)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """Every row with ``text``, the main text of its page, and ``n_chars``, its code points."""

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    others = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    found = pages.select(*others, texts(F.col(f"`{page}`")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_blocks(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).drop("html")


QUERIES = {"op2_html_blocks": op2_html_blocks}
ORACLES: dict[str, str] = {}
