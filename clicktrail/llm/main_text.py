r"""Main text of web pages by tree scoring.

A page is read into a tree of elements. Paragraphs pass points for their length and commas to
their ancestors, less with each level; a container's points are discounted by the share of
its text that stands in links. The best container is the article. Siblings of it that look
like parts of it join it, and what is no article text, inside it too, was left out on
reading or goes by its links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from clicktrail.llm.arrow import batches

# fixed values: elements by their role in a page
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video".split())
ASIDE = frozenset("nav footer aside button select textarea option dialog menu".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote dd li".split())
CONTAINERS = BLOCKS - PARAGRAPHS - {"br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "form", "tr", "th", "dt", "summary", "legend"}
ENDS_P = BLOCKS - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li", "legend", "summary"}
# an opening tag ends an open element of the second set, unless one of the third lies in between
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# words of classes and ids of what surrounds an article, and of the article itself
_SURROUNDINGS = re.compile(
    r"^(?!(?:has|with|without|no|is)[_-])(?!(?:article|post|entry|story|content)[_-]header)(?:.*[_-])?"
    r"(?:ads?|ad(?:box|slot|unit|container|sbygoogle|sense)|advert\w*|alert|banner\w*|billboard|breadcrumb\w*|"
    r"comment(?:s|list|box|area|form|thread)?|community|consent|cookie\w*|disclaimer|discussion|disqus\w*|feedback|"
    r"foot|footer\w*|gdpr\w*|header|hidden|legal|login|masthead|menu\w*|modal|nav(?:bar|igation|list|menu|links?)?|"
    r"newsletter\w*|notices?|notification|overlay|pager|pagination|paywall|popup|pop-up|privacy|promo\w*|rail|"
    r"reactions?|recommend\w*|related|repl(?:y|ies)|respond|responses|search\w*|share|sharing|shoutbox|sidebar\w*|"
    r"side-bar|signup|skyscraper|social|sponsor\w*|subscribe|tags|teaser|toast|toolbar|tooltip|topbar|widget)(?:[_-]|$|\d)", re.I)
_ARTICLE = re.compile(r"(?:(?:article|main|page|post|entry|story|blog|body)[_-])?(?:article|main|content|body|entry|story|post|text|copy)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search form menu menubar status".split())
_UNSEEN = re.compile(r"display:\s*none|visibility:\s*hidden", re.I)
_COMMENTS_HEAD = re.compile(
    r"\W*(?:\d+\s+)?(?:comments?|reader comments|responses?|replies|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)"
    r"\W*(?:\(?\d+\)?)?\W*", re.I)

_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"\s+")

MOST_DEPTH = 256       # elements nested deeper are read as part of the one at this depth
KEPT_SHARE = 0.2       # of the best container's points, for a sibling to join it
BONUS = (0, 8, 25)     # points of an element of no, of article-like name, and of article mark
MENU_LINKS, MENU_SHARE = 3, 0.6


class Element:
    __slots__ = ("tag", "parent", "children", "kind", "points", "chars", "linked", "links", "text_chars", "commas")

    def __init__(self, tag: str, parent: Element | None, kind: int = 0):
        self.tag, self.parent, self.kind = tag, parent, kind       # kind: 1 if named as an article is, 2 if marked as one
        self.children: list[Element | str] = []
        self.points, self.chars, self.linked, self.links = 0.0, 0, 0, 0


def _tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Texts (with an empty tag name), opening and closing tags of a page, left to right."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield "", html.unescape(page[at:lt]), {}
        at = lt + 1
        if lt == size:
            return
        if page.startswith("!--", at):
            end = page.find("-->", at + 1)
            at = size if end < 0 else end + 3
        elif page[at:at + 1] in ("!", "?"):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
        else:
            closing = page[at:at + 1] == "/"
            name = _NAME.match(page, at + closing)
            if name is None:
                if not closing:
                    yield "", "<", {}
                    continue
                end = page.find(">", at)
                at = size if end < 0 else end + 1
                continue
            tag, at, attributes = name.group().lower(), name.end(), {}
            while at < size:
                found = _ATTRIBUTE.match(page, at)
                if found is None:
                    end = page.find(">", at)
                    at = size if end < 0 else end + 1
                    break
                at = found.end()
                value = found.group(2) or found.group(3) or found.group(4) or ""
                attributes.setdefault(found.group(1).lower(), value)
            else:
                return                              # a tag that never ends is no tag
            yield ("/" if closing else "") + tag, "", attributes
            if tag in RAW and not closing:
                end = _raw_end(page, tag, at)
                if tag not in SILENT:
                    yield "", html.unescape(page[at:end]), {}
                at = end


def _raw_end(page: str, tag: str, at: int) -> int:
    found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
    return found.start() if found else len(page)


def _named(attributes: dict[str, str]) -> list[str]:
    """Words of class, id and item property, with humps of camel case taken apart by dashes."""
    return _CAMEL.sub("-", " ".join(attributes.get(k, "") for k in ("class", "id", "itemprop"))).split()


def _surrounds(tag: str, attributes: dict[str, str], names: list[str], in_article: bool) -> bool:
    """Whether an element holds what stands around an article, or cannot be seen."""
    if tag in ASIDE or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in _ROLES or _UNSEEN.search(attributes.get("style", "")):
        return True
    if tag in ("main", "body", "html") or tag == "article" and not any("comment" in n.lower() for n in names):
        return False
    if tag == "header" and not in_article:
        return True
    return any(_SURROUNDINGS.search(n) for n in names) and not any(_ARTICLE.fullmatch(n) for n in names)


def read(page: str) -> Element:
    """Tree of a page; what surrounds articles is read, too, but hangs on no parent."""
    root = Element("html", None)
    here, depth, articles = root, 0, 0
    for tag, text, attributes in _tokens(page):
        if not tag:
            here.children.append(text)
        elif tag[0] == "/":
            name, up = tag[1:], here
            while up is not root and up.tag != name and not (name not in BLOCKS and up.tag in BLOCKS):
                up = up.parent
            if up is not root and up.tag == name:
                while here is not up.parent:
                    articles -= here.tag == "article"
                    here, depth = here.parent, depth - 1
        elif tag in VOID:
            here.children.append(Element(tag, here))
        elif tag not in ("html", "body"):
            if tag in ENDS_P:
                here, depth = _end(here, depth, {"p"}, {"table", "td", "button"})
            elif tag in ENDS:
                here, depth = _end(here, depth, *ENDS[tag])
            if depth >= MOST_DEPTH:
                continue
            names = _named(attributes)
            child = Element(tag, here)
            if tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article"):
                child.kind = 2
            elif any(_ARTICLE.fullmatch(n) for n in names):
                child.kind = 1
            if tag in SILENT or _surrounds(tag, attributes, names, articles > 0):
                if tag in BLOCKS:
                    here.children.append(Element("br", here))   # the gap it leaves
            else:
                here.children.append(child)
            here, depth = child, depth + 1
            articles += tag == "article"
    return root


def _end(here: Element, depth: int, ended: set[str], held_by: set[str]) -> tuple[Element, int]:
    """The place to go on at, once the nearest open element of ``ended`` is closed."""
    up, levels = here, 0
    while up.parent is not None and up.tag not in held_by:
        levels += 1
        if up.tag in ended:
            return up.parent, depth - levels
        if up.tag in BLOCKS and up.tag not in ended and "p" in ended:
            break
        up = up.parent
    return here, depth


def _order(root: Element) -> list[Element]:
    """Elements, each after its parent."""
    out = [root]
    for element in out:
        out.extend(c for c in element.children if isinstance(c, Element))
    return out


def score(root: Element) -> list[Element]:
    """Measure and rate all elements; returns them with parents first."""
    order = _order(root)
    for element in order:
        own = _SPACE.sub(" ", "".join(c for c in element.children if isinstance(c, str))).strip()
        element.chars, element.text_chars, element.commas = len(own), len(own), own.count(",") + own.count("，") + own.count("、")
    for element in reversed(order):
        if element.tag == "a":
            element.linked, element.links = element.chars, element.links + 1
        up = element.parent
        if up is not None:
            up.chars += element.chars
            up.linked += element.linked
            up.links += element.links
            if element.tag not in BLOCKS:               # text of inline elements belongs to their block
                up.text_chars += element.text_chars
                up.commas += element.commas
    for element in order:
        paragraph = element.tag in PARAGRAPHS or (element.tag in CONTAINERS and element.text_chars > 80)
        if not paragraph or not element.text_chars:
            continue
        share = element.linked / element.chars if element.chars else 0.0
        points = (1 + element.commas + min(element.text_chars / 100, 3)) * (1 - share)
        up, level = element.parent, 1
        if element.tag not in PARAGRAPHS:               # a block with text of its own is its own container
            up, level = element, 1
        while up is not None and level <= 5:
            up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            up, level = up.parent, level + 1
    return order


def _final(element: Element) -> float:
    share = element.linked / element.chars if element.chars else 0.0
    return (element.points + BONUS[element.kind] * (element.chars > 0)) * (1 - share)


def _is_menu(element: Element) -> bool:
    return (element.tag in ("ul", "ol", "div", "section", "table", "dl", "p") and element.links >= MENU_LINKS
            and element.linked > MENU_SHARE * element.chars)


def _starts_comments(element: Element) -> bool:
    first = next((c for c in element.children if isinstance(c, Element) or c.strip()), None)
    return (isinstance(first, Element) and first.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            and _COMMENTS_HEAD.fullmatch(_SPACE.sub(" ", _inline(first))) is not None)


def _inline(element: Element) -> str:
    return "".join(c if isinstance(c, str) else _inline(c) for c in element.children)


def parts_of_article(page: str) -> list[Element]:
    """The best container and those of its siblings that belong to it, in page order."""
    order = score(read(page))
    best = max((e for e in order if e.tag in CONTAINERS), key=_final)
    up = best
    while up is not None:                       # an element marked as article is the whole of it
        if up.tag == "article":
            best = up
            break
        up = up.parent
    if best.parent is None:
        return [best]
    least = max(10.0, KEPT_SHARE * _final(best))
    out = []
    for sibling in best.parent.children:
        if sibling is best:
            out.append(sibling)
        elif isinstance(sibling, Element) and sibling.tag in BLOCKS and not _starts_comments(sibling) and not _is_menu(sibling):
            share = sibling.linked / sibling.chars if sibling.chars else 1.0
            text = sibling.tag in PARAGRAPHS and sibling.chars > 80 and share < 0.25
            if text or sibling.kind == best.kind and _final(sibling) >= least or sibling.tag in ("h1", "h2") and sibling.chars:
                out.append(sibling)
    return out


def main_text(page: str) -> str:
    """Text of the article of a page: its blocks in order, each with single spaces, joined by one."""
    pieces: list[str] = []
    stack: list[Element | str] = list(reversed(parts_of_article(page)))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            pieces.append(item)
        elif item.tag == "form" or _is_menu(item) or _starts_comments(item):
            pieces.append(" ")
        else:
            edge = [" "] if item.tag in BLOCKS else []
            stack.extend([*edge, *reversed(item.children), *edge])
    return _SPACE.sub(" ", "".join(pieces)).strip()


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page.

    ``pages`` has ``page_id``, ``url`` and ``html``; other columns are ignored. Null and empty
    pages have an empty text. Each page is taken by itself, whole: repeated rows give equal
    rows, an empty table none. Ties between containers go to the one that begins first. A
    task holds one page's tree at a time.
    """
    def rows(source: Iterator[pa.RecordBatch]):
        for batch in source:
            for page_id, url, page in zip(*(batch.column(i) for i in range(3))):
                text = main_text(page.as_py() or "")
                yield (page_id.as_py(), url.as_py(), text, len(text)), 40 + 2 * len(text)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    return chosen.mapInArrow(lambda s: batches(rows(s), schema), "page_id long, url string, text string, n_chars long")
