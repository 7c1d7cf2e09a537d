"""Main text of web pages by scoring the element tree.

A page becomes a tree of elements. Elements that never hold the article (menus, forms, scripts, elements hidden or named as
notices, adverts or comments) go. Every block of text gives points for its length and its commas to its parent and grandparent
and, less, further up; a container's points are discounted by the share of its characters that lie in links. The best container
is kept with those siblings that score well or read like prose. Its blocks are joined in page order.

Null, empty and tag-less pages: null and empty give an empty text, bare text is one block. Unclosed and stray tags are mended as
browsers do for paragraphs, list items, cells and options; deep nesting costs no recursion.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tidemark.llm.text_arrays import with_computed

# fixed values of the HTML language
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption body html option legend summary dt dd li".split()) | {"hr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl select html body".split())
# fixed values: elements and roles that hold no article
NEVER = frozenset("nav footer aside form button select option menu dialog fieldset legend label input".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# fixed values: words in class and id
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|adslot|banner|sponsor\w*|promo\w*|comments?|commentlist|comment-?section|disqus|replies|respond|responses|"
    r"discussion|cookies?|consent|gdpr|notice|notices|notification\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|login|breadcrumbs?|"
    r"nav|navbar|navigation|menu|menubar|topbar|toolbar|sidebar|side|rail|widget\w*|footer|masthead|site-?header|page-?header|share|sharing|social|"
    r"related|recommended|recommendations|more-?from|tags?|taglist|pagination|pager|paging|skip-?link|copyright|legal|disclaimer|hidden|print-?only)"
    r"(?:$|[\s_-])", re.I)
NOT_THE_ARTICLE = re.compile(r"comment|repl(?:y|ies)|related|recommend|promo|advert|sponsor|teaser|(?:^|[\s_-])ads?(?:$|[\s_-])", re.I)
EDGE = frozenset("header top bottom".split())
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|story|entry|post|content|main|body|text|prose|page)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MENU_LIKE = frozenset("ul ol dl div td table section".split())
#: Ancestors that a text's points reach.
LEVELS = 6
PARAGRAPHS = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())

# a tag without a further "<" is read at once; the last choice is a "<" that may begin a longer one
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|"
                   r"<(/?)([a-zA-Z][^\s/><]*+)([^<>\"']*+(?:(?:\"[^\"<]*+\"|'[^'<]*+')[^<>\"']*+)*+)>|(<)(?=/?[a-zA-Z])", re.S)
NAME_END, MARK = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACES = re.compile(r"\s+")


@dataclass(eq=False)
class Node:
    """An element; ``parts`` are its texts and children in order."""
    tag: str
    parent: Node | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)
    score: float = 0.0
    chars: int = 0
    link_chars: int = 0
    links: int = 0


def attributes(raw: str) -> dict[str, str]:
    return {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t") else {}


class LongTags:
    """Reads tags that hold a "<", in time linear in the page however many of them none closes."""

    def __init__(self, page: str):
        self.page = page
        self.lost: set[int] = set()  # marks outside quotes from which no end was found
        self.known: dict[re.Pattern, tuple[int, int]] = {}

    def following(self, pattern: re.Pattern, at: int) -> int:
        """The next match from ``at``, the page's length if there is none."""
        begin, found = self.known.get(pattern, (0, -1))
        if not begin <= at <= found:
            m = pattern.search(self.page, at)
            begin, found = at, m.start() if m else len(self.page)
            self.known[pattern] = begin, found
        return found

    def read(self, at: int) -> tuple[str, str, str, int] | None:
        """(slash, name, attributes, end) of the tag at a "<", or None."""
        slash = "/" if self.page.startswith("/", at + 1) else ""
        name = at + 1 + len(slash)
        begin = self.following(NAME_END, name)
        mark, seen = self.following(MARK, begin), []
        while mark < len(self.page) and mark not in self.lost and self.page[mark] != ">":
            seen.append(mark)
            close = self.page.find(self.page[mark], mark + 1)
            if close < 0:
                break
            mark = self.following(MARK, close + 1)
        if mark < len(self.page) and self.page[mark] == ">":
            return slash, self.page[name:begin], self.page[begin:mark], mark + 1
        self.lost.update(seen)
        return None


def parse(page: str) -> Node:
    """The tree of a page. Raw elements keep no content."""
    root = node = Node("#root")
    at = text = 0
    size = len(page)
    long_tags = LongTags(page)
    open_tags: Counter[str] = Counter()

    def leave(top: Node) -> Node:
        """Close everything from the current element up to ``top``."""
        inner = node
        while inner is not top.parent:
            open_tags[inner.tag] -= 1
            inner = inner.parent
        return top.parent

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            break
        at = m.end()
        slash, tag, raw = m[1], m[2], m[3]
        if m[4]:
            found = long_tags.read(m.start())
            if found is None:
                continue
            slash, tag, raw, at = found
        if m.start() > text:
            node.parts.append(html.unescape(page[text:m.start()]))
        text = at
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            up = node
            while open_tags[tag] and up is not root and up.tag != tag and not (tag not in BLOCKS and up.tag in BLOCKS):
                up = up.parent
            if up is not root and up.tag == tag:
                node = leave(up)
            continue
        if tag in CLOSES_P and open_tags["p"]:
            up = node
            while up is not root and up.tag != "p" and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p":
                node = leave(up)
        if tag in SIBLINGS and any(open_tags[t] for t in SIBLINGS[tag]):
            up = node
            while up is not root and up.tag not in SCOPE and up.tag not in SIBLINGS[tag]:
                up = up.parent
            if up.tag in SIBLINGS[tag]:
                node = leave(up)
        child = Node(tag, node, attributes(raw))
        node.parts.append(child)
        if tag in RAW and not raw.rstrip().endswith("/"):
            found = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            stop = found.start() if found else size
            close = page.find(">", stop)
            at = text = size if stop >= size or close < 0 else close + 1
        elif tag not in VOID and not raw.rstrip().endswith("/"):
            node = child
            open_tags[tag] += 1
    if text < size:
        node.parts.append(html.unescape(page[text:]))
    return root


def holds_prose(form: Node) -> bool:
    """Whether a form wraps an article, as on pages that are one form: it holds an article, a first heading or two paragraphs of prose."""
    paragraphs, todo = 0, [form]
    while todo:
        node = todo.pop()
        paragraphs += node.tag == "p" and sum(len(p) for p in node.parts if isinstance(p, str)) >= 40
        if node.tag in ("article", "main", "h1") or paragraphs >= 2:
            return True
        todo.extend([p for p in node.parts if not isinstance(p, str)])
    return False


def excluded(node: Node) -> bool:
    """Whether an element cannot hold the article."""
    if node.tag in NEVER:
        return node.tag != "form" or not holds_prose(node)
    attrs = node.attrs
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    name = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if node.tag in ("html", "body"):
        return False
    if node.tag in ("article", "main"):
        return bool(NOT_THE_ARTICLE.search(name))
    if attrs.get("class", "").strip().lower() in EDGE or attrs.get("id", "").strip().lower() in EDGE:
        return True
    return bool(UNLIKELY.search(name)) and not (LIKELY.search(attrs.get("id", "")) and not UNLIKELY.search(attrs.get("id", "")))


def header_of_page(node: Node) -> bool:
    """A header counts as the site's unless it stands in an article."""
    if node.tag != "header":
        return False
    up = node.parent
    while up is not None:
        if up.tag in ("article", "main", "section"):
            return False
        up = up.parent
    return True


def prune(root: Node) -> list[Node]:
    """Take out what cannot hold the article; the nodes left, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.parts = [p for p in node.parts if isinstance(p, str) or not (excluded(p) or header_of_page(p))]
        todo.extend([p for p in reversed(node.parts) if not isinstance(p, str)])
    return order


def blocks(node: Node) -> list[str]:
    """The texts of a node's blocks in page order, blanks made single."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = SPACES.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br" or part.tag == "hr":
            run.append(" ")
        else:
            if part.tag in BLOCKS:
                close()
                todo.append(None)
            todo.extend(reversed(part.parts))
    close()
    return out


def scored(order: list[Node]) -> None:
    """Points of every node. A text's points reach its block's container, half of them the next, then a third, and so on."""
    for node in reversed(order):
        for part in node.parts:
            n = len(SPACES.sub(" ", part).strip()) if isinstance(part, str) else part.chars
            node.chars += n
            if not isinstance(part, str):
                node.link_chars += part.chars if part.tag == "a" else part.link_chars
                node.links += 1 if part.tag == "a" else part.links
    for node in order:
        own = [p for p in node.parts if isinstance(p, str) or p.tag not in BLOCKS]
        text = sum(len(p.strip()) if isinstance(p, str) else p.chars for p in own)
        if node.tag not in BLOCKS and node.tag != "#root" or not text:
            continue
        commas = sum(p.count(",") for p in node.parts if isinstance(p, str))
        points = (1 + commas + min(text / 100, 3) + text / 1000) * (1 - node.link_chars / max(node.chars, 1))
        if text < 25 and node.tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            points *= 0.2
        up, share = (node.parent if node.tag in PARAGRAPHS and node.parent is not None else node), 1.0
        level = 1
        while up is not None and level <= LEVELS:
            up.score += points * share
            level += 1
            up, share = up.parent, 1 / level


def link_list(node: Node) -> bool:
    """A menu by its looks: a list, cell or box of two links or more and hardly anything else."""
    return node.tag in MENU_LIKE and node.links >= 2 and node.link_chars >= 0.9 * node.chars


def article(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    order = prune(root)
    scored(order)
    for node in order:
        node.parts = [p for p in node.parts if isinstance(p, str) or not link_list(p)]

    def worth(node: Node) -> float:
        weight = 1.25 if node.tag in ("article", "main") else 1.0
        if LIKELY.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"):
            weight += 0.1
        return node.score * weight * (1 - node.link_chars / max(node.chars, 1))

    places = [n for n in order if n.tag not in PARAGRAPHS and (n.tag in BLOCKS or n.tag == "#root")]
    best = max(places, key=worth, default=root)
    # the narrowest element that the page itself names as its article, around or within the best container
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best = up
    parent = best.parent
    if parent is None:
        return [best]
    least = worth(best) * 0.2
    kept = []
    for part in parent.parts:
        if isinstance(part, str):
            continue
        density = part.link_chars / max(part.chars, 1)
        text = part.chars
        if part is best or worth(part) >= least > 0 or part.tag == best.tag == "article" and text and density < 0.5:
            kept.append(part)
        elif part.tag == "p" and (text > 80 and density < 0.25 or 0 < text <= 80 and not part.link_chars and "." in "".join(blocks(part))):
            kept.append(part)
        elif part.tag in ("h1", "h2", "h3", "pre", "blockquote", "ul", "ol", "table") and best.tag != "article" and text and density < 0.25:
            kept.append(part)
    return kept


def main_text(page: str | None) -> str:
    """The article's blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    return "\n".join(text for node in article(parse(page)) for text in blocks(node))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole html in ``out``."""
    def step(texts: list[bytes]) -> pa.Array:
        return pa.array([main_text(t.decode("utf-8", "replace")) for t in texts], pa.string())

    return with_computed(pages, html_col, out, T.StringType(), step)
