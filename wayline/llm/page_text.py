"""One web page: its blocks of text, and hashes of its element subtrees."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass, field

import xxhash

#: Comments and declarations; tags with attributes as the HTML standard reads them; tags that a quote leaves open.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+)*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed sets of element names, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "thead", "tbody", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist"), "body": ()}

#: Elements that are never part of an article, by their meaning in HTML; and roles of the same meaning.
NEVER = frozenset(
    "nav footer aside script style noscript iframe template button select input textarea object embed applet canvas svg math audio video dialog menu"
    " head title datalist fieldset label legend map xmp noembed noframes".split()
)
ROLES = frozenset("navigation contentinfo complementary search banner dialog alertdialog menu menubar".split())
#: Elements that are no article unless they hold the page's.
WEAK_TAGS = frozenset("form header".split())
#: Names that say what an element is, where a class or id begins or ends with them.
STRONG_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsored cookie cookies gdpr comment comments commentlist disqus respond"
    " sidebar sidebars nav navbar navigation breadcrumb breadcrumbs masthead footer newsletter subscribe signup login paywall pagination popup modal toolbar".split()
)
#: Names that hint at it: they count where the element's slot recurs over the site.
HINTS = STRONG_MARKS | frozenset(
    "sponsor sponsors promo promos promotion banner banners consent notice notices alert alerts notification notifications announcement disclaimer replies reply discussion"
    " widget widgets menu menus copyright share sharing social related recommended recommendations subscription search pager overlay header topbar".split()
)
#: Words before a mark that tell of the rest of the page, as in has-sidebar.
ABOUT = frozenset("has have with without no is show hide".split())
#: Elements that are no template by themselves: the page's frame, and inline text or parts of tables, which articles repeat.
NO_TEMPLATE = frozenset(
    "html body head main article h1 dt tr td th thead tbody tfoot caption figcaption b strong i em a span u s code q cite small sub sup mark abbr time font".split()
)
#: Elements of prose: a template only if they have some words.
PROSE = frozenset("p li dd blockquote pre h2 h3 h4 h5 h6".split())
LEAST_PROSE_WORDS = 4


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


@dataclass(eq=False, slots=True)
class Node:
    """An element; its hash covers the names and texts of its whole subtree, made from those of its children."""

    tag: str
    parent: Node | None
    inside: int = 0  # 2 in an article, 1 in main, else 0
    never: bool = False
    weak: bool = False  # dropped unless it holds the article
    slot: int | None = None  # hash of its tag, class and id, where these hint at what it is
    digest: xxhash.xxh64 | None = None
    hash: int = 0
    words: int = 0
    anchors: int = 0  # articles and mains in it

    @property
    def may_be_template(self) -> bool:
        return self.words > 0 and self.tag not in NO_TEMPLATE and (self.tag not in PROSE or self.words >= LEAST_PROSE_WORDS)


@dataclass
class Page:
    """Elements in the order in which they begin, and blocks as pieces of source, each with the element it stands in."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[list[tuple[str, Node]]] = field(default_factory=list)

    def hashes(self) -> set[int]:
        """Of all subtrees that could be a template, and of slots, but for those that rules drop anyway."""
        gone = self._dropped(())
        left = [n for n in self.nodes if n not in gone]
        return {n.hash for n in left if n.may_be_template} | {n.slot for n in left if n.slot is not None}

    def _dropped(self, gone: Collection[int]) -> set[Node]:
        root = self.nodes[0]

        def holds_article(n: Node) -> bool:
            return n.anchors == root.anchors if root.anchors else 2 * n.words >= root.words

        out: set[Node] = set()
        for n in self.nodes[1:]:
            template = n.may_be_template and n.hash in gone
            marked = n.weak or (n.slot is not None and n.slot in gone)
            if n.parent in out or n.never or ((template or marked) and not holds_article(n)):
                out.add(n)
        return out

    def text(self, gone: Collection[int] = ()) -> str:
        r"""Blocks joined by \n, without dropped elements and without subtrees and slots whose hashes are in `gone`.

        Blocks of articles alone if they have at least two fifths of the words, else those of main if it has, else all.
        """
        dropped = self._dropped(gone)
        kept: list[tuple[int, str]] = []
        for block in self.blocks:
            some = [(piece, n) for piece, n in block if n not in dropped]
            text = " ".join(html.unescape("".join(piece for piece, _ in some)).split())
            if text:
                kept.append((max(n.inside for _, n in some), text))
        words = Counter()
        for inside, text in kept:
            for level in range(inside + 1):
                words[level] += len(text.split())
        best = next((level for level in (2, 1) if 5 * words[level] >= 2 * words[0] and words[level]), 0)
        return "\n".join(text for inside, text in kept if inside >= best)


def _judge(node: Node, attributes: str) -> None:
    """Sets never, weak and slot by the element's name and attributes."""
    if node.tag in NEVER:
        node.never = True
        return
    node.weak = node.tag == "form" or (node.tag == "header" and not node.inside)
    if not attributes or attributes.isspace() or node.tag in ("html", "body", "main"):
        return
    names: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            node.never = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.never = True
        elif name == "role" and value.strip().lower() in ROLES:
            node.never = True
        elif name in ("class", "id"):
            names += value.split()
    if not names or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return
    hinted = False
    for name in names:
        parts = [m.lower() for m in NAME_PART.findall(name)]
        if parts and parts[0] not in ABOUT:
            hinted |= bool(HINTS.intersection(parts))
            node.weak |= parts[0] in STRONG_MARKS or parts[-1] in STRONG_MARKS
    if hinted:
        node.slot = _hash(f"{node.tag} {' '.join(sorted(names))}")


def parse(source: str) -> Page:
    """Reads a whole page in time linear in its length, however badly nested."""
    root = Node("", None)
    page, stack, pieces = Page([root]), [root], []
    root.digest = xxhash.xxh64()
    open_tags: Counter = Counter()

    def flush() -> None:
        if pieces:
            page.blocks.append(pieces.copy())
            pieces.clear()

    def close(to: int) -> None:
        """Ends the open elements from place `to` on."""
        if any(n.tag in BLOCK for n in stack[to:]):
            flush()
        while len(stack) > to:
            node = stack.pop()
            open_tags[node.tag] -= 1
            node.hash = node.digest.intdigest()
            node.digest = None
            up = stack[-1]
            up.digest.update(b"<" + node.hash.to_bytes(8, "little"))
            if not node.never:
                up.words += node.words
                up.anchors += node.anchors

    def close_last(tags: tuple[str, ...], stops: Collection[str], every: bool = False) -> None:
        if not any(open_tags[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                close(k)
                if not every:
                    return
            elif stack[k].tag in stops:
                return

    at, end = 0, len(source)
    while at < end:
        found = TOKEN.search(source, at)
        upto = found.start() if found else end
        if upto > at:
            piece, here = source[at:upto], stack[-1]
            words = piece.split()
            if words:
                here.digest.update(" ".join(words).encode("utf-8", "surrogatepass"))
                here.words += len(words)
            pieces.append((piece, here))
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:  # an end tag
            if open_tags[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag not in BLOCK and stack[k].tag in BLOCK:
                        break
            continue
        if tag in BLOCK:
            close_last(("p",), BLOCK)
            if tag in CLOSES:
                close_last(CLOSES[tag], SCOPE[tag], every=tag == "tr")
            flush()
        elif tag == "br":
            pieces.append((" ", stack[-1]))
        if tag in VOID:
            continue
        if tag in RAW:
            ending = re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.I).search(source, at)
            at = ending.end() if ending else end
            continue
        node = Node(tag, stack[-1], stack[-1].inside)
        _judge(node, found[3] or "")
        if tag in ("article", "main") and not node.never:
            node.inside = max(node.inside, 2 if tag == "article" else 1)
            node.anchors = int(not node.weak)
        node.digest = xxhash.xxh64(tag.encode("utf-8", "surrogatepass"))
        open_tags[tag] += 1
        stack.append(node)
        page.nodes.append(node)
    close(1)
    flush()
    root.hash = root.digest.intdigest()
    root.digest = None
    return page
