"""HTML extraction by composite text density.

Every node of the page's tree has its characters C, tags T, characters in links LC and link tags LT, all
of its subtree, and from these its composite density: characters per tag, times a logarithm that
shrinks it the more of its text is links, with the page's own share of links as a base. A node's
density sum adds its children's densities. The node of the greatest sum holds the article, whatever it is called. The
least density on the path from the body down to it is the threshold: nodes beside that path
that reach it, parts of an article in several containers, are content too.

Names only remove. Elements that say what they are, by name, role, class or a whole id (menus, forms, adverts, comments and so
on), have no density and are left out wherever they stand. An id that only has such a word among others, or
a class with a vague one, makes an element doubtful: the least density on the path decides about it, computed
without what is doubtful.
Headings are never judged by class or id, as their ids repeat their words.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, text_or_empty

#: Fixed values of HTML: elements without content, with raw text, that are blocks, and that a block's start closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
#: Where the search for an element to close stops.
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select", "datalist")}
#: What is never article text: element names, roles, and words of class or id.
DROP = frozenset("script style noscript template textarea title xmp iframe noembed noframes head nav aside footer form fieldset button select input label svg math canvas audio video object dialog menu search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROP_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|breadcrumbs?|comments?|commentlist|disqus|cookies?|consent|gdpr|disclaimer|footer|footnav|form|login|signup|masthead|menus?|nav|navbar|navigation|newsletter|notices?|alert|pagination|pager|popup|modal|overlay|promo\w*|recommend\w*|related|replies|respond|share|sharing|sidebar|side|social|sponsor\w*|subscribe\w*|subscription|toolbar|widgets?|skip)(?=$|[\s_-])",
    re.I,
)
#: Those that in a class beside other words can say something of an article's part too.
VAGUE = frozenset("side social related alert notice notices form share sharing respond replies skip banner consent disclaimer overlay".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<loose>[^>]*)(?:>|\Z))|</[^a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|(?<=[\s\"'/]))([^\s=\"'<>/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class _Tree:
    """Nodes in page order, so that a parent's number is below its children's. Node 0 is the page."""

    def __init__(self) -> None:
        self.name, self.parent, self.drop, self.link = ["#page"], [-1], [False], [False]
        self.doubt = [False]
        self.chars, self.text = [0], []  # text: (node, string) in page order

    def add(self, name: str, parent: int, attrs: str) -> int:
        drop = self.drop[parent] or name in DROP
        doubt = False
        if not drop and attrs:
            drop, doubt = _says_so(name, attrs)
        if name == "header" and not drop:
            drop = not self.inside(parent, ("article", "main"))
        self.name.append(name)
        self.parent.append(parent)
        self.drop.append(drop)
        self.doubt.append(doubt)
        self.link.append(self.link[parent] or name == "a")
        self.chars.append(0)
        return len(self.name) - 1

    def inside(self, node: int, names: tuple[str, ...]) -> bool:
        while node >= 0:
            if self.name[node] in names:
                return True
            node = self.parent[node]
        return False


def _says_so(name: str, attrs: str) -> tuple[bool, bool]:
    """Whether the element is left out, and whether it is doubtful."""
    if name in ("html", "body", "article", "main"):
        return False, False
    if _HIDDEN.search(attrs):
        return True, False
    doubt = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.strip().lower() in ROLES:
            return True, False
        if key in ("class", "id") and name not in HEADINGS:
            for part in value.split():
                found = [m[0].strip("_-").lower() for m in DROP_WORDS.finditer(part)]
                if DROP_WORDS.fullmatch(part) or key == "class" and not VAGUE.issuperset(found):
                    return True, False
                doubt = doubt or bool(found)
    return False, doubt


def parse(page: str) -> _Tree:
    """The page's tree; markup that is wrong is read much as browsers read it."""
    tree, stack, at, n = _Tree(), [0], 0, len(page)

    def say(a: int, b: int) -> None:
        if a < b:
            text = html.unescape(page[a:b])
            node = stack[-1]
            tree.text.append((node, text))
            tree.chars[node] += len("".join(text.split()))

    while at < n:
        near = page.find("<", at)
        if near < 0:
            say(at, n)
            break
        m = _TOKEN.match(page, near)
        if not m:
            say(at, near + 1)  # a bare less-than sign is text
            at = near + 1
            continue
        say(at, near)
        at = m.end()
        name = (m["name"] or "").lower()
        if m["cdata"]:
            tree.text.append((stack[-1], m["cdata"]))
            tree.chars[stack[-1]] += len("".join(m["cdata"].split()))
        if not name:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if tree.name[stack[i]] == name:
                    del stack[i:]
                    break
                if name not in BLOCK and tree.name[stack[i]] in BLOCK:
                    break  # an inline end tag doesn't close blocks
            else:
                if name == "br":
                    tree.text.append((stack[-1], " "))
            continue
        if name in BLOCK:
            _close(tree, stack, ("p",), ("button", "table", "td", "th", "caption", "object"))
        if name in CLOSED_BY:
            _close(tree, stack, CLOSED_BY[name], SCOPE[name])
        if name in ("html", "body") and tree.inside(stack[-1], (name,)):
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["loose"] or ""
        if name == "body":
            _close(tree, stack, ("head",), ())
        node = tree.add(name, stack[-1], attrs)
        if name in VOID:
            tree.text.append((node, " "))
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            close = page.find(">", at)
            at = n if not end or close < 0 else close + 1
        elif not attrs.endswith("/") or name in BLOCK or name == "a":
            stack.append(node)
    return tree


def _close(tree: _Tree, stack: list[int], names: tuple[str, ...], stop: tuple[str, ...]) -> None:
    """Close the outermost open element of ``names`` above the innermost of ``stop``."""
    cut = 0
    for i in range(len(stack) - 1, 0, -1):
        name = tree.name[stack[i]]
        if name in stop:
            break
        if name in names:
            cut = i
            if names == ("p",):
                break
        elif names == ("p",) and name in BLOCK:
            break
    if cut:
        del stack[cut:]


def composite(chars: int, tags: int, linked: int, links: int, base: float) -> float:
    """Characters per tag, times a logarithm that falls with the share of its text in links; ``base`` is the page's share."""
    if not chars:
        return 0.0
    tags = max(1, tags)
    ratio = chars / max(1, linked) * tags / max(1, links)
    inner = chars / max(1, chars - linked) * linked + base * chars + math.e
    if math.log(inner) > 1.0001:
        return max(0.0, chars / tags * math.log(max(ratio, 1.0)) / math.log(math.log(inner) + 1e-9))
    return chars / tags * math.log(max(ratio, 1.0) + 1)


def densities(tree: _Tree) -> tuple[list[float], list[float], list[int]]:
    """(composite density, density sum, characters) of each node. Left-out nodes have 0 and count as nothing.

    The children that a block sums up are its blocks, and the text outside of them, inline elements included, as one
    more; an inline element has no sum.
    """
    n = len(tree.name)
    chars = [0 if d else c for c, d in zip(tree.chars, tree.drop, strict=True)]
    linked = [c if a else 0 for c, a in zip(chars, tree.link, strict=True)]
    tags, links = [0] * n, [0] * n
    loose = [[0, 0, 0, 0] for _ in range(n)]  # of the text outside of child blocks: characters, tags, linked, links
    inline = [i > 0 and tree.name[i] not in BLOCK for i in range(n)]
    for i in range(n - 1, -1, -1):
        if tree.drop[i]:
            continue
        own = loose[i]
        own[0] += tree.chars[i]
        own[2] += tree.chars[i] if tree.link[i] else 0
        if i == 0:
            break
        p = tree.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        tags[p] += tags[i] + 1
        links[p] += links[i] + (tree.name[i] == "a")
        if inline[i]:
            above = loose[p]
            for k, v in enumerate((own[0], own[1] + 1, own[2], own[3] + (tree.name[i] == "a"))):
                above[k] += v
    base = linked[0] / max(1, chars[0])
    density = [0.0 if tree.drop[i] else composite(chars[i], tags[i], linked[i], links[i], base) for i in range(n)]
    total = [0.0 if tree.drop[i] or inline[i] else composite(*loose[i], base) for i in range(n)]
    for i in range(1, n):
        if not inline[i]:
            total[tree.parent[i]] += density[i]
    return density, total, chars


def _path(tree: _Tree, density: list[float], total: list[float], chars: list[int]) -> list[int]:
    """The node that holds the article, and those above it."""
    live = [i for i in range(len(tree.name)) if not tree.drop[i]]
    best = max(live, key=lambda i: (total[i], -i))
    if total[best] <= 0:
        best = 0
    path, i = [], best
    while i >= 0:
        path.append(i)
        i = tree.parent[i]
    return path


def _least(tree: _Tree, density: list[float], path: list[int]) -> float:
    inner = [i for i in path if tree.name[i] not in ("#page", "html")] or path
    return min(density[i] for i in inner)


def _settle(tree: _Tree) -> None:
    """Leave out what is doubtful and less dense than the path to the article."""
    if not any(tree.doubt):
        return
    n, sure = len(tree.name), tree.drop
    live, _, _ = densities(tree)
    tree.drop = list(sure)
    for i in range(1, n):
        tree.drop[i] = sure[i] or tree.doubt[i] or tree.drop[tree.parent[i]]
    density, total, chars = densities(tree)
    least = _least(tree, density, _path(tree, density, total, chars)) if chars[0] else 0.0
    tree.drop = list(sure)
    for i in range(1, n):
        tree.drop[i] = sure[i] or tree.drop[tree.parent[i]] or tree.doubt[i] and (live[i] < least or live[i] <= 0)


def content(tree: _Tree) -> list[bool]:
    """Of each node whether it is in the article's subtree or a part beside it, and not left out."""
    _settle(tree)
    n = len(tree.name)
    density, total, chars = densities(tree)
    path = _path(tree, density, total, chars)
    best = path[0]
    threshold, above, on = _least(tree, density, path), set(path[1:]), set(path)
    own = [False] * n
    own[best] = True
    for i in range(1, n):
        if tree.parent[i] in above and i not in on and tree.name[i] in BLOCK and density[i] >= threshold > 0:
            own[i] = True
    for i in range(1, n):
        own[i] = (own[i] or own[tree.parent[i]]) and not tree.drop[i]
    return own


def extract(page: str) -> str:
    """The page's main text: blocks in page order joined by newlines, each with its white space as one
    space; no block: the empty string. A page without tags is one block."""
    tree = parse(page)
    own = content(tree)
    block = [0] * len(own)  # the nearest block at or above each node
    for i in range(1, len(own)):
        block[i] = i if tree.name[i] in BLOCK else block[tree.parent[i]]
    blocks: list[list[str]] = []
    last = None
    for node, text in tree.text:
        if tree.name[node] == "hr":
            last = None
        if not own[node]:
            if tree.name[block[node]] in BLOCK and block[node] != last:
                last = None
            continue
        if block[node] != last:
            blocks.append([])
            last = block[node]
        blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a null or empty page has the empty text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(p) for p in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), text_or_empty(html_col).alias("h")), each, "page_id long, url string, text string, n_chars long")
