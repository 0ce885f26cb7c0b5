"""Main text of web pages by tree scoring.

A small tree is built from tags.  Paragraphs give points for length and commas to their parent and,
by half and third shares, to ancestors further up; a container's points are discounted by its share
of text inside links.  The best container and those siblings that score like it are kept; menus,
headers, footers, sidebars, notices, adverts, forms and comments inside are left out, unless they are
wrappers around the article itself.  Reading and scoring take time linear in the page, whatever is
left open in it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title textarea iframe noembed noframes xmp object embed applet canvas svg audio video map select option button input form fieldset label datalist output progress meter dialog menu nav header footer aside".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td blockquote center details dd li table tbody tr html figure".split())
#: Open elements that a start tag closes, and where the search for them ends.
P_CLOSERS = BLOCKS - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "optgroup", "legend", "frameset"} | {"li", "dd", "dt"}
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")),
    "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tr td th", ("table",)), "thead": ("tr td th", ("table",)), "option": ("option", ("select", "datalist")),
}
#: Words in class, id or role that mark what is not the article, and what is.
UNWANTED = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|breadcrumbs?|comments?|commentlist|commenters?|disqus|replies|respond|responses|discussion|cookies?|consent|gdpr|notices?|alert|alertdialog|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|form|menu|navbar|nav|navigation|topnav|pager|pagination|footer|foot|header|masthead|sidebar|side|aside|widgets?|related|recommend\w*|share|sharing|social|toolbar|skip|search|tags|tagcloud|toc|outbrain|taboola|complementary|contentinfo|dialog|status|hidden)(?:$|[_-])",
    re.I,
)
WANTED = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog|hentry|prose)(?:$|[\s_-])", re.I)
#: Names that tell of a layout around what they mark, and names of the article itself.
LAYOUT = re.compile(r"^(?:has|with|no|without|is|js|hide|show)[_-]", re.I)
ARTICLE = frozenset("article article-body article-content main main-content entry-content post-content post-body story-body".split())
#: Elements that some pages put around everything, the article too.
WRAPPERS = frozenset("form header fieldset".split())
COMMENTS = re.compile(r"comment|disqus|replies|respond|responses|discussion", re.I)
#: Blocks that may hold paragraphs of their own, so that one outside them stays open.
HOLDERS = frozenset("div section article main td th table blockquote body li button object figure details caption".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>=]")
VALUE = re.compile(r"\s*([\"'])")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")


def unwanted(tag: str, marks: str) -> bool:
    """Whether an element's names say that it is not part of the article."""
    if not marks or tag in ("html", "body", "main"):
        return False
    names = CAMEL.sub("-", marks).split()
    return any(UNWANTED.search(n) and not LAYOUT.match(n) for n in names) and not any(n.lower() in ARTICLE for n in names)


class Node:
    __slots__ = ("tag", "kids", "up", "marks", "points", "size", "linked", "skip", "depth", "block", "para", "box")

    def __init__(self, tag: str, up: Node | None, marks: str = "", skip: bool = False) -> None:
        self.tag, self.up, self.marks, self.skip = tag, up, marks, skip
        self.kids: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = 0
        # what would else be looked for by walking up: depth, the nearest block's, the open paragraph, the nearest container
        self.depth = up.depth + 1 if up else 0
        self.block = self.depth if tag in BLOCKS or up is None else up.block
        self.para = self if tag == "p" else None if tag in HOLDERS or up is None else up.para
        self.box = self if tag in CONTAINERS else up.box if up else None


class Open:
    """The open elements: a path from the root, and for each tag the depths at which it stands in it."""

    def __init__(self, root: Node) -> None:
        self.path = [root]
        self.depths: dict[str, list[int]] = {}

    @property
    def here(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        self.path.append(node)
        self.depths.setdefault(node.tag, []).append(node.depth)

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all in it; the root stays open."""
        while len(self.path) > max(1, depth):
            self.depths[self.path.pop().tag].pop()

    def last(self, tag: str) -> int:
        """Depth of the innermost open ``tag``, 0 if there is none."""
        return self.depths[tag][-1] if self.depths.get(tag) else 0

    def close_among(self, names: str, stops: tuple[str, ...]) -> None:
        """Close the outermost of ``names`` that stands inside the innermost of ``stops``."""
        inside = max(map(self.last, stops), default=0)
        found = [d[k] for n in names.split() if (d := self.depths.get(n)) and (k := bisect_right(d, inside)) < len(d)]
        if found:
            self.close(min(found))


class Source:
    """Searches that are not repeated once they have found nothing further on, so that reading is linear."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.gone: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.text.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """Where the ``>`` stands that ends a tag; quoted values may hold others.  -1 if there is none."""
        while self.find(">", at) >= 0:
            m = STOP.search(self.text, at)
            if m[0] == ">":
                return m.start()
            at = m.end()
            if q := VALUE.match(self.text, at):
                k = self.find(q[1], q.end())
                at = k + 1 if k >= 0 else q.end()
        return -1


def parse(text: str) -> Node:
    """The tree of elements and texts, in time linear in the text.  Unclosed and misnested tags are mended as browsers do in the common cases."""
    root = Node("html", None)
    source, tree = Source(text), Open(root)
    at = plain = 0  # text from ``plain`` on is not yet in the tree
    while (at := source.find("<", at)) >= 0:
        follows = text[at + 1 : at + 2]
        if text.startswith("<!--", at):
            ends = [(k, n) for mark, n in (("-->", 3), ("--!>", 4)) if (k := source.find(mark, at + 4)) >= 0]
            stop = min(ends)[0] + min(ends)[1] if ends else len(text)
            tag = None
        elif follows and follows in "!?" or follows == "/" and not text[at + 2 : at + 3].isalpha():
            k = source.find(">", at)
            stop, tag = k + 1, None
            if k < 0 or follows == "/" and k == at + 2:
                at += 1
                continue
        elif m := NAME.match(text, at + 1 + (follows == "/")):
            k = source.tag_end(m.end())
            if k < 0:
                at += 1
                continue
            stop, tag = k + 1, m[0].lower()
        else:
            at += 1
            continue
        if at > plain:
            tree.here.kids.append(text[plain:at])
        at = plain = stop
        if tag is None:
            continue
        if follows == "/":
            _end(tree, tag)
            continue
        attributes = text[m.end() : k]
        if tag in ("html", "body") and tree.here is not root:
            continue
        node = _start(tree, tag, attributes)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            if tag not in DROPPED:
                node.kids.append(text[at : close.start() if close else len(text)])
            at = plain = close.end() if close else len(text)
            continue
        tree.push(node)
    if plain < len(text):
        tree.here.kids.append(text[plain:])
    return root


def _start(tree: Open, tag: str, attributes: str) -> Node:
    """Close what a start tag closes, and put its element into the tree."""
    if tag in P_CLOSERS and tree.here.para is not None:
        tree.close(tree.here.para.depth)
    if tag in CLOSES:
        tree.close_among(*CLOSES[tag])
    marks, skip = "", tag in DROPPED
    if "=" in attributes or "hidden" in attributes:
        got = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        marks = " ".join(filter(None, (got.get("class"), got.get("id"), got.get("role"))))
        skip = skip or "hidden" in got or got.get("aria-hidden") == "true" or bool(HIDDEN.search(got.get("style", "")))
    node = Node(tag, tree.here, marks, skip)
    tree.here.kids.append(node)
    return node


def _end(tree: Open, tag: str) -> None:
    if tag == "p" and tree.here.para is None:
        tree.here.kids.append(Node("p", tree.here))
        return
    depth = tree.last(tag)
    # a closing inline tag doesn't reach over a block
    if depth and (tag in BLOCKS or depth >= tree.here.block):
        tree.close(depth)


def _all(root: Node) -> list[Node]:
    """All nodes, each before its children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def judge(root: Node) -> None:
    """Decide which elements are passed over: by their kind and names, but for those around the article.

    A form, a header or an element with an unwanted name stays if it is a wrapper: it holds half of the
    page's paragraph text or more, and an article, main or first heading of the page stands in it (of
    names of readers' comments, an article or main doesn't count).  An article's own header stays if
    it is a heading with little else.
    """
    nodes = _all(root)
    size: dict[int, int] = {}
    marks: dict[int, int] = {}
    heading = next((n for n in nodes if n.tag == "h1"), None)
    doubtful = []
    for node in reversed(nodes):
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str)) if node.box is not None and node.tag not in DROPPED else 0
        if own <= 40 and node.tag not in ("p", "pre", "blockquote", "li"):
            own = 0
        kids = [k for k in node.kids if isinstance(k, Node)]
        size[id(node)] = own + (0 if node.tag in DROPPED and node.tag not in WRAPPERS else sum(size[id(k)] for k in kids))
        marks[id(node)] = 2 * (node.tag in ("article", "main") and not unwanted(node.tag, node.marks)) | (node is heading)
        for k in kids:
            marks[id(node)] |= marks[id(k)]
        named = unwanted(node.tag, node.marks)
        if named or node.skip and node.tag in WRAPPERS:
            doubtful.append((node, named))
    whole = size[id(root)]
    for node, named in doubtful:
        inside = marks[id(node)] & (1 if COMMENTS.search(node.marks) else 3)
        wrapper = whole > 0 and 2 * size[id(node)] >= whole and inside and not (node.tag in DROPPED and node.tag not in WRAPPERS)
        node.skip = not wrapper
    for node in nodes:
        if node.tag == "header" and node.skip and any(u.tag in ("article", "main") for u in _above(node)) and not unwanted("div", node.marks):
            titles = [k for k in node.kids if isinstance(k, Node) and k.tag in ("h1", "h2", "hgroup")]
            if titles:
                node.skip = False
                for k in node.kids:
                    if isinstance(k, Node) and k.tag in ("ul", "ol"):
                        k.skip = True


def _above(node: Node) -> Iterator[Node]:
    """Up to eight elements around a node."""
    for _ in range(8):
        node = node.up
        if node is None:
            return
        yield node


def _in_order(root: Node) -> list[Node]:
    """Nodes that are not passed over, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.skip)
    return out


def score(root: Node) -> Node:
    """Points of all containers; the best one, or the root where nothing has any."""
    judge(root)
    nodes = _in_order(root)
    for node in reversed(nodes):
        for kid in node.kids:
            if isinstance(kid, str):
                node.size += len(kid.strip())
            elif not kid.skip:
                node.size += kid.size
                node.linked += kid.linked
        if node.tag == "a":
            node.linked = node.size
    for node in nodes:
        text = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        paragraph = node.tag in ("p", "pre", "td", "blockquote", "li", "dd") or text > 80 and node.tag in CONTAINERS
        if not paragraph or node.size < 1:
            continue
        words = "".join(k for k in node.kids if isinstance(k, str))
        points = 1 + words.count(",") + words.count("，") + min(3.0, node.size / 100)
        points *= 1 - node.linked / node.size
        # a paragraph's own container gets all, further ones less and less
        up, share = (node if node.tag in CONTAINERS and node.tag not in ("li", "td", "dd") else node.up), 1.0
        while up is not None and (up := up.box) is not None and share > 0.1:
            up.points += points * share
            share *= 0.5
            up = up.up
    best = None
    for node in nodes:
        if node.tag not in CONTAINERS or not node.size:
            continue
        weight = 25.0 * (node.tag in ("article", "main")) + 10.0 * bool(node.marks and WANTED.search(node.marks))
        value = (node.points + (weight if node.points else 0)) * (1 - node.linked / node.size)
        if value > 0 and (best is None or value > best[0]):
            best = (value, node)
    return best[1] if best else root


def keepers(best: Node) -> list[Node]:
    """The best container and siblings that score like it, in page order."""
    if best.up is None or best.tag in ("article", "main", "body"):
        # several articles side by side are one text
        if best.up is not None and best.tag == "article":
            return [k for k in best.up.kids if isinstance(k, Node) and not k.skip and (k is best or k.tag == "article" and k.points >= max(10.0, 0.2 * best.points))]
        return [best]
    need = max(10.0, 0.2 * best.points)
    out = []
    for kid in best.up.kids:
        if not isinstance(kid, Node) or kid.skip:
            continue
        density = kid.linked / kid.size if kid.size else 1.0
        if kid is best or kid.points * (1 - density) >= need or kid.tag == "p" and kid.size > 80 and density < 0.25 or kid.tag in ("h1", "h2") and density < 0.5:
            out.append(kid)
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order: white space made single, trimmed, none empty."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.skip:
            block = x.tag in BLOCKS
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return out


def main_text(source: str | None) -> str:
    """The page's article, blocks joined by newlines; "" where there is none."""
    if not source:
        return ""
    best = score(parse(source))
    return "\n".join(b for node in keepers(best) for b in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html, where it was read.

    Null html is an empty page; null ids and urls, repeated rows and further columns are allowed,
    and further columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
