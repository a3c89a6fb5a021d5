"""Main text of web pages by the ratios of their tag paths.

Every text run of a page belongs to a root-to-leaf tag path. Per path the text length and the
punctuation are summed and set against the number of runs; the ratios are smoothed over the order of
the page, fused into one score and cut at a threshold that comes from their spread, on every page. Words in
class, id or role, and some tags, take out what stands below or lower its score, whatever its size, unless it
is a wrapper: there are no sentences outside it. The passing runs
point out the content: the deepest element with nearly all of their text, or what is marked as article
around it. All containers in it that hold a passing run are the article, short runs too.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
INNER = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header li ul ol dd dt dl blockquote pre td th tr thead tbody tfoot caption table figure figcaption address".split())  # blocks within a container
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split()) | frozenset(("hr",))
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("table td th caption html template button object article section main aside nav header footer form".split())

# Containers that hold no article text, by tag and by words in class, id or role.
BOILER_TAGS = frozenset("nav footer button select menu head label input".split())
WRAPPER_TAGS = frozenset("form dialog fieldset header".split())  # they may also stand around the whole page
SENTENCE = 40  # characters of a block, with a mark, that count as one
LOWERED = 0.1  # share of the score that is left below a word of BOILER_WORDS
NEARLY = 0.8  # of the passing text in the content element
BOILER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|foot|masthead|topbar|sidebar|side|aside|widget|related|recommend(?:ed|ations)?|promo|promotion|sponsor(?:ed)?|ads?|advert|adverts|advertisement|banner|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|respond|replies|reply|disqus|discussion|pagination|pager|toolbar|"
    r"contentinfo|complementary|search|form|skip|hidden|print-only|copyright|legal|disclaimer|tags|toc)(?:$|[\s_-]|\d)", re.I,
)
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)
STRONG_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|ads?|advert\w*|cookies?|sidebar|replies|footer|nav|menu)(?:$|[\s_-])", re.I)
PUNCTUATION = ".,;:!?…。，"
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?|"[^"]*"?|'[^']*'?""")
SPACE = re.compile(r"[\s\x00]+")


class Node:
    """An element: where it hangs, the number of its tag path, and how it counts."""

    __slots__ = ("article", "block", "boiler", "box", "depth", "low", "main", "mass", "parent", "path", "suspect", "tag")

    def __init__(self, tag: str, parent: "Node | None", path: int, boiler: bool, main: bool, article: bool, suspect: str = "") -> None:
        self.tag, self.parent, self.path, self.boiler, self.main, self.article, self.suspect = tag, parent, path, boiler, main, article, suspect
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or tag in BLOCK else parent.block  # the block that its text stands in
        self.box = self if parent is None or (tag in BLOCK and tag not in INNER) else parent.box  # and the container
        self.low, self.mass = False, 0.0


def _child(parent: Node, tag: str, attributes: str, paths: dict[tuple[int, str], int]) -> Node:
    names: dict[str, str] = {}
    for a, b, c, d in ATTRIBUTE.findall(attributes) if attributes else ():
        names.setdefault(a.lower(), b or c or d)
    words = " ".join(names.get(k, "") for k in ("class", "id", "role"))
    article = parent.article or tag in ("article", "main") or "main" in names.get("role", "").split()
    boiler = parent.boiler or tag in BOILER_TAGS or "hidden" in names or names.get("aria-hidden", "").lower() == "true"
    suspect = "strong" if tag == "aside" else "tag" if tag in WRAPPER_TAGS and not (tag == "header" and parent.article) else ""
    named = False
    if words.strip() and tag not in ("html", "body"):
        named = bool(MAIN_WORDS.search(words))
        if not suspect and tag not in ("article", "main"):
            word = bool(BOILER_WORDS.search(words)) and not MAIN_WORDS.search(names.get("class", "") + " " + names.get("id", ""))
            suspect = "strong" if STRONG_WORDS.search(words) else "word" if word else ""
        elif tag == "article" and STRONG_WORDS.search(words):
            suspect = "strong"
    label = tag + ("." + SPACE.sub(".", words.strip()) if words.strip() else "")
    path = paths.setdefault((parent.path, label), len(paths))
    return Node(tag, parent, path, boiler, named or tag in ("article", "main"), article, suspect)


def _settle(texts: list[str], nodes: list[Node], blocks: list[int], made: list[Node]) -> None:
    """Decide which suspect elements stand around the article and which beside it.

    An element named or tagged as a comment, sidebar, advert, form and so on is left out whatever its size if
    outside it, and in no other such element, there are sentences or an element marked as content, or if most of
    its text stands in no block of its own. Otherwise it is a wrapper of the page and counts like any other.
    """
    size, points = {}, {}  # of each block of text, by the innermost suspect element around it
    holder: dict[Node, Node] = {made[0]: made[0]}
    for node in made[1:]:
        holder[node] = node if node.suspect else holder[node.parent]
    for text, node, block in zip(texts, nodes, blocks):
        length = len(text.strip())
        if length and not node.boiler:
            key = holder[node], block
            size[key] = size.get(key, 0) + length
            points[key] = points.get(key, 0) + sum(map(text.count, PUNCTUATION))
    own, sentences = dict.fromkeys(holder.values(), 0), dict.fromkeys(holder.values(), 0)
    for (node, block), length in size.items():
        if length >= SENTENCE and points[node, block]:
            own[node] += length
            sentences[node] += 1
    total, direct = dict.fromkeys(made, 0), dict.fromkeys(made, 0)  # characters in an element, and not in a block of it
    for text, node in zip(texts, nodes):
        if not node.boiler:
            length = len(text.strip())
            total[node] += length
            direct[node.block] += length
    marked = dict.fromkeys(holder.values(), 0)  # elements marked as content, by the innermost suspect element around them
    for node in reversed(made[1:]):
        total[node.parent] += total[node]
        if node.main and not node.suspect and total[node]:
            marked[holder[node]] += 1
    inside, content = dict(own), dict(marked)
    for node in reversed(made[1:]):
        if node.suspect:
            inside[holder[node.parent]] += inside[node]
            content[holder[node.parent]] += content[node]
    outside = {made[0]: (0, 0, 0)}  # characters, sentences and marked elements that an element could be set against
    for node in made[1:]:  # parents come first
        node.boiler = node.boiler or node.parent.boiler
        node.low = node.parent.low
        if node.suspect:
            up = holder[node.parent]
            length, count, marks = (a[up] + b for a, b in zip((own, sentences, marked), outside[up]))
            outside[node] = length, count, marks
            beside = count > 1 or (2 if node.suspect == "tag" else 10) * length > inside[node] or (marks and not content[node])
            if beside or not inside[node] or 2 * direct[node] > total[node]:
                node.boiler = node.boiler or node.suspect != "word"
                node.low = True


def text_runs(page: str) -> tuple[list[str], list[Node], list[int], list[Node]]:
    """Text of every run, its element, the number of the block that it stands in; and all elements, parents first."""
    top = here = Node("", None, -1, False, False, False)
    made = [top]
    paths: dict[tuple[int, str], int] = {}
    open_tags: Counter[str] = Counter()

    def back_to(node: Node) -> None:
        """Close all elements below ``node``."""
        nonlocal here
        while here is not node:
            open_tags[here.tag] -= 1
            here = here.parent

    texts: list[str] = []
    nodes: list[Node] = []
    blocks: list[int] = []
    block, at, size = 0, 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        start = found.start() if found else size
        if start > at:
            texts.append(page[at:start])
            nodes.append(here)
            blocks.append(block)
        if not found:
            break
        at = found.end()
        closing, tag = found.group(1), found.group(2)
        if closing:
            tag = closing.lower()
            if tag in BLOCK:
                block += 1
            if tag == "br":
                texts.append(" ")
                nodes.append(here)
                blocks.append(block)
                continue
            if not open_tags[tag]:
                continue
            node = here
            while node.tag != tag:
                if node.tag in SCOPE and tag not in BLOCK:
                    node = top
                    break
                node = node.parent
            if node is not top:
                back_to(node.parent)
        elif tag:
            tag = tag.lower()
            if tag in BLOCK:
                block += 1
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if not found.group(3).rstrip().endswith("/"):
                    at = end.end() if end else (at if tag in ("svg", "math", "object", "template", "noscript", "canvas") else size)
                continue
            if tag in VOID:
                if tag in ("br", "hr", "wbr") and tag != "wbr":
                    texts.append(" ")
                    nodes.append(here)
                    blocks.append(block)
                continue
            if tag in CLOSES_P and open_tags["p"]:
                node = here
                while node.tag != "p" and node.tag not in SCOPE and node is not top:
                    node = node.parent
                if node.tag == "p":
                    back_to(node.parent)
            if tag in SAME_LEVEL and any(open_tags[t] for t in SAME_LEVEL[tag][0]):
                ends, stops = SAME_LEVEL[tag]
                node, last = here, None
                while node is not top and node.tag not in stops:
                    last = node if node.tag in ends else last
                    node = node.parent
                if last is not None:
                    back_to(last.parent)
            here = _child(here, tag, found.group(3), paths)
            open_tags[tag] += 1
            made.append(here)
    _settle(texts, nodes, blocks, made)
    return texts, nodes, blocks, made


def scores(texts: list[str], nodes: list[Node], blocks: list[int]) -> tuple[np.ndarray, float]:
    """Score of each run, which is the fused one of its tag path or less, and the threshold."""
    paths: dict[int, int] = {}
    index = np.fromiter((paths.setdefault(n.path, len(paths)) for n in nodes), np.int64, len(nodes))
    full = np.fromiter((len(t.strip()) for t in texts), np.float64, len(texts))
    marks = np.fromiter((sum(map(t.count, PUNCTUATION)) for t in texts), np.float64, len(texts))
    runs = np.maximum(np.bincount(index, full > 0, len(paths)), 1)
    length, points = np.bincount(index, full, len(paths)) / runs, np.bincount(index, marks, len(paths)) / runs
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")
    size = np.maximum(np.bincount(index, minlength=len(paths)), 1)
    fused = np.bincount(index, smooth(length[index]), len(paths)) / size * (1 + np.bincount(index, smooth(points[index]), len(paths)) / size)
    weight = np.fromiter((0.0 if n.boiler else LOWERED if n.low else 1.0 for n in nodes), np.float64, len(nodes))
    value = fused[index] * weight
    return value, float(np.std(value)) * 0.5


def main_text(page: str | None) -> str:
    """The article of one page; empty if there is none."""
    if not page:
        return ""
    texts, nodes, blocks, made = text_runs(page)
    if not texts:
        return ""
    score, threshold = scores(texts, nodes, blocks)
    held: set[Node] = set()
    for text, node, value in zip(texts, nodes, score.tolist()):
        if text.strip() and value > 0 and value >= threshold:
            held.add(node.box)
            node.box.mass += len(text.strip()) * (2.0 if node.box.article else 1.0)
    if not held:
        return ""
    for node in reversed(made[1:]):  # passing text at or below an element
        node.parent.mass += node.mass
    content = made[0]
    for node in made:
        if node.mass >= NEARLY * made[0].mass and node.depth >= content.depth:
            content = node
    node = content
    while node is not None:
        content, node = (node if node.main else content), node.parent
    below = {content}  # elements at or below the content element that hold a passing container
    within = {content}
    for node in made[1:]:
        if node.parent in within:
            within.add(node)
    for node in held:
        while node in within and node not in below:
            below.add(node)
            node = node.parent
    chosen = below if any(node in within for node in held) else set()
    out: list[str] = []
    part: list[str] = []
    last = -1

    def close() -> None:
        line = SPACE.sub(" ", entities.unescape("".join(part))).strip()
        if line:
            out.append(line)
        part.clear()

    for text, node, block, value in zip(texts, nodes, blocks, score.tolist()):
        if block != last:
            close()
            last = block
        if not node.boiler and node.box in chosen and not (node.low and value < threshold):
            part.append(text)
    close()
    return "\n".join(out)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty html gives an empty text. Rows are read one by one: repeated rows, null ids and
    null addresses keep their own result. An empty table gives an empty result. Other columns are
    left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [main_text(x) for x in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", html).mapInArrow(read, "page_id long, url string, text string, n_chars long")


def digest_rows(pages: DataFrame) -> DataFrame:
    return extract(pages)
