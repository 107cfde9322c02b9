"""Main-text extraction by consensus host paths.

First pass: every page scores its containers (text in paragraphs, less the text of links, half of it
passed on to the parent) and names the generalised path of the best one: tags and classes from the
root down, digits dropped. Spark sums these votes per host and path. Second pass: each page is read
again and the elements on its host's winning path give the text; a page that has none of them uses
its own best container.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopressure.llm.store import Scratch
from geopressure.llm.tasks import lean

#: Winning paths up to this many bytes are sent to every executor; beyond, pages are joined by host.
MAX_BROADCAST = 16 << 20
#: Copies of a host's winning path in the join by host, so that one host's pages are spread.
SALTS = 64

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^<>"'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Open elements at once; what is nested deeper belongs to the innermost of these, as in browsers.
DEPTH = 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
TEXTUAL = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre".split())
#: Menus, footers, sidebars and forms, and what is never shown: parts of a drawing or formula that describe it.
SKIPPED = frozenset("nav footer aside form button menu head input desc metadata annotation annotation-xml".split())
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
#: Start tag to the open tags that it closes, and the tags that shield those further out.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Words of class, id or role names that mark what is not the article.
CLUTTER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|newsletter|subscri\w*|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|related|recommend\w*|shar(?:e|ing)|social|comments?|commentlist|"
    r"disqus|respond|repl(?:y|ies)|popup|modal|login|signup|footer|masthead|widgets?|pagination|pager|toolbar|search|"
    r"complementary|contentinfo|alert|hidden|sr-only|skip|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)


class Node:
    """An open element: its path, its score so far, and whether its text is left out."""

    __slots__ = ("links", "path", "score", "skipped", "tag")

    def __init__(self, tag: str, path: str, skipped: bool) -> None:
        self.tag, self.path, self.skipped = tag, path, skipped
        self.score = self.links = 0.0


def _names(raw: str) -> tuple[str, bool]:
    """The generalised classes of an element, and whether its attributes mark it as clutter."""
    if not raw.strip(" /"):
        return "", False
    classes, marked = "", False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name == "class":
            classes = ".".join(sorted({re.sub(r"\d+", "", x) for x in value.lower().split()} - {""}))
            marked |= bool(CLUTTER.search(value))
        elif name in ("id", "role"):
            marked |= bool(CLUTTER.search(value))
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            marked = True
        elif name == "style":
            marked |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return classes, marked


def walk(page: str, on_text, on_open, on_close) -> None:
    """Read a page: calls with each text run, each opened and each closed element."""
    stack = [Node("", "", False)]
    at, raw_end, n = 0, None, len(page)
    flat: Counter = Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            on_close(stack.pop(), stack)

    while at < n:
        if raw_end:
            found = re.compile(rf"</{re.escape(raw_end)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at, raw_end = (found.end() if found else n), None
            continue
        token = TOKEN.search(page, at)
        if token is None:
            on_text(page[at:], stack)
            break
        if token.start() > at:
            on_text(page[at : token.start()], stack)
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if flat[tag]:
                flat[tag] -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            else:
                if tag == "p":
                    on_open(Node("p", "", stack[-1].skipped), stack)
            continue
        if tag in RAW:
            if not token[3].endswith("/") or tag in ("script", "style", "title", "textarea", "iframe"):
                raw_end = tag
            continue
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in ("button", "td", "th", "table", "article", "div", "section"):
                    break
        if tag in IMPLIED:
            closes, shields = IMPLIED[tag]
            low = None
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in shields:
                    break
                if stack[depth].tag in closes:
                    low = depth
            if low is not None:
                close(low)
        classes, marked = _names(token[3])
        inside = any(x.tag in ("article", "main") for x in stack)
        skipped = stack[-1].skipped or marked or tag in SKIPPED or (tag == "header" and not inside)
        skipped |= tag == "dialog" and not re.search(r"(?:^|\s)open(?:[\s=/]|$)", token[3], re.I)
        if tag in ("html", "body"):
            skipped = False
        name = tag + ("." + classes if classes else "")
        node = Node(tag, f"{stack[-1].path}>{name}" if tag in BLOCK else stack[-1].path, skipped)
        on_open(node, stack)
        if tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
        elif tag not in VOID:
            flat[tag] += 1
    close(1)
    on_close(stack[0], [])


def _squash(text: str) -> str:
    return " ".join(html.unescape(text).split()) if "&" in text else " ".join(text.split())


def best_path(page: str) -> tuple[str, float]:
    """The generalised path of the best container of a page, and its score."""
    totals: dict[str, list[float]] = {}

    def on_text(text: str, stack: list[Node]) -> None:
        size = len(_squash(text))
        if not size or stack[-1].skipped:
            return
        linked = textual = False
        for node in reversed(stack):
            linked |= node.tag == "a"
            textual |= node.tag in TEXTUAL
            if node.tag in CONTAINERS:
                node.score += size * (1.0 if textual else 0.5)
                node.links += size * linked
                break

    def on_close(node: Node, stack: list[Node]) -> None:
        if node.tag not in CONTAINERS or not node.score:
            return
        own = totals.setdefault(node.path, [0.0])
        own[0] += node.score * (1 - min(1.0, node.links / node.score))
        for parent in reversed(stack):
            if parent.tag in CONTAINERS:
                parent.score += node.score / 2
                parent.links += node.links / 2
                break

    walk(page, on_text, lambda node, stack: None, on_close)
    return max(((path, score) for path, (score,) in totals.items()), key=lambda x: (x[1], x[0]), default=("", 0.0))


def extract(page: str, path: str) -> list[str]:
    """The blocks of text in the outermost elements on ``path``, in page order."""
    blocks: list[str] = []
    run: list[str] = []
    inside: list[Node] = []

    def flush() -> None:
        if run:
            if text := _squash("".join(run)):
                blocks.append(text)
            run.clear()

    def on_text(text: str, stack: list[Node]) -> None:
        if inside and not stack[-1].skipped:
            run.append(text)

    def on_open(node: Node, stack: list[Node]) -> None:
        if node.tag in BLOCK:
            flush()
        elif node.tag == "br" and inside:
            # A line break is white space inside its block; it ends none.
            run.append(" ")
        if not inside and node.path == path and node.tag in CONTAINERS and not node.skipped:
            inside.append(node)

    def on_close(node: Node, stack: list[Node]) -> None:
        if node.tag in BLOCK:
            flush()
        if inside and node is inside[0]:
            flush()
            inside.clear()

    walk(page, on_text, on_open, on_close)
    return blocks


@lean
def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [best_path(page.as_py() or "") for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
            ["host", "path", "score"],
        )


@lean
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, path in zip(batch.column("html"), batch.column("path"), strict=True):
            page, path = page.as_py() or "", path.as_py()
            blocks = extract(page, path) if path else []
            if not blocks and page:
                own, score = best_path(page)
                blocks = extract(page, own) if score else []
            texts.append("\n".join(blocks))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def host_of(url):
    """Host name of a URL, lower-cased, without user or port; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the path with most votes of each host, then most text, then the least path."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("html is not null")
    votes = rows.mapInArrow(_vote, "host string, path string, score double").where("score > 0")
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    # The least struct: most votes, most text, least path. It combines early, so a host's paths never meet in one task.
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.round("score")).alias("score"), "path"))
    return votes.groupBy("host").agg(best.alias("best")).select("host", "best.path")


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages(page_id, url, html, ...)``.

    The blocks of the main text are joined by one newline; white space inside a block, a ``br`` included, is one space. Formulas, drawings'
    words, labels, captions and fallback text inside the article are kept; menus, forms, notices and what a browser never shows are not. A
    null or empty html has an empty text. A page without a host votes and is read with the other
    pages without one. Rows that repeat stay; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "html")
    paths = scratch.save(winning_paths(pages))
    size = paths.agg(F.sum(F.length("host") + F.length("path") + 32)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if size <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string")
