"""HTML to markdown over Arrow batches, on the standard library's parser. The tree builder closes
p, li and table cells that markup leaves open; other repair is not attempted. Where no content
element exists, the densest block by text outside links stands in (an approximation)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.functions.arrow import slices

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table tbody td tfoot th thead tr ul dt dd".split())
CHROME_TAGS = frozenset("aside footer header nav script style".split())
CHROME_CLASSES = frozenset("contents side-nav sidebar skip-link skip-to-content starlight-toc table-of-contents theme-doc-toc-desktop theme-doc-toc-mobile toc vp-doc-aside VPDocAside".split())
MIN_TEXT = 300


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None) -> None:
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        while self.at.tag in ends:
            self.at = self.at.up
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n and n.tag != tag:
            n = n.up
        if n and n.up:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def is_chrome(n: Node) -> bool:
    return n.tag in CHROME_TAGS or n.attrs.get("role") in ("navigation", "banner") or bool(n.classes() & CHROME_CLASSES) or "data-pagefind-ignore" in n.attrs


def text_of(n: Node, skip_chrome: bool = True) -> str:
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is n or not (skip_chrome and is_chrome(x)):
            todo += reversed(x.kids)
    return " ".join("".join(out).split())


SELECTORS = (
    lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: "md-content" in n.classes(), lambda n: "theme-doc-markdown" in n.classes(),
    lambda n: n.attrs.get("role") == "main", lambda n: n.attrs.get("id") == "main-content", lambda n: "markdown-body" in n.classes(), lambda n: "content" in n.classes(),
)


def main_content(root: Node) -> Node | None:
    """Of all content elements the one with the longest text; the first wins ties."""
    best, longest = None, 0
    nodes = list(root.walk())
    for test in SELECTORS:
        for n in nodes:
            if test(n) and (size := len(text_of(n))) > longest:
                best, longest = n, size
    if best is None:
        for n in nodes:
            if n.tag in ("div", "section", "body", "td") and not is_chrome(n):
                own = sum(len(text_of(k)) for k in n.kids if isinstance(k, Node) and k.tag in ("p", "pre", "ul", "ol", "blockquote"))
                if own > longest:
                    best, longest = n, own
    return best


def fence_language(pre: Node) -> str:
    """Language class of the code, then of the pre; data attributes; up to five ancestors."""
    code = next((k for k in pre.walk() if k.tag == "code"), None)
    pair = [x for x in (code, pre) if x]

    def of_class(n):
        found = re.search(r"(?:^|\s)language-([a-z0-9]+)", n.attrs.get("class") or "", re.I)
        return found.group(1) if found else ""

    for n in pair:
        if of_class(n):
            return of_class(n)
    for n in reversed(pair):
        if value := n.attrs.get("data-language") or n.attrs.get("data-lang"):
            return value
    up = pre.up
    for _ in range(5):
        if up is None:
            break
        if of_class(up):
            return of_class(up)
        up = up.up
    return ""


#: Signs of a text that would read as markup: anywhere, and where a text begins.
_SIGNS = re.compile(r"[\\*`\[\]_]")
_STARTS = re.compile(r"^(?:-|\+ |=+|#{1,6} |~~~|>)")


def _escaped(text: str) -> str:
    text = _SIGNS.sub(lambda m: "\\" + m.group(0), text)
    text = _STARTS.sub(lambda m: "\\" + m.group(0), text)
    return re.sub(r"^(\d+)\. ", r"\1\\. ", text)


def _code(inner: str) -> str:
    inner = re.sub(r"\r?\n|\r", " ", inner)
    if not inner:
        return ""
    ticks = "`"
    while re.search(f"(?<!`){ticks}(?!`)", inner):
        ticks += "`"
    pad = " " if inner[0] == "`" or inner[-1] == "`" or (inner[0] == inner[-1] == " " and inner.strip()) else ""
    return f"{ticks}{pad}{inner}{pad}{ticks}"


def _titled(n: Node) -> str:
    return f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""


def _around(inner: str, mark: str) -> str:
    """The mark at the text, blanks outside it."""
    text = inner.strip()
    at = inner.index(text)
    return f"{inner[:at]}{mark}{text}{mark}{inner[at + len(text):]}"


def _inline(n) -> str:
    if isinstance(n, str):
        return _escaped(re.sub(r"[ \t\r\n]+", " ", n))
    if is_chrome(n):
        return ""
    if n.tag == "br":
        return "  \n"
    if n.tag == "img":
        alt = re.sub(r"(\n+\s*)+", "\n", n.attrs.get("alt") or "")
        return f"![{alt}]({n.attrs['src']}{_titled(n)})" if n.attrs.get("src") else ""
    if n.tag == "code":
        return _code(_plain(n))
    inner = "".join(_inline(k) for k in n.kids)
    if n.tag == "a" and n.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({n.attrs['href']}{_titled(n)})"
    if n.tag in ("b", "strong") and inner.strip():
        return _around(inner, "**")
    if n.tag in ("i", "em") and inner.strip():
        return _around(inner, "_")
    return inner


def _blocks(n: Node, depth: int = 0) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush():
        text = re.sub(r"\n +", "\n", re.sub(r" {2,}(?!\n)", " ", "".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    for k in n.kids:
        if isinstance(k, str):
            line.append(_inline(k))
            continue
        if is_chrome(k):
            continue
        holds = any(x.tag in BLOCK or x.tag == "li" for x in k.walk())
        if not holds:
            line.append(_inline(k))
            continue
        flush()
        if re.fullmatch("h[1-6]", k.tag):
            title = " ".join("".join(_inline(x) for x in k.kids).split())
            if title:
                out.append(f"{'#' * int(k.tag[1])} {title}")
        elif k.tag == "pre":
            code = "".join(_plain(x) for x in k.kids)
            out.append(f"```{fence_language(k)}\n{code[:-1] if code.endswith(chr(10)) else code}\n```")
        elif k.tag in ("ul", "ol"):
            items = [x for x in k.kids if isinstance(x, Node) and x.tag == "li" and not is_chrome(x)]
            start = int(k.attrs["start"]) if (k.attrs.get("start") or "").isdigit() else 1
            rows = []
            for i, item in enumerate(items, start):
                inside = _blocks(item, depth + 1)
                # a paragraph within an item keeps its distance, a list below the item's text does not
                loose = any(isinstance(x, Node) and x.tag == "p" for x in item.kids)
                rows.append((f"{i}.  " if k.tag == "ol" else "*   ") + ("\n\n" if loose else "\n").join(inside).replace("\n", "\n    "))
            if rows:
                out.append("\n".join(rows))
        elif k.tag == "blockquote":
            out.append("\n".join("> " + x for x in "\n\n".join(_blocks(k, depth)).split("\n")))
        elif k.tag == "hr":
            out.append("* * *")
        else:
            out += _blocks(k, depth)
    flush()
    return out


def _plain(n) -> str:
    return n if isinstance(n, str) else "\n" if n.tag == "br" else "".join(_plain(k) for k in n.kids)


def to_markdown(html: str) -> tuple[str | None, int]:
    """(markdown or None where the content is under MIN_TEXT characters, length of its text)."""
    content = main_content(parse(html))
    size = len(text_of(content)) if content else 0
    if size < MIN_TEXT:
        return None, size
    return "\n\n".join(_blocks(content)), size


def html_to_markdown(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, markdown, n_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [to_markdown(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=[key, "markdown", "n_text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, markdown string, n_text long")
