"""The strip kernel: a line automaton per platform, then the generic steps in order, over Arrow
batches of whole pages (pages are independent, so nothing is shuffled). New platforms register a
pre-pass in REGISTRY. The island-shaped steps also exist as window plans in lines.py."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.functions.arrow import slices

I = re.I  # noqa: E741
LINK = re.compile(r"^\[.+\]\(.+\)$")
RULE = ("* * *", "---")


def _any(*patterns: str) -> Callable[[str], bool]:
    found = [re.compile(p, I) for p in patterns]
    return lambda t: any(p.search(t) for p in found)


footer = _any(
    "^(?:previous|next|pager|table of contents)$", "was this page (?:helpful|useful)", "edit on github|edit this page|suggest edits", "^last (?:updated|modified)|^on this page",
    "^© |^copyright|^(?:released|licensed) under ", r"^\[(?:previous|next) (?:page )?", r"^(?:#{1,6}\s+)?did you find this (?:doc|page) useful",
)
label = _any(r"^(?:#{1,6}\s+)?on this page(?![a-z0-9_])", "skip to (?:main )?content", r"^\[(?:back to top|edit this page)\]", "^(?:back to top|copy markdown)$")
consent = _any("cookie|accept all|privacy policy|(?<![a-z0-9_])consent(?![a-z0-9_])")
preamble = re.compile(r"^(?:Title|URL Source|Markdown Content):")
html_open = re.compile(r"^<(script|style|nav|footer)\b", I)
bullet_links = [re.compile(p) for p in (r"^[*\-+]\s+\[.+\]\(.+\)\s*$", r"^[*\-+]\s+\[.+\]\(https?://.+\)", r"^[*\-+]\s+- \[x\]\s+\[.+\]\(.+\)")]
numbered_link = re.compile(r"^\d+\.\s+\[")
numbered = re.compile(r"^\d+\.\s+\S")


def nav_line(line: str) -> bool:
    t = line.strip()
    return bool(LINK.match(t)) or any(p.match(t) for p in bullet_links) or bool(re.match(r"^[*\-+]\s+\S+\s*$", t) and "." not in t and len(t) < 60)


def _html_blocks(lines, removed):
    out, closing = [], None
    for line in lines:
        if closing is None and (m := html_open.match(line)):
            closing = f"</{m.group(1).lower()}"
            removed.append(f"html block: {m.group(1).lower()}")
        if closing is None:
            out.append(line)
        elif closing in line.lower():
            closing = None
    return out


def _preamble(lines, removed):
    i = 0
    while i < len(lines) and preamble.match(lines[i]):
        i += 1
    if i:
        removed.append(f"reader preamble: {i} lines")
    while i < len(lines) and not lines[i].strip():
        i += 1
    return lines[i:]


def _header(lines, removed):
    first = next((i for i, x in enumerate(lines) if re.match(r"^#{1,2} ", x)), 0)
    if first:
        removed.append(f"header chrome: {first} lines")
    return lines[first:]


def _title_nav(lines, removed):
    if not lines or not re.match(r"^#{1,2} ", lines[0]):
        return lines
    start, nav, other = -1, 0, 0
    for i in range(1, len(lines)):
        t = lines[i].strip()
        if not t or t in RULE:
            continue
        if re.match(r"^#{1,2} ", t) and nav >= 5:
            start = i
            break
        on_page = t.lower().startswith("on this page")
        shaped = nav_line(lines[i]) or re.match(r"^\[!\[.*\]\(.*\)\]\(.*\)$", t) or (t.startswith("*") and len(t) < 50 and ". " not in t) or (re.match(r"^\s+\*", lines[i]) and len(t) < 60) or re.search(r"- \[x\]\s+\[.+\]\(.+\)", t) or numbered_link.match(t)
        if shaped or on_page:
            nav += 1
            continue
        prose = len(t) > 80 and t[0] not in "[*"
        if prose or (re.match(r"^#{1,6} ", t) and i + 1 < len(lines) and len(lines[i + 1].strip()) > 40):
            start = i
            break
        other += 1
        if other > 5 and nav < 3:
            break
    if nav >= 5 and start > 0:
        removed.append(f"navigation below the title: {nav} lines")
        return [lines[0], "", *lines[start:]]
    return lines


def _drop(name: str, test: Callable[[str], bool]):
    def step(lines, removed):
        out = [x for x in lines if not test(x)]
        if len(out) < len(lines):
            removed.append(f"{name}: {len(lines) - len(out)} lines")
        return out

    return step


def _runs(name: str, test: Callable[[str], bool], least: int):
    def step(lines, removed):
        out, run = [], []
        for line in [*lines, None]:
            if line is not None and test(line):
                run.append(line)
                continue
            if len(run) >= least:
                removed.append(f"{name}: {len(run)} lines")
            else:
                out += run
            run = []
            if line is not None:
                out.append(line)
        return out

    return step


def _link_clusters(lines, removed):
    """Runs of three bare links and over between blanks, or at the end."""
    out, run = [], []
    for line in [*lines, None]:
        if line is not None and LINK.match(line.strip()):
            run.append(line)
            continue
        alone = line is None or ((not out or not out[-1].strip()) and not line.strip())
        if len(run) >= 3 and alone:
            removed.append(f"link cluster: {len(run)} lines")
        else:
            out += run
        run = []
        if line is not None:
            out.append(line)
    return out


def _footer(lines, removed):
    half = len(lines) // 2
    last = next((i for i in range(len(lines) - 1, half - 1, -1) if footer(lines[i].strip())), None)
    if last is None:
        return lines
    removed.append(f"footer: {lines[last].strip()[:60]}")
    cut = last
    for i in range(last - 1, half - 1, -1):
        t = lines[i].strip()
        if t and not footer(t) and not LINK.match(t) and not re.match(r"^[*-]\s+\[.+\]\(.+\)$", t) and t not in RULE:
            break
        cut = i
    return lines[:cut]


def _plain_title(h: str) -> str:
    h = re.sub(r"\s*[|\-–—]\s*.+$", "", h)
    return " ".join(re.sub("\\[[¶\u200b]\\]\\([^)]*\\)", "", h).split())


def _double_title(lines, removed):
    tops = [i for i, x in enumerate(lines) if x.startswith("# ")][:2]
    if len(tops) == 2:
        a, b = (_plain_title(lines[i]) for i in tops)
        if a.startswith(b) or b.startswith(a):
            removed.append("duplicate title")
            return lines[: tops[0]] + lines[tops[0] + 1 :]
    return lines


def _blanks(lines, removed):
    out, run = [], 0
    for line in lines:
        run = run + 1 if not line.strip() else 0
        if run <= 2:
            out.append(line)
    return out


GENERIC = (
    _html_blocks, _preamble, _header, _title_nav, _drop("breadcrumb", lambda x: x.count(" > ") >= 3), _drop("chrome label", lambda x: label(x.strip())), _drop("consent", consent),
    _runs("nav block", nav_line, 5), _link_clusters, _footer, _double_title, _runs("numbered breadcrumb", lambda x: bool(numbered_link.match(x.strip()) or (numbered.match(x.strip()) and len(x.strip()) < 80)), 2), _blanks,
)


def generic(lines: list[str], removed: list[str]) -> str:
    for step in GENERIC:
        lines = step(lines, removed)
    return "\n".join(lines).strip()


def _blocks(marker, inside, cap: int, keep_end: bool = True, opens=None, rearm: bool = True):
    """A block opened by a marker line swallows inside lines, cap of them at most; the line that
    ends it is kept unread."""

    def step(lines, removed):
        out, left = [], None
        for i, line in enumerate(lines):
            t = line.strip()
            if left is not None and not rearm:
                pass
            elif marker(t) and (opens is None or opens(lines, i)):
                left = cap
                removed.append(f"block: {t[:40]}")
                continue
            if left is not None:
                if inside(t) or (rearm and marker(t)):
                    left = left - 1 if left > 0 else None
                    continue
                left = None
                if keep_end:
                    out.append(line)
                    continue
            out.append(line)
        return out

    return step


def _linkish(t: str) -> bool:
    return t == "" or bool(LINK.match(t))


def _next(lines, i) -> str:
    return lines[i + 1].strip() if i + 1 < len(lines) else ""


def _gitbook_toc(lines, removed):
    out, toc, nav = [], False, False
    head, bold = _any("^(?:on this page|table of contents|in this article)$"), re.compile(r"^\*\*[^*]+\*\*$")
    for i, line in enumerate(lines):
        t = line.strip()
        if head(t):
            toc = True
            removed.append("gitbook contents")
            continue
        if toc:
            if t == "" or t[0] in "[*" or t.startswith("- "):
                continue
            toc = False
        if bold.match(t) and i + 1 < len(lines) and LINK.match(_next(lines, i)):
            nav = True
            removed.append(f"gitbook section: {t[:40]}")
            continue
        if nav:
            if _linkish(t) or bold.match(t):
                continue
            nav = False
        out.append(line)
    return out


_types = _any("^(?:string|integer|number|boolean|object|array|required|optional)$")
_search = _any("^(?:type to start searching|initializing search|search|no matching documents)$")
_page_turn = _any("^(?:previous|next)$")
_version = _any(r"^v:\s", "^(?:versions|latest|stable|languages|downloads|on read the docs|project home|builds)$")


def _search_opens(lines, i) -> bool:
    return lines[i].strip().lower() != "search" or bool(re.search("initializing|type to start|no matching", " ".join(lines[max(0, i - 2) : i + 3]), I))


def _docusaurus_labels(lines, removed):
    names = _any("^(?:docs|api|blog|community)$")
    return [x for i, x in enumerate(lines) if not (names(x.strip()) and _linkish(_next(lines, i)))]


_rtd = (
    _drop("rtd footer", _any("built with sphinx|created using sphinx|powered by read the docs|read the docs v:", "built with .* using a theme provided by read the docs")),
    _blocks(_version, _linkish, 10),
    _blocks(_any("^(?:navigation|quick search|search docs|indices and tables)$"), lambda t: _linkish(t) or t[:2] in ("- ", "* "), 20),
)
_mkdocs = (
    _drop("mkdocs footer", _any("made with (?:material for )?mkdocs|powered by mkdocs|documentation built with mkdocs|using the material theme")),
    _drop("mkdocs chrome", lambda x: _any("^(?:skip to content|back to top|toggle navigation)$")(x.strip())),
    _blocks(_search, lambda t: t == "", 5, opens=_search_opens),
)
REGISTRY: dict[str, tuple] = {
    "gitbook": (_drop("gitbook footer", _any("powered by gitbook|last modified")), _gitbook_toc),
    "docusaurus": (_drop("docusaurus footer", _any("(?:built with|powered by) docusaurus")), _drop("docusaurus edit link", lambda x: _any(r"^\[?edit this page")(x.strip())), _blocks(_page_turn, _linkish, 4), _docusaurus_labels),
    "readthedocs": _rtd,
    "sphinx": _rtd,
    "mintlify": (
        _drop("mintlify footer", _any("(?:powered by|built with) mintlify")),
        _drop("mintlify meta", lambda x: _any(r"^(?:was this page helpful\?|suggest edits|raise issue)$")(x.strip())),
        _blocks(lambda t: bool(re.match("^(?:authorization|bearer token|header|query parameters|path parameters|body|responses)$", t, I) or re.match("^curl --request", t)), lambda t: t == "" or _types(t), 30, opens=lambda ls, i: _next(ls, i) == "" or _types(_next(ls, i)), rearm=False),
    ),
    "mkdocs": _mkdocs,
    "mkdocs-material": _mkdocs,
}


def usable(text: str) -> bool:
    lines = text.split("\n")
    return any(re.match(r"^#{1,6} ", x) for x in lines) or any(len(x.strip()) > 40 and x[:1] not in ("#", "[", "*", "-") and not re.match(r"^\d+\.", x.strip()) for x in lines)


def strip_page(content: str, platform: str | None = None) -> tuple[str, list[str], bool]:
    """(clean text, what was removed, quality gate failed). Platforms without a pre-pass are generic."""
    removed: list[str] = []
    lines = (content or "").split("\n")
    for step in REGISTRY.get(platform or "", ()):
        lines = step(lines, removed)
    clean = generic(lines, removed)
    if not usable(clean) and len(clean) < 50:
        return content or "", removed, True
    return clean, removed, False


def strip_pages(pages: DataFrame, platform: str | None = None) -> DataFrame:
    """pages (page_ord, content[, platform]) -> (page_ord, content, removed, quality_gate_failed)."""
    own = "platform" in pages.columns and platform is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kinds = batch.column(2).to_pylist() if own else [platform] * batch.num_rows
            rows = [strip_page(c, k) for c, k in zip(batch.column(1).to_pylist(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.bool_())], names=["page_ord", "content", "removed", "quality_gate_failed"])

    return pages.select("page_ord", "content", *(["platform"] if own else [])).mapInArrow(run, "page_ord long, content string, removed array<string>, quality_gate_failed boolean")
