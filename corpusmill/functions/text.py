"""Column functions over page text. Spark's regular expressions see ASCII classes, as the rules do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def word_list(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), "")


def word_count(c: Column) -> Column:
    """V6: non-empty tokens between white space."""
    return F.size(word_list(c)).cast("long")


def collapse(c: Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def heading_count(c: Column) -> Column:
    """C4: H2 to H6 lines."""
    return F.regexp_count(c, F.lit(r"(?m)^#{2,6}\s")).cast("long")


def code_block_count(c: Column) -> Column:
    """Pairs of fence lines at column 0."""
    return F.floor(F.regexp_count(c, F.lit(r"(?m)^```")) / 2).cast("long")


def discovery_markdown(c: Column) -> Column:
    """Two of five marks of markdown."""
    marks = (r"(?m)^#{1,6}\s", r"\[[^\]]+\]\([^)]+\)", r"(?m)^[-*]\s", r"```", r"(?m)^\|.*\|")
    return sum((F.regexp_like(c, F.lit(m)).cast("int") for m in marks), F.lit(0)) >= 2


def body_markdown(c: Column) -> Column:
    """Starts as a heading, or has two lower headings."""
    return F.regexp_like(c, F.lit(r"\A\s*#")) | (heading_count(c) >= 2)


def soft_404(c: Column) -> Column:
    """A9, over the first 2000 characters."""
    head = F.substring(c, 1, 2000)
    named = [r"(?im)^#\s*404(?![A-Za-z0-9_])", r"(?im)^#\s*page\s*not\s*found", r"(?im)^<title>[^\n]*404[^\n]*</title>"]
    short = (F.size(F.split(head, r"\s+")) < 50) & F.regexp_like(head, F.lit(r"(?i)not\s*found|does\s*not\s*exist"))
    found = short
    for r in named:
        found = found | F.regexp_like(head, F.lit(r))
    return found


def link_ratio(c: Column) -> Column:
    """S3: the share of non-blank lines that are bullets with a link; 0 without lines."""
    lines = F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: x != "")
    hits = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^[-*]\s*\[[^\]]*\]\([^)]*\)"))))
    return F.when(F.size(lines) == 0, F.lit(0.0)).otherwise(hits / F.size(lines))


def slugify(c: Column) -> Column:
    """K3."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def page_slug(path: Column) -> Column:
    """A10 without the collision suffix."""
    s = F.regexp_replace(F.replace(path, F.lit("/"), F.lit("_")), "^_+|_+$", "")
    return F.when(s == "", F.lit("index")).otherwise(s)


def title_of(c: Column, slug: Column) -> Column:
    """K2: first H1, else the slug."""
    t = F.regexp_extract(c, r"(?m)^# +([^\n]+)$", 1)
    return F.when(t == "", slug).otherwise(trimmed(t))


def without_links(c: Column) -> Column:
    """Link text alone."""
    return F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1")


def contaminated_answer(c: Column) -> Column:
    """A refusal or tool text in the first three lines."""
    head = F.array_join(F.slice(F.split(c, "\n"), 1, 3), "\n")
    refusal = r"(?i)I don.t see the actual|I.m ready to tighten|ready to tighten your documentation|Please provide the documentation|However, I don.t see"
    return F.regexp_like(head, F.lit(refusal)) | F.regexp_like(head, F.lit(r"(?i)function calls using tools|invoke name=|parameter name="))


def token_estimate(c: Column) -> Column:
    """K1: 1.33 a prose word, 2 a code word, 1.5 a CJK character; fenced spans are joined without a
    separator before their words are counted."""
    code = F.array_join(F.regexp_extract_all(c, F.lit(r"(?s)```.*?```"), F.lit(0)), "")
    cjk = F.regexp_count(c, F.lit(r"[\u3000-\u9fff\uf900-\ufaff\ufe30-\ufe4f]"))
    prose = word_count(c) - word_count(code)
    return F.floor(F.lit(1.33) * prose + F.lit(2.0) * word_count(code) + F.lit(1.5) * cjk + 0.5).cast("long")


def round_to(c: Column, places: int) -> Column:
    """Half up, on doubles."""
    return F.floor(c * float(10**places) + 0.5) / float(10**places)
