"""Pages as arrays of lines, one row a page: every operator here is an expression over the row, so
nothing is exploded, shuffled or sorted. Runs of lines are found on masks, strings that hold one
character a line, whose stretches of equal characters a regular expression lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import trimmed


def page_lines(pages: DataFrame, *others: str, key: str = "page_ord", text: str = "content") -> DataFrame:
    """(key, ls, others): ls holds (pos, line, t) of each line; pos counts from 0, t is trimmed."""
    # a generator between the steps keeps each from being worked out once per line
    split = pages.select(key, *others, F.explode(F.array(F.split(F.col(text), "\n"))).alias("raw"))
    made = F.transform("raw", lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("line"), trimmed(x).alias("t")))
    return split.select(key, *others, F.explode(F.array(made)).alias("ls"))


def to_lines(pages: DataFrame, key: str = "page_ord", text: str = "content") -> DataFrame:
    """(key, pos, line, t): a row a line."""
    return page_lines(pages, key=key, text=text).select(key, F.inline("ls"))


def from_lines(lines: DataFrame, key: str = "page_ord") -> DataFrame:
    """(key, content) of a row a line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy(key).agg(text.alias("content"))


def join_lines(ls: str = "ls") -> Column:
    return F.array_join(F.transform(ls, lambda s: s["line"]), "\n")


def mask(hit, ls: str = "ls", other=None) -> Column:
    """One character a line: 1 where hit(line) holds, 0 elsewhere; b where other(line) holds of the rest."""

    def mark(s: Column) -> Column:
        rest = F.lit("0") if other is None else F.when(other(s), "b").otherwise("0")
        return F.when(hit(s), "1").otherwise(rest)

    return F.array_join(F.transform(ls, mark), "")


def _stretches(m: Column, each) -> Column:
    """each(a stretch of equal characters, its length) of a mask of 1 and 0, put in a row."""
    return F.flatten(F.transform(F.regexp_extract_all(m, F.lit("(1+|0+)"), F.lit(1)), lambda r: each(r.startswith("1"), F.length(r))))


def run_lengths(m: Column) -> Column:
    """For each line the length of the run of hits that it lies in, 0 outside."""
    return _stretches(m, lambda hit, n: F.array_repeat(F.when(hit, n).otherwise(0), n))


def run_places(m: Column) -> Column:
    """For each line its place in the run of hits, from 1; 0 outside."""
    return _stretches(m, lambda hit, n: F.when(hit, F.sequence(F.lit(1), n)).otherwise(F.array_repeat(F.lit(0), n)))


def in_code(ls: str = "ls") -> Column:
    """for each line whether an odd number of earlier lines opens or closes a fence."""
    fences = mask(lambda s: s["t"].startswith("```"), ls)
    parts = F.regexp_extract_all(fences, F.lit("(0*1|0+)"), F.lit(1))
    return F.flatten(F.transform(parts, lambda p, k: F.array_repeat(k % 2 == 1, F.length(p))))


def with_fences(pages: DataFrame) -> DataFrame:
    """Adds in_code, an array beside ls."""
    return pages.select("*", F.explode(F.array(in_code())).alias("in_code"))


def _keep(pages: DataFrame, marks: Column, keep) -> DataFrame:
    """The lines whose mark, in an array beside ls, is to be kept."""
    marked = pages.select("*", F.explode(F.array(marks)).alias("marks"))
    return marked.withColumn("ls", F.filter("ls", lambda s, i: keep(F.get(F.col("marks"), i)))).drop("marks")


def is_nav(t: Column) -> Column:
    """A line that is a link, a linked bullet, or a one-word bullet."""
    linked = t.rlike(r"^\[.+\]\(.+\)$") | t.rlike(r"^[*\-+]\s+\[.+\]\(.+\)$") | t.rlike(r"^[*\-+]\s+\[.+\]\(https?://.+\)") | t.rlike(r"^[*\-+]\s+- \[x\]\s+\[.+\]\(.+\)")
    return linked | (t.rlike(r"^[*\-+]\s+\S+$") & ~t.contains(".") & (F.length(t) < 60))


def is_numbered(t: Column) -> Column:
    return t.rlike(r"^\d+\.\s+\[") | (t.rlike(r"^\d+\.\s+\S") & (F.length(t) < 80))


def drop_breadcrumbs(pages: DataFrame) -> DataFrame:
    """G5."""
    return pages.withColumn("ls", F.filter("ls", lambda s: F.regexp_count(s["line"], F.lit(" > ")) < 3))


def drop_labels(pages: DataFrame) -> DataFrame:
    """G6."""

    def label(s: Column) -> Column:
        t = F.lower(s["t"])
        return t.rlike(r"^(#{1,6}\s+)?on this page(?![a-z0-9_])") | t.rlike(r"skip to (main )?content") | t.startswith("[back to top]") | (t == "back to top") | t.startswith("[edit this page]") | (t == "copy markdown")

    return pages.withColumn("ls", F.filter("ls", lambda s: ~label(s)))


def drop_consent(pages: DataFrame) -> DataFrame:
    """G7."""
    return pages.withColumn("ls", F.filter("ls", lambda s: ~F.lower(s["line"]).rlike(r"cookie|accept all|privacy policy|(?<![a-z0-9_])consent(?![a-z0-9_])")))


def drop_nav_runs(pages: DataFrame) -> DataFrame:
    """Runs of five navigation lines and over."""
    return _keep(pages, run_lengths(mask(lambda s: is_nav(s["t"]))), lambda n: n < 5)


def drop_numbered_runs(pages: DataFrame) -> DataFrame:
    """Runs of two numbered lines and over."""
    return _keep(pages, run_lengths(mask(lambda s: is_numbered(s["t"]))), lambda n: n < 2)


def collapse_blanks(pages: DataFrame) -> DataFrame:
    """At most two blank lines in a row."""
    return _keep(pages, run_places(mask(lambda s: s["t"] == "")), lambda k: k <= 2)
