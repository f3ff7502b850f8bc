"""Corpus assembly: duplicate pages and blocks, heading shift, contents, the compiled text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import slugify, title_of, token_estimate, trimmed, without_links
from corpusmill.plans.store import kept


#: A line feed before a heading line, which opens a block.
BLOCK_EDGE = r"\n(?=#{1,6}\s)"


def drop_duplicate_pages(pages: DataFrame) -> DataFrame:
    """K8: the first page of each trimmed content. The least order per digest is aggregated before
    it is joined, so a much-copied page is no single task's work."""
    digest = F.md5(trimmed(F.col("content")))
    least = pages.groupBy(digest.alias("digest")).agg(F.min("page_ord").alias("page_ord"))
    return pages.join(least.select("page_ord"), "page_ord", "left_semi")


def blocks(pages: DataFrame) -> DataFrame:
    """K9: (page_ord, block, content); a heading line opens a block. A row's own expression."""
    return pages.select("page_ord", F.posexplode(F.split("content", BLOCK_EDGE)).alias("block", "content"))


def later_copies(pages: DataFrame, least_chars: int = 40) -> DataFrame:
    """(page_ord, block) of blocks seen on an earlier page; short ones are not looked up. Only
    digests are shuffled, and those that stand on one page alone do not come up."""
    text = trimmed(F.col("content"))
    found = blocks(pages).filter(F.length(text) >= least_chars).select("page_ord", "block", F.md5(text).alias("digest"))
    first = found.groupBy("digest").agg(F.min("page_ord").alias("first"), F.max("page_ord").alias("last")).filter("first < last")
    return found.join(first.select("digest", "first"), "digest").filter("first < page_ord").select("page_ord", "block")


def surviving_blocks(pages: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(page_ord, block, content) of the blocks that are no later copies; short ones stay."""
    copies = later_copies(pages) if copies is None else copies
    gone = copies.groupBy("page_ord").agg(F.collect_set("block").alias("gone"))
    kept_here = pages.join(gone, "page_ord", "left").select("page_ord", "gone", F.posexplode(F.split("content", BLOCK_EDGE)).alias("block", "content"))
    return kept_here.filter("gone IS NULL OR NOT array_contains(gone, block)").select("page_ord", "block", "content")


def deduplicate_blocks(pages: DataFrame, least_words: int = 10, copies: DataFrame | None = None) -> DataFrame:
    """Pages without the blocks that are later copies, an expression over the page's row once
    the numbers of its copies are joined; pages of under ten words go."""
    copies = later_copies(pages) if copies is None else copies
    gone = copies.groupBy("page_ord").agg(F.collect_set("block").alias("gone"))
    split = pages.join(gone, "page_ord", "left").select("page_ord", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.explode(F.array(F.split("content", BLOCK_EDGE))).alias("bs"))
    left = F.filter("bs", lambda x, i: ~F.array_contains(F.col("gone"), i))
    rebuilt = split.select("page_ord", trimmed(F.array_join(left, "\n")).alias("content"))
    return rebuilt.filter((F.col("content") != "") & (F.size(F.split("content", r"\s+")) >= least_words))


def shift_headings(pages: DataFrame, target: int = 3) -> DataFrame:
    """(page_ord, content, changed): headings moved so that the least level is target. An
    expression over each page's row."""
    split = pages.select("page_ord", F.explode(F.array(F.split("content", "\n"))).alias("ls"))
    level = F.array_min(F.concat(F.transform(F.filter("ls", lambda x: x.rlike(r"^#{1,6}\s")), lambda x: F.length(F.regexp_extract(x, "^(#{1,6})", 1))), F.array(F.lit(6))))
    moved = split.select("page_ord", "ls", level.alias("least"))

    def new(n: Column) -> Column:
        return F.greatest(F.lit(1), F.least(F.lit(6), n + target - F.col("least")))

    def line(x: Column) -> Column:
        own = F.length(F.regexp_extract(x, r"^(#{1,6})\s.", 1))
        return F.struct(F.when(own > 0, F.concat(F.repeat(F.lit("#"), new(own)), F.regexp_replace(x, "^#{1,6}", ""))).otherwise(x).alias("line"), ((own > 0) & (new(own) != own)).alias("changed"))

    made = moved.select("page_ord", F.explode(F.array(F.transform("ls", line))).alias("ls"))
    return made.select("page_ord", F.array_join(F.transform("ls", lambda s: s["line"]), "\n").alias("content"), F.size(F.filter("ls", lambda s: s["changed"])).cast("long").alias("changed"))


def in_order(pages: DataFrame) -> DataFrame:
    """K4: adds sort_key, by which the index comes first and the others by path, compared as words
    are (case and accents last), not as bytes; ties by page_ord."""
    path = F.regexp_replace(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "^/|/$", "")
    return pages.withColumn("sort_key", F.struct((~path.isin("", "index")).alias("later"), F.collate(path, "UNICODE").alias("path"), F.col("page_ord")))


def renumbered(pages: DataFrame) -> DataFrame:
    """K4: pages with page_ord counted anew in order, from 0. The sort is distributed; what one task
    sees of all pages is how many each sorted part has."""
    placed = in_order(pages).select("page_ord", "sort_key").orderBy("sort_key").select("page_ord", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    placed = kept(placed, "page-order")
    parts = placed.groupBy("part").agg(F.min("place").alias("base"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = placed.join(F.broadcast(parts.select("part", "base", before.alias("before"))), "part")  # a row a part
    order = found.select("page_ord", (F.col("before") + F.col("place") - F.col("base")).alias("new_ord"))
    return pages.join(order, "page_ord").withColumn("page_ord", F.col("new_ord")).drop("new_ord")


def contents(pages: DataFrame) -> DataFrame:
    """K13 over (page_ord, segment, title): groups in the order first seen. A group of several pages,
    where there is more than one group, has one number and its pages are nested; other pages are
    numbered each. Only the groups, not the pages, are counted through in one task."""
    by = Window.partitionBy("segment")
    ranked = pages.withColumn("group_first", F.min("page_ord").over(by)).withColumn("group_size", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy("page_ord")))
    groups = pages.groupBy("segment").agg(F.min("page_ord").alias("group_first"))
    numbered = groups.select("segment", F.row_number().over(Window.orderBy("group_first")).alias("running"), F.count(F.lit(1)).over(Window.partitionBy()).alias("groups"))
    joined = ranked.join(numbered, "segment")
    several = F.col("groups") > 1
    title = without_links(F.col("title"))
    return joined.select(F.when(several, F.col("running")).otherwise(F.col("place")).cast("long").alias("number"), "page_ord", "segment", title.alias("title"), slugify(title).alias("anchor"), (several & (F.col("group_size") > 1)).alias("nested"), "group_first")


def contents_lines(made: DataFrame) -> DataFrame:
    """K13 as text: (group_first, page_ord, line); a nested group's heading has page_ord -1."""
    name = F.initcap(F.regexp_replace("segment", "[-_]", " "))
    heads = made.filter("nested").select("group_first", F.lit(-1).cast("long").alias("page_ord"), F.concat(F.col("number").cast("string"), F.lit(". **"), name, F.lit("**")).alias("line")).distinct()
    link = F.concat(F.lit("["), F.col("title"), F.lit("](#"), F.col("anchor"), F.lit(")"))
    items = made.select("group_first", "page_ord", F.when(F.col("nested"), F.concat(F.lit("   - "), link)).otherwise(F.concat(F.col("number").cast("string"), F.lit(". "), link)).alias("line"))
    return heads.unionByName(items)


@dataclass
class Corpus:
    """parts (part, group_first, page_ord, text): the corpus's text in order, the header 0, the
    contents' lines 1, the pages 2; stats one row; pages the kept ones."""

    pages: DataFrame
    stats: DataFrame
    parts: DataFrame

    def write(self, path: str) -> None:
        """Text files whose names and lines are in the corpus's order; no task holds more than its part."""
        self.parts.orderBy("part", "group_first", "page_ord").select(F.col("text").alias("value")).write.mode("overwrite").text(path)

    def text(self) -> DataFrame:
        """One row (content, pages, tokens): the corpus as one text, which one task must hold."""
        key = F.struct("part", "group_first", "page_ord", "text")
        whole = self.parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["text"]), "\n").alias("content"))
        return whole.crossJoin(self.stats.select(F.col("pages_out").alias("pages"), "tokens"))  # one row each


def compiled(pages: DataFrame, name: str, source: str, date: str) -> Corpus:
    """K6 over pages (page_ord, url, content): a header with counts, flat contents, and each page
    under a marker of its title and address. Nothing is dropped; page_ord gives the order."""
    titled = pages.select("page_ord", "url", title_of(F.col("content"), _slug_title(F.col("url"))).alias("title"), trimmed(F.col("content")).alias("content"))
    counts = titled.agg(F.count(F.lit(1)).alias("pages_out"), F.coalesce(F.sum(token_estimate(F.col("content"))), F.lit(0)).alias("tokens"))
    stats = counts.select(F.col("pages_out").alias("pages_in"), "pages_out", F.lit(0).cast("long").alias("pages_dropped"), F.lit(0).cast("long").alias("blocks_deduped"), F.lit(0).cast("long").alias("headings_normalised"), "tokens")
    head = F.format_string(f"# {name} Documentation\n\n> Mirrored from {source} on {date}\n> %d pages | ~%,d tokens\n\n## Table of Contents\n".replace("{", "").replace("}", ""), "pages_out", "tokens")
    lines = titled.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("group_first"), "page_ord", F.concat(F.lit("- ["), F.col("title"), F.lit("](#"), slugify(F.col("title")), F.lit(")")).alias("text"))
    body = titled.select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("group_first"), "page_ord", F.concat(F.lit("\n---\n\n## Page: "), F.col("title"), F.lit(" (source: "), F.col("url"), F.lit(")\n\n"), F.col("content")).alias("text"))
    first = counts.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("group_first"), F.lit(0).cast("long").alias("page_ord"), head.alias("text"))
    return Corpus(titled, stats, first.unionByName(lines).unionByName(body))


def _slug_title(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "^/|/$", "")
    return slugify(F.when(path == "", "index").otherwise(path))


def postcompiled(pages: DataFrame, name: str, source: str, date: str) -> Corpus:
    """K7 to K14 over pages (page_ord, url, content): duplicate pages and blocks go, headings move
    below the pages' own, grouped contents, a header that says what went."""
    titled = pages.select("page_ord", "url", without_links(title_of(F.col("content"), _slug_title(F.col("url")))).alias("title"), trimmed(F.col("content")).alias("content"))
    unique = kept(drop_duplicate_pages(titled).select("page_ord", "content"), "unique-pages")
    copies = kept(later_copies(unique), "later-copies")
    shifted = shift_headings(deduplicate_blocks(unique, copies=copies))
    stay = kept(titled.drop("content").join(shifted, "page_ord"), "postcompiled")
    removed = copies.agg(F.count(F.lit(1)).alias("blocks_deduped"))  # one row
    out = stay.agg(F.count(F.lit(1)).alias("pages_out"), F.coalesce(F.sum("changed"), F.lit(0)).alias("headings_normalised"), F.coalesce(F.sum(token_estimate(F.col("content"))), F.lit(0)).alias("tokens"))
    stats = titled.agg(F.count(F.lit(1)).alias("pages_in")).crossJoin(out).crossJoin(removed)  # one row each
    stats = kept(stats.select("pages_in", "pages_out", (F.col("pages_in") - F.col("pages_out")).alias("pages_dropped"), "blocks_deduped", "headings_normalised", "tokens"), "corpus-stats")
    head = F.concat(
        F.lit(f"# {name} — Reference Documentation\n<!-- Assembled from "), F.col("pages_in").cast("string"), F.lit(" pages, "), F.col("pages_dropped").cast("string"), F.lit(" dropped as duplicates, "), F.col("blocks_deduped").cast("string"),
        F.lit(f" duplicate blocks removed -->\n\n> Source: {source} | {date}\n> "), F.col("pages_out").cast("string"), F.lit(" pages after deduplication\n\n## Table of Contents\n"),
    )
    segment = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+/+([^/?#]+)", 1)
    made = kept(contents(stay.select("page_ord", F.when(segment == "", "root").otherwise(segment).alias("segment"), "title")), "contents")
    lines = contents_lines(made).select(F.lit(1).alias("part"), "group_first", "page_ord", F.col("line").alias("text"))
    body = stay.select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("group_first"), "page_ord", F.concat(F.lit("\n---\n\n## "), F.col("title"), F.lit("\n\n"), trimmed(F.col("content"))).alias("text"))
    first = stats.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("group_first"), F.lit(0).cast("long").alias("page_ord"), head.alias("text"))
    return Corpus(stay, stats, first.unionByName(lines).unionByName(body))


def write_sections(pages: DataFrame, path: str) -> None:
    """K5: pages (segment, slug, content) under a folder per segment."""
    pages.select("segment", "slug", "content").write.mode("overwrite").partitionBy("segment").parquet(path)
