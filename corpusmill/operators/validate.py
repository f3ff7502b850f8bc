"""Cleanliness, fidelity and coverage reports, and the checks of compressed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import code_block_count, contaminated_answer, heading_count, round_to, trimmed, word_count
from corpusmill.operators.lines import mask, page_lines

FINGERPRINTS = ("Accept all", "Built with", "Cookie", "On this page", "Powered by", "Previous / Next", "Table of Contents", "Was this page helpful", "[Edit on GitHub]", "[Suggest edits]")


def cleanliness(pages: DataFrame) -> DataFrame:
    """V1 detail: (page_ord, noise_hits, flagged, fingerprints)."""
    linked = mask(lambda s: s["t"].rlike(r"^\[.*\]\(.*\)$"))
    lined = page_lines(pages, "content").withColumn("linked", linked.rlike("1{6}"))
    named = [F.when(F.col("content").contains(f), F.lit(f)) for f in FINGERPRINTS]
    crumbs = F.when(F.regexp_like("content", F.lit(r"(?md)^[^\n]+? > [^\n]+? > [^\n]")), F.lit("breadcrumb sequence"))
    found = lined.select("page_ord", F.array_compact(F.array(*named, crumbs, F.when(F.col("linked"), F.lit("consecutive link-only lines")))).alias("fingerprints"))
    return found.select("page_ord", F.size("fingerprints").cast("long").alias("noise_hits"), (F.size("fingerprints") > 3).alias("flagged"), "fingerprints")


def _percent(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(round_to(part * 100.0 / whole, 2))


def cleanliness_report(detail: DataFrame) -> DataFrame:
    """V1 roll-up, one row: (total_pages, flagged_pages, flagged_percent)."""
    one = detail.agg(F.count(F.lit(1)).alias("total_pages"), F.count_if("flagged").alias("flagged_pages"))
    return one.select("*", _percent(F.col("flagged_pages"), F.col("total_pages"), 0.0).alias("flagged_percent"))


def headings(content):
    """V4: trimmed H2 and H3 texts."""
    return F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^#{2,3}[ \t\f\x0b]+([^\n]+)"), F.lit(1)), trimmed)


def fidelity(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """V3 detail, of pages in both whose clean text is not empty."""
    both = raw.select("page_ord", F.col("content").alias("r")).join(clean.filter("content <> ''").select("page_ord", F.col("content").alias("c")), "page_ord")
    both = both.select("page_ord", word_count(F.col("r")).alias("words_before"), word_count(F.col("c")).alias("words_after"), headings(F.col("r")).alias("rh"), headings(F.col("c")).alias("ch"))
    percent = F.when(F.col("words_before") == 0, F.lit(100.0)).otherwise(round_to(F.col("words_after") * 100.0 / F.col("words_before"), 2))
    missing = F.filter("rh", lambda h: ~F.array_contains(F.col("ch"), h))
    return both.select("page_ord", "words_before", "words_after", percent.alias("retention_percent"), missing.alias("missing_headings"), (percent < 30).alias("over_stripped"))


def fidelity_report(detail: DataFrame) -> DataFrame:
    """V3 roll-up, one row: (total_pages, over_stripped)."""
    return detail.agg(F.count(F.lit(1)).alias("total_pages"), F.count_if("over_stripped").alias("over_stripped"))


def coverage_gaps(discovered: DataFrame, results: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """V5: discovered urls without an ok result, with the last failure's error (results may carry an
    order page_ord), and sitemap urls that were not discovered."""
    ok = results.filter("status = 'ok'").select("url")
    failed = results.filter("status <> 'ok'")
    last = F.max_by(F.struct("error"), "page_ord") if "page_ord" in results.columns else F.first(F.struct("error"))
    why = failed.groupBy("url").agg(last["error"].alias("error"))
    gaps = discovered.select("url").join(ok, "url", "left_anti").join(why, "url", "left").select("url", F.coalesce("error", F.lit("not attempted")).alias("reason"))
    if sitemap is None:
        return gaps
    missing = sitemap.select("url").join(discovered.select("url"), "url", "left_anti")
    return gaps.unionByName(missing.select("url", F.lit("in sitemap but left out before fetching").alias("reason")))


def coverage(discovered: DataFrame, results: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """V5 roll-up, one row: (discovered, fetched, percent) and, with a sitemap, (sitemap_urls,
    sitemap_percent: how many of its urls were discovered). Repeated urls count each time they are
    listed; a url fetched twice counts once."""
    listed = discovered.agg(F.count(F.lit(1)).alias("discovered"))
    hit = results.filter("status = 'ok'").agg(F.count_distinct("url").alias("fetched"))
    both = listed.crossJoin(hit)  # one row each
    if sitemap is not None:
        known = sitemap.join(discovered.select("url").distinct().withColumn("known", F.lit(1)), "url", "left")
        both = both.crossJoin(known.agg(F.count(F.lit(1)).alias("sitemap_urls"), F.count("known").alias("known")))  # one row
    percent = _percent(F.col("fetched"), F.col("discovered"), 0.0).alias("percent")
    if sitemap is None:
        return both.select("discovered", "fetched", percent)
    return both.select("discovered", "fetched", percent, "sitemap_urls", _percent(F.col("known"), F.col("sitemap_urls"), 100.0).alias("sitemap_percent"))


def compressed(pairs: DataFrame) -> DataFrame:
    """C5, C7 over (page_ord, source, output): passed, reduction_percent (0 without words)."""
    a, b = F.col("source"), F.col("output")
    passed = (code_block_count(b) >= code_block_count(a)) & (heading_count(b) >= heading_count(a)) & (word_count(b) <= 1.05 * word_count(a)) & ~contaminated_answer(b)
    cut = F.when(word_count(a) == 0, F.lit(0.0)).otherwise(round_to((word_count(a) - word_count(b)) * 100.0 / word_count(a), 2))
    return pairs.select("page_ord", passed.alias("passed"), cut.alias("reduction_percent"))


def condense(pages: DataFrame, call, attempts: int = 1) -> DataFrame:
    """C1 with a pluggable text function: (page_ord, content, status); a page keeps its own text
    unless the answer passes. Calls run per Arrow batch on the executors."""
    import pyarrow as pa

    from corpusmill.functions.arrow import slices

    def run(batches):
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    out.append((call(text), None))
                except Exception as e:  # the page's status says so
                    out.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["page_ord", "source", "output", "error"])

    made = pages.select("page_ord", F.col("content").alias("source")).mapInArrow(run, "page_ord long, source string, output string, error string")
    ok = made.join(compressed(made.filter("output is not null")), "page_ord", "left")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("passed"), "ok").otherwise("fallback")
    return ok.select("page_ord", F.when(F.col("passed"), F.col("output")).otherwise(F.col("source")).alias("content"), status.alias("status"), F.coalesce("reduction_percent", F.lit(0.0)).alias("reduction_percent"))


def condense_stats(condensed: DataFrame) -> DataFrame:
    """Counts by status; the mean reduction over ok pages."""
    return condensed.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "fallback", "error")], F.coalesce(F.avg(F.when(F.col("status") == "ok", F.col("reduction_percent"))), F.lit(0.0)).alias("avg_reduction"))
