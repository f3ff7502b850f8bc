"""Analytics over runs and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import round_to
from corpusmill.sources.discovery import resolve


def even_sample(rows: DataFrame, size: int, order: str = "page_ord") -> DataFrame:
    """Rows floor(i * n / size) of an order that runs from 0."""
    n = rows.agg((F.max(order) + 1).alias("n"))  # one row
    picks = n.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(i * F.col("n") / F.least(F.lit(size), F.col("n"))).cast("long")))).alias(order))
    return rows.join(F.broadcast(picks), order, "left_semi")


def front_door(sizes: DataFrame) -> DataFrame:
    """E2 over (source, html_bytes, clean_bytes): means and their ratio to one place."""
    m = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.avg("html_bytes").alias("html"), F.avg("clean_bytes").alias("clean"))
    return m.select("source", "pages", round_to(F.col("html"), 0).alias("mean_html"), round_to(F.col("clean"), 0).alias("mean_clean"), round_to(F.when(F.col("clean") > 0, F.col("html") / F.col("clean")).otherwise(0.0), 1).alias("ratio"))


def measure(runs: DataFrame) -> DataFrame:
    """E2 over one row a run (name, url, discovery_method, fast_path, pages_listed, raw_files, raw_bytes,
    clean_files, clean_bytes, compiled_bytes, header_tokens, run_tokens, smart_query, smart_top_n,
    elapsed, page_pool, html_n, html_bytes): all the figures of a run. Tokens come from the compiled
    file's header, else from the run, else from its bytes. A reduction compares raw and clean pages,
    never the pruned text; the time of a run of many pages in under a second is none; a page's mean
    divides by the pages that were mirrored, or by the site's where one file holds them all."""
    c = F.col
    slow = ~((c("elapsed") < 1) & (F.coalesce("pages_listed", "raw_files") > 1))
    files = F.when(c("fast_path"), c("page_pool")).otherwise(c("clean_files"))
    held = F.when(c("fast_path"), c("compiled_bytes")).otherwise(c("clean_bytes"))
    counted = runs.select(
        "name", "url", "discovery_method", "fast_path", F.coalesce("pages_listed", "raw_files").alias("pages_fetched"), "raw_bytes", "clean_bytes", "clean_files", "compiled_bytes",
        F.coalesce(c("header_tokens"), c("run_tokens"), round_to(c("compiled_bytes") / 4, 0).cast("long")).alias("compiled_tokens_est"),
        F.when(c("header_tokens").isNotNull(), "header of the compiled file").when(c("run_tokens").isNotNull(), "run record").otherwise("a quarter of the bytes").alias("compiled_tokens_source"),
        "smart_query", F.when(c("smart_query").isNotNull(), c("smart_top_n")).alias("smart_top_n"),
        F.when(~c("fast_path") & (c("raw_bytes") > 0) & (c("clean_bytes") > 0), strip_reduction(c("raw_bytes"), c("clean_bytes"))).alias("pipeline_reduction_pct"),
        F.when(slow, c("elapsed")).alias("elapsed_s"), F.when(~slow, "left out: too short for its pages").alias("elapsed_note"), c("page_pool").alias("sitemap_page_count"),
        c("html_n").alias("html_sample_n"), c("html_bytes").alias("html_sample_bytes"),
        F.when(c("html_n") > 0, round_to(c("html_bytes") / c("html_n"), 0)).alias("html_mean_bytes_per_page"), F.when((files > 0) & (held > 0), round_to(held / files, 0)).alias("markdown_mean_bytes_per_page"),
    )
    mean = c("markdown_mean_bytes_per_page")
    return counted.withColumn("front_door_ratio", F.when((c("html_mean_bytes_per_page") > 0) & (mean > 0), round_to(c("html_mean_bytes_per_page") / mean, 1)))


def strip_reduction(raw_bytes, clean_bytes):
    return F.when(raw_bytes == 0, F.lit(0.0)).otherwise(round_to((raw_bytes - clean_bytes) * 100.0 / raw_bytes, 1))


def index_urls(texts: DataFrame, origin: str) -> DataFrame:
    """E4 over (body): link targets of an index, resolved against the site's root, once each; of a
    page's .md variant the page itself; the bulk text files are left out."""
    found = texts.select(F.explode(F.regexp_extract_all("body", F.lit(r"\]\(([^)\s]+)"), F.lit(1))).alias("u"))
    whole = found.select(resolve(F.col("u"), F.lit(origin)).alias("url")).filter("url is not null")
    page = F.regexp_replace("url", r"^([^?#]*)\.md(?=$|[?#])", "$1")
    return whole.select(page.alias("url")).filter(~F.col("url").rlike(r"llms(-\w+)?\.txt$")).distinct()


def grade(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers (arm, question_id, answer, error) against questions (id, all_of). An answer
    passes if every pattern matches; an unknown question or a runner error fails."""
    q = questions.select(F.col("id").alias("question_id"), "all_of")
    both = answers.join(q, "question_id", "left")  # a small key is broadcast by its size, a large one is not
    missing = F.filter("all_of", lambda p: ~F.regexp_like(F.coalesce(F.col("answer"), F.lit("")), F.concat(F.lit("(?i)"), p)))
    out = both.withColumn("missing", F.when(F.col("all_of").isNull(), F.array(F.lit("unknown question"))).otherwise(missing))
    return out.withColumn("passed", F.col("error").isNull() & (F.size("missing") == 0)).drop("all_of")


def arm_summary(graded: DataFrame) -> DataFrame:
    """Exact medians, three-place accuracy; turns, web calls and models where the records have them."""
    have = set(graded.columns)
    more = []
    if "num_turns" in have:
        more.append(F.coalesce(F.sum("num_turns"), F.lit(0)).alias("total_turns"))
    calls = [F.coalesce(F.col(c), F.lit(0)) for c in ("web_fetches", "web_searches") if c in have]
    if calls:
        more.append(F.sum(sum(calls[1:], calls[0])).alias("web_calls"))
    if "models_used" in have:
        more.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("models_used")))).alias("models"))
    return graded.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), round_to(F.count_if("passed") / F.count(F.lit(1)), 3).alias("accuracy"),
        F.count("error").alias("errors"), F.sum("cost").alias("total_cost"), F.median("cost").alias("median_cost"), F.sum("duration_ms").alias("total_ms"), F.median("duration_ms").alias("median_ms"), *more,
    )
