"""The mirror, resume and inspect flows over DataFrames. Acquired pages are a table (url, html or
body); every stage is a plan over page_ord, and only the platform's name reaches the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import compile as assemble
from corpusmill.operators import detect, flags, relevance, strip, validate
from corpusmill.plans import state
from corpusmill.plans.store import kept


@dataclass
class RunConfig:
    url: str
    name: str = "docs"
    top: int = 30
    query: str = ""
    lang: str = "en"
    exclude: tuple[str, ...] = ()
    max_pages: int = 0
    concurrency: int = 3
    platform: str | None = None
    condenser: object | None = None
    page_key: str = "url"
    date: str = field(default_factory=lambda: datetime.now(timezone.utc).date().isoformat())
    extra: dict = field(default_factory=dict)


@dataclass
class Run:
    platform: str
    clean: DataFrame
    results: DataFrame
    cleanliness: DataFrame
    fidelity: DataFrame
    corpus: assemble.Corpus


def mirror(pages: DataFrame, config: RunConfig, resumed: bool = False) -> Run:
    """pages (page_ord, slug, url, content) -> a run. resumed skips pruning and compression and
    detects the platform on the first five pages."""
    pages = kept(pages, "pages")  # acquired and converted once for all that follows
    if config.platform:
        platform = config.platform
    else:
        seen = pages.filter("page_ord < 5") if resumed else pages
        row = detect.detect_platform(seen, config.url).first()
        platform = row["platform"] if row else "generic"
    raw = pages.select("page_ord", "content")
    cleaned = kept(strip.strip_pages(raw, platform), "stripped")
    flagged = flags.page_flags(cleaned.select("page_ord", "content", "quality_gate_failed"), raw)
    clean = pages.drop("content").join(cleaned.select("page_ord", "content"), "page_ord")
    if not resumed:
        clean = relevance.prune(clean, config.query, config.top)
        if config.condenser:
            clean = clean.drop("content").join(validate.condense(clean, config.condenser).select("page_ord", "content"), "page_ord")
    results = pages.select("page_ord", "url", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")).join(flagged, "page_ord", "left")
    clean = kept(clean, "clean")
    text = clean.select("page_ord", "content")
    ordered = kept(assemble.renumbered(clean.select("page_ord", "url", "content")), "ordered")
    corpus = assemble.postcompiled(ordered, config.name, config.url, config.date)
    return Run(platform, clean, results, validate.cleanliness(text), validate.fidelity(raw, text), corpus)


def fast_path(full_text: DataFrame, config: RunConfig) -> Run:
    """A single file holds the documentation: one page, nothing stripped, fidelity full."""
    page = full_text.select(F.lit(0).cast("long").alias("page_ord"), F.lit("index").alias("slug"), "url", F.col("body").alias("content"))
    text = page.select("page_ord", "content")
    results = page.select("page_ord", "url", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("flags"))
    return Run(config.platform or "generic", page, results, validate.cleanliness(text), validate.fidelity(text, text), assemble.compiled(page, config.name, config.url, config.date))


def resume(old_results: DataFrame, fetched: DataFrame, pages: DataFrame, config: RunConfig) -> tuple[DataFrame, Run]:
    """(merged results, run over all pages)."""
    return state.upsert(old_results, fetched), mirror(pages, config, resumed=True)


def inspect(results: DataFrame) -> DataFrame:
    return state.inspect(results)
