"""Platform detection: signatures against a sample of pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import round_to

#: Declaration order, platform, url patterns, signatures.
PLATFORMS = (
    ("gitbook", (r"\.gitbook\.io",), ("powered by gitbook", "gitbook")),
    ("docusaurus", ("/docs/",), ("built with docusaurus", "docusaurus", "edit this page")),
    ("readthedocs", (r"readthedocs\.io", r"readthedocs\.org"), ("built with sphinx", "created using sphinx", "furo", "made with furo", "read the docs", "sphinx-rtd-theme")),
    ("mintlify", ("mintlify",), ("mintlify", "powered by mintlify")),
    ("mkdocs", (), ("made with material for mkdocs", "mkdocs")),
    ("vitepress", (), ("vitepress",)),
    ("fumadocs", (), ("fumadocs",)),
    ("nextra", (), ("nextra",)),
)


def sample(pages: DataFrame, size: int = 10) -> DataFrame:
    """The first and last page, then every (n/size)-th, size in all; page_ord runs from 0."""
    n = pages.agg((F.max("page_ord") + 1).alias("n"))  # one row
    step = F.greatest(F.lit(1), F.floor(F.col("n") / size))
    picks = F.slice(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.col("n") - 1), F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.least(i * step, F.col("n") - 1).cast("long")))), 1, size)
    chosen = n.select(F.explode(F.when(F.col("n") <= size, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(picks)).alias("page_ord"))
    return pages.join(F.broadcast(chosen), "page_ord", "left_semi")  # size rows


def scores(pages: DataFrame, base_url: str) -> DataFrame:
    """(ord, platform, score, confidence, evidence) over the sample: one aggregate, no join. The
    confidence divides by what a url match and two signatures on every sampled page would score."""
    low = F.lower("content")
    hits = [F.coalesce(F.sum(low.contains(s).cast("long")), F.lit(0)).alias(f"h{i}_{k}") for i, (_, _, sigs) in enumerate(PLATFORMS) for k, s in enumerate(sigs)]
    one = sample(pages).agg(F.count(F.lit(1)).alias("n"), *hits)
    rows = []
    for i, (name, urls, sigs) in enumerate(PLATFORMS):
        url = next((u for u in urls if re.search(u, base_url, re.I)), None)
        found = [F.col(f"h{i}_{k}") for k in range(len(sigs))]
        score = sum((2 * h for h in found), F.lit(3 if url else 0)).cast("long")
        said = [F.lit(f"URL matches {url}")] if url else []
        said += [F.when(h > 0, F.concat(h.cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(f" pages contain '{s}'"))) for h, s in zip(found, sigs)]
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("platform"), score.alias("score"), F.array_compact(F.array(*said)).alias("evidence")))
    flat = one.filter("n > 0").select("n", F.inline(F.array(*rows)))
    return flat.select("ord", "platform", "score", F.least(F.col("score") / (3 + 4 * F.col("n")), F.lit(1.0)).alias("confidence"), "evidence")


def detect_platform(pages: DataFrame, base_url: str) -> DataFrame:
    """One row (platform, confidence, evidence); below 0.3 it is generic, at 0 and without
    evidence. Of equal scores the platform declared first; no page, no row."""
    best = scores(pages, base_url).orderBy(F.desc("score"), "ord").limit(1)
    sure = F.col("confidence") >= 0.3
    return best.select(F.when(sure, F.col("platform")).otherwise("generic").alias("platform"), F.when(sure, round_to(F.col("confidence"), 2)).otherwise(0.0).alias("confidence"), F.when(sure, F.col("evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"))
