"""BM25 over pages: terms are counted once, and lengths and document frequencies come from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.store import kept

K1, B = 1.5, 0.75
STOP = sorted("a also an and are as at be been being but by can could did do does for from had has have he i if in is it its may might my no not of on or she should so than that the then these they this those to was we were will with would you your".split(), key=lambda w: (len(w), w))


def tokens(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s_-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP))


def query_terms(query: str) -> dict[str, int]:
    import re

    out: dict[str, int] = {}
    for w in re.sub(r"[^a-z0-9\s_-]", " ", query.lower()).split():
        if len(w) > 1 and w not in STOP:
            out[w] = out.get(w, 0) + 1
    return out


def bm25_scores(pages: DataFrame, query: str, key: str = "page_ord", text: str = "content") -> DataFrame:
    """(key, score): a query's terms are few, so each page's counts of them are columns of one scan,
    kept as a narrow table from which both the corpus statistics and the scores come; no text is
    shuffled or split twice."""
    terms = query_terms(query)
    words = pages.select(key, F.explode(F.array(tokens(F.col(text)))).alias("ws"))
    asked = F.filter("ws", lambda w: w.isin(list(terms))) if terms else F.array().cast("array<string>")
    few = words.select(key, F.size("ws").alias("dl"), F.explode(F.array(asked)).alias("hits"))
    counted = kept(few.select(key, "dl", *[F.size(F.filter("hits", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)]), "bm25-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    both = counted.crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i, times in enumerate(terms.values()):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}")
        score = score + times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)))
    return both.select(key, score.alias("score"))


def _equals(term: str):
    return lambda w: w == term


def prune(pages: DataFrame, query: str, top: int, key: str = "page_ord", text: str = "content") -> DataFrame:
    """The top pages by score, ties by order, kept in their own order; all of them where the query
    is blank, top is 0, there are no more, or none scores."""
    if top <= 0 or not query_terms(query):
        return pages
    scored = kept(bm25_scores(pages, query, key, text), "bm25-scores")
    best = scored.orderBy(F.desc("score"), key).limit(top)
    whole = scored.agg((F.coalesce(F.max("score"), F.lit(0.0)) <= 0).alias("all"))
    joined = pages.join(best.select(key, F.lit(True).alias("in_top")), key, "left").crossJoin(F.broadcast(whole))
    return joined.filter("in_top or all").select(*pages.columns)
