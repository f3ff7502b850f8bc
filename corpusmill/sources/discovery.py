"""URL discovery over tables of (url, body): what was fetched is a table here, not a network."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import body_markdown, discovery_markdown, heading_count, link_ratio, soft_404

LANGUAGES = sorted("ar bg cs da de el es et fi fr he hr hu id it ja ko lt lv ms nl no pl pt ro ru sk sl sr sv th tr uk vi zh".split(), reverse=True)
ENOUGH = 5


def extract_links(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, href) of anchors, without fragments, mail and scripts."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("pos", "href"))
    return rows.filter(~F.col("href").rlike(r"^(#|mailto:|javascript:)")).select(key, F.col("pos").cast("long").alias("pos"), "href")


def _clean_path(path: Column) -> Column:
    """The path without . and .. segments."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def resolve(href: Column, base: Column) -> Column:
    """The absolute address of a reference on a page of address base, without its fragment: host in
    lower case, dot segments gone, blanks escaped, a bare host with a slash. Null where it is none
    of http and https."""
    whole = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    bare = F.regexp_replace(F.replace(F.btrim(href), F.lit(" "), F.lit("%20")), "#.*$", "")

    def joined(x: Column) -> Column:
        ref, scheme, host, path, query = (x[k] for k in ("ref", "scheme", "host", "path", "query"))
        folder = F.regexp_replace(path, "[^/]*$", "")
        return (
            F.when(ref.rlike("(?i)^https?://"), ref)
            .when(ref.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(scheme, F.lit("://"), host, ref))
            .when(ref == "", F.concat(scheme, F.lit("://"), host, path, query))
            .when(ref.startswith("?"), F.concat(scheme, F.lit("://"), host, path, ref))
            .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", "/").otherwise(folder), ref))
        )

    def tidy(full: Column) -> Column:
        scheme, host, path, query = (F.regexp_extract(full, whole, k) for k in (1, 2, 3, 4))
        made = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(path == "", "/").otherwise(_clean_path(path)), query)
        return F.when(host != "", made)

    # a step on a one-element array each, so that none is worked out more than once
    parts = [F.regexp_extract(base, whole, k).alias(n) for k, n in ((2, "host"), (3, "path"), (4, "query"))]
    one = F.array(F.struct(bare.alias("ref"), F.lower(F.regexp_extract(base, whole, 1)).alias("scheme"), *parts))
    return F.element_at(F.transform(F.transform(one, joined), tidy), 1)


def filter_urls(urls: DataFrame, base: str, lang: str = "en", exclude: tuple[str, ...] = (), most: int = 0) -> DataFrame:
    """S11 over (url_ord, url): same host, no other language's segment, no excluded segment, the
    first of each, at most `most` (0: all)."""
    # the generator keeps the address from being worked out once for each use below
    made = urls.select("url_ord", F.explode(F.array(resolve(F.col("url"), F.lit(base)))).alias("url"))
    host, path = F.try_parse_url("url", F.lit("HOST")), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    segments = F.array_remove(F.split(path, "/"), "")
    other = [x for x in LANGUAGES if x != lang.lower()]
    own = F.try_parse_url(F.lit(base), F.lit("HOST"))
    kept = made.filter((host == own) & ~F.exists(segments, lambda s: F.lower(s).isin(other)))
    if exclude:
        kept = kept.filter(~F.arrays_overlap(segments, F.array(*[F.lit(x) for x in exclude])))
    first = kept.groupBy("url").agg(F.min("url_ord").alias("url_ord")).select("url_ord", "url")
    return first.orderBy("url_ord").limit(most) if most else first


def _root(base: str) -> str:
    return base.removesuffix("/")


def _origin(base: str) -> str | None:
    found = re.match(r"https?://[^/?#]+", base)
    return found.group(0) if found else None


def full_text_addresses(base: str) -> list[str]:
    """Where a single file may lie: at the given path, then at the host's root."""
    return list(dict.fromkeys(f"{r}/llms-full.txt" for r in (_root(base), _origin(base)) if r))


def sitemap_addresses(base: str) -> list[str]:
    """Both roots in three spellings."""
    roots = dict.fromkeys(r for r in (_root(base), _origin(base)) if r)
    return [f"{r}/{name}" for r in roots for name in ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml")]


def _answers(fetched: DataFrame, addresses: list[str]) -> DataFrame:
    """(url, body, rank) of the good answers among a few addresses."""
    rank = F.array_position(F.array(*[F.lit(a) for a in addresses]), F.col("url"))
    return fetched.filter(F.col("url").isin(addresses) & (F.col("status") >= 200) & (F.col("status") < 300)).select("url", "body", rank.alias("rank"))


def is_full_text(body: Column) -> Column:
    """Markdown of substance and no list of links."""
    return (F.length(body) > 500) & discovery_markdown(body) & (heading_count(body) >= 3) & (F.size(F.split(body, r"\s+")) >= 1000) & (link_ratio(body) <= 0.5)


def full_text(fetched: DataFrame, base: str) -> DataFrame:
    """S2 over fetched (url, status, body): the first address that holds a whole documentation."""
    return _answers(fetched, full_text_addresses(base)).filter(is_full_text(F.col("body"))).orderBy("rank").limit(1).select("url", "body")


def index_links(texts: DataFrame, first: str | None = None) -> DataFrame:
    """(url_ord, url) by line: the bullet's linked address, else the first bare one. Lines count
    from 0, or from the column first where texts are parts of a longer one."""
    base = F.col(first) if first else F.lit(0)
    lines = texts.select(base.cast("long").alias("base"), F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    bullet, bare = r"^-\s*\[.*?\]\((.*?)\)", r"https?://\S+"
    link = F.when(F.col("line").rlike(bullet), F.regexp_extract("line", bullet, 1)).when(F.col("line").rlike(bare), F.regexp_extract("line", bare, 0))
    return lines.select((F.col("base") + F.col("pos")).alias("url_ord"), link.alias("url")).filter("url is not null")


def listed_urls(fetched: DataFrame, base: str, **options) -> DataFrame:
    """The links of llms.txt, filtered."""
    return filter_urls(index_links(_answers(fetched, [f"{_root(base)}/llms.txt"])), base, **options)


def _locs(texts: DataFrame, *keys: str) -> DataFrame:
    return texts.select(*keys, F.posexplode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^\n]*?)\s*</loc>"), F.lit(1))).alias("pos", "loc"))


def sitemap_urls(answers: DataFrame, fetched: DataFrame) -> DataFrame:
    """S7 over answers (rank, body), children in fetched: (rank, url_ord, url) of the pages that
    each sitemap lists; of an index, those that its children list, one level deep."""
    index = F.contains("body", F.lit("<sitemapindex"))
    direct = _locs(answers.filter(~index), "rank").select("rank", F.col("pos").cast("long").alias("url_ord"), F.col("loc").alias("url"))
    children = _locs(answers.filter(index), "rank").select("rank", F.col("pos").alias("outer_pos"), F.col("loc").alias("child"))
    met = children.join(fetched.filter("status between 200 and 299").select(F.col("url").alias("child"), "body"), "child")
    return direct.unionByName(_locs(met, "rank", "outer_pos").select("rank", (F.col("outer_pos").cast("long") * (1 << 32) + F.col("pos")).alias("url_ord"), F.col("loc").alias("url")))


def mapped_urls(fetched: DataFrame, base: str, **options) -> DataFrame:
    """The pages of the first sitemap that lists any, filtered."""
    found = sitemap_urls(_answers(fetched, sitemap_addresses(base)), fetched)
    first = found.agg(F.min("rank").alias("rank"))  # one row
    return filter_urls(found.join(F.broadcast(first), "rank").select("url_ord", "url"), base, **options)


def crawl(fetched: DataFrame, base: str, fan_out: int = 50, **options) -> DataFrame:
    """The filtered links of the root page, and those of its first fan_out targets, all resolved
    against the root, filtered again."""
    good = fetched.filter("status between 200 and 299").select("url", F.col("body").alias("html"))
    root = extract_links(good.filter(F.col("url") == base))
    top = filter_urls(root.select(F.col("pos").alias("url_ord"), F.col("href").alias("url")), base, **options)
    heads = top.orderBy("url_ord").limit(fan_out).select(F.col("url_ord").alias("head"), "url")
    deep = extract_links(good.join(F.broadcast(heads), "url").withColumn("key", F.struct("head", "url")).select("key", "html"), "key")
    deep = deep.select(((F.col("key.head") + 1) * (1 << 32) + F.col("pos")).alias("url_ord"), F.col("href").alias("url"))
    return filter_urls(top.unionByName(deep), base, **options)


STAGES = ("llms-full-txt", "llms-txt", "sitemap", "link-crawl", "map")


def choose_stage(found: DataFrame) -> DataFrame:
    """S1 over (stage, url_ord, url): the rows of the first stage with enough urls (any for a full
    text or an external map), else of the best partial one: crawl, sitemap, index; with partial and
    the number of stages that were tried."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    back = F.array_position(F.array(*[F.lit(s) for s in ("link-crawl", "sitemap", "llms-txt")]), F.col("stage"))
    sizes = found.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))  # one row a stage
    full = (F.col("n") >= ENOUGH) | F.col("stage").isin(STAGES[0], STAGES[-1])
    best = sizes.select("stage", (~full).alias("partial"), F.when(full, place).otherwise(back + 10).alias("r")).orderBy("r").limit(1)
    tried = F.when(F.col("r") > 10, 4).otherwise(F.col("r")).cast("long")
    return found.join(F.broadcast(best.select("stage", "partial", tried.alias("stages_tried"))), "stage")


def discover(fetched: DataFrame, base: str, external: DataFrame | None = None, **options) -> DataFrame:
    """(stage, url_ord, url, partial, stages_tried). fetched (url, status, body) holds what the
    addresses answered; external (url_ord, url) what a map service said. A full text is one row."""
    full = full_text(fetched, base).select(F.lit(STAGES[0]).alias("stage"), F.lit(0).cast("long").alias("url_ord"), "url")
    parts = [full]
    for stage, made in zip(STAGES[1:], (listed_urls(fetched, base, **options), mapped_urls(fetched, base, **options), crawl(fetched, base, **options), external)):
        if made is not None:
            parts.append(made.select(F.lit(stage).alias("stage"), "url_ord", "url"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return choose_stage(found)


def page_slugs(pages: DataFrame) -> DataFrame:
    """A10: slugs of (page_ord, path), later ones of a name numbered _2, _3 by order."""
    from corpusmill.functions.text import page_slug

    named = pages.select("page_ord", page_slug(F.col("path")).alias("name"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("page_ord"))
    return named.withColumn("k", k).select("page_ord", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", "k")).alias("slug"))


METHODS = ("content-negotiation", "md-suffix", "rtd-sources", "local-html", "proxy")


def usable(method: Column, status: Column, content_type: Column, body: Column) -> Column:
    """Whether an answer serves. Content negotiation wants markdown by name or look, the
    .md address markdown by look, the source file nothing more, HTML (here already converted, null
    where it was too short) markdown by look, the proxy some text."""
    markdown = body_markdown(body)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    good = (
        F.when(method == METHODS[0], F.contains(kind, F.lit("markdown")) | markdown)
        .when(method == METHODS[1], markdown)
        .when(method == METHODS[2], F.lit(True))
        .when(method == METHODS[3], F.contains(kind, F.lit("html")) & markdown & ~soft_404(body))
        .when(method == METHODS[4], F.trim(body) != "")
    )
    return (status == 200) & F.coalesce(good & body.isNotNull(), F.lit(False))


def acquire(urls: DataFrame, answers: DataFrame) -> DataFrame:
    """A1, A16 over urls (url_ord, url) and answers (url, method, status, content_type, body, error):
    one row per url in its order: the first usable answer that is no soft 404, else why there is
    none. An answer's own error counts as no answer; a url that nothing answered has a row too."""
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    judged = answers.filter("error is null").select("url", rank.alias("rank"), "method", "body", usable(F.col("method"), F.col("status"), F.col("content_type"), F.col("body")).alias("fit"))
    judged = judged.filter("fit").withColumn("gone", soft_404(F.col("body")))
    pick = judged.groupBy("url").agg(F.min_by(F.struct("method", "body"), F.when(~F.col("gone"), F.col("rank"))).alias("best"), F.bool_and("gone").alias("gone"))
    met = urls.join(pick, "url", "left").withColumn("ok", F.coalesce(~F.col("gone"), F.lit(False)))
    reason = F.when(F.col("gone"), "soft 404 or login wall").otherwise("no method served")
    return met.select("url_ord", "url", F.when(F.col("ok"), "ok").otherwise("error").alias("status"), F.when(F.col("ok"), F.col("best.method")).alias("method"), F.when(F.col("ok"), F.col("best.body")).alias("content"), F.when(~F.col("ok"), reason).alias("error"))


def markdown_url(url: Column) -> Column:
    """A3."""
    return F.concat(F.regexp_replace(url, "/$", ""), F.lit(".md"))


def source_url(url: Column) -> Column:
    """A4: the rendered page's source file, below the first en, latest or stable segment; else null."""
    shape = r"^(https?://[^/?#]+)((?:/(?!(?:en|latest|stable)(?:/|$|[?#]))[^/?#]*)*/(?:en|latest|stable))/([^?#]*?)/?(?:[?#].*)?$"
    rest = F.regexp_extract(url, shape, 3)
    return F.when(url.rlike(shape), F.concat(F.regexp_extract(url, shape, 1), F.regexp_extract(url, shape, 2), F.lit("/_sources/"), F.when(rest == "", "index").otherwise(rest), F.lit(".md.txt")))
