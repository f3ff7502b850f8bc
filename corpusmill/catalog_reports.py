"""More registered queries: reports, detection, discovery, acquisition and assembly, with their
oracle SQL. Their oracles are written from the rules' own words, not from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.catalog import (
    D_ALL, D_CLEANED, D_HEADED, D_ISLANDS, D_LANG, D_LIST_SRC, D_PICK, D_RESULTS, D_SIG, HEADED, LISTED, WS, _results, d_count, d_lines, d_words, documents, query, table,
)
from corpusmill.functions import text as T
from corpusmill.operators import compile as assemble
from corpusmill.operators import detect, flags, validate
from corpusmill.plans import evidence, state
from corpusmill.sources import discovery

D_HUNDREDTH = "floor({a} * 100::DOUBLE / {b} * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE"
D_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"

# Coverage
D_DISC, D_MAP = "(SELECT url FROM pages WHERE page_id % 13 <> 0)", "(SELECT url FROM pages WHERE page_id % 3 = 0)"
D_FAILED = f"(SELECT url, arg_max(coalesce(error, 'not attempted'), page_id) AS reason FROM {D_RESULTS} WHERE status <> 'ok' GROUP BY url)"
D_GAPS = f"SELECT d.url, coalesce(r.reason, 'not attempted') AS reason FROM {{d}} d LEFT JOIN {D_FAILED} r USING (url) WHERE d.url NOT IN (SELECT url FROM {D_RESULTS} WHERE status = 'ok')"
D_COVER = f"(SELECT count(*) FROM {{d}}) AS discovered, (SELECT count(DISTINCT url) FROM {D_RESULTS} WHERE status = 'ok') AS fetched"


def _some_results(spark, sf) -> DataFrame:
    return _results(spark, sf, gaps=True).withColumn("page_ord", F.col("page_id"))


def _discovered(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").filter("page_id % 13 <> 0").select("url")


def _mapped(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").filter("page_id % 3 = 0").select("url")


@query(D_GAPS.format(d="pages"))
def coverage_gaps(spark, sf):
    return validate.coverage_gaps(table(spark, sf, "pages"), _some_results(spark, sf))


@query(D_GAPS.format(d=D_DISC) + f" UNION ALL SELECT url, 'in sitemap but left out before fetching' FROM {D_MAP} WHERE url NOT IN (SELECT url FROM {D_DISC})")
def coverage_gaps_sitemap(spark, sf):
    return validate.coverage_gaps(_discovered(spark, sf), _some_results(spark, sf), _mapped(spark, sf))


@query(f"SELECT discovered, fetched, {D_HUNDREDTH.format(a='fetched', b='discovered')} AS percent FROM (SELECT {D_COVER.format(d='pages')})")
def coverage(spark, sf):
    return validate.coverage(table(spark, sf, "pages"), _some_results(spark, sf))


@query(
    f"SELECT discovered, fetched, {D_HUNDREDTH.format(a='fetched', b='discovered')} AS percent, sitemap_urls, {D_HUNDREDTH.format(a='known', b='sitemap_urls')} AS sitemap_percent "
    f"FROM (SELECT {D_COVER.format(d=D_DISC)}, (SELECT count(*) FROM {D_MAP}) AS sitemap_urls, (SELECT count(*) FROM {D_MAP} WHERE url IN (SELECT url FROM {D_DISC})) AS known)"
)
def coverage_sitemap(spark, sf):
    return validate.coverage(_discovered(spark, sf), _some_results(spark, sf), _mapped(spark, sf))


# Cleanliness and fidelity
D_FP = ", ".join(f"CASE WHEN contains(content, '{f}') THEN '{f}' END" for f in validate.FINGERPRINTS)
D_CLEAN = (
    D_ISLANDS.format(src=d_lines(D_LIST_SRC), hit=r"regexp_matches(t, '^\[.*\]\(.*\)$')")
    + ", m AS (SELECT page_ord, max(run) AS longest FROM r GROUP BY page_ord), "
    + f"z AS (SELECT page_ord, list_filter([{D_FP}, CASE WHEN regexp_matches(content, '([^\\n]+ > ){{2,}}[^\\n]+') THEN 'breadcrumb sequence' END, CASE WHEN longest > 5 THEN 'consecutive link-only lines' END], lambda x: x IS NOT NULL) AS f FROM {D_LIST_SRC} JOIN m USING (page_ord)) "
)


@query(D_CLEAN + "SELECT page_ord, CAST(len(f) AS BIGINT) AS noise_hits, len(f) > 3 AS flagged, array_to_string(f, '|') AS fingerprints FROM z")
def cleanliness(spark, sf):
    return validate.cleanliness(documents(spark, sf, LISTED)).withColumn("fingerprints", F.array_join("fingerprints", "|"))


@query(D_CLEAN + "SELECT count(*) AS total_pages, count(*) FILTER (len(f) > 3) AS flagged_pages, " + D_HUNDREDTH.format(a="count(*) FILTER (len(f) > 3)", b="count(*)") + " AS flagged_percent FROM z")
def cleanliness_report(spark, sf):
    return validate.cleanliness_report(validate.cleanliness(documents(spark, sf, LISTED)))


@query(f"SELECT count(*) AS total_pages, count(*) FILTER (b > 0 AND {D_HUNDREDTH.format(a='a', b='b')} < 30) AS over_stripped FROM (SELECT {d_words(D_HEADED)} AS b, {d_words(D_CLEANED)} AS a FROM documents WHERE {D_CLEANED} <> '')")
def fidelity_report(spark, sf):
    return validate.fidelity_report(validate.fidelity(documents(spark, sf, HEADED), documents(spark, sf, D_CLEANED)))


D_LOST = "CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 150) ELSE text END"


@query(
    f"WITH p AS (SELECT doc_id AS page_ord, {D_HEADED} AS r, {D_LOST} AS c FROM documents), n AS (SELECT *, {d_count('r', '(?m)^#{2,6}' + chr(92) + 's')} AS rh, {d_count('c', '(?m)^#{2,6}' + chr(92) + 's')} AS ch, {d_words('r')} AS rw, {d_words('c')} AS cw FROM p) "
    "SELECT page_ord, array_to_string(list_filter([CASE WHEN page_ord % 7 = 0 THEN 'GATE' END, CASE WHEN rh >= 4 AND ch < 0.4 * rh AND rw > 0 AND cw < 0.5 * rw THEN 'FIDELITY' END], lambda x: x IS NOT NULL), ',') AS flags FROM n"
)
def flags_against_raw(spark, sf):
    clean = documents(spark, sf, D_LOST).withColumn("quality_gate_failed", F.col("page_ord") % 7 == 0)
    found = flags.page_flags(clean, documents(spark, sf, HEADED))
    return found.select("page_ord", F.array_join(F.filter("flags", lambda x: x.isin("GATE", "FIDELITY")), ",").alias("flags"))


# Detection
def _sig_row(i: int, name: str, sigs) -> str:
    hits = [f"count(*) FILTER (contains(lower(c), '{g}'))" for g in sigs]
    url = 3 if name == "docusaurus" else 0  # the one pattern that the address below matches
    said = ["'URL matches /docs/'"] if url else []
    said += [f"CASE WHEN {h} > 0 THEN {h} || '/' || count(*) || ' pages contain ''{g}' || chr(39) END" for h, g in zip(hits, sigs)]
    return f"SELECT {i} AS ord, '{name}' AS platform, CAST({url} + 2 * ({' + '.join(hits)}) AS BIGINT) AS score, count(*) AS n, array_to_string(list_filter([{', '.join(said)}], lambda x: x IS NOT NULL), '; ') AS evidence FROM x"


#: Confidence as the rules have it: a url match (3) and two signatures (2 x 2) on each sampled page.
D_DETECT = D_PICK + f", x AS (SELECT {D_SIG} AS c FROM documents JOIN p ON doc_id = d), y AS (" + " UNION ALL ".join(_sig_row(i, n, g) for i, (n, _, g) in enumerate(detect.PLATFORMS)) + "), z AS (SELECT *, least(score::DOUBLE / (3 + 2 * 2 * n), 1::DOUBLE) AS confidence FROM y) "


@query(D_DETECT + "SELECT ord, platform, score, round(confidence, 9) AS confidence, evidence FROM z")
def platform_scores(spark, sf):
    found = detect.scores(documents(spark, sf, D_SIG), "https://example.com/docs/intro")
    return found.select("ord", "platform", "score", F.round("confidence", 9).alias("confidence"), F.array_join("evidence", "; ").alias("evidence"))


@query(D_DETECT + "SELECT CASE WHEN confidence >= 0.3 THEN platform ELSE 'generic' END AS platform, CASE WHEN confidence >= 0.3 THEN floor(confidence * 100 + 0.5::DOUBLE) / 100::DOUBLE ELSE 0 END AS confidence, CASE WHEN confidence >= 0.3 THEN evidence ELSE '' END AS evidence FROM (SELECT * FROM z ORDER BY score DESC, ord LIMIT 1)")
def platform_detect(spark, sf):
    return detect.detect_platform(documents(spark, sf, D_SIG), "https://example.com/docs/intro").withColumn("evidence", F.array_join("evidence", "; "))


# Assembly
D_SEGMENT = "regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1)"
D_CONTENTS = (
    f"WITH p AS (SELECT page_id AS page_ord, {D_SEGMENT} AS segment, 'Page ' || page_id AS title FROM pages), g AS (SELECT *, min(page_ord) OVER (PARTITION BY segment) AS f, count(*) OVER (PARTITION BY segment) AS k, row_number() OVER (PARTITION BY segment ORDER BY page_ord) AS place FROM p), "
    "n AS (SELECT *, dense_rank() OVER (ORDER BY f) AS running, (SELECT count(DISTINCT segment) FROM p) AS groups FROM g), c AS (SELECT CASE WHEN groups > 1 THEN running ELSE place END AS number, page_ord, segment, title, 'page-' || page_ord AS anchor, k > 1 AND groups > 1 AS nested, f AS group_first FROM n) "
)


def _titled(spark, sf) -> DataFrame:
    segment = F.regexp_extract("url", "^https?://[^/?#]+/([^/?#]*)", 1)
    return table(spark, sf, "pages").select(F.col("page_id").alias("page_ord"), segment.alias("segment"), F.concat(F.lit("[Page "), F.col("page_id"), F.lit("](x)")).alias("title"))


@query(D_CONTENTS + "SELECT * FROM c")
def grouped_contents(spark, sf):
    return assemble.contents(_titled(spark, sf))


@query(D_CONTENTS + "SELECT DISTINCT group_first, -1::BIGINT AS page_ord, number || '. **' || upper(segment[1]) || segment[2:] || '**' AS line FROM c WHERE nested UNION ALL SELECT group_first, page_ord, CASE WHEN nested THEN '   - ' ELSE number || '. ' END || '[' || title || '](#' || anchor || ')' AS line FROM c")
def contents_text(spark, sf):
    return assemble.contents_lines(assemble.contents(_titled(spark, sf)))


@query(f"SELECT page_id, row_number() OVER (ORDER BY path NOT IN ('', 'index'), path, page_id) - 1 AS page_ord FROM (SELECT page_id, regexp_replace({D_PATH}, '^/|/$', '', 'g') AS path FROM pages)")
def page_order(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("page_ord"), "page_id", "url")
    return assemble.renumbered(pages).select("page_id", "page_ord")


D_PAGES = f"(SELECT doc_id AS page_ord, trim({D_HEADED}, {WS}) AS content FROM documents)"
D_POST = rf"""WITH u AS (SELECT min(page_ord) AS page_ord, any_value(content) AS content FROM {D_PAGES} GROUP BY md5(content)), l AS {d_lines('u')}, b AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\s') AND pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_ord ORDER BY pos) AS block FROM l),
 k AS (SELECT page_ord, block, string_agg(line, chr(10) ORDER BY pos) AS content FROM b GROUP BY ALL), h AS (SELECT *, length(trim(content, {WS})) >= 40 AS long, min(CASE WHEN length(trim(content, {WS})) >= 40 THEN page_ord END) OVER (PARTITION BY md5(trim(content, {WS}))) AS first FROM k), s AS (SELECT * FROM h WHERE NOT long OR first = page_ord),
 q AS (SELECT page_ord, trim(string_agg(content, chr(10) ORDER BY block), {WS}) AS content FROM s GROUP BY page_ord), o AS (SELECT * FROM q WHERE content <> '' AND len(regexp_split_to_array(content, '\s+')) >= 10) """


def _marked(spark, sf) -> DataFrame:
    return documents(spark, sf, HEADED).withColumn("url", F.concat(F.lit("https://example.com/docs/p"), F.col("page_ord")))


@query(D_POST + "SELECT page_ord, md5(content) AS content_md5 FROM o")
def deduplicated_pages(spark, sf):
    unique = assemble.drop_duplicate_pages(documents(spark, sf, HEADED).withColumn("content", T.trimmed(F.col("content"))))
    return assemble.deduplicate_blocks(unique).select("page_ord", F.md5("content").alias("content_md5"))


D_TOKENS = f"CAST(sum(floor(1.33::DOUBLE * {d_words('content')} + 0.5::DOUBLE)) AS BIGINT)"


@query(
    D_POST + "SELECT (SELECT count(*) FROM documents) AS pages_in, (SELECT count(*) FROM o) AS pages_out, (SELECT count(*) FROM documents) - (SELECT count(*) FROM o) AS pages_dropped, (SELECT count(*) FROM k) - (SELECT count(*) FROM s) AS blocks_deduped, "
    + rf"(SELECT CAST(coalesce(sum({d_count('content', '(?m)^##[ ][^' + chr(92) + 'n]')}), 0) AS BIGINT) FROM o) AS headings_normalised, (SELECT {D_TOKENS} FROM o) AS tokens"
)
def postcompile_stats(spark, sf):
    return assemble.postcompiled(_marked(spark, sf), "docs", "https://example.com/docs", "2026-01-01").stats


@query(
    f"SELECT 2 AS part, page_ord, md5(chr(10) || '---' || chr(10) || chr(10) || '## Page: docs-p' || page_ord || ' (source: https://example.com/docs/p' || page_ord || ')' || chr(10) || chr(10) || content) AS text_md5 FROM {D_PAGES} "
    f"UNION ALL SELECT 1, page_ord, md5('- [docs-p' || page_ord || '](#docs-p' || page_ord || ')') FROM {D_PAGES} "
    f"UNION ALL SELECT 0, 0, md5('# docs Documentation' || chr(10) || chr(10) || '> Mirrored from https://example.com/docs on 2026-01-01' || chr(10) || '> ' || count(*) || ' pages | ~' || format('{{:,}}', {D_TOKENS}) || ' tokens' || chr(10) || chr(10) || '## Table of Contents' || chr(10)) FROM {D_PAGES}"
)
def compiled_parts(spark, sf):
    parts = assemble.compiled(_marked(spark, sf), "docs", "https://example.com/docs", "2026-01-01").parts
    return parts.select("part", "page_ord", F.md5("text").alias("text_md5"))


D_MIXED = "concat(text, chr(10), '```py', chr(10), 'a = b + c', chr(10), '```', chr(10), CASE WHEN doc_id % 2 = 0 THEN '漢字かな交じり文。。' ELSE '' END, '```', chr(10), doc_id, ' open')"


@query(f"SELECT page_ord, CAST(floor(1.33::DOUBLE * ({d_words('content')} - code) + 2::DOUBLE * code + 1.5::DOUBLE * CASE WHEN page_ord % 2 = 0 THEN 10 ELSE 0 END + 0.5::DOUBLE) AS BIGINT) AS tokens FROM (SELECT page_ord, content, {d_words('array_to_string(regexp_extract_all(content, $$(?s)```.*?```$$), $$$$)')} AS code FROM (SELECT doc_id AS page_ord, {D_MIXED} AS content FROM documents))")
def token_estimate_mixed(spark, sf):
    return documents(spark, sf, D_MIXED.replace("chr(10)", "'\\n'")).select("page_ord", T.token_estimate(F.col("content")).alias("tokens"))


D_TITLED = "concat(CASE WHEN doc_id % 3 = 0 THEN concat('# A [link](u) ', doc_id, ' ') ELSE '## no title' END, chr(10), '# second ', chr(10), text)"


@query("SELECT doc_id AS page_ord, CASE WHEN doc_id % 3 = 0 THEN 'A link ' || doc_id ELSE 'second' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'a-link-' || doc_id ELSE 'second' END AS anchor FROM documents")
def page_titles(spark, sf):
    title = T.without_links(T.title_of(F.col("content"), F.lit("none")))
    return documents(spark, sf, D_TITLED.replace("chr(10)", "'\\n'")).select("page_ord", title.alias("title"), T.slugify(title).alias("anchor"))


# Discovery and acquisition
@query(r"""WITH l AS (SELECT page_id, url, unnest(hs) AS href, CAST(generate_subscripts(hs, 1) - 1 AS BIGINT) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"'']+)["'']', 1) AS hs FROM pages)) SELECT page_id, pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || replace(href, ' ', '%20') AS target FROM l WHERE starts_with(href, '/')""")
def resolved_links(spark, sf):
    pages = table(spark, sf, "pages")
    found = discovery.extract_links(pages, "page_id").filter("href like '/%'").join(pages.select("page_id", "url"), "page_id")
    return found.select("page_id", "pos", discovery.resolve(F.col("href"), F.col("url")).alias("target"))


@query(
    f"WITH q AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, string_split(regexp_replace({D_PATH}, '/$', ''), '/') AS ps FROM pages), i AS (SELECT *, list_position(list_transform(ps, lambda x: x IN ('en', 'latest', 'stable')), true) AS n FROM q) "
    "SELECT page_id, CASE WHEN ends_with(url, '/') THEN url[:-2] ELSE url END || '.md' AS md_url, CASE WHEN n > 0 AND len(ps) > n THEN origin || array_to_string(ps[1:n], '/') || '/_sources/' || array_to_string(ps[n + 1:], '/') || '.md.txt' END AS source_url FROM i"
)
def variant_addresses(spark, sf):
    return table(spark, sf, "pages").select("page_id", discovery.markdown_url(F.col("url")).alias("md_url"), discovery.source_url(F.col("url")).alias("source_url"))


D_KEEP = f"len(list_filter(string_split(url, '/'), lambda x: lower(x) IN ({D_LANG}))) = 0"
D_MAPPED = f"SELECT url, min(page_id // 100 * 4294967296 + page_id % 100) AS url_ord FROM (SELECT page_id, 'https://docs.example.com' || {D_PATH} AS url FROM pages) WHERE {D_KEEP} GROUP BY url"


def _sitemaps(spark, sf) -> DataFrame:
    """Sitemaps of a hundred pages each below an index in the third spelling at the host's root."""
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    pages = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 100).alias("k"), "page_id", F.concat(F.lit("<url><loc> https://docs.example.com"), path, F.lit(" </loc></url>")).alias("loc"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "loc"))), lambda x: x["loc"]), "\n")
    child = F.concat(F.lit("https://docs.example.com/map-"), F.col("k").cast("string"), F.lit(".xml"))
    children = pages.groupBy("k").agg(body.alias("body")).select("k", child.alias("url"), "body")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "url"))), lambda x: F.concat(F.lit("<sitemap><loc>"), x["url"], F.lit("</loc></sitemap>"))), "")
    index = children.agg(F.concat(F.lit("<sitemapindex>"), listed).alias("body")).select(F.lit("https://docs.example.com/sitemap-index.xml").alias("url"), F.lit(200).alias("status"), "body")
    gone = spark.createDataFrame([("https://docs.example.com/en/sitemap.xml", 404, "<loc>https://docs.example.com/gone</loc>")], "url string, status int, body string")
    return gone.unionByName(children.select("url", F.lit(200).alias("status"), "body")).unionByName(index)


@query(D_MAPPED)
def sitemap_pages(spark, sf):
    return discovery.mapped_urls(_sitemaps(spark, sf), "https://docs.example.com/en/")


@query(f"SELECT 'sitemap' AS stage, url, url_ord, false AS partial, 3::BIGINT AS stages_tried FROM ({D_MAPPED})")
def discovery_ladder(spark, sf):
    few = spark.createDataFrame([("https://docs.example.com/en/llms.txt", 200, "# Docs\n- [a](/a)\n- [b](b)\nhttps://docs.example.com/c")], "url string, status int, body string")
    return discovery.discover(_sitemaps(spark, sf).unionByName(few), "https://docs.example.com/en/")


@query(f"SELECT page_id AS url_ord, CASE page_id % 3 WHEN 1 THEN {D_PATH} ELSE url END AS url FROM pages")
def index_lines(spark, sf):
    line = "CASE page_id % 3 WHEN 0 THEN concat('- [t ', page_id, '](', url, '): about') WHEN 1 THEN concat('-[t](', coalesce(try_parse_url(url, 'PATH'), ''), ')') ELSE concat('see ', url, ' there') END"
    pages = table(spark, sf, "pages").selectExpr("page_id", f"{line} AS body")
    # a text a page, whose line stands at the page's number
    return discovery.index_links(pages, "page_id")


D_METHOD = "CASE page_id % 6 WHEN 0 THEN 'content-negotiation' WHEN 1 THEN 'md-suffix' WHEN 2 THEN 'rtd-sources' WHEN 3 THEN 'local-html' WHEN 4 THEN 'proxy' END"


@query(
    f"WITH a AS (SELECT page_id AS url_ord, url || '#' || page_id AS url, {D_METHOD} AS method FROM pages) SELECT url_ord, url, CASE WHEN method IS NULL OR url_ord % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN url_ord % 5 <> 0 THEN method END AS method, "
    "CASE WHEN method IS NULL OR (url_ord % 5 = 0 AND method = 'local-html') THEN 'no method served' WHEN url_ord % 5 = 0 THEN 'soft 404 or login wall' END AS error FROM a"
)
def acquired_pages(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("url_ord"), F.concat(F.col("url"), F.lit("#"), F.col("page_id")).alias("url"))
    body = F.concat(F.when(F.col("url_ord") % 5 == 0, F.lit("# 404\n")).otherwise(F.lit("# Fine\n")), F.lit("## a\n## b\n"), F.repeat(F.lit("word "), F.lit(60)))
    answers = pages.select("url", F.expr(D_METHOD.replace("page_id", "url_ord")).alias("method"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), body.alias("body"), F.lit(None).cast("string").alias("error"))
    broken = pages.filter("url like '%1'").select("url", F.lit("content-negotiation").alias("method"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("body"), F.lit("timeout").alias("error"))
    return discovery.acquire(pages, answers.filter("method is not null").unionByName(broken)).drop("content")


# Evidence and run state
@query(f"SELECT string_agg(n || ' ' || reason, ', ' ORDER BY n DESC, reason) AS breakdown FROM (SELECT coalesce(error, 'Unknown error') AS reason, count(*) AS n FROM {D_ALL} WHERE status <> 'ok' GROUP BY 1)")
def exclusion_breakdown(spark, sf):
    return state.exclusion_breakdown(state.exclusions(_results(spark, sf)))


RUNS = """SELECT regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) AS name, count(*) AS n, sum(octet_length({h})) AS bytes, sum(CASE WHEN page_id % 3 = 0 THEN octet_length({h}) ELSE 0 END) AS sample_bytes,
 sum(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END) AS sample_n, min(page_id) AS k FROM pages GROUP BY 1"""
RUN = """SELECT name, concat('https://e.com/', name) AS url, CASE WHEN k % 2 = 0 THEN 'sitemap' ELSE 'llms-full-txt' END AS discovery_method, k % 2 = 1 AS fast_path, CASE WHEN k % 3 = 0 THEN n + 5 END AS pages_listed, n AS raw_files, bytes AS raw_bytes,
 CASE WHEN k % 2 = 1 THEN 0 ELSE n END AS clean_files, CASE WHEN k % 2 = 1 THEN 0 ELSE bytes - n * 31 END AS clean_bytes, bytes - n * 100 AS compiled_bytes, CASE WHEN k % 4 = 0 THEN bytes - 1 END AS header_tokens, CASE WHEN k % 4 = 1 THEN bytes - 2 END AS run_tokens,
 CASE WHEN k % 5 = 0 THEN 'q' END AS smart_query, 40 AS smart_top_n, CASE WHEN k % 7 = 0 THEN 0.5 WHEN k % 7 = 1 THEN NULL ELSE 12.5 END AS elapsed, n AS page_pool, sample_n AS html_n, sample_bytes AS html_bytes FROM r"""


def _half_up(x: str, places: int) -> str:
    return f"floor(({x}) * {10**places} + 0.5::DOUBLE) / {10**places}::DOUBLE"


D_HTML_MEAN, D_MEAN = _half_up("html_bytes::DOUBLE / html_n", 0), _half_up("CASE WHEN fast_path THEN compiled_bytes::DOUBLE / page_pool ELSE clean_bytes::DOUBLE / clean_files END", 0)


@query(
    f"WITH r AS ({RUNS.format(h='encode(html)')}), m AS ({RUN}), s AS (SELECT *, coalesce(pages_listed, raw_files) AS pages, CASE WHEN html_n > 0 THEN {D_HTML_MEAN} END AS hm, {D_MEAN} AS mm FROM m) SELECT name, url, discovery_method, fast_path, pages AS pages_fetched, CAST(raw_bytes AS BIGINT) AS raw_bytes, CAST(clean_bytes AS BIGINT) AS clean_bytes, CAST(clean_files AS BIGINT) AS clean_files, CAST(compiled_bytes AS BIGINT) AS compiled_bytes, "
    f"CAST(coalesce(header_tokens, run_tokens, floor(compiled_bytes::DOUBLE / 4 + 0.5::DOUBLE)) AS BIGINT) AS compiled_tokens_est, CASE WHEN header_tokens IS NOT NULL THEN 'header of the compiled file' WHEN run_tokens IS NOT NULL THEN 'run record' ELSE 'a quarter of the bytes' END AS compiled_tokens_source, smart_query, CASE WHEN smart_query IS NOT NULL THEN smart_top_n END AS smart_top_n, "
    f"CASE WHEN NOT fast_path THEN {_half_up('(raw_bytes - clean_bytes) * 100.0::DOUBLE / raw_bytes', 1)} END AS pipeline_reduction_pct, CASE WHEN elapsed < 1 AND pages > 1 THEN NULL ELSE elapsed::DOUBLE END AS elapsed_s, CASE WHEN elapsed < 1 AND pages > 1 THEN 'left out: too short for its pages' END AS elapsed_note, page_pool AS sitemap_page_count, CAST(html_n AS BIGINT) AS html_sample_n, CAST(html_bytes AS BIGINT) AS html_sample_bytes, "
    f"hm AS html_mean_bytes_per_page, mm AS markdown_mean_bytes_per_page, CASE WHEN hm > 0 AND mm > 0 THEN {_half_up('hm / mm', 1)} END AS front_door_ratio FROM s"
)
def corpus_sizes(spark, sf):
    r = spark.sql(RUNS.format(h="html").replace("FROM pages", "FROM {pages}"), pages=table(spark, sf, "pages"))
    runs = spark.sql(RUN.replace("FROM r", "FROM {r}"), r=r).withColumn("elapsed", F.col("elapsed").cast("double"))
    return evidence.measure(runs)
