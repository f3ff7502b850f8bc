"""Discovery, acquisition, detection and assembly against hand-made cases."""

from pyspark.sql import functions as F

from corpusmill.operators import compile as assemble
from corpusmill.operators import detect, lines, validate
from corpusmill.plans import evidence
from corpusmill.sources import discovery

BASE = "https://docs.example.com/en/"
SCHEMA = "url string, status int, body string"
FULL = "# Docs\n- a list\n" + "\n".join(f"## part {i}\n" + "word " * 120 for i in range(10))


def test_addresses_resolve(spark):
    base = "https://e.com/a/b?q=1#f"
    cases = {
        "x": "https://e.com/a/x", "/x": "https://e.com/x", "./x": "https://e.com/a/x", "../x": "https://e.com/x", "../../x": "https://e.com/x", "x/../y/./z": "https://e.com/a/y/z", "x/..": "https://e.com/a/",
        "?p=2": "https://e.com/a/b?p=2", "#top": "https://e.com/a/b?q=1", "//o.org/x": "https://o.org/x", "HTTP://E.com": "http://e.com/", "https://E.com/A b#c": "https://e.com/A%20b", "mailto:x@y": None, "x#f": "https://e.com/a/x", "": "https://e.com/a/b?q=1",
    }
    df = spark.createDataFrame(list(cases.items()), "href string, want string")
    for r in df.select("href", "want", discovery.resolve(F.col("href"), F.lit(base)).alias("got")).collect():
        assert r.got == r.want, r
    assert spark.range(1).select(discovery.resolve(F.lit("x"), F.lit("https://e.com"))).first()[0] == "https://e.com/x"


def test_source_addresses(spark):
    cases = {
        "https://x.io/en/latest/a/b/": "https://x.io/en/_sources/latest/a/b.md.txt", "https://x.io/p/stable/a.html?q": "https://x.io/p/stable/_sources/a.html.md.txt", "https://x.io/en/": "https://x.io/en/_sources/index.md.txt",
        "https://x.io/ens/a": None, "https://x.io/a": None,
    }
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert all(r.got == r.want for r in df.select("want", discovery.source_url(F.col("url")).alias("got")).collect())


def site(spark, *rows):
    return spark.createDataFrame([(u, 200 if len(x) == 1 else x[0], x[-1]) for u, *x in rows], SCHEMA)


def links(*paths):
    return "".join(f'<a class="c" href="{p}">t</a>' for p in paths)


def test_discovery_takes_the_first_sufficient_stage(spark):
    index = ("https://docs.example.com/en/llms.txt", "\n".join(f"- [p{i}](/p{i}): x" for i in range(5)))
    thin = ("https://docs.example.com/en/llms-full.txt", "# stub\n## a\n## b\n## c\n" + "w " * 300)
    full = ("https://docs.example.com/llms-full.txt", FULL)
    urlset = "<urlset>" + "\n".join(f"<loc> https://docs.example.com/m{i} </loc>" for i in range(6)) + "</urlset>"
    sitemap = ("https://docs.example.com/sitemap_index.xml", urlset)
    root = (BASE, links("a", "b", "/c", "#x", "mailto:q", "https://other.org/z", "/fr/d", "a#y"))
    deep = ("https://docs.example.com/en/a", links("e", "f", "b"))

    def got(*rows, **options):
        found = discovery.discover(site(spark, *rows), BASE, **options).orderBy("url_ord").collect()
        assert len({(r.stage, r.partial, r.stages_tried) for r in found}) <= 1
        return (found[0].stage, found[0].partial, found[0].stages_tried, [r.url.removeprefix("https://docs.example.com") for r in found]) if found else None

    assert got(thin, full, index, sitemap) == ("llms-full-txt", False, 1, ["/llms-full.txt"])
    assert got(thin, index, sitemap) == ("llms-txt", False, 2, [f"/p{i}" for i in range(5)])
    assert got(index, sitemap, most=3) == ("sitemap", True, 4, ["/m0", "/m1", "/m2"])
    assert got(thin, sitemap) == ("sitemap", False, 3, [f"/m{i}" for i in range(6)])
    assert got(root, deep) == ("link-crawl", False, 4, ["/en/a", "/en/b", "/c", "/en/e", "/en/f"])
    assert got(root, deep, exclude=("c",)) == ("link-crawl", True, 4, ["/en/a", "/en/b", "/en/e", "/en/f"])
    assert got((index[0], "- [a](/a)"), (sitemap[0], 404, urlset)) == ("llms-txt", True, 4, ["/a"])
    external = spark.createDataFrame([(0, "https://docs.example.com/q")], "url_ord long, url string")
    assert got((index[0], "- [a](/a)"), external=external) == ("map", False, 5, ["/q"])
    assert got(("https://docs.example.com/x", "x")) is None


def test_crawl_filters_before_it_follows(spark):
    far = [f"https://other.org/{i}" for i in range(60)]
    pages = site(spark, (BASE, links(*far, "last")), ("https://docs.example.com/en/last", links("deep")))
    assert [r.url for r in discovery.crawl(pages, BASE).orderBy("url_ord").collect()] == ["https://docs.example.com/en/last", "https://docs.example.com/en/deep"]


def test_sitemap_children_keep_their_order(spark):
    child = lambda k: f"https://docs.example.com/c{k}.xml"
    index = "<sitemapindex>" + "".join(f"<loc>{child(k)}</loc>" for k in (2, 0, 9, 1)) + "</sitemapindex>"
    rows = [("https://docs.example.com/en/sitemap.xml", index), *[(child(k), "".join(f"<loc>https://docs.example.com/{k}-{i}</loc>" for i in range(3))) for k in range(3)]]
    assert [r.url[25:] for r in discovery.mapped_urls(site(spark, *rows), BASE).orderBy("url_ord").collect()] == [f"{k}-{i}" for k in (2, 0, 1) for i in range(3)]


def test_acquisition_takes_the_first_usable_method_in_order(spark):
    md, gone = "# T\n\n" + "word " * 80, "# 404\n\nnothing"
    answers = [
        ("a", "content-negotiation", 200, "text/plain", "plain text", None), ("a", "md-suffix", 200, None, md, None), ("a", "proxy", 200, None, "x " * 60, None),
        ("b", "content-negotiation", 200, "text/markdown", gone, None), ("b", "rtd-sources", 200, None, "plain " * 60, None),
        ("c", "content-negotiation", 200, "text/markdown", gone, None), ("d", "md-suffix", 500, None, md, None), ("e", "proxy", None, None, None, "timeout"),
        ("f", "local-html", 200, "text/html", None, None), ("g", "local-html", 200, "application/json", md, None), ("h", "local-html", 200, "Text/HTML", md, None),
    ]
    urls = spark.createDataFrame([(i, u) for i, u in enumerate("hgfedcbaz")], "url_ord long, url string")
    df = spark.createDataFrame(answers, "url string, method string, status int, content_type string, body string, error string")
    got = {r.url: (r.url_ord, r.status, r.method, r.error) for r in discovery.acquire(urls, df).collect()}
    none, soft = "no method served", "soft 404 or login wall"
    assert got == {
        "h": (0, "ok", "local-html", None), "g": (1, "error", None, none), "f": (2, "error", None, none), "e": (3, "error", None, none), "d": (4, "error", None, none),
        "c": (5, "error", None, soft), "b": (6, "ok", "rtd-sources", None), "a": (7, "ok", "md-suffix", None), "z": (8, "error", None, none),
    }


def test_detection_by_hand(spark):
    def got(texts, url="https://example.com/x"):
        r = detect.detect_platform(spark.createDataFrame(list(enumerate(texts)), "page_ord long, content string"), url).collect()
        return (r[0].platform, r[0].confidence, list(r[0].evidence)) if r else None

    assert got(["GitBook"] * 8 + ["x"] * 2) == ("gitbook", 0.37, ["8/10 pages contain 'gitbook'"])  # 16 / (3 + 4 * 10)
    assert got(["gitbook"] * 6 + ["x"] * 4) == ("generic", 0.0, [])  # 12 / 43 = 0.28
    assert got(["x"], "https://a.gitbook.io/x") == ("gitbook", 0.43, [r"URL matches \.gitbook\.io"])  # 3 / 7
    assert got(["mkdocs vitepress"]) == ("generic", 0.0, [])  # 2 / 7, below 0.3
    assert got(["powered by mintlify"] * 2)[:2] == ("mintlify", 0.73)  # 8 / 11
    assert got(["powered by gitbook, powered by mintlify"])[0] == "gitbook" and got([]) is None


def test_line_masks(spark):
    text = "```\n* a\n```\n\n* one\n* two\n\n\n\n1. x\n1. y\n```\nopen"
    pages = spark.createDataFrame([(0, text), (1, ""), (2, "one")], "page_ord long, content string")
    made = lines.page_lines(pages)
    fenced = {r.page_ord: list(r.in_code) for r in lines.with_fences(made).collect()}
    assert fenced[0] == [False, True, True, *[False] * 9, True] and fenced[1] == [False]
    m = lines.mask(lambda s: s["t"].startswith("*"))
    r = made.filter("page_ord = 0").select(lines.run_lengths(m).alias("n"), lines.run_places(m).alias("k")).first()
    assert list(r.n) == [0, 1, 0, 0, 2, 2, 0, 0, 0, 0, 0, 0, 0] and list(r.k) == [0, 1, 0, 0, 1, 2, 0, 0, 0, 0, 0, 0, 0]
    texts = {r.page_ord: r.c for r in lines.collapse_blanks(made).select("page_ord", lines.join_lines().alias("c")).collect()}
    assert texts == {0: text.replace("\n\n\n\n1", "\n\n\n1"), 1: "", 2: "one"}
    assert lines.from_lines(lines.to_lines(pages)).count() == 3


def test_compiled_texts(spark):
    long = "This paragraph is long enough to be looked up among the blocks of other pages."
    plain = "Plain words without a heading, ten of them or more, are here."
    pages = [
        (0, "https://e.com/b/one", f"# One [x](y)\n\n{long} one two three\n## Shared\n{long}"), (1, "https://e.com/b/two", f"# Two\n\nAnother text of more than ten words stands here, on its own.\n## Shared\n{long}"),
        (2, "https://e.com/c", plain), (3, "https://e.com/d", plain), (4, "https://e.com/e", f"## Shared\n{long}"),
    ]
    df = spark.createDataFrame(pages, "page_ord long, url string, content string")
    corpus = assemble.postcompiled(df, "n", "https://e.com", "2026-01-01")
    assert corpus.stats.drop("tokens").first().asDict() == {"pages_in": 5, "pages_out": 3, "pages_dropped": 2, "blocks_deduped": 2, "headings_normalised": 3}
    r = corpus.text().first()
    assert r.pages == 3 and r.content == (
        "# n — Reference Documentation\n<!-- Assembled from 5 pages, 2 dropped as duplicates, 2 duplicate blocks removed -->\n\n> Source: https://e.com | 2026-01-01\n> 3 pages after deduplication\n\n## Table of Contents\n\n"
        "1. **B**\n   - [One x](#one-x)\n   - [Two](#two)\n2. [c](#c)\n"
        f"\n---\n\n## One x\n\n### One [x](y)\n\n{long} one two three\n#### Shared\n{long}\n\n---\n\n## Two\n\n### Two\n\nAnother text of more than ten words stands here, on its own.\n\n---\n\n## c\n\n{plain}"
    )
    flat = assemble.compiled(df.limit(1), "n", "https://e.com", "2026-01-01").text().first().content
    assert flat.startswith("# n Documentation\n\n> Mirrored from https://e.com on 2026-01-01\n> 1 pages | ~") and "\n- [One [x](y)](#one-x-y)\n" in flat and "\n## Page: One [x](y) (source: https://e.com/b/one)\n\n# One" in flat
    order = spark.createDataFrame([(0, "https://e.com/Zeta"), (1, "https://e.com/alpha"), (2, "https://e.com/"), (3, "https://e.com/éclair"), (4, "https://e.com/edge")], "page_ord long, url string")
    assert [r.page_ord for r in assemble.in_order(order).orderBy("sort_key").collect()] == [2, 1, 3, 4, 0]


def test_headings_keep_their_distance_and_are_clamped(spark):
    cases = {"# a\n## b\n###### c": "### a\n#### b\n###### c", "###### x": "### x", "none": "none", "#nospace\n## y": "#nospace\n### y", "## z\n```\n# in code\n```": "#### z\n```\n### in code\n```"}
    df = spark.createDataFrame(list(enumerate(cases)), "page_ord long, content string")
    got = {r.page_ord: (r.content, r.changed) for r in assemble.shift_headings(df).collect()}
    assert [got[i][0] for i in range(len(cases))] == list(cases.values()) and [got[i][1] for i in range(len(cases))] == [2, 1, 0, 1, 2]


def test_reports_of_empty_tables(spark):
    urls, results = spark.createDataFrame([], "url string"), spark.createDataFrame([], "url string, status string, error string")
    assert validate.coverage(urls, results, urls).first().asDict() == {"discovered": 0, "fetched": 0, "percent": 0.0, "sitemap_urls": 0, "sitemap_percent": 100.0}
    detail = validate.cleanliness(spark.createDataFrame([], "page_ord long, content string"))
    assert validate.cleanliness_report(detail).first().flagged_percent == 0.0


def test_evidence(spark):
    texts = spark.createDataFrame([("https://h.io/docs/llms.txt", "- [a](/x.md) [b](y) [c](https://h.io/llms-small.txt) [a](/x)\n[d](https://o.org/q.md?v)")], "url string, body string")
    assert {r.url for r in evidence.index_urls(texts, "https://h.io").collect()} == {"https://h.io/x", "https://h.io/y", "https://o.org/q?v"}
    rows = [("q", "a", True, None, 1.0, 10, 2, 1, ["m1"]), ("q", "b", False, "e", 3.0, 30, 4, None, ["m2", "m1"])]
    graded = spark.createDataFrame(rows, "arm string, question_id string, passed boolean, error string, cost double, duration_ms long, num_turns long, web_fetches long, models_used array<string>")
    r = evidence.arm_summary(graded).first()
    assert (r.total_turns, r.web_calls, list(r.models)) == (6, 1, ["m1", "m2"])
