"""Run directories, manifests, state, compression and the whole flow."""

import json

from pyspark.sql import functions as F

from corpusmill.operators import compile as assemble
from corpusmill.operators import relevance, validate
from corpusmill.plans import mirror, state
from corpusmill.sources import runs

RESULTS = "url string, slug string, status string, error string, flags array<string>"


def results(spark):
    return spark.createDataFrame([("u1", "a", "ok", None, []), ("u2", "b", "ok", None, ["OTP"]), ("u3", "c", "error", "HTTP 500", None), ("u4", "d", "error", None, None)], RESULTS)


def test_manifest_round_trip(spark, tmp_path):
    one = state.manifest(results(spark), {"name": "n", "model": "secret", "api_key": "k", "lang": "en"})
    state.save_manifest(one, f"file://{tmp_path}/m")
    text = spark.read.text(f"file://{tmp_path}/m", wholetext=True).first()[0]
    saved = json.loads(text)
    assert saved["config"] == {"name": "n", "lang": "en"} and [p["url"] for p in saved["pages"]] == ["u1", "u2", "u3", "u4"]
    texts = spark.createDataFrame([(json.dumps({"name": "x", "url": "https://e.com", "pages": [{"url": "u", "status": "ok", "flags": ["BC"]}]}),), ("no json",), (None,)], "text string")
    rows = runs.manifests(texts).collect()
    assert rows[0].manifest.name == "x" and rows[0].manifest.pages[0].flags == ["BC"] and rows[1].manifest.name is None if rows[1].manifest else rows[1].manifest is None


def test_run_directories(spark, tmp_path):
    for path, size in (("r1/pages/a.md", 5), ("r1/clean/a.md", 3), ("r2/run.json", 7)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * size)
    got = {r.run: (r.files, r.bytes) for r in runs.run_sizes(spark, f"file://{tmp_path}").collect()}
    assert got == {"r1": (2, 8), "r2": (1, 7)}
    newest = runs.newest_runs(spark.createDataFrame([("n", "n-2026-01-01"), ("n", "n-2026-02-01"), ("m", "m-1")], "name string, dir string"))
    assert {(r.name, r.dir) for r in newest.collect()} == {("n", "n-2026-02-01"), ("m", "m-1")}


def test_state(spark):
    r = results(spark)
    assert state.quality_summary(r).first().asDict() == {"ok": 2, "clean": 1, "clean_percent": 50.0}
    assert state.quality_summary(r.filter("status = 'error'")).first().clean_percent == 100.0
    assert [tuple(x) for x in state.exclusions(r).collect()] == [("HTTP 500", 1), ("Unknown error", 1)]
    assert state.exclusion_breakdown(state.exclusions(r)).first()[0] == "1 HTTP 500, 1 Unknown error"
    done, pending = state.resume_state(r)
    assert {x.url for x in done.collect()} == {"u1", "u2"} and {x.url for x in pending.collect()} == {"u3", "u4"}
    again = spark.createDataFrame([("u3", "c", "ok", None, [])], RESULTS)
    assert sorted((x.url, x.status) for x in state.upsert(r, again).collect()) == [("u1", "ok"), ("u2", "ok"), ("u3", "ok"), ("u4", "error")]
    flagged = state.attach_flags(r, spark.createDataFrame([("b", ["BC", "SKIP"])], "slug string, flags array<string>"))
    assert {x.slug: list(x.flags) for x in flagged.collect()} == {"a": [], "b": ["BC", "SKIP"], "c": [], "d": []}
    names = {"https://www.docs.bun.sh/guide/x": "bun-guide", "https://hono.dev": "hono", "https://docs.astro.build/en/": "astro-en"}
    df = spark.createDataFrame(list(names.items()), "url string, want string")
    assert all(x.got == x.want for x in df.select("want", state.run_name(F.col("url")).alias("got")).collect())


def test_condense_keeps_what_fails_its_checks(spark):
    page = "intro words here\n## a\n```\ncode\n```\n## b\nmore words follow here"
    answers = {
        1: "short\n## a\n```\nc\n```\n## b", 2: "short\n## a\n## b", 3: "## a\n```\nc\n```", 4: page + " and many words more", 5: "x\nPlease provide the documentation\n## a\n```\n```\n## b",
        6: "a\nb\nc\nPlease provide the documentation\n## a\n```\n```\n## b",
    }
    pages = spark.createDataFrame([(k, f"{page}\n{k}") for k in range(1, 8)], "page_ord long, content string")

    def call(text):
        return answers[int(text.rsplit("\n", 1)[1])]

    made = validate.condense(pages, call)
    got = {r.page_ord: (r.status, r.content != f"{page}\n{r.page_ord}", r.reduction_percent) for r in made.collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: ("ok", True), 2: ("fallback", False), 3: ("fallback", False), 4: ("fallback", False), 5: ("fallback", False), 6: ("ok", True), 7: ("error", False)}
    stats = validate.condense_stats(made).first()
    assert (stats.ok, stats.fallback, stats.error) == (2, 4, 1) and abs(stats.avg_reduction - (got[1][2] + got[6][2]) / 2) < 1e-9


def test_pruning(spark):
    pages = spark.createDataFrame([(0, "alpha beta"), (1, "beta beta"), (2, "gamma"), (3, "alpha alpha beta")], "page_ord long, content string")
    top = lambda q, n: [r.page_ord for r in relevance.prune(pages, q, n).orderBy("page_ord").collect()]
    assert top("alpha", 2) == [0, 3] and top("beta", 1) == [1] and top("", 1) == top("the of", 1) == top("alpha", 0) == top("nothing", 1) == top("alpha", 9) == [0, 1, 2, 3]
    twice = {r.page_ord: r.score for r in relevance.bm25_scores(pages, "alpha alpha").collect()}
    once = {r.page_ord: r.score for r in relevance.bm25_scores(pages, "alpha").collect()}
    assert all(abs(twice[k] - 2 * once[k]) < 1e-12 for k in once) and once[2] == 0


def test_the_whole_flow(spark, tmp_path):
    prose = "This sentence is long enough to count as prose in a page of documentation, surely. "
    pages = [(k, f"p{k}", f"https://e.com/docs/{'ab'[k % 2]}/p{k}", f"# Page {k}\n\n{prose * 2}\n\n[Edit this page](x)\n## Part\n\nword{k} {prose}\nBuilt with Docusaurus") for k in range(6)]
    df = spark.createDataFrame(pages, "page_ord long, slug string, url string, content string")
    run = mirror.mirror(df, mirror.RunConfig("https://e.com/docs/", name="n", top=0, date="2026-01-01"))
    assert run.platform == "docusaurus" and run.corpus.stats.first().pages_out == 6
    text = run.corpus.text().first().content
    assert "Edit this page" not in text and "Built with" not in text and "\n6. [Page 5](#page-5)\n" in text and "### Page 3" in text
    assert [text.index(f"## Page {k}\n") for k in (0, 2, 4, 1, 3, 5)] == sorted(text.index(f"## Page {k}\n") for k in range(6))  # by path
    run.corpus.write(f"file://{tmp_path}/out")
    written = "\n".join(r.value for f in sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")) for r in spark.read.text(f"file://{f}").collect())
    assert written == text
    pruned = mirror.mirror(df, mirror.RunConfig("https://e.com/docs/", top=2, query="word4 word5"))
    assert {r.page_ord for r in pruned.clean.collect()} == {4, 5} and pruned.fidelity.count() == 2
    done = mirror.fast_path(spark.createDataFrame([("https://e.com/llms-full.txt", "# All\n\ntext")], "url string, body string"), mirror.RunConfig("https://e.com", name="n", date="2026-01-01"))
    assert done.corpus.stats.first().pages_in == 1 and done.fidelity.first().retention_percent == 100.0
    merged, again = mirror.resume(run.results, run.results.filter("page_ord < 2"), df, mirror.RunConfig("https://e.com/docs/", top=1, query="word4"))
    assert merged.count() == 6 and again.corpus.stats.first().pages_in == 6
    assert {r.status: (r.n, r.percent) for r in mirror.inspect(run.results).collect()} == {"ok": (6, 100.0)}
    assert assemble.in_order(df).orderBy("sort_key").first().page_ord == 0
