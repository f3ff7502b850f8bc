from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.operators import strip
from corpusmill.sources import html

PROSE = "This sentence is long enough to count as prose in a page of documentation, surely."


def clean(text, platform=None):
    return strip.strip_page(text, platform)[0]


def test_nav_run_of_five_goes_and_of_four_stays():
    nav = ["* one", "* two", "* three", "* four", "* five"]
    body = ["# T", PROSE]
    assert "* one" not in clean("\n".join([*body, *nav, PROSE]))
    assert "* one" in clean("\n".join([*body, *nav[:4], PROSE]))


def test_numbered_items_breadcrumbs_and_consent():
    assert "1. a" not in clean(f"# T\n{PROSE}\n1. a\n2. b\n{PROSE}")
    assert "1. a" in clean(f"# T\n{PROSE}\n1. a\n{PROSE}")
    assert "a > b > c > d" not in clean(f"# T\na > b > c > d\n{PROSE}") and "a > b > c" in clean(f"# T\na > b > c\n{PROSE}")
    assert "cookie" not in clean(f"# T\n{PROSE}\nOur cookie rules\n{PROSE}")


def test_footer_only_in_the_back_half():
    assert clean(f"# T\n{PROSE}\n{PROSE}\nLast updated today\nmore") == f"# T\n{PROSE}\n{PROSE}"
    assert "Last updated" in clean(f"# T\nLast updated x\n{PROSE}\n{PROSE}\n{PROSE}")


def test_gate_returns_the_original():
    text, _, failed = strip.strip_page("cookie")
    assert failed and text == "cookie"


def test_platform_blocks():
    assert "[a](b)" not in clean(f"# T\n{PROSE}\nNext\n[a](b)\n{PROSE}", "docusaurus")
    assert "Powered by Mintlify" not in clean(f"# T\n{PROSE}\nPowered by Mintlify\n{PROSE}", "mintlify")
    assert "stable" not in clean(f"# T\n{PROSE}\nVersions\nstable\n[x](y)\n{PROSE}", "readthedocs")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["", "# T", "1. x", "* one", "[a](b)", PROSE, "```", "Last updated"]), max_size=14))
def test_any_page_strips_without_growing(parts):
    text = "\n".join(parts)
    assert len(clean(text)) <= len(text) + 1


def test_html_to_markdown():
    page = "<html><body><nav>menu</nav><article><h1>Title</h1><p>One<p>Two <b>bold</b> <a href='/x'>link</a><pre class='language-py'><code>a = 1\n</code></pre><ul><li>i<li>j</ul>" + f"<p>{PROSE * 5}</article></body></html>"
    md, size = html.to_markdown(page)
    assert "# Title" in md and "[link](/x)" in md and "```py\na = 1\n```" in md and "*   i\n*   j" in md and "menu" not in md and size >= 300
    assert html.to_markdown("<p>short</p>")[0] is None and html.to_markdown("")[0] is None


def steps(platform, lines):
    for step in strip.REGISTRY[platform]:
        lines = step(lines, [])
    return lines


def test_html_blocks_preamble_and_header():
    assert clean(f"<nav>\nx\n</nav>\n# T\n{PROSE}\n<script>a</script>\nkept") == f"# T\n{PROSE}\nkept"
    assert clean(f"# T\n{PROSE}\n<style>\nnever closed") == f"# T\n{PROSE}"
    assert clean(f"# T\n{PROSE}\n  <nav>\nx") == f"# T\n{PROSE}\n  <nav>\nx"
    assert clean(f"Title: a\nURL Source: b\nMarkdown Content:\n\n{PROSE}") == PROSE
    assert clean(f"menu\nmore\n## Start\n{PROSE}") == f"## Start\n{PROSE}" and clean(f"menu\n### low\n{PROSE}").startswith("menu")


def test_navigation_below_the_title():
    nav = [f"[p{i}](u{i}) x" if i % 2 else f"* p{i}" for i in range(12)]
    long = PROSE + " And it goes on."
    shaped = [f"* [p{i}](u)" for i in range(5)]
    assert clean("\n".join(["# T", *shaped, long])) == f"# T\n\n{long}"
    assert clean("\n".join(["# T", *shaped[:4], long])) == "\n".join(["# T", *shaped[:4], long])
    assert clean("\n".join(["# T", *shaped, "# T", long])) == f"# T\n{long}"
    assert "short 5" in clean("\n".join(["# T", *[f"short {i}" for i in range(6)], *nav, long]))


def test_link_clusters_stand_alone():
    links = ["[a](b)", "[c](d)", "[e](f)"]
    assert clean("\n".join(["# T", PROSE, "", *links, "", PROSE])) == f"# T\n{PROSE}\n\n\n{PROSE}"
    assert "[a](b)" in clean("\n".join(["# T", PROSE, *links, "", PROSE])) and "[a](b)" in clean("\n".join(["# T", PROSE, "", *links[:2], "", PROSE]))
    assert clean("\n".join(["# T", PROSE, *links])) == f"# T\n{PROSE}"


def test_double_titles_and_blanks():
    assert clean(f"# Guide | Site\n\n# Guide\n{PROSE}") == f"# Guide\n{PROSE}" and clean(f"# Guide - Site\n# Other\n{PROSE}").count("# ") == 2
    assert clean(f"# T\n{PROSE}\n\n\n\n\n{PROSE}") == f"# T\n{PROSE}\n\n\n{PROSE}" and clean(f"# T\n{PROSE}\n\n\n{PROSE}") == f"# T\n{PROSE}\n\n\n{PROSE}"


def test_platform_blocks_swallow_up_to_their_cap():
    for platform, marker, inside, taken in (("docusaurus", "Next", "[a](b)", 5), ("readthedocs", "Versions", "[a](b)", 11), ("readthedocs", "Navigation", "* a", 21), ("mintlify", "Query Parameters", "string", 31), ("mkdocs", "Type to start searching", "", 6)):
        for extra in (0, 1, 3):
            got = steps(platform, ["# T", marker, *[inside] * (taken + extra), "end"])
            assert got == ["# T", *[inside] * extra, "end"], (platform, extra, got)
        assert steps(platform, ["# T", marker, inside, "text", inside, "end"])[-3:] == ["text", inside, "end"]


def test_platform_markers():
    assert steps("docusaurus", ["Next", *["[a](b)"] * 4, "Previous", *["[a](b)"] * 5, "x"]) == ["x"]
    assert steps("docusaurus", ["Docs", "[a](b)", "Docs", "text", "[Edit this page](x)", "Built with Docusaurus"]) == ["[a](b)", "Docs", "text"]
    assert steps("gitbook", ["On this page", "[a](b)", "* c", "", "text", "**Part**", "[a](b)", "", "[c](d)", "end", "**Bold**", "text", "Powered by GitBook", "Last modified 3d"]) == ["text", "end", "**Bold**", "text"]
    assert steps("mkdocs", ["Search", "", "text"]) == ["Search", "", "text"] and steps("mkdocs", ["Search", "Initializing search", "", "text"]) == ["text"]
    assert steps("mkdocs", ["Skip to content", "x", "Made with Material for MkDocs"]) == ["x"]
    assert steps("mintlify", ["Was this page helpful?", "Body", "prose", "Powered by Mintlify", "Body", "", "required", "x"]) == ["Body", "prose", "x"]
    assert steps("readthedocs", ["v: latest", "[stable](x)", "text", "Built with Sphinx using a theme provided by Read the Docs."]) == ["text"]
