"""HTML to markdown against hand-made cases."""

from corpusmill.sources import html

FILL = "x" * 300


def markdown(body):
    return html.to_markdown(f"<article>{body}<p>{FILL}</p></article>")[0].removesuffix(FILL).strip()


def test_blocks():
    assert markdown("<h1>A  b</h1><p>one\n two<p>three<br>four") == "# A b\n\none two\n\nthree  \nfour"
    assert markdown("<h2><a href='#x'>T</a></h2><blockquote><p>a<p>b</blockquote><hr>") == "## [T](#x)\n\n> a\n> \n> b\n\n* * *"
    assert markdown("<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x</li><li>y</ol>") == "*   a\n*   b\n    *   c\n\n3.  x\n4.  y"
    assert markdown("<table><tr><th>h<td>v</table>") == "h\n\nv" and markdown("<div>a<div>b</div>c</div>") == "a\n\nb\n\nc"


def test_inline_and_escapes():
    assert markdown("<p>a <b>bold </b>and <em> em</em> <code>c`d</code> <a href=u title=t>l</a> <img src=i alt=p>") == "a **bold** and _em_ ``c`d`` [l](u \"t\") ![p](i)"
    assert markdown("<p>a*b_c[d]`e\\f") == "a\\*b\\_c\\[d\\]\\`e\\\\f"
    for text, want in (("- x", "\\- x"), ("# x", "\\# x"), ("#x", "#x"), ("1. x", "1\\. x"), ("+ x", "\\+ x"), ("> x", "\\> x"), ("a - b", "a - b"), ("&lt;b&gt; &amp; c", "<b> & c")):
        assert markdown(f"<p>{text.replace('> x', '&gt; x')}</p>") == want


def test_code_and_its_language():
    assert markdown("<pre><code class='x language-py z'>a *b*\n  c\n</code></pre>") == "```py\na *b*\n  c\n```"
    for wrap, want in (
        ("<pre class='language-c++'><code>1</code></pre>", "c"), ("<pre data-lang=b data-language=a><code data-language=c>1</code></pre>", "a"), ("<pre><code data-lang=q>1</code></pre>", "q"),
        ("<div class='language-go'><div><div><div><div><pre>1</pre></div></div></div></div></div>", "go"), ("<div class='language-go'><div><div><div><div><div><pre>1</pre></div></div></div></div></div></div>", ""), ("<div data-lang=no><pre>1</pre></div>", ""),
    ):
        assert markdown(wrap) == f"```{want}\n1\n```"


def test_the_longest_content_element_without_its_chrome():
    page = "<nav>menu</nav><main><aside>side</aside><p>short</main><div class='content big'><div class=toc>toc</div><p>" + FILL + "</p><script>x</script></div><footer>f</footer>"
    assert html.to_markdown(page) == (FILL, 300)
    assert html.to_markdown("<article><p>" + FILL[1:] + "</article>") == (None, 299) and html.to_markdown("") == (None, 0)
    assert html.to_markdown(f"<article><p>{FILL}</article><main><p>{FILL}y</main>")[0] == FILL + "y"
    assert html.to_markdown(f"<article><p>{FILL}</article><main><p>{'z' * 300}</main>")[0] == FILL
    assert html.to_markdown(f"<body><div><p>{FILL}</p><p>more</p></div><div><p>less</p></div></body>")[0] == FILL + "\n\nmore"
