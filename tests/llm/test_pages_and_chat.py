import pytest

from floppyscope.llm.chat import preference_pairs
from floppyscope.llm.html import extract, main_text, stretches

PAGES = {
    "": "",
    "plain": "plain",
    "<p>a &lt;b&gt; &#x41;&nbsp;&eacute; <b>bo</b>ld": "a <b> A é bold",
    "<article>only\n\t text<br>here</article>": "only text here",
    "<nav><ul><li>x<li>y<article><h1>T</h1><p>One<p>Two<script>var a='<p>no</p>'; if (a<b && '</scripty>') {}</script></article>": "T\n\nOne\n\nTwo",
    "<main><section class='comments'><article><p>comment</p></article></section><article><header>H</header><p>real</p><aside>side</aside><form>f<input></form>"
    "<table><tr><td>c1<td>c2</table><pre>a\n b</pre><ul><li>i1<li>i2</ul></article></main><footer>no</footer>": "real\n\nc1\n\nc2\n\na b\n\ni1\n\ni2",
    "<article><p>one</p><aside><p>x</p><p>y</p><p>z</p><p>w</p></aside><p>two</p></article>": "one\n\ntwo",
    "<body><div class='menu'><a href=x>A</a></div><div id=content><p>Hello, a long paragraph of the article that has to be kept &amp; more, with enough text in it.</p>"
    "<p>Of.</p><div class='ad-box'>Buy!</div><p>The second paragraph.</p></div><div id=comments><p>A reader's comment, long enough to look like text; really it is that long.</p></div>"
    "<div class='cookie-notice'>We use cookies and other things that take a long sentence to explain to everyone.</div></body>": "Hello, a long paragraph of the article that has to be kept & more, with enough text in it.\n\nOf.\n\nThe second paragraph.",
    "<title>no</title><style>p{}</style><!-- no <p>no</p> --><article><p>yes</p><!-- never closed": "yes",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text(page) == PAGES[page]


def test_stretches():
    assert stretches([0, 0, 0, 100, 5, 0, 0, 0, 3, 0, 0, 0, 200, 90, 0], 86) == [(1, 5), (10, 14)]
    assert stretches([], 86) == [] and stretches([0, 0], 86) == []


def test_long_page():
    page = "<article>" + "".join(f"<p>paragraph {k}</p>" for k in range(20_000)) + "</article>"
    assert main_text(page).count("\n\n") == 19_999


def test_extract_odd_rows(spark):
    rows = [(1, "u", "<p>x</p>", 1), (1, "u", "<p>x</p>", 1), (None, None, None, 2), (2, "v", "", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = [tuple(r) for r in extract(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, "v", "", 0)]))
    assert extract(df.limit(0)).count() == 0


def test_preference_pairs(spark):
    turns = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, True, 2, "user", "and?"), (1, True, 3, "assistant", "so"),
        (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "yes"), (1, False, 2, "user", "and?"), (1, False, 3, "assistant", "no"),
        (2, True, 0, "user", "alone"), (3, True, 0, None, None), (3, False, 0, None, None), (3, False, None, "system", "<|end|>"), (None, False, 5, "assistant", "x"),
        (4, True, 0, "user", "a"), (4, True, 0, "user", "a"), (4, False, 0, "user", "a"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preference_pairs(df).collect()}
    one = got[1]
    assert one["n_common"] == 3 and one["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nand?<|end|>\n"
    assert one["chosen"] == "<|assistant|>\nso<|end|>\n" and one["rejected"] == "<|assistant|>\nno<|end|>\n"
    a, b = map(int, one["chosen_spans"].split(":"))
    assert one["chosen"][a:b] == "so<|end|>"
    assert got[2]["n_common"] == 0 and got[2]["rejected"] == "" and got[2]["rejected_spans"] == ""
    assert got[3]["n_common"] == 0 and "< |end|>" in got[3]["rejected"]
    assert got[4]["n_common"] == 1 and got[4]["chosen"] == "<|user|>\na<|end|>\n" and got[4]["rejected"] == ""
    assert got[None]["rejected_spans"] == "14:22"
    assert preference_pairs(df.limit(0)).count() == 0
