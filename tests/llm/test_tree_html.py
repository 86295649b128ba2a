import pytest

from mediasignals.llm import tree_html as H
from mediasignals.llm.queries import op9

from .conftest import SF

MENU = '<nav><ul><li><a href="/a">A menu</a></li><li><a href="/b">Another</a></li></ul></nav>'
LONG = "A sentence, with commas, that goes on for a while, and then some more, so that it counts."
CASES = [
    (None, ""), ("", ""), ("plain text, no markup", "plain text, no markup"), ("<p>", ""), ("<script>x<p>y</script>", ""),
    (f"<body>{MENU}<article><h1>T &amp; t</h1><p>One.<p>Two\n  <b>bo</b>ld<br>x &lt;i&gt;</article><footer>f</footer>",
     "T & t\nOne.\nTwo bold x <i>"),
    (f'<div class="with-sidebar"><div id="content"><h2>Head</h2><div><p>{LONG}</p><p>Short.</p></div></div>'
     f'<div class="sidebar"><p>{LONG}</p></div></div>', f"Head\n{LONG}\nShort."),
    (f'<main><p>{LONG}</p><div class="cookie-notice"><p>{LONG}</p></div><form><p>in</p><input><p>{LONG}</p></form>'
     f'<aside><p>{LONG}</p></aside><section id="comments"><p>{LONG}</p></section></main>', LONG),
    (f"<article><p>{LONG}</p><!-- <p>no</p> --><style>p{{}}</style><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>",
     f"{LONG}\none\ntwo\nc1\nc2"),
    (f"<body><header><p>{LONG}</p></header><p>{LONG}</p><p>{LONG}</p><div hidden><p>no</p></div>", f"{LONG}\n{LONG}"),
    (f'<div><p>{LONG}</p><p>a<span class="ad">BUY</span>b</p></div><div class="ad">{LONG} {LONG}</div>', f"{LONG}\nab"),
    (f"<article><p>{LONG}&#xe9;&nbsp;&eacute;&#0;</p><article class='comment'><p>{LONG}</p></article></article>",
     f"{LONG}é é�"),
    ('<article><p title="a>b" data-x=\'>\'>quoted</p></article>', "quoted"),
    ("<article><p>" + "word " * 20000 + "</p></article>", ("word " * 20000).strip()),
    ("<div>" * 3000 + "deep, text" + "</div>" * 3000, "deep, text"),
    ("<p>cut <a href='x", "cut"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_frame(spark):
    rows = [(i, "u", p, 0) for i, (p, _) in enumerate(CASES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text int")
    got = H.extract(pages).collect()
    assert len(got) == len(rows) and all(r.main_text == CASES[r.page_id][1] for r in got)
    assert H.extract(pages.limit(0)).count() == 0


def test_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op9(spark, SF).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        assert r.text == H.main_text(pages[r.page_id]) and r.n_chars == len(r.text) and r.text
