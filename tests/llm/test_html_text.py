from __future__ import annotations

import time
from html.parser import HTMLParser

from anbar.llm.html_text import extract, op5_html_text, render

SF = "/root/testdata/sf0.01"


class Words(HTMLParser):
    """The words of all text outside of the head, scripts and styles."""

    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")
        if tag not in ("b", "a", "i", "em", "span"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")
        if tag not in ("b", "a", "i", "em", "span"):
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_all_visible_words_come_out(spark):
    pages = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()}
    rows = op5_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        words = Words()
        words.feed(pages[r["page_id"]])
        words.close()
        expected = "".join(words.parts).split()
        assert [w for w in r["text"].split() if w != "-"] == [w for w in expected if w != "-"]
        assert r["n_words"] == len(r["text"].split())


def test_blocks_and_lists():
    html = "<h1>T</h1>a <b>b</b>c<p>one<p>two<br>three<ul><li>x<li>y<ol start=9><li>n<li>m</ol><li>z</ul><hr>end"
    assert render(html) == "T\n\na bc\n\none\n\ntwo\nthree\n\n- x\n- y\n  9. n\n  10. m\n- z\n\nend"
    assert render("<dl><dt>term<dd>meaning<dt>next</dl>") == "term\n  meaning\nnext"
    assert render("<blockquote>said<p>more</blockquote>") == "  said\n\n  more"


def test_tables_are_aligned():
    html = ("<table><caption>Cap</caption><thead><tr><th>Name<th>Qty<th>Note<tbody><tr><td>apple<td>1<td>a"
            "<tr><td>kiwi fruit<td colspan=2>none<tr><td>x<br>y<td>2<td>b</table>after")
    assert render(html) == (
        "Cap\n\nName        Qty  Note\napple       1    a\nkiwi fruit  none\nx           2    b\ny\n\nafter")
    assert render("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>") == "a        b\n\nin  ner"


def test_visibility_and_broken_markup():
    assert render("a<div style='color:red; display : none'>no</div><span hidden>no</span><!-- no -->b") == "ab"
    assert render("<title>no</title><style>p{}</style><script>if (a</p>b) '</div>'</script>yes") == "yes"
    assert render("<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>") == "s\nt\nu"
    assert render("<template>no</template><noscript>no</noscript><select><option>no</select>1 &lt; 2 &amp; 3 < 4") == "1 < 2 & 3 < 4"
    assert render("<pre>\n a\n\n  b</pre>") == " a\n\n  b"
    assert render("<p>x</div></p></b><i>y") == "x\n\ny"
    assert render("<!-- never closed") == "" and render("<a href='x>y") == "<a href='x>y"
    assert render("<textarea>kept <b></textarea>") == "kept <b>"
    assert "".join(render("<div>" * 5000 + "deep" + "<b>" * 3000 + "er").split()) == "deeper"


def test_depth_changes_nothing():
    for opened in ("<div>", "<b>", "<p><span>", "<ul><li>", "<blockquote>", "<button><p>"):
        deep = opened * 10_000
        assert render(f"{deep}<div style='display:none'>no<i>no</i></div>yes").split()[-1] == "yes"
        lines = render(f"{deep}<table><tr><td>a<td>b<tr><td>long<td>c</table>").splitlines()
        assert [line.strip(" -") for line in lines if line.strip(" -")] == ["a     b", "long  c"]
    started = time.perf_counter()
    assert render("<div>" * 200_000 + "x" + "</div>" * 200_000 + "y") == "x\ny"
    assert time.perf_counter() - started < 30


def test_edges(spark):
    schema = "page_id long, html string, text string, n_words int"
    rows = [(1, None), (2, ""), (3, "<p>word " * 30_000), (3, "<p>again"), (None, "<li>x"), (4, "<" * 200_000), (5, "<a " * 90_000), (6, "<a \"" * 30_001)]
    out = extract(spark.createDataFrame([(*r, "x", 1) for r in rows], schema)).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[1]["text"] is None and by[1]["n_words"] == 0 and by[2]["text"] == ""
    assert by[None]["text"] == "x"
    assert {r["n_words"] for r in out if r["page_id"] == 3} == {30_000, 1}
    assert extract(spark.createDataFrame([], schema)).count() == 0
