import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusframe.llm import html_layout as H

CASES = [
    ("", ""),
    (None, ""),
    ("plain text, 1 < 2 &amp; 3 &gt; 2", "plain text, 1 < 2 & 3 > 2"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<h1> A\n title </h1>body <b>bold</b>,<i> it</i>", "A title\n\nbody bold, it"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>x<li>y<ol start=3><li>z<li>w</ol></ul>after", "- x\n- y\n  3. z\n  4. w\n\nafter"),
    ("<ol><li><p>first</p><p>more</p></li><li>second</ol>", "1. first\n\n   more\n\n2. second"),
    ("<table><tr><th>Name<th>Qty<tr><td>apples<td>3<tr><td>figs<td>12</table>", "Name    Qty\napples  3\nfigs    12"),
    ("<table><tr><td colspan=2>wide cell here<td>x<tr><td>a<td>b<td>c</table>", "wide cell here  x\na  b  c"),
    ("<table><tr><td rowspan=2>tall<td>1<tr><td>2</table>", "tall  1\n      2"),
    ("<table>stray<tr><td>in</table>", "stray\n\nin"),
    ("<head><title>t</title></head><body>seen<script>var x='</p>';</script><style>p{}</style></body>", "seen"),
    ("<p hidden>no</p><p style='display: none'>no</p><p style='color:red'>yes</p><!-- c --><template>no</template>", "yes"),
    ("<details><summary>sum</summary>body</details><details open><summary>s2</summary>b2</details>", "sum\ns2\nb2"),
    ("<pre>  a\n   b</pre>x", "  a\n   b\n\nx"),
    ("<blockquote>q<br>r</blockquote>", "  q\n  r"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("</p></div>text</b>", "text"),
    ("a&nbsp;b &copy; &#x41; &unknown;", "a b © A &unknown;"),
    ("<a title='x > y' href=\"q\">link</a>", "link"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("<!doctype html><html><body><div><div>x</div></div><div>y</div>", "x\ny"),
    ("<p>open <!-- never closed", "open"),
    ("<script>never closed <p>x", ""),
]


@pytest.mark.parametrize("html,text", CASES)
def test_rendering(html, text):
    assert H.html_to_text(html) == text


HEADS = [
    ("<!DOCTYPE html><html><head><title>t</title><p>All the text", "All the text"),
    ("<head><meta charset=x>\n<link rel=y> bare text", "bare text"),
    ("<html><head><html><title>t</title><style>p{}</style><h1>one</h1><p>two</html>", "one\n\ntwo"),
    ("<head><template><p>no</template><script>no</script><noscript>no</noscript><div>yes</div></head>more", "yes\nmore"),
    ("<head><title>t</title></head><body>a<head> b", "a b"),
    ("<div>x<head>y</div>z", "xy\nz"),
    ("<head></br>x", "x"),
]


@pytest.mark.parametrize("html,text", HEADS)
def test_head_without_end_tag(html, text):
    assert H.html_to_text(html) == text


FOREIGN = [
    ("<div><svg class=i/> price 5</div>after", "price 5\nafter"),
    ("a <math/> b<svg viewBox='0 0 1 1'><path d='M0'/><circle r=1 /></svg> c", "a b c"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style>no</style><g><text x=1>one <tspan>two</tspan></text><text>three</text></g>no</svg>end", "one two three end"),
    ("<p>so <math><msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><mn>1</mn></math> is", "so x2+1 is"),
    ("<math><semantics><mi>y</mi><annotation encoding=tex>no</annotation></semantics></math>", "y"),
    ("<svg><foreignObject><p>in<p>side</foreignObject></svg>out", "in\n\nside\n\nout"),
    ("<p>a<svg><path d=x><p>b", "a\n\nb"),
    ("<svg><text><![CDATA[1 < 2 > 0]]></text></svg>", "1 < 2 > 0"),
    ("<svg><script/><text>seen</text><text display=none>no</text></svg>", "seen"),
    ("<svg><text x=1/>kept</text><text x='1'/>no<text y=2 />no</svg>", "kept"),
    ("<svg><a href=/x/><text>kept</text></a></svg>z", "kept z"),
    ("x<xmp>a <b> &amp;\n c</xmp>y", "x\n\na <b> &amp;\n c\n\ny"),
    ("<div/>one<p/>two", "one\n\ntwo"),
    ("<table><tr><td><svg><text>s</text></svg><td>t</table>", "s  t"),
]


@pytest.mark.parametrize("html,text", FOREIGN)
def test_foreign_and_example_elements(html, text):
    assert H.html_to_text(html) == text


def test_deep_and_wide_pages():
    assert H.html_to_text("<div>" * 20_000 + "x") == "x"
    assert H.html_to_text("<ul><li>" * 300 + "x").endswith("- x")
    assert len(H.html_to_text("<table>" + "<tr><td>" + "w" * 5000 + "<td colspan=999999>y" + "<tr><td>a<td>b" * 3000 + "</table>")) < 600_000
    assert H.html_to_text("<" * 5000) == "<" * 5000
    assert H.html_to_text("<p a='" * 30_000) == ""
    assert H.html_to_text("<p a=b'>it's</p> \"") == 'it\'s\n\n"'


SHOWN = [
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>z", "yes\nz"),
    ("<p style='display:nonesuch'>a</p><p style='color:red;display :NONE'>no</p><p style='visibility:hidden;visibility:visible'>b", "a\n\nb"),
    ("<p style='x-display:none'>a", "a"),
    ("<p style='visibility:hidden'>no<span>no</span></p>a", "a"),
    ("<ul style='visibility:collapse'><li>no<li style='visibility:visible'>b</ul>", "- b"),
    ("<table><tr><td style='visibility:hidden'>hid<td>x<tr><td>long one<td>y</table>", "          x\nlong one  y"),
    ("<svg><text visibility=hidden>no<tspan visibility=visible>yes</tspan></text></svg>", "yes"),
    ("<form>Name <input type=text value=no> <input type=submit value='Send it'><input type=RESET value=Clear></form>", "Name Send it Clear"),
    ("<ol><li>a<li value=7>b<li>c<li value=x>d</ol>", "1. a\n7. b\n8. c\n9. d"),
    ("<td>a<td>b", "ab"),
]


@pytest.mark.parametrize("html,text", SHOWN)
def test_visibility_labels_and_numbers(html, text):
    assert H.html_to_text(html) == text


HOSTILE = ["<table>x", "<b>y</i>", "<i>y<p>z", "<ul><li>x", "<ol><li value=3>x", "<table><tr><td>x", "<table><tr><td>x</table>", "<div>x</p>", "<a>x<p>", "<svg><g>x",
           "<math><mi>x", "<td>x", "<li>x", "</table>x", "<blockquote>x", "<select><option>x", "<p><b>x", "<dl><dd>x", "<tr>x", "<svg><foreignObject>x", "<details>x",
           "<span style='visibility:hidden'>", "<head>x", "<table><caption>x", "<pre>x", "<font color=a><svg>x"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_hostile_pages_take_time_in_proportion(unit):
    import time

    page = unit * (100_000 // unit.count("<"))
    began = time.process_time()
    H.html_to_text(page)
    assert time.process_time() - began < 5


def test_tables_in_very_many_tables_keep_their_text():
    words = [f"w{i}" for i in range(60)]
    assert H.html_to_text("".join(f"<table><tr><td>{w}" for w in words)).split() == words


def test_every_visible_word_is_kept():
    import random
    import re

    rnd = random.Random(1)
    tags = "p div b i ul li ol table tr td th span h2 blockquote dl dt dd section".split()
    for _ in range(300):
        n, html = 0, ""
        for _ in range(rnd.randrange(60)):
            k = rnd.random()
            if k < 0.4:
                html += f" w{n} "
                n += 1
            elif k < 0.75:
                html += f"<{rnd.choice(tags)}>"
            else:
                html += f"</{rnd.choice(tags)}>"
        assert sorted(map(int, re.findall(r"w(\d+)", H.html_to_text(html)))) == list(range(n)), html


def test_table_of_pages(spark):
    schema = StructType([StructField("page_id", LongType()), StructField("html", StringType()), StructField("text", StringType())])
    rows = [(i, h, "own") for i, (h, _) in enumerate(CASES)] + [(None, "<p>x", None), (1, CASES[1][0], "own")]
    found, name = H.extract(spark.createDataFrame(rows, schema))
    assert found.columns == ["page_id", "html", "text", name]
    got = {r["page_id"]: r[name] for r in found.collect()}
    assert all(got[i] == t for i, (_, t) in enumerate(CASES)) and got[None] == "x"
    assert H.extract(spark.createDataFrame([], schema))[0].count() == 0
