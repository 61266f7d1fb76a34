"""Character references without Python, against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from corpusframe.functions.html import html_to_text, unescape
from corpusframe.plans import corpus as C
from corpusframe.sources.ingest import merged_corpus


def decoded(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["u"] for r in df.select("i", unescape(F.col("t")).alias("u")).orderBy("i").collect()]


def test_every_name(spark):
    texts = [f"a &{n} b &{n.rstrip(';')}x &{n.rstrip(';')}=1&{n}" for n in html5]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_numbers(spark):
    odd = [*range(0, 0x180), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x1FFFF,
           0x10FFFE, 0x10FFFF, 0x110000, 10**8, 10**30]
    texts = [f"&#{n};|&#x{n:x};|&#X{n:X}|&#{n}|&#000{n};" for n in odd] + ["&#;", "&#x;", "&#xg", "&#", "&", "&&amp;", "& amp;", "&#x" + "0" * 40 + "41;"]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_random_texts(spark):
    r = random.Random(4)
    bits = ["&", "#", "x", ";", "amp", "lt", "not", "notin", "in;", "copy", "1", "65", "é", "\U0001F600", " ", "\n", "<", "=", "zz" * 20, "hellip;", "CounterClockwiseContourIntegral;"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(3000)]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_html_to_text_decodes_part_by_part(spark):
    cases = {
        "<p>&hellip;</p> &amp;lt; &#233;t&eacute; <b>&nbsp;</b>": "… &lt; été",
        "<p>a&ampb &notit; ?x=1&y=2</p><script>&copy;&hellip;</script>c": "a&b ¬it; ?x=1&y=2 c",
        "no tag &hellip;": "no tag &hellip;",
        "<br>&amp;hellip; &copy;": "&hellip; ©",
        "<br>&hellip": "&hellip",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", html_to_text("t").alias("x")).collect()}
    assert got == cases


def test_no_python_in_the_plans(spark, small_dir):
    for df in (C.table(spark, small_dir, "pages").select(html_to_text("html")), merged_corpus(spark, small_dir)):
        plan = df._jdf.queryExecution().toString()
        assert not any(n in plan for n in ("EvalPython", "PythonUDF", "MapInArrow", "MapInPandas"))
