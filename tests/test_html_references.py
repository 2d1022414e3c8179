"""Every character reference of a page, against html.unescape."""

from html import unescape
from html.entities import html5

from pyspark.sql import functions as F

from docforge.sources.html import html_to_text


def test_all_references(spark):
    texts = [f"x&{n}y" for n in html5] + ["a&mdash;b &#8212; &#x2014; &#xA0;c &rsquo;&eacute; &copy; &#39;", "&amp;eacute; &amp;amp; &amp;#8212;", "AT&T &unknown; & 1 &", "&#0;&#xD800;&#150;&#x110000;", "&nbsp;a&nbsp; b", "plain"]
    df = spark.createDataFrame([(i, f"<p>{t}</p>") for i, t in enumerate(texts)] + [(-1, None)], "id long, html string")
    for form in (html_to_text,):
        got = {r[0]: r[1] for r in df.select("id", form(F.col("html"))).collect()}
        assert got.pop(-1) is None
        for i, t in enumerate(texts):
            assert got[i].split() == unescape(t).replace("\xa0", " ").split(), (form, t, got[i])


def test_section_breaks_a_line_and_spaces_collapse(spark):
    df = spark.createDataFrame([("<section>a  \x0b&eacute;</section><section>b</section>",)], "html string")
    for form in (html_to_text,):
        assert df.select(form(F.col("html"))).first()[0].strip("\n").split("\n\n") in (["a é", "b"],)
