from html import unescape
from html.entities import html5
from html.parser import HTMLParser

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filigraph.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_strip_takes_unicode_space(spark):
    assert one(spark, "   a b \n", tx.strip) == "a b"


def test_words_and_squeeze(spark):
    assert one(spark, "  a b\tc ", tx.words) == ["a", "b", "c"]
    assert one(spark, "  ", tx.words) == []
    assert one(spark, " a \n b ", tx.squeeze) == "a b"


def test_slug_keeps_a_hyphen_that_the_cut_leaves(spark):
    assert one(spark, "--Our R&D Lab!--", tx.slug) == "our-r-d-lab"
    assert one(spark, "ab cd ef", lambda c: tx.slug(c, 3)) == "ab-"
    assert one(spark, "é", tx.slug) == ""


def test_title_case_like_python(spark):
    for value in ("e-commerce", "it's r&d 2nd", "SUPPLY chain", ""):
        assert one(spark, value, tx.title_case) == value.title()


def test_display(spark):
    assert one(spark, "• | 2024 Form 10-K | 2 we build\nthings,", tx.display) == "We build things."
    assert one(spark, "Is it?", tx.display) == "Is it?"
    assert one(spark, "   ", tx.display) == "" and one(spark, None, tx.display) == ""


def test_risk_name_map_and_default(spark):
    assert one(spark, " Regulat ", lambda c: tx.risk_name(c, {"regulat": "Regulation"})) == "Regulation"
    assert one(spark, "market share", tx.risk_name) == "Market Share"


def test_clip(spark):
    assert one(spark, "x" * 46, lambda c: tx.clip(c, 45)) == "x" * 42 + "..."
    assert one(spark, "x" * 45, lambda c: tx.clip(c, 45)) == "x" * 45


def test_complete_sentences(spark):
    assert one(spark, "One. Two three. And th", tx.complete_sentences) == "One. Two three."
    assert one(spark, "One. And a long unfinished remainder", tx.complete_sentences) == "One. And a long unfinished remainder"
    assert one(spark, "Done!", tx.complete_sentences) == "Done!"


def test_html(spark):
    page = "<html><style>p{}</style><!-- x --><p>A &amp;lt; B&nbsp;</p><SCRIPT>var a='</p>'</SCRIPT><p> &#65;&#x42; <b>c</b>\n\n</p></html>"
    assert one(spark, page, tx.html_text).split("\n") == ["A &lt; B", "AB", "c"]
    assert one(spark, "", tx.html_text) == ""


class Reader(HTMLParser):
    """What the standard library's parser takes for text, a line for each run between tags and comments."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.inside = [], None

    def handle_starttag(self, tag, attrs):
        self.parts.append("\n")
        self.inside = tag if tag in ("script", "style") else self.inside

    def handle_endtag(self, tag):
        self.parts.append("\n")
        self.inside = None if tag == self.inside else self.inside

    def handle_data(self, data):
        self.parts.append("" if self.inside else data)

    def handle_comment(self, data):
        self.parts.append("\n")


def parsed(page):
    reader = Reader()
    reader.feed(page or "")
    reader.close()
    return "\n".join(line for line in (x.strip() for x in "".join(reader.parts).splitlines()) if line)


PAGES = [
    '<p title="a > b">x</p><a href=\'q>"r\'>y</a z="1">', "caf&eacute; &frac12; &frac12 &copy2024 &notit; &unknown; &amp;lt; &lt;b&gt; AT&T", "&#150;&#x93;q&#148; &#8364; &#0; &#xD800; &#x110000; &#128 &#x41",
    "a<!-- <b> -->b<br/>c < d 2<3", "<script>if (a<b) {}</script>t<STYLE media='x>y'>p{}</STYLE >u", "&NotEqualTilde;&CounterClockwiseContourIntegral; &Aacute&aacute;", "<p>open <b>never closed", "", "&", "&#;&#x;&;",
    "<p>a</p><!-- <script> --><p>b</p>", "<p title='<script>'>a</p><p>b</p>", "<p>a</p><script>'<!--'</script><p>b</p><!-- </script> --><p>c</p>", "<script/><p>a</p>", "<scripty>a</scripty><styles>b</styles>",
    "<style>/* <script> */</style>a<script>s = '</style>'</script>b", "a<!-- <style> -- <!-- -->b<script>x</SCRIPT\n>c", "<a b=\"<!--\">a</a>-->b", "<!DOCTYPE html><p>a</p>",
]
PARTS = ["<p>", "</p>", "x", " y ", "\n", "<!-- ", " -->", "<script>", "</script>", "<style a='>'>", "</style>", "<br/>", "<a t='<script>'>", '<a t="-->">', "&amp;", "&lt;"]


@settings(max_examples=15, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=60, max_size=60))
def test_html_of_any_order_of_parts(spark, pages):
    """Comments and scripts that end; what never ends is read in ways that differ."""
    whole = [p for p in pages if ends(p)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(whole)], "i int, v string").select("i", tx.html_text(F.col("v")).alias("r")).collect()
    for r in rows:
        assert r["r"] == parsed(whole[r["i"]]), whole[r["i"]]


def ends(page):
    """Whether every comment and script ends before the page does."""
    reader = Reader()
    reader.feed(page)
    return reader.rawdata == ""


def test_html_equals_the_standard_parser(spark, sf):
    pages = PAGES + [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, v string").select("i", tx.html_text(F.coalesce("v", F.lit(""))).alias("r")).collect()
    for r in rows:
        assert r["r"] == parsed(pages[r["i"]]), pages[r["i"]][:200]


def test_every_named_reference(spark):
    names = list(html5)
    rows = spark.createDataFrame([(f"x&{n} y",) for n in names], "v string").select("v", tx.decode_entities(F.col("v")).alias("r")).collect()
    assert all(r["r"] == unescape(r["v"]) for r in rows) and len(rows) == len(names)
    numbers = spark.createDataFrame([(f"&#{n};",) for n in range(300)], "v string").select("v", tx.decode_entities(F.col("v")).alias("r")).collect()
    assert [r["v"] for r in numbers if r["r"] != unescape(r["v"])] == []
