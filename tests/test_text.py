import html
from urllib.parse import quote_plus, unquote, unquote_plus

from pyspark.sql import functions as F

from crawlspark.functions import text

X = F.col("x")


def test_references_decode_like_the_standard(values):
    samples = [
        "plain", "a &amp; b", "&amp;lt;", "&copy; &copy2024 &notit;", "&#8364;&#x1F600;", "&#0;&#xD800;&#x110000;",
        "&#128;&#x99;", "&unknown; & &; &#; &#x;", "&AMP&LT", "tail &", "&middot;&hellip;&CounterClockwiseContourIntegral;",
        "&#00000000000065;",
    ]
    assert values(text.decode_references(X), samples) == [html.unescape(s) for s in samples]


def test_attribute_references_need_a_semicolon_before_letters(values):
    assert values(text.decode_references(X, attribute=True), ["?a=1&copy=2", "?a&amp;b", "&copy;", "&copyx"]) == [
        "?a=1&copy=2", "?a&b", "©", "&copyx"]


def test_strip_cuts_unicode_blanks(values):
    samples = ["  a b\t", "  x　\n", "​z", ""]
    assert values(text.strip(X), samples) == [s.strip() for s in samples]


def test_percent_coding(values):
    samples = ["a+b%20c", "%zz%41", "100%", "%C3%A9", "", "a%2Bb", "%", "%%41"]
    assert values(text.unquote(X), samples) == [unquote(s) for s in samples]
    assert values(text.unquote_form(X), samples) == [unquote_plus(s) for s in samples]
    plain = ["a b", "é~*-_.", "x/y?z=1&q", ""]
    assert values(text.quote_form(X), plain) == [quote_plus(s) for s in plain]
