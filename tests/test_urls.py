import ipaddress
import random
from urllib.parse import urldefrag, urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlspark.functions import addresses, urls
from crawlspark.functions.html import resolved_link

X = F.col("x")
SAMPLES = [
    "https://user:pw@WWW.Example.be:8080/a/b;p=1/c;q?x=1&y#frag", "http://h", "HTTP://H/a;b/c", "//host/p", "/only/path",
    "mailto:a@b.c", "https://[::1]:80/x", "https://h/?q=a?b#c#d", "relative/x", "", "http:///nohost", "  http://lead/x",
    "1x:y", "http://h:80?q", "https://h/a\nb",
]


@pytest.mark.parametrize("part", ["scheme", "netloc", "path", "params", "query", "fragment"])
def test_parts_match_the_standard_split(spark, part):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(SAMPLES)], "i int, url string")
    got = [r[part] for r in urls.with_url_parts(df).orderBy("i").collect()]
    assert got == [getattr(urlparse(u), part) for u in SAMPLES]


def test_host(values):
    assert values(urls.host_of(X), SAMPLES) == [(urlparse(u).hostname or "") for u in SAMPLES]


def test_site_key_drops_one_www(values):
    key = urls.site_key(urls.host_of(X), X)
    assert values(key, ["https://www.example.be/path", "https://example.be/", "https://www.www.x.be/", "/NoHost"]) == [
        "example.be", "example.be", "www.x.be", "/nohost"]


@pytest.mark.parametrize("url,seed,expected", [
    ("https://www.example.be/a", "example.be", True), ("https://example.be/a", "www.example.be", True),
    ("https://sub.example.be/", "www.example.be", True), ("https://example.be/", "sub.example.be", False),
    ("https://evil-example.be/", "example.be", False), ("/rel", "example.be", False), ("https://example.be:81/", "example.be", True),
])
def test_same_site(values, url, seed, expected):
    assert values(urls.same_site(urls.host_of(X), F.lit(seed)), [url]) == [expected]


def keys(spark, *given_urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given_urls)], "i int, url string")
    return [(r.page_key, r.lang, r.lang_rank) for r in urls.with_language_key(df).orderBy("i").collect()]


def test_language_path_variants_share_a_key(spark):
    (a, la, ra), (b, lb, rb), (c, lc, _) = keys(
        spark, "https://x.be/nl/over/", "https://x.be/FR/over", "https://x.be/over/")
    assert a == b == "https://x.be/over" and (la, ra, lb, rb) == ("nl", 0, "fr", 2)
    assert c == "https://x.be/over/" and lc is None


def test_http_www_and_case_stay_apart(spark):
    got = {k for k, _, _ in keys(
        spark, "http://x.be/a", "https://x.be/a", "https://www.x.be/a", "https://x.be/A", "https://x.be/a;v=1")}
    assert len(got) == 5
    assert keys(spark, "https://X.be/a#f")[0][0] == "https://x.be/a"


def test_listing_id_groups_translated_slugs(spark):
    a, b, c, d = keys(
        spark, "https://x.be/nl/huur/villa-formentor-1083.htm", "https://x.be/de/miete/haus-1083.html?lang=de",
        "https://x.be/huur/villa-formentor-1083.htm", "https://x.be/nl/villa-1083.htm")
    assert a[0] == b[0] == "listing:1083 https://x.be"
    # without a language segment, or with one segment left, the path decides
    assert c[0] == "https://x.be/huur/villa-formentor-1083.htm" and d[0] == "https://x.be/villa-1083.htm"


def test_resource_query_groups_shallow_pages(spark):
    a, b, c, d, e = keys(
        spark, "https://x.be/de/ferien?office_id=12&page=2", "https://x.be/en/holiday?page=2&office_id=12&lang=en",
        "https://x.be/en/holiday?page=3&office_id=12", "https://x.be/en/a/b/c?office_id=12", "https://x.be/en/a?page=123")
    assert a[0] == b[0] and "resource:" in a[0]
    assert c[0] != a[0]                       # pagination is part of the key
    assert "resource:" not in d[0]        # three segments are too deep
    assert "resource:" not in e[0]        # a pagination key is no identity


def test_uuid_and_number_values_are_identities(spark):
    got = keys(
        spark, "https://x.be/a?k=123", "https://x.be/b?k=123", "https://x.be/a?k=12",
        "https://x.be/c?z=0b5c6e2a-1111-2222-3333-444455556666", "https://x.be/d?z=0B5C6E2A-1111-2222-3333-444455556666")
    assert got[0][0] == got[1][0] and "resource:" not in got[2][0]
    assert "resource:" in got[3][0] and got[3][0] != got[4][0]


def test_language_from_query(spark):
    got = keys(
        spark, "https://x.be/a?lang=en-US", "https://x.be/a?locale=nl-be", "https://x.be/a?lang=&lng=fr",
        "https://x.be/a?lang=english&lng=fr")
    assert [(lang, rank) for _, lang, rank in got] == [("en", 1), ("nl-be", 50), ("fr", 2), (None, 50)]
    assert len({k for k, _, _ in got}) == 1


def test_typed_addresses(values):
    assert values(urls.seed_url(X), [
        " example.be ", "https://www.Example.be", "HTTP://h:80/x", "http://h:8080", "", "   ", "https://", "h/a?b=1#c",
    ]) == ["https://example.be/", "https://www.example.be/", "http://h/x", "http://h:8080/", None, None, None,
           "https://h/a?b=1#c"]


def test_typed_addresses_beyond_ascii(values):
    rng = random.Random(1)
    labels = ["bücher", "例え", "пример", "ü", "faß", "ab--cd", "😀emoji", "éééé", "Žluťoučký"]
    labels += ["".join(rng.choice("abcé日пü😀-xz9") for _ in range(rng.randrange(1, 20))) for _ in range(150)]
    want = [p if p.isascii() else "xn--" + p.lower().encode("punycode").decode() for p in labels]
    assert values(urls.seed_url(X), [f"www.{p}.be/x" for p in labels]) == [f"https://www.{p}.be/x" for p in want]
    assert values(urls.seed_url(X), [
        "München.de", "例え。テスト/a", "h.be/é è/%20/\"<>`{}|^", "h.be/a?q=ü 'x'&b=`#é `\"", "h.be/plain/path?q=1#f", "http://Bücher.example:80/日本",
    ]) == ["https://xn--mnchen-3ya.de/", "https://xn--r8jz45g.xn--zckzah/a", "https://h.be/%C3%A9%20%C3%A8/%20/%22%3C%3E%60%7B%7D|%5E",
           "https://h.be/a?q=%C3%BC%20%27x%27&b=`#%C3%A9%20%60%22", "https://h.be/plain/path?q=1#f",
           "http://xn--bcher-kva.example/%E6%97%A5%E6%9C%AC"]


BASES = ["https://h.be/a/b/c?q=1", "https://h.be", "http://h.be/a//b/", "https://h.be/x;p"]
HREFS = [
    "d", "./d", "../d", "../../../d", "/r", "/r/../s/./t", "//o.be/x", "?n=1", "d?e=f", "http://o.be/p", "https://o.be/../p",
    "mailto:x@y.z", "d/..", "..", ".", "a//b", "/a//b", "d#f", " lead", "ftp://x/y",
]


def test_links_resolve_like_the_standard(spark):
    pairs = [(i, b, h) for i, (b, h) in enumerate((b, h) for b in BASES for h in HREFS)]
    df = spark.createDataFrame(pairs, "i int, b string, h string")
    got = [r.v for r in df.select("i", resolved_link(F.col("b"), F.col("h")).alias("v")).orderBy("i").collect()]
    want = [urldefrag(urljoin(b, h))[0] for _, b, h in pairs]
    assert [(p, g) for p, g, w in zip(pairs, got, want) if g != w] == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", "x.html"]), min_size=1, max_size=6).map("/".join),
                min_size=30, max_size=30))
def test_dot_segments_property(spark, hrefs):
    base = "https://h.be/p/q/r"
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, h string")
    got = [r.v for r in df.select("i", resolved_link(F.lit(base), F.col("h")).alias("v")).orderBy("i").collect()]
    assert got == [urljoin(base, h) for h in hrefs]


ADDRESSES = [
    "93.184.216.34", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.0.1", "169.254.169.254", "127.0.0.1", "0.0.0.0", "224.0.0.1",
    "240.0.0.1", "100.64.0.1", "192.0.0.9", "192.0.0.8", "198.18.0.1", "::1", "fe80::1", "fc00::1", "2606:4700::1111", "2001:db8::1",
    "ff02::1", "::ffff:8.8.8.8", "64:ff9b::1", "2001:20::1", "2001:4860:4860:0:0:0:0:8888", "2002::1",
]


def closed_in_python(ip):
    a = ipaddress.ip_address(ip)
    mapped = a.version == 6 and a.ipv4_mapped and a.ipv4_mapped.is_private
    return bool(a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or mapped)


def test_closed_addresses(values):
    assert values(addresses.closed_address(X), ADDRESSES) == [closed_in_python(a) for a in ADDRESSES]
    bad = ["", "not an ip", "1.2.3", "1.2.3.256", ":::", "1:2:3:4:5:6:7:8:9", "01.2.3.4"]
    assert values(addresses.closed_address(X), bad) == [True] * len(bad)


def test_v6_digits(values):
    samples = ["::", "1::", "::8", "1:2:3:4:5:6:7:8", "fe80::1%eth0", "::ffff:1.2.3.4"]
    assert values(addresses.v6_hex(X), samples) == [
        f"{int(ipaddress.ip_address(s.split('%')[0])):032x}" for s in samples]
