"""Links of pages against the standard library's parser and resolver."""

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.operators import links as L
from tests.conftest import DATA

BASES = ["http://a.org/b/c/d?q=1#f", "https://a.org", "http://a.org/x/"]
HREFS = ["g", "./g", "g/", "/g", "//h.net/g", "?y", "g?y=1", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/./h", "g/../h", "http://k.de/l", "https://k.de", "  g "]


def test_addresses_are_resolved_as_by_the_standard_library(spark):
    rows = [(h, b) for h in HREFS for b in BASES]
    got = spark.createDataFrame(rows, "h string, b string").select("h", "b", L.resolved(F.col("h"), F.col("b")).alias("u")).collect()
    for r in got:
        want = urldefrag(urljoin(urldefrag(r.b)[0], r.h.strip()))[0]
        scheme, rest = want.split("://")
        host, slash, path = rest.partition("/")
        host, mark, query = (host, "", "") if slash else host.partition("?")
        assert r.u == f"{scheme}://{host}/{path}{mark}{query}", (r.h, r.b)
    odd = [("mailto:x@y", BASES[0]), ("javascript:f()", BASES[0]), ("g", "no address"), (None, BASES[0]), ("g", None)]
    assert all(r.u is None for r in spark.createDataFrame(odd, "h string, b string").select(L.resolved(F.col("h"), F.col("b")).alias("u")).collect())
    same = ["HTTP://A.org:80/x", "https://a.ORG:443", "http://a.org:443/", "ftp://a.org/", None]
    assert [r.u for r in spark.createDataFrame(list(enumerate(same)), "i int, u string").orderBy("i").select(L.normal_url(F.col("u")).alias("u")).collect()] == ["http://a.org/x", "https://a.org/", "http://a.org:443/", None, None]


def test_links_of_all_pages_and_a_crawl(spark):
    class Anchors(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a" and dict(attrs).get("href") is not None:
                self.found.append(dict(attrs)["href"])

    pages = pd.read_parquet(f"{DATA}/sf0.01/pages.parquet")
    want = {}
    for url, html in zip(pages["url"], pages["html"], strict=True):
        parser = Anchors()
        parser.found = []
        parser.feed(html)
        base = urldefrag(url)[0]
        for h in parser.found:
            key = (base, urldefrag(urljoin(base, h))[0])
            want[key] = want.get(key, 0) + 1
    assert {(r.src, r.dst): r.n for r in L.page_links(spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")).collect()} == want

    made = [
        ("http://a.org/", "<A class=x HREF='b?x=1&amp;y=2'>1</A><a href=c>2</a><!-- <a href='/lost'> --><script>'<a href=\"/lost\">'</script><a name=z>"),
        ("http://A.org:80/b?x=1&y=2#top", '<a\nhref = "//a.org/d">3</a><a href="/">up</a>'),
        ("http://a.org/d", '<a href="mailto:x@y.z">4</a><a href="e">5</a>'),
        ("http://a.org/none", None),
    ]
    df = spark.createDataFrame(made, "url string, html string")
    start = df.where("url = 'http://a.org/'").unionByName(df.where("url = 'http://a.org/none'"))
    got = {r.url: r.depth for r in L.crawl_pages(df, start, 2).collect()}
    assert got == {"http://a.org/": 0, "http://a.org/none": 0, "http://a.org/b?x=1&y=2": 1, "http://a.org/c": 1, "http://a.org/d": 2}
