"""Links of web pages: read, resolved and followed; columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import crawl

_URL = r"(?is)^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?.*$"
_PORTS = (("http", ":80$"), ("https", ":443$"))  # fixed values: ports that a scheme implies


def _no_dots(path: Column) -> Column:
    """``path`` without its ``.`` and ``..`` steps; it begins with a slash, and ends with one if its last step was such a step."""
    steps = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    none = F.array().cast("array<string>")

    def add(done, step):
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(none)
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    end = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    kept = F.concat(F.lit("/"), F.array_join(F.aggregate(steps, none, add), "/"))
    return F.when(F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|$)")), F.concat(kept, F.when(kept == "/", "").otherwise(end))).otherwise(F.when(path == "", "/").otherwise(path))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no port that the scheme implies, no dot steps, no fragment; null for what is no http or https address."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    for name, port in _PORTS:
        host = F.when(scheme == name, F.regexp_replace(host, port, "")).otherwise(host)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, _no_dots(part(3)), part(4)))


def resolved(href: Column, base: Column) -> Column:
    """The normal address that ``href`` means on the page ``base``; null for other schemes and where either is null or no address."""
    ref = F.regexp_replace(F.regexp_replace(href, r"^\s+|\s+$", ""), "(?s)#.*$", "")
    part = lambda k: F.regexp_extract(base, _URL, k)
    root = F.concat(part(1), F.lit("://"), part(2))
    folder = F.regexp_replace(F.when(part(3) == "", "/").otherwise(part(3)), r"[^/]*$", "")
    whole = (
        F.when(F.regexp_like(ref, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(part(1), F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(root, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(root, part(3), ref))
        .when(ref == "", F.concat(root, part(3), part(4)))
        .otherwise(F.concat(root, folder, ref))
    )
    return normal_url(whole)


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): addresses that the anchors of pages (url, html) lead to, with their number. Comments, scripts and styles are
    left out; ``&amp;`` and its numbers are read in addresses, other entities stay. An anchor whose attributes before ``href`` hold a ``>`` is not seen."""
    shown = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    found = F.regexp_extract_all(shown, F.lit(r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    each = pages.select("url", F.explode(found).alias("raw"))
    href = F.regexp_replace(F.regexp_replace("raw", r"""^["']|["']$""", ""), r"&amp;|&#38;|&#x26;", "&")
    links = each.select(normal_url(F.col("url")).alias("src"), resolved(href, F.col("url")).alias("dst")).dropna()
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def crawl_pages(pages: DataFrame, start: DataFrame, most_depth: int = 1) -> DataFrame:
    """(url, depth) of what the links of pages (url, html) reach from the start (url), each address once at its least depth; an address without a page is reached but leads nowhere."""
    roots = start.select(normal_url(F.col("url")).alias("id")).dropna().distinct()
    return crawl(page_links(pages).where("src <> dst"), roots, most_depth).withColumnRenamed("id", "url")
