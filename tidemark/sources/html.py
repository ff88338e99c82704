"""Structure from web pages by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_HOST = r"^https?://([^/?#]+)"


def host(url) -> Column:
    return F.regexp_extract(F.col(url) if isinstance(url, str) else url, _HOST, 1)


def links(pages: DataFrame, page_id: str, html: str = "html") -> DataFrame:
    """(page_id, place, link, host) of each href, numbered from 1."""
    found = pages.select(page_id, F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))).alias("place", "link"))
    return found.select(page_id, (F.col("place") + 1).alias("place"), "link", host("link").alias("host"))


def page_fields(pages: DataFrame) -> DataFrame:
    one = lambda p: F.regexp_extract("html", p, 1)
    return pages.select(
        "page_id", host("url").alias("host"), F.nullif(one('<html[^>]*lang="([^"]*)"'), F.lit("")).alias("lang"),
        F.regexp_count("html", F.lit("<p[ >]")).alias("paragraphs"), F.char_length(one("<title>([^<]*)</title>")).cast("long").alias("title_chars"),
    )


def allowed(df: DataFrame, url: str, hosts: tuple[str, ...], paths: tuple[str, ...]) -> DataFrame:
    """Rows whose host is, or ends in, an allowed one, and whose path starts as allowed."""
    ends = F.lit(False)
    for h in hosts:
        ends |= (host(url) == h) | host(url).endswith(h)
    starts = F.lit(False)
    path = F.regexp_extract(F.col(url), r"^https?://[^/?#]+(/[^?#]*)", 1)
    for p in paths:
        starts |= path.startswith(p)
    return df.where(ends & starts)


def index_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each table row of an index page: its cells as text, and its link with &amp; undone."""
    rows = pages.withColumn("row", F.explode(F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))))
    cells = F.transform(F.regexp_extract_all("row", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    link = F.replace(F.regexp_extract("row", "(?i)href=['\"]([^'\"]+)", 1), F.lit("&amp;"), F.lit("&"))
    return rows.select(*(c for c in pages.columns if c != html), cells.alias("cells"), F.nullif(link, F.lit("")).alias("link"))
