"""Plans that read structure from texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import plan
from tidemark.sources import html


@plan(r"""SELECT page_id, i AS place, u AS link, regexp_extract(u, '^https?://([^/?#]+)', 1) AS host FROM (SELECT page_id, unnest(l) AS u, CAST(generate_subscripts(l, 1) AS INTEGER) AS i
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages))""")
def html_links(t):
    return html.links(t.pages, "page_id")


@plan(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs,
length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title_chars FROM pages""")
def html_page_fields(t):
    return html.page_fields(t.pages)


@plan(r"""SELECT page_id, url FROM pages WHERE regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), 'example\.(com|org)$') AND regexp_matches(url, '^https?://[^/?#]+/(en|fr)/')""")
def url_allow_list(t):
    return html.allowed(t.pages, "url", ("example.com", "example.org"), ("/en/", "/fr/")).select("page_id", "url")


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS n FROM documents),
h AS (SELECT *, CASE WHEN length(line) < 60 THEN line END AS head FROM l)
SELECT doc_id, n, length(line) AS size, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section, length(lead(line, 1) OVER (PARTITION BY doc_id ORDER BY n)) AS next_size FROM h""")
def line_state_parse(t):
    """Lines with what carries forward from earlier ones: the last short line as the section's head."""
    from tidemark.sources.reports import numbered_lines
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("n")
    lines = numbered_lines(t.documents.where("text IS NOT NULL"), "doc_id", "text")
    head = F.when(F.char_length("line") < 60, F.col("line"))
    section = F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("doc_id", "n", F.char_length("line").cast("long").alias("size"), section.alias("section"), F.char_length(F.lead("line").over(w)).cast("long").alias("next_size"))


@plan(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS numbers, nullif(list_last(regexp_extract_all(text, '[0-9]+')), '') AS last_number, regexp_matches(text, '(?i)licen[sc]e') AS has_license FROM documents""")
def pattern_extraction(t):
    found = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return t.documents.select("doc_id", F.size(found).alias("numbers"), F.try_element_at(found, F.lit(-1)).alias("last_number"), F.col("text").rlike("(?i)licen[sc]e").alias("has_license"))


@plan("""SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT sha256(text)) AS texts, min(md5(text)) AS least_md5 FROM documents GROUP BY 1""")
def content_hashes(t):
    return t.documents.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.min(F.md5("text")).alias("least_md5")
    )
