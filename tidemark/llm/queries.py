"""The queries of this package over the whole tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, filter_audit, language_id, line_dedup, near_dup, prefix_trie, quality, secret_scan, sharding
from tidemark.llm import substring_dedup, token_counts, token_files
from tidemark.llm.shared import importable, new_path, stored

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _table(spark, sf_dir, name):
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    """The language of every text, learned from the documents that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    out = language_id.held_out()
    learn = docs.where(F.col("doc_id").isNotNull() & ~out).select("doc_id", "text", "lang")
    model = language_id.fit(learn)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontaminate(spark, sf_dir):
    """What every text shares with the benchmark's items, in windows of ten words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")))


_OP2 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[s : s + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS s FROM i WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(ws[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w CROSS JOIN (SELECT DISTINCT n FROM iw))),
m AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op3_line_dedup(spark, sf_dir):
    """Every text without the lines that ten documents or more have."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digests(line_dedup.drop_frequent_lines(docs))


_OP3 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_ASCII}) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""


def op4_substring_dedup(spark, sf_dir):
    """Every text without passages of twenty words that stand earlier."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digests(substring_dedup.dedup_substrings(docs))


_OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM x) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.i WHERE c.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op5_quality_rules(spark, sf_dir):
    """Base measures of every text and the field's verdict on its lines, learned from labelled rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, field).drop("text")


def op7_byte_bpe(spark, sf_dir):
    """Every text encoded and decoded again, as digests."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN))


def op6_sharding(spark, sf_dir):
    """All documents in sixteen shards of nearly equal bytes."""
    found = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_secret_scan(spark, sf_dir):
    """Secrets of every text; values of one owner in few documents are told apart."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secret_scan.digests(secret_scan.scan(docs))


def op9_token_files(spark, sf_dir):
    """All texts written as token files and read back."""
    path = new_path(spark, "token-files")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.digests(token_files.read(spark, path))


def op10_ngram_jaccard_join(spark, sf_dir):
    """The class of every document and its links at a similarity of 0.8 or more."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_prefix_trie(spark, sf_dir):
    """The prefix trie of all conversations, each rebuilt on the first turns of a common one."""
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = stored(prefix_trie.fingerprints(prefix_trie.turns(conversations)), "trie-fingerprints")
    return prefix_trie.nodes(prefix_trie.spliced(found))


_OP11 = r"""
WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM x),
b AS (SELECT c, list_reduce(list_prepend(4294967295::BIGINT, [ord(y)::BIGINT for y in string_split(c::VARCHAR, '')]), lambda a, y:
        list_reduce([xor(a, y), 1, 2, 3, 4, 5, 6, 7, 8], lambda z, k: xor(z // 2, (z % 2) * 3988292384))) AS r FROM (SELECT DISTINCT conv_id AS c FROM x)),
h AS (SELECT c, xor(r, 4294967295) % 4 AS h FROM b),
l AS (SELECT c, coalesce(max(i), 0) AS k FROM h LEFT JOIN o ON conv_id = c - c % 20 AND i <= h GROUP BY 1),
t AS (
  SELECT c, i AS d, role, text FROM h JOIN o ON conv_id = c - c % 20 AND i <= h
  UNION ALL SELECT c, i - h + k, role, text FROM h JOIN l USING (c) JOIN o ON conv_id = c AND i > h),
q AS (SELECT c, d, [struct_pack(role, text)] AS one, text, list(struct_pack(role, text)) OVER (PARTITION BY c ORDER BY d) AS seq FROM t),
p AS (SELECT c, d, seq, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM q
      UNION ALL SELECT c, 0, [struct_pack(role := 'x', text := 'x')][1 : 0], 0 FROM h),
n AS (SELECT d, seq, min(c) AS v, count(*) AS n_convs, any_value(w) AS w FROM p GROUP BY 1, 2),
m AS (SELECT p.c, p.d, n.v FROM p JOIN n USING (d, seq)),
u AS (SELECT n.v, n.d, n.n_convs, n.w, up.v AS parent FROM n LEFT JOIN m up ON up.c = n.v AND up.d = n.d - 1),
k AS (SELECT v, d, count(*) AS n_children FROM (SELECT parent AS v, d - 1 AS d FROM u WHERE d > 0) GROUP BY 1, 2),
f AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (v, d)),
s AS (SELECT m.v, m.d, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.w) AS saved
      FROM f JOIN m ON m.c = f.v AND m.d <= f.d GROUP BY 1, 2),
e AS (SELECT v, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d FROM m GROUP BY 1) JOIN m USING (c, d) GROUP BY 1, 2)
SELECT CAST(f.v AS BIGINT) AS conv_id, CAST(f.d AS BIGINT) AS depth, CAST(f.parent AS BIGINT) AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs,
       CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN s USING (v, d) LEFT JOIN e USING (v, d)
"""


def op12_filter_audit(spark, sf_dir):
    """Five filters over all documents, in all orders, by source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = filter_audit.flagged(docs, filter_audit.text_flags())
    return filter_audit.audit(filter_audit.flag_counts(rows, _table(spark, sf_dir, "labels")))


_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
                100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
                coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false)] AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
c AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, x.i, y.i, z.i] AS seq FROM c a, c b, c x, c y, c z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5),
s AS (SELECT seq, array_to_string([substr('ABCDE', i, 1) for i in seq], '') AS filter_order, step, seq[step] AS own FROM o, (SELECT i AS step FROM c)),
m AS (
  SELECT part, filter_order, step, own, fails, n, good, toxic,
         list_bool_or([fails[i] for i in seq[1 : step - 1]]) AS gone, fails[own] AS hit, len([x for x in fails if x]) AS n_fails FROM s, g),
r AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND NOT hit), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND hit), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (coalesce(gone, false) AND hit), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (hit AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT coalesce(gone, false) AND hit), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (NOT coalesce(gone, false) AND hit), 0) AS BIGINT) AS toxic_lost
  FROM m GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def op13_token_counts(spark, sf_dir):
    """Bytes and tokens of every whole text, and whether it exceeds 2048 tokens."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.sizes(token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")), 2048)


def _sql_spans(kind: int, pattern: str, group: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, source, {kind} AS kind, vs[i] AS value,
         CAST(list_sum(list_transform(ps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
         length(ws[i]) AS n
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), {p}) AS ws, regexp_extract_all(coalesce(text, ''), {p}, {group}) AS vs,
                     string_split_regex(coalesce(text, ''), {p}) AS ps FROM documents))
  WHERE length(vs[i]) >= 6"""


_OP8 = f"""
WITH b AS ({_sql_spans(0, secret_scan.ASSIGN, 2)} UNION ALL {_sql_spans(1, secret_scan.ACCESS, 0)} UNION ALL {_sql_spans(2, secret_scan.HEX, 0)}),
own AS (SELECT value FROM b GROUP BY value HAVING count(DISTINCT coalesce('x' || source, '')) <= 1 AND count(DISTINCT coalesce('x' || doc_id, '')) <= 5),
l AS (SELECT doc_id, 3 AS kind, s, n FROM b WHERE value IN (SELECT value FROM own) AND length(value) >= 16
      AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
a AS (SELECT doc_id, kind, s, n FROM b UNION ALL SELECT * FROM l),
j AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
             string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) AS spans,
             count(*) FILTER (kind = 3) AS n_live
      FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents d LEFT JOIN j USING (doc_id)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontaminate, op3_line_dedup, op4_substring_dedup, op5_quality_rules, op6_sharding, op7_byte_bpe, op8_secret_scan,
        op9_token_files, op10_ngram_jaccard_join, op11_prefix_trie, op12_filter_audit, op13_token_counts,
    )
}
ORACLE = {"op2_decontaminate": _OP2, "op3_line_dedup": _OP3, "op4_substring_dedup": _OP4, "op8_secret_scan": _OP8, "op11_prefix_trie": _OP11, "op12_filter_audit": _OP12}
