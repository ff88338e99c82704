"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position.

DataFrame functions only. A text is split at \\n (null or empty: one empty line). A line's key is the line stripped
of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased. Keys of at least ``min_chars`` code points found in at
least ``min_docs`` rows lose all their lines; the other lines stay, joined by \\n. Each row counts as one document,
repeated rows too. Null texts stay null if nothing is dropped; very long texts are split whole. An empty table gives an
empty one. Columns that the operator adds replace equal names; other columns are kept, whatever their names.

Keys are told apart by two independent 64-bit hashes. They are counted with map-side combining, so a line in a third
of all rows sends one row a task. The frequent ones then reach the texts in one of two ways, which give the same
rows: at most ``inline`` of them become a constant hash set inside the scan (no shuffle of texts); beyond that, hashes
are joined, and the positions return to their row. That join broadcasts the frequent keys up to ``broadcast`` of them;
beyond that it is a shuffle in which each key is dealt over ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import stored

MIN_DOCS = 10
#: Frequent keys that go into the plan as constants, 16 bytes each.
INLINE = 20_000
#: Frequent keys that a join broadcasts, 16 bytes each.
BROADCAST = 1_000_000
SALTS = 16
_ADDED = ("n_lines", "n_dropped", "kept_text")
_STRIP = " \t\n\x0b\x0c\r"


def ascii_lower(x: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does that for ASCII strings, and faster than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, upper, upper.lower()))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_STRIP)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """A struct of two hashes for each line; null where the key is too short."""

    def one(line):
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")))

    return F.transform(lines_of(text), one)


def frequent_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, text: str = "text") -> DataFrame:
    """Hashes (a, b) of the keys found in at least min_docs rows."""
    keys = docs.select(F.explode(F.array_distinct(_hashes(F.col(text), min_chars))).alias("h")).where("h IS NOT NULL")
    return keys.groupBy("h.a", "h.b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b")


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, text: str = "text", inline: int = INLINE, broadcast: int = BROADCAST
) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text."""
    frequent = stored(frequent_keys(docs, min_docs, min_chars, text), "frequent-lines")
    few = frequent.limit(inline + 1).collect()
    # The rows' own columns stand apart in one struct, so that no name can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    found = _by_constants(rows, few) if len(few) <= inline else _by_join(rows, frequent, min_chars, broadcast)
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in _ADDED), *_ADDED)


def _rebuilt(rows: DataFrame, stay: Column) -> DataFrame:
    out = rows.withColumn("stay", stay).withColumn("n_lines", F.size(lines_of(F.col("text"))).cast("long"))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.size("stay"))
    return out.withColumn("kept_text", F.when(F.col("text").isNotNull() | (F.col("n_dropped") > 0), F.array_join("stay", "\n")))


def _by_constants(rows: DataFrame, frequent: list) -> DataFrame:
    if not frequent:
        return _rebuilt(rows, lines_of(F.col("text")))
    a, b = [r[0] for r in frequent], [r[1] for r in frequent]

    def stays(line):
        # A line goes if both of its hashes are frequent ones; the second is looked at only after the first.
        key = line_key(line)
        return ~(F.xxhash64(key).isin(a) & F.xxhash64(F.lit(7), key).isin(b))

    return _rebuilt(rows, F.filter(lines_of(F.col("text")), stays))


def _by_join(rows: DataFrame, frequent: DataFrame, min_chars: int, broadcast: int) -> DataFrame:
    """Rows meet their dropped positions by two hashes of the text: equal texts drop the same lines."""
    rows = rows.withColumns({"ra": F.xxhash64("text"), "rb": F.xxhash64(F.lit(7), "text")})
    lines = rows.select("ra", "rb", F.posexplode(_hashes(F.col("text"), min_chars)).alias("at", "h")).where("h IS NOT NULL")
    lines = lines.select("ra", "rb", "at", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    if frequent.count() <= broadcast:
        hits = lines.join(F.broadcast(frequent), ["a", "b"])
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = lines.withColumn("salt", F.pmod(F.xxhash64("ra", "at"), F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "salt"])
    # Stored, so that Spark can split a text that very many rows share in the next join.
    hits = stored(hits.groupBy("ra", "rb").agg(F.collect_set("at").alias("gone")), "line-hits")
    joined = rows.join(hits, ["ra", "rb"], "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return _rebuilt(joined, F.filter(lines_of(F.col("text")), lambda _, i: ~F.array_contains(gone, i)))


def digests(found: DataFrame) -> DataFrame:
    kept = F.coalesce("kept_text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
