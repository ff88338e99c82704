"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Three kinds of base spans are found, leftmost and without overlap within a kind: assignments to a secret-like name,
access keys, long hexadecimal runs. Each span's value (of an assignment the part assigned) is hashed, and the hashes
are counted over the whole corpus: by how many distinct owners and in how many distinct repositories a value occurs. A
value that several owners share is a widely copied example, and so is one that a single owner has in more than a few
repositories: a template's. What is left, if it looks random (at least 16 characters with a letter and a digit), is a
live-looking credential, and its place becomes one more span, of kind ``live``.

Positions are code points, ends exclusive. Regular expressions tell matches but not their places; the places follow
from the lengths of the pieces between matches, since ``split`` and ``regexp_extract_all`` walk the same matches.

Counting is combined on the map side, so a value in a third of all rows sends one row a task, and only live hashes
are joined back to the spans; hash pairs of 128 bits stand for values, so no secret is written or shuffled. Null and
empty texts have no spans; very long ones are searched whole. Null owners count as one owner, null repositories as one of their
owner. Repeated rows are in one repository and get equal results; spans that tie in start stand in the order of kinds.
Empty tables give empty ones. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import stored

KINDS = ("assign", "access", "hex", "live")
#: Owners and repositories of a value up to which it counts as theirs; above either, as a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 1, 5
# The patterns of the base kinds. Runs that are too short fail as a whole for access and hex, so the
# least length can stand in the pattern; an assignment that fails still uses up its text.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
_LEAST = 6
_SPAN = "struct<start:int,kind:int,end:int,a:bigint,b:bigint,random:boolean>"


def _spans(text: Column, kind: int, pattern: str, group: int, maybe: Column) -> Column:
    """Spans of one kind; texts that fail the cheap test ``maybe`` are not searched."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    p = F.lit(pattern)
    whole, value, pieces = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group)), F.split(text, pattern, -1)
    parts = F.arrays_zip(whole.alias("w"), value.alias("v"), F.slice(pieces, 1, F.size(whole)).alias("p"))

    def add(done, x):
        start = done["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["w"])
        v = x["v"]
        random = (F.char_length(v) >= 16) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
        span = F.struct(
            start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"),
            F.xxhash64(v).alias("a"), F.xxhash64(F.lit(7), v).alias("b"), random.alias("random"),
        )
        keep = F.char_length(v) >= _LEAST
        return F.struct(end.cast("int").alias("at"), F.when(keep, F.concat(done["out"], F.array(span))).otherwise(done["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(maybe, F.aggregate(parts, zero, add, lambda done: done["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans as array<struct<start, kind, end, a, b, random>>, by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    signs = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    found = F.concat(
        _spans(text, 0, ASSIGN, 2, signs & text.rlike(ASSIGN)),
        _spans(text, 1, ACCESS, 0, F.contains(text, F.lit("AKIA"))),
        _spans(text, 2, HEX, 0, text.rlike(HEX)),
    )
    return F.array_sort(found)


def ownership(spans: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Hashes (a, b) with n_owners, n_repositories and copied, from rows (owner, repository, a, b), which may come twice."""
    once = spans.select("a", "b", "owner", "repository").distinct()
    by_owner = once.groupBy("a", "b", "owner").agg(F.count("*").alias("n"))
    counts = by_owner.groupBy("a", "b").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    return counts.withColumn("copied", (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories))


def scan(
    docs: DataFrame, text: str = "text", owner: str = "source", row_id: str = "doc_id", max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES, repository: str | None = None,
) -> DataFrame:
    """Returns row_id, spans (base spans) and live (spans of live-looking values), one row for each row of docs. Each id is a
    repository unless a column is named."""
    found = docs.select(F.col(row_id).alias("row_id"), F.col(owner).alias("owner"), F.col(repository or row_id).alias("repository"), base_spans(F.col(text)).alias("spans"))
    # Stored without texts, so that they are searched once.
    found = stored(found, "secret-spans")
    some = found.where(F.size("spans") > 0)
    # Rows with the same id and spans get the same result, so these two hashes serve as their key.
    text_of = F.concat_ws("/", F.coalesce(F.col("row_id").cast("string"), F.lit("")), F.to_json("spans"), F.col("row_id").isNull().cast("string"))
    keyed = some.withColumn("ra", F.xxhash64(text_of)).withColumn("rb", F.xxhash64(F.lit(7), text_of))
    values = some.select("owner", "repository", F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))).alias("v"))
    own = ownership(values.select("owner", "repository", "v.a", "v.b"), max_owners, max_repositories).where(~F.col("copied")).select("a", "b")
    places = keyed.select("ra", "rb", F.explode(F.filter("spans", lambda s: s["random"])).alias("s"))
    live = places.select("ra", "rb", "s", "s.a", "s.b").join(own, ["a", "b"]).groupBy("ra", "rb").agg(F.array_sort(F.collect_set("s")).alias("live"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    out = keyed.join(live, ["ra", "rb"], "left").select(F.col("row_id").alias(row_id), "spans", F.coalesce("live", none).alias("live"))
    rest = found.where(F.size("spans") == 0).select(F.col("row_id").alias(row_id), "spans", none.alias("live"))
    return out.unionByName(rest)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Base spans stay; live ones are added with their own kind."""
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    added = F.transform("live", lambda s: s.withField("kind", F.lit(KINDS.index("live"))))
    return found.select(
        "doc_id",
        kind(0).alias("n_assign"),
        kind(1).alias("n_access"),
        kind(2).alias("n_hex"),
        F.sha2(_joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("spans", added))).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )
