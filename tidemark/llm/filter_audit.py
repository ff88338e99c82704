"""What each filter of a cleaning recipe removes, in every order of the filters, from one CUBE over failure flags.

Each document gets one boolean a filter. Counts by part and flags are small (at most 2^k rows a part), and a CUBE over the
flags and the part turns them into survivors: the row of a grouping set in which every grouped flag is false counts the
documents that pass this subset of filters, whatever the others say. A step of an order then is the difference of two
subsets, that before it and that after it; 2^k subsets serve all k! orders.

The last filter fails copies: a document whose text stands under a smaller id anywhere in the table. The smallest id of
each text is an aggregate over digests, and the documents that hold it are found by text and id together, so that no task
gathers a group of copies.

Null texts are empty ones and have no words; empty and null texts are copies of one another. A document of null id has no
smaller id, is no smaller id and has no label; rows of equal id and text are no copies of one another. Several labels of
one document count as one that holds if any of them does; a null label is none. A null part is the empty string. An empty
table gives no parts, hence no rows. Very long texts are judged whole; other columns aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import stored

FILTERS = "ABCDE"
_MEASURES = ("n", "good", "toxic")


def text_flags(text: str = "text", least_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2) -> dict[str, Column]:
    """The failure conditions that look at one text alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    upper = F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]+", ""))
    return {
        "A": n < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct_percent * n,
        "C": 100 * upper > upper_percent * F.char_length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, flags: dict[str, Column], part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, part, digest of the text and one boolean a filter; one narrow row a document, stored."""
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        *(x.alias(name) for name, x in flags.items()),
    )
    return stored(rows, "audit-flags")


def flag_counts(rows: DataFrame, labels: DataFrame, names: str = "ABCD", copies: str = "E") -> DataFrame:
    """Documents, good and toxic ones by part and flags, ``copies`` being the flag of a text under a smaller id.

    ``names`` are the flags of ``rows``. Counted without copies first; those that hold the smallest id of their text, and
    those without an id, then move from true to false.
    """
    with_id = rows.where(F.col("id").isNotNull())
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    first = with_id.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    judged = with_id.join(marks, "id", "left").join(first, ["id", "digest"], "left").select(
        "part", *names, F.col("first").isNull().alias(copies), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    alone = rows.where(F.col("id").isNull()).select("part", *names, F.lit(False).alias(copies), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return (
        judged.union(alone)
        .groupBy("part", *names, copies)
        .agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    )


def survivors(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """n, good and toxic by part and ``subset`` (bit i stands for the i-th filter): the documents that pass all of the subset.

    A grouped flag is true or false in a cube's row, one that isn't grouped is null; flags of the input are never null.
    """
    cubed = counts.cube("part", *names).agg(
        *(F.sum(m).alias(m) for m in _MEASURES), *(F.grouping(c).alias(f"all_{c}") for c in ("part", *names))
    )
    passing = F.col("all_part") == 0
    for c in names:
        passing &= (F.col(f"all_{c}") == 1) | ~F.col(c)
    subset = sum(((1 - F.col(f"all_{c}")) * (1 << i) for i, c in enumerate(names)), F.lit(0))
    return cubed.where(passing).select("part", subset.cast("int").alias("subset"), *_MEASURES)


def _literal(rows: list[tuple], names: list[str]) -> Column:
    """A fixed table as one array of structs, exploded where it is needed: no join and no broadcast."""
    return F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows)))


def orders(names: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """Order, step, its filter's bit and the subset of the filters before it, for every permutation and step."""
    bit = {c: 1 << i for i, c in enumerate(names)}
    return [
        ("".join(order), k + 1, bit[c], sum(bit[x] for x in order[:k])) for order in permutations(names) for k, c in enumerate(order)
    ]


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row a part, order and step, zeros included; ``counts`` has n, good and toxic by part and flags."""
    found = stored(survivors(counts, names), "audit-survivors")
    full, k = (1 << len(names)) - 1, len(names)
    pairs = [(s, 1 << i, factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in range(full + 1) for i in range(k) if not s >> i & 1]
    parts = found.where("subset = 0").select("part")  # no filter yet: every part has this row
    grid = parts.select("part", _literal(pairs, ["before", "bit", "n_orders"])).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    steps = (
        grid.join(found.select("part", F.col("subset").alias("before"), *(F.col(m).alias(f"{m}_in") for m in _MEASURES)), ["part", "before"], "left")
        .join(found.select("part", F.col("subset").alias("after"), *(F.col(m).alias(f"{m}_out") for m in _MEASURES)), ["part", "after"], "left")
        .select("part", "before", "bit", "n_orders", zero("n_out").alias("kept"), *((zero(f"{m}_in") - zero(f"{m}_out")).alias(f"{m}_lost") for m in _MEASURES))
    )
    steps = stored(steps, "audit-steps")
    whole = steps.groupBy("part", "bit").agg(
        F.sum(F.col("n_orders") * F.col("n_lost")).alias("shapley"),
        F.max(F.when(F.col("before") == 0, F.col("n_lost"))).alias("fails"),
        F.max(F.when(F.col("before") + F.col("bit") == full, F.col("n_lost"))).alias("unique_fails"),
    )
    joined = steps.join(whole, ["part", "bit"])
    # Each pair of subsets serves all orders that meet it: at most (k-1)! of them.
    of_pair: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order, step, bit, before in orders(names):
        of_pair.setdefault((before, bit), []).append((order, step))
    dealt = F.create_map(
        *(
            x
            for (before, bit), own in of_pair.items()
            for x in (F.lit(before << k | bit), F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o, s in own)))
        )
    )
    key = F.shiftleft("before", k).bitwiseOR(F.col("bit"))
    return joined.select("*", F.inline(F.element_at(dealt, key))).select(
        "part", "filter_order", "step", "kept", F.col("n_lost").alias("removed"), (F.col("fails") - F.col("n_lost")).alias("redundant"), "unique_fails",
        F.col("good_lost"), F.col("toxic_lost"), "shapley",
    )
