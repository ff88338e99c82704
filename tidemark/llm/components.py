"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """edges has columns u and v of one orderable type; returns (u, root) for every node of an edge, where root is the
    same within a component.

    In each round every node hooks to the first of itself and its neighbours in an order by hash that is new in every
    round, so that about half of the nodes of a path, and more elsewhere, go in a round whatever the ids are. Edges are
    rewritten to what their ends hooked to, until none is left; the rounds' small maps are then applied one after the
    other. Each round is written to the shared folder. Hubs are safe: a round aggregates (combined on the map side) and
    joins, and never gathers a neighbourhood.
    """
    maps = []
    while True:
        ranked = lambda x: F.struct(F.xxhash64(F.lit(len(maps)), x).alias("h"), F.col(x).alias("x"))  # noqa: B023, E731
        edges = stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            break
        both = edges.union(edges.select("v", "u"))
        hook = stored(both.groupBy("u").agg(F.min(ranked("v")).alias("v")).select("u", F.least("v", ranked("u"))["x"].alias("root")), "hooks")
        maps.append(hook)
        left = edges.join(hook, "u").select(F.col("root").alias("p"), "v")
        right = hook.withColumnRenamed("u", "v").withColumnRenamed("root", "q")
        edges = left.join(right, "v").select(F.col("p").alias("u"), F.col("q").alias("v"))
    if not maps:
        return edges.select("u", F.col("v").alias("root"))
    out = maps[0]
    for hook in maps[1:]:
        step = hook.select(F.col("u").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("u", F.coalesce("next", "root").alias("root"))
    return out
