"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) are sorted by size, and each enters the bin with the least capacity left that still
holds it, found in a balanced tree of remaining capacities; where none does, a new bin is opened.

At scale the packing must not see every group. Groups above one ``GRAIN``-th of all bytes, of which there can be at
most GRAIN, are items of their own; all smaller groups are dealt by a hash of their text to GRAIN bundles, and each
bundle is one item. So at most 2 * GRAIN items reach the driver, whatever the table's size, and shards differ by
about one item. Equal texts hash alike, so a group never splits.

With a given capacity, bundles must stay far below it: there are at least ``BUNDLES`` of them for each capacity that the
bytes fill, and more if one still exceeds the capacity. Above ``AT_ONCE`` items the packing is dealt by hash to parallel
tasks of about that many items each, and each task opens bins of its own, so every task may leave one bin part-filled.

Size is the UTF-8 bytes of the text (null: none) plus 1. Null texts form one group, apart from empty ones. Repeated
rows take slots of their own. An empty table gives an empty one. A group larger than the capacity gets a bin alone.
"""

from __future__ import annotations

import random
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.shared import stored

GRAIN = 4096
#: Bundles for each capacity that the bytes fill, where the capacity is given.
BUNDLES = 64
#: Items that are packed by the driver, or by one task.
AT_ONCE = 100_000
#: Rows of a cell, within which slots are numbered by one task.
CELL_ROWS = 50_000


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, and take the least that is at least a size, in log time."""

    def __init__(self):
        self.root = None
        self.random = random.Random(17)

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        at, priority, left, right = node
        if at < key:
            a, b = self._split(right, key)
            return (at, priority, left, a), b
        a, b = self._split(left, key)
        return a, (at, priority, b, right)

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return (a[0], a[1], a[2], self._join(a[3], b))
        return (b[0], b[1], self._join(a, b[2]), b[3])

    def insert(self, remaining: int, which: int) -> None:
        a, b = self._split(self.root, (remaining, which))
        self.root = self._join(self._join(a, ((remaining, which), self.random.random(), None, None)), b)

    def take(self, size: int) -> tuple[int, int] | None:
        a, b = self._split(self.root, (size, -1))
        if b is None:
            return None
        least = b
        while least[2] is not None:
            least = least[2]
        _, rest = self._split(b, (least[0][0], least[0][1] + 1))
        self.root = self._join(a, rest)
        return least[0]


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int = 0) -> list[int]:
    """The bin of each item; ``bins`` are open from the start. Ties go by the items' order."""
    tree, opened, out = CapacityTree(), bins, [0] * len(sizes)
    for b in range(bins):
        tree.insert(capacity, b)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found, opened = (max(capacity, sizes[i]), opened), opened + 1
        out[i] = found[1]
        tree.insert(found[0] - sizes[i], found[1])
    return out


def pack_into(sizes: list[int], bins: int) -> list[int]:
    """Best fit decreasing into ``bins`` bins, under the least capacity on a ladder above the mean that suffices.

    An item above the mean of what is left gets a bin of its own first, so that it does not lift the others' capacity.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    alone, left = 0, sum(sizes)
    while alone < len(order) and bins - alone > 1 and sizes[order[alone]] * (bins - alone) >= left:
        left -= sizes[order[alone]]
        alone += 1
    out = [0] * len(sizes)
    for k, i in enumerate(order[:alone]):
        out[i] = k
    rest, room = order[alone:], bins - alone
    capacity = max(-(-left // room), max((sizes[i] for i in rest), default=1))
    slack = 0
    while True:
        packed = best_fit_decreasing([sizes[i] for i in rest], capacity + slack)
        if max(packed, default=0) < room:
            for i, k in zip(rest, packed, strict=True):
                out[i] = alone + k
            return out
        slack = max(slack * 2, capacity // 8192, 1)


def sized(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """row_id, size, text_crc32 and the two hashes (a, b) that name a row's group."""
    t = F.col(text)
    return docs.select(
        F.col(row_id).alias("row_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(t, t.isNull()).alias("a"),
        F.xxhash64(F.lit(7), t, t.isNull()).alias("b"),
    )


def assign(rows: DataFrame, shards: int | None = None, capacity: int | None = None, grain: int = GRAIN) -> DataFrame:
    """Adds ``shard`` to rows of ``sized``: in a given number of shards, or in as few shards of a given capacity."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    groups = rows.groupBy("a", "b").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    if capacity:
        groups = stored(groups, "groups")
        grain = max(grain, BUNDLES * -(-total // capacity))
    while True:
        bundle = F.pmod(F.col("a"), F.lit(grain))
        large = F.col("bytes") * grain > total
        # One plan gives both kinds of items: at most grain large groups and grain bundles.
        items = (
            groups.select(F.when(large, F.col("a")).alias("a"), F.when(large, F.col("b")).alias("b"), F.when(~large, bundle).alias("bundle"), "bytes")
            .groupBy("a", "b", "bundle").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        )
        if not capacity:
            break
        items = stored(items, "items")
        count, most = items.agg(F.count("*"), F.max(F.when(F.col("n") > 1, F.col("bytes")))).first()
        if most is None or most <= capacity:
            break
        grain *= 2
    if capacity and count > AT_ONCE:
        return _assigned(rows, bundle, _packed_in_parts(items, capacity, -(-count // AT_ONCE)))
    items = items.collect()
    items.sort(key=lambda r: (-r["bytes"], r["bundle"] is None, r["bundle"] or 0, r["a"] or 0, r["b"] or 0))
    sizes = [r["bytes"] for r in items]
    bins = pack_into(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
    dealt = [(r["a"], r["b"], r["bundle"], k) for r, k in zip(items, bins, strict=True)]
    return _assigned(rows, bundle, rows.sparkSession.createDataFrame(dealt, "a long, b long, bundle long, shard int"), F.broadcast)


def _packed_in_parts(items: DataFrame, capacity: int, parts: int) -> DataFrame:
    """(a, b, bundle, shard) of items packed by parallel tasks, whose bins are then numbered through."""

    def run(key, own):
        own = own.sort_values(["bytes", "bundle", "a", "b"], ascending=[False, True, True, True])
        return own.assign(own=best_fit_decreasing(own["bytes"].tolist(), capacity))[["a", "b", "bundle", "part", "own"]]

    # Nullable numbers would lose bits as doubles, so nulls travel as zeros beside a flag.
    flat = items.select(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("a", "b")), F.coalesce("bundle", F.lit(-1)).cast("long").alias("bundle"), "bytes")
    flat = flat.withColumn("part", F.pmod(F.xxhash64("a", "b", "bundle"), F.lit(parts)).cast("int"))
    packed = stored(flat.groupBy("part").applyInPandas(run, "a long, b long, bundle long, part int, own int"), "packed")
    # One row a part.
    ends, starts = 0, []
    for r in packed.groupBy("part").agg(F.max("own").alias("last")).orderBy("part").collect():
        starts.append((r["part"], ends))
        ends += r["last"] + 1
    starts = packed.sparkSession.createDataFrame(starts, "part int, before int")
    alone = F.col("bundle") < 0
    return packed.join(F.broadcast(starts), "part").select(
        F.when(alone, F.col("a")).alias("a"), F.when(alone, F.col("b")).alias("b"), F.when(~alone, F.col("bundle")).alias("bundle"), (F.col("before") + F.col("own")).alias("shard")
    )


def _assigned(rows: DataFrame, bundle: Column, dealt: DataFrame, small=lambda df: df) -> DataFrame:
    """rows with the shard of their group, or else of their bundle."""
    alone = small(dealt.where("bundle IS NULL").select("a", "b", F.col("shard").alias("own")))
    table = small(dealt.where("bundle IS NOT NULL").select("bundle", F.col("shard").alias("dealt")))
    out = rows.join(alone, ["a", "b"], "left").withColumn("bundle", bundle).join(table, "bundle", "left")
    return out.withColumn("shard", F.coalesce("own", "dealt")).drop("own", "dealt", "bundle")


def slotted(rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``slot``: numbers without gaps from 0 in each shard.

    Rows are dealt to cells of about cell_rows rows by a hash, whatever their shard or group; a cell's numbers follow
    those of the cells before it.
    """
    cells = max(16, rows.count() // cell_rows)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row_id", "a"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "cell").orderBy("row_id", "a")
    out = rows.withColumn("at", F.row_number().over(own) - 1).join(counts, ["shard", "cell"])
    return out.withColumn("slot", (F.col("before") + F.col("at")).cast("long")).drop("before", "at", "cell")


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """row_id, size, text_crc32, shard and slot of every row."""
    # The sizes are stored without texts: three steps read them.
    rows = stored(sized(docs, text, row_id), "sizes")
    dealt = stored(assign(rows, shards, capacity), "sharded")
    return slotted(dealt).select(F.col("row_id").alias(row_id), "size", "text_crc32", "shard", "slot")


def packing_bound(sizes: list[int], capacity: int) -> int:
    """No packing can use fewer bins: the larger of the volume bound and the number of items over half a bin."""
    ordered = sorted(sizes)
    return max(-(-sum(sizes) // capacity), len(ordered) - bisect_left(ordered, capacity // 2 + 1))
