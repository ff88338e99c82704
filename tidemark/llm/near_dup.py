"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text's shingles are its runs of five words (see ``plain_bytes``; a text of one to four words has one shingle of
all its words). Texts with equal shingle sets form a *node*; copies are never compared. Each node has a label of ``LABEL``
MinHash values in each of ``TREES`` trees. A tree's labels are sorted, which makes them a prefix trie: labels that share a
prefix stand in a row, a *run*. Two nodes of similarity s share a prefix of d values with probability s^d.

* The labels of all trees are range-partitioned and sorted. Each label's longest match is with a neighbour; labels whose
  longest match is below the least depth, ``depth_for(recall)``, meet nobody and go. At the least depth a pair at the
  threshold meets in some tree with probability ``recall``.
* From the least depth downward, two values at a time, a run is entered further only while it has more than ``BLOCK``
  members, a *crowd*. Runs that aren't crowded are compared whole: all shortening of prefixes inside them costs one small
  cell.
* Crowds are compared from the longest prefix upward. Each node has a *home*, the first of its crowds in the order of
  comparison: the deepest, of the first tree. Nodes of one home were compared there and aren't compared again in another
  crowd, so that a family of near copies, which crowds every tree, is compared about once. The prefix is shortened only for *open* nodes, whose expected recall is below the target. The expected
  recall of a node with n links, the least similar at s, is n / (n / p(s) + (1 - p(t)) / p(t)), where p(s) is the
  probability that a pair of similarity s met at this depth or deeper, and t is the threshold: it allows for one more link
  at the threshold itself. A pair of nodes that have both reached the target isn't compared at shorter prefixes. Nodes
  without links stay open, so they are compared down to the least depth.

Nodes that meet are verified exactly on their shingle sets (64-bit hashes). Runs with the same members in several trees
are verified once; a pair that meets in several runs counts in one of them: the least of the small runs, else the crowd
of its deepest match, in the first such tree. A crowd is cut into blocks, and each pair of blocks is one cell, so no task
holds a crowd. A cell emits no pairs: only each node's number of links, the least similarity of them and the edges of a
spanning forest, from which components follow.

Result: one row a document with class_id (the least doc_id of its connected component) and n_links (the number of
other documents at or above the threshold, each copy counted). Texts without words (null, empty) have no links and are
their own class. Very long texts are hashed whole, in parts of bounded size. Each row counts as a document; repeated rows
are copies, and rows that tie in all else are told apart by nothing, so any of them may stay. Null ids take part, and are
a class_id only if every document of the class has none. Only the id and text columns are read, so others can't clash.
Empty tables give empty ones.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import stored
from tidemark.llm.words import plain_bytes, slices, window_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
TREES, LABEL = 24, 8
#: Of pairs at the threshold itself; more similar pairs are missed far more rarely.
RECALL = 0.99999
#: Values by which prefixes are shortened.
STEP = 2
#: Nodes of a block; a cell compares two blocks. A run of more members is a crowd.
BLOCK = 512
_COLUMNS_AT_ONCE = 4096
#: Bits of a bitmap for each key that it holds, the bits of one of its rows, and the most bits of all.
_BITS_A_KEY, _ROW_BITS, _MOST_BITS = 16, 1 << 15, 1 << 29
#: What tells the row whose text stands for a node.
_ROW = ("rep", "ta", "tb")


def met(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(recall: float, threshold: float, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree with the wanted probability."""
    return next((d for d in range(label, 1, -1) if met(threshold, d, trees) >= recall), 1)


def depths(least: int) -> list[int]:
    """The lengths of prefix that are looked at, from the least on."""
    return sorted({least, *range(LABEL, least, -STEP)})


def expected_recall(n: Column, least: Column, depth: int, threshold: float) -> Column:
    """Of a node with n links found in prefixes of depth or more, the least similar at ``least``; 0 without links."""
    share = 1 - F.pow(1 - F.pow(least, F.lit(float(depth))), F.lit(float(TREES)))
    unseen = (1 - met(threshold, depth)) / met(threshold, depth)
    return F.coalesce(n / (n / share + F.lit(unseen)), F.lit(0.0))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = word_hashes(plain_bytes(text))
    return np.unique(window_hashes(words, min(k, len(words)))) if len(words) else words


class Labels:
    """MinHash labels: TREES x LABEL values of 32 bits."""

    def __init__(self, trees: int = TREES, label: int = LABEL, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, trees * label, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 2**32, trees * label, dtype=np.uint32)

    def of(self, shingles: np.ndarray) -> bytes:
        """Big-endian, so that bytes sort as labels do, tree by tree."""
        low = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(x), 2048):
            y = self.a[:, None] * x[None, start : start + 2048]
            y += self.b[:, None]
            np.minimum(low, y.min(1), out=low)
        return low.astype(">u4").tobytes()


def _text_keys(text: str) -> dict[str, Column]:
    """Two hashes that tell a row's text from others under its id."""
    return {"ta": F.xxhash64(text), "tb": F.xxhash64(F.lit(7), text)}


def signatures(docs: DataFrame, text: str, row_id: str, k: int) -> DataFrame:
    """row_id, node (a digest of the shingle set; null without words), n_shingles, labels and ``_text_keys``."""
    hashes = _text_keys(text)
    keys = list(hashes)
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), *(c.alias(x) for x, c in hashes.items()))
    kind = rows.schema["row_id"].dataType.simpleString()

    def run(batches):
        labels = Labels()
        for part in slices(batches):
            sets = [shingle_set(t, k) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "row_id": part.column("row_id"),
                    "node": pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "n_shingles": pa.array(map(len, sets), pa.int32()),
                    "labels": pa.array([labels.of(s) if len(s) else None for s in sets], pa.binary()),
                }
                | {x: part.column(x) for x in keys}
            )

    return rows.mapInArrow(run, f"row_id {kind}, node binary, n_shingles int, labels binary" + "".join(f", {x} bigint" for x in keys))


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """A column of labels of ``width`` values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, width)


def tries(nodes: DataFrame, least: int) -> DataFrame:
    """(tree, label, node, longest): the labels of every tree in sorted order, without those whose longest match is below
    ``least``. At the cuts of the sort, where the neighbour isn't seen, the longest match counts as whole."""
    size = 4 * LABEL
    label = F.expr(f"substring(labels, tree * {size} + 1, {size})")
    each = nodes.select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", label.alias("label"), "node")
    ranged = each.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label")

    def matches(part: pa.RecordBatch) -> np.ndarray:
        values, tree = _numbers(part.column("label"), LABEL), part.column("tree").to_numpy()
        return np.cumprod((values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(1)

    def run(batches):
        held, before = None, LABEL  # the last row so far, and its match with the row before it

        def kept(part, longest):
            longest = longest.astype(np.int32)
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(longest)], ["tree", "label", "node", "longest"]).filter(pa.array(longest >= least))

        for part in batches:
            if not part.num_rows:
                continue
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            between = matches(part)
            if len(between):
                yield kept(part.slice(0, len(between)), np.maximum(np.concatenate(([before], between[:-1])), between))
                before = int(between[-1])
            held = part.slice(part.num_rows - 1)
        if held is not None:
            yield kept(held, np.array([LABEL]))

    return ranged.mapInArrow(run, "tree int, label binary, node binary, longest int")


def runs(found: DataFrame, least: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The runs of the tries as (node, tree, gid, m): those of at most BLOCK members, each at its least depth, and for each
    depth the crowds. Runs of equal members in several trees are given once."""
    small, crowds, rows = [], [], found
    for depth in depths(least):
        rows = rows.where(F.col("longest") >= depth).withColumn("gid", F.xxhash64("tree", F.substring("label", 1, 4 * depth)))
        # Stored, so that Spark sees its size and can split the rows of a crowd in the join.
        sizes = stored(rows.groupBy("gid").agg(F.count("*").alias("m")).where("m >= 2"), "run-sizes")
        here = stored(rows.join(sizes, "gid").select("node", "tree", "label", "longest", "gid", "m"), "runs")
        small.append(here.where(F.col("m") <= BLOCK).select("node", "tree", "gid", "m"))
        rows = here.where(F.col("m") > BLOCK)
        if rows.isEmpty():
            break
        crowds.append((depth, rows.select("node", "tree", "gid", "m")))
        rows = rows.select("tree", "label", "node", "longest")
    all_small = small[0]
    for more in small[1:]:
        all_small = all_small.unionByName(more)
    sets = all_small.groupBy("gid").agg(
        F.first("m").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y")
    )
    kept = sets.groupBy("m", "x", "y").agg(F.min("gid").alias("gid")).select("gid")
    return all_small.join(kept, "gid"), crowds

def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of blocks of the incidence matrix."""
    n = len(sets)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    keep = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + _COLUMNS_AT_ONCE + 1, _COLUMNS_AT_ONCE))
    for i in range(len(cuts) - 1):
        a, b = cuts[i], cuts[i + 1]
        if a < b:
            block = np.zeros((n, _COLUMNS_AT_ONCE), np.float32)
            block[row[a:b], column[a:b] - i * _COLUMNS_AT_ONCE] = 1
            out += block @ block.T
    return out


class Cell:
    """Nodes that meet, with what is needed to verify pairs of them. ``small`` has a node's small run in each tree, or 0."""

    def __init__(self, members: list[dict]):
        self.members = members = list({m["node"]: m for m in members}.values())
        self.sets = [np.frombuffer(m["shingles"], np.uint64) for m in members]
        self.sizes = np.array([len(s) for s in self.sets], np.float64)
        self.small = np.array([m["small"] for m in members], np.int64).reshape(-1, TREES)

    def links(self, threshold: float, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p, q and similarity of the pairs at the threshold; of members of two blocks across the blocks only."""
        n, sizes = len(self.members), self.sizes
        p, q = np.triu_indices(n, 1)
        fits = np.minimum(sizes[p], sizes[q]) >= threshold * np.maximum(sizes[p], sizes[q]) - 1e-9
        if across:
            block = np.array([m["block"] for m in self.members])
            fits &= block[p] != block[q]
        p, q = p[fits], q[fits]
        if n <= 4:
            inter = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(p, q, strict=True)], np.float64)
        else:
            inter = _shared_counts(self.sets)[p, q].astype(np.float64) if len(p) else np.zeros(0)
        union = sizes[p] + sizes[q] - inter
        linked = inter >= threshold * union - 1e-9
        return p[linked], q[linked], inter[linked] / union[linked]

    def least_run(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The least small run that both nodes of each pair belong to, or the largest integer."""
        none = np.iinfo(np.int64).max
        a, b = self.small[p], self.small[q]
        return np.where((a == b) & (a != 0), a, none).min(1, initial=none)

    def deepest(self, p: np.ndarray, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The longest of the depths at which each pair meets, and the first tree in which it does."""
        level = np.array([max((d for d in depths(least) if d <= n), default=0) for n in range(LABEL + 1)])
        labels = _numbers(pa.array([m["labels"] for m in self.members], pa.binary()), TREES * LABEL).reshape(-1, TREES, LABEL)
        depth, tree = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for s in range(0, len(p), 2048):
            shared = np.cumprod(labels[p[s : s + 2048]] == labels[q[s : s + 2048]], axis=2, dtype=np.int8).sum(2)
            shared = level[shared]
            depth[s : s + 2048], tree[s : s + 2048] = shared.max(1), shared.argmax(1)
        return depth, tree


def verify_cell(gid: int, i: int, j: int, members: list[dict], threshold: float, depth: int = 0, least_depth: int = 1) -> list[tuple]:
    """(node, links, root, n, least) of the nodes with links that this cell counts: a small run, or two blocks of a crowd at
    a depth. ``links`` counts copies, ``n`` nodes; ``least`` is the least similarity."""
    cell = Cell(members)
    members, n = cell.members, len(cell.members)
    if n < 2:
        return []
    p, q, alike = cell.links(threshold, i != j)
    if not len(p):
        return []
    run = cell.least_run(p, q)
    if depth:
        deepest, tree = cell.deepest(p, q, least_depth)
        own = (run == np.iinfo(np.int64).max) & (deepest == depth) & (tree == members[0]["tree"])
    else:
        own = run == gid
    p, q, alike = p[own], q[own], alike[own]
    weight = np.array([m["copies"] for m in members], np.int64)
    links, times, least = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n)
    for x, y in ((p, q), (q, p)):
        np.add.at(links, x, weight[y])
        np.add.at(times, x, 1)
        np.minimum.at(least, x, alike)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in zip(p.tolist(), q.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(members[x]["node"], int(links[x]), members[root(x)]["node"], int(times[x]), float(least[x])) for x in np.flatnonzero(times).tolist()]


_LINKS = {"node": pa.binary(), "links": pa.int64(), "root": pa.binary(), "n": pa.int64(), "least": pa.float64()}


def _verified(cells: DataFrame, threshold: float, depth: int = 0, least_depth: int = 1) -> DataFrame:
    """Streams cells, whose rows are sorted to stand together, and verifies one after the other."""

    def rows(batches):
        for part in slices(batches):
            yield from part.to_pylist()

    def batch(out):
        return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(_LINKS.items())})

    def run(batches):
        out = []
        for (gid, i, j), members in groupby(rows(batches), key=lambda r: (r["gid"], r["i"], r["j"])):
            out += verify_cell(gid, i, j, list(members), threshold, depth, least_depth)
            if len(out) > 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return cells.mapInArrow(run, "node binary, links bigint, root binary, n bigint, least double").withColumn("depth", F.lit(depth))


def _sets(docs: DataFrame, members: DataFrame, text: str, row_id: str, k: int) -> DataFrame:
    """members (node, the id and keys of a row that has it, and further columns) with the nodes' shingle sets in place of
    the row's. A row is found by its id and its text's keys, so that an id that many rows share costs no more than one
    that is unique."""
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), *(c.alias(f"own_{x}") for x, c in _text_keys(text).items()))
    rest = [c for c in members.columns if c not in _ROW]
    same = rows["row_id"].eqNullSafe(members["rep"]) & (rows["own_ta"] == members["ta"]) & (rows["own_tb"] == members["tb"])
    found = rows.join(members, same).select("text", *rest)

    def run(batches):
        for part in slices(batches):
            sets = [shingle_set(t, k).tobytes() for t in part.column("text").to_pylist()]
            # Texts of equal keys may still differ: only the node's own text counts.
            own = pa.array([xxhash.xxh128_digest(s) == n for s, n in zip(sets, part.column("node").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in rest} | {"shingles": pa.array(sets, pa.binary())}).filter(own)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema if f.name not in _ROW)
    return found.mapInArrow(run, f"{fields}, shingles binary")


def _homes(crowds: list[tuple[int, DataFrame]]) -> DataFrame:
    """(node, home): the gid of the first crowd of each node in the order of comparison."""
    all_crowds = _union([rows.select("node", F.struct(F.lit(-depth).alias("order"), "tree", "gid").alias("place")) for depth, rows in crowds])
    return all_crowds.groupBy("node").agg(F.min("place").alias("place")).select("node", F.col("place.gid").alias("home"))


def _blocks(crowd: DataFrame, members: DataFrame, found: list[DataFrame], depth: int, above: int, threshold: float, recall: float) -> DataFrame:
    """The cells of the crowds at a depth; ``above`` is the depth that was compared before, or 0. Members are of one kind if
    they have the same other home, and are both open or both not. No cell pairs members of the same other home, who were
    compared there, or members that have both reached the recall before this depth."""
    rows = crowd.join(members.select("node", "home"), "node").select("node", "tree", "gid", "home", F.lit(True).alias("open"))
    if above:
        linked = _union(found).groupBy("node").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
        reached = expected_recall(F.col("n"), F.col("least"), above, threshold) >= recall
        rows = rows.drop("open").join(linked, "node", "left").select("node", "tree", "gid", "home", (~reached).alias("open"))
    # Homes with few members here are not told apart; their pairs are compared once more, and not counted.
    many = rows.groupBy("gid", "home").agg(F.count("*").alias("here")).where((F.col("home") != F.col("gid")) & (F.col("here") >= BLOCK // 4)).select("gid", "home", F.col("home").alias("inner"))
    rows = rows.join(many, ["gid", "home"], "left").select("node", "tree", "gid", F.coalesce("inner", F.lit(0)).alias("inner"), "open")
    rows = stored(rows, "crowd")
    # At most two kinds for each home, of a quarter of a block or more.
    kinds = rows.groupBy("gid", "inner", "open").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    kinds = kinds.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("inner", "open", "blocks"))).alias("kinds"))
    kinds = stored(kinds.where(F.exists("kinds", lambda x: x["open"])), "crowd-kinds")
    dealt = rows.join(kinds, "gid").join(members.drop("home"), "node")
    numbered = F.transform("kinds", lambda x, i: F.struct(x["inner"].alias("inner"), x["open"].alias("open"), x["blocks"].alias("blocks"), (i * F.lit(1 << 20)).alias("first")))
    same = lambda x: (x["inner"] == F.col("inner")) & (x["open"] == F.col("open"))
    meets = lambda x: (x["open"] | F.col("open")) & ((x["inner"] != F.col("inner")) | (x["inner"] == 0))
    own = F.filter("numbered", same)[0]
    others = F.flatten(F.transform(F.filter("numbered", meets), lambda x: F.sequence(x["first"], x["first"] + x["blocks"] - 1)))
    dealt = dealt.withColumn("numbered", numbered).withColumn("block", (own["first"] + F.pmod(F.xxhash64("node"), own["blocks"])).cast("int"))
    dealt = dealt.select(*members.drop("home").columns, "tree", "gid", "block", F.explode(others).alias("other"))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    return dealt.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def verified_links(docs: DataFrame, signed: DataFrame, nodes: DataFrame, threshold: float, recall: float, k: int, text: str, row_id: str) -> DataFrame:
    """(node, links, root, n, least, depth) of all nodes with links, several rows a node. depth is that of the crowd in which
    they were found, or 0. signed has the signatures, nodes has node, _ROW and copies."""
    least_depth = depth_for(recall, threshold)
    labelled = signed.where("node IS NOT NULL").groupBy("node").agg(F.first("labels").alias("labels"))
    small, crowds = runs(stored(tries(labelled, least_depth), "tries"), least_depth)
    # A node's small runs, at most one a tree, as a list and by tree.
    by_tree = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.try_element_at("of", t), F.lit(0)))
    owned = small.groupBy("node").agg(F.collect_list("gid").alias("gids"), F.map_from_entries(F.collect_list(F.struct("tree", "gid"))).alias("of"))
    owned = stored(owned.select("node", "gids", by_tree.alias("small")), "small-runs")
    nodes = nodes.select("node", *_ROW, "copies")
    cells = _sets(docs, nodes.join(owned, "node"), text, row_id, k)
    cells = cells.select("node", "copies", "shingles", "small", F.explode("gids").alias("gid"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    found = [stored(_verified(cells.repartition("gid").sortWithinPartitions("gid"), threshold), "links")]
    if crowds:
        none = F.array_repeat(F.lit(0).cast("bigint"), TREES)
        members = nodes.join(_homes(crowds), "node").join(owned.select("node", "small"), "node", "left")
        members = members.join(labelled, "node").select("node", *_ROW, "copies", "home", "labels", F.coalesce("small", none).alias("small"))
        members = stored(_sets(docs, members, text, row_id, k), "crowd-members")
        above = 0
        for depth, crowd in reversed(crowds):
            cells = _blocks(crowd, members, found, depth, above, threshold, recall)
            found.append(stored(_verified(cells, threshold, depth, least_depth), "links"))
            above = depth
    return _union(found)


def _classified(docs: DataFrame, threshold: float, recall: float, k: int, text: str, row_id: str) -> DataFrame:
    """row_id, ``_text_keys``, node, n_shingles, class_id, n_links and ``keep`` of every row of docs; all but the first four are
    null without words. ``keep`` is, of the class's rows, the first by id (null last), node and keys."""
    signed = stored(signatures(docs, text, row_id, k), "signatures")
    keys = list(_text_keys(text))
    first = F.min(F.struct(F.col("row_id").isNull().alias("none"), "row_id", "node", *keys)).alias("keep")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), first)
    nodes = stored(nodes.select("node", "copies", "keep", F.col("keep.row_id").alias("rep"), *(F.col(f"keep.{x}").alias(x) for x in keys)), "nodes")
    linked = verified_links(docs, signed, nodes, threshold, recall, k, text, row_id)
    roots = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "node")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.join(links.join(roots, "node", "left"), "node", "left")
    # Nodes without links are classes of their own, and stay out of the join, in which they would share one key.
    linked = classes.where("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("keep").alias("first"))
    linked = linked.join(least, "root").select("node", "links", "copies", F.col("first").alias("keep"))
    classes = linked.unionByName(classes.where("root IS NULL").select("node", "links", "copies", "keep"))
    classes = classes.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "keep")
    return signed.select("row_id", "node", "n_shingles", *keys).join(classes.withColumn("class_id", F.col("keep.row_id")), "node", "left")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, k: int = SHINGLE, text: str = "text", row_id: str = "doc_id"
) -> DataFrame:
    """row_id, class_id, n_links and n_shingles of every row of docs."""
    return _classified(docs, threshold, recall, k, text, row_id).select(
        F.col("row_id").alias(row_id),
        F.when(F.col("node").isNull(), F.col("row_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("n_shingles").cast("long").alias("n_shingles"),
    )


def _perhaps(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """rows with ``perhaps``: false only where no row of keys has the same columns. A bitmap of hashes, two bytes a key and
    64 MB at most, goes to all tasks, so that a join on the columns need not move the rows that it can't concern."""
    bits = min(_MOST_BITS, _ROW_BITS * -(-max(1, _BITS_A_KEY * keys.count()) // _ROW_BITS))
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    places = {"map_row": F.floor(place / _ROW_BITS).cast("int"), "map_bit": (place % _ROW_BITS).cast("bigint")}
    maps = keys.select(*(c.alias(x) for x, c in places.items())).groupBy("map_row").agg(F.bitmap_construct_agg("map_bit").alias("map"))
    found = rows.withColumns(places).join(F.broadcast(maps), "map_row", "left")
    byte = F.expr("cast(conv(hex(substring(map, cast(map_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(map_bit % 8 as int))")) != 0
    return found.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias("perhaps"))


def one_of_each(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, k: int = SHINGLE, text: str = "text", row_id: str = "doc_id"
) -> DataFrame:
    """Of each class one row of docs, that of least id; rows without words all stay.

    Ids may be null (last in order) or repeated: rows are told apart by id and text, and classes by their nodes.
    """
    found = _classified(docs, threshold, recall, k, text, row_id).where("node IS NOT NULL")
    kept = F.col("row_id").eqNullSafe(F.col("keep.row_id")) & (F.col("ta") == F.col("keep.ta")) & (F.col("tb") == F.col("keep.tb"))
    # One row for each id and text that goes, or of which only one row stays.
    judged = found.select("row_id", "ta", "tb", kept.alias("kept")).groupBy("row_id", "ta", "tb", "kept").agg(F.count("*").alias("times"))
    judged = stored(judged.where("NOT kept OR times > 1"), "judged")
    # The rows' own columns stand apart in one struct, so that no name can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(row_id).alias("row_id"), *(c.alias(x) for x, c in _text_keys(text).items()))
    # Most rows surely stay: they are told by a bitmap and not moved.
    rows = _perhaps(rows, judged, ["row_id", "ta", "tb"])
    left = rows.where("NOT perhaps").select("row.*")
    rows = rows.where("perhaps")
    same = rows["row_id"].eqNullSafe(judged["row_id"]) & (rows["ta"] == judged["ta"]) & (rows["tb"] == judged["tb"])
    left = left.unionByName(rows.join(judged, same, "left_anti").select("row.*"))
    twice = judged.where("kept")
    if twice.isEmpty():
        return left
    one = rows.join(twice, same, "left_semi").dropDuplicates(["row_id", "ta", "tb"])
    return left.unionByName(one.select("row.*"))
