"""The trie of conversation prefixes: which prefixes are shared, by how many, and what sharing them saves.

Turns get a 128-bit digest of role and text, so that only narrow rows are sorted: by conversation, then turn, in ranges.
A numpy scan of each range gives every prefix a polynomial fingerprint modulo two primes, ``sum of digest_i * base^i``;
ranges that begin inside a conversation are moved on by what stands before them (one row a range). So a conversation of
any length, or a third of all turns, is spread over many tasks.

Prefixes of equal depth and fingerprint are candidates for one node. They are verified turn by turn: equal digests by
comparing the roles and texts themselves, equal fingerprints by comparing each member's last turn, and the fingerprint
before it, with those of the representative (its smallest conversation). Where something differs the candidates are split:
digests by numbering their texts, fingerprints by the exact pair of parent and turn at each depth where one collided.

A node is named by its depth and smallest conversation; a conversation names a chain of nodes, from some depth to its end.
Sums over subtrees are sums over chains: every member of a node adds what its own chain holds at the node's depth or deeper.
Each prefix is met once, whatever the trie's depth.

Conversation ids are integers; rows without one belong to no conversation and are left out. Turns stand by number, null
first; turns of equal number by the digest of role and text, so repeated rows stand side by side and all count. Null roles
and texts are empty. Long texts stay where they are read. An empty table has no nodes; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.shared import stored

#: (prime below 2^31, base) of the two fingerprints.
FIELD = ((2147483647, 1_288_490_189), (2147483629, 917_632_151))
#: Up to so many repeated digests are sent to all tasks; beyond them all texts are aggregated by digest.
BROADCAST = 200_000
#: Depths whose values are summed by one task; longer chains are summed in pieces.
PIECE = 1024
#: Consecutive ids that are written into one text before a node's ids are hashed.
PACK = 256

_SCANNED = "conv long, range int, pos long, f1 long, f2 long, e1 long, e2 long, k1 long, k2 long, sub int, words long, last boolean"
PREFIX = ("conv", "depth", "f1", "f2", "e1", "e2", "k1", "k2", "sub", "words")


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes; the role's length keeps role and text apart."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def turns(conversations: DataFrame, digest: Callable[[Column, Column], Column] = turn_digest) -> DataFrame:
    """One narrow row a turn: conv, turn, key, sub, words. Equal (key, sub) means equal role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest(role, text).alias("key"), role.alias("role"), text.alias("text")
    )
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long").alias("words")
    narrow = stored(whole.select("conv", "turn", "key", F.lit(0).alias("sub"), words), "trie-turns")
    repeated = stored(narrow.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "trie-repeated")
    seen = whole.select("key", "role", "text")
    if repeated.count() <= BROADCAST:
        seen = seen.join(F.broadcast(repeated), "key", "left_semi")
    said = F.struct("role", "text")
    unequal = seen.groupBy("key").agg(F.min(said).alias("a"), F.max(said).alias("b")).where("a != b").select("key")
    unequal = stored(unequal, "trie-unequal")
    if unequal.isEmpty():
        return narrow
    number = (F.row_number().over(Window.partitionBy("key").orderBy("role", "text")) - 1).alias("number")
    numbers = whole.join(unequal, "key", "left_semi").select("key", "role", "text").distinct().select("*", number)
    numbered = whole.join(numbers, ["key", "role", "text"], "left")
    return stored(numbered.select("conv", "turn", "key", F.coalesce("number", F.lit(0)).alias("sub"), words), "trie-turns")


class _Powers:
    """Powers of a base modulo a prime, at any place: one table of 2^16 powers and one of their steps."""

    def __init__(self, prime: int, base: int):
        self.prime, step = np.uint64(prime), pow(base, 1 << 16, prime)
        self.near = self._table(base, 1 << 16)
        self.step, self.far = step, self._table(step, 1)

    def _table(self, base: int, n: int) -> np.ndarray:
        out, prime = np.ones(n, np.uint64), int(self.prime)
        size = 1
        while size < n:  # doubles the known part
            more = min(size, n - size)
            out[size : size + more] = out[:more] * np.uint64(pow(base, size, prime)) % self.prime
            size += more
        return out % self.prime

    def __call__(self, at: np.ndarray) -> np.ndarray:
        top = int(at.max()) >> 16
        if top >= len(self.far):
            self.far = self._table(self.step, 2 * top + 1)
        return self.near[at & 0xFFFF] * self.far[at >> 16] % self.prime


def _scan(field, range_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and fingerprints within one range, batch after batch; the range's last row is marked."""
    powers = [_Powers(*x) for x in field]
    conv_before, pos_before, f_before, held = None, 0, [0, 0], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv").to_numpy()
        at = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = conv_before is None or conv[0] != conv_before
        start = np.maximum.accumulate(np.where(new, at, -1))  # -1: the run began in an earlier batch
        pos = np.where(start >= 0, at - start + 1, pos_before + at + 1)
        key = np.frombuffer(b"".join(batch.column("key").to_pylist()), "<u8").reshape(n, 2)
        sub = batch.column("sub").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        columns = {"conv": conv, "range": np.full(n, range_id, np.int32), "pos": pos}
        for i, power in enumerate(powers):
            run = np.zeros(n + 1, np.uint64)
            np.cumsum((key[:, i] + sub) % power.prime * power(pos) % power.prime, out=run[1:])
            before = np.where(start >= 0, run[np.maximum(start, 0)], 0)
            f = (run[1:] - before + np.where(start >= 0, 0, f_before[i]).astype(np.uint64)) % power.prime
            e = np.concatenate(([0 if new[0] else f_before[i]], f[:-1])).astype(np.int64)
            e[new] = 0
            columns |= {f"f{i + 1}": f.astype(np.int64), f"e{i + 1}": e}
            f_before[i] = int(f[-1])
        conv_before, pos_before = conv[-1], int(pos[-1])
        columns |= {"k1": key[:, 0].view(np.int64), "k2": key[:, 1].view(np.int64), "sub": batch.column("sub"), "words": batch.column("words")}
        if held:
            yield pa.RecordBatch.from_pydict(held)
        held = {c: columns[c] for c in ("conv", "range", "pos", "f1", "f2", "e1", "e2", "k1", "k2", "sub", "words")} | {"last": np.zeros(n, bool)}
    if held:
        held["last"][-1] = True
        yield pa.RecordBatch.from_pydict(held)


def fingerprints(rows: DataFrame, field=FIELD) -> DataFrame:
    """A row a prefix (PREFIX) but for empty ones: conversation, depth, fingerprint f, that before the last turn e, the
    last turn's digest k with ``sub``, and its words."""
    ranges = rows.repartitionByRange("conv", "turn", "key", "sub").sortWithinPartitions("conv", "turn", "key", "sub")
    scan = lambda batches: _scan(field, TaskContext.get().partitionId(), batches)
    scanned = stored(ranges.mapInArrow(scan, _SCANNED), "trie-ranges")
    # What stands before a range in the conversation that it begins with: found from the last row of each range.
    before, conv, pos, f = [], None, 0, [0, 0]
    for row in scanned.where("last").select("range", "conv", "pos", "f1", "f2").orderBy("range").toLocalIterator():
        if conv is not None:
            before.append((row["range"], conv, pos, *f, *(pow(base, pos, prime) for prime, base in field)))
        own = (row["f1"], row["f2"])
        f = [(f[i] + own[i] * pow(base, pos, prime)) % prime if row["conv"] == conv else own[i] for i, (prime, base) in enumerate(field)]
        pos = (pos if row["conv"] == conv else 0) + row["pos"]
        conv = row["conv"]
    moved = rows.sparkSession.createDataFrame(before, "range int, conv long, before long, g1 long, g2 long, b1 long, b2 long")
    joined = scanned.join(F.broadcast(moved), ["range", "conv"], "left")
    move = lambda x, i: F.when(F.col("before").isNull(), F.col(x)).otherwise((F.col(f"g{i}") + F.col(x) * F.col(f"b{i}")) % field[i - 1][0])
    depth = F.col("pos") + F.coalesce("before", F.lit(0))
    return joined.select("conv", depth.alias("depth"), *(move(f"{c}{i}", i).alias(f"{c}{i}") for c in "fe" for i in (1, 2)), "k1", "k2", "sub", "words")


def roots(convs: DataFrame) -> DataFrame:
    """The empty prefix of each conversation (one row each)."""
    zero = {c: F.lit(0).cast("int" if c == "sub" else "long") for c in PREFIX[1:]}
    return convs.select("conv", *(x.alias(c) for c, x in zero.items()))


def _split(prefixes: DataFrame, unequal: DataFrame) -> DataFrame:
    """Adds ``salt`` and ``salt_up`` (that of the parent): for every depth down to a prefix's own at which its candidates
    weren't equal, the parent and turn that it has there. Prefixes of equal depth, fingerprint and salt are equal."""
    own = F.concat_ws(":", "depth", "e1", "e2", "k1", "k2", "sub")
    split = prefixes.join(unequal, ["depth", "f1", "f2"]).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", own.alias("own")))).alias("splits"))
    joined = prefixes.join(split, "conv", "left")
    salt = lambda top: F.coalesce(F.expr(f"array_join(transform(filter(splits, x -> x.depth {top} depth), x -> x.own), ';')"), F.lit(""))
    return joined.select(*PREFIX, salt("<=").alias("salt"), salt("<").alias("salt_up"))


def _grouped(prefixes: DataFrame, keys: list[str], up: list[str]) -> DataFrame:
    return prefixes.groupBy(*keys).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *(F.max(c).alias(c) for c in up),
        F.greatest(*(F.max(c) - F.min(c) for c in ("e1", "e2"))).alias("differ"), *(F.min(c).alias(f"{c}_least") for c in ("k1", "k2", "sub")),
        *(F.max(c).alias(f"{c}_most") for c in ("k1", "k2", "sub")),
    )


def _hashed(ends: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of each node's ids, ascending and joined by commas. Ids are put together in packs first; a node's packs then
    stream through one hash in order, so that no task holds a node's ids."""
    packs = ends.groupBy(*keys, F.floor(F.col("conv") / PACK).alias("pack")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    packs = packs.select(*keys, "pack", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ordered = packs.repartition(*keys).sortWithinPartitions(*keys, "pack")
    schema = ordered.select(*keys).schema.add("ends_sha256", "string")

    def run(batches):
        node, digest = None, None
        for batch in batches:
            out = []
            rows = zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), batch.column("ids").to_pylist(), strict=True)
            for key, ids in rows:
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield _batch(out)
        if node is not None:
            yield _batch([(*node, digest.hexdigest())])

    names, kinds = [*keys, "ends_sha256"], [pa.string() if c == "salt" else pa.int64() for c in keys] + [pa.string()]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, schema)


def _parents(nodes: DataFrame, keys: list[str], up: list[str], total: int) -> DataFrame:
    """The name of each node's parent. At most 10,000 nodes have more than a 10,000th of all nodes as children: they are sent
    to all tasks, so that no join brings the children of one node together."""
    limit = max(1000, total // 10_000)
    named = nodes.where("n_children > 0").select(*(F.col(k).alias(f"{k}_p") for k in keys), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide, narrow = named.where(F.col("n_children") > limit).drop("n_children"), named.where(F.col("n_children") <= limit).drop("n_children")
    children = nodes.where("depth > 0").select(*keys, *(x.alias(f"{k}_p") for k, x in zip(keys, _up(up), strict=True)))
    on = [f"{k}_p" for k in keys]
    few = children.join(F.broadcast(wide), on).select(*keys, "parent_conv_id")
    rest = children.join(F.broadcast(wide), on, "left_anti").join(narrow, on).select(*keys, "parent_conv_id")
    return few.unionByName(rest)


def _up(up: list[str]) -> list[Column]:
    return [F.col("depth") - 1, *map(F.col, up)]


def nodes(prefixes: DataFrame) -> DataFrame:
    """One row a node of the trie over ``prefixes`` (PREFIX, empty ones included)."""
    prefixes = stored(prefixes.select(*PREFIX), "trie-prefixes")
    keys, up = ["depth", "f1", "f2"], ["e1", "e2"]
    grouped = stored(_grouped(prefixes, keys, up), "trie-groups")
    unequal = grouped.where("differ > 0 OR k1_least != k1_most OR k2_least != k2_most OR sub_least != sub_most").select(*keys)
    if not unequal.isEmpty():
        prefixes = stored(_split(prefixes, unequal), "trie-split")
        keys, up = [*keys, "salt"], [*up, "salt_up"]
        grouped = _grouped(prefixes, keys, up)
    children = grouped.where("depth > 0").groupBy(*(x.alias(k) for k, x in zip(keys, _up(up), strict=True))).agg(F.count("*").alias("n_children"))
    tree = grouped.join(children, keys, "left").select(*keys, *up, "conv_id", "n_convs", "words", F.coalesce("n_children", F.lit(0)).alias("n_children"))
    tree = stored(tree, "trie-nodes")

    # Own chains: what stands at a node or deeper in the chain of its smallest conversation.
    piece = F.floor(F.col("depth") / PIECE).alias("piece")
    values = tree.select(
        *keys, "conv_id", "n_convs", "n_children", piece, (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    pieces = values.groupBy("conv_id", "piece").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "piece", *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"{c}_deeper") for c in ("leaf", "saved")))
    within = Window.partitionBy("conv_id", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = values.withColumns({f"{c}_own": F.sum(c).over(within) for c in ("leaf", "saved")}).join(pieces, ["conv_id", "piece"])
    # Other members of a node add the whole of their chains, which begin deeper.
    chains = values.groupBy(F.col("conv_id").alias("conv")).agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    others = prefixes.select("conv", *keys).join(chains, "conv").where("depth < top").groupBy(*keys).agg(F.sum("leaf").alias("leaf_other"), F.sum("saved").alias("saved_other"))
    ends = prefixes.groupBy("conv").agg(F.max(F.struct(*keys)).alias("end")).select("conv", *(F.col(f"end.{k}").alias(k) for k in keys))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    total = lambda c: (F.col(f"{c}_own") + F.col(f"{c}_deeper") + F.coalesce(f"{c}_other", F.lit(0))).cast("long")
    return (
        own.join(others, keys, "left")
        .join(_parents(tree, keys, up, tree.count()), keys, "left")
        .join(_hashed(ends, keys), keys, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("leaf").alias("n_leaves"), total("saved").alias("saved_tokens"),
                F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    )


def prefix_trie(conversations: DataFrame, digest: Callable[[Column, Column], Column] = turn_digest, field=FIELD) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text): a row a node, with its smallest member, its parent's,
    members, children, leaves and saved words below it, and the hash of the ids of the conversations that end there."""
    found = stored(fingerprints(turns(conversations, digest), field), "trie-fingerprints")
    return nodes(found.unionByName(roots(found.where("depth = 1"))))


def spliced(found: DataFrame, every: int = 20, heads: int = 4, field=FIELD) -> DataFrame:
    """Prefixes of conversations rebuilt from those of the given ones (``fingerprints``): each begins with the first h turns
    of conversation c - c % every and goes on with its own turns after its first h; h = crc32(c) % heads.

    A polynomial of what follows a cut is the difference of two prefixes, and moving it by some places is a product with a
    power of the base: no turn is scanned again. At most ``heads - 1`` turns of a conversation are handed on.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    turn = [c for c in PREFIX if c not in ("conv", "depth")]
    first = found.where((F.col("conv") % every == 0) & (F.col("depth") < heads)).groupBy(F.col("conv").alias("origin"))
    first = first.agg(F.array_sort(F.collect_list(F.struct("depth", *turn))).alias("first"))
    cut = found.where(F.col("depth") == h).select("conv", F.col("f1").alias("c1"), F.col("f2").alias("c2"))
    convs = found.where("depth = 1").select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("origin"))
    convs = convs.join(first, "origin", "left").join(cut, "conv", "left")
    convs = convs.withColumn("first", F.coalesce(F.expr("filter(first, x -> x.depth <= h)"), F.expr("filter(first, x -> false)"), F.array().cast(first.schema["first"].dataType)))
    convs = stored(convs.withColumn("handed", F.size("first").cast("long")), "trie-splices")
    head = convs.select("conv", F.inline("first")).select(*PREFIX)
    start = lambda i: F.when(F.col("handed") == 0, 0).otherwise(F.element_at("first", -1)[f"f{i}"])
    cuts = convs.select("conv", "h", "handed", *(F.coalesce(f"c{i}", F.lit(0)).alias(f"c{i}") for i in (1, 2)), *(start(i).alias(f"g{i}") for i in (1, 2)))
    back = [F.array(*(F.lit(pow(base, -k, prime)).cast("long") for k in range(heads))) for prime, base in field]

    def moved(x: str, i: int) -> Column:
        prime = field[i - 1][0]
        step = F.element_at(back[i - 1], (F.col("h") - F.col("handed") + 1).cast("int"))
        return (F.col(f"g{i}") + step * F.pmod(F.col(x) - F.col(f"c{i}"), F.lit(prime))) % prime

    tail = found.where(F.col("depth") > h).join(cuts, "conv").select(
        "conv", (F.col("depth") - F.col("h") + F.col("handed")).alias("depth"), *(moved(f"{c}{i}", i).alias(f"{c}{i}") for c in "fe" for i in (1, 2)),
        "k1", "k2", "sub", "words",
    )
    return head.unionByName(tail).unionByName(roots(convs))
