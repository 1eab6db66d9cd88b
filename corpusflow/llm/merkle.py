"""Merkle manifest of a table by time-forward processing.

A node's *label* says when it can be computed: the last leaf below it, then its level. A
forward sweep visits nodes by label; each sends its digest to its parent through a priority
queue ordered by label, which hands a node the digests of its children. The reversed sweep
goes through the same nodes by falling label: each sends its children their proof *suffix*,
the sibling's digest and its own suffix, until the leaves hold whole proofs.

At scale the queue is external. A tree is cut into blocks of 2**BITS neighbours over BITS
levels; Spark's shuffle and its spilling sort deliver the messages between blocks by tree,
block and label, while a heap of at most a few dozen entries orders those inside a block. So a
round of the forward sweep turns the digests of a level into those BITS levels above, a round
of the reversed sweep hands the blocks' suffixes down, and the number of rounds is
log(rows) / BITS. A task holds one block at a time, whatever the size of a tree.

Leaves of a tree are numbered without a window over it: rows are range-partitioned and
sorted, and each partition's offset is the sum of the counts before it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize

#: Levels of a tree that one round of a sweep covers: a block has at most 2**BITS nodes at its bottom.
BITS = 8


def field(column: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """Digest of a row: lowercase hex SHA-256 of its fields."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the ``n`` leaves of a tree."""
    return (n - 1).bit_length()


class Block:
    """The nodes of one block of at most 2**levels neighbours, swept forward and then backward."""

    def __init__(self, levels: int):
        self.levels = levels
        self.queue: list[tuple[int, int, str]] = []
        self.swept: list[tuple[int, list[tuple[int, str]]]] = []
        self.top = ""

    @staticmethod
    def label(level: int, at: int) -> int:
        return ((((at + 1) << level) - 1) << 6) + level

    def _send_up(self, level: int, at: int, value: str) -> None:
        if level == self.levels:
            self.top = value
        else:
            heapq.heappush(self.queue, (self.label(level + 1, at >> 1), at, value))

    def _run_to(self, label: float) -> None:
        while self.queue and self.queue[0][0] < label:
            now, children = self.queue[0][0], []
            while self.queue and self.queue[0][0] == now:
                children.append(heapq.heappop(self.queue)[1:])
            self.swept.append((now, children))
            self._send_up(now & 63, children[0][0] >> 1, digest(*[d for _, d in children]))

    def forward(self, digests: list[str]) -> str:
        """Digest of the block's top."""
        for at, value in enumerate(digests):
            self._run_to(self.label(0, at))
            self._send_up(0, at, value)
        self._run_to(float("inf"))
        return self.top

    def backward(self, suffix: str) -> list[str]:
        """Proofs of the block's bottom nodes, in order, from that of its top."""
        if not self.swept:
            return [suffix]
        queue, out = [(-self.swept[-1][0], suffix)], {}
        for now, children in reversed(self.swept):
            label, rest = heapq.heappop(queue)
            assert -label == now
            level = (now & 63) - 1
            for k, (at, _) in enumerate(children):
                proof = "".join(d for i, (_, d) in enumerate(children) if i != k) + rest
                if level:
                    heapq.heappush(queue, (-self.label(level, at), proof))
                else:
                    out[at] = proof
        return [out[at] for at in range(len(out))]


def fold(value: str, places: list[tuple[int, int]], proof: str) -> str:
    """Root that follows from a leaf and its proof. ``places``: (position, leaves) in each tree from
    the leaf's own to the outermost."""
    used = 0
    for at, width in places:
        while width > 1:
            if at ^ 1 < width:
                other = proof[used : used + 64]
                used += 64
                value = digest(other, value) if at & 1 else digest(value, other)
            else:
                value = digest(value)
            at, width = at >> 1, (width + 1) >> 1
    return value


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (tree, id, digest, ..) with ``at``, the place in the tree by id (null first) and
    digest, and ``n``, the rows of the tree. Rows equal in all three are alike, so any order serves."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("digest"), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("mark", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("part", F.shiftright("mark", 33)), name, force=True)
    heads = rows.groupBy("tree", "part").agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("some"))
    tree = Window.partitionBy("tree")  # a row for each partition that the tree touches
    before = F.sum("some").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("some").over(tree).alias("n"))
    return rows.join(heads, ["tree", "part"]).withColumn("at", F.col("mark") + F.col("shift")).drop("mark", "part", "shift")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[dict]]]:
    """Sorted rows by (tree, block)."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, key=lambda r: (r["tree"], r["block"])):
        yield key, list(group)  # 2**BITS nodes and a suffix at most


def _arrow(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types, strict=True)], schema=schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks of nodes, each in one task and in order of label; a suffix (at null) goes first."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("at").asc_nulls_first())


_NODE = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("at", pa.int64()), ("digest", pa.string())])


def _forward_round(nodes: DataFrame, low: int) -> DataFrame:
    """Nodes (tree, n, at, digest) of level ``low`` to those BITS levels above, or to the roots below that."""

    def run(batches):
        def tops():
            for (tree, at), rows in _blocks(batches):
                n = rows[0]["n"]
                yield tree, n, at, Block(min(BITS, height(n) - low)).forward([r["digest"] for r in rows])

        yield from _arrow(tops(), _NODE)

    blocks = nodes.select("tree", "n", "at", "digest", F.shiftright("at", BITS).alias("block"))
    return _dealt(blocks).mapInArrow(run, "tree string, n long, at long, digest string")


def _height(n: Column) -> Column:
    return F.length(F.bin(n - 1)) - F.when(n == 1, 1).otherwise(0)


def _forward(leaves: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Nodes at the bottom of each round, and the roots (tree, n, at 0, digest)."""
    rounds, roots, nodes = [], None, leaves
    for low in range(0, max(1, height(most)), BITS):
        rounds.append(nodes)
        tops = materialize(_forward_round(nodes, low), f"{name}-level", force=True)
        done = _height(F.col("n")) <= low + BITS
        roots = tops.where(done) if roots is None else roots.unionByName(tops.where(done))
        nodes = tops.where(~done)
    return rounds, roots


def _backward_round(nodes: DataFrame, suffixes: DataFrame, low: int) -> DataFrame:
    """(tree, at, suffix) of each node of the round; suffixes: (tree, at, suffix) of the blocks' tops."""
    rows = nodes.select("tree", "n", "at", "digest", F.shiftright("at", BITS).alias("block"))
    first = suffixes.select("tree", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("at"), F.col("suffix").alias("digest"), F.col("at").alias("block"))

    def run(batches):
        def below():
            for (tree, _), (top, *rows) in _blocks(batches):
                block = Block(min(BITS, height(rows[0]["n"]) - low))
                block.forward([r["digest"] for r in rows])
                for row, suffix in zip(rows, block.backward(top["digest"]), strict=True):
                    yield tree, row["at"], suffix

        yield from _arrow(below(), pa.schema([("tree", pa.string()), ("at", pa.int64()), ("suffix", pa.string())]))

    return _dealt(rows.unionByName(first)).mapInArrow(run, "tree string, at long, suffix string")


def _starts(tops: DataFrame, low: int) -> DataFrame:
    """Suffixes (tree, at, suffix) of the trees whose root is reached in the round from level ``low``."""
    tall = _height(F.col("n"))
    return tops.where((tall <= low + BITS) & ((tall > low) | F.lit(low == 0))).select("tree", F.lit(0).cast("long").alias("at"), "suffix")


def _backward(rounds: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """Suffixes of the blocks of the lowest round, from those of the roots (tree, n, suffix)."""
    below = None
    for i in reversed(range(len(rounds))):
        suffixes = _starts(tops, i * BITS) if below is None else _starts(tops, i * BITS).unionByName(below)
        if i == 0:
            return suffixes
        below = materialize(_backward_round(rounds[i], suffixes, i * BITS), f"{name}-suffixes", force=True)


_OUT = "doc_id {kind}, leaf string, tree_at long, tree_leaves long, subroot string, root string, proof string, folded_root string, verified boolean"


def manifest(docs: DataFrame, fields: list[Column], claimed: Column | None = None, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """A leaf of a two-storey Merkle tree for each row, with its proof.

    Rows of a ``group_col`` value form a tree, ordered by ``id_col`` (null first; equal ids by
    digest; equal rows are interchangeable); the trees' roots form the outer tree, ordered by the
    value (null first, else bytewise). Each two neighbours of a level become their digest, a last
    one alone its own digest, until one is left; so a tree of one leaf is that leaf.

    ``claimed``: the digest of the row as somebody presents it (null or None: as it is). It is
    folded with the row's original proof and holds if the root results.

    Returns doc_id, leaf, tree_at (the leaf's place in its tree), tree_leaves, subroot, root,
    proof (the siblings' digests from leaf to root, concatenated), folded_root and verified. No
    rows give no rows; null text or ids are fields like any other; further columns are not read."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    tree = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit(""))
    shown = F.lit(None).cast("string") if claimed is None else claimed
    rows = docs.select(tree.alias("tree"), docs[id_col].alias("id"), leaf(*fields).alias("digest"), shown.alias("claimed"))
    rows = _numbered(materialize(rows, "merkle-leaves", force=True), "merkle-numbered")
    most = rows.agg(F.max("n")).first()[0]
    schema = _OUT.format(kind=kind)
    if most is None:
        return spark.createDataFrame([], schema)

    rounds, roots = _forward(rows, most, "merkle")
    outer = _numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", F.col("n").alias("leaves")), "merkle-trees")
    trees = outer.agg(F.max("n")).first()[0]
    outer_rounds, outer_root = _forward(outer, trees, "merkle-trees")
    root = outer_root.first()["digest"]
    blocks = _backward(outer_rounds, outer_root.withColumn("suffix", F.lit("")), "merkle-trees")
    above = materialize(_backward_round(outer_rounds[0], blocks, 0), "merkle-tree-proofs", force=True).drop("tree")
    above = outer.join(above, "at").select(F.col("id").alias("tree"), F.col("leaves").alias("n"), "suffix", F.col("at").alias("place"), F.col("digest").alias("subroot"))
    above = materialize(above, "merkle-outer", force=True)
    suffixes = _backward(rounds, above, "merkle")

    # the last round: whole proofs; a tree's root and its place among the trees come with the blocks' suffixes
    nodes = rows.select("tree", F.shiftright("at", BITS).alias("block"), "at", "n", "id", "digest", "claimed", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("long").alias("place"))
    none = lambda kind: F.lit(None).cast(kind)
    first = suffixes.join(above.select("tree", "subroot", "place"), "tree").select(
        "tree", F.col("at").alias("block"), none("long").alias("at"), none("long").alias("n"), none(kind).alias("id"), F.col("suffix").alias("digest"), none("string").alias("claimed"), "subroot", "place"
    )

    def run(batches):
        def proofs():
            for _, (top, *rows) in _blocks(batches):
                block, n = Block(min(BITS, height(rows[0]["n"]))), rows[0]["n"]
                block.forward([r["digest"] for r in rows])
                for row, proof in zip(rows, block.backward(top["digest"]), strict=True):
                    folded = fold(row["claimed"] or row["digest"], [(row["at"], n), (top["place"], trees)], proof)
                    yield row["id"], row["digest"], row["at"], n, top["subroot"], root, proof, folded, folded == root

        yield from _arrow(proofs(), target)

    target = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return _dealt(nodes.unionByName(first)).mapInArrow(run, schema)
