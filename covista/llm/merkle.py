"""Op 13: Merkle manifest of a dataset, with proofs and tampered versions from a persistent tree.

Every row is a leaf: the SHA-256 of its fields, made by Spark's own functions, so texts are read once
and never reach Python.  Leaves are numbered within their group by range partitions
(``functions.ranking``), and a group's leaves are dealt into aligned blocks of ``ARITY ** BLOCK_LEVELS``
leaves, one table row a block.  A block becomes a tree in its task; block roots are the nodes of the next
table, until a group is one node, its subroot.  The subroots, ordered by group, climb in the same way to
the root.  Then paths go down: every block gets the siblings on the way from its root to the root.

In a leaf block the tree is persistent: a tampered leaf makes a version, that is a new root, which
copies the leaf's ancestors within the block and shares every other node; all versions and the first
tree live side by side.  A version goes on above the block along the block's path, which the join with
the table of paths brought to it.  Blocks, not groups, are the unit of work, so a group with a third of
all rows is spread over all tasks; nothing is collected or broadcast by hand.

Defined results: a null field is ``-``, an empty text ``0:``; null ids come first, and are not tampered;
rows that share an id stay, ordered by digest; rows without a group are a group that comes first;
a lone leaf is its own subroot, a lone subroot the root, and a proof without siblings is the digest of
nothing; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import running_before
from .common import cut_lineage, drop_table, map_batches

ARITY = 3
BLOCK_LEVELS = 7                   # levels of a block: 2,187 leaves, 150 KB
BLOCK_LEAVES = ARITY ** BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCKS = "tree string, block bigint, ids array<bigint>, hashes array<binary>, changed array<binary>, root binary"
PATHS = "tree string, node bigint, lefts array<string>, rights array<string>, subroot string"
PROOFS = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")
WHOLE = ""                         # the tree over the subroots


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class PersistentTree:
    """A tree of digests whose nodes never change; a version is the number of its root node."""

    def __init__(self, leaves: list[str], levels: int):
        self.hashes, self.kids, self.levels = list(leaves), [()] * len(leaves), levels
        layer = range(len(leaves))
        for _ in range(levels):
            layer = [self._add(tuple(layer[i:i + ARITY])) for i in range(0, len(layer), ARITY)]
        self.root = layer[0]

    def _add(self, kids: tuple[int, ...]) -> int:
        self.hashes.append(digest(*[self.hashes[k] for k in kids]))
        self.kids.append(kids)
        return len(self.hashes) - 1

    def _way(self, root: int, place: int) -> list[tuple[int, int]]:
        """The nodes from a version's root to a leaf's parent, with the child to take at each."""
        way, node = [], root
        for level in range(self.levels - 1, -1, -1):
            at = place // ARITY ** level % ARITY
            way.append((node, at))
            node = self.kids[node][at]
        return way

    def with_leaf(self, root: int, place: int, leaf: str) -> int:
        """A version of ``root`` with another leaf: copies of its ancestors, all other nodes shared."""
        way = self._way(root, place)
        self.hashes.append(leaf)
        self.kids.append(())
        new = len(self.hashes) - 1
        for node, at in reversed(way):
            kids = self.kids[node]
            new = self._add(kids[:at] + (new,) + kids[at + 1:])
        return new

    def siblings(self, root: int, place: int) -> tuple[list[str], list[str]]:
        """Digests left and right of the leaf's way, joined, level by level from the leaf up."""
        lefts, rights = [], []
        for node, at in reversed(self._way(root, place)):
            kids = [self.hashes[k] for k in self.kids[node]]
            lefts.append("".join(kids[:at]))
            rights.append("".join(kids[at + 1:]))
        return lefts, rights


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        leaf = digest(left, leaf, right)
    return leaf


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row's fields, each as byte count and value, or ``-`` for null."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block, from rows sorted by block and place."""
    now, ids, hashes, changed = None, [], [], []

    def block():
        # the first block of a tree is short only if it is the whole tree
        levels = BLOCK_LEVELS if now[1] or len(hashes) == BLOCK_LEAVES else depth(len(hashes))
        tree = PersistentTree([h.hex() for h in hashes], levels)
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([hashes], pa.list_(pa.binary())), pa.array([changed], pa.list_(pa.binary())),
             pa.array([bytes.fromhex(tree.hashes[tree.root])], pa.binary())],
            names=["tree", "block", "ids", "hashes", "changed", "root"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("tree", "block", "doc_id", "hash", "changed")]
        for tree, number, doc, h, other in zip(*columns):
            if (tree, number) != now:
                if hashes:
                    yield block()
                now, ids, hashes, changed = (tree, number), [], [], []
            ids.append(doc)
            hashes.append(h)
            changed.append(other)
    if hashes:
        yield block()


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, lowest first, over ``tree, idx, doc_id, hash, changed``; in the last, every tree
    is one block.  A table has a row for each ``BLOCK_LEAVES`` nodes of the one before."""
    tables = []
    while True:
        block = F.floor(F.col("idx") / F.lit(BLOCK_LEAVES)).cast("bigint")
        dealt = (nodes.select("tree", block.alias("block"), "idx", "doc_id", "hash", "changed")
                      .repartition("tree", "block").sortWithinPartitions("tree", "block", "idx"))
        tables.append(cut_lineage(map_batches(dealt, _blocks, BLOCKS), "blocks"))
        if tables[-1].filter("block > 0").isEmpty():
            return tables
        nodes = tables[-1].select("tree", F.col("block").alias("idx"), F.lit(None).cast("bigint").alias("doc_id"),
                                  F.col("root").alias("hash"), F.lit(None).cast("binary").alias("changed"))


def _tree(row: dict) -> PersistentTree:
    n = len(row["hashes"])
    levels = BLOCK_LEVELS if row["block"] or n == BLOCK_LEAVES else depth(n)
    return PersistentTree([h.hex() for h in row["hashes"]], levels)


def _node_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of a block's nodes to the root: the ways within the block, then the block's own path."""
    for batch in batches:
        for row in batch.to_pylist():
            tree = _tree(row)
            places = range(len(row["hashes"]))
            ways = [tree.siblings(tree.root, p) for p in places]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * len(ways), pa.string()),
                 pa.array([row["block"] * BLOCK_LEAVES + p for p in places], pa.int64()),
                 pa.array([w[0] + row["lefts"] for w in ways], pa.list_(pa.string())),
                 pa.array([w[1] + row["rights"] for w in ways], pa.list_(pa.string())),
                 pa.array([row["subroot"]] * len(ways), pa.string())],
                names=["tree", "node", "lefts", "rights", "subroot"])


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    return blocks.join(paths.withColumnRenamed("node", "block"), ["tree", "block"])


def descend(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the blocks of the lowest table, from those of the trees' tops (``PATHS``)."""
    for blocks in reversed(tables[1:]):
        paths = map_batches(_with_paths(blocks, paths), _node_paths, PATHS)
    return paths


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PROOFS`` for a block's leaves: siblings, and the root of each leaf's version."""
    for batch in batches:
        for row in batch.to_pylist():
            tree, up = _tree(row), (row["lefts"], row["rights"])
            above = [a + b for a, b in zip(*up)]
            first = fold(tree.hashes[tree.root], *up)
            proofs, folded = [], []
            for place, other in enumerate(row["changed"]):
                beside = tree.siblings(tree.root, place)
                proofs.append(digest(*[a + b for a, b in zip(*beside)], *above))
                version = tree.root if other is None else tree.with_leaf(tree.root, place, other.hex())
                folded.append(first if version == tree.root else fold(tree.hashes[version], *up))
            n = len(proofs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array([h.hex() for h in row["hashes"]], pa.string()),
                 pa.array([row["subroot"]] * n, pa.string()), pa.array([first] * n, pa.string()),
                 pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
                 pa.array([f == first for f in folded], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, tampered: Column | None = None, altered: Column | None = None,
             group_col: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS,
             text_col: str = "text") -> DataFrame:
    """``PROOFS`` of all rows.  Rows where ``tampered`` holds are checked with the text ``altered`` in
    place of theirs, each in a version of its own, against the siblings of the first tree."""
    own = [F.col(f) for f in fields]
    leaf = leaf_digest(own)
    changed = F.lit(None).cast("binary")
    if tampered is not None:
        other = leaf_digest([altered if f == text_col else F.col(f) for f in fields])
        changed = F.when(tampered & ~altered.eqNullSafe(F.col(text_col)), other)
    # trees sort as their groups do: null first, then by bytes
    tree = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    leaves = cut_lineage(docs.select(
        tree.alias("tree"), F.col(id_col).cast("bigint").alias("doc_id"), leaf.alias("hash"), changed.alias("changed"),
        F.monotonically_increasing_id().alias("copy")), "leaves")
    numbered = running_before(leaves, ["tree"], F.struct("doc_id", "hash", "copy").asc_nulls_first(), F.lit(1), "idx")
    low = climb(numbered)
    drop_table(leaves)
    subroots = low[-1].select(F.lit(WHOLE).alias("tree"), F.col("tree").alias("group"), F.col("root").alias("hash"),
                              F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))
    subroots = cut_lineage(running_before(subroots, ["tree"], F.col("group").asc(), F.lit(1), "idx"), "subroots")
    high = climb(subroots)
    top = docs.sparkSession.createDataFrame([(WHOLE, 0, [], [], None)], PATHS)
    ends = map_batches(_with_paths(high[0], descend(high, top)), _node_paths, PATHS)
    tops = (ends.drop("tree", "subroot").join(subroots.select("group", "hash", F.col("idx").alias("node")), "node")
                .select(F.col("group").alias("tree"), F.lit(0).cast("bigint").alias("node"), "lefts", "rights",
                        F.lower(F.hex("hash")).alias("subroot")))
    paths = cut_lineage(descend(low, tops), "paths")
    return map_batches(_with_paths(low[0], paths), _versions, PROOFS)
