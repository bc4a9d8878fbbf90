"""Merkle tree over rows, one subtree per group, with a proof for every row.

Superblocks of consecutive leaves are reduced on their own, then superblocks of their tops,
and so on up to one root. On the way back down, the nodes of each superblock and what is
needed from outside of it are cogrouped, and one call finishes the local reduction, joins
the proofs and folds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import stored

# Levels of the tree in one superblock, which then holds up to 2^LEVELS nodes.
LEVELS = 12
# Every row whose id's CRC32 divides by this is folded from a changed leaf.
TAMPER_MODULUS = 7
DIGEST_CHARS = 64

NODES = "grp string, block long, place long, digest string"
# The way from the top of a superblock to the root: per level a side and a digest (none: "-").
OUTER = "grp string, block long, path string, subroot string, root string"
PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def node(digests: str) -> str:
    return hashlib.sha256(digests.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    length = F.octet_length(text).cast("string")
    return F.coalesce(F.concat(length, F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column) -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.sha2(F.concat(*map(_field, fields)), 256)


def reduced(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from ``digests`` to those ``levels`` above."""
    rows = [digests]
    for _ in range(levels):
        below = rows[-1]
        rows.append([node("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return rows


def path_of(rows: list[list[str]], place: int) -> str:
    """Side and digest of the sibling at each level but the last; "-" where there is none."""
    steps = []
    for row in rows[:-1]:
        other = place ^ 1
        steps.append(("<" if other < place else ">") + row[other] if other < len(row) else "-")
        place >>= 1
    return "".join(steps)


def steps_of(path: str) -> list[tuple[str, str]]:
    steps, at = [], 0
    while at < len(path):
        side = path[at]
        end = at + 1 + (0 if side == "-" else DIGEST_CHARS)
        steps.append((side, path[at + 1 : end]))
        at = end
    return steps


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    for side, other in steps:
        digest = node(other + digest if side == "<" else digest + other)
    return digest


def _height(n: int) -> int:
    return max(0, (n - 1).bit_length())


@dataclass(frozen=True)
class MerkleTree:
    """Roots and proofs of a tree whose superblocks hold 2^``levels`` nodes."""

    levels: int = LEVELS

    def _blocked(self, nodes: DataFrame) -> DataFrame:
        """Nodes (grp, pos, n, digest) with their superblock and their place in it."""
        size = 1 << self.levels
        block = F.floor(F.col("pos") / F.lit(size)).cast("long")
        return nodes.withColumn("block", block).withColumn("place", F.col("pos") - block * size)

    def _local_levels(self, n: int) -> int:
        """Levels inside a superblock of a group of ``n`` nodes: a lone one ends at its root."""
        return min(self.levels, _height(n))

    def _tops(self, nodes: DataFrame) -> DataFrame:
        """The node on top of each superblock, as nodes of the tree above."""
        local = self._local_levels

        def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place")
            n = int(rows["n"].iloc[0])
            digest = reduced(list(rows["digest"]), local(n))[-1][0]
            above = -(-n >> self.levels) if n > 1 << self.levels else 1
            return pd.DataFrame(
                {"grp": [key[0]], "pos": [key[1]], "n": [above], "digest": [digest]}
            )

        slim = nodes.select("grp", "block", "place", "n", "digest")
        return stored(
            slim.groupBy("grp", "block").applyInPandas(
                top, "grp string, pos long, n long, digest string"
            )
        )

    def _outer_of(self, nodes: DataFrame, outer: DataFrame) -> DataFrame:
        """What each of the nodes, as the top of a superblock below, needs from outside."""

        def exchange(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place")
            n = int(rows["n"].iloc[0])
            levels = reduced(list(rows["digest"]), self._local_levels(n))
            path, subroot, root = above[["path", "subroot", "root"]].iloc[0]
            return pd.DataFrame(
                {
                    "grp": rows["grp"],
                    "block": rows["pos"],
                    "path": [path_of(levels, p) + path for p in range(len(rows))],
                    "subroot": subroot,
                    "root": root,
                }
            )

        slim = nodes.select("grp", "block", "place", "pos", "n", "digest")
        return stored(self._cogrouped(slim, outer, exchange, OUTER))

    @staticmethod
    def _cogrouped(nodes: DataFrame, outer: DataFrame, how: Callable, schema: str) -> DataFrame:
        keys = ["grp", "block"]
        return nodes.groupBy(*keys).cogroup(outer.groupBy(*keys)).applyInPandas(how, schema)

    def _roots(self, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """The nodes of each tree of superblocks, and the one node left of each group."""
        trees = []
        while True:
            nodes = self._blocked(nodes)
            trees.append(nodes)
            nodes = self._tops(nodes)
            if nodes.where("n > 1").isEmpty():
                return trees, nodes

    def _descend(self, trees: list[DataFrame], outer: DataFrame) -> DataFrame:
        """From what the groups' roots need from outside to what the lowest superblocks need."""
        for nodes in reversed(trees[1:]):
            outer = self._outer_of(nodes, outer)
        return outer

    def proofs(self, leaves: DataFrame) -> DataFrame:
        """Proofs of numbered leaves (grp, pos, n, doc_id, digest, tampered)."""
        trees, subroots = self._roots(leaves)
        # The groups' roots are the leaves of a last tree, in order of the groups.
        groups = subroots.select(F.col("grp").alias("of"), "digest")
        groups = stored(numbered(groups.withColumn("grp", F.lit("all")), ["of"]))
        top_trees, root = self._roots(groups.select("grp", "pos", "n", "digest", "of"))
        none = root.select(
            "grp", F.lit(0).cast("long").alias("block"), F.lit("").alias("path"),
            F.lit("").alias("subroot"), F.col("digest").alias("root"),
        )
        outer = self._descend(top_trees, none)
        outer = self._outer_of(top_trees[0], outer).select(F.col("block").alias("pos"), "path", "root")
        named = groups.select("pos", F.col("of").alias("grp"), F.col("digest").alias("subroot"))
        outer = named.join(outer, "pos").select(
            "grp", F.lit(0).cast("long").alias("block"), "path", "subroot", "root"
        )
        outer = self._descend(trees, stored(outer))

        def prove(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place")
            n = int(rows["n"].iloc[0])
            path, subroot, root = above[["path", "subroot", "root"]].iloc[0]
            levels = reduced(list(rows["digest"]), self._local_levels(n))
            outside = steps_of(path)
            others = "".join(digest for _, digest in outside)
            # All unchanged leaves fold to the same top, and go on alike from there.
            own_top = levels[-1][0]
            from_own_top = fold(own_top, outside)
            proofs, folded = [], []
            for place, (digest, tampered) in enumerate(
                zip(rows["digest"], rows["tampered"], strict=True)
            ):
                inside = steps_of(path_of(levels, place))
                proofs.append(node("".join(d for _, d in inside) + others))
                top = fold(tampered if isinstance(tampered, str) else digest, inside)
                folded.append(from_own_top if top == own_top else fold(top, outside))
            return pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "leaf": rows["digest"],
                    "subroot": subroot,
                    "root": root,
                    "proof_sha256": proofs,
                    "folded_root": folded,
                    "verified": [x == root for x in folded],
                }
            )

        # As text, because pandas has no whole numbers beside nulls.
        slim = trees[0].withColumn("doc_id", F.col("doc_id").cast("string"))
        slim = slim.select("grp", "block", "place", "n", "doc_id", "digest", "tampered")
        proofs = self._cogrouped(slim, outer, prove, PROOFS.replace("doc_id long", "doc_id string"))
        return proofs.withColumn("doc_id", F.col("doc_id").cast("long"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, from 0 in each ``grp`` by ``order``, and ``n``, the rows of the group.

    The rows are dealt by range, and a row's number is its place in its range after the
    rows of the ranges before. ``order`` must leave no ties, so that no range is too large.
    """
    ranged = rows.repartitionByRange("grp", *order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged)
    counts = ranged.groupBy("grp", "part").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(
        counts.select(
            "grp", "part",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
            F.sum("rows").over(whole).alias("n"),
        )
    )
    inside = Window.partitionBy("grp", "part").orderBy(*order)
    placed = ranged.withColumn("place", F.row_number().over(inside))
    placed = placed.join(counts, ["grp", "part"])
    return placed.withColumn("pos", F.col("before") + F.col("place") - 1).drop(
        "part", "place", "before"
    )


def manifest(docs: DataFrame, tree: MerkleTree | None = None) -> DataFrame:
    """Leaf, subroot of its language, root, proof and check of every row of ``docs``.

    A leaf is the digest of doc_id, source, lang, n_chars and text, each as its length in
    bytes and its value, or "-" where it is null. Leaves of a language are in order of
    doc_id, a null one first; rows of one doc_id are in order of their leaves, and rows that
    repeat each other have a leaf each. Two neighbours make a node, one left over makes
    a node alone. Languages are in bytewise order, null first, an empty one after it.
    ``proof_sha256`` is the digest of all siblings on the way to the root, of nothing for a
    lone row. ``folded_root`` starts from the leaf with one more in n_chars where 7 divides
    the CRC32 of doc_id, else from the leaf; rows without a doc_id or n_chars are folded
    unchanged. Other columns are ignored, texts of any length are hashed
    where they are, and an empty table gives an empty result.
    """
    tree = tree or MerkleTree()
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MODULUS == 0
    changed = leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("grp"),
        "doc_id",
        leaf_digest(F.col("n_chars")).alias("digest"),
        F.when(tampers, changed).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Equal rows are told apart by their number, which is fixed once they are written.
    leaves = stored(leaves)
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], PROOFS)
    return tree.proofs(stored(numbered(leaves, ["doc_id", "digest", "row"])))
