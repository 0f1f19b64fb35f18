"""Operator 11: Merkle manifest of a dataset, by a rollup of nested structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.plans.ranks import laid_out, placed
from lumivox.plans.scratch import written

#: Children of a node, and the levels that one block holds: 3 to the power of 7 leaves at most.
RUN, DEPTH = 3, 7


def sha(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: each value as ``-`` if null, else its UTF-8 byte count, a colon and itself (integers in decimal)."""
    texts = [v.cast("string") for v in values]
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _joined(nodes: Column) -> Column:
    return F.concat_ws("", F.transform(nodes, lambda k: k["h"]))


def _levels(most: int) -> int:
    levels = 1
    while RUN**levels < most and levels < DEPTH:
        levels += 1
    return levels


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """``tree, members, block, node``: the ranks' digits are grouped away one by one, and each node nests its children.

    One exchange by block serves all the groupings, as each of them has the block among its keys. A node hashes its
    children only where its tree has several nodes on that level; else the only node is handed on.
    """
    digits = [F.floor(F.col("rank") / F.lit(RUN**i)).cast("long") % RUN for i in range(levels)]
    block = F.floor(F.col("rank") / F.lit(RUN**levels)).cast("long")
    rows = nodes.select("tree", "members", block.alias("block"), *[d.alias(f"d{i}") for i, d in enumerate(digits)], "node").repartition("tree", "block")
    for i in range(levels):
        keys = ["tree", "members", "block", *[f"d{j}" for j in range(i + 1, levels)]]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(f"d{i}", "node"))).alias("run"))
        kids = F.transform("run", lambda r: r["node"])
        digest = F.when(F.col("members") > RUN**i, sha(_joined(kids))).otherwise(F.element_at(kids, 1)["h"])
        rows = rows.select(*keys, F.struct(digest.alias("h"), kids.alias("kids")).alias("node"))
    return rows


def _steps(node: Column, levels: int, path: Column, members: Column) -> Column:
    """An array of ``(node, path)`` of all nodes ``levels`` below: a path has the digests to the left and right on each level, lowest first."""
    if not levels:
        return F.array(F.struct(node.alias("node"), path.alias("path")))
    kids = node["kids"]

    def below(kid: Column, i: Column) -> Column:
        step = F.struct(_joined(F.slice(kids, F.lit(1), i)).alias("left"), _joined(F.slice(kids, i + 2, F.lit(RUN))).alias("right"))
        longer = F.when(members > RUN ** (levels - 1), F.concat(F.array(step), path)).otherwise(path)
        return _steps(kid, levels - 1, longer, members)

    return F.flatten(F.transform(kids, below))


_PATH = "array<struct<left: string, right: string>>"


def _proofs(nodes: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """``tree, node, path, subroot, root`` of rows ``tree, members, rank, node``; no tree has over ``most`` members.

    Blocks of trees are written, their digests are the members of the trees a tier up, and what that tier proves of a
    block meets its nested node again by a union and a grouping of two rows, so no join is made and no row is larger than a block.
    ``crown`` proves the roots of the trees in turn.
    """
    levels = _levels(most)
    size = RUN**levels
    blocks = written(_blocks(nodes, levels), "blocks")
    if most > size:
        tier = blocks.select("tree", F.ceil(F.col("members") / F.lit(size)).cast("long").alias("members"), F.col("block").alias("rank"), F.struct(F.col("node.h").alias("h"), "block").alias("node"))
        above = _proofs(tier, -(-most // size), crown).select("tree", F.col("node.block").alias("block"), "path", "subroot", "root")
    elif crown:
        above = crown(blocks.select("tree", F.col("node.h").alias("h"))).withColumn("block", F.lit(0).cast("long"))
    else:
        above = blocks.select("tree", "block", F.array().cast(_PATH).alias("path"), F.col("node.h").alias("subroot"), F.col("node.h").alias("root"))
    met = blocks.unionByName(above, allowMissingColumns=True).groupBy("tree", "block")
    met = met.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("members", "node", "path", "subroot", "root")])
    return met.select("tree", "subroot", "root", F.inline(_steps(F.col("node"), levels, F.col("path"), F.col("members"))))


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("members")).first()[0] or 1


def merkle_proofs(leaves: DataFrame, group_col: str, order_cols: list[str]) -> DataFrame:
    """``leaves`` (with their digest ``leaf``) and each one's ``path``, ``subroot`` and ``root``.

    A group's leaves, by ``order_cols``, are the lowest level of its tree: while several nodes remain, every three
    on end, or what is left at the end, are hashed into one. The groups' roots, in order of the group (null first, texts
    bytewise), have a tree over them likewise. A path holds the siblings' digests (``left`` and ``right``, one after another)
    of every level up to the root; ``folded`` makes a root of them.

    Leaves that agree in ``order_cols`` are in order of their digest, so repeated rows may change places unseen. Null
    order values are first. A group's leaves are ranked over many parts and no task holds more of them than a block.
    Extra columns pass through; those called leaf, path, subroot or root are the operator's. An empty table gives an empty one.
    """
    own = [c for c in leaves.columns if c != "leaf"]
    rows = leaves.select(F.col(group_col).alias("tree"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)], "leaf", F.struct(*own).alias("own"))
    ranks = placed(written(laid_out(rows, ["tree"], [*[f"o{i}" for i in range(len(order_cols))], "leaf"]), "leaves"), ["tree"], members="members")
    nodes = ranks.select("tree", "members", "rank", F.struct(F.col("leaf").alias("h"), "own").alias("node"))

    def crown(tops: DataFrame) -> DataFrame:
        over = placed(written(laid_out(tops, [], ["tree"]), "roots"), [], members="members")
        named = over.select(F.lit(0).alias("tree"), "members", "rank", F.struct("h", F.col("tree").alias("own")).alias("node"))
        return _proofs(named, _largest(named), None).select(F.col("node.own").alias("tree"), "path", F.col("node.h").alias("subroot"), "root")

    return _proofs(nodes, _largest(nodes), crown).select("node.own.*", F.col("node.h").alias("leaf"), "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path's siblings make."""
    return F.aggregate(path, leaf, lambda h, step: sha(F.concat(step["left"], h, step["right"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, lowest level first, left to right; of nothing where it has none."""
    return sha(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))))
