"""Merkle manifest of a dataset: a tree of each group's rows, a tree of the groups, and multiproofs of rows.

A digest is SHA-256; a node's is that of its children's digests as lower-case hex text, one after the other. The
proof of many rows is an octopus: the rows of an aligned block of places name the fewest nodes that they can't
derive themselves, these are fetched once for the block, and from them and the rows all inner nodes follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdantflow.llm.components import join_counted
from verdantflow.llm.places import placed, runs
from verdantflow.llm.shared import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FOLD = 10  # levels of a tree that one task derives from a block of 2^FOLD nodes
TOP = -1  # the tree of the groups
_NODE = "tree long, level int, place long, width long, digest binary"


@dataclass(frozen=True)
class Manifest:
    """``leaves``: ``id, tree, place, total, digest, claim``; ``nodes``: ``tree, level, place, width, digest``, width being that of the level; ``root`` as hex, None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 as hex of the values in order: ``-`` for a null, else the number of its UTF-8 bytes, ``:`` and the value as text."""

    def told(x: Column) -> Column:
        s = x.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*map(told, values)), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _parents(row: list[str]) -> list[str]:
    return [_hash("".join(row[i : i + 2])) for i in range(0, len(row), 2)]


def _fold(batches: Iterator[pa.RecordBatch], fold: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the next levels (up to ``fold`` of them, or to the top) over each block of ``tree, level, place, width, digest``."""
    schema = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("width", pa.int64()), ("digest", pa.binary())])
    for (tree, block, level, width), rows in runs(batches, ["tree", "block", "level", "width"]):
        row, at = [x.hex() for x in rows.column("digest").to_pylist()], block << fold
        for k in range(1, fold + 1):
            if width == 1:
                break
            row, at, width = _parents(row), at >> 1, (width + 1) // 2
            n = len(row)
            yield pa.RecordBatch.from_arrays([pa.array([tree] * n), pa.array([level + k] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array([width] * n), pa.array([bytes.fromhex(x) for x in row])], schema=schema)


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees over ``tree, place, total, digest``, leaves at level 0; FOLD levels a round, each block of them in a task of its own."""
    rows = leaves.select("tree", F.lit(0).alias("level"), "place", F.col("total").alias("width"), "digest")
    every, level, widest = rows, 0, leaves.agg(F.max("total")).first()[0] or 0
    fold = FOLD
    while widest > 1:
        blocks = rows.filter("width > 1").withColumn("block", F.shiftright("place", fold))
        made = written(blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").mapInArrow(lambda b: _fold(b, fold), _NODE), "nodes")
        every, level, widest = every.unionByName(made), level + fold, -(-widest >> fold)
        rows = made.filter(F.col("level") == level)
    return every


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", order_col: str = "doc_id", claims: dict[str, Column] | None = None) -> Manifest:
    """The manifest of all rows of ``docs``, each a leaf: a binary tree for each value of ``group_col``, and one of their roots.

    Leaves of a group ascend by ``order_col``, nulls first, rows that repeat it by digest. Groups ascend as UTF-8
    bytes, null first. An odd last node becomes its own parent's only child; a lone leaf is its group's root.
    ``claims`` replaces columns in a second digest of each row, ``claim``: what someone says that the row is.
    Texts are read once and whole; only digests are shuffled. Other columns of ``docs`` play no part.
    """
    order = docs[order_col]
    group = F.when(docs[group_col].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), docs[group_col].cast("string")))
    told = [(claims or {}).get(c, docs[c]) for c in fields]
    digest, claim = (F.unhex(leaf_digest(x)) for x in ([docs[c] for c in fields], told))
    leaves = written(docs.select(order.alias("id"), group.alias("group"), digest.alias("digest"), claim.alias("claim")), "leaves")
    rows = written(placed(leaves, ["group"], ["id", "digest"]), "placed")
    groups = written(rows.filter("place = 0").select("group", F.col("total").alias("size")), "groups")
    numbered = written(placed(groups, [], ["group"]).select("group", "size", F.col("place").alias("tree"), F.col("total").alias("groups")), "numbered")
    rows = written(join_counted(rows, numbered, ["group"], "size").select("id", "tree", "place", "total", "groups", "digest", "claim"), "rows")
    nodes = tree_nodes(rows)
    tops = nodes.filter("width = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest")
    counted = written(tops.withColumn("total", F.lit(numbered.count()).cast("long")), "tops")
    nodes = nodes.unionByName(tree_nodes(counted))
    top = nodes.filter((F.col("tree") == TOP) & (F.col("width") == 1)).first()
    return Manifest(rows, nodes, top and bytes(top["digest"]).hex())


def _missing(places: list[int], width: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the fewest nodes that, with the leaves at ``places``, give the root of a tree of ``width`` leaves."""
    known, level = sorted(set(places)), 0
    while width > 1:
        have = set(known)
        for x in known:
            if x ^ 1 < width and x ^ 1 not in have:
                yield level, x ^ 1
        known, width, level = sorted({x >> 1 for x in known}), (width + 1) // 2, level + 1


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coordinates that each block of rows has to fetch: ``tree, block, of, level, place``."""
    names = ["tree", "block", "of", "level", "place"]
    for (tree, block, total, groups), rows in runs(batches, ["tree", "block", "total", "groups"]):
        found = [(tree, block, tree, *x) for x in _missing(rows.column("place").to_pylist(), total)]
        found += [(tree, block, TOP, *x) for x in _missing([tree], groups)]
        if found:
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 3 else pa.int64()) for k, c in enumerate(columns)], names=names)


def _siblings(place: int, width: int, nodes: list[dict[int, str]]) -> Iterator[tuple[int, str]]:
    """Place of each node from a leaf up and its sibling's digest (empty if it has none), below the root."""
    for level in nodes:
        if width == 1:
            return
        yield place, level[place ^ 1] if place ^ 1 < width else ""
        place, width = place >> 1, (width + 1) // 2


def _derived(known: dict[tuple[int, int], str], leaves: dict[int, str], width: int) -> list[dict[int, str]]:
    """Nodes of each level up to the root, by place, from the leaves and the fetched nodes."""
    levels, level, own = [], 0, dict(leaves)
    while True:
        own |= {p: d for (at, p), d in known.items() if at == level}
        levels.append(own)
        if width == 1:
            return levels
        above = {x >> 1 for x in own}
        own = {p: _hash(own[2 * p] + (own[2 * p + 1] if 2 * p + 1 < width else "")) for p in above}
        width, level = (width + 1) // 2, level + 1


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A proof for each row of a block, folded from what is claimed."""
    for (tree, _), rows in runs(batches, ["tree", "block"]):
        table = rows.to_pydict()
        own, top, leaves = {}, {}, []
        for k, of in enumerate(table["of"]):
            if of is None:
                leaves.append(k)
            else:
                (top if of == TOP else own)[table["level"][k], table["place"][k]] = table["digest"][k].hex()
        total, groups = table["total"][leaves[0]], table["groups"][leaves[0]]
        levels = _derived(own, {table["place"][k]: table["digest"][k].hex() for k in leaves}, total)
        subroot = levels[-1][0]
        upper = _derived(top, {tree: subroot}, groups)
        above = list(_siblings(tree, groups, upper))
        out = {"row": [], "leaf": [], "subroot": [], "proof_sha256": [], "folded_root": []}
        for k in leaves:
            path = [*_siblings(table["place"][k], total, levels), *above]
            digest = table["claim"][k].hex()
            for place, other in path:
                digest = _hash(other + digest if place & 1 else digest + other)
            out["row"].append(table["place"][k])
            out["leaf"].append(table["digest"][k].hex())
            out["subroot"].append(subroot)
            out["proof_sha256"].append(_hash("".join(other for _, other in path)))
            out["folded_root"].append(digest)
        ids = rows.column("id").take(pa.array(leaves))
        yield pa.RecordBatch.from_arrays([ids.combine_chunks(), *(pa.array(out[c]) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))], names=["id", "leaf", "subroot", "proof_sha256", "folded_root"])


def prove(manifest: Manifest, rows: DataFrame | None = None) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of rows of ``manifest.leaves`` (all, or any part of them).

    A proof is the digests of the siblings from the leaf over its group's root to the root; ``proof_sha256`` is
    theirs as one text. ``folded_root`` is computed from the row's ``claim`` and the proof, ``verified`` tells
    whether it is the root. Blocks of 2^FOLD places fetch the nodes that they can't derive; nodes that many
    blocks want are broadcast, as far as they are few. A table without rows has no proofs.
    """
    rows = manifest.leaves if rows is None else rows
    kind = rows.schema["id"].dataType.simpleString()
    blocks = rows.withColumn("block", F.shiftright("place", FOLD))
    sorted_rows = blocks.select("tree", "block", "place", "total", "groups").repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    wanted = written(sorted_rows.mapInArrow(_wanted, "tree long, block long, of long, level int, place long"), "wanted")
    keys = ["of", "level", "place"]
    counted = wanted.groupBy(*keys).agg(F.count("*").alias("often"))
    found = written(counted.join(manifest.nodes.select(F.col("tree").alias("of"), "level", "place", "digest"), keys), "found")
    fetched = join_counted(wanted, found, keys, "often").drop("often")
    none = {c: F.lit(None).cast(t) for c, t in (("of", "long"), ("level", "int"))}
    both = blocks.withColumns(none).unionByName(fetched, allowMissingColumns=True)
    dealt = both.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("of").asc_nulls_last(), "level", "place")
    proofs = dealt.mapInArrow(_expand, f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(manifest.root).cast("string")
    return proofs.select("id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
