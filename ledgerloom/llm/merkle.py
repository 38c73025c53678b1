"""Merkle manifests: trees of rows by group, a tree over the groups, proofs, and what a changed row folds to.

A tree of ``n`` leaves has levels of ``ceil(n / 3**level)`` nodes; every three neighbours, the last run
perhaps fewer, have the hash of their digests as parent. Its nodes form an append log in postorder:
a node is written as soon as its children are, so the place of every node follows from ``n`` alone.

Builders are aligned: one holds ``3**HEIGHT`` consecutive leaves, a whole subtree, and writes its part of the
log; the roots of builders are the leaves of the next tier. A part is one row of bounded size, whatever a
group holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import saved
from ledgerloom.operators.ordered import numbered

ARITY = 3
#: Levels of one builder unless asked otherwise: 3**8 = 6561 leaves, 9841 nodes, 315 kB of digests.
HEIGHT = 8


def digest(*columns: Column) -> Column:
    """SHA-256 as hex text over fields: ``-`` for null, else bytes, ``:`` and the value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def parent(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def height(n: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def size(n: np.ndarray | int, levels: np.ndarray | int):
    """Nodes of a subtree of that many levels above ``n`` leaves."""
    total, width = np.zeros_like(np.asarray(n) + np.asarray(levels)), 1
    for level in range(int(np.max(levels, initial=0)) + 1):
        total = total + np.where(level <= np.asarray(levels), -(-np.asarray(n) // width), 0)
        width *= ARITY
    return total


def place(level: np.ndarray, index: np.ndarray, n: int, top: int) -> np.ndarray:
    """Position in the postorder log of a tree of ``n`` leaves and ``top`` levels of node ``index`` on ``level``.

    Before it stand all subtrees that end where its own begins, and the rest of its own: a subtree of
    ``j`` levels has ended before leaf ``s`` for every whole ``3**j`` in ``s``.
    """
    begin = index * ARITY**level
    done, width = np.zeros_like(begin), 1
    for _ in range(top + 1):
        done = done + begin // width
        width *= ARITY
    return done + size(np.minimum(ARITY**level, n - begin), level) - 1


def append_log(leaves: Iterator[bytes], top: int) -> list[bytes]:
    """Digests in completion order of a subtree of ``top`` levels; open runs are all it remembers."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(top + 1)]

    def complete(node: bytes, level: int) -> None:
        log.append(node)
        if level == top:
            return
        runs[level].append(node)
        if len(runs[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        children, runs[level] = runs[level], []
        complete(parent(children), level + 1)

    for leaf in leaves:
        complete(leaf, 0)
    for level in range(top):
        if runs[level]:
            close(level)
    return log


def siblings(ranks: np.ndarray, n: int, top: int) -> np.ndarray:
    """Log positions of the siblings of leaves ``ranks``, level by level, left to right; -1 where a run has fewer."""
    columns = []
    for level in range(top):
        index, nodes = ranks // ARITY**level, -(-n // ARITY**level)
        first = index // ARITY * ARITY
        for other in range(ARITY - 1):
            at = first + other + (index - first <= other)
            columns.append(np.where(at < nodes, place(np.full_like(at, level), np.minimum(at, nodes - 1), n, top), -1))
    return np.stack(columns, 1) if columns else np.empty((len(ranks), 0), np.int64)


def fold(node: bytes, rank: int, n: int, proof: list[bytes], at: int = 0) -> tuple[bytes, int]:
    """Root of a tree from a leaf and its siblings, which are used up from ``at`` on."""
    while n > 1:
        run = min(ARITY, n - rank // ARITY * ARITY)
        k, others = rank % ARITY, proof[at : at + run - 1]
        node = parent([*others[:k], node, *others[k:]])
        at, rank, n = at + run - 1, rank // ARITY, -(-n // ARITY)
    return node, at


def _by_builder(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of one builder stand together, builders of one group on any tasks."""
    return rows.repartition("tree", "builder").sortWithinPartitions("tree", "builder", *order)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each builder."""
    group, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["builder"]) != key:
                if group:
                    yield group
                group, key = [], (row["tree"], row["builder"])
            group.append(row)
    if group:
        yield group


def _frames(rows: Iterator[tuple], schema: pa.Schema, limit: int = 2000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


_PART = pa.schema([("tree", pa.int64()), ("rank", pa.int64()), ("n", pa.int64()), ("nodes", pa.binary()), ("root", pa.binary())])


def append_parts(leaves: DataFrame, levels: int) -> DataFrame:
    """One tier: ``leaves`` ``(tree, rank, n, leaf)`` become ``(tree, rank, n, nodes, root)``, a row a builder.

    ``nodes`` is the builder's part of the log, ``rank`` its number and ``n`` that of builders of the tree. A builder has
    ``levels`` levels, or those of its tree if that has fewer.
    """
    width = ARITY**levels
    rows = leaves.select("tree", "rank", "n", "leaf", F.expr(f"rank div {width}").alias("builder"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for group in _grouped(batches):
                n = group[0]["n"]
                log = append_log((r["leaf"] for r in group), min(height(n), levels))
                yield group[0]["tree"], group[0]["builder"], -(-n // width), b"".join(log), log[-1]

        yield from _frames(parts(), _PART)

    return _by_builder(rows, "rank").mapInArrow(run, "tree bigint, rank bigint, n bigint, nodes binary, root binary")


def tiers(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Parts of all logs, tier by tier, until every tree has one builder; each tier is written once."""
    out = []
    while True:
        part = saved(append_parts(leaves, levels))
        out.append(part)
        if not (part.agg(F.max("n")).first()[0] or 0) > 1:
            return out
        # a tree of one builder is complete and goes no further
        leaves = part.where("n > 1").select("tree", "rank", "n", F.col("root").alias("leaf"))


def prove(members: DataFrame, parts: DataFrame, above: DataFrame | None, levels: int) -> DataFrame:
    """``members`` ``(tree, rank, n, ...)`` with ``path``: digests of their siblings up to the root of their tree.

    ``above`` has ``(tree, rank, path)`` of the builders in their own tier, null where a builder is the whole tree.
    A part of the log meets the members of its builder in one task; their siblings are addressed in it by position.
    """
    width = ARITY**levels
    others = [c for c in members.columns if c not in ("tree", "rank", "n")]
    logs = parts.select("tree", F.col("rank").alias("builder"), "nodes")
    if above is None:
        logs = logs.withColumn("path", F.lit(b""))
    else:
        up = above.select(F.col("tree").alias("_tree"), F.col("rank").alias("_rank"), "path")
        logs = logs.join(up, (F.col("tree") == F.col("_tree")) & (F.col("builder") == F.col("_rank")), "left").drop("_tree", "_rank")
        logs = logs.withColumn("path", F.coalesce("path", F.lit(b"")))
    rows = members.select("*", F.expr(f"rank div {width}").alias("builder")).unionByName(logs.withColumn("rank", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    # a log part has rank -1, so it comes before the members of its builder
    rows = _by_builder(rows, "rank")
    kept = [f for f in rows.schema if f.name in ("tree", "rank", "n", *others)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", path binary"
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tail, key = b"", b"", None
        for batch in batches:
            trees, builders = batch.column("tree").to_numpy(zero_copy_only=False), batch.column("builder").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((trees[1:] != trees[:-1]) | (builders[1:] != builders[:-1])) + 1
            for at, to in zip([0, *cuts], [*cuts, len(batch)]):
                if ranks[at] < 0:
                    key = (trees[at], builders[at])
                    nodes, tail = batch.column("nodes")[at].as_py(), batch.column("path")[at].as_py()
                    at += 1
                if at == to:
                    continue
                if key != (trees[at], builders[at]):
                    raise ValueError("members without a part of the log")
                n = batch.column("n")[at].as_py()
                inside = ranks[at:to] - builders[at] * width
                addresses = siblings(inside, min(width, n - builders[at] * width), min(height(n), levels))
                paths = [b"".join(nodes[32 * p : 32 * p + 32] for p in row if p >= 0) + tail for row in addresses.tolist()]
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(paths, pa.binary())], [*names, "path"])

    return rows.mapInArrow(run, schema)


def _proved(members: DataFrame, built: list[DataFrame], levels: int) -> DataFrame:
    """``members`` of the first tier with their whole path, from the last tier down."""
    above = None
    for below, part in reversed(list(zip(built, built[1:]))):
        above = prove(below.where("n > 1").select("tree", "rank", "n"), part, above, levels)
    return prove(members, built[0], above, levels)


def manifest(docs: DataFrame, group_col: str, id_col: str, leaf: Column, levels: int = HEIGHT, **others: Column) -> tuple[DataFrame, DataFrame]:
    """Log and proofs of a table: ``(parts, proofs)``.

    A group, a null one included, is a tree over the digests ``leaf`` (hex) of its rows by ascending id, nulls first, ties by digest;
    groups, null first, then bytewise, are the leaves of the top tree. ``parts`` has a row ``(tree, tier, rank, n, nodes,
    root)`` for every builder, tree -1 being the top one. ``proofs`` has a row for every row of ``docs``:
    ``(group, id, leaf, subroot, root, rank, n, tree, trees, path)`` and the columns ``others``; ``path`` holds the
    sibling digests from leaf to root, 32 bytes each. A builder holds ``3**levels`` leaves. Rows equal in all of this stay; an empty table
    gives no rows. Only digests and ids are shuffled, not the columns they were made of.
    """
    slim = docs.select(
        docs[group_col].cast("string").alias("group"), docs[id_col].alias("id"), F.unhex(leaf).alias("leaf"), *[v.alias(k) for k, v in others.items()]
    )
    slim = saved(slim)
    groups = slim.select("group").distinct()
    trees = saved(numbered(groups, [], [F.col("group")], "tree", "trees").withColumn("tree", F.col("tree") - 1))
    ranked = numbered(slim, ["group"], [F.col("id"), F.col("leaf")], "rank", "n").withColumn("rank", F.col("rank") - 1)
    named = trees.withColumnRenamed("group", "_group")
    members = saved(ranked.join(named, F.col("group").eqNullSafe(F.col("_group"))).drop("_group"))

    built = tiers(members.select("tree", "rank", "n", "leaf"), levels)
    subroots = built[0].where("n = 1").select("tree", "root")
    for part in built[1:]:
        subroots = subroots.unionByName(part.where("n = 1").select("tree", "root"))
    # subroots are the leaves of the top tree, number -1
    tops = saved(subroots.join(trees.select("tree", "trees"), "tree").select(
        F.lit(-1).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.col("trees").alias("n"), F.col("root").alias("leaf"),
    ))
    over = tiers(tops, levels)
    root = over[-1].where("n = 1").agg(F.max("root")).scalar()
    top = _proved(tops, over, levels).select(F.col("rank").alias("_tree"), F.col("leaf").alias("subroot"), F.col("path").alias("_tail"))
    below = _proved(members, built, levels)
    proofs = below.join(top, F.col("tree") == F.col("_tree")).select(
        "group", "id", "leaf", "subroot", root.alias("root"), "rank", "n", "tree", "trees", F.concat("path", "_tail").alias("path"), *others,
    )
    parts = [p.select("tree", F.lit(t).alias("tier"), "rank", "n", "nodes", "root") for trees_ in (built, over) for t, p in enumerate(trees_)]
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    return log, proofs


def folded(proofs: DataFrame, leaf_col: str, name: str = "folded") -> DataFrame:
    """``proofs`` with the root that ``leaf_col`` (32 bytes) and the path of its row give."""
    kept = ["leaf_", "rank", "n", "tree", "trees", "path"]
    rows = proofs.withColumn("leaf_", F.col(leaf_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema) + f", `{name}` binary"
    names = proofs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for leaf, rank, n, tree, trees, path in zip(*[batch.column(c).to_pylist() for c in kept]):
                proof = [path[i : i + 32] for i in range(0, len(path), 32)]
                node, used = fold(leaf, rank, n, proof)
                node, used = fold(node, tree, trees, proof, used)
                roots.append(node if used == len(proof) else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(roots, pa.binary())], [*names, name])

    return rows.mapInArrow(run, schema)
