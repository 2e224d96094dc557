"""A Merkle manifest of a dataset: a tree of every group of rows, a tree of the groups, and a proof of every row.

A row is a leaf, the SHA-256 of its columns. Leaves of a group ascend by key; while several nodes remain, each run of FAN consecutive
ones becomes a node, the last run with fewer. What remains is the group's root; the groups' roots, in order of the group, likewise give the root
of all. A proof of a row holds the siblings of its path from the leaf to the root.

Nodes get their places from running sums over ranges, so no task holds a group. A block is FAN ** LEVELS consecutive
nodes of a tree, aligned to its start. Executors take some blocks at a time, as Arrow tables of about SIZE rows, into DuckDB, which climbs LEVELS levels by
ordered string_agg and sha256. Spark brings the blocks' roots together as the nodes of the next stage, of which there are
as many as the logarithm of the largest group. Then, from the last stage to the first, each block's outer path is joined to it and
DuckDB extends it to the block's nodes; at the leaves it hashes the proofs and folds them. Digests are text of 64 lowercase hex digits.

Defined results: in a leaf, a null column is ``-``; null keys come first in a group, equal keys by leaf; rows that are repeated are leaves of their own, in any
order, since they are alike; a null group is a group of its own, before all others; groups go by the bytes of their UTF-8; a lone leaf is its group's root, a lone group's
root the root; then the proof is of no digests; an empty table gives an empty result; columns other than those named take no part and don't
come back.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import order
from .shared import stored

FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
#: Nodes that DuckDB takes at a time, on average.
SIZE = 4096
PATH = "array<struct<l:string,r:string>>"


def field(column: Column) -> Column:
    """A column's part of a leaf: its UTF-8 byte count and value, or ``-``."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def height(nodes: str) -> str:
    """SQL for the levels that a block climbs of a tree of so many nodes."""
    cases = " ".join(f"WHEN {nodes} <= {FAN**k} THEN {k}" for k in range(LEVELS))
    return f"CASE {cases} ELSE {LEVELS} END"


def engine():
    """A DuckDB connection of this process, for one task's share of memory and one thread."""
    global _engine
    if _engine is None:
        import duckdb

        _engine = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    return _engine


_engine = None

#: Tables of a block's levels: n0 are its nodes; level k + 1 has a node for each run of level k, and r<k> the runs' digests in a row.
CLIMB = [f"CREATE OR REPLACE TEMP TABLE n0 AS SELECT tree, place // {BLOCK} AS block, place, nodes, h, {height('nodes')} AS height FROM given"] + [
    x
    for k in range(LEVELS)
    for x in (
        f"CREATE OR REPLACE TEMP TABLE r{k} AS SELECT tree, block, any_value(nodes) AS nodes, place // {FAN} AS run, any_value(height) AS height, string_agg(h, '' ORDER BY place) AS digests FROM n{k} WHERE height > {k} GROUP BY tree, block, place // {FAN}",
        f"CREATE OR REPLACE TEMP TABLE n{k + 1} AS SELECT tree, block, run AS place, nodes, sha256(digests) AS h, height FROM r{k}",
    )
]
TOPS = " UNION ALL ".join(f"SELECT tree, block AS place, (nodes + {BLOCK - 1}) // {BLOCK} AS nodes, h FROM n{k} WHERE height = {k}" for k in range(LEVELS + 1))


def _siblings() -> str:
    """SQL for the nodes with their siblings of each level within the block, to the left and to the right; null above its height."""
    at = [f"64 * (n0.place // {FAN**k} % {FAN})" for k in range(LEVELS)]
    sides = [f"substr(r{k}.digests, 1, {x}) AS left{k}, substr(r{k}.digests, {x} + 65) AS right{k}" for k, x in enumerate(at)]
    joins = [f"LEFT JOIN r{k} ON r{k}.tree = n0.tree AND r{k}.run = n0.place // {FAN ** (k + 1)}" for k in range(LEVELS)]
    return f"SELECT n0.*, path, {', '.join(sides)} FROM n0 JOIN outside o ON o.tree = n0.tree AND o.block = n0.block {' '.join(joins)}"


def _run(steps: list[str], **tables: pa.Table) -> pa.Table:
    """What the last of the statements returns, which see the tables by their names."""
    con = engine()
    for name, rows in tables.items():
        con.register(name, rows)
    try:
        for step in steps[:-1]:
            con.execute(step)
        return con.sql(steps[-1]).to_arrow_table()
    finally:
        for name in tables:
            con.unregister(name)


SIDES = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def block_roots(given: pa.Table) -> pa.Table:
    """(tree, place, nodes, h) of whole blocks' roots; place and nodes are those of the next stage."""
    return _run([*CLIMB, TOPS], given=given).cast(pa.schema([("tree", pa.string()), ("place", pa.int64()), ("nodes", pa.int64()), ("h", pa.string())]))


def block_paths(given: pa.Table, outside: pa.Table) -> pa.Table:
    """(tree, place, path) of the nodes of whole blocks. outside: (tree, block, path) of the blocks."""
    own = ", ".join(f"CASE WHEN height > {k} THEN {{'l': left{k}, 'r': right{k}}} END" for k in range(LEVELS))
    found = f"SELECT tree, place, list_concat(list_filter([{own}], lambda x: x IS NOT NULL), path) AS path FROM ({_siblings()})"
    return _run([*CLIMB, found], given=given, outside=outside).cast(pa.schema([("tree", pa.string()), ("place", pa.int64()), ("path", SIDES)]))


def block_proofs(given: pa.Table, outside: pa.Table) -> pa.Table:
    """(tree, key, leaf, proof_sha256, folded) of the leaves of whole blocks. given: also key, and the leaf to fold as ``other``."""
    import pyarrow.compute as pc

    longest = pc.max(pc.list_value_length(outside["path"])).as_py() or 0
    proof = " || ".join(f"coalesce(left{k} || right{k}, '')" for k in range(LEVELS))
    own = "tree, key, leaf, path, proof_sha256"
    steps = f"SELECT s.*, key, s.h AS leaf, other AS f, sha256({proof} || coalesce(array_to_string(list_transform(path, lambda x: x.l || x.r), ''), '')) AS proof_sha256 FROM ({_siblings()}) s JOIN given g ON g.tree = s.tree AND g.place = s.place"
    for k in range(LEVELS):
        rest = "".join(f", left{j}, right{j}" for j in range(k + 1, LEVELS))
        steps = f"SELECT {own}{rest}, CASE WHEN height > {k} THEN sha256(left{k} || f || right{k}) ELSE f END AS f, height FROM ({steps})"
    for k in range(1, longest + 1):
        steps = f"SELECT {own}, CASE WHEN len(path) >= {k} THEN sha256(path[{k}].l || f || path[{k}].r) ELSE f END AS f FROM ({steps})"
    out = _run([*CLIMB, f"SELECT tree, key, leaf, proof_sha256, f AS folded FROM ({steps})"], given=given, outside=outside)
    return out.cast(pa.schema([("tree", pa.string()), ("key", given.schema.field("key").type), *((n, pa.string()) for n in ("leaf", "proof_sha256", "folded"))]))


NODE = ["tree", "place", "nodes", "h"]


#: Groups, of at most some 200 bytes, that are broadcast; more are shuffled.
FEW = 50_000


def portion(block: Column, nodes: int) -> Column:
    """Which of the portions that DuckDB takes a block of a tree is in, by the nodes of all trees."""
    return F.pmod(F.xxhash64("tree", block), F.lit(max(1, -(-nodes // SIZE)))).alias("portion")


def of_blocks(run: Callable, nodes: DataFrame, columns: list[str], count: int, schema: str, outside: DataFrame | None = None) -> DataFrame:
    """What ``run`` makes of the nodes, whole blocks at a time, and of what lies outside of those blocks, if given."""
    own = nodes.select(*columns, portion(F.floor(F.col("place") / BLOCK), count)).groupBy("portion")
    if outside is None:
        return own.applyInArrow(lambda rows: run(rows.drop_columns(["portion"])), schema)
    other = outside.select("tree", "block", "path", portion(F.col("block"), count)).groupBy("portion")
    return own.cogroup(other).applyInArrow(lambda rows, around: run(rows.drop_columns(["portion"]), around.drop_columns(["portion"])), schema)


def climb(nodes: DataFrame, count: int, store: Callable = stored) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The stages, (nodes, how many), from the given ones (tree, place, nodes, h) up, and (tree, stage, h): each tree's root, and the last stage with nodes of it."""
    stages, tops = [], None
    while count:
        up = store(of_blocks(block_roots, nodes, NODE, count, "tree string, place long, nodes long, h string"), "nodes")
        done = up.where("nodes = 1").select("tree", F.lit(len(stages)).alias("stage"), "h")
        stages.append((nodes, count))
        tops = done if tops is None else tops.union(done)
        nodes = up.where("nodes > 1")
        count = nodes.count()
    return stages, tops


def descend(stages: list[tuple[DataFrame, int]], tops: DataFrame, store: Callable = stored) -> DataFrame:
    """(tree, block, path) of the blocks of the first stage. tops: (tree, stage, path) of the trees, the path from a tree's root on."""
    blocks = None
    for k in reversed(range(len(stages))):
        top = tops.where(F.col("stage") == k).select("tree", F.lit(0).cast("long").alias("block"), "path")
        blocks = top if blocks is None else top.union(blocks)
        if k:  # a node of this stage is the root of a block of the one below
            blocks = extended(*stages[k], blocks, store).withColumnRenamed("place", "block")
    return blocks


def extended(nodes: DataFrame, count: int, blocks: DataFrame, store: Callable = stored) -> DataFrame:
    """(tree, place, path) of a stage's nodes, from the paths of their blocks."""
    return store(of_blocks(block_paths, nodes, NODE, count, f"tree string, place long, path {PATH}", blocks), "paths")


def manifest(documents: DataFrame, columns: list[str], group: str, key: str, changed: dict[str, Column] | None = None, when: Column | None = None, store: Callable = stored) -> DataFrame:
    """(key, group, leaf, subroot, root, proof_sha256, folded_root) of each row. columns: those that a leaf is of, in order. changed: what columns are after tampering,
    in rows where ``when`` holds; folded_root is recomputed from such a row's changed leaf, or else its own, and its siblings as they were."""
    plain = leaf(*[F.col(c) for c in columns])
    other = plain if when is None else F.when(when, leaf(*[(changed or {}).get(c, F.col(c)) for c in columns])).otherwise(plain)
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # sorts as groups do, null first
    leaves = store(documents.select(name.alias("tree"), F.col(key).alias("key"), plain.alias("leaf"), other.alias("other"), F.spark_partition_id().alias("task")), "leaves")
    # Rows that are alike share a row for each task that they came from.
    alike = leaves.groupBy("tree", F.struct("key", "leaf", "other", "task").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    sizes = store(alike.groupBy("tree").agg(F.sum("n").alias("nodes")), "groups")
    groups, count = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("nodes"), F.lit(0))).first()
    small = F.broadcast if groups <= FEW else lambda df: df
    first = order.running(alike, "o", {"first": "n"}, ["tree"])
    places = first.select("tree", "o", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("place")).join(small(sizes), "tree")
    placed = store(places.select("tree", "place", "nodes", F.col("o.leaf").alias("h"), F.col("o.key").alias("key"), F.col("o.other").alias("other")), "places")
    out = [F.col("key").alias(key), F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias(group), "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root")]
    if not count:
        return placed.withColumns({c: F.col("h") for c in ("leaf", "subroot", "root", "proof_sha256", "folded")}).select(*out)
    stages, tops = climb(placed, count, store)
    subroots = store(order.running(tops.withColumn("one", F.lit(1).cast("long")), "tree", {"place": "one"}), "subroots")
    outer, last = climb(subroots.select(F.lit("").alias("tree"), "place", F.lit(groups).cast("long").alias("nodes"), "h"), groups, store)
    around = descend(outer, last.select("tree", "stage", F.array().cast(PATH).alias("path")), store)
    paths = extended(*outer[0], around, store).select("place", "path").join(subroots, "place")
    blocks = descend(stages, paths.select("tree", "stage", "path"), store)
    kind = placed.schema["key"].dataType.simpleString()
    proofs = of_blocks(block_proofs, placed, [*NODE, "key", "other"], count, f"tree string, key {kind}, leaf string, proof_sha256 string, folded string", blocks)
    whole = proofs.join(small(subroots.select("tree", F.col("h").alias("subroot"))), "tree").withColumn("root", F.lit(last.first()["h"]))
    return whole.select(*out)
