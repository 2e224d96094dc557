"""Graph operators as iterated DataFrame joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import with_totals

#: Where a local session names no checkpoint folder, as in tests.
CHECKPOINTS = "/tmp/checkpoints/sentograph"


#: Tables that this process has made and not removed.
_made: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for what is cut from its lineage, which all executors share. A session that is not local has to name it."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (at or CHECKPOINTS).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder, without lineage.

    A checkpoint would keep the size that its plan was estimated at; over the rounds of an iteration such estimates are multiplied, until planning takes longer than
    the work. A table has the size of its files, so what is small is joined as such."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/cut-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> int:
    """Deletes all tables that ``cut`` made in this process, for when results that follow from them are no longer read. Returns how many."""
    from pyarrow import fs

    gone = 0
    while _made:
        at = _made.pop()
        files, path = fs.FileSystem.from_uri(at) if ":" in at else (fs.LocalFileSystem(), at)
        if files.get_file_info(path).type == fs.FileType.Directory:
            files.delete_dir(path)
            gone += 1
    return gone


def connected_components(edges: DataFrame, store: Callable[[DataFrame], DataFrame] = cut, rounds: int = 100) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Each round hooks every node onto its smallest smaller neighbour, finds the roots by pointer jumping, and contracts
    the edges to those between different roots. So dense groups shrink to a node at once, and later rounds and their
    joins are small. All tables are cut from their lineage.
    """
    pair = edges.where("src <> dst")
    edge = store(pair.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    found = None
    for _ in range(rounds):
        if edge.isEmpty():
            break
        up = store(edge.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("root")))
        while True:
            above = up.select(F.col("node").alias("n"), F.col("root").alias("r"))
            jumped = store(up.join(above, up.root == above.n, "left").select("node", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        to = up.select(F.col("node").alias("n"), F.col("root").alias("r"))
        if found is None:
            found = up
        else:
            found = store(found.join(to, found.root == to.n, "left").select("node", F.coalesce("r", "root").alias("root")).union(up))
        half = edge.join(to, edge.src == to.n, "left").select(F.coalesce("r", "src").alias("src"), "dst")
        both = half.join(to, half.dst == to.n, "left").select("src", F.coalesce("r", "dst").alias("dst")).where("src <> dst")
        edge = store(both.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if found is None:
        return edge.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return found.select("node", F.col("root").alias("component")).union(found.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct())


def isolates(nodes: DataFrame, edges: DataFrame, key: str = "ngram") -> DataFrame:
    """Nodes without an edge."""
    ends = edges.select(F.col("src").alias("end")).union(edges.select("dst"))
    return nodes.join(ends, F.col(key) == F.col("end"), "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "ngram") -> DataFrame:
    """(node, degree, centrality): centrality is degree by the number of other nodes, null for a single node."""
    ends = edges.select(F.col("src").alias("end")).union(edges.select("dst")).groupBy("end").agg(F.count(F.lit(1)).alias("d"))
    own = with_totals(nodes.select(F.col(key).alias("node")), F.count(F.lit(1)).alias("all"))
    degree = F.coalesce("d", F.lit(0))
    return own.join(ends, F.col("node") == F.col("end"), "left").select("node", degree.alias("degree"), (degree / F.nullif(F.col("all") - 1, F.lit(0))).alias("centrality"))


def components(nodes: DataFrame, edges: DataFrame, key: str = "ngram", store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, component) of all nodes; an isolate is its own component."""
    found = connected_components(edges.select("src", "dst"), store)
    return nodes.select(F.col(key).alias("n")).join(found, F.col("n") == F.col("node"), "left").select(F.col("n").alias("node"), F.coalesce("component", "n").alias("component"))


def both_ways(edges: DataFrame) -> DataFrame:
    pair = edges.select("src", "dst").where("src <> dst")
    return pair.union(pair.select("dst", "src")).distinct()


def distances(sources: DataFrame, edges: DataFrame, farthest: int | None = None, store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(src, dst, d): shortest path lengths from each source (node) to all that it reaches, itself at 0; with ``farthest``, up to that.

    All sources step outwards together; each step joins the newest pairs with the edges and leaves out pairs that are known.
    """
    step = store(both_ways(edges).select(F.col("src").alias("at"), F.col("dst").alias("to")))
    known = front = store(sources.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("d")).distinct())
    d = 0
    while farthest is None or d < farthest:
        d += 1
        new = front.join(step, front.dst == step.at).select("src", F.col("to").alias("dst")).distinct().join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        front = store(new.withColumn("d", F.lit(d).cast("long")))
        if front.isEmpty():
            break
        known = store(known.union(front))
    return known


def nearest_members(sets: DataFrame, edges: DataFrame, store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(set, at, first, second): for each set (set, node) and each node that it reaches, the distances of its two nearest members; second is null
    if it reaches one only. A member is its own nearest, so second is its distance to another.

    Members step outwards together and a node passes on the two that reach it first, so there are twice as many rows as sets times nodes, not a row
    for each pair of nodes.
    """
    step = store(both_ways(edges).select(F.col("src").alias("from"), F.col("dst").alias("to")))
    known = store(sets.select("set", F.col("node").alias("at"), F.array(F.col("node")).alias("members"), F.array(F.lit(0).cast("long")).alias("ds")).distinct())
    front, d = known.select("set", "at", F.explode("members").alias("member")), 0
    while True:
        d += 1
        reached = front.join(step, F.col("at") == F.col("from")).groupBy("set", "to").agg(F.sort_array(F.collect_set("member")).alias("came"))
        seen = known.select(F.col("set").alias("__set"), F.col("at").alias("__at"), "members", "ds")
        both = reached.join(seen, (F.col("set") == F.col("__set")) & (F.col("to") == F.col("__at")), "left").select(
            "set", F.col("to").alias("at"), F.coalesce("members", F.array().cast(known.schema["members"].dataType)).alias("members"), F.coalesce("ds", F.array().cast("array<bigint>")).alias("ds"), "came")
        new = both.withColumn("new", F.slice(F.array_except("came", "members"), 1, 2)).withColumn("new", F.slice("new", 1, 2 - F.size("members"))).where(F.size("new") > 0)
        new = store(new.select("set", "at", F.concat("members", "new").alias("members"), F.concat("ds", F.transform("new", lambda _: F.lit(d).cast("long"))).alias("ds"), "new"))
        if new.isEmpty():
            break
        known = store(known.join(new.select("set", "at"), ["set", "at"], "left_anti").union(new.drop("new")))
        front = new.select("set", "at", F.explode("new").alias("member"))
    return known.select("set", "at", F.col("ds")[0].alias("first"), F.try_element_at("ds", F.lit(2)).alias("second"))


def reach_penalties(wanting: DataFrame, component: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, far, isolated) for the components of the wanting nodes (node): only their diameters are made."""
    from . import hubs  # which builds on this module

    own = component.join(wanting.join(component, "node").select("component").distinct(), "component", "left_semi")
    own = cut(own)
    return penalties(own, hubs.diameters(own, hubs.distance_labels(own, induced(edges, own), "node")))


def diameters(distance: DataFrame, component: DataFrame) -> DataFrame:
    """(component, size, diameter) of components of two nodes or more."""
    sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    far = distance.join(component, distance.src == component.node).groupBy("component").agg(F.max("d").alias("diameter"))
    return sizes.join(far, "component")


def induced(edges: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    own = nodes.select(F.col(key).alias("__n"))
    return edges.join(own, F.col("src") == F.col("__n"), "left_semi").join(own, F.col("dst") == F.col("__n"), "left_semi")


#: Distances of pairs (src, dst, d), or what finds the nearest targets (set, node) of sources (set, node), as ``hubs.by_labels`` does.
Distances = DataFrame | Callable[[DataFrame, DataFrame], DataFrame]


def nearest(sources: DataFrame, targets: DataFrame, distance: Distances) -> DataFrame:
    """(set, node, d): for each source (set, node) the least distance to a target (set, node) of the set other than itself; null if none is reached."""
    if not isinstance(distance, DataFrame):
        return distance(sources, targets)
    reach = distance.where("d > 0").join(targets.select(F.col("set").alias("s"), F.col("node").alias("dst")), "dst")
    least = reach.groupBy("s", "src").agg(F.min("d").alias("d"))
    return sources.join(least, (F.col("set") == F.col("s")) & (F.col("node") == F.col("src")), "left").select("set", "node", "d")


def mean_nearest(sets: DataFrame, distance: Distances, penalty: DataFrame, fixed: float | None = None) -> DataFrame:
    """(set, mean): mean over a set's nodes of the least distance to another of its nodes.

    penalty: (node, far, isolated) for all nodes; far is the distance of a node that reaches none unless fixed is given.
    An isolate adds nothing.
    """
    found = nearest(sets, sets, distance).join(penalty, "node")
    value = F.when(F.col("isolated"), 0.0).otherwise(F.coalesce(F.col("d").cast("double"), F.col("far").cast("double") if fixed is None else F.lit(float(fixed))))
    return found.groupBy("set").agg((F.sum(value) / F.count(F.lit(1))).alias("mean"))


def penalties(component: DataFrame, diameter: DataFrame) -> DataFrame:
    """(node, far, isolated): far is one more than the diameter of the node's component."""
    return component.join(diameter, "component", "left").select("node", (F.coalesce("diameter", F.lit(0)) + 1).alias("far"), F.col("diameter").isNull().alias("isolated"))


def separation(first: DataFrame, second: DataFrame, distance: Distances, penalty: DataFrame, fixed: float | None = None, inner: float | None = 0.0) -> DataFrame:
    """(set, separation) for pairs of node sets, (set, node) each, in one plan for all sets.

    d_GH - (d_GG + d_HH) / 2. Between the two, only nodes of one set count, an isolate of them as 1, and the sum goes by
    the sizes of both. inner: the distance within a set for a node that reaches none (None: far). Null if a side is empty.
    """
    one_g = first.join(second, ["set", "node"], "left_anti")
    one_h = second.join(first, ["set", "node"], "left_anti")
    across = nearest(one_g, second, distance).union(nearest(one_h, first, distance)).join(penalty, "node")
    value = F.when(F.col("isolated"), 1.0).otherwise(F.coalesce(F.col("d").cast("double"), F.col("far").cast("double") if fixed is None else F.lit(float(fixed))))
    sums = across.groupBy("set").agg(F.sum(value).alias("across"))
    size = lambda df, name: df.groupBy("set").agg(F.count(F.lit(1)).alias(name))
    within = lambda df, name: mean_nearest(df, distance, penalty, inner).withColumnRenamed("mean", name)
    whole = size(first, "ng").join(size(second, "nh"), "set").join(within(first, "gg"), "set").join(within(second, "hh"), "set").join(sums, "set", "left")
    return whole.select("set", (F.coalesce("across", F.lit(0.0)) / (F.col("ng") + F.col("nh")) - (F.col("gg") + F.col("hh")) / 2).alias("separation"))


def mean_nearest_by_search(sets: DataFrame, component: DataFrame, edges: DataFrame, fixed: float | None = None) -> DataFrame:
    """What ``mean_nearest`` returns, without the distances of all pairs."""
    near = sets.join(nearest_members(sets, edges).withColumnRenamed("at", "node"), ["set", "node"]).select("set", "node", F.col("second").alias("d"))
    return _mean(near, component, edges, fixed, 0.0)


def _mean(near: DataFrame, component: DataFrame, edges: DataFrame, fixed: float | None, alone: float, name: str = "mean") -> DataFrame:
    """(set, mean) of nearest distances (set, node, d); a node that reaches none counts as its penalty, an isolate as ``alone``."""
    value = F.coalesce(F.col("d").cast("double"), F.when(F.col("isolated"), alone).otherwise(F.col("far").cast("double") if fixed is None else F.lit(float(fixed))))
    wanting = near.where("d is null").select("node").distinct()
    if fixed is None:
        penalty = reach_penalties(wanting, component, edges)
    else:
        linked = both_ways(edges).select(F.col("src").alias("node")).distinct().withColumn("linked", F.lit(True))
        penalty = wanting.join(linked, "node", "left").select("node", F.lit(None).cast("long").alias("far"), F.col("linked").isNull().alias("isolated"))
    return near.join(penalty, "node", "left").groupBy("set").agg((F.sum(value) / F.count(F.lit(1))).alias(name), F.count(F.lit(1)).alias("n"))


def separation_by_search(first: DataFrame, second: DataFrame, component: DataFrame, edges: DataFrame, fixed: float | None = None, inner: float | None = 0.0) -> DataFrame:
    """What ``separation`` returns for pairs of node sets, (set, node) each, without the distances of all pairs.

    The penalty of a node that reaches no member is one more than the diameter of its component, and only such components' diameters are made."""
    first, second = cut(first.select("set", "node").distinct()), cut(second.select("set", "node").distinct())
    near_first, near_second = nearest_members(first, edges), nearest_members(second, edges)
    within = lambda own, near: own.join(near.withColumnRenamed("at", "node"), ["set", "node"]).select("set", "node", F.col("second").alias("d"))
    gg, hh = (_mean(within(own, near), component, edges, inner, 0.0, name).withColumnRenamed("n", f"n{name}") for own, near, name in ((first, near_first, "g"), (second, near_second, "h")))
    to = lambda own, other, near: own.join(other, ["set", "node"], "left_anti").join(near.select("set", F.col("at").alias("node"), F.col("first").alias("d")), ["set", "node"], "left")
    across = _mean(to(first, second, near_second).union(to(second, first, near_first)), component, edges, fixed, 1.0, "across")
    whole = gg.join(hh, "set").join(across.withColumnRenamed("n", "apart"), "set", "left")
    return whole.select("set", (F.coalesce(F.col("across") * F.col("apart"), F.lit(0.0)) / (F.col("ng") + F.col("nh")) - (F.col("g") + F.col("h")) / 2).alias("separation"))


def modules(component: DataFrame, degree: DataFrame) -> DataFrame:
    """(component, kind, hub): components that are a flower (one hub that all edges meet), a wheel or a ring, the first that fits.

    The hub is the node of highest degree, in a ring the longest; ties go to the smallest.
    """
    own = component.join(degree, "node")
    stats = own.groupBy("component").agg(
        F.sum("degree").alias("sum"), F.max("degree").alias("max"), F.min("degree").alias("min"), F.count(F.lit(1)).alias("size"),
        F.min_by("node", F.struct(-F.col("degree"), F.col("node"))).alias("top"), F.min_by("node", F.struct(-F.length("node"), F.col("node"))).alias("long"))
    kind = F.when(F.col("sum") / 2 == F.col("max"), "flower").when((F.col("sum") / 4 == F.col("max")) & (F.col("max") != F.col("min")), "wheel").when((F.col("max") == 2) & (F.col("min") == 2), "ring")
    return stats.select("component", kind.alias("kind"), F.when(kind == "ring", F.col("long")).otherwise(F.col("top")).alias("hub")).where("kind is not null")


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with each node replaced by its hub (mapping: node, hub), without loops, once each."""
    to = mapping.select(F.col("node").alias("__n"), F.col("hub").alias("__h"))
    one = edges.join(to, F.col("src") == F.col("__n"), "left").select(F.coalesce("__h", "src").alias("src"), "dst")
    two = one.join(to, F.col("dst") == F.col("__n"), "left").select("src", F.coalesce("__h", "dst").alias("dst"))
    return two.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def simplify(nodes: DataFrame, edges: DataFrame, key: str = "ngram") -> tuple[DataFrame, DataFrame]:
    """(node, edges) without isolates and with simple modules contracted to their hubs."""
    linked = nodes.select(F.col(key).alias("node")).join(isolates(nodes, edges, key).select(F.col(key).alias("node")), "node", "left_anti")
    component = components(linked, edges, "node")
    hubs = component.join(modules(component, degrees(linked, edges, "node")), "component").select("node", "hub")
    small = contract(edges, hubs)
    ends = small.select(F.col("src").alias("node")).union(small.select("dst")).distinct()
    return ends, small


def community_degrees(edges: DataFrame, community: DataFrame) -> DataFrame:
    """(node, community, inside, outside): a node's edges within its community and to others. community: (node, community)."""
    here = community.select(F.col("node").alias("src"), F.col("community").alias("a"))
    there = community.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    counts = both_ways(edges).join(here, "src").join(there, "dst").groupBy("src").agg(F.count_if(F.col("a") == F.col("b")).alias("i"), F.count_if(F.col("a") != F.col("b")).alias("o"))
    return community.join(counts, F.col("node") == F.col("src"), "left").select("node", "community", F.coalesce("i", F.lit(0)).alias("inside"), F.coalesce("o", F.lit(0)).alias("outside"))


def community_strength(edges: DataFrame, community: DataFrame) -> DataFrame:
    """(community, strength): strong if each node has more edges within than without, weak if all together have, isolate if
    none has any, else mixed. community: (node, community)."""
    own = community_degrees(edges, community).select("community", F.col("inside").alias("i"), F.col("outside").alias("o"))
    stats = own.groupBy("community").agg(F.min((F.col("i") > F.col("o")).cast("int")).alias("each"), F.sum("i").alias("i"), F.sum("o").alias("o"))
    return stats.select("community", F.when(F.col("i") + F.col("o") == 0, "isolate").when(F.col("each") == 1, "strong").when(F.col("i") > F.col("o"), "weak").otherwise("mixed").alias("strength"))
