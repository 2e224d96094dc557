"""Shortest distances from labels instead of from all pairs.

Each node keeps its distance to some hubs, so that any two nodes that reach one another share a hub on a shortest path between them. Nodes become hubs in order
of their degree. A hub walks outwards and stops where earlier hubs already tell the distance; so central nodes label much, the others next to
nothing, and there are far fewer labels than pairs. The nearest member of a set, or a component's diameter, is a join of labels on the hub.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order
from .graph import both_ways, cut

#: Hubs walk together in batches; each batch is so many times all earlier ones. Hubs of a batch stop one another only after some steps.
GROWTH = 8


def distance_labels(nodes: DataFrame, edges: DataFrame, key: str = "ngram", growth: int = GROWTH, store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, hub, d): the labels of all nodes (key); hub is the place of the hub's node by degree, d the distance to it.

    Two nodes' distance is the least sum of their d at a shared hub. A label is kept only if no earlier hub gives its distance."""
    step = store(both_ways(edges).select(F.col("src").alias("from"), F.col("dst").alias("to")))
    degree = step.groupBy("from").agg(F.count(F.lit(1)).alias("degree"))
    named = nodes.select(F.col(key).alias("node")).distinct().join(degree, F.col("node") == F.col("from"), "left")
    named = named.select("node", F.struct((-F.coalesce("degree", F.lit(0))).alias("degree"), "node").alias("o"), F.lit(1).alias("one"))
    placed = store(order.running(named, "o", {"hub": "one"}).select("node", F.col("hub").cast("long").alias("hub")))
    count, done, size = placed.count(), 0, 1
    labels = placed.select("node", "hub", F.lit(0).cast("long").alias("d")).limit(0)
    while done < count:
        front = placed.where((F.col("hub") >= done) & (F.col("hub") < done + size)).select("node", "hub", F.lit(0).cast("long").alias("d"), F.col("node").alias("start"))
        front, d = store(front), 0
        labels = store(labels.union(front.select("node", "hub", "d")))
        while not front.isEmpty():
            d += 1
            reached = front.join(step, F.col("node") == F.col("from")).select(F.col("to").alias("node"), "hub", "start").distinct()
            reached = store(reached.withColumn("d", F.lit(d).cast("long")))
            front = store(_needed(reached, labels, "start"))
            labels = labels.union(front.select("node", "hub", "d"))
        labels, done = store(labels), done + size
        size = done * (growth - 1)
    # What hubs of the same batch gave twice.
    starts = placed.select(F.col("hub").alias("of"), F.col("node").alias("start"))
    return store(_needed(labels.join(starts, F.col("hub") == F.col("of")).drop("of"), labels, "start").select("node", "hub", "d"))


def _needed(found: DataFrame, labels: DataFrame, start: str) -> DataFrame:
    """Rows (node, hub, d, start) whose distance no earlier hub gives; those of the hub itself stay."""
    of_hub = labels.select(F.col("node").alias("__a"), F.col("hub").alias("__x"), F.col("d").alias("__da"))
    of_node = labels.select(F.col("node").alias("__b"), F.col("hub").alias("__y"), F.col("d").alias("__db"))
    ways = found.join(of_hub, (F.col(start) == F.col("__a")) & (F.col("__x") <= F.col("hub")))
    ways = ways.join(of_node, (F.col("node") == F.col("__b")) & (F.col("__x") == F.col("__y")) & (F.col("__da") + F.col("__db") <= F.col("d")))
    # At an earlier hub, or a label of this hub at the node from an earlier step.
    told = ways.where((F.col("__x") < F.col("hub")) | (F.col("__da") + F.col("__db") < F.col("d"))).select(F.col("node").alias("__n"), F.col("hub").alias("__h")).distinct()
    return found.join(told, (F.col("node") == F.col("__n")) & (F.col("hub") == F.col("__h")), "left_anti")


def nearest(sources: DataFrame, targets: DataFrame, labels: DataFrame) -> DataFrame:
    """(set, node, d): for each source (set, node) the least distance to a target (set, node) of the set other than itself; null if it reaches none.

    Of a set's targets, a hub keeps the two nearest; so rows go with the labels of sources and targets, whatever the graph."""
    at_hub = targets.select("set", "node").distinct().join(labels, "node")
    place = F.row_number().over(W.partitionBy("set", "hub").orderBy("d", "node"))
    best = at_hub.withColumn("place", place).where("place <= 2").select(F.col("set").alias("__set"), F.col("hub").alias("__hub"), F.col("node").alias("__node"), F.col("d").alias("__d"))
    own = sources.join(labels, "node").join(best, F.col("set").eqNullSafe(F.col("__set")) & (F.col("hub") == F.col("__hub")) & (F.col("node") != F.col("__node")))
    found = own.groupBy("set", "node").agg(F.min(F.col("d") + F.col("__d")).alias("d")).withColumnsRenamed({"set": "__set", "node": "__node"})
    return sources.join(found, F.col("set").eqNullSafe(F.col("__set")) & (F.col("node") == F.col("__node")), "left").select("set", "node", "d")


def by_labels(labels: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For ``graph.separation`` and ``graph.mean_nearest``, in place of the distances of all pairs."""
    return lambda sources, targets: nearest(sources, targets, labels)


def diameters(component: DataFrame, labels: DataFrame, store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(component, size, diameter) of components (node, component) of two nodes or more.

    The distances from a few nodes of a component bound the eccentricities of all its nodes, from below and above. Each round measures from twice as many nodes as the one before,
    of those that may be more eccentric than any known, until none may: in turn those that may be the most eccentric and those that seem the least."""
    sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    state = store(component.join(sizes, "component").select("component", "node", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"), F.lit(0).cast("long").alias("most")))
    found, take, k = None, 1, 0
    own = labels.select(F.col("node").alias("__at"), F.col("hub").alias("__hub"), F.col("d").alias("__d"))
    while True:
        open_ones = state.where("high > most")
        if open_ones.isEmpty():
            break
        first = (F.col("high").desc(), F.col("low"), F.col("node")) if k % 2 == 0 else (F.col("low"), F.col("high").desc(), F.col("node"))
        place = F.row_number().over(W.partitionBy("component").orderBy(*first))
        picked = open_ones.withColumn("place", place).where(F.col("place") <= take).select(F.col("component").alias("__c"), F.col("node").alias("start"))
        picked = picked.join(labels, F.col("start") == F.col("node")).select("__c", "start", F.col("hub").alias("__h"), F.col("d").alias("__e"))
        near = state.select("component", "node").join(own, F.col("node") == F.col("__at")).join(picked, (F.col("component") == F.col("__c")) & (F.col("__hub") == F.col("__h")))
        far = store(near.groupBy("component", "start", "node").agg(F.min(F.col("__d") + F.col("__e")).alias("d")))
        reach = far.groupBy("component", "start").agg(F.max("d").alias("e"))
        bound = far.join(reach, ["component", "start"]).groupBy("component", "node").agg(F.max(F.greatest("d", F.col("e") - F.col("d"))).alias("l"), F.min(F.col("e") + F.col("d")).alias("h"))
        state = state.drop("most").join(bound, ["component", "node"], "left").withColumns({"low": F.greatest("low", "l"), "high": F.least("high", "h")}).drop("l", "h")
        state = store(state.join(state.groupBy("component").agg(F.max("low").alias("most")), "component"))
        take, k = take * 2, k + 1
        settled = state.groupBy("component").agg(F.max("high").alias("high"), F.max("most").alias("diameter")).where("high <= diameter").select("component", "diameter")
        found = settled if found is None else found.union(settled)
        state = state.join(settled, "component", "left_anti")
    if found is None:
        return sizes.select("component", "size", F.lit(None).cast("long").alias("diameter"))
    return sizes.join(found, "component").select("component", "size", "diameter")
