"""Betweenness as joins: counts of shortest paths outwards from many sources at once, and what depends on each node back towards them.

Sources go in batches, which bound what is held at once; each batch's sums are a table in a folder, so a run that ends early goes on from the batches that are there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import both_ways, checkpoint_folder, cut

#: Sources of a batch; it holds a row for each of them and each node that it reaches.
BATCH = 4096


def loads(sources: DataFrame, step: DataFrame, store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, load): the sum over the sources (source) of the share of shortest paths from each that go on over the node. step: (at, to), edges both ways.

    All sources step outwards together; a level of nodes at a distance keeps how many paths lead there. From the last level back, a node passes on to those before it
    one more than its own load, by their shares of its paths."""
    front = store(sources.select(F.col("source"), F.col("source").alias("node"), F.lit(1.0).alias("paths")))
    levels, seen = [front], front.select("source", "node")
    while True:
        ways = front.join(step, F.col("node") == F.col("at")).groupBy("source", F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
        front = store(ways.join(seen, ["source", "node"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        # A neighbour of the newest level is in it, in the one before, or new.
        seen = front.select("source", "node").union(levels[-2].select("source", "node"))
    out, beyond = None, None
    for level in reversed(levels[1:]):
        if beyond is None:
            own = level.select("source", "node", "paths", F.lit(0.0).alias("load"))
        else:
            due = beyond.select(F.col("source").alias("s"), F.col("node").alias("next"), ((1 + F.col("load")) / F.col("paths")).alias("share"))
            back = due.join(step, F.col("next") == F.col("at")).groupBy(F.col("s").alias("source"), F.col("to").alias("node")).agg(F.sum("share").alias("share"))
            own = level.join(back, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("load"))
        beyond = store(own)
        one = beyond.where("load > 0").select("node", "load")
        out = one if out is None else out.union(one)
    if out is None:
        out = front.select("node", F.col("paths").alias("load"))
    return out.groupBy("node").agg(F.sum("load").alias("load"))


def betweenness(nodes: DataFrame, edges: DataFrame, key: str = "ngram", batch: int = BATCH, folder: str | None = None) -> DataFrame:
    """(node, betweenness) over unordered pairs, by 2 / ((n-1)(n-2)).

    folder: where the batches' sums are kept; a call with the same folder, nodes and batch size goes on after the last one that is there (None: a new folder)."""
    spark = nodes.sparkSession
    own = cut(nodes.select(F.col(key).alias("node")).distinct())
    step, n = cut(both_ways(edges).select(F.col("src").alias("at"), F.col("dst").alias("to"))), own.count()
    count, folder = max(1, -(-n // batch)), folder or f"{checkpoint_folder(spark)}/loads-{uuid.uuid4().hex}"
    kind = own.schema["node"].dataType.simpleString()
    for k in range(count):
        path = f"{folder}/of={count}/batch={k}"
        try:
            spark.read.schema("done boolean").json(f"{path}/whole").isEmpty()
            continue
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        sources = own.where(F.pmod(F.xxhash64("node"), F.lit(count)) == k).select(F.col("node").alias("source"))
        loads(sources, step).write.mode("overwrite").parquet(f"{path}/sums")
        spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").json(f"{path}/whole")
    found = spark.read.schema(f"node {kind}, load double").parquet(*[f"{folder}/of={count}/batch={k}/sums" for k in range(count)])
    total = found.groupBy(F.col("node").alias("v")).agg(F.sum("load").alias("load"))
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return own.join(total, F.col("node") == F.col("v"), "left").select("node", (F.coalesce("load", F.lit(0.0)) * scale).alias("betweenness"))
