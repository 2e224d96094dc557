"""Mixing sources to target weights as a time-varying curriculum.

A source's schedule is a piecewise linear weight over training time 0 to 1. Its integral is the share of the source's
tokens that are due by a time; inverting it gives each document the time at which its tokens are due, and sorting by
that time gives the training order. Running sums are taken in two steps, over hash buckets of a source and then within
a bucket, so that no task holds a source. Everything is DataFrame functions.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated
rows and rows without a key are documents of their own, each on its own share; an empty table gives an empty result; a source
of only empty documents has target 0; columns of the input may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored, stored_texts

#: Hex digits of a document's MD5 that name its bucket: 4096 a source.
DIGITS = 3


@dataclass(frozen=True)
class Recipe:
    """weights: of the sources in code point order, null last, repeating. share: of all tokens that the mix takes. most: epochs of a source at most.
    schedules: of the sources in the same order, repeating; (time, weight) knots from time 0 to 1, of which only the shape counts."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def sizes(text: Column) -> Column:
    """Words of the whole text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(per_source: DataFrame, recipe: Recipe) -> DataFrame:
    """Adds nth (order of the source from 0) and target to (source, source_size).

    Shares by weight are cut at ``most`` times the source's size and what is over goes to the others by weight: the
    level of water in vessels, found from sums over the sources in the order in which they fill up.
    """
    every = W.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, recipe.weights)), (F.col("nth") % len(recipe.weights) + 1).cast("int"))
    ranked = per_source.withColumn("nth", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    ranked = ranked.withColumns({"cap": F.col("source_size") * recipe.most, "total": recipe.share * F.sum("source_size").over(every)})
    before = every.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(W.unboundedPreceding, -1)
    filled = ranked.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)), "all_weight": F.sum("weight").over(every)})
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    ready = filled.withColumn("own_level", F.when(level <= F.col("cap") / F.col("weight"), level))
    found = ready.withColumn("level", F.first("own_level", ignorenulls=True).over(every.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return found.select("source", "source_size", "nth", F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")), F.col("cap").cast("double")).alias("target"))


def due(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which the given share (0 to 1) of a source's tokens is due under a piecewise linear schedule."""
    spans, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        spans.append((t0, t1, w0, w1, area))
        area += (w0 + w1) / 2 * (t1 - t0)
    want, out = share * area, None
    for t0, t1, w0, w1, done in reversed(spans):
        rest, slope = want - done, (w1 - w0) / (t1 - t0)
        # rest = w0 x + slope x^2 / 2, solved in the form that holds for a slope of 0 as well
        x = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest)))
        x = F.when(rest > 0, t0 + F.least(F.lit(t1 - t0), x)).otherwise(F.lit(float(t0)))
        out = x if out is None else F.when(want <= done + (w0 + w1) / 2 * (t1 - t0), x).otherwise(out)
    return out


def numbered(documents: DataFrame, text: str, key: str, *more: Column) -> DataFrame:
    """(key, source, size, order, number, more...) of each row: what tells it from all others. The number is the row's place in
    its task, so it has to be written before it is used."""
    order = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return documents.select(F.col(key).alias("key"), F.col("source").alias("source"), sizes(F.col(text)).alias("size"), order.alias("order"), F.monotonically_increasing_id().alias("number"), *more)


def placed(rows: DataFrame, recipe: Recipe, store) -> DataFrame:
    """(number, key, source, size, source_size, target, epochs, positions, order) of each of the numbered rows.

    Rows that are alike are one row of the running sums for each task that they came from, so no bucket holds a hot key's copies.
    """
    rows = rows.withColumn("bucket", F.substring("order", 1, DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = buckets.withColumn("bucket_start", F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("bucket_size"))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), recipe)
    known = store(buckets.join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), "bucket_start", "source_size", "nth", "target"), "buckets")
    # A number's upper bits are those of its task.
    alike = rows.groupBy("source", "bucket", "order", "key", "size", F.shiftright("number", 33).alias("task")).agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    own = F.col("size") * F.size("numbers")
    within = W.partitionBy("source", "bucket").orderBy("order", "key", "size", "task").rowsBetween(W.unboundedPreceding, 0)
    run = alike.withColumn("inside", F.sum(own).over(within) - own)
    run = run.join(known, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("__bucket"))).drop("__source", "__bucket")
    run = run.select("*", F.posexplode("numbers").alias("copy", "number")).drop("numbers")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    start, half = F.col("bucket_start") + F.col("inside") + F.col("copy") * F.col("size"), F.col("size") / 2
    more = (F.col("size") > 0) & (start + half <= F.col("target") - F.col("whole") * F.col("source_size"))
    taken = run.withColumn("whole", whole.cast("int")).withColumn("epochs", (F.when(F.col("size") > 0, F.col("whole")).otherwise(0) + more.cast("int")).cast("int"))
    share = lambda k: F.least(F.lit(1.0), (k * F.col("source_size") + start + half) / F.col("target"))
    kinds = len(recipe.schedules)
    at = lambda k: (lambda due_at: F.coalesce(*[F.when(F.col("nth") % kinds == i, x) for i, x in enumerate(due_at)]))([due(share(k), s) for s in recipe.schedules])
    positions = F.filter(F.array(*[F.when(F.col("epochs") > k, at(k)) for k in range(recipe.most)]), lambda x: x.isNotNull())
    return taken.select("number", "key", "source", "size", "source_size", "target", "epochs", positions.alias("positions"), "order")


def plan(documents: DataFrame, recipe: Recipe = Recipe(), text: str = "text", key: str = "doc_id", store=stored) -> DataFrame:
    """(key, source, size, source_size, target, epochs, taken, positions) for each document, in training order.

    epochs: times that the mix takes the document, 0 to ``most``; positions: the time of each. Every source takes all
    its documents in whole epochs and, for what is left of its target, those first in the order of the MD5 of their
    key and text, a document if at least half of it fits. Documents that are not taken come last.
    """
    found = placed(store(numbered(documents, text, key), "sizes"), recipe, store)
    rank = F.coalesce(F.try_element_at("positions", F.lit(1)), 1 + F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2.0**32)
    found = found.withColumn("__at", rank).orderBy("__at", "order", "number")
    return found.select(F.col("key").alias(key), "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"), "positions")


def mix(documents: DataFrame, recipe: Recipe = Recipe(), text: str = "text", key: str = "doc_id", store=stored, store_texts=stored_texts) -> DataFrame:
    """The documents in training order, each as often as the plan takes it; all columns stay.

    The rows are written once with their numbers, by which each gets its own positions, whatever its key."""
    marked = store_texts(numbered(documents, text, key, F.struct("*").alias("row")), "numbered")
    found = placed(marked.drop("row"), recipe, store).where("epochs > 0").select("number", "order", F.explode("positions").alias("at"))
    # The plan has a row for each document, so it is never broadcast.
    joined = marked.select("row", "number").join(found.hint("merge"), "number")
    return joined.orderBy("at", "order", "number").select("row.*")
