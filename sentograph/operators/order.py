"""Totals, running sums and ranks over all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the order that running sums are taken in, and values drawn for the border of each.
BLOCKS, DRAWN = 1024, 4


def with_totals(rows: DataFrame, *totals: Column) -> DataFrame:
    """The rows with aggregates over all of them, which are one broadcast row."""
    return rows.crossJoin(F.broadcast(rows.agg(*totals)))


def borders(rows: DataFrame, order: str, blocks: int = BLOCKS) -> DataFrame:
    """One row with at most ``blocks - 1`` ascending values (__borders) that cut the distinct values of ``order`` into ranges of about one size.

    The values are an even draw: of those whose hash falls into a bin, the one with the least hash. So they follow from
    the set of values alone, however rows are dealt to tasks, and a plan that computes them twice gets the same ones.
    """
    drawn = rows.select(F.col(order).alias("__v")).withColumn("__h", F.xxhash64("__v"))
    drawn = drawn.groupBy(F.pmod("__h", F.lit(blocks * DRAWN)).alias("__bin")).agg(F.min_by("__v", F.col("__h")).alias("__v"))
    every = drawn.agg(F.sort_array(F.collect_list("__v")).alias("__drawn"))
    step = F.greatest(F.lit(1), F.ceil(F.size("__drawn") / blocks)).cast("int")
    return every.select(F.filter("__drawn", lambda _, i: (F.pmod(i + 1, step) == 0) & (i + 1 < F.size("__drawn"))).alias("__borders"))


def with_block(rows: DataFrame, order: str, blocks: int = BLOCKS) -> DataFrame:
    """The rows with the number of the range (__block) that their ``order`` falls into; ranges ascend with it."""
    both = rows.crossJoin(F.broadcast(borders(rows, order, blocks)))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(blocks.bit_length()))])
    under = F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.try_element_at("__borders", at + half) < F.col(order), half).otherwise(0))  # a binary search
    return both.withColumn("__block", under).drop("__borders")


def running(levels: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Adds for each name -> column of ``sums`` the sum of the column over the rows of the group with a smaller ``order``.

    order is comparable and distinct within a group. Rows are cut into ranges of the order; the totals of a group's earlier ranges become
    one row that goes first into each of its ranges, and a window holds one range of a group. Nothing runs while the plan is built.
    """
    by = by or []
    marked = with_block(levels, order, blocks)
    totals = marked.groupBy(*by, "__block").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()], F.max(F.col(order).isNull()).alias("__one"))
    kinds = {n: totals.schema[f"__{n}"].dataType for n in sums}
    earlier = W.partitionBy(*(by or ["__one"])).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # at most a row for each range
    zero = lambda n, c: F.coalesce(c, F.lit(0)).cast(kinds[n])
    starts = totals.select(*by, "__block", *[zero(n, F.sum(f"__{n}").over(earlier)).alias(f"__{n}") for n in sums], F.lit(0).alias("__own"))
    own = marked.select("*", *[F.col(c).cast(kinds[n]).alias(f"__{n}") for n, c in sums.items()], F.lit(1).alias("__own"))
    within = W.partitionBy(*by, "__block").orderBy("__own", order).rowsBetween(W.unboundedPreceding, -1)
    found = own.unionByName(starts, allowMissingColumns=True).withColumns({f"__{n}": zero(n, F.sum(f"__{n}").over(within)) for n in sums})
    return found.where("__own = 1").select(*levels.columns, *[F.col(f"__{n}").alias(n) for n in sums])


def top_with_ties(rows: DataFrame, value: str, k: int) -> DataFrame:
    """Rows of rank up to k by the value, the largest first, with their rank: those that tie with the k-th too. Only rows from its value on are ranked."""
    last = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("__v")).orderBy(F.col("__v").desc()).limit(k).agg(F.min("__v").alias("__last"))
    own = rows.crossJoin(F.broadcast(last)).where(F.col(value) >= F.col("__last")).drop("__last")
    return own.join(ranks(own, value), value)


def ranks(rows: DataFrame, value: str, by: list[str] | None = None, largest_first: bool = True) -> DataFrame:
    """(by..., value, rank): the least rank of each distinct value, 1 for the first. Nulls have none."""
    by = by or []
    order = -F.col(value) if largest_first else F.col(value)
    levels = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__order", order)
    return running(levels, "__order", {"__before": "__n"}, by).select(*by, value, (F.col("__before") + 1).cast("long").alias("rank"))
