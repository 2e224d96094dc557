"""Comparisons between networks: models of other lengths, subgraphs of groups, layered graphs of contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks, graph, ngrams, order, stats


def stacked(corpus: DataFrame, lengths: list[int]) -> DataFrame:
    """(longest, isolates, components, articulation) of the network at each length; all networks are parts of one graph, keyed by length."""
    nodes = edges = None
    for n in lengths:
        kept = graph.cut(ngrams.closed(ngrams.support(ngrams.postings(corpus, n))))
        of = lambda x: F.concat(F.lit(f"{n}:"), x)  # noqa: B023, E731
        own = kept.select(F.lit(n).cast("long").alias("longest"), of(F.col("ngram")).alias("node"))
        links = ngrams.containment_edges(kept).select(of(F.col("src")).alias("src"), of(F.col("dst")).alias("dst"))
        nodes, edges = (own, links) if nodes is None else (nodes.union(own), edges.union(links))
    nodes, edges = graph.cut(nodes), graph.cut(edges)
    points = blocks.articulation_points(blocks.block_tree(edges)).withColumn("point", F.lit(1))
    lone = graph.isolates(nodes, edges, "node").select("node", F.lit(1).alias("lone"))
    every = nodes.join(graph.components(nodes, edges, "node"), "node").join(lone, "node", "left").join(points, "node", "left")
    return every.groupBy("longest").agg(F.count("lone").alias("isolates"), F.count_distinct("component").alias("components"), F.count("point").alias("articulation"))


def component_fate(full: DataFrame, model: DataFrame) -> DataFrame:
    """(component, fate): what becomes of each component (node, component) in another model: preserved whole, truncated to some of
    its nodes, split over several components, or lost."""
    other = model.select("node", F.col("component").alias("there"))
    both = full.join(other, "node", "left").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("kept"), F.count_distinct("there").alias("parts"))
    return both.select("component", F.when(F.col("kept") == 0, "lost").when(F.col("parts") > 1, "split").when(F.col("kept") < F.col("n"), "truncated").otherwise("preserved").alias("fate"))


def component_entities(component: DataFrame, posted: DataFrame) -> DataFrame:
    """(component, entities)."""
    return component.join(posted.select(F.col("ngram").alias("node"), "id"), "node").groupBy("component").agg(F.count_distinct("id").alias("entities"))


def group_network(posted: DataFrame, groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, nodes, isolates, components) of the part of a pooled network that each group's entities (id, group) have."""
    own = posted.join(groups, "id").join(nodes.select("ngram"), "ngram", "left_semi").select("group", F.col("ngram").alias("node")).distinct()
    name = lambda c: F.concat_ws("\x1f", F.col("group").cast("string"), F.col(c))
    inner = edges.join(own.select(F.col("group"), F.col("node").alias("src")), "src").join(own.select(F.col("group"), F.col("node").alias("dst")), ["group", "dst"])
    keyed = own.select("group", name("node").alias("ngram"))
    linked = inner.select(name("src").alias("src"), name("dst").alias("dst"))
    component = graph.components(keyed, linked)
    alone = graph.isolates(keyed, linked).groupBy("group").agg(F.count(F.lit(1)).alias("isolates"))
    rows = keyed.join(component, F.col("ngram") == F.col("node")).groupBy("group").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"))
    return rows.join(alone, "group", "left").select("group", "nodes", F.coalesce("isolates", F.lit(0)).alias("isolates"), "components")


def replaced_by(missing: DataFrame, pooled: DataFrame) -> DataFrame:
    """(ngram, stands_in): the nodes of a pooled network that contain an n-gram which it lacks."""
    return missing.select("ngram").join(ngrams.proper_windows(pooled).select(F.col("sub").alias("ngram"), F.col("ngram").alias("stands_in")), "ngram")


def contribution_edges(fusions: DataFrame) -> DataFrame:
    """(src, dst, weight): 5' part to result to 3' part with counts; a name that has several roles bears the role.

    fusions: five, whole, three.
    """
    roles = fusions.select(F.explode(F.array(F.struct(F.col("five").alias("n"), F.lit("5").alias("r")), F.struct(F.col("whole").alias("n"), F.lit("Full").alias("r")), F.struct(F.col("three").alias("n"), F.lit("3").alias("r")))).alias("x")).select("x.*").distinct()
    several = roles.groupBy("n").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("n")
    marked = several.withColumn("many", F.lit(True))
    pairs = fusions.select(F.explode(F.array(F.struct(F.col("five").alias("a"), F.lit("5").alias("ra"), F.col("whole").alias("b"), F.lit("Full").alias("rb")), F.struct(F.col("whole").alias("a"), F.lit("Full").alias("ra"), F.col("three").alias("b"), F.lit("3").alias("rb")))).alias("x")).select("x.*")
    counts = pairs.groupBy("a", "ra", "b", "rb").agg(F.count(F.lit(1)).alias("weight"))
    one = counts.join(marked.withColumnsRenamed({"n": "na", "many": "ma"}), F.col("a") == F.col("na"), "left").join(marked.withColumnsRenamed({"n": "nb", "many": "mb"}), F.col("b") == F.col("nb"), "left")
    label = lambda c, r, m: F.when(F.col(m), F.concat_ws("_", c, r)).otherwise(F.col(c))
    return one.select(label("a", "ra", "ma").alias("src"), label("b", "rb", "mb").alias("dst"), "weight")


def focused(edges: DataFrame, base: str) -> DataFrame:
    """Edges of a layered graph that touch a node which contains the n-gram, or a neighbour of one."""
    has = lambda c: F.array_contains(F.split(F.regexp_replace(c, "_(5|3|Full)$", ""), r"\|"), base)
    core = edges.where(has("src") | has("dst"))
    near = core.select(F.col("src").alias("n")).union(core.select("dst")).distinct()
    return edges.join(near, (F.col("src") == F.col("n")), "left_semi").union(edges.join(near, F.col("dst") == F.col("n"), "left_semi")).distinct()


def bipartite(posted: DataFrame, sets: DataFrame) -> DataFrame:
    """(ngram, set, shared): n-grams and the sets (set, id) that share entities with them."""
    return posted.join(sets, "id").groupBy("ngram", "set").agg(F.count_distinct("id").alias("shared"))


def bipartite_of(corpus: DataFrame, longest: int, sets: DataFrame) -> DataFrame:
    """``bipartite`` of a corpus' n-grams of up to ``longest`` tokens: entities of equal sequences are counted in each set before windows are made."""
    alike = ngrams.gathered(corpus).join(sets.select("id", "set").distinct(), "id").groupBy("sequences", "set").agg(F.count(F.lit(1)).alias("c"))
    return alike.select("set", "c", F.explode(ngrams.names(F.col("sequences"), longest)).alias("ngram")).groupBy("ngram", "set").agg(F.sum("c").alias("shared"))


def running_enrichment(ranked: DataFrame, sets: DataFrame, smallest: int = 15, largest: int = 500) -> DataFrame:
    """(set, size, score): the running-sum statistic of pre-ranked genes (gene, stat) for sets (set, gene) of a size in the limits.

    Between hits the sum falls evenly, so its extremes are at hits: just before and at each. Only rows of hits are kept.
    """
    n = ranked.count()
    # A gene's place is the rank of its statistic, and among equal ones that of its name.
    alike = ranked.join(order.ranks(ranked, "stat"), "stat")
    place = alike.select("gene", F.abs("stat").alias("w"), (F.col("rank") - 1 + F.row_number().over(W.partitionBy("stat").orderBy("gene"))).alias("r"))
    hits = sets.distinct().join(place, "gene")
    whole = W.partitionBy("set")
    upto = whole.orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    own = hits.withColumns({"size": F.count(F.lit(1)).over(whole), "sum": F.sum("w").over(whole), "upto": F.sum("w").over(upto), "k": F.count(F.lit(1)).over(upto)}).where((F.col("size") >= smallest) & (F.col("size") <= largest) & (F.col("sum") > 0))
    misses = (F.col("r") - F.col("k")) / (n - F.col("size"))
    after, before = F.col("upto") / F.col("sum") - misses, (F.col("upto") - F.col("w")) / F.col("sum") - misses
    top = own.groupBy("set").agg(F.first("size").alias("size"), F.max(after).alias("high"), F.min(before).alias("low"))
    return top.select("set", "size", F.when(F.col("high") >= -F.col("low"), F.col("high")).otherwise(F.col("low")).alias("score"))


def enrichment_significance(ranked: DataFrame, sets: DataFrame, trials: int, seed: int, smallest: int = 15, largest: int = 500) -> DataFrame:
    """(set, size, score, p, normalized, q) with ``trials`` permutations of the genes: p is the share of the permuted scores of the same sign that are
    as far from 0, normalized the score by their mean. A set is permuted by drawing as many genes at random, as keys of one plan.

    q is the false discovery rate: the permuted scores of all sets, each normalized by its set's mean for its sign, are one null distribution; q is the share of those of a sign
    that are as far from 0 by the share of the sets' own scores that are, at most 1. Both shares are of ranks over all rows; scores tie if they agree in nine decimals.
    """
    actual = running_enrichment(ranked, sets, smallest, largest)
    number = ranked.sparkSession.range(trials).select(F.col("id").alias("trial"))
    draws = number.crossJoin(actual.select("set", F.col("size").alias("take"))).select(F.struct("trial", "set").alias("trial"), "take")
    chosen = stats.drawn(ranked.select("gene"), "gene", [], draws, lambda t: stats.drawn_before(str(seed), t["trial"], t["set"], F.col("gene")))
    null = running_enrichment(ranked, chosen.select(F.col("trial").alias("set"), "gene"), smallest, largest).select(F.col("set.set").alias("of"), F.col("score").alias("null"))
    null, actual = graph.cut(null.withColumn("up", F.col("null") >= 0)), graph.cut(actual.withColumn("up", F.col("score") >= 0))
    means = null.groupBy(F.col("of").alias("o"), F.col("up").alias("u")).agg(F.avg(F.abs("null")).alias("mean"))
    scaled = null.join(means, (F.col("of") == F.col("o")) & (F.col("up") == F.col("u"))).select("of", "null", "up", F.round(F.abs("null") / F.nullif(F.col("mean"), F.lit(0.0)), 9).alias("far"))
    hits = actual.join(scaled, (F.col("set") == F.col("of")) & (actual.up == scaled.up), "left").groupBy("set").agg(
        F.count_if(stats.up_to(F.abs("score"), F.abs("null"))).alias("hits"), F.count("null").alias("n"))
    own = actual.join(means, (F.col("set") == F.col("o")) & (F.col("up") == F.col("u")), "left").select("set", "size", "score", "up", (F.col("score") / F.nullif(F.col("mean"), F.lit(0.0))).alias("normalized"))
    own = graph.cut(own.join(hits, "set").withColumn("far", F.round(F.abs("normalized"), 9)))
    both = scaled.select("up", "far", F.lit(1).alias("null"), F.lit(0).alias("own")).union(own.select("up", "far", F.lit(0), F.lit(1))).where("far is not null")
    levels = both.groupBy("up", "far").agg(F.sum("null").alias("null"), F.sum("own").alias("own")).withColumn("back", -F.col("far"))
    beyond = order.running(levels, "back", {"farther": "null", "farther_own": "own"}, ["up"])
    totals = both.groupBy(F.col("up").alias("t")).agg(F.sum("null").alias("nulls"), F.sum("own").alias("owns"))  # a row for each sign
    shares = beyond.join(F.broadcast(totals), F.col("up") == F.col("t")).select(
        F.col("up").alias("s"), F.col("far").alias("level"), ((F.col("farther") + F.col("null")) / F.nullif(F.col("nulls"), F.lit(0)) / F.nullif(F.col("farther_own") + F.col("own"), F.lit(0)) * F.col("owns")).alias("q"))
    found = own.join(shares, (F.col("up") == F.col("s")) & (F.col("far") == F.col("level")), "left")
    return found.select("set", "size", "score", (F.col("hits") / F.nullif(F.col("n"), F.lit(0))).alias("p"), "normalized", F.when(F.col("q").isNotNull(), F.least(F.lit(1.0), "q")).alias("q"))


def leaf_order(rows: DataFrame, key: str, column: str, value: str, most: int = 2000):
    """Keys in the order of Ward clustering of their value vectors; a display order, so for at most ``most`` keys, else an error."""
    import numpy as np

    wide = rows.groupBy(key).pivot(column).agg(F.first(value)).na.fill(0).orderBy(key).limit(most + 1).toPandas()
    if len(wide) > most:
        raise ValueError(f"more than {most} keys to order")
    names = wide[key].tolist()
    points = {i: (v, 1) for i, v in enumerate(wide.drop(columns=[key]).to_numpy(float))}
    leaves = {i: [i] for i in points}
    while len(points) > 1:
        ids = sorted(points)
        centre, size = np.stack([points[i][0] for i in ids]), np.array([points[i][1] for i in ids], float)
        square = (centre**2).sum(1)
        cost = (square[:, None] + square[None, :] - 2 * centre @ centre.T) * (size[:, None] * size[None, :]) / (size[:, None] + size[None, :])
        np.fill_diagonal(cost, np.inf)
        a, b = divmod(int(np.argmin(cost)), len(ids))
        a, b = sorted((ids[a], ids[b]))
        (x, n), (y, m) = points.pop(a), points.pop(b)
        new = max(leaves) + 1
        points[new], leaves[new] = ((x * n + y * m) / (n + m), n + m), leaves[a] + leaves[b]
    return [names[i] for i in leaves[max(leaves)]] if leaves else []
