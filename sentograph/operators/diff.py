"""Differential selection: contrasts, id mapping, the n-grams of a set, sweeps, and tidy results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, ngrams, stats


def select_sets(rows: DataFrame, alpha: float, fold: float, strict: bool = False) -> DataFrame:
    """(set, id): up where padj <= alpha (strict: <) and log2fc > fold, down where log2fc < -fold. rows: id, log2fc, padj."""
    side = F.when(F.col("log2fc") > fold, "up").when(F.col("log2fc") < -fold, "down")
    return rows.where(F.col("padj") < alpha if strict else F.col("padj") <= alpha).select(side.alias("set"), "id").where("set is not null").distinct()


def with_entity_ids(contrasts: DataFrame, mapping: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Contrast rows with an id for each entity of their gene; second: (name, id) for genes that the mapping lacks."""
    found = contrasts.join(mapping.select("gene_id", "id").dropna(), "gene_id")
    if second is None:
        return found
    rest = contrasts.join(mapping.dropna(), "gene_id", "left_anti")
    return found.unionByName(rest.join(second.select(F.col("name").alias("gene_id"), "id").dropna(), "gene_id"))


def set_ngrams(posted: DataFrame, nodes: DataFrame, members: DataFrame, whole: bool = False) -> DataFrame:
    """Nodes that members (id) of a set have, without those that a longer one with the same members of the set contains.

    whole: who has an n-gram has all the nodes within it, as in a full extraction. So the same members are as many members, and no pairs are made for each of them."""
    own = posted.join(nodes.select("ngram"), "ngram", "left_semi").join(members.select("id").distinct(), "id", "left_semi")
    if not whole:
        return ngrams.collapse(own)[0]
    counts = graph.cut(ngrams.support(own))
    gone = ngrams.containment_edges(counts).select(F.col("src").alias("ngram"), F.col("weight").alias("support"))
    return counts.join(gone, ["ngram", "support"], "left_anti").select(counts.columns)


def threshold_sweep(rows: DataFrame, alphas: list[float], fold: float) -> DataFrame:
    """(contrast, alpha, up, down): sizes of the sets over a grid, in one pass."""
    each = rows.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    hit = F.col("padj") <= F.col("alpha")
    return each.groupBy("contrast", "alpha").agg(F.count_if(hit & (F.col("log2fc") > fold)).alias("up"), F.count_if(hit & (F.col("log2fc") < -fold)).alias("down"))


def separation_sweep(up: DataFrame, down: DataFrame, cutoffs: list[float], distance: graph.Distances, penalty: DataFrame) -> DataFrame:
    """(set, separation) for each cutoff, as a string, of the n-grams (node, p) with p up to it; all cutoffs in one plan."""
    cut = lambda df: df.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).where(stats.up_to(F.col("p"), F.col("cutoff"))).select(F.col("cutoff").cast("string").alias("set"), "node")
    return graph.separation(cut(up), cut(down), distance, penalty)


def random_sets(corpus: DataFrame, counts: int, trials: int, seed: int) -> DataFrame:
    """(trial, id): seeded samples without replacement, of ``counts`` entities each."""
    draws = corpus.sparkSession.range(trials).select(F.col("id").alias("trial"), F.lit(counts).alias("take"))
    return stats.drawn(corpus.select("id"), "id", [], draws, lambda t: stats.drawn_before(str(seed), t, F.col("id"))).select("trial", "id")


def length_of(tokens: str = "tokens", longest: int = 10) -> Column:
    """The stratum of a sequence: its length, and one for all that are longer."""
    return F.least(F.size(tokens), F.lit(longest + 1)).cast("long")


def length_stratified(corpus: DataFrame, weights: DataFrame, trials: int, seed: int, longest: int = 10, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """(trial, id): for each trial and length up to ``longest`` (longer ones together) a random number of entities between low and high times the weight (length, weight)."""
    number = corpus.sparkSession.range(trials).select(F.col("id").alias("trial"))
    return _stratified(corpus, weights.crossJoin(F.broadcast(number)), seed, longest, low, high)


def _stratified(corpus: DataFrame, weights: DataFrame, seed: int, longest: int = 10, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """The same for weights of each trial (trial, length, weight); a trial may be a number or a struct."""
    u = F.conv(F.substring(stats.drawn_before(str(seed), _text(weights, F.col("trial")), F.col("length")), 1, 8), 16, 10).cast("double") / 2.0**32
    lo, hi = F.floor(low * F.col("weight")), F.ceil(high * F.col("weight"))
    draws = weights.withColumn("take", (lo + F.floor(u * F.greatest(hi - lo, F.lit(1)))).cast("long")).select("trial", "length", "take")
    rows = corpus.select("id", length_of(longest=longest).alias("length"))
    return stats.drawn(rows, "id", ["length"], draws, lambda t: stats.drawn_before(str(seed), _text(weights, t), F.col("length"), F.col("id"))).select("trial", "id")


def _text(rows: DataFrame, trial: Column) -> Column:
    kind = rows.schema["trial"].dataType
    return F.concat_ws("|", *[trial[n].cast("string") for n in kind.names]) if hasattr(kind, "names") else trial.cast("string")


def split_sets(sampled: DataFrame, up_share: float, seed: int) -> DataFrame:
    """(trial, set, id): each trial's entities, the first share of them in random order as up, the others as down."""
    place = F.row_number().over(W.partitionBy("trial").orderBy(stats.drawn_before(f"split{seed}", _text(sampled, F.col("trial")), F.col("id")), "id"))
    size = F.count(F.lit(1)).over(W.partitionBy("trial"))
    return sampled.select("trial", F.when(place <= F.floor(size * up_share), "up").otherwise("down").alias("set"), "id")


def trial_ngrams(posted: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(set, node) of many sets (set, id) at once: each set's n-grams, collapsed on its own entities.

    A node goes from a set if a node that contains it has as many of the set's entities.
    """
    own = posted.join(nodes.select("ngram"), "ngram", "left_semi").join(members.select("set", "id").distinct(), "id")
    counts = own.groupBy("set", "ngram").agg(F.count(F.lit(1)).alias("c"))
    edges = ngrams.containment_edges(nodes).select("src", "dst")
    longer = counts.select("set", F.col("ngram").alias("dst"), F.col("c").alias("of"))
    gone = counts.join(edges, F.col("ngram") == F.col("src")).join(longer, ["set", "dst"]).where("c = of").select("set", "ngram").distinct()
    return counts.join(gone, ["set", "ngram"], "left_anti").select("set", F.col("ngram").alias("node"))


def stability(posted: DataFrame, nodes: DataFrame, distance: graph.Distances, penalty: DataFrame, members: DataFrame) -> DataFrame:
    """(trial, separation) of trials (trial, set, id) in one plan."""
    keyed = members.select(F.concat_ws("|", "trial", "set").alias("set"), "id")
    found = trial_ngrams(posted, nodes, keyed).select(F.split("set", r"\|")[0].alias("trial"), F.split("set", r"\|")[1].alias("side"), "node")
    side = lambda s: found.where(F.col("side") == s).select(F.col("trial").alias("set"), "node")
    return graph.separation(side("up"), side("down"), distance, penalty).select(F.col("set").cast("long").alias("trial"), "separation")


#: Cutoffs of the pruning sweep: 21 from 1 to 1e-10, evenly in their logarithm.
SWEEP = tuple(10 ** (-k / 2) for k in range(21))


def trial_metrics(posted: DataFrame, nodes: DataFrame, background: DataFrame, distance: graph.Distances, penalty: DataFrame, members: DataFrame, sweep: tuple[float, ...] = SWEEP) -> DataFrame:
    """(trial, separation, iqr) of trials (trial, set, id), set being up or down: the separation of their n-grams, and the distance of the quartiles of the
    separations of those up to each cutoff of their hypergeometric p. All trials and cutoffs are keys of one plan; a side without n-grams gives null.

    background: (id) the entities that enrichment is measured against.
    """
    kind = members.schema["trial"].dataType
    members = members.join(background.select("id").distinct(), "id", "left_semi").select(F.struct("trial", "set").alias("set"), "id").distinct()
    sizes = members.groupBy("set").agg(F.count(F.lit(1)).alias("m"))
    own = posted.join(background.select("id").distinct(), "id", "left_semi").groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    counts = posted.join(members, "id").groupBy("set", "ngram").agg(F.count(F.lit(1)).alias("k"))
    rows = trial_ngrams(posted, nodes, members).withColumnRenamed("node", "ngram").join(counts, ["set", "ngram"]).join(own, "ngram").join(F.broadcast(sizes), "set")
    rows = rows.crossJoin(F.broadcast(background.agg(F.count_distinct("id").alias("total"))))
    tested = graph.cut(stats.hypergeometric_tail(rows, "k", "n", "m", "total").select(F.col("set.trial").alias("trial"), F.col("set.set").alias("side"), F.col("ngram").alias("node"), "p"))
    each = tested.withColumn("cutoff", F.explode(F.array(F.lit(None).cast("double"), *map(F.lit, sweep)))).where(F.col("cutoff").isNull() | stats.up_to(F.col("p"), F.col("cutoff")))
    side = lambda s: each.where(F.col("side") == s).select(F.struct("trial", F.coalesce("cutoff", F.lit(-1.0)).alias("cutoff")).alias("set"), "node")
    found = graph.separation(side("up"), side("down"), distance, penalty).select(F.col("set.trial").alias("trial"), F.col("set.cutoff").alias("cutoff"), "separation")
    spans = found.groupBy("trial").agg(
        F.max(F.when(F.col("cutoff") < 0, F.col("separation"))).alias("separation"),
        (F.percentile(F.when(F.col("cutoff") >= 0, F.col("separation")), 0.75) - F.percentile(F.when(F.col("cutoff") >= 0, F.col("separation")), 0.25)).alias("iqr"))
    return members.select(F.col("set.trial").cast(kind).alias("trial")).distinct().join(spans, "trial", "left").select("trial", "separation", "iqr")


def stability_trials(corpus: DataFrame, members: DataFrame, trials: int, seed: int, share: float = 0.7) -> DataFrame:
    """(trial, set, id) with trials (of, kind, trial): for each pair of sets (of, set, id), up and down, ``trials`` random sets with the pair's distribution of
    lengths at about ``share`` of its size, split by the pair's share of up; and as many subsamples of the pair itself of the random sets' sizes."""
    pair = members.select("of", "set", "id").distinct()
    lengths = pair.join(corpus.select("id", length_of().alias("length")), "id")
    number = corpus.sparkSession.range(trials).select(F.col("id").alias("trial"))
    weights = lengths.groupBy("of", "length").agg(F.round(F.count(F.lit(1)) * share).alias("weight"))
    each = weights.crossJoin(F.broadcast(number)).select(F.struct("of", F.lit("random").alias("kind"), "trial").alias("trial"), "length", "weight")
    chosen = _stratified(corpus, each, seed)
    ups = pair.groupBy("of").agg((F.count_if(F.col("set") == "up") / F.count(F.lit(1))).alias("ups"))
    size = chosen.groupBy("trial").agg(F.count(F.lit(1)).alias("size")).join(ups, F.col("trial.of") == F.col("of")).select("trial", F.floor(F.col("size") * F.col("ups")).alias("n_up"), "size")
    place = F.row_number().over(W.partitionBy("trial").orderBy(stats.drawn_before(f"split{seed}", _text(chosen, F.col("trial")), F.col("id")), "id"))
    random = chosen.join(size, "trial").select("trial", F.when(place <= F.col("n_up"), "up").otherwise("down").alias("set"), "id")
    both = F.explode(F.array(F.struct(F.lit("up").alias("set"), F.col("n_up").alias("take")), F.struct(F.lit("down").alias("set"), (F.col("size") - F.col("n_up")).alias("take"))))
    draws = size.select(F.struct(F.col("trial.of").alias("of"), F.lit("subsample").alias("kind"), F.col("trial.trial").alias("trial")).alias("trial"), both.alias("b"))
    draws = draws.select(F.col("trial.of").alias("of"), F.col("b.set").alias("set"), "trial", F.col("b.take").alias("take"))
    again = stats.drawn(pair, "id", ["of", "set"], draws, lambda t: stats.drawn_before(f"sub{seed}", _text(draws, t), F.col("set"), F.col("id")))
    return random.unionByName(again.select("trial", "set", "id"))


def separation_stability(corpus: DataFrame, posted: DataFrame, nodes: DataFrame, distance: graph.Distances, penalty: DataFrame, members: DataFrame, trials: int, seed: int, sweep: tuple[float, ...] = SWEEP) -> DataFrame:
    """(of, kind, trial, separation, iqr): the metrics of the random and the subsampled trials of each pair of sets (of, set, id)."""
    drawn = graph.cut(stability_trials(corpus, members, trials, seed))
    found = trial_metrics(posted, nodes, corpus.select("id"), distance, penalty, drawn, sweep)
    return found.select("trial.*", "separation", "iqr")


def stability_tests(metrics: DataFrame) -> DataFrame:
    """(of, separation_p, iqr_p): whether random and subsampled trials differ, by Mann-Whitney; values tie if they agree in nine decimals.

    Where all values are one, or one kind has none, nothing speaks for a difference and p is 1."""
    metrics = metrics.withColumns({c: F.round(c, 9) for c in ("separation", "iqr")})
    test = lambda c: stats.mann_whitney(metrics, c, "kind", "random", "subsample", ["of"]).select("of", F.coalesce("p", F.lit(1.0)).alias(f"{c}_p"))
    return test("separation").join(test("iqr"), "of", "full_outer")


def false_positive_checks(corpus: DataFrame, posted: DataFrame, nodes: DataFrame, distance: graph.Distances, penalty: DataFrame, size: int, sets: int, trials: int, seed: int, up_share: float = 0.6, sweep: tuple[float, ...] = SWEEP) -> DataFrame:
    """(of, separation_p, iqr_p) for ``sets`` random pairs of ``size`` entities: what an actual pair's p-values are held against."""
    chosen = split_sets(random_sets(corpus, size, sets, seed), up_share, seed).select(F.col("trial").alias("of"), "set", "id")
    return stability_tests(separation_stability(corpus, posted, nodes, distance, penalty, graph.cut(chosen), trials, seed, sweep))


def check_rates(actual: DataFrame, checks: DataFrame) -> DataFrame:
    """(separation_fpr, iqr_fpr): the share of the checks' p-values up to the actual ones (one row each of separation_p, iqr_p)."""
    own = actual.select(F.col("separation_p").alias("a"), F.col("iqr_p").alias("b"))
    share = lambda c, x: F.avg(stats.up_to(F.col(c), F.col(x)).cast("double"))
    return checks.crossJoin(F.broadcast(own)).agg(share("separation_p", "a").alias("separation_fpr"), share("iqr_p", "b").alias("iqr_fpr"))


def size_sweep(corpus: DataFrame, posted: DataFrame, nodes: DataFrame, distance: graph.Distances, penalty: DataFrame, sizes: list[int], trials: int, seed: int, penalties: list[float | None] = (None,)) -> DataFrame:
    """(size, trial, penalty, separation) of random pairs of disjoint sets of each size, for each penalty of a node that reaches none (None: by its component)."""
    chosen = None
    for n in sizes:
        one = split_sets(random_sets(corpus, 2 * n, trials, seed + n), 0.5, seed).select(F.struct(F.lit(n).alias("size"), "trial").alias("trial"), "set", "id")
        chosen = one if chosen is None else chosen.union(one)
    found = graph.cut(trial_ngrams(posted, nodes, chosen.select(F.struct("trial", "set").alias("set"), "id")))
    side = lambda s: found.where(F.col("set.set") == s).select(F.col("set.trial").alias("set"), "node")
    out = None
    for fixed in penalties:
        one = graph.separation(side("up"), side("down"), distance, penalty, fixed).select("set.*", F.lit(fixed).cast("double").alias("penalty"), "separation")
        out = one if out is None else out.union(one)
    return out


def common_ngrams(sets: DataFrame) -> DataFrame:
    """(up, down, common): sizes of two sets of n-grams (set, node)."""
    each = sets.groupBy("node").agg(F.bool_or(F.col("set") == "up").alias("u"), F.bool_or(F.col("set") == "down").alias("d"))
    return each.agg(F.count_if("u").alias("up"), F.count_if("d").alias("down"), F.count_if(F.col("u") & F.col("d")).alias("common"))


def enriched_ngrams(p_values: DataFrame, cutoff: float) -> DataFrame:
    """(set, ngram) with p below the cutoff, from (set, ngram, p)."""
    return p_values.where(stats.below(F.col("p"), cutoff)).select("set", "ngram")


def enriched_entities(enriched: DataFrame, posted: DataFrame, members: DataFrame) -> DataFrame:
    """(set, id): the members (set, id) that have an enriched n-gram of their set."""
    return enriched.join(posted.select("ngram", "id"), "ngram").join(members, ["set", "id"], "left_semi").select("set", "id").distinct()


def gather_results(p_values: DataFrame, rates: DataFrame) -> DataFrame:
    """(ngram, condition, p, log_p, fpr, passes) from long tables (ngram, condition, p) and (ngram, condition, fpr)."""
    return p_values.where("p is not null").join(rates, ["ngram", "condition"]).select("ngram", "condition", "p", (-F.log10("p")).alias("log_p"), "fpr", (F.col("fpr") <= 0.05).alias("passes"))


def significant(results: DataFrame, rate: float = 0.05, p: float = 0.05) -> DataFrame:
    """Rows of ``gather_results`` whose FPR and p are up to these."""
    return results.where((F.col("fpr") <= rate) & stats.up_to(F.col("p"), p))


def top_quantile(results: DataFrame, q: float) -> DataFrame:
    """All rows of n-grams with any p up to the q-quantile."""
    limit = results.agg(F.percentile("p", q).alias("limit"))
    passing = results.crossJoin(F.broadcast(limit)).where(stats.up_to(F.col("p"), F.col("limit"))).select("ngram").distinct()
    return results.join(passing, "ngram", "left_semi")


def most_informative(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows without those of n-grams that contain another with the same flags in all their conditions."""
    flags = results.groupBy("ngram").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("condition", "passes")))).alias("f"))
    entries = lambda c: F.array_sort(F.map_entries(c))
    short = flags.select(F.col("ngram").alias("src"), entries("f").alias("sf"))
    long = flags.select(F.col("ngram").alias("dst"), entries("f").alias("lf"))
    gone = edges.select("src", "dst").join(short, "src").join(long, "dst").where("sf = lf").select(F.col("dst").alias("ngram")).distinct()
    return results.join(gone, "ngram", "left_anti")


def bitmask(sets: DataFrame, names: list[str], group: str = "set", member: str = "member") -> DataFrame:
    """(mask, count): members by the exact combination of sets that they are in; bit k is the k-th name."""
    bit = sum([F.max(F.when(F.col(group) == n, 1 << k).otherwise(0)) for k, n in enumerate(names)], F.lit(0))
    return sets.where(F.col(group).isin(names)).groupBy(member).agg(bit.cast("long").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("count"))
