"""Information theory over a corpus of token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .corpus import BAR
from .ngrams import named, windows
from .order import with_totals


def token_counts(corpus: DataFrame) -> DataFrame:
    """(token, count) over all occurrences."""
    return corpus.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def f0(corpus: DataFrame) -> DataFrame:
    """(f0): log2 of the number of distinct tokens, to 3 digits."""
    return corpus.select(F.explode("tokens").alias("t")).agg(F.round(F.log2(F.count_distinct("t")), 3).alias("f0"))


def f1(corpus: DataFrame) -> DataFrame:
    """(f1): entropy of the tokens in bits, to 3 digits."""
    whole = with_totals(token_counts(corpus), F.sum("count").alias("all"))
    return whole.select((F.col("count") / F.col("all")).alias("p")).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 3).alias("f1"))


def instance_counts(corpus: DataFrame, longest: int) -> DataFrame:
    """(ngram, n, count): all occurrences, overlaps included. Windows are made once for all equal sequences."""
    alike = corpus.groupBy("tokens").agg(F.count(F.lit(1)).alias("rows"))
    each = named(alike.select("rows", F.explode(windows(F.col("tokens"), longest)).alias("tokens")))
    return each.groupBy("ngram").agg(F.first("n").alias("n"), F.sum("rows").alias("count"))


def frequencies(counts: DataFrame, interest: DataFrame | None = None) -> DataFrame:
    """Adds to (ngram, n, count) frequency (of all), conditional (count by that of the n-gram without its last token; for
    single tokens the count by that of all n-grams), length_total and total.

    interest: (ngram) those that rows and totals are restricted to, of a count of 0 if the corpus lacks them; prefixes may be others. The counts
    have to hold the prefixes, as those of a full extraction do. The conditional of a count of 0 is 0.
    """
    own = counts.select("ngram", "n", "count")
    if interest is not None:
        own = interest.select("ngram").distinct().join(own, "ngram", "left").select("ngram", F.coalesce("n", F.size(F.split("ngram", r"\|")).cast("long")).alias("n"), F.coalesce("count", F.lit(0)).alias("count"))
    known = counts.select(F.col("ngram").alias("prefix"), F.col("count").alias("prefix_count"))
    lengths = own.groupBy(F.col("n").alias("__n")).agg(F.sum("count").alias("length_total"))
    sums = with_totals(own, F.sum("count").alias("total")).join(F.broadcast(lengths), F.col("n") == F.col("__n"))
    joined = sums.withColumn("prefix", F.when(F.col("n") > 1, F.regexp_replace("ngram", r"\|[^|]*$", ""))).join(known, "prefix", "left")
    conditional = F.when(F.col("count") == 0, 0.0).otherwise(F.col("count") / F.coalesce("prefix_count", "total"))
    return joined.select("ngram", "n", "count", (F.col("count") / F.col("total")).alias("frequency"), conditional.alias("conditional"), "length_total", "total")


def fn(frequency: DataFrame, n: int, cumulative: bool = True) -> DataFrame:
    """(fn): the conditional entropy over n-grams of up to, or of just, n tokens."""
    own = with_totals(frequency.where(F.col("n") <= n if cumulative else F.col("n") == n).where("count > 0"), F.sum("count").alias("all"))
    return own.select((F.col("count") / F.col("all")).alias("p"), "conditional").agg((-F.sum(F.col("p") * F.log2("conditional"))).alias("fn"))


def of_model(kept: DataFrame, removed: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(ngram) of a network's model: its nodes and what they stand for, and with a corpus all its tokens."""
    every = kept.select("ngram").union(removed.select("ngram"))
    return (every if corpus is None else every.union(corpus.select(F.explode("tokens").alias("ngram")))).distinct()


def model_frequencies(kept: DataFrame, removed: DataFrame, corpus: DataFrame, longest: int) -> DataFrame:
    """The frequencies of the nodes and what they stand for, by their occurrences in the corpus."""
    counts = instance_counts(corpus, longest)
    return frequencies(counts, of_model(kept, removed))


def fn_of_model(kept: DataFrame, removed: DataFrame, corpus: DataFrame, n: int, cumulative: bool = False) -> DataFrame:
    """(fn): the conditional entropy of a network's n-grams and the corpus' tokens of up to, or of just, n tokens."""
    counts = instance_counts(corpus, n)
    size = F.size(F.split("ngram", r"\|"))
    return fn(frequencies(counts, of_model(kept, removed, corpus).where(size <= n if cumulative else size == n)), n, cumulative)


def gains(kept: DataFrame, removed: DataFrame, corpus: DataFrame, lengths: list[int]) -> DataFrame:
    """(n, fn, gain): the cumulative entropy of a model at each length, and what it gains over that of the tokens."""
    first, out = f1(corpus), None
    for n in lengths:
        one = fn_of_model(kept, removed, corpus, n, True).crossJoin(F.broadcast(first)).select(F.lit(n).cast("long").alias("n"), "fn", (F.col("f1") - F.col("fn")).alias("gain"))
        out = one if out is None else out.union(one)
    return out


def last_token_share(counts: DataFrame) -> DataFrame:
    """(ngram, n, share): of n-grams over one token, the count by that of all with the same length and last token."""
    rows = counts.where("n > 1").withColumn("last", F.element_at(F.split("ngram", r"\|"), -1))
    same = rows.groupBy("n", "last").agg(F.sum("count").alias("same"))
    return rows.join(same, ["n", "last"]).select("ngram", "n", (F.col("count") / F.col("same")).alias("share"))


def cross_entropy(p: DataFrame, q: DataFrame) -> DataFrame:
    """(cross_entropy): sum of -p.frequency log2 q.conditional; an n-gram that q lacks makes it null."""
    other = q.select("ngram", F.col("conditional").alias("c"))
    joined = p.join(other, "ngram", "left")
    missing = F.count_if(F.col("c").isNull())
    return joined.agg(F.when(missing == 0, -F.sum(F.col("frequency") * F.log2("c"))).alias("cross_entropy"))


def relative_entropy(p: DataFrame, q: DataFrame) -> DataFrame:
    """(relative_entropy): sum of p.frequency log2(p.conditional / q.conditional); null as above."""
    other = q.select("ngram", F.col("conditional").alias("c"))
    joined = p.join(other, "ngram", "left")
    missing = F.count_if(F.col("c").isNull())
    return joined.agg(F.when(missing == 0, F.sum(F.col("frequency") * F.log2(F.col("conditional") / F.col("c")))).alias("relative_entropy"))


def simpson(counts: DataFrame, side: str = "pro") -> DataFrame:
    """(ngram, diversity): 1 - Simpson's index of the counts of the n-grams one token longer that start ("pro") or end
    ("retro") with it; null where they count one or less."""
    t = F.split("ngram", r"\|")
    base = F.array_join(F.slice(t, 1, F.size(t) - 1) if side == "pro" else F.slice(t, 2, F.size(t) - 1), BAR)
    longer = counts.where("n > 1").select(base.alias("base"), F.col("count").alias("c"))
    sums = longer.groupBy("base").agg(F.sum("c").alias("all"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
    value = F.when(F.col("all") > 1, 1 - F.col("pairs") / (F.col("all") * (F.col("all") - 1)))
    return counts.join(sums, counts.ngram == sums.base, "left").select("ngram", value.alias("diversity"))


def shared_members(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, both): members that two groups a < b share, for pairs that share any.

    A member is reduced to the groups that it is in first, and equal ones are counted before their pairs are made, so a hot member is one row.
    """
    groups = rows.where(F.col(group).isNotNull() & F.col(member).isNotNull()).groupBy(F.col(member).alias("m")).agg(F.sort_array(F.collect_set(group)).alias("gs"))
    return _pairs(groups.where(F.size("gs") > 1).groupBy("gs").agg(F.count(F.lit(1)).alias("n")))


def _pairs(alike: DataFrame) -> DataFrame:
    """(a, b, both) from the sorted groups gs of members and the number n of members that are in just these."""
    pairs = alike.select("n", "gs", F.posexplode("gs").alias("i", "a")).select("n", "a", F.explode(F.slice("gs", F.col("i") + 2, F.size("gs"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("both"))


def jaccard(sets: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, jaccard) of all pairs of groups a < b that have members, from (group, member) rows.

    Members are reduced to the groups that they are in, which gives sizes and what is shared, so the rows are made and shuffled once. A null member counts, but is shared by none."""
    rows = sets.select(F.col(group).alias("a"), F.col(member).alias("m")).distinct()
    groups = rows.groupBy("m").agg(F.sort_array(F.collect_set("a")).alias("gs"))
    alike = graph.cut(groups.groupBy("gs", F.col("m").isNull().alias("none")).agg(F.count(F.lit(1)).alias("n")))
    sizes = alike.select(F.explode("gs").alias("a"), "n").groupBy("a").agg(F.sum("n").alias("size"))
    names = sizes.select("a", F.col("size").alias("na")).join(sizes.select(F.col("a").alias("b"), F.col("size").alias("nb")), F.col("a") < F.col("b"))
    return names.join(_pairs(alike.where("not none")), ["a", "b"], "left").select("a", "b", (F.coalesce("both", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("both", F.lit(0)))).alias("jaccard"))
