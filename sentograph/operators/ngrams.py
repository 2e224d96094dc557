"""Contiguous n-grams: windows, postings, support, closed sets, containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import BAR


def windows(sequence: Column, longest: int) -> Column:
    """Array of all contiguous windows of up to ``longest`` tokens."""
    size = F.size(sequence)
    starts = F.filter(F.sequence(F.lit(0), size), lambda i: i > 0)
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda k: F.slice(sequence, i, k))))


def seeded_windows(sequence: Column, seeds: list[str], longest: int | None = None, mode: str = "complete") -> Column:
    """Windows that hold a seed.

    complete: all of up to ``longest`` tokens. compat: those to a seed's left of up to ``longest`` tokens, and from a
    seed or the token before it to an absolute end of at most ``longest``; windows that reach to both sides otherwise are left out.
    """
    wanted = F.array(*[F.lit(s) for s in seeds])
    size = F.size(sequence)
    cap = size if longest is None else F.lit(longest)
    if mode == "complete":
        return F.filter(windows(sequence, longest or 2**30) if longest else _all(sequence), lambda w: F.arrays_overlap(w, wanted))
    places = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda t: F.array_contains(wanted, F.get(sequence, t)))
    span = lambda a, b: F.slice(sequence, a + 1, b - a)  # noqa: E731  half-open, from 0
    upto = lambda lo, hi: F.filter(F.sequence(F.least(lo, hi), F.greatest(lo, hi)), lambda x: (x >= lo) & (x <= hi))
    end = F.least(size, cap)

    def around(t):
        left = F.transform(upto(F.greatest(F.lit(0), t - cap + 1), t - 1), lambda a: span(a, t + 1))
        right = F.transform(upto(t + 2, end), lambda b: span(t, b))
        both = F.when(t >= 1, F.transform(upto(t + 2, end), lambda b: span(t - 1, b))).otherwise(F.array().cast("array<array<string>>"))
        return F.concat(left, right, both, F.array(span(t, t + 1)))

    return F.array_distinct(F.flatten(F.transform(places, around)))


def _all(sequence: Column) -> Column:
    size = F.size(sequence)
    starts = F.filter(F.sequence(F.lit(0), size), lambda i: i > 0)
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda k: F.slice(sequence, i, k))))


def named(rows: DataFrame) -> DataFrame:
    """Adds ngram (bar-joined) and n to rows with tokens."""
    return rows.withColumns({"ngram": F.array_join("tokens", BAR), "n": F.size("tokens").cast("long")})


def instances(corpus: DataFrame, longest: int) -> DataFrame:
    """(id, tokens, ngram, n): a row for each occurrence of a window, overlaps included."""
    return named(corpus.select("id", F.explode(windows(F.col("tokens"), longest)).alias("tokens")))


def postings(corpus: DataFrame, longest: int, seeds: list[str] | None = None, mode: str = "complete", together: bool = False) -> DataFrame:
    """Distinct (id, ngram, n, tokens). Sequences of an id are put together, and their windows made distinct there: no task holds the windows of many.

    together: ids of equal sequences are one, as in ``alike``, with their number in entities, which ``support`` and ``collapse`` count."""
    own = lambda s: windows(s, longest) if seeds is None else seeded_windows(s, seeds, longest, mode)
    whole = alike(corpus) if together else corpus.groupBy("id").agg(F.collect_set("tokens").alias("sequences"))
    return named(whole.select(*[c for c in whole.columns if c != "sequences"], F.explode(F.array_distinct(F.flatten(F.transform("sequences", own)))).alias("tokens")))


def _entities(posted: DataFrame) -> Column:
    return F.sum("entities") if "entities" in posted.columns else F.count(F.lit(1))


def gathered(corpus: DataFrame) -> DataFrame:
    """(id, sequences): the distinct sequences of each id, in one order."""
    return corpus.groupBy("id").agg(F.sort_array(F.collect_set("tokens")).alias("sequences"))


def alike(corpus: DataFrame) -> DataFrame:
    """(id, sequences, entities): ids of equal sequences as one, the smallest, with their number. So windows are made once for all of them."""
    return gathered(corpus).groupBy("sequences").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("entities")).select("id", "sequences", "entities")


def names(sequences: Column, longest: int) -> Column:
    """The distinct n-grams, bar-joined, of the windows of an array of sequences."""
    return F.array_distinct(F.flatten(F.transform(sequences, lambda s: F.transform(windows(s, longest), lambda w: F.array_join(w, BAR)))))


def supported(corpus: DataFrame, longest: int, least: int = 1) -> DataFrame:
    """``support`` of the ``postings`` of a corpus, without making those: sequences that ids share are looked at once, and n-grams are counted by name.

    Tokens go along only for sequences whose tokens the name does not give back."""
    odd = F.exists(F.flatten("sequences"), lambda x: x.isNull() | x.contains(BAR))
    none = F.lit(None).cast("array<string>")
    plain = F.transform(names(F.col("sequences"), longest), lambda g: F.struct(g.alias("ngram"), none.alias("own")))
    whole = F.transform(F.array_distinct(F.flatten(F.transform("sequences", lambda s: windows(s, longest)))), lambda w: F.struct(F.array_join(w, BAR).alias("ngram"), w.alias("own")))
    each = alike(corpus).select("entities", F.explode(F.when(odd, whole).otherwise(plain)).alias("w")).groupBy("w.ngram", "w.own").agg(F.sum("entities").alias("c"))
    counted = each.groupBy("ngram").agg(F.first("own", True).alias("own"), F.sum("c").alias("support")).withColumn("tokens", F.coalesce("own", F.split("ngram", r"\|", -1)))
    found = counted.select("ngram", F.size("tokens").cast("long").alias("n"), "tokens", "support")
    return found if least <= 1 else found.where(F.col("support") >= least)


def support(posted: DataFrame, least: int = 1) -> DataFrame:
    """(ngram, n, tokens, support) of n-grams with at least so many entities."""
    # Counted by hash first: a first array is no value for a hash map, and all postings would be sorted for it.
    each = posted.groupBy("ngram", "n", "tokens").agg(_entities(posted).alias("c"))
    counted = each.groupBy("ngram").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.sum("c").alias("support"))
    return counted if least <= 1 else counted.where(F.col("support") >= least)


def _parents(supported: DataFrame) -> DataFrame:
    """(sub, support): the two n-grams that lack an end of each, with its support."""
    t = F.col("tokens")
    ends = F.array(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1))
    return supported.where("n > 1").select(F.explode(ends).alias("sub"), "support").select(F.array_join("sub", BAR).alias("sub"), F.col("support").alias("of"))


def closed(supported: DataFrame) -> DataFrame:
    """Those n-grams of a full extraction that no longer one with the same entities contains.

    All windows are there, so it is enough to look at n-grams one token longer, and for the same entities at equal support.
    """
    parents = _parents(supported)
    return supported.join(parents, (F.col("ngram") == F.col("sub")) & (F.col("support") == F.col("of")), "left_anti")


def collapsed(supported: DataFrame) -> DataFrame:
    """Those that ``closed`` leaves out."""
    parents = _parents(supported)
    return supported.join(parents, (F.col("ngram") == F.col("sub")) & (F.col("support") == F.col("of")), "left_semi")


def proper_windows(nodes: DataFrame) -> DataFrame:
    """(sub, ngram): each n-gram with all its shorter windows, once each."""
    t = F.col("tokens")
    shorter = F.filter(_all(t), lambda w: F.size(w) < F.size(t))
    return nodes.where("n > 1").select("ngram", F.explode(F.array_distinct(shorter)).alias("sub")).select(F.array_join("sub", BAR).alias("sub"), "ngram")


def collapse(posted: DataFrame, longest_kept: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) for any set of postings, seeded ones too: an n-gram goes if a longer one that contains it has all its entities.

    longest_kept: over that length it is the longer one that goes instead.
    """
    supported = support(posted)
    # What an entity has is put together once, and the pairs that it holds are counted before they are shuffled.
    mine = posted.groupBy("id").agg(F.collect_set("ngram").alias("mine"))
    many = [c for c in posted.columns if c == "entities"]
    longer = posted.where("n > 1").select("id", "ngram", *many, F.array_distinct(F.filter(_all(F.col("tokens")), lambda w: F.size(w) < F.col("n"))).alias("subs"))
    held = longer.join(mine, "id").select("ngram", *many, F.explode(F.array_intersect(F.transform("subs", lambda w: F.array_join(w, BAR)), "mine")).alias("sub"))
    shared = held.groupBy("sub", "ngram").agg(_entities(held).alias("both"))
    sized = shared.join(supported.select(F.col("ngram").alias("sub"), F.col("support").alias("own"), F.col("n").alias("short")), "sub").join(supported.select("ngram", F.col("n").alias("long")), "ngram")
    within = sized.where("both = own")
    gone = within.select(F.col("sub").alias("ngram")) if longest_kept is None else within.select(F.when(F.col("long") <= longest_kept, F.col("sub")).otherwise(F.col("ngram")).alias("ngram"))
    gone = gone.distinct()
    return supported.join(gone, "ngram", "left_anti"), supported.join(gone, "ngram", "left_semi")


def containment_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, weight): src is a shorter window of dst, both among the nodes; weight is the support of dst.

    The shorter windows are exploded and joined by equality; the literal substring predicate would be a nested loop.
    """
    known = nodes.select(F.col("ngram").alias("sub"))
    return proper_windows(nodes).join(known, "sub", "left_semi").join(nodes.select("ngram", "support"), "ngram").select(F.col("sub").alias("src"), F.col("ngram").alias("dst"), F.col("support").alias("weight"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, col, value): the sparse adjacency, with the support on the diagonal."""
    return nodes.select(F.col("ngram").alias("row"), F.col("ngram").alias("col"), F.col("support").alias("value")).union(edges.select("src", "dst", "weight"))


def length_cutoff(lengths: DataFrame, share: float = 0.8) -> DataFrame:
    """(n): the first length by which more than ``share`` of the counts (n, count) is reached. There is a row for each length."""
    packed = lengths.agg(F.sort_array(F.collect_list(F.struct("n", "count"))).alias("ls"), F.sum("count").alias("all"))
    upto = lambda n: F.aggregate(F.transform(F.filter("ls", lambda y: y["n"] <= n), lambda y: y["count"]), F.lit(0).cast("long"), lambda a, c: a + c)
    return packed.select(F.array_min(F.transform(F.filter("ls", lambda x: upto(x["n"]) / F.col("all") > share), lambda x: x["n"])).alias("n"))


def entity_count(kept: DataFrame, supported: DataFrame, ngrams: DataFrame) -> DataFrame:
    """(ngram, standing_for, support): for a collapsed n-gram the shortest kept n-gram that contains it with the same support."""
    asked = supported.join(ngrams, "ngram", "left_semi")
    holds = proper_windows(kept).union(kept.select("ngram", "ngram")).toDF("sub", "of")
    found = asked.join(holds, asked.ngram == holds["sub"]).join(kept.select(F.col("ngram").alias("of"), F.col("support").alias("s"), F.col("n").alias("m")), "of").where("s = support")
    return found.groupBy("ngram", "support").agg(F.min_by("of", F.struct("m", "of")).alias("standing_for")).select("ngram", "standing_for", "support")


def analysis(corpus: DataFrame, longest: int, least: int = 1, seeds: list[str] | None = None, mode: str = "complete", concat: bool = True, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All steps: postings, kept and removed n-grams, edges. store: keeps what several steps follow from, so it is made once."""
    posted = store(postings(corpus, longest, seeds, mode))
    known = store(support(posted, least))
    if not concat:
        return {"postings": posted, "kept": known, "removed": known.limit(0), "edges": store(containment_edges(known))}
    kept, removed = map(store, (closed(known), collapsed(known)) if seeds is None and least <= 1 else collapse(posted.join(known.select("ngram"), "ngram", "left_semi")))
    return {"postings": posted, "kept": kept, "removed": removed, "edges": store(containment_edges(kept))}
