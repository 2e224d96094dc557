"""Facades: an n-gram network over a corpus, and the differential analysis of two sets on it."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentograph.operators import diff, graph, hubs, ngrams, stats


@dataclass(frozen=True)
class Options:
    """longest: tokens of an n-gram at most. least: entities that an n-gram needs. seeds: tokens one of which it has to hold.
    mode: of seeded extraction. concat: whether n-grams collapse."""

    longest: int = 10
    least: int = 1
    seeds: tuple[str, ...] | None = None
    mode: str = "complete"
    concat: bool = True

    def __post_init__(self):
        if self.longest < 1:
            raise ValueError("longest has to be at least 1")
        if self.mode not in ("complete", "compat"):
            raise ValueError("mode is complete or compat")


class NgramNetwork:
    """The containment network of a corpus (id, tokens), computed when it is asked for and kept in the reliable checkpoint folder, where lost executors take nothing away."""

    def __init__(self, corpus: DataFrame, options: Options = Options()):
        self.corpus, self.options = corpus, options

    @classmethod
    def from_saved(cls, corpus: DataFrame, adjacency: DataFrame, removed: DataFrame, options: Options = Options()) -> NgramNetwork:
        """The network of a saved adjacency (row, col, value) and its removed n-grams (ngram): only postings are made anew, without the removed ones."""
        net = cls(corpus, options)
        posted = ngrams.postings(corpus, options.longest, list(options.seeds) if options.seeds else None, options.mode).join(removed.select("ngram"), "ngram", "left_anti")
        kept = ngrams.support(posted, options.least).join(adjacency.select(F.col("row").alias("ngram")).union(adjacency.select("col")).distinct(), "ngram", "left_semi")
        edges = adjacency.where("row <> col").select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("weight"))
        net.__dict__["_steps"] = {k: graph.cut(v) for k, v in (("postings", posted), ("kept", kept), ("removed", removed.select("ngram")), ("edges", edges))}
        return net

    @cached_property
    def _steps(self) -> dict[str, DataFrame]:
        o = self.options
        return ngrams.analysis(self.corpus, o.longest, o.least, list(o.seeds) if o.seeds else None, o.mode, o.concat, graph.cut)

    def release(self) -> None:
        """Forgets all that was computed; Spark's cleaner removes checkpoints that nothing refers to, if it is set to."""
        for k in ("_steps", "components", "labels", "penalties", "adjacency"):
            self.__dict__.pop(k, None)

    postings = property(lambda self: self._steps["postings"])
    nodes = property(lambda self: self._steps["kept"])
    removed = property(lambda self: self._steps["removed"])
    edges = property(lambda self: self._steps["edges"])

    @cached_property
    def adjacency(self) -> DataFrame:
        return ngrams.adjacency(self.nodes, self.edges)

    @cached_property
    def components(self) -> DataFrame:
        return graph.cut(graph.components(self.nodes, self.edges))

    @cached_property
    def labels(self) -> DataFrame:
        """Distances to hubs, from which those of any two n-grams follow."""
        return hubs.distance_labels(self.nodes, self.edges)

    @cached_property
    def penalties(self) -> DataFrame:
        return graph.cut(graph.penalties(self.components, hubs.diameters(self.components, self.labels)))

    def entities_of(self, ids: DataFrame | None = None, ngram: DataFrame | None = None) -> DataFrame:
        """Corpus rows by id or by n-gram, one of the two."""
        if (ids is None) == (ngram is None):
            raise ValueError("give ids or ngram, and not both")
        wanted = ids if ids is not None else self.postings.join(ngram.select("ngram"), "ngram", "left_semi").select("id")
        return self.corpus.join(wanted.select("id").distinct(), "id", "left_semi")

    def summary(self, detailed: bool = False) -> DataFrame:
        """(metric, value)."""
        parts = [("entities", self.corpus), ("ngrams", self.nodes), ("isolates", graph.isolates(self.nodes, self.edges)), ("components", self.components.select("component").distinct())]
        if detailed:
            parts += [("collapsed", self.removed), ("edges", self.edges)]
        out = None
        for name, df in parts:
            one = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
            out = one if out is None else out.union(one)
        if detailed:
            longest = self.corpus.agg(F.max(F.size("tokens")).cast("long").alias("value")).select(F.lit("longest").alias("metric"), "value")
            out = out.union(longest)
        return out

    def validate(self) -> None:
        """Raises if the corpus is empty or has no token, or the n-grams don't fit the greatest length that is asked for; warns if that is over the longest sequence."""
        row = self.corpus.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("tokens")).alias("longest")).first()
        if not row["n"]:
            raise ValueError("the corpus is empty")
        if (row["longest"] or 0) < 1:
            raise ValueError("no sequence has a token")
        size = F.size(F.split("ngram", r"\|"))
        kept, removed = (df.agg(F.max(size)).first()[0] or 0 for df in (self.nodes, self.removed))
        if max(kept, removed) > self.options.longest:
            raise ValueError(f"n-grams have up to {max(kept, removed)} tokens, more than {self.options.longest}")
        if kept < row["longest"] and kept != self.options.longest:
            raise ValueError(f"the longest n-gram has {kept} tokens, not {self.options.longest}")
        if self.options.longest > row["longest"]:
            warnings.warn(f"no sequence has {self.options.longest} tokens", stacklevel=2)

    def random_entities(self, count: int, trials: int, seed: int) -> DataFrame:
        """(trial, id): seeded samples without replacement."""
        return diff.random_sets(self.corpus, count, trials, seed)


class Differential:
    """Sets that go up and down on a network: their n-grams, separation and enrichment."""

    def __init__(self, network: NgramNetwork, contrasts: DataFrame, mapping: DataFrame | None = None):
        self.network = network
        self.rows = contrasts if mapping is None else diff.with_entity_ids(contrasts, mapping)

    def sets(self, contrast: str, alpha: float = 0.05, fold: float = 1.0) -> DataFrame:
        """(set, id), set being up or down."""
        return diff.select_sets(self.rows.where(F.col("contrast") == contrast), alpha, fold)

    def ngrams(self, contrast: str, alpha: float = 0.05, fold: float = 1.0, side: str = "up") -> DataFrame:
        """(ngram, ...) of a side, collapsed on the side's own entities."""
        return self._ngrams(self.sets(contrast, alpha, fold), side)

    def _ngrams(self, sets: DataFrame, side: str) -> DataFrame:
        options = self.network.options
        return diff.set_ngrams(self.network.postings, self.network.nodes, sets.where(F.col("set") == side.lower()), not options.seeds or options.mode == "complete")

    def separation(self, contrast: str, alpha: float = 0.05, fold: float = 1.0, penalty: float | None = None) -> DataFrame:
        """(set, separation) of the up and down n-grams; no row if a side is empty."""
        up, down = (self.ngrams(contrast, alpha, fold, s).select(F.lit(contrast).alias("set"), F.col("ngram").alias("node")) for s in ("up", "down"))
        return graph.separation_by_search(up, down, self.network.components, self.network.edges, penalty)

    def enrichment(self, contrast: str, alpha: float = 0.05, fold: float = 1.0, side: str = "up") -> DataFrame:
        own = self.sets(contrast, alpha, fold).where(F.col("set") == side.lower()).select("id")
        return stats.enrichment(self.network.postings, self.ngrams(contrast, alpha, fold, side), own, self.network.corpus.select("id"))

    def summary(self, contrast: str, alpha: float = 0.05, fold: float = 1.0, detailed: bool = False) -> DataFrame:
        """(metric, value) as text: the contrast, the thresholds and the sizes of both sides; detailed: also those of their n-grams and of what they share."""
        sets = graph.cut(self.sets(contrast, alpha, fold))
        count = lambda df: df.agg(F.count(F.lit(1)).cast("string").alias("value"))
        parts = [(name, sets.sparkSession.createDataFrame([(str(v),)], "value string")) for name, v in (("contrast", contrast), ("alpha", alpha), ("fold", fold))]
        parts += [(s, count(sets.where(F.col("set") == s))) for s in ("up", "down")]
        if detailed:
            up, down = (graph.cut(self._ngrams(sets, s).select("ngram")) for s in ("up", "down"))
            parts += [("up n-grams", count(up)), ("down n-grams", count(down)), ("common n-grams", count(up.join(down, "ngram", "left_semi")))]
        out = None
        for name, df in parts:
            one = df.select(F.lit(name).alias("metric"), "value")
            out = one if out is None else out.union(one)
        return out
