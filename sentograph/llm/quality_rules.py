"""Quality rules: base counts of every document and a decision list learned from labels.

Sequential covering: while documents of low quality are left, grow a conjunction of thresholds that covers them
purely, prune it on rows that were held back, and put it on the list if it is pure enough, else set its region aside and grow
elsewhere. The list becomes an ordered chain of Spark
conditional expressions. Everything on the path is DataFrame functions; the driver sees only counts by cell of the
threshold grid, whose number is bounded by the grid and not by the data.

Defined results: a null text counts as empty; a document without words has all counts 0 and fails the base rules;
repeated rows are judged one by one; an empty table gives an empty result; labels that are null, or whose document is
missing, are left out; without any low-quality label the list is empty and keeps what the base rules keep. Columns of
the input that bear the name of a result column are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that the list may test, in the order in which ties are settled.
FEATURES = ("symbols_per_word", "repeat_share", "dup_lines_per_100", "chars_per_word", "n_words")
#: Words of a window whose repetition counts.
WINDOW = 3
#: Up to so many repeated windows are looked up one by one.
FEW = 16


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, operator, threshold); documents that meet it are rejected."""

    tests: tuple[tuple[str, str, float], ...]
    bad: int
    good: int

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {x:g}" for f, op, x in self.tests) + f" -> reject ({self.bad} low, {self.good} high)"


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts as longs, over the whole text.

    Windows of three words are told apart by 64-bit hashes; only texts in which a hash repeats sort theirs.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    first = df.drop(*[c for c in COUNTS if c in df.columns]).withColumns({
        "__words": F.array_remove(F.split(body, f"{SPACE}+", -1), ""),
        "__lines": F.when(body.contains("\n"), lines).otherwise(F.array().cast("array<string>")),
        "word_chars": F.length(F.regexp_replace(body, f"{SPACE}+", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
    })
    words = F.col("__words")
    second = first.withColumns({
        "n_words": F.size(words).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__windows": F.when(F.size(words) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")),
    }).drop("__words", "__lines")
    w = F.col("__windows")
    # Equal hashes lie side by side in sorted order. Where few differ, a look at each window finds its places; else the
    # sorted (hash, place) pairs have them.
    ordered = F.col("__ordered")
    third = second.withColumn("__ordered", F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(w)))
    third = third.withColumn("__again", F.array_distinct(F.filter(ordered, lambda x, k: x == F.try_element_at(ordered, k + 2)))).drop("__ordered")
    again, pairs = F.col("__again"), F.col("__pairs")
    third = third.withColumn("__pairs", F.when(F.size(again) > FEW, F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = F.filter(pairs, lambda x, k: (x["h"] == F.try_element_at(pairs, k + 2)["h"]) | ((k > 0) & (x["h"] == F.element_at(pairs, F.greatest(k, F.lit(1)))["h"])))
    places = (
        F.when(F.size(again) > FEW, F.sort_array(F.transform(near, lambda x: x["i"])))
        .when(F.size(again) > 0, F.filter(F.transform(w, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull()))
    )
    fourth = third.withColumn("__places", places)
    covered = F.aggregate(
        F.col("__places"), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__windows", "__again", "__pairs", "__places")


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_lines_per_100": 100 * F.col("n_dup_lines") / n,
        "chars_per_word": F.col("word_chars") / n,
        "n_words": F.col("n_words").cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _thresholds(rows: DataFrame, steps: int) -> dict[str, list[float]]:
    """Quantiles of each feature over the labelled rows, of the low-quality ones and of all, as exact aggregates."""
    at = [(k + 1) / (steps + 1) for k in range(steps)]
    got = rows.agg(*[F.percentile(f, F.array(*map(F.lit, at))).alias(f) for f in FEATURES], *[F.percentile(F.when(F.col("quality") == 0, F.col(f)), F.array(*map(F.lit, at))).alias(f"low_{f}") for f in FEATURES]).first()
    return {f: sorted({*(got[f] or ()), *(got[f"low_{f}"] or ())}) for f in FEATURES}


def learn(rows: DataFrame, steps: int = 4, most_rules: int = 8, most_tests: int = 3, purity: float = 0.99, least: int = 10, most_tries: int = 64) -> list[Rule]:
    """The decision list for rows of FEATURES, quality (0 or 1) and fold (0 to 2; 2 is held back for pruning).

    steps: quantiles a feature, twice; the grid has at most (2 * steps + 1) ** 5 cells, which bounds what the driver gets.
    purity: a rule stays if at least this share of the held-back rows that it covers, and of all that it covers, is of low quality;
    least: and so many of all. A conjunction that doesn't stay is set aside: growing leaves out what it covers from then on, and
    goes on elsewhere, for at most most_tries conjunctions and most_rules rules. Ties go to the first test in order of feature, threshold and operator.
    """
    cuts = _thresholds(rows, steps)
    cell = [sum([(F.col(f) > x).cast("int") for x in cuts[f]], F.lit(0)).alias(f) for f in FEATURES]
    low = F.col("quality") == 0
    counts = rows.select(*cell, (F.col("fold") == 2).alias("part"), "quality").groupBy(*FEATURES, "part").agg(F.count_if(low).alias("bad"), F.count_if(~low).alias("good")).collect()
    return cover([(tuple(r[f] for f in FEATURES), r["part"], r["bad"], r["good"]) for r in counts], cuts, most_rules, most_tests, purity, least, most_tries)


def cover(cells: list[tuple], cuts: dict[str, list[float]], most_rules: int, most_tests: int, purity: float, least: int, most_tries: int) -> list[Rule]:
    """The list from counts by cell: (number of thresholds below the value for each feature, whether held back, low, high)."""
    import numpy as np

    cells = sorted(cells)
    place = np.array([c[0] for c in cells], np.int64).reshape(len(cells), len(FEATURES))
    back, low, high = (np.array([c[k] for c in cells]) for k in (1, 2, 3))
    back = back.astype(bool)
    tests = [(k, j, op) for k, f in enumerate(FEATURES) for j in range(len(cuts[f])) for op in (">", "<=")]
    meets = [(place[:, k] > j) == (op == ">") for k, j, op in tests]
    left, aside, rules = np.ones(len(cells), bool), np.zeros(len(cells), bool), []
    total = lambda over: (int(low[over].sum()), int(high[over].sum()))
    both = lambda chosen: np.logical_and.reduce([meets[t] for t in chosen]) if chosen else np.ones(len(cells), bool)

    def worth(chosen):
        b, g = total(left & back & both(chosen))
        return (b - g) / (b + g) if b + g else -1.0

    for _ in range(most_tries):
        here, chosen = left & ~aside & ~back, []
        bad, good = total(here)
        if len(rules) >= most_rules or not bad:
            break
        while good and bad and len(chosen) < most_tests:
            was, best, gain = math.log2(bad / (bad + good)), None, 1e-9
            for t, hit in enumerate(meets):
                b, g = total(here & hit)
                if b >= least and (x := b * (math.log2(b / (b + g)) - was)) > gain + 1e-12:
                    best, gain = t, x
            if best is None:
                break
            chosen.append(best)
            here = here & meets[best]
            bad, good = total(here)
        if not chosen:
            break
        grown = here
        # Prune: leave off tests while that does not lower the worth on the rows held back.
        while len(chosen) > 1:
            shorter = max(([t for t in chosen if t != x] for x in chosen), key=worth)
            if worth(shorter) < worth(chosen):
                break
            chosen = shorter
        bad, good = total(left & both(chosen))
        held = total(left & back & both(chosen))
        if bad < least or bad < purity * (bad + good) or held[0] < purity * sum(held) or not held[0]:
            aside |= grown
            continue
        rules.append(Rule(tuple((FEATURES[tests[t][0]], tests[t][2], cuts[FEATURES[tests[t][0]]][tests[t][1]]) for t in chosen), bad, good))
        left &= ~both(chosen)
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept by the list, number of the first rule that rejects or null): an ordered chain of conditions."""
    ratio, which = features(), None
    for k, rule in enumerate(rules):
        meets = F.lit(True)
        for f, op, x in rule.tests:
            meets = meets & ((ratio[f] > x) if op == ">" else (ratio[f] <= x))
        which = F.when(meets, k) if which is None else which.when(meets, k)
    which = F.lit(None).cast("int") if which is None else which
    return which.isNull(), which.cast("int")


def sampled(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, quality), once an id: all labels, or about ``most`` of them by hash of their id.

    A label that is given twice with both values counts as low quality.
    """
    n = labels.count()
    keep = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if n > most:
        keep = keep.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return keep.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def labelled(counted: DataFrame) -> DataFrame:
    """FEATURES, quality and fold of counted documents with a quality."""
    return counted.select(*[c.alias(f) for f, c in features().items()], "quality", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)).alias("fold"))


def judge(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, kept and rule (number of the rejecting rule, or null) to counted documents."""
    good, which = verdict(rules)
    return df.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & good, "rule": which})


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", most_labels: int = 200_000) -> list[Rule]:
    """The list for documents by labels; only documents of the sample are counted.

    most_labels: the documented bound of the sample of labelled rows on which the list is fitted; the sample is broadcast.
    """
    own = documents.select("doc_id", text).join(F.broadcast(sampled(labels, most_labels)), "doc_id")
    return _learned(labelled(with_counts(own, text)))


def _learned(rows: DataFrame) -> list[Rule]:
    """The sample's features are kept for the two passes over them, and no longer."""
    kept_rows = rows.cache()
    try:
        return learn(kept_rows)
    finally:
        kept_rows.unpersist()


def quality_rules(documents: DataFrame, labels: DataFrame, text: str = "text", most_labels: int = 200_000, store=None) -> tuple[DataFrame, list[Rule]]:
    """Documents with counts and verdicts, and the list.

    store: writes the counts of all documents once, and gives back just those with doc_id and the verdicts; without it all
    columns stay, and documents of the sample are counted twice.
    """
    if store is None:
        rules = fit(documents, labels, text, most_labels)
        return judge(with_counts(documents, text), rules), rules
    counted = store(with_counts(documents.select("doc_id", text), text).drop(text))
    rules = _learned(labelled(counted.join(F.broadcast(sampled(labels, most_labels)), "doc_id")))
    return judge(counted, rules), rules


def kept(documents: DataFrame, labels: DataFrame, text: str = "text", most_labels: int = 200_000) -> DataFrame:
    """The documents that the base rules and the list keep, with their columns as they are. No row is shuffled."""
    rules = fit(documents, labels, text, most_labels)
    rows = documents.select(F.struct("*").alias("__row"), F.col(text).alias("text"))
    # The row number, which no filter moves below, keeps the optimizer from writing the counts out in the filter, each within the next.
    judged = judge(with_counts(rows), rules).select("__row", "kept", F.monotonically_increasing_id().alias("__nth"))
    return judged.where("kept and __nth >= 0").select("__row.*")
