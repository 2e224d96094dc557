"""Corpora: entities with an ordered array of tokens, and the columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between tokens where a sequence is written as one string.
BAR = "|"


def annotations(packed: Column) -> Column:
    """Array of (name, id, start, end) from ``name:id:start:end;...``; empty for an empty or null string."""
    part = F.filter(F.split(F.coalesce(packed, F.lit("")), ";"), lambda x: x != "")
    return F.transform(part, lambda x: (lambda f: F.struct(f[0].alias("name"), F.get(f, 1).alias("id"), F.get(f, 2).cast("int").alias("start"), F.get(f, 3).cast("int").alias("end")))(F.split(x, ":")))


def tokens(architecture: Column, keep_empty: bool = False) -> Column:
    """Array of tokens of a bar-joined string. An empty string is no token, or one empty token with keep_empty."""
    own = F.split(F.coalesce(architecture, F.lit("")), r"\|", -1)
    return own if keep_empty else F.when(F.coalesce(architecture, F.lit("")) == "", F.array().cast("array<string>")).otherwise(own)


def architecture(ids: Column) -> Column:
    return F.array_join(ids, BAR)


def with_architecture(df: DataFrame, packed: str, column: str = "architecture") -> DataFrame:
    """Adds the bar-joined ids of an annotation column; leaves the frame as it is if the column is there."""
    return df if column in df.columns else df.withColumn(column, architecture(F.transform(annotations(F.col(packed)), lambda a: a["id"])))


def true_length(sequence: Column) -> Column:
    """Tokens of an array, 0 if it is empty or null."""
    return F.coalesce(F.size(sequence), F.lit(0)).cast("long")


def with_ends(sequence: Column, first: str = "Nterm", last: str = "Cterm") -> Column:
    """The tokens between two marks."""
    return F.concat(F.array(F.lit(first)), sequence, F.array(F.lit(last)))


def first_names(rows: DataFrame, key: str, name: str, order: list[Column]) -> DataFrame:
    """(key, name): the first name seen for each key by the given order."""
    return rows.groupBy(key).agg(F.min_by(name, F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias(name))


def legible(ngrams: DataFrame, names: DataFrame, sequence: str = "tokens", out: str = "legible") -> DataFrame:
    """Adds the n-gram with each token's name (names: token, name); tokens without a name stay."""
    places = ngrams.select("ngram", F.posexplode(sequence).alias("place", "token")).join(names, "token", "left")
    joined = places.groupBy("ngram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("name", "token").alias("name")))), lambda x: x["name"]), BAR).alias(out))
    return ngrams.join(joined, "ngram")


def homopolymer(sequence: Column, least: int = 4) -> Column:
    """``token x k`` for a run of one token of at least ``least``, else null."""
    return F.when((F.size(F.array_distinct(sequence)) == 1) & (F.size(sequence) >= least), F.concat(sequence[0], F.lit(" x "), F.size(sequence).cast("string")))


def ordered_tokens(rows: DataFrame, key: str, token: str, order: list[str]) -> DataFrame:
    """(id, tokens) from a row for each token, in the given total order."""
    packed = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(token).alias("token"))))
    return rows.groupBy(F.col(key).alias("id")).agg(F.transform(packed, lambda x: x["token"]).alias("tokens"))


def latest_file_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key: that of the file listed last."""
    names = [c for c in rows.columns if c not in (key, ordinal)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.col(ordinal)).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in names])


def renamed_postings(posted: DataFrame, names: DataFrame) -> DataFrame:
    """(id, ngram) with each token's name: names are not unique, so n-grams that get one name are one."""
    called = legible(posted.select("ngram", "tokens").dropDuplicates(["ngram"]), names).select("ngram", "legible")
    return posted.join(called, "ngram").select("id", F.col("legible").alias("ngram")).distinct()


def renamed_adjacency(adjacency: DataFrame, names: DataFrame) -> DataFrame:
    """(row, col, value) with each token's name; of entries that get one place the largest counts."""
    every = adjacency.select(F.col("row").alias("ngram")).union(adjacency.select("col")).distinct().withColumn("tokens", F.split("ngram", r"\|"))
    called = legible(every, names).select("ngram", "legible")
    row, col = called.toDF("row", "__r"), called.toDF("col", "__c")
    return adjacency.join(row, "row").join(col, "col").groupBy(F.col("__r").alias("row"), F.col("__c").alias("col")).agg(F.max("value").alias("value"))


def spans_of(annotated: DataFrame) -> DataFrame:
    """(token, entities, copies, sizes): for each token of annotated entities (id, token, start, end) its copies in each entity and its spans, both sorted."""
    each = annotated.groupBy("token", "id").agg(F.count(F.lit(1)).alias("c"), F.collect_list(F.col("end") - F.col("start")).alias("s"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("entities"), F.sort_array(F.collect_list("c")).alias("copies"), F.sort_array(F.flatten(F.collect_list("s"))).alias("sizes"))
