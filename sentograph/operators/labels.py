"""Labels and classes derived from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entropy import shared_members
from .order import with_totals


def renamed(column: Column, changes: list[tuple[str, str]]) -> Column:
    """Literal replacements one after another."""
    for old, new in changes:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def metric_of(variable: Column) -> Column:
    """The part before the first space, and of that before the first underscore."""
    return F.split_part(F.split_part(variable, F.lit(" "), F.lit(1)), F.lit("_"), F.lit(1))


def condition_of(sample: Column, pattern: str = r"[._-]?(rep)?\d+$") -> Column:
    """A sample's name without its replicate number."""
    return F.regexp_replace(sample, pattern, "")


def dispersion_class(value: Column, low: float = 1.25, high: float = 2.5) -> Column:
    return F.when(value.isNull(), None).when(value <= low, "Low").when(value <= high, "Med").otherwise("High")


def side_class(rows: DataFrame, by: str, member: str, first: DataFrame, second: DataFrame, names: tuple[str, str] = ("pY", "pST")) -> DataFrame:
    """(by, class): whether a group has members of the first list, the second, both or none. Lists have the member column."""
    marked = rows.join(first.select(F.col(member).alias("__a")).distinct(), F.col(member) == F.col("__a"), "left").join(second.select(F.col(member).alias("__b")).distinct(), F.col(member) == F.col("__b"), "left")
    a, b = F.bool_or(F.col("__a").isNotNull()), F.bool_or(F.col("__b").isNotNull())
    return marked.groupBy(by).agg(F.when(a & b, "Both").when(a, names[0]).when(b, names[1]).otherwise("None").alias("class"))


def role_table(roles: DataFrame) -> DataFrame:
    """(token, role) from (nth, role, tokens): of a token with several roles that with the largest nth counts."""
    return roles.select("nth", "role", F.explode("tokens").alias("token")).groupBy("token").agg(F.max_by("role", "nth").alias("role"))


def node_roles(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """(ngram, role): the role of a node's tokens, Multiple if they differ, null without any."""
    each = nodes.select("ngram", F.explode("tokens").alias("token")).join(roles, "token")
    found = each.groupBy("ngram").agg(F.count_distinct("role").alias("n"), F.min("role").alias("r"))
    return nodes.select("ngram").join(found, "ngram", "left").select("ngram", F.when(F.col("n") > 1, "Multiple").otherwise(F.col("r")).alias("role"))


def one_hot(rows: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each level but the first; none for a single level."""
    return rows.select("*", *[(F.col(column) == x).cast("int").alias(f"{column}_{x}") for x in levels[1:]])


def node_sides(nodes: DataFrame, up: DataFrame, down: DataFrame) -> DataFrame:
    """(ngram, side): Up, Down, Both or None by the sets (ngram) that a node is in."""
    a, b = (df.select(F.col("ngram").alias(n)).distinct() for df, n in ((up, "__u"), (down, "__d")))
    both = nodes.select("ngram").join(a, F.col("ngram") == F.col("__u"), "left").join(b, F.col("ngram") == F.col("__d"), "left")
    u, d = F.col("__u").isNotNull(), F.col("__d").isNotNull()
    return both.select("ngram", F.when(u & d, "Both").when(u, "Up").when(d, "Down").otherwise("None").alias("side"))


def bucket_count(members: DataFrame, key: str, group: str, most: int = 3) -> DataFrame:
    """(bucket, n, share): keys by the number of groups that they are in, from ``most`` on together. Rows without a group count as in none."""
    sizes = members.groupBy(key).agg(F.count_distinct(group).alias("k"))
    label = F.when(F.col("k") >= most, F.lit(f"{most}+")).otherwise(F.col("k").cast("string"))
    counts = sizes.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return with_totals(counts, F.sum("n").alias("all")).select("bucket", "n", (F.col("n") / F.col("all")).alias("share"))


def overlap_share(members: DataFrame, group: str, key: str) -> DataFrame:
    """(a, b, share): of the members of a those in b, for pairs that share any."""
    rows = members.select(F.col(group).alias("a"), F.col(key).alias("k")).distinct()
    sizes = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    one = shared_members(rows, "a", "k")
    both = one.union(one.select("b", "a", "both"))
    return both.join(sizes, "a").select("a", "b", (F.col("both") / F.col("n")).alias("share"))


def resolve_redundant(entries: DataFrame, by: str, key: str, order: list[Column]) -> DataFrame:
    """One entry of each group, the first by the given preferences (a total order; ties go to the smaller key)."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("k"))
    names = [c for c in entries.columns if c != by]
    return entries.groupBy(by).agg(F.min_by(F.struct(*names), rank).alias("r")).select(by, *[F.col(f"r.{c}").alias(c) for c in names])


def common_and_unique(rows: DataFrame, key: str, group: str, value: str, top: int = 6) -> DataFrame:
    """(key, kind, mean): keys in all groups (common) or in one (unique), the ``top`` of each kind by mean value."""
    from pyspark.sql import Window as W

    total = rows.agg(F.count_distinct(group).alias("t"))
    stats = rows.groupBy(key).agg(F.count_distinct(group).alias("n"), F.avg(value).alias("mean")).crossJoin(F.broadcast(total))
    kinds = stats.select(key, F.when(F.col("n") == F.col("t"), "common").when(F.col("n") == 1, "unique").alias("kind"), "mean").where("kind is not null")
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.col("mean").desc(), key))
    return kinds.withColumn("p", place).where(F.col("p") <= top).drop("p")


def mixed_tops(nodes: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Two lists (ngram, n, support) of the ``top`` nodes by support, ties by name: those of two tokens or more that hold more than two different
    ones or are of at most three, and those of one token, or of up to three that differ."""
    size, kinds = F.size("tokens"), F.size(F.array_distinct("tokens"))
    first = lambda rows: rows.select("ngram", "n", "support").orderBy(F.col("support").desc(), "ngram").limit(top)
    return first(nodes.where((size >= 2) & ((kinds > 2) | (size <= 3)))), first(nodes.where((size == 1) | ((kinds >= 2) & (size <= 3))))


def plotted(results: DataFrame, metric: str) -> DataFrame:
    """(comparison, fpr, cohen, p_log, passes, sign, score, category) of a metric from rows (comparison, metric, variable, value) with the variables
    ``<metric>_FPR``, ``<metric> Cohen`` and ``<metric> p_log``: category 0 where the effect is positive, else 1."""
    own = results.where(F.col("metric") == metric)
    of = lambda name: F.max(F.when(F.col("variable") == name, F.col("value")))
    wide = own.groupBy("comparison").agg(of(f"{metric}_FPR").alias("fpr"), of(f"{metric} Cohen").alias("cohen"), of(f"{metric} p_log").alias("p_log"))
    sign = F.coalesce(F.col("cohen") > 0, F.lit(False))
    return wide.select("*", F.coalesce(F.col("fpr") <= 0.05, F.lit(False)).alias("passes"), sign.alias("sign"), F.abs("cohen").alias("score"), F.when(sign, 0).otherwise(1).alias("category"))


def transposed(rows: DataFrame, key: str, values: list[str], columns: list[str]) -> DataFrame:
    """(variable, a column for each of ``columns``): the values of each key, of which the first in order counts if it repeats."""
    long = rows.unpivot(key, values, "variable", "__value")
    return long.groupBy("variable").pivot(key, columns).agg(F.min("__value"))
