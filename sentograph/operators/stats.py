"""Statistics as aggregates: effect sizes, rank tests, hypergeometric tails, resampling, false-positive rates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order
from .corpus import BAR
from .ngrams import gathered, names


#: Computed p-values that differ by this share are the same: their last digits depend on the order of additions.
TIE = 1e-9


def up_to(p: Column, limit: Column | float) -> Column:
    """p <= limit, where p is a computed probability that may be off in its last digits."""
    return p <= limit * F.lit(1 + TIE)


def below(p: Column, limit: Column | float) -> Column:
    """p < limit, likewise."""
    return p < limit * F.lit(1 - TIE)


def drawn_before(seed: Column | str, *parts: Column) -> Column:
    """A reproducible random order: the MD5 of seed and parts."""
    return F.md5(F.concat_ws(BAR, F.lit(seed).cast("string") if not isinstance(seed, Column) else seed.cast("string"), *[p.cast("string") for p in parts]))


def drawn(rows: DataFrame, key: str, by: list[str], draws: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(trial, by..., key): of each group of ``by`` and each of its draws (by..., trial, take) the first ``take`` rows in random order.

    digest: a row's MD5 from the trial's column. A row is looked at for every trial where it is, and goes on only if its MD5 is among those
    that take, ten standard deviations and thirty more are expected to be under, so what is shuffled grows with what is
    drawn. Were there too few (a chance below 1e-20), an error is raised.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"))
    share = F.least(F.lit(1.0), (F.col("take") + 10 * F.sqrt("take") + 30) / F.col("__all"))
    limit = F.when(share >= 1, "g").otherwise(F.lower(F.lpad(F.hex(F.floor(share * 2.0**32)), 8, "0")))
    each = draws.join(sizes, by).withColumn("limit", limit) if by else draws.crossJoin(F.broadcast(sizes)).withColumn("limit", limit)
    packed = each.groupBy(*by).agg(F.collect_list(F.struct("trial", "take", "limit", "__all")).alias("__draws"))
    own = rows.join(F.broadcast(packed), by) if by else rows.crossJoin(F.broadcast(packed))
    tried = F.transform("__draws", lambda d: F.struct(d["trial"].alias("trial"), d["take"].alias("take"), d["limit"].alias("limit"), d["__all"].alias("all"), digest(d["trial"]).alias("h")))
    near = own.select(*by, key, F.explode(F.filter(tried, lambda d: d["h"] < d["limit"])).alias("d")).select("d.*", *by, key)
    group = W.partitionBy("trial", *by)
    placed = near.withColumns({"__place": F.row_number().over(group.orderBy("h", key)), "__near": F.count(F.lit(1)).over(group)})
    enough = F.when(F.col("__near") < F.least("take", "all"), F.raise_error(F.lit("too few rows are under the limit of a draw"))).otherwise(True).cast("boolean")
    return placed.where(enough & (F.col("__place") <= F.col("take"))).select("trial", *by, key)


def cohen_d(rows: DataFrame, value: str, group: str, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by..., d): difference of the means of groups a and b by their pooled deviation; 0 if that is 0. Rows without a value count in the sizes."""
    of = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    size = lambda g: F.count_if(F.col(group) == g)
    na, nb = size(a), size(b)
    pooled = F.sqrt(((na - 1) * of(a, F.var_samp) + (nb - 1) * of(b, F.var_samp)) / (na + nb - 2))
    d = F.when(pooled == 0, 0.0).otherwise((of(a, F.avg) - of(b, F.avg)) / pooled)
    return rows.groupBy(*(by or [])).agg(d.alias("d"))


def upper_normal(z: Column) -> Column:
    """P(Z >= z) for z >= 0, by the continued fraction far out and by the series near 0; relative error below 1e-12."""
    steps = F.sequence(F.lit(60), F.lit(1), F.lit(-1))
    density = F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    far = density / F.aggregate(steps, z, lambda acc, k: z + k / acc)
    term = lambda acc, k: F.struct((acc["t"] * z * z / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * z * z / (2 * k + 1)).alias("s"))
    near = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(z.alias("t"), z.alias("s")), term, lambda acc: acc["s"])
    return F.when(z > 3, far).otherwise(near)


def mann_whitney(rows: DataFrame, value: str, group: str, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by..., u, p): U of group a and the two-sided asymptotic p with tie and continuity correction; p is null where all values are one."""
    by = by or []
    own = rows.where(F.col(value).isNotNull() & F.col(group).isin(a, b))
    level = own.groupBy(*by, value).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(group) == a).alias("in_a"))
    ranked = order.running(level, value, {"before": "t"}, by).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("in_a")).alias("r"), F.sum("in_a").alias("na"), F.sum(F.col("t") - F.col("in_a")).alias("nb"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("na") + F.col("nb")
    u = F.col("r") - F.col("na") * (F.col("na") + 1) / 2
    middle = F.col("na") * F.col("nb") / 2
    spread = F.sqrt(F.col("na") * F.col("nb") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), (F.abs(u - middle) - 0.5) / F.nullif(spread, F.lit(0.0)))
    return sums.select(*by, u.alias("u"), F.when(spread > 0, F.least(F.lit(1.0), 2 * upper_normal(z))).alias("p"))


#: ln x! of the first numbers.
_SMALL = 32


def log_factorial(x: Column) -> Column:
    """ln x! of whole numbers: exact for small ones, else by Stirling's series, with an error below 1e-14 of the result."""
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(_SMALL)])
    x = x.cast("double")
    large = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(x < _SMALL, F.try_element_at(table, (F.greatest(x, F.lit(0.0)) + 1).cast("int"))).otherwise(large)


def hypergeometric_tail(rows: DataFrame, k: str, n: str, m: str, total: str) -> DataFrame:
    """Adds p = P(X >= k) of drawing m from total, n of which count. Rows with k = 0 have p = 1.

    Above the mean the tail is summed upwards from k, else what lies below k is summed downwards and taken from 1. Each term comes from
    the one before by a ratio; only those are taken that may weigh something, some tens of standard deviations at most. No row is shuffled.
    """
    K, N, M, T = (F.col(c).cast("double") for c in (k, n, m, total))
    mean = N * M / T
    spread = F.sqrt(F.greatest(F.lit(0.0), mean * (T - N) * (T - M) / (T * F.greatest(T - 1, F.lit(1.0)))))
    least, most = F.greatest(F.lit(0.0), N + M - T), F.least(N, M)
    rest = T - N - M

    def log_term(i):
        plus, minus = (N, T - N, M, T - M), (i, N - i, M - i, rest + i, T)
        return sum((log_factorial(x) for x in plus), F.lit(0.0)) - sum((log_factorial(x) for x in minus), F.lit(0.0))

    def terms(start, ratio, count, far):
        """The sum of the terms from start on by the first; ratio: of the j-th following one to that before it."""
        first = ratio(F.lit(0.0))
        falling = F.when(first <= 0, 0.0).when(first < 1, F.ceil(-40 / F.ln(first)))
        steps = F.least(count, falling, F.when(F.abs(start - mean) < 8 * spread, F.ceil(far))).cast("int")
        places = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
        add = lambda acc, j: (lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s")))(acc["t"] * ratio(j.cast("double")))
        return F.aggregate(places, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), add, lambda acc: acc["s"])

    above = F.exp(log_term(K)) * terms(K, lambda j: (N - K - j) * (M - K - j) / ((K + j + 1) * (rest + K + j + 1)), most - K, mean + 20 * spread + 50 - K)
    top = K - 1
    below = F.exp(log_term(top)) * terms(top, lambda j: (top - j) * (rest + top - j) / ((N - top + j + 1) * (M - top + j + 1)), top - least, top - (mean - 20 * spread - 50))
    p = F.when(K <= least, 1.0).when(K > most, 0.0).when(K > mean, above).otherwise(1 - below)
    return rows.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def upper_chi2(x: Column, df: int) -> Column:
    """P(X >= x) of the chi-square distribution of a whole number of degrees of freedom."""
    half = x / 2
    if df % 2 == 0:
        return F.exp(-half) * sum((F.pow(half, F.lit(float(i))) / math.factorial(i) for i in range(df // 2)), F.lit(0.0))
    return 2 * upper_normal(F.sqrt(x)) + F.exp(-half) * sum((F.pow(half, F.lit(i - 0.5)) / math.gamma(i + 0.5) for i in range(1, (df + 1) // 2)), F.lit(0.0))


def enrichment(posted: DataFrame, ngrams: DataFrame, foreground: DataFrame, background: DataFrame) -> DataFrame:
    """(ngram, k, n, m, total, p): over-representation of each n-gram's entities in the foreground (id), against the background (id)."""
    inside = foreground.join(background, "id", "left_semi").distinct().withColumn("fg", F.lit(1))
    own = posted.join(ngrams.select("ngram"), "ngram", "left_semi").join(background.distinct(), "id", "left_semi").join(inside, "id", "left")
    counts = own.groupBy("ngram").agg(F.count("fg").alias("k"), F.count(F.lit(1)).alias("n"))
    sizes = background.agg(F.count_distinct("id").alias("total")).crossJoin(inside.agg(F.count_distinct("id").alias("m")))
    return hypergeometric_tail(counts.crossJoin(F.broadcast(sizes)), "k", "n", "m", "total")


def enrichment_of(corpus: DataFrame, longest: int, foreground: DataFrame) -> DataFrame:
    """``enrichment`` of a corpus' n-grams of up to ``longest`` tokens against all its ids: those of equal sequences are counted before windows are made."""
    whole = gathered(corpus.where("id is not null")).join(foreground.select("id").distinct().withColumn("fg", F.lit(1)), "id", "left")
    alike = whole.groupBy("sequences").agg(F.count("fg").alias("k"), F.count(F.lit(1)).alias("n"))
    counts = alike.select("k", "n", F.explode(names(F.col("sequences"), longest)).alias("ngram")).groupBy("ngram").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    sizes = alike.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("k"), F.lit(0)).alias("m"))
    return hypergeometric_tail(counts.crossJoin(F.broadcast(sizes)), "k", "n", "m", "total")


def false_positive_rate(actual: DataFrame, null: DataFrame, by: list[str], strict: bool = False) -> DataFrame:
    """(by..., p, fpr): share of the null p-values up to (strict: below) the actual one, among the null rows of the group; 0 without any."""
    other = null.select(*by, F.col("p").alias("null_p"))
    hit = (below if strict else up_to)(F.col("null_p"), F.col("p"))
    return actual.join(other, by, "left").groupBy(*by, "p").agg(F.coalesce(F.avg(F.when(F.col("null_p").isNotNull(), hit.cast("double"))), F.lit(0.0)).alias("fpr"))


def dispersion(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., iqr, mad, std, cv) without nulls; std of the population."""
    middle = rows.groupBy(*by).agg(F.median(value).alias("__m"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"), F.stddev_pop(value).alias("std"), F.avg(value).alias("__a"))
    off = rows.join(middle, by).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("mad"), F.first("iqr").alias("iqr"), F.first("std").alias("std"), (F.first("std") / F.first("__a")).alias("cv"))
    return off.select(*by, "iqr", "mad", "std", "cv")


def bootstrap_mann_whitney(rows: DataFrame, value: str, group: str, a: str, b: str, size: int, trials: int, seed: int, key: str | None = None) -> DataFrame:
    """(trial, u, p) of samples of ``size`` from each group, all trials in one plan. key: the column that tells rows apart (None: a hash of all columns)."""
    name = F.xxhash64(*rows.columns) if key is None else F.col(key)
    own = rows.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(group, value, F.struct(value, name.alias("h")).alias("__key"))
    number = rows.sparkSession.range(trials).select(F.col("id").alias("trial"), F.lit(size).alias("take"))
    draws = number.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(a,), (b,)], f"{group} string")))
    found = drawn(own, "__key", [group], draws, lambda t: drawn_before(str(seed), t, F.col("__key")["h"]))
    return mann_whitney(found.select("trial", group, F.col("__key")[value].alias(value)), value, group, a, b, ["trial"])


def quartile_span(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., iqr): the distance of the quartiles, without nulls."""
    return rows.groupBy(*by).agg((F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"))
