"""Survival curves and comparisons, from (duration, event, stratum) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order


def event_flag(status, codes: dict[str, int] | None = None):
    """1 or 0 from a status text: its first character, or by a table."""
    if codes is None:
        return F.try_to_number(F.substring(status, 1, 1), F.lit("9")).cast("int")
    out = None
    for text, flag in codes.items():
        out = F.when(status == text, flag) if out is None else out.when(status == text, flag)
    return out


def at_risk(rows: DataFrame) -> DataFrame:
    """(stratum, duration, deaths, risk): a row for each time at which something ends."""
    own = rows.where("duration is not null and event is not null").groupBy("stratum", "duration").agg(F.sum("event").alias("deaths"), F.count(F.lit(1)).alias("gone"))
    later = order.running(own.withColumn("back", -F.col("duration")), "back", {"later": "gone"}, ["stratum"])
    return later.select("stratum", "duration", "deaths", (F.col("later") + F.col("gone")).alias("risk"))


def kaplan_meier(rows: DataFrame) -> DataFrame:
    """(stratum, duration, deaths, risk, survival)."""
    table = at_risk(rows).withColumns({"log": F.when(F.col("deaths") < F.col("risk"), F.ln(1 - F.col("deaths") / F.col("risk"))).otherwise(0.0), "none": (F.col("deaths") == F.col("risk")).cast("long")})
    upto = order.running(table, "duration", {"logs": "log", "ended": "none"}, ["stratum"])
    return upto.select("stratum", "duration", "deaths", "risk", F.when(F.col("ended") + F.col("none") > 0, 0.0).otherwise(F.exp(F.col("logs") + F.col("log"))).alias("survival"))


def log_rank(rows: DataFrame) -> DataFrame:
    """(stratum, observed, expected): what the log-rank test compares, for any number of strata."""
    times = rows.where("duration is not null and event is not null")
    every = times.groupBy("duration").agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("gone"))
    later = order.running(every.withColumn("back", -F.col("duration")), "back", {"later": "gone"})
    share = later.select("duration", (F.col("d") / (F.col("later") + F.col("gone"))).alias("share"))
    # A subject of duration t is at risk at all death times up to t: its expectation is the sum of d/n so far.
    hazard = order.running(share, "duration", {"before": "share"}).select("duration", (F.col("before") + F.col("share")).alias("h"))
    return times.join(hazard, "duration").groupBy("stratum").agg(F.sum("event").alias("observed"), F.sum("h").alias("expected"))


def log_rank_test(rows: DataFrame, most: int = 100) -> DataFrame:
    """(chi2, df, p) of all strata at once, by the hypergeometric covariance of their deaths. Only the sums of a matrix over the strata, of which
    there may be ``most``, come to the driver. One stratum gives no row; strata that can't be told apart a null."""
    import numpy as np

    from .stats import upper_chi2

    own = rows.where("duration is not null and event is not null and stratum is not null")
    names = [r["stratum"] for r in own.select("stratum").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} strata")
    names, spark = sorted(names)[:-1], rows.sparkSession
    schema = "chi2 double, df int, p double"
    if not names:
        return spark.createDataFrame([], schema)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    level = own.groupBy("duration").agg(
        F.sum("event").alias("d"), F.count(F.lit(1)).alias("g"), *[F.count_if(F.col("stratum") == x).alias(f"g{i}") for i, x in enumerate(names)],
        *[F.sum(F.when(F.col("stratum") == x, F.col("event")).otherwise(0)).alias(f"d{i}") for i, x in enumerate(names)])
    counts = ["g", *[f"g{i}" for i in range(len(names))]]
    risk = order.running(level.withColumn("back", -F.col("duration")), "back", {f"n{c[1:]}": c for c in counts})
    risk = risk.withColumns({f"n{c[1:]}": F.col(f"n{c[1:]}") + F.col(c) for c in counts}).where("d > 0")
    share = [F.col(f"n{i}") / F.col("n") for i in range(len(names))]
    weight = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    got = risk.agg(*[F.sum(F.col(f"d{i}") - F.col("d") * s).alias(f"z{i}") for i, s in enumerate(share)], *[F.sum(weight * share[i] * (int(i == j) - share[j])).alias(f"v{i}_{j}") for i, j in pairs]).first()
    z, v = np.array([got[f"z{i}"] or 0.0 for i in range(len(names))]), np.zeros((len(names), len(names)))
    for i, j in pairs:
        v[i, j] = v[j, i] = got[f"v{i}_{j}"] or 0.0
    chi2 = float(z @ np.linalg.solve(v, z)) if np.linalg.matrix_rank(v) == len(names) else None
    one = spark.createDataFrame([(chi2, len(names))], "chi2 double, df int")
    return one.withColumn("p", upper_chi2(F.col("chi2"), len(names)))


def log_rank_pair(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, p) of two strata, by the hypergeometric variance."""
    from .stats import upper_normal

    own = rows.where(F.col("stratum").isin(a, b) & F.col("duration").isNotNull() & F.col("event").isNotNull())
    level = own.groupBy("duration").agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("g"), F.sum(F.when(F.col("stratum") == a, F.col("event")).otherwise(0)).alias("da"), F.count_if(F.col("stratum") == a).alias("ga"))
    later = order.running(level.withColumn("back", -F.col("duration")), "back", {"n": "g", "na": "ga"})
    risk = later.withColumns({"n": F.col("n") + F.col("g"), "na": F.col("na") + F.col("ga")}).where("d > 0")
    e = F.col("d") * F.col("na") / F.col("n")
    v = F.when(F.col("n") > 1, e * (1 - F.col("na") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    sums = risk.agg(F.sum(F.col("da") - e).alias("o"), F.sum(v).alias("v"))
    chi2 = F.col("o") * F.col("o") / F.nullif(F.col("v"), F.lit(0.0))
    return sums.select(chi2.alias("chi2"), (2 * upper_normal(F.sqrt(chi2))).alias("p"))


def log_rank_pairs(rows: DataFrame, most: int = 30) -> DataFrame:
    """(a, b, chi2, p) of all pairs of strata a < b, of at most ``most`` strata."""
    names = sorted(r["stratum"] for r in rows.where("duration is not null and event is not null and stratum is not null").select("stratum").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} strata")
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            one = log_rank_pair(rows, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "chi2", "p")
            out = one if out is None else out.union(one)
    return out if out is not None else rows.sparkSession.createDataFrame([], "a string, b string, chi2 double, p double")


def cox_sample_size(power_z: float, alpha_z: float, ratio: float, p_exposed: float, p_control: float, hazard: float) -> tuple[int, int]:
    """Subjects (exposed, control) for a two-sided test of a hazard ratio, at normal quantiles of power and level."""
    import math

    events = (1 / ratio) * ((ratio * hazard + 1) / (hazard - 1)) ** 2 * (alpha_z + power_z) ** 2
    control = events / (ratio * p_exposed + p_control)
    return math.ceil(control * ratio), math.ceil(control)


#: Terms of a sum over tied deaths that are added one by one; what more there are is a difference of digamma functions.
DIRECT = 16


def tied_sums(a: Column, d: Column) -> tuple[Column, Column]:
    """The sums of 1/u and 1/u**2 over u = a, a - 1, ..., a - d + 1, for a >= d >= 1; work doesn't grow with d."""
    few = F.least(d, F.lit(DIRECT).cast("long"))
    least = a - d + 1
    add = lambda acc, i: F.struct((acc["one"] + 1 / (least + i)).alias("one"), (acc["two"] + 1 / ((least + i) * (least + i))).alias("two"))
    small = F.aggregate(F.sequence(F.lit(0).cast("long"), few - 1), F.struct(F.lit(0.0).alias("one"), F.lit(0.0).alias("two")), add)
    x, y, rest = a + 1, least + few, d - few  # rest terms: the difference of digamma, and of trigamma, at x and y, by their series
    power = lambda k: F.pow(x, F.lit(-float(k))) - F.pow(y, F.lit(-float(k)))
    apart = rest / (x * y)
    one = -F.log1p(-rest / x) + apart / 2 - power(2) / 12 + power(4) / 120 - power(6) / 252
    two = apart - power(2) / 2 - power(3) / 6 + power(5) / 30 - power(7) / 42
    more = lambda c: F.when(rest > 0, c).otherwise(0.0)
    return small["one"] + more(one), small["two"] + more(two)


def cox(rows: DataFrame, covariates: list[str], penalizer: float = 0.01, steps: int = 20, tolerance: float = 1e-9) -> dict[str, float]:
    """Coefficients of a proportional-hazards model with Efron's ties, by Newton steps with a ridge penalty.

    Of d deaths at a time, the l-th meets a risk from which l/d of the dying is taken away; the sums over l are closed (``tied_sums``). Raises if the coefficients don't settle in so many
    steps. Each step sums over subjects by time and then over times from the last to the first, both as aggregates; the driver gets sums only.
    """
    import numpy as np

    known = rows.where("duration is not null and event is not null").dropna(subset=covariates).select("duration", "event", *covariates).cache()
    n, k = known.count(), len(covariates)
    beta = np.zeros(k)
    x = [F.col(c).cast("double") for c in covariates]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    died = F.col("event").cast("double")
    settled = False
    for _ in range(steps):
        risk = F.exp(sum((b * c for b, c in zip(beta.tolist(), x)), F.lit(0.0)))
        parts = {"0": risk} | {f"1_{i}": risk * c for i, c in enumerate(x)} | {f"2_{i}_{j}": risk * x[i] * x[j] for i, j in pairs}
        level = known.groupBy("duration").agg(
            F.sum("event").cast("long").alias("d"), *[F.sum(v).alias(f"s{m}") for m, v in parts.items()], *[F.sum(died * v).alias(f"q{m}") for m, v in parts.items()], *[F.sum(died * c).alias(f"e_{i}") for i, c in enumerate(x)])
        later = order.running(level.withColumn("back", -F.col("duration")), "back", {f"l{m}": f"s{m}" for m in parts}).where("d > 0")
        at = later.withColumns({f"s{m}": F.col(f"l{m}") + F.col(f"s{m}") for m in parts})
        s, q, d = (lambda m: F.col(f"s{m}")), (lambda m: F.col(f"q{m}")), F.col("d")
        one, two = tied_sums(s("0") * d / q("0"), d)
        at = at.withColumns({"one": one, "two": two, "scale": d / q("0")})
        off = lambda m: s(m) - s("0") * q(m) / q("0")  # noqa: B023, E731
        over = lambda m: F.col("scale") * (off(m) * F.col("one") + q(m))  # noqa: B023, E731
        product = lambda i, j: F.col("scale") * F.col("scale") * (off(f"1_{i}") * off(f"1_{j}") * F.col("two") + (off(f"1_{i}") * q(f"1_{j}") + off(f"1_{j}") * q(f"1_{i}")) / d * F.col("one") + q(f"1_{i}") * q(f"1_{j}") / d)  # noqa: B023, E731
        got = at.agg(*[F.sum(F.col(f"e_{i}") - over(f"1_{i}")).alias(f"g_{i}") for i in range(k)], *[F.sum(over(f"2_{i}_{j}") - product(i, j)).alias(f"h_{i}_{j}") for i, j in pairs]).first()
        gradient = np.array([got[f"g_{i}"] or 0.0 for i in range(k)], float) - n * penalizer * beta
        hessian = np.zeros((k, k))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = got[f"h_{i}_{j}"] or 0.0
        step = np.linalg.solve(hessian + n * penalizer * np.eye(k), gradient)
        beta = beta + step
        if settled := np.abs(step).max() < tolerance:
            break
    known.unpersist()
    if not settled:
        raise RuntimeError(f"the coefficients did not settle in {steps} steps")
    return dict(zip(covariates, beta.tolist()))


def strata(subjects: DataFrame, fusions: DataFrame, key: str = "patient") -> DataFrame:
    """Adds stratum: No Fusion, Single or Multiple, by the fusions of a subject."""
    counts = fusions.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    joined = subjects.join(counts, F.col(key) == F.col("__k"), "left")
    return joined.withColumn("stratum", F.when(F.col("__n").isNull(), "No Fusion").when(F.col("__n") == 1, "Single").otherwise("Multiple")).drop("__k", "__n")


def of_patients(samples: DataFrame, patients: DataFrame, endings: tuple[str, ...] = ("A", "B"), sample: str = "sample", patient: str = "patient") -> DataFrame:
    """The rows of samples with their patient: a sample's id is the patient's and one of the endings. Samples of no known patient are left out."""
    ids = patients.select(F.col(patient).alias("__p")).distinct().select("__p", F.explode(F.array(*[F.concat(F.col("__p"), F.lit(e)) for e in endings])).alias("__s"))
    return samples.join(ids, F.col(sample) == F.col("__s")).withColumn(patient, F.col("__p")).drop("__p", "__s")
