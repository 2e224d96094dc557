"""URL filters as a temporal list join.

Lists are logs of dated entries that add or remove a pattern. They become validity intervals, and every capture is
evaluated against the entries active at the time of its fetch. A capture's URL gives the keys of all patterns that can match it: its host, every
domain above, and every path prefix; so the join is on equal keys, and its as-of part is on equal spans of time as
well: an interval stands in each span that it reaches into, and a capture in its own.

Patterns: kind "host" (that host), "domain" (it and all hosts below, of a single label too), "prefix" (host and leading path segments).
Of several hits the longest pattern decides, and of equal ones "allow".

Defined results: a null or unreadable URL has no host and no hit; a null time hits nothing; repeated captures each get
a result; entries with a null in any column are left out; of entries for a pattern at one time a removal wins;
a pattern that is added twice stays until its next removal; empty tables give no hits or an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a span of the join.
SPAN = 30 * 86400
#: Up to so many rows of intervals (some 150 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST = 200_000


def host_of(url: Column) -> Column:
    """The lower-case host, null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """An array of (kind, pattern) of all patterns that match the URL."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("pattern")))
    steps = F.array_remove(F.split(path_of(url), "/"), "")
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(steps)), lambda i: i > 0), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")).alias("pattern")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host.isNotNull(), F.concat(own, domains, prefixes)).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))


def validity(entries: DataFrame) -> DataFrame:
    """(list, policy, kind, pattern, since, until) from entries (list, policy, kind, pattern, action, at); until is null where an entry still holds.

    Entries of one pattern and time are merged first, so a pattern's window has a row for each of its times."""
    names = ["list", "policy", "kind", "pattern"]
    known = entries.where(F.col("action").isin("add", "remove") & F.col("at").isNotNull()).dropna(subset=names)
    merged = known.groupBy(*names, "at").agg(F.max("action").alias("action"))
    later = W.partitionBy(*names).orderBy("at")
    spans = merged.withColumns({"before": F.lag("action").over(later), "until": F.min(F.when(F.col("action") == "remove", F.col("at"))).over(later.rowsBetween(1, W.unboundedFollowing))})
    starts = (F.col("action") == "add") & (F.coalesce("before", F.lit("remove")) == "remove")
    return spans.where(starts).select(*names, F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched_at", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(key, url, at, host, n_hits, lists, verdict) of each capture: verdict is the deciding policy, or "none"."""
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    held = validity(entries).select("list", "policy", F.col("kind").alias("k"), F.col("pattern").alias("p"), second("since").alias("since"), second("until").alias("until"))
    own = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(at).alias("at"), second(at).alias("second"))
    last = own.agg(F.max("second")).first()[0]
    ends = F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last))
    span = lambda c: F.floor(c / SPAN).cast("long")
    held = held.where(F.col("since") <= ends).withColumn("s", F.explode(F.sequence(span(F.col("since")), span(ends))))
    if held.limit(most_broadcast + 1).count() <= most_broadcast:
        held = F.broadcast(held)
    else:
        held = held.hint("merge")
    # The null key stands for the capture itself.
    none = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("pattern")))
    asked = own.withColumn("m", F.explode(F.concat(none, keys_of(F.col("url"))))).select("key", "url", "at", "second", F.col("m.kind").alias("kind"), F.col("m.pattern").alias("pattern"), span(F.col("second")).alias("span"))
    active = (F.col("kind") == F.col("k")) & (F.col("pattern") == F.col("p")) & (F.col("span") == F.col("s")) & (F.col("second") >= F.col("since")) & (F.col("until").isNull() | (F.col("second") < F.col("until")))
    hits = asked.join(held, active, "left").where(F.col("kind").isNull() | F.col("list").isNotNull())
    found = hits.groupBy("key", "url", "at").agg(
        F.count_if(F.col("kind").isNull()).alias("copies"),
        F.count("list").alias("hits"),
        F.array_sort(F.collect_set("list")).alias("lists"),
        F.max(F.when(F.col("list").isNotNull(), F.struct(F.length("pattern").alias("n"), (F.col("policy") == "allow").alias("allow"), F.col("policy")))).alias("best"),
    )
    # Repeated captures hit alike.
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(F.col("key").alias(key), F.col("url").alias(url), F.col("at").alias(at), host_of(F.col("url")).alias("host"), (F.col("hits") / F.col("copies")).cast("long").alias("n_hits"), F.array_join("lists", ",").alias("lists"), F.coalesce("best.policy", F.lit("none")).alias("verdict"))


def derived_lists(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts of the pages, for want of a list among the tables: which, and when, follows from MD5."""
    host = pages.select(host_of(F.col("url")).alias("host"), F.array_remove(F.split(path_of(F.col("url")), "/"), "").alias("steps")).where("host is not null")
    hosts = host.select("host").distinct()
    number = lambda tag, c: F.conv(F.substring(F.md5(F.concat(F.lit(tag), c)), 1, 4), 16, 10).cast("long")

    def entry(rows, tag, name, policy, kind, pattern, every, days, action="add"):
        n = number(tag, pattern)
        return rows.where(n % every == 0).select(F.lit(name).alias("list"), F.lit(policy).alias("policy"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), F.timestamp_seconds(START + days(n) * 86400).alias("at"))

    domains = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain")).where("domain <> ''").distinct()
    prefixes = host.where(F.size("steps") > 0).select(F.concat("host", F.lit("/"), F.col("steps")[0]).alias("prefix")).distinct()
    d, h, p = F.col("domain"), F.col("host"), F.col("prefix")
    parts = [
        entry(domains, "d", "spam", "block", "domain", d, 3, lambda n: n % 300),
        entry(domains, "d", "spam", "block", "domain", d, 6, lambda n: n % 300 + 45, "remove"),
        entry(hosts, "h", "malware", "block", "host", h, 4, lambda n: n % 340),
        entry(hosts, "h", "malware", "block", "host", h, 4, lambda n: n % 340 + 20, "remove"),
        entry(hosts, "h", "malware", "block", "host", h, 8, lambda n: n % 340 + 40),
        entry(hosts, "a", "trusted", "allow", "host", h, 5, lambda n: n % 300),
        entry(prefixes, "p", "adult", "block", "prefix", p, 6, lambda n: n % 300),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


#: 2024-01-01, in seconds.
START = 1704067200
