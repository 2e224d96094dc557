"""Queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentograph.operators import blocks, compare, corpus, diff, entropy, fusion, graph, hubs, kernels, labels, ngrams, order, paths, stats, survival

from . import sql
from .base import EVD, EVG, ORACLES, QUERIES, doc, ev, ev_graph, ob, query, table, w

# Corpora and derived columns


@query(w(sql.OB) + "SELECT id, array_to_string(tokens, '|') AS architecture, CAST(len(tokens) AS BIGINT) AS length FROM ob")
def arch_tokens(spark, sf):
    return ob(spark, sf).select("id", corpus.architecture(F.col("tokens")).alias("architecture"), corpus.true_length(F.col("tokens")).alias("length"))


@query(w(sql.OB) + "SELECT CASE WHEN len(tokens) > 10 THEN 11 ELSE CAST(len(tokens) AS BIGINT) END AS length, count(*) AS entities FROM ob GROUP BY 1")
def arch_length_hist(spark, sf):
    length = F.least(corpus.true_length(F.col("tokens")), F.lit(11).cast("long"))
    return ob(spark, sf).groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("entities"))


@query("SELECT o_orderkey, coalesce(n, 0) AS length FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON o_orderkey = l_orderkey")
def true_length(spark, sf):
    own = ob(spark, sf).select("id", "tokens")
    return table(spark, sf, "orders").select("o_orderkey").join(own, F.col("o_orderkey") == F.col("id"), "left").select("o_orderkey", corpus.true_length(F.col("tokens")).alias("length"))


@query("SELECT p_brand AS id, arg_min(p_name, (p_partkey, p_name)) AS name FROM part GROUP BY 1")
def name_map_first(spark, sf):
    return corpus.first_names(table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), "p_partkey"), "id", "name", [F.col("p_partkey"), F.col("name")])


@query(w(sql.OB, sql.windows("ob", 10), sql.CLOSED, "nm AS (SELECT replace(p_brand, 'Brand#', 'B') AS token, min(p_type) AS name FROM part GROUP BY 1)") + "SELECT ngram, string_agg(name, '|' ORDER BY i) AS legible FROM (SELECT ngram, unnest(string_split(ngram, '|')) AS token, unnest(range(n)) AS i FROM c) JOIN nm USING (token) GROUP BY ngram")
def legible_ngrams(spark, sf):
    names = table(spark, sf, "part").groupBy(F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("token")).agg(F.min("p_type").alias("name"))
    return corpus.legible(ngrams.closed(ngrams.supported(ob(spark, sf), 10)), names).select("ngram", "legible")


@query(w(sql.OB) + "SELECT id, tokens[1] || ' x ' || CAST(len(tokens) AS VARCHAR) AS label FROM ob WHERE len(tokens) > 1 AND len(list_distinct(tokens)) = 1")
def homopolymers(spark, sf):
    return ob(spark, sf).select("id", corpus.homopolymer(F.col("tokens"), 2).alias("label")).where("label is not null")


@query(w(sql.OB) + "SELECT id, '<' || array_to_string(list_concat(['Nterm'], tokens, ['Cterm']), '|') || '>' AS marked FROM ob")
def marked_ends(spark, sf):
    return ob(spark, sf).select("id", F.concat(F.lit("<"), F.array_join(corpus.with_ends(F.col("tokens")), "|"), F.lit(">")).alias("marked"))


# N-grams


@query(w(sql.OB, sql.windows("ob", 5)) + "SELECT id, ngram, n FROM p")
def ngram_windows(spark, sf):
    return ngrams.postings(ob(spark, sf), 5).select("id", "ngram", "n")


@query(w(sql.OB, sql.windows("ob", 10)) + "SELECT ngram, n, support FROM s")
def ngram_support(spark, sf):
    return ngrams.supported(ob(spark, sf), 10).select("ngram", "n", "support")


@query(w(sql.OB, sql.windows("ob", 10)) + "SELECT ngram, n, support FROM s WHERE support >= 5")
def ngram_support_filter(spark, sf):
    return ngrams.supported(ob(spark, sf), 10, 5).select("ngram", "n", "support")


@query(w(sql.OB, sql.windows("ob", 10), sql.CLOSED) + "SELECT ngram, n, support FROM c")
def closed_ngrams(spark, sf):
    return ngrams.closed(ngrams.supported(ob(spark, sf), 10)).select("ngram", "n", "support")


@query(w(sql.OB, sql.windows("ob", 10), sql.CLOSED) + "SELECT ngram, n, support FROM s WHERE ngram NOT IN (SELECT ngram FROM c)")
def collapsed_ngrams(spark, sf):
    return ngrams.collapsed(ngrams.supported(ob(spark, sf), 10)).select("ngram", "n", "support")


SEEDED = "sd AS (SELECT id, ngram, n FROM p WHERE list_has_any(string_split(ngram, '|'), ['B11', 'B25', 'B43']))"


@query(w(sql.OB, sql.windows("ob", 4), SEEDED) + "SELECT ngram, n, count(*) AS support FROM sd GROUP BY ngram, n")
def seeded_ngrams(spark, sf):
    return ngrams.support(ngrams.postings(ob(spark, sf), 4, ["B11", "B25", "B43"])).select("ngram", "n", "support")


@query(w(sql.OB, "t AS (SELECT id, tokens, len(tokens) AS l, i - 1 AS t FROM ob, unnest(range(1, len(tokens) + 1)) a(i) WHERE tokens[i] IN ('B11', 'B25', 'B43'))", "h AS (SELECT id, tokens, a, t + 1 AS b FROM t, unnest(range(greatest(0, t - 3), t + 1)) x(a) UNION SELECT id, tokens, t, b FROM t, unnest(range(t + 2, least(l, 4) + 1)) x(b) UNION SELECT id, tokens, t - 1, b FROM t, unnest(range(t + 2, least(l, 4) + 1)) x(b) WHERE t >= 1)") + "SELECT ngram, n, count(*) AS support FROM (SELECT DISTINCT id, array_to_string(tokens[a + 1:b], '|') AS ngram, CAST(b - a AS BIGINT) AS n FROM h) GROUP BY ngram, n")
def seeded_compat(spark, sf):
    return ngrams.support(ngrams.postings(ob(spark, sf), 4, ["B11", "B25", "B43"], "compat")).select("ngram", "n", "support")


@query(w(sql.OB, sql.windows("ob", 4), SEEDED, "ss AS (SELECT ngram, n, count(*) AS support FROM sd GROUP BY ngram, n)", "k AS (SELECT DISTINCT a.ngram AS sub, b.ngram AS sup FROM sd a JOIN sd b ON a.id = b.id AND a.n < b.n AND contains('|' || b.ngram || '|', '|' || a.ngram || '|'))", "sh AS (SELECT sub, sup, count(*) AS both FROM k JOIN sd x ON x.ngram = sub JOIN sd y ON y.ngram = sup AND y.id = x.id GROUP BY sub, sup)") + "SELECT ngram, n, support FROM ss WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.sub = ss.ngram AND sh.both = ss.support)")
def seeded_collapse(spark, sf):
    return ngrams.collapse(ngrams.postings(ob(spark, sf), 4, ["B11", "B25", "B43"]))[0].select("ngram", "n", "support")


@query(w(sql.OB, sql.windows("ob", 10), sql.CLOSED, sql.EDGES) + "SELECT src, dst, weight FROM e")
def containment_edges(spark, sf):
    return ngrams.containment_edges(ngrams.closed(ngrams.supported(ob(spark, sf), 10)))


@query(w(*EVG) + 'SELECT ngram AS "row", ngram AS col, support AS value FROM c UNION ALL SELECT src, dst, weight FROM e')
def adjacency_sparse(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return ngrams.adjacency(nodes, edges)


@query(w(*EVG) + "SELECT src, coalesce(sum(weight) FILTER (WHERE k = 2), 0)::BIGINT AS to_2, coalesce(sum(weight) FILTER (WHERE k = 3), 0)::BIGINT AS to_3 FROM (SELECT src, weight, len(string_split(dst, '|')) AS k FROM e) GROUP BY src")
def adjacency_pivot(spark, sf):
    edges = ev_graph(spark, sf)[2].withColumn("k", F.concat(F.lit("to_"), F.size(F.split("dst", r"\|")).cast("string")))
    return edges.groupBy("src").pivot("k", ["to_2", "to_3"]).agg(F.sum("weight")).na.fill(0)


@query(w(sql.OB, sql.windows("ob", 10), sql.CLOSED, "l AS (SELECT n, count(*) AS cnt FROM c GROUP BY n)") + "SELECT min(n) AS n FROM (SELECT n, sum(cnt) OVER (ORDER BY n) / sum(cnt) OVER () AS upto FROM l) WHERE upto > 0.8")
def ngram_cutoff(spark, sf):
    kept = ngrams.closed(ngrams.supported(ob(spark, sf), 10))
    return ngrams.length_cutoff(kept.groupBy("n").agg(F.count(F.lit(1)).alias("count")))


@query(w(sql.OB, sql.windows("ob", 6), sql.CLOSED, "h AS (SELECT ngram AS of, support, n, array_to_string(t[i:i + k - 1], '|') AS sub FROM (SELECT *, string_split(ngram, '|') AS t FROM c), unnest(range(1, n + 1)) x(i), unnest(range(1, n - i + 2)) y(k))") + "SELECT s.ngram, arg_min(h.of, (h.n, h.of)) AS standing_for, s.support FROM s JOIN h ON h.sub = s.ngram AND h.support = s.support GROUP BY s.ngram, s.support")
def ngram_entity_count(spark, sf):
    known = graph.cut(ngrams.supported(ob(spark, sf), 6))
    return ngrams.entity_count(ngrams.closed(known), known, known.select("ngram"))


# The graph


@query(w(*EVD, sql.COMPONENTS, recursive=True) + "SELECT 'entities' AS metric, count(*) AS value FROM ev UNION ALL SELECT 'ngrams', count(*) FROM c UNION ALL SELECT 'isolates', count(*) FROM c WHERE ngram NOT IN (SELECT a FROM u) UNION ALL SELECT 'components', count(DISTINCT component) FROM comp UNION ALL SELECT 'collapsed', (SELECT count(*) FROM s) - (SELECT count(*) FROM c) UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'longest', max(len(tokens)) FROM ev")
def network_summary(spark, sf):
    from sentograph.network import NgramNetwork, Options

    return NgramNetwork(ev(spark, sf), Options(longest=3)).summary(detailed=True)


@query(w(sql.OB, sql.windows("ob", 3), "c AS (SELECT * FROM s WHERE n = 3 OR (n = 2 AND support < 3))", sql.EDGES) + "SELECT ngram, n, support FROM c WHERE ngram NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def isolates(spark, sf):
    nodes = graph.cut(ngrams.supported(ob(spark, sf), 3).where("n = 3 or (n = 2 and support < 3)"))
    return graph.isolates(nodes, ngrams.containment_edges(nodes)).select("ngram", "n", "support")


@query(w(*EVG) + "SELECT ngram AS node, coalesce(d, 0) AS degree, round(coalesce(d, 0) / (count(*) OVER () - 1), 9) AS centrality FROM c LEFT JOIN (SELECT n, count(*) AS d FROM (SELECT src AS n FROM e UNION ALL SELECT dst FROM e) GROUP BY n) ON n = ngram".replace("SELECT n, count(*) AS d FROM (SELECT src AS n", "SELECT nd, count(*) AS d FROM (SELECT src AS nd").replace("GROUP BY n) ON n = ngram", "GROUP BY nd) ON nd = ngram"))
def degree_centrality(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return graph.degrees(nodes, edges).withColumn("centrality", F.round("centrality", 9))


@query("SELECT 'c' || o_custkey AS node, min('c' || o_custkey) AS component FROM orders GROUP BY 1 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders")
def connected_components(spark, sf):
    edges = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("dst"))
    return graph.connected_components(edges)


@query(w("k AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation)", "m AS (SELECT r, count(*) + 1 AS size FROM k GROUP BY r)") + "SELECT size, count(*) AS components FROM m GROUP BY size")
def component_sizes(spark, sf):
    edges = table(spark, sf, "nation").select((F.col("n_nationkey") + 1000).alias("src"), F.col("n_regionkey").alias("dst"))
    return graph.connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@query(w(*EVD, recursive=True) + "SELECT src, dst, d FROM d")
def shortest_paths(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return graph.distances(nodes.select(F.col("ngram").alias("node")), edges)


@query(w(*EVD, sql.COMPONENTS, recursive=True) + "SELECT component, size, diameter FROM diam")
def component_diameter(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return hubs.diameters(graph.components(nodes, edges), hubs.distance_labels(nodes, edges))


def ev_members(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(postings, nodes, edges, (set, id) of users above and below the mean value)."""
    return *ev_graph(spark, sf), ev_sets(spark, sf)


def ev_sets(spark, sf) -> DataFrame:
    """(set, id) of users above and below the mean value."""
    events = table(spark, sf, "events")
    users = events.groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("v")).crossJoin(F.broadcast(events.agg(F.avg("value").alias("m"))))
    return users.select(F.when(F.col("v") > F.col("m"), "up").otherwise("down").alias("set"), "id")


def ev_sides(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(postings, nodes, edges, (set, node) of the n-grams of either side)."""
    posted, nodes, edges, members = ev_members(spark, sf)
    return posted, nodes, edges, diff.trial_ngrams(posted, nodes, members)


@query(w(*EVD, sql.COMPONENTS, sql.SETS, sql.SIDE_NODES, sql.SEPARATION, recursive=True) + "SELECT side AS set, round(m, 9) AS mean FROM inn")
def mean_min_dist(spark, sf):
    _, nodes, edges, sides = ev_sides(spark, sf)
    return graph.mean_nearest_by_search(sides, graph.components(nodes, edges), edges, 0.0).select("set", F.round("mean", 9).alias("mean"))


@query(w(*EVD, sql.COMPONENTS, sql.SETS, sql.SIDE_NODES, sql.SEPARATION, recursive=True) + "SELECT round((SELECT t FROM acs) / (SELECT count(*) FROM sn) - (SELECT sum(m) FROM inn) / 2, 9) AS separation")
def network_separation(spark, sf):
    _, nodes, edges, sides = ev_sides(spark, sf)
    side = lambda s: sides.where(F.col("set") == s).select(F.lit("all").alias("set"), "node")
    return graph.separation_by_search(side("up"), side("down"), graph.components(nodes, edges), edges).select(F.round("separation", 9).alias("separation"))


# Information


@query(w(sql.OB) + "SELECT round(log2(count(DISTINCT t)), 3) AS f0 FROM (SELECT unnest(tokens) AS t FROM ob)")
def token_entropy_f0(spark, sf):
    return entropy.f0(ob(spark, sf))


@query(w(sql.OB, "k AS (SELECT t, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM ob) GROUP BY t)") + "SELECT round(-sum(p * log2(p)), 3) AS f1 FROM (SELECT n / sum(n) OVER () AS p FROM k)")
def token_entropy_f1(spark, sf):
    return entropy.f1(ob(spark, sf))


FREQ = r"cn AS (SELECT ngram, n, count(*) AS cnt FROM w GROUP BY ngram, n), tt AS (SELECT *, sum(cnt) OVER () AS total, sum(cnt) OVER (PARTITION BY n) AS length_total, CASE WHEN n > 1 THEN regexp_replace(ngram, '\|[^|]*$', '') END AS prefix FROM cn), fr AS (SELECT tt.ngram, tt.n, tt.cnt, tt.cnt / tt.total AS frequency, tt.cnt / coalesce(q.cnt, tt.total) AS conditional, tt.length_total, tt.total FROM tt LEFT JOIN cn q ON q.ngram = tt.prefix)"


@query(w(sql.OB, sql.windows("ob", 3), FREQ) + "SELECT ngram, n, cnt AS count, round(frequency, 9) AS frequency, round(conditional, 9) AS conditional, length_total::BIGINT AS length_total, total::BIGINT AS total FROM fr")
def freq_dict(spark, sf):
    f = entropy.frequencies(entropy.instance_counts(ob(spark, sf), 3))
    return f.withColumns({"frequency": F.round("frequency", 9), "conditional": F.round("conditional", 9)})


@query(w(sql.OB, sql.windows("ob", 3), FREQ) + "SELECT round(-sum(p * log2(conditional)), 6) AS fn FROM (SELECT cnt / sum(cnt) OVER () AS p, conditional FROM fr)")
def entropy_fn_cumulative(spark, sf):
    return entropy.fn(entropy.frequencies(entropy.instance_counts(ob(spark, sf), 3)), 3).select(F.round("fn", 6).alias("fn"))


@query(w(sql.OB, sql.windows("ob", 3), FREQ) + "SELECT round(-sum(p * log2(conditional)), 6) AS fn FROM (SELECT cnt / sum(cnt) OVER () AS p, conditional FROM fr WHERE n = 2)")
def entropy_fn_single(spark, sf):
    return entropy.fn(entropy.frequencies(entropy.instance_counts(ob(spark, sf), 3)), 2, False).select(F.round("fn", 6).alias("fn"))


@query(w(sql.OB, sql.windows("ob", 3)) + r"SELECT ngram, n, round(cnt / sum(cnt) OVER (PARTITION BY n, regexp_extract(ngram, '[^|]*$')), 9) AS share FROM (SELECT ngram, n, count(*) AS cnt FROM w WHERE n > 1 GROUP BY ngram, n)")
def freq_diversity(spark, sf):
    return entropy.last_token_share(entropy.instance_counts(ob(spark, sf), 3)).withColumn("share", F.round("share", 9))


def _ob_by(spark, sf, status: str) -> DataFrame:
    own = table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("id"))
    return entropy.frequencies(entropy.instance_counts(ob(spark, sf).join(own, "id", "left_semi"), 2))


def _pair(value: str) -> str:
    part = lambda tag, status: sql.windows(f"ob{tag}", 2).replace("w AS", f"w{tag} AS").split(", p AS")[0]
    freq = lambda tag: FREQ.replace("FROM w ", f"FROM w{tag} ").replace("cn AS", f"cn{tag} AS").replace("FROM cn)", f"FROM cn{tag})").replace("JOIN cn q", f"JOIN cn{tag} q").replace("tt AS", f"tt{tag} AS").replace("FROM tt ", f"FROM tt{tag} tt ").replace("fr AS", f"fr{tag} AS")
    corpora = ", ".join(f"ob{t} AS (SELECT ob.* FROM ob JOIN orders ON o_orderkey = id AND o_orderstatus = '{s}')" for t, s in (("a", "F"), ("b", "O")))
    return w(sql.OB, corpora, part("a", "F"), part("b", "O"), freq("a"), freq("b")) + f"SELECT CASE WHEN count(*) FILTER (WHERE b.ngram IS NULL) = 0 THEN round({value}, 6) END AS value FROM fra a LEFT JOIN frb b ON a.ngram = b.ngram"


@query(_pair("-sum(a.frequency * log2(b.conditional))"))
def cross_entropy(spark, sf):
    return entropy.cross_entropy(_ob_by(spark, sf, "F"), _ob_by(spark, sf, "O")).select(F.round("cross_entropy", 6).alias("value"))


@query(_pair("sum(a.frequency * log2(a.conditional / b.conditional))"))
def relative_entropy(spark, sf):
    return entropy.relative_entropy(_ob_by(spark, sf, "F"), _ob_by(spark, sf, "O")).select(F.round("relative_entropy", 6).alias("value"))


def _simpson(base: str) -> str:
    return w(sql.OB, sql.windows("ob", 3), "cn AS (SELECT ngram, n, count(*) AS cnt FROM w GROUP BY ngram, n)") + f"SELECT cn.ngram, CASE WHEN t > 1 THEN round(1 - q / (t * (t - 1)), 9) END AS diversity FROM cn LEFT JOIN (SELECT {base} AS base, sum(cnt) AS t, sum(cnt * (cnt - 1)) AS q FROM cn WHERE n > 1 GROUP BY 1) ON base = cn.ngram"


@query(_simpson(r"regexp_replace(ngram, '\|[^|]*$', '')"))
def simpson_pro(spark, sf):
    return entropy.simpson(entropy.instance_counts(ob(spark, sf), 3), "pro").select("ngram", F.round("diversity", 9).alias("diversity"))


@query(_simpson(r"regexp_replace(ngram, '^[^|]*\|', '')"))
def simpson_retro(spark, sf):
    return entropy.simpson(entropy.instance_counts(ob(spark, sf), 3), "retro").select("ngram", F.round("diversity", 9).alias("diversity"))


@query(w(sql.DOC, "m AS (SELECT DISTINCT lang, unnest(tokens) AS t FROM doc)", "z AS (SELECT lang, count(*) AS n FROM m GROUP BY lang)") + "SELECT x.lang AS a, y.lang AS b, round(coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)), 9) AS jaccard FROM z x JOIN z y ON x.lang < y.lang LEFT JOIN (SELECT p.lang AS a, q.lang AS b, count(*) AS k FROM m p JOIN m q USING (t) WHERE p.lang < q.lang GROUP BY 1, 2) ON a = x.lang AND b = y.lang")
def jaccard_corpora(spark, sf):
    # An inner explode is given a filter on the array's size, which would split every text once more for it.
    members = doc(spark, sf).select("lang", F.explode_outer(F.array_distinct("tokens")).alias("t")).where("t is not null")
    return entropy.jaccard(members, "lang", "t").withColumn("jaccard", F.round("jaccard", 9))


# Differential analysis


def deg(spark, sf) -> DataFrame:
    orders = order.with_totals(table(spark, sf, "orders").where("o_totalprice > 0"), F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("all"))
    off = graph.cut(orders.withColumn("off", F.abs(F.col("o_totalprice") - F.col("mean"))))
    placed = off.join(order.ranks(off, "off"), "off")
    return placed.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("contrast"), F.log2(F.col("o_totalprice") / F.col("mean")).alias("log2fc"), (F.col("rank").cast("double") / F.col("all")).alias("padj"))


@query(w(sql.DEG) + "SELECT CASE WHEN log2fc > 0.5 THEN 'up' ELSE 'down' END AS set, id FROM deg WHERE padj <= 0.2 AND abs(log2fc) > 0.5")
def deg_select(spark, sf):
    return diff.select_sets(deg(spark, sf), 0.2, 0.5)


@query(w(sql.DEG) + "SELECT contrast, alpha, count(*) FILTER (WHERE padj <= alpha AND log2fc > 0.5) AS up, count(*) FILTER (WHERE padj <= alpha AND log2fc < -0.5) AS down FROM deg, unnest([0.05::DOUBLE, 0.1, 0.2, 0.4]) t(alpha) GROUP BY contrast, alpha")
def deg_threshold_sweep(spark, sf):
    return diff.threshold_sweep(deg(spark, sf), [0.05, 0.1, 0.2, 0.4], 0.5)


@query(w(*EVG, sql.SETS, sql.SIDE_NODES) + "SELECT side AS set, node FROM sn")
def deg_ngrams(spark, sf):
    return ev_sides(spark, sf)[3].select("set", "node")


HYPER = "lf AS (SELECT x, sum(CASE WHEN x > 1 THEN ln(x) ELSE 0 END) OVER (ORDER BY x) AS lf FROM range(0, (SELECT count(*) + 1 FROM ob)) t(x)), fg AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'), cc AS (SELECT ngram, count(fg.id) AS k, count(*) AS n FROM p LEFT JOIN fg USING (id) GROUP BY ngram), tot AS (SELECT count(*) AS total, count(fg.id) AS m FROM ob LEFT JOIN fg USING (id)), tail AS (SELECT k, n, m, total, sum(exp(a.lf - b.lf - c1.lf + d1.lf - e1.lf - f1.lf - g.lf + h.lf + q.lf)) AS p FROM (SELECT DISTINCT k, n, m, total FROM cc, tot), unnest(range(k, least(n, m) + 1)) i(i), lf a, lf b, lf c1, lf d1, lf e1, lf f1, lf g, lf h, lf q WHERE a.x = n AND b.x = i AND c1.x = n - i AND d1.x = total - n AND e1.x = m - i AND f1.x = total - n - m + i AND g.x = total AND h.x = m AND q.x = total - m GROUP BY k, n, m, total)"


@query(w(sql.OB, sql.windows("ob", 2), HYPER) + "SELECT ngram, k, n, m, total, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE round(least(1, p), 6) END AS p FROM cc, tot JOIN tail USING (k, n, m, total)".replace("FROM cc, tot JOIN", "FROM (SELECT * FROM cc, tot) JOIN"))
def hypergeom_enrichment(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return stats.enrichment_of(ob(spark, sf), 2, urgent).withColumn("p", F.round("p", 6))


#: Brands and priorities: how many orders of a priority have a brand, of how many of either; and the same for priorities dealt out at random, ten times.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BY_PRIORITY = (
    sql.OB, "tk AS (SELECT DISTINCT id, unnest(tokens) AS ngram FROM ob)",
    "cond AS (SELECT -1 AS t, o_orderkey AS id, o_orderpriority AS condition FROM orders JOIN ob ON id = o_orderkey UNION ALL SELECT t, id, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + ('0x' || substr(md5(t || '|' || id), 1, 6))::BIGINT % 5] FROM ob, range(10) r(t))",
    "sz AS (SELECT t, condition, count(*) AS m FROM cond GROUP BY 1, 2)", "nn AS (SELECT ngram, count(*) AS n FROM tk GROUP BY 1)",
    "kk AS (SELECT t, ngram, condition, count(*) AS k FROM tk JOIN cond USING (id) GROUP BY 1, 2, 3)",
    f"pv AS (SELECT t, ngram, condition, {sql.hyper('k', 'n', 'm', 'total')} AS p FROM (SELECT kk.*, n, m, (SELECT count(*) FROM ob) AS total FROM kk JOIN nn USING (ngram) JOIN sz USING (t, condition)))",
    f"fp AS (SELECT a.ngram, a.condition, a.p, avg(CASE WHEN {sql.below('b.p', 'a.p')} THEN 1.0 ELSE 0.0 END) AS fpr FROM pv a JOIN pv b ON b.ngram = a.ngram AND b.condition = a.condition AND b.t >= 0 WHERE a.t = -1 GROUP BY 1, 2, 3)",
)


def _p_by_priority(spark, sf) -> DataFrame:
    """(t, ngram, condition, p): hypergeometric p of brands in orders of a priority; t = -1 the actual one, else priorities by MD5."""
    own = graph.cut(ob(spark, sf))
    tokens = own.select("id", F.explode(F.array_distinct("tokens")).alias("ngram"))
    actual = table(spark, sf, "orders").select(F.lit(-1).cast("long").alias("t"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("condition")).join(own.select("id"), "id", "left_semi")
    dealt = own.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("t"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("t").cast("string"), F.col("id").cast("string"))), 1, 6), 16, 10).cast("long") % 5
    drawn = dealt.select("t", "id", F.element_at(F.array(*map(F.lit, PRIORITIES)), (number + 1).cast("int")).alias("condition"))
    every = actual.unionByName(drawn)
    counts = tokens.join(every, "id").groupBy("t", "ngram", "condition").agg(F.count(F.lit(1)).alias("k")).join(tokens.groupBy("ngram").agg(F.count(F.lit(1)).alias("n")), "ngram")
    counts = counts.join(F.broadcast(every.groupBy("t", "condition").agg(F.count(F.lit(1)).alias("m"))), ["t", "condition"]).crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("total"))))
    return graph.cut(stats.hypergeometric_tail(counts, "k", "n", "m", "total").select("t", "ngram", "condition", "p"))


def _rated(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(ngram, condition, p) and (ngram, condition, p, fpr)."""
    every = _p_by_priority(spark, sf)
    actual = every.where("t = -1").drop("t")
    return actual, stats.false_positive_rate(actual, every.where("t >= 0"), ["ngram", "condition"], strict=True)


@query(w(*BY_PRIORITY) + "SELECT ngram, condition, round(p, 6) AS p, round(fpr, 9) AS fpr FROM fp")
def ngram_fpr(spark, sf):
    return _rated(spark, sf)[1].withColumns({"p": F.round("p", 6), "fpr": F.round("fpr", 9)})


RESULTS = "round(p, 6) AS p, round(-log10(p), 6) AS log_p, round(fpr, 9) AS fpr, fpr <= 0.05 AS passes"


@query(w(*BY_PRIORITY, "q AS (SELECT quantile_cont(p, 0.25) AS lim FROM fp)") + f"SELECT ngram, condition, {RESULTS} FROM fp WHERE ngram IN (SELECT ngram FROM fp, q WHERE {sql.up_to('p', 'lim')})")
def enrichment_results(spark, sf):
    actual, rates = _rated(spark, sf)
    return diff.top_quantile(diff.gather_results(actual, rates.drop("p")), 0.25).withColumns({"p": F.round("p", 6), "log_p": F.round("log_p", 6), "fpr": F.round("fpr", 9)})


@query(w(*BY_PRIORITY) + f"SELECT ngram, condition, {RESULTS} FROM fp WHERE fpr <= 0.2 AND {sql.up_to('p', '0.2')}")
def significant_results(spark, sf):
    actual, rates = _rated(spark, sf)
    return diff.significant(diff.gather_results(actual, rates.drop("p")), 0.2, 0.2).withColumns({"p": F.round("p", 6), "log_p": F.round("log_p", 6), "fpr": F.round("fpr", 9)})


#: p of the EV n-grams that each side's users have.
SIDE_P = ("msz AS (SELECT side, count(*) AS m FROM mem GROUP BY side)", f"sp AS (SELECT side, ngram, {sql.hyper('k', 'support', 'm', 'total')} AS p FROM (SELECT own.*, support, m, (SELECT count(*) FROM ev) AS total FROM own JOIN c USING (ngram) JOIN msz USING (side)))")


@query(w(*EVG, sql.SETS, sql.SIDE_NODES, *SIDE_P, f"r AS (SELECT ngram, side AS condition, {sql.up_to('p', '0.4')} AS passes FROM sp)", "f AS (SELECT ngram, list((condition, passes) ORDER BY condition) AS f FROM r GROUP BY 1)") + "SELECT ngram, condition, passes FROM r WHERE ngram NOT IN (SELECT e.dst FROM e JOIN f a ON a.ngram = e.src JOIN f b ON b.ngram = e.dst WHERE a.f = b.f)")
def max_info_collapse(spark, sf):
    posted, nodes, edges, members = ev_members(spark, sf)
    found = side_p(posted, nodes, members, ev(spark, sf).select("id"))
    return diff.most_informative(found.select("ngram", F.col("set").alias("condition"), stats.up_to(F.col("p"), 0.4).alias("passes")), edges)


def side_p(posted: DataFrame, nodes: DataFrame, members: DataFrame, background: DataFrame) -> DataFrame:
    """(set, ngram, p) of the nodes that members (set, id) have."""
    out = None
    for s in ("up", "down"):
        own = members.where(F.col("set") == s).select("id")
        one = stats.enrichment(posted, nodes, own, background).where("k > 0").select(F.lit(s).alias("set"), "ngram", "p")
        out = one if out is None else out.union(one)
    return out


@query("SELECT o_orderpriority, round((avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O')) / sqrt(((count(*) FILTER (WHERE o_orderstatus = 'F') - 1) * var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') + (count(*) FILTER (WHERE o_orderstatus = 'O') - 1) * var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O')) / (count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) - 2)), 6) AS d FROM orders GROUP BY 1")
def cohen_d(spark, sf):
    return stats.cohen_d(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O", ["o_orderpriority"]).withColumn("d", F.round("d", 6))


MANN = (
    "r AS (SELECT o_orderpriority, o_orderstatus, (rank() OVER w) + (count(*) OVER (PARTITION BY o_orderpriority, round(o_totalprice, -3)) - 1) / 2.0 AS rk FROM (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY round(o_totalprice, -3)))",
    "t AS (SELECT o_orderpriority, sum(t ** 3 - t) AS ties FROM (SELECT o_orderpriority, count(*)::DOUBLE AS t FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority, round(o_totalprice, -3)) GROUP BY 1)",
    "a AS (SELECT o_orderpriority, sum(rk) FILTER (WHERE o_orderstatus = 'F') AS r, (count(*) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE AS x, (count(*) FILTER (WHERE o_orderstatus = 'O'))::DOUBLE AS y FROM r GROUP BY 1)",
    "b AS (SELECT o_orderpriority, r - x * (x + 1) / 2.0 AS u, greatest(0, (abs(r - x * (x + 1) / 2.0 - x * y / 2) - 0.5) / sqrt(x * y / 12 * (x + y + 1 - ties / ((x + y) * (x + y - 1))))) AS z FROM a JOIN t USING (o_orderpriority))",
)


@query(w(*MANN) + f"SELECT o_orderpriority, u, round({sql.two_sided('z')}, 6) AS p FROM b")
def mann_whitney_u(spark, sf):
    rows = table(spark, sf, "orders").withColumn("v", F.round("o_totalprice", -3))
    return stats.mann_whitney(rows, "v", "o_orderstatus", "F", "O", ["o_orderpriority"]).select("o_orderpriority", "u", F.round("p", 6).alias("p"))


@query("WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS m FROM orders GROUP BY 1) SELECT o.o_orderpriority, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr, round(median(abs(o_totalprice - m.m)), 6) AS mad, round(stddev_pop(o_totalprice), 4) AS std, round(stddev_pop(o_totalprice) / avg(o_totalprice), 6) AS cv FROM orders o JOIN m USING (o_orderpriority) GROUP BY 1")
def iqr_mad_cv(spark, sf):
    return stats.dispersion(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"]).withColumns({"iqr": F.round("iqr", 6), "mad": F.round("mad", 6), "std": F.round("std", 4), "cv": F.round("cv", 6)})


@query(w(sql.OB, "l AS (SELECT id, least(len(tokens), 11)::BIGINT AS length FROM ob)", "wt AS (SELECT length, count(*) * 0.1 AS weight FROM l GROUP BY length)", "r AS (SELECT t AS trial, id, row_number() OVER (PARTITION BY t, length ORDER BY md5('7|' || t || '|' || length || '|' || id), id) AS place, CAST(floor(0.85 * weight) + floor((('0x' || substr(md5('7|' || t || '|' || length), 1, 8))::BIGINT / 4294967296.0) * greatest(ceil(1.15 * weight) - floor(0.85 * weight), 1)) AS BIGINT) AS take FROM l JOIN wt USING (length), range(5) x(t))") + "SELECT trial, id FROM r WHERE place <= take")
def stratified_null_sample(spark, sf):
    own = ob(spark, sf)
    weights = own.groupBy(F.least(F.size("tokens"), F.lit(11)).cast("long").alias("length")).agg((F.count(F.lit(1)) * 0.1).alias("weight"))
    return diff.length_stratified(own, weights, 5, 7)


def _stability(spark, sf, make):
    posted, nodes, edges, members = ev_members(spark, sf)
    near, component = hubs.distance_labels(nodes, edges), graph.components(nodes, edges)
    return make(graph.cut(ev(spark, sf)), posted, nodes, hubs.by_labels(near), graph.penalties(component, hubs.diameters(component, near)), members)


PAIR = "pair AS (SELECT '0' AS pof, side, id FROM mem)"
STABLE = "split_part(t, '|', 1) AS of, split_part(t, '|', 2) AS kind, split_part(t, '|', 3)::BIGINT AS trial, round(separation, 9) AS separation, round(iqr, 9) AS iqr"


@query(w(*EVD, sql.COMPONENTS, sql.SETS, PAIR, *sql.stability_trials("pair", 10, 3), *sql.trial_metrics(diff.SWEEP), recursive=True) + f"SELECT {STABLE} FROM tm")
def separation_stability(spark, sf):
    return _stability(spark, sf, lambda own, posted, nodes, far, penalty, members: diff.separation_stability(own, posted, nodes, far, penalty, members.withColumn("of", F.lit("0")), 10, 3)).withColumns({c: F.round(c, 9) for c in ("separation", "iqr")})


ACTUAL = (PAIR, *sql.stability_trials("pair", 6, 3), *sql.trial_metrics(diff.SWEEP), *sql.stability_tests("actual"))
RANDOM = (f"rpair AS (SELECT r::VARCHAR AS pof, side, id FROM ({sql.random_pairs(60, 4, 5, 5, 0.6)}))", *sql.again((*sql.stability_trials("rpair", 6, 5), *sql.trial_metrics(diff.SWEEP), *sql.stability_tests("checks")), "_r"))
RATE = ", ".join(f"round(avg(({sql.up_to(f'c.{x}_p', f'a.{x}_p')})::INT), 9) AS {x}_fpr" for x in ("separation", "iqr"))


@query(w(*EVD, sql.COMPONENTS, sql.SETS, *ACTUAL, *RANDOM, recursive=True) + f"SELECT {RATE} FROM checks c, actual a")
def separation_fpr(spark, sf):
    def make(own, posted, nodes, far, penalty, members):
        actual = diff.stability_tests(diff.separation_stability(own, posted, nodes, far, penalty, members.withColumn("of", F.lit("0")), 6, 3))
        found = diff.check_rates(actual, diff.false_positive_checks(own, posted, nodes, far, penalty, 60, 4, 6, 5))
        return found.select(*[F.round(c, 9).alias(c) for c in found.columns])

    return _stability(spark, sf, make)


SIZES = "tmem AS (" + " UNION ALL ".join(f"SELECT '{n}|' || r AS t, side, id FROM ({sql.random_pairs(2 * n, 5, 1 + n, 1, 0.5)})" for n in (5, 20, 60)) + ")"
FIXED = {"z0": ("far", "NULL::DOUBLE"), "z1": ("0", "0.0::DOUBLE"), "z2": ("3", "3.0::DOUBLE")}


@query(
    w(*EVD, sql.COMPONENTS, SIZES, *sql.TRIAL_NGRAMS, "zn AS (SELECT t, side, ngram AS node FROM tsn)", *[p for name, (fixed, _) in FIXED.items() for p in sql.separations("zn", name, "t", fixed)], recursive=True)
    + " UNION ALL ".join(f"SELECT split_part(t, '|', 1)::INT AS size, split_part(t, '|', 2)::BIGINT AS trial, {shown} AS penalty, round(separation, 9) AS separation FROM {name}" for name, (_, shown) in FIXED.items())
)
def separation_sizes(spark, sf):
    return _stability(spark, sf, lambda own, posted, nodes, far, penalty, members: diff.size_sweep(own, posted, nodes, far, penalty, [5, 20, 60], 5, 1, [None, 0.0, 3.0]).withColumn("separation", F.round("separation", 9)))


@query("SELECT mask, count(*) AS count FROM (SELECT user_id, CAST(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) + max(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) + max(CASE WHEN event_type = 'view' THEN 4 ELSE 0 END) AS BIGINT) AS mask FROM events WHERE value > 50 AND event_type IN ('click', 'error', 'view') GROUP BY user_id) GROUP BY mask")
def set_combinations(spark, sf):
    rows = table(spark, sf, "events").where("value > 50").select(F.col("event_type").alias("set"), F.col("user_id").alias("member"))
    return diff.bitmask(rows, ["click", "error", "view"])


# Recombined sequences, ranks, survival


@query(w(sql.OB, "f AS (SELECT a.id, list_concat(a.tokens[1:2], b.tokens[2:]) AS tokens FROM ob a JOIN ob b ON b.id = a.id + 1)") + "SELECT min(id) AS id, array_to_string(tokens, '|') AS architecture, count(*) AS copies FROM f GROUP BY tokens")
def fusion_architectures(spark, sf):
    own = ob(spark, sf)
    after = own.select((F.col("id") - 1).alias("id"), F.col("tokens").alias("tail"))
    fused = own.join(after, "id").select("id", F.concat(F.slice("tokens", 1, 2), F.slice("tail", 2, 2**30)).alias("tokens"))
    return fusion.representatives(fused).select("id", F.array_join("tokens", "|").alias("architecture"), "copies")


FUSED = (sql.OB, sql.windows("ob", 3), "f AS (SELECT a.id, list_concat(a.tokens[1:2], b.tokens[2:]) AS tokens FROM ob a JOIN ob b ON b.id = a.id + 1)", "fo AS (SELECT * FROM f WHERE array_to_string(tokens, '|') NOT IN (SELECT ngram FROM s))", "fp AS (SELECT DISTINCT id, array_to_string(tokens[i:i + k - 1], '|') AS ngram, k AS n FROM fo, unnest(range(1, len(tokens) + 1)) a(i), unnest(range(1, least(3, len(tokens) - i + 1) + 1)) b(k))", "mi AS (SELECT * FROM fp WHERE ngram NOT IN (SELECT ngram FROM s))")


@query(w(*FUSED) + r"SELECT id, ngram, 'new' AS kind FROM mi m WHERE NOT EXISTS (SELECT 1 FROM mi l WHERE l.id = m.id AND l.n = m.n + 1 AND (regexp_replace(l.ngram, '\|[^|]*$', '') = m.ngram OR regexp_replace(l.ngram, '^[^|]*\|', '') = m.ngram))")
def fusion_new_ngrams(spark, sf):
    own = graph.cut(ob(spark, sf))
    known = graph.cut(ngrams.supported(own, 3))
    after = own.select((F.col("id") - 1).alias("id"), F.col("tokens").alias("tail"))
    fused = own.join(after, "id").select("id", F.concat(F.slice("tokens", 1, 2), F.slice("tail", 2, 2**30)).alias("tokens"))
    return fusion.new_ngrams_of_all(fused, known, known, 3).select("id", "ngram", "kind")


@query(w("k AS (SELECT p_brand AS ngram, count(*) FILTER (WHERE l_linenumber = 1) AS f, count(*) FILTER (WHERE l_linenumber = 3) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)", "n AS (SELECT ngram, nullif(f, 0) AS five, nullif(t, 0) AS three FROM k)", "r AS (SELECT *, CASE WHEN five IS NULL THEN count(*) OVER () ELSE rank() OVER (PARTITION BY five IS NULL ORDER BY five DESC) END AS rank_five, CASE WHEN three IS NULL THEN count(*) OVER () ELSE rank() OVER (PARTITION BY three IS NULL ORDER BY three DESC) END AS rank_three FROM n)", "m AS (SELECT *, (rank_five + rank_three) / 2 AS mean_rank, coalesce(five, 0) * coalesce(three, 0) AS score FROM r)") + "SELECT ngram, five, three, rank_five, rank_three, mean_rank, rank() OVER (ORDER BY mean_rank) AS rank_mean, score, rank() OVER (ORDER BY score DESC) AS rank_score FROM m")
def contribution_ranks(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy(F.col("p_brand").alias("ngram")).agg(F.nullif(F.count_if(F.col("l_linenumber") == 1), F.lit(0)).alias("five"), F.nullif(F.count_if(F.col("l_linenumber") == 3), F.lit(0)).alias("three"))
    ranked = fusion.contribution_ranks(counts)
    return ranked.withColumns({c: F.col(c).cast("long") for c in ("rank_five", "rank_three", "rank_mean", "rank_score")})


@query("SELECT l_suppkey, n, rk FROM (SELECT l_suppkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rk FROM lineitem GROUP BY 1) WHERE rk <= 10")
def top_k_with_ties(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return order.top_with_ties(counts, "n", 10).withColumnRenamed("rank", "rk").select("l_suppkey", "n", "rk")


@query("SELECT o_orderpriority, coalesce(f, 0) AS f, coalesce(o, 0) AS o, round(coalesce(f, 0) / (coalesce(f, 0) + coalesce(o, 0)), 9) AS share FROM (SELECT o_orderpriority, count(*) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT o_orderpriority, count(*) AS o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (o_orderpriority)")
def outer_join_fill(spark, sf):
    orders = table(spark, sf, "orders")
    of = lambda s, n: orders.where(F.col("o_orderstatus") == s).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias(n))
    both = of("F", "f").join(of("O", "o"), "o_orderpriority", "full_outer").na.fill(0)
    return both.withColumn("share", F.round(F.col("f") / (F.col("f") + F.col("o")), 9))


@query("SELECT o_orderpriority, variable, value FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1) UNPIVOT (value FOR variable IN (f, o, p))")
def category_counts_long(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).toDF("o_orderpriority", "f", "o", "p")
    return wide.unpivot("o_orderpriority", ["f", "o", "p"], "variable", "value")


SURV = "sv AS (SELECT o_orderpriority AS stratum, CAST(date_diff('day', o_orderdate, max(l_shipdate)) AS BIGINT) AS duration, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate, o_orderstatus)"


def subjects(spark, sf) -> DataFrame:
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_orderpriority").alias("stratum"), F.datediff("last", "o_orderdate").cast("long").alias("duration"), (F.col("o_orderstatus") == "F").cast("int").alias("event"))


@query(w(SURV, "g AS (SELECT stratum, duration, sum(event) AS deaths, count(*) AS gone FROM sv GROUP BY 1, 2)", "k AS (SELECT stratum, duration, deaths, sum(gone) OVER (PARTITION BY stratum ORDER BY duration DESC) AS risk FROM g)") + "SELECT stratum, duration, deaths::BIGINT AS deaths, risk::BIGINT AS risk, round(CASE WHEN max((deaths = risk)::INT) OVER u = 1 THEN 0 ELSE exp(sum(CASE WHEN deaths < risk THEN ln(1 - deaths / risk) ELSE 0 END) OVER u) END, 6)::DOUBLE AS survival FROM k WINDOW u AS (PARTITION BY stratum ORDER BY duration)")
def kaplan_meier(spark, sf):
    return survival.kaplan_meier(subjects(spark, sf)).withColumn("survival", F.round("survival", 6))


@query(w(SURV, "g AS (SELECT duration, sum(event) AS d, count(*) AS gone FROM sv GROUP BY 1)", "k AS (SELECT duration, d, sum(gone) OVER (ORDER BY duration DESC) AS n FROM g)", "h AS (SELECT duration, sum(d / n) OVER (ORDER BY duration) AS h FROM k)") + "SELECT stratum, sum(event)::BIGINT AS observed, round(sum(h), 6) AS expected FROM sv JOIN h USING (duration) GROUP BY stratum")
def logrank_stat(spark, sf):
    return survival.log_rank(subjects(spark, sf)).withColumn("expected", F.round("expected", 6))


# Kernels


BC = (*EVG, sql.UNDIRECTED, "nd AS (SELECT ngram AS node FROM c)", sql.numbered_paths("nd", 7), sql.BETWEENNESS)


@query(w(*BC) + "SELECT node, round(betweenness, 9) AS betweenness FROM bc")
def betweenness(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return paths.betweenness(nodes, edges).withColumn("betweenness", F.round("betweenness", 9))


@query(w(*BC, "dg AS (SELECT a AS node, count(*) AS d FROM u GROUP BY 1)", "ar AS (SELECT a AS node, sum(1 / d) AS s FROM u JOIN dg ON dg.node = u.b GROUP BY 1)") + "SELECT bc.node, round(1 / d / s * betweenness, 9) AS bridging FROM bc LEFT JOIN dg USING (node) LEFT JOIN ar USING (node)")
def bridging_centrality(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return kernels.bridging(paths.betweenness(nodes, edges), graph.degrees(nodes, edges), edges).withColumn("bridging", F.round("bridging", 9))


@query("SELECT 'c' || o_custkey AS node FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def articulation_points(spark, sf):
    edges = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("dst"))
    return blocks.articulation_points(blocks.block_tree(edges))


@query()
def louvain_communities(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return kernels.louvain(edges, graph.components(nodes, edges), 1)


@query()
def community_strength(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return graph.community_strength(edges, kernels.louvain(edges, graph.components(nodes, edges), 1))


@query()
def soft_communities(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return kernels.soft_communities(edges, graph.components(nodes, edges), [1, 2, 3])


@query("SELECT n_regionkey AS component, 'flower' AS kind, CASE WHEN count(*) = 1 THEN min(n_nationkey) + 1000 END AS hub FROM nation WHERE false GROUP BY 1 UNION ALL SELECT 'r' || n_regionkey, 'flower', 'r' || n_regionkey FROM nation GROUP BY n_regionkey HAVING count(*) > 1".split("UNION ALL ")[1].replace("SELECT 'r' || n_regionkey, 'flower', 'r' || n_regionkey", "SELECT min('n' || n_nationkey) AS component, 'flower' AS kind, 'r' || n_regionkey AS hub"))
def simple_modules(spark, sf):
    edges = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.modules(graph.components(nodes, edges, "node"), graph.degrees(nodes, edges, "node"))


# Labels and comparisons


@query("SELECT o_orderkey, CASE WHEN a AND b THEN 'Both' WHEN a THEN 'pY' WHEN b THEN 'pST' ELSE 'None' END AS class FROM (SELECT l_orderkey AS o_orderkey, bool_or(p_size < 10) AS a, bool_or(p_size > 40) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)")
def side_classes(spark, sf):
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_partkey")
    return labels.side_class(lines, "o_orderkey", "p_partkey", part.where("p_size < 10"), part.where("p_size > 40"))


ROLES = "rl AS (SELECT replace(p_brand, 'Brand#', 'B') AS token, arg_max(p_type, (p_type)) AS role FROM part GROUP BY 1)"


@query(w(sql.OB, sql.windows("ob", 3), ROLES) + "SELECT ngram, CASE WHEN count(DISTINCT role) > 1 THEN 'Multiple' ELSE min(role) END AS role FROM (SELECT ngram, unnest(string_split(ngram, '|')) AS token FROM s) JOIN rl USING (token) GROUP BY ngram")
def node_roles(spark, sf):
    part = table(spark, sf, "part").groupBy(F.col("p_type").alias("role")).agg(F.collect_set(F.replace("p_brand", F.lit("Brand#"), F.lit("B"))).alias("tokens"))
    roles = labels.role_table(part.withColumn("nth", F.col("role")))
    return labels.node_roles(ngrams.supported(ob(spark, sf), 3), roles)


@query("SELECT bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) >= 3 THEN '3+' ELSE CAST(count(DISTINCT o_orderpriority) AS VARCHAR) END AS bucket FROM orders GROUP BY 1) GROUP BY bucket")
def set_count_buckets(spark, sf):
    return labels.bucket_count(table(spark, sf, "orders"), "o_custkey", "o_orderpriority").withColumn("share", F.round("share", 9))


@query("WITH m AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS k FROM orders), z AS (SELECT g, count(*) AS n FROM m GROUP BY g) SELECT a.g AS a, b.g AS b, round(count(*) / any_value(z.n), 9) AS share FROM m a JOIN m b ON a.k = b.k AND a.g <> b.g JOIN z ON z.g = a.g GROUP BY a.g, b.g")
def overlap_shares(spark, sf):
    return labels.overlap_share(table(spark, sf, "orders"), "o_orderpriority", "o_custkey").withColumn("share", F.round("share", 9))


@query("SELECT p_brand, p_partkey, p_size, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey) AS r FROM part) WHERE r = 1")
def redundant_resolution(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return labels.resolve_redundant(part, "p_brand", "p_partkey", [-F.col("p_size"), F.col("p_retailprice")])


@query("WITH k AS (SELECT p_brand, l_shipmode, avg(l_extendedprice) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT 1".replace("l_shipmode", "l_returnflag").split(" SELECT 1")[0] + " SELECT p_brand, kind, round(mean, 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mean DESC, p_brand) AS r FROM (SELECT p_brand, CASE WHEN count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM k) THEN 'common' WHEN count(DISTINCT l_returnflag) = 1 THEN 'unique' END AS kind, avg(m) AS mean FROM k GROUP BY p_brand) WHERE kind IS NOT NULL) WHERE r <= 6")
def common_and_unique(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    means = lines.groupBy("p_brand", "l_returnflag").agg(F.avg("l_extendedprice").alias("m"))
    return labels.common_and_unique(means, "p_brand", "l_returnflag", "m").withColumn("mean", F.round("mean", 4))


@query("WITH f AS (SELECT l_returnflag AS five, p_brand AS whole, l_linestatus AS three FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT five AS n, '5' AS r FROM f UNION SELECT whole, 'Full' FROM f UNION SELECT three, '3' FROM f), m AS (SELECT n FROM r GROUP BY n HAVING count(*) > 1), c AS (SELECT five AS a, '5' AS ra, whole AS b, 'Full' AS rb, count(*) AS weight FROM f GROUP BY 1, 3 UNION ALL SELECT whole, 'Full', three, '3', count(*) FROM f GROUP BY 1, 3) SELECT CASE WHEN a IN (SELECT n FROM m) THEN a || '_' || ra ELSE a END AS src, CASE WHEN b IN (SELECT n FROM m) THEN b || '_' || rb ELSE b END AS dst, weight FROM c")
def contribution_edges(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return compare.contribution_edges(lines.select(F.col("l_returnflag").alias("five"), F.col("p_brand").alias("whole"), F.col("l_linestatus").alias("three")))


@query(w(sql.OB, sql.windows("ob", 2)) + "SELECT ngram, o_orderpriority AS set, count(DISTINCT id) AS shared FROM p JOIN orders ON o_orderkey = id GROUP BY 1, 2")
def ngram_set_graph(spark, sf):
    sets = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("set"))
    return compare.bipartite_of(ob(spark, sf), 2, sets)


@query("WITH g AS (SELECT p_partkey AS gene, p_retailprice - 1000 AS stat, p_brand AS s FROM part), r AS (SELECT *, row_number() OVER (ORDER BY stat DESC, gene) AS r, count(*) OVER () AS n FROM g), h AS (SELECT *, count(*) OVER (PARTITION BY s) AS size, sum(abs(stat)) OVER (PARTITION BY s) AS t, sum(abs(stat)) OVER (PARTITION BY s ORDER BY r) AS u, row_number() OVER (PARTITION BY s ORDER BY r) AS k FROM r), e AS (SELECT s, any_value(size) AS size, max(u / t - (r - k) / (n - size)) AS hi, min((u - abs(stat)) / t - (r - k) / (n - size)) AS lo FROM h WHERE size BETWEEN 2 AND 500 AND t > 0 GROUP BY s) SELECT s AS set, size, round(CASE WHEN hi >= -lo THEN hi ELSE lo END, 6) AS score FROM e")
def running_enrichment(spark, sf):
    part = table(spark, sf, "part")
    ranked = part.select(F.col("p_partkey").alias("gene"), (F.col("p_retailprice") - 1000).alias("stat"))
    return compare.running_enrichment(ranked, part.select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("gene")), 2, 500).withColumn("score", F.round("score", 6))


@query(w(*EVG, "gm AS (SELECT user_id AS id, CAST(user_id % 3 AS BIGINT) AS grp FROM (SELECT DISTINCT user_id FROM events))", "gn AS (SELECT DISTINCT grp, p.ngram FROM p JOIN gm USING (id) JOIN c USING (ngram))", "ge AS (SELECT a.grp, e.src, e.dst FROM e JOIN gn a ON a.ngram = e.src JOIN gn b ON b.ngram = e.dst AND a.grp = b.grp)", "gw(grp, src, dst) AS (SELECT grp, ngram, ngram FROM gn UNION SELECT gw.grp, gw.src, CASE WHEN ge.src = gw.dst THEN ge.dst ELSE ge.src END FROM gw JOIN ge ON ge.grp = gw.grp AND (ge.src = gw.dst OR ge.dst = gw.dst))", "gk AS (SELECT grp, count(DISTINCT m) AS k FROM (SELECT grp, src, min(dst) AS m FROM gw GROUP BY grp, src) GROUP BY grp)", recursive=True) + 'SELECT grp AS "group", count(*) AS nodes, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.grp = gn.grp AND (ge.src = gn.ngram OR ge.dst = gn.ngram))) AS isolates, any_value(k) AS components FROM gn JOIN gk USING (grp) GROUP BY grp')
def group_networks(spark, sf):
    posted, nodes, edges = ev_graph(spark, sf)
    groups = table(spark, sf, "events").select(F.col("user_id").alias("id"), (F.col("user_id") % 3).alias("group")).distinct()
    return compare.group_network(posted, groups, nodes, edges)


STACK = (
    sql.EV, *[re.sub(r"\b(w|p|s|par|c|sub|e)\b(?=[ .(),]|$)", lambda m: f"{m[1]}_{n}", f"{sql.windows('ev', n)}, {sql.CLOSED}, {sql.EDGES}") for n in (2, 3)],  # noqa: B023
    "sn AS (SELECT 2 AS k, ngram AS node FROM c_2 UNION ALL SELECT 3, ngram FROM c_3)",
    "sl AS (SELECT 2 AS k, src AS a, dst AS b FROM e_2 UNION SELECT 2, dst, src FROM e_2 UNION SELECT 3, src, dst FROM e_3 UNION SELECT 3, dst, src FROM e_3)",
)


@query(w(*STACK, *sql.shapes("sn", "sl"), recursive=True) + "SELECT k::BIGINT AS longest, isolates, components, articulation FROM shape")
def network_stack(spark, sf):
    return compare.stacked(ev(spark, sf), [2, 3])


DRAWN = (
    "bs AS (SELECT t, o_orderstatus AS g, o_totalprice AS v FROM (SELECT o.*, t, row_number() OVER (PARTITION BY t, o_orderstatus ORDER BY md5('1|' || t || '|' || o_orderkey)) AS place FROM orders o, range(20) x(t) WHERE o_orderstatus IN ('F', 'O')) WHERE place <= 50)",
    "br AS (SELECT t, g, rank() OVER (PARTITION BY t ORDER BY v) + (count(*) OVER (PARTITION BY t, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY t, v) AS same FROM bs)",
    "ba AS (SELECT t, sum(rk) FILTER (WHERE g = 'F') AS r, (count(*) FILTER (WHERE g = 'F'))::DOUBLE AS x, (count(*) FILTER (WHERE g = 'O'))::DOUBLE AS y, sum(same::DOUBLE * same - 1) AS ties FROM br GROUP BY t)",
    "bb AS (SELECT t, r - x * (x + 1) / 2 AS u, greatest(0, (abs(r - x * (x + 1) / 2 - x * y / 2) - 0.5) / sqrt(x * y / 12 * (x + y + 1 - ties / ((x + y) * (x + y - 1))))) AS z FROM ba)",
)


@query(w(*DRAWN) + f"SELECT t AS trial, u, round({sql.two_sided('z')}, 6) AS p FROM bb")
def bootstrap_tests(spark, sf):
    found = stats.bootstrap_mann_whitney(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O", 50, 20, 1, "o_orderkey")
    return found.withColumn("p", F.round("p", 6))


#: Customers' orders, by tens of customers: many small networks, each with the statuses of its ten; sequences that go on with the next customer's orders.
TENS = "cg AS (SELECT o_custkey AS id, list((o_custkey // 10) || o_orderstatus ORDER BY o_orderdate, o_orderkey) AS tokens FROM orders GROUP BY o_custkey)"
NEXT = "fu AS (SELECT a.id, list_concat(a.tokens[1:2], b.tokens[2:]) AS tokens FROM cg a JOIN cg b ON b.id = a.id + 1)"


@query(w(TENS, sql.windows("cg", 3), sql.CLOSED, NEXT, recursive=True)[:-1] + ", " + sql.impact("regexp_extract({}, '^[0-9]+')"))
def fusion_impact(spark, sf):
    orders = table(spark, sf, "orders").withColumn("token", F.concat(F.floor(F.col("o_custkey") / 10).cast("string"), "o_orderstatus"))
    own = graph.cut(corpus.ordered_tokens(orders, "o_custkey", "token", ["o_orderdate", "o_orderkey"]))
    after = own.select((F.col("id") - 1).alias("id"), F.col("tokens").alias("tail"))
    fused = own.join(after, "id").select("id", F.concat(F.slice("tokens", 1, 2), F.slice("tail", 2, 2**30)).alias("tokens"))
    return fusion.impact(own, fused, 3)


from . import catalog_files, catalog_more, catalog_recombined  # noqa: E402, F401  they register the rest
