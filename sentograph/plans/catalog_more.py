"""Queries of modules, communities, networks of groups, models, and differential analysis."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sentograph.operators import compare, diff, entropy, graph, hubs, kernels, ngrams, stats

from . import sql
from .base import EVD, EVG, ev, ev_graph, ob, query, table, w
from .catalog import ev_members, ev_sets, ev_sides, side_p

# Modules: nations of a region as a star, a ring or a wheel; the regions as a path

MODULES = (
    "na AS (SELECT 'n' || n_nationkey AS v, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation)",
    "me AS (SELECT v AS src, 'r' || r AS dst FROM na WHERE r % 3 <> 1 UNION ALL SELECT a.v, b.v FROM na a JOIN na b ON a.r = b.r AND b.i = a.i % a.k + 1 WHERE a.r % 3 <> 0 UNION ALL SELECT 'x' || a.r_regionkey, 'x' || (a.r_regionkey + 1) FROM region a WHERE a.r_regionkey < 3)",
    "md AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM me UNION ALL SELECT dst FROM me) GROUP BY 1)",
    "mc AS (SELECT md.*, CASE WHEN node LIKE 'x%' THEN 'x' WHEN node LIKE 'r%' THEN substr(node, 2) ELSE (SELECT CAST(r AS VARCHAR) FROM na WHERE v = node) END AS c FROM md)",
    "mk AS (SELECT c, min(node) AS component, CASE WHEN c = 'x' THEN NULL WHEN c::INT % 3 = 0 THEN 'flower' WHEN c::INT % 3 = 1 THEN 'ring' ELSE 'wheel' END AS kind, arg_min(node, (-d, node)) AS top, arg_min(node, (-length(node), node)) AS long FROM mc GROUP BY c)",
    "mm AS (SELECT c, component, kind, CASE WHEN kind = 'ring' THEN long ELSE top END AS hub FROM mk WHERE kind IS NOT NULL)",
)


def module_edges(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    packed = nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("ks"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    each = packed.select("r", F.size("ks").alias("k"), "ks", F.posexplode("ks").alias("i", "n"))
    star = each.where("r % 3 <> 1").select(name(F.col("n")).alias("src"), F.concat(F.lit("r"), "r").alias("dst"))
    ring = each.where("r % 3 <> 0").select(name(F.col("n")), name(F.element_at("ks", ((F.col("i") + 1) % F.col("k") + 1).cast("int"))))
    path = region.where("r_regionkey < 3").select(F.concat(F.lit("x"), "r_regionkey"), F.concat(F.lit("x"), (F.col("r_regionkey") + 1).cast("string")))
    return graph.cut(star.union(ring).union(path))


def module_nodes(spark, sf, edges):
    alone = table(spark, sf, "region").select(F.concat(F.lit("alone"), "r_regionkey").alias("ngram"))
    return edges.select(F.col("src").alias("ngram")).union(edges.select("dst")).distinct().union(alone)


@query(w(*MODULES) + "SELECT component, kind, hub FROM mm")
def all_modules(spark, sf):
    edges = module_edges(spark, sf)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.modules(graph.components(nodes, edges, "node"), graph.degrees(nodes, edges, "node"))


@query(w(*MODULES, "hm AS (SELECT node, coalesce(hub, node) AS h FROM mc LEFT JOIN mm USING (c))") + "SELECT DISTINCT least(a.h, b.h) AS src, greatest(a.h, b.h) AS dst FROM me JOIN hm a ON a.node = src JOIN hm b ON b.node = dst WHERE a.h <> b.h")
def simplified_network(spark, sf):
    edges = module_edges(spark, sf)
    return graph.simplify(module_nodes(spark, sf, edges), edges)[1]


@query("WITH e AS (SELECT DISTINCT 'c' || c_nationkey AS a, 'c' || (c_custkey % 25) AS b FROM customer), h AS (SELECT 'c' || n_nationkey AS node, CASE WHEN n_regionkey < 3 THEN 'r' || n_regionkey ELSE 'c' || n_nationkey END AS hub FROM nation) SELECT DISTINCT least(x.hub, y.hub) AS src, greatest(x.hub, y.hub) AS dst FROM e JOIN h x ON x.node = a JOIN h y ON y.node = b WHERE x.hub <> y.hub")
def contracted_edges(spark, sf):
    c = table(spark, sf, "customer")
    edges = c.select(F.concat(F.lit("c"), "c_nationkey").alias("src"), F.concat(F.lit("c"), (F.col("c_custkey") % 25).cast("string")).alias("dst")).distinct()
    hubs = table(spark, sf, "nation").where("n_regionkey < 3").select(F.concat(F.lit("c"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("hub"))
    return graph.contract(edges, hubs)


@query(w(*EVG) + "SELECT src, dst, weight FROM e WHERE src NOT LIKE '%error%' AND dst NOT LIKE '%error%'")
def induced_edges(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    return graph.induced(edges, nodes.where("ngram not like '%error%'").select(F.col("ngram").alias("node"))).select("src", "dst", "weight")


# Communities: the nations of a region are all linked, and regions in a chain by one edge each

CLIQUES = (
    "nr AS (SELECT 'n' || n_nationkey AS v, n_nationkey AS k, n_regionkey AS r FROM nation)",
    "ce AS (SELECT a.v AS src, b.v AS dst FROM nr a JOIN nr b ON a.r = b.r AND a.k < b.k UNION ALL SELECT 'n' || x.lo, 'n' || y.hi FROM (SELECT r, min(k) AS lo FROM nr GROUP BY r) x JOIN (SELECT r, max(k) AS hi FROM nr GROUP BY r) y ON y.r = x.r + 1)",
    "cd AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM ce UNION ALL SELECT dst FROM ce) GROUP BY 1)",
    "ch AS (SELECT r, arg_min(node, (-d, node)) AS hub FROM cd JOIN nr ON v = node GROUP BY r)",
    "cm AS (SELECT v AS node, hub AS community FROM nr JOIN ch USING (r))",
)


def clique_edges(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    inner = n.join(n.select(F.col("k").alias("l"), "r"), "r").where("k < l").select(name("k").alias("src"), name("l").alias("dst"))
    ends = n.groupBy("r").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    return graph.cut(inner.union(ends.select("r", "lo").join(ends.select((F.col("r") - 1).alias("r"), "hi"), "r").select(name("lo"), name("hi"))))


def clique_components(edges):
    return graph.connected_components(edges)


@query(w(*CLIQUES) + "SELECT node, community FROM cm")
def divisive_communities(spark, sf):
    edges = clique_edges(spark, sf)
    return kernels.divisive(edges, clique_components(edges))


@query(w(*CLIQUES) + "SELECT node, community FROM cm")
def louvain_of_cliques(spark, sf):
    edges = clique_edges(spark, sf)
    return kernels.louvain(edges, clique_components(edges), 4)


@query(w(*CLIQUES) + "SELECT cm.node, cm.community, count(*) FILTER (WHERE o.community = cm.community) AS inside, count(*) FILTER (WHERE o.community <> cm.community) AS outside FROM cm JOIN (SELECT src AS a, dst AS b FROM ce UNION SELECT dst, src FROM ce) ON a = cm.node JOIN cm o ON o.node = b GROUP BY 1, 2")
def community_degrees(spark, sf):
    edges = clique_edges(spark, sf)
    return graph.community_degrees(edges, kernels.louvain(edges, clique_components(edges), 4))


@query(w(*CLIQUES) + "SELECT community, 'strong' AS strength FROM cm GROUP BY 1 HAVING count(*) > 1")
def clique_strength(spark, sf):
    edges = clique_edges(spark, sf)
    return graph.community_strength(edges, kernels.louvain(edges, clique_components(edges), 4))


@query(w(*CLIQUES) + "SELECT community AS hub, node, 5::BIGINT AS instances, 1.0::DOUBLE AS share, true AS core FROM cm")
def soft_cliques(spark, sf):
    edges = clique_edges(spark, sf)
    return kernels.merged_communities(kernels.soft_communities(edges, clique_components(edges), kernels.iteration_seeds(5, 7)), 5)


SOFT = "sa AS (SELECT o_orderpriority AS hub, 'c' || (o_custkey % 40) AS node, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), sb AS (SELECT o_orderpriority AS hub, 'c' || (o_custkey % 40) AS node, count(*) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2), sw AS (SELECT hub, node, (coalesce(b, 0) - coalesce(a, 0)) / 100.0::DOUBLE AS difference FROM sa FULL JOIN sb USING (hub, node) WHERE node IN (SELECT node FROM sa))"


@query(w(SOFT, "lm AS (SELECT quantile_cont(abs(difference), 0.95) AS l FROM sw)") + "SELECT hub, node, round(difference, 9) AS difference FROM sw WHERE hub IN (SELECT hub FROM sw, lm WHERE abs(difference) > l)")
def soft_differences(spark, sf):
    of = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("hub"), F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("node")).agg((F.count(F.lit(1)) / 100).alias("share"))
    return kernels.soft_difference(of("F"), of("O")).withColumn("difference", F.round("difference", 9))


# Networks


@query(w(*EVD, sql.COMPONENTS, recursive=True) + "SELECT component, count(DISTINCT id) AS entities FROM comp JOIN p ON p.ngram = node GROUP BY 1")
def component_entities(spark, sf):
    posted, nodes, edges = ev_graph(spark, sf)
    return compare.component_entities(graph.components(nodes, edges), posted)


@query("WITH f AS (SELECT c_custkey AS node, c_nationkey AS component FROM customer), m AS (SELECT c_custkey AS node, CASE WHEN c_nationkey % 4 = 3 THEN c_nationkey * 10 + c_custkey % 2 ELSE c_nationkey END AS there FROM customer WHERE c_nationkey % 4 <> 2 AND (c_nationkey % 4 <> 1 OR c_custkey % 3 > 0)), b AS (SELECT component, count(*) AS n, count(there) AS kept, count(DISTINCT there) AS parts FROM f LEFT JOIN m USING (node) GROUP BY 1) SELECT component, CASE WHEN kept = 0 THEN 'lost' WHEN parts > 1 THEN 'split' WHEN kept < n THEN 'truncated' ELSE 'preserved' END AS fate FROM b")
def component_fate(spark, sf):
    c = table(spark, sf, "customer")
    nation = F.col("c_nationkey")
    model = c.where((nation % 4 != 2) & ((nation % 4 != 1) | (F.col("c_custkey") % 3 > 0))).select(F.col("c_custkey").alias("node"), F.when(nation % 4 == 3, nation * 10 + F.col("c_custkey") % 2).otherwise(nation).alias("component"))
    return compare.component_fate(c.select(F.col("c_custkey").alias("node"), nation.alias("component")), model)


@query(w(sql.OB, sql.windows("ob", 5), sql.CLOSED, "sub2 AS (SELECT DISTINCT ngram, array_to_string(t[i:i + k - 1], '|') AS sub FROM (SELECT *, string_split(ngram, '|') AS t FROM c), unnest(range(1, n + 1)) x(i), unnest(range(1, n - i + 2)) y(k) WHERE k < n)") + "SELECT s.ngram, sub2.ngram AS stands_in FROM s JOIN sub2 ON sub2.sub = s.ngram WHERE s.ngram NOT IN (SELECT ngram FROM c)")
def replaced_by(spark, sf):
    known = graph.cut(ngrams.supported(ob(spark, sf), 5))
    return compare.replaced_by(ngrams.collapsed(known), ngrams.closed(known))


# Models

INTEREST = "iq AS (SELECT DISTINCT ngram FROM p WHERE list_has_any(string_split(ngram, '|'), ['B11', 'B25', 'B43']))"
COUNTS = "cn AS (SELECT ngram, n, count(*) AS cnt FROM w GROUP BY ngram, n)"


def model_sql(interest: str) -> str:
    """fr(ngram, n, cnt, frequency, conditional, length_total, total) of the n-grams of interest; prefixes may be others."""
    return (
        f"oi AS (SELECT cn.* FROM cn WHERE ngram IN ({interest})), tt AS (SELECT *, sum(cnt) OVER () AS total, sum(cnt) OVER (PARTITION BY n) AS length_total, CASE WHEN n > 1 THEN regexp_replace(ngram, '\\|[^|]*$', '') END AS prefix FROM oi), "
        "fr AS (SELECT tt.ngram, tt.n, tt.cnt, tt.cnt / tt.total AS frequency, tt.cnt / coalesce(q.cnt, tt.total) AS conditional, tt.length_total, tt.total FROM tt LEFT JOIN cn q ON q.ngram = tt.prefix)")


def seeded_model(spark, sf):
    own = graph.cut(ob(spark, sf))
    kept, removed = ngrams.collapse(graph.cut(ngrams.postings(own, 3, ["B11", "B25", "B43"], together=True)))
    return own, kept, removed


@query(w(sql.OB, sql.windows("ob", 3), INTEREST, COUNTS, model_sql("SELECT ngram FROM iq")) + "SELECT ngram, n, cnt AS count, round(frequency, 9) AS frequency, round(conditional, 9) AS conditional, length_total::BIGINT AS length_total, total::BIGINT AS total FROM fr")
def model_frequencies(spark, sf):
    own, kept, removed = seeded_model(spark, sf)
    return entropy.model_frequencies(kept, removed, own, 3).withColumns({"frequency": F.round("frequency", 9), "conditional": F.round("conditional", 9)})


def _fn_sql(n: int, cumulative: bool) -> str:
    size = f"len(string_split(ngram, '|')) {'<=' if cumulative else '='} {n}"
    interest = f"SELECT ngram FROM (SELECT ngram FROM iq UNION SELECT ngram FROM cn WHERE n = 1) WHERE {size}"
    return w(sql.OB, sql.windows("ob", 3), INTEREST, COUNTS, model_sql(interest)) + "SELECT round(-sum(p * log2(conditional)), 6) AS fn FROM (SELECT cnt / sum(cnt) OVER () AS p, conditional FROM fr)"


@query(_fn_sql(2, False))
def model_entropy_single(spark, sf):
    own, kept, removed = seeded_model(spark, sf)
    return entropy.fn_of_model(kept, removed, own, 2).select(F.round("fn", 6).alias("fn"))


@query(" UNION ALL ".join(f"SELECT {n}::BIGINT AS n, fn, round((SELECT f1 FROM ({w(sql.OB)} SELECT round(-sum(p * log2(p)), 3) AS f1 FROM (SELECT n / sum(n) OVER () AS p FROM (SELECT t, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM ob) GROUP BY t)))) - fn, 6) AS gain FROM ({_fn_sql(n, True)})" for n in (2, 3)))
def information_gain(spark, sf):
    own, kept, removed = seeded_model(spark, sf)
    return entropy.gains(kept, removed, own, [2, 3]).withColumns({"fn": F.round("fn", 6), "gain": F.round("gain", 6)})


# Differential analysis


@query(w(sql.DEG) + "SELECT CASE WHEN log2fc > 0.5 THEN 'up' ELSE 'down' END AS set, id FROM deg WHERE padj < 0.2 AND abs(log2fc) > 0.5")
def deg_select_strict(spark, sf):
    from .catalog import deg

    return diff.select_sets(deg(spark, sf), 0.2, 0.5, strict=True)


@query(w(*EVG, sql.SETS, sql.SIDE_NODES) + "SELECT ngram, k AS support FROM own JOIN sn ON sn.node = own.ngram AND sn.side = own.side WHERE own.side = 'up'")
def set_ngrams(spark, sf):
    posted, nodes, _, members = ev_members(spark, sf)
    return diff.set_ngrams(posted, nodes, members.where("set = 'up'")).select("ngram", "support")


@query(w(*EVG, sql.SETS, sql.SIDE_NODES) + "SELECT count(*) FILTER (WHERE side = 'up') AS up, count(*) FILTER (WHERE side = 'down') AS down, count(*) - count(DISTINCT node) AS common FROM sn")
def common_ngrams(spark, sf):
    return diff.common_ngrams(ev_sides(spark, sf)[3])


SIDE_P = (sql.SETS, sql.SIDE_NODES, "msz AS (SELECT side, count(*) AS m FROM mem GROUP BY side)", f"sp AS (SELECT side, ngram, {sql.hyper('k', 'support', 'm', 'total')} AS p FROM (SELECT own.*, support, m, (SELECT count(*) FROM ev) AS total FROM own JOIN c USING (ngram) JOIN msz USING (side)))")


def _tested(spark, sf):
    posted, nodes, edges, members = ev_members(spark, sf)
    return posted, nodes, edges, members, graph.cut(side_p(posted, nodes, members, ev(spark, sf).select("id")))


@query(w(*EVG, *SIDE_P) + f"SELECT side AS set, ngram FROM sp WHERE {sql.below('p', '0.3')}")
def enriched_ngrams(spark, sf):
    return diff.enriched_ngrams(_tested(spark, sf)[4], 0.3)


@query(w(*EVG, *SIDE_P) + "SELECT DISTINCT sp.side AS set, mem.id FROM sp JOIN p USING (ngram) JOIN mem ON mem.side = sp.side AND mem.id = p.id WHERE " + sql.below("sp.p", "0.3"))
def enriched_entities(spark, sf):
    posted, _, _, members, tested = _tested(spark, sf)
    return diff.enriched_entities(diff.enriched_ngrams(tested, 0.3), posted, members)


CUTOFFS = (0.9, 0.5, 0.2)


def _swept(k: int, cutoff: float) -> str:
    """The CTEs of the separation under other names, over the n-grams with p up to the cutoff."""
    own = f"sn{k} AS (SELECT sn.* FROM sn JOIN sp ON sp.side = sn.side AND sp.ngram = sn.node WHERE {sql.up_to('sp.p', str(cutoff))})"
    return own + ", " + re.sub(r"\b(sn|near|inn|one|acr|acs)\b", lambda m: f"{m[1]}{k}", sql.SEPARATION)


@query(w(*EVD, sql.COMPONENTS, *SIDE_P, *[_swept(k, c) for k, c in enumerate(CUTOFFS)], recursive=True) + " UNION ALL ".join(f"SELECT '{c}' AS set, round((SELECT t FROM acs{k}) / (SELECT count(*) FROM sn{k}) - (SELECT sum(m) FROM inn{k}) / 2, 9) AS separation FROM (SELECT count(DISTINCT side) AS s FROM sn{k}) WHERE s = 2" for k, c in enumerate(CUTOFFS)))
def separation_sweep(spark, sf):
    _, nodes, edges, _, tested = _tested(spark, sf)
    sides = ev_sides(spark, sf)[3].withColumnRenamed("node", "ngram").join(tested, ["set", "ngram"]).withColumnRenamed("ngram", "node")
    labels = hubs.distance_labels(nodes, edges)
    component = graph.components(nodes, edges)
    of = lambda s: sides.where(F.col("set") == s).select("node", "p")
    return diff.separation_sweep(of("up"), of("down"), list(CUTOFFS), hubs.by_labels(labels), graph.penalties(component, hubs.diameters(component, labels))).withColumn("separation", F.round("separation", 9))


CHECKS = "ck AS (SELECT (o_custkey % 100) / 100.0::DOUBLE AS a, (o_orderkey % 37) / 37.0::DOUBLE AS b FROM orders)"


@query(w(CHECKS) + "SELECT round(avg((a <= 0.13)::INT), 9) AS separation_fpr, round(avg((b <= 0.5)::INT), 9) AS iqr_fpr FROM ck")
def check_rates(spark, sf):
    checks = table(spark, sf, "orders").select((F.col("o_custkey") % 100 / 100).alias("separation_p"), (F.col("o_orderkey") % 37 / 37).alias("iqr_p"))
    actual = spark.createDataFrame([(0.13, 0.5)], "separation_p double, iqr_p double")
    return diff.check_rates(actual, checks).select(F.round("separation_fpr", 9).alias("separation_fpr"), F.round("iqr_fpr", 9).alias("iqr_fpr"))


@query(w(*EVG, sql.SETS, sql.SIDE_NODES) + "SELECT 'contrast' AS metric, 'x' AS value UNION ALL SELECT 'alpha', '0.5' UNION ALL SELECT 'fold', '0.5' UNION ALL SELECT side, CAST(count(*) AS VARCHAR) FROM mem GROUP BY side UNION ALL SELECT side || ' n-grams', CAST(count(*) AS VARCHAR) FROM sn GROUP BY side UNION ALL SELECT 'common n-grams', CAST(count(*) - count(DISTINCT node) AS VARCHAR) FROM sn")
def deg_summary(spark, sf):
    from sentograph.network import Differential, NgramNetwork, Options

    contrasts = ev_sets(spark, sf).select("id", F.lit("x").alias("contrast"), F.when(F.col("set") == "up", 1.0).otherwise(-1.0).alias("log2fc"), F.lit(0.01).alias("padj"))
    return Differential(NgramNetwork(ev(spark, sf), Options(longest=3)), contrasts).summary("x", 0.5, 0.5, detailed=True)


@query("SELECT t AS trial, user_id AS id FROM (SELECT t, user_id, row_number() OVER (PARTITION BY t ORDER BY md5('9|' || t || '|' || user_id), user_id) AS r FROM (SELECT DISTINCT user_id FROM events), range(5) x(t)) WHERE r <= 20")
def random_sets(spark, sf):
    return diff.random_sets(ev(spark, sf), 20, 5, 9)


def _scored(own: str) -> str:
    """SQL for (t, s, size, score) of the running sums of sets own(t, s, gene) over gr(gene, stat, r, n)."""
    return (
        f"SELECT t, s, any_value(size) AS size, CASE WHEN max(u / w - (r - k) / (n - size)) >= -min((u - abs(stat)) / w - (r - k) / (n - size)) THEN max(u / w - (r - k) / (n - size)) ELSE min((u - abs(stat)) / w - (r - k) / (n - size)) END AS score "
        f"FROM (SELECT *, count(*) OVER (PARTITION BY t, s) AS size, sum(abs(stat)) OVER (PARTITION BY t, s) AS w, sum(abs(stat)) OVER (PARTITION BY t, s ORDER BY r) AS u, row_number() OVER (PARTITION BY t, s ORDER BY r) AS k FROM {own} JOIN gr USING (gene)) WHERE size BETWEEN 2 AND 500 AND w > 0 GROUP BY t, s"
    )


GSEA = (
    "gr AS (SELECT p_partkey AS gene, p_retailprice - 1000 AS stat, row_number() OVER (ORDER BY p_retailprice - 1000 DESC, p_partkey) AS r, count(*) OVER () AS n FROM part)",
    "gs AS (SELECT -1 AS t, p_brand AS s, p_partkey AS gene FROM part)", f"ac AS ({_scored('gs')})",
    "gd AS (SELECT t, s, gene FROM (SELECT x.t, ac.s, gene, size, row_number() OVER (PARTITION BY x.t, ac.s ORDER BY md5('3|' || x.t || '|' || ac.s || '|' || gene), gene) AS place FROM ac, range(50) x(t), gr) WHERE place <= size)",
    f"nu AS ({_scored('gd')})", "me AS (SELECT s, score >= 0 AS up, avg(abs(score)) AS m FROM nu GROUP BY 1, 2)",
    "fa AS (SELECT nu.s, nu.score >= 0 AS up, score, round(abs(score) / nullif(m, 0), 9) AS far FROM nu JOIN me ON me.s = nu.s AND me.up = (nu.score >= 0))",
    "ow AS (SELECT ac.s, size, score, score >= 0 AS up, score / nullif(m, 0) AS normalized, round(abs(score / nullif(m, 0)), 9) AS far FROM ac LEFT JOIN me ON me.s = ac.s AND me.up = (ac.score >= 0))",
    "pq AS (SELECT o.*, (SELECT avg((abs(o.score) <= abs(f.score) * (1 + 1e-9::DOUBLE))::INT) FROM fa f WHERE f.s = o.s AND f.up = o.up) AS p, (SELECT avg((f.far >= o.far)::INT) FROM fa f WHERE f.up = o.up AND f.far IS NOT NULL) AS a, (SELECT avg((x.far >= o.far)::INT) FROM ow x WHERE x.up = o.up AND x.far IS NOT NULL) AS b FROM ow o)",
)


@query(w(*GSEA) + "SELECT s AS set, size, round(score, 6) AS score, round(p, 9) AS p, round(normalized, 6) AS normalized, round(CASE WHEN a / b IS NOT NULL THEN least(1, a / b) END, 9) AS q FROM pq")
def enrichment_significance(spark, sf):
    part = table(spark, sf, "part")
    ranked = part.select(F.col("p_partkey").alias("gene"), (F.col("p_retailprice") - 1000).alias("stat"))
    found = compare.enrichment_significance(ranked, part.select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("gene")), 50, 3, 2, 500)
    return found.withColumns({"score": F.round("score", 6), "p": F.round("p", 9), "normalized": F.round("normalized", 6), "q": F.round("q", 9)})


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr FROM orders GROUP BY 1")
def quartile_spans(spark, sf):
    return stats.quartile_span(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"]).withColumn("iqr", F.round("iqr", 6))


@query("WITH d AS (SELECT l_returnflag AS k, round(avg(l_quantity), 0) AS m FROM lineitem GROUP BY 1) SELECT count(*) AS leaves FROM d")
def ward_order(spark, sf):
    """How many keys the display order of brands' means has; the order itself is held against hand-made groups in the tests."""
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("m"))
    return spark.createDataFrame([(len(compare.leaf_order(rows, "l_returnflag", "l_linestatus", "m")),)], "leaves long")
