"""Queries of recombined sequences and of survival. Breakpoints, genes, exons and domains follow from keys by arithmetic, as no table has them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sentograph.operators import corpus, fusion, graph, survival

from . import sql
from .base import ob, query, table, w

FUSIONS = (
    "fu AS (SELECT o_orderkey AS fusion_id, o_custkey AS \"BarcodeID\", o_orderpriority AS \"Cancertype\", CASE WHEN o_orderstatus <> 'P' THEN 'Seq+' ELSE 'Seq-' END AS seq, CASE WHEN o_custkey % 7 <> 0 THEN 'In-Frame' ELSE 'Out' END AS frame, "
    "CASE WHEN o_orderkey % 11 <> 0 THEN 'hg38' ELSE 'hg19' END AS build, 'brand#' || (o_custkey % 25 + 1) || '-brand#' || (o_orderkey % 25 + 1) AS pair, (o_orderkey * 37) % 3000 AS hp, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS hs, (o_custkey * 53) % 3000 AS tp, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS ts FROM orders)",
    "fs AS (SELECT * FROM fu WHERE seq = 'Seq+' AND frame = 'In-Frame' AND build = 'hg38' AND \"Cancertype\" IN ('1-URGENT', '2-HIGH', '5-LOW'))",
    "mp AS (SELECT 'P' || p_partkey AS gene_id, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) END AS name, CASE WHEN p_partkey % 2 = 1 OR p_partkey % 3 = 0 THEN p_brand END AS synonym, p_size AS version FROM part)",
    "gi AS (SELECT gene, arg_min(gene_id, (o, -version, gene_id)) AS gene_id FROM (SELECT upper(name) AS gene, gene_id, version, 0 AS o FROM mp WHERE name IS NOT NULL UNION ALL SELECT upper(synonym), gene_id, version, 1 FROM mp WHERE synonym IS NOT NULL) WHERE gene <> 'BRAND#13' GROUP BY gene)",
    "sd AS (SELECT s.*, gi.gene_id FROM (SELECT fusion_id, 5 AS side, upper(string_split(pair, '-')[1]) AS gene, hp AS position, hs AS strand FROM fs UNION ALL SELECT fusion_id, 3, upper(string_split(pair, '-')[2]), tp, ts FROM fs) s JOIN gi USING (gene) WHERE fusion_id IN (SELECT fusion_id FROM fs JOIN gi a ON a.gene = upper(string_split(pair, '-')[1]) JOIN gi b ON b.gene = upper(string_split(pair, '-')[2])))",
    "ex AS (SELECT 'P' || p_partkey AS gene_id, i * 350 + p_size AS exon_start, i * 350 + p_size + 200 AS exon_end, CASE WHEN i > 0 THEN (i - 1) * 201 + 1 END AS cds_start, CASE WHEN i > 0 THEN i * 201 END AS cds_end FROM part, range(0, 8) r(i))",
    "xe AS (SELECT *, (side = 5 AND strand = '+') OR (side = 3 AND strand = '-') AS flip FROM sd JOIN ex USING (gene_id))",
    "xk AS (SELECT *, cds_start IS NOT NULL AND (CASE WHEN flip THEN NOT exon_start >= position ELSE exon_start >= position END) AS kept, cds_start IS NOT NULL AND ((exon_start >= position) <> (exon_end > position)) AS cut FROM xe)",
    "ps AS (SELECT fusion_id, side, gene_id, max(cds_end) AS last, min(cds_start) AS first, sum(CASE WHEN cut THEN abs(position - CASE WHEN strand = '+' THEN exon_end ELSE exon_start END) ELSE 0 END) AS lost FROM xk WHERE kept GROUP BY 1, 2, 3)",
    "pp AS (SELECT fusion_id, side, gene_id, CAST(ceil((CASE WHEN side = 5 THEN last - lost ELSE first + lost END) / 3) AS BIGINT) AS residue FROM ps WHERE fusion_id IN (SELECT fusion_id FROM ps WHERE side = 3))",
    "dm AS (SELECT 'P' || p_partkey AS gene_id, 'D' || ((p_partkey + i) % 9) AS token, i * 80 + 1 AS s, i * 80 + 51 AS e FROM part, range(0, 6) r(i))",
    "rc AS (SELECT fusion_id, string_agg(token, '|' ORDER BY side DESC, s, e, token) AS architecture FROM pp JOIN dm USING (gene_id) WHERE (side = 5 AND e <= residue) OR (side = 3 AND s >= residue) GROUP BY 1)",
    "ra AS (SELECT fusion_id AS id, coalesce(architecture, '') AS architecture FROM (SELECT DISTINCT fusion_id FROM pp) LEFT JOIN rc USING (fusion_id))",
)
CANCERS = ["1-URGENT", "2-HIGH", "5-LOW"]


def fusions(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda x: F.concat(F.lit("brand#"), (x % 25 + 1).cast("string"))
    strand = lambda x: F.when(x % 2 == 0, "+").otherwise("-")
    return table(spark, sf, "orders").select(
        k.alias("fusion_id"), c.alias("BarcodeID"), F.col("o_orderpriority").alias("Cancertype"), F.when(F.col("o_orderstatus") != "P", "Seq+").otherwise("Seq-").alias("Highly_Reliable_Seq"),
        F.when(c % 7 != 0, "In-Frame").otherwise("Out").alias("Frame"), F.when(k % 11 != 0, "hg38").otherwise("hg19").alias("Genome_Build_Version"), F.concat(name(c), F.lit("-"), name(k)).alias("Fusion_pair"),
        F.lit("?").alias("H_gene"), F.concat(F.lit("chr"), (c % 22).cast("string")).alias("H_chr"), (k * 37 % 3000).alias("H_position"), strand(k).alias("H_strand"),
        F.lit("?").alias("T_gene"), F.concat(F.lit("chr"), (k % 22).cast("string")).alias("T_chr"), (c * 53 % 3000).alias("T_position"), strand(c).alias("T_strand"))


def chosen(spark, sf):
    return fusion.repair_genes(fusion.select_fusions(fusions(spark, sf), CANCERS))


def mapping(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("gene_id"), F.when(k % 2 == 0, F.lower("p_brand")).alias("name"), F.when((k % 2 == 1) | (k % 3 == 0), F.col("p_brand")).alias("synonym"), F.col("p_size").alias("version"))
    return rows.where("coalesce(name, '') <> 'brand#13' and coalesce(synonym, '') <> 'Brand#13'")


def gene_table(spark, sf):
    own = chosen(spark, sf)
    return fusion.gene_ids(own.select(F.explode(F.array("H_gene", "T_gene")).alias("gene")), mapping(spark, sf))


def sided(spark, sf):
    return graph.cut(fusion.sides(chosen(spark, sf), gene_table(spark, sf)))


def exon_table(spark, sf):
    i, s = F.col("i"), F.col("p_size")
    rows = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return rows.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene_id"), (i * 350 + s).alias("exon_start"), (i * 350 + s + 200).alias("exon_end"), F.when(i > 0, (i - 1) * 201 + 1).alias("cds_start"), F.when(i > 0, i * 201).alias("cds_end"), F.lit(1).alias("exon_strand"))


def domain_table(spark, sf):
    i = F.col("i")
    rows = table(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return rows.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene_id"), F.concat(F.lit("D"), ((F.col("p_partkey") + i) % 9).cast("string")).alias("token"), (i * 80 + 1).alias("start"), (i * 80 + 51).alias("end"))


@query(w(*FUSIONS) + 'SELECT fusion_id, "Cancertype", upper(string_split(pair, \'-\')[1]) AS "H_gene", upper(string_split(pair, \'-\')[2]) AS "T_gene" FROM fs')
def fusions_selected(spark, sf):
    return chosen(spark, sf).select("fusion_id", "Cancertype", "H_gene", "T_gene")


@query(w(*FUSIONS) + "SELECT gene, gene_id FROM gi WHERE gene IN (SELECT upper(string_split(pair, '-')[1]) FROM fs UNION SELECT upper(string_split(pair, '-')[2]) FROM fs)")
def fusion_gene_ids(spark, sf):
    return gene_table(spark, sf)


@query(w(*FUSIONS) + "SELECT fusion_id, side, gene, gene_id, position, strand FROM sd")
def fusion_sides(spark, sf):
    return sided(spark, sf).select("fusion_id", "side", "gene", "gene_id", "position", "strand")


@query(w(*FUSIONS) + "SELECT fusion_id, side, gene_id, CAST(exon_start AS BIGINT) AS exon_start, kept, cut FROM xk")
def fusion_exons(spark, sf):
    return fusion.exons(sided(spark, sf), exon_table(spark, sf)).select("fusion_id", "side", "gene_id", F.col("exon_start").cast("long").alias("exon_start"), "kept", "cut")


@query(w(*FUSIONS) + "SELECT fusion_id, side, gene_id, residue FROM pp")
def fusion_peptides(spark, sf):
    return fusion.peptide(fusion.exons(sided(spark, sf), exon_table(spark, sf)))


@query(w(*FUSIONS) + "SELECT id, architecture FROM ra")
def fusion_domains(spark, sf):
    parts = fusion.peptide(fusion.exons(sided(spark, sf), exon_table(spark, sf)))
    return fusion.recombine(parts, domain_table(spark, sf)).select("id", F.array_join("tokens", "|").alias("architecture"))


def gene_corpus(spark, sf):
    rows = domain_table(spark, sf).groupBy(F.col("gene_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start", "token"))).alias("d"))
    return rows.select("id", F.transform(F.slice("d", 1, 3), lambda x: x["token"]).alias("tokens"))


@query(w(*FUSIONS) + "SELECT id, architecture FROM ra")
def fusion_chain(spark, sf):
    """The sequences that the whole chain makes; its second result is in ``fusion_chain_impact``."""
    return fusion.analysis(fusions(spark, sf), mapping(spark, sf), exon_table(spark, sf), domain_table(spark, sf), gene_corpus(spark, sf), 3, CANCERS)[0].select("id", F.array_join("tokens", "|").alias("architecture"))


CHAIN = (*[re.sub(r"\bfu\b", "fz", part) for part in FUSIONS], "gc AS (SELECT gene_id AS id, list(token ORDER BY s, token)[1:3] AS tokens FROM dm GROUP BY gene_id)", "fu AS (SELECT id, string_split(architecture, '|') AS tokens FROM ra WHERE architecture <> '')")


@query(w(*CHAIN, sql.windows("gc", 3), sql.CLOSED, recursive=True)[:-1] + ", " + sql.impact("length({}) * 0"))
def fusion_chain_impact(spark, sf):
    return fusion.analysis(fusions(spark, sf), mapping(spark, sf), exon_table(spark, sf), domain_table(spark, sf), gene_corpus(spark, sf), 3, CANCERS)[1]


@query('SELECT o_orderkey AS fusion_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)')
def patients_with_several(spark, sf):
    return fusion.multiple(fusions(spark, sf)).select("fusion_id")


PARTS = "pa AS (SELECT o_orderkey, o_custkey, o_orderpriority, l_linenumber, p_brand, p_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


@query(w(sql.OB, "f AS (SELECT tokens, count(DISTINCT o_custkey) AS p, count(DISTINCT o_orderpriority) AS n_cancers, count(DISTINCT o_orderkey % 100) AS n_fusions FROM ob JOIN orders ON o_orderkey = id GROUP BY tokens)") + "SELECT array_to_string(tokens, '|') AS architecture, p AS patients, n_cancers, n_fusions FROM f WHERE n_fusions > 1 OR p > 1")
def recurrent_architectures(spark, sf):
    rows = ob(spark, sf).join(table(spark, sf, "orders"), F.col("id") == F.col("o_orderkey")).select("tokens", F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("cancer"), (F.col("o_orderkey") % 100).alias("pair"))
    return fusion.recurrent(rows).select(F.array_join("tokens", "|").alias("architecture"), F.size("patients").cast("long").alias("patients"), "n_cancers", "n_fusions")


def _lines(spark, sf):
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    return table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))


@query(w(PARTS) + "SELECT p_brand AS gene_id, count(DISTINCT o_orderpriority) AS n_cancers, count(DISTINCT o_orderkey) AS n_fusions, count(DISTINCT p_type) AS n_architectures, count(*) AS patients FROM pa GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def recurrent_genes(spark, sf):
    rows = _lines(spark, sf).select(F.col("p_brand").alias("gene_id"), F.col("o_orderpriority").alias("cancer"), F.col("o_orderkey").alias("pair"), F.col("p_type").alias("architecture"), F.col("o_custkey").alias("patient"))
    return fusion.recurrent_genes(rows).withColumn("patients", F.size("patients").cast("long"))


@query(w(sql.OB, sql.windows("ob", 2), "x AS (SELECT a.id, list_concat(a.tokens[1:2], b.tokens[2:]) AS tokens, a.tokens[1] AS five, b.tokens[len(b.tokens)] AS three FROM ob a JOIN ob b ON b.id = a.id + 1)", "y AS (SELECT 5 AS side, five AS part, tokens FROM x UNION ALL SELECT 3, three, tokens FROM x)") + "SELECT part, side, count(*) AS count, count(*) FILTER (WHERE array_to_string(tokens, '|') NOT IN (SELECT ngram FROM s)) AS novel FROM y GROUP BY 1, 2")
def contributions(spark, sf):
    from sentograph.operators import ngrams

    own = ob(spark, sf)
    after = own.select((F.col("id") - 1).alias("id"), F.col("tokens").alias("tail"))
    fused = own.join(after, "id").select(F.concat(F.slice("tokens", 1, 2), F.slice("tail", 2, 2**30)).alias("t"), F.col("tokens")[0].alias("five"), F.element_at("tail", -1).alias("three"))
    each = fused.select(F.explode(F.array(F.struct(F.lit(5).alias("side"), F.col("five").alias("part")), F.struct(F.lit(3).alias("side"), F.col("three").alias("part")))).alias("x"), F.col("t").alias("tokens")).select("x.*", "tokens")
    return fusion.contributions(each, ngrams.support(ngrams.postings(own, 2)))


CHANGES = "SELECT o_orderpriority AS cancer, o_custkey % 3 - 1 AS cc, o_orderkey % 3 - 1 AS ap FROM orders"


@query(f"WITH k AS (SELECT cancer, CASE WHEN cc = 0 AND ap = 0 THEN 'no change' WHEN cc > 0 AND ap <= 0 THEN 'joins components' WHEN cc < 0 AND ap = 0 THEN 'adds a component' WHEN cc = 0 AND ap > 0 THEN 'adds redundancy' WHEN cc = 0 AND ap < 0 THEN 'adds a bridge' ELSE 'unclassified' END AS category FROM ({CHANGES})) SELECT cancer, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cancer), 9) AS share FROM k GROUP BY 1, 2")
def category_shares(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("cancer"), (F.col("o_custkey") % 3 - 1).alias("d_components"), (F.col("o_orderkey") % 3 - 1).alias("d_articulation"))
    return fusion.category_counts(fusion.categories(rows)).withColumn("share", F.round("share", 9))


@query("WITH a AS (SELECT p_partkey AS gene, p_brand AS architecture, CASE WHEN p_size % 4 = 0 THEN p_type END AS t FROM part), f AS (SELECT architecture, arg_min(t, gene) AS l FROM a WHERE t IS NOT NULL GROUP BY 1) SELECT gene, architecture, coalesce(t, l) AS topology FROM a LEFT JOIN f USING (architecture)")
def topology(spark, sf):
    part = table(spark, sf, "part")
    return fusion.topology(part.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("architecture")), part.where("p_size % 4 = 0").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("topology")))


# Survival

GROUPS = "gs AS (SELECT CASE WHEN o_orderpriority < '3' THEN 'A' WHEN o_orderpriority < '4' THEN 'B' ELSE 'C' END AS stratum, CAST(date_diff('day', o_orderdate, max(l_shipdate)) AS BIGINT) AS duration, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate, o_orderstatus)"
RISKS = (
    GROUPS, "lv AS (SELECT duration, sum(event)::DOUBLE AS d, count(*) AS g, sum(event) FILTER (WHERE stratum = 'A') AS da, sum(event) FILTER (WHERE stratum = 'B') AS db, count(*) FILTER (WHERE stratum = 'A') AS ga, count(*) FILTER (WHERE stratum = 'B') AS gb FROM gs GROUP BY 1)",
    "rk AS (SELECT d, coalesce(da, 0) AS da, coalesce(db, 0) AS db, (sum(g) OVER t)::DOUBLE AS n, (sum(ga) OVER t)::DOUBLE AS na, (sum(gb) OVER t)::DOUBLE AS nb FROM lv WINDOW t AS (ORDER BY duration DESC))",
    "mx AS (SELECT sum(da - d * na / n) AS za, sum(db - d * nb / n) AS zb, sum(w * na / n * (1 - na / n)) AS vaa, sum(w * na / n * -nb / n) AS vab, sum(w * nb / n * (1 - nb / n)) AS vbb FROM (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS w FROM rk WHERE d > 0))",
    "ch AS (SELECT (za * za * vbb - 2 * za * zb * vab + zb * zb * vaa) / (vaa * vbb - vab * vab) AS chi2 FROM mx)",
)


def grouped(spark, sf):
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    p = F.col("o_orderpriority")
    return rows.select(F.when(p < "3", "A").when(p < "4", "B").otherwise("C").alias("stratum"), F.datediff("last", "o_orderdate").cast("long").alias("duration"), (F.col("o_orderstatus") == "F").cast("int").alias("event"))


@query(w(*RISKS) + "SELECT round(chi2, 6) AS chi2, 2 AS df, round(exp(-chi2 / 2), 6) AS p FROM ch")
def logrank_test(spark, sf):
    return survival.log_rank_test(grouped(spark, sf)).withColumns({"chi2": F.round("chi2", 6), "p": F.round("p", 6)})


def _pair_sql(a: str, b: str) -> str:
    return (
        f"SELECT '{a}' AS a, '{b}' AS b, round(o * o / v, 6) AS chi2, round({sql.two_sided('sqrt(o * o / v)')}, 6) AS p FROM (SELECT sum(da - d * na / n) AS o, sum(CASE WHEN n > 1 THEN d * na / n * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM "
        f"(SELECT sum(event)::DOUBLE AS d, coalesce(sum(event) FILTER (WHERE stratum = '{a}'), 0) AS da, (sum(count(*)) OVER t)::DOUBLE AS n, (sum(count(*) FILTER (WHERE stratum = '{a}')) OVER t)::DOUBLE AS na FROM gs WHERE stratum IN ('{a}', '{b}') GROUP BY duration WINDOW t AS (ORDER BY duration DESC)) WHERE d > 0)")


@query(w(GROUPS) + " UNION ALL ".join(_pair_sql(a, b) for a, b in ("AB", "AC", "BC")))
def logrank_pairs(spark, sf):
    return survival.log_rank_pairs(grouped(spark, sf)).withColumns({"chi2": F.round("chi2", 6), "p": F.round("p", 6)})


@query("SELECT c_custkey AS patient, CASE WHEN n IS NULL THEN 'No Fusion' WHEN n = 1 THEN 'Single' ELSE 'Multiple' END AS stratum FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def patient_strata(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient"))
    return survival.strata(people, table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("patient")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS patient, count(*) AS samples FROM orders WHERE o_orderkey % 3 < 2 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1")
def patient_samples(spark, sf):
    ending = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    samples = table(spark, sf, "orders").select(F.concat(F.col("o_custkey").cast("string"), ending).alias("sample"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("patient"))
    return survival.of_patients(samples, people).groupBy("patient").agg(F.count(F.lit(1)).alias("samples"))


COX = "cx AS (SELECT date_diff('day', o_orderdate::DATE, last::DATE) AS duration, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event, o_totalprice / 100000 AS price, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS urgent FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"


@query(w(COX, *sql.cox("cx", ("price", "urgent"), 0.01, 8)) + "SELECT 'price' AS covariate, round(a, 7) AS coefficient FROM beta8 UNION ALL SELECT 'urgent', round(b, 7) FROM beta8")
def cox_coefficients(spark, sf):
    """Coefficients of price and priority on the orders' survival, with the ridge penalty of 0.01."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.datediff("last", "o_orderdate").cast("long").alias("duration"), (F.col("o_orderstatus") == "F").cast("int").alias("event"), (F.col("o_totalprice") / 100000).alias("price"), F.col("o_orderpriority").startswith("1").cast("int").alias("urgent"))
    found = {c: round(b, 7) for c, b in survival.cox(rows, ["price", "urgent"]).items()}
    return spark.createDataFrame(sorted(found.items()), "covariate string, coefficient double")
