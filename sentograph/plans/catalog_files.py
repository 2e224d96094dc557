"""Queries of readers, writers and derived columns; what they read they write before, into the session's checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentograph import sources
from sentograph.operators import compare, corpus, diff, graph, labels, ngrams, survival
from sentograph.sources import workbook

from . import sql
from .base import EVG, ev, ev_graph, ob, query, scratch, table, w

#: Parts as annotated entities: three tokens each, with their spans.
PACKED = "pk AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE array_to_string(list_transform(range(0, 1 + p_partkey % 3), lambda i: 'n' || ((p_size + i) % 7) || ':T' || ((p_size + i) % 5) || ':' || (i * 50 + 1) || ':' || (i * 50 + p_size)), ';') END AS packed FROM part)"


def packed(spark, sf):
    one = lambda i: F.concat(F.lit("n"), ((F.col("p_size") + i) % 7).cast("string"), F.lit(":T"), ((F.col("p_size") + i) % 5).cast("string"), F.lit(":"), (i * 50 + 1).cast("string"), F.lit(":"), (i * 50 + F.col("p_size")).cast("string"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int")), one), ";")
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(text).alias("packed"))


def references(spark, sf) -> list[str]:
    """Two reference files; the second has some of the first's entities with other genes."""
    paths = [scratch(spark, "reference") for _ in range(2)]
    rows = packed(spark, sf).select(F.col("p_partkey").cast("string").alias("UniProt ID"), F.col("p_brand").alias("Gene"), F.col("packed").alias("Interpro Domains"))
    rows.write.option("header", True).csv(paths[0])
    rows.where(F.col("UniProt ID").cast("long") % 4 == 0).withColumn("Gene", F.lit("other")).write.option("header", True).csv(paths[1])
    return paths


IDS = "CASE WHEN packed = '' THEN '' ELSE array_to_string(list_transform(string_split(packed, ';'), lambda x: string_split(x, ':')[2]), '|') END"


@query(w(PACKED) + f"SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_brand END AS gene, packed, {IDS} AS architecture FROM pk JOIN part USING (p_partkey)")
def reference_files(spark, sf):
    rows = sources.reference_files(spark, references(spark, sf))
    return rows.select(F.col("UniProt ID").alias("id"), F.col("Gene").alias("gene"), F.col("Interpro Domains").alias("packed"), F.col("Interpro Domain Architecture IDs").alias("architecture"))


@query("SELECT r_name || '.ref.csv' AS file, n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey < 3")
def reference_folder(spark, sf):
    """A file a region, of which those with the suffix are read."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region").orderBy("r_regionkey").collect()
    folder = scratch(spark, "folder")
    files = spark._jvm.org.apache.hadoop.fs
    for r in region:
        at = scratch(spark, "one")
        nation.where(F.col("n_regionkey") == r["r_regionkey"]).select("n_name").coalesce(1).write.option("header", True).csv(at)
        fs = files.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(files.Path(folder))
        written = fs.globStatus(files.Path(f"{at}/part-*.csv"))[0].getPath()
        fs.rename(written, files.Path(f"{folder}/{r['r_name'].replace(' ', '_')}{'.ref' if r['r_regionkey'] < 3 else ''}.csv"))
    rows = sources.reference_folder(spark, folder, ".ref.csv")
    return rows.select(F.replace("file", F.lit("_"), F.lit(" ")).alias("file"), "n_name")


@query(w(*EVG) + 'SELECT ngram AS "row", ngram AS col, support AS value FROM c UNION ALL SELECT src, dst, weight FROM e')
def adjacency_json(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    path = scratch(spark, "adjacency")
    sources.write_adjacency_json(ngrams.adjacency(nodes, edges), path)
    return sources.read_adjacency_json(spark, path)


@query(w(*EVG) + "SELECT 'edge' AS kind, src AS a, dst AS b, weight AS value FROM e UNION ALL SELECT 'removed', ngram, NULL, NULL FROM s WHERE ngram NOT IN (SELECT ngram FROM c)")
def adjacency_csv(spark, sf):
    posted, nodes, edges = ev_graph(spark, sf)
    path, gone = scratch(spark, "edges"), scratch(spark, "removed")
    sources.write_adjacency_csv(ngrams.adjacency(nodes, edges), ngrams.collapsed(ngrams.support(posted)), path, gone)
    none = lambda t: F.lit(None).cast(t)
    read = sources.read_or_build(spark, path, sources.read_adjacency_csv, lambda: edges)
    return read.select(F.lit("edge").alias("kind"), F.col("row").alias("a"), F.col("col").alias("b"), "value").union(sources.read_removed_csv(spark, gone).select(F.lit("removed"), "ngram", none("string"), none("long")))


@query(w(*EVG) + "SELECT 'n-gram' AS kind, ngram, support FROM c UNION ALL SELECT 'edge', src || ' ' || dst, weight FROM e UNION ALL SELECT 'posting', ngram, count(*) FROM p JOIN c USING (ngram) GROUP BY ngram")
def precomputed(spark, sf):
    from sentograph.network import NgramNetwork, Options

    posted, nodes, edges = ev_graph(spark, sf)
    path, gone = scratch(spark, "edges"), scratch(spark, "removed")
    ngrams.adjacency(nodes, edges).write.option("header", True).csv(path)
    ngrams.collapsed(ngrams.support(posted)).select("ngram").write.csv(gone)
    net = NgramNetwork.from_saved(ev(spark, sf), sources.read_adjacency_csv(spark, path), sources.read_removed_csv(spark, gone), Options(longest=3))
    counts = net.postings.groupBy("ngram").agg(F.count(F.lit(1)).alias("support"))
    return net.nodes.select(F.lit("n-gram").alias("kind"), "ngram", "support").union(net.edges.select(F.lit("edge"), F.concat_ws(" ", "src", "dst"), "weight")).union(counts.select(F.lit("posting"), "ngram", "support"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS gene_id, contrast, round(CASE contrast WHEN 'a' THEN log2(o_totalprice / 100000) ELSE -log2(o_totalprice / 150000) END, 9) AS log2fc, round(CASE contrast WHEN 'a' THEN o_totalprice / 1000 END, 9) AS stat, CASE WHEN contrast = 'a' AND o_custkey % 10 > 0 THEN (o_custkey % 10) / 10.0 WHEN contrast = 'b' THEN 0.01 END AS padj FROM orders, (VALUES ('a'), ('b')) t(contrast)")
def differential_csv(spark, sf):
    path, price = scratch(spark, "deg"), F.col("o_totalprice")
    wide = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("gene_id"), F.log2(price / 100000).alias("log2FoldChange_a"), (price / 1000).alias("stat_a"), F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey") % 10 / 10).alias("padj_a"),
        (-F.log2(price / 150000)).alias("log2FoldChange_b"), F.lit(0.01).alias("padj_b"))
    wide.write.option("header", True).option("nullValue", "NA").csv(path)
    return sources.differential(spark, path).withColumns({"gene_id": F.col("gene_id").cast("string"), "log2fc": F.round("log2fc", 9), "stat": F.round("stat", 9)})


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def tab_separated(spark, sf):
    path = scratch(spark, "tsv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).option("sep", "\t").csv(path)
    return sources.delimited(spark, path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS _c0, s_name AS _c1 FROM supplier")
def tab_separated_without_header(spark, sf):
    path = scratch(spark, "tsv")
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("sep", "\t").option("compression", "gzip").csv(path)
    return sources.delimited(spark, path, header=False)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ordered, o_orderpriority FROM orders")
def workbook_records(spark, sf):
    path = scratch(spark, "workbooks")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    spread = orders.repartition("o_orderkey")  # a row takes the more time in Python, and a large row group would be one task's
    workbook.write_workbooks(spread, path, 5000).agg(F.sum("rows")).collect()  # writes the files
    return workbook.read_workbooks(spark, path).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).withColumnRenamed("o_orderdate", "ordered")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_records(spark, sf):
    path = scratch(spark, "json")
    sources.write_json(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), path)
    return spark.read.schema("n_nationkey long, n_name string").json(path)


@query('SELECT DISTINCT r_name AS "set", n_name AS gene FROM nation JOIN region ON r_regionkey = n_regionkey')
def gene_sets(spark, sf):
    path = scratch(spark, "sets")
    members = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    whole = members.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", F.struct(F.col("names").alias("geneSymbols")))))).alias("value"))
    whole.coalesce(1).write.text(path)
    return sources.gene_sets(spark, path)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0")
def remaining_entities(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    path = scratch(spark, "done")
    orders.where("id % 3 = 0").write.parquet(path)
    return sources.remaining(orders, spark.read.parquet(path), "id")


CONTAINED = "SELECT DISTINCT 'f' || o_custkey AS file, p_brand AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"


@query(f"WITH o AS ({CONTAINED}), z AS (SELECT file, count(*) AS n FROM o GROUP BY 1), b AS (SELECT a.file, c.file AS within, count(*) AS b FROM o a JOIN o c ON a.id = c.id AND a.file <> c.file GROUP BY 1, 2) SELECT b.file, within FROM b JOIN z ON z.file = b.file JOIN z y ON y.file = within WHERE b = z.n AND (y.n > z.n OR within < b.file)")
def contained_files(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return sources.contained_files(lines.select(F.concat(F.lit("f"), "o_custkey").alias("file"), F.col("p_brand").alias("id")))


@query("SELECT count(*) AS ids, greatest(1, CAST(ceil(count(*) / 300.0) AS BIGINT)) AS batches FROM orders")
def chunked_ids(spark, sf):
    rows = sources.batches(table(spark, sf, "orders"), "o_orderkey", 300)
    return rows.agg(F.count(F.lit(1)).alias("ids"), (F.max("batch") + 1).cast("long").alias("batches"))


@query("SELECT o_custkey, coalesce(f, 0) AS f, coalesce(o, 0) AS o FROM (SELECT o_custkey, count(*) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) JOIN (SELECT o_custkey, count(*) AS o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (o_custkey) WHERE f + o > 10")
def merged_counts(spark, sf):
    orders = table(spark, sf, "orders")
    of = lambda s, n: orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias(n))
    return sources.low_counts_removed(sources.merge_counts([of("F", "f"), of("O", "o")], "o_custkey"), "o_custkey", 10)


@query("SELECT o_orderpriority AS \"Comparison\", o_orderstatus AS variable, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY 1, 2")
def tidy_results(spark, sf):
    path = scratch(spark, "tidy")
    sources.write_tidy(table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("Comparison"), F.col("o_orderstatus").alias("variable")).agg(F.count(F.lit(1)).alias("value")), path)
    return sources.delimited(spark, path, ",")


# Derived columns


@query(w(PACKED) + f"SELECT p_partkey, {IDS} AS architecture FROM pk")
def annotated_architecture(spark, sf):
    return corpus.with_architecture(packed(spark, sf), "packed").select("p_partkey", "architecture")


ANNOTATED = "an AS (SELECT p_partkey AS id, string_split(x, ':') AS f FROM (SELECT p_partkey, unnest(string_split(packed, ';')) AS x FROM pk WHERE packed <> ''))"


@query(w(PACKED, ANNOTATED, "g AS (SELECT f[2] AS token, id, count(*) AS c, list(f[4]::BIGINT - f[3]::BIGINT) AS s FROM an GROUP BY 1, 2)") + "SELECT token, count(*) AS entities, array_to_string(list_sort(list(c)), ',') AS copies, array_to_string(list_sort(flatten(list(s))), ',') AS sizes FROM g GROUP BY token")
def token_spans(spark, sf):
    each = packed(spark, sf).select(F.col("p_partkey").alias("id"), F.explode(corpus.annotations(F.col("packed"))).alias("a")).select("id", F.col("a.id").alias("token"), "a.start", "a.end")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return corpus.spans_of(each).select("token", "entities", text("copies"), text("sizes"))


NAMES = "nm AS (SELECT DISTINCT replace(p_brand, 'Brand#', 'B') AS token, substr(p_brand, 1, 7) AS name FROM part)"


@query(w(sql.OB, sql.windows("ob", 2), NAMES, "lg AS (SELECT ngram, string_agg(name, '|' ORDER BY i) AS legible FROM (SELECT DISTINCT ngram, unnest(string_split(ngram, '|')) AS token, unnest(range(n)) AS i FROM s) JOIN nm USING (token) GROUP BY ngram)") + "SELECT legible AS ngram, count(DISTINCT id) AS support FROM p JOIN lg USING (ngram) GROUP BY 1")
def readable_postings(spark, sf):
    """Brands called by their first digit, so several n-grams get one name."""
    names = table(spark, sf, "part").select(F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("token"), F.substring("p_brand", 1, 7).alias("name")).distinct()
    return corpus.renamed_postings(ngrams.postings(ob(spark, sf), 2), names).groupBy("ngram").agg(F.count(F.lit(1)).alias("support"))


@query(w(*EVG, "lg AS (SELECT ngram, array_to_string(list_transform(string_split(ngram, '|'), lambda x: substr(x, 1, 1)), '|') AS name FROM c)") + 'SELECT a.name AS "row", b.name AS col, max(value) AS value FROM (SELECT ngram AS r, ngram AS k, support AS value FROM c UNION ALL SELECT src, dst, weight FROM e) JOIN lg a ON a.ngram = r JOIN lg b ON b.ngram = k GROUP BY 1, 2')
def readable_adjacency(spark, sf):
    _, nodes, edges = ev_graph(spark, sf)
    names = table(spark, sf, "events").select(F.col("event_type").alias("token")).distinct().withColumn("name", F.substring("token", 1, 1))
    return corpus.renamed_adjacency(ngrams.adjacency(nodes, edges), names)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS by_table, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS by_text FROM orders")
def event_flags(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", survival.event_flag(F.col("o_orderstatus"), {"F": 1, "O": 0}).alias("by_table"), survival.event_flag(F.col("o_orderpriority")).alias("by_text"))


@query("SELECT c_custkey, replace(replace(c_name, 'Customer#', 'C '), '000', '-') AS renamed, string_split(string_split(c_mktsegment || '_x y', ' ')[1], '_')[1] AS metric, regexp_replace(c_name || '_rep' || (c_custkey % 3), '[._-]?(rep)?[0-9]+$', '') AS condition, CASE WHEN c_acctbal / 1000 <= 1.25 THEN 'Low' WHEN c_acctbal / 1000 <= 2.5 THEN 'Med' ELSE 'High' END AS dispersion FROM customer")
def label_columns(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", labels.renamed(F.col("c_name"), [("Customer#", "C "), ("000", "-")]).alias("renamed"), labels.metric_of(F.concat("c_mktsegment", F.lit("_x y"))).alias("metric"),
        labels.condition_of(F.concat("c_name", F.lit("_rep"), (F.col("c_custkey") % 3).cast("string"))).alias("condition"), labels.dispersion_class(F.col("c_acctbal") / 1000).alias("dispersion"))


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INTEGER AS \"c_mktsegment_BUILDING\", (c_mktsegment = 'MACHINERY')::INTEGER AS \"c_mktsegment_MACHINERY\" FROM customer")
def one_hot(spark, sf):
    return labels.one_hot(table(spark, sf, "customer"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_MACHINERY")


@query(w(*EVG, sql.SETS, sql.SIDE_NODES) + "SELECT ngram, CASE WHEN u AND d THEN 'Both' WHEN u THEN 'Up' WHEN d THEN 'Down' ELSE 'None' END AS side FROM (SELECT ngram, ngram IN (SELECT node FROM sn WHERE side = 'up') AS u, ngram IN (SELECT node FROM sn WHERE side = 'down') AS d FROM c)")
def node_sides(spark, sf):
    from .catalog import ev_sides

    _, nodes, _, sides = ev_sides(spark, sf)
    of = lambda s: sides.where(F.col("set") == s).select(F.col("node").alias("ngram"))
    return labels.node_sides(nodes, of("up"), of("down"))


@query(w(sql.OB, sql.windows("ob", 4), sql.CLOSED, "k AS (SELECT ngram, n, support, len(list_distinct(string_split(ngram, '|'))) AS d FROM c)") + "(SELECT 'long' AS list, ngram, support FROM k WHERE n >= 2 AND (d > 2 OR n <= 3) ORDER BY support DESC, ngram LIMIT 10) UNION ALL (SELECT 'short', ngram, support FROM k WHERE n = 1 OR (d >= 2 AND n <= 3) ORDER BY support DESC, ngram LIMIT 10)")
def mixed_tops(spark, sf):
    long, short = labels.mixed_tops(graph.cut(ngrams.closed(graph.cut(ngrams.supported(ob(spark, sf), 4)))))
    return long.select(F.lit("long").alias("list"), "ngram", "support").union(short.select(F.lit("short"), "ngram", "support"))


@query("SELECT variable, max(v) FILTER (WHERE o_orderstatus = 'F') AS \"F\", max(v) FILTER (WHERE o_orderstatus = 'O') AS \"O\", max(v) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM (SELECT o_orderstatus, unnest(['n', 'customers']) AS variable, unnest([count(*), count(DISTINCT o_custkey)]) AS v FROM orders GROUP BY 1) GROUP BY variable")
def transposed(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return labels.transposed(wide, "o_orderstatus", ["n", "customers"], ["F", "O", "P"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem) ORDER BY l_quantity DESC, l_orderkey, l_linenumber DESC LIMIT 25")
def several_sort_keys(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct().orderBy(F.col("l_quantity").desc(), "l_orderkey", F.col("l_linenumber").desc()).limit(25)


PLOTTED = "rs AS (SELECT o_orderpriority AS comparison, 'NS' AS metric, unnest(['NS_FPR', 'NS Cohen', 'NS p_log']) AS variable, unnest([avg((o_orderstatus = 'F')::INT) / 9, avg(o_totalprice) / 100000 - 2.5, count(*) / 100.0]) AS value FROM orders GROUP BY 1)"


@query(w(PLOTTED, "p AS (SELECT comparison, max(value) FILTER (WHERE variable = 'NS_FPR') AS fpr, max(value) FILTER (WHERE variable = 'NS Cohen') AS cohen, max(value) FILTER (WHERE variable = 'NS p_log') AS p_log FROM rs GROUP BY 1)") + "SELECT comparison, round(fpr, 9) AS fpr, round(cohen, 6) AS cohen, round(p_log, 6) AS p_log, fpr <= 0.05 AS passes, cohen > 0 AS sign, round(abs(cohen), 6) AS score, CASE WHEN cohen > 0 THEN 0 ELSE 1 END AS category FROM p")
def plotted_results(spark, sf):
    one = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("comparison")).agg(
        (F.avg((F.col("o_orderstatus") == "F").cast("int")) / 9).alias("NS_FPR"), (F.avg("o_totalprice") / 100000 - 2.5).alias("NS Cohen"), (F.count(F.lit(1)) / 100.0).alias("NS p_log"))
    long = one.unpivot("comparison", ["NS_FPR", "NS Cohen", "NS p_log"], "variable", "value").withColumn("metric", labels.metric_of(F.col("variable")))
    return labels.plotted(long, "NS").withColumns({"fpr": F.round("fpr", 9), "cohen": F.round("cohen", 6), "p_log": F.round("p_log", 6), "score": F.round("score", 6)})


@query("SELECT o_orderkey, o_custkey AS id FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT o_orderkey, 900000 + o_custkey FROM orders WHERE o_custkey % 10 = 0")
def entity_ids(spark, sf):
    """Genes that the mapping lacks are found by a second name, some by neither."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("gene_id"))
    keys = table(spark, sf, "orders").select("o_custkey").distinct()
    first = keys.select(F.col("o_custkey").cast("string").alias("gene_id"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("id"))
    second = keys.where("o_custkey % 10 = 0").select(F.col("o_custkey").cast("string").alias("name"), (F.col("o_custkey") + 900000).alias("id"))
    return diff.with_entity_ids(orders, first, second).select("o_orderkey", "id")


@query(w(sql.EV, sql.windows("ev", 2)) + "SELECT id FROM ev WHERE id IN (SELECT id FROM p WHERE ngram = 'click|error')")
def entities_of(spark, sf):
    from sentograph.network import NgramNetwork, Options

    return NgramNetwork(ev(spark, sf), Options(longest=2, concat=False)).entities_of(ngram=spark.createDataFrame([("click|error",)], "ngram string")).select("id")


@query("WITH e AS (SELECT l_returnflag AS five, p_brand || '|' || p_type AS whole, l_linestatus AS three FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT five AS src, whole AS dst, count(*) AS weight FROM e GROUP BY 1, 2 UNION ALL SELECT whole, three, count(*) FROM e GROUP BY 1, 2), k AS (SELECT * FROM x WHERE list_contains(string_split(src, '|'), 'Brand#12') OR list_contains(string_split(dst, '|'), 'Brand#12')), n AS (SELECT src AS n FROM k UNION SELECT dst FROM k) SELECT * FROM x WHERE src IN (SELECT n FROM n) OR dst IN (SELECT n FROM n)")
def focused_edges(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_returnflag").alias("five"), F.concat("p_brand", F.lit("|"), "p_type").alias("whole"), F.col("l_linestatus").alias("three"))
    edges = lines.groupBy(F.col("five").alias("src"), F.col("whole").alias("dst")).agg(F.count(F.lit(1)).alias("weight")).union(lines.groupBy("whole", "three").agg(F.count(F.lit(1))))
    return compare.focused(edges, "Brand#12")
