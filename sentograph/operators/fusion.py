"""Recombined sequences: from breakpoints to token sequences, and what they change in the containment graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks, corpus, graph, ngrams, order


def select_fusions(fusions: DataFrame, cancers: list[str] | None = None) -> DataFrame:
    """Reliable in-frame fusions on the current assembly, of the given cancer types, once each."""
    rows = fusions.where((F.col("Highly_Reliable_Seq") == "Seq+") & (F.col("Frame") == "In-Frame") & (F.col("Genome_Build_Version") == "hg38"))
    return (rows if cancers is None else rows.where(F.col("Cancertype").isin(cancers))).dropDuplicates()


def repair_genes(fusions: DataFrame) -> DataFrame:
    """H_gene and T_gene from the upper-case pair name."""
    pair = F.split(F.upper("Fusion_pair"), "-")
    return fusions.withColumns({"H_gene": pair[0], "T_gene": F.get(pair, 1)})


def gene_ids(genes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(gene, gene_id): by name before synonym, the newest version first, in any case of letters.

    mapping: gene_id, name, synonym, version.
    """
    asked = graph.cut(genes.select("gene", F.upper("gene").alias("key")).distinct())  # as a table it has its own size, which is small, not that of the fusions
    by = lambda c, order: mapping.select(F.upper(c).alias("key"), "gene_id", "version", F.lit(order).alias("order")).where("key is not null")
    found = asked.join(by("name", 0).union(by("synonym", 1)), "key")
    return found.groupBy("gene").agg(F.min_by("gene_id", F.struct("order", -F.col("version"), "gene_id")).alias("gene_id"))


def of_genes(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows (gene_id, ...) of the genes that occur (gene_id), as a table of that size.

    A plan takes rows that are exploded from a table of genes for as small as that table, and would broadcast them all through the driver."""
    return graph.cut(rows.join(genes.select("gene_id").distinct(), "gene_id", "left_semi"))


def sides(fusions: DataFrame, ids: DataFrame) -> DataFrame:
    """(fusion_id, side, gene, gene_id, chromosome, position, strand), a row for each side of fusions both of whose genes have an id."""
    side = lambda p, n: F.struct(F.lit(n).alias("side"), F.col(f"{p}_gene").alias("gene"), F.regexp_replace(f"{p}_chr", "^chr", "").alias("chromosome"), F.col(f"{p}_position").alias("position"), F.col(f"{p}_strand").alias("strand"))
    rows = fusions.select("fusion_id", F.explode(F.array(side("H", 5), side("T", 3))).alias("s")).select("fusion_id", "s.*")
    known = rows.join(ids, "gene")
    whole = known.groupBy("fusion_id").agg(F.count_distinct("side").alias("n")).where("n = 2")
    return known.join(whole, "fusion_id", "left_semi")


def exons(sided: DataFrame, exon: DataFrame) -> DataFrame:
    """Exons of each side with kept and cut: kept those on the side's part of the break, cut those that it runs through.

    exon: gene_id, exon_start, exon_end, cds_start, cds_end, exon_strand. Exons without coding sequence are neither.
    """
    rows = sided.join(of_genes(exon, sided), "gene_id")
    flip = ((F.col("side") == 5) & (F.col("strand") == "+")) | ((F.col("side") == 3) & (F.col("strand") == "-"))
    coding = F.col("cds_start").isNotNull()
    after = F.col("exon_start") >= F.col("position")
    past = F.col("exon_end") > F.col("position")
    kept = F.when(flip, ~after).otherwise(after)
    through = F.when(flip, ~past).otherwise(past)
    return rows.withColumns({"kept": coding & kept, "cut": coding & (kept != through)})


def peptide(exoned: DataFrame) -> DataFrame:
    """(fusion_id, side, gene_id, residue): the last residue of the 5' side, the first of the 3' side; without 3' coding sequence the fusion goes."""
    span = exoned.where("kept").groupBy("fusion_id", "side", "gene_id").agg(
        F.max("cds_end").alias("last"), F.min("cds_start").alias("first"),
        F.sum(F.when(F.col("cut"), F.abs(F.col("position") - F.when(F.col("strand") == "+", F.col("exon_end")).otherwise(F.col("exon_start")))).otherwise(0)).alias("lost"))
    base = F.when(F.col("side") == 5, F.col("last") - F.col("lost")).otherwise(F.col("first") + F.col("lost"))
    rows = span.withColumn("residue", F.ceil(base / 3).cast("long"))
    return rows.join(rows.where("side = 3").select("fusion_id"), "fusion_id", "left_semi").select("fusion_id", "side", "gene_id", "residue")


def recombine(parts: DataFrame, domains: DataFrame) -> DataFrame:
    """(id, tokens): the domains that the 5' side keeps (end up to its residue), then those of the 3' side (start from its residue).

    domains: gene_id, token, start, end. Genes with several proteins have to be resolved before.
    """
    parts = graph.cut(parts)
    kept = parts.join(of_genes(domains, parts), "gene_id").where(((F.col("side") == 5) & (F.col("end") <= F.col("residue"))) | ((F.col("side") == 3) & (F.col("start") >= F.col("residue"))))
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("side"), "start", "end", "token")))
    rows = kept.groupBy("fusion_id").agg(F.transform(ordered, lambda x: x["token"]).alias("tokens"))
    every = parts.select("fusion_id").distinct()
    return every.join(rows, "fusion_id", "left").select(F.col("fusion_id").alias("id"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def representatives(fused: DataFrame) -> DataFrame:
    """(id, tokens, copies): the smallest id of each distinct sequence."""
    return fused.groupBy("tokens").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "tokens", "copies")


def new_ngrams(fused: DataFrame, nodes: DataFrame, supported: DataFrame, longest: int) -> DataFrame:
    """(id, ngram, kind): windows of each sequence that are no node, "new" if no sequence had them, else "reintroduced"; of
    those only the ones that no longer one of the same sequence contains. Sequences that are a node themselves are left out."""
    own = fused.join(nodes.select("ngram"), F.array_join("tokens", corpus.BAR) == F.col("ngram"), "left_anti")
    posted = ngrams.postings(own, longest)
    missing = posted.join(nodes.select("ngram"), "ngram", "left_anti")
    inner = missing.select("id", "tokens", "n").where("n > 1").select("id", F.explode(F.array(F.slice("tokens", 1, F.size("tokens") - 1), F.slice("tokens", 2, F.size("tokens") - 1))).alias("t")).select("id", F.array_join("t", corpus.BAR).alias("ngram"))
    top = missing.join(inner, ["id", "ngram"], "left_anti")
    known = supported.select("ngram", F.lit("reintroduced").alias("kind"))
    return top.join(known, "ngram", "left").select("id", "ngram", F.coalesce("kind", F.lit("new")).alias("kind"), "tokens", "n")


def new_ngrams_of_all(fused: DataFrame, nodes: DataFrame, supported: DataFrame, longest: int) -> DataFrame:
    """``new_ngrams`` where many have equal sequences: they are found for one of them, the smallest id, and given to all."""
    own = graph.cut(fused.join(nodes.select("ngram"), F.array_join("tokens", corpus.BAR) == F.col("ngram"), "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("tokens")).alias("sequences")))
    first = graph.cut(own.groupBy("sequences").agg(F.min("id").alias("first")))
    found = graph.cut(new_ngrams(first.select(F.col("first").alias("id"), F.explode("sequences").alias("tokens")), nodes, supported, longest))
    with_any = first.join(found.select(F.col("id").alias("first")).distinct(), "first", "left_semi")
    return own.join(with_any, "sequences").select("id", "first").join(found.withColumnRenamed("id", "first"), "first").select("id", "ngram", "kind", "tokens", "n")


def categories(changes: DataFrame) -> DataFrame:
    """Adds category from the change in components and in articulation points (before less after)."""
    cc, ap = F.col("d_components"), F.col("d_articulation")
    kind = F.when((cc == 0) & (ap == 0), "no change").when((cc > 0) & (ap <= 0), "joins components").when((cc < 0) & (ap == 0), "adds a component").when((cc == 0) & (ap > 0), "adds redundancy").when((cc == 0) & (ap < 0), "adds a bridge")
    return changes.withColumn("category", F.coalesce(kind, F.lit("unclassified")))


def links(fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, top, node, own) of each sequence's new n-grams: the nodes that one contains or is contained in, and (own) the other new ones that it contains."""
    subs = lambda rows: rows.withColumn("sub", F.explode(F.array_distinct(ngrams._all(F.col("tokens"))))).withColumn("sub", F.array_join("sub", corpus.BAR))
    holds = subs(fresh.select("id", F.col("ngram").alias("top"), "tokens")).select("id", "top", F.col("sub").alias("node")).where("top <> node")
    inside = holds.join(nodes.select(F.col("ngram").alias("node")), "node", "left_semi").select("id", "top", "node", F.lit(False).alias("own"))
    around = subs(nodes.select("ngram", "tokens")).where("sub <> ngram").select(F.col("sub").alias("top"), F.col("ngram").alias("node"))
    around = fresh.select("id", F.col("ngram").alias("top")).join(around, "top").select("id", "top", "node", F.lit(False).alias("own"))
    own = holds.join(fresh.select("id", F.col("ngram").alias("node")), ["id", "node"], "left_semi").select("id", "top", "node", F.lit(True).alias("own"))
    return inside.union(around).union(own).distinct()


def component_change(fresh: DataFrame, linked: DataFrame, component: DataFrame) -> DataFrame:
    """(id, d_components): how many components fewer there are with a sequence's new n-grams; one that touches none adds one.

    A new n-gram joins the components of all nodes that it is linked to into one; new n-grams of a sequence that share a
    component are joined through it.
    """
    new = lambda c: F.concat(F.lit("new:"), F.col("id").cast("string"), F.lit(":"), c)
    old = linked.where("not own").join(component, "node").select("id", new("top").alias("src"), F.concat(F.lit("old:"), F.col("id").cast("string"), F.lit(":"), F.col("component").cast("string")).alias("dst")).distinct()
    touched = graph.cut(old.union(linked.where("own").select("id", new("top").alias("src"), new("node").alias("dst"))))
    alone = fresh.select("id", new("ngram").alias("src")).distinct()
    groups = graph.connected_components(touched.select("src", "dst"))
    news = alone.join(groups, alone.src == groups.node, "left").select("id", F.coalesce("component", "src").alias("g"))
    after = news.groupBy("id").agg(F.count_distinct("g").alias("after"))
    before = touched.where("dst like 'old:%'").groupBy("id").agg(F.count_distinct("dst").alias("before"))
    return after.join(before, "id", "left").select("id", (F.coalesce("before", F.lit(0)) - F.col("after")).alias("d_components"))


def articulation_change(linked: DataFrame, component: DataFrame, edges: DataFrame, small: int = blocks.SMALL) -> DataFrame:
    """(id, d_articulation): how many articulation points fewer there are with the new n-grams of a sequence that have links.

    Only nodes between linked ones can change. For each sequence, a component's tree of blocks is cut down to what lies
    between its linked nodes, with a leaf where more hangs on a node; with the new n-grams these are parts of one graph, keyed by sequence, whose points are counted.
    Components and such graphs of up to ``small`` rows are searched where their rows meet, larger ones by joins.
    """
    ends = graph.cut(linked.where("not own").select("id", "node").distinct().join(component, "node").select("component", "id", "node"))
    inside = edges.join(component, F.col("src") == F.col("node")).join(ends.select("component").distinct(), "component", "left_semi")
    none = lambda c: F.lit(None).cast(linked.schema[c].dataType)
    rows = graph.cut(inside.select("component", none("id").alias("id"), F.col("src").alias("a"), F.col("dst").alias("b")).union(ends.select("component", "id", "node", none("node"))))
    few, many = _by_size(rows, "component", small)
    parts = graph.cut(blocks.cut_down(few))
    if many is not None:
        parts = parts.union(_cut_down_by_joins(many))
    new = linked.select("id", F.concat(F.lit("new:"), "top").alias("src"), F.concat(F.when(F.col("own"), "new:").otherwise("node:"), "node").alias("dst"))
    every = graph.cut(parts.where("src is not null").select("id", "src", "dst").union(new))
    few, many = _by_size(every, "id", small)
    now = blocks.count_points(few)
    if many is not None:
        now = now.union(_count_points_by_joins(many))
    was = parts.where("src is null").groupBy("id").agg(F.sum("was").alias("was"))
    return linked.select("id").distinct().join(was, "id", "left").join(now, "id", "left").select("id", (F.coalesce("was", F.lit(0)) - F.coalesce("now", F.lit(0))).alias("d_articulation"))


def _by_size(rows: DataFrame, key: str, small: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that have up to ``small`` of them, and the others, None if there are none."""
    large = graph.cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select(key))
    return (rows, None) if large.isEmpty() else (rows.join(large, key, "left_anti"), rows.join(large, key, "left_semi"))


def _cut_down_by_joins(rows: DataFrame) -> DataFrame:
    """``blocks.cut_down`` for components of any size."""
    tree = blocks.block_tree(rows.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    places = blocks.depths(tree)
    many = graph.cut(blocks.memberships(tree).groupBy(F.concat(F.lit("node:"), "node").alias("n")).agg(F.count(F.lit(1)).alias("all")))
    ends = rows.where("b is null").select(F.struct("id", "component").alias("key"), F.concat(F.lit("node:"), "a").alias("x"))
    kept, on = blocks.between(ends, places)
    degree = kept.select("key", "x").union(kept.select("key", F.col("up").alias("x"))).groupBy("key", "x").agg(F.count(F.lit(1)).alias("kept"))
    nodes = on.where("x like 'node:%'").join(many, F.col("x") == F.col("n")).join(degree, ["key", "x"], "left").select("key.id", "x", "all", F.coalesce("kept", F.lit(0)).alias("kept"))
    nodes = graph.cut(nodes)
    none = F.lit(None).cast("long").alias("was")
    was = nodes.where("all > 1").groupBy("id").agg(F.count(F.lit(1)).alias("was")).select("id", F.lit(None).cast("string"), F.lit(None).cast("string"), "was")
    more = nodes.where("all > kept").select("id", "x", F.concat(F.lit("more:"), "x"), none)
    return kept.select("key.id", F.col("x").alias("src"), F.col("up").alias("dst"), none).union(more).union(was)


def _count_points_by_joins(rows: DataFrame) -> DataFrame:
    """``blocks.count_points`` for graphs of any size."""
    of = lambda x: F.concat(F.col("id").cast("string"), F.lit("|"), x)
    every = graph.cut(rows.select("id", of(F.col("src")).alias("src"), of(F.col("dst")).alias("dst")))
    points = blocks.articulation_points(blocks.block_tree(every)).withColumnRenamed("node", "point")
    owner = every.select("id", F.col("src").alias("point")).union(every.select("id", "dst")).distinct()
    return points.join(owner, "point").where(~F.col("point").startswith(of(F.lit("block:")))).groupBy("id").agg(F.count(F.lit(1)).alias("now"))


def recurrent(fused: DataFrame) -> DataFrame:
    """(tokens, patients, n_cancers, n_fusions) of sequences with several fusions; fused has tokens, patient, cancer, pair."""
    rows = fused.groupBy("tokens").agg(F.array_sort(F.collect_set("patient")).alias("patients"), F.count_distinct("cancer").alias("n_cancers"), F.count_distinct("pair").alias("n_fusions"))
    return rows.where("n_fusions > 1 or size(patients) > 1")


def multiple(fusions: DataFrame, patient: str = "BarcodeID") -> DataFrame:
    """Fusions of patients who have several."""
    many = fusions.groupBy(patient).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return fusions.join(many, patient, "left_semi")


def contributions(sided: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, side, count, novel): how often a side (5 or 3) gives a part, and how often to a sequence that is no node. sided: side, part, tokens."""
    known = nodes.select(F.col("ngram").alias("__g"), F.lit(1).alias("__known"))
    rows = sided.join(known, F.array_join("tokens", corpus.BAR) == F.col("__g"), "left")
    return rows.groupBy("part", "side").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("__known").isNull()).alias("novel"))


def gene_counts(sided: DataFrame) -> DataFrame:
    """(gene_id, n_cancers, n_fusions, n_architectures, n_patients) of genes whose fusions are in several cancers, as ``recurrent_genes``, without the lists of patients."""
    rows = sided.groupBy("gene_id").agg(F.count_distinct("cancer").alias("n_cancers"), F.count_distinct("pair").alias("n_fusions"), F.count_distinct("architecture").alias("n_architectures"), F.count("patient").alias("n_patients"))
    return rows.where("n_cancers > 1")


def recurrent_genes(sided: DataFrame) -> DataFrame:
    """(gene_id, n_cancers, n_fusions, n_architectures, patients) of genes whose fusions are in several cancers; sided: gene_id, cancer, pair, architecture, patient.

    The lists are made apart from the distinct counts, which would carry them through each of their steps."""
    lists = sided.groupBy(F.col("gene_id").alias("__g")).agg(F.sort_array(F.collect_list("patient")).alias("patients"))
    rows = gene_counts(sided).join(lists, F.col("gene_id").eqNullSafe(F.col("__g")))
    return rows.select("gene_id", "n_cancers", "n_fusions", "n_architectures", "patients")


def contribution_ranks(counts: DataFrame) -> DataFrame:
    """Adds to (ngram, five, three) ranks by either count, their mean, the rank of that, and the product's rank. Missing
    counts rank last, with the number of rows."""
    own = order.with_totals(counts, F.count(F.lit(1)).alias("__n"))
    for c in ("five", "three"):
        own = own.join(order.ranks(counts, c).withColumnRenamed("rank", f"rank_{c}"), c, "left").withColumn(f"rank_{c}", F.coalesce(f"rank_{c}", "__n"))
    own = graph.cut(own.withColumns({"mean_rank": (F.col("rank_five") + F.col("rank_three")) / 2, "score": F.coalesce("five", F.lit(0)) * F.coalesce("three", F.lit(0))}))
    both = own.join(order.ranks(own, "mean_rank", largest_first=False).withColumnRenamed("rank", "rank_mean"), "mean_rank").join(order.ranks(own, "score").withColumnRenamed("rank", "rank_score"), "score")
    return both.select("ngram", "five", "three", "rank_five", "rank_three", "mean_rank", "rank_mean", "score", "rank_score")


def topology(architectures: DataFrame, own: DataFrame) -> DataFrame:
    """Adds topology to (gene, architecture): the gene's own (gene, topology), else that of the first gene of equal architecture that has one."""
    direct = architectures.join(own, "gene", "left")
    known = direct.where("topology is not null").groupBy("architecture").agg(F.min_by("topology", "gene").alias("__like"))
    return direct.join(known, "architecture", "left").select("gene", "architecture", F.coalesce("topology", "__like").alias("topology"))


def impact(corpus_rows: DataFrame, fused: DataFrame, longest: int) -> DataFrame:
    """(id, copies, new, d_components, d_isolates, d_articulation, category) of each distinct recombined sequence that brings
    new n-grams: the whole chain. Changes are those before less those after."""
    known = ngrams.support(ngrams.postings(corpus_rows, longest))
    nodes = graph.cut(ngrams.closed(known))
    edges = graph.cut(ngrams.containment_edges(nodes))
    component = graph.components(nodes, edges)
    one = representatives(fused)
    fresh = graph.cut(new_ngrams(one, nodes, known, longest))
    linked = graph.cut(links(fresh, nodes))
    counts = fresh.groupBy("id").agg(F.count(F.lit(1)).alias("new"))
    ends = linked.select("id", F.col("top").alias("ngram")).union(linked.where("own").select("id", "node"))
    lone = fresh.join(ends, ["id", "ngram"], "left_anti").select("id", F.lit(-1).alias("n"))
    ended = linked.where("not own").join(graph.isolates(nodes, edges).select(F.col("ngram").alias("node")), "node", "left_semi").select("id", "node").distinct().select("id", F.lit(1).alias("n"))
    isolates = lone.union(ended).groupBy("id").agg(F.sum("n").alias("d_isolates"))
    changes = one.join(counts, "id").join(component_change(fresh, linked, component), "id").join(isolates, "id", "left").join(articulation_change(linked, component, edges), "id", "left").fillna(0, ["d_isolates", "d_articulation"])
    return categories(changes).select("id", "copies", "new", "d_components", "d_isolates", "d_articulation", "category")


def analysis(fusions: DataFrame, mapping: DataFrame, exon: DataFrame, domains: DataFrame, corpus_rows: DataFrame, longest: int, cancers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole chain from raw fusions: (id, tokens) of each fusion that both sides give coding sequence to, and the ``impact`` of the distinct sequences.

    fusions: fusion_id and the columns of ``select_fusions`` and ``sides``; mapping as for ``gene_ids``, exon as for ``exons``, domains as for ``recombine``.
    """
    chosen = repair_genes(select_fusions(fusions, cancers))
    ids = gene_ids(chosen.select(F.explode(F.array("H_gene", "T_gene")).alias("gene")), mapping)
    fused = graph.cut(recombine(peptide(exons(graph.cut(sides(chosen, ids)), exon)), domains))
    return fused, impact(corpus_rows, fused.where(F.size("tokens") > 0), longest)


def category_counts(changes: DataFrame, by: str = "cancer") -> DataFrame:
    """(by, category, n, share)."""
    rows = changes.groupBy(by, "category").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(by)))
