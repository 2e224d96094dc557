"""Steps whose tables must not grow faster than their input."""

from pyspark.sql import functions as F

from sentograph import sources
from sentograph.operators import blocks, compare, diff, entropy, fusion, graph, ngrams, stats


def test_exploded_gene_tables_are_cut_to_the_genes_that_occur(spark, tmp_path):
    """A table exploded from a small one is not joined, nor broadcast, as it is: only the rows of genes that fusions have."""
    spark.range(2000).select(F.concat(F.lit("P"), "id").alias("gene_id")).write.parquet(str(tmp_path / "genes"))
    genes = spark.read.parquet(str(tmp_path / "genes"))
    i = F.col("i")
    exon = genes.select("gene_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("gene_id", (i * 300).alias("exon_start"), (i * 300 + 100).alias("exon_end"), (i * 101 + 1).alias("cds_start"), ((i + 1) * 101).alias("cds_end"))
    sided = spark.createDataFrame([(1, 5, "P7", 450, "+"), (1, 3, "P9", 450, "+"), (2, 5, "P7", 1250, "+"), (2, 3, "none", 1, "-")], "fusion_id long, side int, gene_id string, position long, strand string")
    found = fusion.exons(sided, exon)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert fusion.of_genes(exon, sided).count() == 16
    assert found.groupBy("fusion_id", "side").count().orderBy("fusion_id", "side").collect() == [(1, 3, 8), (1, 5, 8), (2, 5, 8)]
    domains = genes.select("gene_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("gene_id", F.concat(F.lit("D"), "i").alias("token"), (i * 80 + 1).alias("start"), (i * 80 + 51).alias("end"))
    parts = spark.createDataFrame([(1, 5, "P7", 140), (1, 3, "P9", 300), (2, 3, "none", 1)], "fusion_id long, side int, gene_id string, residue long")
    whole = fusion.recombine(parts, domains)
    assert "Generate" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["tokens"] for r in whole.collect()} == {1: ["D0", "D1", "D4", "D5"], 2: []}


def test_contained_files_shuffle_no_pairs(spark):
    """Against brute force, with equal files and null ids; what is cut holds contained sets only, and the plan counts no pairs."""
    import random

    dice = random.Random(3)
    files = {f"f{k:03}": [dice.choice([None, *range(6)]) if dice.random() < 0.1 else dice.randrange(6) for _ in range(dice.randrange(1, 7))] for k in range(120)}
    rows = spark.createDataFrame([(f, i) for f, ids in files.items() for i in ids] + [(None, 1), ("f000", files["f000"][0])], "file string, id int")
    found = sources.contained_files(rows)
    sets = {f: set(ids) for f, ids in files.items()}
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a != b and None not in x and x <= y and (len(y) > len(x) or b < a)}
    got = [tuple(r) for r in found.select("file", "within").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_contained_files_deal_out_large_sets(spark):
    """Files of equal ids go on in pieces: no row holds many of them, a pair of large sets is many rows, and pairs of files are made without a lookup for each."""
    equal = {"a": ([1], 700), "b": ([1, 2], 600), "c": ([3, None], 5), "d": ([3], 2)}
    member = spark.createDataFrame([(s, f"{s}{k:04}") for s, (_, n) in equal.items() for k in range(n)], "set string, file string")
    pieces = sources._pieces(member, 64)
    assert sorted((r["set"], f) for r in pieces.collect() for f in r["files"]) == sorted(map(tuple, member.collect()))
    assert pieces.agg(F.max(F.size("files"))).first()[0] <= 128 and pieces.where("set = 'a'").count() == 11
    rows = member.join(spark.createDataFrame([(s, i) for s, (ids, _) in equal.items() for i in ids], "set string, id int"), "set")
    found = sources.contained_files(rows.select("file", "id"))
    last = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert last.count("Generate explode") == 2
    kinds = found.groupBy(F.substring("file", 1, 1).alias("f"), F.substring("within", 1, 1).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file", "within").alias("d"), F.max(F.expr("file <= within")).alias("up")).collect()
    assert {(r["f"], r["w"]): (r["n"], r["d"]) for r in kinds} == {("a", "b"): (420000, 420000), ("a", "a"): (244650, 244650), ("b", "b"): (179700, 179700), ("d", "c"): (10, 10), ("d", "d"): (1, 1)}
    assert not any(r["up"] for r in kinds if r["f"] == r["w"])


def test_recurrent_genes_count_without_lists(spark):
    """Counts of genes hold no list of a gene's patients; the lists themselves keep repeats, in order, and a null gene is a gene."""
    rows = spark.createDataFrame([("g", "c1", 1, "x", 5), ("g", "c2", 1, "y", 3), ("g", "c2", 2, "y", 3), ("g", "c2", 2, None, None), ("h", "c1", 4, "x", 1), (None, "c1", 1, "x", 2), (None, "c2", 1, "x", 1)], "gene_id string, cancer string, pair long, architecture string, patient long")
    counts = fusion.gene_counts(rows)
    assert "collect" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, counts.collect()), key=str) == [("g", 2, 2, 2, 3), (None, 2, 1, 1, 2)]
    assert sorted(map(tuple, fusion.recurrent_genes(rows).collect()), key=str) == [("g", 2, 2, 2, [3, 3, 5]), (None, 2, 1, 1, [1, 2])]


def test_recurrent_genes_lists_patients_in_its_query(spark, sf):
    """The query goes through the operator's lists of patients, whose sizes it returns, not through the counts alone."""
    from sentograph.plans import catalog

    found = catalog.QUERIES["recurrent_genes"](spark, sf)
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    lines = read("lineitem").join(read("part"), F.expr("p_partkey = l_partkey")).join(read("orders"), F.expr("o_orderkey = l_orderkey")).select("p_brand", "o_orderpriority", "o_orderkey", "p_type", "o_custkey").collect()
    genes = {g: [r for r in lines if r["p_brand"] == g] for g in {r["p_brand"] for r in lines}}
    sets = {g: [len({r[c] for r in rows}) for c in ("o_orderpriority", "o_orderkey", "p_type")] for g, rows in genes.items()}
    assert sorted(map(tuple, found.collect())) == sorted((g, *n, len(genes[g])) for g, n in sets.items() if n[0] > 1)


def test_trials_that_are_all_alike_do_not_differ(spark):
    """As in the SQL of separation_fpr, whose trials all separate alike on larger tables: p is 1, and a rate is no null."""
    rows = [(of, kind, t, -1.0 if of == 0 else 0.1 * t, 0.5 * t) for of in (0, 1) for kind in ("random", "subsample") for t in range(6)]
    found = diff.stability_tests(spark.createDataFrame(rows, "of int, kind string, trial int, separation double, iqr double"))
    by = {r["of"]: r for r in found.collect()}
    assert by[0]["separation_p"] == 1.0 and by[1]["separation_p"] == by[0]["iqr_p"]
    assert diff.check_rates(found.where("of = 0"), found.where("of = 1")).collect() == [(1.0, 1.0)]


def test_postings_hold_no_windows_and_support_sorts_none(spark):
    """Windows are exploded after sequences of an id are put together, ids that repeat or are null included; support is counted by hash."""
    rows = [(1, ["a", "b", "a"]), (1, ["a", "b"]), (None, ["a", "b"]), (None, ["b", "c"]), (2, []), (3, None)]
    posted = ngrams.postings(spark.createDataFrame(rows, "id long, tokens array<string>"), 2)
    plan = posted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
    got = [(r["id"], tuple(r["tokens"])) for r in posted.collect()]
    want = {(i, tuple(t[a : a + k])) for i, t in rows if t for a in range(len(t)) for k in (1, 2) if a + k <= len(t)}
    assert len(got) == len(set(got)) and set(got) == want
    known = ngrams.support(posted)
    steps = known._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("Aggregate") == 3
    assert {r["ngram"]: r["support"] for r in known.collect()} == {"a": 2, "b": 2, "a|b": 2, "b|a": 1, "c": 1, "b|c": 1}


def test_leaves_are_no_part_of_the_spanning_forest(spark):
    """Stars, a pair, a path and a cycle with tails, edges both ways and repeated: what hangs on one node goes before the forest is made. Against removal of each node."""
    made = []

    def store(rows):
        made.append(graph.cut(rows))
        return made[-1]

    def parts(edges, nodes):
        home = {n: n for n in nodes}
        for _ in nodes:
            for a, b in edges:
                if a in home and b in home:
                    home[a] = home[b] = min(home[a], home[b])
        return len(set(home.values()))

    stars = [(f"c{k % 5}", f"o{k}") for k in range(40)]
    points = blocks.articulation_points(blocks.block_tree(spark.createDataFrame(stars, "src string, dst string"), store))
    assert {r[0] for r in points.collect()} == {f"c{k}" for k in range(5)}
    assert len(made) == 2
    shapes = stars + [("x", "y"), ("y", "x"), ("x", "x")] + [(f"p{k:02}", f"p{k + 1:02}") for k in range(12)] + [(f"r{k}", f"r{(k + 1) % 4}") for k in range(4)] * 2 + [("r0", "t0"), ("t0", "t1"), ("r2", "c0")]
    tree = blocks.block_tree(spark.createDataFrame(shapes, "src string, dst string"))
    nodes = {n for e in shapes for n in e}
    whole = parts(shapes, nodes)
    assert {r[0] for r in blocks.articulation_points(tree).collect()} == {n for n in nodes if parts(shapes, nodes - {n}) > whole}
    rows = tree.collect()
    assert len({r["node"] for r in rows}) == len(rows) == len(nodes) - whole
    assert len({r["block"] for r in rows}) == len([e for e in {frozenset(e) for e in shapes} if len(e) == 2]) - 3


def _odd_corpus(spark):
    """Ids of equal sequences, in any order of them, null and repeated ids, tokens with a bar or empty, empty and null sequences."""
    rows = [(k, ["a", "b", "a"][: 1 + k % 3]) for k in range(30)] + [(3, ["b", "c"]), (6, ["b", "c"]), (6, ["b", "c"]), (None, ["a", "b"]), (None, ["b", "c"]), (40, []), (41, None), (42, ["x|y", "z"]), (43, ["", "b"])]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


def test_support_looks_at_equal_sequences_once(spark):
    """As the support of the postings; windows are made after the sequences are counted, and the keys that n-grams are counted by hold no tokens."""
    rows = _odd_corpus(spark)
    found = ngrams.supported(rows, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("sequences")
    assert plan[plan.index("Generate") :].count("Aggregate") == 2  # by id, then by sequences
    assert ngrams.alike(rows).where("size(sequences) = 1").agg(F.max("entities")).first()[0] >= 9
    as_set = lambda df: sorted((r["ngram"], r["n"], r["tokens"], r["support"]) for r in df.collect())
    assert str(as_set(found)) == str(as_set(ngrams.support(ngrams.postings(rows, 2))))
    assert str(as_set(ngrams.supported(rows, 2, 5))) == str(as_set(ngrams.support(ngrams.postings(rows, 2), 5)))
    plain = rows.where("id < 40")
    for part, same in zip(ngrams.collapse(ngrams.postings(plain, 3, ["a"], together=True)), ngrams.collapse(ngrams.postings(plain, 3, ["a"]))):
        assert as_set(part) == as_set(same)


def test_instances_are_counted_by_sequence(spark):
    """All occurrences, of repeated rows too, with windows made once for equal sequences."""
    rows = _odd_corpus(spark)
    found = entropy.instance_counts(rows, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]
    want = ngrams.instances(rows, 3).groupBy("ngram").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("count"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_sets_and_foregrounds_are_counted_by_sequence(spark):
    rows = _odd_corpus(spark).where("id is not null")
    sets = spark.createDataFrame([(k % 50, f"s{k % 4}") for k in range(80)], "id long, set string")
    found = compare.bipartite_of(rows, 2, sets)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Aggregate" in plan[plan.index("Generate") :]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, compare.bipartite(ngrams.postings(rows, 2), sets).collect()))
    posted = ngrams.postings(rows, 2)
    some = sets.where("set = 's1'").select("id")
    old = stats.enrichment(posted, posted.select("ngram").distinct(), some, rows.select("id"))
    new = stats.enrichment_of(rows, 2, some)
    steps = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in steps[steps.index("Generate") :]
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))


def test_new_ngrams_of_equal_sequences_are_found_once(spark):
    rows = spark.createDataFrame([(k, [["a", "b", "c"], ["a", "x"], ["a", "b"]][k % 3]) for k in range(12)] + [(1, ["b", "b"])], "id long, tokens array<string>")
    nodes = ngrams.supported(spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "id long, tokens array<string>"), 3)
    found = fusion.new_ngrams_of_all(rows, nodes, nodes, 3)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, found.collect())) == sorted(map(str, fusion.new_ngrams(rows, nodes, nodes, 3).collect()))


def test_small_graphs_are_searched_where_their_rows_meet(spark, monkeypatch):
    """Changes in articulation points of many sequences over small components, without a spanning forest; the larger ones by joins. Against removal of each node."""
    import random

    dice = random.Random(5)
    old = [(f"{c}:{a}", f"{c}:{b}") for c in range(8) for a, b in {tuple(sorted(dice.sample(range(4 + 2 * c), 2))) for _ in range(5 + 2 * c)}]
    nodes = sorted({n for e in old for n in e} | {"alone"})

    def parts(edges, own):
        home = {n: n for n in own}
        for _ in own:
            for a, b in edges:
                if a in home and b in home:
                    home[a] = home[b] = min(home[a], home[b])
        return home

    def points(edges):
        own = {n for e in edges for n in e}
        whole = len(set(parts(edges, own).values()))
        return {n for n in own if len(set(parts(edges, own - {n}).values())) > whole}

    linked = sorted({(i, f"t{i}.{dice.randrange(2)}", dice.choice(nodes), False) for i in range(25) for _ in range(dice.randrange(1, 5))} | {(i, f"t{i}.0", f"t{i}.1", True) for i in range(0, 25, 3)})
    before = len(points(old))
    want = {i: before - len(points(old + [(t, n) for k, t, n, _ in linked if k == i])) for i in {r[0] for r in linked}}
    rows = spark.createDataFrame(linked, "id long, top string, node string, own boolean")
    component = spark.createDataFrame(list(parts(old, nodes).items()), "node string, component string")
    edges = spark.createDataFrame(old, "src string, dst string")
    assert {r["id"]: r["d_articulation"] for r in fusion.articulation_change(rows, component, edges, 12).collect()} == want
    monkeypatch.setattr(blocks, "block_tree", None)
    assert {r["id"]: r["d_articulation"] for r in fusion.articulation_change(rows, component, edges).collect()} == want
    assert len(set(want.values())) > 2


def test_jaccard_reads_its_rows_once(spark):
    """Sizes and what is shared follow from one table of members' groups; null members count but are not shared, null groups don't."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(g, m) for g, ms in {"x": [1, 2, 3, None], "y": [2, 3, 4], "z": [9], "w": [None], None: [1, 2]}.items() for m in ms] * 2

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frame = spark.createDataFrame(rows, "g string, m long").mapInArrow(passed, "g string, m long")
    found = {(r["a"], r["b"]): r["jaccard"] for r in entropy.jaccard(frame, "g", "m").collect()}
    assert seen.value == len(rows)
    assert found == {("w", "x"): 0.0, ("w", "y"): 0.0, ("w", "z"): 0.0, ("x", "y"): 2 / 5, ("x", "z"): 0.0, ("y", "z"): 0.0}


def test_a_sets_ngrams_hold_no_pairs(spark):
    """Where all windows of an entity are there, a set's collapsed n-grams are those of the pairs, by counts alone; a network makes its postings once."""
    rows = _odd_corpus(spark).where("id < 42")
    posted = graph.cut(ngrams.postings(rows, 3))
    nodes = graph.cut(ngrams.closed(ngrams.support(posted)))
    as_set = lambda df: sorted((r["ngram"], r["n"], r["tokens"], r["support"]) for r in df.collect())
    for k in (2, 3, 5):
        members = rows.where(F.col("id") % k == 0).select("id")
        found = diff.set_ngrams(posted, nodes, members, True)
        assert found.columns == ["ngram", "n", "tokens", "support"] and "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert as_set(found) == as_set(diff.set_ngrams(posted, nodes, members)) != []
    made = []
    steps = ngrams.analysis(rows, 3, store=lambda df: made.append(graph.cut(df)) or made[-1])
    assert len(made) == 5 and not any("collect_set" in df._jdf.queryExecution().optimizedPlan().toString() for df in steps.values())
    assert as_set(steps["kept"]) == as_set(nodes)


def test_jaccard_corpora_splits_texts_once(spark, sf):
    """No filter beside the explosion makes the words of a text again."""
    import os

    import pytest

    from sentograph.plans import catalog

    if not os.path.isdir(sf):
        pytest.skip("no test data")
    plans, real = [], entropy.jaccard
    catalog.entropy.jaccard = lambda rows, a, b: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or real(rows, a, b)
    try:
        catalog.QUERIES["jaccard_corpora"](spark, sf)
    finally:
        catalog.entropy.jaccard = real
    assert plans[0].count("split(") == 1
