"""Labels, comparisons of networks, and models without SQL, by hand or brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentograph.operators import blocks, compare, fusion, graph, kernels, labels, ngrams, stats, survival


def test_labels(spark):
    rows = spark.createDataFrame([("NS_pval dist", 1.0, "s_rep2"), ("IQR p", 3.0, "t.1"), ("x", None, "u")], "v string, d double, s string")
    got = [tuple(r) for r in rows.select(labels.metric_of(F.col("v")), labels.dispersion_class(F.col("d")), labels.condition_of(F.col("s")), labels.renamed(F.col("v"), [("NS", "A"), ("A_", "B ")])).collect()]
    assert got == [("NS", "Low", "s", "B pval dist"), ("IQR", "High", "t", "IQR p"), ("x", None, "u", "x")]
    hot = labels.one_hot(spark.createDataFrame([("a",), ("b",)], "c string"), "c", ["a", "b"]).collect()
    assert [r["c_b"] for r in hot] == [0, 1]
    nodes = spark.createDataFrame([("x",), ("y",), ("z",)], "ngram string")
    sides = labels.node_sides(nodes, nodes.where("ngram <> 'z'"), nodes.where("ngram = 'x'"))
    assert {r["ngram"]: r["side"] for r in sides.collect()} == {"x": "Both", "y": "Up", "z": "None"}


def test_component_fate(spark):
    full = spark.createDataFrame([(n, c) for c, own in (("A", "ab"), ("B", "cd"), ("C", "efg"), ("D", "h")) for n in own], "node string, component string")
    model = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3"), ("e", "4"), ("f", "4")], "node string, component string")
    assert {r["component"]: r["fate"] for r in compare.component_fate(full, model).collect()} == {"A": "preserved", "B": "split", "C": "truncated", "D": "lost"}


def test_running_enrichment_against_the_whole_walk(spark):
    draw = random.Random(1)
    genes = [(f"g{i:03}", draw.gauss(0, 1)) for i in range(60)]
    sets = [(s, g) for s in "abc" for g, _ in draw.sample(genes, 12)]
    got = {r["set"]: r["score"] for r in compare.running_enrichment(spark.createDataFrame(genes, "gene string, stat double"), spark.createDataFrame(sets, "set string, gene string"), 5).collect()}
    order = sorted(genes, key=lambda x: (-x[1], x[0]))
    for s in "abc":
        own = {g for t, g in sets if t == s}
        total, here, best = sum(abs(x) for g, x in genes if g in own), 0.0, 0.0
        for g, x in order:
            here += abs(x) / total if g in own else -1 / (len(genes) - len(own))
            best = max(best, here, key=abs)
        assert got[s] == pytest.approx(best)


def test_leaf_order(spark):
    rows = spark.createDataFrame([(k, c, v) for k, vs in {"p": (0, 0), "q": (9, 9), "r": (0, 1), "s": (9, 8)}.items() for c, v in zip("xy", vs)], "k string, c string, v long")
    order = compare.leaf_order(rows, "k", "c", "v")
    assert {frozenset(order[:2]), frozenset(order[2:])} == {frozenset("pr"), frozenset("qs")}


def test_cox_finds_the_hazard(spark):
    draw = random.Random(2)
    rows = []
    for i in range(600):
        x = i % 2
        rows.append((draw.expovariate(math.exp(0.8 * x)), 1, float(x)))
    frame = spark.createDataFrame(rows, "duration double, event int, x double")
    assert survival.cox(frame, ["x"], 0.0)["x"] == pytest.approx(0.8, abs=0.25)
    assert abs(survival.cox(frame, ["x"], 1.0)["x"]) < abs(survival.cox(frame, ["x"], 0.0)["x"])


def test_cox_takes_ties_as_efron_does(spark):
    """Against a fit that goes through the deaths one by one, with many deaths at a time."""
    draw = random.Random(8)
    rows = [(draw.randint(1, 9), int(draw.random() < 0.7), draw.gauss(0, 1), float(draw.randint(0, 1))) for _ in range(400)]
    t, e, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2:] for r in rows])
    for ridge in (0.0, 0.05):
        beta = np.zeros(2)
        for _ in range(30):
            r = np.exp(x @ beta)
            g, h = -len(rows) * ridge * beta, len(rows) * ridge * np.eye(2)
            for at in set(t):
                risk, died = t >= at, (t == at) & (e == 1)
                d = int(died.sum())
                for i in range(d):
                    weight = r * risk - i / d * r * died
                    s0, s1, s2 = weight.sum(), weight @ x, (x * weight[:, None]).T @ x
                    g = g - s1 / s0
                    h = h + s2 / s0 - np.outer(s1, s1) / s0**2
                g = g + x[died].sum(0)
            beta = beta + np.linalg.solve(h, g)
        found = survival.cox(spark.createDataFrame(rows, "duration int, event int, x double, y double"), ["x", "y"], ridge)
        assert [found["x"], found["y"]] == pytest.approx(beta.tolist(), abs=1e-6)


def test_tied_sums(spark):
    """The closed sums of reciprocals, for few and many terms, up to the smallest and from very large numbers on."""
    cases = [(1.0, 1), (1.5, 1), (7.25, 7), (16.0, 16), (17.0, 17), (40.5, 30), (5000.0, 5000), (5000.5, 4000), (1e9, 1), (1e9, 50), (1e12, 3000)]
    frame = spark.createDataFrame(cases, "a double, d long")
    one, two = survival.tied_sums(F.col("a"), F.col("d"))
    for r in frame.select("a", "d", one.alias("one"), two.alias("two")).collect():
        terms = [r["a"] - i for i in range(r["d"])]
        assert r["one"] == pytest.approx(sum(1 / u for u in terms), rel=1e-11) and r["two"] == pytest.approx(sum(1 / u**2 for u in terms), rel=1e-11)


def test_blocks_are_those_of_a_search(spark):
    """Random graphs of every density, trees, rings and cliques, as parts of one graph: points, and which edges share a block."""
    draw = random.Random(2)
    edges = [(f"{k}.{draw.randint(0, 14)}", f"{k}.{draw.randint(0, 14)}") for k in range(12) for _ in range(6 + 2 * k)]
    edges += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r0", "t0"), ("t0", "t1"), ("t0", "t2")] + [(f"q{i}", f"q{j}") for i in range(5) for j in range(i)] + [("x", "y")]
    edges = [e for e in edges if e[0] != e[1]]
    frame = spark.createDataFrame(edges + edges[:5] + [("z", "z")], "src string, dst string")
    tree = graph.cut(blocks.block_tree(frame))
    assert sorted(r["node"] for r in blocks.articulation_points(tree).collect()) == sorted(kernels.cut_nodes(kernels.block_tree(kernels._adjacent(*zip(*edges)))))
    own = {}
    for r in blocks.memberships(tree).collect():
        own.setdefault(r["block"], set()).add(r["node"])
    assert all(sum({a, b} <= x for x in own.values()) == 1 for a, b in edges)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(start, without, within):
        seen, todo = {start}, [start]
        while todo:
            new = (near[todo.pop()] & within) - {without} - seen
            seen |= new
            todo += new
        return seen

    for x in own.values():  # nothing in a block hangs on one node
        assert all(len(x) == 2 or reach(min(x - {v}), v, x) == x - {v} for v in x)
    assert blocks.block_tree(frame.limit(0)).collect() == []


def test_blocks_of_a_long_chain(spark):
    n = 100_000
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert blocks.articulation_points(blocks.block_tree(chain)).agg(F.count(F.lit(1)), F.min("node"), F.max("node")).first()[:] == (n - 2, 1, n - 2)


def test_cox_says_if_it_does_not_settle(spark):
    frame = spark.createDataFrame([(float(i), 1, float(i % 2)) for i in range(20)], "duration double, event int, x double")
    with pytest.raises(RuntimeError):
        survival.cox(frame, ["x"], 0.0, steps=1)


def test_permuted_enrichment_repeats_itself(spark):
    draw = random.Random(3)
    genes = [(f"g{i:03}", draw.gauss(0, 1)) for i in range(80)]
    top = [g for g, _ in sorted(genes, key=lambda x: -x[1])[:12]]
    sets = [("top", g) for g in top] + [("any", g) for g, _ in draw.sample(genes, 12)]
    make = lambda: {r["set"]: r for r in compare.enrichment_significance(spark.createDataFrame(genes, "gene string, stat double"), spark.createDataFrame(sets, "set string, gene string"), 60, 2, 5).collect()}
    got = make()
    assert got == make() and got["top"]["p"] <= 0.02 and got["top"]["normalized"] > 1.5 and got["any"]["p"] > 0.02


def test_equal_communities_are_merged(spark):
    soft = spark.createDataFrame([("a", "x", 2, 0.4, True), ("a", "y", 2, 0.4, True), ("b|c", "x", 3, 0.6, True), ("b|c", "y", 3, 0.6, True), ("d", "z", 5, 1.0, True), ("e", "x", 1, 0.2, True)], "hub string, node string, instances long, share double, core boolean")
    got = {(r["hub"], r["node"]): (r["instances"], round(r["share"], 9)) for r in kernels.merged_communities(soft, 5).collect()}
    assert got == {("b|c", "x"): (5, 1.0), ("b|c", "y"): (5, 1.0), ("d", "z"): (5, 1.0), ("e", "x"): (1, 0.2)}
    assert len(set(kernels.iteration_seeds(30, 1))) == 30 and kernels.iteration_seeds(30, 1) != kernels.iteration_seeds(30, 2) and max(kernels.iteration_seeds(1500, 1)) > 1000


def test_large_components_are_refused(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    component = spark.createDataFrame([(x, "a") for x in "abcd"], "node string, component string")
    monkeypatch.setattr(kernels, "MOST_EDGES", 2)
    for refused in (lambda: kernels.louvain(edges, component), lambda: kernels.divisive(edges, component)):
        with pytest.raises(ValueError):
            refused()


def test_strata_and_sample_size(spark):
    people = spark.createDataFrame([("a",), ("b",), ("c",)], "patient string")
    fused = spark.createDataFrame([("a",), ("a",), ("b",)], "patient string")
    assert {r["patient"]: r["stratum"] for r in survival.strata(people, fused).collect()} == {"a": "Multiple", "b": "Single", "c": "No Fusion"}
    exposed, control = survival.cox_sample_size(0.84, 1.96, 1.0, 0.7, 0.5, 2.0)
    assert exposed == control and exposed == math.ceil((3 / 1) ** 2 * 2.8**2 / 1.2)


def test_impact_against_whole_graphs(spark):
    """Each sequence's graph is made anew, and its points counted by leaving out one node after the other."""
    draw = random.Random(4)
    own = [(i, [draw.choice("abcdefghijkl"[i % 3 * 4 : i % 3 * 4 + 4]) for _ in range(draw.choice([1, 2, 3, 4]))]) for i in range(26)] + [(90, ["p", "q"]), (91, ["r"]), (92, ["r", "s", "t"])]
    fused = [(i, [draw.choice("abcdefghijklpqrstxy") for _ in range(draw.choice([1, 2, 3, 4]))]) for i in range(70)] + [(70, ["p"]), (71, ["a", "x", "r"]), (72, ["x", "y"]), (73, ["s", "t"])]
    schema = "id long, tokens array<string>"
    windows = lambda t: {tuple(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    inside = lambda a, b: a != b and a in windows(b)
    corpus_rows = spark.createDataFrame(own, schema)
    nodes = {tuple(r["tokens"]) for r in ngrams.closed(ngrams.support(ngrams.postings(corpus_rows, 3))).collect()}

    def parts(every):
        left, n = set(every), 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                v = todo.pop()
                near = {w for w in left if inside(v, w) or inside(w, v)}
                left -= near
                todo += near
        return n

    def measures(every):
        whole, lone = parts(every), {v for v in every if not any(inside(v, w) or inside(w, v) for w in every)}
        return whole, len(lone), sum(parts(every - {v}) > whole for v in every)

    before, seen = measures(nodes), set()
    rows = {r["id"]: r for r in fusion.impact(corpus_rows, spark.createDataFrame(fused, schema), 3).collect()}
    fresh = {}
    known = ngrams.support(ngrams.postings(corpus_rows, 3))
    for r in fusion.new_ngrams(fusion.representatives(spark.createDataFrame(fused, schema)), ngrams.closed(known), known, 3).collect():
        fresh.setdefault(r["id"], set()).add(tuple(r["tokens"]))
    assert set(rows) == set(fresh) and len(rows) > 40
    for i, new in fresh.items():
        want = tuple(b - a for b, a in zip(before, measures(nodes | new)))
        assert (rows[i]["d_components"], rows[i]["d_isolates"], rows[i]["d_articulation"]) == want, fused[i]
        seen.add(rows[i]["category"])
    assert {"adds redundancy", "adds a bridge"} <= seen


def test_topology_falls_back_to_like_architectures(spark):
    genes = spark.createDataFrame([("g1", "A"), ("g2", "A"), ("g3", "B")], "gene string, architecture string")
    own = spark.createDataFrame([("g2", "TM")], "gene string, topology string")
    assert {r["gene"]: r["topology"] for r in fusion.topology(genes, own).collect()} == {"g1": "TM", "g2": "TM", "g3": None}


def test_bootstrap_repeats_itself(spark):
    rows = spark.createDataFrame([("a" if i % 2 else "b", float(i)) for i in range(60)], "g string, v double")
    first = stats.bootstrap_mann_whitney(rows, "v", "g", "a", "b", 10, 4, 1).orderBy("trial").collect()
    assert len(first) == 4 and first == stats.bootstrap_mann_whitney(rows, "v", "g", "a", "b", 10, 4, 1).orderBy("trial").collect()


def test_soft_communities_of_two_triangles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")], "src string, dst string")
    component = spark.createDataFrame([(x, "a") for x in "abcdef"], "node string, component string")
    groups = {}
    for r in kernels.divisive(edges, component).collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list("abc"), list("def")]
    soft = kernels.soft_communities(edges, component, [1, 2])
    assert {(r["hub"], r["node"]) for r in soft.where("core").collect()} == {(h, n) for h, own in groups.items() for n in own}
    assert kernels.soft_difference(soft, soft).collect() == []
