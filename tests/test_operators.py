"""Operators against brute force, known facts and properties."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sentograph import sources
from sentograph.network import NgramNetwork, Options
from sentograph.operators import blocks, corpus, diff, entropy, fusion, graph, hubs, kernels, ngrams, order, paths, stats, survival


def sequences(spark, rows):
    return spark.createDataFrame([(i, list(t)) for i, t in rows], "id string, tokens array<string>")


CASES = [("a", "xyzx"), ("b", "yz"), ("c", "xx"), ("d", ""), ("e", "xyz")]


def all_windows(t, n):
    return {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 1, min(len(t), i + n) + 1)}


def test_windows_and_closed_against_brute_force(spark):
    posted = ngrams.postings(sequences(spark, CASES), 10)
    got = {(r["id"], tuple(r["tokens"])) for r in posted.collect()}
    assert got == {(i, w) for i, t in CASES for w in all_windows(t, 10)}
    having = {}
    for i, w in got:
        having.setdefault(w, set()).add(i)
    inside = lambda a, b: len(a) < len(b) and any(b[k : k + len(a)] == a for k in range(len(b)))
    want = {w for w in having if not any(inside(w, v) and having[w] <= having[v] for v in having)}
    supported = ngrams.support(posted)
    assert {tuple(r["tokens"]) for r in ngrams.closed(supported).collect()} == want
    assert {tuple(r["tokens"]) for r in ngrams.collapse(posted)[0].collect()} == want
    kept = ngrams.closed(supported)
    edges = {(r["src"], r["dst"]) for r in ngrams.containment_edges(kept).collect()}
    assert edges == {("|".join(a), "|".join(b)) for a in want for b in want if inside(a, b)}


def test_collapse_twice_changes_nothing(spark):
    draw = random.Random(1)
    rows = [(str(i), "".join(draw.choice("abc") for _ in range(draw.randint(0, 6)))) for i in range(30)]
    posted = ngrams.postings(sequences(spark, rows), 6)
    kept, removed = ngrams.collapse(posted)
    again, none = ngrams.collapse(posted.join(kept.select("ngram"), "ngram", "left_semi"))
    assert none.isEmpty()
    assert {r["ngram"] for r in again.collect()} == {r["ngram"] for r in kept.collect()}
    assert kept.count() + removed.count() == ngrams.support(posted).count()


def test_annotations(spark):
    df = spark.createDataFrame([("A:I1:3:9;B:I2:10:20",), ("",), (None,)], "x string")
    rows = df.select(corpus.annotations(F.col("x")).alias("a")).collect()
    assert [(p["name"], p["id"], p["start"], p["end"]) for p in rows[0]["a"]] == [("A", "I1", 3, 9), ("B", "I2", 10, 20)]
    assert rows[1]["a"] == [] and rows[2]["a"] == []
    assert corpus.with_architecture(df, "x").select("architecture").first()[0] == "I1|I2"


@pytest.fixture
def small(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f")]
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "ngram string")
    return nodes, spark.createDataFrame(edges, "src string, dst string")


def test_graph(spark, small):
    nodes, edges = small
    component = graph.components(nodes, edges)
    assert {r["node"]: r["component"] for r in component.collect()} == dict(zip("abcdefg", "aaaaeeg"))
    far = graph.distances(nodes.select(F.col("ngram").alias("node")), edges)
    known = {(r["src"], r["dst"]): r["d"] for r in far.collect()}
    assert known["a", "d"] == 2 and known["e", "f"] == 1 and ("a", "e") not in known and known["g", "g"] == 0
    assert {r["component"]: r["diameter"] for r in graph.diameters(far, component).collect()} == {"a": 2, "e": 1}
    assert [r["ngram"] for r in graph.isolates(nodes, edges).collect()] == ["g"]
    assert [r["node"] for r in blocks.articulation_points(blocks.block_tree(edges)).collect()] == ["c"]
    between = {r["node"]: r["betweenness"] for r in paths.betweenness(nodes, edges).collect()}
    assert between["c"] == pytest.approx(2 * 2 / (6 * 5)) and between["a"] == 0
    parts = kernels.louvain(edges, component).collect()
    assert {r["node"] for r in parts} == set("abcdef")
    assert kernels.divisive(edges, component).count() == 6


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "src long, dst long")
    found = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert found == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}
    assert graph.connected_components(edges.limit(0)).collect() == []


def test_separation_of_a_set_from_itself(spark, small):
    nodes, edges = small
    component = graph.components(nodes, edges)
    far = graph.distances(nodes.select(F.col("ngram").alias("node")), edges)
    penalty = graph.penalties(component, graph.diameters(far, component))
    own = spark.createDataFrame([("s", x) for x in "abd"], "set string, node string")
    got = graph.separation(own, own, far, penalty).first()["separation"]
    assert got == pytest.approx(-(1 + 1 + 2) / 3)


def test_modules(spark):
    star = [("h", x) for x in "pqr"]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r4"), ("r4", "r1xx"), ("r1xx", "r1")]
    edges = spark.createDataFrame(star + ring, "src string, dst string")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    found = {r["hub"]: r["kind"] for r in graph.modules(graph.components(nodes, edges, "node"), graph.degrees(nodes, edges, "node")).collect()}
    assert found == {"h": "flower", "r1xx": "ring"}


def test_normal_tail(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 2.9, 3.1, 5.0, 12.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.upper_normal(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)) / 2, rel=1e-10)


def test_mann_whitney_against_all_pairs(spark):
    draw = random.Random(3)
    a, b = [draw.randint(0, 9) for _ in range(40)], [draw.randint(2, 12) for _ in range(30)]
    rows = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, v double")
    got = stats.mann_whitney(rows, "v", "g", "a", "b").first()
    u = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b))
    assert got["u"] == u
    n, ties = 70, sum(t**3 - t for t in (sum(v == x for v in a + b) for x in set(a + b)))
    z = (abs(u - 600) - 0.5) / math.sqrt(40 * 30 / 12 * (71 - ties / (n * (n - 1))))
    assert got["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_hypergeometric_tail(spark):
    cases = [(k, n, m, 19) for n in (1, 3, 8) for m in (5, 11) for k in range(0, min(n, m) + 1)]
    rows = spark.createDataFrame(cases, "k long, n long, m long, total long")
    for r in stats.hypergeometric_tail(rows, "k", "n", "m", "total").collect():
        want = sum(math.comb(r["n"], i) * math.comb(19 - r["n"], r["m"] - i) for i in range(r["k"], min(r["n"], r["m"]) + 1)) / math.comb(19, r["m"])
        assert r["p"] == pytest.approx(want, rel=1e-11)


def test_hypergeometric_tail_of_large_numbers(spark):
    cases = [(k, n, m, 20_000) for n, m in ((400, 5000), (9000, 8000), (50, 19_990)) for k in sorted({0, 1, n * m // 20_000 - 5, n * m // 20_000, n * m // 20_000 + 40, min(n, m)}) if 0 <= k <= min(n, m)]
    rows = spark.createDataFrame(cases, "k long, n long, m long, total long")
    for r in stats.hypergeometric_tail(rows, "k", "n", "m", "total").collect():
        hits = sum(math.comb(r["n"], i) * math.comb(20_000 - r["n"], r["m"] - i) for i in range(r["k"], min(r["n"], r["m"]) + 1))
        want = _ratio(hits, math.comb(20_000, r["m"]))
        assert r["p"] == pytest.approx(want, rel=1e-8, abs=1e-300), (r["k"], r["n"], r["m"])


def _ratio(a, b):
    """a / b of numbers beyond the range of a float."""
    import fractions

    return float(fractions.Fraction(a, b))


def test_ranks_and_running_sums(spark):
    draw = random.Random(5)
    rows = [(draw.choice([None, "a", "b"]), draw.choice([None, *range(50)]), draw.randint(0, 9)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "g string, v int, w int")
    got = {(r["g"], r["v"]): r["rank"] for r in order.ranks(frame, "v", ["g"]).collect()}
    assert got == {(g, v): 1 + sum(h == g and u is not None and u > v for h, u, _ in rows) for g, v, _ in rows if v is not None}
    levels = frame.where("v is not null").groupBy("v").agg(F.sum("w").alias("w"))
    for blocks in (1, 2, 7, 64):
        found = {r["v"]: r["before"] for r in order.running(levels, "v", {"before": "w"}, blocks=blocks).collect()}
        assert found == {v: sum(w for _, u, w in rows if u is not None and u < v) for _, v, _ in rows if v is not None}
        both = frame.where("v is not null").groupBy("g", "v").agg(F.sum("w").alias("w"), F.sum(F.lit(0.5)).alias("x"))
        found = {(r["g"], r["v"]): (r["w0"], r["x0"]) for r in order.running(both, "v", {"w0": "w", "x0": "x"}, ["g"], blocks).collect()}
        before = lambda g, v: [w for h, u, w in rows if h == g and u is not None and u < v]
        assert found == {(g, v): (sum(before(g, v)), 0.5 * len(before(g, v))) for g, v, _ in rows if v is not None}
    assert order.running(levels.limit(0), "v", {"before": "w"}).collect() == []
    # Borders follow from the values alone, are values themselves, and ranges between them are of about one size.
    wide = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v"))
    cuts = [order.borders(x, "v", 64).first()[0] for x in (wide, wide.repartition(7), wide.union(wide))]
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) == 63
    sizes = [r["count"] for r in order.with_block(wide, "v", 64).groupBy("__block").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 6 * 20_000 / 64
    pairs = wide.select(F.struct(F.when(F.col("v") > 900, F.col("v")).alias("a"), F.col("v").alias("b")).alias("o"), F.lit(1).alias("n"))
    at = {v: k for k, v in enumerate(sorted(k * 7919 % 20_011 for k in range(20_000)))}
    assert all(at[r["o"]["b"]] == r["c"] for r in order.running(pairs, "o", {"c": "n"}, blocks=16).collect())
    top = order.top_with_ties(frame.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "n", 3).collect()
    assert sorted(r["rank"] for r in top) == sorted(r["rank"] for r in top if r["rank"] <= 3) and len(top) >= 3


def test_draws_are_the_first_by_their_digest(spark):
    import hashlib

    rows = [(i, "ab"[i % 3 == 0]) for i in range(3000)]
    draws = spark.createDataFrame([(t, g, n) for t in range(4) for g, n in (("a", 5), ("b", 2500))], "trial long, g string, take long")
    got = {}
    for r in stats.drawn(spark.createDataFrame(rows, "id long, g string"), "id", ["g"], draws, lambda t: stats.drawn_before("s", t, F.col("id"))).collect():
        got.setdefault((r["trial"], r["g"]), set()).add(r["id"])
    for t in range(4):
        for g, n in (("a", 5), ("b", 2500)):
            own = sorted((hashlib.md5(f"s|{t}|{i}".encode()).hexdigest(), i) for i, h in rows if h == g)[:n]
            assert got[t, g] == {i for _, i in own}


def test_nearest_members_are_those_of_all_distances(spark):
    draw = random.Random(6)
    edges = [(f"v{draw.randint(0, 20)}", f"v{draw.randint(0, 20)}") for _ in range(26)] + [("p", "q"), ("q", "r")]
    names = [f"v{i}" for i in range(21)] + ["p", "q", "r", "alone", "lone"]
    frame = spark.createDataFrame([e for e in edges if e[0] != e[1]], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    far = graph.distances(nodes, frame)
    component = graph.components(nodes, frame, "node")
    penalty = graph.penalties(component, graph.diameters(far, component))
    assert graph.distances(nodes, frame, 2).agg(F.max("d")).first()[0] == 2
    one, two = (spark.createDataFrame([(s, x) for s in ("s", "t") for x in draw.sample(names, 7)] + [("s", "alone"), ("t", end)], "set string, node string").distinct() for end in ("p", "lone"))
    known = {(r["src"], r["dst"]): r["d"] for r in far.collect()}
    members = {}
    for r in one.collect():
        members.setdefault(r["set"], []).append(r["node"])
    for r in graph.nearest_members(one, frame).collect():
        reach = sorted(known[m, r["at"]] for m in members[r["set"]] if (m, r["at"]) in known)
        assert [r["first"], r["second"]] == (reach + [None])[:2]
    for fixed, inner in ((None, None), (2.0, 0.0)):
        want = {r["set"]: r["separation"] for r in graph.separation(one, two, far, penalty, fixed, inner).collect()}
        got = {r["set"]: r["separation"] for r in graph.separation_by_search(one, two, component, frame, fixed, inner).collect()}
        assert got == pytest.approx(want) and len(got) == 2
    want = {r["set"]: r["mean"] for r in graph.mean_nearest(one, far, penalty, None).collect()}
    assert {r["set"]: r["mean"] for r in graph.mean_nearest_by_search(one, component, frame, None).collect()} == pytest.approx(want)


def test_betweenness_in_batches(spark, tmp_path):
    """Against counts of all shortest paths; a run goes on from the batches that are there."""
    import itertools
    import shutil

    draw = random.Random(13)
    edges = [(draw.randint(0, 17), draw.randint(0, 17)) for _ in range(30)] + [(30, 31), (31, 32)]
    edges = [e for e in edges if e[0] != e[1]]
    names = sorted({x for e in edges for x in e} | {40})
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in names}

    def shortest(a, b):
        level = [[a]]
        seen = {a}
        while level:
            if hits := [p for p in level if p[-1] == b]:
                return hits
            level = [[*p, w] for p in level for w in near[p[-1]] if w not in seen]
            seen |= {p[-1] for p in level}
        return []

    want = dict.fromkeys(names, 0.0)
    for a, b in itertools.combinations(names, 2):
        ways = shortest(a, b)
        for p in ways:
            for v in p[1:-1]:
                want[v] += 1 / len(ways)
    n = len(names)
    nodes, frame = spark.createDataFrame([(v,) for v in names], "ngram int"), spark.createDataFrame(edges, "src int, dst int")
    for batch in (7, 100):
        folder = str(tmp_path / str(batch))
        for again in range(2):
            got = {r["node"]: r["betweenness"] for r in paths.betweenness(nodes, frame, batch=batch, folder=folder).collect()}
            assert got == pytest.approx({v: 2 * x / ((n - 1) * (n - 2)) for v, x in want.items()})
            shutil.rmtree(f"{folder}/of={-(-n // batch)}/batch=0")
        assert paths.betweenness(nodes.limit(1), frame.limit(0), folder=f"{folder}/one").first()["betweenness"] == 0


def test_labels_give_all_distances(spark):
    """Random, dense, path-like and star-like parts, isolates; whatever the batches of hubs."""
    draw = random.Random(11)
    edges = [(f"a{draw.randint(0, 30)}", f"a{draw.randint(0, 30)}") for _ in range(45)] + [(f"p{i}", f"p{i + 1}") for i in range(9)] + [("s0", f"s{i}") for i in range(1, 9)] + [(f"k{i}", f"k{j}") for i in range(6) for j in range(i)]
    names = sorted({x for e in edges for x in e} | {"alone", "lone"})
    frame = spark.createDataFrame([e for e in edges if e[0] != e[1]], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    far = {(r["src"], r["dst"]): r["d"] for r in graph.distances(nodes, frame).collect()}
    component = graph.components(nodes, frame, "node")
    for growth in (4,):
        labels = hubs.distance_labels(nodes, frame, "node", growth)
        own = {}
        for r in labels.collect():
            own.setdefault(r["node"], {})[r["hub"]] = r["d"]
        assert sum(map(len, own.values())) == labels.count() < len(far) / 2
        for a in names:
            for b in names:
                assert min((d + own[b][h] for h, d in own[a].items() if h in own[b]), default=None) == far.get((a, b))
        # A label is there only if no earlier hub gives its distance.
        at = {h: x for x, hs in own.items() for h, d in hs.items() if d == 0}
        assert all(not any(h in own[at[g]] and own[at[g]][h] + own[x][h] <= d for h in own[x] if h < g) for x, hs in own.items() for g, d in hs.items())
    want = sorted(map(str, graph.diameters(graph.distances(nodes, frame), component).select("component", "size", "diameter").collect()))
    assert sorted(map(str, hubs.diameters(component, labels).collect())) == want
    one, two = (spark.createDataFrame([(s, x) for s in ("s", "t") for x in draw.sample(names, 9)] + [("s", "alone"), ("t", end)], "set string, node string").distinct() for end in ("p1", "lone"))
    penalty = graph.penalties(component, hubs.diameters(component, labels))
    pairs = graph.distances(nodes, frame)
    for fixed, inner in ((None, None), (2.0, 0.0)):
        want = {r["set"]: r["separation"] for r in graph.separation(one, two, pairs, penalty, fixed, inner).collect()}
        assert {r["set"]: r["separation"] for r in graph.separation(one, two, hubs.by_labels(labels), penalty, fixed, inner).collect()} == pytest.approx(want) and len(want) == 2
    empty = frame.limit(0)
    assert hubs.distance_labels(nodes, empty, "node").count() == len(names) and hubs.diameters(component.limit(0), labels).collect() == []


def test_cut_tables_are_cleared(spark):
    """What is cut has the rows and kinds that it had, in a table that goes when it is cleared."""
    rows = spark.createDataFrame([(1, ["a"], {"k": 2.0}, None)], "a long, b array<string>, c map<string, double>, d struct<x: int, y: string>")
    kept = graph.cut(rows)
    assert kept.collect() == rows.collect() and kept.schema == rows.schema and kept.inputFiles()
    before = list(graph._made)
    graph._made[:] = before[-1:]
    assert graph.clear() == 1 and graph.clear() == 0
    graph._made[:] = before[:-1]
    with pytest.raises(Exception, match="(?i)exist"):
        kept.collect()


def test_labels_of_many_nodes(spark):
    """100,000 nodes in a tree: each has no more labels than the logarithm of the nodes, against 10 ** 10 pairs."""
    n = 100_000
    edges = spark.range(1, n).select(F.col("id").alias("src"), F.floor((F.col("id") - 1) / 10).alias("dst"))
    labels = hubs.distance_labels(spark.range(n).withColumnRenamed("id", "node"), edges, "node", 64)
    assert labels.count() < math.log2(n) * n
    far = hubs.nearest(spark.createDataFrame([(0, n - 1)], "set int, node long"), spark.createDataFrame([(0, 1), (0, n - 1)], "set int, node long"), labels).first()["d"]
    up = lambda x: [x, *up((x - 1) // 10)] if x else [0]
    a, b = up(n - 1), up(1)
    assert far == min(a.index(x) + b.index(x) for x in a if x in b)


def test_trial_metrics_are_those_of_each_trial(spark):
    draw = random.Random(7)
    rows = sequences(spark, [(f"e{i}", "".join(draw.choice("abcd") for _ in range(draw.randint(1, 5)))) for i in range(40)]).cache()
    posted = ngrams.postings(rows, 3)
    nodes = graph.cut(ngrams.closed(ngrams.support(posted)))
    edges = graph.cut(ngrams.containment_edges(nodes))
    component = graph.components(nodes, edges)
    far = graph.distances(nodes.select(F.col("ngram").alias("node")), edges)
    penalty = graph.penalties(component, graph.diameters(far, component))
    members = [(t, s, f"e{i}") for t in (0, 1) for s, own in (("up", draw.sample(range(20), 8)), ("down", draw.sample(range(20, 40), 8))) for i in own] + [(2, "up", "e1")]
    got = {r["trial"]: r for r in diff.trial_metrics(posted, nodes, rows.select("id"), far, penalty, spark.createDataFrame(members, "trial long, set string, id string"), (1.0, 0.6)).collect()}
    assert got[2]["separation"] is None and got[2]["iqr"] is None and len(got) == 3
    for t in (0,):
        sides = {}
        for s in ("up", "down"):
            own = spark.createDataFrame([(i,) for u, v, i in members if (u, v) == (t, s)], "id string")
            kept = diff.set_ngrams(posted, nodes, own).select("ngram")
            sides[s] = stats.enrichment(posted, kept, own, rows.select("id")).select(F.lit("x").alias("set"), F.col("ngram").alias("node"), "p").cache()
        at = []
        for cutoff in (None, 1.0, 0.6):
            up, down = (sides[s].where("true" if cutoff is None else f"p <= {cutoff}").select("set", "node") for s in ("up", "down"))
            at += [r["separation"] for r in graph.separation(up, down, far, penalty).collect()] or [None]
        assert got[t]["separation"] == pytest.approx(at[0])
        rest = sorted(x for x in at[1:] if x is not None)
        quantile = lambda q: (lambda p: rest[int(p)] + (p - int(p)) * (rest[min(int(p) + 1, len(rest) - 1)] - rest[int(p)]))(q * (len(rest) - 1))
        assert got[t]["iqr"] == pytest.approx(quantile(0.75) - quantile(0.25))


def test_trials_have_the_sizes_of_their_pair(spark):
    rows = sequences(spark, [(f"e{i}", "ab" * (i % 4 + 1)) for i in range(400)])
    pair = spark.createDataFrame([(0, "up" if i % 3 else "down", f"e{i}") for i in range(120)], "of int, set string, id string")
    trials = diff.stability_trials(rows, pair, 3, 1).collect()
    assert trials == diff.stability_trials(rows, pair, 3, 1).collect() or sorted(map(str, trials)) == sorted(map(str, diff.stability_trials(rows, pair, 3, 1).collect()))
    sizes, members = {}, {(r["set"], r["id"]) for r in pair.collect()}
    for r in trials:
        key = (r["trial"]["kind"], r["trial"]["trial"])
        sizes.setdefault(key, {"up": 0, "down": 0})[r["set"]] += 1
        assert r["trial"]["kind"] == "random" or (r["set"], r["id"]) in members
    for t in range(3):
        assert sizes["random", t] == sizes["subsample", t] and 0.8 * 84 <= sum(sizes["random", t].values()) <= 1.2 * 84


def test_relative_entropy_with_itself(spark):
    f = entropy.frequencies(entropy.instance_counts(sequences(spark, CASES), 3))
    assert entropy.relative_entropy(f, f).first()[0] == pytest.approx(0)
    assert entropy.f0(sequences(spark, CASES)).first()[0] == round(math.log2(3), 3)


def test_kaplan_meier_by_hand(spark):
    rows = spark.createDataFrame([("s", 1, 1), ("s", 2, 0), ("s", 3, 1), ("s", 4, 1), ("s", None, 1)], "stratum string, duration long, event int")
    got = {r["duration"]: r["survival"] for r in survival.kaplan_meier(rows).collect()}
    assert got == pytest.approx({1: 0.75, 2: 0.75, 3: 0.375, 4: 0.0})
    two = rows.union(spark.createDataFrame([("t", 5, 1), ("t", 6, 1)], rows.schema))
    pair = survival.log_rank_pair(two, "s", "t").first()
    both = {r["stratum"]: (r["observed"], r["expected"]) for r in survival.log_rank(two).collect()}
    assert sum(o for o, _ in both.values()) == pytest.approx(sum(e for _, e in both.values()))
    assert 0 < pair["p"] < 1
    both_ways = survival.log_rank_test(two).first()
    assert (both_ways["chi2"], both_ways["df"], both_ways["p"]) == (pytest.approx(pair["chi2"]), 1, pytest.approx(pair["p"]))
    assert [(r["a"], r["b"]) for r in survival.log_rank_pairs(two).collect()] == [("s", "t")] and survival.log_rank_test(rows).collect() == []
    known = {(1, 3.84): 0.0500435, (2, 5.99): 0.0500366, (3, 0.5): 0.9188914, (5, 11.07): 0.0500096}
    for (df, x), p in known.items():
        assert spark.range(1).select(stats.upper_chi2(F.lit(x), df).alias("p")).first()["p"] == pytest.approx(p, abs=1e-6)


def test_fusion_steps(spark):
    fusions = spark.createDataFrame([(1, "A", "chr1", 150, "+", "B", "chr2", 250, "+"), (2, "A", "chr1", 150, "+", "Z", "chr2", 1, "+")], "fusion_id long, H_gene string, H_chr string, H_position long, H_strand string, T_gene string, T_chr string, T_position long, T_strand string")
    mapping = spark.createDataFrame([("g1", "a", None, 1), ("g1x", "A", None, 2), ("g2", "Q", "b", 1)], "gene_id string, name string, synonym string, version int")
    ids = fusion.gene_ids(fusions.select(F.explode(F.array("H_gene", "T_gene")).alias("gene")), mapping)
    assert {r["gene"]: r["gene_id"] for r in ids.collect()} == {"A": "g1x", "B": "g2"}
    sided = fusion.sides(fusions, ids)
    assert {(r["fusion_id"], r["side"], r["chromosome"]) for r in sided.collect()} == {(1, 5, "1"), (1, 3, "2")}
    exon = spark.createDataFrame([("g1x", 100, 129, 1.0, 30.0, 1), ("g1x", 200, 230, 31.0, 60.0, 1), ("g2", 200, 220, 1.0, 20.0, 1), ("g2", 260, 300, 22.0, 60.0, 1)], "gene_id string, exon_start long, exon_end long, cds_start double, cds_end double, exon_strand int")
    marked = {(r["gene_id"], r["exon_start"]): r["kept"] for r in fusion.exons(sided, exon).collect()}
    assert marked == {("g1x", 100): True, ("g1x", 200): False, ("g2", 200): False, ("g2", 260): True}
    parts = fusion.peptide(fusion.exons(sided, exon))
    domains = spark.createDataFrame([("g1x", "D1", 1, 9), ("g1x", "D2", 9, 20), ("g2", "D3", 1, 5), ("g2", "D4", 9, 19)], "gene_id string, token string, start int, end int")
    assert fusion.recombine(parts, domains).collect()[0]["tokens"] == ["D1", "D4"]


def test_differential(spark):
    wide = spark.createDataFrame([("g1", 2.0, 0.05), ("g2", -2.0, 0.01), ("g3", 1.0, 0.01), ("g4", 5.0, None)], "gene_id string, log2FoldChange_c double, padj_c double")
    long = sources.long_contrasts(wide).withColumnRenamed("gene_id", "id")
    assert {(r["set"], r["id"]) for r in diff.select_sets(long, 0.05, 1.0).collect()} == {("up", "g1"), ("down", "g2")}


def test_network_facade(spark):
    net = NgramNetwork(sequences(spark, CASES), Options(longest=3))
    net.validate()
    metrics = {r["metric"]: r["value"] for r in net.summary(True).collect()}
    assert metrics["entities"] == 5 and metrics["longest"] == 4
    with pytest.raises(ValueError):
        net.entities_of()
    with pytest.raises(ValueError):
        Options(mode="other")
    with pytest.warns(UserWarning):
        NgramNetwork(sequences(spark, CASES), Options(longest=9)).validate()
    for wrong in (Options(longest=2), Options(longest=3)):
        bad = NgramNetwork.from_saved(sequences(spark, CASES), net.adjacency, spark.createDataFrame([("x|y|z|x",)], "ngram string"), wrong)
        with pytest.raises(ValueError):
            bad.validate()
    with pytest.raises(ValueError):
        NgramNetwork(sequences(spark, []), Options(longest=3)).validate()
    drawn = net.random_entities(2, 3, 1).collect()
    assert len(drawn) == 6 and drawn == net.random_entities(2, 3, 1).collect()


def test_files(spark, tmp_path):
    head = "UniProt ID,Gene,Interpro Domains\n"
    (tmp_path / "a.csv").write_text(head + "P1,g1,X:I1:1:5;Y:I2:6:9\nP2,g2,\n")
    (tmp_path / "b.csv").write_text(head + "P1,g9,X:I1:1:5\n")
    rows = {r["UniProt ID"]: r for r in sources.reference_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert rows["P1"]["Gene"] == "g9" and rows["P1"]["Interpro Domain Architecture IDs"] == "I1" and rows["P2"]["Interpro Domains"] == ""
    with pytest.raises(ValueError):
        sources.reference_files(spark, [str(tmp_path / "a.csv")], "Nothing")
    adjacency = spark.createDataFrame([("a", "a", 2), ("a", "b", 1), ("b", "b", 0)], "row string, col string, value long")
    sources.write_adjacency_json(adjacency, str(tmp_path / "adj"))
    assert {tuple(r) for r in sources.read_adjacency_json(spark, str(tmp_path / "adj")).collect()} == {("a", "a", 2), ("a", "b", 1)}
    (tmp_path / "sets.json").write_text('{"s": {"geneSymbols": ["x", "y"]}}')
    assert sources.gene_sets(spark, str(tmp_path / "sets.json")).count() == 2
    assert {r["id"]: r["tokens"] for r in sources.as_corpus(spark, {"a": "x|y", "b": "", "c": ["z"], "d": "one"}).collect()} == {"a": ["x", "y"], "b": [], "c": ["z"], "d": ["one"]}
    assert {r["id"]: r["tokens"] for r in sources.as_corpus(spark, str(tmp_path / "a.csv")).collect()} == {"P1": ["I1", "I2"], "P2": []}
    assert [sorted(r["id"] for r in sources.as_ids(spark, x).collect()) for x in ("p", ["p", "q", "p"], {1, 2}, spark.createDataFrame([("k",)], "n string"))] == [["p"], ["p", "q"], [1, 2], ["k"]]
    with pytest.raises(ValueError):
        sources.as_ids(spark, adjacency)
    assert sources.read_or_build(spark, str(tmp_path / "none"), sources.read_adjacency_csv, lambda: adjacency) is adjacency
    (tmp_path / "list.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r["a"] for r in sources.read_json(spark, str(tmp_path / "list.json"), "a long").collect()) == [1, 2]
    inside = sources.contained_files(spark.createDataFrame([("f", 1), ("g", 1), ("g", 2)], "file string, id long")).collect()
    assert [(r["file"], r["within"]) for r in inside] == [("f", "g")]


def test_stream(spark, tmp_path):
    from sentograph.streaming import support_stream

    sequences(spark, CASES).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, tokens array<string>").json(str(tmp_path / "in"))
    done = support_stream(stream, 3).writeStream.outputMode("complete").format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "cp")).start()
    done.processAllAvailable()
    done.stop()
    want = {r["ngram"]: r["support"] for r in ngrams.support(ngrams.postings(sequences(spark, CASES), 3)).collect()}
    assert {r["ngram"]: r["support"] for r in spark.table("grown").collect()} == want
