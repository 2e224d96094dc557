"""Quality rules, SimHash and mixing against brute force, with odd inputs."""

import collections
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sentograph.llm import mixing, quality_rules, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def documents(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "s"), len(t or "")) for i, t in texts], SCHEMA)


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "a b c a b c"), (5, "x\nx\n\nx\n y\n y"), (6, "#$ %& é|<> " * 3), (7, "w " * 5000), (8, "é ü z w"), (9, "a b c a b c"), (None, "a b"), (7, "q")]


def counted(text):
    words = [x for x in SPACES.split(text or "") if x]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, places = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            places |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if SPACES.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places)


def test_counts_against_brute_force(spark):
    draw = random.Random(1)
    texts = ODD + [(100 + i, "".join(draw.choice(["a ", "b ", "c\n", "d  ", "#", "\t"]) for _ in range(draw.randint(0, 200)))) for i in range(60)]
    clash = documents(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(3)).withColumn("quality", F.lit(9))
    rows = quality_rules.with_counts(clash).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in quality_rules.COUNTS) == counted(r["text"]), r["text"]
    # and by the other path for many repeated windows
    many = " ".join(f"u{i % 40} v{i % 40}" for i in range(400))
    assert tuple(quality_rules.with_counts(documents(spark, [(1, many)])).first()[c] for c in quality_rules.COUNTS) == counted(many)


def test_rules_are_learned_and_keep_the_good(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        texts.append((i, " ".join((word() + "###" if bad and k % 3 == 0 else word()) for k in range(80))))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    labels += [(0, 0, 0), (1, None, None), (None, 1, 0), (99999, 0, 0)]
    out, rules = quality_rules.quality_rules(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rules and all(r.bad >= 10 for r in rules)
    verdict = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert not any(verdict[i] for i in range(0, 600, 5)) and all(verdict[i] for i in range(600) if i % 5)
    assert [c for c in out.columns if c in SCHEMA] and str(rules[0]).endswith("high)")


def test_rules_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, rules = quality_rules.quality_rules(documents(spark, ODD), none)
    assert rules == []
    for r in out.collect():
        n, *_, repeated = counted(r["text"])
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and r["kept"] == (not r["base_failed"])
    assert quality_rules.quality_rules(documents(spark, []), none)[0].collect() == []


def brute_fingerprint(text):
    words = [w for w in SPACES.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [*ODD, (20, "The Quick BROWN fox jumps ÄÖ over the lazy dog"), (21, "a b c")]
    for r in documents(spark, texts).select("text", simhash.fingerprints(F.col("text")).alias("f"), simhash.hexadecimal(simhash.fingerprints(F.col("text"))).alias("h")).collect():
        assert r["f"] % 2**64 == brute_fingerprint(r["text"]) and r["h"] == f"{brute_fingerprint(r['text']):016x}"


def test_links_are_all_found(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    values = list(base)
    for b in base:
        for d in (1, 2, 3, 4, 4, 4, 5, 6):
            v = b
            for bit in draw.sample(range(64), d):
                v ^= 1 << bit
            values.append(v)
    values = sorted(set(values))
    rows = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)], "root long, fp long")
    got = {(r["src"], r["dst"]) for r in simhash.links(rows).collect()}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 4}


def test_covering_code():
    for _, bits in simhash.BLOCKS:
        masks = simhash._masks(bits)
        assert all(m[0].bit_count() <= 1 and len(set(m)) == len(m) for m in masks)
        assert all(x.bit_count() <= 2 for m in masks for x in m)


def test_components_and_one_of_each(spark):
    draw = random.Random(4)
    words = [f"w{draw.randint(0, 10**6)}" for _ in range(400)]
    near = list(words)
    near[200] = "other"
    texts = [(5, " ".join(words)), (3, " ".join(near)), (8, " ".join(words)), (9, "alone in the world today"), (10, None), (11, " "), (9, "alone in the world today"), (None, "nobody knows this one here")]
    frame = documents(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    assert (brute_fingerprint(texts[0][1]) ^ brute_fingerprint(texts[1][1])).bit_count() <= 4
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame).collect())
    assert got == collections.Counter({(5, 3): 1, (3, 3): 1, (8, 3): 1, (9, 9): 2, (10, 10): 1, (11, 10): 1, (None, None): 1})
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "3", "9", "None"]
    assert sorted(str(r["doc_id"]) for r in simhash.one_of_each(frame, most_broadcast=0).collect()) == ["10", "3", "9", "None"]
    assert simhash.near_duplicates(documents(spark, [])).collect() == [] and simhash.one_of_each(documents(spark, [])).collect() == []


def classes(rows, radius=simhash.RADIUS):
    """Smallest id reachable and number of the class of each (id, text) row, by comparing all pairs."""
    prints = [brute_fingerprint(t) for _, t in rows]
    whose = list(range(len(rows)))

    def find(x):
        while whose[x] != x:
            x = whose[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                whose[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))], [find(i) for i in range(len(rows))]


def test_rows_count_by_themselves(spark):
    """Ids that repeat with different texts, and rows without an id that link others."""
    draw = random.Random(8)
    text = lambda: [f"w{draw.randint(0, 10**6)}" for _ in range(300)]
    chain = [text()]
    for _ in range(12):  # each near the one before
        chain.append(list(chain[-1]))
        for _ in range(3):
            chain[-1][draw.randrange(300)] = "other"
    rows = [(None if i % 3 == 1 else 100 - i, " ".join(w)) for i, w in enumerate(chain)]
    rows += [(7, " ".join(text())) for _ in range(3)] + [(7, " ".join(chain[0])), (100, "alone here"), (None, "nobody"), (None, "nobody")]
    least, which = classes(rows)
    assert len(set(which)) < len(rows) - 3
    got = collections.Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows).repartition(3)).collect())
    assert got == collections.Counter((d, brute_fingerprint(t), c) for (d, t), c in zip(rows, least))
    kept = simhash.one_of_each(documents(spark, rows).repartition(3)).collect()
    at = {(d, t): w for (d, t), w in zip(rows, which)}
    assert sorted(at[r["doc_id"], r["text"]] for r in kept) == sorted(set(which))
    names = {w: min((d is None, d or 0) for (d, _), v in zip(rows, which) if v == w) for w in which}
    assert all((r["doc_id"] is None, r["doc_id"] or 0) == names[at[r["doc_id"], r["text"]]] for r in kept)


def test_dense_groups_leave_few_pairs(spark):
    """All pairs of 697 fingerprints link; what is shuffled of that is in the order of their number."""
    middle = 0x0123456789ABCDEF
    values = [middle ^ (1 << a) ^ (1 << b) for a in range(0, 37) for b in range(a)] + [middle ^ (1 << a) for a in range(31)]
    nodes = spark.createDataFrame([(v, v) for v in values], "fp long, root long")
    assert len(values) == 697 and simhash.first_links(nodes).count() <= 6 * len(values)
    made = []

    def store(df, name):
        made.append((name, df.cache()))
        return made[-1][1]

    found = simhash.groups(nodes.select("fp"), store)
    assert {r["root"] for r in found.collect()} == {min(values)} and found.count() == len(values)
    drawn = [df for name, df in made if name == "drawn"][0]
    assert simhash.links(drawn).count() <= len(values)


def mixed(rows):
    return {r["doc_id"]: r for r in rows}


def test_mixing_targets_and_limits(spark):
    draw = random.Random(5)
    texts = [(i, "w " * draw.randint(0, 60)) for i in range(400)] + [(1000, None), (1001, "")]
    sources = {i: ["a", "b", "c", None][i % 4] if i < 300 else "a" for i, _ in texts}
    frame = documents(spark, texts, sources)
    rows = mixing.plan(frame).collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["epochs"] and len(r["positions"]) == r["epochs"]
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        by[r["source"]].append(r)
    size = {s: sum(r["size"] for r in v) for s, v in by.items()}
    weight = dict(zip(["a", "b", "c", None], [3, 1, 2, 3]))
    want, left = {}, set(size)
    while True:  # water filling, step by step
        rest = 1.5 * sum(size.values()) - sum(want.values())
        level = rest / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in left}
            break
        want |= {s: 2 * size[s] for s in over}
        left -= over
    for s, v in by.items():
        assert v[0]["target"] == pytest.approx(want[s]) and v[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in v) - want[s]) <= 31
    again = mixed(mixing.plan(frame.repartition(3)).collect())
    assert all(again[r["doc_id"]]["taken"] == r["taken"] for r in rows)
    order = [r["positions"][0] for r in rows if r["positions"]]
    assert order == sorted(order)


def test_curriculum_follows_the_schedule(spark):
    knots = ((0.0, 1.5), (0.25, 1.0), (1.0, 0.5))
    rows = spark.range(1001).select((F.col("id") / 1000).alias("s")).select("s", mixing.due(F.col("s"), knots).alias("t")).collect()

    def demand(t):
        area = lambda t0, w0, t1, w1, t: (t - t0) * (w0 + (w0 + (w1 - w0) * (t - t0) / (t1 - t0))) / 2
        whole = area(0, 1.5, 0.25, 1.0, 0.25) + area(0.25, 1.0, 1.0, 0.5, 1.0)
        return (area(0, 1.5, 0.25, 1.0, min(t, 0.25)) + (area(0.25, 1.0, 1.0, 0.5, t) if t > 0.25 else 0)) / whole

    for r in rows:
        assert demand(r["t"]) == pytest.approx(r["s"], abs=1e-9)


def test_mix_repeats_documents(spark):
    frame = documents(spark, [(i, "w " * 10) for i in range(40)], {i: "a" if i < 30 else "b" for i in range(40)}).withColumn("size", F.lit("clash"))
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    times = collections.Counter(r["doc_id"] for r in out.collect())
    assert max(times.values()) <= 2 and abs(sum(times.values()) - 60) <= 2
    assert mixing.mix(documents(spark, [])).collect() == []
    assert mixing.plan(documents(spark, [(1, None)])).first()["target"] == 0


def test_mix_is_the_plan_for_rows_that_repeat(spark):
    """Repeated ids with equal and other texts, null ids, and a third of all rows alike."""
    draw = random.Random(9)
    texts = [(i // 4, f"t{i % 2} " * (10 + i // 4 % 5)) for i in range(80)] + [(None, "n " * 7)] * 15 + [(None, f"m{i} " * 5) for i in range(9)] + [(5000, "hot " * 8)] * 60
    sources = {i: "ab"[i % 2] for i in range(80)}
    draw.shuffle(texts)
    frame = documents(spark, texts, sources).withColumn("number", F.lit("clash")).withColumn("row", F.lit(2)).repartition(4)
    plan = mixing.plan(frame).collect()
    assert len(plan) == len(texts)
    want, got = collections.Counter(), collections.Counter()
    for r in plan:
        want[r["doc_id"], r["source"], r["size"]] += r["epochs"]
    out = mixing.mix(frame).collect()
    for r in out:
        got[r["doc_id"], r["source"], len(r["text"].split())] += 1
    assert got == +want and mixing.mix(frame).columns == frame.columns
    by = collections.defaultdict(int)
    for r in plan:
        by[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for r in plan:
        assert abs(by[r["source"]] - r["target"]) <= 14 / 2 + 1
    again = collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.plan(frame.repartition(2)).collect())
    assert again == collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in plan)


def test_kept_documents_have_their_columns(spark):
    """Null, empty, very long and repeated rows, clashing names; the verdict is that of the whole query."""
    long_text = "word " * 30_000 + "".join(f"u{i} " for i in range(60_000))
    good = " ".join(f"g{i}" for i in range(60))
    texts = [*ODD, (20, good), (20, good), (None, good), (21, long_text)]
    frame = documents(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(3)).withColumn("__row", F.lit(1)).withColumn("quality", F.lit("q"))
    none = spark.createDataFrame([(20, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality_rules.kept(frame, none)
    assert kept.columns == frame.columns
    base = lambda t: (lambda n, *rest: n >= 50 and 100 * rest[-1] <= 50 * n)(*counted(t))
    assert sorted(str((r["doc_id"], r["text"], r["kept"])) for r in kept.collect()) == sorted(str((d, t, 3)) for d, t in texts if base(t))
    assert quality_rules.kept(frame.limit(0), none).collect() == []


def brute_list(cells, cuts, most_rules, most_tests, purity, least, most_tries):
    """The decision list cell by cell, as the docstring of ``learn`` has it."""
    import math

    tests = [(k, j, op) for k, f in enumerate(quality_rules.FEATURES) for j in range(len(cuts[f])) for op in (">", "<=")]
    meets = lambda c, own: all((c[0][k] > j) == (op == ">") for k, j, op in own)
    total = lambda own: (sum(c[2] for c in own), sum(c[3] for c in own))
    left, aside, rules = list(cells), [], []
    for _ in range(most_tries):
        here = [c for c in left if not c[1] and c not in aside]
        if len(rules) == most_rules or not total(here)[0]:
            break
        chosen = []
        while len(chosen) < most_tests and all(total(here)):
            b0, g0 = total(here)
            gains = []
            for t in tests:
                b, g = total([c for c in here if meets(c, [t])])
                gains.append(b * (math.log2(b / (b + g)) - math.log2(b0 / (b0 + g0))) if b >= least else -1)
            top = max(gains)
            if top <= 1e-9:
                break
            chosen.append(tests[next(i for i, x in enumerate(gains) if x >= top - 1e-12)])
            here = [c for c in here if meets(c, chosen[-1:])]
        if not chosen:
            break
        held = lambda own: total([c for c in left if c[1] and meets(c, own)])
        worth = lambda own: (lambda b, g: (b - g) / (b + g) if b + g else -1)(*held(own))
        while len(chosen) > 1:
            less = [[t for t in chosen if t != x] for x in chosen]
            best = max(less, key=worth)
            if worth(best) < worth(chosen):
                break
            chosen = best
        (b, g), (hb, hg) = total([c for c in left if meets(c, chosen)]), held(chosen)
        if b >= least and b >= purity * (b + g) and hb and hb >= purity * (hb + hg):
            rules.append((tuple((quality_rules.FEATURES[k], op, cuts[quality_rules.FEATURES[k]][j]) for k, j, op in chosen), b, g))
            left = [c for c in left if not meets(c, chosen)]
        else:
            aside += here
    return rules


def test_the_list_against_brute_force():
    draw, seen = random.Random(10), set()
    for trial in range(25):
        cuts = {f: [float(x) for x in range(draw.choice([0, 1, 2]))] for f in quality_rules.FEATURES}
        cells = {}
        for _ in range(60):
            place = tuple(draw.randint(0, len(cuts[f])) for f in quality_rules.FEATURES)
            bad = place[0] == len(cuts["symbols_per_word"]) and draw.random() < 0.9
            cells[place, draw.random() < 0.3] = (draw.randint(5, 40), draw.choice([0, 0, 1])) if bad else (draw.choice([0, 0, 9]), draw.randint(5, 60))
        cells = [(p, back, *n) for (p, back), n in cells.items()]
        for purity in (0.8, 0.99):
            got = quality_rules.cover(cells, cuts, 4, 3, purity, 10, 12)
            assert [(r.tests, r.bad, r.good) for r in got] == brute_list(sorted(cells), cuts, 4, 3, purity, 10, 12)
            seen.add(len(got))
    assert len(seen) > 2
