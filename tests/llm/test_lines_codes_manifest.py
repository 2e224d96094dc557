"""Line deduplication, vector codes and the Merkle manifest against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentograph.llm import line_dedup, merkle, vector_codes

SPACE, LOW = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, least=10, shared=2):
    """(id, kept text, lines, dropped) of (id, text) rows."""
    key = lambda line: line.strip(SPACE).translate(LOW)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        gone = lambda x: len(key(x)) >= least and len(holders[key(x)]) >= shared and i != min(holders[key(x)], key=lambda d: (d is None, d or 0))
        kept = [x for x in own if not gone(x)]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return out


def test_lines(spark):
    draw = random.Random(1)
    common = ["A common line of text", "  a COMMON line of text\t\r", "É common line of text", "short one", "\x0b0123456789\x0c", "0123456789", "", "   ", "ÀÀÀÀÀÀÀÀÀÀ"]
    texts = ["\n".join(draw.choice([*common, f"own line {draw.random()}", *common]) for _ in range(draw.randint(0, 9))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, texts[5]), (None, common[0]), (None, texts[1] + "\nof no document else"), (None, None), (70, None), (71, ""), (72, "\n\n"), (73, "one text\n" * 3000 + common[0])]
    rows += [(80, "the same row of text\nand more of it")] * 50 + [(79, "the same row of text")]
    frame = spark.createDataFrame([(i, t, "x", 5, "row", len(t or "")) for i, t in rows], "doc_id long, text string, kept_text string, mark int, doc string, n_lines int")
    for shared in (2, 3):
        found = line_dedup.dedup(frame, shared=shared)
        assert found.columns == ["doc_id", "text", "mark", "doc", "kept_text", "n_lines", "n_dropped"]
        got = [(r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in found.collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows, shared=shared)))
    assert line_dedup.dedup(frame.limit(0)).collect() == []


def brute_codes(rows, parts, entries, rounds):
    """(id, code, error) of (id, label, whole vector) rows, and the codebooks."""
    width = max(1, -(-max(len(v) for _, _, v in rows) // parts))
    rows = [(i, n, [*v, *[0] * (width * parts - len(v))]) for i, n, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))]
    cut = lambda v, p: v[p * width : p * width + width]
    books = [[cut(v, p) for _, _, v in rows[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = collections.defaultdict(list)
            for _, _, v in rows:
                own[near(cut(v, p), book)[1]].append(cut(v, p))
            for k, xs in own.items():
                book[k] = [sum(x) // len(xs) for x in zip(*xs)]
    last = [(i, n, [near(cut(v, p), books[p]) for p in range(parts)]) for i, n, v in rows]
    most = 2**63 - 1
    coded = [(i, n, "".join(f"{k:02x}" for _, k in c), min(most, sum(d for d, _ in c))) for i, n, c in last]
    total = collections.Counter()
    for _, n, _, e in coded:
        total[n] += e
    return [(i, c, e, min(most, total[n])) for i, n, c, e in coded], books


@pytest.mark.parametrize("few", [0, 100_000])
def test_codes(spark, few, monkeypatch):
    """Ties, few values, repeated rows and ids, null ids and labels, short and unusable vectors, far outliers."""
    monkeypatch.setattr(vector_codes, "FEW", few)
    draw = np.random.default_rng(few)
    rows = [(int(i) if i % 11 else None, int(i) % 5 if i % 7 else None, (draw.integers(-3, 4, 12) / 2).tolist()) for i in range(150)]
    rows += [(3, 1, [1.0] * 12)] * 40 + [(500 + i, 2, draw.normal(size=12 if i % 2 else 7).tolist()) for i in range(80)] + [(700, 3, [1000.0, -2000.0] * 6), (701, None, [])]
    bad = [(800, 1, None), (801, 1, [1.0, None]), (802, 1, [float("nan")] * 12), (803, 1, [float("inf")] * 12)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, label int, embedding array<double>, v string").repartition(3)
    whole = [(i, n, [int(np.floor(8 * x)) for x in v]) for i, n, v in rows]
    for parts, entries, rounds in ((4, 16, 2), (3, 256, 4), (5, 1, 1)):
        found, books = vector_codes.compress(frame, parts=parts, entries=entries, rounds=rounds, scale=8.0)
        want, brute = brute_codes(whole, parts, entries, rounds)
        got = found.collect()
        assert sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"])) for r in got) == sorted(map(str, want))
        assert books.entries.tolist() == brute
        if entries == 16:
            assert np.mean([r["checked"] for r in got]) < parts * entries / 2  # bounds spare most distances
    assert vector_codes.compress(frame.limit(0))[0].collect() == [] and vector_codes.compress(frame.where("vec_id >= 800"))[1] is None


def test_codes_of_any_size(spark):
    """Components up to the ends of 64 bits, whose squares and sums leave it."""
    rows = [(i, 0, [x, -x, 3.0, float(i)]) for i, x in enumerate([1e30, -1e30, 9e18, 1.5e10, -4e9, 7.0, 6.0, 1e30, 9e18])]
    clip = lambda x: int(min(max(x, -(2.0**63)), 2.0**63 - 1024)) if abs(x) < 2**63 else (2**63 - 1 if x > 0 else -(2**63))
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found, books = vector_codes.compress(frame, parts=2, entries=3, rounds=3, scale=1.0)
    want, brute = brute_codes([(i, n, [clip(x) for x in v]) for i, n, v in rows], 2, 3, 3)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found.collect()) == sorted(want)
    assert books.entries.tolist() == brute


def test_bounds_never_err():
    """Bounds hold, also after moves; entries that tie go by index."""
    draw = np.random.default_rng(9)
    for case in range(30):
        x = draw.integers(-20, 20, (200, 3)) * (1 if case % 3 else 100_000)
        entries = draw.integers(-20, 20, (8, 3)) * (1 if case % 3 else 100_000)
        before = vector_codes.assign(x, entries)
        moved = entries + draw.integers(-3, 4, entries.shape)
        shift = vector_codes.upper_bound(((moved - entries) ** 2).sum(1))
        after = vector_codes.reassign(x, moved, before, shift)
        exact = vector_codes.squares(x, moved)
        assert (after.code == exact.argmin(1)).all()
        root = vector_codes.UNIT * np.sqrt(exact)
        own = root[np.arange(len(x)), after.code]
        assert (after.lower <= root).all() and ((after.upper >= own) | (after.upper == vector_codes.UNKNOWN)).all()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def climb(nodes, fan=16):
    """The root, and the path of each node: a list of (left, right) by level."""
    level, paths, where = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        for path, at in zip(paths, where):
            lo = at // fan * fan
            path.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + fan])))
        level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
        where = [at // fan for at in where]
    return level[0], paths


def brute_manifest(rows):
    """(id, leaf, subroot, root, proof, folded) of (id, source, lang, n_chars, text) rows."""
    groups = collections.defaultdict(list)
    for r in rows:
        low = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        groups[r[1]].append((r[0] is not None, r[0] or 0, brute_leaf(r), brute_leaf((*r[:4], r[4].translate(LOW))) if low else brute_leaf(r), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:4])]) for s in names}
    root, outer = climb([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, outer):
        for (_, _, leaf, other, i), path in zip(sorted(groups[s], key=lambda x: x[:4]), trees[s][1]):
            fold = other
            for a, b in (*path, *above):
                fold = h(a, fold, b)
            out.append((i, leaf, trees[s][0], root, h(*[a + b for a, b in (*path, *above)]), fold))
    return out


def found_manifest(frame):
    lower = F.translate("text", line_dedup.UPPER, line_dedup.UPPER.lower())
    rows = merkle.manifest(frame, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": lower}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in rows.collect()]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at int, h string"


@pytest.mark.parametrize("few", [0, 50_000])
def test_manifest(spark, few, monkeypatch):
    """Trees of every height up to four, of whole and broken runs; odd names; null columns; repeated rows and ids."""
    monkeypatch.setattr(merkle, "FEW", few)
    rows = [(i, f"size {n}", "en", i, f"Text {i}") for n in (1, 2, 15, 16, 17, 256, 257, 4097) for i in range(n)]
    rows += [(i % 7, None, None, None, None) for i in range(30)] + [(None, "", "en", 1, "No Id"), (None, "é", None, 0, ""), (5, "￮", "en", 2, "A:b-"), (5, "\U00010000", "en", 2, "A"), (5, "z" * 300, "en", 2, "A")]
    rows += [(20, "size 16", "en", 20, "Again")] * 40 + [(20, "size 16", "en", 20, "again")] * 3
    frame = spark.createDataFrame([(*r, "t", 0, "h") for r in rows], SCHEMA).repartition(5)
    got = found_manifest(frame)
    want = brute_manifest(rows)
    assert len({w[3] for w in want} | {g[3] for g in got}) == 1
    # Copies of a row are alike, so each has a proof of one of their places; within a place all agrees.
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(g[5] != g[3] for g in got) and any(g[5] == g[3] for g in got)


def test_manifest_of_many_groups(spark):
    rows = [(i, f"source {i % 600}", "en", i, f"Text {i}") for i in range(900)]
    assert sorted(map(str, found_manifest(spark.createDataFrame([(*r, "t", 0, "h") for r in rows], SCHEMA)))) == sorted(map(str, brute_manifest(rows)))
    one = [(3, "s", "en", 1, "Only")]
    assert found_manifest(spark.createDataFrame([(*r, "t", 0, "h") for r in one], SCHEMA)) == brute_manifest(one)
    assert found_manifest(spark.createDataFrame([], SCHEMA)) == []
