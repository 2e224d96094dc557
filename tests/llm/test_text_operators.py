"""Segmentations, token files, archives, licences, chat, vectors and URL filters against brute force, with odd inputs."""

import base64
import collections
import datetime
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentograph.llm import chat_format, licenses, pieces, token_files, url_filter, vector_search, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  two  spaces ", "line\n\nbreaks\n ", "▁ marks ▁▁ and\n▁one", "日本語 \U0001f600 é H̱x", "<|endoftext|> a<|startoftext|>b", "don't 'sup 3.14, etc. x²., a.b", "\x1c\x85   z", "İstanbul ΑΣ ﬁ ŉ", "x" * 3000, "a b " * 2000, "\r\n\t\x0b\x0c", "\x00 nul", "same", "same"]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(MODEL)


def segmentations(vocabulary, text, longest=pieces.LONG):
    """All of a text, by recursion, with their probabilities."""
    units, index, _ = pieces.cut_up(vocabulary, *pieces.units_of(pa.array([text]), vocabulary.marks), longest)
    body = [u[1:] if u[:1] == pieces.SPACE or (u[:1] == "\n" and len(u) > 1) else u for u in units]
    lattice = pieces.Lattice(vocabulary, body, [u[:1] == pieces.SPACE for u in units])
    out = {(): 1.0}
    for u in index:
        def ways(place):
            if not place:
                return [((), 1.0)]
            return [((int(lattice.run[e]), *rest), math.exp(lattice.log[e]) * p) for e in range(lattice.first[place], lattice.first[place + 1]) for rest, p in ways(lattice.to[e])]

        out = {a + b: p * q for a, p in out.items() for b, q in ways(lattice.start[u])}
    return out


def drawn(vocabulary, texts, k, start=0):
    with np.errstate(over="ignore"):
        return pieces.sample_part(vocabulary, pa.array(texts, pa.string()), (np.arange(len(texts)) + start).astype(np.uint64), k)


def test_lattice_has_the_chances_of_the_weights(vocabulary):
    found = segmentations(vocabulary, "cat")
    own = {vocabulary.names[i]: vocabulary.score[i] for i in vocabulary.ids}
    want = {}

    def walk(rest, done, weight):
        if not rest:
            want[done] = math.exp(weight)
        for n in range(1, len(rest) + 1):
            if rest[:n] in own:
                walk(rest[n:], (*done, rest[:n]), weight + own[rest[:n]])

    walk("▁cat", (), 0.0)
    total = sum(want.values())
    got = {tuple(vocabulary.names[vocabulary.ids[i]] for i in k): p for k, p in found.items()}
    assert got.keys() == want.keys()
    for k, p in got.items():
        assert p == pytest.approx(want[k] / total)


def test_samples_are_distinct_and_follow_the_model(vocabulary):
    text, n, k = "ab on", 6000, 3
    chance = segmentations(vocabulary, text)
    lattice, found, least = drawn(vocabulary, [text] * n, k)
    counts, estimate = [collections.Counter() for _ in range(k)], 0.0
    for own, low in zip(found, least):
        keys = [tuple(lattice.run[p.edges].tolist()) for p, _, _ in own]
        values = [v for _, _, v in own]
        assert len(set(keys)) == k and values == sorted(values, reverse=True) and values[-1] > low
        for c, key in zip(counts, keys):
            c[key] += 1
        estimate += sum(math.exp(log - pieces.inclusion(log, low)) * len(key) for key, (_, log, _) in zip(keys, own)) / n
    second = collections.Counter()
    for a, p in chance.items():
        for b, q in chance.items():
            if a != b:
                second[b] += p * q / (1 - p)
    for got, want in zip(counts, (chance, second)):
        for key, p in want.items():
            assert abs(got[key] - n * p) < 5 * math.sqrt(n * p * (1 - p) + 1)
    assert estimate == pytest.approx(sum(len(key) * p for key, p in chance.items()), rel=0.02)


def test_cutting_up_loses_nothing(vocabulary):
    for text in ("a日b本", "x4P+Q", "日本", " é\u0301Kq", "▁a▁", "a\n▁b", "q\n"):
        whole, cut = segmentations(vocabulary, text), segmentations(vocabulary, text, 1)
        assert whole.keys() == cut.keys() and all(cut[k] == pytest.approx(p) for k, p in whole.items())
    draw = random.Random(12)
    long = ["".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(60_000)), "".join(draw.choice("etaoin") for _ in range(20_000))]
    lattice, found, _ = drawn(vocabulary, long, 2)
    for text, own in zip(long, found):
        for path, _, _ in own:
            runs = lattice.run[path.edges]
            ids = [i for r in runs for i in lattice.run_ids[lattice.run_begin[r] : lattice.run_begin[r] + lattice.run_length[r]]]
            assert vocabulary.decode(ids) == text


def test_few_segmentations_come_all_of_them(vocabulary):
    _, found, least = drawn(vocabulary, ["ab", "", "日"], 9)
    assert [len(x) for x in found] == [len(segmentations(vocabulary, t)) for t in ("ab", "", "日")]
    assert set(least) == {-math.inf} and pieces.inclusion(-1.0, -math.inf) == 0.0


def test_sampling_restores_odd_texts(spark):
    frame = documents(spark, ODD).withColumn("rank", F.lit("clash")).withColumn("ids", F.lit(1))
    rows = pieces.sample(frame, MODEL, k=3, part=4000).collect()
    assert all(r["restores"] for r in rows)
    assert {r["doc_id"] for r in rows} == set(range(len(ODD)))
    for d, own in collections.defaultdict(list, {d: [r for r in rows if r["doc_id"] == d] for d in range(len(ODD))}).items():
        assert len({bytes(r["ids"]) for r in own}) == len(own) and sorted(r["rank"] for r in own) == list(range(1, len(own) + 1))
    other = {(r["doc_id"], r["rank"]): bytes(r["ids"]) for r in pieces.sample(frame.repartition(5), MODEL, k=3).collect()}
    assert other == {(r["doc_id"], r["rank"]): bytes(r["ids"]) for r in rows}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.sample(frame.select("doc_id", "text"), MODEL, k=1), MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert pieces.sample(documents(spark, []), MODEL).collect() == []


def test_encode_is_the_librarys(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in pieces.encode(documents(spark, ["the cat", None]), MODEL).collect():
        assert np.frombuffer(r["ids"], "<i4").tolist() == own.encode(r["text"] or "")


def test_word_encoder_is_the_tokenizer():
    encoder = token_files.WordEncoder(WORDS)
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("aAzéÉ'.,<|>s t\n\t3²́日-") for _ in range(60)) for _ in range(400)]
    flat, lengths = encoder.encode(pa.array(texts, pa.string()), end=2)
    at = 0
    for text, n in zip(texts, lengths.tolist()):
        assert flat[at : at + n].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at += n


def test_other_tokenizers_encode_whole_texts():
    encoder = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    flat, lengths = encoder.encode(pa.array(ODD, pa.string()), end=2)
    at = 0
    for text, n in zip(ODD, lengths.tolist()):
        assert flat[at : at + n].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at += n
    assert not encoder.by_word and token_files.WordEncoder(WORDS).by_word


def test_token_files(spark, tmp_path):
    rows = [(i * 7 % 31, t) for i, t in enumerate(ODD)] + [(None, "no key"), (3, "again"), (3, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("tokens", F.lit(1))
    folder = str(tmp_path / "t")
    parts = token_files.write_tokens(frame.repartition(3), folder, WORDS)
    assert sum(p["documents"] for p in parts) == len(rows) and [p["base"] for p in parts] == [sum(q["tokens"] for q in parts[:i]) for i in range(len(parts))]
    got = token_files.read_tokens(spark, folder, parts, {"ids_crc32": "long"}, token_files.checksum).orderBy("start").collect()
    tokenizer = token_files.WordEncoder(WORDS).tokenizer
    want = sorted(((k, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted(((r["key"], r["ids_crc32"]) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == want
    keys = [r["key"] for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    none = token_files.write_tokens(documents(spark, []), str(tmp_path / "none"), WORDS)
    assert none == [] and token_files.read_tokens(spark, folder, none, {"c": "long"}, token_files.checksum).collect() == []


def test_archives(spark, tmp_path):
    inner = warc.record(99, "http://x/", b"inner", "D", None, False)
    htmls = [None, "", "a", "a", "é" * 10, inner.decode(), (inner * 3).decode(), "WARC/1.1\r\n", "b" * 200_000, "a", "WARC/1.1\r\nContent-Length: 5\r\n\r\n12345\r\n\r\n" * 50]
    rows = [(i, None if i == 2 else f"http://h/ {i}\r\nX: y", h) for i, h in enumerate(htmls)] + [(None, "u", "null id"), (4, "u", "é" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("digest", F.lit(1))
    files = warc.write_archives(pages.repartition(2), str(tmp_path / "w"))
    assert sum(f["records"] for f in files) == len(rows)
    heads = {}
    for i, _, h in rows:
        if i is not None:
            heads[h or ""] = max(heads.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        head = heads.get(h or "")
        revisit = i is not None and i != head
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    for step in (64, 1000, 1 << 24):  # ranges that end within records, and whole files
        got = warc.read_archives(spark, files, step).collect()
        assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
        assert all(r["digest_ok"] for r in got)
    least = warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "l"), least=10**9)).collect()
    assert {r["record_type"] for r in least} == {"response"}
    cut = dict(files[0])
    data = open(cut["file"], "rb").read()
    open(cut["file"], "wb").write(data[:-10])
    cut["bytes"] = len(data) - 10
    assert warc.read_archives(spark, [cut], 500).count() == files[0]["records"] - 1
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), str(tmp_path / "n"))).collect() == []


def test_archives_of_other_versions_and_damaged_ones(spark, tmp_path):
    bodies = ["first", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "third", "fourth", "last"]
    parts = [warc.record(i, f"http://h/{i}", b.encode(), base64.b32encode(hashlib.sha1(b.encode()).digest()).decode(), None, False) for i, b in enumerate(bodies)]
    old = [b"WARC/1.0" + p[8:] for p in parts]

    def read(data, step, **more):
        path = tmp_path / f"{hashlib.md5(data).hexdigest()}.warc"
        path.write_bytes(data)
        return warc.read_archives(spark, [{"file": str(path), "bytes": len(data)}], step, **more)

    for step in (100, 1 << 20):
        for data in (b"".join(old), b"".join([parts[0], *old[1:3], *parts[3:]])):
            assert sorted((r["page_id"], r["payload_bytes"], r["digest_ok"]) for r in read(data, step).collect()) == [(i, len(b), True) for i, b in enumerate(bodies)]
        for broken, whole in ((parts[2].replace(b"WARC/1.1", b"WARC/2.1", 1), 2), (parts[2].replace(b"Content-Length", b"Content-Breadth"), 2), (b"noise" + parts[2], 2)):
            data = b"".join([*parts[:2], broken, *parts[3:]])
            rows = read(data, step, strict=False).collect()
            assert sorted(r["page_id"] for r in rows if r["record_type"] == "response") == list(range(whole))
            assert [(r["at"], r["digest_ok"]) for r in rows if r["record_type"] == "broken"] == [(len(parts[0]) + len(parts[1]), False)]
            with pytest.raises(Exception, match="no record at byte"):
                read(data, step).collect()
        with pytest.raises(Exception, match="no record at byte 0"):
            read(b"WARC/0.18\r\n" + parts[0], step).collect()
        for cut in (3, 15, len(parts[1]) - 5):  # within the magic, a header, a payload
            assert [r["page_id"] for r in read(parts[0] + parts[1][:cut], step).collect()] == [0]
        assert read(b"", step).collect() == []


def test_archives_with_long_headers(spark, tmp_path):
    urls = [f"data:,{'x' * 100_000}{i}" for i in range(3)] + ["http://h/"]
    bodies = ["first", "WARC/1.1\r\nX: " + "y" * 200_000, "WARC/1.1\r\nno colon\r\n" + "z" * 200_000, "last"]
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(zip(urls, bodies))], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(pages, str(tmp_path / "w"))
    data = b"".join(open(f["file"], "rb").read() for f in files)
    assert sorted(re.findall(rb"WARC-Target-URI: (.*)\r\n", data)) == sorted(u.encode() for u in urls)
    for step in (70_000, 1 << 24):
        rows = warc.read_archives(spark, files, step).collect()
        assert sorted((r["page_id"], r["payload_bytes"], r["digest_ok"]) for r in rows) == [(i, len(b), True) for i, b in enumerate(bodies)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_license_base_against_brute_force(spark):
    draw = random.Random(2)
    texts = [*ODD, "MIT license mit LICENSE.", "mit\nlicense, Apache-License; general public license", "İmit license mit éapache license"]
    texts += [" ".join(draw.choice(["mit", "license", "Apache", "general", "public", "é", "-", "x1"]) for _ in range(80)) for _ in range(60)]
    frame = documents(spark, texts).withColumn("score", F.lit("clash"))
    for r in licenses.scan(frame).collect():
        words, starts, labels = WORD.findall((texts[r["doc_id"]] or "").translate(LOW)), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            for i in range(len(words)):
                if words[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(documents(spark, [])).collect() == []


def test_license_templates_are_found_and_others_not(spark):
    label, text, _ = licenses.TEMPLATES[1]
    words = text.split()
    changed = " ".join(words[:10] + ["really"] + words[10:20] + words[21:])
    prose = "the license of the software may be used by any person for any purpose and the conditions of that are free " * 5
    texts = [f"junk words before {text} and after", changed, prose, " ".join(reversed(words)), "Licensed under CC BY-NC 4.0.", text.replace("granted", "given")]
    rows = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts + ["filler text here"] * 20)).collect()}
    assert rows[0]["labels"] == label and rows[0]["score"] == 1.0
    assert rows[1]["labels"] == label and 0.75 <= rows[1]["score"] < 1.0
    assert rows[2]["labels"] == rows[3]["labels"] == "" and rows[5]["labels"] == ""
    assert rows[4]["labels"] == "cc-by-nc" and rows[4]["base_labels"] == ""


def test_license_templates_do_not_compete(spark):
    draw = random.Random(6)
    long_text, short = licenses.TEMPLATES[1][1], "Licensed under CC BY-NC 4.0."
    every = [t for _, t, _ in licenses.TEMPLATES]
    words = [w for t in every for w in t.split()]
    filler = " ".join(draw.choice(words) for _ in range(40_000))
    texts = [f"{long_text} {'x ' * 300} {short}", " \n ".join(every), f"{filler} {short} {filler}"]
    for t in every * 3:  # words changed, and some put in
        own = [draw.choice(["x", w]) if draw.random() < 0.3 else w for w in t.split()]
        own[len(own) // 2 : len(own) // 2] = ["x"] * draw.randrange(8)
        texts.append(" ".join(draw.choices(words, k=9) + own + draw.choices(words, k=9)))
    common = [short] * 60  # so that the words of the longer text are rarer
    rows = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts + common)).collect()}
    assert set(rows[0]["labels"].split(",")) == {"mit", "cc-by-nc"}
    assert set(rows[1]["labels"].split(",")) == {label for label, _, _ in licenses.TEMPLATES} and rows[1]["score"] == 1.0
    assert "cc-by-nc" in rows[2]["labels"].split(",")
    slack = 2 * licenses.SLACK
    for d, text in list(enumerate(texts))[3:]:
        own, best = [w.encode() for w in WORD.findall(text.translate(LOW))], {}
        for label, template, keys in licenses.TEMPLATES:
            words, keys = licenses.words_of(template), [licenses.words_of(k) for k in keys]
            last, most, runs = None, -1, []
            for begin in range(-len(words) - slack, len(own) + slack):
                if any(own[p : p + len(k)] == k for k in keys for p in range(max(0, begin - slack), begin + len(words) + slack + 1)):
                    hits = sum(w in own[max(0, begin + q - slack) : max(0, begin + q + slack + 1)] for q, w in enumerate(words))
                    if hits >= licenses.ENOUGH * len(words):
                        right = sum(0 <= begin + q < len(own) and own[begin + q] == w for q, w in enumerate(words))
                        if last is None or begin > last + 1:
                            runs, most = [*runs, hits / len(words)], right
                        elif right > most:
                            runs[-1], most = hits / len(words), right
                        last = begin
            if runs:
                best[label] = max(best.get(label, 0), *runs)
        base = set(filter(None, rows[d]["base_labels"].split(",")))
        assert rows[d]["labels"] == ",".join(sorted({*best, *base})) and rows[d]["score"] == max([*best.values(), 0.5 if base else 0.0])


def limited(x):
    return max(-(2**63), min(2**63 - 1, x))


def brute_top(rows, every, k, scale=256, single=True):
    value = lambda x: float(np.float32(x)) if single else x
    good = [(i, [limited(math.floor(value(x) * scale)) if math.isfinite(value(x) * scale) else limited(2**64 if x > 0 else -(2**64)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        own = min(v for i, v in good if i == q)
        best = sorted((-limited(sum(a * b for a, b in zip(own, v))), i) for i, v in good if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def test_vector_search_under_changing_tasks(spark, tmp_path, monkeypatch):
    """Every row is in one shard for both searches, though files are dealt to other tasks in the second."""
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=12).astype(np.float32).tolist()) for i in range(400)]
    path = str(tmp_path / "vectors.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6).write.parquet(path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before, store = [spark.conf.get(n) for n in names], vector_search.stored

    def changed(df, name):
        out = store(df, name)
        for n in names:
            spark.conf.set(n, "1k" if spark.conf.get(n) != "1k" else "128m")
        return out

    monkeypatch.setattr(vector_search, "stored", changed)
    try:
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.top_k(spark.read.parquet(path), every=10, shard=50).collect())
    finally:
        for n, x in zip(names, before):
            spark.conf.set(n, x)
    assert got == brute_top(rows, 10, 5)


@pytest.mark.parametrize("shard", [16, 8192])
def test_vector_search(spark, shard):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 8) for i in range(30)] + [(500, [0.0] * 8), (510, [-1.0] * 8), (520, None), (530, [1.0, None]), (540, [float("nan")] * 8), (550, [float("inf")] * 8), (None, [9.0] * 8), (7, rows[7][1]), (560, [1.0]), (570, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("shard", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.top_k(frame, every=10, k=5, shard=shard, block=7).collect())
    assert got == brute_top(rows, 10, 5)
    few = spark.createDataFrame(rows[:3], frame.select("vec_id", "embedding").schema)
    assert len(vector_search.top_k(few, every=10).collect()) == 2
    assert vector_search.top_k(few.limit(0)).collect() == []
    with_copies = rows[:60] + [(1000 + i, [0.4] * 8) for i in range(60)] + [(2000, [0.3] * 8)] * 40  # a third alike
    copied = spark.createDataFrame(with_copies, frame.select("vec_id", "embedding").schema)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.top_k(copied, every=10, k=5, shard=shard, block=7).collect()) == brute_top(with_copies, 10, 5)
    wide = [(i, [draw.choice([1e30, -1e30, 1e308, 2.0**55, -3.5, 0.25, 1e17]) * draw.choice([1, 1, -1]) for _ in range(4)]) for i in range(40)]
    doubles = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.top_k(doubles, every=4, shard=shard).collect()) == brute_top(wide, 4, 5, single=False)
    large = [(i, [float(draw.randint(-(2**30), 2**30)) for _ in range(4)]) for i in range(20)]
    frame = spark.createDataFrame(large, "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.top_k(frame, every=5, scale=1.0).collect()) == brute_top(large, 5, 5, 1)


CONTROL = ["</s>[INST] ok [/INST]", "<s><s>", "\\", "\\\\<s>", "[ROLE x] [/ROLE]", "<</s>", "a\nb", " ", "[ASSISTANT]\\</s", "<", "é\U0001f600"]


def test_escaping_is_reversible_and_hides_control_strings():
    draw = random.Random(4)
    texts = CONTROL + ["".join(draw.choice([*chat_format.CONTROL, "\\", "<", "[", "s>", "]", " ", "x"]) for _ in range(12)) for _ in range(500)]
    for t in texts:
        assert chat_format.unescape(chat_format.escape(t)) == t
        assert not any(c in chat_format.escape(t) for c in chat_format.CONTROL)


def digest(turns):
    whole = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), whole, len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_chat(spark, tmp_path):
    draw = random.Random(5)
    convs = {i: [(draw.choice(["user", "assistant", "system", "tool]x", "", None]), draw.choice([*CONTROL, None, "", "x" * 300])) for _ in range(draw.choice([1, 2, 5, 60]))] for i in range(25)}
    convs[77] = [(draw.choice(["user", "assistant"]), f"turn {i}") for i in range(700)]
    rows = [(c, n, r, t) for c, turns in convs.items() for n, (r, t) in enumerate(turns)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows + [(None, 0, "user", "no id")], "conv_id long, turn int, role string, text string").withColumn("part", F.lit("clash"))
    folder = str(tmp_path / "c")
    portions = chat_format.format_conversations(frame.repartition(4), folder, window=6)
    got = {r["conv_id"]: r for r in chat_format.digests(portions, folder).collect()}
    for c, turns in [*convs.items(), (None, [("user", "no id")])]:
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(turns) and not r["rewrites"]
        assert r["formatted_chars"] == len(chat_format.render([(a or "", b or "") for a, b in turns]))
    none = chat_format.format_conversations(frame.limit(0), str(tmp_path / "n"))
    assert chat_format.digests(none, str(tmp_path / "n")).collect() == []


def test_templates_that_rewrite_history():
    turns = [("user", "hi"), ("assistant", "yes"), ("user", "more")]
    found = chat_format.spans(turns)
    assert "".join(s for s, _, _ in found) == chat_format.render(turns)
    assert [chat_format.unescape(s[a:b]) for s, a, b in found] == ["hi", "yes", "more"]

    def forgets(own):
        return "".join(f"<{r}>{t if r != 'assistant' or k == len(own) - 1 else '...'}\n" for k, (r, t) in enumerate(own))

    with pytest.raises(chat_format.Rewritten) as caught:
        chat_format.spans(turns, forgets)
    assert caught.value.turn == 2
    begins = lambda own: "<bos>" + chat_format.render(own)
    late = chat_format.spans(turns[1:], begins, turns[:1])
    assert [s[a:b] for s, a, b in late] == ["yes", "more"] and not late[0][0].startswith("<bos>")


def formatted(portions, folder):
    """The rendering of each conversation from its portions, and whether it is marked."""
    out, marked = collections.defaultdict(bytes), collections.defaultdict(bool)
    for r in sorted(portions.collect(), key=lambda r: (r["part"], r["nth"])):
        text, marks = (open(f"{folder}/{kind}-{r['part']:06d}.{end}", "rb").read() for kind, end in (("text", "txt"), ("turns", "bin")))
        at = r["at"]
        for k in range(r["first_turn"], r["first_turn"] + r["turns"]):
            whole, _, _, _, cut, *_ = struct.unpack_from(chat_format.MARK, marks, k * struct.calcsize(chat_format.MARK))
            out[r["conv_id"]] = out[r["conv_id"]][: len(out[r["conv_id"]]) - cut] + text[at : at + whole]
            at += whole
        marked[r["conv_id"]] |= r["rewrites"]
    return {c: x.decode() for c, x in out.items()}, marked


@pytest.mark.parametrize("parts", [1, 3, 12])
def test_chat_renders_whole_prefixes(spark, tmp_path, parts):
    convs = {1: 3, 2: 80, 3: 29, 4: 20, None: 2}
    rows = [(c, n, "assistant" if n % 2 else "user", f"é text {n} of {c}") for c, turns in convs.items() for n in range(turns)]
    rows += [(5, 0, "user", f"{draw:02d} of equal number") for draw in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    own = {c: [(r, t) for k, _, r, t in sorted(rows, key=lambda x: (x[0] or 0, *x[1:])) if k == c] for c in [*convs, 5]}

    def begins(turns):
        return "<bos>" + "".join(f"{k}:{r}:{t}\n" for k, (r, t) in enumerate(turns))

    def forgets(turns):
        return begins([(r, "..." if k == 1 and len(turns) > 30 else t) for k, (r, t) in enumerate(turns)])

    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, template, rewritten in (("b", begins, set()), ("f", forgets, {2, 5})):
            portions = chat_format.format_conversations(frame, str(tmp_path / name), template)
            assert parts == 1 or portions.select("part").distinct().count() > 1
            texts, marked = formatted(portions, str(tmp_path / name))
            assert texts == {c: template(turns) for c, turns in own.items()}
            assert {c for c, m in marked.items() if m} == rewritten
            for r in chat_format.digests(portions, str(tmp_path / name)).collect():
                assert r["n_turns"] == len(own[r["conv_id"]]) and r["formatted_chars"] == len(template(own[r["conv_id"]]))
                assert r["rewrites"] == (r["conv_id"] in rewritten) and r["turns_sha256"] == digest(own[r["conv_id"]])[1]
                assert (r["loss_chars"], r["loss_sha256"]) == ((0, digest([])[3]) if r["rewrites"] else digest(own[r["conv_id"]])[2:])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind", ["system first", "shouts"])
def test_chat_reads_back_any_template(spark, tmp_path, kind):
    """Roles and texts come back whatever the template does to them."""

    def template(turns):
        if kind == "shouts":
            return "".join(f"{r}:{t.strip().upper()}é\n" for r, t in turns)
        return "<<SYS>>é<</SYS>>" + "".join(f"«{r}» {t} é" for r, t in turns)

    draw = random.Random(11)
    convs = {c: [(draw.choice(["user", "assistant", "<s>[ROLE x] ", "", "é"]), draw.choice([*CONTROL, "", " spaced ", "\\x", "É" * 40])) for _ in range(draw.choice([1, 3, 25]))] for c in range(12)}
    frame = spark.createDataFrame([(c, n, r, t) for c, turns in convs.items() for n, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string").repartition(3)
    for name, most in (("all", None), ("few", 2)):
        portions = chat_format.format_conversations(frame, str(tmp_path / name), template, most=most)
        for r in chat_format.digests(portions, str(tmp_path / name)).collect():
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["rewrites"]) == (*digest(convs[r["conv_id"]]), False)
            assert r["formatted_chars"] == len(template(convs[r["conv_id"]]))


DAY = 86400


def at(day):
    return datetime.datetime.fromtimestamp(url_filter.START + day * DAY, datetime.timezone.utc).replace(tzinfo=None)


def test_url_filter_against_brute_force(spark):
    draw = random.Random(6)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "x"]
    urls = [f"{draw.choice(['http', 'HTTPS'])}://{draw.choice(['', 'u:p@'])}{draw.choice(hosts).upper() if draw.random() < 0.3 else draw.choice(hosts)}{draw.choice(['', ':80', '.'])}{draw.choice(['', '/', '/p', '/p/q?x=1', '/p//q#f'])}" for _ in range(80)]
    captures = [(i, u, at(draw.randint(0, 90))) for i, u in enumerate(urls)] + [(100, None, at(3)), (101, "nonsense", at(3)), (102, "http://example.com/", None), (0, urls[0], at(1)), (0, urls[0], at(1)), (None, urls[1], at(50))]
    patterns = [("host", h) for h in hosts] + [("domain", d) for d in ("example.com", "com", "org", "a.example.com")] + [("prefix", h + p) for h in hosts for p in ("/p", "/p/q")]
    entries = []
    for kind, p in patterns:
        for name, policy in (("l1", "block"), ("l2", "allow")):
            for _ in range(draw.choice([0, 1, 2, 4])):
                entries.append((name, policy, kind, p, draw.choice(["add", "add", "remove"]), at(draw.randint(0, 80))))
    entries += [("l1", "block", "host", None, "add", at(0)), ("l1", "block", "host", "x", "add", None), ("l1", "block", "host", "x", "odd", at(0)), *entries[:5]]

    def active(name, policy, kind, p, t):
        own = sorted({(e[5], e[4]) for e in entries if e[:4] == (name, policy, kind, p) and e[5] is not None and e[4] in ("add", "remove") and e[5] <= t})
        return bool(own) and own[-1][1] == "add"

    def verdict(u, t):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::\d+)?(/[^?#]*)?", u or "")
        if not m or t is None:
            return 0, "", "none"
        host = m[1].lower().rstrip(".")
        labels, steps = host.split("."), [s for s in (m[2] or "").split("/") if s]
        keys = [("host", host)] + [("domain", ".".join(labels[i:])) for i in range(len(labels))] + [("prefix", host + "/" + "/".join(steps[: i + 1])) for i in range(len(steps))]
        hits = [(name, policy, p) for kind, p in keys for name, policy in (("l1", "block"), ("l2", "allow")) if active(name, policy, kind, p, t)]
        return len(hits), ",".join(sorted({h[0] for h in hits})), max(hits, key=lambda h: (len(h[2]), h[1] == "allow"))[1] if hits else "none"

    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumn("kind", F.lit("clash")).withColumn("list", F.lit(1))
    listed = spark.createDataFrame(entries, "list string, policy string, kind string, pattern string, action string, at timestamp")
    got = sorted(str((r["page_id"], r["url"], r["n_hits"], r["lists"], r["verdict"])) for r in url_filter.evaluate(frame, listed).collect())
    assert got == sorted(str((i, u, *verdict(u, t))) for i, u, t in captures)
    assert got == sorted(str((r["page_id"], r["url"], r["n_hits"], r["lists"], r["verdict"])) for r in url_filter.evaluate(frame, listed, most_broadcast=0).collect())
    assert url_filter.evaluate(frame.limit(0), listed).collect() == []
    assert {r["verdict"] for r in url_filter.evaluate(frame, listed.limit(0)).collect()} == {"none"}


def test_windows_of_long_texts_change_nothing(spark):
    """A text that goes through in windows has the segmentations that it has as a whole, where no piece crosses a cut; all restore it."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 9)))
    prose = lambda n: "".join(draw.choice([" ", " ", "\n", "  ", ". ", ", "]) + word() for _ in range(n))
    same = [prose(900), "\n" * 500 + prose(300) + "\n\n\n", "é▁ ▁a\n▁b " * 300, "аб" * 900, "漢字" * 700 + prose(100), " " * 1500, "a.b,c" * 500]
    vocabulary = pieces.Pieces(MODEL)
    with np.errstate(over="ignore"):
        for nth, text in enumerate([*same, "x" * 3000, "▁" * 2500]):
            for k in (1, 2, 5):
                seed = np.uint64(12345 + k)
                long = pieces.LongText(vocabulary, text, seed, k, 1000)
                found, least = long.sample()
                assert len(long.parts) > 1 and all(w[3] for path, _, _ in found for w in path)
                ids = [b"".join(w[2] for w in path) for path, _, _ in found]
                assert len(set(ids)) == len(ids)
                if nth < len(same):
                    lattice, whole, bound = pieces.sample_part(vocabulary, pa.array([text]), np.array([seed]), k)
                    runs = lambda path: [(lattice.run_begin[x], lattice.run_length[x]) for x in lattice.run[path.edges].tolist()]  # noqa: B023, E731
                    assert ids == [np.array([i for b, n in runs(path) for i in lattice.run_ids[b : b + n].tolist()], "<i4").tobytes() for path, _, _ in whole[0]]
                    assert [x[1:] for x in found] == [pytest.approx(x[1:]) for x in whole[0]] and (least == bound[0] or least == pytest.approx(bound[0]))
    frame = spark.createDataFrame(list(enumerate(same[:3])), "doc_id long, text string")
    rows = lambda part: sorted((r["doc_id"], r["rank"], bytes(r["ids"]), r["n_pieces"], round(r["log_inclusion"], 6), r["restores"]) for r in pieces.sample(frame, MODEL, k=3, part=part).collect())
    assert rows(1000) == rows(pieces.PART)


def test_memory_does_not_follow_a_text(tmp_path):
    """Peak memory over that of the text and the ids, for 1, 4 and 20 MB."""
    import subprocess
    import sys

    code = f"""
import random, re, sys
import numpy as np
from sentograph.llm import pieces
draw = random.Random(3)
some = " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 9))) for _ in range(160_000))
text, own = (some + " ") * int(sys.argv[1]), pieces.Pieces({MODEL!r})
with np.errstate(over="ignore"):
    found, _ = pieces.LongText(own, text, np.uint64(5), 2, pieces.PART).sample()
peak = int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1])  # of this program alone; ru_maxrss also has that of the one that began it
print(peak // 1024, sum(len(w[2]) for path, _, _ in found for w in path) // 2**20, len(text) // 2**20)
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for times in (1, 4, 20):
        out = subprocess.run([sys.executable, "-c", code, str(times)], capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": os.pathsep.join([root, *sys.path])})
        assert out.returncode == 0, out.stderr
        peak, ids, length = map(int, out.stdout.split())
        assert peak < 300 + 2 * ids + 2 * length
