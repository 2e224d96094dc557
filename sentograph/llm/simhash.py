"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at ``RADIUS`` or fewer differing bits. The bits fall into three blocks, and two
linked fingerprints differ by at most ``RADIUS // 3`` = 1 bit in one of them. The anchors of a block are the words of
a covering code: the Hamming(15, 11) code on 15 bits and all values of the others, so that each value lies within
covering radius 1 of an anchor. Every fingerprint goes to its nearest anchor as a resident and to every anchor within
radius plus threshold, 1 + 1 = 2, as a visitor (14 or more of 2**17); of two linked fingerprints one visits the other at its home in
some block. Fingerprints are compared anchor by anchor, residents with visitors.

Fingerprints are the nodes, so groups of copies cost nothing. Groups of different fingerprints that all link are drawn together
over a representative of each anchor first, and the comparison after that keeps pairs of groups only. Anchors are a join key, and
adaptive execution splits the hot ones.

Defined results: a null or empty text has no words, fingerprint zero, and links like any other; texts of fewer words
than a shingle hash their whole sequence; repeated rows each get a result, and rows of one id with different texts are rows like
others; a null id is returned, links like others, and never names a component unless its group has no other; an empty table gives
an empty result; columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentograph.operators.graph import connected_components

from .shared import bounded_batches, stored, stored_texts

SHINGLE, SEED, RADIUS = 4, 42, 4
#: (first bit, bits) of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned number: the majority of the bits of its shingles' XXH64."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: n - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(64, np.int64), len(starts)
    stops = ends[shingle - 1 :].tolist()
    for at in range(0, total, 65536):  # a bounded part of a very long text
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprints as longs of the same 64 bits."""

    @F.pandas_udf(T.LongType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for part in parts:
            yield pd.Series(np.array([fingerprint(x) for x in part], "<u8").view("<i8"))

    return run(text)


def _masks(bits: int) -> list[list[int]]:
    """For each syndrome of the code part, the changes of at most two bits that lead to an anchor; the first leads to the nearest."""
    free = [0] + [1 << (CODE_BITS + k) for k in range(bits - CODE_BITS)]
    out = []
    for s in range(CODE_BITS + 1):
        one = 1 << (s - 1) if s else 0
        own = [one | x for x in free]
        if s:
            own += sorted({1 << (a - 1) | 1 << (b - 1) for a in range(1, CODE_BITS + 1) if (b := a ^ s) and a != b})
        else:
            own += [x | y for i, x in enumerate(free[1:]) for y in free[i + 2 :]]
        out.append(own)
    return out


#: Bits of the code part that each bit of the syndrome sums up.
CHECKS = [sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> k & 1) for k in range(4)]


def _anchors(fp: Column, most: int | None) -> Column:
    """The keys (block and anchor in one long) of the anchors that a fingerprint goes to; most=1: its home in each block."""
    keys = []
    for j, (first, bits) in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))
        syndrome = F.lit(0)
        for k, check in enumerate(CHECKS):
            syndrome = syndrome + F.bit_count(value.bitwiseAND(F.lit(check))).bitwiseAND(F.lit(1)) * (1 << k)
        table = F.array(*[F.array(*[F.lit(x).cast("long") for x in own[:most]]) for own in _masks(bits)])
        keys.append(F.transform(F.element_at(table, syndrome + 1), _moved(value, j << 40)))
    return F.concat(*keys)


def _moved(value: Column, base: int):
    return lambda mask: value.bitwiseXOR(mask) + F.lit(base)


def _at_home(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode(_anchors(F.col("fp"), 1)).alias("anchor"), "fp", "root")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def first_links(nodes: DataFrame) -> DataFrame:
    """(src, dst) links of the fingerprints of an anchor to its smallest and its largest resident: few, and enough to draw a dense group together.

    Only anchors with several residents have representatives. There are 2**19 anchors, so these are at most that many rows of three longs (some 25 MB) and are broadcast."""
    home = _at_home(nodes)
    chosen = home.groupBy(F.col("anchor").alias("a")).agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    # The condition is the join's own, and only links are made rows.
    low, high = (_near(F.col("fp"), F.col(c)) & (F.col("fp") != F.col(c)) for c in ("low", "high"))
    pairs = home.join(F.broadcast(chosen), [F.col("anchor") == F.col("a"), low | high])
    linked = F.filter(F.array(F.when(low, F.col("low")), F.when(high, F.col("high"))), lambda x: x.isNotNull())
    return pairs.select(F.col("fp").alias("src"), F.explode(linked).alias("dst"))


def links(nodes: DataFrame) -> DataFrame:
    """(src, dst) pairs of roots, src < dst, once each, that a link joins. nodes: (fp, root), a row for each fingerprint; root is its group so far.

    Pairs are made distinct before they are shuffled, so what leaves a task grows with the groups that it joins, not with the links."""
    home = _at_home(nodes).select(F.col("anchor").alias("a"), F.col("fp").alias("home_fp"), F.col("root").alias("home_root"))
    guest = nodes.select(F.explode(_anchors(F.col("fp"), None)).alias("anchor"), "fp", "root")
    found = guest.join(home, [F.col("anchor") == F.col("a"), _near(F.col("fp"), F.col("home_fp")), F.col("root") < F.col("home_root")])
    return found.select(F.col("root").alias("src"), F.col("home_root").alias("dst")).distinct()


def merged(nodes: DataFrame, edges: DataFrame, store) -> DataFrame:
    """The nodes with their roots joined by links between them."""
    found = connected_components(edges, lambda df: store(df, "components"))
    return nodes.join(found, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("component", "root").alias("root"))


def groups(fingerprinted: DataFrame, store) -> DataFrame:
    """(fp, root) of each fingerprint: root is the same for all that are reachable over links.

    Dense groups are drawn together over their representatives first; then only links between different groups are left."""
    nodes = store(fingerprinted.select("fp").distinct().select("fp", F.col("fp").alias("root")), "distinct")
    nodes = store(merged(nodes, first_links(nodes), store), "drawn")
    return store(merged(nodes, links(nodes), store), "groups")


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id", store=stored) -> DataFrame:
    """(key, fp, component_id) for each document: fp as a long, component_id the smallest key reachable over links."""
    bounded_batches(documents.sparkSession)
    marked = store(documents.select(F.col(key).alias("__key"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    found = groups(marked, store)
    least = marked.groupBy("fp").agg(F.min("__key").alias("least")).join(found, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    known = found.join(named, "root").select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(known, marked.fp == F.col("__fp")).select(F.col("__key").alias(key), "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Up to so many numbers (8 bytes each) of rows to leave out are broadcast; more are joined by shuffle.
MOST_BROADCAST = 500_000


def one_of_each(documents: DataFrame, text: str = "text", key: str = "doc_id", store=stored, most_broadcast: int = MOST_BROADCAST, store_texts=stored_texts) -> DataFrame:
    """One row of each group, with all columns: that with the smallest key, and of several the one with the smallest fingerprint
    and then the first. Rows without a key come after all others.

    The rows are written once with fingerprint and number, so each is judged by itself, whatever its key."""
    bounded_batches(documents.sparkSession)
    marked = store_texts(documents.select(F.struct("*").alias("row"), F.col(key).alias("key"), fingerprints(F.col(text)).alias("fp"), F.monotonically_increasing_id().alias("number")), "fingerprints")
    narrow = marked.select("key", "fp", "number")
    rank = F.struct(F.col("key").isNull(), "key", "fp", "number")
    # First by fingerprint, so that copies are one row before they meet their group.
    best = narrow.groupBy("fp").agg(F.min(rank).alias("best")).join(groups(marked, store), "fp").groupBy("root").agg(F.min("best").alias("best"))
    gone = store(narrow.join(best.select(F.col("best.number").alias("stays")), F.col("number") == F.col("stays"), "left_anti").select(F.col("number").alias("__gone")), "gone")
    gone = F.broadcast(gone) if gone.count() <= most_broadcast else gone.hint("merge")
    return marked.join(gone, F.col("number") == F.col("__gone"), "left_anti").select("row.*")
