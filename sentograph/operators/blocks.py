"""Blocks (biconnected components) and articulation points of a graph of any size, as joins.

A spanning forest comes from contracting the graph over least edges. Its Euler tours are ranked by pointer jumping, which gives each node its place in preorder and
the size of its subtree, so a subtree is a range. What each range reaches over other edges is the least and greatest of a range, from tables of
doubled widths. Two tree edges are in one block if an edge closes a cycle over both; blocks are the components of that relation. Rounds grow with
the logarithm of the nodes, whatever the shape; no task holds a component. Nodes that hang on a single other one are taken off before all that.

Of many small graphs, keyed by group, each is searched in a task as its rows pass (``cut_down``, ``count_points``); the caller leaves groups of more than ``SMALL`` rows to the joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import order
from .graph import connected_components, cut

Store = Callable[[DataFrame], DataFrame]

#: Rows of a group that a task may hold.
SMALL = 10_000
#: Rows of an Arrow batch.
BATCH = 10_000


def _numbered(edges: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """((node, v) with numbers from 0, and the pairs (u, v) with u < v)."""
    pair = edges.select("src", "dst").where("src <> dst")
    ends = pair.select(F.col("src").alias("node")).union(pair.select("dst")).distinct().withColumn("one", F.lit(1))
    number = store(order.running(ends, "node", {"v": "one"}).select("node", F.col("v").cast("long").alias("v")))
    to = lambda name: number.select(F.col("node").alias(f"n_{name}"), F.col("v").alias(name))
    both = pair.join(to("a"), F.col("src") == F.col("n_a")).join(to("b"), F.col("dst") == F.col("n_b"))
    return number, store(both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def spanning_forest(pairs: DataFrame, store: Store = cut) -> tuple[DataFrame, DataFrame]:
    """((u, v) of a spanning forest, (v, root) of all nodes) of pairs (u, v) of numbers.

    Each part takes its least edge to another part; the parts that these join become one."""
    live = pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("u", "v").alias("e"))
    ends = pairs.select(F.col("u").alias("v")).union(pairs.select("v")).distinct()
    home, tree = store(ends.withColumn("root", F.col("v"))), None
    while not live.isEmpty():
        ways = live.union(live.select("b", "a", "e"))
        least = store(ways.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select(F.col("a").alias("part"), F.col("m.b").alias("up"), F.col("m.e").alias("e")))
        tree = least.select("e.*") if tree is None else tree.union(least.select("e.*"))
        back = least.select(F.col("part").alias("p"), F.col("up").alias("q"))
        # Two parts that chose one edge: the smaller is the root.
        mutual = (F.col("q") == F.col("part")) & (F.col("part") < F.col("up"))
        up = store(least.join(back, F.col("up") == F.col("p")).select("part", F.when(mutual, F.col("part")).otherwise(F.col("up")).alias("up")))
        while True:
            above = up.select(F.col("part").alias("p"), F.col("up").alias("next"))
            jumped = store(up.join(above, F.col("up") == F.col("p")).select("part", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
            up = jumped.select("part", "up")
            if jumped.where("moved").isEmpty():
                break
        to = lambda name: up.select(F.col("part").alias(f"p_{name}"), F.col("up").alias(f"r_{name}"))  # noqa: B023, E731
        home = store(home.join(to("h"), F.col("root") == F.col("p_h"), "left").select("v", F.coalesce("r_h", "root").alias("root")))
        both = live.join(to("a"), F.col("a") == F.col("p_a")).join(to("b"), F.col("b") == F.col("p_b")).where("r_a <> r_b")
        live = store(both.groupBy(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).agg(F.min("e").alias("e")))
    tree = pairs.limit(0) if tree is None else store(tree.distinct())
    return tree, home


def preorder(tree: DataFrame, home: DataFrame, store: Store = cut) -> DataFrame:
    """(v, parent, pre, size) of all nodes of a forest: pre from 0 over all trees, size of the subtree; a root has no parent.

    An arc's successor on the tour of a tree is the one after its twin around their node; arcs are ranked by jumping over ever more of them."""
    arcs = tree.select(F.col("u").alias("tail"), F.col("v").alias("head")).union(tree.select(F.col("v").alias("tail"), F.col("u").alias("head")))
    placed = store(order.running(arcs.select(F.struct("tail", "head").alias("o"), F.lit(1).alias("one")), "o", {"p": "one"}).select("o.*", F.col("p").cast("long").alias("p")))
    ring = placed.groupBy(F.col("tail").alias("at")).agg(F.min("p").alias("first"), F.max("p").alias("last"))
    twin = placed.join(ring, F.col("tail") == F.col("at")).select(F.col("head").alias("t"), F.col("tail").alias("h"), F.when(F.col("p") == F.col("last"), F.col("first")).otherwise(F.col("p") + 1).alias("next"))
    begin = placed.join(home, F.col("tail") == F.col("root")).where("v = root").groupBy(F.col("root").alias("of")).agg(F.min("p").alias("begin"))
    linked = placed.join(twin, (F.col("tail") == F.col("t")) & (F.col("head") == F.col("h"))).join(home, F.col("tail") == F.col("v")).join(begin, F.col("root") == F.col("of"))
    # The arc before a tour's first one is its last.
    walk = store(linked.select("p", "tail", "head", "root", F.when(F.col("next") != F.col("begin"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("d")))
    arc = walk.select("p", "tail", "head", "root")
    ranks = walk.select("p", "next", "d")
    while not ranks.where("next is not null").isEmpty():
        ahead = ranks.select(F.col("p").alias("q"), F.col("next").alias("after"), F.col("d").alias("more"))
        ranks = store(ranks.join(ahead, F.col("next") == F.col("q"), "left").select("p", F.col("after").alias("next"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")))
    # d counts the arcs from an arc to the tour's end, so of an edge's two arcs the one down has the larger.
    ranked = arc.join(ranks.select("p", "d"), "p")
    up = ranked.select(F.col("tail").alias("t"), F.col("head").alias("h"), F.col("d").alias("back"))
    down = ranked.join(up, (F.col("tail") == F.col("h")) & (F.col("head") == F.col("t"))).where("d > back")
    nodes = down.select(F.col("head").alias("v"), F.col("tail").alias("parent"), "root", (-F.col("d")).alias("at"), F.floor((F.col("d") - F.col("back") + 1) / 2).alias("size"))
    whole = home.groupBy("root").agg(F.count(F.lit(1)).alias("size")).select(F.col("root").alias("v"), F.lit(None).cast("long").alias("parent"), "root", F.lit(-(2**62)).cast("long").alias("at"), "size")
    rows = store(nodes.union(whole).select("v", "parent", "size", F.struct("root", "at").alias("o"), F.lit(1).alias("one")))
    return store(order.running(rows, "o", {"pre": "one"}).select("v", "parent", F.col("pre").cast("long").alias("pre"), "size"))


def reaches(nodes: DataFrame, store: Store = cut) -> DataFrame:
    """(pre, low, high): the least lo and the greatest hi of the range of each node's subtree, from (pre, size, lo, hi) of all nodes.

    A range is two ranges of a power of two, which may overlap; a table of all ranges of one width gives that of the doubled width."""
    power = F.floor(F.log2(F.col("size").cast("double")) + 1e-9).cast("int")
    asked = store(nodes.select("pre", "size", power.alias("k")))
    most = asked.agg(F.max("k")).first()[0]
    level, out = nodes.select(F.col("pre").alias("i"), "lo", "hi"), None
    for k in range(0 if most is None else most + 1):
        other = lambda name: level.select(F.col("i").alias(f"i_{name}"), F.col("lo").alias(f"lo_{name}"), F.col("hi").alias(f"hi_{name}"))  # noqa: B023, E731
        own = asked.where(F.col("k") == k).join(other("a"), F.col("pre") == F.col("i_a")).join(other("b"), F.col("pre") + F.col("size") - 2**k == F.col("i_b"))
        found = store(own.select("pre", F.least("lo_a", "lo_b").alias("low"), F.greatest("hi_a", "hi_b").alias("high")))
        out = found if out is None else out.union(found)
        if k < most:
            pair = level.join(other("c"), F.col("i") + 2**k == F.col("i_c"))  # ranges over the end are in no subtree
            level = store(pair.select("i", F.least("lo", "lo_c").alias("lo"), F.greatest("hi", "hi_c").alias("hi")))
    return out if out is not None else nodes.select("pre", F.col("lo").alias("low"), F.col("hi").alias("high"))


def leaves_off(edges: DataFrame, store: Store = cut) -> tuple[list[DataFrame], DataFrame]:
    """((node, block, top) tables of nodes with a single neighbour, a block below 0 each, and the edges (src, dst) that are left).

    Without them others may be left with a single neighbour; rounds go on while one takes a fifth of the edges, so they grow with the logarithm of those."""
    rest, off = edges.select("src", "dst").where("src <> dst"), []
    while True:
        alone = rest.union(rest.select("dst", "src")).groupBy(F.col("src").alias("leaf")).agg(F.min("dst").alias("top"), F.max("dst").alias("most")).where("top = most")
        # Of two that have only one another, the smaller stays.
        once = alone.groupBy(F.least("leaf", "top").alias("a"), F.greatest("leaf", "top").alias("b")).agg(F.max("leaf").alias("node"))
        number = -1 - len(off) - 64 * F.monotonically_increasing_id()
        gone = store(once.select("node", number.alias("block"), F.when(F.col("node") == F.col("b"), F.col("a")).otherwise(F.col("b")).alias("top")))
        ends = gone.select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b"))
        rest = store(rest.join(ends, (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left_anti"))
        off.append(gone)
        left = rest.count()
        if not left or gone.count() * 4 < left or len(off) == 64:
            return off, rest


def block_tree(edges: DataFrame, store: Store = cut) -> DataFrame:
    """(node, block, top) of every node that isn't a root: the block over it, a number, and that block's node next to the root.

    So a block has its top and the nodes that name it; every edge (src, dst) is in one block, and the blocks of a component are a tree."""
    off, rest = leaves_off(edges, store)
    hanging = reduce(DataFrame.union, off)
    return hanging if rest.isEmpty() else store(hanging.union(_core_tree(rest, store)))


def _core_tree(edges: DataFrame, store: Store) -> DataFrame:
    """The rows of ``block_tree`` by a spanning forest."""
    number, pairs = _numbered(edges, store)
    tree, home = spanning_forest(pairs, store)
    nodes = preorder(tree, home, store)
    at = lambda name: nodes.select(F.col("v").alias(f"v_{name}"), F.col("pre").alias(f"pre_{name}"), F.col("size").alias(f"size_{name}"), F.col("parent").alias(f"parent_{name}"))
    placed = pairs.join(at("a"), F.col("u") == F.col("v_a")).join(at("b"), F.col("v") == F.col("v_b"))
    rest = store(placed.where("not (parent_a <=> v_b) and not (parent_b <=> v_a)").select("pre_a", "size_a", "pre_b", "size_b"))
    ends = rest.select(F.col("pre_a").alias("x"), F.col("pre_b").alias("y")).union(rest.select("pre_b", "pre_a")).groupBy("x").agg(F.min("y").alias("l"), F.max("y").alias("h"))
    local = nodes.join(ends, F.col("pre") == F.col("x"), "left").select("pre", "size", F.least("pre", "l").alias("lo"), F.greatest("pre", "h").alias("hi"))
    reach = reaches(store(local), store)
    known = nodes.join(reach, "pre")
    child = store(known.where("parent is not null").join(at("p"), F.col("parent") == F.col("v_p")).select("v", "pre", "low", "high", "parent", "pre_p", "size_p", "parent_p"))
    over = child.where("parent_p is not null and (low < pre_p or high >= pre_p + size_p)").select(F.col("pre").alias("src"), F.col("pre_p").alias("dst"))
    across = rest.where("pre_a + size_a <= pre_b or pre_b + size_b <= pre_a").select(F.col("pre_a").alias("src"), F.col("pre_b").alias("dst"))
    joined = connected_components(over.union(across), store)
    own = child.join(joined, F.col("pre") == F.col("node"), "left").select("v", "pre", "parent", F.coalesce("component", "pre").alias("block"))
    # A block is named by its first tree edge in preorder, whose parent is the top.
    tops = own.where("pre = block").select(F.col("block").alias("b"), F.col("parent").alias("t"))
    name = lambda n: number.select(F.col("node").alias(n), F.col("v").alias(f"v_{n}"))
    found = own.join(tops, F.col("block") == F.col("b")).join(name("node"), F.col("v") == F.col("v_node")).join(name("top"), F.col("t") == F.col("v_top"))
    return found.select("node", F.col("block").cast("long").alias("block"), "top")


def memberships(tree: DataFrame) -> DataFrame:
    """(node, block) of all nodes of each block, from the tree of blocks."""
    return tree.select("node", "block").union(tree.select("top", "block").distinct())


def articulation_points(tree: DataFrame) -> DataFrame:
    """(node): nodes of several blocks, without which their component falls apart."""
    return memberships(tree).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")


def depths(tree: DataFrame, store: Store = cut) -> DataFrame:
    """(x, up, depth) of the tree of blocks: x is "node:..." or "block:...", a node's up is its block, a block's its top; depth of roots 0."""
    node, block, top = (F.concat(F.lit(kind), F.col(c).cast("string")) for kind, c in (("node:", "node"), ("block:", "block"), ("node:", "top")))
    links = store(tree.select(node.alias("x"), block.alias("up")).union(tree.select(block.alias("x"), top.alias("up")).distinct()))
    jumps = links.select("x", F.col("up").alias("to"), F.lit(1).cast("long").alias("d"))
    while True:
        ahead = jumps.select(F.col("x").alias("y"), F.col("to").alias("after"), F.col("d").alias("more"))
        jumped = store(jumps.join(ahead, F.col("to") == F.col("y"), "left").select("x", F.coalesce("after", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("after").isNotNull().alias("moved")))
        jumps = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    known = links.join(jumps.select("x", F.col("d").alias("depth")), "x")
    roots = known.select("up").join(known.select(F.col("x").alias("y")), F.col("up") == F.col("y"), "left_anti").distinct()
    return store(known.union(roots.select(F.col("up").alias("x"), F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("depth"))))


def between(ends: DataFrame, places: DataFrame, store: Store = cut) -> tuple[DataFrame, DataFrame]:
    """((key, x, up) of the tree of blocks between a key's ends, (key, x) of all that lies on it): ends (key, x) of one component each key, places as ``depths`` gives them.

    The deepest step up together, those of a key that meet as one, until one is left."""
    front = store(ends.select("key", "x").distinct().join(places, "x").select("key", "x", "depth"))
    seen, links = front.select("key", "x"), None
    while True:
        stats = front.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest")).where("n > 1")
        both = store(front.join(stats.drop("n"), "key", "left"))
        moving = both.where("depth = deepest").select("key", "x").join(places.select("x", "up"), "x")
        step = store(moving.select("key", "x", "up"))
        if step.isEmpty():
            break
        links = step if links is None else links.union(step)
        reached = step.select("key", F.col("up").alias("x")).distinct().join(places.select("x", "depth"), "x").select("key", "x", "depth")
        front = store(both.where("deepest is null or depth < deepest").select("key", "x", "depth").union(reached).distinct())
        seen = seen.union(reached.select("key", "x"))
    return (store(links) if links is not None else seen.select("key", "x", F.col("x").alias("up")).limit(0)), store(seen.distinct())


def small_tree(edges: Iterable[tuple]) -> list[tuple]:
    """The rows of ``block_tree`` for a graph that a task holds, by depth-first search."""
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    at, low, out, block = {}, {}, [], 0
    for root in near:
        if root in at:
            continue
        at[root] = low[root] = len(at)
        path, walk = [], [(root, None, iter(near[root]))]
        while walk:
            node, up, ways = walk[-1]
            for x in ways:
                if x not in at:
                    at[x] = low[x] = len(at)
                    path.append(x)
                    walk.append((x, node, iter(near[x])))
                    break
                if x != up and at[x] < low[node]:
                    low[node] = at[x]
            else:
                walk.pop()
                if up is None:
                    continue
                low[up] = min(low[up], low[node])
                if low[node] >= at[up]:  # what the search has found since node is a block with up
                    while not out or out[-1][:2] != (node, block):
                        out.append((path.pop(), block, up))
                    block += 1
    return out


def _counts(tree: list[tuple]) -> dict:
    """{node: number of its blocks}."""
    of: dict = {}
    for node in [node for node, _, _ in tree] + [top for top, _ in {(top, block) for _, block, top in tree}]:
        of[node] = of.get(node, 0) + 1
    return of


def _by_group(rows: DataFrame, of: Callable[[object, Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``of`` makes of the rows of each value of the first column, one group at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        found = (x for key, own in groupby(every, lambda r: r[0]) for x in of(key, own))
        while some := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), to)], schema=to)

    return rows.repartition(F.col(rows.columns[0])).sortWithinPartitions(rows.columns[0]).mapInArrow(run, schema)


def cut_down(rows: DataFrame) -> DataFrame:
    """(id, src, dst, was): for each id the links of the tree of blocks between its ends, with a leaf where more hangs on a node, and in a row without src how many of its points lie there.

    rows: (component, id, a, b) of small components: an edge a, b, or an end a of the id where b is null. Nodes are "node:...", blocks "block:...", leaves "more:..."."""

    def of(component, own):
        edges, ends = set(), {}
        for _, id_, a, b in own:
            if b is None:
                ends.setdefault(id_, set()).add(a)
            else:
                edges.add((a, b))
        tree = small_tree(edges)
        number, up, depth = _counts(tree), {}, {}
        # A search gives the blocks under a node before that one's own.
        for node, block, top in reversed(tree):
            up[node], up[(block,)] = (block,), top
            depth[(block,)] = depth.setdefault(top, 0) + 1
            depth[node] = depth[(block,)] + 1
        name = lambda x: f"block:{component}:{x[0]}" if isinstance(x, tuple) else f"node:{x}"
        for id_, nodes in ends.items():
            front, kept = {x for x in nodes if x in number}, dict.fromkeys((x for x in nodes if x in number), 0)
            heap = [(-depth[x], isinstance(x, tuple), x) for x in front]
            heapify(heap)
            while len(front) > 1:
                x = heappop(heap)[2]
                front.remove(x)
                above = up[x]
                yield id_, name(x), name(above), None
                kept[x], kept[above] = kept.get(x, 0) + 1, kept.get(above, 0) + 1
                if above not in front:
                    front.add(above)
                    heappush(heap, (-depth[above], isinstance(above, tuple), above))
            on = [(x, n) for x, n in kept.items() if not isinstance(x, tuple)]
            yield from ((id_, f"node:{x}", f"more:node:{x}", None) for x, n in on if number[x] > n)
            yield id_, None, None, sum(number[x] > 1 for x, _ in on)

    return _by_group(rows.select("component", "id", "a", "b"), of, f"id {rows.schema['id'].dataType.simpleString()}, src string, dst string, was long")


def count_points(rows: DataFrame) -> DataFrame:
    """(id, now): the articulation points of each id's small graph (id, src, dst), without those that are "block:..."."""

    def of(id_, own):
        yield id_, sum(n > 1 and not x.startswith("block:") for x, n in _counts(small_tree(r[1:] for r in own)).items())

    return _by_group(rows.select("id", "src", "dst"), of, f"id {rows.schema['id'].dataType.simpleString()}, now long")
