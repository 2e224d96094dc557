"""Graph algorithms as grouped pandas kernels: components are dealt whole, and those over ``MOST_EDGES`` are refused."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import both_ways

#: Edges of a component that a task may hold.
MOST_EDGES = 2_000_000


def bridging(between: DataFrame, degree: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, bridging): betweenness by (1/degree) / sum of 1/degree of the neighbours; null for isolates."""
    around = both_ways(edges).join(degree, F.col("dst") == F.col("node")).groupBy("src").agg(F.sum(1 / F.col("degree")).alias("s"))
    rows = between.join(degree, "node").join(around, F.col("node") == F.col("src"), "left")
    return rows.select("node", ((1 / F.nullif(F.col("degree"), F.lit(0))) / F.col("s") * F.col("betweenness")).alias("bridging"))


def _by_component(edges: DataFrame, component: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs the kernel on each component's edges. Components of more than ``MOST_EDGES`` are refused, as one task holds one."""
    rows = edges.select("src", "dst").where("src <> dst").join(component, F.col("src") == F.col("node")).select("component", "src", "dst")
    largest = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > MOST_EDGES:
        raise ValueError(f"a component has {largest} edges, more than {MOST_EDGES}")
    return rows.groupBy("component").applyInPandas(kernel, schema)


def block_tree(adjacent: dict) -> dict:
    """Parent of each node in a forest of nodes and blocks, a block being a largest set of nodes that no single one's removal
    parts. A root's is None, a node's else a block (a number), a block's the node by which it hangs."""
    number, low, parent, held, blocks = {}, {}, {}, [], 0
    for root in adjacent:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        parent[root] = None
        stack = [(root, None, iter(adjacent[root]))]
        while stack:
            v, up, rest = stack[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    held.append(w)
                    stack.append((w, v, iter(adjacent[w])))
                    break
                if w != up:
                    low[v] = min(low[v], number[w])
            else:
                stack.pop()
                if stack:
                    low[up] = min(low[up], low[v])
                    if low[v] >= number[up]:
                        parent[blocks] = up
                        last = None
                        while last != v:
                            last = held.pop()
                            parent[last] = blocks
                        blocks += 1
    return parent


def cut_nodes(parent: dict) -> set:
    """Nodes in several blocks of such a forest: without one of them its component falls apart."""
    count: dict = {}
    for x, up in parent.items():
        if up is not None:
            node = up if isinstance(x, int) else x
            count[node] = count.get(node, 0) + 1
    return {v for v, n in count.items() if n > 1}


def _adjacent(src, dst) -> dict:
    out: dict = {}
    for a, b in zip(src, dst):
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def louvain(edges: DataFrame, component: DataFrame, seed: int = 0) -> DataFrame:
    """(node, community): communities of locally best modularity, in an order of nodes that the seed shuffles; named by their node of highest degree."""
    kind = component.schema["node"].dataType.simpleString()

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        import random

        pairs = {(min(a, b), max(a, b)) for a, b in zip(group["src"], group["dst"])}
        weight: dict = {}
        for a, b in pairs:
            weight.setdefault(a, {})[b] = 1.0
            weight.setdefault(b, {})[a] = 1.0
        degree = {v: len(w) for v, w in weight.items()}
        member = {v: [v] for v in weight}
        loops = dict.fromkeys(weight, 0.0)
        double = 2.0 * len(pairs)
        draw = random.Random(seed)
        while True:
            k = {v: sum(w.values()) + loops[v] for v, w in weight.items()}
            home, total = {v: v for v in weight}, dict(k)
            moved = again = True
            improved = False
            while again:
                again = False
                order = sorted(weight, key=str)
                draw.shuffle(order)
                for v in order:
                    old, links = home[v], {}
                    for w, x in weight[v].items():
                        links[home[w]] = links.get(home[w], 0.0) + x
                    total[old] -= k[v]
                    gain = lambda c: links.get(c, 0.0) - total[c] * k[v] / double  # noqa: B023, E731
                    best = max(sorted(links, key=str), key=gain, default=old)
                    if gain(best) <= gain(old) + 1e-12:
                        best = old
                    total[best] += k[v]
                    if best != old:
                        home[v], again, improved = best, True, True
            if not improved:
                break
            members: dict = {}
            new_loops: dict = {}
            new: dict = {}
            for v, c in home.items():
                members.setdefault(c, []).extend(member[v])
                new_loops[c] = new_loops.get(c, 0.0) + loops[v]
                new.setdefault(c, {})
                for w, x in weight[v].items():
                    if home[w] == c:
                        new_loops[c] += x
                    else:
                        new[c][home[w]] = new[c].get(home[w], 0.0) + x
            member, loops, weight = members, new_loops, new
            del moved
        rows = []
        for own in member.values():
            hub = min(own, key=lambda v: (-degree[v], v))
            rows += [(v, hub) for v in own]
        return pd.DataFrame(rows, columns=["node", "community"])

    return _by_component(edges, component, kernel, f"node {kind}, community {kind}")


def divisive(edges: DataFrame, component: DataFrame) -> DataFrame:
    """(node, community) by taking out edges of highest betweenness while modularity rises level by level; small components only."""
    kind = component.schema["node"].dataType.simpleString()

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        whole: dict = {}
        for a, b in zip(group["src"], group["dst"]):
            whole.setdefault(a, set()).add(b)
            whole.setdefault(b, set()).add(a)
        count = sum(map(len, whole.values())) / 2

        def parts(adjacent):
            seen, out = set(), []
            for s in sorted(adjacent, key=str):
                if s in seen:
                    continue
                own, queue = {s}, [s]
                for v in queue:
                    for w in adjacent[v]:
                        if w not in own:
                            own.add(w)
                            queue.append(w)
                seen |= own
                out.append(own)
            return out

        def modularity(groups):
            return sum(sum(len(whole[v] & g) for v in g) / (2 * count) - (sum(len(whole[v]) for v in g) / (2 * count)) ** 2 for g in groups)

        def heaviest(adjacent):
            load: dict = {}
            for s in adjacent:
                order, before, paths, depth = [s], {s: []}, {s: 1.0}, {s: 0}
                for v in order:
                    for w in adjacent[v]:
                        if w not in depth:
                            depth[w], before[w], paths[w] = depth[v] + 1, [], 0.0
                            order.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        x = paths[v] / paths[w] * (1 + share[w])
                        share[v] += x
                        e = (v, w) if str(v) <= str(w) else (w, v)
                        load[e] = load.get(e, 0.0) + x
            return max(sorted(load, key=str), key=lambda e: round(load[e], 9))

        left = {v: set(w) for v, w in whole.items()}
        best, score = parts(left), modularity(parts(left))
        while any(left.values()):
            size = len(parts(left))
            while any(left.values()) and len(parts(left)) == size:
                a, b = heaviest(left)
                left[a].discard(b)
                left[b].discard(a)
            now = parts(left)
            if modularity(now) <= score:
                break
            best, score = now, modularity(now)
        rows = []
        for own in best:
            hub = min(own, key=lambda v: (-len(whole[v]), v))
            rows += [(v, hub) for v in own]
        return pd.DataFrame(rows, columns=["node", "community"])

    return _by_component(edges, component, kernel, f"node {kind}, community {kind}")


def soft_communities(edges: DataFrame, component: DataFrame, seeds: list[int]) -> DataFrame:
    """(hub, node, instances, share, core): in how many seeds' communities of a hub a node is, by the seeds that have the hub."""
    runs = None
    for seed in seeds:
        one = louvain(edges, component, seed).withColumn("seed", F.lit(seed))
        runs = one if runs is None else runs.union(one)
    hubs = runs.groupBy("community").agg(F.count_distinct("seed").alias("instances"))
    counts = runs.groupBy("community", "node").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(hubs, "community").select(F.col("community").alias("hub"), "node", "instances", (F.col("n") / len(seeds)).alias("share"), (F.col("n") == F.col("instances")).alias("core"))


def iteration_seeds(count: int, seed: int) -> list[int]:
    """Distinct numbers below 1000, or below twice the count if that is over 1000, in a random order that the seed fixes."""
    import hashlib

    most = 2 * count if count > 1000 else 1000
    return sorted(range(most), key=lambda x: hashlib.md5(f"{seed}|{x}".encode()).hexdigest())[:count]


def merged_communities(soft: DataFrame, iterations: int) -> DataFrame:
    """The table of ``soft_communities`` where communities of several names are one if they never changed and have equal nodes; it bears the longest name
    (most tokens, then the last in order), and instances and shares add up."""
    steady = soft.groupBy("hub").agg(F.min("core").alias("same"), F.first("instances").alias("instances"), F.sort_array(F.collect_list("node")).alias("nodes")).where("same and instances < " + str(int(iterations)))
    longest = F.struct(F.size(F.split(F.col("hub").cast("string"), r"\|")).alias("n"), F.col("hub").alias("h"))
    groups = steady.groupBy("nodes").agg(F.max(longest).alias("top"), F.collect_list("hub").alias("hubs")).where(F.size("hubs") > 1)
    names = groups.select(F.col("top.h").alias("to"), F.explode("hubs").alias("hub"))
    moved = soft.join(names, "hub", "left").withColumn("hub", F.coalesce("to", "hub")).drop("to")
    return moved.groupBy("hub", "node").agg(F.sum("instances").alias("instances"), F.sum("share").alias("share"), F.min("core").alias("core"))


def soft_difference(first: DataFrame, second: DataFrame, quantile: float = 0.95) -> DataFrame:
    """(hub, node, difference): shares of second less first over the nodes of first, of hubs with any difference over the quantile of all."""
    other = second.select("hub", "node", F.col("share").alias("other"))
    nodes = first.select("node").distinct()
    both = first.select("hub", "node", "share").join(other, ["hub", "node"], "full_outer").join(nodes, "node", "left_semi")
    off = both.select("hub", "node", (F.coalesce("other", F.lit(0.0)) - F.coalesce("share", F.lit(0.0))).alias("difference"))
    limit = off.agg(F.percentile(F.abs("difference"), quantile).alias("limit"))
    marked = off.crossJoin(F.broadcast(limit))
    keep = marked.where("abs(difference) > limit").select("hub").distinct()
    return off.join(keep, "hub", "left_semi")
