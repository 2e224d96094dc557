"""Exact top-k inner products by MaxScore.

A dimension and a sign are a term; a part of a shard of vectors has a posting list of it, the vectors whose component has that
sign. A query's terms of the sign of its own components can only raise a score; each has a bound, its weight times the
largest impact in the part. With the k-th best score so far as threshold, the weakest terms whose bounds sum up to less are
non-essential: a vector in none but those can't compete. So only essential lists are traversed; what stays competitive
is probed in the other terms, strongest first, and then in the terms of opposite sign, which only lower a score, and is
dropped as soon as its bound falls below the threshold. A shard's vectors are in order of their length, so the first part
has the likeliest winners; the threshold rises from part to part, and a part whose bounds all sum up to less is passed over. The
first shard is searched before the others, which begin with the threshold from there. Shards' winners are merged.

Shards hold about SHARD vectors and queries come in blocks of about BLOCK; a task has one of each, whatever the sizes.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part; a
shorter vector counts as padded with zeros; a query is an id, of repeated ones the least vector counts; repeated
candidates are rows of their own, but none with the query's id; ties go to the smaller id; components and scores
that leave the range of 64 bits count as its end, so such scores are ties; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

SHARD, BLOCK = 8192, 8192
#: Vectors of a part of a shard; a threshold holds for a part.
PART = 1024
LEAST, MOST = -(2**63), 2**63 - 1


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))


def whole(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


class Part:
    """Vectors with a posting list for each term. The matrix is of one number type."""

    def __init__(self, candidates, ids):
        import numpy as np

        width = candidates.shape[1]
        self.vectors, self.ids = candidates, ids
        self.above = [np.flatnonzero(candidates[:, d] > 0) for d in range(width)]
        self.under = [np.flatnonzero(candidates[:, d] < 0) for d in range(width)]
        self.impact_above = [candidates[x, d] for d, x in enumerate(self.above)]
        self.impact_under = [candidates[x, d] for d, x in enumerate(self.under)]
        self.most = np.maximum(candidates.max(0, initial=0), 0)
        self.least = np.minimum(candidates.min(0, initial=0), 0)

    def search(self, q, own, threshold):
        """(rows, scores) of the vectors with another id than the query's that score at least the threshold (None: all)."""
        import numpy as np

        if threshold is None or threshold <= 0:  # a vector in no essential list may compete
            live = np.flatnonzero(self.ids != own)
            score = self.vectors[live] @ q
            if threshold is not None:
                keep = score >= threshold
                live, score = live[keep], score[keep]
            return live, score
        bounds = np.where(q > 0, q * self.most, q * self.least)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        after = bounds[order][::-1].cumsum()[::-1]  # bound of a term and all weaker ones
        essential = int((after >= threshold).sum())
        if not essential:
            return np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        score = np.zeros(len(self.ids), self.vectors.dtype)
        for d in order[:essential]:
            if q[d] > 0:
                score[self.above[d]] += q[d] * self.impact_above[d]
            else:
                score[self.under[d]] += q[d] * self.impact_under[d]
        left = after[essential] if essential < len(order) else 0
        live = np.flatnonzero((score > 0) & (score + left >= threshold))
        live = live[self.ids[live] != own]
        score = score[live]
        for i, d in enumerate(order[essential:], essential + 1):
            score = score + np.maximum(q[d] * self.vectors[live, d], 0)
            keep = score + (after[i] if i < len(order) else 0) >= threshold
            live, score = live[keep], score[keep]
        loss = np.where(q > 0, q * self.least, q * self.most)
        for d in np.argsort(loss, kind="stable"):
            if loss[d] >= 0 or not len(live):
                break
            score = score + np.minimum(q[d] * self.vectors[live, d], 0)
            keep = score >= threshold
            live, score = live[keep], score[keep]
        return live, score


def maxscore(queries, candidates, own_ids, ids, k: int, floors=None, part: int = PART):
    """For each query (row) the k best candidates: (query number, id, score) lists. Matrices of one number type and width.

    floors: for each query a score that k candidates elsewhere reach, or None.
    """
    import numpy as np

    rough = candidates.astype(float)
    order = np.argsort(-(rough * rough).sum(1), kind="stable")
    candidates, ids = candidates[order], ids[order]
    parts = [Part(candidates[a : a + part], ids[a : a + part]) for a in range(0, len(ids), part)]
    out = []
    for nth, (q, own) in enumerate(zip(queries, own_ids)):
        threshold = None if floors is None else floors[nth]
        best_ids, best = ids[:0], candidates[:0, 0]
        for p in parts:
            live, score = p.search(q, own, threshold)
            if not len(live):
                continue
            if score.dtype == object:
                score = np.minimum(np.maximum(score, LEAST), MOST)
            best_ids, best = np.append(best_ids, p.ids[live]), np.append(best, score)
            first = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[first], best[first]
            if len(best) == k and (threshold is None or best[-1] > threshold):
                threshold = best[-1]
        out += [(nth, int(i), int(s)) for i, s in zip(best_ids, best)]
    return out


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row's vector for each query, the rows whose id is divisible by ``every``."""
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"))
    # By row, so that copies of a vector don't share a shard. A row's number depends on how files are dealt to tasks, so it is written before it is used: each row is in one
    # shard for both searches, however many executors either finds.
    rows = stored(rows.withColumn("at", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    count = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0)).first()
    shards, blocks = max(1, -(-count[0] // shard)), max(1, -(-count[1] // block))
    numbers = lambda first, n: F.explode(F.sequence(F.lit(first).cast("long"), F.lit(n - 1).cast("long")))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select("id", "v", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks).cast("long")).alias("block"))
    held = rows.select(F.col("id").alias("vec"), F.col("v").alias("w"), F.pmod("at", F.lit(shards).cast("long")).alias("shard"), numbers(0, blocks).alias("block"))

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        columns = {"query_id": "int64", "vec_id": "int64", "score": "int64"}
        if queries.empty or candidates.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})
        width = max(queries.v.map(len).max(), candidates.w.map(len).max())

        def matrix(v):
            m = np.zeros((len(v), width), np.int64)
            for i, x in enumerate(v):
                m[i, : len(x)] = x
            return m

        q, c = matrix(queries.v), matrix(candidates.w)
        size = max(1, int(width)) * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0))
        kind = np.float64 if size < 2**53 else np.int64 if size < 2**62 else object  # each exact for such sums
        own = queries.id.to_numpy()
        floors = None if "floor" not in queries else [None if x is None or x is pd.NA or x != x else int(x) for x in queries["floor"].astype(object)]
        found = maxscore(q.astype(kind), c.astype(kind), own, candidates.vec.to_numpy(), k, floors)
        return pd.DataFrame({"query_id": own[[x[0] for x in found]] if found else [], "vec_id": [x[1] for x in found], "score": [x[2] for x in found]}).astype(columns)

    def searched(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        return queries.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")

    found = searched(asked.withColumn("shard", F.lit(0).cast("long")), held.where("shard = 0"))
    if shards > 1:
        found = stored(found, "first_shard")
        # As text: pandas would make a long column with nulls a double one.
        floors = found.groupBy(F.col("query_id").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("string").alias("floor")).where(F.col("n") >= k)
        known = asked.join(floors, F.col("id") == F.col("q"), "left").select("id", "v", "block", "floor")
        found = found.union(searched(known.withColumn("shard", numbers(1, shards)), held.where("shard > 0")))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
