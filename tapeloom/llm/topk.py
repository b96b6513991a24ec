"""Exact top-k inner products from an impact-ordered index, read score at a time.

Vectors are turned into whole numbers. Candidates are dealt into shards of about ``shard`` vectors and
queries into blocks of about ``block`` vectors; every block meets every shard once (an equality join on
the pair of numbers, so both sides of a task are bounded). In a task each dimension's values are sorted
and cut into ``levels`` segments. For one query a segment's impact is the query's component times the
segment's best value, measured from the dimension's worst one, so that impacts are never negative. Segments
are read by descending impact. After each batch of segments, a candidate's score lies between what it has
gathered and that plus what its unread dimensions can still add; reading stops only when the number of
candidates whose upper bound reaches the k-th lower bound is small. Those are scored exactly.

Ties go to the smaller id. Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do empty ones and rows without id; a query meets only vectors of its own length; rows that share the query's id are
its own row; repeated rows are separate candidates; with fewer candidates all are returned. Inner products
must fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.plans.stage import stage

_SCHEMA = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id and ``v``, floor(scale * x) per component, of the vectors that take part."""
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & sound).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


class ImpactIndex:
    """Segments of a shard: per dimension, candidate numbers by level of their value."""

    def __init__(self, values: np.ndarray, levels: int):
        n, dims = values.shape
        self.values = values
        order = np.argsort(values, axis=0, kind="stable")
        self.edges = np.unique(np.linspace(0, n, levels + 1).astype(np.int64))
        sorted_values = np.take_along_axis(values, order, axis=0)
        self.order = order.T.copy()  # dims x n
        self.low = sorted_values[self.edges[:-1]].T  # dims x levels
        self.high = sorted_values[self.edges[1:] - 1].T

    def top(self, query: np.ndarray, k: int, own: np.ndarray, rounds: int = 8) -> np.ndarray:
        """Candidate numbers that can be among the k best (``own`` excluded), proven complete."""
        n, dims = self.values.shape
        q = query[:, None]
        up = q >= 0
        worst = np.where(q[:, 0] >= 0, self.low[:, 0], self.high[:, -1])[:, None]
        best = np.abs(q) * np.where(up, self.high - worst, worst - self.low)
        least = np.abs(q) * np.where(up, self.low - worst, worst - self.high)
        by_impact = np.argsort(-best, axis=None, kind="stable")
        gathered = np.zeros(n)
        extra = np.zeros(n)  # how much more the read segments may hold
        unread = best.copy()
        levels = best.shape[1]
        alive = np.flatnonzero(~own)
        for tier in np.array_split(by_impact, rounds):
            for d, level in zip(*np.divmod(tier, levels)):
                members = self.order[d, self.edges[level] : self.edges[level + 1]]
                gathered[members] += least[d, level]
                extra[members] += best[d, level] - least[d, level]
            unread.reshape(-1)[tier] = 0
            rest = float(unread.max(axis=1).sum())
            if len(alive) > k:
                bar = np.partition(gathered[alive], len(alive) - k)[len(alive) - k]
                alive = alive[gathered[alive] + extra[alive] + rest >= bar]
            if len(alive) <= 4 * k:
                break
        return alive


def _search(k: int, levels: int):
    def run(key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        ids, values = shard["vec_id"].to_numpy(), np.stack(shard["v"].to_numpy()).astype(np.int64)
        index = ImpactIndex(values, levels)
        out = []
        for query_id, q in zip(queries["vec_id"], queries["v"]):
            q = np.asarray(q, np.int64)
            found = index.top(q, k, ids == query_id)
            scores = values[found] @ q
            best = np.lexsort((ids[found], -scores))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found][best], "score": scores[best]}))
        return pd.concat(out)

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    shard: int = 8192,
    block: int = 1024,
    levels: int = 8,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows where ``is_query`` (a condition on ``vec_id``) holds."""
    table = stage(whole_numbers(vectors, vec_id, vector, scale), "vectors")
    queries = table.where(is_query)
    sizes = table.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    counted = sizes.agg(F.max("n").alias("n"), F.max("q").alias("q")).first()
    shards, blocks = max(1, -(-(counted["n"] or 0) // shard)), max(1, -(-(counted["q"] or 0) // block))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        return df.select(F.size("v").alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own), spread.alias(other), "vec_id", "v")

    left = dealt(queries, "block", blocks, "shard", shards).groupBy("d", "block", "shard")
    right = dealt(table, "shard", shards, "block", blocks).groupBy("d", "block", "shard")
    found = left.cogroup(right).applyInPandas(_search(k, levels), _SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
