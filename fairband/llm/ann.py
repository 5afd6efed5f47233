"""Nearest neighbours by cosine with a permutation index.

A vector is represented by its nearest pivots in order.  The index is dealt in
blocks; each block posts its vectors in pivot inverted files, adds up for a query
how well shared pivots agree in rank (the footrule distance of the two truncated
permutations), and reranks the vectors of smallest footrule by exact cosine.
Every row is indexed; only the pivots come from a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairband.llm.common import python_workers, written

PIVOTS = 256
PREFIX = 64  # pivots kept of a permutation
SAMPLE = 4096  # vectors that the pivots are taken from
BLOCK = 8192  # vectors in an index block, about
QUERIES = 1024  # queries in a query block, about
RERANKED = 0.2  # share of a block whose exact cosine is computed
LEAST = 100


def valid_vectors(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector, query, size)`` in double precision, without vectors that are null, zero or hold null or non-finite parts."""
    v = F.col("vector")
    return (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                           F.coalesce(is_query, F.lit(False)).alias("query"))
            .filter(F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
                    & F.exists(v, lambda x: x != 0.0))
            .withColumn("size", F.size("vector")))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(valid: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit pivots for every vector size in a sample of ``sample`` vectors, far from each other.

    The first vector by hash is a pivot; then, again and again, the sampled vector
    whose most similar pivot is least similar.  Copies are never chosen twice.
    """
    rows = valid.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(sample).select("vector", "size").collect()
    out = {}
    for size in {r["size"] for r in rows}:
        units = _unit(np.array([r["vector"] for r in rows if r["size"] == size]))
        chosen, nearest = [0], units @ units[0]
        while len(chosen) < min(pivots, len(units)) and nearest.min() < 1 - 1e-9:
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, units @ units[chosen[-1]])
        out[size] = units[chosen]
    return out


def permutations(units: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The ``prefix`` nearest pivots of every unit vector, nearest first."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :prefix]


def posting_lists(perms: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pivot: the rows that hold it in their prefix, and its rank there."""
    rows, ranks = np.divmod(np.arange(perms.size), perms.shape[1])
    order = np.argsort(perms.ravel(), kind="stable")
    cuts = np.searchsorted(perms.ravel()[order], np.arange(pivots + 1))
    return [(rows[order[a:b]], ranks[order[a:b]]) for a, b in zip(cuts, cuts[1:])]


def search_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray | None,
                 k: int, share: float = RERANKED, least: int = LEAST) -> list[tuple[int, int, float]]:
    """The ``k`` best rows of a block for each query: ``(query id, id, cosine)``."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    wanted = max(least, int(np.ceil(share * len(rows)))) + 1
    files = query_perms = None
    if pivots is not None and wanted < len(rows):
        perms = permutations(_unit(rows), pivots)
        depth = perms.shape[1]
        files = posting_lists(perms, len(pivots))
        query_perms = permutations(_unit(queries), pivots)
    out = []
    for n, (query_id, query) in enumerate(zip(query_ids, queries)):
        found = np.arange(len(rows))
        if files is not None:
            agreed = np.zeros(len(rows), np.int32)  # the footrule distance falls by twice this
            for rank, pivot in enumerate(query_perms[n]):
                at, ranks = files[pivot]
                agreed[at] += depth - np.maximum(ranks, rank)
            found = np.flatnonzero(agreed >= np.partition(agreed, len(rows) - wanted)[len(rows) - wanted])  # ties too
        found = found[ids[found] != query_id]
        cosine = (rows[found] * query).sum(axis=1) / (norms[found] * np.sqrt((query * query).sum()))
        best = np.lexsort((ids[found], -cosine))[:k]
        out += [(int(query_id), int(ids[found[i]]), float(cosine[i])) for i in best]
    return out


def _once(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block; rows that repeat both (they share a block) count once."""
    ids, rows = group["id"].to_numpy(), np.array(group["vector"].tolist())
    if len(np.unique(ids)) < len(ids):
        first = sorted({(i, r.tobytes()): n for n, (i, r) in reversed(list(enumerate(zip(ids, rows))))}.values())
        ids, rows = ids[first], rows[first]
    return ids, rows


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            block: int = BLOCK, query_block: int = QUERIES, pivots: int = PIVOTS, share: float = RERANKED) -> DataFrame:
    """The ``k`` nearest other vectors of every row where ``is_query`` holds, by cosine in double precision.

    Returns ``query_id``, ``rank`` (from 1), ``id_col`` and ``score``; nearest first, ties
    to the smaller id; all candidates if there are fewer than ``k``.  Vectors that are
    null, zero or hold null or non-finite parts, and rows without id, take no part;
    vectors of different sizes are not compared; no row is a neighbour of its own id;
    rows that repeat id and vector count once.  Vectors with the
    same footrule at the edge of the reranked share are all reranked.  Other
    columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    python_workers(spark)
    valid = written(valid_vectors(vectors, is_query, id_col, vector_col), "ann-vectors")
    counts = valid.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    blocks, query_blocks = -(-counts["n"] // block) or 1, -(-counts["q"] // query_block) or 1
    shared = spark.sparkContext.broadcast(choose_pivots(valid, pivots))
    row = F.xxhash64("id", F.lit("block"))
    index = valid.withColumn("block", F.pmod(row, F.lit(blocks)).cast("int")).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = (valid.filter("query").withColumn("query_block", F.pmod(row, F.lit(query_blocks)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            out = search_block(*_once(rows), *_once(queries), shared.value.get(int(rows["size"].iloc[0])), k, share)
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    keys = ["size", "block", "query_block"]
    best = (index.select(*keys, "id", "vector").groupBy(*keys).cogroup(asked.select(*keys, "id", "vector").groupBy(*keys))
            .applyInPandas(search, "query_id long, id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
