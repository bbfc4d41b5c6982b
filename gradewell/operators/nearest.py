"""Exact nearest vectors of a query set, block by block (OP-11F)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries and vectors that meet in one task.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 16_384
LEAST_NORM = 1e-9


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < LEAST_NORM, 0.0, x / np.maximum(n, LEAST_NORM))


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has components that are all numbers, with its length."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).withColumn("dim", F.size("embedding"))


def _tile(k: int, digits: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            sims, ids = np.round(_unit(queries["query"]) @ _unit(vectors["embedding"]).T, digits), vectors["vec_id"].to_numpy()
            for q, row in zip(queries["query_id"].tolist(), sims, strict=True):
                # ties with the last one count, so that ids can decide
                near = np.flatnonzero(row >= np.partition(row, -min(k + 1, len(row)))[-min(k + 1, len(row))])
                near = near[ids[near] != q]
                best = near[np.lexsort((ids[near], -row[near]))][:k]
                out += [(q, int(ids[i]), float(row[i])) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "sim"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, vec_id of the ``k`` nearest other vectors by cosine (0 for next to no length; ties: the smaller id).

    Both are (vec_id, embedding). Vectors are dealt over blocks by a hash of
    their id, queries too; each pair of blocks is one task's work, whose size
    doesn't grow with either table, and hands on ``k`` rows a query. Vectors
    that are null, empty or hold null or non-finite components are nobody's
    neighbours and have none; vectors of different lengths aren't compared.
    """
    vectors, queries = _usable(vectors), _usable(queries)
    n_vectors, n_queries = vectors.count(), queries.count()
    v, q = max(1, -(-n_vectors // VECTOR_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("dim", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), block("vec_id", q).alias("qb"), every(v).alias("vb"))
    right = vectors.select("dim", "vec_id", "embedding", every(q).alias("qb"), block("vec_id", v).alias("vb"))
    near = left.groupBy("dim", "qb", "vb").cogroup(right.groupBy("dim", "qb", "vb")).applyInPandas(_tile(k, digits), "query_id long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    return near.withColumn("__n", rank).where(F.col("__n") <= k).select("query_id", "vec_id")
