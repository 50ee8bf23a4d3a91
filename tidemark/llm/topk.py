"""Exact top-k inner products by a three-phase uniform threshold.

Phase 1 gathers, from every batch of rows, the local score lists of all queries of a block. Phase 2 broadcasts for each query a safe
cutoff, the k-th best of the gathered lists less the rounding error, and every batch collects the entries that can reach it.
Phase 3 resolves the scores of just these entries exactly in integers and keeps the k best of each batch; the last merge is over those.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id; vectors of
different lengths don't score; a query row repeated under one id is one query (the smallest vector), and no row of its id is its
candidate; repeated candidate rows each count; ties go to the smaller id; components beyond 64 bits after scaling, and scores beyond 64 bits,
count as the nearest 64-bit number. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import new_path, settled, table

K = 10
EVERY = 100
#: Queries held in memory and broadcast at once.
BLOCK = 1024


def _matrices(ids, vectors):
    """(ids, integer matrix) for each vector length."""
    lengths = np.fromiter((len(v) for v in vectors), dtype=np.int64, count=len(vectors))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield ids[at], np.stack([np.asarray(vectors[i], dtype=np.int64) for i in at])


#: The largest and smallest scores.
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows, within 64 bits."""
    if float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", q, x)
    return np.array([min(MOST, max(LEAST, sum(a * b for a, b in zip(r, s, strict=True)))) for r, s in zip(q.tolist(), x.tolist(), strict=True)], dtype=np.int64)


def _rough(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores within 64 bits, queries by rows, and for each query a bound of their error; in single precision where that can hold them."""
    qn, xn = (np.sqrt((m.astype(np.float64) ** 2).sum(1)) for m in (q, x))
    single = float(qn.max(initial=0)) * float(xn.max(initial=0)) < 2.0**100
    kind, unit = (np.float32, 2.0**-23) if single else (np.float64, 2.0**-52)
    bound = (q.shape[1] + 4) * unit * qn * xn.max(initial=0) + 1e-6
    # near the ends of 64 bits doubles are 2048 apart
    return np.clip((q.astype(kind) @ x.astype(kind).T).astype(np.float64), -(2.0**63), 2.0**63), bound + (0 if single else 4096.0)


def _gather(block, k):
    def run(batches):
        for pdf in batches:
            for ids, x in _matrices(pdf["vec_id"].to_numpy(), pdf["v"].to_list()):
                for qids, q in block:
                    if q.shape[1] != x.shape[1]:
                        continue
                    s, bound = _rough(q, x)
                    s[qids[:, None] == ids[None, :]] = -np.inf
                    n = min(k, s.shape[1])
                    top = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n :] - bound[:, None]
                    rows = pd.DataFrame({"query_id": np.repeat(qids, n), "low": top.ravel()})
                    yield rows[np.isfinite(rows["low"])]

    return run


def _collect(block, cutoffs, k):
    def run(batches):
        for pdf in batches:
            for ids, x in _matrices(pdf["vec_id"].to_numpy(), pdf["v"].to_list()):
                for qids, q in block:
                    if q.shape[1] != x.shape[1]:
                        continue
                    s, bound = _rough(q, x)
                    floor = np.array([cutoffs.get(int(i), -np.inf) for i in qids])
                    a, b = np.nonzero((s + bound[:, None] >= floor[:, None]) & (qids[:, None] != ids[None, :]))
                    if not len(a):
                        continue
                    out = pd.DataFrame({"query_id": qids[a], "vec_id": ids[b], "score": _exact(q[a], x[b])})
                    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                    yield out.groupby("query_id", sort=False).head(k)

    return run


def as_integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); rows that take no part are left out."""
    e = F.col(embedding)
    ok = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    v = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(F.col(vec_id).isNotNull() & ok & (F.size(e) > 0)).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def exact_topk(ints: DataFrame, is_query: Column, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for (vec_id, v) rows; queries are the rows that is_query holds for, taken in blocks of bounded size."""
    spark = ints.sparkSession
    ints = settled(ints)  # read twice for each block of queries
    # a block's queries come to the driver, at most about `block` vectors; the query set itself stays distributed
    queries = settled(ints.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    n_blocks = max(1, -(-queries.count() // block))
    path = new_path(spark)
    for i in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i).collect()
        held = list(_matrices(np.array([r["vec_id"] for r in rows], dtype=np.int64), [r["v"] for r in rows])) if rows else []
        sent = spark.sparkContext.broadcast(held)
        lists = ints.mapInPandas(lambda it, s=sent: _gather(s.value, k)(it), "query_id long, low double")
        nth = W.partitionBy("query_id").orderBy(F.desc("low"))
        cut = lists.withColumn("n", F.row_number().over(nth)).where(F.col("n") == k)
        cutoffs = {r["query_id"]: r["low"] for r in cut.collect()}  # one number for each query of the block
        floor = spark.sparkContext.broadcast(cutoffs)
        enough = ints.mapInPandas(lambda it, s=sent, f=floor: _collect(s.value, f.value, k)(it), "query_id long, vec_id long, score long")
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        enough.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = as_integers(table(spark, sf_dir, "embeddings"))
    return exact_topk(ints, F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
