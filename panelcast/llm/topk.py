"""Exact top-k search by inner product over norm-sorted, SVD-rotated vectors.

1. One aggregate gives the second moments of all vectors; their eigenvectors are the right
   singular vectors, so after the rotation a few leading components carry most of a product.
2. Candidates are range-partitioned by descending length and cut into blocks; every block knows
   its greatest length. The first ``SEED_ROWS`` (the longest, a bounded broadcast)
   give each query a first threshold, its k-th best score among them.
3. For each (shard, chunk of queries) the blocks are taken in descending length. A query is
   finished once its length times the block's greatest is below its threshold (Cauchy-Schwarz).
   Else the leading components' partial sum plus the product of the residual lengths bounds each
   candidate; only those that reach the threshold get their exact integer product. The threshold
   rises with every block.

Bounds have a margin for rounding and ties stay in, so the result is exact: products of
integers are computed in doubles where no sum can leave 2**53, else in Python integers.

Vectors null or with null or non-finite components take no part; shorter vectors count as if
zeros followed; rows with the query's own id are not its candidates; ties go to the smaller id;
rows of one id are ranked each; an empty table or a query without candidates gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import saved
from panelcast.llm.vectors import best, finite, matrix, ranked

SHARD_ROWS = 16_384
BLOCK_ROWS = 1_024
QUERY_CHUNK = 1_024
SEED_ROWS = 1_024
LEADING = 16
_EXACT = float(2 ** 53)


def second_moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """The dim x dim matrix of second moments, summed in Spark."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            total += x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    rows = (vectors.select("v").mapInArrow(partial, "i long, j long, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas())
    out = np.zeros((dim, dim))
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    out[i, j] = out[j, i] = rows["s"].to_numpy()
    return out


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, row by row."""
    if len(q) and np.sqrt((q ** 2).sum(1).max() * (c ** 2).sum(1).max()) >= _EXACT:
        return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True)], np.int64)
    return np.einsum("ij,ij->i", q, c).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of floor(scale * x) vectors."""
    spark = vectors.sparkSession
    # v: integers, as doubles (exact to 2**53); one long table of them in the shared folder
    ints = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    base = vectors.where(finite(vec_col)).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), ints.alias("v"))
    base = base.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    base = base.where(F.col("id").isNotNull())
    base = saved(base, "vectors")
    facts = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"),
                     F.sum(F.col("is_query").cast("long")).alias("nq")).first()
    n, dim, nq = facts["n"], facts["dim"] or 1, facts["nq"] or 0
    shards, chunks = max(1, -(-n // SHARD_ROWS)), max(1, -(-nq // QUERY_CHUNK))
    rotation = np.linalg.eigh(second_moments(base, dim))[1][:, ::-1] if n else np.eye(dim)
    lead = min(LEADING, dim)
    seeds = base.orderBy(F.col("n2").desc(), "id").limit(SEED_ROWS).select("id", "v").toArrow()
    held = spark.sparkContext.broadcast((rotation, seeds.column("id").to_numpy(), matrix(seeds.column("v"), dim)))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their first threshold: the k-th best among the seeds."""
        _, seed_ids, seed = held.value
        for batch in batches:
            ids, q = batch.column("id").to_numpy(), matrix(batch.column("v"), dim)
            least = np.full(len(ids), -np.inf)
            for r in range(len(ids)):
                others = seed_ids != ids[r]
                if others.sum() >= k:
                    s = exact_scores(np.broadcast_to(q[r], (int(others.sum()), dim)), seed[others])
                    least[r] = np.partition(s, len(s) - k)[len(s) - k]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(least)], ["id", "v", "least"])

    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    queries = (base.where("is_query").select("id", "v").mapInArrow(prepare, "id long, v array<double>, least double")
               .withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
               .select("*", every(shards, "shard")))
    # shards of descending length: bounds that part the rows evenly, ties by id
    order = [F.col("n2").desc(), F.col("id")]
    by_length = (base.repartitionByRange(shards, *order).sortWithinPartitions(*order)
                 .select("id", "v", "n2", F.spark_partition_id().alias("shard")))
    candidates = by_length.select("*", every(chunks, "chunk"))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rotate = held.value[0]
        q_ids, q, least = left.column("id").to_numpy(), matrix(left.column("v"), dim), left.column("least").to_numpy().copy()
        ids, c, n2 = right.column("id").to_numpy(), matrix(right.column("v"), dim), right.column("n2").to_numpy()
        down = np.lexsort((ids, -n2))
        ids, c, n2 = ids[down], c[down], n2[down]
        q_rot, c_rot = q @ rotate, c @ rotate
        q_len, c_len = np.sqrt((q ** 2).sum(1)), np.sqrt(n2)
        q_rest = np.sqrt((q_rot[:, lead:] ** 2).sum(1))
        c_rest = np.sqrt((c_rot[:, lead:] ** 2).sum(1))
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q_ids)
        for at in range(0, len(ids), BLOCK_ROWS):
            end = min(at + BLOCK_ROWS, len(ids))
            margin = 1e-9 * q_len * c_len[at] + 1e-6
            live = np.flatnonzero(q_len * c_len[at] + margin >= least)
            if not len(live):
                break
            bound = q_rot[live, :lead] @ c_rot[at:end, :lead].T + np.outer(q_rest[live], c_rest[at:end])
            hit = bound + margin[live, None] >= least[live, None]
            hit &= q_ids[live, None] != ids[None, at:end]
            row, col = np.nonzero(hit)
            scores = exact_scores(q[live[row]], c[at + col])
            cut = np.searchsorted(row, np.arange(len(live) + 1))
            for r in np.flatnonzero(np.diff(cut)):
                own = live[r]
                new_ids = np.concatenate([top[own][0], ids[at + col[cut[r]:cut[r + 1]]]])
                new = np.concatenate([top[own][1], scores[cut[r]:cut[r + 1]]])
                keep = ranked(new_ids, new, k)
                top[own] = new_ids[keep], new[keep]
                if len(keep) == k:
                    least[own] = max(least[own], new[keep[-1]])
        per = [len(t[0]) for t in top]
        return pa.table({"query_id": pa.array(np.repeat(q_ids, per), pa.int64()),
                         id_col: pa.array(np.concatenate([t[0] for t in top]) if top else [], pa.int64()),
                         "score": pa.array(np.concatenate([t[1] for t in top]) if top else [], pa.int64())})

    shape = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", id_col, "score")])
    found = (queries.groupBy("shard", "chunk").cogroup(candidates.groupBy("shard", "chunk"))
             .applyInArrow(search, shape))
    return best(found, "query_id", id_col, "score", k)
