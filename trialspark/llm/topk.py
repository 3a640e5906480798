"""Exact top-k search by inner product: tiled matrix products of queries and shards, selection per tile, tree merging.

Vectors are dealt into shards by their place in the input, as many as the machines can use and each of bounded bytes. Every
shard gets the queries streamed past it in batches; a tile is the product of some queries and some vectors of the shard.
Only what can still enter a query's list is taken from a tile. The lists of all shards are merged by a tree of rankings.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .ranking import best
from .vectors import doubles, matrix, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 10
#: Bytes of vectors that one shard holds at most (more only where a single vector is larger).
SHARD_BYTES = 32 << 20
#: Queries and vectors of one tile.
TILE = (512, 4096)
#: Entries are held to this, where every product has long left 64 bits.
FAR = 1e300
#: Stands for a null id, which comes last among equal scores.
NO_ID = np.iinfo(np.int64).max


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by doubles while no sum can reach 2^53, else by unbounded integers held to 64 bits."""
    size = queries.shape[1]
    top = lambda x: float(np.abs(x).max(initial=0))
    if top(queries) * top(vectors) * max(1, size) < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    whole = [np.array([int(v) for v in x.ravel()], object).reshape(x.shape) for x in (queries, vectors)]
    exact = whole[0] @ whole[1].T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Shard:
    """Vectors of one length; of equal ones only the `k` smallest ids, as no other can be among a query's best."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T)) if vectors.shape[1] else np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        fresh = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
        start = np.flatnonzero(fresh)
        place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
        stay = place < k
        order = np.argsort(ids[stay], kind="stable")
        self.ids, self.vectors, self.k = ids[stay][order], vectors[stay][order], k

    def best(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, score, id) of the `k` best vectors of each query, best first."""
        kept = tuple(np.empty(0, np.int64) for _ in range(3))
        least = np.full(len(queries), np.iinfo(np.int64).min)
        for a in range(0, len(self.ids), TILE[1]):
            ids = self.ids[a:a + TILE[1]]
            scores = products(queries, self.vectors[a:a + TILE[1]])
            at = max(0, len(ids) - self.k)
            bar = np.maximum(least, np.partition(scores, at, axis=1)[:, at])
            row, col = np.nonzero(scores >= bar[:, None])
            row, score, own = (np.concatenate([x, y]) for x, y in zip(kept, (row, scores[row, col], ids[col])))
            # Not the negated score: the least 64-bit integer has no opposite.
            order = np.lexsort((own, ~score, row))
            row, score, own = row[order], score[order], own[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = row, score, own = tuple(x[place < self.k] for x in (row, score, own))
            full = np.bincount(row, minlength=len(queries)) >= self.k
            last = np.searchsorted(row, np.arange(len(queries)), "right") - 1
            least[full] = score[last[full]]
        return kept


def scanned(rows: DataFrame, k: int, scale: float) -> DataFrame:
    """(_query, query_id, shard, own, score, id): the best of every shard for every query; `own` is the query's product with itself.

    rows: (shard, size, _query, id, x), those without `_query` first within a shard and length; sorted within partitions.
    """
    def scan(batches):
        at, ids, vectors, shard = None, [], [], None
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            asks = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                place = tuple(int(x) for x in where[:, a])
                if place != at:
                    at, ids, vectors, shard = place, [], [], None
                own = part.column(3).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                x = whole(matrix(part.column(4), place[1]), scale, FAR)
                if not asks[a]:
                    ids.append(own)
                    vectors.append(x)
                    continue
                if shard is None and ids:
                    shard = Shard(np.concatenate(ids), np.concatenate(vectors), k)
                    ids, vectors = [], []
                if shard is None:
                    continue
                number = part.column(2).to_numpy(zero_copy_only=False)
                for c in range(0, len(x), TILE[0]):
                    tile = x[c:c + TILE[0]]
                    row, score, found = shard.best(tile)
                    self_score = np.array([products(t[None], t[None])[0, 0] for t in tile], np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(number[c + row]), pa.array(own[c + row]), pa.array(np.full(len(row), place[0])), pa.array(self_score[row]),
                        pa.array(score), pa.array(found, mask=found == NO_ID)], names=["_query", "query_id", "shard", "own", "score", "id"])

    return rows.mapInArrow(scan, "_query long, query_id long, shard long, own long, score long, id long")


def top_k(rows: DataFrame, k: int = TOP, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vector: str = "embedding",
          shard_bytes: int = SHARD_BYTES, shards: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): for every row whose id is divisible by `every`, the `k` other rows of highest score.

    Score: inner product of the vectors' entries floor(scale * x), a 64-bit integer (held to its range beyond it); equal scores by
    smaller id. Vectors that are null or hold a null or non-finite entry take no part. Vectors of other lengths than the
    query's have no product with it. A query's own row is left out once: a repeated row finds its twin and is itself answered
    again. A null id is no query and comes last among equal scores. Empty tables give an empty result. Columns of other names
    are not looked at. `shards` overrides the number of shards.
    """
    spark = prepare(rows.sparkSession)
    valid = (rows.select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vector)).alias("x"), F.monotonically_increasing_id().alias("_row"))
             .where(F.col("x").isNotNull()))
    n, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    held = max(1, shard_bytes // (8 * max(1, longest)))
    shards = shards or max(1, -(-n // held), min(4 * spark.sparkContext.defaultParallelism, n // 512))
    sized = valid.select("id", "_row", F.size("x").alias("size"), "x")
    offered = sized.select(F.pmod("_row", F.lit(shards)).alias("shard"), "size", F.lit(None).cast("long").alias("_query"), "id", "x")
    asking = (sized.where(F.pmod("id", F.lit(every)) == 0)
              .select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "size", F.col("_row").alias("_query"), "id", "x"))
    dealt = (offered.unionByName(asking).repartitionById(shards, F.col("shard").cast("int"))  # one shard per task
             .sortWithinPartitions("shard", "size", F.col("_query").asc_nulls_first()))
    # One more than asked for, as a query finds itself; it stands in its list as any row of its id and score would.
    found = best(scanned(dealt, k + 1, scale), ["_query"], [F.col("score").desc(), F.col("id").asc_nulls_last()], k + 1, "shard", shards)
    itself = F.col("id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("own"))
    found = found.withColumn("_itself", F.min(F.when(itself, F.col("rank"))).over(Window.partitionBy("_query")))
    rank = F.col("rank") - F.when(F.col("rank") > F.col("_itself"), 1).otherwise(0)
    return (found.where(F.coalesce(F.col("rank") != F.col("_itself"), F.lit(True)))
            .select("query_id", rank.cast("int").alias("rank"), F.col("id").alias(id_col), "score").where(F.col("rank") <= k))
