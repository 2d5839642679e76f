"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Terms are vector components. For a block of queries and a block of candidates the weighted
postings of one term after another are scattered into a dense score array, the k best per
query are selected by partition, and the blocks' winners are merged.

Queries of a checked size go to every task, which holds its candidates in place and keeps
k winners per query; more queries are dealt into blocks that meet blocks of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, stored, table

SCALE, K = 256, 5
#: Rows that are scored together, so that a score array has 8 MB whatever the input's size.
QUERY_BLOCK, CANDIDATE_BLOCK = 256, 4096
#: Bytes of query weights up to which all queries are broadcast, and queries and candidates of a block beyond that.
BROADCAST_BYTES, FAR_QUERIES, FAR_CANDIDATES = 64_000_000, 20_000, 50_000
#: Sums of absolute products up to this are added as 64-bit integers, others as Python's.
SAFE = 2**62
_LOWEST = -(2**63) + 1
_FOUND = "query_row long, query_id long, vec_id long, score long"


def weights(vectors: list, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, x as double, exactly; vectors shorter than width end in zeros, longer ones are cut to it.

    64-bit integers, or Python's where one doesn't fit.
    """
    out = np.zeros((len(vectors), width))
    if len(vectors) and all(len(v) == width for v in vectors):
        out[:] = np.stack([np.asarray(v, np.float64) for v in vectors])
    else:
        for row, v in zip(out, vectors):
            row[: min(len(v), width)] = np.asarray(v, np.float64)[:width]
    if np.abs(out).max(initial=0) < SAFE / SCALE:
        return np.floor(SCALE * out).astype(np.int64)
    exact = [int(x) * SCALE if abs(x) > 2**60 else math.floor(SCALE * x) for x in out.ravel().tolist()]
    return np.array(exact, object).reshape(out.shape)


def _bound(queries: np.ndarray, candidates: np.ndarray) -> int:
    largest = lambda w: int(max(abs(int(w.max(initial=0))), abs(int(w.min(initial=0)))))
    return largest(queries) * largest(candidates) * queries.shape[1]


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores (queries x candidates), one term at a time over its postings."""
    kind = np.int64 if _bound(queries, candidates) < SAFE else object
    queries, candidates = queries.astype(kind, copy=False), candidates.astype(kind, copy=False)
    scores = np.zeros((len(queries), len(candidates)), kind)
    for term in range(queries.shape[1]):
        rows, posted = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if not len(rows) or not len(posted):
            continue
        if 2 * len(posted) > len(candidates):
            scores[rows] += np.multiply.outer(queries[rows, term], candidates[:, term])
        else:
            scores[np.ix_(rows, posted)] += np.multiply.outer(queries[rows, term], candidates[posted, term])
    if kind is object and len(scores) and scores.size and max(scores.max(), -scores.min()) >= 2**63:
        raise OverflowError("a score doesn't fit a long")
    return scores


def select(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places (queries x at most k) of the highest scores, the best first, ties to the earlier place; own is each query's excluded place, or -1.

    A place that is none (the query's own, where there are few others) is -1.
    """
    m, n = scores.shape
    mine = np.flatnonzero(own >= 0)
    if scores.dtype != object and (n + 1) * max(1, int(np.abs(scores).max(initial=0))) < SAFE:
        key = scores * n + np.arange(n - 1, -1, -1)  # unique, so that a partition settles the ties
        key[mine, own[mine]] = _LOWEST
        at = np.argpartition(key, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), (m, n))
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, 1), axis=1), 1)
        return np.where(np.take_along_axis(key, at, 1) == _LOWEST, -1, at)
    out = np.full((m, min(k, n)), -1)
    for i, row in enumerate(scores.tolist()):
        best = sorted((j for j in range(n) if j != own[i]), key=lambda j: (-row[j], j))[:k]
        out[i, : len(best)] = best
    return out


class Best:
    """The k best candidates so far of every query."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, weight: np.ndarray, k: int):
        self.rows, self.ids, self.weight, self.k = rows, ids, weight, k
        self.score = np.full((len(rows), 0), _LOWEST, np.int64)
        self.of = np.zeros((len(rows), 0), np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, vectors: list) -> None:
        order = np.argsort(ids, kind="stable")
        rows, ids, weight = rows[order], ids[order], weights(vectors, self.weight.shape[1])[order]
        by_row = np.argsort(rows)
        score, of = [], []
        for at in range(0, len(self.rows), QUERY_BLOCK):
            mine = self.rows[at : at + QUERY_BLOCK]
            place = by_row[np.minimum(np.searchsorted(rows[by_row], mine), len(rows) - 1)]
            scores = accumulate(self.weight[at : at + QUERY_BLOCK], weight)
            best = select(scores, np.where(rows[place] == mine, place, -1), self.k)
            score.append(np.where(best >= 0, np.take_along_axis(scores, np.maximum(best, 0), 1), _LOWEST).astype(np.int64))
            of.append(ids[np.maximum(best, 0)])
        score, of = np.concatenate([self.score, np.concatenate(score)], 1), np.concatenate([self.of, np.concatenate(of)], 1)
        order = np.lexsort((of, -score))[:, : self.k]
        self.score, self.of = np.take_along_axis(score, order, 1), np.take_along_axis(of, order, 1)

    def found(self) -> list[np.ndarray]:
        """query_row, query_id, vec_id, score of all winners."""
        q, at = np.nonzero(self.score != _LOWEST)
        return [self.rows[q], self.ids[q], self.of[q, at], self.score[q, at]]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row, id, v of every row with an id whose vector has no null and no non-finite component; a written table, so that row numbers stay."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(good)
    return stored(kept.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query row.

    queries, candidates: row, id, v (usable). A candidate is every row but the query's own:
    a row that repeats a query's id is another candidate, and a repeated query has its
    k rows each time. Ties go to the smaller id. Fewer than k candidates give fewer rows; an
    empty table gives none. Vectors of unequal length count as zero where short. Scores are
    exact for components of any size; one that doesn't fit a long is an error, not a wrong score.
    """
    spark = candidates.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size["n"], size["width"] or 0
    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    if n * width * 8 <= BROADCAST_BYTES:
        mine = queries.orderBy("row").collect()
        held = spark.sparkContext.broadcast((np.array([r["row"] for r in mine], np.int64), np.array([r["id"] for r in mine], np.int64), weights([r["v"] for r in mine], width)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(*held.value, k)
            for batch in batches:
                for at in range(0, len(batch) if n else 0, CANDIDATE_BLOCK):
                    part = batch.slice(at, CANDIDATE_BLOCK)
                    best.add(part.column(0).to_numpy(), part.column(1).to_numpy(), _vectors(part.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.found()], names=["query_row", "query_id", "vec_id", "score"])
            release()

        found = candidates.select("row", "id", "v").mapInArrow(run, _FOUND)
    else:
        blocks_q, blocks_c = -(-n // FAR_QUERIES), max(1, -(-candidates.count() // FAR_CANDIDATES))
        block = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
        q = queries.select("row", "id", "v", block(blocks_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks_c - 1))).alias("cb"))
        c = candidates.select(F.col("row").alias("c_row"), F.col("id").alias("c_id"), F.col("v").alias("c_v"), F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))).alias("qb"), block(blocks_c).alias("cb"))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            best = Best(left["row"].to_numpy(np.int64), left["id"].to_numpy(np.int64), weights(list(left["v"]), width), k)
            for at in range(0, len(right) if len(left) else 0, CANDIDATE_BLOCK):
                part = right.iloc[at : at + CANDIDATE_BLOCK]
                best.add(part["c_row"].to_numpy(np.int64), part["c_id"].to_numpy(np.int64), list(part["c_v"]))
            return pd.DataFrame(dict(zip(("query_row", "query_id", "vec_id", "score"), best.found())))

        found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(meet, _FOUND)
    return found.select("query_id", F.row_number().over(best_first).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _vectors(column: pa.ListArray) -> list:
    """Views of the vectors of a column without nulls."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.where("id % 50 = 0"), vectors)


OP2_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), t AS (
  SELECT r, vec_id, generate_subscripts(e, 1) AS d, CAST(floor(256 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS w FROM v
), s AS (
  SELECT q.r AS qr, c.r AS cr, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM t q JOIN t c ON q.d = c.d AND q.r <> c.r WHERE q.vec_id % 50 = 0 GROUP BY 1, 2, 3, 4
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
