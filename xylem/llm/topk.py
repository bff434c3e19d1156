"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors become integers, floor(256 * x). A shard of them is indexed by
dimension: posting lists cut into segments of equal quantised impact
(component // STEP). A query takes the segments of all dimensions in
descending order of the most that they add to a score. What a row can still
gain in a dimension where it hasn't been met is bounded by the next segment
there. Now and then the rows with the highest bounds are scored exactly; the
k-th of these scores proves that rows with lower bounds are no members.
Reading stops when scoring the possible members exactly is cheaper than
reading on; at worst all segments are read.

Shards have a bounded size, and queries stream past them: the work is queries
times vectors at most, held in pieces of bounded size. A shard's k best of a
query are merged with those of the other shards.

Nulls: vectors that are null, empty or hold null or non-finite components take
no part, as candidates or queries; vectors of different lengths don't meet.
Repeated rows are candidates each; rows with a query's own id are its own, and
repeated queries are answered once for each. Ties go to the smaller id. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
STEP = 32
SHARD = 16_384
#: Queries that one copy of a shard answers.
QUERIES = 512
#: Rows scored exactly for the threshold.
PROBE = 64


class ImpactIndex:
    """Postings of integer vectors by dimension and quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        dim, least, most, self.rows, self.values = [], [], [], [], []
        for d in range(vectors.shape[1]):
            column = vectors[:, d]
            order = np.argsort(column, kind="stable")
            level = column[order] // STEP
            starts = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
                rows = order[a:b]
                dim.append(d)
                least.append(column[rows[0]])
                most.append(column[rows[-1]])
                self.rows.append(rows)
                self.values.append(column[rows])
        self.dim, self.least, self.most = (np.array(x, np.int64) for x in (dim, least, most))
        self.sizes = np.array([len(x) for x in self.rows], np.int64)
        self.postings_read = 0
        self.met = np.zeros((vectors.shape[1], len(ids)), np.float32)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to smaller ids, without rows whose id is own."""
        n, dims = self.vectors.shape
        weight = query[self.dim]
        bound = np.maximum(weight * self.least, weight * self.most)
        order = np.argsort(-bound, kind="stable")
        ahead = [[] for _ in range(dims)]  # bounds of a dimension's segments, the next one last
        for s in order[::-1].tolist():
            ahead[self.dim[s]].append(int(bound[s]))
        score = np.zeros(n, np.int64)
        met = self.met
        met.fill(0)
        others = self.ids != own
        read, total = 0, n * dims
        check = int(0.3 * total)
        alive = np.flatnonzero(others)
        for s in order.tolist():
            d, rows = self.dim[s], self.rows[s]
            score[rows] += query[d] * self.values[s]
            met[d][rows] = 1
            ahead[d].pop()
            read += len(rows)
            if read >= check and read < total:
                check = read + total // 20
                rest = np.array([x[-1] if x else 0 for x in ahead], np.float32)
                # the margin covers single precision: bounds may be too high, never too low
                upper = score + (float(rest.sum(dtype=np.float64)) - rest @ met + 1e-4 * float(np.abs(rest).sum(dtype=np.float64)) + 1)
                upper[~others] = -np.inf
                probe = np.argpartition(-upper, min(PROBE, n - 1))[: max(PROBE, k)]
                probe = probe[others[probe]]
                exact = np.sort(self.vectors[probe] @ query)[::-1]
                if len(exact) >= k:
                    alive = np.flatnonzero(upper >= exact[k - 1])
                    if len(alive) * dims <= (total - read) // 2:
                        break
        self.postings_read += read
        exact = self.vectors[alive] @ query
        best = np.lexsort((self.ids[alive], -exact))[:k]
        return self.ids[alive][best], exact[best]


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of each row that is_query holds for."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    fine = fine.select("vec_id", "asks", F.size("v").alias("d"), F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))).cast("long")).alias("v"))
    sizes = fine.groupBy("d").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.ceil(F.count_if("asks") / QUERIES).cast("int").alias("blocks"))
    dealt = fine.join(F.broadcast(sizes), "d")  # one row for each length of vectors
    h = F.xxhash64("vec_id")
    # rows that ask with one id are told apart by their number
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "v"))
    asks = dealt.where("asks").withColumn("nth", nth).select("d", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(h, "blocks").cast("int").alias("block"), F.lit(1).alias("side"), "vec_id", "v", "nth")
    held = dealt.where("blocks > 0").select("d", F.pmod(h, "shards").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "vec_id", "v", F.lit(0).alias("nth"))
    key = ["d", "shard", "block"]

    def answer(batches):
        at, ids, parts, index = None, [], [], None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            vec = batch.column(4).to_numpy()
            offsets, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                x = values[offsets[i] : offsets[j]].reshape(j - i, -1)
                if marks[i][:3] != at:
                    at, ids, parts, index = marks[i][:3], [], [], None
                if marks[i][3] == 0:
                    ids.append(vec[i:j])
                    parts.append(x)
                elif parts:
                    if index is None:
                        index = ImpactIndex(np.concatenate(ids), np.concatenate(parts))
                    found = [index.top(q, own, k) for q, own in zip(x, vec[i:j].tolist(), strict=True)]
                    n = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(vec[i:j], n)), pa.array(np.repeat(batch.column(6).to_numpy()[i:j], n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "nth", "vec_id", "score"])

    both = held.unionByName(asks).repartition(*key).sortWithinPartitions(*key, "side")
    found = both.mapInArrow(answer, "query_id long, nth int, vec_id long, score long")
    best = Window.partitionBy("query_id", "nth").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
