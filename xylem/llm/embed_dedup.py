"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside them, one representative for each group.

Vectors are compared with those of their own label only. A cell is a label and
a centroid. A unit vector belongs to the cell of its nearest centroid c; it is
also shown to the cells of other centroids d where a partner could be: if
cos(x, y) >= t then |x - y| <= r = sqrt(2 - 2t), and y is in d's cell only if
(c - d).x <= r * |c - d|. So no link is lost between cells. Each vector counts
its own links, and every vector belongs to one cell, so no link counts twice.

A cell's members are dealt into blocks of BLOCK by hash; a task compares one
block of vectors with one block of members, so a cell that holds a third of
all rows is many tasks. A task gives, for each vector, its number of links and
one link to a member, and the links between members that join what it has
found so far: never all pairs.

Equal vectors (label and bits) are one vector with a multiplicity.

Centroids are fitted on a bounded sample (SAMPLE vectors of least hash), so
there are SAMPLE / FOR_EACH of them at most: beyond about 5 million vectors of a
label, cells grow with the table.

Nulls: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, link with nothing and are kept.
Vectors of different lengths aren't compared. Repeated rows link with each
other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import cut
from xylem.llm.components import connected_components

SAMPLE = 20_000
CELL = 2048
#: Sampled vectors for each centroid at least, which bounds the number of cells by the sample's.
FOR_EACH = 8
BLOCK = 1024
#: Room for rounding in the bounds that only select candidates.
EPS = 1e-6


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit vectors; starts from vectors far apart, the first being the first."""
    chosen = [0]
    near = x @ x[0]
    for _ in range(1, min(k, len(x))):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        new = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
        if np.allclose(new, c):
            break
        c = new
    return c


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def embedding_components(vectors: DataFrame, t: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fine = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    classes = cut(fine.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    by_size = {r["d"]: r["k"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("k")).collect()}  # one row for each length of vectors
    largest = {r["d"]: r["k"] for r in classes.groupBy(F.size("v").alias("d"), "label").agg(F.count("*").alias("k")).groupBy("d").agg(F.max("k").alias("k")).collect()}
    centroids = {}
    for d in by_size:
        some = classes.where(F.size("v") == d).orderBy(F.xxhash64("rep")).limit(sample).select("v").toPandas()["v"]
        x = np.array(some.tolist(), np.float64)
        # scaled first, so that the squares of extreme components neither vanish nor overflow
        x /= np.abs(x).max(1, keepdims=True)
        centroids[d] = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), max(1, min(len(x) // FOR_EACH, -(-largest[d] // cell))))
    sent = spark.sparkContext.broadcast(centroids)  # sample / FOR_EACH centroids for each length of vectors at most
    reach = np.sqrt(2 - 2 * t) + EPS

    def assign(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                c = sent.value[d]
                x = _matrix(part.column(1), d)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                dots = x @ c.T
                own = np.argmax(dots, 1)
                gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                show = dots[np.arange(len(x)), own][:, None] - dots <= reach * gap[own] + EPS
                row, col = np.nonzero(show)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * d, pa.int32()), pa.array(x[row].reshape(-1)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(np.full(len(row), d), pa.int32()), pa.array(col, pa.int32()), part.column(2).take(take), part.column(3).take(take), pa.array(own[row] == col), flat],
                    ["label", "d", "cell", "rep", "n", "member", "x"],
                )

    shown = cut(classes.select("label", "v", "rep", "n").mapInArrow(assign, "label string, d int, cell int, rep long, n long, member boolean, x array<double>"))
    key = ["label", "d", "cell"]
    blocks = shown.groupBy(*key).agg(F.ceil(F.sum(F.col("member").cast("int")) / BLOCK).cast("int").alias("mb"), F.ceil(F.count("*") / BLOCK).cast("int").alias("qb")).where("mb > 0")
    dealt = shown.join(blocks, key)
    # each vector meets every block of members; each member stands in every block of vectors
    asks = dealt.withColumn("q", F.pmod(F.xxhash64("rep"), "qb")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).withColumn("side", F.lit(1))
    gives = dealt.where("member").withColumn("m", F.pmod(F.xxhash64("rep", F.lit(1)), "mb")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).withColumn("side", F.lit(0))
    both = [*key, F.col("q").cast("int").alias("q"), F.col("m").cast("int").alias("m"), "side", "rep", "n", "x"]
    group = [*key, "q", "m"]

    def compare(batches):
        kept, members, ids, counts = None, [], [], []
        joined = None
        for batch in batches:
            marks = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            side, rep, n = (batch.column(k).to_numpy() for k in (5, 6, 7))
            offsets = batch.column(8).offsets.to_numpy()
            values = batch.column(8).values.to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1] or side[i] != side[i - 1]), len(marks)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                x = values[offsets[i] : offsets[j]].reshape(j - i, -1)
                if marks[i] != kept:
                    kept, members, ids, counts, joined = marks[i], [], [], [], None
                if side[i] == 0:
                    members.append(x)
                    ids.append(rep[i:j])
                    counts.append(n[i:j])
                    continue
                if not members:
                    continue
                if joined is None:
                    m_x, m_id, m_n = np.concatenate(members), np.concatenate(ids), np.concatenate(counts)
                    joined = np.arange(len(m_id))  # equal for members that links found here have joined
                near = x @ m_x.T >= t
                near &= rep[i:j][:, None] != m_id[None, :]
                links = near @ m_n
                hit = np.flatnonzero(links)
                a, b, k = [], [], []
                for h in hit.tolist():
                    found = np.flatnonzero(near[h])
                    # a link to one member of each group that nothing here has joined with the others
                    groups, one = np.unique(joined[found], return_index=True)
                    a += [rep[i + h]] * len(one)
                    b += m_id[found[one]].tolist()
                    k += [links[h]] + [0] * (len(one) - 1)
                    if len(groups) > 1:
                        joined[np.isin(joined, groups)] = groups[0]
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64)) for v in (a, b, k)], ["a", "b", "k"])

    met = asks.select(*both).unionByName(gives.select(*both)).repartition(*group).sortWithinPartitions(*group, "side")
    found = cut(met.mapInArrow(compare, "a long, b long, k long"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("k").alias("k"))
    roots = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("u", "rep")
    each = classes.join(links, "rep", "left").join(roots, "rep", "left").select("label", "v", (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    plain = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    out = plain.join(each, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
