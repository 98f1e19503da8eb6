"""Exact top-k by inner product as a Voronoi join.

Pivots, a bounded sample of vectors, part the space: every vector goes to its nearest pivot's cell, queries and data alike. A
cell's summary (count, largest distance to the pivot, largest norm) bounds the product of a query with any of its vectors:
<q, x> <= <q, pivot> + |q| * distance, and <q, x> <= |q| * norm. A second bounded sample, the probes, gives each query a
threshold, its k-th best product with a probe: a cell whose bound is below it can't hold a better vector. Each query goes only
to the cells that it needs, and queries, lying in blocks by their own cells, are few: a vector is sent once for each block of
queries that needs its cell, not once for each group. Units are (cell, slice, block), so a cell that holds a third of all
vectors is still many tasks; each gives its k best, and the k best of those are the answer.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without vec_id. Vectors of unequal length are compared as if the
shorter one ended in zeros. Products that doubles can't hold exactly are computed with whole numbers, and scores beyond 64
bits are the nearest such number. Repeated vectors tie and go by vec_id; a table with fewer candidates than k gives all; empty
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrid.llm.common import save, small_batches

PIVOTS, PROBES = 64, 1024
#: Vectors of a slice and queries of a block at most, and bytes of a slice.
SLICE, BLOCK, SLICE_BYTES = 20_000, 2_000, 32 << 20
K = 5
_TOP = "query_id long, vec_id long, score long"
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Rows (vec_id, v): v holds floor(scale * component as double) as longs."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(x.isNotNull() & ~bad & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).cast("array<long>").alias("v"))


def _by_length(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    size = np.array([len(v) for v in vectors])
    return [(at, np.array([vectors[i] for i in at]).reshape(len(at), n)) for n in np.unique(size) for at in [np.flatnonzero(size == n)]]


def _products(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """All inner products of x with y, rounded as doubles: for bounds."""
    out = np.empty((len(x), len(y)))
    for i, a in _by_length(x):
        for j, b in _by_length(y):
            n = min(a.shape[1], b.shape[1])
            out[np.ix_(i, j)] = a[:, :n].astype(float) @ b[:, :n].astype(float).T
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of two matrices of whole numbers: doubles where they are exact, else whole numbers cut to 64 bits."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if not n or not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    most = lambda x: max(abs(int(x.min())), abs(int(x.max())))
    if most(a) * most(b) * n < 1 << 53:
        return a.astype(float) @ b.astype(float).T
    return np.clip(a.astype(object) @ b.astype(object).T, -_LONG - 1, _LONG).astype(np.int64)


def _sample(vectors: DataFrame, n: int, seed: int) -> list:
    """The vector of least hash in each of n slots: at most n rows, whatever the table's size."""
    h = F.xxhash64("vec_id", F.lit(seed))
    return vectors.groupBy(F.pmod(h, F.lit(n)).alias("g")).agg(F.min(F.struct(h.alias("h"), "vec_id", "v")).alias("x")).select("x.vec_id", "x.v").collect()


def deal(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, probes: int = PROBES, per_slice: int = SLICE, per_block: int = BLOCK) -> tuple[DataFrame, DataFrame] | None:
    """What is sent where: rows (key, vec_id, v) of queries and of data, that meet by key. None if there is no vector."""
    spark = vectors.sparkSession
    centre = [np.array(r["v"], np.int64) for r in _sample(vectors, pivots, 3)]
    if not centre:
        return None
    square = np.array([float((c.astype(float) ** 2).sum()) for c in centre])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.asarray(v, np.int64) for v in b.column("v").to_numpy(zero_copy_only=False)]
            own = np.array([float((v.astype(float) ** 2).sum()) for v in x])
            d = own[:, None] - 2 * _products(x, centre) + square
            cell = d.argmin(1) if len(x) else np.empty(0, int)
            dist = np.sqrt(np.maximum(d[np.arange(len(x)), cell], 0)) + 1e-6 * np.sqrt(own + square[cell]) + 1e-6
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("q"), pa.array(cell, pa.int32()), pa.array(dist), pa.array(np.sqrt(own))], ["vec_id", "v", "q", "cell", "dist", "norm"])

    schema = "vec_id long, v array<long>, q boolean, cell int, dist double, norm double"
    placed = small_batches(vectors).select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("q")).mapInArrow(assign, schema)
    placed = save(placed, "cells")
    # a row for each pivot
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.max("norm").alias("norm"), F.sum(F.col("q").cast("long")).alias("nq"), F.max(F.size("v")).alias("dim")).collect()}
    names = sorted(cells)
    radius, norm = (np.array([cells[c][x] for c in names]) for x in ("r", "norm"))
    hints = _sample(vectors, probes, 4)
    hint_ids, hint = np.array([r["vec_id"] for r in hints]), [np.array(r["v"], np.int64) for r in hints]

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column("vec_id").to_numpy(), [np.asarray(v, np.int64) for v in b.column("v").to_numpy(zero_copy_only=False)]
            own = np.array([float(np.sqrt((v.astype(float) ** 2).sum())) for v in x])[:, None]
            score = np.where(ids[:, None] == hint_ids, -np.inf, _products(x, hint)) if len(x) else np.empty((0, len(hint)))
            least = np.partition(score, -k, axis=1)[:, [-k]] if len(hint) >= k else np.full((len(x), 1), -np.inf)
            upper = np.minimum(_products(x, [centre[c] for c in names]) + own * radius, own * norm) if len(x) else score[:, :0]
            needed = upper + 1e-6 * (1 + np.abs(upper)) >= least
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("cell"), pa.array([[names[j] for j in np.flatnonzero(r)] for r in needed], pa.list_(pa.int32()))], ["vec_id", "v", "qc", "cells"])

    # queries lie in blocks in the order of their cells
    before, blocks = {}, 0
    for c in names:
        before[c], blocks = blocks, blocks + cells[c]["nq"]
    dim = max(1, max(r["dim"] for r in cells.values()))
    slices = {c: max(1, -(-cells[c]["n"] // max(16, min(per_slice, SLICE_BYTES // (8 * dim))))) for c in names}
    # a row for each pivot: its queries and those of cells before it, and its slices
    of_cell = spark.createDataFrame([(c, before[c], cells[c]["nq"], slices[c]) for c in names], "qc int, before long, nq long, slices int")
    part = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), n)
    q = small_batches(placed).filter("q").select("vec_id", "v", "cell").mapInArrow(needs, "vec_id long, v array<long>, qc int, cells array<int>")
    q = q.join(F.broadcast(of_cell.drop("slices")), "qc").withColumn("block", F.floor((F.col("before") + part(F.col("nq"))) / per_block).cast("int"))
    q = save(q.select("vec_id", "v", "block", F.explode("cells").alias("cell")), "queries")
    wanted = q.groupBy("cell").agg(F.collect_set("block").alias("blocks"))  # a row for each pivot: numbers of blocks of per_block queries
    key = F.xxhash64(*(F.col(c).cast("int") for c in ("cell", "slice", "block"))).alias("key")
    in_slices = F.broadcast(of_cell.select(F.col("qc").alias("cell"), "slices"))
    queries = q.join(in_slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    data = placed.join(F.broadcast(wanted), "cell").join(in_slices, "cell").withColumn("slice", part(F.col("slices")).cast("int")).withColumn("block", F.explode("blocks"))
    return queries.select(key, "vec_id", "v"), data.select(key, "vec_id", "v")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, probes: int = PROBES, per_slice: int = SLICE, per_block: int = BLOCK) -> DataFrame:
    """The k best other vectors of each query: rows (query_id, rank, vec_id, score)."""
    dealt = deal(vectors, is_query, k, pivots, probes, per_slice, per_block)
    if dealt is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries, data = dealt

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = []
        qid, xid = q["qid"].to_numpy(), x["vec_id"].to_numpy()
        for i, a in _by_length(list(q["qv"])):
            for s in range(0, len(a), 256):
                ids, best = qid[i[s : s + 256]], []
                for j, b in _by_length(list(x["v"])):
                    score = _exact(a[s : s + 256], b)
                    for r, row in enumerate(score):
                        # all above the k-th score and all equal to it, so that ties go by vec_id; one may be the query itself
                        edge = np.partition(row, len(row) - k - 1)[len(row) - k - 1] if len(row) > k + 1 else row.min()
                        at = np.flatnonzero(row >= edge)
                        at = at[xid[j[at]] != ids[r]]
                        at = at[np.lexsort((xid[j[at]], -row[at].astype(np.float64) if row.dtype == float else ~row[at]))][:k]
                        best.append((np.full(len(at), ids[r]), xid[j[at]], row[at].astype(np.int64)))
                found += best
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return pd.DataFrame({n: np.concatenate([f[c] for f in found]) for c, n in enumerate(("query_id", "vec_id", "score"))})

    near = queries.select(F.col("key").alias("qkey"), F.col("vec_id").alias("qid"), F.col("v").alias("qv")).groupBy("qkey").cogroup(data.groupBy("key")).applyInPandas(solve, _TOP)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for top_k(quantised(embeddings), vec_id % 50 = 0).
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
