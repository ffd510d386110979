"""Exact top-k inner products by pivot-table elimination.

Every row's distances to a set of pivots are computed once.  By the triangle
inequality the largest difference of a query's and a row's distances to a pivot is
a lower bound of their own distance, hence an upper bound of their score.  A
query evaluates rows in bound order and stops once no bound reaches its k-th
best score.  All distances together say more than the largest difference: they fix the two
points' projections onto the pivots' span, and what is left of their product is at most the product
of what is left of their lengths.  Rows that single pivots leave are bounded so.  A first floor under
the k-th best score comes from a sample of at most a tenth of the rows, the same
for all tasks; only rows that reach it leave a task.

Largest inner product is made a nearest-point question by one more coordinate,
sqrt(M^2 - |x|^2) for rows (M: the largest norm) and 0 for queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import best, matrix, usable

#: Pivots for a dimension; fixed, so their vectors can go to every task.
PIVOTS = 48
ROWS_IN_BLOCK, QUERIES_IN_BLOCK = 8192, 512
#: Rows of a dimension, by a hash of their ids, among which a query's first k-th best score is found: a tenth of them, and no more than this.
FLOOR_ROWS, FLOOR_PART = 4096, 10
#: Directions of the pivots' span that matter, as part of the largest eigenvalue, and what rounding may take from a squared length.
SPAN, ROUNDING = 1e-6, 1e-10
#: Rows that a query evaluates at first; doubled until it may stop.
FIRST_ROWS = 64


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; through float64 where that is exact."""
    if x.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def pivot_distances(x: np.ndarray, norms: np.ndarray, pivots: np.ndarray, most: float, query: bool) -> np.ndarray:
    """(row, pivot): distances in the space with the further coordinate."""
    own = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, most - norms))
    theirs = np.sqrt(np.maximum(0, most - (pivots * pivots).sum(1)))
    length = norms if query else np.full(len(x), most)
    return np.sqrt(np.maximum(0, length[:, None] + most - 2 * (x @ pivots.T) - 2 * own[:, None] * theirs[None, :]))


def span_of(pivots: np.ndarray, most: float) -> np.ndarray:
    """(pivot, direction): turns products with the pivots into coordinates along an orthonormal basis of their span."""
    own = np.sqrt(np.maximum(0, most - (pivots * pivots).sum(1)))
    size, along = np.linalg.eigh(pivots @ pivots.T + own[:, None] * own[None, :])
    kept = size > SPAN * max(size.max(initial=0), 1e-300)
    return along[:, kept] / np.sqrt(size[kept])


def projected(far: np.ndarray, length: np.ndarray, most: float, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in the pivots' span, from squared lengths and distances (point, pivot), and the length of what is outside."""
    y = (length[:, None] + most - far * far) / 2 @ span
    return y, np.sqrt(np.maximum(0, length - (y * y).sum(1)) + ROUNDING * most)


def exact_top_k(rows: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, pivots: int = PIVOTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): each query's k largest integer inner products.

    Components become floor(scale * x).  ``is_query`` is a condition on
    ``vec_id``.  Rows with the query's own id are no candidates; an id that
    occurs more than once counts with its best score; of several vectors of a query's id the least
    (component by component) asks; ties go to the smaller id.
    Vectors that are null, empty or hold a null or non-finite component take no
    part, nor do rows without id; vectors of another length are never compared.
    Sums must fit a long.  An empty table gives an empty result.
    """
    vectors = usable(rows, key, vector).withColumn("dim", F.size("vec"))
    vectors = vectors.select("vec_id", "dim", F.transform("vec", lambda x: F.floor(x * scale).cast("bigint")).alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = vectors.groupBy("dim").agg(F.max(square).alias("most"), F.count(F.lit(1)).alias("n")).collect()  # a row a dimension
    largest, counts = ({r["dim"]: r[c] for r in sizes} for c in ("most", "n"))
    chosen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in largest:  # by a hash of the id, so that every run has the same ones
        own = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(max(pivots, min(FLOOR_ROWS, counts[dim] // FLOOR_PART))).collect()
        chosen[dim] = np.array([r["vec"] for r in own], np.int64), np.array([r["vec_id"] for r in own])
    spans = {dim: span_of(sample[:pivots].astype(np.float64), largest[dim]) for dim, (sample, _) in chosen.items()}
    shared = rows.sparkSession.sparkContext.broadcast((chosen, spans))

    def measure(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    x = matrix(part.column("vec"))
                    d = pivot_distances(x, (x * x).sum(1), shared.value[0][int(dim)][0][:pivots].astype(np.float64), largest[int(dim)], query)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                    sample, names = (v[: counts[int(dim)] // FLOOR_PART] for v in shared.value[0][int(dim)])
                    floor = [floor_of(v, i, sample, names, k) for v, i in zip(x.astype(np.int64), part.column("vec_id").to_pylist(), strict=True)] if query else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dim"), part.column("vec"), lists, pa.array(floor, pa.int64())], ["vec_id", "dim", "vec", "far", "floor"])

        return run

    schema = "vec_id bigint, dim int, vec array<bigint>, far array<double>, floor bigint"
    index = checkpointed(vectors.mapInArrow(measure(False), schema))
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")).select("vec_id", F.size("vec").alias("dim"), "vec")
    asked = checkpointed(asked.mapInArrow(measure(True), schema))
    row_blocks, query_blocks = max(1, -(-index.count() // ROWS_IN_BLOCK)), max(1, -(-asked.count() // QUERIES_IN_BLOCK))
    block = ["dim", "row_block", "query_block"]

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = index.select("dim", "vec_id", "vec", "far", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).alias("row_block"), every(query_blocks).alias("query_block"))
    right = asked.select("dim", F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), F.col("far").alias("query_far"), "floor", every(row_blocks).alias("row_block"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("query_block"))

    def search(found: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if found.num_rows and queries.num_rows:
            x, ids = matrix(found.column("vec")).astype(np.int64), found.column("vec_id").to_numpy()
            dim = found.column("dim")[0].as_py()
            most, span = largest[dim], shared.value[1][dim]
            q = matrix(queries.column("query")).astype(np.int64)
            asked_far, lengths = matrix(queries.column("query_far")), (q.astype(np.float64) ** 2).sum(1)
            rows_far = matrix(found.column("far"))
            y, rest = projected(rows_far, np.full(len(x), most), most, span)
            query_y, query_rest = projected(asked_far, lengths, most, span)
            far = np.ascontiguousarray(rows_far.T)
            names, floors = (queries.column(c).to_numpy() for c in ("query_id", "floor"))
            for v, d, length, i, floor, along, outside in zip(q, asked_far, lengths, names, floors, query_y, query_rest, strict=True):
                bound = np.abs(far[0] - d[0])
                for p in range(1, len(far)):
                    np.maximum(bound, np.abs(far[p] - d[p]), out=bound)
                slack = 1e-9 * (length + most) + 1e-6
                upper = (length + most - bound * bound) / 2 + slack
                upper[ids == i] = -np.inf
                left = np.flatnonzero(upper >= floor)
                upper[left] = np.minimum(upper[left], y[left] @ along + rest[left] * outside + slack)
                upper[upper < floor] = -np.inf
                at, score = bounded_search(v, x, ids, upper, k)
                at, score = at[score >= floor], score[score >= floor]
                out["query_id"].append(np.full(len(at), i))
                out["vec_id"].append(ids[at])
                out["score"].append(score)
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, np.int64) for n, c in out.items()})

    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def floor_of(q: np.ndarray, own: int, sample: np.ndarray, ids: np.ndarray, k: int) -> int:
    """The k-th best score among the sampled rows of other ids; the least long if there are fewer."""
    scores = exact_scores(q, sample)
    at = best(scores, ids, k + 1, repeated=len(np.unique(ids)) < len(ids))
    at = at[ids[at] != own][:k]
    return int(scores[at[-1]]) if len(at) == k else -(2**63)


def bounded_search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k best, evaluated in the order of their bounds until none can enter.

    Rows whose bound is -inf are no candidates.
    """
    repeated = len(np.unique(ids)) < len(ids)
    order = np.argsort(-upper, kind="stable")
    order = order[upper[order] > -np.inf]
    scores = np.zeros(0, np.int64)
    size = max(FIRST_ROWS, k)
    while len(scores) < len(order):
        part = order[len(scores) : len(scores) + size]
        scores = np.concatenate([scores, exact_scores(q, x[part])])
        at = best(scores, ids[order[: len(scores)]], k, repeated)
        if len(scores) < len(order) and len(at) == k and upper[order[len(scores)]] < scores[at[-1]]:
            break
        size *= 2
    at = best(scores, ids[order[: len(scores)]], k, repeated)
    return order[at], scores[at]
