"""Approximate nearest neighbours by cross-polytope hashing (Andoni et al. 2015).

A vector is turned by three rounds of random signs and a fast Hadamard
transform, and goes to the bucket of the signed axis nearest to it.  Each of
several tables has signs of its own.  A query looks into the buckets of its
nearest axes in every table, and all vectors found there are ranked
by their exact inner product.

Buckets are those of directions, so for the largest inner product rows are split into
bands of norm, a power of two each.  How many axes a band needs is measured in the
job: some queries are ranked against all rows, and a band is probed as far as
their true neighbours in it ask for, or ranked in full where that is less work.
Queries with fewer than k rows found are ranked against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import best, matrix, usable

#: Rows and queries that meet in one task.
ROWS_IN_BLOCK, QUERIES_IN_BLOCK = 16_384, 4096
#: Queries of a dimension that are ranked against all rows, and the share of their neighbours that probing must find.
SAMPLE, RECALL = 128, 0.96


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, width, step = len(rows), rows.shape[1], 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def nearest_axes(unit: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(row, table, probe) -> signed axis, nearest first."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))
    out = np.empty((len(unit), tables, min(probes, width)), np.int32)
    for t in range(tables):
        turned = padded
        for s in signs[t]:
            turned = hadamard(turned * s)
        axes = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :probes]
        out[:, t] = 2 * axes + (np.take_along_axis(turned, axes, 1) < 0)
    return out


def most_probes(dim: int, tables: int, probes: int) -> int:
    """Axes in a table from which on ranking all rows is less work."""
    width = 1 << max(1, (dim - 1).bit_length())
    return min(width, max(probes, 2 * width // tables))


def _hashed(vectors: DataFrame, norms: dict[int, float], tables: int, probes: int | None, seed: int) -> DataFrame:
    """vec_id, vec, dim, band (of norm, 0 the longest), axes (array, table by table); without ``probes`` a row's nearest axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = matrix(part.column("vec"))
                norm = np.linalg.norm(x, axis=1)
                band = np.maximum(0, np.ceil(np.log2(norms[int(dim)] / norm) - 1e-6) - 1).astype(np.int32)
                axes = nearest_axes(x / norm[:, None], tables, 1 if probes is None else most_probes(int(dim), tables, probes), seed).reshape(len(x), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * axes.shape[1], pa.int32()), pa.array(axes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vec"), part.column("dim"), pa.array(band), lists], ["vec_id", "vec", "dim", "band", "axes"])

    return vectors.mapInArrow(run, "vec_id bigint, vec array<double>, dim int, band int, axes array<int>")


def _needed(index: DataFrame, asked: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """dim, band, need: axes to probe so that RECALL of a band's rows among the k best of the sampled queries are found."""
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    chosen = asked.select("vec_id", "vec", "dim").withColumn("__n", F.row_number().over(by_hash)).where(F.col("__n") <= SAMPLE).collect()
    sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in chosen}:
        own = [r for r in chosen if r["dim"] == dim]
        q = np.array([r["vec"] for r in own])
        axes = nearest_axes(q / np.linalg.norm(q, axis=1, keepdims=True), tables, 1 << 30, seed)
        width = axes.shape[2]
        place = np.full((len(q), tables, 2 * width), 2 * width, np.int32)
        np.put_along_axis(place, axes, np.arange(width, dtype=np.int32)[None, None, :], 2)
        sample[dim] = np.array([r["vec_id"] for r in own]), q, place
    shared = index.sparkSession.sparkContext.broadcast(sample)

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in shared.value:
                    continue
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                own, q, place = shared.value[int(dim)]
                x, ids = matrix(part.column("vec")), part.column("vec_id").to_numpy()
                axes, band = matrix(part.column("axes")).astype(np.int64), part.column("band").to_numpy()
                repeated = len(np.unique(ids)) < len(ids)
                for i, s, p in zip(own, q @ x.T, place, strict=True):
                    s[ids == i] = -np.inf
                    at = best(s, ids, k, repeated)
                    at = at[ids[at] != i]
                    need = p[np.arange(tables), axes[at]].min(axis=1) + 1
                    columns = [np.full(len(at), dim, np.int32), np.full(len(at), i), ids[at], s[at], band[at], need.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "query_id", "vec_id", "score", "band", "need"])

    pairs = index.mapInArrow(true, "dim int, query_id bigint, vec_id bigint, score double, band int, need int")
    pairs = pairs.groupBy("dim", "query_id", "vec_id").agg(F.max(F.struct("score", "band", "need")).alias("best")).select("dim", "query_id", "vec_id", "best.*")
    order = Window.partitionBy("dim", "query_id").orderBy(F.col("score").desc(), "vec_id")
    pairs = pairs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    return pairs.groupBy("dim", "band").agg(F.expr(f"percentile_disc({RECALL}) WITHIN GROUP (ORDER BY need)").cast("int").alias("need"))


def nearest_neighbours(rows: DataFrame, is_query: Column, *, k: int = 20, tables: int = 16, probes: int = 8, seed: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for every query row.

    ``is_query`` is a condition on ``vec_id``.  Rows with the query's own id are
    no candidates of it; a candidate id counts once, with its best score; of several vectors of
    a query's id the least (component by component) asks; ties go to the smaller id.  Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, nor do rows without id; vectors of
    another length are never compared.  An empty table gives an empty result.

    ``probes`` is the least number of axes that a query looks at in a table.
    Buckets are cut into blocks of bounded rows and queries by their counts, so
    a bucket that holds a third of all vectors is searched by many tasks.
    """
    vectors = usable(rows, key, vector).withColumn("dim", F.size("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    vectors = vectors.withColumn("norm", norm).where("norm > 0")
    norms = {r["dim"]: r["most"] for r in vectors.groupBy("dim").agg(F.max("norm").alias("most")).collect()}
    vectors = vectors.drop("norm")
    index = checkpointed(_hashed(vectors, norms, tables, None, seed))
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    asked = checkpointed(_hashed(asked, norms, tables, probes, seed).drop("band"))
    bands = index.select("dim", "band").distinct().join(_needed(index, asked, k, tables, seed), ["dim", "band"], "left")
    # a row for each dimension and power of two of norms; no axes: the band is ranked in full
    limits = {dim: most_probes(dim, tables, probes) for dim in norms}
    plan = [(r["dim"], r["band"], 0 if (r["need"] or 0) > limits[r["dim"]] else max(r["need"] or 0, min(probes, limits[r["dim"]]))) for r in bands.collect()]
    plan = F.broadcast(rows.sparkSession.createDataFrame(plan, "dim int, band int, probes int"))
    in_full = F.array(F.struct(F.lit(-1).alias("table"), F.lit(0).alias("bucket")))
    per = F.size("axes") / tables

    def places(axes: Column) -> Column:
        own = F.transform(axes, lambda x, i: F.struct(F.floor(i / per).cast("int").alias("table"), x.alias("bucket"), (i % per).alias("__at")))
        own = F.filter(own, lambda s: s["__at"] < F.col("probes"))
        return F.when(F.col("probes") == 0, in_full).otherwise(F.transform(own, lambda s: F.struct(s["table"].alias("table"), s["bucket"].alias("bucket"))))

    entries = index.join(plan, ["dim", "band"]).select("dim", "band", "vec_id", "vec", F.inline(places(F.col("axes"))))
    probed = asked.join(plan, "dim").select("dim", "band", F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), F.inline(places(F.col("axes"))))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def ranked(entries: DataFrame, probed: DataFrame) -> DataFrame:
        found = _met(entries, probed, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return checkpointed(found.select("query_id", "rank", "vec_id", "score"))

    found = ranked(entries, probed)
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    one = [F.lit(0).alias("band"), F.lit(-1).alias("table"), F.lit(0).alias("bucket")]
    short = checkpointed(asked.select("dim", F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), *one).join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return found
    more = ranked(index.select("dim", "vec_id", "vec", *one), short)
    return found.join(full, "query_id", "left_semi").unionByName(more)


def best_in_order(q: np.ndarray, x: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, repeated: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best rows that are candidates (their score is not -inf).

    ``scores`` come from a matrix product, whose last bits depend on its shape.  Every row that is within their error of
    the k-th best is scored again with its sum in one fixed order, so that equal vectors tie everywhere.
    """
    at = best(scores, ids, k, repeated)
    at = at[scores[at] > -np.inf]
    if not len(at):
        return at, np.zeros(0)
    error = 1e-12 * len(q) * np.abs(q).max() * np.abs(x).max()
    near = np.flatnonzero((scores >= scores[at[-1]] - error) & (scores > -np.inf))
    again = (x[near] * q).sum(axis=1)
    at = best(again, ids[near], k, repeated)
    return near[at], again[at]


def _met(entries: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: a query's k best rows in each block that it meets."""
    group = ["dim", "band", "table", "bucket"]
    # one row for each table and axis: at most tables * 2 * padded dimension for a dimension and band
    sizes = entries.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).join(probed.groupBy(*group).agg(F.count(F.lit(1)).alias("queries")), group)
    sizes = sizes.select(*group, F.ceil(F.col("rows") / ROWS_IN_BLOCK).cast("int").alias("row_blocks"), F.ceil(F.col("queries") / QUERIES_IN_BLOCK).cast("int").alias("query_blocks"))
    sizes = checkpointed(sizes)
    left = entries.join(sizes, group).select(*group, "vec_id", "vec", F.pmod(F.xxhash64("vec_id"), "row_blocks").alias("row_block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("query_blocks").cast("bigint") - 1)).alias("query_block"))
    right = probed.join(sizes, group).select(*group, "query_id", "query", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("row_blocks").cast("bigint") - 1)).alias("row_block"), F.pmod(F.xxhash64("query_id"), "query_blocks").alias("query_block"))
    block = [*group, "row_block", "query_block"]

    def rank(found: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if found.num_rows and queries.num_rows:
            x, ids = matrix(found.column("vec")), found.column("vec_id").to_numpy()
            q, own = matrix(queries.column("query")), queries.column("query_id").to_numpy()
            repeated = len(np.unique(ids)) < len(ids)
            for first in range(0, len(q), 256):
                scores = q[first : first + 256] @ x.T
                for v, s, i in zip(q[first : first + 256], scores, own[first : first + 256], strict=True):
                    s[ids == i] = -np.inf
                    at, score = best_in_order(v, x, s, ids, k, repeated)
                    out["query_id"].append(np.full(len(at), i))
                    out["vec_id"].append(ids[at])
                    out["score"].append(score)
        return pa.table({n: np.concatenate(v) if v else np.zeros(0, np.float64 if n == "score" else np.int64) for n, v in out.items()})

    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(rank, "query_id bigint, vec_id bigint, score double")
