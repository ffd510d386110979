"""Connected components of a distributed edge list by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Edges for each task of a round: a short list needs neither many tasks nor an exchange.
EDGES_PER_TASK = 200_000


def _each(rows: DataFrame, *edges: tuple[str, str]) -> DataFrame:
    """a, b: several edges from each row, without those from a node to itself."""

    def edge(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))

    return rows.select(F.explode(F.array(*[edge(*e) for e in edges])).alias("e")).select("e.a", "e.b").where("a <> b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _each(edges, ("a", "b"), ("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("of"), F.least("a", "least").alias("least"))
    return both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "of")
    return _each(edges.join(least, F.col("a") == F.col("of")), ("b", "least"), ("a", "least")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """member, root for every node of ``links`` (a, b) that is not the least of its component.

    Rounds go on until nothing changes; each is written to the shared folder,
    so a lost executor costs one round.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges)
    mark = _mark(edges)
    while mark[0]:
        tasks = -(-mark[0] // EDGES_PER_TASK)
        edges = checkpointed(_small_star(_large_star(edges.coalesce(tasks))).coalesce(tasks))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("member"), F.col("b").alias("root"))
