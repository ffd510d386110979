"""Weights on disk, with the variables of ESMF weight files as Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.points import divided
from ..manifold import Manifold


def esmf_tables(regridder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """weights (row, col, S), source (cell_id, area_a, frac_a) and destination (cell_id, area_b, frac_b)."""
    dst, src = regridder.marginals()
    weights = regridder.weights.join(regridder.dst_areas.withColumnRenamed("area", "__area"), F.col("dst") == F.col("cell_id"))
    weights = weights.select(F.col("dst").alias("row"), F.col("src").alias("col"), divided(F.col("area"), F.col("__area")).alias("S"))
    return weights, src.select("cell_id", F.col("area").alias("area_a"), F.col("frac").alias("frac_a")), dst.select("cell_id", F.col("area").alias("area_b"), F.col("frac").alias("frac_b"))


def save_esmf_weights(path: str, regridder, *, src_grid_name: str = "source", dst_grid_name: str = "destination", src_shape: tuple | None = None, dst_shape: tuple | None = None, created_at: str | None = None) -> str:
    """Writes weights/, src/, dst/ and attrs/ below ``path``; attributes that are not given are left out."""
    weights, src, dst = esmf_tables(regridder)
    for name, table in (("weights", weights), ("src", src), ("dst", dst)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    attrs = {"normalization": "destarea", "n_a": regridder.n_src, "n_b": regridder.n_dst, "manifold": regridder.manifold.kind, "radius": regridder.manifold.radius}
    more = {"src_grid_name": src_grid_name, "dst_grid_name": dst_grid_name, "src_shape": src_shape and list(src_shape), "dst_shape": dst_shape and list(dst_shape), "created_at": created_at}
    attrs |= {k: v for k, v in more.items() if v is not None}
    regridder.weights.sparkSession.createDataFrame([(json.dumps(attrs),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/attrs")
    return path


def load_attrs(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/attrs").first()[0])


def load_regridder(spark: SparkSession, path: str):
    """The regridder that ``save_esmf_weights`` wrote: area = S * area_b."""
    from ..operators.regridder import Regridder

    attrs = load_attrs(spark, path)
    dst, src = spark.read.parquet(f"{path}/dst"), spark.read.parquet(f"{path}/src")
    weights = spark.read.parquet(f"{path}/weights").join(dst, F.col("row") == F.col("cell_id"))
    weights = weights.select(F.col("row").alias("dst"), F.col("col").alias("src"), (F.col("S") * F.col("area_b")).alias("area"))
    return Regridder(weights, dst.select("cell_id", F.col("area_b").alias("area")), src.select("cell_id", F.col("area_a").alias("area")), attrs["n_b"], attrs["n_a"], Manifold(attrs["manifold"], attrs["radius"]))
