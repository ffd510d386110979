"""A regridder applied to a stream of field values: a stream-static join and a sum for each window and cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regrid_stream(regridder, stream: DataFrame, *, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes", key: str = "cell_id", value: str = "value") -> DataFrame:
    """window, cell_id, value: destination means of each window; cells that nothing reached have no row."""
    shares = regridder.weights.withColumnRenamed("area", "w").join(regridder.dst_areas.withColumnRenamed("cell_id", "dst"), "dst").where("area > 0").select("dst", "src", (F.col("w") / F.col("area")).alias("share"))
    rows = stream.withWatermark(time, late).select(F.col(time), F.col(key).alias("src"), F.col(value).cast("double").alias("v"))
    sums = rows.join(shares, "src").groupBy(F.window(time, window), "dst").agg(F.sum(F.col("share") * F.col("v")).alias("value"))
    return sums.select("window", F.col("dst").alias("cell_id"), "value")
