"""Tables that are written once, so that later steps do not compute them again."""

from __future__ import annotations

import re
import tempfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame) -> DataFrame:
    """``df`` in the session's checkpoint folder, which driver and executors share; a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder, as a path of files, below the session's checkpoint folder."""
    written(spark.range(0))
    folder = urlparse(spark.sparkContext.getCheckpointDir())
    if folder.scheme not in ("", "file"):
        raise ValueError("the checkpoint folder is no folder of files")
    return tempfile.mkdtemp(prefix="shared-", dir=folder.path)
