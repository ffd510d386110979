"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where
    none is configured a temporary one serves a local session, whose tasks share
    this machine's disk; a cluster without the setting is an error.  Spark removes the
    files of tables that are no longer referenced with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def few_files(df: DataFrame, rows: int, rows_per_task: int = 20_000) -> DataFrame:
    """``df`` of about so many rows in no more tasks, and so files, than they are worth; large tables stay as they are."""
    return df.coalesce(max(1, -(-rows // rows_per_task)))


def give_back() -> None:
    """Returns freed memory of this Python worker, which may stay idle beside others, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker returns memory to the system once all that it held is free."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_once: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with where each begins (and the end), from batches sorted by integer ``keys``.

    A table has all groups that end in one batch; with ``at_once``, that many groups at most.
    """

    def cut(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(held)
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        new[0] = True
        begins = np.append(np.flatnonzero(new), table.num_rows)
        for first in range(0, len(begins) - 1, at_once or len(begins)):
            own = begins[first : first + (at_once or len(begins)) + 1]
            yield table.slice(own[0], own[-1] - own[0]), own - own[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k).to_numpy()
            same &= values == values[-1]
        last = int(same.argmax())  # the first row of the batch's last group
        if held and (last or any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)):
            yield from cut([*held, *([batch.slice(0, last)] if last else [])])
            held = []
        elif last:
            yield from cut([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield from cut(held)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows; empty ones are left out."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def tasks_for(df: DataFrame, rows: int, rows_per_task: int) -> int:
    """Partitions for a shuffle of ``rows`` rows: at least the session's number, more as rows grow."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // rows_per_task))


def running_total(rows: DataFrame, by: list[str], order: str, value: str, name: str, chunk: int = 4096) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``by`` with a smaller ``order``.

    ``order`` is an integer >= 0, unique within ``by``; ``by`` holds no nulls.
    Sums run within chunks of ``order`` and then over the chunks, so no task
    sees more than ``chunk`` rows of a group, or one row for each of its chunks.
    """
    rows = rows.withColumn("__chunk", F.floor(F.col(order) / chunk))
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "__chunk").agg(F.sum(value).alias("__sum"))
    starts = starts.select(*by, "__chunk", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(starts, [*by, "__chunk"]).withColumn(name, F.col("__start") + F.col("__within")).drop("__chunk", "__start", "__within")
