"""ESMF weight files in the classic NetCDF format, written and read by Spark tasks.

The driver writes the header and sets the file's length; every task then writes its own rows of each variable where they
belong, so no value passes through the driver, and a task that runs twice writes the same bytes to the same places.  This asks for a path on
a file system that driver and executors share, as files.  A file of 2**31 entries or more has the 64-bit variant of the format.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.shared import written
from ..manifold import Manifold
from .weights_io import esmf_tables

#: Fixed values of the published format: tags of lists, types with their codes.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
CHAR, INT, DOUBLE, INT64 = 2, 4, 6, 10
KINDS = {CHAR: "S1", INT: ">i4", DOUBLE: ">f8", INT64: ">i8"}
#: Dimension and type (None: integers) of each variable.
VARIABLES = {"S": ("n_s", DOUBLE), "row": ("n_s", None), "col": ("n_s", None), "area_a": ("n_a", DOUBLE), "area_b": ("n_b", DOUBLE), "frac_a": ("n_a", DOUBLE), "frac_b": ("n_b", DOUBLE)}
#: Entries that one task reads.
ROWS_PER_TASK = 4_000_000


@dataclass(frozen=True)
class Layout:
    """Dimensions, attributes, and (first byte, numpy type, dimension) of each variable."""

    dims: dict[str, int]
    attrs: dict[str, str]
    variables: dict[str, tuple[int, str, str]]


def header(dims: dict[str, int], attrs: dict[str, str]) -> tuple[bytes, Layout, int]:
    """The header, the layout and the length of the file."""
    wide = max(dims.values(), default=0) >= 2**31
    number, integer = (">q", INT64) if wide else (">i", INT)

    def n(x: int) -> bytes:
        return struct.pack(number, x)

    def name(x: str) -> bytes:
        data = x.encode()
        return n(len(data)) + data + bytes(-len(data) % 4)

    def tagged(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">i", tag if items else 0) + n(len(items)) + b"".join(items)

    order = list(dims)
    front = b"CDF" + bytes([5 if wide else 2]) + n(0)
    front += tagged(DIMENSION, [name(k) + n(v) for k, v in dims.items()])
    front += tagged(ATTRIBUTE, [name(k) + struct.pack(">i", CHAR) + name(v) for k, v in attrs.items()])

    def entry(k: str, begin: int) -> bytes:
        dim, kind = VARIABLES[k]
        kind = kind or integer
        size = dims[dim] * np.dtype(KINDS[kind]).itemsize
        return name(k) + n(1) + n(order.index(dim)) + struct.pack(">i", 0) + n(0) + struct.pack(">i", kind) + n(size + -size % 4 if wide or size < 2**31 - 4 else 2**31 - 1) + struct.pack(">q", begin)

    at = len(front + tagged(VARIABLE, [entry(k, 0) for k in VARIABLES]))
    variables, entries = {}, []
    for k, (dim, kind) in VARIABLES.items():
        dtype = KINDS[kind or integer]
        variables[k] = (at, dtype, dim)
        entries.append(entry(k, at))
        at += dims[dim] * np.dtype(dtype).itemsize
        at += -at % 4
    return front + tagged(VARIABLE, entries), Layout(dims, attrs, variables), at


def read_header(path: str) -> Layout:
    """The layout of a file that has only fixed dimensions and, as attributes of the file, texts."""
    with open(path, "rb") as f:
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{path} is no classic NetCDF file")
        wide = magic[3] == 5

        def n(kind: str = "") -> int:
            kind = kind or (">q" if wide else ">i")
            return struct.unpack(kind, f.read(struct.calcsize(kind)))[0]

        def name() -> str:
            size = n()
            return f.read(size + -size % 4)[:size].decode()

        def attributes() -> dict:
            out = {}
            n(">i")
            for _ in range(n()):
                key, kind, size = name(), n(">i"), n()
                data = f.read((size := size * np.dtype(KINDS[kind]).itemsize) + -size % 4)[:size]
                out[key] = data.decode() if kind == CHAR else np.frombuffer(data, KINDS[kind]).tolist()
            return out

        n()
        n(">i")
        dims = {name(): n() for _ in range(n())}
        order, attrs, variables = list(dims), attributes(), {}
        n(">i")
        for _ in range(n()):
            key = name()
            own = [order[n()] for _ in range(n())]
            attributes()
            kind = n(">i")
            n()
            begin = n(">q" if magic[3] != 1 else ">i")
            variables[key] = (begin, KINDS[kind], own[0])
    return Layout(dims, attrs, variables)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.places = options["path"], json.loads(options["places"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        with open(self.path, "r+b") as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                at = batch.column("position").to_numpy()
                cuts = np.flatnonzero(np.diff(at) != 1) + 1  # a run of rows that follow each other is one write
                for k, (begin, dtype, _) in self.places.items():
                    values = batch.column(k).to_numpy(zero_copy_only=False).astype(dtype)
                    for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                        f.seek(begin + int(at[first]) * values.itemsize)
                        f.write(values[first:last].tobytes())
            f.flush()
            os.fsync(f.fileno())
        return WriterCommitMessage()


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.names = options["path"], options["variables"].split(",")
        layout = read_header(self.path)
        self.places = [layout.variables[k] for k in self.names]
        self.n = layout.dims[self.places[0][2]]

    def partitions(self) -> list[_Rows]:
        return [_Rows(k, min(self.n, k + ROWS_PER_TASK)) for k in range(0, max(self.n, 1), ROWS_PER_TASK)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        for first in range(partition.first, partition.last, 100_000):
            count = min(100_000, partition.last - first)
            columns = [pa.array(np.arange(first, first + count))]
            for begin, dtype, _ in self.places:
                values = np.fromfile(self.path, dtype, count, offset=begin + first * np.dtype(dtype).itemsize)
                columns.append(pa.array(values.astype(np.float64 if dtype == ">f8" else np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["position", *self.names])


class EsmfNetCDF(DataSource):
    """Rows of variables of one dimension: position (0-based) and the variables' values."""

    @classmethod
    def name(cls) -> str:
        return "esmf_netcdf"

    def schema(self) -> str:
        return ", ".join(["position bigint", *[f"`{k}` {'double' if VARIABLES[k][1] == DOUBLE else 'bigint'}" for k in self.options["variables"].split(",")]])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ARG002
        return _Writer(dict(self.options))

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(dict(self.options))


def _positioned(weights: DataFrame) -> tuple[DataFrame, int]:
    """The weights in order of row and column, with the position of each, and their number."""
    rows = weights.repartitionByRange("row", "col").sortWithinPartitions("row", "col")
    rows = written(rows.withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))))
    before, total = [], 0
    for part, count in sorted(tuple(r) for r in rows.groupBy("part").count().collect()):  # a row for each partition
        before.append((part, total))
        total += count
    starts = weights.sparkSession.createDataFrame(before, "part int, start bigint")
    return rows.join(F.broadcast(starts), "part").withColumn("position", F.col("k") + F.col("start")).drop("part", "k", "start"), total


def save_netcdf_weights(path: str, regridder, *, src_grid_name: str | None = None, dst_grid_name: str | None = None, src_shape: tuple | None = None, dst_shape: tuple | None = None, created_at: str | None = None) -> str:
    """Writes the regridder as one file: S = area / area_b with row and col from 1, areas and covered shares of both grids.

    Cells of a grid have the ids 1 to n.  Attributes that are not given are left out; the folder is made where it is missing.  The
    file appears under its name when it is complete.
    """
    spark = regridder.weights.sparkSession
    spark.dataSource.register(EsmfNetCDF)
    weights, src, dst = esmf_tables(regridder)
    weights, n_s = _positioned(weights)
    attrs = {"title": "conservative regridding weights", "normalization": "destarea", "map_method": "Conservative remapping", "manifold": regridder.manifold.kind, "radius": repr(regridder.manifold.radius)}
    more = {"domain_a": src_grid_name, "domain_b": dst_grid_name, "shape_a": src_shape and ",".join(map(str, src_shape)), "shape_b": dst_shape and ",".join(map(str, dst_shape)), "created_at": created_at}
    attrs |= {k: v for k, v in more.items() if v is not None}
    front, layout, size = header({"n_s": n_s, "n_a": regridder.n_src, "n_b": regridder.n_dst}, attrs)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    unfinished = f"{path}.unfinished"
    with open(unfinished, "wb") as f:
        f.write(front)
        f.truncate(size)
    cells = [t.withColumn("position", F.col("cell_id") - 1) for t in (src, dst)]
    for table, names in ((weights, ("S", "row", "col")), (cells[0], ("area_a", "frac_a")), (cells[1], ("area_b", "frac_b"))):
        places = {k: layout.variables[k] for k in names}
        table.select("position", *names).write.format("esmf_netcdf").mode("append").options(path=unfinished, variables=",".join(names), places=json.dumps(places)).save()
    os.replace(unfinished, path)
    return path


def read_netcdf(spark: SparkSession, path: str, *variables: str) -> DataFrame:
    """position and the given variables, all of one dimension."""
    spark.dataSource.register(EsmfNetCDF)
    return spark.read.format("esmf_netcdf").options(path=path, variables=",".join(variables)).load()


def load_netcdf_weights(spark: SparkSession, path: str):
    """The regridder of such a file: area = S * area_b."""
    from ..operators.regridder import Regridder

    layout = read_header(path)
    sides = [read_netcdf(spark, path, f"area_{k}").select((F.col("position") + 1).alias("cell_id"), F.col(f"area_{k}").alias("area")) for k in "ab"]
    weights = read_netcdf(spark, path, "S", "row", "col").join(sides[1], F.col("row") == F.col("cell_id"))
    weights = weights.select(F.col("row").alias("dst"), F.col("col").alias("src"), (F.col("S") * F.col("area")).alias("area"))
    manifold = Manifold(layout.attrs.get("manifold", "spherical"), float(layout.attrs.get("radius", 1)))
    return Regridder(weights, sides[1], sides[0], layout.dims["n_b"], layout.dims["n_a"], manifold)
