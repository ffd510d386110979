"""Regridders of other kinds, one after another, and fields of other kinds."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.points import divided
from .regridder import Regridder


class AnyRegridder(ABC):
    """What takes a field (cell_id, values, keys) to another grid."""

    @abstractmethod
    def regrid(self, field: DataFrame, **options) -> DataFrame: ...


AnyRegridder.register(Regridder)


@dataclass(frozen=True)
class Chain(AnyRegridder):
    """``first``, then ``second``; both may be any regridders, and nothing is multiplied out."""

    first: AnyRegridder
    second: AnyRegridder

    def regrid(self, field: DataFrame, **options) -> DataFrame:
        there = self.first.regrid(field, **options)
        return self.second.regrid(there, **{k: v for k, v in options.items() if k != "key"})


def product(second: Regridder, first: Regridder) -> Regridder:
    """One regridder for both: the weights of ``second`` times those of ``first``, divided by the areas between them.

    The cells between both meet on their ids: each pair of weights there is one row before they are summed.  A cell without
    area passes nothing on.
    """
    if first.n_dst != second.n_src:
        raise ValueError(f"{first.n_dst} cells come out of the first regridder, the second takes {second.n_src}")
    between = first.dst_areas.select(F.col("cell_id").alias("dst"), F.col("area").alias("__between")).where("__between <> 0")
    one = first.weights.join(between, "dst").select(F.col("dst").alias("middle"), "src", divided(F.col("area"), F.col("__between")).alias("share"))
    other = second.weights.select("dst", F.col("src").alias("middle"), "area")
    weights = other.join(one, "middle").groupBy("dst", "src").agg(F.sum(F.col("area") * F.col("share")).alias("area"))
    return replace(second, weights=weights, src_areas=first.src_areas, n_src=first.n_src)


class FieldAdapter(ABC):
    """A field of another kind: how it becomes a table, and what a regridded table becomes."""

    @abstractmethod
    def table(self) -> tuple[DataFrame, dict]:
        """The field as a table, and the options of ``regrid`` that say what its columns are: key, values, by."""

    @abstractmethod
    def filled(self, out: DataFrame):
        """This kind of field with the values of a regridded table."""


@dataclass(frozen=True)
class WideField(FieldAdapter):
    """Cells as rows, one column for each of many levels or times: a key and every other column a value."""

    data: DataFrame
    key: str = "cell_id"

    def table(self) -> tuple[DataFrame, dict]:
        return self.data, {"key": self.key, "values": [c for c in self.data.columns if c != self.key]}

    def filled(self, out: DataFrame) -> WideField:
        return WideField(out.withColumnRenamed("cell_id", self.key), self.key)


@dataclass(frozen=True)
class ListField(FieldAdapter):
    """cell_id and one array of values, level by level."""

    data: DataFrame
    values: str = "values"

    def table(self) -> tuple[DataFrame, dict]:
        return self.data.select("cell_id", F.posexplode(self.values).alias("level", "value")), {"by": ["level"]}

    def filled(self, out: DataFrame) -> ListField:
        levels = F.transform(F.array_sort(F.collect_list(F.struct("level", "value"))), lambda x: x["value"])
        return ListField(out.groupBy("cell_id").agg(levels.alias(self.values)), self.values)


def regrid_field(regridder: AnyRegridder, field: FieldAdapter, like: FieldAdapter | None = None, **options):
    """A field of any kind on the destination grid, as the kind of ``like`` or its own."""
    table, own = field.table()
    return (like or field).filled(regridder.regrid(table, **own, **options))
