"""Integrals, error metrics and checks of regridded fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import divided
from .merged import common_classes, rounded, spread
from .regridder import Regridder


def integral(field: DataFrame, areas: DataFrame, *, by: list[str] = ()) -> DataFrame:
    """``by``, integral and mean of a field (cell_id, value) over a grid's areas."""
    joined = field.join(areas, "cell_id").groupBy(*by)
    return joined.agg(F.sum(F.col("value") * F.col("area")).alias("integral"), divided(F.sum(F.col("value") * F.col("area")), F.sum("area")).alias("mean"))


def error_metrics(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: mean, largest and root-mean-square misfit, and how far the extremes of ``found`` go beyond those of ``true``."""
    joined = found.select("cell_id", F.col("value").alias("a")).join(true.select("cell_id", F.col("value").alias("b")), "cell_id")
    off = F.abs(F.col("a") - F.col("b")) / F.when(F.col("b") == 0, 1.0).otherwise(F.abs("b"))
    return joined.agg(F.avg(off).alias("mean_misfit"), F.max(off).alias("max_misfit"), F.sqrt(F.avg(off * off)).alias("rms_misfit"), divided(F.min("b") - F.min("a"), F.max(F.abs("b"))).alias("l_min"), divided(F.max("a") - F.max("b"), F.max(F.abs("b"))).alias("l_max"))


def mirror_fold(field: DataFrame, nx: int, ny: int, value: str = "value", *, by: list[str] = ()) -> DataFrame:
    """The last row's ghost cells get the values of the real cells they mirror: r and nx + 1 - r are one cell, for each ``by``."""
    place = F.col("cell_id") - (ny - 1) * nx
    real = place.between(1, nx // 4) | place.between(nx // 2 + 1, nx // 2 + nx // 4)
    twins = field.where(real).select((F.lit((ny - 1) * nx + nx + 1) - place).cast("bigint").alias("__of"), *[F.col(c).alias(f"__{c}") for c in by], F.col(value).alias("__twin"), F.lit(True).alias("__mirrored"))
    match = F.col("cell_id") == F.col("__of")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return field.join(twins, match, "left").withColumn(value, F.when(F.col("__mirrored"), F.col("__twin")).otherwise(F.col(value))).select(*field.columns)


def average_coincident(nodes: DataFrame, *, node: str = "global_node", value: str = "value", weight: str = "weight") -> DataFrame:
    """Weighted mean over the copies that neighbouring elements have of one node."""
    own = Window.partitionBy(node)
    return nodes.withColumn(value, divided(F.sum(F.col(value) * F.col(weight)).over(own), F.sum(weight).over(own)))


def weight_differences(one: DataFrame, other: DataFrame, *, relative: float = 1e-9, absolute: float = 0.0) -> DataFrame:
    """dst, src, one, other, off of the pairs on which two tables of weights (dst, src, area) do not agree.

    A pair that only one has counts as 0 in the other.  They may differ by ``absolute`` plus ``relative`` times the largest weight of the
    destination cell.  Order by ``off``, descending, for the worst.
    """
    a = one.groupBy("dst", "src").agg(F.sum("area").alias("one"))
    b = other.groupBy("dst", "src").agg(F.sum("area").alias("other"))
    return _apart(a, b, relative, absolute)


def _apart(a: DataFrame, b: DataFrame, relative: float, absolute: float) -> DataFrame:
    """Where two tables (dst, src, one) and (dst, src, other), pairs once in each, do not agree."""
    both = a.join(b, ["dst", "src"], "full").fillna(0.0, ["one", "other"])
    most = F.max(F.greatest(F.abs("one"), F.abs("other"))).over(Window.partitionBy("dst"))
    off = F.abs(F.col("one") - F.col("other"))
    return both.withColumns({"off": off, "__most": most}).where(F.col("off") > absolute + relative * F.col("__most")).drop("__most")


def regridder_differences(one: Regridder, other: Regridder, *, relative: float = 1e-9, absolute: float = 0.0, digits: int | None = None) -> DataFrame:
    """``weight_differences`` of the weights of two regridders, rounded after they are compared.

    Where both have classes of equal cells, classes are compared, cells that are together in both, and only what differs is spread over their cells.
    """
    names = ("one", "other", "off")
    a, b = one.classes, other.classes
    if a is None or b is None or any((getattr(a, s) is None) != (getattr(b, s) is None) for s in ("dst", "src")):
        found = weight_differences(one.weights, other.weights, relative=relative, absolute=absolute)
        return found.withColumns({c: rounded(F.col(c), digits) for c in names})
    sides, members = {"one": a.weights, "other": b.weights}, {}
    for side in ("dst", "src"):
        members[side] = None
        if getattr(a, side) is not None:
            classes, members[side] = common_classes(getattr(a, side), getattr(b, side))
            for name, weights in sides.items():
                of = classes.select("of", F.col(name).alias(side))
                sides[name] = weights.join(of.hint("merge"), side).drop(side).withColumnRenamed("of", side)
    found = _apart(*[w.select("dst", "src", F.col("area").alias(name)) for name, w in sides.items()], relative, absolute)
    return spread(found.withColumns({c: rounded(F.col(c), digits) for c in names}), members)
