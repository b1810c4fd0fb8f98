"""Arrays in cells to one row per array element."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats import fixed
from fieldstats.functions.coerce import ref
from fieldstats.plans.ranks import systematic_sample


def flatten_grid(
    df: DataFrame,
    dims: Mapping[str, str | Sequence[object]],
    variables: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per grid cell: the coordinate of every dimension and the value of every variable.

    Each input row holds one block: flat value arrays (last dimension fastest) and, per dimension, an array column
    with its coordinates or a fixed list of them. A cell's coordinates follow from its position alone, so nothing
    is joined or shuffled; blocks flatten in parallel.
    """
    if not variables:
        raise ValueError("A grid needs at least one data variable.")
    if not dims:
        raise ValueError("A grid needs at least one dimension.")
    axes: dict[str, Column] = {
        name: ref(axis) if isinstance(axis, str) else F.array(*[F.lit(v) for v in axis]) for name, axis in dims.items()
    }
    held = {f"__axis{i}": axis for i, axis in enumerate(axes.values())}
    cells = F.arrays_zip(*[ref(v).alias(v) for v in variables])
    size = [F.size(a).cast("long") for a in axes.values()]
    whole = size[0]
    for s in size[1:]:
        whole = whole * s
    fits = F.size(ref(variables[0])).cast("long") == whole
    checked = F.when(fits, cells).otherwise(
        F.raise_error(F.lit("A value array does not match the lengths of its dimensions."))
    )
    rows = df.select(*[ref(c) for c in keep], *[a.alias(n) for n, a in held.items()], F.posexplode(checked).alias("__pos", "__cell"))
    names = list(axes)
    coordinates: list[Column] = []
    for i, name in enumerate(names):
        stride: Column = F.lit(1).cast("long")
        for k in range(i + 1, len(names)):
            stride = stride * F.size(f"__axis{k}")
        at = F.floor(F.col("__pos") / stride) % F.size(f"__axis{i}") if i + 1 < len(names) else F.col("__pos") % F.size(f"__axis{i}")
        coordinates.append(F.get(f"__axis{i}", at.cast("int")).alias(name))
    values = [F.col("__cell").getField(v).alias(v) for v in variables]
    return rows.select(*[ref(c) for c in keep], *coordinates, *values)


def flatten_raster(
    df: DataFrame,
    pixels: str,
    width: int | str,
    affine: Sequence[float],
    nodata: float | None = None,
    keep: Sequence[str] = (),
    max_points: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """``longitude, latitude, value`` of the pixels that hold data.

    ``pixels`` is a row-major array column, ``width`` its row length (number or column), ``affine`` the six numbers
    (a, b, c, d, e, f) of x = a·col + b·row + c, y = d·col + e·row + f, taken at pixel centres. ``max_points`` keeps
    that many points, evenly spaced in ``order_by`` and pixel order.
    """
    a, b, c, d, e, f = (float(v) for v in affine)
    span = ref(width) if isinstance(width, str) else F.lit(int(width))
    listed = df.select(*[ref(k) for k in keep], span.alias("__width"), F.posexplode(ref(pixels)).alias("__pos", "__pixel"))
    value = F.col("__pixel").cast("double")
    listed = listed.withColumn("value", value).where(F.col("value").isNotNull() & ~F.isnan("value"))
    if nodata is not None:
        listed = listed.where(F.col("value") != F.lit(float(nodata)))
    column = F.col("__pos") % F.col("__width") + 0.5
    row = F.floor(F.col("__pos") / F.col("__width")) + 0.5
    points = listed.select(
        *[ref(k) for k in keep],
        "__pos",
        (column * a + row * b + c).alias("longitude"),
        (column * d + row * e + f).alias("latitude"),
        "value",
    )
    if max_points is not None:
        order = [*order_by, "__pos"] if order_by else []
        points = systematic_sample(points, max_points, order)
    return points.drop("__pos")
