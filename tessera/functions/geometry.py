"""Image geometry as column arithmetic; pixels are left to injected functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aspect_ok(width: Column, height: Column, most: float = 2.5) -> Column:
    """Whether the longer side is at most ``most`` times the shorter."""
    return F.try_divide(F.greatest(width, height), F.least(width, height)) <= most


def centre_crop(width: Column, height: Column, size: int = 512, rounded: bool = False) -> Column:
    """(width, height, left, top): the shorter side is scaled to ``size`` and a square is cut from the centre."""
    whole = (lambda c: F.bround(c).cast("int")) if rounded else (lambda c: F.floor(c).cast("int"))
    short = F.least(width, height)
    w = F.when(width <= height, F.lit(size)).otherwise(whole(width * size / short))
    h = F.when(height <= width, F.lit(size)).otherwise(whole(height * size / short))
    return F.struct(w.alias("width"), h.alias("height"), F.floor((w - size) / 2).cast("int").alias("left"), F.floor((h - size) / 2).cast("int").alias("top"))


def pad_square(width: Column, height: Column) -> Column:
    """(side, left, top) of the square that an image is pasted into."""
    side = F.greatest(width, height)
    return F.struct(side.alias("side"), F.floor((side - width) / 2).cast("int").alias("left"), F.floor((side - height) / 2).cast("int").alias("top"))


def bounded_resize(width: Column, height: Column, longest: int = 1344, shortest: int = 672) -> Column:
    """(width, height) to which an image over the limit shrinks: the shorter side is set to at most ``shortest`` so that the
    longer stays under ``longest``. ``display_size`` leaves images within the limit alone."""
    ratio = F.greatest(width, height) / F.least(width, height)
    short = F.floor(F.least(longest / ratio, F.lit(shortest), F.least(width, height))).cast("int")
    long = F.floor(short * ratio).cast("int")
    return F.struct(F.when(height > width, short).otherwise(long).alias("width"), F.when(height > width, long).otherwise(short).alias("height"))


def display_size(width: Column, height: Column, longest: int = 1344, shortest: int = 672, fixed: int | None = None) -> Column:
    """(width, height) at which an image is shown: a longer side over ``longest`` makes it shrink. ``fixed``: both sides are
    set to this first."""
    if fixed:
        width, height = F.lit(fixed), F.lit(fixed)
    small = bounded_resize(width, height, longest, shortest)
    own = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    return F.when(F.greatest(width, height) > longest, small).otherwise(own)


def quadrants(df: DataFrame, n: int, width: str = "width", height: str = "height") -> DataFrame:
    """The first n of the four quarters of each image: crop, left, top, right, bottom."""
    w, h = F.col(width), F.col(height)
    x, y = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    zero = F.lit(0)
    boxes = [(zero, zero, x, y), (x, zero, w, y), (zero, y, x, h), (x, y, w, h)][:n]
    each = F.array(*[F.struct(F.lit(i).alias("crop"), *[c.cast("int").alias(k) for c, k in zip(b, ("left", "top", "right", "bottom"))]) for i, b in enumerate(boxes)])
    return df.select("*", F.explode(each).alias("_box")).select("*", "_box.*").drop("_box")


def grid_cell(index: Column, columns: int) -> Column:
    return F.struct(F.floor(index / columns).cast("int").alias("row"), F.pmod(index, F.lit(columns)).cast("int").alias("column"))


def is_square(n: Column) -> Column:
    return F.pow(F.floor(F.sqrt(n)), F.lit(2)) == n


def with_pixels(df: DataFrame, image: str, fn: Callable[[bytes], list[int] | None], to: str = "codes") -> DataFrame:
    """Applies an injected image function (decode, blend, crop, encode) batch by batch; what raises becomes null."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x):
            try:
                return None if x is None else fn(bytes(x))
            except Exception:  # noqa: BLE001  a bad image is a null, as any undecodable row
                return None

        for images in batches:
            yield pd.Series([one(x) for x in images], dtype=object)

    return df.withColumn(to, run(F.col(image)))
