"""Resizing of images held as pixel rows (keys, x, y, value): grouped sums over the pixels that a target covers.

``sizes`` has a row (keys, w, h, tw, th) for each image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp_byte(x: Column) -> Column:
    """The nearest whole number in 0..255, ties to even ones."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(x)))


def smoothstep(x: Column) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return t * t * (3 - 2 * t)


def flatten_onto_white(value: Column, alpha: Column) -> Column:
    share = alpha / 255
    return value * share + (1 - share) * 255


def has_transparency(pixels: DataFrame, *keys: str, alpha: str = "a") -> DataFrame:
    """(keys, transparent): whether any pixel isn't opaque."""
    return pixels.groupBy(*keys).agg((F.min(alpha) < 255).alias("transparent"))


def fit_within(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """A size scaled down, never up, so that its long edge is at most ``most``; edges round half up and keep a pixel."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    return tuple(F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("int") for x in (w, h))


def _covered(at: Column, size: Column, target: Column) -> Column:
    """The targets that a source pixel at ``at`` lies in, and how much of it lies in each."""
    ratio = size / target
    first, last = F.floor(at / ratio).cast("int"), F.least(target - 1, F.ceil((at + 1) / ratio).cast("int") - 1)
    return F.transform(F.sequence(F.least(first, last), last), lambda t: F.struct(t.alias("t"), (F.least(at + 1, (t + 1) * ratio) - F.greatest(at, t * ratio)).alias("w")))


def area(pixels: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, value): each target is the mean of the source it covers, edges by their share; for scaling down."""
    p = pixels.join(sizes, list(keys))
    p = p.withColumn("_x", F.explode(_covered(F.col("x"), F.col("w"), F.col("tw")))).withColumn("_y", F.explode(_covered(F.col("y"), F.col("h"), F.col("th"))))
    weight = F.col("_x.w") * F.col("_y.w")
    return p.where(weight > 0).groupBy(*keys, F.col("_x.t").alias("x"), F.col("_y.t").alias("y")).agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"))


def _between(at: Column, size: Column, target: Column) -> tuple[Column, Column, Column]:
    """The two source places around the centre of the target at ``at``, and how far it lies from the first to the second."""
    place = F.least(F.greatest((at + 0.5) * size / target - 0.5, F.lit(0.0)), size - 1.0)
    low = F.floor(place)
    return low, F.least(low + 1, size - 1), place - low


def _line(pixels: pa.Array, widths: pa.Array, targets: pa.Array) -> pa.Array:
    """Each row of pixels (x, value) at its target width; a target without both its pixels is null, one with a null pixel has a null value."""
    w, tw = (np.asarray(a.to_numpy(zero_copy_only=False), dtype=np.int64) for a in (widths, targets))
    cut, n = np.concatenate([[0], np.cumsum(w)]), np.diff(pixels.offsets.to_numpy())
    flat = pixels.flatten()
    x, v = flat.field("x").to_numpy(), flat.field("value")
    place = np.repeat(cut[:-1], n) + x
    value, there, known = np.zeros(cut[-1]), np.zeros(cut[-1], dtype=bool), np.zeros(cut[-1], dtype=bool)
    value[place], there[place], known[place] = v.fill_null(0.0).to_numpy(zero_copy_only=False), True, v.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(tw)])
    row = np.repeat(np.arange(len(w)), tw)
    t = np.arange(ends[-1]) - ends[row]
    at = np.clip((t + 0.5) * w[row] / tw[row] - 0.5, 0.0, w[row] - 1.0)
    low = np.floor(at).astype(np.int64)
    a, b = cut[row] + low, cut[row] + np.minimum(low + 1, w[row] - 1)
    values = pa.array(value[a] + (value[b] - value[a]) * (at - low), mask=~(known[a] & known[b]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([values], names=["value"], mask=pa.array(~(there[a] & there[b]))))


def bilinear(pixels: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, value): interpolated between the four source pixels around each target's centre; no row where one of them is missing.

    Rows of pixels are brought to the target's width where they are, and go to
    the one or two rows of targets that each of them touches: what is shuffled
    are pixels once and rows once, and no pixel is joined with its targets.
    """
    line = F.arrow_udf(_line, "array<struct<value:double>>")
    pixel = F.struct(F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))
    rows = pixels.groupBy(*keys, F.col("y").cast("long").alias("_y")).agg(F.collect_list(pixel).alias("_p")).join(sizes, list(keys))
    # targets near a row: those around it, and one more on each side for the last bits
    step = F.col("th") / F.col("h")
    first = F.greatest(F.lit(0), F.floor((F.col("_y") - 0.5) * step - 0.5).cast("int") - 1)
    last = F.least(F.col("th") - 1, F.ceil((F.col("_y") + 1.5) * step - 0.5).cast("int") + 1)
    low, high, share = _between(F.col("_t"), F.col("h"), F.col("th"))
    near = rows.withColumn("_line", line(*map(F.col, ("_p", "w", "tw")))).select(*keys, "_y", "h", "th", "_line", F.explode(F.sequence(first, last)).alias("_t"))
    sides = F.array_compact(F.array(F.when(low == F.col("_y"), F.lit(0)), F.when(high == F.col("_y"), F.lit(1))))
    sent = near.select(*keys, "_t", share.alias("_share"), "_line", F.explode(sides).alias("_side"))
    pair = F.array_sort(F.collect_list(F.struct("_side", "_line")))
    met = sent.groupBy(*keys, "_t", "_share").agg(pair.alias("_two")).where(F.size("_two") == 2)
    s = F.col("_share")
    value = F.zip_with(F.col("_two")[0]["_line"], F.col("_two")[1]["_line"], lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct((a["value"] * (1 - s) + b["value"] * s).alias("value"))))
    out = met.select(*keys, F.posexplode(value).alias("x", "_v"), F.col("_t").alias("y")).where("_v is not null")
    return out.select(*keys, "x", "y", "_v.value")


def normalised(pixels: DataFrame, *keys: str, edge: int = 1024) -> DataFrame:
    """(keys, x, y, value) with long edges scaled down to ``edge``; smaller images stay as they are."""
    sizes = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    tw, th = fit_within(F.col("w"), F.col("h"), edge)
    large = sizes.where(F.greatest("w", "h") > edge).select(*keys, "w", "h", tw.alias("tw"), th.alias("th"))
    small = pixels.join(large.select(*keys), list(keys), "left_anti").select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "value")
    # means are fractions of the sizes: what lies on a tie but for the last bits of its sum is taken as one
    return small.unionByName(area(pixels, large, *keys).withColumn("value", clamp_byte(F.round("value", 9))))
