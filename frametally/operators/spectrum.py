"""Radial power spectra of luma planes of any size, and the resolution up to which they hold detail.

A plane is brought to a square of 256, 512 or 1,024 and transformed one axis at
a time: rows are resampled, windowed and transformed on their own, then blocks
of their columns.  Resampling down a column and transforming along a row change
places freely, so no image is ever one row of a table: the most that a task
holds is one row of pixels, or a few columns.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, LEAST = 64, 16
#: Columns of the transformed rows that are transformed together.
COLUMNS = 16
# A ring counts from this share of the largest whitened one, which is looked for from the third ring on,
# and below this power there is nothing to see.
THRESHOLD, GUARD, NOTHING = 0.4, 3, 1e-6


def analysis_size(long_edge: Column) -> Column:
    return F.when(long_edge <= 256, 256).when(long_edge <= 512, 512).otherwise(1024)


@lru_cache(maxsize=64)
def resampling(size: int, target: int) -> np.ndarray:
    """(target, size): the mean of what a target covers where it shrinks, between the two nearest where it stretches."""
    out = np.zeros((target, size))
    ratio, t = size / target, np.arange(target)
    if size > target:
        at = np.arange(size)
        out = np.clip(np.minimum(at + 1, (t[:, None] + 1) * ratio) - np.maximum(at, t[:, None] * ratio), 0, None) / ratio
    else:
        place = np.clip((t + 0.5) * ratio - 0.5, 0, size - 1)
        low = np.floor(place).astype(int)
        np.add.at(out, (t, low), 1 - (place - low))
        np.add.at(out, (t, np.minimum(low + 1, size - 1)), place - low)
    return out


@lru_cache(maxsize=8)
def _window(n: int) -> tuple[np.ndarray, np.ndarray]:
    w = np.hanning(n)
    return w, np.fft.fft(w)


def rows_transformed(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, w, h, n, y, re, im): the resampled, windowed and transformed rows of images of 16 pixels or more on both edges.

    Pixels (keys, x, y, value) that are missing count as 0; re and im hold
    frequencies 0..n/2.
    """
    sizes = pixels.groupBy(*keys).agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    sizes = sizes.where(F.least("w", "h") >= LEAST).withColumn("n", analysis_size(F.greatest("w", "h")))
    rows = pixels.groupBy(*keys, F.col("y").cast("int").alias("y")).agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("v"))).alias("p"))
    kind = pa.struct([("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<re:array<double>,im:array<double>>")
    def transformed(xs: pa.Array, values: pa.Array, widths: pa.Array, targets: pa.Array) -> pa.Array:
        out = []
        for x, v, w, n in zip(xs, values, widths.to_pylist(), targets.to_pylist()):
            row = np.zeros(w)
            np.add.at(row, x.values.to_numpy(), v.values.to_numpy())
            f = np.fft.rfft((resampling(w, n) @ row) * _window(n)[0])
            out.append({"re": f.real, "im": f.imag})
        return pa.array(out, kind)

    joined = rows.join(sizes, list(keys))
    f = transformed(*map(F.col, ("p.x", "p.v", "w", "n")))
    return joined.withColumn("f", f).select(*keys, "w", "h", "n", "y", "f.re", "f.im")


def _columns(ys: pa.Scalar, parts: pa.Scalar, h: int) -> np.ndarray:
    """(h, columns) of rows given by their places; rows that are missing are 0."""
    flat = parts.values
    out = np.zeros((h, len(flat[0]) if len(flat) else 0))
    out[ys.values.to_numpy()] = flat.flatten().to_numpy().reshape(len(flat), -1)
    return out


def spectra(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, w, h, n, spectrum): mean power in 64 rings up to the Nyquist radius, of the plane less its windowed mean."""
    rows = rows_transformed(pixels, *keys)
    size = [*keys, "w", "h", "n"]

    @F.arrow_udf("double")
    def mean(ys: pa.Array, sums: pa.Array, heights: pa.Array, targets: pa.Array) -> pa.Array:
        out = []
        for y, s, h, n in zip(ys, sums, heights.to_pylist(), targets.to_pylist()):
            w, column = _window(n)[0], np.zeros(h)
            column[y.values.to_numpy()] = s.values.to_numpy()
            out.append(float(w @ (resampling(h, n) @ column)) / w.sum() ** 2)
        return pa.array(out, pa.float64())

    dc = rows.groupBy(*size).agg(F.collect_list(F.struct("y", F.element_at("re", 1).alias("s"))).alias("d"))
    means = dc.select(*keys, mean(*map(F.col, ("d.y", "d.s", "h", "n"))).alias("mean"))

    @F.arrow_udf("struct<power:array<double>,cells:array<double>>")
    def rings(block: pa.Array, ys: pa.Array, re: pa.Array, im: pa.Array, heights: pa.Array, targets: pa.Array, means: pa.Array) -> pa.Array:
        out = []
        for b, y, r, i, h, n, mu in zip(block.to_pylist(), ys, re, im, heights.to_pylist(), targets.to_pylist(), means.to_pylist()):
            w, wf = _window(n)
            plane = resampling(h, n) @ (_columns(y, r, h) + 1j * _columns(y, i, h))
            kx = b * COLUMNS + np.arange(plane.shape[1])
            f = np.fft.fft(plane * w[:, None], axis=0) - mu * wf[:, None] * wf[kx]
            radius = np.hypot(np.fft.fftfreq(n)[:, None], kx / n)
            inside = radius <= 0.5
            ring = np.minimum((radius[inside] / 0.5 * BINS).astype(int), BINS - 1)
            # of a real plane, columns beyond the middle mirror those before it
            times = np.broadcast_to(np.where((kx == 0) | (kx == n // 2), 1.0, 2.0), radius.shape)[inside]
            out.append({"power": np.bincount(ring, (np.abs(f) ** 2)[inside] * times, BINS), "cells": np.bincount(ring, times, BINS)})
        return pa.array(out, pa.struct([("power", pa.list_(pa.float64())), ("cells", pa.list_(pa.float64()))]))

    blocks = F.sequence(F.lit(0), F.floor(F.col("n") / 2 / COLUMNS).cast("int"))
    cut = [F.slice(c, F.col("block") * COLUMNS + 1, F.lit(COLUMNS)).alias(c) for c in ("re", "im")]
    parts = rows.withColumn("block", F.explode(blocks)).select(*size, "block", "y", *cut)
    columns = parts.groupBy(*size, "block").agg(F.collect_list(F.struct("y", "re", "im")).alias("c")).join(means, list(keys))
    summed = columns.select(*size, rings(*map(F.col, ("block", "c.y", "c.re", "c.im", "h", "n", "mean"))).alias("r"))
    by_ring = summed.select(*size, F.posexplode(F.arrays_zip("r.power", "r.cells")).alias("bin", "z")).groupBy(*size, "bin").agg((F.sum("z.power") / F.greatest(F.sum("z.cells"), F.lit(1.0))).alias("p"))
    return by_ring.groupBy(*size).agg(F.array_sort(F.collect_list(F.struct("bin", "p")))["p"].alias("spectrum"))


def cutoff(spectrum: Column) -> Column:
    """Share of the analysis plane's Nyquist radius up to which there is detail: rings are whitened by their squared
    radius, and the last one over THRESHOLD of the largest counts; null where there is nothing to see."""
    white = F.transform(spectrum, lambda p, b: p * (b + 0.5) * (b + 0.5))
    top = F.array_max(F.slice(white, GUARD + 1, BINS - GUARD))
    last = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda b: F.get(white, b) > THRESHOLD * top))
    return F.when(F.array_max(F.slice(spectrum, 2, BINS - 1)) > NOTHING, (F.coalesce(last, F.lit(1)) + 1) / BINS)


def resolution(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, w, h, share, effective_w, effective_h, certified_w, certified_h) of every image.

    ``share`` is of the declared Nyquist radius; a plane of 1,024 can't certify
    more than that of a larger image.  Planes without content have 1/64; images
    with an edge below 16 pixels have nulls.
    """
    sizes = pixels.groupBy(*keys).agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    known = spectra(pixels, *keys).select(*keys, "n", cutoff(F.col("spectrum")).alias("cut"))
    found = sizes.join(known, list(keys), "left")
    edge = F.greatest("w", "h")
    share = F.when(F.col("cut").isNotNull(), F.least(F.lit(1.0), F.col("cut") * F.col("n") / edge)).when(F.col("n").isNotNull(), 1.0 / BINS)
    scale = F.when(F.col("n").isNotNull(), F.least(F.lit(1.0), F.col("n") / edge))
    rounded = {f"{kind}_{s}": F.floor(F.col(s) * by + 0.5).cast("int") for kind, by in (("effective", F.col("share")), ("certified", scale)) for s in "wh"}
    return found.withColumn("share", share).select(*keys, "w", "h", "share", *[c.alias(k) for k, c in rounded.items()])
