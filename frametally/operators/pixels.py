"""Pixel measures as grouped expressions over exploded pixels, and spectra from them.

Pixels are rows (keys, x, y, value) for luma or (keys, x, y, r, g, b); every
measure is an aggregate, so images of any size spread over tasks and only
per-window sums are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
EPS = 1e-6
BINS = 64


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def ssim(pairs: DataFrame, *keys: str, window: int = 8) -> DataFrame:
    """(keys, ssim): mean structural similarity of columns a and b over windows that don't overlap."""
    w = pairs.withColumns({"wx": F.floor(F.col("x") / window), "wy": F.floor(F.col("y") / window)})
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    sums = w.groupBy(*keys, "wx", "wy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.col("b") * F.col("b")).alias("sbb"), F.sum(F.col("a") * F.col("b")).alias("sab")
    )
    ma, mb = sa / n, sb / n
    va, vb, cov = F.col("saa") / n - ma * ma, F.col("sbb") / n - mb * mb, F.col("sab") / n - ma * mb
    each = ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))
    return sums.withColumn("s", each).groupBy(*keys).agg(F.avg("s").alias("ssim"))


def linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of sRGB channels in 0..255."""
    lr, lg, lb = linear(r), linear(g), linear(b)

    def f(t: Column) -> Column:
        return F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)

    fx = f((0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047)
    fy = f(0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb)
    fz = f((0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def delta_e(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean, p95) of the colour distance of (r1, g1, b1) and (r2, g2, b2); p95 is the nearest rank."""
    one, two = lab(F.col("r1"), F.col("g1"), F.col("b1")), lab(F.col("r2"), F.col("g2"), F.col("b2"))
    distance = F.sqrt(sum(((p - q) * (p - q) for p, q in zip(one, two)), F.lit(0.0)))
    return pairs.withColumn("d", distance).groupBy(*keys).agg(F.avg("d").alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY d)").alias("p95"))


def blocking(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, horizontal, vertical, combined): mean gradient across multiples of eight over that elsewhere; axes under 17 pixels give 1."""
    dx = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*keys, "y").orderBy("x")))
    dy = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*keys, "x").orderBy("y")))
    g = pixels.withColumns({"dx": dx, "dy": dy})

    def axis(d: str, at: str) -> Column:
        edge, rest = F.avg(F.when(F.col(at) % 8 == 0, F.col(d))), F.avg(F.when(F.col(at) % 8 != 0, F.col(d)))
        return F.when(F.max(at) + 1 < 17, 1.0).otherwise((F.coalesce(edge, F.lit(0.0)) + EPS) / (F.coalesce(rest, F.lit(0.0)) + EPS))

    out = g.groupBy(*keys).agg(axis("dx", "x").alias("horizontal"), axis("dy", "y").alias("vertical"))
    return out.withColumn("combined", (F.col("horizontal") + F.col("vertical")) / 2)


def laplacian(pixels: DataFrame, *keys: str, tile: int = 64, least: int = 16) -> DataFrame:
    """(keys, p95, tiles): 95th percentile (linear) of the tiles' variance of the 3x3 Laplacian's interior.

    Partial tiles count from ``least`` pixels on both axes; where no tile does, the whole is one.
    """
    row, col = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    v = F.col("value")
    around = F.lag(v).over(row) + F.lead(v).over(row) + F.lag(v).over(col) + F.lead(v).over(col)
    edge = pixels.withColumn("l", around - 4 * v).where("l is not null")
    tiles = edge.withColumns({"tx": F.floor((F.col("x") - 1) / tile), "ty": F.floor((F.col("y") - 1) / tile)}).groupBy(*keys, "tx", "ty").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l").alias("s"), F.sum(F.col("l") * F.col("l")).alias("ss"), F.countDistinct("x").alias("w"), F.countDistinct("y").alias("h")
    )
    big = (F.col("w") >= least) & (F.col("h") >= least)
    var = F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")))
    all_n, all_s, all_ss = F.sum("n"), F.sum("s"), F.sum("ss")
    whole = F.greatest(F.lit(0.0), all_ss / all_n - (all_s / all_n) * (all_s / all_n))
    out = tiles.withColumn("v", F.when(big, var)).groupBy(*keys).agg(F.expr("percentile(v, 0.95)").alias("tiled"), F.count("v").alias("full"), whole.alias("whole"))
    return out.select(*keys, F.coalesce("tiled", "whole").alias("p95"), F.greatest(F.lit(1), "full").alias("tiles"))


#: The orthonormal transform of eight samples: a row for each frequency.
COSINES = np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.125), 0.5)[:, None]


def _transform(inverse: bool = False):
    """A function of a block's 64 samples, row by row, that gives its coefficients v by v, or of those that gives the samples.

    Nulls count as 0; a block of nulls only stays so.
    """
    left = COSINES.T if inverse else COSINES

    @F.arrow_udf("array<double>")
    def transformed(blocks: pa.Array) -> pa.Array:
        flat = blocks.flatten()
        empty = ~flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, 64).any(axis=1)
        values = left @ flat.fill_null(0.0).to_numpy().reshape(-1, 8, 8) @ left.T
        return pa.ListArray.from_arrays(pa.array(np.arange(len(blocks) + 1, dtype=np.int32) * 64), pa.array(values.ravel(), pa.float64(), mask=np.repeat(empty, 64)))

    return transformed


def _gathered(rows: DataFrame, at: Column, value: Column, *by: str) -> DataFrame:
    """(by, n, values): the number of rows, and an array of the sums of value where at is 0 to 63, null where there is none.

    What a task holds is 64 sums a block, before the shuffle and after it, however many rows are made of a block elsewhere.
    """
    rows = rows.select(*by, at.alias("_at"), value.alias("_value"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("_at") == i, F.col("_value"))).alias(f"_{i}") for i in range(64)])
    return sums.select(*by, "n", F.array(*[f"_{i}" for i in range(64)]).alias("values"))


def blocks(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, block_x, block_y, samples) of every full 8x8 block: its levels row by row, shifted by 128."""
    cut = pixels.withColumns({"block_x": F.floor(F.col("x") / 8), "block_y": F.floor(F.col("y") / 8)})
    at = F.pmod("y", F.lit(8)) * 8 + F.pmod("x", F.lit(8))
    return _gathered(cut, at, F.col("value") - 128, *keys, "block_x", "block_y").where("n = 64").drop("n").withColumnRenamed("values", "samples")


def coefficients(blocks: DataFrame, *keys: str, samples: str = "samples") -> DataFrame:
    """(keys, block_x, block_y, u, v, coefficient) of blocks of samples."""
    each = blocks.withColumn("_c", _transform()(F.col(samples))).select(*keys, "block_x", "block_y", F.posexplode("_c").alias("_at", "coefficient"))
    return each.select(*keys, "block_x", "block_y", (F.col("_at") % 8).cast("long").alias("u"), F.expr("_at div 8").alias("v"), "coefficient")


def dct_blocks(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, block_x, block_y, u, v, coefficient) of every full 8x8 block, levels shifted by 128."""
    return coefficients(blocks(pixels, *keys), *keys)


def _pixels(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, value) of blocks of samples."""
    each = blocks.select(*keys, "block_x", "block_y", F.posexplode("samples").alias("_at", "_value"))
    return each.select(*keys, (F.col("block_x") * 8 + F.col("_at") % 8).alias("x"), (F.col("block_y") * 8 + F.expr("_at div 8")).alias("y"), (F.col("_value") + 128).alias("value"))


def pixels_of(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, value) of blocks of coefficients, the inverse of :func:`dct_blocks`: a coefficient
    without a row is 0, a block without rows gives no pixels."""
    by = [*keys, "block_x", "block_y"]
    whole = _gathered(blocks, F.col("v") * 8 + F.col("u"), F.col("coefficient"), *by)
    return _pixels(whole.select(*by, _transform(inverse=True)(F.col("values")).alias("samples")), *keys)


def _requantised(c: Column, step: Column) -> Column:
    return step * half_up(F.round(c, 6) / step)


def requantised(blocks: DataFrame, step: Column) -> DataFrame:
    """Blocks whose coefficients are the nearest multiples of step, a column over u and v, at least 1."""
    return blocks.withColumn("coefficient", _requantised(F.col("coefficient"), step))


def table_step(table: Column) -> Column:
    """The step of u and v in a table of 64 in natural order."""
    return F.element_at(table, (F.col("v") * 8 + F.col("u") + 1).cast("int")).cast("double")


def _tables(spark: SparkSession, steps: tuple[Column, ...]) -> DataFrame:
    """One row of arrays of 64 (_0, _1, ...), v by v: the values of columns over u and v."""
    cells = spark.range(64, numPartitions=1).select("id", (F.col("id") % 8).alias("u"), F.expr("id div 8").alias("v"))
    cells = cells.select("id", *[s.cast("double").alias(f"_{i}") for i, s in enumerate(steps)])
    return cells.agg(*[F.transform(F.array_sort(F.collect_list(F.struct("id", F.col(f"_{i}").alias("s")))), lambda c: c["s"]).alias(f"_{i}") for i in range(len(steps))])


def encoded_blocks(blocks: DataFrame, steps: tuple[Column, ...], out: str = "samples") -> DataFrame:
    """Blocks with the samples (in the column out) that an encode and a decode with each of steps in turn,
    columns over u and v, leave; levels are whole and lie in 0..255 after each."""
    columns = [F.col(c) for c in blocks.columns if c != out]
    coded = blocks.withColumn("_samples", F.col("samples")).crossJoin(F.broadcast(_tables(blocks.sparkSession, steps)))
    for i in range(len(steps)):
        coded = coded.withColumn("_c", _transform()(F.col("_samples")))
        coded = coded.withColumn("_c", F.zip_with("_c", f"_{i}", _requantised))
        coded = coded.withColumn("_samples", _transform(inverse=True)(F.col("_c")))
        coded = coded.withColumn("_samples", F.transform("_samples", lambda s: F.least(F.lit(255.0), F.greatest(F.lit(0.0), half_up(F.round(s + 128, 6)).cast("double"))) - 128))
    return coded.select(*columns, F.col("_samples").alias(out))


def encoded(pixels: DataFrame, *keys: str, steps: tuple[Column, ...]) -> DataFrame:
    """(keys, x, y, value): what is left after an encode and a decode with each of steps in turn.

    Values are whole and lie in 0..255 after each.  Blocks that aren't full are
    left out.  One shuffle in all, however many encodes there are.
    """
    return _pixels(encoded_blocks(blocks(pixels, *keys), steps), *keys)


def half_up(x: Column) -> Column:
    """Rounding half towards plus infinity."""
    return F.floor(x + 0.5)


def quantised_histogram(blocks: DataFrame, step: Column, *keys: str, most: int = 40) -> DataFrame:
    """(keys, u, v, level, n): counts of |round(coefficient / step)| in 1..most for each band but the mean."""
    level = F.abs(half_up(F.col("coefficient") / step)).cast("long")
    return blocks.where("u + v > 0").withColumn("level", level).where(F.col("level").between(1, most)).groupBy(*keys, "u", "v", "level").agg(F.count(F.lit(1)).alias("n"))


def periodicity(histograms: DataFrame, *keys: str, most: int = 40) -> DataFrame:
    """(keys, u, v, samples, score): peak over upper median of the detrended log histogram's spectrum (bins 3..20)."""
    hist = histograms.groupBy(*keys, "u", "v").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("h"), F.sum("n").alias("samples"))
    logs = F.expr(f"transform(sequence(1L, {most}L), k -> log1p(double(coalesce(h[k], 0))))")
    flat = F.expr(f"transform(g, (x, i) -> x - aggregate(slice(g, greatest(1, i - 1), least({most}, i + 3) - greatest(1, i - 1) + 1), 0D, (s, y) -> s + y, s -> s) / (least({most}, i + 3) - greatest(1, i - 1) + 1))")
    power = F.expr(
        f"transform(sequence(3, 20), k -> pow(aggregate(transform(f, (x, i) -> x * cos(2 * pi() * k * i / {most})), 0D, (s, y) -> s + y), 2) + pow(aggregate(transform(f, (x, i) -> x * sin(2 * pi() * k * i / {most})), 0D, (s, y) -> s + y), 2))"
    )
    spectrum = hist.withColumn("g", logs).withColumn("f", flat).withColumn("p", F.array_sort(power))
    median = F.expr("p[size(p) div 2]")
    peak = F.expr("element_at(p, -1)")
    score = F.when(median > 0, peak / median).when(peak > 0, F.lit(float("inf"))).otherwise(0.0)
    return spectrum.select(*keys, "u", "v", "samples", score.alias("score"))


def generations(bands: DataFrame, *keys: str, least_samples: int = 128, least_bands: int = 3, periodic: float = 50.0) -> DataFrame:
    """(keys, usable, periodic, generations, confidence) from the bands' periodicity: 2 if two bands or more
    repeat, 1 if none does, null where one does or too few can be used."""
    ok = F.col("samples") >= least_samples
    out = bands.groupBy(*keys).agg(F.count_if(ok).alias("usable"), F.count_if(ok & (F.col("score") >= periodic)).alias("periodic"))
    few, p = F.col("usable") < least_bands, F.col("periodic")
    return out.withColumn("generations", F.when(few, None).when(p >= 2, 2).when(p == 0, 1)).withColumn(
        "confidence", F.when(few, None).when(p >= 2, F.least(F.lit(1.0), 0.3 + 0.7 * p / F.col("usable"))).when(p == 0, 0.7)
    )
