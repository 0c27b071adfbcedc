"""Provenance records: what is known of an image's past, with the evidence in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.functions import rates
from frametally.operators import headers, resize, spectrum
from frametally.operators import pixels as measures
from frametally.operators.decide import headroom

#: Below this share of the resolution that its spectrum can certify an image counts as enlarged.
UPSCALED = 0.625
#: Shorter edges have no spectrum to go by.
LEAST = 16


def _pair(w: Column, h: Column) -> Column:
    return F.concat(w.cast("string"), F.lit("x"), h.cast("string"))


def records(images: DataFrame) -> DataFrame:
    """images (container, width, height, quality, encoder, subsampling, generations, seams, effective_w, effective_h,
    certified_w, certified_h, p95, said) with blocking_score, upscaled, softness, headroom, reasons and evidence.

    seams is the ratio of :func:`frametally.operators.pixels.blocking`; quality,
    encoder, subsampling and generations are null but for JPEGs; sizes are those
    of :func:`frametally.operators.spectrum.resolution`, null where there is no
    spectrum; a null p95 has softness unknown.  ``said`` is an array of what the
    header gave, told after the container.
    """
    c = F.col
    long_edge, short_edge = F.greatest("width", "height"), F.least("width", "height")
    measured = (short_edge >= LEAST) & c("effective_w").isNotNull() & c("certified_w").isNotNull()
    upscaled = F.coalesce(measured & (F.greatest("effective_w", "effective_h") < UPSCALED * F.greatest("certified_w", "certified_h")), F.lit(False))
    softness = F.coalesce(F.when(c("p95").isNotNull(), rates.softness(c("p95"), long_edge)), F.lit("unknown"))
    out = images.withColumns({"blocking_score": rates.blocking_score(c("seams")), "upscaled": upscaled, "softness": softness})
    out = out.withColumn("_room", headroom(c("container"), c("generations"), c("quality"), c("blocking_score")))
    size = _pair(c("effective_w"), c("effective_h"))
    told = F.array(
        F.when(c("generations").isNotNull(), F.concat(F.lit("encode generations "), c("generations").cast("string"))),
        F.concat(F.lit("seams score "), F.format_string("%.4f", c("blocking_score"))),
        F.when(~measured, F.lit("no spectrum to go by")).when(c("upscaled"), F.concat(F.lit("enlarged from "), size)).otherwise(F.concat(F.lit("detail up to "), size)),
        F.concat(F.lit("softness "), "softness"),
        F.concat(F.lit("headroom "), c("_room.headroom"), F.lit(": "), F.array_join(c("_room.reasons"), "; ")),
    )
    first = F.array(F.concat(F.lit("container "), "container", F.lit(", "), _pair(c("width"), c("height"))))
    evidence = F.array_compact(F.concat(first, F.coalesce("said", F.array().cast("array<string>")), told))
    return out.select(*images.columns, "blocking_score", "upscaled", "softness", c("_room.headroom").alias("headroom"), c("_room.reasons").alias("reasons"), evidence.alias("evidence"))


def measured(pixels: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """Records of images whose pixels (keys, x, y, value) and files (keys, content) are at hand.

    Seams, spectrum and sharpness are measured on the pixels, quality and
    encoder read from the header, and generations counted with the steps of the
    file's luma table.  Images without a file count as PNG; files without pixels
    give no record.
    """
    on = list(keys)
    opened = headers.read(files.join(pixels.select(*keys).distinct(), on, "left_semi"))
    # a block meets its file's table whole and is told apart afterwards: what an explode makes of arrays isn't seen in
    # estimates of sizes, by which all coefficients of all images would be sent to the driver as a small side of the join.
    # No table is one of nulls, whose bands have no levels: a filter on it would parse the headers of all files first
    steps = F.coalesce("luma.values", F.array_repeat(F.lit(None).cast("int"), 64))
    tables = opened.select(*keys, steps.alias("_steps")).hint("merge")
    bands = measures.coefficients(measures.blocks(pixels, *keys).join(tables, on), *keys, "_steps")
    histogram = measures.quantised_histogram(bands, measures.table_step(F.col("_steps")), *keys)
    generations = measures.generations(measures.periodicity(histogram, *keys), *keys).select(*keys, "generations")
    seams = measures.blocking(pixels, *keys).select(*keys, F.col("combined").alias("seams"))
    sharp = measures.laplacian(resize.normalised(pixels, *keys), *keys).select(*keys, "p95")
    known = spectrum.resolution(pixels, *keys).join(seams, on).join(sharp, on, "left").join(generations, on, "left")
    read = opened.select(*keys, "container", headers.notes(pixels=True).alias("said"), F.col("fit.quality").alias("quality"), F.col("fit.encoder").alias("encoder"), "subsampling")
    out = known.withColumnsRenamed({"w": "width", "h": "height"}).join(read, on, "left").withColumn("container", F.coalesce("container", F.lit("png")))
    return records(out.withColumn("generations", F.when(F.col("container") == "jpeg", F.col("generations"))))
