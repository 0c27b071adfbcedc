"""What the first bytes of an image file tell: container, frame, quality, encoder and headroom, with the evidence in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametally.functions import containers
from frametally.operators import quant
from frametally.operators.decide import headroom
from frametally.sources.images import HEAD, jpeg_header

JPEG_FIELDS = ("width", "height", "bits", "progressive", "truncated")


def read(files: DataFrame) -> DataFrame:
    """files (..., content) with container, header, luma, chroma, subsampling and fit; of each file 64 KB are looked at."""
    head = F.substring("content", 1, HEAD)
    kind = containers.sniff(head, "probe")
    opened = files.withColumn("container", kind).withColumn("header", F.when(F.col("container") == "jpeg", jpeg_header(head)))
    bound = quant.bound_tables("header.tables", "header.components")
    tables = opened.withColumn("_b", bound).withColumns({"luma": F.col("_b.luma"), "chroma": F.col("_b.chroma")}).drop("_b")
    subsampling = quant.subsampling(F.col("header.components"))
    fit = quant.pair_fit(quant.registry(files.sparkSession))
    return tables.withColumns({"subsampling": subsampling, "fit": fit(F.col("luma"), F.col("chroma"))})


def notes(*, pixels: bool = False):
    """The evidence of a header as an array of strings, columns as :func:`read` gives them; without ``pixels`` it says that generations are unknown."""
    c = F.col
    jpeg, tables = c("container") == "jpeg", c("luma").isNotNull()
    precision = [F.coalesce(c(f"{t}.precision"), F.lit(0)) for t in ("luma", "chroma")]
    signed = [F.concat(F.lit(f"{t} "), F.when(p == 0, quant.signature(c(f"{t}.values"), 0)).otherwise(quant.signature(c(f"{t}.values"), 1))) for t, p in zip(("luma", "chroma"), precision)]
    fit = F.concat(
        F.lit("tables fit "), c("fit.family"), F.lit(" at quality "), c("fit.quality").cast("string"),
        F.when(c("fit.exact"), F.lit(" exactly")).otherwise(F.format_string(" with deviation %.4f", c("fit.fit"))),
    )
    said = F.array(
        F.when(c("container").isNull(), F.lit("no known container")).when(~jpeg, F.concat(F.lit("only the name of container "), "container", F.lit(" is known"))),
        F.when(jpeg & c("header.truncated"), F.lit("header cut short")),
        F.when(jpeg, F.concat(F.lit("chroma subsampling "), "subsampling")),
        F.when(jpeg & ~tables, F.lit("no quantisation tables")).when(jpeg & c("fit.quality").isNotNull(), fit).when(jpeg, F.concat(F.lit("tables of no known family: "), F.concat_ws(", ", *signed))),
        F.when(jpeg, F.concat(F.lit("encoder "), "fit.encoder")),
        F.lit(None).cast("string") if pixels else F.when(jpeg, F.lit("generations are unknown without pixels")),
    )
    return F.array_compact(said)


def evidence(files: DataFrame, key: str) -> DataFrame:
    """(key, container, width, height, bits, progressive, truncated, subsampling, quality, family, encoder, generations, headroom, evidence).

    From bytes alone, so generations are null and headroom goes by quality;
    containers other than JPEG have their name only, and no known one nulls.
    """
    known = read(files)
    room = headroom(F.col("container"), F.lit(None).cast("int"), F.col("fit.quality"), F.lit(0.0))
    jpeg = F.col("container") == "jpeg"
    said = F.when(jpeg, F.concat(notes(), F.array(F.concat(F.lit("headroom "), room["headroom"], F.lit(": "), F.array_join(room["reasons"], "; "))))).otherwise(notes())
    return known.select(
        key, "container", *[F.col(f"header.{f}").alias(f) for f in JPEG_FIELDS], "subsampling", F.col("fit.quality").alias("quality"), F.col("fit.family").alias("family"),
        F.col("fit.encoder").alias("encoder"), F.lit(None).cast("int").alias("generations"), F.when(jpeg, room["headroom"]).alias("headroom"), said.alias("evidence"),
    )
