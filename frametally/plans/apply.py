"""Receipts of decisions, written append-only, and plans that change nothing unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametally.sources import receipts

TOOL = "frametally@0.1"


def entries(planned: DataFrame, ts: str) -> DataFrame:
    """(asset, line): a receipt for each planned asset (asset, source_hash, output_hash, reference_w, reference_h,
    reference_hash, decision, reason, container, file_bytes, chosen_format, chosen_quality, chosen_bytes, ssim,
    delta_e, distortion, generations, quality, headroom); assets without a reference get none."""
    encoded = F.col("decision") == "encoded"
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    entry = F.struct(
        F.lit(1).alias("v"),
        F.lit(ts).alias("ts"),
        F.replace("asset", F.lit("\\"), F.lit("/")).alias("asset"),
        F.col("source_hash").alias("sourceHash"),
        F.when(encoded, F.col("output_hash")).alias("outputHash"),
        text.alias("sourceRecovered"),
        F.struct(F.col("reference_w").alias("w"), F.col("reference_h").alias("h"), F.col("reference_hash").alias("hash")).alias("reference"),
        "decision",
        F.when(~encoded, F.col("reason")).alias("reason"),
        F.when(encoded, F.struct(F.col("chosen_format").alias("format"), F.col("chosen_quality").alias("quality"), F.col("chosen_bytes").alias("bytes"))).alias("output"),
        F.struct(F.col("container").alias("format"), F.col("file_bytes").alias("bytes")).alias("before"),
        F.when(encoded, F.struct("ssim", F.col("delta_e").alias("deltaE"), "distortion")).alias("metrics"),
        number.alias("weight"),
        number.alias("lambda"),
        F.struct("generations", F.col("quality").alias("estimatedOriginalQuality"), "headroom").alias("provenance"),
        text.alias("encoder"),
        F.lit(TOOL).alias("tool"),
    )
    return planned.where("reference_hash is not null").select("asset", receipts.to_json(entry).alias("line"))


def append(lines: DataFrame, path: str, confirm: bool = False) -> int:
    """Appends receipts under path and returns how many there are; without ``confirm`` nothing is written."""
    n = lines.count()
    if confirm and n:
        lines.select("line").write.mode("append").text(path)
    return n
