"""Receipts held against files by content hash, and re-measured numbers held against the recorded ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.functions import containers, rates
from frametally.operators import pixels as measures
from frametally.operators import resize

# What decoders may differ by.
SSIM, DELTA_E = 0.002, 0.1
DISTORTION = SSIM + 0.5 * DELTA_E / 2.3


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def match(receipts: DataFrame, files: DataFrame, key: str = "line") -> DataFrame:
    """receipts (key, asset, decision, source_hash, output_hash) with classification and verdict.

    files has (file_ord, name, hash).  Three left joins, each with one row for
    each hash or name (the first file in order), so receipts keep their number.
    """

    def first(by: Column, name: str) -> DataFrame:
        return files.groupBy(by.alias(name)).agg(F.min(F.struct("file_ord", "hash"))["hash"].alias(f"{name}_file"))

    joined = (
        receipts.withColumn("by_name", F.lower(basename(F.col("asset"))))
        .join(first(F.col("hash"), "output_hash"), "output_hash", "left")
        .join(first(F.col("hash"), "source_hash"), "source_hash", "left")
        .join(first(F.lower("name"), "by_name"), "by_name", "left")
    )
    encoded, out, src, named = F.col("decision") == "encoded", F.col("output_hash_file").isNotNull(), F.col("source_hash_file").isNotNull(), F.col("by_name_file").isNotNull()
    classification = F.when(~encoded, "not-applicable").when(out & src, "verifiable").when(out, "reference-missing").otherwise("file-missing")
    verdict = (
        F.when(encoded & out & src, None)
        .when(encoded & out, "unverifiable")
        .when(encoded & named, "refuted")
        .when(encoded, "unverifiable")
        .when(src, "pass")
        .when(named, "refuted")
        .otherwise("unverifiable")
    )
    return joined.select(key, "asset", "decision", classification.alias("classification"), verdict.alias("verdict"))


def within(recorded: dict[str, Column], measured: dict[str, Column]) -> Column:
    """Whether re-measured ssim, delta_e and distortion lie within the tolerances."""
    most = {"ssim": SSIM, "delta_e": DELTA_E, "distortion": DISTORTION}
    return F.forall(F.array(*[F.abs(recorded[k] - measured[k]) <= v for k, v in most.items()]), lambda x: x)


def verdict(output_hash_ok: Column, same_size: Column, metrics_ok: Column, reference_ok: Column) -> Column:
    """pass, refuted or unverifiable of an encoded receipt whose output and source are at hand."""
    return F.when(~output_hash_ok, "refuted").when(~same_size, "refuted").when(metrics_ok, "pass").when(~reference_ok, "unverifiable").otherwise("refuted")


def totals(matched: DataFrame) -> DataFrame:
    return matched.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "refuted", "unverifiable")], F.count_if(F.col("verdict").isNull()).alias("to_measure"), F.count(F.lit(1)).alias("entries"))


def exit_code(refuted: Column, unverifiable: Column) -> Column:
    return F.when(refuted > 0, 1).when(unverifiable > 0, 2).otherwise(0)


# ---- entries verified against files and their pixels

#: Where a source is looked for, first to last, below the root.
KEPT = ".frametally/sources/"


def located(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (line, asset, source_hash, output_hash, output_format, ...) with ``found`` (the path of a file with the
    source's hash, kept copies first), ``output_path`` and ``output_file`` (the hash of the file there, null: missing).

    files has (path, hash), a row for each path below the root.
    """

    def at(path: str, hash_: str) -> DataFrame:
        return files.groupBy(F.col("path").alias(path)).agg(F.min("hash").alias(hash_))

    asked = entries.withColumns({"_kept": F.concat(F.lit(KEPT), "asset"), "_plain": F.col("asset"), "output_path": containers.output_path(F.col("asset"), F.col("output_format"))})
    joined = asked.join(at("_kept", "_k"), "_kept", "left").join(at("_plain", "_p"), "_plain", "left").join(at("output_path", "output_file"), "output_path", "left")
    found = F.when(F.col("_k") == F.col("source_hash"), F.col("_kept")).when(F.col("_p") == F.col("source_hash"), F.col("_plain"))
    return joined.withColumn("found", found).drop("_kept", "_plain", "_k", "_p")


def _image_hash(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, hash) of images (keys, x, y, r, g, b): the SHA-256 of their opaque pixels row by row, without their size."""
    cell = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgb"], F.lit("FF"))
    rows = pixels.groupBy(*keys, "y").agg(F.array_join(F.array_sort(F.collect_list(F.struct("x", cell.alias("c"))))["c"], "").alias("row"))
    return rows.groupBy(*keys).agg(F.concat(F.lit("sha256:"), F.sha2(F.unhex(F.array_join(F.array_sort(F.collect_list(F.struct("y", "row")))["row"], "")), 256)).alias("hash"))


def remeasured(entries: DataFrame, pixels: DataFrame) -> DataFrame:
    """(line, source_w, source_h, output_w, output_h, reference_hash_now, ssim_now, delta_e_now, distortion_now) of entries whose
    source and output have pixels (hash, x, y, r, g, b).

    The reference is the source brought to the recorded size, never enlarged;
    the numbers are null where output and reference differ in size.
    """
    sizes = pixels.groupBy("hash").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))

    def of(side: str) -> DataFrame:
        return sizes.select(F.col("hash").alias(f"{side}_hash"), F.col("w").alias(f"{side}_w"), F.col("h").alias(f"{side}_h"))

    known = entries.select("line", "source_hash", "output_hash", "reference_w", "reference_h").join(of("source"), "source_hash").join(of("output"), "output_hash")
    fits = known.where("reference_w <= source_w and reference_h <= source_h")
    shown = fits.join(pixels.withColumnRenamed("hash", "source_hash"), "source_hash")
    same = F.expr("reference_w = source_w and reference_h = source_h")
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).cast("double").alias("value")) for c in "rgb"]))
    long = shown.where(~same).select("line", "x", "y", channels.alias("c")).select("line", "c.ch", "x", "y", "c.value")
    targets = fits.where(~same).select("line", F.explode(F.array(*map(F.lit, "rgb"))).alias("ch"), F.col("source_w").alias("w"), F.col("source_h").alias("h"), F.col("reference_w").alias("tw"), F.col("reference_h").alias("th"))
    small = resize.area(long, targets, "line", "ch").groupBy("line", "x", "y").agg(*[resize.clamp_byte(F.round(F.max(F.when(F.col("ch") == c, F.col("value"))), 9)).alias(c) for c in "rgb"])
    place = [F.col(c).cast("int").alias(c) for c in "xy"]
    reference = shown.where(same).select("line", *place, *[F.col(c).cast("double").alias(c) for c in "rgb"]).unionByName(small.select("line", *place, *"rgb"))
    output = fits.join(pixels.withColumnRenamed("hash", "output_hash"), "output_hash").where("output_w = reference_w and output_h = reference_h").select("line", *place, *[F.col(c).cast("double").alias(f"{c}2") for c in "rgb"])
    both = reference.withColumnsRenamed({c: f"{c}1" for c in "rgb"}).join(output, ["line", "x", "y"])
    lumas = both.select("line", "x", "y", *[measures.luma(*[F.col(f"{c}{i}") for c in "rgb"]).alias(n) for i, n in ((1, "a"), (2, "b"))])
    numbers = measures.ssim(lumas, "line").withColumnRenamed("ssim", "ssim_now").join(measures.delta_e(both, "line").select("line", F.col("mean").alias("delta_e_now")), "line")
    hashes = _image_hash(reference, "line").withColumnRenamed("hash", "reference_hash_now")
    out = known.select("line", "source_w", "source_h", "output_w", "output_h").join(hashes, "line", "left").join(numbers, "line", "left")
    return out.withColumn("distortion_now", F.when(F.col("ssim_now").isNotNull(), rates.distortion(F.least(F.lit(1.0), "ssim_now"), F.col("delta_e_now"))))


def verified(entries: DataFrame, files: DataFrame, pixels: DataFrame) -> DataFrame:
    """(line, asset, decision, verdict, reference_match, found, why) of every entry.

    Entries without an encode claim nothing and pass.  Of encodes the first that
    holds counts: a format that isn't decoded, no file with the source's hash, no
    output, an output of another hash, no pixels, a reference larger than the
    source, an output of another size; then numbers within what decoders may
    differ by pass, and others refute, unless the reference itself can't be made
    again.
    """
    placed = located(entries, files)
    c = F.col
    open_ = placed.where(containers.decodable(c("before_format")) & containers.decodable(c("output_format")) & c("found").isNotNull() & (c("output_file") == c("output_hash")))
    m = placed.join(remeasured(open_, pixels), "line", "left")
    encoded = (c("decision") == "encoded") & c("output_format").isNotNull() & c("ssim").isNotNull()
    match_ = c("reference_hash_now") == c("reference_hash")
    near = within({k: c(k) for k in ("ssim", "delta_e", "distortion")}, {k: c(f"{k}_now") for k in ("ssim", "delta_e", "distortion")})

    def told(verdict: str, why: str) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(why).alias("why"))

    outcome = (
        F.when(~F.coalesce(encoded, F.lit(False)), told("pass", "no encode to measure"))
        .when(~F.coalesce(containers.decodable(c("before_format")) & containers.decodable(c("output_format")), F.lit(False)), told("unverifiable", "format isn't decoded"))
        .when(c("found").isNull(), told("unverifiable", "source missing"))
        .when(c("output_file").isNull(), told("unverifiable", "output missing"))
        .when(c("output_hash").isNotNull() & (c("output_file") != c("output_hash")), told("refuted", "other output"))
        .when(c("source_w").isNull(), told("unverifiable", "no pixels"))
        .when((c("reference_w") > c("source_w")) | (c("reference_h") > c("source_h")), told("unverifiable", "reference larger than source"))
        .when((c("output_w") != c("reference_w")) | (c("output_h") != c("reference_h")), told("refuted", "output of another size"))
        .when(near & match_, told("pass", "measured again"))
        .when(near, told("pass", "measured again, reference differs"))
        .when(~match_, told("unverifiable", "numbers and reference differ"))
        .otherwise(told("refuted", "numbers differ"))
    )
    return m.withColumn("_o", outcome).select("line", "asset", "decision", "_o.verdict", F.when(c("found").isNotNull(), match_).alias("reference_match"), "found", "_o.why")


def for_display(reports: DataFrame) -> DataFrame:
    """Refuted entries first, then unverifiable ones, then passes, each in order of their lines."""
    rank = F.when(F.col("verdict") == "refuted", 0).when(F.col("verdict") == "unverifiable", 1).otherwise(2)
    return reports.orderBy(rank, "line")


def verification_totals(reports: DataFrame) -> DataFrame:
    """One row: entries by verdict and the exit code of them all."""
    t = reports.agg(F.count(F.lit(1)).alias("entries"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "refuted", "unverifiable")])
    return t.withColumn("exit_code", exit_code(F.col("refuted"), F.col("unverifiable")))
