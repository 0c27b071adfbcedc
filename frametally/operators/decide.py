"""What becomes of each asset: headroom, decisions, accepted replacements, recoverable bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.operators.hull import FLOOR, FLOOR_ABOVE_FOLD, LOW_MARGIN, hull_of

#: From this blocking score on, lossless pixels once were a JPEG.
LAUNDERED = 1 / 3
#: A re-encode in the same format must save this share.
NO_OP = 0.05
# Fixed values of the recoverable-bytes model: share of the bytes a better format saves.
FORMAT_SAVES = {"jpeg": 0.25, "png_photo": 0.65, "png": 0.18, "webp": 0.15, "gif": 0.65}
QUALITY_SLACK = ((95, 0.3), (90, 0.2), (85, 0.1))


def headroom(container: Column, generations: Column, quality: Column, blocking: Column) -> Column:
    """struct(headroom, reasons): how much quality is left to spend."""
    exhausted = F.array_compact(
        F.array(
            F.when(generations >= 2, F.concat(F.lit("at least "), generations.cast("string"), F.lit(" encode generations"))),
            F.when(quality < 60, F.concat(F.lit("quality "), quality.cast("string"), F.lit(" is below 60"))),
            F.when(container.isin("png", "gif") & (blocking >= LAUNDERED), F.lit("lossless container with jpeg seams")),
        )
    )
    low = F.array(F.concat(F.lit("quality "), quality.cast("string"), F.lit(" is below 78")))
    return (
        F.when(F.size(exhausted) > 0, F.struct(F.lit("none").alias("headroom"), exhausted.alias("reasons")))
        .when(quality < 78, F.struct(F.lit("low").alias("headroom"), low.alias("reasons")))
        .otherwise(F.struct(F.lit("normal").alias("headroom"), F.array(F.lit("no exhaustion evidence")).alias("reasons")))
    )


def skip_class(container: Column, classification: Column) -> Column:
    """The class an asset is skipped as; an explicit class wins over what the container implies; null: not skipped."""
    known = F.coalesce(classification, F.when(container == "svg", "vector").when(container == "gif", "animated"))
    return F.when(known.isin("vector", "animated", "icon"), known)


def floor_for(above_fold: Column, room: Column) -> Column:
    base = F.when(above_fold, F.lit(FLOOR_ABOVE_FOLD)).otherwise(F.lit(FLOOR))
    return F.when(room == "low", F.least(F.lit(1.0), base + LOW_MARGIN)).otherwise(base)


#: Of judged assets, those whose decision needs candidates.
_OPEN = "skip is null and room <> 'none'"


def _judged(assets: DataFrame) -> DataFrame:
    room = headroom(F.col("container"), F.col("generations"), F.col("quality"), F.col("blocking_score"))
    return assets.withColumn("room", room["headroom"]).withColumn("skip", skip_class(F.col("container"), F.col("classification")))


def to_measure(assets: DataFrame) -> DataFrame:
    """The assets that neither their class nor exhausted headroom settles before a sweep."""
    return _judged(assets).where(_OPEN).select(*assets.columns)


def decide(assets: DataFrame, candidates: DataFrame, key: str = "asset_id") -> DataFrame:
    """assets (key, container, classification, generations, quality, blocking_score, above_fold)
    with decision, tag, format, bytes and saved.

    Order: class skip, refusal, nothing measured, floors, choice, keep-original,
    no-op guard.  Refused and skipped assets are settled before any candidate
    is looked at, so their candidates aren't shuffled.
    """
    judged = _judged(assets)
    judged = judged.withColumn("floor", floor_for(F.col("above_fold"), F.col("room")))
    open_ = judged.where(_OPEN).select(key, "floor")
    measured = (
        candidates.join(open_, key)
        .groupBy(key)
        .agg(
            F.collect_list(F.when(F.col("ssim") >= F.col("floor"), F.struct("bytes", "distortion", "ord", "format", "quality", "ssim"))).alias("points"),
            F.min(F.when(F.col("format") == "keep-original", F.struct("ord", "bytes")))["bytes"].alias("original"),
        )
        .withColumn("chosen", F.get(hull_of(), F.lit(0)))
        .select(key, "chosen", "original", F.lit(True).alias("measured"))
    )
    saved = (F.col("original") - F.col("chosen.bytes")) / F.col("original")
    tag = (
        F.when(F.col("skip").isNotNull(), "skipped-class")
        .when(F.col("room") == "none", "refused")
        .when(F.col("measured").isNull(), "skipped-unmeasured")
        .when(F.col("chosen").isNull(), "kept-below-floor")
        .when(F.col("chosen.format") == "keep-original", "kept-original")
        .when((F.col("original") > 0) & (saved < NO_OP) & (F.col("chosen.format") == F.col("container")), "kept-no-op")
        .otherwise("encoded")
    )
    out = judged.join(measured, key, "left").withColumn("tag", tag).withColumn("decision", F.split("tag", "-")[0])
    encoded = F.col("decision") == "encoded"
    return out.select(
        *assets.columns,
        F.col("room").alias("headroom"),
        "decision",
        "tag",
        F.when(encoded, F.col("chosen.format")).alias("chosen_format"),
        F.when(encoded, F.col("chosen.quality")).alias("chosen_quality"),
        F.when(encoded, F.col("chosen.bytes")).alias("chosen_bytes"),
        F.when(encoded & (F.col("original") > 0), saved).alias("saved"),
    )


def _dimension(better: Column, worse: Column, known: Column) -> Column:
    return F.when(~known, 0).when(better, 1).when(worse, -1).otherwise(0)


def compare_sources(cur: str = "cur", cand: str = "cand") -> dict[str, Column]:
    """1, 0 or -1 for each dimension in which a recovered source is better, alike or worse."""

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    area = {s: c(s, "declared_w") * c(s, "declared_h") for s in (cur, cand)}
    effective = {s: c(s, "effective_w") * c(s, "effective_h") for s in (cur, cand)}
    both = effective[cur].isNotNull() & effective[cand].isNotNull()
    gen = c(cur, "generations").isNotNull() & c(cand, "generations").isNotNull()
    qual = c(cur, "quality").isNotNull() & c(cand, "quality").isNotNull()
    return {
        "declared": _dimension(area[cand] > area[cur], area[cand] < area[cur], F.lit(True)),
        "effective": _dimension(effective[cand] > effective[cur] * 1.05, effective[cand] < effective[cur] * 0.95, both),
        "generation": _dimension(c(cand, "generations") < c(cur, "generations"), c(cand, "generations") > c(cur, "generations"), gen),
        "quality": _dimension(c(cand, "quality") > c(cur, "quality") + 2, c(cand, "quality") < c(cur, "quality") - 2, qual),
    }


def accept_sources(pairs: DataFrame, cur: str = "cur", cand: str = "cand") -> DataFrame:
    """pairs (structs cur and cand) with the four verdicts and ``accepted``: some better, none worse."""
    verdicts = compare_sources(cur, cand)
    out = pairs.withColumns({f"{k}_verdict": v for k, v in verdicts.items()})
    names = [F.col(f"{k}_verdict") for k in verdicts]
    return out.withColumn("accepted", (F.least(*names) >= 0) & (F.greatest(*names) > 0))


def recoverable(assets: DataFrame, *, decimal: bool = False) -> DataFrame:
    """assets (container, quality, blocking_score, headroom, declared_w/h, display_w/h, file_bytes)
    with fraction and recoverable bytes, the estimate an audit reports.

    With ``decimal`` the share that a format leaves is a whole number of
    hundredths, as decimals give it; otherwise it is what doubles give, whose
    last bit decides bytes that lie on a half.
    """
    slack = F.lit(0.0)
    for least, share in reversed(QUALITY_SLACK):
        slack = F.when(F.col("quality") >= least, F.lit(share)).otherwise(slack)
    factor = (
        F.when(F.col("container") == "jpeg", F.lit(FORMAT_SAVES["jpeg"]) + slack)
        .when((F.col("container") == "png") & (F.col("blocking_score") >= LAUNDERED), F.lit(FORMAT_SAVES["png_photo"]))
        .when(F.col("container") == "png", F.lit(FORMAT_SAVES["png"]))
        .when(F.col("container") == "webp", F.lit(FORMAT_SAVES["webp"]))
        .when(F.col("container") == "gif", F.lit(FORMAT_SAVES["gif"]))
        .otherwise(F.lit(0.0))
    )
    declared, display = F.col("declared_w") * F.col("declared_h"), F.col("display_w") * F.col("display_h")
    ratio = display / declared
    oversize = F.when((display > 0) & (ratio < 1 / 1.2), 1 - ratio).otherwise(0.0)
    left = F.round(1 - factor, 2) if decimal else 1 - factor
    fraction = F.when(F.col("headroom") == "none", 0.0).otherwise(F.least(F.lit(0.95), 1 - (1 - oversize) * left))
    return assets.withColumn("fraction", fraction).withColumn("recoverable", F.floor(F.col("file_bytes") * F.col("fraction") + 0.5).cast("long"))


def audit_rollup(assets: DataFrame) -> DataFrame:
    """One row of totals over audited assets."""
    return assets.agg(
        F.count(F.lit(1)).alias("assets"),
        F.sum("file_bytes").alias("bytes"),
        F.sum("recoverable").alias("recoverable"),
        *[F.count_if(F.col("headroom") == h).alias(f"headroom_{h}") for h in ("none", "low", "normal")],
        F.count_if(F.col("recoverable") == 0).alias("nothing_recoverable"),
    )


def plan_totals(decided: DataFrame) -> DataFrame:
    """One row of :func:`decide`'s rows with file_bytes: assets by decision, bytes before and after."""
    d = F.col("decision")
    return decided.agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if(d == "encoded").alias("encoded"),
        F.count_if(d == "refused").alias("refused"),
        F.count_if(~d.isin("encoded", "refused")).alias("kept_or_skipped"),
        F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum(F.coalesce("chosen_bytes", "file_bytes")), F.lit(0)).alias("bytes_after"),
    )
