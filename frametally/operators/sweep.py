"""The ladder of encodes to try, as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametally.functions import rates

LADDER = tuple(range(40, 96, 5))
SPARSE = tuple(range(40, 91, 10))


def plan(spark: SparkSession, fast: bool = False) -> DataFrame:
    """(step, format, quality): jpeg, webp and, unless fast, avif over the ladder, and png once."""
    steps = [(f, q) for f in ("jpeg", "webp", *(() if fast else ("avif",))) for q in LADDER] + [("png", None)]
    return spark.createDataFrame([(i, f, q) for i, (f, q) in enumerate(steps)], "step int, format string, quality int")


def capped_plan(spark: SparkSession, formats: dict[str, bool]) -> DataFrame:
    """(step, format, quality) for formats and whether they can store losslessly: a sparser ladder for avif, a
    lossless step each where it exists and isn't avif's; png has that alone."""
    steps: list[tuple[str, int | None]] = []
    for name in ("jpeg", "webp", "png", "avif"):
        if name not in formats:
            continue
        if name != "png":
            steps += [(name, q) for q in (SPARSE if name == "avif" else LADDER)]
        if formats[name] and name != "avif":
            steps.append((name, None))
    return spark.createDataFrame([(i, f, q) for i, (f, q) in enumerate(steps)], "step int, format string, quality int")


def steps_for(assets: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """Every asset with every step (a few dozen rows) and its keep-original step, which comes last."""
    tried = assets.select(key).join(F.broadcast(steps), how="cross")
    return tried.unionByName(assets.select(key, F.lit(-1).alias("step"), F.lit("keep-original").alias("format"), F.lit(None).cast("int").alias("quality")))


ORIGINAL = "keep-original"
_RESULT = "bytes long, ssim double, delta_e double, error string"


def attempt(tries: DataFrame, encode: Callable[[dict[str, Any]], tuple[int, float, float]], *keep: str) -> DataFrame:
    """(keep, bytes, ssim, delta_e, error) of a Python encoder over each row; where it raises, error says why."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tries.select(*keep).schema), _RESULT])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results: list[tuple] = []
            for row in frame.to_dict("records"):
                try:
                    results.append((*encode(row), None))
                except Exception as e:  # one step's failure is a result, whatever it is
                    results.append((None, None, None, str(e) or type(e).__name__))
            yield pd.concat([frame[list(keep)].reset_index(drop=True), pd.DataFrame(results, columns=["bytes", "ssim", "delta_e", "error"])], axis=1)

    return tries.mapInPandas(run, schema)


def originals(assets: DataFrame, key: str) -> DataFrame:
    """The first point of assets (key, bytes, exact): the file itself, where what is measured against is its very decode (exact)."""
    return assets.where("exact").select(
        key, F.lit(0).alias("idx"), F.lit("point").alias("event"), F.lit(ORIGINAL).alias("format"), F.lit(None).cast("int").alias("quality"), F.col("bytes").cast("long").alias("bytes"),
        F.lit(1.0).alias("ssim"), F.lit(0.0).alias("delta_e"), F.lit(0.0).alias("distortion"), F.lit(None).cast("string").alias("message"),
    )


def measured(assets: DataFrame, steps: DataFrame, measure: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """(key, idx, event, format, quality, bytes, ssim, delta_e, distortion, message) of each asset's steps.

    measure takes the assets' columns with step, format and quality and returns
    rows (key, step, bytes, ssim, delta_e, error); a step that it gives an error
    or numbers out of range, or no row at all, is a ``step-error`` with a
    message, and the others go on.  Places count from 1 where the file itself is
    a point, else from 0.
    """
    tries = assets.where(F.col("exact").isNotNull()).crossJoin(F.broadcast(steps))
    got = measure(tries).select(key, "step", F.struct("bytes", "ssim", "delta_e", "error").alias("r"))
    r = tries.select(key, "exact", "step", "format", "quality").join(got, [key, "step"], "left")
    wrong = F.coalesce((F.col("r.bytes") < 0) | ~F.col("r.ssim").between(-1, 1) | (F.col("r.delta_e") < 0) | F.isnan("r.delta_e"), F.lit(True))
    message = F.when(F.col("r").isNull(), "no encode").when(F.col("r.error").isNotNull(), F.col("r.error")).when(wrong, "numbers out of range")
    ok = message.isNull()
    ssim, delta_e = F.when(ok, F.col("r.ssim")), F.when(ok, F.col("r.delta_e"))
    return r.select(
        key, (F.col("step") + F.col("exact").cast("int")).alias("idx"), F.when(ok, "point").otherwise("step-error").alias("event"), "format", "quality", F.when(ok, F.col("r.bytes")).cast("long").alias("bytes"),
        ssim.alias("ssim"), delta_e.alias("delta_e"), F.when(ok, rates.distortion(ssim, delta_e)).alias("distortion"), message.alias("message"),
    )


def progress(points: DataFrame, totals: int, key: str) -> DataFrame:
    """(key, done, failed, cheapest, finished) of points so far: finished when the plan's steps are all there.

    An aggregate without a window, so it also runs over a stream of points
    (in update mode).  cheapest is the least size that reaches the floor.
    """
    tried = F.col("format") != ORIGINAL
    enough = (F.col("event") == "point") & (F.col("ssim") >= 0.97)
    out = points.groupBy(key).agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("event") == "step-error").alias("failed"), F.min(F.when(enough, F.col("bytes"))).alias("cheapest"), F.count_if(tried).alias("_n"))
    return out.select(key, "done", "failed", "cheapest", (F.col("_n") >= totals).alias("finished"))
