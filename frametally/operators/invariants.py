"""Assertions that ride on a run as observed metrics, and keys that must be unique."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Violated(ValueError):
    """Invariants that didn't hold, by name, with how many rows broke each."""

    def __init__(self, broken: dict[str, int]):
        super().__init__("invariants violated: " + ", ".join(f"{k} ({n} rows)" for k, n in sorted(broken.items())))
        self.broken = broken


class Invariants:
    """Conditions on rows, counted where they fail while the rows pass by; ``check`` after an action raises for those that did.

    A condition that is null has failed.  No second pass is made: the counts are
    metrics of the run itself.
    """

    def __init__(self, **conditions: Column):
        self.conditions = conditions
        self.observation = Observation(f"invariants-{uuid.uuid4().hex}")

    def on(self, df: DataFrame) -> DataFrame:
        broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in self.conditions.items()]
        return df.observe(self.observation, *broken)

    def check(self) -> None:
        broken = {k: n for k, n in self.observation.get.items() if n}
        if broken:
            raise Violated(broken)


#: What measures of pictures must hold, by name: of a picture against itself, damaged by blocks, by hue, blurred and enlarged.
PICTURES = {
    "same_structure": "self_ssim = 1",
    "same_colour": "self_delta_e = 0",
    "blocks_show": "blocked_seams > 1.5",
    "clean_seams": "seams < 1.1",
    "hue_keeps_structure": "hue_ssim > 0.995",
    "hue_shows": "hue_delta_e > 2.3",
    "blur_shows": "blurred_p95 < 0.2 * p95",
    "enlarged_shows": "enlarged_share > 0.4 and enlarged_share < 0.65",
}


def of_pictures() -> Invariants:
    return Invariants(**{k: F.expr(c) for k, c in PICTURES.items()})


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that several rows have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, whose run fails where two rows share a key, with that key in the message."""
    named = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    counted = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys], named.alias("_named")).agg(F.count(F.lit(1)).alias("_n"))
    failed = F.raise_error(F.concat(F.lit("duplicate key: "), "_named")).cast("boolean")
    checked = counted.withColumn("_ok", F.when(F.col("_n") > 1, failed).otherwise(True))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(checked, condition).where("_ok").select(*df.columns)
