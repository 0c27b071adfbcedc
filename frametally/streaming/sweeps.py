"""Sweeps over a stream of assets whose points come out while dearer encodes still run.

Each micro-batch measures its assets format by format, the cheap ones first,
and writes the points of each before it begins the next: a reader of the
folder sees the curve fill.  A step that fails is a row, not the end.  Stopping
the query cancels the sweep; started again on its checkpoint it goes on, and
the batch that was cut off is measured anew over the same files, so no point
is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from frametally.operators import sweep

FORMATS = {"jpeg": False, "webp": True, "png": True, "avif": True}


def start(assets: DataFrame, measure: Callable[[DataFrame], DataFrame], key: str, path: str, checkpoint: str, formats: dict[str, bool] | None = None, **trigger: bool | str) -> StreamingQuery:
    """Sweeps a stream of (key, bytes, exact, ...) into Parquet under path, which the checkpoint belongs to.

    measure is that of :func:`sweep.measured`; an asset that comes twice is
    swept twice if it comes in two batches.  trigger is passed on.
    """
    plan = {name: (formats or FORMATS)[name] for name in FORMATS if name in (formats or FORMATS)}

    def batch(rows: DataFrame, number: int) -> None:
        once = rows.dropDuplicates([key])
        folder = f"{path}/batch={number}"
        sweep.originals(once, key).write.mode("overwrite").parquet(f"{folder}/stage=0")
        steps = sweep.capped_plan(rows.sparkSession, plan)
        for stage, name in enumerate(plan, 1):  # four formats at most, each a job over all assets
            sweep.measured(once, steps.where(steps.format == name), measure, key).write.mode("overwrite").parquet(f"{folder}/stage={stage}")

    return assets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def points(spark: SparkSession, path: str) -> DataFrame:
    """All points written so far, with the batch and stage that wrote them."""
    return spark.read.parquet(path)
