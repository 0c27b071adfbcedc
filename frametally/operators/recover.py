"""Proposals of all recoverers, those that read the URL and its page first, version history last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frametally.functions import urls
from frametally.operators import history


def proposals(assets: DataFrame, log: DataFrame, key: str, srcset_col: str | None = None) -> DataFrame:
    """(key, ord, url, via) of assets (key, url, local_path, bytes, srcset_col) and their log: places count from 0
    without gaps, a URL that several recoverers propose stays with the first.  Assets without a URL have their history."""
    by_url = urls.proposals(assets, key, srcset_col=srcset_col).select(key, F.lit(0).alias("turn"), "ord", "url", "via")
    older = history.proposals(assets, log, key).select(key, F.lit(1).alias("turn"), "ord", "url", "via")
    first = by_url.unionByName(older).groupBy(key, "url").agg(F.min(F.struct("turn", "ord", "via")).alias("f"))
    order = Window.partitionBy(key).orderBy("f.turn", "f.ord", "url")
    return first.select(key, (F.row_number().over(order) - 1).alias("ord"), "url", F.col("f.via").alias("via"))
