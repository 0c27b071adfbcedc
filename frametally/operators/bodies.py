"""Bodies that come in chunks, read up to a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped(chunks: DataFrame, body: str, ord_: str, size: str, cap: int) -> DataFrame:
    """chunks (body, ord, size, ...) with ``kept``: how much of each chunk is read before the cap, in order of ord.

    A chunk that crosses the cap is cut; what comes after isn't read, and has 0.
    Null sizes are empty chunks.
    """
    n = F.coalesce(size, F.lit(0)).cast("long")
    before = F.coalesce(F.sum(n).over(Window.partitionBy(body).orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("kept", F.greatest(F.lit(0), F.least(n, F.lit(cap) - before)).cast("long"))


def read(chunks: DataFrame, body: str, ord_: str, size: str, cap: int) -> DataFrame:
    """(body, read, chunks, truncated) of each body: truncated only if it is strictly over the cap."""
    k = capped(chunks, body, ord_, size, cap)
    return k.groupBy(body).agg(F.sum("kept").alias("read"), F.count_if(F.col("kept") > 0).alias("chunks"), (F.coalesce(F.sum(size), F.lit(0)) > cap).alias("truncated"))


def content(chunks: DataFrame, body: str, ord_: str, data: str, cap: int) -> DataFrame:
    """(body, content): the bytes of each body up to the cap, which bounds the row; chunks beyond it aren't collected."""
    k = capped(chunks.withColumn("_size", F.octet_length(data)), body, ord_, "_size", cap).where("kept > 0")
    cut = F.expr(f"substring({data}, 1, int(kept))")
    parts = k.groupBy(body).agg(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), cut.alias("d")))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["d"]))
    return chunks.select(body).distinct().join(parts.select(body, joined.alias("content")), body, "left").withColumn("content", F.coalesce("content", F.lit(b"")))
