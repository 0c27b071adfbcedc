"""A probe's answers in their fixed order: address given, rate, address valid, cache, fetch, status, container, report.

Limiter and cache are stateful operators chained in one query: what the limiter
refuses doesn't reach the cache, and only what is fetched well is kept.  The
same steps run over a batch and over a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.functions import urls
from frametally.streaming import limits

#: Why a fetch was refused or failed -> the status of the answer.
REFUSALS = {
    "invalid-url": 400, "bad-scheme": 400, "credentials": 400, "private-address": 400, "bad-redirect": 400, "too-many-redirects": 400,
    "content-type": 415, "timeout": 504, "dns-error": 502, "network-error": 502,
}
TTL, MOST = 3_600_000, 500
CONTAINERS = ("jpeg", "png", "webp", "avif", "gif")


def outcome(refusal: Column, upstream: Column, container: Column) -> Column:
    """struct(status, code) of a fetch: why it was refused, or the status of what answered, or its container."""
    status = F.lit(500)
    for code, value in REFUSALS.items():
        status = F.when(refusal == code, F.lit(value)).otherwise(status)

    def answer(status: Column | int, code: Column | str | None) -> Column:
        return F.struct((status if isinstance(status, Column) else F.lit(status)).cast("int").alias("status"), (code if isinstance(code, Column) else F.lit(code)).cast("string").alias("code"))

    return (
        F.when(refusal.isNotNull(), answer(status, refusal))
        .when(upstream.isNull() | ~upstream.between(200, 299), answer(502, "upstream-status"))
        .when(~F.coalesce(container.isin(*CONTAINERS), F.lit(False)), answer(415, "unrecognized-container"))
        .otherwise(answer(200, None))
    )


def valid(url: Column) -> Column:
    """Whether a text parses as an absolute address."""
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+[^\s]*$")


def answers(requests: DataFrame, responses: DataFrame, windows: tuple[tuple[int, int], ...] = limits.WINDOWS, ttl_ms: int = TTL, most: int = MOST, late: str = "1 hour") -> DataFrame:
    """(event_id, at, status, code, cached, retry_after) of requests (client, instance, event_id, at in ms, target).

    responses has a row (url, refusal, upstream, container) for each normal
    address; an address without one can't be reached.  Requests without a target
    aren't charged to the client, those whose target is no address are.  Seconds
    to wait are rounded up and at least 1.  Each instance has a cache; a batch
    gives the rows that a stream gives, which come out in append mode.
    """
    stream = requests.isStreaming
    given = F.coalesce(F.col("target") != "", F.lit(False))
    none = F.lit(None).cast("string")

    def told(rows: DataFrame, status: Column, code: Column, cached: Column | None = None, wait: Column | None = None) -> DataFrame:
        after = F.lit(None).cast("long") if wait is None else wait
        return rows.select("event_id", "at", status.cast("int").alias("status"), code.alias("code"), (F.lit(False) if cached is None else cached).alias("cached"), after.alias("retry_after"))

    asked = requests.select("client", "instance", "event_id", "at", "target")
    if stream:
        asked = asked.withColumn("at_time", F.timestamp_millis("at")).withWatermark("at_time", late)
    charged = (limits.limited if stream else limits.limited_batch)(asked.where(given), windows)
    # all that was charged goes through the cache, for a stream can't be read twice: what is refused or no address has no good answer to keep
    named = charged.withColumn("url", F.when(F.col("allowed") & valid(F.col("target")), urls.normalised(F.col("target"))))
    known = responses.select(F.col("url").alias("_url"), outcome(F.col("refusal"), F.col("upstream"), F.col("container")).alias("_o"))
    found = named.join(known, F.col("url") == F.col("_url"), "left").withColumn("o", F.coalesce("_o", F.struct(F.lit(502).alias("status"), F.lit("network-error").alias("code"))))
    sought = found.select(*charged.columns, F.coalesce("url", F.lit("")).alias("url"), F.col("o.status").alias("fetch_status"), F.col("o.code").alias("fetch_code"), (F.col("url").isNotNull() & (F.col("o.status") == 200)).alias("good"))
    through = limits.cache_stream(sought, ttl_ms, most, late=late) if stream else limits.cached_batch(sought, ttl_ms, most)
    refused, wrong = ~F.col("allowed"), ~valid(F.col("target"))
    status = F.when(refused, 429).when(wrong, 400).when(F.col("hit"), 200).otherwise(F.col("fetch_status"))
    code = F.when(refused, "rate-limited").when(wrong, "invalid-url").when(~F.col("hit"), F.col("fetch_code")).otherwise(none)
    wait = F.when(refused, F.greatest(F.lit(1), F.ceil(F.col("retry_after") / 1000)).cast("long"))
    return told(through, status, code, F.col("hit"), wait).unionByName(told(asked.where(~given), F.lit(400), F.lit("missing-url")))
