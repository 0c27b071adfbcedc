"""Rate limits and expiring caches over request streams, by keyed state.

Refused requests aren't charged, so whether one passes depends on what passed
before: state for each client, in order of arrival.  The same step function
runs over a stream (``transformWithStateInPandas``) and over a batch.  Streams
have a watermark: when it has passed all that a key's state can still decide,
a timer clears it, so clients that never return leave nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: (window in ms, requests) pairs that all hold.
WINDOWS = ((60_000, 10), (3_600_000, 60))


def step(hits: list[int], at: int, windows: tuple[tuple[int, int], ...]) -> tuple[list[int], bool, int]:
    """Kept hits, whether a request at ``at`` passes, and the ms after which it would."""
    kept = [t for t in hits if t > at - max(w for w, _ in windows)]
    wait = 0
    for width, limit in windows:
        inside = [t for t in kept if t > at - width]
        if len(inside) >= limit:
            wait = max(wait, inside[-limit] + width - at)
    if wait:
        return kept, False, wait
    return [*kept, at], True, 0


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = [f for f in frames if len(f)]
    return pd.concat(parts).sort_values(["at", "event_id"]) if parts else pd.DataFrame({"event_id": [], "at": []})


class _Keyed(StatefulProcessor):
    """Rows of a key in order of (at, event_id), their columns passed on with what ``decide`` adds."""

    def __init__(self, added: tuple[str, ...]):
        self.added = added

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ordered = _ordered(rows)
        if not len(ordered):
            return
        made, until = self.decide(ordered)
        # one timer a key: the last moment that its state still counts for
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if until is not None:
            self.handle.registerTimer(until)
        out = ordered.copy()
        for name, values in zip(self.added, zip(*made)):
            out[name] = list(values)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Limiter(_Keyed):
    def __init__(self, windows: tuple[tuple[int, int], ...] = WINDOWS):
        super().__init__(("allowed", "retry_after"))
        self.windows = windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getListState("hits", StructType([StructField("at", LongType())]))

    def decide(self, rows: pd.DataFrame) -> tuple[list[tuple[bool, int]], int | None]:
        hits = [int(h[0]) for h in self.state.get()] if self.state.exists() else []
        made = []
        for at in rows["at"]:
            hits, ok, wait = step(hits, int(at), self.windows)
            made.append((ok, wait))
        if not hits:
            self.state.clear()
            return made, None
        self.state.put([(h,) for h in hits])
        return made, hits[-1] + max(w for w, _ in self.windows)


class Cache(_Keyed):
    """A cache of each key: entries expire ``ttl`` after they are set, which reads don't prolong; where ``most`` are held, the
    one set first goes for a new one.  Rows have url and ``good``: whether what a miss fetches is kept."""

    def __init__(self, ttl: int, most: int):
        super().__init__(("hit",))
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getListState("entries", StructType([StructField("url", StringType()), StructField("until", LongType())]))

    def decide(self, rows: pd.DataFrame) -> tuple[list[tuple[bool]], int | None]:
        entries = {u: int(t) for u, t in self.state.get()} if self.state.exists() else {}
        made = [(cached(entries, u, int(at), bool(good), self.ttl, self.most),) for u, at, good in zip(rows["url"], rows["at"], rows["good"])]
        if not entries:
            self.state.clear()
            return made, None
        self.state.put(list(entries.items()))
        return made, max(entries.values())


def cached(entries: dict[str, int], url: str, at: int, good: bool, ttl: int, most: int) -> bool:
    """Whether a request is answered from ``entries`` (url -> end, in order of their setting), which it changes."""
    until = entries.get(url)
    if until is not None and at < until:
        return True
    entries.pop(url, None)
    if good:
        if len(entries) >= most:
            del entries[next(iter(entries))]
        entries[url] = at + ttl
    return False


def _stateful(requests: DataFrame, key: str, processor: _Keyed, added: tuple[StructField, ...], late: str) -> DataFrame:
    """A stream's rows by key through a processor, with an event time column ``at_time`` made of ``at`` where there is none."""
    if hidden := [c for c in requests.columns if c.startswith("_")]:
        raise ValueError(f"columns whose names begin with an underscore aren't passed on: {hidden}")
    timed = requests
    if "at_time" not in requests.columns:
        timed = requests.withColumn("at_time", F.timestamp_millis("at")).withWatermark("at_time", late)
    out = StructType([*timed.schema.fields, *added])
    return timed.groupBy(key).transformWithStateInPandas(processor, outputStructType=out, outputMode="append", timeMode="EventTime", eventTimeColumnName="at_time")


def limited(requests: DataFrame, windows: tuple[tuple[int, int], ...] = WINDOWS, late: str = "1 hour") -> DataFrame:
    """A stream (client, event_id, at in ms, ...) with allowed, retry_after and at_time; needs the RocksDB state store.

    ``late`` is how far requests may be out of order.
    """
    added = (StructField("allowed", BooleanType()), StructField("retry_after", LongType()))
    return _stateful(requests, "client", Limiter(windows), added, late)


def limit_stream(requests: DataFrame, windows: tuple[tuple[int, int], ...] = WINDOWS, late: str = "1 hour") -> DataFrame:
    """A stream (client, event_id, at) with decisions."""
    return limited(requests.select("client", "event_id", "at"), windows, late).select("client", "event_id", "at", "allowed", "retry_after")


def cache_stream(requests: DataFrame, ttl_ms: int, most: int = 500, key: str = "instance", late: str = "1 hour") -> DataFrame:
    """A stream (key, url, event_id, at, good, ...) with ``hit``; each key has a cache of its own."""
    return _stateful(requests, key, Cache(ttl_ms, most), (StructField("hit", BooleanType()),), late)


def _in_order(requests: DataFrame, key: str, first, follow, reads: tuple[str, ...], adds: str) -> DataFrame:
    """requests with what ``follow(state, *values of reads)`` -> (state, values) gives over each key's rows in order of (at, event_id).

    ``first()`` is a key's first state.  Rows are sorted in their partitions and
    read as a stream; only the state of the current key is held.
    """
    types = [pa.bool_() if c.split()[1] == "boolean" else pa.int64() for c in adds.split(", ")]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema)}, {adds}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, now, state = False, None, None
        for batch in batches:
            made = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *reads))):
                if not some or k != now:
                    some, now, state = True, k, first()
                state, out = follow(state, *values)
                made.append(out)
            columns = [pa.array(c, t) for c, t in zip(zip(*made) if made else [()] * len(types), types)]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, *(c.split()[0] for c in adds.split(", "))])

    return requests.repartition(key).sortWithinPartitions(key, "at", "event_id").mapInArrow(run, schema)


def limited_batch(requests: DataFrame, windows: tuple[tuple[int, int], ...] = WINDOWS) -> DataFrame:
    """A batch (client, event_id, at in ms, ...) with allowed and retry_after.

    Each client's requests in order; the state holds no more hits than the
    windows allow.
    """

    def follow(hits: list[int], at: int) -> tuple[list[int], tuple[bool, int]]:
        hits, ok, wait = step(hits, at, windows)
        return hits, (ok, wait)

    return _in_order(requests, "client", list, follow, ("at",), "allowed boolean, retry_after long")


def _plain(requests: DataFrame, key: str) -> DataFrame:
    return requests.select(key, F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("long").alias("at"))


def limit_batch(requests: DataFrame, windows: tuple[tuple[int, int], ...] = WINDOWS) -> DataFrame:
    """A batch (client, event_id, at in ms) with allowed and retry_after."""
    return limited_batch(_plain(requests.withColumn("client", F.col("client").cast("long")), "client"), windows)


def cache_batch(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """A batch (url, event_id, at in ms) with ``hit``: whether the entry set by the last miss still holds.

    An entry expires at its time plus the ttl, which reads don't prolong.
    """

    def follow(until: int, at: int) -> tuple[int, tuple[bool]]:
        return (until, (True,)) if at < until else (at + ttl_ms, (False,))

    return _in_order(_plain(requests, "url"), "url", lambda: -1, follow, ("at",), "hit boolean")


def cached_batch(requests: DataFrame, ttl_ms: int, most: int = 500, key: str = "instance") -> DataFrame:
    """A batch (key, url, event_id, at, good, ...) with ``hit``, as :func:`cache_stream` gives it."""

    def follow(entries: dict[str, int], url: str, at: int, good: bool) -> tuple[dict[str, int], tuple[bool]]:
        return entries, (cached(entries, url, at, good, ttl_ms, most),)

    return _in_order(requests, key, dict, follow, ("url", "at", "good"), "hit boolean")
