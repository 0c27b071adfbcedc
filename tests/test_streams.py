"""The limiter and the cache as streams against a replay, with state that goes, and the probe's order as a batch and a stream."""

import random

import pytest
from pyspark.sql import functions as F

from frametally.streaming import limits, probe

WINDOWS = ((1_000, 2), (5_000, 4))


def run(spark, build, rows, schema, folder, cuts):
    """Rows written in parts, each followed by a run of the query on one checkpoint; all that came out."""
    df = spark.createDataFrame(rows, schema)
    bounds = [float("-inf"), *cuts, float("inf")]
    for a, b in zip(bounds, bounds[1:]):
        df.where((F.col("at") >= a) & (F.col("at") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = build(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
    return spark.read.parquet(f"{folder}/out").collect()


def state_rows(spark, folder, operator, name):
    return spark.read.format("statestore").option("path", f"{folder}/cp").option("operatorId", operator).option("stateVarName", name).load().count()


def test_idle_clients_leave_no_state(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, i, c * 100_000 + rng.randrange(0, 8_000)) for c in range(5) for i in range(c * 50, c * 50 + 50)]
    # a last client, long after, moves the watermark beyond all that the others' hits decide
    rows += [(9, 900, 10_000_000), (9, 901, 20_000_000)]
    got = run(spark, lambda s: limits.limit_stream(s, WINDOWS, late="1 second"), rows, "client long, event_id long, at long", str(tmp_path), (250_000, 10_000_000, 20_000_000))
    want = {}
    for c in {r[0] for r in rows}:
        hits = []
        for at, i in sorted((at, i) for k, i, at in rows if k == c):
            hits, ok, wait = limits.step(hits, at, WINDOWS)
            want[i] = (ok, wait)
    assert {r.event_id: (r.allowed, r.retry_after) for r in got} == want
    assert state_rows(spark, str(tmp_path), 0, "hits") <= 2  # of the last client alone


def replayed(rows, ttl, most):
    """Hits by a cache in plain Python: a list in order of setting."""
    held, out = {}, {}
    for key, url, i, at, good in sorted(rows, key=lambda r: (r[3], r[2])):
        entries = held.setdefault(key, [])
        live = [e for e in entries if e[0] == url]
        if live and at < live[0][1]:
            out[i] = True
            continue
        entries[:] = [e for e in entries if e[0] != url]
        if good:
            if len(entries) >= most:
                entries.pop(0)
            entries.append((url, at + ttl))
        out[i] = False
    return out


def test_cache_stream_evicts_in_order_of_setting(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 3, f"u{rng.randrange(6)}", i, i * 100 + rng.randrange(90), rng.random() < 0.8) for i in range(300)]
    schema = "instance long, url string, event_id long, at long, good boolean"
    want = replayed(rows, 4_000, 3)
    assert 20 < sum(want.values()) < 280
    assert {r.event_id: r.hit for r in limits.cached_batch(spark.createDataFrame(rows, schema), 4_000, 3).collect()} == want
    late = [*rows, (7, "z", 998, 10_000_000, True), (7, "z", 999, 20_000_000, False)]
    got = run(spark, lambda s: limits.cache_stream(s, 4_000, 3, late="1 second"), late, schema, str(tmp_path), (12_345, 10_000_000, 20_000_000))
    assert {r.event_id: r.hit for r in got} == want | {998: False, 999: False}
    assert state_rows(spark, str(tmp_path), 0, "entries") <= 1


@pytest.fixture(scope="module")
def asked():
    rng = random.Random(3)
    targets = ["https://a.example/x?b=1&a=2", "https://a.example/x?a=2&b=1#f", "https://a.example/gone", "https://a.example/blocked", "https://a.example/text", "https://nowhere.example/", "no address", "", None]
    rows = [(rng.randrange(6), i % 2, i, i * 150 + rng.randrange(100), rng.choice(targets)) for i in range(250)]
    responses = [("https://a.example/x?a=2&b=1", None, 206, "jpeg"), ("https://a.example/gone", None, 404, None), ("https://a.example/blocked", "private-address", None, None), ("https://a.example/text", None, 200, None)]
    return rows, responses


def expected(rows, responses):
    known, hits, caches, out = {r[0]: r for r in responses}, {}, {}, {}
    for client, instance, i, at, target in sorted(rows, key=lambda r: (r[3], r[2])):
        if not target:
            out[i] = (400, "missing-url", False, None)
            continue
        hits[client], ok, wait = limits.step(hits.get(client, []), at, WINDOWS)
        if not ok:
            out[i] = (429, "rate-limited", False, max(1, -(-wait // 1000)))
            continue
        if "://" not in target:
            out[i] = (400, "invalid-url", False, None)
            continue
        url = "https://a.example/x?a=2&b=1" if "/x?" in target else target
        cache = caches.setdefault(instance, {})
        if cache.get(url, -1) > at:
            out[i] = (200, None, True, None)
            continue
        cache.pop(url, None)
        _, refusal, status, container = known.get(url, (url, "network-error", None, None))
        code = refusal or ("upstream-status" if status >= 300 else "unrecognized-container" if not container else None)
        out[i] = ({None: 200, "upstream-status": 502, "unrecognized-container": 415, "private-address": 400, "network-error": 502}[code], code, False, None)
        if code is None:
            cache[url] = at + 3_000
    return out


REQUEST, RESPONSE = "client long, instance long, event_id long, at long, target string", "url string, refusal string, upstream int, container string"


def test_probe_answers_in_order(spark, asked):
    rows, responses = asked
    got = probe.answers(spark.createDataFrame(rows, REQUEST), spark.createDataFrame(responses, RESPONSE), WINDOWS, 3_000, 5)
    want = expected(rows, responses)
    assert {r.event_id: (r.status, r.code, r.cached, r.retry_after) for r in got.collect()} == want
    assert {200, 400, 415, 429, 502} == {w[0] for w in want.values()} and any(w[2] for w in want.values())


def test_probe_stream_equals_the_batch(spark, asked, tmp_path):
    rows, responses = asked
    # requests after all others let the watermark pass them through both operators
    rows = [*rows, (99, 99, 9_998, 50_000_000, "no address"), (99, 99, 9_999, 90_000_000, "no address")]
    known = spark.createDataFrame(responses, RESPONSE)
    got = run(spark, lambda s: probe.answers(s, known, WINDOWS, 3_000, 5, late="1 second"), rows, REQUEST, str(tmp_path), (9_000, 20_000, 40_000_000, 80_000_000))
    assert {r.event_id: (r.status, r.code, r.cached, r.retry_after) for r in got} == expected(rows, responses)


def test_empty_requests(spark):
    empty = spark.createDataFrame([], REQUEST)
    assert probe.answers(empty, spark.createDataFrame([], RESPONSE)).count() == 0
