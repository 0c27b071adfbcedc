"""Capped bodies, audits, verification, invariants and ledgers in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from frametally.operators import audit, bodies, invariants, verify
from frametally.sources import receipts


def test_bodies_are_cut_at_the_cap(spark):
    rng = random.Random(1)
    chunks = {b: [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 9]))) for _ in range(rng.randrange(1, 7))] for b in range(60)}
    chunks[100], chunks[101], chunks[102], chunks[103] = [b"x" * 10, b"y" * 10], [b"x" * 10, b"y" * 11], [b"", None], [b"z" * 50]
    df = spark.createDataFrame([(b, i, c) for b, cs in chunks.items() for i, c in enumerate(cs)], "body int, ord int, data binary")
    want = {b: b"".join(c or b"" for c in cs) for b, cs in chunks.items()}
    got = {r.body: (r.read, r.truncated) for r in bodies.read(df.withColumn("size", F.octet_length("data")), "body", "ord", "size", 20).collect()}
    assert got == {b: (min(20, len(w)), len(w) > 20) for b, w in want.items()}
    assert got[100] == (20, False) and got[101] == (20, True)
    assert {r.body: bytes(r.content) for r in bodies.content(df, "body", "ord", "data", 20).collect()} == {b: w[:20] for b, w in want.items()}


def test_audit_reports_what_caps_cut_off(spark):
    rows = [(1, i, f"/{i}", 400, b"GIF89a") for i in range(7)] + [(2, 0, "/a", None, None), (2, 1, "/b", 900, b"GIF89a"), (2, 2, "/c", 900, b"hello"), (2, 3, "/d", 900, b"GIF89a")]
    items = spark.createDataFrame(rows, "page int, idx int, url string, length long, content binary")
    for c in ("attr_w", "attr_h", "display_w", "display_h"):
        items = items.withColumn(c, F.lit(10))
    a = audit.assets(items, images=5, head=500, total=1000)
    state = {(r.page, r.idx): (r.state, r.head, r.container) for r in a.collect()}
    assert [state[1, i][0] for i in range(7)] == ["inspected"] * 3 + ["beyond-bytes"] * 2 + ["beyond-images"] * 2
    assert state[2, 0] == ("failed", 0, None) and state[2, 1] == ("inspected", 500, "gif") and state[2, 2] == ("inspected", 500, None) and state[2, 3][0] == "beyond-bytes"
    got = {r.page: r for r in audit.pages(a, 5, 1000).collect()}
    assert got[1].truncations == ["of 7 images the first 5 are looked at", "1000 bytes are spent: 2 images are left out"] and (got[1].found, got[1].inspected, got[1].bytes) == (7, 3, 1200)
    assert got[2].truncations == ["not fetched: /a", "1000 bytes are spent: 1 images are left out"]
    assert got[1].recoverable == 3 * 260


def test_verdicts_and_order(spark):
    from frametally.plans.queries import QUERIES

    got = QUERIES["verified_entries"](spark, "/root/testdata/sf0.001")
    shown = [(r.verdict, r.line) for r in verify.for_display(got).collect()]
    rank = {"refuted": 0, "unverifiable": 1, "pass": 2}
    assert shown == sorted(shown, key=lambda x: (rank[x[0]], x[1])) and {v for v, _ in shown} == set(rank)
    totals = spark.createDataFrame([("pass",), ("unverifiable",)], "verdict string")
    assert verify.verification_totals(totals).first().exit_code == 2
    assert verify.verification_totals(totals.where("verdict = 'pass'")).first().exit_code == 0


def test_reference_is_made_small_and_compared(spark):
    # a source of 4 x 4 whose reference is 2 x 2: means of 2 x 2 pixels
    source = [("s", x, y, 10 * (y // 2), 20 * (x // 2), 5) for x in range(4) for y in range(4)]
    output = [("o", x, y, 10 * y, 20 * x, 5) for x in range(2) for y in range(2)]
    pixels = spark.createDataFrame(source + output, "hash string, x int, y int, r int, g int, b int")
    entries = spark.createDataFrame([(1, "s", "o", 2, 2), (2, "s", "o", 4, 4), (3, "s", "o", 5, 5)], "line int, source_hash string, output_hash string, reference_w int, reference_h int")
    got = {r.line: r for r in verify.remeasured(entries, pixels).collect()}
    assert got[1].ssim_now == pytest.approx(1) and got[1].delta_e_now == 0 and got[1].reference_hash_now.startswith("sha256:")
    assert got[2].ssim_now is None and got[2].output_w == 2 and got[3].reference_hash_now is None


def test_invariants_ride_on_the_run(spark):
    good = spark.createDataFrame([(1.0, 0.0, 2.0, 1.0, 0.999, 5.0, 10.0, 100.0, 0.5)], "self_ssim double, self_delta_e double, blocked_seams double, seams double, hue_ssim double, hue_delta_e double, blurred_p95 double, p95 double, enlarged_share double")
    i = invariants.of_pictures()
    assert i.on(good).count() == 1
    i.check()
    for column, value, name in (("self_ssim", 0.9, "same_structure"), ("blocked_seams", 1.2, "blocks_show"), ("enlarged_share", 0.9, "enlarged_shows"), ("p95", None, "blur_shows")):
        i = invariants.of_pictures()
        i.on(good.withColumn(column, F.lit(value).cast("double"))).collect()
        with pytest.raises(invariants.Violated, match=name) as e:
            i.check()
        assert e.value.broken == {name: 1}


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    assert invariants.duplicates(df, "id").count() == 0 and invariants.unique(df, "id").count() == 3
    twice = df.unionByName(df.where("id = 2"))
    assert [tuple(r) for r in invariants.duplicates(twice, "id").collect()] == [(2, 2)]
    with pytest.raises(Exception, match="duplicate key: 2"):
        invariants.unique(twice, "id").collect()


def test_ledger_lines_keep_their_numbers_in_blocks(spark, tmp_path):
    files = {f"f{k}.jsonl": [f"{k}:{i}" + "x" * (i * 37 % 900) for i in range(1, 800)] for k in range(2)}
    for name, lines in files.items():
        (tmp_path / name).write_bytes("\r\n".join(lines).encode() + (b"\r\n" if name == "f0.jsonl" else b""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = receipts.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.raw.rstrip("\r")) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((n, i, x) for n, lines in files.items() for i, x in enumerate(lines, 1))
