"""Block encodes and their inverse, generations that were made, sweeps that go on after failing steps and restarts, hull keys."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametally.operators import hull, pixels, quant, recover, sweep
from frametally.streaming import sweeps

N = np.arange(8)
BASIS = np.cos((2 * N[None] + 1) * N[:, None] * np.pi / 16) * np.where(N == 0, np.sqrt(0.125), 0.5)[:, None]


def frame(spark, planes):
    return spark.createDataFrame([(k, x, y, float(v)) for k, p in planes.items() for (y, x), v in np.ndenumerate(p)], "image int, x long, y long, value double")


def array(df, image, like):
    out = np.full(like.shape, np.nan)
    for r in df.where(F.col("image") == image).collect():
        out[r.y, r.x] = r.value
    return out


def encoded(plane, table):
    out = np.empty_like(plane, dtype=float)
    for y in range(0, plane.shape[0], 8):
        for x in range(0, plane.shape[1], 8):
            c = BASIS @ (plane[y : y + 8, x : x + 8] - 128.0) @ BASIS.T
            c = table * np.floor(np.round(c, 6) / table + 0.5)
            out[y : y + 8, x : x + 8] = np.clip(np.floor(np.round(BASIS.T @ c @ BASIS + 128, 6) + 0.5), 0, 255)
    return out


def test_inverse_gives_the_pixels_back(spark):
    rng = np.random.default_rng(3)
    planes = {1: rng.uniform(0, 255, (16, 24)), 2: np.full((8, 8), 77.25)}
    back = pixels.pixels_of(pixels.dct_blocks(frame(spark, planes), "image"), "image")
    for k, p in planes.items():
        np.testing.assert_allclose(array(back, k, p), p, atol=1e-9)


def test_missing_coefficients_are_zero(spark):
    only_mean = spark.createDataFrame([(1, 0, 2, 0, 0, 80.0)], "image int, block_x long, block_y long, u long, v long, coefficient double")
    rows = pixels.pixels_of(only_mean, "image").collect()
    assert len(rows) == 64 and {round(r.value, 9) for r in rows} == {138.0} and {r.y for r in rows} == set(range(16, 24))
    assert pixels.pixels_of(only_mean.limit(0), "image").count() == 0


def test_encodes_equal_those_by_matrices(spark):
    rng = np.random.default_rng(4)
    p = rng.integers(0, 256, (16, 16))
    part = np.pad(p, ((0, 0), (0, 3)))  # its last three columns are no full block
    table = np.array([max(1, min(255, (b * 50 + 50) // 100)) for b in quant.STANDARD_LUMA]).reshape(8, 8)
    steps = (F.lit(12.0), pixels.table_step(quant.scale_table(F.array(*map(F.lit, quant.STANDARD_LUMA)), F.lit(75))))
    got = array(pixels.encoded(frame(spark, {1: part}), "image", steps=steps), 1, part)
    np.testing.assert_array_equal(got[:, :16], encoded(encoded(p, np.full((8, 8), 12.0)), table))
    assert np.isnan(got[:, 16:]).all()


def test_one_shuffle_for_all_encodes(spark):
    plan = pixels.encoded(frame(spark, {1: np.zeros((8, 8))}), "image", steps=(F.lit(3.0), F.lit(5.0)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_made_generations_are_found(spark):
    rng = np.random.default_rng(5)
    smooth = np.clip(np.round(128 + rng.normal(0, 25, (128, 256))), 0, 255)
    once = frame(spark, {1: smooth})
    twice = pixels.encoded(once, "image", steps=(F.lit(5.0),)).withColumn("image", F.lit(2))
    blocks = pixels.dct_blocks(once.unionByName(twice), "image").withColumn("coefficient", F.round("coefficient", 6))
    found = pixels.generations(pixels.periodicity(pixels.quantised_histogram(blocks, F.lit(2.0), "image"), "image"), "image")
    got = {r.image: r.generations for r in found.collect()}
    assert got == {1: 1, 2: 2}


STEPS = 32


def encode(row):
    """A codec that can't do webp above 80, nor any asset 3, and whose numbers for asset 4's png are wrong."""
    if row["format"] == "webp" and row["quality"] == row["quality"] and row["quality"] > 80:
        raise ValueError(f"no webp at {int(row['quality'])}")
    if row["asset"] == 3:
        raise RuntimeError
    q = 100 if row["quality"] != row["quality"] else row["quality"]
    return int(row["bytes"] * q // 100), 1.5 if row["asset"] == 4 and row["format"] == "png" else q / 100, (100 - q) / 50


def measure(tries):
    return sweep.attempt(tries, encode, "asset", "step")


ASSETS = [(1, 1000, True), (2, 500, False), (3, 700, True), (4, 90, False), (5, None, None)]
SCHEMA = "asset int, bytes long, exact boolean"


def in_order(df):
    return sorted(map(tuple, df.select("asset", "idx", "event", "format", "quality", "bytes", "ssim", "delta_e", "distortion", "message").collect()), key=lambda r: r[:2])


def whole(spark):
    assets = spark.createDataFrame(ASSETS, SCHEMA)
    return in_order(sweep.originals(assets, "asset").unionByName(sweep.measured(assets, sweep.capped_plan(spark, sweeps.FORMATS), measure, "asset")))


def test_failing_steps_are_rows(spark):
    got = whole(spark)
    of = {k: [r for r in got if r[0] == k] for k in (1, 2, 3, 4, 5)}
    assert [len(of[k]) for k in of] == [STEPS + 1, STEPS, STEPS + 1, STEPS, 0]  # an asset of which it isn't known isn't swept
    assert of[1][0][2:6] == ("point", "keep-original", None, 1000) and [r[1] for r in of[1]] == list(range(STEPS + 1))
    assert [r[9] for r in of[1] if r[2] == "step-error"] == ["no webp at 85", "no webp at 90", "no webp at 95"]
    assert {r[9] for r in of[3][1:]} == {"RuntimeError", "no webp at 85", "no webp at 90", "no webp at 95"} and {r[2] for r in of[3][1:]} == {"step-error"}
    assert [(r[3], r[9]) for r in of[4] if r[2] == "step-error" and r[3] == "png"] == [("png", "numbers out of range")]
    p = next(r for r in of[2] if r[3:5] == ("jpeg", 40))
    assert p[5] == 200 and p[8] == pytest.approx(0.6 + 0.5 * 1.2 / 2.3)
    assert sweep.measured(spark.createDataFrame([], SCHEMA), sweep.capped_plan(spark, sweeps.FORMATS), measure, "asset").count() == 0


def test_stream_goes_on_after_a_crash(spark, tmp_path):
    path, flag = str(tmp_path / "points"), str(tmp_path / "crashed")
    seen = []

    def crashing(tries):
        formats = {r.format for r in tries.select("format").distinct().collect()}
        if "png" in formats and not os.path.exists(flag):
            # what is cheaper is already there to read
            seen.extend(sorted({r.format for r in sweeps.points(spark, path).select("format").distinct().collect()}))
            open(flag, "w").close()
            raise OSError("the machine went down")
        return measure(tries)

    spark.createDataFrame(ASSETS[:3] + ASSETS[:1], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    for left in (1, 0):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = sweeps.start(stream, crashing, "asset", path, f"{tmp_path}/cp")
        if left:
            with pytest.raises(Exception, match="went down"):
                q.awaitTermination(120)
            q.stop()
            spark.createDataFrame(ASSETS[3:], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        else:
            assert q.awaitTermination(120)
    # the batch cut off is done anew over its own files, the asset that came between is another batch
    q = sweeps.start(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), crashing, "asset", path, f"{tmp_path}/cp")
    assert q.awaitTermination(120)
    assert seen == ["jpeg", "keep-original", "webp"]
    points = sweeps.points(spark, path)
    assert in_order(points) == whole(spark)
    done = {r.asset: (r.done, r.failed, r.finished) for r in sweep.progress(points, STEPS, "asset").collect()}
    assert done == {1: (33, 3, True), 2: (32, 3, True), 3: (33, 32, True), 4: (32, 4, True)}
    half = {r.asset: r.finished for r in sweep.progress(points.where("stage <= 2"), STEPS, "asset").collect()}
    assert half == {1: False, 2: False, 3: False, 4: False}


def test_hull_members_go_by_key(spark):
    rows = [(1, 10, 0.5, 1, "webp", 40, 0.99), (1, 20, 0.1, 2, "webp", None, 0.99), (1, 30, 0.3, 3, "webp", 40, 0.99), (1, 15, 0.4, 4, "jpeg", 60, 0.99)]
    c = spark.createDataFrame(rows, "asset int, bytes long, distortion double, ord long, format string, quality int, ssim double")
    got = {r.ord: (r.key, r.on_hull) for r in hull.members(c, hull.hulls(c, "asset"), "asset").collect()}
    # a dearer encode of a member's key counts as a member, as its key does
    assert got == {1: ("webp:q40", True), 2: ("webp:lossless", True), 3: ("webp:q40", True), 4: ("jpeg:q60", False)}


def test_recoverers_in_order(spark):
    schema = "asset int, url string, local_path string, bytes long, listed array<struct<url:string,descriptor:string>>"
    assets = spark.createDataFrame(
        [(1, "https://e.example/a.jpg", "a.jpg", 50, [("git:h3:a.jpg", "2x"), ("https://e.example/a@2x.jpg", "3x")]), (2, None, "b.png", None, None), (3, "https://e.example/c", None, 9, None)], schema
    )
    log = spark.createDataFrame([(1, 0, "h1", "a.jpg", 50), (1, 1, "h2", "a.jpg", 80), (1, 2, "h3", "a.jpg", 70), (1, 3, "h4", "a.jpg", None), (2, 0, "g1", "b.png", 5), (2, 1, "g2", "b.png", 6)], "asset int, ord long, hash string, path string, size long")
    got = sorted(map(tuple, recover.proposals(assets, log, "asset", srcset_col="listed").collect()))
    assert got == [
        (1, 0, "https://e.example/a@2x.jpg", "srcset"), (1, 1, "git:h3:a.jpg", "srcset"), (1, 2, "https://e.example/a@3x.jpg", "retina"), (1, 3, "git:h2:a.jpg", "git-history"), (2, 0, "git:g2:b.png", "git-history"),
    ]
    assert recover.proposals(assets.limit(0), log, "asset").count() == 0
