"""What the findings of round 3 named, on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from frametally.operators import pixels, resize
from frametally.plans.queries import ORACLE_SQL, QUERIES


def test_bilinear_takes_targets_with_all_four_pixels_only(spark):
    full = [(1, x, y, float(10 * y + x)) for y in range(3) for x in range(3)]
    rows = full + [(2, *r[1:]) for r in full if r[1:3] != (2, 2)] + [(3, x, y, None if (x, y) == (0, 0) else v) for _, x, y, v in full]
    sizes = spark.createDataFrame([(i, 3, 3, 5, 5) for i in (1, 2, 3)], "image int, w int, h int, tw int, th int")
    got = {(r.image, r.x, r.y): r.value for r in resize.bilinear(spark.createDataFrame(rows, "image int, x int, y int, value double"), sizes, "image").collect()}

    def place(t):
        return min(max((t + 0.5) * 3 / 5 - 0.5, 0), 2)

    want = {(x, y): 10 * place(y) + place(x) for x in range(5) for y in range(5)}
    assert {k[1:]: v for k, v in got.items() if k[0] == 1} == pytest.approx(want)
    # of an image without its last pixel, the targets that need it have no row
    assert {k[1:] for k in got if k[0] == 2} == {(x, y) for x, y in want if place(x) < 1 or place(y) < 1}
    assert {k[1:] for k, v in got.items() if k[0] == 3 and v is None} == {(x, y) for x, y in want if place(x) < 1 and place(y) < 1}


def test_rollup_on_halves_is_that_of_decimals(spark, tmp_path):
    # PNG files of which 18 hundredths can be saved, which of such sizes is half a byte more
    parts = [(576 + 1008 * i, 30, (15025 + 50 * i) / 16) for i in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert tuple(QUERIES["audit_rollup"](spark, str(tmp_path)).first()) == duck.execute(ORACLE_SQL["audit_rollup"]).fetchall()[0]


def test_few_large_files_are_dealt_to_all_tasks(spark, sf):
    from frametally.plans.views import view

    least = 2 * spark.sparkContext.defaultParallelism
    assert view(spark, sf, "part").rdd.getNumPartitions() >= least and view(spark, sf, "embeddings").rdd.getNumPartitions() >= least
    # what is made of a row is made in the task that it was dealt to: no second shuffle, and no broadcast of the rows
    for name in ("scaled_tables", "source_proposals", "table_quality"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and plan.count("Exchange hashpartitioning") == 1, name


def test_a_file_on_many_pages_is_read_once(spark, sf):
    from frametally.operators import audit
    from frametally.plans.views import view

    files = view(spark, sf, "jpegs").selectExpr("file_id", "unhex(hexbytes) AS content").where("file_id <= 12")
    # file 13 is missing; of each page one image can't be fetched and one is beyond the first four
    items = spark.createDataFrame([(p, i, f"/{p}/{i}", 1 + (p + i) % 13, None if i == 2 else 500 * i, 90, 60, 40, 30) for p in range(13) for i in range(6)], "page long, idx int, url string, file_id long, length long, attr_w long, attr_h long, display_w long, display_h long")
    caps = {"images": 5, "head": 900, "total": 8000}
    once, each = audit.assets(items, **caps, files=files), audit.assets(items.join(files, "file_id", "left"), **caps)
    shown = [c for c in each.columns if c != "content"]
    assert sorted(map(repr, once.select(*shown).collect())) == sorted(map(repr, each.select(*shown).collect()))
    # no Python function of a header runs on rows of items
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "idx" not in plan[plan.index("ArrowEvalPython") :] if "ArrowEvalPython" in plan else False


def test_blank_ends_of_receipts_are_cut_without_a_pattern(spark):
    from frametally.sources import receipts

    lines = spark.createDataFrame([(i, raw) for i, raw in enumerate([" \t\x0b{}\r\n", "\f \n", None, "", "\u00a0", "[1]  "])], "line int, raw string")
    parsed = receipts.parse(lines)
    assert {r.line: r.raw for r in parsed.collect()} == {0: "{}", 4: "\u00a0", 5: "[1]"}
    assert "regexp_replace" not in parsed._jdf.queryExecution().optimizedPlan().toString()


def test_a_block_is_one_row_of_sums_from_before_the_shuffle_on(spark, sf):
    p = spark.range(64 * 6).select((F.col("id") % 24).alias("x"), F.expr("id div 24").alias("y"), (F.col("id") % 251).cast("double").alias("value"), F.expr("id div 192").alias("image"))
    for made in (pixels.dct_blocks(p, "image"), pixels.encoded(p, "image", steps=(F.lit(3.0), F.lit(5.0)))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        # the sums of pixels before the shuffle and those after it, and no others over pixels or coefficients
        assert plan.count("HashAggregate(keys=[image") == 2 and plan.count("Exchange hashpartitioning(image") == 1
    # all generations of an image come from one shuffle of its blocks, the other aggregates are of its histogram
    plan = QUERIES["made_generations"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image") == 1 and plan.count("HashAggregate(keys=[image") == 2


def test_blocks_left_of_zero_and_blocks_of_nulls(spark):
    full = [(1, x, y, float(3 * x + y)) for y in range(8) for x in range(-8, 8)]
    nulls = [(2, x, y, None) for y in range(8) for x in range(8)] + [(3, x, y, None if x == y else 130.0) for y in range(8) for x in range(8)]
    made = spark.createDataFrame(full + nulls, "image int, x int, y int, value double")
    got = {(r.image, r.block_x, r.u, r.v): r.coefficient for r in pixels.dct_blocks(made, "image").collect()}
    assert len(got) == 4 * 64 and {got[2, 0, u, v] for u in range(8) for v in range(8)} == {None}
    assert got[1, -1, 0, 0] == pytest.approx(8 * (-13.5 + 3.5 - 128)) and got[1, 0, 0, 0] == pytest.approx(8 * (10.5 + 3.5 - 128))
    assert got[3, 0, 0, 0] == pytest.approx(56 * 2 / 8)  # a null adds nothing to a sum
    back = {(r.x, r.y): r.value for r in pixels.pixels_of(pixels.dct_blocks(made.where("image = 1"), "image"), "image").collect()}
    assert back == pytest.approx({(x, y): v for _, x, y, v in full})


def test_planes_without_a_label_are_of_no_image(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 2 == 0, F.col("label"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("made_generations", "encode_generations"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(duck.execute(ORACLE_SQL[name]).fetchall()), name
