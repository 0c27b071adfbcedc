"""What the finding of round 4 named: nothing that grows with pixels or files is sent to the driver, and records are the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametally.operators import headers, pixels, provenance, quant
from frametally.plans.views import view
from tests.test_evidence import jpeg, scaled, table

@pytest.fixture(scope="module")
def shown(spark, tmp_path_factory):
    """Pictures of noise as a table, and files: 1 was encoded before, 3 has no file, that of 4 ends before its tables, 5 is small and has two files; more files have no picture."""
    rng = np.random.default_rng(5)
    sizes = {1: (128, 256), 2: (128, 256), 3: (32, 32), 4: (32, 32), 5: (32, 32)}
    made = [(i, x, y, float(v)) for i, s in sizes.items() for y, row in enumerate(np.clip(np.round(128 + rng.normal(0, 25, s)), 0, 255)) for x, v in enumerate(row)]
    raw = spark.createDataFrame(made, "image int, x int, y int, value double")
    at = str(tmp_path_factory.mktemp("shown"))
    pixels.encoded(raw.where("image = 1"), "image", steps=(F.lit(5.0),)).unionByName(raw.where("image > 1")).write.parquet(f"{at}/pixels")
    good = jpeg(table(0, [2] * 64), table(1, scaled(quant.STANDARD_CHROMA, 75)))
    files = [(1, good), (2, good), (4, good[:20]), (5, good), (5, b"\xff\xd8\xff\xda\x00\x02\xff\xd9"), (None, good), (8, None)] + [(i, good) for i in range(100, 900)]
    spark.createDataFrame(files, "image int, content binary").repartition(4).write.parquet(f"{at}/files")
    return spark.read.parquet(f"{at}/pixels"), spark.read.parquet(f"{at}/files")


def test_generations_are_those_of_each_coefficient_with_its_step(spark, shown):
    p, files = shown
    values = headers.read(files).where("luma is not null").select("image", F.posexplode("luma.values").alias("at", "step")).selectExpr("image", "at % 8 AS u", "at div 8 AS v", "step")
    each = pixels.dct_blocks(p, "image").join(values, ["image", "u", "v"])
    want = {r.image: r.generations for r in pixels.generations(pixels.periodicity(pixels.quantised_histogram(each, F.col("step"), "image"), "image"), "image").collect()}
    got = sorted((r.image, r.container, r.generations, r.subsampling or "") for r in provenance.measured(p, files, "image").collect())
    assert want == {1: 2, 2: 1, 5: None}
    assert got == [(1, "jpeg", 2, "4:2:0"), (2, "jpeg", 1, "4:2:0"), (3, "png", None, ""), (4, "jpeg", None, ""), (5, "jpeg", None, ""), (5, "jpeg", None, "4:2:0")]


def nodes(plan):
    """The nodes of an executed plan, those of its finished stages included."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))


def broadcast_rows(df):
    df.collect()
    return [n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "BroadcastExchangeExec"]


def test_no_coefficient_of_a_picture_is_sent_to_the_driver(spark, shown):
    p, files = shown
    sent = broadcast_rows(provenance.measured(p, files, "image"))
    # sizes and numbers of the five pictures, and the files that are theirs; not 400 blocks of each, nor 64 coefficients of a block
    assert sent and max(sent) <= 6


def test_files_are_not_joined_with_themselves(spark, sf):
    files = view(spark, sf, "jpegs")
    kinds = view(spark, sf, "part").selectExpr("p_partkey % 12", "p_size").distinct().count()
    assert max(broadcast_rows(files)) <= max(kinds, 256)
    # read for the files and for one of each kind
    assert files._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("FileScan parquet") == 2
