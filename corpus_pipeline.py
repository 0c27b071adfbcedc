"""A training-corpus pipeline: filter, deduplicate, decontaminate and mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which :func:`run` writes as Parquet to the shared
folder and reads again as the next stage's docs.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametally.llm import decontaminate, mixing, quality, repeats, simhash
from frametally.llm.shared import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 1.

    Trained on the labelled rows of docs that aren't held out.
    """
    model = quality.train(quality.document_features(docs), table(spark, sf_dir, "labels"))
    return docs.where(quality.text_score(model, F.col("text")) >= 0.5)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id.

    Five-word shingles, a likeness of 0.8 or more.  Of rows with one id, one stays; rows without an id stay.
    """
    found = simhash.similar(docs, 0.8, k=5)
    kept = stored(found.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of about 50 words or more that repeat in or across them; n_chars follows the text."""
    cut = repeats.without_repeats(docs, repeats.PASSAGE, repeats.PASSAGE_ANCHOR)
    text = F.when(F.col("text").isNotNull(), F.col("kept.text"))
    return cut.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (decontaminate.text_hash(F.col("text")) == F.col("_hash")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-duplicates", one_of_near_duplicates),
    ("suffix-array repeats", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("source mixing", mixed),
]

#: No SQL expresses the classifier, the fingerprints or the draws of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
