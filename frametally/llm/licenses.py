"""Licence scan by diagonal voting.

Every rolling run of words of a document (pairs for short phrases, runs of four
for notices) is hashed; runs that stand in a template are joined, in Spark, with
the template's positions.  A shared run votes for a diagonal: its place in the
document less its place in the template.  Votes are counted for each diagonal;
neighbouring diagonals of one template, which words put in or left out tear
apart, are merged into spans; a span is verified by the share of the template's
words that its votes cover.

A base phrase is found where all its word pairs vote for one diagonal, that is
where its words stand consecutively.  The set of template hashes is fixed by
this package (some hundred runs), so it goes to the tasks to leave out runs that
no template has.

Defined results: a null text is empty; a document without places has null
first_word and last_word, empty labels and score 0; repeated rows are scanned
one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frametally.llm import bytekernels as bk
from frametally.llm.decontaminate import Terms
from frametally.llm.license_texts import BASE, NOTICES
from frametally.llm.shared import stored

PAIR, RUN = 2, 4
#: Diagonals this near are one span, if at most GAP document words lie between their votes.
SHIFT, GAP = 4, 12
#: A notice counts from this share of its words on.
SHARE = 0.5


def template_positions() -> list[tuple[int, int, str, int, int, bool]]:
    """(hash, template, label, place, words, base) of every run of every template."""
    out = []
    for i, (label, text) in enumerate(BASE + NOTICES):
        base = i < len(BASE)
        words = np.array([bk.word_hash(w.encode()) for w in text.split()], dtype=np.uint64)
        runs = bk.signed(bk.run_hashes(words, PAIR if base else RUN))
        out += [(int(h), i, label, at, len(words), base) for at, h in enumerate(runs)]
    return out


def shared_runs(text: Column) -> Column:
    """struct(n_words, hits array<struct(h, place)>) of each text: the runs that a template has too."""
    known = template_positions()
    sets = [(k, Terms(np.array([r[0] for r in known if r[5] == base], dtype=np.int64).view(np.uint64))) for k, base in ((PAIR, True), (RUN, False))]
    hit = pa.struct([("h", pa.int64()), ("place", pa.int64())])
    row = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(hit))])

    @F.arrow_udf("struct<n_words:long,hits:array<struct<h:long,place:long>>>")
    def scan(texts: pa.Array) -> pa.Array:
        count, many, hashes, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, buf, offsets in bk.text_chunks(texts):
            words, _, _, first = bk.word_hashes(buf, offsets, bk.WORD)
            count.append(np.diff(first))
            at, h, own = [], [], []
            for k, terms in sets:
                runs = bk.run_hashes(words, k)
                found = terms.among(runs)
                owner = np.searchsorted(first, found, side="right") - 1
                inside = found + k <= first[owner + 1]
                found, owner = found[inside], owner[inside]
                at.append(found - first[owner])
                h.append(runs[found])
                own.append(owner)
            own = np.concatenate(own)
            order = np.argsort(own, kind="stable")
            many.append(np.bincount(own, minlength=len(offsets) - 1))
            hashes.append(np.concatenate(h)[order])
            place.append(np.concatenate(at)[order])
        hits = pa.StructArray.from_arrays([pa.array(bk.signed(np.concatenate(hashes))), pa.array(np.concatenate(place))], fields=list(hit))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(many))]).astype(np.int32)), hits)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(count).astype(np.int64)), lists], fields=list(row))

    return scan(text)


def diagonals(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """(row, template, label, words, base, diagonal, votes, low, high): votes of rows (row, h, place) by offset."""
    known = spark.createDataFrame(template_positions(), "h long, template int, label string, at int, words int, base boolean")
    joined = runs.join(F.broadcast(known), "h").withColumn("diagonal", F.col("place") - F.col("at"))
    return joined.groupBy("row", "template", "label", "words", "base", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))


def notice_spans(votes: DataFrame) -> DataFrame:
    """(row, template, label, start, end, share) of notices: neighbouring diagonals merged, coverage verified."""
    mine = votes.where("not base").withColumn("start", F.col("diagonal") + F.col("low")).withColumn("end", F.col("diagonal") + F.col("high") + RUN)
    # a word is covered once for each diagonal; runs of one diagonal overlap in RUN - 1 words
    w = Window.partitionBy("row", "template").orderBy("start", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > SHIFT) | (F.col("start") - F.lag("end").over(w) > GAP) | (F.col("low") < F.lag("low").over(w))
    spans = mine.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w))
    covered = F.least(F.col("votes") + RUN - 1, F.col("high") - F.col("low") + RUN)
    found = spans.groupBy("row", "template", "label", "words", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(covered).alias("covered"))
    return found.withColumn("share", F.least(F.lit(1.0), F.col("covered") / F.col("words"))).where(F.col("share") >= SHARE).select("row", "template", "label", "start", "end", "share")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    score is the largest verified share of a template, 1 for a base phrase.
    """
    spark = docs.sparkSession
    index = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), shared_runs(F.col(text_col)).alias("r")), "runs")
    votes = stored(diagonals(spark, index.select("row", F.explode("r.hits").alias("x")).select("row", "x.h", "x.place")), "votes")
    base = votes.where("base and votes = words - 1").select("row", "label", F.lit(True).alias("base"), F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    notices = notice_spans(votes).select("row", "label", F.lit(False).alias("base"), "start", "share")
    own = F.when(F.col("base"), F.col("start"))
    found = base.unionByName(notices).groupBy("row").agg(
        F.count(own).alias("n_base"),
        F.min(own).alias("first_word"),
        F.max(own).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return index.select("row", "doc_id", F.col("r.n_words").alias("n_words")).join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
