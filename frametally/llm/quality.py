"""Quality classifier: a regularised quadratic discriminant over document statistics.

Every text is reduced to a few transformed statistics.  Class means and
covariances come from exact integer sums over all labelled training rows
(aggregated in Spark; the driver receives a few hundred sums, whatever the
input's size).  Each covariance is shrunk towards the pooled one and towards
its own mean variance; its Cholesky factor is computed once and shipped with
the scorer, and a text's score is the logistic of the difference of the two
Gaussian log densities (Mahalanobis distances by triangular solve).

Defined results: a null text is empty; an empty text is scored like any other;
labels that are null, or whose document is missing, are left out; repeated
rows count as often as they occur.  With fewer than ``MIN_ROWS`` training rows
in a class there is nothing to tell apart and every score is the share of label
1 (1.0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.llm import bytekernels as bk
from frametally.llm.shared import stored

FEATURES = (
    "log_words", "punctuation", "upper", "symbol_end", "word_length", "length_spread", "distinct",
    "repeat_next", "short_words", "digits", "pipes", "line_length", "distinct_lines", "stops", "bangs", "non_ascii",
)
#: Statistics are held as multiples of 2**-12, so that sums of products are exact integers.
GRID = 4096
MIN_ROWS = 8
#: What is added to each variance at least, so that equal rows can be fitted.
LEAST_VARIANCE = 1e-6

_kind = np.zeros((9, 256), dtype=bool)
_kind[0, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True  # punctuation and symbols
_kind[1, 0x41:0x5B] = True
_kind[2, 0x61:0x7B] = True
_kind[3, 0x30:0x3A] = True
_kind[4, ord("|")] = True
_kind[5, ord("\n")] = True
_kind[6, ord(".")] = True
_kind[7, ord("!")] = True
_kind[8, 0xC0:] = True
_SYMBOL_END = np.zeros(256, dtype=bool)
_SYMBOL_END[[ord(c) for c in "#&$%*!|@^~+=<>_/\\"]] = True


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n = len(offsets) - 1
    x = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets).astype(float)
    total = np.zeros((len(_kind), n))
    for i, k in enumerate(_kind):
        run = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(k[buf], out=run[1:])
        total[i] = run[offsets[1:]] - run[offsets[:-1]]
    h, starts, ends, first = bk.word_hashes(buf, offsets, bk.TOKEN)
    count = np.diff(first)
    words = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    owner = np.repeat(np.arange(n), count)

    def per(v: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=v, minlength=n) / words

    mean = per(length)
    order = np.lexsort((h, owner))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    newline = np.flatnonzero(buf == 10)
    # a line's hash is the sum of its words' hashes; lines are told apart within their text
    line_id = np.searchsorted(newline, starts) + owner
    if len(h):
        head = np.ones(len(h), dtype=bool)
        head[1:] = line_id[1:] != line_id[:-1]
        at = np.flatnonzero(head)
        lh, lo = np.add.reduceat(h, at), owner[at]
        by = np.lexsort((lh, lo))
        nl = np.ones(len(at), dtype=bool)
        nl[1:] = (lh[by][1:] != lh[by][:-1]) | (lo[by][1:] != lo[by][:-1])
        lines, unlike = np.bincount(lo, minlength=n), np.bincount(lo[by][nl], minlength=n)
    else:
        lines = unlike = np.zeros(n)
    letters = np.maximum(total[1] + total[2], 1)
    chars = np.maximum(size, 1)
    spread = np.sqrt(np.maximum(per(length * length) - mean * mean, 0))
    x[:, 0] = np.log1p(count)
    x[:, 1] = np.log(total[0] / chars + 0.005)
    x[:, 2] = np.log(total[1] / letters + 0.005)
    x[:, 3] = np.log(per(_SYMBOL_END[buf[ends - 1]].astype(float)) + 0.01) if len(h) else np.log(0.01)
    x[:, 4] = np.log(mean + 1)
    x[:, 5] = np.log(spread + 0.2)
    x[:, 6] = np.log(np.maximum(distinct, 1)) / np.log(words + 1.0)
    x[:, 7] = np.log(per(again.astype(float)) + 0.005)
    x[:, 8] = per((length <= 3).astype(float))
    x[:, 9] = np.log(total[3] / chars + 0.005)
    x[:, 10] = np.log(total[4] / words + 0.005)
    x[:, 11] = np.log((count + 1.0) / np.maximum(lines, 1))
    x[:, 12] = unlike / np.maximum(lines, 1)
    x[:, 13] = np.log(total[6] / words + 0.01)
    x[:, 14] = np.log(total[7] / words + 0.005)
    x[:, 15] = np.log(total[8] / chars + 0.005)
    return np.rint(np.clip(x, -16, 16) * GRID) / GRID


def text_statistics(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b, buf, offsets in bk.text_chunks(texts):
        out[a:b] = statistics(buf, offsets)
    return out


def features(text: Column) -> Column:
    """FEATURES of each text as an array of doubles."""

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        x = text_statistics(texts)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())

    return stats(text)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors (lower) and log terms of both classes; constant where there was nothing to fit."""

    constant: float | None
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    offset: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            density.append(self.offset[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of the grid multiples of each class of a batch."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        x = np.rint(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1) * GRID).astype(np.int64)
        for c in (0, 1):
            own = x[label == c]
            if len(own):
                v = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                yield pa.record_batch([pa.array([c] * len(v), pa.int32()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["label", "i", "v"])


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """The discriminant of labelled rows (x array<double>, label int 0 or 1)."""
    d = len(FEATURES)
    rows = (
        labelled.where("label in (0, 1) and x is not null")
        .select("x", F.col("label").cast("int").alias("label"))
        .mapInArrow(_sums, "label int, i int, v long")
        .groupBy("label", "i")
        .agg(F.sum("v").alias("v"))
        .collect()  # 2 x (1 + d + d*d) sums at most
    )
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r.label, r.i] = r.v
    n = total[:, 0]
    if n.min() < MIN_ROWS:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 1.0)
    mean = total[:, 1 : 1 + d] / n[:, None] / GRID
    scatter = total[:, 1 + d :].reshape(2, d, d) / GRID**2 - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    factor, offset = [], []
    for c in (0, 1):
        s = (1 - shrink) * scatter[c] / n[c] + shrink * pooled
        # statistics that are equal in all labelled rows have no variance to take a share of
        s += np.eye(d) * max(ridge * np.trace(s) / d, LEAST_VARIANCE)
        low = np.linalg.cholesky(s)
        factor.append(np.linalg.solve(low, np.eye(d)))
        offset.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(None, mean, np.array(factor), np.array(offset))


def score(model: Discriminant, x: Column) -> Column:
    """The model's score (label 1 likelier: higher) of an array of FEATURES."""

    @F.arrow_udf("double")
    def scored(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)))

    return scored(x)


def text_score(model: Discriminant, text: Column) -> Column:
    """The model's score of a text."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(text_statistics(texts)))

    return scored(text)


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32(id as text) mod folds, by which rows are held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row of docs, stored in the shared folder."""
    return stored(docs.select(F.col(id_col).alias("doc_id"), features(F.col(text_col)).alias("x")), "quality")


def train(doc_features: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held: int = 1) -> Discriminant:
    """Fits on the labelled rows that aren't held out."""
    seen = labels.where(remainder(F.col("doc_id"), folds) != held).select("doc_id", F.col(label_col).alias("label"))
    return fit(doc_features.join(seen, "doc_id").select("x", "label"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    known = document_features(docs)
    model = train(known, labels, folds=folds, held=held)
    return known.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), score(model, F.col("x")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
