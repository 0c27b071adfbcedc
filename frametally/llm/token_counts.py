"""Token counts of whole texts by a compiled tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametally.llm.bpe_transducer import Compiled

#: Bytes of text that are looked at together.
BATCH = 16 << 20
#: The one tokenizer that this worker has compiled, by its digest.
_compiled: dict[str, Compiled] = {}


def compiled(file: str) -> Compiled:
    digest = hashlib.sha256(file.encode()).hexdigest()
    if digest not in _compiled:
        _compiled.clear()
        _compiled[digest] = Compiled(file)
    return _compiled[digest]


def counts(machine: Compiled, texts: pa.Array) -> np.ndarray:
    """Tokens of each text, nulls as empty ones."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    out = np.zeros(len(texts), dtype=np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BATCH, side="right")) - 1)
        a, b = int(offsets[first]), int(offsets[last])
        if b > a:
            data = np.frombuffer(whole, dtype=np.uint8)[a:b]
            ends = (offsets[first + 1 : last + 1] - a).astype(np.int64)
            cuts = machine.cuts(data, ends)
            begins = np.concatenate([[0], cuts[cuts > 0]])
            pieces = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
            each = machine.pieces.count_all(pieces.dictionary.to_pylist())
            # a special string is one piece only where it stands as a token
            for special in machine.special:
                if (i := pc.index(pieces.dictionary, pa.scalar(special, pa.large_binary())).as_py()) >= 0:
                    each[i] = 1
            n = np.concatenate([[0], np.cumsum(each[pieces.indices.to_numpy()])])
            at = n[np.searchsorted(begins, np.concatenate([[0], ends]))]
            out[first:last] = np.diff(at)
        first = last
    return out


def counted(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text), by the byte-level tokenizer in a file.

    Without tokens at begin or end; a special token's string in a text is that
    token, as the library has it.  A null text counts as empty, with no tokens;
    rows without an id and repeated rows stay; other columns are not read.  The
    file, read on the driver, goes to all tasks: its size doesn't depend on docs.
    Each text is read once, in blocks, so that very long ones are no worse.
    """
    with open(tokenizer, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(file.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts(machine, batch.column(1)))], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
