"""Receipts: one JSON object a line, read with every problem named, and written with every key."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DECISIONS = ("encoded", "kept", "refused", "skipped")
KEYS = "v ts asset sourceHash outputHash sourceRecovered reference decision reason output before metrics weight lambda provenance encoder tool".split()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw) of receipt files, lines from 1; large files are read in blocks by many tasks.

    Ids ascend within a block, so a line's number is its place in the block and
    the lines of the blocks before it; of each block one row is shuffled.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("raw"))
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("_before", before).drop("_n")
    return lines.join(placed, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int").alias("line"), "raw")


#: Key -> what its value must be: kinds of values, or the fields of an object and whether it may be null instead.
FIELDS: dict[str, str | tuple[dict[str, str], bool]] = {
    "v": "one",
    "ts": "text",
    "asset": "text",
    "sourceHash": "text",
    "outputHash": "text null",
    "sourceRecovered": ({"from": "text", "via": "text"}, True),
    "reference": ({"w": "count", "h": "count", "hash": "text"}, False),
    "decision": "decision",
    "reason": "string null",
    "output": ({"format": "text", "quality": "number null", "bytes": "number"}, True),
    "before": ({"format": "text", "bytes": "number"}, False),
    "metrics": ({"ssim": "number", "deltaE": "number", "distortion": "number"}, True),
    "weight": "number null",
    "lambda": "number null",
    "provenance": ({"generations": "number null", "estimatedOriginalQuality": "number null", "headroom": "headroom"}, True),
    "encoder": "string null",
    "tool": "text",
}
#: Keys that an encoded entry must not have null.
ENCODED = ("outputHash", "output", "metrics")


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


_KINDS = {
    "null": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "text": lambda x: isinstance(x, str) and x != "",
    "number": _number,
    "count": lambda x: _number(x) and x > 0 and x == int(x),
    "one": lambda x: _number(x) and x == 1,
    "decision": lambda x: isinstance(x, str) and x in DECISIONS,
    "headroom": lambda x: isinstance(x, str) and x in ("normal", "low", "none"),
}
_NAMES = {"null": "null", "string": "text", "text": "text", "number": "a number"}


@lru_cache(maxsize=None)
def _checks(kinds: str) -> tuple:
    return tuple(_KINDS[k] for k in kinds.split())


def _is(value: object, kinds: str) -> bool:
    for check in _checks(kinds):
        if check(value):
            return True
    return False


def _listed(names: list[str]) -> str:
    return names[0] if len(names) == 1 else f"{', '.join(names[:-1])} and {names[-1]}"


def _message(key: str, rule: str | tuple[dict[str, str], bool]) -> str:
    if isinstance(rule, tuple):
        return f"{key} must have {_listed(list(rule[0]))}" + ", or be null" * rule[1]
    special = {"one": f"{key} must be 1", "decision": f"{key} is unknown"}
    return special.get(rule) or f"{key} must be " + " or ".join(_NAMES[k] for k in rule.split())


def problem(entry: object) -> str | None:
    """The first problem of a parsed line, in order of the keys."""
    if not isinstance(entry, dict):
        return "not an object"
    for key, rule in FIELDS.items():
        value = entry.get(key, entry)  # the entry itself is of no kind
        if isinstance(rule, tuple):
            fields, nullable = rule
            ok = value is None and nullable or isinstance(value, dict) and value is not entry and all(_is(value.get(f, entry), kinds) for f, kinds in fields.items())
        else:
            ok = _is(value, rule)
        if not ok:
            return _message(key, rule)
    if entry["decision"] == "encoded" and any(entry[k] is None for k in ENCODED):
        return f"an encoded entry must have {_listed(list(ENCODED))}"
    return None


def _no_constant(name: str) -> None:
    raise ValueError(name)


_FOUND = (("asset", "asset"), ("decision", "decision"), ("source_hash", "sourceHash"), ("output_hash", "outputHash"))


def judged(raw: Column) -> Column:
    """struct(reason, asset, decision, source_hash, output_hash) of each line, parsed once in Arrow batches."""
    kind = pa.struct([pa.field(n, pa.string()) for n in ("reason", *dict(_FOUND))])

    @F.arrow_udf(", ".join(f"{f.name} string" for f in kind).join(("struct<", ">")).replace(" string", ":string"))
    def judge(lines: pa.Array) -> pa.Array:
        out: list[list[str | None]] = [[] for _ in kind]
        for line in lines.to_pylist():
            try:
                entry = json.loads(line, parse_constant=_no_constant)
                reason = problem(entry)
            except (ValueError, RecursionError, OverflowError):
                entry, reason = None, "invalid JSON"
            got = entry if isinstance(entry, dict) else {}
            out[0].append(reason)
            for column, (_, k) in zip(out[1:], _FOUND):
                column.append(v if isinstance(v := got.get(k), str) else None)
        return pa.StructArray.from_arrays([pa.array(column, pa.string()) for column in out], fields=list(kind))

    return judge(raw)


def parse(lines: DataFrame) -> DataFrame:
    """lines (..., raw) that aren't blank, with ``reason`` (null: valid) and the fields that joins need."""
    trimmed = lines.withColumn("raw", F.btrim("raw", F.lit(" \t\n\x0b\f\r"))).where("raw <> ''")
    return trimmed.withColumn("_r", judged(F.col("raw"))).select(*lines.columns, "_r.*")


def to_json(entry: Column) -> Column:
    """A receipt as one line; keys with null stay."""
    return F.to_json(entry, {"ignoreNullFields": "false"})
