"""Older versions of a file in version history that are larger than what is in use.

A log is a table (key, ord, hash, path, size), newest first by ord; a size is
null where the version can't be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ENTRY = r"(?m)^[ \t]*([0-9a-f]{40})[ \t]*\n\s*(?![0-9a-f]{40}[ \t]*$)(\S[^\n]*)"


def parse_log(text: Column) -> Column:
    """array<struct(hash, path)> of a log that prints each commit's hash and the file's path at it, newest first."""
    hashes, paths = (F.regexp_extract_all(F.regexp_replace(text, "\r", ""), F.lit(_ENTRY), F.lit(i)) for i in (1, 2))
    return F.zip_with(hashes, paths, lambda h, p: F.struct(h.alias("hash"), F.trim(p).alias("path")))


def relative_path(path: Column, top: Column) -> Column:
    """The path below a repository's top folder, whatever the case and the slashes; null where it lies elsewhere."""
    file, root = F.replace(path, F.lit("\\"), F.lit("/")), F.replace(top, F.lit("\\"), F.lit("/"))
    root = F.when(root.endswith("/"), root).otherwise(F.concat(root, F.lit("/")))
    rest = F.substr(file, F.length(root) + 1)
    return F.when((root != "/") & F.lower(file).startswith(F.lower(root)) & (rest != ""), rest)


def proposals(assets: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """(key, ord, url, via, size): versions larger than the asset's bytes, or than its newest readable version where
    those aren't known, largest first; each version once, and never what is in use (url, local_path)."""
    sized = log.where("size >= 0")
    newest = sized.groupBy(key).agg(F.min_by("size", "ord").alias("newest"))
    url = F.concat(F.lit("git:"), "hash", F.lit(":"), "path")
    found = sized.join(newest, key).join(assets.select(key, F.col("url").alias("own"), "local_path", "bytes"), key).withColumn("url", url)
    found = found.where((F.col("size") > F.coalesce("bytes", "newest")) & ~F.col("url").eqNullSafe(F.col("own")) & ~F.col("url").eqNullSafe(F.col("local_path")))
    once = found.groupBy(key, "url").agg(F.max(F.struct("size", (-F.col("ord")).alias("at"))).alias("v"))
    order = Window.partitionBy(key).orderBy(F.desc("v.size"), F.desc("v.at"), "url")
    return once.select(key, (F.row_number().over(order) - 1).alias("ord"), "url", F.lit("git-history").alias("via"), F.col("v.size").alias("size"))


def more_than(items: Column, most: int = 10) -> Column:
    """The first items of a list as lines, and how many more there are."""
    rest = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), "\n"), F.when(rest > 0, F.concat(F.lit("\nand "), rest.cast("string"), F.lit(" more"))).otherwise(""))


def dirty_files(status: Column) -> Column:
    """Paths of a porcelain status that aren't clean; of a renamed file the new one."""
    lines = F.filter(F.split(F.regexp_replace(status, "\r", ""), "\n"), lambda x: F.length(x) > 3)
    return F.transform(lines, lambda x: F.regexp_replace(F.substr(x, F.lit(4)), "^.* -> ", ""))
