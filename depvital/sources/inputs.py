"""Package and repository lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depvital.operators.keys import input_kind

UNRECOGNISED_LIMIT = 0.5


def parse_line_range(text: str) -> tuple[int, int | None]:
    """START:END or START: with 1-based inclusive numbers."""
    found = re.fullmatch(r"\s*(\d+)\s*:\s*(\d*)\s*", text)
    if not found or int(found[1]) < 1:
        raise ValueError("line range must be START:END with START >= 1")
    start, end = int(found[1]), int(found[2]) if found[2] else None
    if end is not None and end < start:
        raise ValueError("line range must end at or after its start")
    return start, end


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of list files: path, line_no (from 1), line.

    Files are read in splits by many tasks. A first pass counts the lines of each split, a table with one row per split;
    its running sums per file, added to a line's place in its split, number the lines. Both passes pack the splits alike,
    so a line has the same identifier in them.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )
    splits = lines.groupBy("path", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("path", "split", "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    numbered = lines.join(before, ["path", "split"])
    return numbered.select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))


def classify_lines(lines: DataFrame, line_range: str | None = None) -> DataFrame:
    """Content lines with their kind; blank and # lines are skipped, outside the range nothing is read."""
    trimmed = F.btrim("line", F.lit(" \t\r\n"))
    if line_range:
        start, end = parse_line_range(line_range)
        lines = lines.where(F.col("line_no") >= start)
        lines = lines if end is None else lines.where(F.col("line_no") <= end)
    return lines.withColumn("line", trimmed).where("line <> '' AND line NOT LIKE '#%'").withColumn(
        "kind", input_kind(F.col("line"))
    )


def file_quality(classified: DataFrame, key: str = "file_id") -> DataFrame:
    """Share of unrecognised lines per file; a file with more than half of them fails."""
    return classified.groupBy(key).agg(
        F.count(F.lit(1)).alias("content_lines"),
        F.count_if(F.col("kind") == "package").alias("packages"),
        F.count_if(F.col("kind") == "repository").alias("repositories"),
        F.avg((F.col("kind") == "unrecognised").cast("double")).alias("unrecognised_share"),
    ).withColumn("failed", F.col("unrecognised_share") > UNRECOGNISED_LIMIT)


def read_inputs(lines: DataFrame, key: str = "file_id", line_range: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Recognised inputs of the files that pass, and the quality of every file."""
    classified = classify_lines(lines, line_range)
    quality = file_quality(classified, key)
    passed = quality.where("NOT failed").select(key)
    return classified.where("kind <> 'unrecognised'").join(passed, key, "left_semi"), quality
