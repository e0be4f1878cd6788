"""Exact deduplication by sorting contents (native).

Texts are range-partitioned by sampled splitters over (leading bytes, digest, identifier), sorted inside each range
with spilling, and every text is compared in full with its neighbour. A group of copies that crosses ranges is put
together again from one row per range it touches, so a group with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depvital.llm.common import keep_table, named, range_of

#: Bytes of text sorted together, and splitter samples drawn for each range.
RANGE_BYTES = 8 << 20
RANGE_ROWS = 20_000
SAMPLES_PER_RANGE = 48
#: Leading bytes in the sort key; a digest follows, so keys and splitters stay short however long the texts are.
PREFIX_BYTES = 24
_SIGN = -(1 << 63)


def _descending(ids: Column) -> Column:
    """Hexadecimal string that sorts long values from the largest to the smallest, null last."""
    flipped = F.bitwise_not(ids).bitwiseXOR(F.lit(_SIGN))
    return F.coalesce(F.lpad(F.hex(flipped), 16, "0"), F.lit("Z"))


def _splitters(keys: DataFrame, rows: int, ranges: int) -> list[str]:
    """`ranges - 1` keys that cut a sample of the sorted keys evenly."""
    fraction = min(1.0, SAMPLES_PER_RANGE * ranges / rows)
    cut = F.expr(f"transform(sequence(1, {ranges - 1}), i -> get(s, cast(i * size(s) / {ranges} as int)))")
    sample = keys.sample(fraction, 7).agg(F.sort_array(F.collect_list("key")).alias("s"))
    found = sample.select(F.array_sort(F.array_distinct(F.array_compact(cut))).alias("cuts")).first()
    return list(found["cuts"])


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Group identical (normalised) texts; the row with the largest identifier of each group stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row. A null text counts as empty; empty
    texts form a group like any other. Null identifiers sort last and are kept only in a group without others. Of
    repeated rows with one identifier and one text, one is kept. Other columns of the input are not read. An empty
    table gives an empty result.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    ranges = 1 + (size["b"] or 0) // range_bytes + size["n"] // RANGE_ROWS

    prefix = F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")
    content = rows.withColumn("digest", F.sha2("text", 256)).withColumn("content", F.concat(prefix, "digest"))
    key = F.concat("content", _descending(F.col("doc_id")))
    cuts = _splitters(content.select(key.alias("key")), size["n"], ranges) if ranges > 1 else []
    table = F.split(F.lit(",".join(cuts)), ",")
    dealt = content.withColumn("range", range_of(key, table, len(cuts)) if cuts else F.lit(0))

    # neighbours in the sorted range: a new run starts where the full text differs from the one before
    inside = Window.partitionBy("range").orderBy("content", "text", F.col("doc_id").desc_nulls_last())
    before = F.lag("text").over(inside)
    differs = before.isNull() | (before != F.col("text"))
    at_edge = before.isNull() | F.lead(F.lit(1)).over(inside).isNull()
    compared = dealt.select(
        "doc_id",
        "range",
        "digest",
        F.row_number().over(inside).alias("place"),
        differs.alias("starts"),
        (~differs & F.lag("doc_id").over(inside).eqNullSafe(F.col("doc_id"))).alias("again"),
        F.when(at_edge, F.col("text")).alias("edge_text"),
    )
    ordered = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = compared.withColumn("run", F.sum(F.col("starts").cast("int")).over(ordered))
    one_run = Window.partitionBy("range", "run")
    runs = runs.withColumns({"size": F.count(F.lit(1)).over(one_run), "best": F.max("doc_id").over(one_run)})
    runs = keep_table(runs.drop("place", "starts"), "exact-runs")

    # runs at the ends of ranges may go on in the next range
    ends = runs.where(F.col("edge_text").isNotNull()).dropDuplicates(["range", "run"])
    whole = ends.groupBy("digest", "edge_text").agg(
        F.sum("size").alias("all_size"), F.max("best").alias("all_best"), F.count(F.lit(1)).alias("parts")
    )
    joined = (
        ends.join(whole.where("parts > 1"), ["digest", "edge_text"])
        .select("range", "run", "all_size", "all_best", F.lit(True).alias("spans"))
    )
    keep_id = F.when(F.col("spans"), F.col("all_best")).otherwise(F.col("best"))
    return (
        runs.drop("edge_text")
        .join(joined, ["range", "run"], "left")
        .withColumn("keep_id", keep_id)
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("all_size", "size").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("again")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )
