"""Shards of bounded bytes by extendible hashing (native).

A shard is a bucket of all documents whose hash begins with certain bits. One pass sums bytes in a directory indexed by a
few more bits than the average shard needs; a bucket is split on another bit only where it is over the limit, so hot
regions get deeper shards and the rest stays shallow. The directory grows with the number of shards, never with the rows
of one; documents meet it on their leading bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depvital.llm.common import keep_table, lookup, named

#: Bits of the hash (fifteen hexadecimal digits), and directory bits beyond those of an average shard.
HASH_BITS = 60
SPARE_BITS = 3
#: Bits that name the shard of one hash that is over the limit, whatever the directory's width.
LONE_BITS = 40
MORE_BITS = 6


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def shard_directory(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The directory over rows (hash, bytes), and its number of bits."""
    size = rows.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    bits = min(HASH_BITS, math.ceil(math.log2(max(1.0, size / limit))) + SPARE_BITS)
    while True:
        cell = F.shiftright("hash", HASH_BITS - bits).alias("cell")
        sums = F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("hash").alias("low"), F.max("hash").alias("high")
        cells = keep_table(rows.groupBy(cell).agg(*sums), "shard-cells")
        if bits == HASH_BITS or cells.where((F.col("bytes") > limit) & (F.col("low") < F.col("high"))).isEmpty():
            break
        bits = min(HASH_BITS, bits + MORE_BITS)
    paths = cells.select("cell", "bytes", "docs", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    paths = paths.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    buckets = keep_table(paths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")), "buckets")
    split = buckets.where((F.col("bytes") > limit) & (F.col("depth") < bits)).select(F.col("depth").alias("parent_depth"), F.col("prefix").alias("parent"))
    inner = (F.col("depth") == F.col("parent_depth") + 1) & (F.shiftright("prefix", 1) == F.col("parent"))
    reached = buckets.join(split, inner, "left").where((F.col("depth") == 0) | F.col("parent").isNotNull())
    leaves = reached.where((F.col("bytes") <= limit) | (F.col("depth") == bits)).select("depth", "prefix", "bytes", "docs")
    directory = paths.select("cell", "depth", "prefix", "low", "high").join(leaves, ["depth", "prefix"])
    lone = (F.col("bytes") > limit) & (F.col("low") == F.col("high")) & (F.col("depth") < LONE_BITS)
    prefix = F.when(lone, F.shiftright("low", HASH_BITS - LONE_BITS)).otherwise(F.col("prefix"))
    return directory.withColumns({"prefix": prefix, "depth": F.when(lone, F.lit(LONE_BITS)).otherwise(F.col("depth"))}), bits


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, depth, bytes, shard_docs, shard_bytes, over_limit) for each row; shard is the bucket's leading bits.

    `bytes` is the text's length in UTF-8, 0 for null and empty texts. Every shard has at most `limit` bytes, unless all
    its documents share one hash: a document longer than the limit, or repeated rows of one identifier; such a shard holds
    nothing else that could be split off, is named by LONE_BITS bits and is marked over_limit. Null identifiers are placed by the hash of their text.
    Other columns are not read. An empty table gives an empty result.
    """
    text = named(text_col).cast("string")
    key = F.coalesce(named(id_col).cast("long").cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), _hash(key).alias("hash"))
    rows = keep_table(rows, "shard-rows")
    directory, bits = shard_directory(rows, limit)
    bits_of = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    directory = directory.select(
        "cell", bits_of.alias("shard"), "depth", F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"), (F.col("bytes") > limit).alias("over_limit")
    )
    celled = rows.select("doc_id", "bytes", F.shiftright("hash", HASH_BITS - bits).alias("cell"))
    return lookup(celled, directory, ["cell"]).select("doc_id", "shard", "depth", "bytes", "shard_docs", "shard_bytes", "over_limit")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as Parquet, one folder `shard=...` for each shard; identifiers are unique and not null here."""
    shards = placed.select(F.col("doc_id").alias(id_col), F.concat(F.lit("b"), F.col("shard")).alias("shard"))
    docs.join(shards, id_col).repartition("shard").write.partitionBy("shard").parquet(path)
