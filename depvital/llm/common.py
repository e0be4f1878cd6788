"""Helpers shared by the operators: tables kept in the shared folder and look-ups that survive hot keys."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from depvital.session import ensure_checkpoint_dir

#: Copies of each look-up row; a key with a third of all probing rows is dealt to so many tasks.
SALTS = 8


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package wherever they were started; clusters install it or ship it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """Column by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nullable(schema: StructType) -> StructType:
    """The schema with all columns nullable, as a Python task's output has to be declared."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def new_folder(spark: SparkSession, label: str) -> str:
    """Unused folder below the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep_table(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them from there; cuts lineage, outlives executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables that `keep_table` wrote, once nothing that is still to run reads them."""
    for table in tables:
        files = table.inputFiles()
        if files:
            jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
            path = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join slim rows with a table that has one row per key; a hot key's left rows are spread over `salts` tasks.

    `right` is repeated once per salt, so it should hold no more columns than needed.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*[named(c) for c in left.columns]), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def range_of(key: Column, cuts: Column, count: int) -> Column:
    """How many of the `count` sorted values in the array `cuts` are not above the key, by binary search."""
    steps = [1 << b for b in range(count.bit_length() - 1, -1, -1)]
    start = F.struct(F.lit(0).alias("n"), key.alias("key"))  # the key is computed once, not in each step

    def step(state: Column, width: Column) -> Column:
        n = state["n"] + width
        return F.struct(F.when(F.get(cuts, n - 1) <= state["key"], n).otherwise(state["n"]).alias("n"), state["key"].alias("key"))

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), start, step, lambda state: state["n"])
