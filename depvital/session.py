"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "depvital", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs expect; cluster settings given elsewhere are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package wherever they were started; clusters install it or ship it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session; a local one is made only for local masters."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="depvital-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and read them from there.

    The plan runs once, later reads are pruned by column, and a lost executor costs no recomputation.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    typed = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    typed.write.parquet(path)
    return df.sparkSession.read.schema(typed.schema).parquet(path)


def use_buckets(spark: SparkSession) -> None:
    """Before bucketed tables are read: let unions not take over their partitioning.

    The planner leaves out exchanges above a union of two tables of as many buckets, yet such a union of columnar scans, or
    of scans whose buckets were given up as unneeded, only strings the tables' partitions together: keys would be split.
    Tables of as many buckets are joined as they lie also where the join has further keys beside that of the buckets.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def cut_by(df: DataFrame, key: str, dealt: bool = False, more: Sequence[DataFrame] = ()) -> DataFrame:
    """``cut_lineage`` into a table bucketed by a key: joins on it with tables of as many buckets need no exchange.

    Rows that come from such a table by the same key are ``dealt`` already and written as they lie. ``more`` frames, dealt
    alike, follow them in the same table, where a union would be dealt anew.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    use_buckets(spark)
    rows = df if dealt else df.repartition(buckets, key)
    rows.sortWithinPartitions(key).write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    for frame in more:
        frame.select(*df.columns).sortWithinPartitions(key).write.insertInto(name)
    return spark.table(name)


def drop_table(table: DataFrame) -> None:
    """Remove a table that ``cut_lineage`` wrote, once nothing that is still to run reads it."""
    files = table.inputFiles()
    if files:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deal the rows, by a key if one is given, to as many tasks as a shuffle has, for what heavy per-row work follows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
