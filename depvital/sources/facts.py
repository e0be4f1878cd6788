"""Fact snapshots: the tables a scan reads, with explicit schemas."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from depvital.session import use_buckets

SCHEMAS: dict[str, str] = {
    "packages": "package_id BIGINT, ecosystem STRING, namespace STRING, name STRING, version STRING, purl STRING, "
    "repo_id BIGINT",
    "versions": "package_id BIGINT, version STRING, published_at TIMESTAMP, is_default BOOLEAN, "
    "is_deprecated BOOLEAN",
    "advisories": "package_id BIGINT, version STRING, advisory_id STRING, cvss3 DOUBLE, relation STRING",
    "commits": "repo_id BIGINT, commit_id BIGINT, login STRING, committed_at TIMESTAMP",
    "package_graphs": "package_id BIGINT, graph_version STRING, dependency_id BIGINT, dependency_version STRING, "
    "relation STRING",
    "repos": "repo_id BIGINT, repo_url STRING, archived BOOLEAN, disabled BOOLEAN, fork BOOLEAN, fork_source STRING, stars BIGINT, "
    "forks BIGINT, homepage STRING, description STRING, default_branch STRING, language STRING, overall_score DOUBLE",
    "projects": "repo_id BIGINT, stars BIGINT, forks BIGINT, description STRING, homepage STRING, default_branch STRING, "
    "language STRING",
    "scores": "repo_id BIGINT, check_name STRING, score BIGINT, reason STRING",
    "registry": "package_id BIGINT, source STRING, flag STRING, version STRING, reason STRING, message STRING, "
    "successor STRING, scheduled STRING",
    "dependents": "package_id BIGINT, source STRING, dependent_count BIGINT",
    "edges": "project_id BIGINT, src BIGINT, dst BIGINT",
    "direct": "project_id BIGINT, package_id BIGINT",
    "reach": "project_id BIGINT, direct_id BIGINT, node BIGINT, level INT",
    "coupling": "project_id BIGINT, package_id BIGINT, import_files BIGINT, call_sites BIGINT, api_breadth BIGINT, "
    "has_blank_import BOOLEAN",
}


#: Key that a table's rows are bucketed by; scans, aggregations and joins on it need no exchange.
KEYS = {
    **dict.fromkeys(("packages", "versions", "advisories", "registry", "dependents", "package_graphs"), "package_id"),
    **dict.fromkeys(("commits", "repos", "projects", "scores"), "repo_id"),
    **dict.fromkeys(("edges", "direct", "reach", "coupling"), "project_id"),
}


def _location(folder: str, name: str, buckets: int) -> str:
    return f"{folder.rstrip('/')}/{name}-{buckets}"


def _table_name(path: str, name: str) -> str:
    return f"facts_{hashlib.md5(path.encode()).hexdigest()[:16]}_{name}"


def load_table(spark: SparkSession, folder: str, name: str, buckets: int | None = None) -> DataFrame:
    """One snapshot table; unread columns and filtered rows are pruned by the Parquet scan.

    The table is registered in the session's catalog under a name made of its folder, as only tables know their buckets.
    """
    use_buckets(spark)
    buckets = buckets or default_buckets(spark)
    path = _location(folder, name, buckets)
    table = _table_name(path, name)
    if not spark.catalog.tableExists(table):
        key = KEYS[name]
        spark.sql(
            f"CREATE TABLE {table} ({SCHEMAS[name]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS "
            f"LOCATION '{path}'"
        )
    return spark.table(table)


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions; snapshots that outlive a session name their number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load_facts(
    spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(SCHEMAS), buckets: int | None = None
) -> dict[str, DataFrame]:
    return {name: load_table(spark, folder, name, buckets) for name in names}


def save_table(df: DataFrame, folder: str, name: str, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Write a snapshot table with the columns and types of its schema, one file for each bucket of its key, and read it.

    Rows that are ``dealt`` to that many partitions by the key already are written as they lie.
    """
    spark = df.sparkSession
    buckets = buckets or default_buckets(spark)
    columns = [part.split() for part in SCHEMAS[name].split(", ")]
    typed = df.selectExpr(*[f"CAST(`{c}` AS {t}) AS `{c}`" for c, t in columns])
    key = KEYS[name]
    load_table(spark, folder, name, buckets)
    table = _table_name(_location(folder, name, buckets), name)
    rows = typed if dealt else typed.repartition(buckets, key)
    rows.sortWithinPartitions(key).write.insertInto(table, overwrite=True)
    return spark.table(table)
