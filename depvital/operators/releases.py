"""Release slots, effective versions and fallback versions of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depvital.functions.scalars import micros
from depvital.functions.versions import is_semver, is_stable_looking, prerelease_part, semver_key

SLOTS = ("stable", "prerelease", "max_semver", "requested")


def _version_row() -> Column:
    return F.struct("version", "published_at", "is_deprecated")


def _newest_first() -> Column:
    """Order key whose minimum is the newest row; undated rows come last, ties by version text."""
    undated = F.col("published_at").isNull().cast("int")
    return F.struct(undated, -F.coalesce(micros(F.col("published_at")), F.lit(0)), F.col("version"))


def release_slots(versions: DataFrame, requested: DataFrame) -> DataFrame:
    """One row per package with its stable, pre-release, highest and requested version.

    ``versions`` has package_id, version, published_at, is_default, is_deprecated; ``requested`` has
    package_id, version. All slots come out of one grouped aggregation (partial on the map side).
    """
    # keys are worked out once for each row, not once for each slot
    keyed = versions.withColumns(
        {
            "_stable": is_stable_looking(F.col("version")),
            "_order": _newest_first(),
            "_semver": F.when(is_semver(F.col("version")), F.struct(semver_key(F.col("version")), "version")),
        }
    )
    stable_looking, order = F.col("_stable"), F.col("_order")
    row = _version_row()
    picked = keyed.groupBy("package_id").agg(
        F.min_by(row, F.when(F.col("is_default"), order)).alias("newest_default"),
        F.min_by(row, F.when(stable_looking, order)).alias("newest_stable"),
        F.min_by(row, F.when(~stable_looking, order)).alias("prerelease"),
        F.max_by(row, "_semver").alias("highest"),
        F.min_by(row, order).alias("newest"),
        F.count(F.lit(1)).alias("version_count"),
    )
    slots = picked.select(
        "package_id",
        F.coalesce("newest_default", "newest_stable").alias("stable"),
        "prerelease",
        F.coalesce("highest", "newest").alias("max_semver"),
        "version_count",
    )
    wanted = requested.where(F.col("version").isNotNull()).select("package_id", "version")
    exact = (
        versions.join(wanted, ["package_id", "version"])
        .groupBy("package_id")
        .agg(F.max(_version_row()).alias("requested"))
    )
    return slots.join(exact, "package_id", "left")


def flat_slots(slots: DataFrame) -> DataFrame:
    """Slots as plain columns, one version and one date per slot."""
    columns = [F.col("package_id")]
    for slot in SLOTS:
        columns += [
            F.col(f"{slot}.version").alias(f"{slot}_version"),
            F.col(f"{slot}.published_at").alias(f"{slot}_published_at"),
            F.col(f"{slot}.is_deprecated").alias(f"{slot}_deprecated"),
        ]
    return slots.select(*columns)


def join_versions(packages: DataFrame, slots: DataFrame) -> DataFrame:
    """Packages with their slots; a package without versions keeps empty slots."""
    return packages.join(slots, "package_id", "left")


def resolved_version() -> Column:
    """The version that was asked for, else the stable or the highest one."""
    return F.coalesce(F.when(F.trim("version") != "", F.trim("version")), "stable.version", "max_semver.version")


def effective_versions(packages_with_slots: DataFrame) -> DataFrame:
    """Three version orders that must stay apart.

    Facts are read for stable, highest, pre-release, else the input; the latest release never falls back
    to the input; the resolved version prefers the input.
    """
    return packages_with_slots.select(
        "package_id",
        "purl",
        F.coalesce("stable.version", "max_semver.version", "prerelease.version", "version").alias("effective_version"),
        F.coalesce("stable.version", "max_semver.version", "prerelease.version").alias("latest_release"),
        resolved_version().alias("resolved_version"),
    )


def fallback_versions(versions: DataFrame, tried: DataFrame, limit: int = 2) -> DataFrame:
    """Best versions to try next when one has no dependency graph.

    Deprecated versions and the tried one are left out; then stable first, parsable first, highest
    first, dated first, newest first.
    """
    key = semver_key(F.col("version"))
    parsed = is_semver(F.col("version"))
    stable = F.when(parsed, prerelease_part(F.col("version")) == "").otherwise(is_stable_looking(F.col("version")))
    candidates = (
        versions.where(~F.col("is_deprecated") & (F.trim("version") != ""))
        .join(tried.select("package_id", "version"), ["package_id", "version"], "left_anti")
        .select("package_id", "version", "published_at", stable.alias("stable"), key.alias("key"))
    )
    rank = Window.partitionBy("package_id").orderBy(
        F.col("stable").desc(),
        F.col("key").isNotNull().desc(),
        F.col("key").desc(),
        F.col("published_at").isNotNull().desc(),
        F.col("published_at").desc(),
        F.col("version"),
    )
    return (
        candidates.withColumn("position", F.row_number().over(rank))
        .where(F.col("position") <= limit)
        .select("package_id", "position", "version", "stable")
    )


def yanked_versions(files: DataFrame) -> DataFrame:
    """A version is yanked when flagged itself or when every one of its files is.

    ``files`` has package_id, version, version_yanked, file_yanked (NULL where a version has no file).
    """
    return files.groupBy("package_id", "version").agg(
        F.coalesce(F.bool_or("version_yanked") | F.bool_and("file_yanked"), F.lit(False)).alias("yanked"),
        F.count("file_yanked").alias("file_count"),
    )
