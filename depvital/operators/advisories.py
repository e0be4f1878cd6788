"""Security advisories: per-version metrics, severity, transitive advisories and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depvital.config import DEFAULTS, Thresholds
from depvital.functions.scalars import advisory_source, advisory_url, severity
from depvital.operators.keys import graph_eligible
from depvital.operators.releases import fallback_versions, resolved_version


def _is_transitive() -> Column:
    return F.coalesce(F.col("relation") == "TRANSITIVE", F.lit(False))


def advisory_metrics(advisories: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Counts and maxima per package version; an empty relation counts as direct."""
    transitive = _is_transitive()
    score = F.coalesce("cvss3", F.lit(0.0))
    return advisories.groupBy("package_id", "version").agg(
        F.count(F.lit(1)).alias("advisory_count"),
        F.count_if(~transitive).alias("direct_count"),
        F.count_if(transitive).alias("transitive_count"),
        F.greatest(F.max(score), F.lit(0.0)).alias("max_cvss3"),
        F.greatest(F.max(F.when(transitive, score)), F.lit(0.0)).alias("max_transitive_cvss3"),
        F.count_if(score >= cfg.high_cvss).alias("high_count"),
        F.count_if(score <= 0).alias("unknown_count"),
    )


def describe_advisories(advisories: DataFrame) -> DataFrame:
    """Source, link and severity band of each advisory."""
    return advisories.select(
        "*",
        advisory_source(F.col("advisory_id")).alias("source"),
        advisory_url(F.col("advisory_id")).alias("url"),
        severity(F.col("cvss3")).alias("severity"),
    )


def slot_versions(slots: DataFrame) -> DataFrame:
    """(package, slot, version) of the two slots that lifecycle rules look at."""
    slot = F.explode(
        F.array(
            F.struct(F.lit("stable").alias("slot"), F.col("stable.version").alias("version")),
            F.struct(F.lit("max_semver").alias("slot"), F.col("max_semver.version").alias("version")),
        )
    )
    return slots.select("package_id", slot.alias("s")).select("package_id", "s.*").where("version IS NOT NULL")


def join_advisories(slots: DataFrame, advisory_keys: DataFrame, details: DataFrame) -> DataFrame:
    """Advisories of the stable and highest slots, with title and score where details are known.

    ``advisory_keys`` has package_id, version, advisory_id; ``details`` has advisory_id, title, cvss3.
    """
    attached = slot_versions(slots).join(advisory_keys, ["package_id", "version"])
    joined = attached.join(details, "advisory_id", "left")
    return joined.select(
        "package_id",
        "slot",
        "version",
        "advisory_id",
        "title",
        F.coalesce("cvss3", F.lit(0.0)).alias("cvss3"),
        severity(F.col("cvss3")).alias("severity"),
        F.lit("DIRECT").alias("relation"),
    )


def choose_graphs(with_slots: DataFrame, versions: DataFrame, package_graphs: DataFrame) -> DataFrame:
    """(package_id, graph_version, position): the version whose dependency graph stands for a package.

    First (position 0) the requested or else the stable or highest version; where that one has no graph, the first of the
    two fallback versions that has one. Only ecosystems with graphs are looked up.
    """
    resolved = with_slots.select("package_id", "ecosystem", resolved_version().alias("version"))
    wanted = graph_eligible(resolved).select("package_id", "version")
    known = package_graphs.select("package_id", F.col("graph_version").alias("version")).distinct()
    exact = wanted.join(known, ["package_id", "version"], "left_semi")
    missing = wanted.join(known, ["package_id", "version"], "left_anti")
    # the few packages left are all that versions are ranked for
    tried = fallback_versions(versions.join(missing.select("package_id"), "package_id", "left_semi"), missing)
    backup = (
        tried.join(known, ["package_id", "version"], "left_semi")
        .groupBy("package_id")
        .agg(F.min(F.struct("position", "version")).alias("first"))
        .select("package_id", F.col("first.version").alias("graph_version"), "first.position")
    )
    return exact.select("package_id", F.col("version").alias("graph_version"), F.lit(0).alias("position")).unionByName(backup)


def transitive_advisories(
    slots: DataFrame, advisories: DataFrame, chosen: DataFrame, package_graphs: DataFrame, packages: DataFrame
) -> DataFrame:
    """Advisories of the packages in a package's own graph, on the slots of the graph's version.

    ``chosen`` has package_id, graph_version; ``package_graphs`` has package_id, graph_version, dependency_id,
    dependency_version (never the package itself); ``advisories`` has package_id, version, advisory_id, cvss3. A node counts
    with its own version, an advisory that the slot's version already has does not count again, and one row stays for each
    (version, advisory), with the first dependency name. Columns: package_id, version, advisory_id, cvss3, dependency_name.
    """
    keys = ["package_id", "version"]
    # versions that can receive anything come first: neither graphs nor advisories of others are expanded
    targets = slot_versions(slots).select(*keys).distinct().join(
        chosen.select("package_id", F.col("graph_version").alias("version")), keys, "left_semi"
    )
    below = targets.join(package_graphs.withColumnRenamed("graph_version", "version"), keys)
    of_nodes = advisories.select(F.col("package_id").alias("dependency_id"), F.col("version").alias("dependency_version"), "advisory_id", "cvss3")
    names = packages.select(F.col("package_id").alias("dependency_id"), F.col("name").alias("dependency_name"))
    carried = below.join(of_nodes, ["dependency_id", "dependency_version"]).join(names, "dependency_id")
    # dealt by package, as the advisories lie: the grouping and the lookup of a slot's own ones need no further exchange
    carried = carried.repartition(int(carried.sparkSession.conf.get("spark.sql.shuffle.partitions")), "package_id")
    first = carried.groupBy(*keys, "advisory_id").agg(F.min("dependency_name").alias("dependency_name"), F.max("cvss3").alias("cvss3"))
    own = advisories.select(*keys, "advisory_id")
    return first.join(own, [*keys, "advisory_id"], "left_anti").select(*keys, "advisory_id", "cvss3", "dependency_name")


def slot_transitive(
    with_slots: DataFrame, advisories: DataFrame, versions: DataFrame, package_graphs: DataFrame
) -> DataFrame:
    """On the slots' versions, the advisories that the package's own graph brings in."""
    chosen = choose_graphs(with_slots, versions, package_graphs)
    found = transitive_advisories(with_slots, advisories, chosen, package_graphs, with_slots)
    return found.withColumn("relation", F.lit("TRANSITIVE"))


def add_metrics(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with advisory metrics, and those of further advisories added: counts are summed, of maxima the larger stays.

    Both tables of metrics are joined as they are grouped, so advisories are not shuffled into one table first.
    """
    names = [c for c in more.columns if c not in keys]
    joined = rows.join(more.select(*keys, *[F.col(c).alias(f"_{c}") for c in names]), keys, "left")

    def both(c: str) -> Column:
        if c.startswith("max_"):
            return F.greatest(c, f"_{c}")
        return F.coalesce(F.col(c) + F.col(f"_{c}"), F.col(c), F.col(f"_{c}"))

    return joined.withColumns({c: both(c) for c in names}).drop(*[f"_{c}" for c in names])


def with_transitive(
    with_slots: DataFrame, advisories: DataFrame, versions: DataFrame, package_graphs: DataFrame
) -> DataFrame:
    """The advisories of every version, and on the slots' versions those that the package's own graph brings in.

    ``with_slots`` has the packages with their slots. Columns: package_id, version, advisory_id, cvss3, relation,
    dependency_name (NULL for a package's own advisories).
    """
    found = slot_transitive(with_slots, advisories, versions, package_graphs)
    columns = ["package_id", "version", "advisory_id", "cvss3", "relation", "dependency_name"]
    direct = advisories.withColumn("dependency_name", F.lit(None).cast("string"))
    return direct.select(*columns).unionByName(found.select(*columns))


def top_advisories(advisories: DataFrame, n: int = 3) -> DataFrame:
    """The n worst advisories per package version, how many more there are, and the dependencies that bring the shown ones.

    Positions come from one window and everything else from one grouping on top of it, so the advisories are read and
    shuffled once; lists hold the n shown ones only. Rows without a package or version belong to none and are left out.
    """
    if "dependency_name" not in advisories.columns:
        advisories = advisories.withColumn("dependency_name", F.lit(None).cast("string"))
    keys = ["package_id", "version"]
    rank = Window.partitionBy(*keys).orderBy(F.col("cvss3").desc(), F.col("advisory_id"))
    known = advisories.where("package_id IS NOT NULL AND version IS NOT NULL")
    placed = known.select(*keys, "advisory_id", "cvss3", "dependency_name").withColumn("position", F.row_number().over(rank))
    is_shown = F.col("position") <= n
    lists = placed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(is_shown, F.struct("position", "advisory_id", "cvss3")))).alias("shown"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_shown, F.col("dependency_name")))), ", ").alias("dependencies"),
        F.count(F.lit(1)).alias("advisory_count"),
    )
    return lists.select(
        *keys,
        F.array_join(F.transform("shown", lambda a: a["advisory_id"]), ";").alias("top_ids"),
        F.element_at("shown", 1)["cvss3"].alias("top_cvss3"),
        "dependencies",
        "advisory_count",
        F.greatest(F.col("advisory_count") - n, F.lit(0)).alias("more_count"),
    )
