"""Summaries, distributions, exports and the joins that merge or mark result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depvital.functions.ranking import rank_within
from depvital.functions.scalars import blank_to_null, severity

# --- fixed values: checks of the published scorecard --------------------------------
CHECKS = (
    "Binary-Artifacts", "Branch-Protection", "CI-Tests", "CII-Best-Practices", "Code-Review", "Contributors",
    "Dangerous-Workflow", "Dependency-Update-Tool", "Fuzzing", "License", "Maintained", "Packaging",
    "Pinned-Dependencies", "SAST", "Security-Policy", "Signed-Releases", "Token-Permissions", "Vulnerabilities",
)
#: Names that a list column shows; the total stands beside it.
LIST_LIMIT = 10
# order of label groups in listings
BUCKETS = ("active", "stalled", "eol", "review", "other")


def scan_summary(entries: DataFrame, key: str | None = None) -> DataFrame:
    """Totals per verdict and per build label (a missing one counts as ungraded)."""
    build = F.coalesce("build_label", F.lit("Ungraded"))
    columns = [F.count(F.lit(1)).alias("total")]
    columns += [F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in ("ok", "caution", "replace", "review")]
    columns += [
        F.count_if(build == b).alias(f"{b.lower()}_count") for b in ("Hardened", "Moderate", "Weak", "Ungraded")
    ]
    return (entries.groupBy(key) if key else entries.groupBy()).agg(*columns)


def label_bucket(label: Column) -> Column:
    return (
        F.when(label == "Active", "active")
        .when(label == "Stalled", "stalled")
        .when(label.startswith("EOL-"), "eol")
        .when(label == "Review Needed", "review")
        .otherwise("other")
    )


def label_distribution(entries: DataFrame) -> DataFrame:
    """Counts and percent of evaluated rows per label, and per label and reason, in one grouping-sets pass."""
    evaluated = entries.where("error IS NULL").select(
        F.coalesce("lifecycle_label", F.lit("Review Needed")).alias("label"),
        F.coalesce("lifecycle_reason", F.lit("")).alias("reason"),
    )
    counted = evaluated.groupingSets([["label"], ["label", "reason"]], "label", "reason").agg(
        F.grouping("reason").alias("is_total"), F.count(F.lit(1)).alias("rows")
    )
    total = counted.where("is_total = 1").agg(F.sum("rows").alias("evaluated"))  # one row
    return counted.join(F.broadcast(total)).select(
        "label",
        F.when(F.col("is_total") == 0, F.col("reason")).alias("reason"),
        F.col("rows").alias("packages"),
        F.round(F.col("rows") * 100.0 / F.col("evaluated"), 9).alias("percent"),
        label_bucket(F.col("label")).alias("bucket"),
    )


def order_distribution(distribution: DataFrame) -> DataFrame:
    """Positions of a listing: largest label first, ties by name; a label's own row, then its reasons in the same way.

    A distribution has as many rows as there are labels and reasons.
    """
    size = F.max(F.when(F.col("reason").isNull(), F.col("packages"))).over(Window.partitionBy("label"))
    sized = distribution.withColumn("_size", size)
    order = Window.orderBy(F.col("_size").desc(), "label", F.col("reason").isNotNull(), F.col("packages").desc(), "reason")
    return sized.withColumn("position", F.row_number().over(order)).drop("_size")


def order_by_bucket(entries: DataFrame, key: str = "purl") -> DataFrame:
    """Positions inside each label group (active, stalled, end of life, review, others), by key, and the group's place."""
    bucket = label_bucket(F.col("lifecycle_label"))
    rank = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), bucket).cast("int")
    return rank_within(entries.withColumns({"bucket": bucket, "bucket_place": rank}), "bucket", [F.col(key)], "position")


def scan_rows(entries: DataFrame) -> DataFrame:
    """Flat scan export; absent values are NULL, and relation and via are kept only when the input has them."""
    above = lambda name: F.when(F.col(name) > 0, F.col(name))
    columns = [
        "verdict",
        "purl",
        *[c for c in ("relation", "relation_via") if c in entries.columns],
        "lifecycle_label",
        "lifecycle_reason",
        "build_label",
        "build_score",
        F.col("eol_successor").alias("successor"),
        F.coalesce("advisory_count", F.lit(0)).alias("advisory_count"),
        severity(above("max_cvss3")).alias("max_advisory_severity"),
        above("max_cvss3").alias("max_cvss3"),
        F.coalesce("direct_count", F.lit(0)).alias("direct_advisory_count"),
        F.coalesce("transitive_count", F.lit(0)).alias("transitive_advisory_count"),
        severity(above("max_transitive_cvss3")).alias("max_transitive_severity"),
        above("max_transitive_cvss3").alias("max_transitive_cvss3"),
        "repo_url",
        *[c for c in ("source", "via") if c in entries.columns],
        blank_to_null(F.col("error")).alias("error"),
    ]
    return entries.select(*columns)


def scorecard_wide(analysis: DataFrame, scores: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """One row per package with a repository, one column per check (sorted), scores as text with two digits.

    Counts and flags that the analysis does not have are 0 and false. The checks are an argument, by default those of the scorecard and whatever further names the scores hold.
    """
    if checks is None:
        names = scores.select("check_name").where("check_name IS NOT NULL").distinct()
        checks = {*CHECKS, *(r["check_name"] for r in names.collect())}  # one row for each check
    ordered = sorted(checks)
    wide = scores.groupBy("repo_id").pivot("check_name", ordered).agg(F.max("score"))
    column = lambda name: F.col("`" + name.replace("`", "``") + "`")
    two_digits = lambda name: F.format_string("%.2f", column(name).cast("double"))
    named = [F.when(column(c).isNotNull(), two_digits(c)).alias(c) for c in ordered]
    have = set(analysis.columns)
    number = lambda name: F.coalesce(column(name), F.lit(0)) if name in have else F.lit(0)
    flag = lambda name: F.coalesce(column(name), F.lit(False)) if name in have else F.lit(False)
    return (
        analysis.where("repo_url IS NOT NULL")
        .join(wide.select("repo_id", *named), "repo_id", "left")
        .select(
            "purl",
            "repo_url",
            F.concat(F.lit("https://scorecard.dev/viewer/?uri="), F.url_encode("repo_url")).alias("scorecard_url"),
            F.concat(F.lit("https://api.scorecard.dev/projects/"), "repo_url").alias("scorecard_api_url"),
            (F.when(column("version_count").isNotNull(), F.col("repo_url")).otherwise("") if "version_count" in have else F.lit("")).alias("release_url"),
            two_digits("overall_score").alias("overall_score"),
            *[column(c) for c in ordered],
            *[number(c).cast("long").alias(c) for c in ("stars", "days_since_stable", "days_since_prerelease", "days_since_commit", "dependents", "direct_deps", "transitive_deps")],
            *[flag(c).alias(c) for c in ("archived", "disabled", "fork")],
            (F.coalesce(column("fork_source"), F.lit("")) if "fork_source" in have else F.lit("")).alias("fork_source"),
            "lifecycle_label",
            "lifecycle_reason",
            F.format_string("Archived:%s,Disabled:%s", flag("archived"), flag("disabled")).alias("repo_state"),
        )
    )


def lifecycle_summary(entries: DataFrame) -> DataFrame:
    """Short lifecycle row for library users."""
    human = F.when(F.col("eol_state") == "EOL", "EOL").when(F.col("eol_state") == "Scheduled", "Scheduled EOL")
    human = human.when(F.col("eol_state") == "NotEOL", "Not EOL").otherwise("Unknown")
    return entries.select(
        "purl",
        F.col("status").alias("final_status"),
        "lifecycle_label",
        "lifecycle_reason",
        "eol_state",
        human.alias("eol_human_state"),
        F.col("eol_scheduled").alias("scheduled_at"),
        F.col("evidence_summary").alias("eol_evidence"),
        "eol_successor",
        F.col("eol_reason").alias("final_reason"),
        (F.col("status").startswith("EOL")).alias("is_end_of_life"),
    )


def first_values(rows: DataFrame, keys: list[str], value: str, name: str, limit: int = LIST_LIMIT) -> DataFrame:
    """Per key the first ``limit`` distinct values, joined by semicolons, and how many there are.

    The rank is cut in each task before the shuffle (and again after it), so no list grows with its group.
    """
    distinct = rows.select(*keys, value).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    shown = distinct.withColumn("_n", rank).where(F.col("_n") <= limit)
    lists = shown.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), ";").alias(name))
    return lists.join(distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_count")), keys)


def diet_export(entries: DataFrame, via: DataFrame, symbols: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """Ranked removal plan with what holds a dependency in, its symbols and its files, each a list with its total.

    ``via`` has project_id, direct_id, via_id; ``symbols`` and ``files`` have project_id, package_id and symbol or path;
    ``names`` has package_id, name.
    """
    keys = ["project_id", "package_id"]
    held = via.join(names.select(F.col("package_id").alias("via_id"), F.col("name").alias("via_name")), "via_id")
    held = held.withColumnRenamed("direct_id", "package_id")
    out = entries
    for rows, value, name in ((held, "via_name", "indirect_via"), (symbols, "symbol", "symbols"), (files, "path", "import_file_names")):
        out = out.join(first_values(rows, keys, value, name), keys, "left")
    counts = [F.coalesce(f"{n}_count", F.lit(0)).alias(f"{n}_count") for n in ("indirect_via", "symbols", "import_file_names")]
    return out.select(
        "project_id", "rank", "purl", F.round("priority", 9).alias("priority"), "difficulty", "is_unused", "import_files", "call_sites",
        "api_breadth", "has_blank_import", "has_dot_import", "has_wildcard_import", F.col("health_status").alias("lifecycle"),
        "indirect_via", "symbols", "import_file_names", *counts,
    )


def diet_rows(entries: DataFrame) -> DataFrame:
    """Ranked removal plan, one flat row per direct dependency; ``diet_export`` adds what holds it in, files and symbols."""
    return entries.select(
        "project_id",
        "rank",
        "purl",
        "name",
        "version",
        "ecosystem",
        "scope",
        F.round("priority", 9).alias("priority"),
        "difficulty",
        F.round("graph_impact", 9).alias("graph_impact"),
        F.round("coupling_effort", 9).alias("coupling_effort"),
        F.round("health_risk", 9).alias("health_risk"),
        "exclusive_transitive",
        "total_transitive",
        (F.col("via_count") > 0).alias("stays_as_indirect"),
        F.col("import_files").alias("import_file_count"),
        F.col("call_sites").alias("call_site_count"),
        "api_breadth",
        "has_blank_import",
        "has_dot_import",
        "has_wildcard_import",
        "is_unused",
        F.col("health_status").alias("maintenance_status"),
        (F.coalesce("advisory_count", F.lit(0)) > 0).alias("has_vulnerabilities"),
        F.coalesce("advisory_count", F.lit(0)).alias("vulnerability_count"),
        F.when(F.col("max_cvss3") > 0, F.col("max_cvss3")).alias("max_cvss_score"),
        F.when(F.col("overall_score") > 0, F.col("overall_score")).alias("overall_score"),
    )


# --- joins that mark, skip or merge rows -----------------------------------------


def mark_missing(inputs: DataFrame, facts: DataFrame, evidence: DataFrame, key: str = "key") -> DataFrame:
    """Inputs with an error where no fact exists; registry or repository evidence clears it."""
    known = facts.select(key, F.lit(True).alias("_known")).distinct()
    proven = evidence.select(key, F.lit(True).alias("_proven")).distinct()
    return (
        inputs.join(known, key, "left")
        .join(proven, key, "left")
        .withColumn(
            "error",
            F.when(F.col("_known").isNull() & F.col("_proven").isNull(), "package not found"),
        )
        .drop("_known", "_proven")
    )


def not_found(inputs: DataFrame, facts: DataFrame, key: str = "key") -> DataFrame:
    return inputs.join(facts.select(key), key, "left_anti")


def new_actions_only(found: DataFrame, evaluated: DataFrame, key: str = "action") -> DataFrame:
    """Discovered actions that were not evaluated before, each once."""
    return found.join(evaluated.select(key), key, "left_anti").dropDuplicates([key])


def merge_results(first: DataFrame, second: DataFrame, key: str = "key") -> DataFrame:
    """All keys of both results; where both have one, the second result's whole row wins."""
    fields = [c for c in first.columns if c != key]
    a = first.select(key, F.struct(*fields).alias("_a"))
    b = second.select(key, F.struct(*fields).alias("_b"))
    merged = a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias("row"))
    return merged.select(key, "row.*")


def union_sources(**sources: DataFrame) -> DataFrame:
    """Rows of all sources with a source column, matched by column name."""
    result = None
    for name, frame in sources.items():
        tagged = frame.withColumn("source", F.lit(name))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    return result


def distinct_keys(frame: DataFrame, *keys: str) -> DataFrame:
    """Distinct non-null identifiers, asked for once before a lookup."""
    return frame.select(*keys).where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).distinct()
