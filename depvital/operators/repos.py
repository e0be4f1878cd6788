"""Repository facts: commit statistics, state, metadata, dependents and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depvital.functions.scalars import age_days, blank_to_null


def is_bot(login: Column) -> Column:
    """Logins that contain "bot"; an unknown author counts as human."""
    return F.coalesce(F.lower(login).contains("bot"), F.lit(False))


def repo_activity(commits: DataFrame, as_of: str) -> DataFrame:
    """Commit statistics and latest (human) commit per repository, in one pass over the commits."""
    bot = is_bot(F.col("login"))
    stats = commits.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.count_if(bot).alias("bot_commits"),
        F.max("committed_at").alias("latest_commit"),
        F.max(F.when(~bot, F.col("committed_at"))).alias("latest_human_commit"),
    )
    total = F.col("total_commits")
    return stats.select(
        "repo_id",
        "total_commits",
        "bot_commits",
        (total - F.col("bot_commits")).alias("user_commits"),
        ((total - F.col("bot_commits")) / total).alias("user_ratio"),
        (F.col("bot_commits") / total).alias("bot_ratio"),
        "latest_commit",
        "latest_human_commit",
        age_days(F.col("latest_commit"), as_of).alias("days_since_commit"),
        age_days(F.col("latest_human_commit"), as_of).alias("days_since_human_commit"),
    )


def commit_stats(commits: DataFrame, as_of: str) -> DataFrame:
    return repo_activity(commits, as_of).select(
        "repo_id", "total_commits", "user_commits", "bot_commits", "user_ratio", "bot_ratio"
    )


def archived_by_reason(check_name: Column, reason: Column) -> Column:
    """The Maintained check says the project is archived (used where repository data is missing)."""
    return (check_name == "Maintained") & F.coalesce(F.lower(reason).contains("project is archived"), F.lit(False))


def merge_repo_metadata(project: DataFrame, repo: DataFrame) -> DataFrame:
    """Project facts overlaid with repository facts, keyed by repo_id.

    Stars and forks replace when positive, a description replaces when present, and homepage, branch and
    language only fill gaps.
    """
    p, r = project.alias("p"), repo.alias("r")

    def positive(name: str) -> Column:
        return F.when(F.col(f"r.{name}") > 0, F.col(f"r.{name}")).otherwise(F.col(f"p.{name}")).alias(name)

    def fill(name: str) -> Column:
        return F.coalesce(blank_to_null(F.col(f"p.{name}")), blank_to_null(F.col(f"r.{name}"))).alias(name)

    return p.join(r, F.col("p.repo_id") == F.col("r.repo_id"), "left").select(
        F.col("p.repo_id").alias("repo_id"),
        positive("stars"),
        positive("forks"),
        F.coalesce(blank_to_null(F.col("r.description")), blank_to_null(F.col("p.description"))).alias("description"),
        fill("homepage"),
        fill("default_branch"),
        fill("language"),
    )


def repo_topics(topics: DataFrame, limit: int | None = None) -> DataFrame:
    """Trimmed, distinct, non-blank topics in their order, at most ``limit``; NULL stays "not fetched"."""
    trimmed = F.array_distinct(F.filter(F.transform("topics", lambda t: F.trim(t)), lambda t: t != ""))
    return topics.select("repo_id", (trimmed if limit is None else F.slice(trimmed, 1, limit)).alias("topics"))


def dependent_counts(packages: DataFrame, dependents: DataFrame) -> DataFrame:
    """Dependents per package; gem and composer fall back to the registry count where the first is zero."""
    per_source = dependents.groupBy("package_id").agg(
        F.max(F.when(F.col("source") == "depsdev", F.col("dependent_count"))).alias("general"),
        F.max(F.when(F.col("source") == "registry", F.col("dependent_count"))).alias("registry"),
    )
    general = F.when(F.col("general") > 0, F.col("general"))
    backup = F.when(F.col("ecosystem").isin("gem", "composer") & (F.col("registry") > 0), F.col("registry"))
    return packages.join(per_source, "package_id", "left").select(
        "package_id", "ecosystem", F.coalesce(general, backup, F.lit(0)).alias("dependent_count")
    )


def dependency_counts(packages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Direct and transitive node counts; NULL where a package has no graph, zero where it is empty.

    ``nodes`` has package_id, relation (SELF, DIRECT, INDIRECT).
    """
    counts = nodes.groupBy("package_id").agg(
        F.count_if(F.col("relation") == "DIRECT").alias("direct_count"),
        F.count_if(F.col("relation") == "INDIRECT").alias("transitive_count"),
    )
    return packages.join(counts, "package_id", "left").select(
        "package_id",
        "direct_count",
        "transitive_count",
        F.col("direct_count").isNotNull().alias("has_graph"),
    )


def coverage_report(analysis: DataFrame) -> DataFrame:
    """How many packages lack a repository, project facts or scorecard checks."""
    total = F.count(F.lit(1))
    columns = [total.alias("packages")]
    for name in ("repository", "project", "scorecard"):
        missing = ~F.col(f"has_{name}")
        columns += [
            F.count_if(missing).alias(f"missing_{name}"),
            F.round(F.avg(missing.cast("double")), 9).alias(f"missing_{name}_share"),
        ]
    return analysis.agg(*columns)
