"""The scan: one row per package with lifecycle, build and verdict labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depvital.config import BUILD_CHECKS, DEFAULTS, Thresholds
from depvital.functions.scalars import round_half_up
from depvital.operators import advisories as adv
from depvital.operators import assess, eol_rules, releases, repos
from depvital.session import cut_by

Enricher = Callable[[DataFrame], DataFrame]
#: Descriptive columns of a repository.
METADATA = ("stars", "forks", "description", "homepage", "default_branch", "language")


def repo_scores(scores: DataFrame) -> DataFrame:
    """Maintained and Vulnerabilities scores and the build-integrity label, in one pass over the checks."""
    weights = F.create_map(*[F.lit(x) for pair in BUILD_CHECKS for x in pair])
    weight = F.when(F.col("score") >= 0, F.try_element_at(weights, F.col("check_name")))
    sums = scores.groupBy("repo_id").agg(
        F.max(F.when(F.col("check_name") == "Maintained", F.col("score"))).alias("maintained_score"),
        F.max(F.when(F.col("check_name") == "Vulnerabilities", F.col("score"))).alias("vulnerability_score"),
        F.sum(weight * F.col("score")).alias("_weighted"),
        F.sum(weight).alias("_weights"),
        F.count(weight).alias("build_signals"),
        F.count(F.lit(1)).alias("score_count"),
        *([F.bool_or(repos.archived_by_reason(F.col("check_name"), F.col("reason"))).alias("archived_by_check")] if "reason" in scores.columns else []),
    )
    raw = F.when(F.col("build_signals") >= assess.BUILD_MIN_SIGNALS, F.col("_weighted") / F.col("_weights"))
    return sums.withColumns(
        {"build_score": round_half_up(raw, 1), "build_label": assess.build_label(raw)}
    ).drop("_weighted", "_weights")


def gather(facts: Mapping[str, DataFrame], as_of: str, cfg: Thresholds = DEFAULTS,
           enrichers: Iterable[Enricher] = ()) -> DataFrame:
    """All facts of every package in one row, without any assessment.

    ``facts`` maps packages, versions, advisories, commits, repos, scores and registry to tables. With package_graphs the
    advisories of dependencies count on the slots they belong to; with projects, repository facts overlay those of another
    source. A repository whose state is not known is archived where its Maintained check says so.
    Per-package tables join on package_id first, which snapshots are bucketed by; repository facts are aggregated per
    repository and joined last.
    """
    packages = facts["packages"].select(
        "package_id", "ecosystem", "namespace", "name", "version", "purl", "repo_id"
    )
    slots = releases.release_slots(facts["versions"], packages.select("package_id", "version"))
    with_slots = cut_by(releases.join_versions(packages, slots), "package_id")  # versions are read and ordered once
    hits = eol_rules.rule_hits(with_slots, facts["registry"])
    eol = eol_rules.eol_status(hits)
    for enricher in enrichers:
        eol = eol.transform(enricher)
    metrics = adv.advisory_metrics(facts["advisories"], cfg).withColumnRenamed("version", "fact_version")
    activity = repos.repo_activity(facts["commits"], as_of).withColumn("has_commit_data", F.lit(True))
    state = facts["repos"].select("repo_id", "repo_url", "archived", "disabled", "overall_score", "fork", "fork_source")
    metadata = facts["repos"].select("repo_id", *METADATA)
    if "projects" in facts:
        metadata = repos.merge_repo_metadata(facts["projects"], metadata)
    per_repo = (
        state.join(metadata, "repo_id", "left")
        .join(activity.select("repo_id", "latest_human_commit", "days_since_commit", "has_commit_data"),
                   "repo_id", "left")
        .join(repo_scores(facts["scores"]), "repo_id", "left")
    )
    if "archived_by_check" in per_repo.columns:
        per_repo = per_repo.withColumn("archived", F.coalesce("archived", "archived_by_check")).drop("archived_by_check")
    keys = ["package_id", "fact_version"]
    versioned = with_slots.withColumn("fact_version", F.coalesce("stable.version", "max_semver.version")).join(metrics, keys, "left")
    if "package_graphs" in facts:
        found = adv.slot_transitive(with_slots, facts["advisories"], facts["versions"], facts["package_graphs"])
        versioned = adv.add_metrics(versioned, adv.advisory_metrics(found, cfg).withColumnRenamed("version", "fact_version"), keys)
    return (
        versioned.join(eol, "package_id", "left")
        .join(per_repo, "repo_id", "left")
        .withColumn(
            "error",
            F.when(
                F.col("version_count").isNull() & F.col("repo_url").isNull() & F.col("eol_state").isNull(),
                "package not found",
            ),
        )
    )


def lifecycle_axis(as_of: str, cfg: Thresholds = DEFAULTS) -> assess.Axis:
    """Lifecycle columns, the final status and the verdict."""

    def run(analysis: DataFrame) -> DataFrame:
        labelled = assess.lifecycle(analysis, as_of, cfg)
        label = F.col("lifecycle.label")
        archived = F.coalesce("archived", F.lit(False))
        return labelled.withColumns(
            {
                "lifecycle_label": label,
                "lifecycle_reason": F.col("lifecycle.reason"),
                "lifecycle_rule": F.col("lifecycle.rule"),
                "status": assess.final_status(F.col("eol_state"), F.col("eol_scheduled"), label),
                "verdict": assess.verdict(F.col("error"), archived, F.col("eol_state"), label),
            }
        ).drop("lifecycle")

    return run


def build_axis(analysis: DataFrame) -> DataFrame:
    return analysis.withColumn("build_label", F.coalesce("build_label", F.lit("Ungraded")))


def scan(facts: Mapping[str, DataFrame], as_of: str, cfg: Thresholds = DEFAULTS,
         enrichers: Iterable[Enricher] = ()) -> DataFrame:
    """Gather the facts and run the lifecycle and build axes."""
    return assess.assess_axes(gather(facts, as_of, cfg, enrichers), [lifecycle_axis(as_of, cfg), build_axis])


def catalog_from(registry: DataFrame) -> Enricher:
    """Enricher over the catalogue rows of a registry table."""
    catalog = registry.where("source = 'catalog'")
    return lambda eol: eol_rules.catalog_enricher(eol, catalog)
