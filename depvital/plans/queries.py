"""Registered queries: every job run over the driver's tables through the fixture views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depvital.functions import spdx
from depvital.functions.scalars import age_days
from depvital.operators import (
    advisories,
    assess,
    coupling,
    diet,
    eol_rules,
    eol_text,
    graph,
    keys,
    licenses,
    releases,
    reports,
    repos,
)
from depvital.plans import diet as diet_plan_module
from depvital.plans import entrypoints
from depvital.plans import scan as scan_plan
from depvital.plans.diet import removal_plan
from depvital.plans.fixtures import AS_OF, Fixtures
from depvital.session import cut_by
from depvital.sources import files, inputs, manifests, sbom

Query = Callable[[Fixtures], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUERIES[name](Fixtures(spark, sf_dir))


def _ts(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _facts(fx: Fixtures) -> dict[str, DataFrame]:
    names = ("packages", "versions", "advisories", "commits", "repos", "projects", "scores", "registry", "package_graphs")
    return {name: fx[f"fx_{name}"] for name in names}


def _slots(fx: Fixtures) -> DataFrame:
    return releases.release_slots(fx["fx_versions"], fx["fx_packages"].select("package_id", "version"))


def _with_slots(fx: Fixtures) -> DataFrame:
    """Packages with their slots, written once: what follows reads them several times."""
    return cut_by(releases.join_versions(fx["fx_packages"], _slots(fx)), "package_id")


def _scan(fx: Fixtures) -> DataFrame:
    facts = _facts(fx)
    return scan_plan.scan(facts, AS_OF, enrichers=[scan_plan.catalog_from(facts["registry"])])


# --- releases -------------------------------------------------------------------


@query
def release_slots(fx: Fixtures) -> DataFrame:
    flat = releases.flat_slots(_slots(fx))
    return flat.select(
        "package_id",
        "stable_version",
        _ts("stable_published_at"),
        "stable_deprecated",
        "prerelease_version",
        _ts("prerelease_published_at"),
        "max_semver_version",
        _ts("max_semver_published_at"),
        "requested_version",
    )


@query
def effective_versions(fx: Fixtures) -> DataFrame:
    return releases.effective_versions(releases.join_versions(fx["fx_packages"], _slots(fx)))


@query
def fallback_versions(fx: Fixtures) -> DataFrame:
    return releases.fallback_versions(fx["fx_versions"], fx["fx_packages"])


# --- repositories and advisories ----------------------------------------------------


@query
def commit_stats(fx: Fixtures) -> DataFrame:
    stats = repos.commit_stats(fx["fx_commits"], AS_OF)
    return stats.withColumns({c: F.round(c, 9) for c in ("user_ratio", "bot_ratio")})


@query
def repo_activity(fx: Fixtures) -> DataFrame:
    return repos.repo_activity(fx["fx_commits"], AS_OF).select(
        "repo_id", _ts("latest_commit"), _ts("latest_human_commit"), "days_since_commit", "days_since_human_commit"
    )


@query
def advisory_metrics(fx: Fixtures) -> DataFrame:
    return advisories.advisory_metrics(fx["fx_advisories"])


# --- assessment -----------------------------------------------------------------


@query
def build_integrity(fx: Fixtures) -> DataFrame:
    return assess.build_integrity(fx["fx_scores"])


@query
def registry_rule_hits(fx: Fixtures) -> DataFrame:
    with_slots = releases.join_versions(fx["fx_packages"], _slots(fx))
    return eol_rules.rule_hits(with_slots, fx["fx_registry"]).withColumnRenamed("order", "rule_order")


@query
def registry_eol(fx: Fixtures) -> DataFrame:
    with_slots = releases.join_versions(fx["fx_packages"], _slots(fx))
    return eol_rules.eol_status(eol_rules.rule_hits(with_slots, fx["fx_registry"]))


@query
def lifecycle_scan(fx: Fixtures) -> DataFrame:
    return _scan(fx).select(
        "package_id",
        "purl",
        "lifecycle_label",
        "lifecycle_reason",
        "status",
        "verdict",
        "build_label",
        "build_score",
        F.coalesce("advisory_count", F.lit(0)).alias("advisory_count"),
        "error",
    )


@query
def lifecycle_signals(fx: Fixtures) -> DataFrame:
    return assess.lifecycle_signals(_scan(fx), AS_OF)


@query
def label_distribution(fx: Fixtures) -> DataFrame:
    return reports.label_distribution(_scan(fx))


@query
def scan_summary(fx: Fixtures) -> DataFrame:
    return reports.scan_summary(_scan(fx))


# --- dependency graphs ----------------------------------------------------------


@query
def reachability(fx: Fixtures) -> DataFrame:
    return graph.reachability(fx["fx_edges"], fx["fx_direct"])


@query
def graph_metrics(fx: Fixtures) -> DataFrame:
    return graph.graph_metrics(fx["fx_edges"], fx["fx_direct"])


@query
def indirect_via(fx: Fixtures) -> DataFrame:
    return graph.indirect_via(fx["fx_reach"], fx["fx_direct"])


@query
def via_parents(fx: Fixtures) -> DataFrame:
    return graph.via_parents(fx["fx_reach"], fx["fx_direct"], fx["fx_packages"])


def _nodes(fx: Fixtures) -> DataFrame:
    ends = fx["fx_edges"].select("project_id", F.explode(F.array("src", "dst")).alias("node"))
    return ends.unionByName(fx["fx_direct"].withColumnRenamed("package_id", "node")).distinct()


@query
def relation_classes(fx: Fixtures) -> DataFrame:
    return graph.classify_relation(_nodes(fx), fx["fx_direct"], fx["fx_edges"])


@query
def dependency_counts(fx: Fixtures) -> DataFrame:
    related = graph.classify_relation(_nodes(fx), fx["fx_direct"], fx["fx_edges"])
    nodes = related.select(
        F.col("project_id").alias("package_id"),
        F.when(F.col("relation") == "direct", "DIRECT").otherwise("INDIRECT").alias("relation"),
    )
    customers = fx["customer"].select(F.col("c_custkey").alias("package_id"))
    return repos.dependency_counts(customers, nodes)


@query
def total_transitive(fx: Fixtures) -> DataFrame:
    roots = fx["fx_direct"].groupBy("project_id").agg(F.max("package_id").alias("root"))
    return graph.total_transitive(_nodes(fx), fx["fx_direct"], roots)


# --- removal planning --------------------------------------------------------------


@query
def health_risk(fx: Fixtures) -> DataFrame:
    return diet.health_risk(_scan(fx)).select(
        "package_id", "is_eol", "is_stalled", "health_status", F.round("health_risk", 9).alias("health_risk")
    )


def _plan(fx: Fixtures) -> DataFrame:
    return removal_plan(fx["fx_edges"], fx["fx_direct"], fx["fx_packages"], _scan(fx), fx["fx_coupling"])


@query
def diet_plan(fx: Fixtures) -> DataFrame:
    return reports.diet_rows(_plan(fx))


@query
def diet_summary(fx: Fixtures) -> DataFrame:
    entries = _plan(fx)
    roots = fx["fx_direct"].groupBy("project_id").agg(F.lit(-1).cast("long").alias("root"))
    return diet.diet_summary(entries, graph.total_transitive(_nodes(fx), fx["fx_direct"], roots))


@query
def graph_only_plan(fx: Fixtures) -> DataFrame:
    """The plan without source coupling: nothing is unused and no effort is counted."""
    plan = removal_plan(fx["fx_edges"], fx["fx_direct"], fx["fx_packages"], _scan(fx))
    return plan.select("project_id", "rank", "package_id", F.round("priority", 9).alias("priority"), "difficulty")


# --- advisories on slots ---------------------------------------------------------------


def _slot_advisories(fx: Fixtures, slots: DataFrame) -> DataFrame:
    keys = fx["fx_advisories"].select("package_id", "version", "advisory_id")
    details = fx["fx_advisories"].groupBy("advisory_id").agg(
        F.max("cvss3").alias("cvss3"), F.max(F.concat(F.lit("Title of "), F.col("advisory_id"))).alias("title")
    )
    return advisories.join_advisories(slots, keys, details)


@query
def slot_advisories(fx: Fixtures) -> DataFrame:
    return _slot_advisories(fx, _slots(fx))


def _all_advisories(fx: Fixtures) -> DataFrame:
    return advisories.with_transitive(_with_slots(fx), fx["fx_advisories"], fx["fx_versions"], fx["fx_package_graphs"])


@query
def graph_choice(fx: Fixtures) -> DataFrame:
    """Version whose graph stands for a package, with up to two fallback versions."""
    return advisories.choose_graphs(_with_slots(fx), fx["fx_versions"], fx["fx_package_graphs"])


@query
def scan_advisories(fx: Fixtures) -> DataFrame:
    """Advisory metrics as the scan sees them, with those of dependencies."""
    return advisories.advisory_metrics(_all_advisories(fx))


@query
def slot_versions(fx: Fixtures) -> DataFrame:
    return advisories.slot_versions(_slots(fx))


@query
def transitive_advisories(fx: Fixtures) -> DataFrame:
    return _all_advisories(fx).where("relation = 'TRANSITIVE'")


@query
def top_advisories(fx: Fixtures) -> DataFrame:
    described = advisories.describe_advisories(_all_advisories(fx))
    return advisories.top_advisories(described)


@query
def advisory_sources(fx: Fixtures) -> DataFrame:
    return (
        advisories.describe_advisories(fx["fx_advisories"])
        .groupBy("source", "severity")
        .agg(F.count(F.lit(1)).alias("advisories"), F.min("url").alias("first_url"))
    )


# --- end-of-life text ------------------------------------------------------------------

_EOL_COLUMNS = ("eol_kind", "eol_phrase", "eol_successor", "eol_date")


@query
def eol_text_message(fx: Fixtures) -> DataFrame:
    return eol_text.detect_eol(fx["fx_messages"], "message").select("package_id", *_EOL_COLUMNS)


@query
def eol_text_readme(fx: Fixtures) -> DataFrame:
    return eol_text.detect_eol(fx["fx_readmes"], "readme").select("doc_id", *_EOL_COLUMNS)


@query
def eol_text_registry(fx: Fixtures) -> DataFrame:
    return eol_text.detect_eol(fx["fx_readmes"], "registry").select("doc_id", *_EOL_COLUMNS)


@query
def phrase_hits(fx: Fixtures) -> DataFrame:
    return eol_text.phrase_hits(fx["fx_readmes"], ("strong", "reevaluate", "snippet"))


@query
def phrase_stats(fx: Fixtures) -> DataFrame:
    return eol_text.phrase_stats(fx["fx_readmes"])


@query
def npm_successors(fx: Fixtures) -> DataFrame:
    messages = fx["fx_registry"].where("source = 'npm'").select("package_id", "message")
    named = messages.join(fx["fx_packages"], "package_id")
    full = F.concat_ws("/", "namespace", "name")
    return named.select(
        "package_id", eol_text.npm_successor(F.col("message"), F.col("name"), full).alias("successor")
    )


@query
def repo_summaries(fx: Fixtures) -> DataFrame:
    docs = fx["fx_repos"].select(
        F.col("repo_id").alias("key"),
        F.lit("npm").alias("ecosystem"),
        F.concat(F.lit("Project "), F.col("repo_id")).alias("project_description"),
        F.col("description").alias("repo_description"),
        F.lit(None).cast("string").alias("package_summary"),
    )
    return eol_text.summaries(docs)


@query
def document_summaries(fx: Fixtures) -> DataFrame:
    return fx["documents"].select(
        F.col("doc_id").alias("key"), eol_text.normalize_summary(F.col("text")).alias("summary")
    )


# --- licences ------------------------------------------------------------------------------


def _spdx(fx: Fixtures) -> DataFrame:
    return spdx.core_spdx(fx.spark)


@query
def normalize_licenses(fx: Fixtures) -> DataFrame:
    return licenses.normalize_licenses(licenses.spellings(fx["fx_licenses"]), _spdx(fx))


@query
def license_urls(fx: Fixtures) -> DataFrame:
    return licenses.license_url_lookup(fx["fx_pom_entries"]).drop("name")


@query
def version_licenses(fx: Fixtures) -> DataFrame:
    return licenses.version_licenses(fx["fx_licenses"], _spdx(fx))


@query
def license_report(fx: Fixtures) -> DataFrame:
    resolved = licenses.resolve_licenses(fx["fx_licenses"], _spdx(fx))
    none = F.lit(None).cast("string")
    analysis = (
        resolved.join(fx["fx_packages"].select("package_id", "purl", "repo_id"), "package_id")
        .join(fx["fx_repos"].select("repo_id", F.col("repo_url").alias("repository_url")), "repo_id", "left")
        .withColumns(
            {
                "effective_purl": F.col("purl"),
                "version_resolved": F.size("version_licenses") > 0,
                "error": none,
                "registry_url": none,
            }
        )
    )
    return licenses.license_report(analysis)


@query
def license_disagreements(fx: Fixtures) -> DataFrame:
    return licenses.license_disagreements(licenses.resolve_licenses(fx["fx_licenses"], _spdx(fx)))


@query
def manifest_licenses(fx: Fixtures) -> DataFrame:
    return licenses.manifest_licenses(fx["fx_pom_entries"], fx["fx_pom_properties"], _spdx(fx))


@query
def license_mentions(fx: Fixtures) -> DataFrame:
    return licenses.license_mentions(fx["documents"], _spdx(fx))


@query
def license_leaves(fx: Fixtures) -> DataFrame:
    return licenses.license_leaves(fx["fx_expressions"], _spdx(fx)).drop("position", "exception")


# --- source coupling ----------------------------------------------------------------------


@query
def source_imports(fx: Fixtures) -> DataFrame:
    found = coupling.extract_imports(fx["fx_sources"])
    uses = F.when(F.col("kind") == "normal", F.size("symbols")).otherwise(0)
    return found.select("project_id", "path", "lang", "import_path", "alias", "kind", uses.alias("uses"))


@query
def source_calls(fx: Fixtures) -> DataFrame:
    return coupling.extract_calls(fx["fx_sources"])


@query
def candidate_imports(fx: Fixtures) -> DataFrame:
    found = coupling.candidate_imports(fx["fx_packages"])
    return found.select("package_id", F.lower("prefix").alias("prefix")).distinct()


def _dependencies(fx: Fixtures) -> DataFrame:
    return fx["fx_direct"].join(fx["fx_package_names"], "package_id")


def _matched(fx: Fixtures) -> DataFrame:
    return diet_plan_module.matched_sources(fx["fx_sources"], _dependencies(fx))


@query
def matched_imports(fx: Fixtures) -> DataFrame:
    return _matched(fx).select(
        "project_id", "path", "import_path", "alias", "kind", "package_id", "matched_prefix"
    )


@query
def coupling_metrics(fx: Fixtures) -> DataFrame:
    """Coupling of every direct dependency, PyPI names that the name rules miss retried through file listings."""
    return diet_plan_module.source_coupling(fx["fx_sources"], _dependencies(fx), fx["fx_wheel_files"])


@query
def coupling_files(fx: Fixtures) -> DataFrame:
    return coupling.coupling_files(_matched(fx))


@query
def coupling_symbols(fx: Fixtures) -> DataFrame:
    return coupling.coupling_symbols(_matched(fx))


@query
def wheel_import_names(fx: Fixtures) -> DataFrame:
    return coupling.wheel_import_names(fx["fx_wheel_files"])


@query
def pypi_retry(fx: Fixtures) -> DataFrame:
    imports = diet_plan_module.source_imports(fx["fx_sources"])
    matched = coupling.match_imports(imports, diet_plan_module.import_targets(_dependencies(fx)))
    found = coupling.retry_pypi_imports(_dependencies(fx), matched, imports, fx["fx_wheel_files"])
    return found.select("project_id", "path", "import_path", "alias", "kind", "package_id")


@query
def diet_from_sources(fx: Fixtures) -> DataFrame:
    """The full plan: coupling read from source files, PyPI names retried through file listings."""
    used = diet_plan_module.source_coupling(fx["fx_sources"], _dependencies(fx), fx["fx_wheel_files"])
    plan = removal_plan(fx["fx_edges"], fx["fx_direct"], fx["fx_packages"], _scan(fx), used)
    return plan.select(
        "project_id",
        "rank",
        "package_id",
        F.round("priority", 9).alias("priority"),
        "difficulty",
        "is_unused",
        "import_files",
        "call_sites",
        "api_breadth",
    )


# --- inputs and keys ------------------------------------------------------------------------


@query
def input_quality(fx: Fixtures) -> DataFrame:
    quality = inputs.read_inputs(fx["fx_inputs"])[1]
    return quality.withColumn("unrecognised_share", F.round("unrecognised_share", 9))


@query
def input_lines(fx: Fixtures) -> DataFrame:
    return inputs.read_inputs(fx["fx_inputs"])[0]


@query
def input_range(fx: Fixtures) -> DataFrame:
    """Inputs of an inclusive line range; the quality of a file is judged inside it."""
    return inputs.read_inputs(fx["fx_inputs"], line_range="3:14")[0]


def _purls(fx: Fixtures) -> DataFrame:
    lines = inputs.classify_lines(fx["fx_inputs"]).where("kind = 'package'")
    return lines.select("file_id", "line_no", F.col("line").alias("purl"))


@query
def package_keys(fx: Fixtures) -> DataFrame:
    return keys.resolve_package_keys(_purls(fx)).select(
        "file_id", "line_no", "purl", "canonical_key", "purl_version"
    )


@query
def key_variants(fx: Fixtures) -> DataFrame:
    return keys.key_variants(keys.resolve_package_keys(_purls(fx)))


@query
def dedup_inputs(fx: Fixtures) -> DataFrame:
    resolved = keys.resolve_package_keys(_purls(fx)).where("canonical_key IS NOT NULL")
    placed = resolved.select("canonical_key", F.struct("file_id", "line_no").alias("position"), "purl")
    return keys.dedup_inputs(placed, "canonical_key", "position").select("canonical_key", "position.*", "purl")


@query
def maven_repair(fx: Fixtures) -> DataFrame:
    return keys.repair_maven_inputs(_purls(fx))


@query
def maven_repair_stats(fx: Fixtures) -> DataFrame:
    return keys.repair_stats(keys.repair_maven_inputs(_purls(fx)))


@query
def supported_split(fx: Fixtures) -> DataFrame:
    supported, skipped = keys.split_supported(_purls(fx))
    both = supported.withColumn("supported", F.lit(True)).unionByName(skipped.withColumn("supported", F.lit(False)))
    return keys.resolve_package_keys(both).groupBy("supported", F.col("purl_type").alias("ecosystem")).agg(
        F.count(F.lit(1)).alias("inputs")
    )


@query
def ecosystem_filter(fx: Fixtures) -> DataFrame:
    return keys.filter_ecosystem(_purls(fx), "NPM")


@query
def graph_eligible(fx: Fixtures) -> DataFrame:
    return keys.graph_eligible(fx["fx_packages"]).select("package_id", "ecosystem", "version")


@query
def repo_groups(fx: Fixtures) -> DataFrame:
    return keys.group_by_repo(fx["fx_repo_urls"])


@query
def repo_choice(fx: Fixtures) -> DataFrame:
    return keys.choose_repo(fx["fx_repo_candidates"].withColumnRenamed("raw", "url"))


@query
def registry_pages(fx: Fixtures) -> DataFrame:
    return keys.enrich_package(fx["fx_packages"]).select(
        "package_id", "registry_name", "registry_url", "version_url"
    )


@query
def package_inference(fx: Fixtures) -> DataFrame:
    return keys.infer_package(fx["fx_repo_names"], fx["fx_manifest_managers"], fx["fx_languages"])


@query
def roundtrip_check(fx: Fixtures) -> DataFrame:
    return keys.validate_roundtrip(fx["fx_roundtrip"]).select("package_id", "repo_matches", "repository_only")


@query
def vanity_repos(fx: Fixtures) -> DataFrame:
    return keys.resolve_vanity(fx["fx_vanity"], fx["fx_html"])


# --- bills of materials, module files and workflows --------------------------------------------


@query
def sbom_components(fx: Fixtures) -> DataFrame:
    return sbom.unique_components(sbom.read_sboms(fx["fx_sbom"])[0])


@query
def sbom_edges(fx: Fixtures) -> DataFrame:
    components, dependencies, _ = sbom.read_sboms(fx["fx_sbom"])
    return graph.sbom_edges(sbom.reference_map(components), dependencies)


@query
def sbom_direct(fx: Fixtures) -> DataFrame:
    components, dependencies, roots = sbom.read_sboms(fx["fx_sbom"])
    return graph.direct_deps(sbom.reference_map(components), dependencies, roots, dealt=True)


@query
def aggregator_modules(fx: Fixtures) -> DataFrame:
    """One project per Maven group: its packages are the direct dependencies of an aggregator root."""
    modules = fx["fx_packages"].where("ecosystem = 'maven'").select(
        F.col("namespace").alias("project_id"), "package_id", "purl"
    )
    purls = fx["fx_packages"].select(F.col("package_id").alias("dst"), F.col("purl").alias("dst_purl"))
    edges = (
        fx["fx_edges"].select("src", "dst").distinct()
        .join(modules.withColumnRenamed("package_id", "src"), "src")
        .join(purls, "dst")
        .select("project_id", F.col("purl").alias("src"), F.col("dst_purl").alias("dst"))
    )
    roots = modules.select("project_id").distinct().select(
        "project_id", F.concat(F.lit("pkg:maven/"), F.col("project_id"), F.lit("/root@1.0")).alias("root_purl")
    )
    return graph.flatten_aggregators(modules.select("project_id", "purl"), edges, roots)


@query
def go_requirements(fx: Fixtures) -> DataFrame:
    return manifests.read_go_manifests(fx["fx_gomod"])


@query
def workflow_refs(fx: Fixtures) -> DataFrame:
    return manifests.read_workflow_refs(fx["fx_workflows"])


def _workflow_tables(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    refs = cut_by(manifests.read_workflow_refs(fx["fx_workflows"]).drop("ref"), "scope", dealt=True)  # texts are read once
    return refs.where("path LIKE '.github/workflows/%'"), refs.where("path NOT LIKE '.github/workflows/%'")


def _folder(path: str) -> Column:
    return F.regexp_replace(path, "/action.ya?ml$", "")


@query
def action_closure(fx: Fixtures) -> DataFrame:
    direct, nested = _workflow_tables(fx)
    composite = nested.where("kind = 'remote'").select(
        "scope", _folder("path").alias("action"), F.col("action").alias("uses")
    )
    return graph.action_closure(direct.where("kind = 'remote'").select("scope", "action"), composite)


@query
def local_action_uses(fx: Fixtures) -> DataFrame:
    direct, nested = _workflow_tables(fx)
    start = direct.where("kind = 'local'").select("scope", F.col("local_path").alias("path"))
    local = nested.where("kind = 'local'").select(
        "scope", _folder("path").alias("path"), F.col("local_path").alias("uses_path")
    )
    remote = nested.where("kind = 'remote'").select("scope", _folder("path").alias("path"), "action")
    return graph.local_action_uses(start, local, remote)


@query
def file_formats(fx: Fixtures) -> DataFrame:
    return files.route_files(fx["fx_files"]).select("path", "format")


@query
def source_selection(fx: Fixtures) -> DataFrame:
    placed = F.expr(
        "CASE length(text) % 6 WHEN 0 THEN 'vendor/' || path WHEN 1 THEN 'lib/build/' || path "
        "WHEN 2 THEN 'builder/' || path WHEN 3 THEN path || '.txt' ELSE path END"
    )
    moved = fx["fx_sources"].select("project_id", placed.alias("path"), "text")
    return files.select_sources(moved).select("project_id", "path", "lang")


# --- repository metadata and counts --------------------------------------------------------------


@query
def repo_metadata(fx: Fixtures) -> DataFrame:
    return repos.merge_repo_metadata(fx["fx_projects"], fx["fx_repos"])


@query
def repo_topics(fx: Fixtures) -> DataFrame:
    topics = fx["fx_topics"].select(F.col("key").alias("repo_id"), F.split("text", " ").alias("topics"))
    return repos.repo_topics(topics).select("repo_id", F.array_join(F.array_sort("topics"), ";").alias("topics"))


@query
def dependent_counts(fx: Fixtures) -> DataFrame:
    return repos.dependent_counts(fx["fx_packages"], fx["fx_dependents"])


@query
def yanked_versions(fx: Fixtures) -> DataFrame:
    lines = fx["lineitem"].select(
        F.col("l_partkey").alias("package_id"),
        F.col("l_linenumber").alias("version"),
        F.expr("l_returnflag = 'R' AND l_quantity > 45").alias("version_yanked"),
        F.expr("l_linestatus = 'F'").alias("file_yanked"),
    )
    return releases.yanked_versions(lines)


@query
def coverage_report(fx: Fixtures) -> DataFrame:
    def present(name: str, column: str) -> DataFrame:
        return fx[name].select("repo_id").distinct().withColumn(column, F.lit(True))

    joined = fx["fx_packages"]
    for name, column in (("fx_repos", "has_repository"), ("fx_commits", "has_project"), ("fx_scores", "has_scorecard")):
        joined = joined.join(present(name, column), "repo_id", "left").withColumn(
            column, F.coalesce(column, F.lit(False))
        )
    return repos.coverage_report(joined)


@query
def archived_by_check(fx: Fixtures) -> DataFrame:
    """Repositories the Maintained check reports as archived."""
    checks = fx["fx_scores"]
    return checks.where(repos.archived_by_reason(F.col("check_name"), F.col("reason"))).select("repo_id", "reason")


@query
def vanity_entries(fx: Fixtures) -> DataFrame:
    return keys.page_metadata(fx["fx_html"])


# --- result rows -----------------------------------------------------------------------------------


@query
def missing_inputs(fx: Fixtures) -> DataFrame:
    key = F.col("package_id").alias("key")
    return reports.mark_missing(
        fx["fx_packages"].select(key), fx["fx_versions"].select(key), fx["fx_registry"].select(key)
    )


@query
def not_found(fx: Fixtures) -> DataFrame:
    key = F.col("package_id").alias("key")
    return reports.not_found(fx["fx_packages"].select(key), fx["fx_versions"].select(key))


@query
def new_actions(fx: Fixtures) -> DataFrame:
    direct, nested = _workflow_tables(fx)
    found = nested.where("kind = 'remote'").select("action")
    return reports.new_actions_only(found, direct.where("kind = 'remote'").select("action"))


@query
def merged_results(fx: Fixtures) -> DataFrame:
    first = fx["fx_versions"].groupBy(F.col("package_id").alias("key")).agg(F.min("version").alias("value"))
    second = fx["fx_advisories"].groupBy(F.col("package_id").alias("key")).agg(F.max("version").alias("value"))
    return reports.merge_results(
        first.withColumn("origin", F.lit("first")), second.withColumn("origin", F.lit("second"))
    )


@query
def source_union(fx: Fixtures) -> DataFrame:
    action = F.expr(
        "'owner' || (package_id % 40) || '/repo' || (package_id % 40) || '/act' || package_id || CASE WHEN package_id % 6 = 0 THEN '/sub' ELSE '' END"
    )
    named = fx["fx_packages"].select("package_id", action.alias("action"))
    direct = named.join(fx["fx_direct"].select("package_id").distinct(), "package_id").select(F.col("action").alias("key"))
    nested = named.groupBy(F.regexp_extract("action", "^([^/]+/[^/]+)", 1).alias("key")).agg(F.min("action").alias("via"))
    return reports.union_sources(
        purl=fx["fx_packages"].select(F.col("purl").alias("key")),
        repository=fx["fx_repos"].select(F.col("repo_url").alias("key")),
        actions=direct,
        actions_transitive=nested,
    )


@query
def distinct_lookup_keys(fx: Fixtures) -> DataFrame:
    return reports.distinct_keys(fx["fx_advisories"], "advisory_id")


@query
def scan_rows(fx: Fixtures) -> DataFrame:
    return reports.scan_rows(_scan(fx))


@query
def scorecard_wide(fx: Fixtures) -> DataFrame:
    entries = _scan(fx)
    dated = entries.withColumns(
        {
            "days_since_stable": age_days(F.col("stable.published_at"), AS_OF),
            "days_since_prerelease": age_days(F.col("prerelease.published_at"), AS_OF),
        }
    )
    chosen = advisories.choose_graphs(_with_slots(fx), fx["fx_versions"], fx["fx_package_graphs"]).select("package_id", "graph_version")
    nodes = fx["fx_package_graphs"].join(chosen, ["package_id", "graph_version"]).select("package_id", "relation")
    counts = repos.dependency_counts(fx["fx_packages"].select("package_id"), nodes)
    dependents = repos.dependent_counts(fx["fx_packages"], fx["fx_dependents"]).select("package_id", F.col("dependent_count").alias("dependents"))
    counts = counts.select("package_id", F.col("direct_count").alias("direct_deps"), F.col("transitive_count").alias("transitive_deps"))
    return reports.scorecard_wide(dated.join(counts, "package_id").join(dependents, "package_id"), fx["fx_scores"])


@query
def ordered_distribution(fx: Fixtures) -> DataFrame:
    return reports.order_distribution(reports.label_distribution(_scan(fx)))


@query
def ordered_entries(fx: Fixtures) -> DataFrame:
    return reports.order_by_bucket(_scan(fx)).select("purl", "bucket", "bucket_place", "position")


@query
def diet_export(fx: Fixtures) -> DataFrame:
    """The plan from source files with list columns."""
    matched = diet_plan_module.matched_sources(fx["fx_sources"], _dependencies(fx), fx["fx_wheel_files"])
    plan = removal_plan(fx["fx_edges"], fx["fx_direct"], fx["fx_packages"], _scan(fx), coupling.coupling_metrics(matched))
    via = graph.indirect_via(fx["fx_reach"], fx["fx_direct"])
    return reports.diet_export(plan, via, coupling.coupling_symbols(matched), coupling.coupling_files(matched), fx["fx_packages"])


@query
def lifecycle_summary(fx: Fixtures) -> DataFrame:
    return reports.lifecycle_summary(_scan(fx))


@query
def verdict_filter(fx: Fixtures) -> DataFrame:
    return assess.filter_verdicts(_scan(fx), ["replace", "Review"]).select("package_id", "verdict")


@query
def label_filter(fx: Fixtures) -> DataFrame:
    return assess.filter_labels(_scan(fx), only_review=True, only_eol=True).select("package_id", "status")


@query
def fail_policy(fx: Fixtures) -> DataFrame:
    entries = fx["fx_direct"].join(_scan(fx), "package_id")
    return assess.fail_policy(entries, ["eol-confirmed", "eol-effective"])


@query
def project_scan(fx: Fixtures) -> DataFrame:
    return reports.scan_summary(fx["fx_direct"].join(_scan(fx), "package_id"), "project_id")


@query
def relation_filter(fx: Fixtures) -> DataFrame:
    return assess.filter_relation(graph.classify_relation(_nodes(fx), fx["fx_direct"], fx["fx_edges"]))


@query
def workspace_filter(fx: Fixtures) -> DataFrame:
    local = F.expr(
        "CASE package_id % 5 WHEN 0 THEN 'workspace:*' WHEN 1 THEN 'link:../x' WHEN 2 THEN '0.0.0-use.local' "
        "WHEN 3 THEN 'file:./y' ELSE version END"
    )
    return diet.drop_workspace(fx["fx_packages"].select("package_id", "ecosystem", local.alias("version")))


@query
def success_flags(fx: Fixtures) -> DataFrame:
    flag = assess.is_success(F.col("error"), F.col("score_count"), F.col("lifecycle_label"))
    return _scan(fx).select("package_id", flag.alias("successful"))


@query
def final_reasons(fx: Fixtures) -> DataFrame:
    catalog = fx["fx_registry"].where("source = 'catalog'")
    return eol_rules.final_reason(fx["fx_evidence"], catalog)


@query
def input_sample(fx: Fixtures) -> DataFrame:
    classified = inputs.classify_lines(fx["fx_inputs"])
    return keys.sample_inputs(classified, 25, seed=7)


# --- from documents to results ---------------------------------------------------------------------


def _enrichers(fx: Fixtures) -> list:
    return [scan_plan.catalog_from(fx["fx_registry"])]


@query
def scan_from_inputs(fx: Fixtures) -> DataFrame:
    """Package lists to scan results: quality gate, keys, first occurrence, facts with transitive advisories."""
    return entrypoints.scan_lines(fx["fx_inputs"], _facts(fx), AS_OF, enrichers=_enrichers(fx))


@query
def scan_from_sbom(fx: Fixtures) -> DataFrame:
    """SBOM documents to scan results with relation and the direct dependency that brings a package in."""
    return entrypoints.scan_sboms(fx["fx_sbom"], _facts(fx), AS_OF, enrichers=_enrichers(fx))


@query
def scan_from_gomod(fx: Fixtures) -> DataFrame:
    """Module files to scan results."""
    return entrypoints.scan_go_modules(fx["fx_gomod"], _facts(fx), AS_OF, enrichers=_enrichers(fx))


@query
def scan_from_repos(fx: Fixtures) -> DataFrame:
    """List files to scan results of their packages, repositories, and the actions that these repositories use."""
    repo = F.concat(F.lit("github.com/owner"), (F.col("scope") % 50).cast("string"), F.lit("/repo"), F.col("scope").cast("string"))
    workflows = fx["fx_workflows"].withColumn("scope", repo)
    return entrypoints.scan_repos(fx["fx_inputs"], workflows, _facts(fx), AS_OF, enrichers=_enrichers(fx))


@query
def diet_from_sbom(fx: Fixtures) -> DataFrame:
    """SBOM documents to a ranked removal plan, with a development tool in each project."""
    tools = fx["fx_direct"].groupBy("project_id").agg(F.min("package_id").alias("package_id"))
    named = fx["fx_packages"].select("package_id", F.concat_ws("/", "namespace", "name").alias("name"))
    tools = tools.join(named, "package_id").select("project_id", "name")
    plan = entrypoints.plan_from_sboms(fx["fx_sbom"], _facts(fx), AS_OF, enrichers=_enrichers(fx), tools=tools)
    return reports.diet_rows(plan)
