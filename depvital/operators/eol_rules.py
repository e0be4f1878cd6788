"""Registry end-of-life rules.

Signals of all registries arrive as one long table. Every rule is a branch of one CASE over the signal
row, and one grouped aggregation keeps the first terminal rule of each package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depvital.operators.eol_text import eol_announcement, npm_successor

# --- fixed values: ecosystems with a registry rule of their own ---------------
AUTHORITATIVE = ("npm", "nuget", "composer", "packagist", "maven", "pypi", "cargo")
DEPSDEV_SYSTEMS = {
    "golang": "go",
    "go": "go",
    "gem": "rubygems",
    "rubygems": "rubygems",
    "npm": "npm",
    "cargo": "cargo",
    "maven": "maven",
    "pypi": "pypi",
    "nuget": "nuget",
}
HUMAN_SOURCE = "HumanCatalog"


# Rules in evaluation order: condition, order, terminal, source, summary, confidence, successor. Summary,
# confidence and successor are SQL; conditions read the columns prepared in rule_hits().
_RULES = (
    ("ecosystem IN ('composer', 'packagist') AND flag = 'abandoned'", 1, True, "Packagist",
     "'Package marked abandoned'", "1.0D", "_next"),
    ("_nuget AND _next IS NOT NULL", 2, True, "NuGet", "'Package deprecated with successor'", "0.9D", "_next"),
    ("_nuget AND _reason LIKE '%criticalbugs%'", 2, True, "NuGet", "'Package deprecated: CriticalBugs'", "1.0D", "NULL"),
    ("_nuget AND _reason LIKE '%legacy%'", 2, False, "NuGet", "'Package deprecated: Legacy (no successor)'", "0.7D",
     "NULL"),
    ("_nuget AND _reason LIKE '%other%'", 2, False, "NuGet",
     "CASE WHEN _strong_wording THEN 'Package deprecated: Other (strong wording)' ELSE 'Package deprecated: Other' END",
     "CASE WHEN _strong_wording THEN 0.8D ELSE 0.5D END", "NULL"),
    ("ecosystem = 'npm' AND flag = 'unpublished' AND _on_stable", 3, True, "npmjs", "'Unpublished in npm registry'",
     "0.95D", "_npm_next"),
    ("ecosystem = 'npm' AND flag = 'deprecated' AND _on_stable", 3, True, "npmjs", "'Deprecated in npm registry'",
     "0.9D", "_npm_next"),
    ("ecosystem = 'npm' AND flag = 'unpublished' AND _on_input", 4, True, "npmjs", "'Unpublished in npm registry'",
     "0.95D", "_npm_next"),
    ("ecosystem = 'npm' AND flag = 'deprecated' AND _on_input", 4, True, "npmjs", "'Deprecated in npm registry'",
     "0.9D", "_npm_next"),
    ("ecosystem = 'pypi' AND flag = 'inactive_classifier'", 5, True, "PyPI",
     "'Classifier: Development Status :: 7 - Inactive'", "1.0D", "NULL"),
    ("ecosystem = 'pypi' AND flag = 'yanked' AND _pinned", 6, True, "PyPI", "'Version yanked on PyPI' || _note",
     "0.95D", "NULL"),
    ("ecosystem = 'cargo' AND flag = 'yanked' AND _pinned", 7, True, "crates.io", "'Version yanked on crates.io'",
     "1.0D", "NULL"),
    ("ecosystem = 'maven' AND flag = 'relocated' AND _input IS NOT NULL", 8, True, "Maven",
     "'Artifact relocated' || _note", "0.95D", "_next"),
)


def _rule_struct(order: int, terminal: bool, source: str, summary: str, confidence: str, successor: str) -> str:
    return (
        f"named_struct('order', {order}, 'terminal', {str(terminal).lower()}, 'source', '{source}', 'summary', {summary}, "
        f"'confidence', {confidence}, 'successor', CAST({successor} AS STRING))"
    )


def rule_hits(packages: DataFrame, signals: DataFrame) -> DataFrame:
    """Evidence rows of every registry rule that fires.

    ``packages`` has package_id, ecosystem, namespace, name, version, stable (struct version,
    is_deprecated). ``signals`` has package_id, source, flag, version (NULL for the whole package),
    reason, message, successor.
    """
    base = packages.select("package_id", "ecosystem", "namespace", "name", "version", "stable")
    registry = signals.where("source <> 'catalog'").withColumnRenamed("version", "signal_version")
    wording = eol_announcement(F.col("message"), F.col("name"), "message")["kind"]
    prepared = {
        "_input": "nullif(version, '')",
        "_stable": "nullif(stable.version, '')",
        "_next": "nullif(trim(successor), '')",
        "_reason": "lower(coalesce(reason, ''))",
        "_note": "coalesce(': ' || nullif(trim(message), ''), '')",
        "_nuget": "ecosystem = 'nuget' AND flag = 'deprecated'",
    }
    applies = {
        "_pinned": "coalesce(_input, _stable) IS NOT NULL"
        " AND (signal_version IS NULL OR signal_version = coalesce(_input, _stable))",
        "_on_stable": "_stable IS NOT NULL AND (signal_version IS NULL OR signal_version = _stable)",
        "_on_input": "_stable IS NULL AND _input IS NOT NULL AND (signal_version IS NULL OR signal_version = _input)",
    }
    joined = (
        base.join(registry, "package_id")
        .withColumns({name: F.expr(sql) for name, sql in prepared.items()})
        .withColumns({name: F.expr(sql) for name, sql in applies.items()})
    )
    # filter on the conditions, not on the evidence, so that no text is read to decide whether a rule fires
    fired = joined.where(" OR ".join(f"({rule[0]})" for rule in _RULES)).withColumns(
        {
            "_strong_wording": F.when(F.col("_nuget"), F.coalesce(wording.isin("strong", "explicit"), F.lit(False))),
            "_npm_next": npm_successor(F.col("message"), F.col("name"), F.concat_ws("/", "namespace", "name")),
        }
    )
    case = "CASE " + " ".join(f"WHEN {rule[0]} THEN {_rule_struct(*rule[1:])}" for rule in _RULES) + " END"
    from_registry = fired.select("package_id", F.expr(case).alias("hit")).select("package_id", "hit.*")
    fallback = packages.where(
        F.col("stable.is_deprecated") & ~F.lower("ecosystem").isin(*AUTHORITATIVE)
        & F.lower("ecosystem").isin(*DEPSDEV_SYSTEMS)
    ).select(
        "package_id",
        F.expr(_rule_struct(9, True, "deps.dev", "'Marked deprecated in deps.dev'", "0.95D", "NULL")).alias("hit"),
    )
    return from_registry.unionByName(fallback.select("package_id", "hit.*"))


def eol_status(hits: DataFrame) -> DataFrame:
    """Per package: end-of-life state, successor and final reason of the first terminal rule.

    Evidence that only warns stays visible through evidence_summary, without a state.
    """
    row = F.struct("source", "summary", "confidence", "successor")
    first = F.min_by(row, F.when(F.col("terminal"), F.struct("order", -F.col("confidence"), "summary")))
    warn = F.min_by(row, F.when(~F.col("terminal"), F.struct(-F.col("confidence"), F.col("summary"))))
    picked = hits.groupBy("package_id").agg(first.alias("first"), warn.alias("warn"))
    return picked.select(
        "package_id",
        F.when(F.col("first").isNotNull(), "EOL").alias("eol_state"),
        F.coalesce("first.source", "warn.source").alias("eol_source"),
        F.when(F.col("first").isNotNull(), F.col("first.summary")).alias("eol_reason"),
        F.col("first.successor").alias("eol_successor"),
        F.coalesce("first.summary", "warn.summary").alias("evidence_summary"),
        F.lit(None).cast("string").alias("eol_scheduled"),
    )


def catalog_enricher(eol: DataFrame, catalog: DataFrame) -> DataFrame:
    """Overlay reviewed catalogue facts: its reason wins, its state fills in where no registry rule fired.

    ``catalog`` has package_id, flag (scheduled or eol), reason, successor, scheduled; one row per package.
    """
    c = catalog.select(
        "package_id",
        F.when(F.col("flag") == "eol", "EOL").when(F.col("flag") == "scheduled", "Scheduled").alias("c_state"),
        F.expr("nullif(trim(reason), '')").alias("c_reason"),
        F.expr("nullif(trim(successor), '')").alias("c_successor"),
        F.col("scheduled").alias("c_scheduled"),
    )
    return eol.join(c, "package_id", "full").select(
        "package_id",
        F.coalesce("eol_state", "c_state").alias("eol_state"),
        F.coalesce("eol_source", F.when(F.col("c_state").isNotNull(), "catalog")).alias("eol_source"),
        F.coalesce("c_reason", "eol_reason").alias("eol_reason"),
        F.coalesce("eol_successor", "c_successor").alias("eol_successor"),
        F.coalesce("c_reason", "evidence_summary").alias("evidence_summary"),
        F.when(F.col("eol_state").isNull(), F.col("c_scheduled")).alias("eol_scheduled"),
    )


def final_reason(evidence: DataFrame, catalog_reason: DataFrame | None = None) -> DataFrame:
    """One reason per package: catalogue reason, human-reviewed evidence, most confident evidence.

    ``evidence`` has package_id, position, source, summary, confidence; ties keep the first position.
    """
    human = (F.col("source") != HUMAN_SOURCE).cast("int")
    best = evidence.groupBy("package_id").agg(
        F.min_by("summary", F.struct(human, -F.col("confidence"), "position")).alias("reason")
    )
    if catalog_reason is None:
        return best
    override = catalog_reason.select("package_id", F.col("reason").alias("override"))
    return best.join(override, "package_id", "full").select(
        "package_id", F.coalesce("override", "reason").alias("reason")
    )
