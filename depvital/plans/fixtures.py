"""Dependency-health tables derived from the driver's tables.

Each view is one SQL text over whole input tables, written in the SQL that Spark and DuckDB share, so
both engines see the same rows. ``{name}`` stands for an input table or another view. Moduli below only
choose attribute values; they never select rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from depvital.operators import graph
from depvital.session import ensure_checkpoint_dir, spread
from depvital.sources import facts

AS_OF = "2024-02-01 00:00:00"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_ECO = ("npm", "pypi", "maven", "cargo", "golang", "gem", "composer", "nuget")
_ECO_CASE = "CASE {key} % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ECO)) + " END"
_BUILD_CHECKS = (
    "Dangerous-Workflow",
    "Branch-Protection",
    "Code-Review",
    "Token-Permissions",
    "Binary-Artifacts",
    "Pinned-Dependencies",
)


# PyPI distribution names differ from the module name for two packages of three
# package 10 is loaded at run time and never imported
_RUNTIME = "CASE WHEN p.k = 10 THEN 'org.postgresql' ELSE p.brand END"
_NAME = "CASE WHEN p.k = 10 THEN 'postgresql' WHEN p.k % 8 = 1 AND p.k % 3 = 1 THEN 'py-' WHEN p.k % 8 = 1 AND p.k % 3 = 2 THEN 'dist-' ELSE '' END || 'p' || p.k"
#: Identifiers of packages without a release start here, above those of all parts.
UNRELEASED = 1_000_000_000_000


def _eco(key: str) -> str:
    return _ECO_CASE.replace("{key}", key)


_CHECK_STRUCTS = ", ".join(
    ["{open}'Maintained'{sep}(repo_id * 7) % 13 - 2{close}"]
    + ["{open}'Vulnerabilities'{sep}least(10, (repo_id * 5 + 77) % 14 - 2){close}"]
    + [
        f"{{open}}'{name}'{{sep}}least(10, (repo_id * 7) % 13 - 2 + (repo_id + {k}) % 3){{close}}"
        for k, name in enumerate(_BUILD_CHECKS)
    ]
)
_SPARK_CHECKS = _CHECK_STRUCTS.format(open="named_struct('check_name', ", sep=", 'score', ", close=")")
_DUCK_CHECKS = _CHECK_STRUCTS.format(open="{{'check_name': ", sep=", 'score': ", close="}}")

_LINE_VERSIONS = (
    "SELECT l_orderkey, l_linenumber AS n, l_partkey AS package_id, l_linenumber || '.' || CAST(l_quantity AS INT) || '.' || (l_suppkey % 10) "
    "|| CASE WHEN l_returnflag = 'R' THEN '-rc.' || l_linenumber ELSE '' END AS version FROM {lineitem}"
)
_REASON = "CASE WHEN c.check_name = 'Maintained' AND c.score < 1 THEN 'Project is archived since repo ' || repo_id ELSE 'active' END"

# a view is one shared text, or a (Spark, DuckDB) pair where the two spell an explode differently
VIEWS: dict[str, str | tuple[str, str]] = {
    # one row per (package, version); shifted publish dates spread the ages over all rules, and dates past the evaluation
    # time move back
    "fx_versions": f"""
SELECT package_id, version, published_at - INTERVAL '1' YEAR * (CASE WHEN published_at > TIMESTAMP '{AS_OF}' THEN 8 ELSE 0 END)
  AS published_at, is_default, is_deprecated FROM (
  SELECT l_partkey AS package_id,
    l_linenumber || '.' || CAST(l_quantity AS INT) || '.' || (l_suppkey % 10)
      || CASE WHEN l_returnflag = 'R' THEN '-rc.' || l_linenumber ELSE '' END AS version,
    min(l_shipdate + INTERVAL '1' YEAR * (CASE
      WHEN l_partkey % 10 = 0 THEN 22 WHEN l_partkey % 10 = 1 THEN 28
      WHEN l_partkey % 10 = 2 THEN 27 WHEN l_partkey % 10 = 3 THEN 21 ELSE 8 END)) AS published_at,
    bool_or(l_linestatus = 'O' AND l_linenumber = 1) AS is_default,
    bool_and(l_tax >= 0.08) AS is_deprecated
  FROM {{lineitem}} GROUP BY 1, 2
) v
""",
    # every part is a released package, one of five named without a version; every supplier is one never released
    "fx_packages": f"""
SELECT p.k AS package_id, {_eco('p.k')} AS ecosystem,
  CASE WHEN p.k % 8 = 0 THEN '@' ELSE '' END || CASE WHEN p.k % 8 IN (0, 2, 4, 6) THEN {_RUNTIME} END AS namespace,
  {_NAME} AS name, CASE WHEN p.k % 5 <> 2 THEN v.version END AS version,
  'pkg:' || {_eco('p.k')} || '/'
    || CASE WHEN p.k % 8 = 0 THEN '%40' ELSE '' END
    || CASE WHEN p.k % 8 IN (0, 2, 4, 6) THEN {_RUNTIME} || '/' ELSE '' END
    || {_NAME} || coalesce('@' || CASE WHEN p.k % 5 <> 2 THEN v.version END, '') AS purl,
  p.k % (2 * (SELECT count(DISTINCT user_id) FROM {{events}})) AS repo_id
FROM (SELECT p_partkey AS k, lower(replace(p_brand, '#', '')) AS brand FROM {{part}}
  UNION ALL SELECT s_suppkey + {UNRELEASED} AS k, 'vendor' || (s_nationkey % 5) AS brand FROM {{supplier}}) p
LEFT JOIN (SELECT package_id, min(version) AS version FROM {{fx_versions}} GROUP BY 1) v ON v.package_id = p.k
""",
    # advisories of returned lines concern versions that may be in use, all others early versions that no one uses
    "fx_advisories": """
SELECT l_partkey AS package_id,
  CASE WHEN l_returnflag = 'A' THEN l_linenumber || '.' || CAST(l_quantity AS INT) || '.' || (l_suppkey % 10)
    ELSE '0.0.' || l_linenumber END AS version,
  CASE l_orderkey % 4 WHEN 0 THEN 'GHSA-' WHEN 1 THEN 'CVE-' WHEN 2 THEN 'GO-' ELSE 'PYSEC-' END
    || l_orderkey AS advisory_id,
  max(CAST(l_orderkey % 11 AS DOUBLE)) AS cvss3, CAST(NULL AS VARCHAR(9)) AS relation
FROM {lineitem} GROUP BY 1, 2, 3
""",
    "fx_commits": """
SELECT user_id AS repo_id, event_id AS commit_id,
  CASE WHEN event_type = 'error' OR user_id % 13 = 5 THEN 'dependabot[bot]'
    WHEN event_type = 'signup' THEN NULL ELSE 'user' || user_id END AS login,
  ts - INTERVAL '1' DAY * ((user_id % 12) * 100) AS committed_at
FROM {events}
""",
    "fx_repos": """
SELECT repo_id, 'https://github.com/owner' || (repo_id % 50) || '/repo' || repo_id AS repo_url,
  CASE WHEN repo_id % 5 <> 2 THEN repo_id % 17 = 0 END AS archived, repo_id % 41 = 0 AS disabled, repo_id % 9 = 0 AS fork,
  CASE WHEN repo_id % 9 = 0 THEN 'upstream/repo' || repo_id END AS fork_source,
  CAST((repo_id * 31) % 101 AS DOUBLE) / 10 AS overall_score, (repo_id * 37) % 5000 AS stars, (repo_id * 11) % 700 AS forks,
  CASE WHEN repo_id % 3 = 0 THEN 'https://home.example.org/' || repo_id END AS homepage,
  CASE WHEN repo_id % 4 <> 1 THEN 'Repository   ' || repo_id || ' of the sample. It has more text' END AS description,
  CASE WHEN repo_id % 5 = 0 THEN 'develop' END AS default_branch,
  CASE repo_id % 6 WHEN 0 THEN 'Go' WHEN 1 THEN 'Python' WHEN 2 THEN 'Java' WHEN 3 THEN 'Rust'
    WHEN 4 THEN 'C#' ELSE NULL END AS language
FROM (SELECT DISTINCT p_partkey % (2 * (SELECT count(DISTINCT user_id) FROM {events})) AS repo_id FROM {part}) r
""",
    "fx_scores": (
        f"SELECT repo_id, c.check_name, c.score, {_REASON} AS reason FROM {{fx_repos}} LATERAL VIEW explode(array({_SPARK_CHECKS})) t AS c "
        "WHERE c.score > -2",
        f"SELECT repo_id, c.check_name, c.score, {_REASON} AS reason FROM (SELECT repo_id, unnest([{_DUCK_CHECKS}]) AS c FROM {{fx_repos}}) t "
        "WHERE c.score > -2",
    ),
    "fx_registry": """
SELECT package_id, source, flag, version, reason, message, successor, scheduled FROM (
  SELECT package_id,
    CASE WHEN ecosystem IN ('pypi', 'cargo') AND package_id % 3 > 0 THEN version
      WHEN ecosystem IN ('pypi', 'cargo') THEN '0.0.0' END AS version,
    CASE ecosystem WHEN 'composer' THEN 'packagist' WHEN 'cargo' THEN 'crates' ELSE ecosystem END AS source,
    CASE WHEN package_id % 23 IN (1, 2) THEN CASE ecosystem
        WHEN 'composer' THEN 'abandoned' WHEN 'nuget' THEN 'deprecated' WHEN 'npm' THEN
          CASE WHEN package_id % 46 = 24 THEN 'unpublished' ELSE 'deprecated' END
        WHEN 'pypi' THEN CASE WHEN package_id % 23 = 1 THEN 'inactive_classifier' ELSE 'yanked' END
        WHEN 'cargo' THEN 'yanked' WHEN 'maven' THEN 'relocated' END
      WHEN package_id % 23 IN (3, 4) AND ecosystem = 'nuget' THEN 'deprecated' END AS flag,
    CASE WHEN ecosystem = 'nuget' THEN CASE package_id % 23
      WHEN 1 THEN 'CriticalBugs' WHEN 2 THEN 'Legacy' WHEN 3 THEN 'Legacy' ELSE 'Other' END END AS reason,
    CASE WHEN ecosystem = 'npm' THEN CASE package_id % 3
        WHEN 0 THEN 'Please use @new/pkg' || package_id || ' instead.'
        WHEN 1 THEN 'This moved to p' || package_id ELSE 'Replaced by nothing!' END
      WHEN ecosystem = 'nuget' THEN CASE WHEN package_id % 16 = 7
        THEN 'This package is old and this package is no longer maintained.' ELSE 'Please look elsewhere.' END
      WHEN ecosystem = 'maven' THEN 'moved' WHEN ecosystem = 'pypi' THEN 'broken build' END AS message,
    CASE WHEN ecosystem = 'composer' AND package_id % 23 = 1 THEN 'vendor/new' || package_id
      WHEN ecosystem = 'nuget' AND package_id % 23 = 2 THEN 'New.P' || package_id
      WHEN ecosystem = 'maven' THEN 'org.next/p' || package_id END AS successor,
    CAST(NULL AS VARCHAR(10)) AS scheduled
  FROM {fx_packages}
  UNION ALL
  SELECT package_id, CAST(NULL AS VARCHAR(10)) AS version, 'catalog' AS source,
    CASE WHEN package_id % 53 = 0 THEN 'scheduled' END AS flag,
    'Vendor announced end of support' AS reason, CAST(NULL AS VARCHAR(10)) AS message,
    CASE WHEN package_id % 2 = 0 THEN 'catalog-next' END AS successor, '2025-06-30' AS scheduled
  FROM {fx_packages}
) r WHERE flag IS NOT NULL
""",
    # facts of the same repositories from another source, which knows some that have no state
    "fx_projects": """
SELECT repo_id, CAST(7 AS BIGINT) AS stars, CAST(3 AS BIGINT) AS forks, 'project ' || repo_id AS description,
  CASE WHEN repo_id % 2 = 0 THEN 'https://p.example.org' END AS homepage, CAST(NULL AS VARCHAR(10)) AS default_branch,
  CAST(NULL AS VARCHAR(10)) AS language FROM {fx_repos}
""",
    # graph of a package version: the later lines of its orders, the next one directly; last lines have no graph
    "fx_package_graphs": (
        """
SELECT package_id, graph_version, dependency_id, dependency_version, CASE WHEN bool_or(is_next) THEN 'DIRECT' ELSE 'INDIRECT' END AS relation
FROM {fx_graph_pairs} GROUP BY 1, 2, 3, 4
""",
        f"""
SELECT a.package_id, a.version AS graph_version, b.package_id AS dependency_id, b.version AS dependency_version,
  min(CASE WHEN b.n = a.n + 1 THEN 'DIRECT' ELSE 'INDIRECT' END) AS relation
FROM ({_LINE_VERSIONS}) a JOIN ({_LINE_VERSIONS}) b ON b.l_orderkey = a.l_orderkey AND b.n > a.n
WHERE a.package_id <> b.package_id GROUP BY 1, 2, 3, 4
""",
    ),
    "fx_graph_pairs": f"""
SELECT a.package_id, a.version AS graph_version, b.package_id AS dependency_id, b.version AS dependency_version, b.n = a.n + 1 AS is_next
FROM ({_LINE_VERSIONS}) a JOIN ({_LINE_VERSIONS}) b ON b.l_orderkey = a.l_orderkey AND b.n > a.n
WHERE a.package_id <> b.package_id
""",
    "fx_edges": (
        "SELECT DISTINCT project_id, src, dst FROM {fx_order_edges}",
        """
SELECT DISTINCT o.o_custkey AS project_id, e.src, e.dst FROM (
  SELECT l_orderkey, l_partkey AS src,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM {lineitem}) l
) e JOIN {orders} o ON o.o_orderkey = e.l_orderkey WHERE e.dst IS NOT NULL AND e.src <> e.dst
""",
    ),
    "fx_order_edges": """
SELECT o.o_custkey AS project_id, e.src, e.dst FROM (
  SELECT l_orderkey, l_partkey AS src,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM {lineitem}) l
) e JOIN {orders} o ON o.o_orderkey = e.l_orderkey WHERE e.dst IS NOT NULL AND e.src <> e.dst
""",
    "fx_direct": (
        "SELECT DISTINCT project_id, package_id FROM {fx_order_firsts}",
        """
SELECT DISTINCT o.o_custkey AS project_id, f.l_partkey AS package_id FROM (
  SELECT l_orderkey, l_partkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM {lineitem}) l
) f JOIN {orders} o ON o.o_orderkey = f.l_orderkey WHERE f.rn = 1
""",
    ),
    "fx_order_firsts": """
SELECT o.o_custkey AS project_id, f.l_partkey AS package_id FROM (
  SELECT l_orderkey, l_partkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM {lineitem}) l
) f JOIN {orders} o ON o.o_orderkey = f.l_orderkey WHERE f.rn = 1
""",
    # import counts standing in for source analysis: a line of a finished order uses its part, an open one its supplier's package
    "fx_coupling": f"""
SELECT o.o_custkey AS project_id, CASE WHEN l.l_linestatus = 'F' THEN l.l_partkey ELSE l.l_suppkey + {UNRELEASED} END AS package_id,
  count(DISTINCT l.l_orderkey) AS import_files, count(*) AS call_sites,
  count(DISTINCT l.l_suppkey) AS api_breadth, bool_or(l.l_discount >= 0.09) AS has_blank_import
FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2
""",
    "fx_dependents": """
SELECT package_id, 'depsdev' AS source, (package_id * 13) % 7 AS dependent_count FROM {fx_packages}
UNION ALL
SELECT package_id, 'registry' AS source, (package_id * 29) % 1000 AS dependent_count FROM {fx_packages}
""",
}


def _spelling(index: str) -> str:
    """One of twelve licence spellings: canonical, other case, alias, address, free text or nothing."""
    return (
        f"CASE ({index}) % 12 WHEN 0 THEN 'MIT' WHEN 1 THEN 'mit' WHEN 2 THEN 'Apache License 2.0' "
        "WHEN 3 THEN 'Apache-2.0' WHEN 4 THEN 'NOASSERTION' WHEN 5 THEN 'Custom  License' WHEN 7 THEN 'BSD 3-Clause' "
        "WHEN 8 THEN 'GPL-3.0-only' WHEN 9 THEN 'https://www.apache.org/licenses/LICENSE-2.0.txt' "
        "WHEN 10 THEN 'LGPL 2.1' WHEN 11 THEN 'non-standard' END"
    )


def _address(index: str) -> str:
    return (
        f"CASE ({index}) % 5 WHEN 0 THEN 'https://www.apache.org/licenses/LICENSE-2.0.txt' "
        "WHEN 1 THEN 'http://opensource.org/licenses/MIT/' WHEN 2 THEN 'www.gnu.org/licenses/gpl.html' "
        "WHEN 3 THEN 'https://example.org/license' END"
    )


def _both(template: str) -> tuple[str, str]:
    """Spark and DuckDB spellings of a text that uses LIST(..) and ENTRY(name, url)."""
    spark = re.sub(r"ENTRY\((.*?) ;; (.*?)\)ENTRY", r"named_struct('name', \1, 'url', \2)", template)
    duck = re.sub(r"ENTRY\((.*?) ;; (.*?)\)ENTRY", r"struct_pack(name := \1, url := \2)", template)
    return spark.replace("LIST(", "array("), duck.replace("LIST(", "list_value(")


_TEXT_CASES = (
    "This project has been discontinued and archived.",
    "The library has reached end of life and should not be used.",
    "This project is not deprecated and still maintained.",
    "This project is no longer maintained. Please use coolpkg instead",
    "This project is no longer maintained and moved to @scope/newpkg",
    "The library has reached end of. life status soon",
    "Deprecated function foo() will be removed. See the notes.",
    "Python 2.7 is no longer supported.",
    "This repository is deprecated: use betterlib instead.",
    "Support continues until 2025-06-30 for this release, which is EOL for the project.",
    "No longer supported.",
    "The old branch was retired but the project is actively maintained.",
    "This package will be removed on 2024-12-31. Superseded by other-lib.",
    "Sunsetting this project. Replaced by newthing, see docs.",
    "Moved into read-only mode after 2023-01-15 no support is given.",
    "",
)
_ANNOUNCEMENT = "CASE {key} % 16 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXT_CASES)) + " END"

VIEWS["fx_licenses"] = _both(f"""
SELECT package_id, {_spelling('package_id')} AS project_raw, {_spelling('package_id * 5 + 3')} AS github_spdx,
  {_spelling('package_id * 7 + 1')} AS github_name,
  CASE package_id % 4 WHEN 1 THEN LIST({_spelling('package_id + 1')})
    WHEN 2 THEN LIST({_spelling('package_id + 1')}, {_spelling('package_id + 2')})
    WHEN 3 THEN LIST({_spelling('package_id + 3')}, {_spelling('package_id + 3')}) END AS version_spdx,
  CASE WHEN package_id % 3 > 0 THEN LIST({_spelling('package_id + 5')}, {_spelling('package_id + 7')}) END AS version_raw,
  CASE WHEN ecosystem = 'maven' THEN LIST(
    ENTRY({_spelling('package_id * 11 + 5')} ;; {_address('package_id * 3')})ENTRY,
    ENTRY({_spelling('package_id * 3 + 2')} ;; {_address('package_id * 2 + 1')})ENTRY) END AS manifest,
  package_id % 6 <> 0 AS requested_known
FROM {{fx_packages}}
""")
VIEWS["fx_pom_entries"] = f"""
SELECT package_id, 0 AS position, CASE WHEN package_id % 3 = 0 THEN '$' || '{{{{license.name}}}}' ELSE {_spelling('package_id + 2')} END
    AS name, {_address('package_id')} AS url FROM {{fx_packages}}
UNION ALL SELECT package_id, 1 AS position, {_spelling('package_id * 5')} AS name,
  CASE WHEN package_id % 4 = 0 THEN '$' || '{{{{license.url}}}}' ELSE {_address('package_id * 7')} END AS url FROM {{fx_packages}}
"""
VIEWS["fx_pom_properties"] = f"""
SELECT package_id, 'license.name' AS key, CASE WHEN package_id % 2 = 0 THEN '$' || '{{{{base.name}}}}' ELSE 'mit' END AS value
  FROM {{fx_packages}}
UNION ALL SELECT package_id, 'base.name' AS key, {_spelling('package_id * 7')} AS value FROM {{fx_packages}}
UNION ALL SELECT package_id, 'license.url' AS key, 'https://mit-license.org/' AS value FROM {{fx_packages}}
"""
_EXPRESSIONS = (
    "MIT", "MIT OR Apache-2.0", "(MIT OR Apache-2.0) AND ISC", "GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0+",
    "MIT AND (", "Apache License 2.0 or mit", "(MIT OR GPL-2.0-only) WITH X-exception",
    "(Zlib OR (BSD-3-Clause AND Custom  Terms)) WITH Y AND ISC", "OR-tools License OR BSL-1.0",
)
VIEWS["fx_expressions"] = (
    "SELECT package_id, CASE package_id % 10 "
    + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXPRESSIONS))
    + " END AS expression FROM {fx_packages}"
)
VIEWS["fx_readmes"] = f"""
SELECT doc_id, 'p' || doc_id AS name, text || '
' || {_ANNOUNCEMENT.replace('{key}', 'doc_id')} AS text FROM {{documents}}
"""
VIEWS["fx_messages"] = f"""
SELECT package_id, name, {_ANNOUNCEMENT.replace('{key}', 'package_id')} AS text FROM {{fx_packages}}
"""


# --- source files: every order is one file, every order line an import and its uses --------
VIEWS["fx_lines"] = """
SELECT o.o_custkey AS project_id, l.l_orderkey AS file_id, l.l_orderkey % 5 AS lang_no, l.n, l.l_partkey AS p,
  l.l_suppkey AS s, lower(replace(t.p_brand, '#', '')) AS b
FROM (SELECT l_orderkey, l_partkey, l_suppkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}) d) l
JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {part} t ON t.p_partkey = l.l_partkey
"""
_Q = "'\"'"
# (import statement, body) per language and line variant n % 3; p package, s supplier, b brand
_SOURCE_LINES = {
    0: (
        ("'\t' || Q || b || '/p' || p || '/sub' || Q", "'\tsub.Call' || s || '()'"),
        ("'\tx' || p || ' ' || Q || b || '/p' || p || Q", "'\tx' || p || '.Call' || s || '(' || p || ') // x.y'"),
        ("'\t_ ' || Q || b || '/p' || p || Q", "'\t// nothing.Here()'"),
    ),
    1: (
        ("'import p' || p", "'p' || p || '.fn' || s || '(1)'"),
        ("'from p' || p || '.mod import fn' || s || ' as g' || p", "'g' || p || '(2)  # g.h'"),
        ("'import p' || p || ' as q' || p", "'v = q' || p || '.attr' || s"),
    ),
    2: (
        ("'import x' || p || ' from ' || Q || '@' || b || '/p' || p || Q || ';'", "'x' || p || '.do' || s || '();'"),
        ("'const y' || p || ' = require(' || Q || '@' || b || '/p' || p || '/lib' || Q || ');'", "'y' || p || '(' || p || ');'"),
        ("'import ' || Q || '@' || b || '/p' || p || Q || ';'", "'// none'"),
    ),
    3: (
        (
            "'import ' || chr(123) || ' a' || p || ', b' || s || ' as c' || p || ' ' || chr(125) || ' from ' || Q || '@' || b || '/p' || p || Q || ';'",
            "'new a' || p || '(); c' || p || '();'",
        ),
        ("'import type ' || chr(123) || ' T' || p || ' ' || chr(125) || ' from ' || Q || '@' || b || '/p' || p || Q || ';'", "'let z' || p || ' = 1;'"),
        ("'export * from ' || Q || '@' || b || '/p' || p || Q || ';'", "'// re-export'"),
    ),
    4: (
        (
            "'import ' || b || '.p' || p || '.C' || s || ';'",
            "'C' || s || ' v' || n || ' = new C' || s || '(); c' || s || '.run' || p || '();'",
        ),
        ("'import static ' || b || '.p' || p || '.Util.help' || s || ';'", "'help' || s || '(' || p || ');'"),
        ("'import ' || b || '.p' || p || '.*;'", "'// star'"),
    ),
}


def _by_variant(part: int) -> str:
    langs = " ".join(
        f"WHEN {lang} THEN CASE n % 3 " + " ".join(f"WHEN {v} THEN {texts[part]}" for v, texts in enumerate(variants)) + " END"
        for lang, variants in _SOURCE_LINES.items()
    )
    return f"CASE lang_no {langs} END".replace(" Q ", f" {_Q} ").replace("'\t", "chr(9) || '").replace("|| Q", f"|| {_Q}")


_EXTENSION = "CASE lang_no WHEN 0 THEN 'go' WHEN 1 THEN 'py' WHEN 2 THEN 'js' WHEN 3 THEN 'ts' ELSE 'java' END"
_LANG = (
    "CASE lang_no WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'typescript' ELSE 'java' END"
)
_SOURCE_TEXT = """
SELECT project_id, 'src/f' || file_id || '.' || {extension} AS path, {lang} AS lang,
  CASE lang_no WHEN 0 THEN 'package main' || chr(10) || 'import (' || chr(10) || head || chr(10) || ')' || chr(10)
      || 'func main() ' || chr(123) || chr(10) || body || chr(10) || chr(125)
    WHEN 4 THEN 'package demo;' || chr(10) || head || chr(10) || 'class Main ' || chr(123) || ' void go() ' || chr(123) || chr(10)
      || body || chr(10) || chr(125) || chr(125)
    ELSE head || chr(10) || body END || chr(10) AS text
FROM (SELECT project_id, file_id, lang_no, {agg_head} AS head, {agg_body} AS body FROM (
    SELECT project_id, file_id, lang_no, n, {head} AS h, {body} AS c FROM {{fx_lines}}) x
  GROUP BY 1, 2, 3) y
"""


def _source_view(aggregate: str) -> str:
    return _SOURCE_TEXT.format(
        extension=_EXTENSION, lang=_LANG, head=_by_variant(0), body=_by_variant(1),
        agg_head=aggregate.replace("X", "h"), agg_body=aggregate.replace("X", "c"),
    )


VIEWS["fx_sources"] = (
    _source_view("listagg(X, chr(10)) WITHIN GROUP (ORDER BY n)"),
    _source_view("string_agg(X, chr(10) ORDER BY n)"),
)
VIEWS["fx_wheel_files"] = """
SELECT p_partkey AS package_id, CASE p_partkey % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'record' ELSE 'top_level' END AS kind,
  CASE p_partkey % 3 WHEN 0 THEN 'p' || p_partkey || '/__init__.py' WHEN 1 THEN 'p' || p_partkey || '/__init__.py,sha256=x,10'
    ELSE 'p' || p_partkey END AS line FROM {part}
UNION ALL SELECT p_partkey AS package_id, 'record' AS kind, 'p' || p_partkey || '.dist-info/METADATA,,' AS line FROM {part}
UNION ALL SELECT p_partkey AS package_id, 'file' AS kind, '_hidden/__init__.py' AS line FROM {part}
"""


# --- input lists, repository addresses and pages --------------------------------------------
VIEWS["fx_inputs"] = """
SELECT file_id, line_no, CASE WHEN file_id = 6 AND k % 13 NOT IN (9, 10) THEN 'require example v' || p ELSE
  CASE k % 13 WHEN 0 THEN purl WHEN 1 THEN '  ' || purl || '  '
    WHEN 2 THEN 'pkg:npm/@Scope/P' || (p % 100) || '@1.' || (p % 10) || '.0'
    WHEN 3 THEN 'pkg:maven/org.acme:lib' || (p % 50) || '@1.0'
    WHEN 4 THEN 'pkg:maven/org.acme%3Alib' || (p % 50) || '@2.0'
    WHEN 5 THEN 'https://github.com/Owner' || (p % 50) || '/Repo' || p || '.git'
    WHEN 6 THEN 'owner' || (p % 50) || '/repo' || p
    WHEN 7 THEN 'github.com/owner' || (p % 50) || '/repo' || p || '/tree/main'
    WHEN 8 THEN 'https://gitlab.com/group/repo' || p
    WHEN 9 THEN '' WHEN 10 THEN '# comment ' || p WHEN 11 THEN 'pkg:hex/phoenix' || p || '@1.0'
    ELSE purl || '?arch=x86#sub/path' END END AS line
FROM (SELECT p.package_id AS p, p.package_id % 7 AS file_id, CAST((p.package_id - p.package_id % 7) / 7 AS BIGINT) + 1 AS line_no,
    CAST((p.package_id - p.package_id % 7) / 7 AS BIGINT) AS k, p.purl FROM {fx_packages} p) x
"""
VIEWS["fx_repo_urls"] = """
SELECT p.package_id, CASE p.package_id % 9 WHEN 0 THEN r.repo_url WHEN 1 THEN r.repo_url || '.git'
  WHEN 2 THEN 'git+' || r.repo_url || '.git#main' WHEN 3 THEN replace(r.repo_url, 'https://github.com/', 'git@github.com:') || '.git'
  WHEN 4 THEN replace(r.repo_url, 'https://', 'git://') || '/' WHEN 5 THEN replace(r.repo_url, 'https://github.com/', 'github:')
  WHEN 6 THEN replace(r.repo_url, 'https://github.com/', 'git+ssh://git@github.com:')
  WHEN 7 THEN replace(r.repo_url, 'owner', 'Owner') || '/tree/main?tab=x'
  ELSE 'https://gitbox.apache.org/repos/asf/proj' || p.repo_id || '.git' END AS repo_url
FROM {fx_packages} p JOIN {fx_repos} r ON r.repo_id = p.repo_id
"""
VIEWS["fx_repo_candidates"] = """
SELECT package_id, 'link' AS kind, CASE WHEN package_id % 4 = 0 THEN 'SOURCE_REPO' ELSE 'HOMEPAGE' END AS label, 0 AS position,
  CASE package_id % 3 WHEN 0 THEN 'https://git.example.org/x' || package_id || '.git'
    WHEN 1 THEN 'https://github.com/link/r' || package_id || '/' ELSE 'https://docs.example.org/' || package_id END AS raw
  FROM {fx_packages}
UNION ALL SELECT package_id, 'related' AS kind, '' AS label, 0 AS position,
  CASE WHEN package_id % 5 = 0 THEN 'https://github.com/related/r' || package_id ELSE '' END AS raw FROM {fx_packages}
UNION ALL SELECT package_id, CASE WHEN ecosystem = 'pypi' THEN 'pypi' ELSE 'registry' END AS kind, 'Source' AS label, 1 AS position,
  'git+https://github.com/reg/r' || package_id || '.git#v1' AS raw FROM {fx_packages} WHERE ecosystem <> 'gem'
UNION ALL SELECT package_id, 'pypi' AS kind, 'Repository' AS label, 2 AS position,
  'https://github.com/pypi/r' || package_id AS raw FROM {fx_packages} WHERE ecosystem = 'pypi'
"""
VIEWS["fx_repo_names"] = """
SELECT repo_id AS repo_key, 'Owner' || (repo_id % 50) AS owner, 'Repo' || repo_id AS repo FROM {fx_repos}
"""
VIEWS["fx_manifest_managers"] = """
SELECT repo_id AS repo_key, CASE repo_id % 10 WHEN 0 THEN 'NPM' WHEN 1 THEN 'pip' WHEN 2 THEN 'Maven' WHEN 3 THEN 'RUST'
  WHEN 4 THEN 'GO' WHEN 5 THEN 'composer' WHEN 6 THEN 'SBT' ELSE NULL END AS manager FROM {fx_repos}
UNION ALL SELECT repo_id AS repo_key, CASE WHEN repo_id % 4 = 0 THEN 'GO' ELSE 'unknown' END AS manager FROM {fx_repos}
"""
VIEWS["fx_languages"] = """
SELECT repo_id AS repo_key, language, (repo_id * 97) % 1000 AS bytes FROM {fx_repos} WHERE language IS NOT NULL
UNION ALL SELECT repo_id AS repo_key, 'PHP' AS language, (repo_id * 31) % 1000 AS bytes FROM {fx_repos}
UNION ALL SELECT repo_id AS repo_key, 'Haskell' AS language, (repo_id * 13) % 1000 AS bytes FROM {fx_repos}
"""
VIEWS["fx_roundtrip"] = """
SELECT p.package_id, r.repo_url AS input_url, CASE p.package_id % 5 WHEN 0 THEN replace(r.repo_url, 'owner', 'OWNER') || '.git'
  WHEN 1 THEN '' WHEN 2 THEN 'https://gitlab.com/a/b' WHEN 3 THEN r.repo_url || 'x'
  ELSE replace(r.repo_url, 'https://github.com/', 'git@github.com:') END AS resolved_url
FROM {fx_packages} p JOIN {fx_repos} r ON r.repo_id = p.repo_id
"""
_HEAD = "'</head>'"
_TAGS = (
    "CASE page_id % 3 WHEN 0 THEN '<meta name=\"go-import\" content=\"go.v.org git https://github.com/owner' || page_id "
    "|| '/root\"><meta content=\"go.v.org/x' || page_id || ' git https://github.com/owner' || page_id "
    "|| '/deep.git\" name=\"go-import\">' "
    "WHEN 1 THEN '<meta name=\"go-import\" content=\"go.v.org hg https://hg.example.org/r\">' "
    "|| '<meta name=\"go-source\" content=\"go.v.org _ https://github.com/src' || page_id || '/tool/tree/master f\">' ELSE '' END"
)
VIEWS["fx_html"] = f"SELECT page_id, replace(html, {_HEAD}, {_TAGS} || {_HEAD}) AS html FROM {{pages}}"
VIEWS["fx_vanity"] = """
SELECT p.package_id, 'Go.v.org/x' || g.page_id || '/sub' AS import_path, g.page_id
FROM (SELECT package_id, package_id % n AS page_id FROM {fx_packages}, (SELECT count(*) AS n FROM {pages}) c) p
JOIN {pages} g ON g.page_id = p.page_id
"""


VIEWS["fx_topics"] = """
SELECT c_custkey AS key, '  ' || lower(c_mktsegment) || '  ' || lower(c_mktsegment) || ' t' || (c_custkey % 7) || ' ' AS text
FROM {customer}
"""
VIEWS["fx_evidence"] = """
SELECT l_partkey AS package_id, l_orderkey * 10 + l_linenumber AS position,
  CASE WHEN l_returnflag = 'A' AND l_quantity > 45 THEN 'HumanCatalog' ELSE 'npmjs' END AS source,
  min('evidence ' || l_orderkey || '/' || l_linenumber || '/' || l_suppkey) AS summary, max(l_discount) AS confidence
FROM {lineitem} GROUP BY 1, 2, 3
"""


# --- documents of a project: bill of materials, module file, workflows --------------------------
_AGGREGATES = ("listagg(X, ',') WITHIN GROUP (ORDER BY K)", "string_agg(X, ',' ORDER BY K)")
_LINE_AGGREGATES = ("listagg(X, chr(10)) WITHIN GROUP (ORDER BY K)", "string_agg(X, chr(10) ORDER BY K)")


def _aggregated(template: str, aggregates: tuple[str, str]) -> tuple[str, str]:
    """Spark and DuckDB spellings of a text with AGG(expression ;; order)AGG."""
    spell = lambda how: re.sub(
        r"AGG\((.*?) ;; (.*?)\)AGG", lambda m: how.replace("X", m[1], 1).replace("K", m[2], 1), template, flags=re.S
    )
    return spell(aggregates[0]), spell(aggregates[1])


VIEWS["fx_sbom_nodes"] = """
SELECT n.project_id, n.node, p.purl FROM (
  SELECT project_id, src AS node FROM {fx_edges} UNION SELECT project_id, dst AS node FROM {fx_edges}
  UNION SELECT project_id, package_id AS node FROM {fx_direct}) n JOIN {fx_packages} p ON p.package_id = n.node
"""
# roots: 0 and 2 name their direct dependencies, 1 goes through a node without package, 3 has no entry
VIEWS["fx_sbom"] = _aggregated(
    """
SELECT c.project_id, '{{"bomFormat":"CycloneDX","specVersion":"1.5","metadata":{{"component":{{"type":"application",'
  || '"bom-ref":"root","name":"app"}}}},"components":[{{"type":"file","bom-ref":"mod"}},{{"type":"group","bom-ref":"group",'
  || '"components":[' || coalesce(c.nested, '') || ']}}' || coalesce(',' || c.flat, '') || '],"dependencies":['
  || CASE c.project_id % 4 WHEN 3 THEN '' WHEN 1 THEN '{{"ref":"root","dependsOn":["mod"]}},{{"ref":"mod","dependsOn":[' || d.refs
    || ']}},' ELSE '{{"ref":"root","dependsOn":[' || d.refs || ']}},' END || '{{"ref":"lost","dependsOn":["nowhere"]}}'
  || ',' || c.entries || ']}}' AS text
FROM (SELECT i.project_id, AGG(CASE WHEN node % 5 <> 0 THEN item END ;; node)AGG AS flat,
    AGG(CASE WHEN node % 5 = 0 THEN item END ;; node)AGG AS nested,
    AGG('{{"ref":"r' || node || '","dependsOn":[' || coalesce(x.children, '') || ']}}' ;; node)AGG AS entries
  FROM (SELECT project_id, node, '{{"type":"library","bom-ref":"r' || node || '","name":"p' || node || '","purl":"' || purl
    || '?arch=x"}}' AS item FROM {fx_sbom_nodes}) i
  LEFT JOIN (SELECT project_id, src, AGG('"r' || dst || '"' ;; dst)AGG AS children FROM {fx_edges} GROUP BY 1, 2) x
    ON x.project_id = i.project_id AND x.src = i.node GROUP BY i.project_id) c
JOIN (SELECT project_id, AGG('"r' || package_id || '"' ;; package_id)AGG AS refs FROM {fx_direct} GROUP BY 1) d
  ON d.project_id = c.project_id
""",
    _AGGREGATES,
)
VIEWS["fx_modules"] = """
SELECT d.project_id, d.package_id, CASE WHEN p.ecosystem = 'golang' THEN p.namespace || '/' || p.name ELSE 'example.com/m' || d.package_id END AS module
FROM {fx_direct} d JOIN {fx_packages} p ON p.package_id = d.package_id
"""
VIEWS["fx_gomod"] = _aggregated(
    """
SELECT project_id, 'module example.com/app' || project_id || chr(10) || 'go 1.24' || chr(10) || 'require (' || chr(10)
  || AGG(chr(9) || module || ' v1.' || (package_id % 10) || '.0'
    || CASE WHEN package_id % 4 = 1 THEN ' // indirect' ELSE '' END ;; package_id)AGG || chr(10) || ')' || chr(10)
  || 'require example.com/single v0.1.0' || chr(10) || 'replace (' || chr(10)
  || AGG(CASE WHEN package_id % 9 = 0 THEN chr(9) || module || ' => example.com/fork' || package_id || ' v2.0.0'
    WHEN package_id % 11 = 0 THEN chr(9) || module || ' v1.0.0 => ../local' || package_id
    ELSE '// none' END ;; package_id)AGG || chr(10) || ')' || chr(10)
  || AGG(CASE WHEN package_id % 13 = 0 THEN 'tool ' || module || '/cmd/run' ELSE '// no tool' END ;; package_id)AGG
  || chr(10) AS text
FROM {fx_modules} GROUP BY project_id
""",
    _LINE_AGGREGATES,
)
_ACTION = "'owner' || (P % 40) || '/repo' || (P % 40) || '/act' || P || CASE WHEN P % 6 = 0 THEN '/sub' ELSE '' END"
VIEWS["fx_workflows"] = _aggregated(
    """
SELECT project_id AS scope, '.github/workflows/ci.yml' AS path, 'on: push' || chr(10) || 'jobs:' || chr(10) || '  build:' || chr(10)
  || '    steps:' || chr(10) || '      - uses: docker://alpine:3' || chr(10) || '      - uses: ./.github/actions/first' || chr(10)
  || '      - uses: ./../outside' || chr(10)
  || AGG('      - uses: ' || ACTION(package_id) || '@v' || (package_id % 5) ;; package_id)AGG || chr(10) AS text
FROM {fx_direct} GROUP BY project_id
UNION ALL
SELECT project_id AS scope, ACTION(src) || '/action.yml' AS path, 'name: x' || chr(10) || 'runs:' || chr(10) || '  using: '
  || CASE WHEN src % 10 = 3 THEN 'node20' ELSE 'composite' END || chr(10) || '  steps:' || chr(10)
  || AGG('    - uses: "' || ACTION(dst) || '@main"' ;; dst)AGG || chr(10) AS text
FROM {fx_edges} GROUP BY project_id, src
UNION ALL
SELECT project_id AS scope, '.github/actions/first/action.yml' AS path, 'runs:' || chr(10) || '  using: composite' || chr(10)
  || '  steps:' || chr(10) || '    - uses: ./.github/actions/x/../second/' || chr(10) || '    - uses: local/one@v1' || chr(10) AS text
FROM {fx_direct} GROUP BY project_id
UNION ALL
SELECT project_id AS scope, '.github/actions/second/action.yml' AS path, 'runs:' || chr(10) || "  using: 'composite'" || chr(10)
  || '  steps:' || chr(10) || '    - uses: ./.github/actions/first' || chr(10) || '    - uses: local/one@v2' || chr(10)
  || '    - uses: local/two/sub@v2' || chr(10) AS text
FROM {fx_direct} GROUP BY project_id
""".replace("\"  using: 'composite'\"", "'  using: ' || chr(39) || 'composite' || chr(39)"),
    _LINE_AGGREGATES,
)
VIEWS["fx_workflows"] = tuple(
    re.sub(r"ACTION\((\w+)\)", lambda m: _ACTION.replace("P", m[1]), text) for text in VIEWS["fx_workflows"]
)
VIEWS["fx_files"] = """
SELECT 'repo' || project_id || '/go.mod' AS path, text FROM {fx_gomod}
UNION ALL SELECT 'repo' || project_id || '/renamed-' || project_id || '.txt' AS path, '// copy' || chr(10) || chr(10) || text AS text
  FROM {fx_gomod}
UNION ALL SELECT 'repo' || project_id || '/bom.json' AS path, text FROM {fx_sbom}
UNION ALL SELECT 'repo' || scope || '/' || path AS path, text FROM {fx_workflows}
UNION ALL SELECT 'docs/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.json' ELSE '.txt' END AS path, text FROM {documents}
"""


def spark_text(name: str) -> str:
    view = VIEWS[name]
    return view[0] if isinstance(view, tuple) else view


def duckdb_text(name: str) -> str:
    """Text of a view with plain table names; doubled braces are literal ones, as for Spark."""
    view = VIEWS[name]
    text = view[1] if isinstance(view, tuple) else view
    named = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text)
    return named.replace("{{", "{").replace("}}", "}").strip()


#: Views whose groups all lie inside one value of a column of an input. For Spark that input is dealt by the column first:
#: grouping needs no further exchange then, nor does writing a snapshot that is bucketed by this column.
DEALT = {
    "fx_versions": ("lineitem", "l_partkey"),
    "fx_advisories": ("lineitem", "l_partkey"),
    "fx_package_graphs": ("fx_graph_pairs", "package_id"),
    "fx_edges": ("fx_order_edges", "project_id"),
    "fx_direct": ("fx_order_firsts", "project_id"),
    "fx_order_edges": ("lineitem", "l_orderkey"),
    "fx_order_firsts": ("lineitem", "l_orderkey"),
    "fx_lines": ("lineitem", "l_orderkey"),
    "fx_sources": ("fx_lines", "file_id"),
    "fx_sbom": ("fx_sbom_nodes", "project_id"),
}
SNAPSHOTS = tuple(name for name in VIEWS if name.removeprefix("fx_") in facts.SCHEMAS)


def _inputs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


class Fixtures:
    """Tables and views of one scale-factor folder.

    Views that stand for fact tables are written once per session, as snapshots in the shared checkpoint
    folder, and read back from there: jobs then see plain tables, as they would in use.
    """

    _folders: dict[tuple[str, str], str] = {}
    _buckets: dict[tuple[str, str], int] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._built: dict[str, DataFrame] = {}
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in self._folders:
            self._folders[key] = f"{ensure_checkpoint_dir(spark)}/facts-{uuid.uuid4().hex}"
            self._saved[key] = set()
            self._buckets[key] = facts.default_buckets(spark)
        self.folder, self.buckets = self._folders[key], self._buckets[key]
        self.saved = self._saved[key]

    _saved: dict[tuple[str, str], set[str]] = {}

    def _view(self, name: str, snapshots: bool = True) -> DataFrame:
        """A view over tables and snapshots, or over tables only, so that what no reader asks for is not worked out."""
        sql = spark_text(name)
        inputs = {dep: self[dep] if snapshots or dep in TABLES else self._view(dep, snapshots) for dep in _inputs(sql)}
        if name in DEALT:
            dep, key = DEALT[name]
            inputs[dep] = inputs[dep].repartition(self.buckets, key)
        return self.spark.sql(sql, **inputs)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            table = name.removeprefix("fx_")
            if name == "fx_reach":
                return self._reach()
            if name == "fx_package_names":
                packages = self["fx_packages"] if "fx_packages" in self.saved else self._view("fx_packages", snapshots=False)
                return packages.select("package_id", "ecosystem", "namespace", "name")
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                df = spread(df) if name in ("documents", "pages") else df
            elif table in facts.SCHEMAS:
                if name not in self.saved:
                    facts.save_table(self._view(name), self.folder, table, self.buckets, dealt=name in DEALT)
                    self.saved.add(name)
                df = facts.load_table(self.spark, self.folder, table, self.buckets)
            else:
                df = self._view(name)
            self._built[name] = df
        return self._built[name]

    def _reach(self) -> DataFrame:
        """Reachable pairs, computed once per session; several jobs start from them."""
        if "fx_reach" not in self.saved:
            found = graph.reachability(self["fx_edges"], self["fx_direct"])
            facts.save_table(found, self.folder, "reach", self.buckets)
            self.saved.add("fx_reach")
        self._built["fx_reach"] = facts.load_table(self.spark, self.folder, "reach", self.buckets)
        return self._built["fx_reach"]


def duckdb_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the views it names, as common table expressions."""
    known = {**{name: duckdb_text(name) for name in VIEWS}, **(extra or {})}
    ordered: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\w+", text):
            if name in known and name not in seen:
                seen.add(name)
                visit(known[name])
                ordered.append(name)

    visit(sql)
    parts = [f"{name} AS (\n{known[name].strip()}\n)" for name in ordered]
    recursive = "RECURSIVE " if parts else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
