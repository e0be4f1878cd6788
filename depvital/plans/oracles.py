"""Equivalent DuckDB SQL of the registered queries.

Written independently of the Spark jobs; only the input views are shared. ``PARTS`` are helper tables
that several statements use.
"""

from __future__ import annotations

from depvital.functions.phrases import (
    AMBIGUOUS_PHRASES,
    CHANGELOG_HEADING,
    CONTEXTUAL_PATTERNS,
    EXPLICIT_LABEL,
    PHRASE_TIERS,
    PLATFORM_VERSION,
    README_EXPLICIT,
    SENTENCE_NEGATIVES,
    STRONG_PHRASES,
)
from depvital.functions.spdx import CORE_IDS, CUSTOM_ALIASES, URL_LICENSES
from depvital.operators.eol_text import PROFILES
from depvital.plans.fixtures import AS_OF, duckdb_ctes

_TS = f"TIMESTAMP '{AS_OF}'"


def _age(ts: str) -> str:
    """Whole 24-hour blocks before the evaluation time."""
    return f"CAST(trunc((epoch_us({_TS}) - epoch_us({ts})) / 86400000000.0) AS INTEGER)"


_KEY = r"""CASE WHEN regexp_matches(purl, '^pkg:/*[A-Za-z]') THEN 'pkg:' || lower(regexp_extract(purl, '^pkg:/*([A-Za-z][A-Za-z0-9.+-]*)/', 1)) || '/'
    || lower(replace(replace(regexp_replace(regexp_extract(regexp_replace(purl, '[?#].*$', ''), '^pkg:/*[A-Za-z][A-Za-z0-9.+-]*/(.+)$', 1),
      '([^/])@[^@]*$', '\1'), '%40', '@'), '%3A', ':')) END"""
_RESULTS = """coalesce(b.verdict, 'review') AS verdict, b.label AS lifecycle_label, b.reason AS lifecycle_reason, b.build_label,
  coalesce(b.adv, 0) AS advisory_count, coalesce(b.transitive_count, 0) AS transitive_count, b.max_cvss3,
  CASE WHEN b.canonical_key IS NULL THEN 'package not found' ELSE b.error END AS error"""


def _dictionary() -> str:
    ids = ", ".join(f"('{i}')" for i in CORE_IDS)
    custom = ", ".join(f"('{k}', '{v}')" for k, v in CUSTOM_ALIASES.items())
    key = r"trim(upper(regexp_replace({x}, '[-_./+ \t\n\r]+', ' ', 'g')))"
    return f"""
SELECT key, min(rank) AS rank, arg_min(id, rank * 1000 + pos) AS id FROM (
  SELECT key, id, rank, row_number() OVER (ORDER BY rank, id) AS pos FROM (
    SELECT upper(id) AS key, id, 0 AS rank FROM (VALUES {ids}) a(id)
    UNION ALL SELECT {key.format(x='k')}, id, 1 FROM (VALUES {custom}) c(k, id)
    UNION ALL SELECT {key.format(x='id')}, id, 2 FROM (VALUES {ids}) a(id)
    UNION ALL SELECT {key.format(x="replace(id, '-', '')")}, id, 2 FROM (VALUES {ids}) a(id)) e) f GROUP BY key
"""


def _normalized(source: str, raw: str = "raw") -> str:
    """Rows of a table with license_id, is_spdx and match_type of a raw spelling."""
    return rf"""
SELECT n.*, CASE WHEN t = '' THEN NULL WHEN upper(t) IN ('NOASSERTION', 'NONE') THEN upper(t)
    ELSE coalesce(d0.id, d1.id, regexp_replace(t, '\s+', '-', 'g')) END AS license_id,
  t <> '' AND upper(t) NOT IN ('NOASSERTION', 'NONE') AND coalesce(d0.id, d1.id) IS NOT NULL AS is_spdx,
  CASE WHEN t = '' THEN 'none' WHEN upper(t) IN ('NOASSERTION', 'NONE') THEN 'no-assertion' WHEN d0.id = t THEN 'exact'
    WHEN d0.id IS NOT NULL THEN 'case-fold' WHEN d1.id IS NOT NULL THEN 'alias' ELSE 'heuristic' END AS match_type
FROM (SELECT *, trim(coalesce({raw}, '')) AS t FROM {source}) n
LEFT JOIN o_dict d0 ON d0.rank = 0 AND d0.key = upper(n.t)
LEFT JOIN o_dict d1 ON d1.key = trim(upper(regexp_replace(n.t, '[-_./+ \t\n\r]+', ' ', 'g')))
"""


def _url_id(url: str) -> str:
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in URL_LICENSES.items()) + "}"
    full = f"CASE WHEN contains({url}, '://') THEN trim({url}) ELSE 'https://' || trim({url}) END"
    host = f"regexp_replace(lower(regexp_extract({full}, '^[A-Za-z+.-]+://([^/?#:]*)', 1)), '^www\\.', '')"
    path = f"regexp_replace(lower(regexp_extract({full}, '^[A-Za-z+.-]+://[^/?#]*([^?#]*)', 1)), '/$', '')"
    path = f"regexp_replace({path}, '\\.(txt|html|htm)$', '')"
    return f"element_at({table}, {host} || {path})[1]"


def _eol(source: str, key: str, profile: str) -> str:
    """End-of-life announcements of a table with text and name, by sentence rows and first hits."""
    rules = PROFILES[profile]

    def any_of(text: str, words: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"

    def token(text: str) -> str:
        return f"({any_of(text, rules.tokens)} OR (nm <> '' AND contains({text}, nm)))"

    strong = " ".join(
        f"WHEN contains(ls, '{p}')" + (f" AND {token('ls')}" if p in AMBIGUOUS_PHRASES else "") + f" THEN '{p}'"
        for p in STRONG_PHRASES
    )
    contextual = " ".join(f"WHEN regexp_matches(ls, '{p}') THEN {i}" for i, (_, p, _) in enumerate(CONTEXTUAL_PATTERNS))
    sentence_date = " ".join(
        f"WHEN {i} THEN nullif(trim(regexp_extract(s, '{p}', {g})), '')" for i, (_, p, g) in enumerate(CONTEXTUAL_PATTERNS) if g
    )
    text_date = ", ".join(f"nullif(trim(regexp_extract(doc, '{p}', {g})), '')" for _, p, g in CONTEXTUAL_PATTERNS if g)
    successor = ", ".join(
        f"nullif(trim(regexp_extract(win, '{p}', {g}), '.,;:()[]{{}} '), '')" for p, g in rules.successors
    )
    component = "deprecated (argument|parameter|function|method|class|module)"
    lead = r"(?i)^(?:deprecated\s+(?:argument|parameter|function|method|class|module)\b[^.!?\n]*[.!?\n]\s*)+"
    start = r"(?i)^deprecated\s+(argument|parameter|function|method|class|module)\b"
    anywhere = "NULL"
    prelude = "doc"
    if rules.trims_changelog:
        anywhere = (
            f"CASE WHEN NOT regexp_matches(low, '{component}') OR ({any_of('low', ('this project', 'this package'))} "
            f"AND NOT regexp_matches(doc, '{start}')) THEN nullif(regexp_extract(doc, '{rules.explicit}'), '') END"
        )
        heading = CHANGELOG_HEADING
        found = f"strpos(doc, regexp_extract(doc, '{heading}'))"
        prelude = (
            f"CASE WHEN regexp_matches(doc, '{heading}') AND {found} > 200 THEN trim(left(doc, {found} - 1), ' \t\n\r') "
            "ELSE doc END"
        )
    own = "lower(name)" if rules.drops_self else "''"
    sql = f"""
SELECT {key}, CASE WHEN kept THEN kind END AS eol_kind, CASE WHEN kept THEN phrase END AS eol_phrase,
  CASE WHEN kept AND (lower(succ) <> {own} OR {own} = '') THEN succ END AS eol_successor,
  CASE WHEN kept THEN coalesce(hit_date, {text_date}) END AS eol_date
FROM (SELECT *, coalesce({successor}) AS succ, kind IS NOT NULL AND NOT {any_of('sent', SENTENCE_NEGATIVES)}
    AND NOT (kind = 'explicit' AND amb AND NOT {token('sent')})
    AND NOT (kind IN ('explicit', 'strong') AND amb AND regexp_matches(sent, '{PLATFORM_VERSION}') AND NOT {token('sent')})
    AS kept
FROM (SELECT *, lower(phrase) IN ({', '.join(f"'{p}'" for p in AMBIGUOUS_PHRASES)}) AS amb,
    CASE WHEN strpos(low, lower(phrase)) = 0 THEN '' ELSE array_to_string(
      string_split(substr(doc, strpos(low, lower(phrase)), 400), chr(10))[1:4], chr(10)) END AS win,
    CASE WHEN strpos(low, lower(phrase)) = 0 THEN '' ELSE trim(
      regexp_extract(substr(low, 1, strpos(low, lower(phrase)) - 1), '[^.!?\n]*$') || lower(phrase)
      || regexp_extract(substr(low, strpos(low, lower(phrase)) + length(phrase)), '^[^.!?\n]*'), ' \t\r') END AS sent
FROM (SELECT d.*, CASE WHEN neg THEN NULL WHEN first_explicit IS NOT NULL THEN 'explicit'
      WHEN dead THEN NULL WHEN body_explicit IS NOT NULL THEN 'explicit' ELSE h.kind END AS kind,
    CASE WHEN neg THEN NULL WHEN first_explicit IS NOT NULL THEN first_explicit WHEN dead THEN NULL
      WHEN body_explicit IS NOT NULL THEN body_explicit ELSE h.phrase END AS phrase,
    CASE WHEN neg OR first_explicit IS NOT NULL OR dead OR body_explicit IS NOT NULL THEN NULL ELSE h.hit_date END AS hit_date
FROM (SELECT *, body = '' OR regexp_matches(body, '{start}') AS dead,
    CASE WHEN NOT regexp_matches(lower(body), '{component}') OR {any_of('lower(body)', ('this project', 'this package'))}
      THEN nullif(regexp_extract(body, '{rules.explicit}'), '') END AS body_explicit
  FROM (SELECT *, {any_of('low', rules.negatives)} AS neg, {anywhere} AS first_explicit,
      regexp_replace({prelude}, '{lead}', '') AS body
    FROM (SELECT {key}, name, lower(name) AS nm, trim(text, E' \t\n\r') AS doc, lower(trim(text, E' \t\n\r')) AS low
      FROM {source}) a) b) d
LEFT JOIN (SELECT {key}, arg_min(kind, i) AS kind, arg_min(phrase, i) AS phrase,
    first(hit_date ORDER BY i) AS hit_date FROM (
  SELECT {key}, i, CASE WHEN strong IS NOT NULL THEN 'strong' ELSE 'contextual' END AS kind,
    coalesce(strong, 'end of life') AS phrase, CASE WHEN strong IS NULL THEN CASE ctx {sentence_date} END END AS hit_date
  FROM (SELECT *, CASE {strong} END AS strong, CASE {contextual} END AS ctx FROM (
    SELECT *, lower(s) AS ls FROM (
      SELECT {key}, nm, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
        SELECT {key}, lower(name) AS nm, regexp_split_to_array(regexp_replace({prelude}, '{lead}', ''), '[.!?\n]') AS l
        FROM (SELECT *, trim(text, E' \t\n\r') AS doc FROM {source}) z) y) x) w
    WHERE NOT {any_of('ls', SENTENCE_NEGATIVES)}) v
  WHERE strong IS NOT NULL OR ctx IS NOT NULL) u GROUP BY {key}) h USING ({key})) k) m) o
"""
    return sql


def _plan_parts(suffix: str, coupling: str) -> dict[str, str]:
    """Entries and ranked plan over one coupling table."""
    return {
        "o_entries" + suffix: f"""
SELECT g.project_id, g.direct_id AS package_id, p.purl, p.ecosystem, g.exclusive_transitive, g.total_transitive,
  g.via_count, max(g.exclusive_transitive) OVER (PARTITION BY g.project_id) AS max_excl,
  coalesce(c.import_files, 0) AS files, coalesce(c.call_sites, 0) AS calls,
  coalesce(c.api_breadth, CASE WHEN p.name = 'postgresql' THEN 1 ELSE 0 END) AS api, coalesce(c.has_blank_import, FALSE) AS blank,
  CASE WHEN p.name = 'postgresql' THEN 'runtime' END AS scope,
  c.package_id IS NULL AND g.project_id IN (SELECT project_id FROM {coupling}) AND p.name <> 'postgresql' AS is_unused,
  coalesce(h.health_risk, 0.5) AS health_risk, h.is_eol, h.health_status, p.name, p.version, h.adv, h.max_cvss3, h.overall_score
FROM o_gmetrics g JOIN fx_packages p ON p.package_id = g.direct_id
LEFT JOIN {coupling} c ON c.project_id = g.project_id AND c.package_id = g.direct_id
LEFT JOIN o_health h ON h.package_id = g.direct_id
""",
        "o_plan" + suffix: f"""
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, purl) AS rank,
  CASE WHEN effort < 1e-9 THEN 'trivial' WHEN effort < 0.25 THEN 'easy' WHEN effort < 0.6 THEN 'moderate' ELSE 'hard' END
    AS difficulty
FROM (SELECT *, CASE WHEN is_eol OR health_status = 'Archived' THEN greatest(p0, 0.1::DOUBLE) ELSE p0 END AS priority FROM (
  SELECT *, CASE WHEN is_unused THEN greatest(impact * health_risk * greatest(1 - effort, 0.05::DOUBLE),
      0.3::DOUBLE * impact + 0.3::DOUBLE * health_risk + 0.2::DOUBLE)
    ELSE impact * health_risk * greatest(1 - effort, 0.05::DOUBLE) END AS p0 FROM (
    SELECT *, CASE WHEN max_excl = 0 THEN 0.1::DOUBLE
        ELSE least(0.1::DOUBLE + 0.9::DOUBLE * (exclusive_transitive / max_excl), 1.0::DOUBLE) END AS impact,
      CASE WHEN is_unused OR (blank AND calls <= 1 AND api = 0) OR (files = 0 AND calls = 0 AND api = 0) THEN 0.0::DOUBLE
        ELSE 0.4::DOUBLE * (1 / (1 + exp(-0.8::DOUBLE * (files - 5)))) + 0.4::DOUBLE * (1 / (1 + exp(-0.2::DOUBLE * (calls - 20))))
          + 0.2::DOUBLE * (1 / (1 + exp(-0.4::DOUBLE * (api - 10)))) END AS effort
    FROM o_entries{suffix}) e1) e2) e3
""",
    }


def _coupling_parts(suffix: str, matched: str) -> dict[str, str]:
    """Coupling figures over one table of matched imports."""
    return {
        "o_pkg_alias" + suffix: f"""
SELECT project_id, package_id, path, alias, bool_or(kind = 'normal') AS normal, bool_or(kind = 'blank') AS blank,
  bool_or(kind = 'dot') AS dot, bool_or(kind = 'wildcard') AS wild FROM {matched} GROUP BY ALL
""",
        "o_pkg_uses" + suffix: f"""
SELECT a.project_id, a.package_id, a.path, u.symbol, u.calls FROM o_pkg_alias{suffix} a
JOIN o_alias_uses u ON u.project_id = a.project_id AND u.path = a.path AND u.alias = a.alias WHERE a.normal
""",
        "o_coupling" + suffix: f"""
SELECT f.project_id, f.package_id, f.import_files,
  CASE WHEN blank OR dot THEN greatest(coalesce(u.calls, 0), 1) ELSE coalesce(u.calls, 0) END AS call_sites,
  coalesce(u.breadth, 0) AS api_breadth, blank AS has_blank_import, dot AS has_dot_import, wild AS has_wildcard_import
FROM (SELECT project_id, package_id, count(DISTINCT path) AS import_files, bool_or(blank) AS blank, bool_or(dot) AS dot,
    bool_or(wild) AS wild FROM o_pkg_alias{suffix} GROUP BY 1, 2) f
LEFT JOIN (SELECT project_id, package_id, sum(calls) AS calls, count(DISTINCT symbol) AS breadth FROM o_pkg_uses{suffix}
  GROUP BY 1, 2) u ON u.project_id = f.project_id AND u.package_id = f.package_id
""",
    }


PARTS: dict[str, str] = {
    "o_versions": r"""
SELECT *, NOT regexp_matches(lower(version), 'alpha|beta|rc|dev|snapshot|pre') AS looks_stable,
  CAST(split_part(split_part(version, '-', 1), '.', 1) AS INTEGER) AS v1,
  CAST(split_part(split_part(version, '-', 1), '.', 2) AS INTEGER) AS v2,
  CAST(split_part(split_part(version, '-', 1), '.', 3) AS INTEGER) AS v3,
  CASE WHEN contains(version, '-rc.') THEN 0 ELSE 1 END AS v4,
  CASE WHEN contains(version, '-rc.') THEN CAST(split_part(version, '-rc.', 2) AS INTEGER) ELSE 0 END AS v5
FROM fx_versions
""",
    "o_slots": """
SELECT s.*, r.published_at AS requested_at, r.version AS requested, r.is_deprecated AS requested_dep FROM (
  SELECT package_id, count(*) AS version_count,
    coalesce(first(version ORDER BY published_at DESC, version) FILTER (WHERE is_default),
             first(version ORDER BY published_at DESC, version) FILTER (WHERE looks_stable)) AS stable,
    coalesce(first(published_at ORDER BY published_at DESC, version) FILTER (WHERE is_default),
             first(published_at ORDER BY published_at DESC, version) FILTER (WHERE looks_stable)) AS stable_at,
    coalesce(first(is_deprecated ORDER BY published_at DESC, version) FILTER (WHERE is_default),
             first(is_deprecated ORDER BY published_at DESC, version) FILTER (WHERE looks_stable)) AS stable_dep,
    first(version ORDER BY published_at DESC, version) FILTER (WHERE NOT looks_stable) AS pre,
    first(published_at ORDER BY published_at DESC, version) FILTER (WHERE NOT looks_stable) AS pre_at,
    first(version ORDER BY v1 DESC, v2 DESC, v3 DESC, v4 DESC, v5 DESC) AS top,
    first(published_at ORDER BY v1 DESC, v2 DESC, v3 DESC, v4 DESC, v5 DESC) AS top_at
  FROM o_versions GROUP BY package_id) s
LEFT JOIN (SELECT v.* FROM fx_versions v JOIN fx_packages p USING (package_id, version)) r USING (package_id)
""",
    "o_metrics": """
SELECT package_id, version, count(*) AS advisory_count,
  sum(CASE WHEN relation = 'TRANSITIVE' THEN 0 ELSE 1 END) AS direct_count,
  sum(CASE WHEN relation = 'TRANSITIVE' THEN 1 ELSE 0 END) AS transitive_count,
  max(cvss3) AS max_cvss3,
  coalesce(max(CASE WHEN relation = 'TRANSITIVE' THEN cvss3 END), 0.0) AS max_transitive_cvss3,
  sum(CASE WHEN cvss3 >= 7 THEN 1 ELSE 0 END) AS high_count,
  sum(CASE WHEN cvss3 <= 0 THEN 1 ELSE 0 END) AS unknown_count
FROM fx_advisories GROUP BY ALL
""",
    "o_activity": f"""
SELECT repo_id, count(*) AS total_commits,
  sum(CASE WHEN login ILIKE '%bot%' THEN 1 ELSE 0 END) AS bot_commits,
  sum(CASE WHEN login ILIKE '%bot%' THEN 0 ELSE 1 END) AS user_commits,
  max(committed_at) AS latest,
  max(committed_at) FILTER (WHERE login IS NULL OR login NOT ILIKE '%bot%') AS latest_human,
  {_age('max(committed_at)')} AS days_any,
  {_age("max(committed_at) FILTER (WHERE login IS NULL OR login NOT ILIKE '%bot%')")} AS days_human
FROM fx_commits GROUP BY repo_id
""",
    "o_weights": """
SELECT * FROM (VALUES ('Dangerous-Workflow', 10.0), ('Branch-Protection', 7.5), ('Code-Review', 7.5),
  ('Token-Permissions', 7.5), ('Binary-Artifacts', 7.5), ('Pinned-Dependencies', 5.0)) w(check_name, weight)
""",
    "o_build": """
SELECT repo_id, n AS build_signals, CASE WHEN n >= 3 THEN floor(raw * 10 + 0.5) / 10 END AS build_score,
  CASE WHEN n < 3 THEN 'Ungraded' WHEN raw >= 7.5 THEN 'Hardened' WHEN raw >= 2.5 THEN 'Moderate' ELSE 'Weak' END
    AS build_label
FROM (SELECT repo_id, count(*) AS n,
        CAST(sum(CAST(weight AS DOUBLE) * score) AS DOUBLE) / CAST(sum(CAST(weight AS DOUBLE)) AS DOUBLE) AS raw
      FROM fx_scores JOIN o_weights USING (check_name) WHERE score >= 0 GROUP BY repo_id) b
""",
    "o_scores": """
SELECT repo_id, max(score) FILTER (WHERE check_name = 'Maintained') AS maint,
  max(score) FILTER (WHERE check_name = 'Vulnerabilities') AS vuln,
  bool_or(check_name = 'Maintained' AND contains(lower(reason), 'project is archived')) AS by_check
FROM fx_scores GROUP BY repo_id
""",
    "o_npm_next": r"""
SELECT package_id, CASE WHEN lower(nxt) = lower(name) OR lower(nxt) = lower(full_name) THEN NULL ELSE nxt END AS nxt FROM (
  SELECT r.package_id, p.name, coalesce(p.namespace || '/', '') || p.name AS full_name,
    coalesce(
      CASE WHEN regexp_matches(trim(regexp_extract(message, '(?i)use \s*(\S+)', 1), '.,;:!?()[]{}'),
        '^(?:@[-a-z0-9_.]+/)?[A-Za-z0-9][A-Za-z0-9._-]*$')
        THEN trim(regexp_extract(message, '(?i)use \s*(\S+)', 1), '.,;:!?()[]{}') END,
      CASE WHEN regexp_matches(trim(regexp_extract(message, '(?i)moved to \s*(\S+)', 1), '.,;:!?()[]{}'),
        '^(?:@[-a-z0-9_.]+/)?[A-Za-z0-9][A-Za-z0-9._-]*$')
        THEN trim(regexp_extract(message, '(?i)moved to \s*(\S+)', 1), '.,;:!?()[]{}') END,
      CASE WHEN regexp_matches(trim(regexp_extract(message, '(?i)replaced by \s*(\S+)', 1), '.,;:!?()[]{}'),
        '^(?:@[-a-z0-9_.]+/)?[A-Za-z0-9][A-Za-z0-9._-]*$')
        THEN trim(regexp_extract(message, '(?i)replaced by \s*(\S+)', 1), '.,;:!?()[]{}') END) AS nxt
  FROM fx_registry r JOIN fx_packages p USING (package_id) WHERE r.source = 'npm') m
""",
    "o_rule_hits": """
SELECT package_id, 1 AS rule_order, TRUE AS terminal, 'Packagist' AS source, 'Package marked abandoned' AS summary,
  1.0 AS confidence, successor
FROM fx_registry JOIN fx_packages p USING (package_id) WHERE p.ecosystem = 'composer' AND flag = 'abandoned'
UNION ALL
SELECT package_id, 2, successor IS NOT NULL OR reason = 'CriticalBugs', 'NuGet',
  CASE WHEN successor IS NOT NULL THEN 'Package deprecated with successor'
    WHEN reason = 'CriticalBugs' THEN 'Package deprecated: CriticalBugs'
    WHEN reason = 'Legacy' THEN 'Package deprecated: Legacy (no successor)'
    WHEN contains(message, 'no longer maintained') THEN 'Package deprecated: Other (strong wording)'
    ELSE 'Package deprecated: Other' END,
  CASE WHEN successor IS NOT NULL THEN 0.9 WHEN reason = 'CriticalBugs' THEN 1.0 WHEN reason = 'Legacy' THEN 0.7
    WHEN contains(message, 'no longer maintained') THEN 0.8 ELSE 0.5 END, successor
FROM fx_registry JOIN fx_packages p USING (package_id) WHERE p.ecosystem = 'nuget' AND flag = 'deprecated'
UNION ALL
SELECT package_id, CASE WHEN s.stable IS NOT NULL THEN 3 ELSE 4 END, TRUE, 'npmjs',
  CASE flag WHEN 'unpublished' THEN 'Unpublished in npm registry' ELSE 'Deprecated in npm registry' END,
  CASE flag WHEN 'unpublished' THEN 0.95 ELSE 0.9 END, n.nxt
FROM fx_registry r JOIN fx_packages p USING (package_id) LEFT JOIN o_slots s USING (package_id)
  LEFT JOIN o_npm_next n USING (package_id)
WHERE p.ecosystem = 'npm' AND r.source = 'npm' AND (s.stable IS NOT NULL OR p.version IS NOT NULL)
UNION ALL
SELECT package_id, 5, TRUE, 'PyPI', 'Classifier: Development Status :: 7 - Inactive', 1.0, NULL
FROM fx_registry JOIN fx_packages p USING (package_id) WHERE p.ecosystem = 'pypi' AND flag = 'inactive_classifier'
UNION ALL
SELECT package_id, 6, TRUE, 'PyPI', 'Version yanked on PyPI: ' || message, 0.95, NULL
FROM fx_registry r JOIN fx_packages p USING (package_id) LEFT JOIN o_slots s USING (package_id)
WHERE p.ecosystem = 'pypi' AND flag = 'yanked' AND coalesce(r.version, p.version, s.stable) = coalesce(p.version, s.stable)
UNION ALL
SELECT package_id, 7, TRUE, 'crates.io', 'Version yanked on crates.io', 1.0, NULL
FROM fx_registry r JOIN fx_packages p USING (package_id) LEFT JOIN o_slots s USING (package_id)
WHERE p.ecosystem = 'cargo' AND flag = 'yanked' AND coalesce(r.version, p.version, s.stable) = coalesce(p.version, s.stable)
UNION ALL
SELECT package_id, 8, TRUE, 'Maven', 'Artifact relocated: ' || message, 0.95, successor
FROM fx_registry r JOIN fx_packages p USING (package_id)
WHERE p.ecosystem = 'maven' AND flag = 'relocated' AND p.version IS NOT NULL
UNION ALL
SELECT package_id, 9, TRUE, 'deps.dev', 'Marked deprecated in deps.dev', 0.95, NULL
FROM o_slots s JOIN fx_packages p USING (package_id) WHERE p.ecosystem IN ('golang', 'gem') AND s.stable_dep
""",
    "o_eol": """
SELECT package_id, CASE WHEN first_rule IS NOT NULL THEN 'EOL' END AS eol_state, first_rule.source AS eol_source,
  first_rule.summary AS eol_reason, first_rule.successor AS eol_successor,
  coalesce(first_rule.summary, warning) AS evidence_summary, warn_source
FROM (SELECT package_id,
    first({'source': source, 'summary': summary, 'successor': successor} ORDER BY rule_order, confidence DESC, summary)
      FILTER (WHERE terminal) AS first_rule,
    first(summary ORDER BY confidence DESC, summary) FILTER (WHERE NOT terminal) AS warning,
    first(source ORDER BY confidence DESC, summary) FILTER (WHERE NOT terminal) AS warn_source
  FROM o_rule_hits GROUP BY package_id) h
""",
    "o_final_eol": """
SELECT package_id, coalesce(e.eol_state, CASE WHEN c.package_id IS NOT NULL THEN 'Scheduled' END) AS eol_state,
  coalesce(c.reason, e.eol_reason) AS eol_reason, coalesce(e.eol_successor, c.successor) AS eol_successor,
  CASE WHEN e.eol_state IS NULL THEN c.scheduled END AS eol_scheduled, coalesce(c.reason, e.evidence_summary) AS evidence
FROM o_eol e FULL JOIN (SELECT * FROM fx_registry WHERE source = 'catalog') c USING (package_id)
""",
    "o_facts": f"""
SELECT p.package_id, p.ecosystem, p.purl, p.namespace, p.name, p.version, s.version_count, s.stable, s.stable_at,
  s.pre_at, s.top, s.top_at, s.requested_at, r.repo_url, coalesce(r.archived, sc.by_check, FALSE) AS archived,
  coalesce(r.disabled, FALSE) AS disabled,
  e.eol_state, e.eol_reason, e.eol_successor, e.eol_scheduled, e.evidence,
  coalesce(m.advisory_count, 0) AS adv, m.max_cvss3, coalesce(m.high_count, 0) AS high,
  coalesce(m.unknown_count, 0) AS unknown_sev,
  coalesce(sc.maint, -1) AS maint, coalesce(sc.vuln, -1) AS vuln, a.repo_id IS NOT NULL AS has_commit,
  a.latest_human, a.days_any, coalesce(a.days_human, 9999) AS dh,
  least({_age('s.stable_at')}, {_age('s.pre_at')}, {_age('s.top_at')}, {_age('s.requested_at')}) AS pub,
  {_age('s.stable_at')} AS stable_age, {_age('s.pre_at')} AS pre_age,
  coalesce(b.build_label, 'Ungraded') AS build_label, b.build_score
FROM fx_packages p LEFT JOIN o_slots s USING (package_id)
LEFT JOIN o_all_metrics m ON m.package_id = p.package_id AND m.version = coalesce(s.stable, s.top)
LEFT JOIN o_final_eol e ON e.package_id = p.package_id
LEFT JOIN fx_repos r ON r.repo_id = p.repo_id LEFT JOIN o_activity a ON a.repo_id = p.repo_id
LEFT JOIN o_scores sc ON sc.repo_id = p.repo_id LEFT JOIN o_build b ON b.repo_id = p.repo_id
""",
    "o_ruled": """
SELECT *, CASE
  WHEN eol_state = 'Scheduled' THEN 1 WHEN archived OR disabled THEN 2 WHEN eol_state = 'EOL' THEN 3
  WHEN (maint < 0 OR vuln < 0) AND latest_human IS NOT NULL AND dh > 730 AND adv >= 1 AND (unknown_sev > 0 OR high > 0)
    THEN 4
  WHEN stable_age <= 365 THEN 5 WHEN pre_age <= 180 THEN 6
  WHEN dh <= 180 THEN CASE WHEN ecosystem IN ('golang', 'composer') THEN 7 WHEN maint >= 3 THEN 8
    WHEN maint < 0 THEN 9 ELSE 10 END
  WHEN has_commit THEN CASE
    WHEN vuln >= 8 THEN CASE WHEN dh = 9999 OR dh / 365.0 >= 3 THEN 12 ELSE 13 END
    WHEN adv = 0 AND dh > 730 THEN 14
    WHEN maint >= 0 AND maint < 3 THEN CASE WHEN dh <= 730 THEN 17 WHEN vuln BETWEEN 0 AND 2 THEN 15 ELSE 16 END
    WHEN maint >= 3 THEN 18 WHEN pub <= 730 THEN 19 WHEN pub IS NULL THEN 21 WHEN dh > 730 THEN 20 ELSE 22 END
  ELSE CASE
    WHEN maint >= 3 THEN 23
    WHEN maint >= 0 THEN CASE WHEN adv >= 1 AND pub > 730 THEN 24 ELSE 25 END
    WHEN adv >= 1 THEN CASE WHEN pub > 730 THEN 26 ELSE 27 END
    WHEN pub <= 365 THEN 28 WHEN pub <= 730 THEN 29 WHEN pub IS NOT NULL THEN 30 ELSE 31 END
  END AS rule_no
FROM o_facts
""",
    "o_rule_text": """
SELECT * FROM (VALUES
  (1, 'EOL-Scheduled', 'Scheduled EOL'), (2, 'EOL-Confirmed', 'Repository archived or disabled'),
  (3, 'EOL-Confirmed', NULL), (4, 'EOL-Effective', 'Unmaintained, unpatched vulnerabilities'),
  (5, 'Active', 'Actively maintained with recent releases'),
  (6, 'Active', 'Actively maintained with recent pre-release'),
  (7, 'Active', 'Active commits (VCS-direct delivery)'), (8, 'Active', 'Active commits, no recent publish'),
  (9, 'Active', 'Active commits, scorecard unavailable'), (10, 'Stalled', 'Active commits but low maintenance'),
  (12, 'Legacy-Safe', 'Dormant but no known vulnerabilities'),
  (13, 'Stalled', 'Low vulnerability risk but inactive'),
  (14, 'Legacy-Safe', 'Dormant but no known vulnerabilities'),
  (15, 'EOL-Effective', 'Unmaintained, unpatched vulnerabilities'),
  (16, 'Stalled', 'Low maintenance, long-term inactive'), (17, 'Stalled', 'Low maintenance'),
  (18, 'Stalled', 'Maintained but no recent activity'), (19, 'Stalled', 'No recent activity, recent publish'),
  (20, 'Stalled', 'Long-term inactive, no recent releases'),
  (21, 'Stalled', 'No recent activity, no registry data'),
  (22, 'Review Needed', 'Insufficient data for assessment'),
  (23, 'Stalled', 'Maintained but no commit data'), (24, NULL, 'Unmaintained, unpatched vulnerabilities'),
  (25, 'Stalled', 'Low maintenance, no commit data'),
  (26, NULL, 'Unpatched vulnerabilities, no recent releases'),
  (27, 'Stalled', 'Unpatched vulnerabilities, recent publish'),
  (28, 'Active', 'Recently published, no known vulnerabilities'),
  (29, 'Stalled', 'No vulnerabilities but no recent releases'),
  (30, 'Legacy-Safe', 'Dormant but no known vulnerabilities'),
  (31, 'Review Needed', 'Insufficient data for assessment')) t(rule_no, rule_label, rule_reason)
""",
    "o_scan": """
SELECT *, CASE WHEN eol_state = 'EOL' AND eol_scheduled IS NOT NULL THEN 'EOL-Effective'
    WHEN eol_state = 'EOL' THEN 'EOL-Confirmed' WHEN eol_state = 'Scheduled' THEN 'EOL-Scheduled' ELSE label END
    AS status,
  CASE WHEN error IS NOT NULL THEN 'review' WHEN archived OR eol_state = 'EOL' THEN 'replace'
    WHEN eol_state = 'Scheduled' THEN 'caution' WHEN label IN ('Active', 'Legacy-Safe') THEN 'ok'
    WHEN label = 'Stalled' THEN 'caution' WHEN label LIKE 'EOL-%' THEN 'replace' ELSE 'review' END AS verdict
FROM (SELECT r.*,
    CASE WHEN rule_no IN (24, 26) THEN CASE WHEN unknown_sev > 0 OR high > 0 THEN 'EOL-Effective' ELSE 'Stalled' END
      ELSE rule_label END AS label,
    coalesce(rule_reason, coalesce(eol_reason, 'End of life'))
      || CASE WHEN rule_no IN (1, 3) AND eol_successor IS NOT NULL THEN '; successor: ' || eol_successor ELSE '' END
      AS reason,
    CASE WHEN version_count IS NULL AND repo_url IS NULL AND eol_state IS NULL THEN 'package not found' END AS error
  FROM o_ruled r JOIN o_rule_text USING (rule_no)) x
""",
    "o_reach": """
SELECT project_id, package_id AS direct_id, package_id AS node FROM fx_direct
UNION
SELECT r.project_id, r.direct_id, e.dst FROM o_reach r
JOIN fx_edges e ON e.project_id = r.project_id AND e.src = r.node
""",
    # the newest rows of each step; a node found again at a later level does not lead on
    "o_steps": """
SELECT project_id, package_id AS direct_id, package_id AS node, 0 AS level FROM fx_direct
UNION
SELECT s.project_id, s.direct_id, e.dst, s.level + 1 FROM o_steps s
JOIN fx_edges e ON e.project_id = s.project_id AND e.src = s.node
WHERE s.level < (SELECT max(n) FROM (SELECT count(*) AS n FROM o_nodes GROUP BY project_id))
""",
    "o_pairs": """
SELECT r.*, d.package_id IS NOT NULL AS node_direct FROM o_reach r
LEFT JOIN fx_direct d ON d.project_id = r.project_id AND d.package_id = r.node WHERE r.node <> r.direct_id
""",
    "o_gmetrics": """
SELECT d.project_id, d.package_id AS direct_id, coalesce(t.total, 0) AS total_transitive,
  coalesce(t.excl, 0) AS exclusive_transitive, coalesce(t.total, 0) - coalesce(t.excl, 0) AS shared_transitive,
  coalesce(v.n, 0) AS via_count
FROM fx_direct d
LEFT JOIN (SELECT project_id, direct_id, count(*) AS total, sum((providers = 1)::INT) AS excl FROM (
    SELECT *, count(*) OVER (PARTITION BY project_id, node) AS providers FROM o_pairs WHERE NOT node_direct) x
  GROUP BY 1, 2) t ON t.project_id = d.project_id AND t.direct_id = d.package_id
LEFT JOIN (SELECT project_id, node, count(*) AS n FROM o_pairs WHERE node_direct GROUP BY 1, 2) v
  ON v.project_id = d.project_id AND v.node = d.package_id
""",
    "o_nodes": """
SELECT project_id, src AS node FROM fx_edges UNION SELECT project_id, dst FROM fx_edges
UNION SELECT project_id, package_id FROM fx_direct
""",
    "o_health": """
SELECT package_id, is_eol, is_stalled, health_status, adv, max_cvss3, overall_score,
  CASE WHEN overall_score > 0 THEN least(r2 + (1.0 - overall_score / 10.0) * 0.1, 1.0) ELSE r2 END AS health_risk
FROM (SELECT *, CASE WHEN adv > 0 THEN least(r1 + max_cvss3 / 10.0 * 0.2, 1.0) ELSE r1 END AS r2 FROM (
  SELECT s.package_id, coalesce(s.eol_state = 'EOL', FALSE) AS is_eol, s.adv, s.max_cvss3,
    CASE WHEN s.archived THEN 'Archived' ELSE s.status END AS health_status, r.overall_score,
    (s.eol_state IS NULL AND s.status = 'Stalled') OR coalesce(s.days_any > 365, FALSE) AS is_stalled,
    greatest(CASE WHEN s.eol_state = 'EOL' THEN CASE WHEN s.status = 'EOL-Effective' THEN 0.85 ELSE 0.9 END
        WHEN s.eol_state = 'Scheduled' THEN 0.7 WHEN s.status = 'Stalled' THEN 0.6 WHEN s.status = 'Legacy-Safe' THEN 0.4
        WHEN s.status = 'Review Needed' THEN 0.5 ELSE 0.2 END,
      CASE WHEN s.archived THEN 0.85 ELSE 0.0 END, CASE WHEN s.days_any > 365 THEN 0.6 ELSE 0.0 END)::DOUBLE AS r1
  FROM o_scan s JOIN fx_packages p USING (package_id) LEFT JOIN fx_repos r ON r.repo_id = p.repo_id) h1) h2
""",
    **_plan_parts("", "fx_coupling"),
    "o_graph_plan": """
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, purl) AS rank FROM (
  SELECT project_id, package_id, purl, scope, CASE WHEN is_eol OR health_status = 'Archived'
    THEN greatest(impact * health_risk * ease, 0.1::DOUBLE) ELSE impact * health_risk * ease END AS priority FROM (
    SELECT *, CASE WHEN scope IS NULL THEN 1.0::DOUBLE ELSE 1 - (0.4::DOUBLE * (1 / (1 + exp(4::DOUBLE))) + 0.4::DOUBLE * (1 / (1 + exp(4::DOUBLE)))
      + 0.2::DOUBLE * (1 / (1 + exp(3.6::DOUBLE)))) END AS ease, CASE WHEN max_excl = 0 THEN 0.1::DOUBLE
      ELSE least(0.1::DOUBLE + 0.9::DOUBLE * (exclusive_transitive / max_excl), 1.0::DOUBLE) END AS impact FROM o_entries) e) f
""",
    "o_details": """
SELECT advisory_id, max(cvss3) AS cvss3, 'Title of ' || advisory_id AS title FROM fx_advisories GROUP BY advisory_id
""",
    "o_slot_versions": """
SELECT package_id, 'stable' AS slot, stable AS version FROM o_slots WHERE stable IS NOT NULL
UNION ALL SELECT package_id, 'max_semver', top FROM o_slots WHERE top IS NOT NULL
""",
    "o_slot_advisories": """
SELECT s.package_id, s.slot, s.version, a.advisory_id, d.title, d.cvss3,
  CASE WHEN d.cvss3 <= 0 THEN NULL WHEN d.cvss3 < 4 THEN 'LOW' WHEN d.cvss3 < 7 THEN 'MEDIUM' WHEN d.cvss3 < 9 THEN 'HIGH'
    ELSE 'CRITICAL' END AS severity, 'DIRECT' AS relation
FROM o_slot_versions s JOIN fx_advisories a ON a.package_id = s.package_id AND a.version = s.version
JOIN o_details d ON d.advisory_id = a.advisory_id
""",
    "o_resolved": """
SELECT package_id, ecosystem, coalesce(version, stable, top) AS version FROM fx_packages LEFT JOIN o_slots USING (package_id)
""",
    "o_graph_tries": """
SELECT package_id, version, 0 AS position FROM o_resolved
UNION ALL SELECT package_id, version, position FROM (
  SELECT v.package_id, v.version, row_number() OVER (PARTITION BY v.package_id
    ORDER BY v4 DESC, v1 DESC, v2 DESC, v3 DESC, v5 DESC) AS position
  FROM o_versions v JOIN o_resolved r ON r.package_id = v.package_id WHERE NOT v.is_deprecated AND v.version <> r.version) f
WHERE position <= 2
""",
    "o_graph_choice": """
SELECT t.package_id, arg_min(t.version, position) AS graph_version, min(position) AS position
FROM o_graph_tries t JOIN o_resolved r ON r.package_id = t.package_id AND r.ecosystem IN ('npm', 'cargo', 'maven', 'pypi')
  AND r.version IS NOT NULL
WHERE EXISTS (SELECT 1 FROM fx_package_graphs g WHERE g.package_id = t.package_id AND g.graph_version = t.version) GROUP BY 1
""",
    "o_transitive": """
SELECT g.package_id, g.graph_version AS version, a.advisory_id, max(a.cvss3) AS cvss3, 'TRANSITIVE' AS relation,
  min(p.name) AS dependency_name
FROM o_graph_choice c JOIN fx_package_graphs g ON g.package_id = c.package_id AND g.graph_version = c.graph_version
JOIN fx_advisories a ON a.package_id = g.dependency_id AND a.version = g.dependency_version
JOIN fx_packages p ON p.package_id = g.dependency_id
WHERE EXISTS (SELECT 1 FROM o_slot_versions v WHERE v.package_id = g.package_id AND v.version = g.graph_version)
  AND NOT EXISTS (SELECT 1 FROM fx_advisories k WHERE k.package_id = g.package_id AND k.version = g.graph_version
    AND k.advisory_id = a.advisory_id)
GROUP BY 1, 2, 3
""",
    "o_all_advisories": """
SELECT package_id, version, advisory_id, cvss3, relation, CAST(NULL AS VARCHAR) AS dependency_name FROM fx_advisories
UNION ALL SELECT package_id, version, advisory_id, cvss3, relation, dependency_name FROM o_transitive
""",
    "o_all_metrics": """
SELECT package_id, version, count(*) AS advisory_count,
  count(*) FILTER (WHERE relation IS DISTINCT FROM 'TRANSITIVE') AS direct_count,
  count(*) FILTER (WHERE relation = 'TRANSITIVE') AS transitive_count, max(cvss3) AS max_cvss3,
  coalesce(max(cvss3) FILTER (WHERE relation = 'TRANSITIVE'), 0.0) AS max_transitive_cvss3,
  count(*) FILTER (WHERE cvss3 >= 7) AS high_count, count(*) FILTER (WHERE cvss3 <= 0) AS unknown_count
FROM o_all_advisories GROUP BY ALL
""",
    "o_by_key": r"""
SELECT * FROM (SELECT s.*, m.transitive_count, k.canonical_key, row_number() OVER (PARTITION BY k.canonical_key ORDER BY s.package_id) AS kn
  FROM o_scan s JOIN (SELECT package_id, KEY AS canonical_key FROM fx_packages) k ON k.package_id = s.package_id
  LEFT JOIN o_all_metrics m ON m.package_id = s.package_id AND m.version = coalesce(s.stable, s.top)) x WHERE kn = 1
""".replace("KEY", _KEY),
    "o_sbom_reach": """
SELECT project_id, purl AS direct, purl AS node FROM o_sbom_direct
UNION SELECT r.project_id, r.direct, e.dst FROM o_sbom_reach r JOIN o_sbom_edges e ON e.project_id = r.project_id AND e.src = r.node
""",
    "o_dict": _dictionary(),
    "o_spellings": """
SELECT package_id, 'project' AS slot, 0 AS position, project_raw AS raw, CAST(NULL AS VARCHAR) AS url FROM fx_licenses
UNION ALL SELECT package_id, 'github_spdx', 0, github_spdx, NULL FROM fx_licenses
UNION ALL SELECT package_id, 'github_name', 0, github_name, NULL FROM fx_licenses
UNION ALL SELECT package_id, 'version_spdx', unnest(range(len(version_spdx))), unnest(version_spdx), NULL FROM fx_licenses
UNION ALL SELECT package_id, 'version_raw', unnest(range(len(version_raw))), unnest(version_raw), NULL FROM fx_licenses
UNION ALL SELECT package_id, 'manifest', unnest(range(len(manifest))), unnest(manifest).name, unnest(manifest).url
  FROM fx_licenses
""",
    "o_known_all": _normalized("o_spellings"),
    "o_known": """
SELECT * FROM o_known_all WHERE trim(coalesce(raw, '')) <> '' OR trim(coalesce(url, '')) <> ''
""",
    "o_usable": "SELECT * FROM o_known WHERE license_id IS NOT NULL AND upper(license_id) <> 'NOASSERTION'",
    "o_version_ids": """
SELECT DISTINCT package_id, license_id, is_spdx, slot, first_value(trim(raw)) OVER (
  PARTITION BY package_id, slot, license_id ORDER BY position) AS raw
FROM o_usable WHERE slot = 'version_spdx' OR (slot = 'version_raw' AND package_id NOT IN (
  SELECT package_id FROM o_usable WHERE slot = 'version_spdx'))
""",
    "o_version_lists": """
SELECT package_id, list({'id': license_id, 'raw': raw, 'spdx': is_spdx,
    'src': CASE slot WHEN 'version_spdx' THEN 'depsdev-version-spdx' ELSE 'depsdev-version-raw' END}
    ORDER BY license_id) AS vl
FROM o_version_ids GROUP BY 1
""",
    "o_pom_rows": f"""
SELECT package_id, position, CASE WHEN is_spdx THEN license_id ELSE coalesce({_url_id('url')}, '') END AS id,
  CASE WHEN is_spdx THEN trim(raw) WHEN {_url_id('url')} IS NOT NULL THEN trim(url)
    ELSE coalesce(nullif(trim(raw), ''), trim(url)) END AS raw,
  is_spdx OR {_url_id('url')} IS NOT NULL AS spdx
FROM o_known WHERE slot = 'manifest'
""",
    "o_pom": """
SELECT package_id, list({'id': id, 'raw': raw, 'spdx': spdx,
    'src': CASE WHEN spdx THEN 'maven-pom-spdx' ELSE 'maven-pom-nonstandard' END} ORDER BY position) AS pom,
  first(id ORDER BY position) FILTER (WHERE spdx) AS best_id, first(raw ORDER BY position) FILTER (WHERE spdx) AS best_raw
FROM (SELECT *, row_number() OVER (PARTITION BY package_id, CASE WHEN id <> '' THEN id ELSE 'raw:' || raw END
    ORDER BY position) AS rn FROM o_pom_rows) p WHERE rn = 1 GROUP BY 1
""",
    "o_lic1": """
SELECT f.package_id, f.requested_known, f.github_spdx, f.github_name,
  CASE WHEN p.license_id IS NULL THEN NULL WHEN p.is_spdx THEN {'id': p.license_id, 'raw': trim(p.raw), 'spdx': TRUE,
      'src': 'depsdev-project-spdx'}
    ELSE {'id': '', 'raw': trim(p.raw), 'spdx': FALSE, 'src': 'depsdev-project-nonstandard'} END AS pl,
  CASE WHEN f.requested_known THEN coalesce(v.vl, []) ELSE [] END AS vl,
  g1.license_id AS g1_id, g1.is_spdx AS g1_spdx, g2.license_id AS g2_id, g2.is_spdx AS g2_spdx
FROM fx_licenses f LEFT JOIN o_usable p ON p.package_id = f.package_id AND p.slot = 'project'
LEFT JOIN o_version_lists v ON v.package_id = f.package_id
LEFT JOIN o_usable g1 ON g1.package_id = f.package_id AND g1.slot = 'github_spdx'
LEFT JOIN o_usable g2 ON g2.package_id = f.package_id AND g2.slot = 'github_name'
""",
    "o_lic2": """
SELECT * EXCLUDE (vl), CASE WHEN requested_known AND pl.id <> ''
    AND (len(vl) = 0 OR len(list_filter(vl, lambda x: x.spdx)) = 0)
  THEN [{'id': pl.id, 'raw': pl.id, 'spdx': TRUE, 'src': 'project-fallback'}] ELSE vl END AS vl FROM o_lic1
""",
    "o_lic3": """
SELECT * EXCLUDE (pl), CASE WHEN requested_known AND coalesce(pl.id, '') = '' AND len(vl) = 1 AND vl[1].spdx
  THEN {'id': vl[1].id, 'raw': vl[1].id, 'spdx': TRUE, 'src': 'derived-from-version'} ELSE pl END AS pl FROM o_lic2
""",
    "o_lic4": """
SELECT * EXCLUDE (pl), CASE WHEN pl.spdx THEN pl
  WHEN g1_spdx THEN {'id': g1_id, 'raw': github_spdx, 'spdx': TRUE, 'src': 'github-project-spdx'}
  WHEN g2_spdx THEN {'id': g2_id, 'raw': github_name, 'spdx': TRUE, 'src': 'github-project-spdx'}
  WHEN host IS NULL OR (pl IS NOT NULL AND pl.raw = host) THEN pl
  ELSE {'id': '', 'raw': host, 'spdx': FALSE, 'src': 'github-project-nonstandard'} END AS pl
FROM (SELECT *, coalesce(CASE WHEN upper(trim(github_name)) NOT IN ('', 'NOASSERTION') THEN trim(github_name) END,
  CASE WHEN upper(trim(github_spdx)) NOT IN ('', 'NOASSERTION') THEN trim(github_spdx) END) AS host FROM o_lic3) h
""",
    "o_licenses": """
SELECT l.package_id, CASE WHEN (pl IS NULL OR NOT pl.spdx) AND best_id IS NOT NULL
    THEN {'id': best_id, 'raw': best_raw, 'spdx': TRUE, 'src': 'maven-pom-spdx'}
    WHEN pl IS NULL AND len(pom) > 0 THEN pom[1] ELSE pl END AS pl,
  CASE WHEN len(pom) > 0 AND (len(vl) = 0 OR (len(list_filter(vl, lambda x: x.spdx)) = 0 AND best_id IS NOT NULL))
    THEN pom ELSE vl END AS vl,
  best_id AS manifest_spdx, CASE WHEN pl.spdx THEN pl.id END AS settled_spdx
FROM o_lic4 l LEFT JOIN o_pom USING (package_id)
""",
    "o_license_flags": """
SELECT *, pl IS NULL AS z, coalesce(pl.spdx, FALSE) AS sp, pl IS NOT NULL AND NOT pl.spdx AS od, len(vl) AS n,
  len(vl) > 0 AND len(list_filter(vl, lambda x: x.spdx)) = 0 AS an,
  coalesce(pl.spdx, FALSE) AND len(list_filter(vl, lambda x: x.id = pl.id)) > 0 AS has,
  len(vl) = 1 AND coalesce(vl[1].src = 'project-fallback', FALSE) AS fb, coalesce(pl.src, '') AS src
FROM o_licenses
""",
    "o_pom_expanded": """
SELECT package_id, position, CASE WHEN name = '$' || '{license.name}' THEN
    CASE WHEN package_id % 2 = 0 THEN b.value ELSE 'mit' END ELSE name END AS name,
  CASE WHEN url = '$' || '{license.url}' THEN 'https://mit-license.org/' ELSE url END AS url
FROM fx_pom_entries LEFT JOIN (SELECT * FROM fx_pom_properties WHERE key = 'base.name') b USING (package_id)
""",
    "o_pom_filled": """
SELECT package_id, position, CASE WHEN name IS NULL AND raw_name = '$' || '{license.name}' THEN '$' || '{base.name}'
  ELSE name END AS name, url
FROM (SELECT x.*, e.name AS raw_name FROM o_pom_expanded x JOIN fx_pom_entries e USING (package_id, position)) y
""",
    "o_pom_known": _normalized("o_pom_filled", "name"),
    "o_mentions": r"""
SELECT doc_id, regexp_replace(trim(unnest(list_concat(
  regexp_extract_all(text, '(?i)(?:licensed|released) under (?:the )?([^\n.]*(?:\.\d[^\n.]*)*)', 1),
  regexp_extract_all(text, 'SPDX-License-Identifier:\s*([^\s*/]+)', 1)))), '[\s.,;]+$', '') AS raw FROM documents
""",
    "o_mentions_known": _normalized("o_mentions"),
    "o_leaf_raw": r"""
SELECT package_id, expression, trim(regexp_replace(regexp_replace(x, '(?i)(^|\s)with(\s.*)?$', ''), '\s+', ' ', 'g')) AS raw
FROM (SELECT package_id, expression, unnest(regexp_split_to_array(regexp_replace(
    regexp_replace(expression, '(?i)([\s()]|^)(?:or|and)([\s()]|$)', '\1#\2', 'g'), '[()]', '#', 'g'), '#')) AS x
  FROM fx_expressions) e
""",
    "o_leaf_base": r"""
SELECT *, regexp_matches(raw, '[^+]\+$') AS or_later, regexp_replace(raw, '([^+])\+$', '\1') AS base
FROM o_leaf_raw WHERE raw <> ''
""",
    "o_leaf_known": _normalized("o_leaf_base", "base"),
    "o_code": """
SELECT project_id, 'src/f' || file_id || '.' || ['go', 'py', 'js', 'ts', 'java'][lang_no + 1] AS path,
  ['go', 'python', 'javascript', 'typescript', 'java'][lang_no + 1] AS lang, u.ip AS import_path, u.al AS alias, u.kd AS kind,
  u.sy AS symbol, u.n AS calls
FROM (SELECT *, unnest(CASE lang_no * 3 + n % 3
  WHEN 0 THEN [{'ip': b || '/p' || p || '/sub', 'al': 'sub', 'kd': 'normal', 'sy': 'Call' || s, 'n': 1}]
  WHEN 1 THEN [{'ip': b || '/p' || p, 'al': 'x' || p, 'kd': 'normal', 'sy': 'Call' || s, 'n': 1}]
  WHEN 2 THEN [{'ip': b || '/p' || p, 'al': '', 'kd': 'blank', 'sy': NULL, 'n': 0}]
  WHEN 3 THEN [{'ip': 'p' || p, 'al': 'p' || p, 'kd': 'normal', 'sy': 'fn' || s, 'n': 1}]
  WHEN 4 THEN [{'ip': 'p' || p || '.mod', 'al': 'g' || p, 'kd': 'normal', 'sy': 'g' || p, 'n': 1}]
  WHEN 5 THEN [{'ip': 'p' || p, 'al': 'q' || p, 'kd': 'normal', 'sy': 'attr' || s, 'n': 1}]
  WHEN 6 THEN [{'ip': '@' || b || '/p' || p, 'al': 'x' || p, 'kd': 'normal', 'sy': 'do' || s, 'n': 1}]
  WHEN 7 THEN [{'ip': '@' || b || '/p' || p || '/lib', 'al': 'y' || p, 'kd': 'normal', 'sy': 'y' || p, 'n': 1}]
  WHEN 8 THEN [{'ip': '@' || b || '/p' || p, 'al': '', 'kd': 'blank', 'sy': NULL, 'n': 0}]
  WHEN 9 THEN [{'ip': '@' || b || '/p' || p, 'al': 'a' || p, 'kd': 'normal', 'sy': 'a' || p, 'n': 1},
    {'ip': '@' || b || '/p' || p, 'al': 'c' || p, 'kd': 'normal', 'sy': 'c' || p, 'n': 1}]
  WHEN 11 THEN [{'ip': '@' || b || '/p' || p, 'al': '', 'kd': 'blank', 'sy': NULL, 'n': 0}]
  WHEN 12 THEN [{'ip': b || '.p' || p || '.C' || s, 'al': 'C' || s, 'kd': 'normal', 'sy': 'C' || s, 'n': 2},
    {'ip': b || '.p' || p || '.C' || s, 'al': 'c' || s, 'kd': 'normal', 'sy': 'run' || p, 'n': 1}]
  WHEN 13 THEN [{'ip': b || '.p' || p || '.Util.help' || s, 'al': 'help' || s, 'kd': 'normal', 'sy': 'help' || s, 'n': 1}]
  WHEN 14 THEN [{'ip': b || '.p' || p, 'al': '', 'kd': 'wildcard', 'sy': NULL, 'n': 0}] END) AS u FROM fx_lines) x
""",
    "o_alias_uses": """
SELECT project_id, path, alias, symbol, sum(calls) AS calls FROM o_code WHERE kind = 'normal' GROUP BY ALL
""",
    "o_imports": "SELECT DISTINCT project_id, path, lang, import_path, alias, kind FROM o_code",
    "o_candidates": """
SELECT DISTINCT package_id, lower(unnest(CASE
  WHEN ecosystem IN ('golang', 'npm') THEN [coalesce(namespace || '/', '') || name]
  WHEN ecosystem = 'pypi' THEN CASE WHEN name LIKE 'py-%' THEN [replace(name, '-', '_'), replace(name, 'py-', '')]
    ELSE [replace(name, '-', '_')] END
  WHEN ecosystem = 'maven' THEN [namespace, namespace || '.' || name] ELSE [name] END)) AS prefix
FROM fx_packages
""",
    "o_targets": """
SELECT DISTINCT d.project_id, c.prefix, c.package_id FROM fx_direct d JOIN o_candidates c USING (package_id)
""",
    "o_paths": """
SELECT DISTINCT project_id, lower(import_path) AS w, lang = 'python' AS py,
  CASE WHEN lang IN ('python', 'java') THEN '.' ELSE '/' END AS sep FROM o_imports
""",
    "o_path_match": """
SELECT project_id, w, py, sep, prefix FROM (
  SELECT p.*, t.prefix, row_number() OVER (PARTITION BY p.project_id, w, py, sep ORDER BY
    CASE WHEN py AND t.prefix = w THEN 2000000 WHEN py AND t.prefix = split_part(w, '.', 1) THEN 1000000
      ELSE length(t.prefix) END DESC) AS rn
  FROM o_paths p JOIN (SELECT DISTINCT project_id, prefix FROM o_targets) t
    ON t.project_id = p.project_id AND (p.w = t.prefix OR starts_with(p.w, t.prefix || p.sep))) x WHERE rn = 1
""",
    "o_matched": """
SELECT DISTINCT i.*, t.package_id, m.prefix FROM o_imports i JOIN o_path_match m ON m.project_id = i.project_id
  AND m.w = lower(i.import_path) AND m.py = (i.lang = 'python')
  AND m.sep = CASE WHEN i.lang IN ('python', 'java') THEN '.' ELSE '/' END
JOIN o_targets t ON t.project_id = i.project_id AND t.prefix = m.prefix
""",
    **_coupling_parts("", "o_matched"),
    "o_retry": """
SELECT DISTINCT i.*, m.package_id, m.prefix FROM o_imports i JOIN (
  SELECT d.project_id, d.package_id, 'p' || d.package_id AS prefix FROM fx_direct d
  JOIN fx_packages p USING (package_id) WHERE p.ecosystem = 'pypi' AND NOT EXISTS (SELECT 1 FROM o_matched m
    WHERE m.project_id = d.project_id AND m.package_id = d.package_id)) m
  ON m.project_id = i.project_id AND (lower(i.import_path) = m.prefix OR starts_with(lower(i.import_path),
    m.prefix || CASE WHEN i.lang IN ('python', 'java') THEN '.' ELSE '/' END))
""",
    "o_matched_all": "SELECT * FROM o_matched UNION SELECT * FROM o_retry",
    **_coupling_parts("_all", "o_matched_all"),
    **_plan_parts("_src", "o_coupling_all"),
    "o_wheel_names": """
SELECT DISTINCT p_partkey AS package_id, 'p' || p_partkey AS prefix FROM part WHERE p_partkey >= 0
""",
    "o_input_norm": r"""
SELECT *, trim(line) AS t FROM fx_inputs WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%'
""",
    "o_input_kinds": r"""
SELECT *, CASE WHEN t LIKE 'pkg:%' THEN 'package'
  WHEN regexp_matches(t, '^https?://') THEN CASE WHEN regexp_matches(t, '^https?://[^/]*(?i:github\.com)[^/]*/+[^/?#]+/[^/?#]+')
    THEN 'repository' ELSE 'unrecognised' END
  WHEN regexp_matches(t, '^github\.com/[^/]+/[^/]+') OR regexp_matches(t, '^[^/@:]+/[^/@:]+$') THEN 'repository'
  ELSE 'unrecognised' END AS kind FROM o_input_norm
""",
    "o_file_quality": """
SELECT file_id, count(*) AS content_lines, count(*) FILTER (WHERE kind = 'package') AS packages,
  count(*) FILTER (WHERE kind = 'repository') AS repositories,
  avg(CASE WHEN kind = 'unrecognised' THEN 1.0 ELSE 0.0 END) AS unrecognised_share FROM o_input_kinds GROUP BY 1
""",
    "o_keys": r"""
SELECT *, CASE WHEN pth <> '' THEN 'pkg:' || kind || '/' || lower(replace(replace(pth, '%40', '@'), '%3A', ':')) END AS canonical_key FROM (
  SELECT *, lower(regexp_extract(bare, '^pkg:/*([A-Za-z][A-Za-z0-9.+-]*)/(.+)$', 1)) AS kind,
    regexp_replace(regexp_extract(bare, '^pkg:/*[A-Za-z][A-Za-z0-9.+-]*/(.+)$', 1), '([^/])@[^@]*$', '\1') AS pth,
    nullif(regexp_extract(regexp_extract(bare, '^pkg:/*[A-Za-z][A-Za-z0-9.+-]*/(.+)$', 1), '[^/]@([^@]*)$', 1), '') AS ver
  FROM (SELECT file_id, line_no, t AS purl, regexp_replace(t, '[?#].*$', '') AS bare FROM o_input_norm
    WHERE t LIKE 'pkg:%') a) b
""",
    "o_repo_norm": r"""
SELECT *, regexp_replace(regexp_replace(regexp_replace(
  CASE WHEN repo_url LIKE '%gitbox.apache.org%' THEN 'https://github.com/apache/' || regexp_extract(repo_url, '([^/=]+)\.git', 1)
    WHEN repo_url LIKE 'github:%' THEN 'https://github.com/' || substr(repo_url, 8)
    WHEN repo_url LIKE 'git+https://%' THEN substr(repo_url, 5)
    WHEN repo_url LIKE 'git+ssh://git@%' THEN 'https://' || replace(substr(repo_url, 15), ':', '/')
    WHEN repo_url LIKE 'git@%' THEN 'https://' || replace(substr(repo_url, 5), ':', '/')
    WHEN repo_url LIKE 'git://%' THEN 'https://' || substr(repo_url, 7) ELSE repo_url END,
  '[#?].*$', ''), '/+$', ''), '\.git$', '') AS url FROM fx_repo_urls
""",
    "o_repo_keys": r"""
SELECT *, CASE WHEN contains(lower(url), 'github.com') THEN
    'github.com/' || regexp_extract(lower(url), 'github\.com[:/]+([^/]+/[^/]+)', 1) ELSE url END AS repo_key FROM o_repo_norm
""",
    "o_purls": "SELECT package_id AS node, purl FROM fx_packages",
    "o_sbom_edges": """
SELECT e.project_id, a.purl AS src, b.purl AS dst FROM fx_edges e JOIN o_purls a ON a.node = e.src JOIN o_purls b ON b.node = e.dst
""",
    "o_sbom_direct": """
WITH n AS (SELECT project_id, count(*) AS k, min(package_id) AS only_id FROM fx_direct GROUP BY 1),
ids AS (
  SELECT project_id, package_id AS node FROM fx_direct WHERE project_id % 4 IN (0, 2)
  UNION SELECT d.project_id, d.package_id FROM fx_direct d JOIN n USING (project_id) WHERE project_id % 4 = 1 AND (k > 1
    OR NOT EXISTS (SELECT 1 FROM fx_edges e WHERE e.project_id = d.project_id AND e.src = d.package_id))
  UNION SELECT e.project_id, e.dst FROM fx_edges e JOIN n ON n.project_id = e.project_id AND n.k = 1 AND n.only_id = e.src
    WHERE e.project_id % 4 = 1
  UNION SELECT project_id, node FROM fx_sbom_nodes s WHERE project_id % 4 = 3
    AND NOT EXISTS (SELECT 1 FROM fx_edges e WHERE e.project_id = s.project_id AND e.dst = s.node))
SELECT i.project_id, p.purl FROM ids i JOIN o_purls p USING (node)
""",
    "o_action": """
SELECT package_id AS p, 'owner' || (package_id % 40) || '/repo' || (package_id % 40) || '/act' || package_id
  || CASE WHEN package_id % 6 = 0 THEN '/sub' ELSE '' END AS action, 'owner' || (package_id % 40) || '/repo' || (package_id % 40) AS repo
FROM fx_packages
""",
    "o_action_edges": "SELECT project_id, src, dst FROM fx_edges WHERE src % 10 <> 3",
    "o_action_levels": """
SELECT project_id, package_id AS node, 0 AS level FROM fx_direct
UNION SELECT l.project_id, e.dst, l.level + 1 FROM o_action_levels l
JOIN o_action_edges e ON e.project_id = l.project_id AND e.src = l.node WHERE l.level < 40
""",
    "o_action_first": "SELECT project_id, node, min(level) AS level FROM o_action_levels GROUP BY 1, 2",
    "o_action_via": """
SELECT d.project_id, d.package_id AS node, 0 AS level, a.action AS via FROM fx_direct d JOIN o_action a ON a.p = d.package_id
UNION SELECT v.project_id, e.dst, f.level, v.via FROM o_action_via v
JOIN o_action_edges e ON e.project_id = v.project_id AND e.src = v.node
JOIN o_action_first f ON f.project_id = e.project_id AND f.node = e.dst AND f.level = v.level + 1
""",
    "o_workflow_refs": """
SELECT d.project_id AS scope, '.github/workflows/ci.yml' AS path, 'remote' AS kind, a.action, 'v' || (d.package_id % 5) AS ref,
  CAST(NULL AS VARCHAR) AS local_path FROM fx_direct d JOIN o_action a ON a.p = d.package_id
UNION ALL SELECT DISTINCT project_id, '.github/workflows/ci.yml', 'local', NULL, NULL, '.github/actions/first' FROM fx_direct
UNION ALL SELECT e.project_id, s.action || '/action.yml', 'remote', t.action, 'main', NULL FROM o_action_edges e
  JOIN o_action s ON s.p = e.src JOIN o_action t ON t.p = e.dst
UNION ALL SELECT DISTINCT project_id, '.github/actions/first/action.yml', 'local', NULL, NULL, '.github/actions/second' FROM fx_direct
UNION ALL SELECT DISTINCT project_id, '.github/actions/first/action.yml', 'remote', 'local/one', 'v1', NULL FROM fx_direct
UNION ALL SELECT DISTINCT project_id, '.github/actions/second/action.yml', 'local', NULL, NULL, '.github/actions/first' FROM fx_direct
UNION ALL SELECT DISTINCT project_id, '.github/actions/second/action.yml', 'remote', 'local/one', 'v2', NULL FROM fx_direct
UNION ALL SELECT DISTINCT project_id, '.github/actions/second/action.yml', 'remote', 'local/two/sub', 'v2', NULL FROM fx_direct
""",
    "o_modules": """
SELECT DISTINCT namespace AS brand, package_id, purl FROM fx_packages WHERE ecosystem = 'maven'
""",
    "o_module_edges": """
SELECT DISTINCT m.brand, m.purl AS src, p.purl AS dst FROM o_modules m JOIN fx_edges e ON e.src = m.package_id
JOIN o_purls p ON p.node = e.dst
""",
    "o_scan_repo": """
SELECT s.*, p.repo_id, r.stars, r.overall_score, r.fork, r.fork_source, g.direct_deps, g.transitive_deps, CASE
    WHEN (p.package_id * 13) % 7 > 0 THEN (p.package_id * 13) % 7 WHEN p.ecosystem IN ('gem', 'composer') THEN (p.package_id * 29) % 1000 ELSE 0 END AS dependents
FROM o_scan s JOIN fx_packages p USING (package_id) LEFT JOIN fx_repos r ON r.repo_id = p.repo_id
LEFT JOIN (SELECT package_id, count(*) FILTER (WHERE relation = 'DIRECT') AS direct_deps, count(*) FILTER (WHERE relation = 'INDIRECT') AS transitive_deps
  FROM fx_package_graphs JOIN o_graph_choice USING (package_id, graph_version) GROUP BY 1) g ON g.package_id = s.package_id
""",

    "o_required": """
SELECT project_id, module, CASE WHEN package_id % 9 = 0 THEN 'example.com/fork' || package_id ELSE module END AS name,
  CASE WHEN package_id % 9 = 0 THEN 'v2.0.0' ELSE 'v1.' || (package_id % 10) || '.0' END AS version,
  'pkg:golang/' || CASE WHEN package_id % 9 = 0 THEN 'example.com/fork' || package_id || '@v2.0.0'
    ELSE module || '@v1.' || (package_id % 10) || '.0' END AS purl,
  CASE WHEN package_id % 13 = 0 THEN 'tool' END AS scope FROM fx_modules WHERE package_id % 4 <> 1
UNION ALL SELECT DISTINCT project_id, 'example.com/single', 'example.com/single', 'v0.1.0', 'pkg:golang/example.com/single@v0.1.0',
  NULL FROM fx_direct
""",
    "o_listed": """
SELECT DISTINCT i.file_id, 'github.com/' || regexp_extract(lower(i.t), '^(?:https://github\\.com/|github\\.com/)?([^/]+/[^/.]+)', 1) AS repo_key
FROM o_input_kinds i JOIN o_file_quality q ON q.file_id = i.file_id WHERE kind = 'repository' AND unrecognised_share <= 0.5
""",
    "o_project_repos": """
SELECT DISTINCT project_id, 'github.com/owner' || (project_id % 50) || '/repo' || project_id AS repo_key FROM fx_direct
""",
    "o_named_actions": """
SELECT d.project_id, a.repo, 2 AS rank, 0 AS level, CAST(NULL AS VARCHAR) AS via FROM fx_direct d JOIN o_action a ON a.p = d.package_id
UNION ALL SELECT DISTINCT project_id, unnest(['local/one', 'local/two']), 3, unnest([0, 1]),
  unnest(['.github/actions/first', '.github/actions/second']) FROM fx_direct
UNION ALL SELECT v.project_id, a.repo, 4, v.level, v.via FROM o_action_via v JOIN o_action a ON a.p = v.node WHERE v.level > 0
""",
    "o_file_repos": """
SELECT file_id, repo_key, source, via FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id, repo_key ORDER BY rank, scope, level, via) AS n FROM (
    SELECT file_id, repo_key, 1 AS rank, repo_key AS scope, 0 AS level, CAST(NULL AS VARCHAR) AS via, 'repository' AS source FROM o_listed
    UNION ALL SELECT l.file_id, 'github.com/' || a.repo, rank, l.repo_key, level, via,
      CASE rank WHEN 2 THEN 'actions' WHEN 3 THEN 'actions-local' ELSE 'actions-transitive' END
    FROM o_listed l JOIN o_project_repos p ON p.repo_key = l.repo_key JOIN o_named_actions a ON a.project_id = p.project_id) x) y
WHERE n = 1
""",
    "o_repo_packages": """
SELECT -repo_id - 1 AS package_id, 'github' AS ecosystem, CAST(NULL AS VARCHAR) AS namespace, CAST(NULL AS VARCHAR) AS name,
  CAST(NULL AS VARCHAR) AS version, 'pkg:' || substr(repo_url, 9) AS purl, repo_id FROM fx_repos
""",
    "o_sbom_pairs": """
SELECT r.project_id, r.direct, r.node, d.purl IS NOT NULL AS node_direct FROM o_sbom_reach r
LEFT JOIN o_sbom_direct d ON d.project_id = r.project_id AND d.purl = r.node WHERE r.node <> r.direct
""",
    "o_sbom_entries": """
SELECT d.project_id, d.purl, coalesce(t.total, 0) AS total, coalesce(t.excl, 0) AS excl, coalesce(v.n, 0) AS via_count,
  max(coalesce(t.excl, 0)) OVER (PARTITION BY d.project_id) AS max_excl
FROM o_sbom_direct d
LEFT JOIN (SELECT project_id, direct, count(*) AS total, count(*) FILTER (WHERE providers = 1) AS excl FROM (
    SELECT *, count(*) OVER (PARTITION BY project_id, node) AS providers FROM o_sbom_pairs WHERE NOT node_direct) x GROUP BY 1, 2) t
  ON t.project_id = d.project_id AND t.direct = d.purl
LEFT JOIN (SELECT project_id, node, count(*) AS n FROM o_sbom_pairs WHERE node_direct GROUP BY 1, 2) v
  ON v.project_id = d.project_id AND v.node = d.purl
""",
    "o_evaluated": "SELECT label, reason FROM o_scan WHERE error IS NULL",
    "o_distribution": """
SELECT label, reason, packages, round(packages * 100.0 / (SELECT count(*) FROM o_evaluated), 9) AS percent,
  CASE WHEN label = 'Active' THEN 'active' WHEN label = 'Stalled' THEN 'stalled' WHEN label LIKE 'EOL-%' THEN 'eol'
    WHEN label = 'Review Needed' THEN 'review' ELSE 'other' END AS bucket
FROM (SELECT label, NULL AS reason, count(*) AS packages FROM o_evaluated GROUP BY label
      UNION ALL SELECT label, reason, count(*) FROM o_evaluated GROUP BY label, reason) d
""",
    "o_signal_names": """
SELECT *, unnest(sigs) AS sig, generate_subscripts(sigs, 1) - 1 AS position FROM (SELECT *, CASE
  WHEN rule_no = 1 THEN ['eol_source', 'eol_scheduled_date'] WHEN rule_no = 2 THEN ['repo_archived', 'repo_disabled']
  WHEN rule_no = 3 THEN ['eol_source']
  WHEN rule_no IN (4, 15) THEN ['last_human_commit', 'maintained_score', 'advisory_count', 'max_advisory_severity']
  WHEN rule_no = 5 THEN ['recent_stable_release', 'last_human_commit', 'maintained_score']
  WHEN rule_no = 6 THEN ['recent_pre_release', 'last_human_commit', 'maintained_score']
  WHEN rule_no = 7 THEN ['last_human_commit', 'ecosystem_delivery', 'maintained_score']
  WHEN rule_no IN (12, 13) THEN ['last_human_commit', 'advisory_count', 'max_advisory_severity']
  WHEN rule_no = 14 THEN ['last_human_commit', 'advisory_count']
  WHEN rule_no IN (19, 20) THEN ['last_human_commit', 'days_since_release', 'maintained_score']
  WHEN rule_no IN (24, 26, 27) THEN ['last_human_commit', 'maintained_score', 'days_since_release', 'advisory_count',
    'max_advisory_severity']
  WHEN rule_no IN (28, 29, 30) THEN ['days_since_release', 'advisory_count']
  ELSE ['last_human_commit', 'maintained_score'] END AS sigs FROM o_scan) AS listed
""",
    "o_marked_pages": r"""
SELECT page_id, len(regexp_extract_all(string_split(html, '</head>')[1], '<meta\b[^>]*>')) AS ahead
  FROM pages WHERE contains(html, '</head>')
""",
    "o_rule_names": r"""
SELECT unnest(names) AS rule, generate_subscripts(names, 1) AS rule_no FROM (SELECT regexp_split_to_array('planned_eol archived_or_disabled primary_eol
residual_vulnerabilities recent_stable recent_prerelease commits_vcs_direct commits_maintained commits_no_scorecard commits_low_maintenance
commit_data_missing safe_by_vulnerability_score stalled_good_vulnerability_score safe_no_advisories low_maintenance_vulnerable
low_maintenance_dormant low_maintenance maintained_inactive inactive_recent_publish inactive_old_publish inactive_no_registry
commit_inconclusive no_commit_maintained no_commit_low_vulnerable no_commit_low no_commit_vulnerable_old no_commit_vulnerable_recent
no_commit_recent_publish no_commit_mid_publish no_commit_old_publish no_data', '\s+') AS names)
""",
}

# repositories judged as packages without versions: the same tables over other rows
for _name, _from, _to in (("facts", "fx_packages", "o_repo_packages"), ("ruled", "o_facts", "o_repo_facts"), ("scan", "o_ruled", "o_repo_ruled")):
    PARTS[f"o_repo_{_name}"] = PARTS[f"o_{_name}"].replace(_from, _to)

# --- statements, one per registered query ---------------------------------------
SQL: dict[str, str] = {
    "release_slots": """
SELECT package_id, stable AS stable_version, CAST(stable_at AS VARCHAR) AS stable_published_at,
  stable_dep AS stable_deprecated, pre AS prerelease_version, CAST(pre_at AS VARCHAR) AS prerelease_published_at,
  top AS max_semver_version, CAST(top_at AS VARCHAR) AS max_semver_published_at, requested AS requested_version
FROM o_slots
""",
    "effective_versions": """
SELECT package_id, purl, coalesce(stable, top, pre, version) AS effective_version,
  coalesce(stable, top, pre) AS latest_release, coalesce(version, stable, top) AS resolved_version
FROM fx_packages LEFT JOIN o_slots USING (package_id)
""",
    "fallback_versions": """
SELECT package_id, position, version, v4 = 1 AS stable FROM (
  SELECT package_id, version, v4, row_number() OVER (PARTITION BY package_id
    ORDER BY v4 DESC, v1 DESC, v2 DESC, v3 DESC, v5 DESC) AS position
  FROM o_versions v WHERE NOT is_deprecated
    AND NOT EXISTS (SELECT 1 FROM fx_packages p WHERE p.package_id = v.package_id AND p.version = v.version)) f
WHERE position <= 2
""",
    "commit_stats": """
SELECT repo_id, total_commits, user_commits, bot_commits, round(user_commits / total_commits, 9) AS user_ratio,
  round(bot_commits / total_commits, 9) AS bot_ratio FROM o_activity
""",
    "repo_activity": """
SELECT repo_id, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest_commit,
  strftime(latest_human, '%Y-%m-%d %H:%M:%S') AS latest_human_commit, days_any AS days_since_commit,
  days_human AS days_since_human_commit FROM o_activity
""",
    "advisory_metrics": "SELECT * FROM o_metrics",
    "build_integrity": "SELECT * FROM o_build",
    "registry_rule_hits": """
SELECT package_id, rule_order, terminal, source, summary, CAST(confidence AS DOUBLE) AS confidence, successor
FROM o_rule_hits
""",
    "registry_eol": """
SELECT package_id, eol_state, coalesce(eol_source, warn_source) AS eol_source, eol_reason, eol_successor,
  evidence_summary, CAST(NULL AS VARCHAR) AS eol_scheduled FROM o_eol
""",
    "lifecycle_scan": """
SELECT package_id, purl, label AS lifecycle_label, reason AS lifecycle_reason, status, verdict, build_label,
  build_score, adv AS advisory_count, error FROM o_scan
""",
    "label_distribution": "SELECT * FROM o_distribution",
    "scan_summary": """
SELECT count(*) AS total, sum((verdict = 'ok')::INT) AS ok_count, sum((verdict = 'caution')::INT) AS caution_count,
  sum((verdict = 'replace')::INT) AS replace_count, sum((verdict = 'review')::INT) AS review_count,
  sum((build_label = 'Hardened')::INT) AS hardened_count, sum((build_label = 'Moderate')::INT) AS moderate_count,
  sum((build_label = 'Weak')::INT) AS weak_count, sum((build_label = 'Ungraded')::INT) AS ungraded_count
FROM o_scan
""",
    "reachability": """
SELECT project_id, direct_id, node, min(level) AS level FROM o_steps WHERE node <> direct_id GROUP BY 1, 2, 3
""",
    "graph_metrics": "SELECT * FROM o_gmetrics",
    "indirect_via": """
SELECT project_id, node AS direct_id, direct_id AS via_id FROM o_pairs WHERE node_direct
""",
    "via_parents": """
SELECT o.project_id, o.node, p.name AS via_name FROM o_pairs o JOIN fx_packages p ON p.package_id = o.direct_id
WHERE NOT node_direct
""",
    "relation_classes": """
SELECT n.project_id, n.node, CASE WHEN n.project_id NOT IN (SELECT project_id FROM fx_edges) THEN 'unknown'
  WHEN d.package_id IS NOT NULL THEN 'direct' ELSE 'transitive' END AS relation
FROM o_nodes n LEFT JOIN fx_direct d ON d.project_id = n.project_id AND d.package_id = n.node
""",
    "dependency_counts": """
SELECT c.c_custkey AS package_id, n.direct_count, n.transitive_count, n.direct_count IS NOT NULL AS has_graph
FROM customer c LEFT JOIN (
  SELECT o.project_id, count(d.package_id) FILTER (WHERE o.project_id IN (SELECT project_id FROM fx_edges)) AS direct_count,
    count(*) - count(d.package_id) FILTER (WHERE o.project_id IN (SELECT project_id FROM fx_edges)) AS transitive_count
  FROM o_nodes o LEFT JOIN fx_direct d ON d.project_id = o.project_id AND d.package_id = o.node GROUP BY 1) n
  ON n.project_id = c.c_custkey
""",
    "total_transitive": """
SELECT o.project_id, count(*) AS total_transitive FROM o_nodes o
WHERE NOT EXISTS (SELECT 1 FROM fx_direct d WHERE d.project_id = o.project_id AND d.package_id = o.node) GROUP BY 1
""",
    "health_risk": """
SELECT package_id, is_eol, is_stalled, health_status, round(health_risk, 9) AS health_risk FROM o_health
""",
    "diet_plan": """
SELECT project_id, rank, purl, ecosystem, scope, round(priority, 9) AS priority, difficulty,
  round(impact, 9) AS graph_impact, round(effort, 9) AS coupling_effort, round(health_risk, 9) AS health_risk,
  exclusive_transitive, total_transitive, is_unused, health_status AS maintenance_status, name, version,
  via_count > 0 AS stays_as_indirect, files AS import_file_count, calls AS call_site_count, api AS api_breadth,
  blank AS has_blank_import, FALSE AS has_dot_import, FALSE AS has_wildcard_import, coalesce(adv, 0) > 0 AS has_vulnerabilities, coalesce(adv, 0) AS vulnerability_count,
  CASE WHEN max_cvss3 > 0 THEN max_cvss3 END AS max_cvss_score, CASE WHEN overall_score > 0 THEN overall_score END AS overall_score
FROM o_plan
""",
    "diet_summary": """
SELECT p.project_id, count(*) AS total_direct, sum(exclusive_transitive) AS exclusive_total,
  sum(is_unused::INT) AS unused_direct, sum((difficulty IN ('trivial', 'easy') AND priority > 0.3)::INT) AS easy_wins,
  sum((priority > 0.2)::INT) AS actionable, sum((via_count > 0)::INT) AS stays_indirect,
  coalesce(max(t.n), 0) AS total_transitive
FROM o_plan p LEFT JOIN (SELECT project_id, count(*) AS n FROM o_nodes o
  WHERE NOT EXISTS (SELECT 1 FROM fx_direct d WHERE d.project_id = o.project_id AND d.package_id = o.node) GROUP BY 1) t
  ON t.project_id = p.project_id GROUP BY p.project_id
""",
    "graph_only_plan": """
SELECT project_id, rank, package_id, round(priority, 9) AS priority, CASE WHEN scope IS NULL THEN 'trivial' ELSE 'easy' END AS difficulty FROM o_graph_plan
""",
    "slot_advisories": "SELECT * FROM o_slot_advisories",
    "transitive_advisories": "SELECT * FROM o_transitive",
    "graph_choice": "SELECT * FROM o_graph_choice",
    "slot_versions": "SELECT * FROM o_slot_versions",
    "scan_from_inputs": f"""
SELECT k.canonical_key, file_id, line_no, k.purl, {_RESULTS}
FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY file_id, line_no) AS n FROM o_keys
  WHERE canonical_key IS NOT NULL AND file_id IN (SELECT file_id FROM o_file_quality WHERE unrecognised_share <= 0.5)) k
LEFT JOIN o_by_key b ON b.canonical_key = k.canonical_key WHERE n = 1
""",
    "scan_from_sbom": f"""
SELECT k.canonical_key, k.project_id, k.purl, k.relation, CASE WHEN relation = 'transitive' THEN v.via END AS via,
  CASE WHEN relation = 'transitive' THEN coalesce(v.n, 0) ELSE 0 END AS via_count, {_RESULTS}
FROM (SELECT DISTINCT n.project_id, n.purl, {_KEY.replace('purl', 'n.purl')} AS canonical_key,
    CASE WHEN n.project_id NOT IN (SELECT project_id FROM o_sbom_direct) THEN 'unknown' WHEN d.purl IS NOT NULL THEN 'direct'
      ELSE 'transitive' END AS relation
  FROM fx_sbom_nodes n LEFT JOIN (SELECT DISTINCT project_id, purl FROM o_sbom_direct) d ON d.project_id = n.project_id AND d.purl = n.purl) k
LEFT JOIN (SELECT project_id, node, min(direct) AS via, count(*) AS n FROM o_sbom_reach WHERE node <> direct GROUP BY 1, 2) v
  ON v.project_id = k.project_id AND v.node = k.purl
LEFT JOIN o_by_key b ON b.canonical_key = k.canonical_key
""",
    "scan_from_gomod": f"""
SELECT k.*, {_RESULTS} FROM (SELECT project_id, purl, 'direct' AS relation, scope, {_KEY} AS canonical_key FROM o_required) k
LEFT JOIN o_by_key b ON b.canonical_key = k.canonical_key
""",
    "scan_from_repos": f"""
SELECT file_id, 'purl' AS source, k.purl AS input, CAST(NULL AS VARCHAR) AS via, {_RESULTS}
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, canonical_key ORDER BY line_no) AS n FROM o_keys
  WHERE canonical_key IS NOT NULL AND file_id IN (SELECT file_id FROM o_file_quality WHERE unrecognised_share <= 0.5)) k
LEFT JOIN o_by_key b ON b.canonical_key = k.canonical_key WHERE n = 1
UNION ALL SELECT file_id, k.source, k.repo_key, k.via, {_RESULTS.replace('b.canonical_key', 'b.package_id').replace('b.transitive_count', '0')}
FROM o_file_repos k LEFT JOIN o_repo_scan b ON b.purl = 'pkg:' || k.repo_key
""",
    "diet_from_sbom": """
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, purl) AS rank, purl, ecosystem, scope,
  round(priority, 9) AS priority, CASE WHEN effort < 1e-9 THEN 'trivial' WHEN effort < 0.25 THEN 'easy' WHEN effort < 0.6 THEN 'moderate'
    ELSE 'hard' END AS difficulty, round(impact, 9) AS graph_impact, round(effort, 9) AS coupling_effort, round(risk, 9) AS health_risk,
  excl AS exclusive_transitive, total AS total_transitive, FALSE AS is_unused, health_status AS maintenance_status, name, version,
  via_count > 0 AS stays_as_indirect, 0 AS import_file_count, 0 AS call_site_count, CASE WHEN scope IS NULL THEN 0 ELSE 1 END AS api_breadth,
  FALSE AS has_blank_import, FALSE AS has_dot_import, FALSE AS has_wildcard_import, coalesce(adv, 0) > 0 AS has_vulnerabilities, coalesce(adv, 0) AS vulnerability_count,
  CASE WHEN max_cvss3 > 0 THEN max_cvss3 END AS max_cvss_score, CASE WHEN overall_score > 0 THEN overall_score END AS overall_score
FROM (SELECT *, CASE WHEN is_eol OR health_status = 'Archived' THEN greatest(p0, 0.1::DOUBLE) ELSE p0 END AS priority FROM (
  SELECT *, impact * risk * greatest(1 - effort, 0.05::DOUBLE) AS p0 FROM (
    SELECT e.*, p.ecosystem, p.name, p.version, h.health_status, h.is_eol, h.adv, h.max_cvss3, h.overall_score,
      coalesce(h.health_risk, 0.5) AS risk, CASE WHEN t.package_id IS NOT NULL THEN 'tool' WHEN p.name = 'postgresql' THEN 'runtime' END AS scope,
      CASE WHEN max_excl = 0 THEN 0.1::DOUBLE ELSE least(0.1::DOUBLE + 0.9::DOUBLE * (excl / max_excl), 1.0::DOUBLE) END AS impact,
      CASE WHEN t.package_id IS NULL AND p.name <> 'postgresql' THEN 0.0::DOUBLE
        ELSE 0.4::DOUBLE * (1 / (1 + exp(4::DOUBLE))) + 0.4::DOUBLE * (1 / (1 + exp(4::DOUBLE))) + 0.2::DOUBLE * (1 / (1 + exp(3.6::DOUBLE))) END AS effort
    FROM o_sbom_entries e JOIN fx_packages p ON p.purl = e.purl LEFT JOIN o_health h ON h.package_id = p.package_id
    LEFT JOIN (SELECT project_id, min(package_id) AS package_id FROM fx_direct GROUP BY 1) t
      ON t.project_id = e.project_id AND t.package_id = p.package_id) a) b) c
""",
    "ordered_distribution": """
SELECT label, reason, packages, percent, bucket, row_number() OVER (ORDER BY size DESC, label, reason IS NOT NULL, packages DESC, reason) AS position
FROM (SELECT *, max(CASE WHEN reason IS NULL THEN packages END) OVER (PARTITION BY label) AS size FROM o_distribution) e
""",
    "ordered_entries": """
SELECT purl, bucket, bucket_place, row_number() OVER (PARTITION BY bucket ORDER BY purl) AS position FROM (
  SELECT purl, b.bucket, b.place AS bucket_place FROM o_scan s JOIN (VALUES ('active', 1), ('stalled', 2), ('eol', 3), ('review', 4), ('other', 5)) b(bucket, place)
    ON b.bucket = CASE WHEN s.label = 'Active' THEN 'active' WHEN s.label = 'Stalled' THEN 'stalled' WHEN s.label LIKE 'EOL-%' THEN 'eol'
      WHEN s.label = 'Review Needed' THEN 'review' ELSE 'other' END) x
""",
    "diet_export": """
SELECT p.project_id, p.rank, p.purl, round(p.priority, 9) AS priority, p.difficulty, p.is_unused, p.files AS import_files, p.calls AS call_sites,
  p.api AS api_breadth, p.blank AS has_blank_import, coalesce(c.has_dot_import, FALSE) AS has_dot_import,
  coalesce(c.has_wildcard_import, FALSE) AS has_wildcard_import, p.health_status AS lifecycle,
  v.shown AS indirect_via, s.shown AS symbols, f.shown AS import_file_names, coalesce(v.n, 0) AS indirect_via_count,
  coalesce(s.n, 0) AS symbols_count, coalesce(f.n, 0) AS import_file_names_count
FROM o_plan_src p LEFT JOIN o_coupling_all c ON c.project_id = p.project_id AND c.package_id = p.package_id
LEFT JOIN (SELECT project_id, node, array_to_string(list_sort(list(DISTINCT name))[1:10], ';') AS shown, count(DISTINCT name) AS n
  FROM (SELECT o.project_id, o.node, p.name FROM o_pairs o JOIN fx_packages p ON p.package_id = o.direct_id WHERE node_direct) x GROUP BY 1, 2) v
  ON v.project_id = p.project_id AND v.node = p.package_id
LEFT JOIN (SELECT project_id, package_id, array_to_string(list_sort(list(DISTINCT symbol))[1:10], ';') AS shown, count(DISTINCT symbol) AS n
  FROM o_pkg_uses_all GROUP BY 1, 2) s ON s.project_id = p.project_id AND s.package_id = p.package_id
LEFT JOIN (SELECT project_id, package_id, array_to_string(list_sort(list(DISTINCT path))[1:10], ';') AS shown, count(DISTINCT path) AS n
  FROM o_matched_all GROUP BY 1, 2) f ON f.project_id = p.project_id AND f.package_id = p.package_id
""",
    "scan_advisories": "SELECT * FROM o_all_metrics",
    "top_advisories": """
SELECT package_id, version, string_agg(advisory_id, ';' ORDER BY pos) FILTER (WHERE pos <= 3) AS top_ids,
  max(cvss3) AS top_cvss3, coalesce(string_agg(DISTINCT dependency_name, ', ' ORDER BY dependency_name) FILTER (WHERE pos <= 3), '')
    AS dependencies, count(*) AS advisory_count, greatest(count(*) - 3, 0) AS more_count
FROM (SELECT *, row_number() OVER (PARTITION BY package_id, version ORDER BY cvss3 DESC, advisory_id) AS pos
  FROM o_all_advisories) a GROUP BY 1, 2
""",
    "advisory_sources": """
SELECT CASE WHEN advisory_id LIKE 'GHSA-%' THEN 'GHSA' WHEN advisory_id LIKE 'CVE-%' THEN 'CVE'
    WHEN advisory_id LIKE 'GO-%' THEN 'OSV' ELSE 'OTHER' END AS source,
  CASE WHEN cvss3 <= 0 THEN NULL WHEN cvss3 < 4 THEN 'LOW' WHEN cvss3 < 7 THEN 'MEDIUM' WHEN cvss3 < 9 THEN 'HIGH'
    ELSE 'CRITICAL' END AS severity, count(*) AS advisories,
  min(CASE WHEN advisory_id LIKE 'GHSA-%' THEN 'https://github.com/advisories/' WHEN advisory_id LIKE 'CVE-%'
    THEN 'https://nvd.nist.gov/vuln/detail/' ELSE 'https://osv.dev/' END || advisory_id) AS first_url
FROM fx_advisories GROUP BY 1, 2
""",
    "eol_text_message": _eol("fx_messages", "package_id", "message"),
    "eol_text_readme": _eol("fx_readmes", "doc_id", "readme"),
    "eol_text_registry": _eol("fx_readmes", "doc_id", "registry"),
    "phrase_hits": " UNION ALL ".join(
        f"SELECT doc_id, '{tier}' AS tier, '{p}' AS phrase FROM fx_readmes WHERE contains(lower(text), '{p}')"
        for tier in ("strong", "reevaluate", "snippet")
        for p in PHRASE_TIERS[tier]
    ),
    "phrase_stats": " UNION ALL ".join(
        [
            f"SELECT '{tier}' AS tier, '{p}' AS phrase, count(*) FILTER (WHERE contains(lower(text), '{p}')) AS documents "
            "FROM fx_readmes"
            for tier, phrases in PHRASE_TIERS.items()
            for p in phrases
        ]
        + [
            f"SELECT 'contextual', '{label}', count(*) FILTER (WHERE regexp_matches(lower(text), '{p}')) FROM fx_readmes"
            for label, p, _ in CONTEXTUAL_PATTERNS
        ]
        + [f"SELECT 'explicit', '{EXPLICIT_LABEL}', count(*) FILTER (WHERE regexp_matches(text, '{README_EXPLICIT}')) FROM fx_readmes"]
    ),
    "npm_successors": "SELECT package_id, nxt AS successor FROM o_npm_next",
    "repo_summaries": r"""
SELECT repo_id AS key, CASE WHEN description IS NOT NULL THEN trim(regexp_replace(description, '\s+', ' ', 'g'))
    ELSE 'Project ' || repo_id END AS summary,
  CASE WHEN description IS NOT NULL THEN regexp_extract(description, '^(.*?\.)(?:\s|$)', 1) END AS first_sentence
FROM fx_repos
""",
    "document_summaries": r"""
SELECT doc_id AS key, CASE WHEN s = '' THEN NULL WHEN length(s) <= 200 THEN s ELSE rtrim(left(s, 199)) || '…' END AS summary
FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS s FROM documents) d
""",
    "normalize_licenses": """
SELECT package_id, slot, position, raw, url, license_id, is_spdx, match_type FROM o_known
""",
    "license_urls": f"SELECT package_id, position, url, {_url_id('url')} AS url_license FROM fx_pom_entries",
    "version_licenses": "SELECT DISTINCT package_id, license_id FROM o_version_ids",
    "license_report": """
SELECT p.purl AS original_purl, p.purl AS effective_purl, l.n > 0 AS version_resolved,
  coalesce(pl.id, '') AS project_license_identifier, coalesce(pl.raw, '') AS project_license_raw,
  src AS project_license_source, sp AS project_license_is_spdx, z AS project_license_is_zero,
  array_to_string(list_transform(vl, lambda x: x.id), ';') AS version_license_identifiers,
  array_to_string(list_transform(vl, lambda x: x.raw), ';') AS version_license_raws,
  array_to_string(list_transform(vl, lambda x: x.src), ';') AS version_license_sources, n AS version_license_count,
  an AS version_licenses_all_non_spdx,
  len(list_filter(vl, lambda x: regexp_matches(upper(x.id), ' AND | OR |[()]')
    OR regexp_matches(upper(x.raw), ' AND | OR |[()]'))) > 0 AS version_licenses_any_composite_expr,
  sp AND n > 0 AND NOT has AS project_vs_version_mismatch, (z OR od) AND (n = 0 OR an)
    AS licenses_all_missing_or_nonstandard, fb AS fallback_applied, src = 'derived-from-version' AS derived_from_version,
  src IN ('github-project-spdx', 'github-project-nonstandard') AS github_override_applied,
  CASE WHEN fb THEN 'fallback_applied' WHEN src = 'derived-from-version' THEN 'derived_from_version'
    WHEN src = 'github-project-spdx' THEN 'github_override_spdx'
    WHEN src = 'github-project-nonstandard' THEN 'github_override_nonstandard'
    WHEN n = 0 THEN CASE WHEN z THEN 'no_project_no_version' WHEN sp THEN 'project_spdx_no_version'
      ELSE 'project_nonstandard_no_version' END
    WHEN z THEN 'versions_only'
    WHEN sp THEN CASE WHEN an THEN 'project_spdx_versions_all_nonspdx_mismatch'
      WHEN has THEN 'project_spdx_version_all_spdx_consistent' ELSE 'project_spdx_version_all_spdx_mismatch' END
    WHEN an THEN 'project_nonstandard_versions_all_nonspdx' ELSE 'project_nonstandard_versions_mixed' END
    AS license_resolution_scenario,
  CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS registry_url, r.repo_url AS repository_url
FROM o_license_flags l JOIN fx_packages p USING (package_id) LEFT JOIN fx_repos r ON r.repo_id = p.repo_id
""",
    "license_disagreements": """
SELECT package_id, settled_spdx, manifest_spdx FROM o_licenses
WHERE settled_spdx IS NOT NULL AND manifest_spdx IS NOT NULL AND lower(settled_spdx) <> lower(manifest_spdx)
""",
    "manifest_licenses": f"""
SELECT package_id, min(position) AS position, id AS identifier, arg_min(raw, position) AS raw,
  CASE WHEN id <> '' THEN 'maven-pom-spdx' ELSE 'maven-pom-nonstandard' END AS source
FROM (SELECT package_id, position, CASE WHEN is_spdx THEN license_id ELSE coalesce({_url_id('url')}, '') END AS id,
    CASE WHEN is_spdx THEN trim(name) WHEN {_url_id('url')} IS NOT NULL THEN trim(url)
      ELSE coalesce(nullif(trim(name), ''), trim(url)) END AS raw
  FROM o_pom_known WHERE coalesce(nullif(trim(name), ''), nullif(trim(url), '')) IS NOT NULL) m
GROUP BY package_id, id, CASE WHEN id = '' THEN raw END
""",
    "license_mentions": "SELECT doc_id, raw, license_id, match_type FROM o_mentions_known WHERE raw <> ''",
    "license_leaves": """
SELECT package_id, raw, CASE WHEN is_spdx THEN license_id END AS license_id, or_later,
  CASE WHEN regexp_matches(expression, '(?i)\\sand(\\s|$)') AND regexp_matches(expression, '(?i)\\sor\\s') THEN 'mixed'
    WHEN regexp_matches(expression, '(?i)\\sand(\\s|$)') THEN 'and' WHEN regexp_matches(expression, '(?i)\\sor\\s') THEN 'or'
    ELSE 'single' END AS operators, match_type FROM o_leaf_known
""",
    "source_imports": """
SELECT i.*, coalesce(CASE WHEN kind = 'normal' THEN u.calls END, 0) AS uses FROM o_imports i LEFT JOIN (
  SELECT project_id, path, alias, sum(calls) AS calls FROM o_alias_uses GROUP BY ALL) u
  ON u.project_id = i.project_id AND u.path = i.path AND u.alias = i.alias
""",
    "source_calls": "SELECT project_id, path, alias, symbol, calls FROM o_alias_uses",
    "candidate_imports": "SELECT package_id, prefix FROM o_candidates",
    "matched_imports": "SELECT project_id, path, import_path, alias, kind, package_id, prefix AS matched_prefix FROM o_matched",
    "coupling_metrics": "SELECT * FROM o_coupling_all",
    "coupling_files": "SELECT DISTINCT project_id, package_id, path FROM o_matched",
    "coupling_symbols": "SELECT DISTINCT project_id, package_id, symbol FROM o_pkg_uses",
    "wheel_import_names": "SELECT * FROM o_wheel_names",
    "pypi_retry": "SELECT project_id, path, import_path, alias, kind, package_id FROM o_retry",
    "diet_from_sources": """
SELECT project_id, rank, package_id, round(priority, 9) AS priority, difficulty, is_unused, files AS import_files,
  calls AS call_sites, api AS api_breadth FROM o_plan_src
""",
    "input_quality": """
SELECT * REPLACE (round(unrecognised_share, 9) AS unrecognised_share), unrecognised_share > 0.5 AS failed FROM o_file_quality
""",
    "input_lines": """
SELECT file_id, line_no, t AS line, kind FROM o_input_kinds WHERE kind <> 'unrecognised'
  AND file_id IN (SELECT file_id FROM o_file_quality WHERE unrecognised_share <= 0.5)
""",
    "input_range": """
SELECT i.file_id, i.line_no, i.t AS line, i.kind FROM o_input_kinds i WHERE line_no BETWEEN 3 AND 14 AND kind <> 'unrecognised'
  AND file_id IN (SELECT file_id FROM o_input_kinds WHERE line_no BETWEEN 3 AND 14 GROUP BY 1
    HAVING avg(CASE WHEN kind = 'unrecognised' THEN 1.0 ELSE 0.0 END) <= 0.5)
""",
    "input_sample": """
SELECT file_id, line_no, line, kind FROM (SELECT file_id, line_no, t AS line, kind, row_number() OVER (
    PARTITION BY kind ORDER BY md5('7/' || file_id || '/' || line_no), file_id, line_no) AS n
  FROM o_input_kinds WHERE kind <> 'unrecognised') k WHERE n <= 25
""",
    "package_keys": "SELECT file_id, line_no, purl, canonical_key, ver AS purl_version FROM o_keys",
    "key_variants": """
SELECT canonical_key, count(*) AS inputs, count(DISTINCT purl) AS spellings, min(purl) AS first_spelling,
  count(DISTINCT ver) AS versions FROM o_keys WHERE canonical_key IS NOT NULL GROUP BY 1
""",
    "dedup_inputs": """
SELECT canonical_key, file_id, line_no, purl FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY file_id, line_no) AS n
  FROM o_keys WHERE canonical_key IS NOT NULL) k WHERE n = 1
""",
    "maven_repair": r"""
SELECT file_id, line_no, purl, CASE WHEN fits THEN regexp_replace(regexp_replace(purl, '%3[aA]', ':'), ':([^:@/]+)(@|$)', '/\1\2')
  ELSE purl END AS repaired, fits AS was_fixed
FROM (SELECT *, purl LIKE 'pkg:maven/%' AND regexp_matches(purl, '^pkg:maven/[^:/@]*\.[^:/@]*(:|%3[aA])[^:/@?#]+([@?#]|$)') AS fits
  FROM o_keys) k
""",
    "maven_repair_stats": r"""
WITH k AS (SELECT purl, regexp_matches(purl, '^pkg:maven/[^:/@]*\.[^:/@]*(:|%3[aA])[^:/@?#]+([@?#]|$)') AS fits FROM o_keys
  WHERE purl LIKE 'pkg:maven/%')
SELECT count(*) AS maven_inputs, count(*) FILTER (WHERE fits) AS fixed, count(*) FILTER (WHERE NOT fits) AS already_canonical
FROM k
""",
    "supported_split": """
SELECT coalesce(kind IN ('npm', 'pypi', 'maven', 'nuget', 'cargo', 'golang', 'gem', 'composer', 'github'), FALSE) AS supported,
  kind AS ecosystem, count(*) AS inputs FROM (SELECT CASE WHEN pth <> '' THEN kind END AS kind FROM o_keys) k GROUP BY 1, 2
""",
    "ecosystem_filter": "SELECT file_id, line_no, purl FROM o_keys WHERE kind = 'npm' AND pth <> ''",
    "repo_groups": """
SELECT repo_key, count(*) AS packages, count(DISTINCT repo_url) AS spellings, min(package_id) AS first_package
FROM o_repo_keys GROUP BY 1
""",
    "repo_choice": """
SELECT package_id, first(url ORDER BY pr, position, url) AS repo_url, first(kind ORDER BY pr, position, url) AS repo_source FROM (
  SELECT c.*, CASE WHEN kind = 'link' AND label = 'SOURCE_REPO' THEN 0 WHEN kind = 'link' THEN 1 WHEN kind = 'related' THEN 2
    WHEN kind = 'registry' THEN 50 ELSE 100 + coalesce(list_position(['repository', 'source', 'source code', 'github', 'code',
      'homepage', 'home', 'project'], lower(label)) - 1, 8) END AS pr
  FROM (SELECT package_id, kind, label, position, regexp_replace(regexp_replace(regexp_replace(
      CASE WHEN raw LIKE 'git+https://%' THEN substr(raw, 5) ELSE raw END, '[#?].*$', ''), '/+$', ''), '\\.git$', '') AS url
    FROM fx_repo_candidates) c WHERE url <> '') x
WHERE pr = 0 OR contains(lower(url), 'github.com/') GROUP BY 1
""",
    "registry_pages": """
SELECT package_id, registry_name,
  CASE ecosystem WHEN 'npm' THEN 'https://www.npmjs.com/package/' || registry_name
    WHEN 'pypi' THEN 'https://pypi.org/project/' || registry_name || '/' WHEN 'gem' THEN 'https://rubygems.org/gems/' || registry_name
    WHEN 'composer' THEN 'https://packagist.org/packages/' || registry_name WHEN 'golang' THEN 'https://pkg.go.dev/' || registry_name
    WHEN 'maven' THEN 'https://central.sonatype.com/artifact/' || namespace || '/' || name
    WHEN 'cargo' THEN 'https://crates.io/crates/' || registry_name
    WHEN 'nuget' THEN 'https://www.nuget.org/packages/' || registry_name END AS registry_url,
  CASE ecosystem WHEN 'npm' THEN 'https://www.npmjs.com/package/' || registry_name || '/v/' || version
    WHEN 'pypi' THEN 'https://pypi.org/project/' || registry_name || '/' || version || '/'
    WHEN 'gem' THEN 'https://rubygems.org/gems/' || registry_name || '/versions/' || version
    WHEN 'golang' THEN 'https://pkg.go.dev/' || registry_name || '@' || version
    WHEN 'maven' THEN 'https://central.sonatype.com/artifact/' || namespace || '/' || name || '/' || version
    WHEN 'cargo' THEN 'https://crates.io/crates/' || registry_name || '/' || version
    WHEN 'nuget' THEN 'https://www.nuget.org/packages/' || registry_name || '/' || version END AS version_url
FROM (SELECT *, CASE WHEN ecosystem = 'maven' THEN namespace || ':' || name WHEN namespace IS NULL THEN name
  ELSE namespace || '/' || name END AS registry_name FROM fx_packages) p
""",
    "package_inference": """
WITH m AS (SELECT repo_key, min(CASE upper(manager) WHEN 'NPM' THEN 'npm' WHEN 'PIP' THEN 'pypi' WHEN 'MAVEN' THEN 'maven'
    WHEN 'RUST' THEN 'cargo' WHEN 'GO' THEN 'golang' WHEN 'COMPOSER' THEN 'composer' END) AS d FROM fx_manifest_managers GROUP BY 1),
l AS (SELECT repo_key, arg_min(language, -bytes * 1000 + ascii(language)) AS lang FROM fx_languages WHERE bytes > 0 GROUP BY 1),
e AS (SELECT r.repo_key, r.owner, r.repo, d, coalesce(d, CASE lang WHEN 'Go' THEN 'golang' WHEN 'Python' THEN 'pypi'
    WHEN 'Java' THEN 'maven' WHEN 'Rust' THEN 'cargo' WHEN 'C#' THEN 'nuget' WHEN 'PHP' THEN 'composer' END, 'npm') AS eco
  FROM fx_repo_names r LEFT JOIN m USING (repo_key) LEFT JOIN l USING (repo_key)),
n AS (SELECT *, 'pkg:' || eco || '/' || CASE WHEN eco = 'golang' THEN 'github.com/' || owner || '/' || repo
    WHEN eco IN ('maven', 'composer', 'github') THEN owner || '/' || repo
    WHEN eco IN ('pypi', 'cargo', 'gem') THEN lower(repo) ELSE repo END AS u FROM e)
SELECT repo_key, eco AS ecosystem, d IS NOT NULL AS from_manifest, CASE WHEN d IS NULL THEN u ELSE lower(u) END AS purl FROM n
""",
    "roundtrip_check": """
SELECT package_id, repo_matches, NOT repo_matches AS repository_only FROM (
  SELECT package_id, CASE WHEN coalesce(resolved_url, '') = '' THEN TRUE WHEN NOT contains(lower(resolved_url), 'github.com') THEN FALSE
    ELSE lower(regexp_replace(regexp_extract(resolved_url, 'github\\.com[:/]+([^/]+/[^/#?]+)', 1), '\\.git$', ''))
      = lower(regexp_extract(input_url, 'github\\.com/([^/]+/[^/]+)', 1)) END AS repo_matches FROM fx_roundtrip) r
""",
    "vanity_repos": """
SELECT package_id, import_path, CASE page_id % 3 WHEN 0 THEN 'https://github.com/owner' || page_id || '/deep'
    ELSE 'https://github.com/src' || page_id || '/tool' END AS repo_url,
  CASE page_id % 3 WHEN 0 THEN 'go-import' ELSE 'go-source' END AS entry FROM fx_vanity WHERE page_id % 3 < 2
""",
    "graph_eligible": """
SELECT package_id, ecosystem, version FROM fx_packages WHERE ecosystem IN ('npm', 'cargo', 'maven', 'pypi') AND version IS NOT NULL
""",
    "sbom_components": "SELECT DISTINCT project_id, purl FROM fx_sbom_nodes",
    "sbom_edges": "SELECT * FROM o_sbom_edges",
    "sbom_direct": "SELECT * FROM o_sbom_direct",
    "aggregator_modules": """
WITH ok AS (SELECT brand FROM o_modules m GROUP BY brand
  HAVING bool_and(EXISTS (SELECT 1 FROM o_module_edges e WHERE e.brand = m.brand AND e.src = m.purl))),
below AS (SELECT DISTINCT e.brand, e.dst AS purl FROM o_module_edges e JOIN ok USING (brand)
  WHERE NOT EXISTS (SELECT 1 FROM o_modules m WHERE m.brand = e.brand AND m.purl = e.dst))
SELECT brand AS project_id, purl FROM below
UNION ALL SELECT brand, purl FROM o_modules WHERE brand NOT IN (SELECT brand FROM below)
""",
    "go_requirements": "SELECT * FROM o_required",
    "workflow_refs": "SELECT * FROM o_workflow_refs",
    "action_closure": """
SELECT project_id AS scope, repo, arg_min(level, level) AS level, first(via ORDER BY level, via) AS via FROM (
  SELECT v.project_id, a.repo, v.level, v.via FROM o_action_via v JOIN o_action a ON a.p = v.node WHERE v.level > 0) x
WHERE NOT EXISTS (SELECT 1 FROM fx_direct d JOIN o_action a ON a.p = d.package_id WHERE d.project_id = x.project_id AND a.repo = x.repo)
GROUP BY 1, 2
""",
    "local_action_uses": """
SELECT DISTINCT project_id AS scope, 'local/one' AS repo, '.github/actions/first' AS via_path FROM fx_direct
UNION ALL SELECT DISTINCT project_id, 'local/two', '.github/actions/second' FROM fx_direct
""",
    "file_formats": r"""
SELECT path, CASE WHEN path LIKE '%/go.mod' OR path LIKE '%/renamed-%' OR regexp_matches(text, '^\s*module\s') THEN 'gomod'
  WHEN path LIKE '%/bom.json' THEN 'sbom' WHEN path LIKE '%/.github/workflows/%' THEN 'workflow' ELSE 'list' END AS format
FROM fx_files
""",
    "source_selection": r"""
SELECT project_id, path, lang FROM (SELECT project_id, lang, CASE length(text) % 6 WHEN 0 THEN 'vendor/' || path
  WHEN 1 THEN 'lib/build/' || path WHEN 2 THEN 'builder/' || path WHEN 3 THEN path || '.txt' ELSE path END AS path FROM fx_sources) s
WHERE NOT regexp_matches(path, '(^|/)(vendor|node_modules|\.git|testdata|__pycache__|build|dist|target)/') AND path NOT LIKE '%.txt'
""",
    "repo_metadata": """
SELECT repo_id, CASE WHEN stars > 0 THEN stars ELSE 7 END AS stars, CASE WHEN forks > 0 THEN forks ELSE 3 END AS forks,
  coalesce(description, 'project ' || repo_id) AS description,
  CASE WHEN repo_id % 2 = 0 THEN 'https://p.example.org' ELSE homepage END AS homepage, default_branch, language FROM fx_repos
""",
    "repo_topics": """
SELECT key AS repo_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ' '),
  lambda t: trim(t)), lambda t: t <> ''))), ';') AS topics FROM fx_topics
""",
    "dependent_counts": """
SELECT p.package_id, p.ecosystem, CASE WHEN (p.package_id * 13) % 7 > 0 THEN (p.package_id * 13) % 7
  WHEN p.ecosystem IN ('gem', 'composer') THEN (p.package_id * 29) % 1000 ELSE 0 END AS dependent_count FROM fx_packages p
""",
    "yanked_versions": """
SELECT l_partkey AS package_id, l_linenumber AS version, bool_or(l_returnflag = 'R' AND l_quantity > 45) OR bool_and(l_linestatus = 'F')
  AS yanked, count(*) AS file_count FROM lineitem GROUP BY 1, 2
""",
    "coverage_report": """
SELECT count(*) AS packages, count(*) FILTER (WHERE r.repo_url IS NULL) AS missing_repository,
  round(avg((r.repo_url IS NULL)::INT), 9) AS missing_repository_share,
  count(*) FILTER (WHERE a.repo_id IS NULL) AS missing_project, round(avg((a.repo_id IS NULL)::INT), 9) AS missing_project_share,
  count(*) FILTER (WHERE s.repo_id IS NULL) AS missing_scorecard, round(avg((s.repo_id IS NULL)::INT), 9) AS missing_scorecard_share
FROM fx_packages p LEFT JOIN fx_repos r ON r.repo_id = p.repo_id LEFT JOIN o_activity a ON a.repo_id = p.repo_id
LEFT JOIN o_scores s ON s.repo_id = p.repo_id
""",
    "missing_inputs": """
SELECT p.package_id AS key, CASE WHEN v.package_id IS NULL AND r.package_id IS NULL THEN 'package not found' END AS error
FROM fx_packages p LEFT JOIN (SELECT DISTINCT package_id FROM fx_versions) v USING (package_id)
LEFT JOIN (SELECT DISTINCT package_id FROM fx_registry) r USING (package_id)
""",
    "not_found": """
SELECT package_id AS key FROM fx_packages WHERE package_id NOT IN (SELECT package_id FROM fx_versions)
""",
    "new_actions": """
SELECT action FROM (SELECT DISTINCT a.action FROM o_action_edges e JOIN o_action a ON a.p = e.dst
  WHERE NOT EXISTS (SELECT 1 FROM fx_direct d WHERE d.package_id = e.dst)) x
UNION ALL SELECT DISTINCT unnest(['local/one', 'local/two/sub']) FROM fx_direct
""",
    "merged_results": """
SELECT coalesce(b.package_id, a.package_id) AS key, CASE WHEN b.package_id IS NOT NULL THEN b.max_v ELSE a.min_v END AS value,
  CASE WHEN b.package_id IS NOT NULL THEN 'second' ELSE 'first' END AS origin
FROM (SELECT package_id, min(version) AS min_v FROM fx_versions GROUP BY 1) a
FULL JOIN (SELECT package_id, max(version) AS max_v FROM fx_advisories GROUP BY 1) b ON a.package_id = b.package_id
""",
    "source_union": """
SELECT purl AS key, 'purl' AS source, CAST(NULL AS VARCHAR) AS via FROM fx_packages
UNION ALL SELECT repo_url, 'repository', NULL FROM fx_repos
UNION ALL SELECT action, 'actions', NULL FROM (SELECT DISTINCT a.action FROM fx_direct d JOIN o_action a ON a.p = d.package_id) x
UNION ALL SELECT repo, 'actions_transitive', min(action) FROM o_action GROUP BY repo
""",
    "distinct_lookup_keys": "SELECT DISTINCT advisory_id FROM fx_advisories",
    "scan_rows": """
SELECT verdict, s.purl, label AS lifecycle_label, reason AS lifecycle_reason, build_label, build_score, eol_successor AS successor,
  adv AS advisory_count, CASE WHEN s.max_cvss3 > 0 THEN s.max_cvss3 END AS max_cvss3,
  CASE WHEN s.max_cvss3 > 0 THEN CASE WHEN s.max_cvss3 < 4 THEN 'LOW' WHEN s.max_cvss3 < 7 THEN 'MEDIUM' WHEN s.max_cvss3 < 9 THEN 'HIGH' ELSE 'CRITICAL' END END AS max_advisory_severity,
  coalesce(m.direct_count, 0) AS direct_advisory_count, coalesce(m.transitive_count, 0) AS transitive_advisory_count,
  CASE WHEN m.max_transitive_cvss3 > 0 THEN m.max_transitive_cvss3 END AS max_transitive_cvss3,
  CASE WHEN m.max_transitive_cvss3 > 0 THEN CASE WHEN m.max_transitive_cvss3 < 4 THEN 'LOW' WHEN m.max_transitive_cvss3 < 7 THEN 'MEDIUM' WHEN m.max_transitive_cvss3 < 9 THEN 'HIGH' ELSE 'CRITICAL' END END AS max_transitive_severity, repo_url, error
FROM o_scan s LEFT JOIN o_all_metrics m ON m.package_id = s.package_id AND m.version = coalesce(s.stable, s.top)
""",
    "scorecard_wide": f"""
WITH c AS (SELECT repo_id, check_name, printf('%.2f', CAST(score AS DOUBLE)) AS t FROM fx_scores)
SELECT s.purl, s.repo_url, 'https://scorecard.dev/viewer/?uri=' || url_encode(s.repo_url) AS scorecard_url,
  'https://api.scorecard.dev/projects/' || s.repo_url AS scorecard_api_url, any_value(CASE WHEN s.version_count IS NULL THEN '' ELSE s.repo_url END) AS release_url,
  printf('%.2f', s.overall_score) AS overall_score,
  {', '.join(f"max(t) FILTER (WHERE check_name = '{c}') AS " + '"' + c + '"' for c in (
      'Binary-Artifacts', 'Branch-Protection', 'CI-Tests', 'CII-Best-Practices', 'Code-Review', 'Contributors',
      'Dangerous-Workflow', 'Dependency-Update-Tool', 'Fuzzing', 'License', 'Maintained', 'Packaging', 'Pinned-Dependencies',
      'SAST', 'Security-Policy', 'Signed-Releases', 'Token-Permissions', 'Vulnerabilities'))},
  any_value(coalesce(s.stable_age, 0)) AS days_since_stable, any_value(coalesce(s.pre_age, 0)) AS days_since_prerelease,
  any_value(CASE WHEN s.stars > 0 THEN s.stars ELSE 7 END) AS stars, any_value(coalesce(s.days_any, 0)) AS days_since_commit,
  any_value(s.dependents) AS dependents, any_value(coalesce(s.direct_deps, 0)) AS direct_deps, any_value(coalesce(s.transitive_deps, 0)) AS transitive_deps,
  any_value(s.archived) AS archived, any_value(s.disabled) AS disabled, any_value(s.fork) AS fork, any_value(coalesce(s.fork_source, '')) AS fork_source,
  any_value(s.label) AS lifecycle_label, any_value(s.reason) AS lifecycle_reason,
  any_value('Archived:' || s.archived || ',Disabled:' || s.disabled) AS repo_state
FROM o_scan_repo s LEFT JOIN c ON c.repo_id = s.repo_id WHERE s.repo_url IS NOT NULL GROUP BY s.package_id, s.purl, s.repo_url, s.overall_score
""",
    "lifecycle_summary": """
SELECT purl, status AS final_status, label AS lifecycle_label, reason AS lifecycle_reason, eol_state, eol_successor,
  CASE eol_state WHEN 'EOL' THEN 'EOL' WHEN 'Scheduled' THEN 'Scheduled EOL' ELSE 'Unknown' END AS eol_human_state,
  eol_scheduled AS scheduled_at, evidence AS eol_evidence, eol_reason AS final_reason, status LIKE 'EOL%' AS is_end_of_life FROM o_scan
""",
    "verdict_filter": "SELECT package_id, verdict FROM o_scan WHERE verdict IN ('replace', 'review')",
    "label_filter": "SELECT package_id, status FROM o_scan WHERE status = 'Review Needed' OR status LIKE 'EOL-%'",
    "fail_policy": """
SELECT d.project_id, bool_or(s.label IN ('EOL-Confirmed', 'EOL-Effective')) AS failed,
  count(*) FILTER (WHERE s.label IN ('EOL-Confirmed', 'EOL-Effective')) AS hits
FROM fx_direct d JOIN o_scan s USING (package_id) GROUP BY 1
""",
    "relation_filter": """
SELECT n.project_id, n.node, CASE WHEN n.project_id NOT IN (SELECT project_id FROM fx_edges) THEN 'unknown' ELSE 'direct' END
  AS relation FROM o_nodes n LEFT JOIN fx_direct d ON d.project_id = n.project_id AND d.package_id = n.node
WHERE n.project_id NOT IN (SELECT project_id FROM fx_edges) OR d.package_id IS NOT NULL
""",
    "workspace_filter": """
SELECT package_id, ecosystem, version FROM (SELECT package_id, ecosystem, CASE package_id % 5 WHEN 0 THEN 'workspace:*'
  WHEN 1 THEN 'link:../x' WHEN 2 THEN '0.0.0-use.local' WHEN 3 THEN 'file:./y' ELSE version END AS version FROM fx_packages) p
WHERE ecosystem <> 'npm' OR package_id % 5 = 4
""",
    "success_flags": """
SELECT s.package_id, s.error IS NULL AND (coalesce(n.c, 0) > 0 OR s.label <> '') AS successful FROM o_scan s
JOIN fx_packages p USING (package_id) LEFT JOIN (SELECT repo_id, count(*) AS c FROM fx_scores GROUP BY 1) n
  ON n.repo_id = p.repo_id
""",
    "final_reasons": """
SELECT package_id, coalesce(c.reason, h.reason) AS reason FROM (
  SELECT package_id, first(summary ORDER BY (source = 'HumanCatalog') DESC, confidence DESC, position) AS reason FROM fx_evidence
  GROUP BY 1) h FULL JOIN (SELECT package_id, reason FROM fx_registry WHERE source = 'catalog') c USING (package_id)
""",
    "project_scan": """
SELECT d.project_id, count(*) AS total, count(*) FILTER (WHERE verdict = 'ok') AS ok_count,
  count(*) FILTER (WHERE verdict = 'caution') AS caution_count, count(*) FILTER (WHERE verdict = 'replace') AS replace_count,
  count(*) FILTER (WHERE verdict = 'review') AS review_count, count(*) FILTER (WHERE build_label = 'Hardened') AS hardened_count,
  count(*) FILTER (WHERE build_label = 'Moderate') AS moderate_count, count(*) FILTER (WHERE build_label = 'Weak') AS weak_count,
  count(*) FILTER (WHERE build_label = 'Ungraded') AS ungraded_count
FROM fx_direct d JOIN o_scan s USING (package_id) GROUP BY 1
""",
    "archived_by_check": """
SELECT repo_id, reason FROM fx_scores WHERE check_name = 'Maintained' AND reason LIKE 'Project is archived%'
""",
    "vanity_entries": """
SELECT page_id, 'go-import' AS kind, ahead AS position, 'go.v.org' AS prefix, 'https://github.com/owner' || page_id || '/root' AS repo_url
FROM o_marked_pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'go-import', ahead + 1, 'go.v.org/x' || page_id, 'https://github.com/owner' || page_id || '/deep'
FROM o_marked_pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'go-source', ahead + 1, 'go.v.org', 'https://github.com/src' || page_id || '/tool'
FROM o_marked_pages WHERE page_id % 3 = 1
""",
    "lifecycle_signals": """
SELECT package_id, rule AS lifecycle_rule, position, name, value, CASE WHEN value IS NULL THEN 'absent' ELSE 'used' END AS role FROM (
  SELECT s.package_id, n.rule, s.position, sig AS name, CASE sig
    WHEN 'eol_source' THEN CASE WHEN s.eol_state = 'Scheduled' THEN 'scheduled' ELSE lower(e.eol_source) END
    WHEN 'eol_scheduled_date' THEN s.eol_scheduled WHEN 'repo_archived' THEN CASE WHEN archived THEN 'true' END
    WHEN 'repo_disabled' THEN CASE WHEN disabled THEN 'true' END
    WHEN 'last_human_commit' THEN strftime(latest_human, '%Y-%m-%d')
    WHEN 'maintained_score' THEN CASE WHEN maint >= 0 THEN maint || '/10' END
    WHEN 'recent_stable_release' THEN 'true' WHEN 'recent_pre_release' THEN 'true'
    WHEN 'ecosystem_delivery' THEN 'vcs-direct' WHEN 'advisory_count' THEN CAST(adv AS VARCHAR)
    WHEN 'max_advisory_severity' THEN CASE WHEN max_cvss3 > 0 THEN CASE WHEN max_cvss3 < 4 THEN 'LOW' WHEN max_cvss3 < 7
      THEN 'MEDIUM' WHEN max_cvss3 < 9 THEN 'HIGH' ELSE 'CRITICAL' END || ' ' || printf('%.1f', max_cvss3) END
    WHEN 'days_since_release' THEN CAST(pub AS VARCHAR) END AS value
  FROM o_signal_names s JOIN o_rule_names n USING (rule_no) LEFT JOIN o_eol e ON e.package_id = s.package_id) x
WHERE value IS NOT NULL OR name NOT IN ('eol_scheduled_date', 'repo_archived', 'repo_disabled', 'max_advisory_severity')
""",
}


def statement(name: str) -> str:
    """The query with its helper tables in front; a query's own WITH list continues theirs."""
    body = SQL[name].strip()
    own = body[5:].lstrip() if body.upper().startswith("WITH ") else None
    if own is None:
        return duckdb_ctes(body, PARTS)
    full = duckdb_ctes(own, PARTS)
    return full[: -len(own)].rstrip() + ",\n" + own


def all_statements() -> dict[str, str]:
    return {name: statement(name) for name in SQL}
