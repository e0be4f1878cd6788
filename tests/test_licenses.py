from __future__ import annotations

from pyspark.sql import functions as F

from depvital.functions.spdx import CORE_IDS, URL_LICENSES, core_spdx, dictionary, license_of_url
from depvital.operators import licenses

FACTS = (
    "package_id BIGINT, project_raw STRING, github_spdx STRING, github_name STRING, version_spdx ARRAY<STRING>, "
    "version_raw ARRAY<STRING>, manifest ARRAY<STRUCT<name: STRING, url: STRING>>, requested_known BOOLEAN"
)


def test_spellings(spark):
    rows = [("MIT", "MIT", "exact"), ("mit", "MIT", "case-fold"), ("Apache License 2.0", "Apache-2.0", "alias"),
            ("apache 2.0", "Apache-2.0", "alias"), ("BSD3Clause", "BSD-3-Clause", "alias"), ("NOASSERTION", "NOASSERTION", "no-assertion"),
            ("Custom  License", "Custom-License", "heuristic"), ("  ", None, "none"), ("gpl_2.0_only", "GPL-2.0-only", "alias"),
            ("Mozilla Public License 2.0", "MPL-2.0", "alias")]
    df = spark.createDataFrame(rows, "raw STRING, want STRING, kind STRING")
    for r in licenses.normalize_licenses(df, core_spdx(spark)).collect():
        assert (r.license_id, r.match_type) == (r.want, r.kind), r
    assert len(CORE_IDS) == len(set(CORE_IDS)) < 200
    keys = dictionary(core_spdx(spark))
    assert keys.count() == keys.select("key").distinct().count()


def test_addresses(spark):
    rows = [("https://www.apache.org/licenses/LICENSE-2.0.txt", "Apache-2.0"), ("http://opensource.org/licenses/MIT/", "MIT"),
            ("mit-license.org", "MIT"), ("https://www.gnu.org:443/licenses/gpl.html#x", "GPL-3.0-only"), ("https://example.org/", None), ("", None)]
    df = spark.createDataFrame(rows, "url STRING, want STRING")
    got = df.select("want", license_of_url(F.col("url")).alias("id")).collect()
    assert all(r.want == r.id for r in got) and len(URL_LICENSES) == 42


def resolve(spark, *facts):
    rows = [(i, *f) for i, f in enumerate(facts)]
    out = licenses.resolve_licenses(spark.createDataFrame(rows, FACTS), core_spdx(spark)).collect()
    by_id = {r.package_id: r for r in out}
    return [(by_id[i].project_license, by_id[i].version_licenses) for i in range(len(facts))]


def test_resolution(spark):
    got = resolve(
        spark,
        ("MIT", None, None, None, None, None, True),  # silent version takes the project's
        (None, None, None, ["ISC"], None, None, True),  # silent project takes the only one
        ("custom", None, None, ["ISC", "MIT"], None, None, True),  # two licences: no promotion
        ("MIT", None, None, None, ["weird words"], None, True),  # unrecognised version replaced
        (None, "NOASSERTION", "Apache License 2.0", None, None, None, False),
        ("non-standard", None, "Strange", None, None, None, False),
        ("MIT", "GPL-3.0-only", None, None, None, [("GPL-3.0-only", None)], False),
        (None, None, None, None, None, [("My own", "https://x.org"), (None, "https://opensource.org/licenses/MIT")], False),
        (None, None, None, ["MIT", "mit"], ["ISC"], None, True),
        (None, None, None, None, None, None, True),
    )
    assert got[0][0].source == "depsdev-project-spdx" and got[0][1][0].source == "project-fallback"
    assert got[1][0].source == "derived-from-version" and got[1][0].identifier == "ISC"
    assert got[2][0].source == "depsdev-project-nonstandard" and [v.identifier for v in got[2][1]] == ["ISC", "MIT"]
    assert [v.source for v in got[3][1]] == ["project-fallback"]
    assert got[4][0].identifier == "Apache-2.0" and got[4][0].source == "github-project-spdx" and got[4][1] == []
    assert got[5][0].raw == "Strange" and got[5][0].source == "github-project-nonstandard"
    assert got[6][0].identifier == "MIT" and [v.identifier for v in got[6][1]] == ["GPL-3.0-only"]
    assert got[7][0].identifier == "MIT" and [v.raw for v in got[7][1]] == ["My own", "https://opensource.org/licenses/MIT"]
    assert [v.identifier for v in got[8][1]] == ["MIT"]
    assert got[9] == (None, [])


def test_scenarios(spark):
    names = ("_fallback", "_derived", "_github", "_zero", "_spdx", "_odd", "_count", "_all_non", "_has", "_mismatch")
    base = dict.fromkeys(names, False) | {"_count": 0}
    cases = [
        ({"_fallback": True, "_derived": True}, "fallback_applied"), ({"_derived": True}, "derived_from_version"),
        ({"_github": True, "_spdx": True}, "github_override_spdx"), ({"_github": True, "_odd": True}, "github_override_nonstandard"),
        ({"_zero": True}, "no_project_no_version"), ({"_spdx": True}, "project_spdx_no_version"),
        ({"_odd": True}, "project_nonstandard_no_version"), ({}, "project_other_no_version"),
        ({"_count": 1}, "project_other_with_versions"), ({"_zero": True, "_count": 1}, "versions_only"),
        ({"_spdx": True, "_count": 1, "_has": True}, "project_spdx_version_all_spdx_consistent"),
        ({"_spdx": True, "_count": 1, "_mismatch": True}, "project_spdx_version_all_spdx_mismatch"),
        ({"_spdx": True, "_count": 1, "_all_non": True}, "project_spdx_versions_all_nonspdx"),
        ({"_spdx": True, "_count": 1, "_all_non": True, "_mismatch": True}, "project_spdx_versions_all_nonspdx_mismatch"),
        ({"_odd": True, "_count": 1}, "project_nonstandard_versions_mixed"),
        ({"_odd": True, "_count": 1, "_all_non": True}, "project_nonstandard_versions_all_nonspdx"),
        ({"_spdx": True, "_count": 1}, "catch_all"),
    ]
    rows = [tuple((base | c)[n] for n in names) + (want,) for c, want in cases]
    schema = ", ".join(f"{n} {'INT' if n == '_count' else 'BOOLEAN'}" for n in names) + ", want STRING"
    got = spark.createDataFrame(rows, schema).select("want", licenses.license_scenario().alias("s")).collect()
    assert [r.want for r in got] == [r.s for r in got] and len({r.s for r in got}) == 17


def leaves(spark, text):
    df = spark.createDataFrame([(1, text)], "package_id BIGINT, expression STRING")
    rows = licenses.license_leaves(df, core_spdx(spark)).orderBy("position").collect()
    return [(r.raw, r.license_id, r.or_later, r.exception) for r in rows], (rows[0].operators if rows else None)


def test_expressions(spark):
    assert leaves(spark, "MIT") == ([("MIT", "MIT", False, None)], "single")
    assert leaves(spark, "GPL-2.0+ WITH Classpath-exception-2.0")[0] == [("GPL-2.0+", "GPL-2.0", True, "Classpath-exception-2.0")]
    got, mix = leaves(spark, "(MIT OR Apache License 2.0) WITH X and ISC")
    assert got == [("MIT", "MIT", False, "X"), ("Apache License 2.0", "Apache-2.0", False, "X"), ("ISC", "ISC", False, None)]
    assert mix == "mixed"
    got, _ = leaves(spark, "((MIT WITH Own OR ISC) AND Zlib) WITH Outer OR BSL-1.0")
    assert got == [("MIT", "MIT", False, "Own"), ("ISC", "ISC", False, "Outer"), ("Zlib", "Zlib", False, "Outer"),
                   ("BSL-1.0", "BSL-1.0", False, None)]
    assert leaves(spark, "MIT AND (")[0] == [("MIT", "MIT", False, None)]
    assert leaves(spark, "OR MIT OR")[0] == [("MIT", "MIT", False, None)]
    assert leaves(spark, "OR-tools License")[0] == [("OR-tools License", None, False, None)]
    assert leaves(spark, "X++")[0] == [("X++", None, False, None)]
    assert leaves(spark, "  ") == ([], None)


def test_manifests(spark):
    entries = spark.createDataFrame(
        [(1, 0, "${lic}", None), (1, 1, "The MIT thing", "${base}/licenses/MIT"), (1, 2, "${unknown}", None), (1, 3, None, " "),
         (2, 0, None, "https://unlicense.org/")], "package_id BIGINT, position INT, name STRING, url STRING")
    properties = spark.createDataFrame(
        [(1, "lic", "${real}"), (1, "real", "Apache 2.0"), (1, "base", "https://opensource.org")], "package_id BIGINT, key STRING, value STRING")
    got = licenses.manifest_licenses(entries, properties, core_spdx(spark))
    assert {(r.package_id, r.position, r.identifier, r.raw) for r in got.collect()} == {
        (1, 0, "Apache-2.0", "Apache 2.0"), (1, 1, "MIT", "https://opensource.org/licenses/MIT"), (1, 2, "", "${unknown}"),
        (2, 0, "Unlicense", "https://unlicense.org/")}


def test_properties_expand_to_the_end(spark):
    chain = [(1, f"k{i}", f"${{k{i + 1}}}") for i in range(8)] + [(1, "k8", "MIT")]
    loops = [(1, "a", "x${b}"), (1, "b", "${a}${a}"), (1, "own", "${project.version}-${pom.artifactId}"), (1, "twice", "old"), (1, "twice", "new")]
    rows = [(*r, i) for i, r in enumerate(chain + loops)]
    properties = spark.createDataFrame(rows, "package_id BIGINT, key STRING, value STRING, position INT")
    packages = spark.createDataFrame([(1, "g", "n", "1.2")], "package_id BIGINT, namespace STRING, name STRING, version STRING")
    names = ["${k0}", "${a}", "${own}", "${twice}", "${unknown}"]
    entries = spark.createDataFrame([(1, i, n, "") for i, n in enumerate(names)], "package_id BIGINT, position INT, name STRING, url STRING")
    got = {r.position: r.name for r in licenses.expand_properties(entries, properties, packages=packages).collect()}
    assert got == {0: "MIT", 1: "${a}", 2: "1.2-n", 3: "new", 4: "${unknown}"}
