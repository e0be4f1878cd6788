from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from depvital.functions.purl import purl_struct, repair_maven, versionless
from depvital.functions.repo_urls import github_owner_repo, is_github_input, normalize_repo_url, repo_key
from depvital.operators import keys
from depvital.operators.prefixes import longest_prefix_join
from depvital.sources.inputs import parse_line_range


def values(spark, rows, expression):
    df = spark.createDataFrame([(r,) for r in rows], "v STRING")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_purl_parts(spark):
    rows = ["pkg:npm/%40scope/x@1.0", "pkg:npm/@scope/x@1", "pkg:npm/@scope/x", "pkg:maven/org.a/b@1?type=jar#sub",
            "pkg:golang/github.com/O/R/v2@v2.1.0", "PKG:x/y", "pkg:gem/", "pkg:NPM/React", "pkg:pypi/a%2Bb@1%2B2"]
    got = [tuple(r) if r else None for r in values(spark, rows, purl_struct)]
    assert got == [("npm", "@scope", "x", "1.0"), ("npm", "@scope", "x", "1"), ("npm", "@scope", "x", None),
                   ("maven", "org.a", "b", "1"), ("golang", "github.com/O/R", "v2", "v2.1.0"), None, None,
                   ("npm", None, "React", None), ("pypi", None, "a+b", "1+2")]


def test_versionless(spark):
    got = values(spark, ["pkg:npm/React@18.3.1", "pkg:gem/Rails@7.0?key=val", "pkg:npm/@s/x", "pkg:npm/@s/x@2"], versionless)
    assert got == ["pkg:npm/React", "pkg:gem/Rails?key=val", "pkg:npm/@s/x", "pkg:npm/@s/x"]


def test_maven_repair(spark):
    rows = ["pkg:maven/org.slf4j:slf4j-api@1.7.36", "pkg:maven/org.slf4j%3Aslf4j-api@1", "pkg:maven/slf4j:api@1",
            "pkg:maven/org.a/b@1", "pkg:maven/org.a:b:c@1", "pkg:npm/a:b", "pkg:maven/org.a:b?x=1"]
    assert values(spark, rows, repair_maven) == [
        "pkg:maven/org.slf4j/slf4j-api@1.7.36", "pkg:maven/org.slf4j/slf4j-api@1", "pkg:maven/slf4j:api@1",
        "pkg:maven/org.a/b@1", "pkg:maven/org.a:b:c@1", "pkg:npm/a:b", "pkg:maven/org.a/b?x=1"]


SPELLINGS = ["https://github.com/Own/Rep", "git+https://github.com/Own/Rep.git#v1", "git+ssh://git@github.com/Own/Rep.git",
             "ssh://git@github.com:Own/Rep", "git@github.com:Own/Rep.git", "git://github.com/Own/Rep/", "github:Own/Rep#main",
             "https://github.com/Own/Rep.git/?x=1"]


def test_repository_spellings(spark):
    assert set(values(spark, SPELLINGS, normalize_repo_url)) == {"https://github.com/Own/Rep"}
    assert set(values(spark, SPELLINGS + ["https://github.com/own/rep/tree/main"], repo_key)) == {"github.com/own/rep"}
    got = values(spark, ["https://gitbox.apache.org/repos/asf?p=kafka.git;a=summary",
                         "https://git-wip-us.apache.org/repos/asf/hive.git", "https://gitlab.com/a/b.git"], repo_key)
    assert got == ["github.com/apache/kafka", "github.com/apache/hive", "https://gitlab.com/a/b"]
    pairs = values(spark, SPELLINGS + ["Own/Rep", "github.com/Own/Rep/x"], github_owner_repo)
    assert {tuple(p) for p in pairs} == {("Own", "Rep")}
    assert values(spark, ["pkg:npm/a", "https://gitlab.com/a/b", "single", ""], github_owner_repo) == [None] * 4


def test_input_lines(spark):
    rows = ["https://github.com/a/b", "https://github.com/a", "github.com/a/b/c", "a/b", "a/b/c", "a@x/b", "text"]
    assert values(spark, rows, is_github_input) == [True, False, True, True, False, False, False]
    assert parse_line_range("3:9") == (3, 9) and parse_line_range(" 2: ") == (2, None)
    for bad in ("5", "0:3", "4:2", ":3", "a:b"):
        with pytest.raises(ValueError):
            parse_line_range(bad)


def test_longest_prefix(spark):
    left = spark.createDataFrame([(1, "ex.com/Foo/bar/x"), (1, "ex.com/foobar"), (1, "none/x"), (2, "ex.com/foo")],
                                 "project_id BIGINT, path STRING")
    right = spark.createDataFrame([(1, "ex.com/foo", "a"), (1, "ex.com/foo/bar", "b"), (1, "ex.com/foo/bar", "c"), (2, "ex.com/foo", "d")],
                                  "project_id BIGINT, prefix STRING, pkg STRING")
    got = {(r.project_id, r.path, r.pkg) for r in longest_prefix_join(left, right, "path", "/").collect()}
    assert got == {(1, "ex.com/Foo/bar/x", "b"), (1, "ex.com/Foo/bar/x", "c"), (2, "ex.com/foo", "d")}


def test_repo_choice(spark):
    rows = [(1, "link", "HOMEPAGE", 0, "https://github.com/a/home"), (1, "link", "SOURCE_REPO", 1, "https://git.x.org/a.git"),
            (2, "link", "HOMEPAGE", 0, "https://docs.org/x"), (2, "related", "", 0, "https://github.com/r/r"),
            (3, "pypi", "Homepage", 0, "https://github.com/h/h"), (3, "pypi", "Source", 1, "https://github.com/s/s"),
            (4, "link", "HOMEPAGE", 0, "https://docs.org/x")]
    got = keys.choose_repo(spark.createDataFrame(rows, "package_id BIGINT, kind STRING, label STRING, position INT, url STRING"))
    assert {r.package_id: r.repo_url for r in got.collect()} == {
        1: "https://git.x.org/a", 2: "https://github.com/r/r", 3: "https://github.com/s/s"}


def test_sample_and_dedup(spark):
    rows = [(f"p{i}", "package" if i % 2 else "repository") for i in range(40)]
    df = spark.createDataFrame(rows, "line STRING, kind STRING")
    assert keys.sample_inputs(df, 5, 1, ["line"]).groupBy("kind").count().where("count = 5").count() == 2
    assert keys.sample_inputs(df, 100, 1, ["line"]).count() == 40
    lines = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("j", 2, "b")], "key STRING, line_no INT, text STRING")
    assert {tuple(r) for r in keys.dedup_inputs(lines, "key", "line_no").collect()} == {("k", 1, "a"), ("j", 2, "b")}
