from __future__ import annotations

import json

from pyspark.sql import functions as F

from depvital.operators import graph, reports
from depvital.sources import files, inputs, manifests, sbom, sinks

GOMOD = '''// header
module example.com/app

require (
	ex.com/a v1.0.0
	ex.com/b v1.1.0 // indirect
	ex.com/tool v0.1.0
	ex.com/tool/sub v0.2.0 // indirect
)
require ex.com/c v2.0.0
replace ex.com/a => ex.com/fork v1.5.0
replace (
	ex.com/c v2.0.0 => ../local
)
tool ex.com/tool/cmd/run
tool ex.com/tool/sub/cmd
'''
WORKFLOW = '''on: push
jobs:
  b:
    uses: org/reusable/.github/workflows/x.yml@main
    steps:
      - uses: actions/checkout@v4 # pinned
      - uses: "actions/cache/save@abc"
      - uses: actions/checkout@v3
      - uses: docker://alpine
      - uses: ./.github/actions/own/
      - uses: ./../escape
      - uses: ./a/../../b
'''


def test_go_manifest(spark):
    df = spark.createDataFrame([(1, GOMOD)], "project_id BIGINT, text STRING")
    got = {r.module: (r.purl, r.scope) for r in manifests.read_go_manifests(df).collect()}
    assert got == {"ex.com/a": ("pkg:golang/ex.com/fork@v1.5.0", None), "ex.com/c": ("pkg:golang/ex.com/c@v2.0.0", None),
                   "ex.com/tool": ("pkg:golang/ex.com/tool@v0.1.0", "tool")}


def test_workflow(spark):
    rows = [("r", ".github/workflows/ci.yml", WORKFLOW), ("r", "x/action.yml", "runs:\n  using: node20\n  steps:\n    - uses: a/b@v1\n"),
            ("r", "y/action.yaml", "runs:\n  using: 'Composite'\n  steps:\n    - uses: a/b@v1\n")]
    got = manifests.read_workflow_refs(spark.createDataFrame(rows, "scope STRING, path STRING, text STRING")).collect()
    first = {(r.kind, r.action, r.local_path) for r in got if r.path == ".github/workflows/ci.yml"}
    assert first == {("remote", "org/reusable/.github/workflows/x.yml", None), ("remote", "actions/checkout", None),
                     ("remote", "actions/cache/save", None), ("local", None, ".github/actions/own")}
    assert [r.path for r in got if r.action == "a/b"] == ["y/action.yaml"]


def test_sbom_nesting(spark):
    inner = {"bom-ref": "d", "purl": "pkg:npm/d@1"}
    for i in range(3):
        inner = {"bom-ref": f"w{i}", "components": [inner]}
    bom = {
        "bomFormat": "CycloneDX",
        "metadata": {"component": {"bom-ref": "root", "purl": "pkg:npm/app@1?x=1"}},
        "components": [{"bom-ref": "a", "purl": "pkg:npm/a@1?q=2"}, {"bom-ref": "a2", "purl": "pkg:npm/a@1"}, inner,
                       {"bom-ref": "bad", "purl": "nonsense", "components": [{"bom-ref": "h", "purl": "pkg:npm/hidden@1"}]}],
        "dependencies": [{"ref": "root", "dependsOn": ["a", "gone"]}, {"ref": "pkg:npm/a@1?q=2", "dependsOn": ["d"]}, {"ref": "d"}],
    }
    df = spark.createDataFrame([(1, json.dumps(bom)), (2, "not json"), (3, "{}")], "project_id BIGINT, text STRING")
    components, dependencies, roots = sbom.read_sboms(df)
    assert {r.purl for r in sbom.unique_components(components).collect()} == {"pkg:npm/a@1", "pkg:npm/d@1"}
    assert max(r.depth for r in components.collect()) == 3
    refs = sbom.reference_map(components)
    assert {(r.src, r.dst) for r in graph.sbom_edges(refs, dependencies).collect()} == {("pkg:npm/a@1", "pkg:npm/d@1")}
    assert {r.purl for r in graph.direct_deps(refs, dependencies, roots).collect()} == {"pkg:npm/a@1"}
    assert [(r.root_ref, r.root_purl) for r in roots.collect()] == [("root", "pkg:npm/app@1")]


def test_files_and_lists(spark, tmp_path):
    for path, text in {
        "p1/go.mod": GOMOD, "p1/.github/workflows/ci.yml": WORKFLOW, "p1/bom.json": '{"bomFormat": "CycloneDX"}', "p1/x.json": "{}",
        "p1/src/a.go": "package a", "p1/vendor/b.go": "package b", "p1/src/big.py": "#" * (2 << 20), "p1/.github/actions/x/action.yml": "runs: {using: composite}",
        "p2/long.json": " " * 600 + '{"bomFormat": "CycloneDX"}', "p2/other.mod": "// note\n" * 100 + "module ex.com/m\n",
        "p2/src/x.tsx": "let x", "p2/list.txt": "pkg:npm/a@1\n\n# note\r\nowner/repo\njunk\n",
    }.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    routed = files.route_files(files.read_texts(spark, str(tmp_path)))
    got = {r.path.split(str(tmp_path) + "/")[1]: r.format for r in routed.collect()}
    assert got["p1/go.mod"] == "gomod" and got["p1/bom.json"] == "sbom" and got["p1/x.json"] == "list"
    assert got["p2/long.json"] == "sbom" and got["p2/other.mod"] == "gomod"
    found = files.route_files(files.read_workflows(spark, str(tmp_path))).collect()
    assert {(r.scope, r.path) for r in found} == {("p1", ".github/workflows/ci.yml"), ("p1", ".github/actions/x/action.yml")}
    assert {r.format for r in found if r.path.endswith("ci.yml")} == {"workflow"}
    sources = {(r.project_id, r.path, r.lang) for r in files.read_sources(spark, str(tmp_path)).collect()}
    assert sources == {("p1", "p1/src/a.go", "go"), ("p1", "p1/src/big.py", "python"), ("p2", "p2/src/x.tsx", "typescript")}
    lines = inputs.read_lines(spark, str(tmp_path / "p2" / "list.txt")).withColumn("file_id", F.lit(1))
    kept, quality = inputs.read_inputs(lines)
    assert {(r.line_no, r.line, r.kind) for r in kept.collect()} == {(1, "pkg:npm/a@1", "package"), (4, "owner/repo", "repository")}
    assert quality.first().failed is False
    assert inputs.read_inputs(lines, line_range="5:")[1].first().failed is True
    out = str(tmp_path / "out")
    sinks.write_csv(kept, out + "/csv", ["line_no"])
    sinks.write_json(kept.withColumn("none", F.lit(None).cast("string")), out + "/json")
    assert spark.read.option("header", True).csv(out + "/csv").count() == 2
    assert "none" not in spark.read.json(out + "/json").columns


def test_result_joins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "key STRING, v INT")
    b = spark.createDataFrame([("y", 9), ("z", None)], "key STRING, v INT")
    assert {tuple(r) for r in reports.merge_results(a, b).collect()} == {("x", 1), ("y", 9), ("z", None)}
    marked = reports.mark_missing(a, b.where("key = 'none'"), b)
    assert {r.key: r.error for r in marked.collect()} == {"x": "package not found", "y": None}
    assert reports.not_found(a, b).count() == 1
    union = reports.union_sources(one=a, two=b.withColumn("via", F.lit("w")))
    assert union.where("source = 'one' AND via IS NULL").count() == 2
    named = a.withColumnRenamed("key", "action")
    assert reports.new_actions_only(named.unionByName(named), b.withColumnRenamed("key", "action")).count() == 1


def test_last_replacement_counts(spark):
    text = """module m
require (
	a/x v1.0.0
	a/y v1.0.0
	a/z v1.0.0
)
replace a/x => b/y v2.0.0
replace a/x v1.0.0 => ../local
replace (
	a/y => c/first v9.0.0
	a/y => c/last v1.1.0
)
replace a/z => d/block v3.0.0
"""
    got = manifests.read_go_manifests(spark.createDataFrame([(1, text)], "project_id BIGINT, text STRING")).collect()
    assert {r.module: r.purl for r in got} == {"a/x": "pkg:golang/a/x@v1.0.0", "a/y": "pkg:golang/c/last@v1.1.0", "a/z": "pkg:golang/d/block@v3.0.0"}


def test_uses_is_a_key_of_jobs_and_steps(spark):
    text = """on: push
jobs:
  a:
    steps:
      - run: |
          uses: not/run@v1
          - uses: not/run2@v1

      - { name: x, uses: flow/map@v1 }
      - 'uses': quoted/key@v2
      - name: y
        with:
          uses: not/input@v1
        uses: after/with@v3
      - run: >-
          text
        uses: after/run@v1
      - uses: own/r@v2
      - uses: own/r@v1
  b: {uses: "re/use/.github/workflows/x.yml@main"}
"""
    rows = spark.createDataFrame([("r", ".github/workflows/ci.yml", text)], "scope STRING, path STRING, text STRING")
    got = {(r.action, r.ref) for r in manifests.read_workflow_refs(rows).collect()}
    assert got == {("flow/map", "v1"), ("quoted/key", "v2"), ("after/with", "v3"), ("after/run", "v1"), ("own/r", "v1"),
                   ("re/use/.github/workflows/x.yml", "main")}


def test_deep_components_and_repeated_refs(spark):
    inner = {"bom-ref": "deep", "purl": "pkg:npm/deep@1"}
    for i in range(12):
        inner = {"bom-ref": f"w{i}", "components": [inner]}
    bom = {"components": [{"bom-ref": "same", "purl": "pkg:npm/first@1", "components": [{"bom-ref": "same", "purl": "pkg:npm/nested@1"}]}, inner,
                          {"bom-ref": "same", "purl": "pkg:npm/last@1"}]}
    components = sbom.read_sboms(spark.createDataFrame([(1, json.dumps(bom))], "project_id BIGINT, text STRING"))[0]
    refs = {r.ref: r.purl for r in sbom.reference_map(components).collect()}
    assert refs["same"] == "pkg:npm/last@1" and refs["deep"] == "pkg:npm/deep@1"


def test_lines_of_a_split_file_are_numbered_whole(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 7), ("empty.txt", 0)):
        (tmp_path / name).write_bytes(b"".join(b"line %d\r\n" % i if i % 2 else b"line %d\n" % i for i in range(1, n + 1)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = inputs.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 20
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    assert len(rows) == 3007 and all(r.line == f"line {r.line_no}" for r in rows)
    assert sum(r.path.endswith("/a.txt") for r in rows) == 3000


def test_references_are_read_once_and_dealt_by_repository(spark, capsys):
    text = "using: composite\nsteps:\n- uses: docker://a/b\n- uses: ./../out\n- uses: ./x/../y//\n- uses: own/r/sub/@v2\n- uses: own/r/sub@v1\n- uses: '@v1'\n- uses: a//b@v1\n"
    files_ = [("r", "p/action.yml", text), ("r", "p/action.yml", text), (None, "p/action.yml", text), ("r", "q/action.yml", None)]
    refs = manifests.read_workflow_refs(spark.createDataFrame(files_, "scope STRING, path STRING, text STRING"))
    found = [(s, "p/action.yml", *rest) for s in ("r", None) for rest in (("remote", "own/r/sub", "v1", None), ("local", None, None, "y"))]
    assert sorted(map(tuple, refs.collect()), key=str) == sorted(found, key=str)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    refs.drop("ref").repartition(buckets, "scope").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and plan.count("docker://") == 1
