from __future__ import annotations

import random

import pytest

from depvital.operators import graph, walks
from depvital.sources import facts

EDGES = "project_id BIGINT, src STRING, dst STRING"
DIRECT = "project_id BIGINT, package_id STRING"


def tables(spark, edges, direct):
    return (
        spark.createDataFrame([(1, a, b) for a, b in edges], EDGES),
        spark.createDataFrame([(1, d) for d in direct], DIRECT),
    )


def brute_reach(edges, start):
    seen, queue = {start}, [start]
    while queue:
        here = queue.pop()
        for a, b in edges:
            if a == here and b not in seen:
                seen.add(b)
                queue.append(b)
    return seen - {start}


def brute_metrics(edges, direct):
    reach = {d: brute_reach(edges, d) for d in direct}
    providers = {}
    for d in direct:
        for n in reach[d] - set(direct):
            providers.setdefault(n, set()).add(d)
    return {
        d: (
            len(reach[d] - set(direct)),
            sum(1 for n in reach[d] - set(direct) if len(providers[n]) == 1),
            sum(1 for e in direct if e != d and d in reach[e]),
        )
        for d in direct
    }


def metrics(spark, edges, direct, large_edges=graph.LARGE_EDGES):
    e, d = tables(spark, edges, direct)
    rows = graph.graph_metrics(e, d, large_edges).collect()
    return {r.direct_id: (r.total_transitive, r.exclusive_transitive, r.via_count) for r in rows}


def test_shapes(spark):
    chain = [("A", "B"), ("B", "C"), ("C", "D")]
    assert metrics(spark, chain, ["A"]) == {"A": (3, 3, 0)}
    shared = [("A", "S"), ("B", "S"), ("A", "X")]
    assert metrics(spark, shared, ["A", "B"]) == {"A": (2, 1, 0), "B": (1, 0, 0)}
    through = [("C", "A"), ("A", "X")]
    assert metrics(spark, through, ["A", "C"]) == {"A": (1, 0, 1), "C": (1, 0, 0)}
    cycle = [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")]
    assert metrics(spark, cycle, ["A"]) == {"A": (2, 2, 0)}
    assert metrics(spark, [("X", "Y")], ["A"]) == {"A": (0, 0, 0)}


def test_random_graphs_against_brute_force(spark):
    rnd = random.Random(4)
    for _ in range(3):
        nodes = [f"n{i}" for i in range(14)]
        edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(26)})
        direct = rnd.sample(nodes, 4)
        assert metrics(spark, [e for e in edges if e[0] != e[1]], direct) == brute_metrics(edges, direct)


@pytest.mark.parametrize("large_edges", [graph.LARGE_EDGES, 5])
def test_long_chain(spark, large_edges):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    e, d = tables(spark, chain, ["n00"])
    rows = {r.node: r.level for r in graph.reachability(e, d, large_edges).collect()}
    assert rows == {f"n{i:02d}": i for i in range(1, 21)}


def many_projects(spark, seed):
    """Projects of all sizes, one with over 64 direct dependencies, one without edges, one without direct dependencies."""
    rnd = random.Random(seed)
    edges, direct = [], []
    for project in range(12):
        nodes = [f"n{i}" for i in range(rnd.choice([3, 10, 40]) if project else 200)]
        edges += {(project, rnd.choice(nodes), rnd.choice(nodes)) for _ in range(0 if project == 3 else 2 * len(nodes))}
        direct += [(project, n) for n in rnd.sample(nodes, 150 if not project else 2)] if project != 5 else []
    return edges, direct, spark.createDataFrame(edges, EDGES).repartition(3), spark.createDataFrame(direct, DIRECT)


@pytest.mark.parametrize("large_edges", [graph.LARGE_EDGES, 30, 0])
def test_projects_of_all_sizes(spark, large_edges):
    edges, direct, e, d = many_projects(spark, 8)
    wants, reached, above = {}, {}, {}
    for project in {p for p, _ in direct}:
        own = [(a, b) for p, a, b in edges if p == project and a != b]
        starts = [n for p, n in direct if p == project]
        wants |= {(project, n): m for n, m in brute_metrics(own, starts).items()}
        for s in starts:
            for n in brute_reach(own, s):
                reached.setdefault((project, n), []).append(s)
    got = {(r.project_id, r.direct_id): (r.total_transitive, r.exclusive_transitive, r.via_count) for r in graph.graph_metrics(e, d, large_edges).collect()}
    assert got == wants
    via = {(r.project_id, r.node): (r.via, r.via_count) for r in graph.direct_providers(e, d, large_edges).collect()}
    assert via == {k: (min(v), len(v)) for k, v in reached.items()}
    pairs = {(r.project_id, r.direct_id, r.node) for r in graph.reachability(e, d, large_edges).collect()}
    assert pairs == {(p, s, n) for (p, n), starts in reached.items() for s in starts}


def test_a_slice_holds_whole_projects(spark):
    _, _, e, d = many_projects(spark, 9)
    scoped, starts = graph._by_scope(e, d)
    output = [("scope", "scope"), ("start", "node"), ("total", "long"), ("exclusive", "long"), ("above", "long")]
    one = walks.walk_graphs(scoped, starts, walks.start_metrics, output, slice_rows=1)
    all_ = walks.walk_graphs(scoped, starts, walks.start_metrics, output)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, all_.collect()))


def test_bucketed_tables_keep_projects_whole(spark, tmp_path):
    rnd = random.Random(3)
    edges = list({(p, rnd.randrange(30), rnd.randrange(30)) for p in range(40) for _ in range(50)})
    direct = [(p, n) for p in range(40) for n in rnd.sample(range(30), 3)]
    plain = spark.createDataFrame(edges, "project_id BIGINT, src BIGINT, dst BIGINT"), spark.createDataFrame(direct, "project_id BIGINT, package_id BIGINT")
    stored = [facts.save_table(t.repartition(3), f"file://{tmp_path}", n) for t, n in zip(plain, ("edges", "direct"))]
    assert stored[0].count() == len(edges)
    want = sorted(map(tuple, graph.graph_metrics(*plain).collect()))
    assert sorted(map(tuple, graph.graph_metrics(*stored).collect())) == want and any(r[3] for r in want)
    both = stored[0].select("project_id").unionAll(stored[1].select("project_id")).groupBy("project_id").count()
    assert both.count() == 40


def test_empty_graphs(spark):
    e, d = spark.createDataFrame([], EDGES), spark.createDataFrame([], DIRECT)
    assert graph.reachability(e, d).collect() == [] and graph.graph_metrics(e, d).collect() == [] and graph.direct_providers(e, d).collect() == []


@pytest.mark.parametrize("large_edges", [graph.LARGE_EDGES, 2])
def test_first_reach_takes_lowest_level_then_smallest_origin(spark, large_edges):
    edges = [("a", "x"), ("b", "x"), ("b", "y"), ("x", "z"), ("y", "w"), ("z", "a")]
    e = spark.createDataFrame([("s", p, q) for p, q in edges], "scope STRING, src STRING, dst STRING")
    seeds = spark.createDataFrame([("s", "b", "b"), ("s", "a", "a")], "scope STRING, node STRING, via STRING")
    got = {r.node: (r.level, r.via) for r in graph.first_reach(e, seeds, "via", large_edges).collect()}
    assert got == {"a": (0, "a"), "b": (0, "b"), "x": (1, "a"), "y": (1, "b"), "z": (2, "a"), "w": (2, "b")}


def test_action_closure(spark):
    direct = spark.createDataFrame([("r", "acme/one"), ("r", "acme/two/sub")], "scope STRING, action STRING")
    uses = spark.createDataFrame(
        [("r", "acme/one", "lib/a"), ("r", "lib/a", "lib/b/x"), ("r", "acme/two/sub", "lib/b/x"), ("r", "lib/b/x", "acme/one/extra")],
        "scope STRING, action STRING, uses STRING",
    )
    got = {(r.repo, r.level, r.via) for r in graph.action_closure(direct, uses).collect()}
    assert got == {("lib/a", 1, "acme/one"), ("lib/b", 1, "acme/two/sub")}


REFS = "project_id BIGINT, ref STRING, purl STRING"
DEPS = "project_id BIGINT, ref STRING, child_ref STRING"
ROOTS = "project_id BIGINT, root_ref STRING, root_purl STRING"


def direct_of(spark, refs, deps, root):
    got = graph.direct_deps(
        spark.createDataFrame([(1, *r) for r in refs], REFS),
        spark.createDataFrame([(1, *d) for d in deps], DEPS),
        spark.createDataFrame([(1, *root)], ROOTS),
    )
    return {r.purl for r in got.collect()}


def test_direct_dependencies(spark):
    refs = [("a", "pkg:npm/a@1"), ("b", "pkg:npm/b@1"), ("c", "pkg:npm/c@1"), ("me", "pkg:npm/me@1")]
    plain = [("root", "a"), ("root", "b"), ("a", "c")]
    assert direct_of(spark, refs, plain, ("root", None)) == {"pkg:npm/a@1", "pkg:npm/b@1"}
    # a file node without package, then the project's own module, then real dependencies
    own = [("root", "mod"), ("mod", "me"), ("me", "a"), ("me", "b")]
    assert direct_of(spark, refs, own, ("root", "pkg:npm/me@1")) == {"pkg:npm/a@1", "pkg:npm/b@1"}
    # the sole child of a node without package passes through when it has children itself
    assert direct_of(spark, refs, own, ("root", None)) == {"pkg:npm/a@1", "pkg:npm/b@1"}
    assert direct_of(spark, refs, [("root", "mod"), ("mod", "me")], ("root", None)) == {"pkg:npm/me@1"}
    # no root entry: what nothing depends on
    assert direct_of(spark, refs, [("a", "c"), ("b", None), ("c", None)], ("root", None)) == {"pkg:npm/a@1", "pkg:npm/b@1"}
    # cycle through nodes without package
    assert direct_of(spark, refs, [("root", "x"), ("x", "y"), ("y", "x"), ("y", "a")], ("root", None)) == {"pkg:npm/a@1"}
    # broken reference
    assert direct_of(spark, refs, [("root", "lost"), ("root", "a")], ("root", None)) == {"pkg:npm/a@1"}


def flat(spark, direct, edges, root):
    got = graph.flatten_aggregators(
        spark.createDataFrame([(1, d) for d in direct], "project_id BIGINT, purl STRING"),
        spark.createDataFrame([(1, *e) for e in edges], EDGES),
        spark.createDataFrame([(1, "root", root)], ROOTS),
    )
    return {r.purl for r in got.collect()}


def test_aggregators(spark):
    m1, m2, ext = "pkg:maven/org.acme/m1@1", "pkg:maven/Org.Acme/m2@1", "pkg:maven/org.other/lib@2"
    edges = [(m1, ext), (m2, m1), (m2, "pkg:maven/org.acme/root@1")]
    root = "pkg:maven/org.acme/root@1"
    assert flat(spark, [m1, m2], edges, root) == {ext}
    assert flat(spark, [m1, m2, ext], edges + [(ext, m1)], root) == {m1, m2, ext}  # mixed groups
    assert flat(spark, [m1, m2], [(m2, m1)], root) == {m1, m2}  # a leaf is no module
    assert flat(spark, [m1], [(m1, root)], root) == {m1}  # nothing would remain
    assert flat(spark, [m1, m2], edges, "pkg:npm/org.acme/root@1") == {m1, m2}


def test_relations(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "project_id BIGINT, node STRING")
    _, direct = tables(spark, [("a", "b")], ["a"])
    known = spark.createDataFrame([(1,)], "project_id BIGINT")
    got = {r.node: r.relation for r in graph.classify_relation(nodes, direct, known).collect()}
    assert got == {"a": "direct", "b": "transitive", "c": "unknown"}
