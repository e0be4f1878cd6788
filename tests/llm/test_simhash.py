from __future__ import annotations

import random
import re

import pytest
import xxhash

from depvital.llm import simhash
from depvital.llm.components import components

from .conftest import AWKWARD


def plain_fingerprint(text, k=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(n, linked):
    lead = list(range(n))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                lead[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def smallest(ids, roots):
    out = {}
    for i, r in zip(ids, roots):
        if i is not None:
            out[r] = min(out.get(r, i), i)
    return [out.get(r) for r in roots]


@pytest.mark.parametrize("tree_nodes", [4096, 1])
def test_awkward_rows(documents, tree_nodes):
    fps = [plain_fingerprint(t) for _, t, *_ in AWKWARD]
    roots = groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    want = sorted(zip((r[0] for r in AWKWARD), (f"{f:016x}" for f in fps), smallest([r[0] for r in AWKWARD], roots)), key=repr)
    got = simhash.near_duplicates(documents(AWKWARD), tree_nodes=tree_nodes).collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert simhash.near_duplicates(documents([])).collect() == []


@pytest.mark.parametrize(("radius", "tree_nodes"), [(1, 1), (2, 3), (2, 10_000), (3, 2), (3, 10_000), (4, 10_000)])
def test_links_connect_what_is_near(spark, radius, tree_nodes):
    rng = random.Random(radius)
    keys = {rng.getrandbits(64) for _ in range(40)}
    for key in list(keys):
        for _ in range(12):
            for _ in range(rng.randint(0, radius + 2)):
                key ^= 1 << rng.randrange(64)
            keys.add(key)
    keys = sorted(map(simhash.signed, keys))
    mask = (1 << 64) - 1
    roots = groups(len(keys), lambda i, j: ((keys[i] ^ keys[j]) & mask).bit_count() <= radius)
    want = {k: min(x for x, r in zip(keys, roots) if r == root) for k, root in zip(keys, roots)}
    links = simhash.near_links(spark.createDataFrame([(k,) for k in keys], "fp long"), radius, tree_nodes)
    found = {r.node: r.root for r in components(links).collect()}
    assert {k: found.get(k, k) for k in keys} == want


def test_tree_follows_edges_within_the_radius():
    rng = random.Random(1)
    keys = [rng.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for k in keys:
        tree.add(k)
    for radius in (0, 2, 5):
        for ask in keys[:40]:
            assert sorted(tree.within(ask, radius)) == [i for i, k in enumerate(keys) if (k ^ ask).bit_count() <= radius]


@pytest.mark.parametrize("tree_nodes", [4096, 3])
def test_similar_documents(documents, tree_nodes):
    rng = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(500)]
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 20, 60, 90]))]
        for _ in range(8):
            changed = list(text)
            for _ in range(rng.choice([0, 0, 1, 2])):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (None, "w1 w2 w3 w4")]
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    roots = groups(len(rows), lambda i, j: sets[i] == sets[j] or bool(sets[i] & sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    want = dict(zip((r[0] for r in rows), smallest([r[0] for r in rows], roots)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(rows), tree_nodes=tree_nodes).collect()}
    assert got == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(i, 7) for i in range(8, 40)] + [(500, 500), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_components(rows, words=5, least=0.8):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").lower().split()
        sets.append({" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    roots = groups(len(rows), lambda i, j: sets[i] == sets[j] or bool(sets[i] & sets[j]) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))
    return dict(zip((r[0] for r in rows), smallest([r[0] for r in rows], roots)))


@pytest.mark.parametrize(("tree_nodes", "held"), [(4096, 4_000_000), (2, 500)])
def test_long_texts_are_decided_exactly(documents, tree_nodes, held):
    rng = random.Random(7)
    rows = []
    for base in range(60):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(300, 3000) if base % 10 else 300)]
        rows.append((len(rows), " ".join(text)))
        for alike in (rng.uniform(0.7, 0.8), rng.uniform(0.8, 0.9)):
            n = len(text) - 4
            same = round(2 * n * alike / (1 + alike)) + 4
            rows.append((len(rows), " ".join(text[:same] + [f"x{rng.randrange(5000)}" for _ in text[same:]])))
    got = simhash.similar_documents(documents(rows), tree_nodes=tree_nodes, hashes_held=held)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_components(rows)


def test_texts_that_repeat_themselves(documents):
    rng = random.Random(11)
    rows = []
    for base in range(60):
        few = base % 3 == 2
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(6, 24) if few else rng.choice([150, 400]))]
        again = [f"x{rng.randrange(5000)}" for _ in range(8)] * (10 if len(text) == 150 else 20)
        rows.append((len(rows), " ".join(text)))
        rows.append((len(rows), " ".join(text[1:] if few else text + again)))
    want = brute_components(rows)
    assert len(set(want.values())) < len(rows) - 50
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(documents(rows)).collect()} == want


def test_radius_covers_similar_texts():
    assert 24 <= simhash.similar_bits(0.8) <= 28
    rng = random.Random(5)
    for n in [simhash.FEW, 20, 50, 500] * 100:
        union = [rng.getrandbits(64) for _ in range(int(n / 0.9))]
        gone = int(len(union) * 0.1)
        fps = [simhash.majority(b"".join(h.to_bytes(8, "big") for h in part)) for part in (union[gone:], union[: len(union) - gone])]
        assert (fps[0] ^ fps[1]).bit_count() <= simhash.similar_bits(0.8)
