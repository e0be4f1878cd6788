from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import check
from depvital.llm import prefix_trie as module
from depvital.llm.prefix_trie import NodeTable, borrowed_paths, ordered_turns, own_paths, prefix_trie
from depvital.llm.queries import ORACLE_SQL

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("conv", "pos", "high", "low", "bytes", "depth", "hi", "shard", "length", "a.b")],
    ]
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def turns(spark):
    return lambda rows: spark.createDataFrame([(*r, *["x"] * 10) for r in rows], TURNS).repartition(3)


def digest_of(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def originals(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, signed(digest_of(role or "", text or "")), (role or "", text or "")))
    return {c: [t[-1] for t in sorted(held)] for c, held in convs.items()}


def signed(digest):
    return tuple(int.from_bytes(bytes.fromhex(digest[i : i + 16]), "big", signed=True) for i in (0, 16))


def rebuilt(rows):
    convs = originals(rows)
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def expected(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(int)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, held in members.items():
        weight = (len(held) - 1) * (len(prefix[-1][1].encode()) if prefix else 0)
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += not children[prefix]
            saved[prefix[:d]] += weight
    return sorted(
        (
            (
                min(held), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(held), children[prefix], leaves[prefix], saved[prefix],
                hashlib.sha256(",".join(map(str, sorted(ends[prefix]))).encode()).hexdigest(),
            )
            for prefix, held in members.items()
        ),
        key=repr,
    )


def found(trie):
    assert trie.columns == COLUMNS
    return sorted((tuple(r) for r in trie.collect()), key=repr)


def query(frame):
    return prefix_trie(borrowed_paths(ordered_turns(frame), 5, F.crc32(F.col("conv").cast("string").cast("binary")) % 9, 8))


AWKWARD = [
    (0, 0, "user", "hello"),
    (0, 1, None, "hello"),
    (0, None, "user", None),
    (0, None, "user", None),
    (1, 0, "user", "hello"),
    (1, 1, "", "hello"),
    (7, 2, "bot", "Ünïcödé 🙂"),
    (7, 2, "bot", "Ünïcödé 🙂"),
    (7, 2, "bo", "tÜnïcödé 🙂"),
    (-3, 0, "user", "hello"),
    (-5, 0, "user", "x" * 200_000),
    (None, 0, "user", "hello"),
    (None, None, None, None),
]


def chatter(seed, convs=120):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(draw.randrange(1, 14)):
            rows.append((c, turn, draw.choice(["user", "bot"]), "common first" if turn == 0 and c % 3 else draw.choice("abc") * draw.randrange(1, 4)))
    return rows


@pytest.mark.parametrize("seed,depths,nodes", [(0, 1024, 50_000), (1, 2, 40), (2, 1, 7)])
def test_equals_brute_force(turns, monkeypatch, seed, depths, nodes):
    monkeypatch.setattr(module, "BLOCK_DEPTHS", depths)
    monkeypatch.setattr(module, "SHARD_NODES", nodes)
    rows = chatter(seed) + AWKWARD
    assert found(query(turns(rows))) == expected(rebuilt(rows))
    if seed == 1:
        assert found(prefix_trie(own_paths(ordered_turns(turns(rows))))) == expected(originals(rows))


def test_one_long_conversation_and_many_copies(turns):
    rows = [(3, i, "user", f"turn {i % 7}") for i in range(3000)]
    rows += [(c, i, "user", "same") for c in range(10, 700) for i in range(2)]
    got = found(query(turns(rows)))
    paths = rebuilt(rows)
    assert len(got) == len({tuple(p[:d]) for p in paths.values() for d in range(len(p) + 1)}) and max(r[1] for r in got) == len(paths[3]) > 2500
    short = {c: p for c, p in paths.items() if c != 3}
    # the long conversation shares nothing below the root, so the other nodes are those of the trie without it
    alone = [r for r in expected(short) if r[1] > 0]
    alone = {(r[0], r[1], *r[3:]) for r in alone}
    assert alone <= {(r[0], r[1], *r[3:]) for r in got}


def test_identifiers_of_an_end_in_many_pieces(turns, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(0, 400)]
    assert found(prefix_trie(own_paths(ordered_turns(turns(rows))))) == expected(originals(rows))


def test_awkward_rows_and_sql(turns):
    rows = [r for r in AWKWARD if (r[0], r[1]) not in ((7, 2),)] + chatter(9, 60)
    got = query(turns(rows))
    con = duckdb.connect()
    names = ["conv_id", "turn", "role", "text"]
    con.register("conversations", pa.table({n: pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string()) for i, n in enumerate(names)}))
    result = con.execute(ORACLE_SQL["op13_prefix_trie"])
    columns = [d[0] for d in result.description]
    assert check.rows_of(got.columns, [tuple(r) for r in got.collect()]) == check.rows_of(columns, result.fetchall())


def test_empty_tables(turns):
    assert found(query(turns([]))) == []
    assert found(query(turns([(None, 1, "a", "b")]))) == []


def test_another_seed_after_a_collision(turns, monkeypatch):
    weak, real = [], module.prefix_digests

    def first_weak(paths, seed):
        rows = real(paths, seed)
        if not weak:
            weak.append(seed)
            return rows.withColumns({c: F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.lit(1)).cast("long") for c in ("hi", "lo")})
        return rows

    monkeypatch.setattr(module, "prefix_digests", first_weak)
    rows = chatter(4, 20)
    assert found(prefix_trie(own_paths(ordered_turns(turns(rows))))) == expected(originals(rows)) and weak == [1]


def test_slots_are_verified():
    draw = np.random.default_rng(1)
    high, low = (draw.integers(0, 1 << 63, 500).astype(np.uint64) for _ in range(2))
    table = NodeTable(high, low)
    assert sorted(table.slot(high, low)) == list(range(500))
    assert (table.slot(low, high) == -1).all()
