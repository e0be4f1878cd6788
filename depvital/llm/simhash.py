"""Near-duplicates by 64-bit SimHash fingerprints, linked through BK-trees.

Two fingerprints that differ in at most r bits agree on at least one of r + 1 blocks of bits. A shard holds the distinct
fingerprints that agree on one block; its BK-tree (children keyed by the integer Hamming distance to their parent) is
searched along the edges within the radius. Only fingerprints of the same block value reach a tree, so a tree goes to
the one task that asks it; no table of all fingerprints is sent anywhere. Shards above a bound are linked exactly
through the short-distance keys around each fingerprint instead, which is linear in their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depvital.llm.byte_bpe import small_batches
from depvital.llm.common import drop_tables, keep_table, lookup, named
from depvital.llm.components import components

SEED = 42
BITS = 64
#: Fingerprints in one BK-tree; larger shards are linked by keys.
TREE_NODES = 4096


def shingle_hashes(tokens: list[bytes], words: int) -> bytes:
    """Eight bytes for each word shingle, in order; one for all words where there are fewer than a shingle's."""
    if not tokens:
        return b""
    width = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[: len(tokens) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, stops)])


def majority(hashes: bytes) -> int:
    """A bit is set if more than half the hashes have it; 0 without hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of a text's word shingles."""
    return majority(shingle_hashes(text.lower().split(), words))


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; a null text counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint(t or b"", words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(of, "doc_id long, fp long")


class BKTree:
    """Hamming BK-tree over integers; nodes are numbered in the order of insertion."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, key: int, radius: int) -> Iterator[int]:
        """Nodes at most `radius` away."""
        keys, children = self.keys, self.children
        todo = [0] if keys else []
        while todo:
            node = todo.pop()
            far = (key ^ keys[node]).bit_count()
            if far <= radius:
                yield node
            edges = children[node]
            if len(edges) > 2 * radius:
                todo += [edges[d] for d in range(far - radius, far + radius + 1) if d in edges]
            elif edges:
                todo += [child for d, child in edges.items() if -radius <= far - d <= radius]

    def add(self, key: int) -> int:
        new = len(self.keys)
        node = 0
        while self.keys:
            far = (key ^ self.keys[node]).bit_count()
            if (below := self.children[node].get(far)) is None:
                self.children[node][far] = new
                break
            node = below
        self.keys.append(key)
        self.children.append({})
        return new


def shard_links(keys: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect the distinct keys within the radius of each other: (key, smallest place of its set), no pairs."""
    tree, lead = BKTree(), list(range(len(keys)))

    def top(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    for i, key in enumerate(keys):
        for j in tree.within(key, radius):
            a, b = top(i), top(j)
            lead[max(a, b)] = min(a, b)
        tree.add(key)
    return [(keys[i], keys[top(i)]) for i in range(len(keys)) if lead[i] != i]


def _tree_links(radius: int):
    """Stream of rows sorted by (block, value) to links inside each shard."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << BITS) - 1
        held: list[np.ndarray] = []  # the shard that the next batch may continue
        held_key = None

        def flush() -> list[tuple[int, int]]:
            found = np.concatenate(held) if held else np.empty(0, np.int64)
            return shard_links([int(x) & mask for x in found], radius) if len(found) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            block, value, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(value) != 0)) + 1
            out: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                key = (block[lo], value[lo])
                if key != held_key:
                    out += flush()
                    held, held_key = [], key
                held.append(fp[lo:hi])
            yield _edges(out)
        yield _edges(flush())

    return links


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([signed(x[i]) for x in found], pa.int64()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def _blocks(radius: int) -> list[Column]:
    """The fingerprint's value in each of radius + 1 blocks of bits."""
    cuts = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return [F.shiftrightunsigned(F.shiftleft("fp", BITS - hi), BITS - (hi - lo)) for lo, hi in zip(cuts, cuts[1:])]


def _ball(radius: int) -> list[int]:
    return [signed(sum(1 << b for b in flips)) for r in range(radius + 1) for flips in combinations(range(BITS), r)]


def _key_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links of distinct fingerprints by common neighbours: a, b are within r of each other if and only if some key lies
    within r // 2 of one and within r - r // 2 of the other. A key's rows are at most the keys around it, not the shard's."""
    near, far = radius // 2, radius - radius // 2
    inner = set(_ball(near))
    flips = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(x in inner).alias("near")) for x in _ball(far)]))
    keys = fps.select("fp", flips.alias("k")).select(F.col("fp").bitwiseXOR(F.col("k.x")).alias("key"), "fp", F.col("k.near").alias("near"))
    centre = keys.groupBy("key").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return keys.join(centre.where("n > 1 and b is not null"), "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_links(fps: DataFrame, radius: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) at most `radius` bits apart, possibly through others."""
    shards = fps.select("fp", F.posexplode(F.array(*_blocks(radius))).alias("block", "value"))
    large = shards.groupBy("block", "value").count().where(F.col("count") > tree_nodes)
    large = keep_table(large.select("block", "value", F.lit(True).alias("large")), "large-shards")
    marked = lookup(shards, large, ["block", "value"])
    small = marked.where("large is null").select("block", "value", "fp")
    trees = small.repartition("block", "value").sortWithinPartitions("block", "value", "fp").mapInArrow(_tree_links(radius), "a long, b long")
    if large.isEmpty():
        return trees
    return trees.union(_key_links(marked.where("large").select("fp").distinct(), radius))


def near_duplicates(
    docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", tree_nodes: int = TREE_NODES
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id is the smallest doc_id reachable by links.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Texts with fewer words than a shingle have
    one shingle; null, empty and blank texts have the fingerprint zero and are linked like any other. Rows with equal
    texts share a fingerprint and so a component. Null identifiers take part but never name a component unless nothing
    else does (then it is null). Repeated rows come back as often as they went in. Other columns are not read.
    """
    rows = keep_table(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = keep_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), radius, tree_nodes)).select(F.col("node").alias("fp"), "root")
    rooted = keep_table(distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    named_by = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = lookup(rooted, named_by, ["root"]).select("fp", "component_id")
    return lookup(rows, of_fp, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity: fingerprints lie too far apart for blocks of bits, so shards are shared shingles

#: Texts with a similar one of fewer than FEW shingles are compared with all of their shard, without the tree; their bits
#: depend on too few hashes. `similar_bits` is the radius for the rest.
FEW = 16
#: Smallest hashes under so many orders name the shards of a text: two texts that share a part s of their shingles meet
#: in one with probability 1 - (1 - s) ** SHARD_ORDERS.
SHARD_ORDERS = 5
#: Smallest distinct hashes kept of a text to pass candidates. A similar pair falls below the bar of `least_common` with
#: probability MISS at most; whatever passes is decided on all hashes of both texts.
SKETCH = 160
MISS = 1e-6
#: Hashes held by a task that decides; larger groups of candidates are cut into blocks.
HASHES_HELD = 4_000_000
_ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _ones(n: int) -> np.ndarray:
    """Probabilities of 0 to n set bits among n hashes."""
    return np.array([comb(n, k) / 2**n for k in range(n + 1)])


def _bit_differs(common: int, only_a: int, only_b: int) -> float:
    """Probability that a fingerprint bit of two sets differs."""

    def set_bit(only: int) -> np.ndarray:  # by the number of common hashes that have it
        most = np.concatenate([[0.0], np.cumsum(_ones(only))])
        return 1 - most[np.clip((common + only) // 2 + 1 - np.arange(common + 1), 0, only + 1)]

    a, b = set_bit(only_a), set_bit(only_b)
    return float((_ones(common) * (a * (1 - b) + b * (1 - a))).sum())


@lru_cache
def similar_bits(least: float) -> int:
    """Radius that fingerprints of two similar texts exceed with probability MISS at most, if both have FEW distinct
    shingles or more: the tail of the binomial with the worst probability of a differing bit. From 64 shingles on that
    probability only falls towards its limit."""
    worst = 0.0
    for smaller in range(FEW, 65):
        for only in range(smaller + 1):
            common = smaller - only
            more = int(common / least + 1e-9) - smaller
            if more < only:
                break
            worst = max(worst, *(_bit_differs(common, only, x) for x in range(max(only, more - 1), more + 1)))
    tail = 0.0
    for r in range(BITS, 0, -1):
        tail += comb(BITS, r) * worst**r * (1 - worst) ** (BITS - r)
        if tail > MISS:
            return r
    return 0


@lru_cache
def least_common(used: int, least: float) -> int:
    """How many of the `used` smallest hashes of a union both texts have at the least, but for probability MISS."""
    below = 0.0
    for k in range(used + 1):
        below += comb(used, k) * least**k * (1 - least) ** (used - k)
        if below > MISS:
            return k
    return used


def are_similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sets of hashes, sorted and distinct, reaches `least`."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    if not len(a):
        return True
    common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return common >= least * (len(a) + len(b) - common)


def may_be_similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether texts of these sketches are worth a comparison: false for a similar pair with probability MISS at most."""
    if len(a) < SKETCH and len(b) < SKETCH:
        return are_similar(a, b, least)
    common, union = np.intersect1d(a, b, assume_unique=True), np.union1d(a, b)
    used = min(len(union), SKETCH)
    return int(np.searchsorted(common, union[used - 1], side="right")) >= least_common(used, least)


def _distinct(hashes: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashes, ">u8")).astype(np.uint64)


def text_key(text: Column) -> Column:
    """What tells a text from others; a null text counts as empty."""
    return F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))


def _features(words: int):
    names = ["doc_id", "text_md5", "content", "fp", "n", "shards", "sketch"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                tokens = (text or b"").lower().split()
                hashes = shingle_hashes(tokens, words)
                found = _distinct(hashes)
                shards = []
                if len(found):
                    mixed = found[None, :] * _ORDERS[:SHARD_ORDERS, None]
                    shards = (mixed ^ (mixed >> np.uint64(29))).min(axis=1).view(np.int64).tolist()
                sketch = (found[:SKETCH] >> np.uint64(24)).astype("<u8")  # the upper 40 bits keep the order
                content = xxhash.xxh3_128_digest(b" ".join(tokens))
                rows.append((content, signed(majority(found.astype(">u8").tobytes())), len(found), shards, sketch.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return features


def _unpacked(sketch: bytes) -> np.ndarray:
    wide = np.zeros((len(sketch) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(sketch, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def similar_links(rows: list[tuple[int, int, int, int, bytes]], bits: int, least: float) -> list[tuple[int, int]]:
    """Links that connect the texts of one shard that may be similar; rows: (role, node, fingerprint,
    number of distinct shingles, sketch).

    Role 0 goes into the tree, role 1 asks it, role 2 does both. A text that a text of fewer than FEW shingles may be
    similar to asks for all. Texts already connected are not compared again.
    """
    tree, places, lead = BKTree(), [], list(range(len(rows)))
    sketches: list[np.ndarray | None] = [None] * len(rows)

    def top(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    def sketch(i: int) -> np.ndarray:
        if sketches[i] is None:
            sketches[i] = _unpacked(rows[i][4])
        return sketches[i]

    for i, (role, _, fp, n, _) in enumerate(rows):
        if role:
            for node in tree.within(fp, bits) if least * n >= FEW else range(len(places)):
                j = places[node]
                if (a := top(i)) != (b := top(j)) and may_be_similar(sketch(i), sketch(j), least):
                    lead[max(a, b)] = min(a, b)
        if role != 1:
            tree.add(fp)
            places.append(i)
    return [(rows[i][1], rows[top(i)][1]) for i in range(len(rows)) if lead[i] != i]


def _shard_stream(bits: int, least: float):
    """Rows sorted by (place, value, part, role) to links inside each part of a shard."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_key = None
        mask = (1 << BITS) - 1
        for batch in batches:
            out: list[tuple[int, int]] = []
            for *key, role, node, fp, n, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                if key != held_key:
                    out += similar_links(held, bits, least) if len(held) > 1 else []
                    held, held_key = [], key
                held.append((role, node, fp & mask, n, sketch))
            yield _edges(out)
        yield _edges(similar_links(held, bits, least) if len(held) > 1 else [])

    return links


def _needed_hashes(words: int):
    """Rows (node, root, ..., content, text) to the same with all distinct hashes of the text in place of the last two."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 3):
                found = [_distinct(shingle_hashes(t.as_py().lower().split(), words)).astype("<u8").tobytes() for t in batch.column(3)]
                columns = [*(batch.column(i) for i in range(3)), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "blocks", "hashes"])

    return hashes


def _exact_stream(least: float):
    """Rows (root, low, high, role, node, hashes) sorted by (part, role, node) to links of the texts that are similar.

    Texts of role 0 and 2 are held; those of role 1 and 2 are compared with the held ones, one after the other.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = None
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        lead: dict[int, int] = {}

        def top(node: int) -> int:
            while (above := lead.get(node, node)) != node:
                lead[node] = node = lead.get(above, above)
            return node

        for batch in batches:
            out: list[tuple[int, int]] = []
            *keys, roles, names = (batch.column(i).to_pylist() for i in range(5))
            for *part, role, node, hashes in zip(*keys, roles, names, batch.column(5)):
                if part != key:
                    key, nodes, sets, lead = part, [], [], {}
                elif node == last:  # rows of one identifier and text
                    continue
                last, own = node, np.frombuffer(hashes.as_py(), "<u8")
                if role:
                    for other, held in zip(nodes, sets):
                        if (a := top(node)) != (b := top(other)) and are_similar(own, held, least):
                            lead[max(a, b)] = min(a, b)
                            out.append((node, other))
                if role != 1:
                    nodes.append(node)
                    sets.append(own)
            yield _edges(out)

    return links


def _exact_links(texts: DataFrame, first: DataFrame, candidates: DataFrame, words: int, least: float, held: int, tree_nodes: int) -> DataFrame:
    """Links of the candidates (node, root) that are similar by all their hashes, which are computed again from the texts."""
    members = first.select("node", "n", "content", "sample").join(candidates, "node")
    sizes = members.groupBy("root").agg(F.sum("n").alias("hashes"), F.count(F.lit(1)).alias("texts"))
    blocks = F.greatest(F.ceil(F.col("hashes") / held), F.ceil(F.col("texts") / tree_nodes)).cast("int").alias("blocks")
    needed = lookup(members, sizes.select("root", blocks), ["root"], "inner")
    needed = keep_table(needed.select("node", "root", "blocks", F.col("sample.doc_id").alias("sample_id"), F.col("sample.text_md5").alias("sample_md5")), "candidate-texts")
    same = F.col("doc_id").eqNullSafe(F.col("sample_id")) & (F.col("text_md5") == F.col("sample_md5"))
    read = texts.join(needed, same).select("node", "root", "blocks", "text")
    hashed = keep_table(read.mapInArrow(_needed_hashes(words), "node long, root long, blocks int, hashes binary"), "candidate-hashes")

    key = ("root", "low", "high")
    dealt = _dealt(hashed).select(*key, "role", "node", "hashes")
    found = dealt.repartition(*key).sortWithinPartitions(*key, "role", "node").mapInArrow(_exact_stream(least), "a long, b long")
    found = keep_table(found, "similar-pairs")
    drop_tables(needed, hashed)
    return found


def _dealt(members: DataFrame) -> DataFrame:
    """Rows with a number of blocks, once for each pair of blocks that theirs is in, with the pair (low, high) and their role."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    role = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "role": role})


def similar_documents(
    docs: DataFrame,
    words: int = 5,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    tree_nodes: int = TREE_NODES,
    hashes_held: int = HASHES_HELD,
) -> DataFrame:
    """(doc_id, component_id, text_md5, kept) for each row: texts are linked if their sets of word shingles have a Jaccard similarity of
    `least` or more; component_id is the smallest doc_id reachable. One pair of
    doc_id and text_md5 is kept of each component: its smallest identifier's, of the texts under that the smallest MD5.

    Words as in `near_duplicates`. Texts of the same words are one text, blank and null texts too. A shard holds the
    texts that share a smallest hash; a BK-tree over their fingerprints and a sketch find the candidates. Texts that
    candidates connect are a group, inside which all hashes decide. A shard of more than `tree_nodes` different texts, and
    a group of more than these or of more than `hashes_held` hashes, is cut into blocks, and each pair of blocks has a task
    of its own. Null identifiers take part but name a component only if nothing else does. Other columns are not read.
    """
    binary = named(text_col).cast("binary")
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), text_key(binary).alias("text_md5"), binary.alias("text"))
    schema = "doc_id long, text_md5 string, content binary, fp long, n long, shards array<long>, sketch binary"
    rows = keep_table(texts.mapInArrow(_features(words), schema), "shingle-features")
    sample = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_md5")).alias("sample")  # a row that has the text
    first = rows.groupBy("content").agg(sample, *[F.any_value(c).alias(c) for c in ("fp", "n", "shards", "sketch")])
    first = keep_table(first.withColumn("node", F.monotonically_increasing_id()), "different-texts")

    shards = first.select("node", F.posexplode("shards").alias("place", "value"))
    shared = shards.groupBy("place", "value").agg(F.ceil(F.count(F.lit(1)) / tree_nodes).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    shared = keep_table(shared.where("n > 1").select("place", "value", "blocks"), "shared-shards")
    members = lookup(shards, shared, ["place", "value"], "inner").join(first.select("node", "fp", "n", "sketch"), "node")
    key = ("place", "value", "low", "high")
    dealt = _dealt(members).select(*key, "role", "node", "fp", "n", "sketch")
    links = dealt.repartition(*key).sortWithinPartitions(*key, "role", "node").mapInArrow(_shard_stream(similar_bits(least), least), "a long, b long")

    roots = components(_exact_links(texts, first, components(links), words, least, hashes_held, tree_nodes))
    rooted = first.select("node", "content", "sample").join(roots, "node", "left")
    rooted = keep_table(rooted.select("content", "sample", F.coalesce("root", "node").alias("root")), "rooted-texts")
    named_by = rooted.groupBy("root").agg(F.min("sample").alias("first"))
    of_text = lookup(rooted, named_by, ["root"]).select("content", "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_md5") == F.col("first.text_md5"))
    found = lookup(rows.select("doc_id", "content", "text_md5"), of_text, ["content"])
    found = found.select("doc_id", F.col("first.doc_id").alias("component_id"), "text_md5", kept.alias("kept"))
    found = keep_table(found, "similar-documents")
    drop_tables(rows, first, shared, rooted)  # sketches are a large part of short texts
    return found
