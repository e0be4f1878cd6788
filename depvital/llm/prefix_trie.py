"""Trie of conversation prefixes in a node table of sharded minimal perfect hashes.

A prefix is known by the exclusive or of 128-bit hashes of its turns with their depths, so digests of all prefixes are a
running sum that is cut into blocks of depths, however long a conversation is. Nodes are the distinct digests; every row
of a node must agree on depth, parent and last turn, or all is hashed anew with another seed.

The nodes whose smallest member is one conversation form a chain, as a node's smallest member is also that of the one
child it goes on to. Chains, cut into pieces of bounded depth, are dealt to shards. A shard is a minimal perfect hash over
its digests with flat arrays; parents are slots of the same arrays, and sums run from the deepest nodes upwards. What
hangs below a piece in other pieces comes in as one message for each parent node: totals of whole pieces, added up over
the (much smaller) tree of pieces by doubling, in as many rounds as the logarithm of its height.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depvital.functions.ranking import rank_within
from depvital.llm.common import drop_tables, find_package, keep_table, lookup, named
from depvital.llm.line_dedup import PerfectHash

#: Depths in a block of prefix digests and in a piece of a chain, and nodes in a shard on average.
BLOCK_DEPTHS = 1024
SHARD_NODES = 50_000
#: Identifiers that are joined to one piece of text before a node's digest runs over the pieces.
CHUNK_IDS = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, pos, high, low, bytes): turns numbered from 1, the digest of role and text, and the text's bytes in UTF-8.

    Null turns come first; rows of one turn are ordered by their digests. Null roles and texts count as empty. Rows with a
    null identifier belong to no conversation and are left out.
    """
    role, text = (F.coalesce(named(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda start: F.conv(F.substring("digest", start, 16), 16, -10).cast("long")
    slim = conversations.select(
        named(id_col).cast("long").alias("conv"), named(turn_col).alias("turn"), F.octet_length(text).cast("long").alias("bytes"), digest.alias("digest")
    ).where("conv is not null")
    slim = slim.select("conv", "turn", "bytes", half(1).alias("high"), half(17).alias("low"))
    ranked = rank_within(slim, "conv", [F.col("turn").asc_nulls_first(), F.col("high"), F.col("low")], "pos")
    return ranked.select("conv", "pos", "high", "low", "bytes")


def own_paths(turns: DataFrame) -> DataFrame:
    """Paths of whole conversations: rows (conv, depth, high, low, bytes, length), one of them of depth 0."""
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("length"))
    rows = lookup(turns.withColumnRenamed("pos", "depth"), lengths, ["conv"])
    return rows.select("conv", "depth", "high", "low", "bytes", "length").union(_tops(lengths))


def _tops(lengths: DataFrame) -> DataFrame:
    nothing = F.lit(0).cast("long")
    return lengths.select("conv", nothing, nothing, nothing, nothing, "length")


def borrowed_paths(turns: DataFrame, family: int, borrowed: Column, most: int) -> DataFrame:
    """Paths of conversations c that begin with the first turns of conversation c - c % family and go on with their own.

    `borrowed` (a column over conv, at most `most`) is how many turns are borrowed and left out of the own ones; a shorter
    or absent other conversation gives what it has. A conversation's path may be empty.
    """
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    base = F.col("conv") - F.col("conv") % family
    convs = lengths.select("conv", "own", base.alias("base"), borrowed.cast("long").alias("h"))
    donors = lengths.select(F.col("conv").alias("base"), F.col("own").alias("base_length"))
    head = F.least("h", F.coalesce("base_length", F.lit(0)))
    info = convs.join(donors, "base", "left").select(
        "conv", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")
    )
    info = keep_table(info, "trie-conversations")
    # at most `most` turns of the other conversation for each member of its family
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv", "base")
    first = heads.join(info, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "high", "low", "bytes", "length")
    rest = lookup(turns, info.select("conv", "h", "head", "length"), ["conv"]).where("pos > h")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "high", "low", "bytes", "length")
    return first.union(rest).union(_tops(info))


def prefix_digests(paths: DataFrame, seed: int) -> DataFrame:
    """Paths with the digest of the prefix that ends in each row (hi, lo), its parent's (phi, plo) and a check value."""
    block = F.floor(F.col("depth") / BLOCK_DEPTHS).alias("block")
    top = F.col("depth") == 0
    x = F.when(top, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "depth", "high", "low"))
    y = F.when(top, F.lit(0)).otherwise(F.xxhash64("low", "high", "depth", F.lit(~seed)))
    hashed = paths.select("*", block, x.alias("x"), y.alias("y"))
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = hashed.withColumns({c: F.bit_xor(v).over(so_far) for c, v in (("hi", "x"), ("lo", "y"))})
    # what earlier blocks of the conversation add: one row for each block
    totals = hashed.groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv", "block", F.bit_xor("x").over(earlier).alias("bx"), F.bit_xor("y").over(earlier).alias("by"))
    joined = inside.join(before.where("block > 0"), ["conv", "block"], "left")
    whole = joined.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(b, F.lit(0))) for c, b in (("hi", "bx"), ("lo", "by"))})
    up = {c: F.when(~top, F.col(d).bitwiseXOR(F.col(v))) for c, d, v in (("phi", "hi", "x"), ("plo", "lo", "y"))}
    checked = whole.withColumns(up).withColumn("check", F.xxhash64("depth", "high", "low", "bytes", "phi", "plo"))
    return checked.select("conv", "depth", "bytes", "length", "hi", "lo", "phi", "plo", "check")


def _distinct_prefixes(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with digests, and one row per prefix; another seed as long as two prefixes share a digest."""
    for seed in count(1):
        rows = keep_table(prefix_digests(paths, seed), "trie-rows")
        same = F.min("check").alias("least"), F.max("check").alias("most")
        facts = [F.min(c).alias(c) for c in ("depth", "bytes", "phi", "plo")]
        found = rows.groupBy("hi", "lo").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *facts, *same)
        found = keep_table(found, "trie-prefixes")
        if found.where("least <> most").isEmpty():
            return rows, found.drop("least", "most")
        drop_tables(rows, found)
    raise AssertionError("seeds never end")


def _with_kin(found: DataFrame) -> DataFrame:
    """Prefixes with parent_conv_id, n_children, the piece they lie in and their parent's piece where it is another one."""
    children = found.groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = found.join(children.where("hi is not null"), ["hi", "lo"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = found.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent_conv_id"))
    kin = lookup(counted, parents, ["phi", "plo"])
    block, up = (F.floor(d / BLOCK_DEPTHS) for d in (F.col("depth"), F.col("depth") - 1))
    head = F.col("parent_conv_id").isNotNull() & ((F.col("parent_conv_id") != F.col("conv_id")) | (block != up))
    return kin.select(
        "*",
        block.alias("block"),
        F.when(head, F.col("parent_conv_id")).alias("up_conv"),
        F.when(head, up).alias("up_block"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )


def _messages(nodes: DataFrame) -> DataFrame:
    """(block, conv_id, hi, lo, leaf, saved): what hangs below a node in other pieces than its own.

    Each round adds the totals of the pieces 1, 2, 4, ... steps below; a piece's total is complete when all pieces have
    passed their top.
    """
    top = F.col("up_conv").isNotNull()
    heads = [F.max(F.when(top, F.col(c))).alias(c) for c in ("up_conv", "up_block", "phi", "plo")]
    pieces = nodes.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), *heads)
    pieces = keep_table(pieces.select("*", F.col("up_conv").alias("jump_conv"), F.col("up_block").alias("jump_block")), "trie-pieces")
    while not pieces.where("jump_conv is not null").isEmpty():
        below = pieces.where("jump_conv is not null").groupBy(F.col("jump_conv").alias("conv_id"), F.col("jump_block").alias("block"))
        summed = pieces.join(below.agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved")), ["conv_id", "block"], "left")
        summed = summed.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaf", "saved")}).drop("more_leaf", "more_saved")
        steps = pieces.select(
            F.col("conv_id").alias("jump_conv"), F.col("block").alias("jump_block"), F.col("jump_conv").alias("next_conv"), F.col("jump_block").alias("next_block")
        )
        jumped = lookup(summed, steps, ["jump_conv", "jump_block"]).drop("jump_conv", "jump_block")
        after = keep_table(jumped.withColumnsRenamed({"next_conv": "jump_conv", "next_block": "jump_block"}), "trie-pieces")
        drop_tables(pieces)
        pieces = after
    sent = pieces.where("up_conv is not null")
    target = F.col("up_conv").alias("conv_id"), F.col("up_block").alias("block"), F.col("phi").alias("hi"), F.col("plo").alias("lo")
    return sent.groupBy(*target).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))


class NodeTable:
    """Flat arrays over the slots of a minimal perfect hash of node digests."""

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.hash = PerfectHash.build(high, low)
        slots = self.hash.place(high, low)
        self.high, self.low = np.empty_like(high), np.empty_like(low)
        self.high[slots], self.low[slots] = high, low
        if not (len(np.unique(slots)) == len(slots) == self.hash.size):
            raise ValueError("two nodes share a slot")
        self.slots = slots

    def slot(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that are not in the table."""
        at = self.hash.place(high, low)
        known = (at >= 0) & (self.high[at] == high) & (self.low[at] == low)
        return np.where(known, at, -1)

    def sums_below(self, depth: np.ndarray, parent: np.ndarray, *values: np.ndarray) -> None:
        """Add each value to all ancestors in place, the deepest nodes first; all arrays are by slot."""
        order = np.argsort(-depth, kind="stable")
        order = order[parent[order] >= 0]
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        for level in np.split(order, cuts):
            for value in values:
                np.add.at(value, parent[level], value[level])


_IN = "shard long, message boolean, hi long, lo long, phi long, plo long, depth long, leaf long, saved long"


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _IN sorted by shard to (hi, lo, n_leaves, saved_tokens) of each node."""

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.set_column(4, "phi", table.column("phi").fill_null(0)).set_column(5, "plo", table.column("plo").fill_null(0))
        message = table.column("message").to_numpy()
        own, sent = ({c: table.column(c).to_numpy()[m] for c in table.column_names[2:]} for m in (~message, message))
        u = lambda x: np.ascontiguousarray(x).view(np.uint64)
        nodes = NodeTable(u(own["hi"]), u(own["lo"]))
        by_slot = {c: np.empty_like(own[c]) for c in ("depth", "leaf", "saved")}
        parent = np.empty(len(own["hi"]), np.int64)
        for c in by_slot:
            by_slot[c][nodes.slots] = own[c]
        parent[nodes.slots] = np.where(own["phi"] == _ABSENT, -1, nodes.slot(u(own["phi"]), u(own["plo"])))
        if len(sent["hi"]):
            at = nodes.slot(u(sent["hi"]), u(sent["lo"]))
            if (at < 0).any():
                raise ValueError("a message for a node of another shard")
            for c in ("leaf", "saved"):
                np.add.at(by_slot[c], at, sent[c])
        nodes.sums_below(by_slot["depth"], parent, by_slot["leaf"], by_slot["saved"])
        columns = [nodes.high.view(np.int64), nodes.low.view(np.int64), by_slot["leaf"], by_slot["saved"]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hi", "lo", "n_leaves", "saved_tokens"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != number[lo]:
                yield shard(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield shard(held)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hi, lo, conv) in this order to (hi, lo, first, ids): the identifiers of a node in pieces, joined by commas."""
    for batch in batches:
        hi, lo, conv = (batch.column(i).to_numpy() for i in range(3))
        change = np.flatnonzero((np.diff(hi) != 0) | (np.diff(lo) != 0)) + 1
        cuts = sorted({0, *change.tolist(), *range(0, len(hi), CHUNK_IDS), len(hi)}) if len(hi) else []
        words = list(map(str, conv.tolist()))
        starts = cuts[:-1]
        ids = [",".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]
        columns = [pa.array(hi[starts]), pa.array(lo[starts]), pa.array(conv[starts]), pa.array(ids, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "first", "ids"])


def _running_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hi, lo, first, ids) in this order to (hi, lo, ends_sha256)."""
    key, digest = None, None

    def result(done: list) -> pa.RecordBatch:
        columns = [pa.array([d[0][i] for d in done], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.string())], names=["hi", "lo", "ends_sha256"])

    for batch in batches:
        done = []
        for hi, lo, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if key == (hi, lo):
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((key, digest.hexdigest()))
            key, digest = (hi, lo), hashlib.sha256(ids.encode())
        yield result(done)
    if key is not None:
        yield result([(key, digest.hexdigest())])


def end_digests(rows: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes where a conversation ends: the digest of their sorted identifiers.

    A digest runs over its text in order, so one task takes a node's last step; it reads joined identifiers in pieces.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.where("depth = length").select("hi", "lo", "conv")
    pieces = ends.repartitionByRange(n, "hi", "lo", "conv").sortWithinPartitions("hi", "lo", "conv")
    pieces = pieces.mapInArrow(_joined_ids, "hi long, lo long, first long, ids string")
    return pieces.repartition(n, "hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(_running_digest, "hi long, lo long, ends_sha256 string")


#: Stands for a parent that lies in another piece (or for none).
_ABSENT = -(1 << 63)


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the paths (see `own_paths`): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest member, parent_conv_id the parent's (null at the root, the empty prefix); n_convs counts the
    members, n_children the prefixes that are one turn longer; n_leaves counts the prefixes of the subtree without longer
    ones and saved_tokens adds up (n_convs - 1) times the last turn's bytes over it, each with the node itself.
    ends_sha256 is the digest of the identifiers, ascending and joined by commas, of the members that end there. Without
    any conversation there is no node.
    """
    find_package(paths.sparkSession)
    rows, found = _distinct_prefixes(paths)
    nodes = keep_table(_with_kin(found), "trie-nodes")
    shards = 1 + nodes.count() // SHARD_NODES
    shard = F.pmod(F.xxhash64("conv_id", "block"), F.lit(shards)).alias("shard")
    inner = F.col("up_conv").isNull()  # a head's parent is in another piece and gets a message
    parent = [F.when(inner, F.coalesce(c, F.lit(_ABSENT))).otherwise(F.lit(_ABSENT)).alias(c) for c in ("phi", "plo")]
    own = nodes.select(shard, F.lit(False).alias("message"), "hi", "lo", *parent, "depth", "leaf", "saved")
    absent = F.lit(_ABSENT)
    sent = _messages(nodes).select(shard, F.lit(True).alias("message"), "hi", "lo", absent.alias("phi"), absent.alias("plo"), F.lit(0).cast("long").alias("depth"), "leaf", "saved")
    dealt = own.union(sent).repartition("shard").sortWithinPartitions("shard")
    sums = dealt.mapInArrow(_accumulate, "hi long, lo long, n_leaves long, saved_tokens long")
    whole = nodes.drop("shard").join(sums, ["hi", "lo"]).join(end_digests(rows), ["hi", "lo"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )
