"""Line deduplication through sharded minimal perfect hashes.

Every distinct line key of a document becomes a 128-bit hash. Hashes that several documents hold are dealt to shards; a
shard is a minimal perfect hash over its hashes with compact arrays: fingerprint, number of documents, smallest
identifier. The documents' hashes (16 bytes, no lines) go to the shards and probe the arrays there; only what a document
loses comes back to it. A shard is one row of bounded size. The rows that probe a shard stream past its arrays sorted by
Spark and are dealt to several copies of the shard, so a line that a third of all documents hold stays spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depvital.llm.byte_bpe import small_batches
from depvital.llm.common import keep_table, named, nullable

#: Distinct repeated lines in a shard on average, and probing rows that one copy of a shard's arrays serves.
SHARD_LINES = 20_000
PROBES_PER_COPY = 200_000
BLANKS = " \t\n\x0b\x0c\r"
#: Slots per key in a level of the perfect hash.
GAMMA = 2.0
_LAST = (1 << 63) - 1


def line_key(line: str) -> bytes:
    """The line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANKS).encode().lower()


def _key_hashes(text: str, min_chars: int) -> list[bytes]:
    """Distinct hashes of the keys long enough to be compared, one for each line key."""
    keys = {k for line in set(text.split("\n")) if len(k := line.strip(BLANKS)) >= min_chars}
    return list({xxhash.xxh3_128_digest(k.encode().lower()) for k in keys})


def _mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """Hash number `level` of 128-bit keys."""
    x = high ^ (low * np.uint64(0x9E3779B97F4A7C15 + 2 * level))  # another odd factor for each level
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


class PerfectHash:
    """Minimal perfect hash by levels of bit arrays: a key sits in the first level where no other key has its slot."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        counts = [0, *np.cumsum([int(level.sum()) for level in levels]).tolist()]
        self.ranks = [np.cumsum(level, dtype=np.int64) - 1 + before for level, before in zip(levels, counts)]
        self.size = counts[-1]

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """From distinct keys."""
        levels: list[np.ndarray] = []
        while len(high):
            slots = max(8, int(GAMMA * len(high)))
            at = (_mixed(high, low, len(levels)) % np.uint64(slots)).astype(np.int64)
            level = np.bincount(at, minlength=slots) == 1
            levels.append(level)
            rest = ~level[at]
            high, low = high[rest], low[rest]
        return cls(levels)

    def place(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of each key, different for all keys it was built from; any index or -1 for other keys."""
        found = np.full(len(high), -1, np.int64)
        todo = np.arange(len(high))
        for number, (level, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                break
            at = (_mixed(high[todo], low[todo], number) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            found[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return found

    def store(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return sizes + b"".join(np.packbits(level).tobytes() for level in self.levels)

    @classmethod
    def load(cls, stored: bytes) -> PerfectHash:
        n = int(np.frombuffer(stored, "<i8", 1)[0])
        sizes = np.frombuffer(stored, "<i8", n, 8).tolist()
        at, levels = 8 * (n + 1), []
        for size in sizes:
            width = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(stored, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(high, low, doc): one row for each distinct line key of a document; docs: doc, text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 1):
                each = [_key_hashes(t or "", min_chars) for t in batch.column(1).to_pylist()]
                found = np.frombuffer(b"".join(h for doc in each for h in doc), "<i8").reshape(-1, 2)
                doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in each])
                columns = [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(doc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "doc"])

    return docs.select("doc", "text").mapInArrow(hashes, "high long, low long, doc long")


def _build_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, high, low, docs, first_doc) sorted by shard to one row of arrays for each shard."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        high, low = (table.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
        perfect = PerfectHash.build(high, low)
        order = np.argsort(perfect.place(high, low))
        arrays = [high[order], low[order], *(table.column(c).to_numpy()[order] for c in ("docs", "first_doc"))]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in arrays]
        columns = [table.column("shard").combine_chunks()[:1], pa.array([perfect.store()], pa.binary()), *blobs]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "hash", "high", "low", "docs", "first_doc"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != shard[lo]:
                yield rows(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield rows(held)


def _probe_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, copy, probe): a shard's arrays come first, then the hashes that probe them. Gives (doc, high,
    low) of lines that another document with a smaller identifier holds."""
    shard = None
    for batch in batches:
        own, probe = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(~probe)
        cuts = sorted({0, *heads.tolist(), *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)})
        out: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip(cuts, cuts[1:]):
            if not probe[lo]:
                blobs = [batch.column(i)[lo].as_py() for i in range(3, 8)]
                arrays = [np.frombuffer(b, t) for b, t in zip(blobs[1:], (np.uint64, np.uint64, np.int64, np.int64))]
                shard = (own[lo], PerfectHash.load(blobs[0]), *arrays)
                lo += 1
            if lo == hi or shard is None or shard[0] != own[lo]:
                continue
            part = batch.slice(lo, hi - lo)
            high, low, doc = (part.column(i).to_numpy(zero_copy_only=False) for i in (8, 9, 10))
            at = shard[1].place(high.view(np.uint64), low.view(np.uint64))
            known = (at >= 0) & (shard[2][at] == high.view(np.uint64)) & (shard[3][at] == low.view(np.uint64))
            lost = known & (shard[5][at] != doc)
            out.append((doc[lost], high[lost], low[lost]))
        if out:
            columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "high", "low"])


def line_shards(hashes: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """The shards' arrays over all lines that several documents hold, and how many shards there are."""
    several = F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")
    lines = hashes.groupBy("high", "low").agg(*several).where("first_doc <> last_doc").drop("last_doc")
    lines = keep_table(lines, "repeated-lines")
    shards = 1 + lines.count() // shard_lines
    dealt = lines.select(_shard(shards), "high", "low", "docs", "first_doc")
    built = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _build_shard, "shard long, hash binary, high binary, low binary, docs binary, first_doc binary"
    )
    return keep_table(built, "line-shards"), shards


def _shard(shards: int):
    return F.pmod(F.xxhash64("high", "low"), F.lit(shards)).cast("long").alias("shard")


def lost_lines(hashes: DataFrame, shard_lines: int = SHARD_LINES, probes_per_copy: int = PROBES_PER_COPY) -> DataFrame:
    """(doc, lost): the hashes (16 bytes each) of lines that each document loses."""
    arrays, shards = line_shards(hashes, shard_lines)
    probes = hashes.select(_shard(shards), "high", "low", "doc")
    copies = probes.groupBy("shard").agg((1 + F.floor(F.count(F.lit(1)) / probes_per_copy)).cast("int").alias("copies"))
    copies = keep_table(copies, "shard-copies")
    heads = arrays.join(copies, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("probe"),
        "hash", F.col("high").alias("highs"), F.col("low").alias("lows"), "docs", "first_doc",
        *[F.lit(None).cast("long").alias(c) for c in ("high", "low", "doc")],
    )
    per_shard = F.broadcast(copies) if shards <= 100_000 else copies
    dealt = probes.join(per_shard, "shard").select(
        "shard", F.pmod(F.xxhash64("doc"), F.col("copies")).cast("int").alias("copy"), F.lit(True).alias("probe"),
        *[F.lit(None).cast("binary").alias(c) for c in ("hash", "highs", "lows", "docs", "first_doc")], "high", "low", "doc",
    )
    both = heads.union(dealt).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "probe")
    lost = both.mapInArrow(_probe_shard, "doc long, high long, low long")
    return lost.groupBy("doc").agg(F.collect_list(F.struct("high", "low")).alias("lost"))


def _keep_lines(min_chars: int):
    """(row columns..., text, lost) to (row columns..., n_lines, n_dropped, kept_text)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 1):
                lists = batch.column(2)
                pairs = np.stack([x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()], axis=1).astype("<i8")
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                raw, at = pairs.tobytes(), 0
                n_lines, n_dropped, texts = [], [], []
                for text, end in zip(batch.column(1).to_pylist(), ends.tolist()):
                    text = text or ""
                    n_lines.append(text.count("\n") + 1)
                    if end > at:
                        drop = {raw[i : i + 16] for i in range(16 * at, 16 * end, 16)}
                        lines = text.split("\n")
                        kept = [x for x in lines if len(k := x.strip(BLANKS)) < min_chars or xxhash.xxh3_128_digest(k.encode().lower()) not in drop]
                        n_dropped.append(len(lines) - len(kept))
                        texts.append("\n".join(kept))
                    else:
                        n_dropped.append(0)
                        texts.append(text)
                    at = end
                columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "n_lines", "n_dropped", "kept_text"])

    return keep


def line_dedup(
    docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_lines: int = SHARD_LINES, probes_per_copy: int = PROBES_PER_COPY
) -> DataFrame:
    """The input's columns but the text, with n_lines, n_dropped and kept_text (in place of columns of the same names).

    Texts are split at newlines. A line's key is the line without blanks at its ends, A-Z in lower case. Lines whose key
    has at least `min_chars` code points and occurs in two documents or more go, except in the document with the smallest
    identifier; a line repeated inside that document stays repeated. Null and empty texts are one empty line. Rows with
    one identifier count as one document, and rows with a null identifier as one document behind all others. An empty
    table gives an empty result.
    """
    doc = F.coalesce(named(id_col).cast("long"), F.lit(_LAST)).alias("doc")
    rest = [named(f.name) for f in docs.schema.fields if f.name not in (text_col, "n_lines", "n_dropped", "kept_text")]
    rows = docs.select(F.struct(*rest).alias("row"), named(text_col).cast("string").alias("text"), doc)
    hashes = keep_table(line_hashes(rows, min_chars), "line-hashes")
    joined = rows.join(lost_lines(hashes, shard_lines, probes_per_copy), "doc", "left").select("row", "text", "lost")
    schema = joined.select("row", *[F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_dropped")], F.col("text").alias("kept_text")).schema
    return joined.mapInArrow(_keep_lines(min_chars), nullable(schema)).select("row.*", "n_lines", "n_dropped", "kept_text")
