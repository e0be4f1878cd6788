"""Byte-level BPE encoding and decoding by longest matches with backtracking.

Bytes are mapped to Latin-1, so an Aho-Corasick automaton over characters finds the tokens that start at each byte. The
encoder takes the longest, checks it against the token before it (two tokens may stand side by side only if the merges
of their bytes would leave them apart; memoised), tries shorter ones and backtracks at most once per byte position. The
ids equal those of applying the merges in rank order.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Sequence
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depvital.llm.common import named, nullable

#: Pieces and token pairs remembered by a worker; when full, the pieces not met since the last time are forgotten.
REMEMBERED = 120_000
#: Longer pieces are encoded anew each time.
REMEMBERED_BYTES = 64
#: Texts that go to a worker at once, so a batch stays small whatever the texts' lengths.
BATCH_CHARS = 2 << 20


def _later_characters() -> dict[int, int]:
    """Letters and numbers of a newer Unicode version than the one that the reference library splits by, each with a
    character that is neither."""
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    bytewise = {bytes([i]): i for i in range(256)}
    later: set[str] = set()
    for name in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=bytewise, special_tokens={})
        later |= set(regex.findall(name, text)) - set(bytes(probe.encode_ordinary(text)).decode())
    return dict.fromkeys(map(ord, later), 0xE000)


class Codec:
    """Encoder and decoder for one rank file (lines of base64 token and rank) and one pre-token pattern."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        rows = (line.split() for line in ranks_file.splitlines() if line)
        self.ranks: dict[bytes, int] = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.split_any = regex.compile(pattern).findall
        self.later = _later_characters()
        self.later_set = frozenset(map(chr, self.later))
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = list(map(len, self.tokens))
        self.packed = [struct.pack("<I", rank) for rank in range(size)]
        #: The two tokens that the last merge joins; a single byte stands for itself.
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.prefix: list[int | None] = [None] * size
        self.machine = ahocorasick.Automaton()
        reachable = set()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            parts = self._last_parts(token, rank)
            if len(parts) == 2:
                self.left[rank], self.right[rank] = parts
                self.merged[parts] = rank
            if len(parts) <= 2:
                reachable.add(token)
                self.machine.add_word(token.decode("latin-1"), rank)
        self.machine.make_automaton()
        for token in reachable:
            shorter = (token[:n] for n in range(len(token) - 1, 0, -1))
            self.prefix[self.ranks[token]] = next((self.ranks[t] for t in shorter if t in reachable), None)
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _last_parts(self, token: bytes, rank: int) -> tuple[int, ...]:
        """Ids left when the token's bytes are merged by lower ranks only; two if the token is one more merge."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], rank))
            if self.ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _apart(self, first: int, second: int) -> bool:
        """Whether merging the bytes of both tokens leaves exactly these two."""
        known = self.pairs.get((first, second))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[first, second] = self._stay_apart(first, second)
        return known

    def _stay_apart(self, first: int, second: int) -> bool:
        # undo the later of the two last merges, and look whether a merge across the border would have come before it
        limit = len(self.tokens)
        while True:
            joined = self.merged.get((first, second))
            if joined is not None and joined < limit:
                return False
            whole_first, whole_second = self.left[first] == first, self.left[second] == second
            if first > second and not whole_first or whole_second and not whole_first:
                limit, first = first, self.right[first]
            elif not whole_second:
                limit, second = second + 1, self.left[second]
            else:
                return True

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * (len(piece) + 1)
        lengths, prefix, known, apart = self.lengths, self.prefix, self.pairs.get, self._apart
        for end, rank in self.machine.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[rank]] = rank  # matches come by their ends: the last of a start is the longest
        shut: set[int] = set()
        ids: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + lengths[token]
            if end not in shut and (last < 0 or (known((last, token)) or apart(last, token))):
                ids.append(token)
                if end == len(piece):
                    return ids
                at, last, token = end, token, longest[end]
            elif (shorter := prefix[token]) is not None:
                token = shorter
            else:
                shut.add(at)
                token = ids.pop()
                last = ids[-1] if ids else -1
                at -= lengths[token]

    def _learn(self, piece: str) -> bytes:
        ids = self.old_pieces.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = np.array(self.merge(raw), "<u4").tobytes() if len(raw) > 256 else b"".join(map(self.packed.__getitem__, self.merge(raw)))
            if len(raw) > REMEMBERED_BYTES:
                return ids
        if len(self.pieces) >= REMEMBERED:
            self.old_pieces, self.pieces = self.pieces, {}
        self.pieces[piece] = ids
        return ids

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if text.isascii() or self.later_set.isdisjoint(text):
            return self.split_any(text)
        stops = list(accumulate(map(len, self.split_any(text.translate(self.later)))))
        return [text[a:b] for a, b in zip([0, *stops], stops)]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, learn = self.pieces.get, self._learn
        return b"".join([known(p) or learn(p) for p in self.split(text)])

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        known, learn = self.pieces.get, self._learn
        return [len(known(p) or learn(p)) >> 2 for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """The codec of a rank file, built once in each worker."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks_file, pattern)
    return _CODECS[key]


def small_batches(batch: pa.RecordBatch, text_at: int, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `chars` bytes of text, at least one row each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def read_ranks(ranks_path: str) -> bytes:
    """The rank file's bytes; under one megabyte for 50,000 tokens, so it may be broadcast."""
    with open(ranks_path, "rb") as file:
        return file.read()


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, *carry, n_tokens, ids): ids of each whole text without special tokens, as little-endian unsigned 32-bit
    integers; the columns named in `carry` come along.

    Null and empty texts have no ids (empty binary). Rows come back as they went in, repeated rows and null identifiers
    included; other columns are not read. An empty table gives an empty result.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for whole in batches:
            for batch in small_batches(whole, 0):
                ids = [own.encode(text or "") for text in batch.column(0).to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1), counts, pa.array(ids, pa.binary())], names=["row", "n_tokens", "ids"])

    rest = F.struct(named(id_col).cast("long").alias("doc_id"), *map(named, carry)).alias("row")
    texts = docs.select(named(text_col).cast("string").alias("text"), rest)
    schema = docs.select(rest, F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids")).schema
    return texts.mapInArrow(encode, nullable(schema)).select("row.*", "n_tokens", "ids")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with `ids_col` replaced by `decoded`, the bytes that the ids stand for; null ids decode to nothing."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for whole in batches:
            for batch in small_batches(whole, 0):
                texts = pa.array([own.decode(x or b"") for x in batch.column(0).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1), texts], names=["row", "decoded"])

    rest = F.struct(*[named(f.name) for f in encoded.schema.fields if f.name not in (ids_col, "decoded")]).alias("row")
    schema = encoded.select(rest, F.lit(b"").alias("decoded")).schema
    return encoded.select(named(ids_col).alias("ids"), rest).mapInArrow(decode, nullable(schema)).select("row.*", "decoded")


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """`encode_texts` with a further column decoded, the bytes that `decode_ids` makes of the ids, from one worker."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for whole in batches:
            for batch in small_batches(whole, 0):
                ids = [own.encode(text or "") for text in batch.column(0).to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [batch.column(1), counts, pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "ids", "decoded"])

    rest = F.struct(named(id_col).cast("long").alias("doc_id"), *map(named, carry)).alias("row")
    texts = docs.select(named(text_col).cast("string").alias("text"), rest)
    schema = docs.select(rest, F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")).schema
    return texts.mapInArrow(code, nullable(schema)).select("row.*", "n_tokens", "ids", "decoded")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes again, and digests both."""
    coded = round_trip(docs, ranks_path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
