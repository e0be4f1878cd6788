from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from depvital.llm import token_counts
from depvital.llm.byte_bpe import Codec, decode_ids, encode_texts, read_ranks, round_trip
from depvital.llm.queries import RANKS

from .conftest import AWKWARD

PIECES = ["a", "b", "th", "ing", "é", "ñ", "中", "的", " ", "  ", "\n", "\t", "1", "23", "'s", "'", "!", "...", "ß", "\x85", "\x1c", "🙂", "́", "ا", "ll"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return Codec(read_ranks(RANKS), public_tokenizers.PATTERN)


def texts(seed, count, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def test_ids_equal_the_library(coder, library):
    for text in [*texts(1, 2000, 60), "a" * 3000, " " * 3000, "ab" * 2000, "中" * 900, "\n" * 500]:
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_every_character_is_classed_alike(coder, library):
    for code in [*range(0xD800), *range(0xE000, 0x110000, 7)]:
        text = f"a{chr(code)}a 1"
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text), hex(code)


def test_awkward_rows(documents, library):
    encoded = encode_texts(documents(AWKWARD), RANKS, public_tokenizers.PATTERN, carry=["source", "a.b"])
    got = decode_ids(encoded.withColumn("again", encoded["ids"]), RANKS, public_tokenizers.PATTERN, "again").collect()
    want = [(d, s, len(ids := library.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for d, t, _, s in AWKWARD]
    key = repr
    assert sorted(((r.doc_id, r.source, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)
    both = round_trip(documents(AWKWARD), RANKS, public_tokenizers.PATTERN, carry=["source", "a.b"]).collect()
    assert sorted(((r.doc_id, r.source, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in both), key=key) == sorted(want, key=key)
    assert encode_texts(documents([]), RANKS, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_counts_follow_edits(coder, monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF_PIECES", leaf)
    rng = random.Random(leaf)
    for text in texts(leaf, 400, 120):
        tree = token_counts.CountTree.build(coder, text)
        for _ in range(3):
            edits = [(a := rng.randint(0, len(text) + 2), a + rng.choice([0, 0, 1, 5, 30]), rng.choice(PIECES) * rng.randint(0, 3)) for _ in range(rng.randint(0, 4))]
            want = token_counts._spliced(text, 0, len(text), token_counts._ordered(edits, len(text)))
            text, _ = tree.edit(coder, text, edits)
            assert text == want
            assert tree.n_tokens == len(coder.encode(text)) // 4
            tree = token_counts.CountTree.load(tree.store())


def test_an_edit_splits_only_its_surroundings(coder):
    text = "some words of a long text " * 4000
    tree = token_counts.CountTree.build(coder, text)
    new, again = tree.edit(coder, text, [(50_000, 50_004, "other")])
    assert again < 2000 and tree.n_tokens == len(coder.encode(new)) // 4


def test_counts_of_awkward_rows(documents, library):
    built = token_counts.build_counts(documents(AWKWARD), RANKS, public_tokenizers.PATTERN)
    edited = token_counts.replace_matches(built, "t(e)", r"<\1>", RANKS, public_tokenizers.PATTERN)
    at_once = token_counts.replace_matches(token_counts.unbuilt(documents(AWKWARD)), "t(e)", r"<\1>", RANKS, public_tokenizers.PATTERN)
    assert sorted(at_once.drop("split_again").collect(), key=repr) == sorted(edited.drop("split_again").collect(), key=repr)
    want = []
    for doc, text, *_ in AWKWARD:
        text = text or ""
        new = text.replace("te", "<e>")
        want.append((doc, new, len(library.encode_ordinary(new)), len(library.encode_ordinary(text)), text.count("te")))
    got = [(r.doc_id, r.text, r.n_tokens, r.n_tokens_before, r.n_edits) for r in edited.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_counts.build_counts(documents([]), RANKS, public_tokenizers.PATTERN).collect() == []


def test_given_edits(spark, documents, library):
    state = token_counts.build_counts(documents([(1, "one two three"), (2, None), (3, "kept")]), RANKS, public_tokenizers.PATTERN)
    edits = "CASE doc_id WHEN 1 THEN array(named_struct('start', 4, 'stop', 7, 'text', 'zwei'), named_struct('start', 50, 'stop', 60, 'text', '!')) WHEN 2 THEN array(named_struct('start', 0, 'stop', 0, 'text', 'new text')) END"
    rows = token_counts.apply_edits(state.selectExpr("*", f"{edits} AS edits"), RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: (r.text, r.n_edits) for r in rows} == {1: ("one zwei three!", 2), 2: ("new text", 1), 3: ("kept", 0)}
    assert all(r.n_tokens == len(library.encode_ordinary(r.text)) for r in rows)
