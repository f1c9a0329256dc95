import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe_tree, token_counts
from corpusloom.llm.tokenizers import default_byte_bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENC = default_byte_bpe()

TEXTS = [
    "", " ", "a", "Hello there, it's 12,345 o'clock.\n\n  x ", "<|endoftext|>", "ab<|endoftext|> cd<|endof", "é漢字🙂" * 50,
    "a" * 9001, "ab" * 5000, "x" * 5000 + "<|endoftext|>" + "漢字" * 4000, "!?" * 6000, "1234567" * 2000, " " * 7000, "\n \t" * 3000 + "end",
    "word " * 30000, "word" * 3000 + " tail " + "Ünïcödé" * 2000, ("ertion th of " * 400 + "\n") * 20, "'s't" * 3000,
]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_encode_equals_the_library(text):
    assert bpe_tree.encode(ENC, text) == ids(text)
    assert bpe_tree.decode(ENC, ids(text)) == LIBRARY.decode(ids(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abetonhis", max_size=120), st.integers(1, 9))
def test_tree_of_small_leaves_is_exact(text, leaf):
    piece = text.encode()
    if piece:
        assert bpe_tree.encode_piece(ENC, piece, leaf) == ENC._encode_single_piece(piece)


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (64, 16), (1000, 3)])
def test_count_equals_the_library(text, chunk, overlap):
    assert token_counts.Counter(ENC, chunk, overlap).count(text) == len(ids(text))


@pytest.mark.parametrize("run", [" ", "\n", "ab", "!?", " \n"])
def test_two_million_characters_without_a_boundary(run):
    text = "Head " + run * (2_000_000 // len(run)) + " tail."
    assert token_counts.Counter(ENC).count(text) == len(ids(text)) and bpe_tree.encode(ENC, text) == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n'é漢<|>.s"), max_size=400))
def test_count_of_any_text(text):
    assert token_counts.Counter(ENC, 24, 8).count(text) == len(ids(text))


def test_queries_over_edge_rows(spark):
    rows = [(1, "Hello <|endoftext|> there", 0), (1, "Hello <|endoftext|> there", 1), (2, None, 0), (3, "", 0), (4, "long " * 20000, 0), (None, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tree.digests(docs).collect()}
    want = {(k, len(ids(t or "")), hashlib.sha256(struct.pack(f"<{len(ids(t or ''))}I", *ids(t or ""))).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t, _ in rows}
    assert got == want
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect()}
    assert counts == {(k, len((t or "").encode()), len(ids(t or "")), len(ids(t or "")) > 512) for k, t, _ in rows}
    round_trip = bpe_tree.decoded(bpe_tree.encoded(docs)).collect()
    assert sorted(r.text for r in round_trip) == sorted(t or "" for _, t, _ in rows)
    empty = docs.where("false")
    assert bpe_tree.digests(empty).count() == token_counts.token_counts(empty).count() == 0
