"""BPE encoding and decoding by tree concatenation.

A text is cut at context-free boundaries (an ASCII letter or digit followed by a space: no piece of the split pattern
and no special token contains that pair, so what stands before and after is encoded alike on its own or together).
Spans between boundaries that stay short are encoded in runs. A long unsplit span is cut into the split pattern's
pieces, and a long piece is encoded as a tree: it is halved down to leaves, which THREADS threads encode side by side (the
encoder lets go of the interpreter's lock), and level by level, around each join, a growing
window of tokens is encoded again until the window's first and last tokens agree exactly with those that stand there.
That is a proof, not a guess: a sequence of tokens is the encoding of its bytes if and only if every adjacent pair is
the encoding of its own bytes. Pairs outside the window stood in an encoding, pairs inside stand in the window's
encoding, and the two border pairs are unchanged as the border tokens agree.

Memory of a task is bounded by the largest text and one Arrow batch. There is no shuffle.

Edge cases: null counts as empty (no ids); the special string inside a text becomes its id, as is the library's
default; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, prepare, table
from corpusloom.llm.tokenizers import SPECIAL, SPECIAL_ID, default_byte_bpe

#: Characters of a run of short spans that is encoded in one call.
RUN_CHARS = 1 << 16
#: A span without a context-free boundary of more characters is long.
LONG_CHARS = 4096
#: Bytes of a leaf of the tree.
LEAF_BYTES = 2048
#: Leaves of a piece that are encoded at once; a task has the cores of spark.task.cpus.
THREADS = 2
#: Tokens on either side of a join in its first window.
WINDOW = 8

_BOUNDARY = re.compile(r"(?<=[A-Za-z0-9]) ")


@functools.lru_cache(maxsize=4)
def _unsplit(enc):
    """The same vocabulary, by which a text is one piece."""
    import tiktoken

    return tiktoken.Encoding(f"{enc.name}-unsplit", pat_str=r"[\s\S]+", mergeable_ranks=enc._mergeable_ranks, special_tokens={})


def halves(piece: bytes, leaf: int) -> Iterator[bytes]:
    """Leaves of the tree, in order; characters stay whole, so that one of them may be longer."""
    mid = len(piece) // 2
    while mid and piece[mid] & 0xC0 == 0x80:
        mid -= 1
    if len(piece) <= leaf or not mid:
        yield piece
    else:
        yield from halves(piece[:mid], leaf)
        yield from halves(piece[mid:], leaf)


def encode_piece(enc, piece: bytes, leaf: int = LEAF_BYTES, threads: int = THREADS) -> list[int]:
    """Ids of one unsplit piece, as a tree of halves."""
    if len(piece) <= leaf:
        return enc._encode_single_piece(piece)
    parts = _unsplit(enc).encode_ordinary_batch([x.decode() for x in halves(piece, leaf)], num_threads=threads)
    while len(parts) > 1:
        parts = [join(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def join(enc, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
    """The encoding of two encodings' bytes together."""
    k = window
    while True:
        a, b = max(0, len(left) - k), min(len(right), k)
        mid = enc._encode_single_piece(enc.decode_bytes(left[a:] + right[:b]))
        if (a == 0 or mid[0] == left[a]) and (b == len(right) or mid[-1] == right[b - 1]):
            return left[:a] + mid + right[b:]
        k *= 2


def spans(text: str) -> Iterator[tuple[bool, int, int]]:
    """Runs of a text from boundary to boundary, as (long, start, end); together they are the whole text."""
    n, start, last = len(text), 0, 0
    if n <= LONG_CHARS:
        yield False, 0, n
        return
    for at in [m.start() for m in _BOUNDARY.finditer(text)] + [n]:
        if at - last > LONG_CHARS:
            if last > start:
                yield False, start, last
            yield True, last, at
            start = at
        elif at - start > RUN_CHARS:
            yield False, start, last
            start = last
        last = at
    if n > start:
        yield False, start, n


def encode(enc, text: str) -> list[int]:
    """Ids of a whole text."""
    ids: list[int] = []
    for is_long, a, b in spans(text):
        part = text[a:b]
        if not is_long:
            ids.extend(enc.encode(part, allowed_special="all"))
            continue
        for i, ordinary in enumerate(part.split(SPECIAL)):
            if i:
                ids.append(SPECIAL_ID)
            for piece in _split(enc, ordinary):
                ids.extend(encode_piece(enc, piece.encode()))
    return ids


def _split(enc, text: str) -> list[str]:
    """Pieces by the encoder's own pattern."""
    import regex

    return regex.findall(enc._pat_str, text)


def decode(enc, ids: list[int]) -> str:
    return enc.decode_bytes(ids).decode("utf-8", errors="replace")


def encoded(docs: DataFrame, encoder=default_byte_bpe) -> DataFrame:
    """doc_id and ids of every row's text. encoder: makes the encoder, once a Python worker."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def make():
        enc = encoder()
        return lambda keys, texts: {"doc_id": keys, "ids": [encode(enc, t or "") for t in texts]}

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(map_rows(["doc_id", "text"], schema, make), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, encoder=default_byte_bpe) -> DataFrame:
    """doc_id and text of every row's ids; null ids count as none."""
    prepare(rows.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def make():
        enc = encoder()
        return lambda keys, ids: {"doc_id": keys, "text": [decode(enc, x or []) for x in ids]}

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(map_rows(["doc_id", "ids"], schema, make), "doc_id long, text string")


def digests(docs: DataFrame, encoder=default_byte_bpe) -> DataFrame:
    """Per row: the number of ids, their SHA-256 as little-endian 32-bit integers, and that of the decoded text. Encoding
    and decoding share one pass, so that ids never leave the worker."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make():
        enc = encoder()

        def work(keys, texts):
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, text in zip(keys, texts):
                ids = encode(enc, text or "")
                out["doc_id"].append(key)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decode(enc, ids).encode()).hexdigest())
            return out

        return work

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(map_rows(["doc_id", "text"], schema, make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
