"""Byte-level BPE encoders, one per Python worker."""

from __future__ import annotations

import base64
import functools
import os

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def default_dir() -> str:
    """The folder of the public vocabularies; the vocabulary path is a parameter everywhere else."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


@functools.lru_cache(maxsize=4)
def byte_bpe(ranks_path: str, pattern: str, special: str = SPECIAL, special_id: int = SPECIAL_ID):
    """A tiktoken encoder over a rank file. Its ids equal those of the tokenizers library for the JSON form of
    the same vocabulary: the split pattern, ranks and the one added token are the same (tests/llm compares them)."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(os.path.basename(ranks_path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: special_id})


def default_byte_bpe():
    import public_tokenizers

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
