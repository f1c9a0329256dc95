"""Token counts of whole texts by overlap resynchronisation.

A huge document is encoded in overlapping chunks. Each chunk's tokens have byte offsets; two neighbours are spliced at
a boundary that both have and that is proven stable: an ASCII letter or digit followed by a space, which no piece of
the split pattern and no special token spans, so that both encodings are exact there. Where the overlap holds no such
boundary, or the two encodings do not both break there, the left chunk is widened (doubled, up to the whole rest) and
encoded again. Texts up to one chunk are encoded directly. A long run without a boundary, such as a million spaces, is
encoded piece by piece (bpe_tree.encode), as the encoder's own split overflows its stack on it.

Memory of a task: one Arrow batch and the tokens of one chunk (of the widened chunk for text without any such
boundary). There is no shuffle.

Edge cases: null counts as empty (0 bytes, 0 tokens); the special string inside a text counts as one token, as is the
library's default; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe_tree import encode
from corpusloom.llm.common import map_rows, prepare, table
from corpusloom.llm.tokenizers import SPECIAL, SPECIAL_ID, default_byte_bpe

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 512
LIMIT = 512

_STABLE = re.compile(r"(?<=[A-Za-z0-9]) ")


class Counter:
    def __init__(self, enc, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        if not 0 < overlap < chunk:
            raise ValueError("overlap must be positive and smaller than chunk")
        self.enc, self.chunk, self.overlap = enc, chunk, overlap
        self.width = np.zeros(max(enc.n_vocab, SPECIAL_ID + 1), np.int64)
        for token in enc.token_byte_values():
            self.width[enc.encode_single_token(token)] = len(token)
        self.width[SPECIAL_ID] = len(SPECIAL)

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets at which the tokens of a text end."""
        return np.cumsum(self.width[encode(self.enc, text)])

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(encode(self.enc, text))
        total, start, size = 0, 0, self.chunk
        ends = None
        while True:
            stop = min(len(text), start + size)
            if ends is None:
                ends = self.ends(text[start:stop])
            if stop == len(text):
                return total + len(ends)
            begin = stop - self.overlap
            ahead = min(len(text), begin + self.chunk)
            after = self.ends(text[begin:ahead])
            splice = self._splice(text, start, begin, stop, ends, after)
            if splice is None:
                size, ends = size * 2, None  # widen and align again
                continue
            at, before, skipped = splice
            total += before
            # from here on the right chunk is the left one; its tokens before the splice are not its own
            start, size, ends = at, ahead - at, after[skipped:] - (after[skipped - 1] if skipped else 0)

    def _splice(self, text: str, start: int, begin: int, stop: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int, int] | None:
        """A stable boundary as a character position, with the tokens before it in either chunk."""
        for m in _STABLE.finditer(text, begin + 1, stop):
            at = m.start()
            a, b = len(text[start:at].encode()), len(text[begin:at].encode())
            i, j = int(np.searchsorted(left, a)), int(np.searchsorted(right, b))
            if i < len(left) and left[i] == a and j < len(right) and right[j] == b:
                return at, i + 1, j + 1
        return None


def token_counts(docs: DataFrame, encoder=default_byte_bpe, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def make():
        counter = Counter(encoder())

        def work(keys, texts):
            counts = [counter.count(t or "") for t in texts]
            return {"doc_id": keys, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return work

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(map_rows(["doc_id", "text"], schema, make), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
