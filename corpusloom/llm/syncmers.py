"""Document fingerprints by closed syncmers.

A k-mer of characters is a closed syncmer if its smallest s-mer (by hash) is the first or the last one. The choice
depends on the k-mer alone, so equal passages give equal anchors wherever they stand. Texts are compared by all their
anchors, however long they are, each at the position where it first occurs: of the anchors in common, the longest chain
that rises in both texts counts; its share among the anchors of both gives the likeness, as twice what is common over
the sum of both. The fingerprint that is written is a sketch of the SLOTS anchors of smallest hash; n_anchors and
anchors_sha256 stand for all of them. No likeness is taken from the sketch.

The next document in ascending doc_id comes from one range layout: cut points of doc_id (as many as scan partitions)
deal rows into blocks, each block is read in order by one task, and the first row of each block is sent once more to
the block before it, and that of the first block to the last. The driver gets one id a block.

Edge cases: null counts as empty; an empty text has the empty fingerprint, which is like itself (1.0) and nothing else
(0.0); a text shorter than k has one anchor, itself; rows of one doc_id follow each other in the order of their text's
hash; a null doc_id comes first; one row is its own next; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import hot_keys, map_rows, prepare, table

K, S = 16, 4
SLOTS = 64
#: Blocks of rows in the order of doc_id, for each task that reads them.
BLOCKS = 8

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _grams(c: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of a length, from those of its halves."""
    if size == 1:
        return _mix(c + _M1)
    a, n = size // 2, len(c) - size + 1
    left = _grams(c, a)
    right = left if size == 2 * a else _grams(c, size - a)
    # a power for each length, so that every place in the substring has its own
    return left[:n] * np.uint64(pow(int(_M1), size - a, 1 << 64)) + right[a : a + n]


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    have, m = 1, x
    while have * 2 <= size:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    n = len(x) - size + 1
    return m if have == size else np.minimum(m[:n], m[size - have : size - have + n])


def syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's closed syncmers; of a text shorter than k, of the text itself."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(c) < k:
        whole = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
        return np.array([whole], np.uint64), np.zeros(1, np.int64)
    inner, n = _mix(_grams(c, s)), len(c) - k + 1
    least = _window_min(inner, k - s + 1)
    at = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
    return _mix(_grams(c, k)[at]), at


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All distinct anchors: hashes in ascending order, and the first position of each."""
    h, at = syncmers(text)
    values, first = np.unique(h, return_index=True)
    return values, at[first]


def sketch(whole: tuple[np.ndarray, np.ndarray], slots: int = SLOTS) -> list[tuple[int, int]]:
    """The anchors of smallest hash, of which the upper half is kept, as (hash, first position)."""
    h, at = whole[0] >> np.uint64(32), whole[1]
    if not len(h):
        return []
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    first = np.minimum.reduceat(at, starts)
    return list(zip(h[starts[:slots]].tolist(), first[:slots].tolist()))


def fingerprint(text: str, slots: int = SLOTS) -> list[tuple[int, int]]:
    """The anchors of smallest hash as (hash, first position), in the order of hash."""
    return sketch(anchors(text), slots)


def digest(whole: tuple[np.ndarray, np.ndarray]) -> str:
    """SHA-256 of all anchors: the hashes, then the positions, eight bytes each."""
    return hashlib.sha256(whole[0].astype("<u8").tobytes() + whole[1].astype("<i8").tobytes()).hexdigest()


def to_text(anchors: list[tuple[int, int]]) -> str:
    return ",".join(f"{h:08x}@{p}" for h, p in anchors)


def likeness_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1, over all anchors of both; 1 for equal ones."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    chain: list[int] = []
    for q in b[1][j[np.argsort(a[1][i])]].tolist():
        if not chain or q > chain[-1]:
            chain.append(q)
        else:
            chain[bisect.bisect_left(chain, q)] = q
    share = len(chain) / (len(a[0]) + len(b[0]) - len(i))
    return 2 * share / (1 + share)


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    """likeness_of() over lists of (hash, position) without repeats, in the order of hash."""
    split = lambda x: (np.array([h for h, _ in x], np.uint64), np.array([p for _, p in x], np.int64))
    return likeness_of(split(a), split(b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row: one pass, no shuffle."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def make():
        return lambda keys, texts: {"doc_id": keys, "fingerprint": [to_text(fingerprint(t or "")) for t in texts]}

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(map_rows(["doc_id", "text"], schema, make), "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) laid out so that a task reads whole blocks in ascending doc_id: columns block, look,
    doc_id, text. look marks the row that follows the block's last one; it belongs to another block (or, of a table of
    one block, to the block's start). Rows of a hot doc_id (common.hot_keys) are blocks of their own, by
    ranges of their text's hash."""
    spark = docs.sparkSession
    ord_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), ord_.alias("ord"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs._jdf.queryExecution().toRdd().getNumPartitions())
    points = BLOCKS * n  # several a task, so that the hash deals them out evenly
    found = rows.select("ord").stat.approxQuantile("ord", [i / points for i in range(1, points)], 1 / (4 * points)) if points > 1 else []
    hot = [r.ord for r in hot_keys(rows.select("ord"), ["ord"])]
    cuts = np.array(sorted({*(int(min(max(x, -(2.0**63)), 2.0**62)) for x in found), *hot}), np.int64)
    shared = spark.sparkContext.broadcast((cuts, np.isin(cuts, hot)))  # a number for each scan partition and hot doc_id

    @F.pandas_udf("long")
    def block_of(ord_: pd.Series, h: pd.Series) -> pd.Series:
        points, is_hot = shared.value
        o = ord_.to_numpy(np.int64)
        at = np.searchsorted(points, o, side="left")
        if len(points):
            near = np.minimum(at, len(points) - 1)
            own = is_hot[near] & (points[near] == o)
            # blocks between cut points are even; a hot doc_id is an odd one with parts by the hash, in its order
            return pd.Series(((2 * at + own) << 8) + np.where(own, (h.to_numpy(np.int64) >> 56) + 128, 0))
        return pd.Series(at.astype(np.int64))

    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("block", block_of("ord", "h"))
    firsts = rows.groupBy("block").agg(F.min("ord").alias("ord"), F.min("h").alias("h")).collect()  # a row a block
    firsts = sorted((r.block, r.ord, r.h if (r.block >> 8) & 1 else None) for r in firsts)
    before = [firsts[k - 1][0] for k in range(len(firsts))]  # the first block's row goes to the last block
    sent = spark.createDataFrame([(b, to, o, h) for (b, o, h), to in zip(firsts, before)], "from_block long, to_block long, first long, first_h long")
    is_first = (F.col("block") == F.col("from_block")) & (F.col("ord") == F.col("first")) & (F.col("first_h").isNull() | (F.col("first_h") == F.col("h")))
    ahead = rows.join(F.broadcast(sent), is_first).select(F.col("to_block").alias("block"), F.lit(True).alias("look"), "ord", "h", "doc_id", "text")
    own = rows.select("block", F.lit(False).alias("look"), "ord", "h", "doc_id", "text")
    return own.unionByName(ahead).repartition(n, "block").sortWithinPartitions("block", "look", "ord", "h").select("block", "look", "doc_id", "text")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("n_anchors", pa.int64()), ("anchors_sha256", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Per row: the fingerprint of its text and of its text with the last quarter replaced by the start of the next
    document, the number and digest of all its anchors, and the likeness of these to those of the edited text and of the
    next document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def put(row, after, after_print):
            key, text, own = row
            n, q = len(text), len(text) // 4
            edited = text[: n - q] + after[:q] if q else text
            new = own if edited == text else anchors(edited)
            out.append((key, n, hashlib.sha256(edited.encode()).hexdigest(), to_text(sketch(own)), to_text(sketch(new)), len(own[0]), digest(own), likeness_of(own, new), likeness_of(own, after_print)))

        def batch_of():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)
            out.clear()
            return made

        for batch in batches:
            for block, look, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = anchors(text)
                if held is not None and held[0] == block:
                    put(held[1], text, own)
                # of several rows that look ahead the first counts
                held = None if look else (block, (key, text, own))
            if out:
                yield batch_of()

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, n_anchors long, anchors_sha256 string, near_edited double, near_next double")


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
