"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised alike: lower case, every run of characters that are no letters or digits as one
space, and one at either end, so that an item stands on whole words or pays for it. An item of m characters, however few,
may be found with k = floor(rate * m) edits. It is split, with its spaces, into k + 1 pieces; by the
pigeonhole principle any occurrence within k edits holds one piece unchanged, at most k places from where it should
stand. One automaton finds exact hits of all pieces in a text; the window around each hit is verified by Myers'
bit-parallel edit distance, so that the result is exact: an item is reported if and only if some substring of the
normalised text, with its spaces, is within k edits of it.

Items are read in blocks of at most BLOCK_CHARS characters; each block is broadcast and makes one pass over the
documents, with no shuffle. Memory of a task: one Arrow batch and the automaton of one block.

Edge cases: null or empty texts and items that normalise to nothing match nothing; items too short
for an edit are found unchanged, as whole words; repeated items are reported under each of their ids, repeated documents row
by row; of several occurrences the one of fewest edits counts, then the first; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, prepare, table

RATE = 0.08
BLOCK_CHARS = 2_000_000

_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def offsets(text: str, start: int, end: int) -> tuple[int, int]:
    """The range of a text that a range of its normalised form stems from."""
    places, pending = [], None
    for i, c in enumerate(text):
        for x in c.lower():
            if _GAP.match(x):
                pending = i if pending is None and places else pending
            else:
                if pending is not None:
                    places.append(pending)
                    pending = None
                places.append(i)
    return places[start], places[end - 1] + 1


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces with their offsets, of lengths that differ by one at most."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def masks(pattern: str) -> dict[str, int]:
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    return dict(peq)


def myers(peq: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """Fewest edits between the pattern and any substring of the text, and where the first such substring ends; None
    if more than k. One bit of the integers stands for one row of the matrix."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, k + 1, -1
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= k else None


class Matcher:
    """All items of one block. items: (item_id, text)."""

    def __init__(self, items: Iterable[tuple[int, str | None]], rate: float = RATE):
        import ahocorasick

        by_text: dict[str, list[int]] = defaultdict(list)
        for key, text in items:
            if norm := normalise(text):
                by_text[norm].append(key)
        self.items = [(f" {t} ", ids, int(rate * len(t))) for t, ids in by_text.items()]
        self.peq = [masks(t) for t, _, _ in self.items]
        self.peq_back = [masks(t[::-1]) for t, _, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (t, _, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                places[piece].append((n, at))
        self.automaton = ahocorasick.Automaton() if places else None
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, norm: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each item found in a normalised text."""
        padded = f" {norm} "
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        for last, (size, where) in self.automaton.iter(padded) if self.automaton else ():
            first = last + 1 - size
            for n, at in where:
                t, _, k = self.items[n]
                if best.get(n, (k + 1,))[0] == 0:
                    continue
                if k == 0:  # the one piece is the item
                    best[n] = (0, last + 1)
                    continue
                a, b = max(0, first - at - k), min(len(padded), first - at + len(t) + k)
                if done.get(n) == (a, b):
                    continue
                done[n] = (a, b)
                hit = myers(self.peq[n], len(t), padded[a:b], k)
                if hit is not None and (n not in best or (hit[0], a + hit[1]) < best[n]):
                    best[n] = (hit[0], a + hit[1])
        for n, (edits, end) in sorted(best.items()):
            t = self.items[n][0]
            a = max(0, end - len(t) - edits)
            back = myers(self.peq_back[n], len(t), padded[a:end][::-1], edits) if edits else (0, len(t))
            found = padded[end - back[1] : end]
            start = end - back[1] + len(found) - len(found.lstrip()) - 1
            yield n, edits, start, start + len(found.strip())


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks that stay below a number of characters; an item is never cut."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if block and size + len(r.text) > most:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    yield block


SCHEMA = "doc_id long, item_id long, edits int, start long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, edits, start and end (code points of the text) of every item found in every row."""
    spark = docs.sparkSession
    prepare(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def passes(block):
        shared = spark.sparkContext.broadcast((block, rate))  # BLOCK_CHARS at most, or one item

        def make():
            matcher = Matcher(*shared.value)

            def work(keys, texts):
                out: dict[str, list] = {f.name: [] for f in schema}
                for key, text in zip(keys, texts):
                    for n, edits, a, b in matcher.find(normalise(text)):
                        start, end = offsets(text, a, b)
                        for item in matcher.items[n][1]:
                            for name, value in zip(out, (key, item, edits, start, end)):
                                out[name].append(value)
                return out

            return work

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(map_rows(["doc_id", "text"], schema, make), SCHEMA)

    return reduce(DataFrame.unionByName, [passes(b) for b in blocks(benchmark)])


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows in which an item is found: one pass a block, no shuffle or join; columns stay."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index("text")

    def passes(rows, block):
        shared = spark.sparkContext.broadcast((block, rate))

        def run(batches):
            matcher = Matcher(*shared.value)
            for batch in batches:
                keep = [next(matcher.find(normalise(t)), None) is None for t in batch.column(at).to_pylist()]
                if any(keep):
                    yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    return reduce(passes, blocks(benchmark), docs)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
