import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import shards as S


def plain(sizes, shards):
    """One by one: each group to the least-loaded shard; number of groups and bytes of every shard by size."""
    heap, got = [(0, s) for s in range(shards)], defaultdict(Counter)
    for size in sorted(sizes, reverse=True):
        load, shard = heapq.heappop(heap)
        got[size][shard] += 1
        heapq.heappush(heap, (load + size, shard))
    return {k: dict(v) for k, v in got.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=120), st.integers(1, 7))
def test_schedule_is_longest_processing_time(sizes, shards):
    got = {}
    for size, ranges in S.schedule(sorted(Counter(sizes).items(), reverse=True), shards):
        ends = [0, *(e for e, _ in ranges)]
        got[size] = Counter()
        for a, (b, s) in zip(ends, ranges):
            got[size][s] += b - a
    assert {k: dict(v) for k, v in got.items()} == plain(sizes, shards)


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(5, texts[5], 3), (None, "no id", 3)], "doc_id long, text string, shard int").repartition(5)


@pytest.mark.parametrize("part", [1 << 16, 7])
def test_shards_are_those_of_the_plain_schedule(spark, part):
    rng = random.Random(2)
    texts = ["copy " * 30] * 700 + ["é" * rng.randrange(0, 40) + str(i % 10) for i in range(1300)] + [None, "", None, "", "L" * 2_000_000]
    docs = rows_of(spark, texts)
    got = S.sharded(docs, part=part).collect()
    assert len(got) == len(texts) + 2
    slots, group, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        slots[r.shard].append(r.slot)
        group[text].add(r.shard)
        sizes[text] += r.size
    assert all(len(s) == 1 for s in group.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    placed = defaultdict(Counter)
    for text, size in sizes.items():
        placed[size][next(iter(group[text]))] += 1
    assert {k: dict(v) for k, v in placed.items()} == plain(sizes.values(), 16)
    again = {(r.doc_id, r.shard) for r in S.sharded(docs.repartition(2), part=part).collect()}
    assert again == {(r.doc_id, r.shard) for r in got}


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    from corpusloom.llm import common

    left = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(400)] + [(None, -1)] * 60, "k int, v int")
    right = spark.createDataFrame([(k, str(k)) for k in range(10)], "k int, name string")
    want = {how: sorted(map(str, left.join(right, ["k"], how).collect())) for how in ("inner", "left")}
    monkeypatch.setattr(common, "HOT", 4)
    for how in want:
        assert sorted(map(str, common.join_unique(left, right, ["k"], how).collect())) == want[how]


def test_empty_table(spark):
    assert S.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
