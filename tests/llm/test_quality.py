import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import quality_nbsvm as Q


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("th", "er", "on", "is", "an", "re")) for _ in range(rng.randrange(1, 4)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.3
        kind = rng.randrange(3)
        if bad:
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rng.choice(("$$$", "###")) for w in words] if kind == 1 else [w for w in words for _ in range(9)]
        out.append((" ".join(words), int(not bad)))
    return out


def test_held_out_accuracy(spark):
    rows = texts(1, 900)
    docs = spark.createDataFrame([(i, t, 0) for i, (t, _) in enumerate(rows)] + [(5000, None, 0), (5001, "", 0), (None, "x", 0), (5002, "the " * 60000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(rows)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    usable = ~Q.held_out(F.col("doc_id"))
    model = Q.train(docs, labels, usable)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == rows[i][1] for i in held]) > 0.95
    assert {r.doc_id for r in docs.where(Q.held_out(F.col("doc_id"))).collect()} >= set(held)
    assert got[5000] == got[5001]
    kept = Q.kept(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s >= 0.7}


def test_fit_is_stable_and_defined_for_one_class():
    rows = texts(2, 200)
    a, b = (Q.fit([t for t, _ in rows], [q for _, q in rows]) for _ in range(2))
    assert a.weights == b.weights and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)
    one = Q.fit(["a b", "c"], [1, 1])
    assert one.score("anything", Q._Shapes()) == one.score(None, Q._Shapes()) == 0.75
    assert Q.fit([], []).score("x", Q._Shapes()) == 0.5


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = np.where(x @ np.array([1.0, -2, 0.5, 0]) + rng.normal(size=60) > 0, 1.0, -1.0)
    cost = np.full(60, 0.7)
    w = Q.dual_coordinate_descent([np.arange(4)] * 60, list(x), y, cost, 4, 2000)
    value = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert all(value(w) <= value(w + 0.01 * rng.normal(size=4)) + 1e-6 for _ in range(500))


def test_sample_is_bounded_and_repeats_count_once(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(7, "another text")] * 40 + [(8, "x" * (3 << 20)), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, 0), (7, 1), (60, 1)], "doc_id long, quality int")
    got = Q.sample(docs, labels)
    assert len(got) == 50 and sum(q for _, q in got) == 25 and ("text 8", 0) in got
    assert len([t for t, _ in got if t in ("text 7", "another text")]) == 1
    assert sum(len(t) for t, _ in Q.sample(docs, labels, max_bytes=100)) <= 100 and len(Q.sample(docs, labels, max_train=9)) == 9
    assert Q.sample(docs.where("false"), labels) == [] == Q.sample(docs, labels.where("false"))
