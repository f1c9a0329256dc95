import math
import random

from corpusloom.llm import licenses as L


def test_headers_files_and_inheritance(spark):
    prose = "then the ertion of thatish\n" * 20
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", prose), ("a/b/COPYING", "This work is licensed under the GNU General\nPublic License, version 3."),
        ("a/y.py", prose + "Licensed under the Apache License, Version 2.0.\n" + prose), ("z/q.py", prose), ("top.py", "the licence of thatish is not the copyright of tion here and so on"),
        ("n/m.txt", "Licensed under CC BY-NC 4.0."), ("n/o/p.txt", None), ("n/o/p.txt", ""), (None, "Released under the MIT License."), (None, "none"), ("ab/x", prose), ("a/b/c/x.py", prose), ("a/big", prose * 3000 + "Released under the MIT License."),
        ("z/inline", "Copyright 2021 Acme Corp. Licensed under the Apache License, Version 2.0."), ("z/prose", "We write. Released under the MIT License. And on it goes for long."), ("z/page", "The text of this page is licensed under CC BY 4.0. Contact us for more."),
        ("z/wrapped", prose + "Permission is hereby\n * granted, free of charge, to any\n * person obtaining a copy of this\n * software and associated\n * documentation files" + prose),
    ]
    docs = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, licence string").repartition(3)
    got = {r.doc_id: (r.licence, r.origin, r.from_dir) for r in L.scan(docs).collect()}
    assert got[0] == ("MIT", "file", None) and got[1] == got[12] == ("GPL-3.0", "inherited", "a/b") and got[2] == ("GPL-3.0", "file", None)
    assert got[3] == ("Apache-2.0", "header", None) and got[4][0] != "MIT" and got[5] == got[11] == (None, None, None)
    assert got[6] == ("CC-BY-NC-4.0", "file", None) and got[7] == got[8] == ("CC-BY-NC-4.0", "inherited", "n")
    assert got[9][0] == "MIT" and got[10] == (None, None, None) and got[13] == ("MIT", "header", None) and len(got) == len(rows)
    assert got[14][0] == "Apache-2.0" and got[15] == ("MIT", "header", None) and got[16][0] == "CC-BY-4.0" and got[17] == ("MIT", "header", None)
    assert L.scan(docs.where("false")).count() == 0


def cosine(words, vector, idf, other):
    v = {w: words.count(w) * idf.get(w, other) for w in set(words)}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return sum(v.get(w, 0) * x for w, x in vector.items()) / norm if norm else 0.0


def test_windows_equal_all_windows(spark):
    rng = random.Random(4)
    idf, other, vectors = L.weights(L.TEMPLATES)
    known, texts = sorted(idf), ["copyright", "license mit mit", "zzz license zzz"]
    for _ in range(60):
        words = [rng.choice(known) if rng.random() < 0.2 else "prose" for _ in range(rng.randrange(0, 90))]
        cut, template = rng.randrange(len(words) + 1), L.words_of(rng.choice(L.TEMPLATES)[1])
        for _ in range(rng.randrange(4)):
            template[rng.randrange(len(template))] = rng.choice(["other", *known])
        texts.append(" ".join([*words[:cut], *template, *words[cut:]]))
    got = {r.doc_id: (r.own_licence, r.similarity) for r in L.scan(spark.createDataFrame([(i, "d/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string"), threshold=0.7).collect()}
    for i, t in enumerate(texts):
        words = L.words_of(t)
        scores = []
        for (_, text), (name, vector) in zip(L.TEMPLATES, vectors):
            n = len(L.words_of(text))
            scores += [(-round(cosine(words[s : s + n], vector, idf, other), 9), name) for s in range(max(1, len(words) - n + 1))]
        s, name = min(scores)
        assert (got[i][0] or None) == (name if -s >= 0.7 else None), t
        assert got[i][1] is None or abs(got[i][1] + s) < 2e-6


def test_whole_licence_files(spark):
    full = " ".join(f"clause{i} of the terms" for i in range(200))
    templates = [*L.TEMPLATES, ("Long-1.0", full)]
    rows = [(0, "a/LICENSE.txt", "Preamble. " + full), (1, "a/b/c.py", "no licence here"), (2, "e/code.py", full)]
    got = {r.doc_id: (r.licence, r.origin) for r in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), templates).collect()}
    assert got == {0: ("Long-1.0", "file"), 1: ("Long-1.0", "inherited"), 2: (None, None)}


def test_hot_directories(spark, monkeypatch):
    from corpusloom.llm import common

    rows = [(i, f"a/b{i % 3}/f{i}", "plain text") for i in range(90)] + [(200, "a/LICENSE", "Released under the MIT License.")] + [(300 + i, None, "no path") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    whole = sorted(map(str, L.scan(docs).collect()))
    monkeypatch.setattr(common, "HOT", 5)
    assert sorted(map(str, L.scan(docs).collect())) == whole
    assert sum("inherited" in r for r in whole) == 90
