import hashlib
import random

import numpy as np

from corpusloom.llm import syncmers as S


def test_closed_syncmers_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("abé d🙂") for _ in range(rng.randrange(16, 120)))
        _, at = S.syncmers(text)
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        value = {text[i : i + 4]: int(x) for i, x in enumerate(S._mix(S._grams(c, 4)))}
        want = []
        for i in range(len(text) - 15):
            inner = [value[text[j : j + 4]] for j in range(i, i + 13)]
            if min(inner) in (inner[0], inner[-1]):
                want.append(i)
        assert at.tolist() == want
        assert len({text[i : i + 16] for i in at.tolist()}) == len(set(S.syncmers(text)[0].tolist()))


def test_grams_of_any_size():
    text = "abcabcabdabc" * 3
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    for size in (1, 2, 3, 5, 6, 7, 12):
        h = S._grams(c, size).tolist()
        parts = [text[i : i + size] for i in range(len(text) - size + 1)]
        assert len(h) == len(parts) and len(set(h)) == len(set(parts)) == len(set(zip(h, parts)))


def test_fingerprints():
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choice("thernosia") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    a, b = line(4000), line(4000)
    fa = S.fingerprint(a)
    assert fa == S.fingerprint(a) and S.likeness(fa, fa) == 1.0 and S.likeness(fa, S.fingerprint(b)) < 0.1
    assert 0.55 < S.likeness(fa, S.fingerprint(a[: len(a) * 3 // 4] + b[: len(a) // 4])) < 0.92
    assert S.likeness(fa, S.fingerprint("new start " + a)) > 0.95
    h, at = S.syncmers(a)
    values, first = np.unique(h >> np.uint64(32), return_index=True)
    assert fa == [(int(v), int(at[i])) for v, i in zip(values[:64], first[:64])]
    assert S.likeness([], []) == 1.0 and S.likeness([], fa) == 0.0 and S.fingerprint("") == []


def test_rows_in_order(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["one", "two", "thréé", "four", "x"]) for _ in range(rng.randrange(0, 60))) for _ in range(90)]
    rows = [(i * 7 - 100, t) for i, t in enumerate(texts)] + [(10**15, None), (10**15 + 1, ""), (10**15 + 2, "z" * 200000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([(k, t, 1) for k, t in shuffled], "doc_id long, text string, look int").repartition(7)
    got = {r.doc_id: r for r in S.edited_likeness(docs).collect()}
    assert len(got) == len(rows) == S.edited_likeness(docs).count()
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[k].edited_fingerprint == S.to_text(S.fingerprint(edited)) and got[k].fingerprint == S.to_text(S.fingerprint(t))
        assert got[k].near_next == S.likeness(S.fingerprint(t), S.fingerprint(after))
    assert len({r.fingerprint for r in S.fingerprints(docs).collect()}) > 50
    assert S.edited_likeness(docs.where("false")).count() == 0
    one = S.edited_likeness(spark.createDataFrame([(3, "only one here"), (None, "no id"), (3, "only one here")], "doc_id long, text string")).collect()
    assert sorted(r.n_chars for r in one) == [5, 13, 13]


def test_long_texts_are_compared_by_all_anchors(spark):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("thernosia") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared, a, b = line(50), line(6000), line(6000)
    x, y = a[:15000] + shared + a[15000:], b[:9000] + shared + b[9000:]
    got = S.edited_likeness(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")).where("doc_id = 1").first()

    def first(text):
        out = {}
        for h, p in zip(*(v.tolist() for v in S.syncmers(text))):
            out.setdefault(h, p)
        return out

    def brute(s, t):
        p, q = first(s), first(t)
        pairs = sorted((p[h], q[h]) for h in p if h in q)
        best = []
        for i, (_, v) in enumerate(pairs):
            best.append(1 + max((best[k] for k in range(i) if pairs[k][1] < v), default=0))
        j = max(best, default=0) / len(set(p) | set(q))
        return 2 * j / (1 + j)

    assert got.near_next == brute(x, y) > 0.0
    edited = x[: len(x) - len(x) // 4] + y[: len(x) // 4]
    # the share of the text that stays, to a hundredth
    assert got.n_anchors == len(first(x)) > 3000 and abs(got.near_edited - 0.75) < 0.01
    assert got.near_edited == S.likeness_of(S.anchors(x), S.anchors(edited))
    assert got.anchors_sha256 == S.digest(S.anchors(x)) != S.digest(S.anchors(edited))


def test_a_doc_id_of_many_rows_is_split(spark, monkeypatch):
    from corpusloom.llm import common

    rng = random.Random(10)
    text = lambda: " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randrange(1, 30)))
    rows = [(5, text()) for _ in range(150)] + [(i, text()) for i in range(120)] + [(None, text()) for _ in range(60)] + [(2**62 + i, text()) for i in range(20)] + [(5, "same text")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = sorted(map(str, S.edited_likeness(docs).collect()))
    monkeypatch.setattr(common, "HOT", 8)
    assert sorted(map(str, S.edited_likeness(docs).collect())) == whole and len(whole) == len(rows)
    blocks = {(r.block, r.doc_id) for r in S.in_order(docs).where("not look").collect()}
    assert len({b for b, k in blocks if k == 5}) > 50 and len({b for b, k in blocks if k is None}) > 20
