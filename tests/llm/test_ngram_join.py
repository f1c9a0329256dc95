import random
from collections import defaultdict

from corpusloom.llm import ngram_join as N
from corpusloom.llm.components import components


def sets(texts, words):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute(rows, words, percent):
    got = sets([t for _, t in rows], words)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = got[i], got[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    return sorted((k or -1, len(got[i]), min(least[root(i)], default=-1) if got[i] else (k or -1)) for i, (k, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Tion", "THE", "x\ty"]
    line = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, rows = line(60), []
    bases = [line(rng.choice((1, 3, 4, 20, 60, 150))) for _ in range(n // 6)]
    bases += [line(25) + passage + line(5) for _ in range(10)] + [passage + line(2) for _ in range(10)]
    big = line(90)
    for i in range(n):
        w = list(big if i % 3 == 0 else rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = line(rng.randrange(2))
            w = w or line(1)
        rows.append((i * 3 % n if n % 3 else i, " ".join(w)))
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, " \n "), (n + 4, "a"), (n + 5, "A"), (None, rows[0][1]), (rows[1][0], rows[1][1]), (rows[2][0], "other words here and there")]


def test_components_equal_brute_force(spark):
    for seed, words, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 60)):
        rows = corpus(seed, 220)
        docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n long").repartition(3)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in N.near_duplicates(docs, words, percent).collect())
        want = brute(rows, words, percent)
        assert [(-1 if k == 0 else k, *x) for k, *x in got] == [(-1 if k == 0 else k, *x) for k, *x in want]


def test_frequent_shingles_only_change_the_order(spark, monkeypatch):
    rows = corpus(7, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "MAX_BROADCAST_IDS", 0)
    monkeypatch.setattr(N, "frequent", lambda docs, words: (N.np.empty(0, N.np.uint64), N.np.empty(0, N.np.int64)))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in N.near_duplicates(docs, 4, 85).collect())
    assert [x[:2] for x in got] == [x[:2] for x in brute(rows, 4, 85)] and [x[2] for x in got] == [x[2] for x in brute(rows, 4, 85)]


def test_empty_and_deduplicated(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g", "x"), (3, "A b c d e f g", "y"), (9, None, "z"), (None, "a b c d e f g", "n"), (8, "q r s", "k")], "doc_id long, text string, n string")
    assert N.near_duplicates(docs.where("false")).count() == 0
    kept = N.deduplicated(docs)
    clash = docs.withColumn("gone_id", docs.n).withColumn("component_id", docs.n).withColumn("cid", docs.n)
    assert sorted(r.n for r in N.deduplicated(clash).collect()) == sorted(r.n for r in kept.collect())
    assert kept.columns == docs.columns and sorted(r.n for r in kept.collect()) == ["k", "n", "y", "z"]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_deduplicated_deletes_rows_not_ids(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(5, a, "a5"), (3, a, "a3"), (5, b, "b5"), (7, c, "c7"), (7, c, "c7"), (7, c, "c7"), (7, b, "b7"), (8, None, "null"), (8, None, "null"), (None, a, "none")]
    for n in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, row_0 string").repartition(n)
        kept = N.deduplicated(docs)
        # the text b is nowhere else, though its row's doc_id is that of a copy; one of the repeated rows stays
        assert kept.columns == docs.columns and sorted(r.row_0 for r in kept.collect()) == ["a3", "b5", "c7", "none", "null", "null"]


def test_large_bucket_and_large_component(spark):
    """5,000 texts that share a passage and are not alike, 5,000 of one component, and one very long text."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(12)]
    rows = [(i, " ".join([f"u{i}_{j}" for j in range(14)] + passage)) for i in range(5000)]
    base = [f"b{i}" for i in range(80)]
    for i in range(5000, 10_000):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(10_000, " ".join(f"long{i}" for i in range(300_000))), (10_001, " ".join(f"long{i}" for i in range(299_990)))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 5, 80).collect()}
    assert all(got[i] == i for i in range(5000)) and all(got[i] == 5000 for i in range(5000, 10_000)) and got[10_001] == 10_000


def test_hot_keys(spark, monkeypatch):
    """Every shared key is hot, and every text that is compared often is salted."""
    from corpusloom.llm import common

    monkeypatch.setattr(common, "HOT", 30)
    monkeypatch.setattr(N, "HOT", 30)
    monkeypatch.setattr(N, "HEAVY_DF", 2)
    monkeypatch.setattr(N, "SALT_PAIRS", 2)
    rows = corpus(11, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in N.near_duplicates(docs, 4, 70).collect())
    assert got == [(-1 if k == 0 else k, *x) for k, *x in brute(rows, 4, 70)]


def test_prints_rule_out_no_similar_pair():
    rng = random.Random(15)
    hashes = lambda n: N.np.unique(N.np.array([rng.randrange(2**64) for _ in range(n)], N.np.uint64))
    ruled_out = 0
    for _ in range(300):
        base = hashes(rng.choice((1, 5, 90, 300, 3000)))
        a, b = (N.np.unique(N.np.concatenate([base[: max(1, int(len(base) * rng.uniform(0.5, 1)))], hashes(rng.randrange(1 + len(base) // 2))])) for _ in range(2))
        both = len(N.np.intersect1d(a, b))
        alike = 100 * both >= 80 * (len(a) + len(b) - both)
        assert N.may_be_alike(N.print_of(a), N.print_of(b), 80) or not alike
        ruled_out += not N.may_be_alike(N.print_of(a), N.print_of(b), 80)
    assert ruled_out > 100
    many = N.np.arange(2**22, dtype=N.np.uint64) * N.np.uint64(4096)  # one cell, above 255
    assert N.may_be_alike(N.print_of(many), N.print_of(many[:-9]), 99)
