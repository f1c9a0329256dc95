import random

from corpusloom.llm import decontaminate as D


def best(pattern, text):
    """Fewest edits against any substring, by the plain matrix."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != x)))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[i : i + (kind > 0)] = [] if kind == 1 else [rng.choice("abcdxyz")]
    return "".join(s)


def test_myers_equals_the_matrix():
    rng = random.Random(1)
    for _ in range(500):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randrange(1, 70))) for _ in range(2))
        hit = D.myers(D.masks(p), len(p), t, len(p))
        assert hit is not None and (hit[0] == best(p, t) or best(p, t) == len(p))


def test_every_item_within_the_budget_is_found():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 3, 5, 8, 20, 30))))) for i in range(40)]
    matcher = D.Matcher(items, rate=0.1)
    seen = 0
    for _ in range(400):
        text = " ".join(word() for _ in range(20))
        key, item = rng.choice(items)
        text = f"{text} {edited(rng, item, rng.randrange(0, 2 + len(item) // 6))} {text[::-1]}"
        norm = D.normalise(text)
        want = {i: best(f" {t} ", f" {norm} ") for i, t in items if best(f" {t} ", f" {norm} ") <= int(0.1 * len(t))}
        assert {matcher.items[n][1][0]: e for n, e, _, _ in matcher.find(norm)} == want
        for n, e, a, b in matcher.find(norm):
            assert best(matcher.items[n][0], f" {norm[a:b]} ") <= e and norm[a:b] == norm[a:b].strip()
        seen += len(want)
    assert seen > 100


def test_rows(spark):
    item = "Onsh er thention, of andre the lyst inger; haed 12 thatish!"
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, "", 0), (4, None, 0), (5, "short one", 0)], "item_id long, text string, doc_id int")
    rows = [(1, f"Éa b. {item.upper().replace(' ', '  ')} end", 9), (1, "no leak here", 9), (2, None, 9), (3, "", 9), (4, "z " * 50000 + item + " q" * 50000, 9), (None, "A Short, one.", 9), (6, "shortone", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits int")
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in D.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (1, 2), (4, 1), (4, 2), (None, 5)}
    assert rows[0][1][slice(*got[1, 1][1:])].startswith("ONSH") and got[4, 1] == (0, 100000, 100000 + len(item) - 1)
    assert sorted((r.doc_id, r.text) for r in D.clean(docs, bench).where("doc_id < 4").collect() if r.text) == [(1, "no leak here")]
    assert D.clean(docs, bench).count() == 4
    assert D.leaks(docs.where("false"), bench).count() == 0 and D.leaks(docs, bench.where("false")).count() == 0
    assert D.clean(docs, bench.where("false")).count() == len(rows)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, f"item number {i} has words of its own, as {i * 7919} and {i * 104729} show") for i in range(30)]
    bench = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    assert [len(b) for b in D.blocks(bench, 200)][:2] == [3, 3] and sum(len(b) for b in D.blocks(bench, 200)) == 30
    docs = spark.createDataFrame([(i, f"Some text. {t.upper()} More text." if i % 3 else "Some text alone.") for i, t in items], "doc_id long, text string")
    whole = sorted(map(tuple, D.leaks(docs, bench).collect()))
    small = D.blocks
    monkeypatch.setattr(D, "blocks", lambda b: small(b, 400))
    assert sorted(map(tuple, D.leaks(docs, bench).collect())) == whole and len(whole) >= 20
    assert D.clean(docs, bench).count() == 10
