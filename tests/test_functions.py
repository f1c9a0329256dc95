import hashlib
import math
import random
import re
import sys

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.functions import hashing, text, tokenizers, training
from corpusloom.operators import budget, chat, configs, estimate, logits, packing, prefix, sampling


def test_strip_equals_python(spark):
    cases = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(sys.maxunicode + 1) if chr(c).isspace() or c in (0x200B, 0xFEFF, 0x180E, 0, 0x1B, 0x2060)] + ["", " \n ", "a\n", "\x1fa"]
    got = {r.t: r.s for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.strip("t").alias("s")).collect()}
    assert got == {c: c.strip() for c in cases}


def test_pretoken_counts_equal_the_regex_engine(spark):
    rng = random.Random(1)
    cases = ["".join(rng.choice("aB é漢1 2\n\r\t's'LL !?🙂") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", tokenizers.count("pretoken", F.col("t")).alias("n")).collect()
    assert all(r.n == len(regex.findall(tokenizers.SPLIT_PATTERN, r.t)) for r in rows)


def test_hash_profiles(spark):
    rows = [("a", 1), ("b|", 22)]
    key = hashing.address_key(9, F.col("s"), F.col("i"))
    for r in spark.createDataFrame(rows, "s string, i int").select("s", "i", hashing.md5_bucket(key).alias("m"), hashing.blake2b_bucket(key).alias("b"), hashing.sample_seed_column(3, F.col("s")).alias("x")).collect():
        k = f"9|{r.s}|{r.i}".encode()
        assert r.m == int(hashlib.md5(k).hexdigest()[:15], 16) % 10**6 and r.b == int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "big") % 10**6
        assert r.x == hashing.sample_seed(3, r.s)
    row = budget.hash_split(spark.createDataFrame([("sub", "s0", 7, "é" * 3)], "subset string, shard string, line_idx long, head string"), 0.5, 9, ["subset", "shard", "line_idx", "head"], "conformance").first()
    assert row.bucket == int.from_bytes(hashlib.blake2b("sub|s0|7|ééé".encode(), digest_size=8).digest(), "big") % 10**6 and row.candidate == (row.bucket < 500_000)
    assert hashing.threshold(0.000249) == 248 and hashing.threshold(0) == 0 and hashing.threshold(1) == 10**6


def test_formulas(spark):
    r = spark.range(1).select(text.human(F.lit(1963908151)).alias("a"), text.human(F.lit(999)).alias("b"), text.human(F.lit(2.5e15)).alias("c"), text.without_channels(F.lit(" a<|channel>x<channel|>b ")).alias("d"), text.after_thinking(F.lit("<think>q</think> z ")).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("2.0B", "999.0", "2.5P", "ab", "z")
    scale = [x.s for x in spark.range(12).select(training.learning_rate_scale(F.col("id"), 10, 4, 0.1).alias("s")).collect()]
    assert scale[:4] == [0.25, 0.5, 0.75, 1.0] and math.isclose(scale[10], 0.1) and scale[11] == scale[10]
    assert training.tokens_per_step(2048, 16, 2, 1) == 65536
    with pytest.raises(Exception):
        spark.range(1).select(training.finite(F.lit(float("nan")))).collect()


def test_tokenizer_bundle_round_trip(tmp_path):
    ranks, added = tokenizers.ranks_from_json(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizers.export_bundle(str(tmp_path / "b"), "own", public_tokenizers.PATTERN, ranks, added)
    t = tokenizers.load(f"tiktoken:{tmp_path / 'b'}")
    sample = "Ünï <|endoftext|> of the 12345 漢字"
    assert t.decode(t.encode(sample)) == sample and t.decode(t.encode(sample), skip_special=True) == sample.replace("<|endoftext|>", "")
    assert t.token_to_id("<|endoftext|>") == 50256 and t.token_to_id("no single token") is None
    assert tokenizers.resolve_stops(t, ["<|endoftext|>", "not one token"]) == ([50256], ["not one token"]) and tokenizers.resolve_stops(t, ["a"], True) == ([], [])
    b = tokenizers.load("utf8_bytes")
    assert b.decode(b.encode("é", True, True), skip_special=True) == "é" and b.token_to_id("<eos>") == 2
    assert tokenizers.token_dtype(65535) == "uint16" and tokenizers.token_dtype(65536) == "uint32" and tokenizers.max_token_id([3], None, 9) == 9
    for f in (lambda: tokenizers.token_dtype(70000, "uint16"), lambda: tokenizers.max_token_id([]), lambda: tokenizers.ranks_from_json(public_tokenizers.path("word_bpe_49k.json"))):
        with pytest.raises((ValueError, KeyError)):
            f()


def test_prefix_sum_does_not_depend_on_layout(spark):
    rng = random.Random(2)
    rows = [(g, m, i, rng.randrange(9)) for g in "abc" for m in range(3) for i in range(rng.randrange(1, 50))]
    want, used = {}, {}
    for g, m, i, v in sorted(rows):
        want[g, m, i] = used.get(g, 0)
        used[g] = used.get(g, 0) + v
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "g string, m int, i long, v long").repartition(parts)
        got = {(r.g, r.m, r.i): r.prior for r in prefix.prefix_sum(df, "v", "i", ["g"], ["m"], chunk=7).collect()}
        assert got == want


def test_segments_and_greedy_cap(spark):
    for n in (0, 1, 4, 5, 9, 10, 11):
        df = spark.createDataFrame([(list(range(10, 10 + n)),)], "ids array<int>")
        seg = [r.seg for r in packing.segments(df, 1, 2, 5).orderBy("seg_idx").collect()]
        flat = [1, *range(10, 10 + n), 2]
        assert sum(seg, []) == flat and len(seg) == max(1, -(-n // 5)) and all(len([x for x in s if x > 2]) <= 5 for s in seg)
    rng = random.Random(3)
    rows = [(s, i, rng.randrange(1, 50), rng.random() < 0.7) for s in ("x", "y", None) for i in range(40)]
    df = spark.createDataFrame(rows, "subset string, line_idx long, n_framed long, candidate boolean").repartition(5)
    got = {(r.subset, r.line_idx): r.split for r in budget.greedy_cap(df, 200).collect()}
    want = {}
    for s in ("x", "y", None):
        used = 0
        for t, i, n, c in rows:
            if t == s:
                fits = c and used + n <= 200
                used += n * fits
                want[s, i] = "val" if fits else "train"
    assert got == want


def test_lookup_bounds(spark):
    index = packing.block_index(spark.createDataFrame([("t", 0, 33), ("t", 1, 16), ("t", 2, 50)], "split string, shard int, tokens long"), 16)
    assert [(r.shard, r.blocks, r.first_block) for r in index.orderBy("shard").collect()] == [(0, 2, 0), (2, 3, 2)]
    ask = lambda *i: [(r.shard, r.block) for r in packing.lookup(spark.createDataFrame([(x,) for x in i], "idx long"), index).orderBy("idx").collect()]
    assert ask(0, 1, 2, 4) == [(0, 0), (0, 1), (2, 0), (2, 2)] and ask(-5, -1) == [(0, 0), (2, 2)]
    for bad in (5, -6):
        with pytest.raises(Exception):
            ask(bad)


def test_logits_with_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0, 3.0],), ([0.0, 0.0, 0.0, 0.0, 0.0],), ([-1.0, -2.0, -0.5, -9.0, -3.0],)], "l array<double>")
    r = df.select(logits.greedy(F.col("l")).alias("g"), logits.top_k(F.col("l"), 2).alias("k"), logits.top_p(F.col("l"), 0.3).alias("p"), logits.top_p(F.col("l"), 1).alias("all"), logits.repetition_penalty(F.col("l"), F.array(F.lit(1), F.lit(2)), 2.0).alias("r"), logits.draw(F.col("l"), F.lit(0.999999)).alias("d")).collect()
    assert [x.g for x in r] == [1, 0, 2] and r[0].k == [None, 3.0, 3.0, None, 3.0] and r[1].k == [0.0] * 5
    assert r[0].p == [None, 3.0, None, None, None] or r[0].p == [None, 3.0, 3.0, None, None]
    assert sum(v is not None for v in r[1].p) == 2 and r[0]["all"] == [1.0, 3.0, 3.0, 2.0, 3.0] and r[2].r == [-1.0, -4.0, -1.0, -9.0, -3.0] and r[1].d == 4
    with pytest.raises(ValueError):
        logits.repetition_penalty(F.col("l"), F.array(), 0)
    probs = np.exp([1.0, 3, 3, 2, 3]) / np.exp([1.0, 3, 3, 2, 3]).sum()
    assert np.allclose(df.limit(1).select(logits.softmax(F.col("l")).alias("s")).first().s, probs)


def conv(spark, *turns):
    return spark.createDataFrame([(1, i, role, t) for i, (role, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")


def test_hoisted_chat(spark):
    rows = conv(spark, ("system", "S"), ("user", "u1"), ("assistant", "<think>a</think> b "), ("user", "u2"), ("assistant", "<think>c</think> d "))
    m = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    want = "<|startoftext|>" + m("system", "S\nList of tools: [{}]") + m("user", "u1") + m("assistant", "b") + m("user", "u2") + m("assistant", "<think>c</think> d ") + "<|im_start|>assistant\n"
    assert chat.hoisted(rows, generation_prompt=True, tools=["{}"]).first().transcript == want
    assert "<think>a</think> b " in chat.hoisted(rows, keep_thinking=True).first().transcript
    assert chat.hoisted(conv(spark, ("system", "only"))).first().transcript == "<|startoftext|>" + m("system", "only")


def test_queries_chat(spark):
    rows = conv(spark, ("system", " S "), ("user", "q"), ("assistant", "<think>\nr1\n</think>\n\ncall"), ("tool", "t1"), ("tool", "t2"), ("assistant", "<think>r2</think>done"))
    want = "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\nr1\n</think>\n\ncall<|im_end|>\n<|im_start|>user\n<tool_response>\nt1\n</tool_response>\n<tool_response>\nt2\n</tool_response><|im_end|>\n<|im_start|>assistant\n<think>\nr2\n</think>\n\ndone<|im_end|>\n"
    assert chat.queries(rows).first().transcript == want
    later = conv(spark, ("user", "q"), ("assistant", "<think>x</think>y"), ("user", "q2"))
    assert chat.queries(later).first().transcript.count("think") == 0 and "<think>\nx\n</think>" in chat.queries(later, preserve_thinking=True).first().transcript
    assert chat.queries(later, generation_prompt=True, thinking=False).first().transcript.endswith("<|im_start|>assistant\n<think>\n\n</think>\n\n")
    for bad in (conv(spark, ("assistant", "a")), conv(spark, ("user", "a"), ("system", "s")), conv(spark, ("user", "a"), ("other", "s")), conv(spark, ("user", "<tool_response>x</tool_response>"))):
        with pytest.raises(Exception):
            chat.queries(bad).collect()


def test_turns_chat_and_response(spark):
    rows = conv(spark, ("developer", " D "), ("user", " u "), ("assistant", "<|channel>thought\nx<channel|> a"), ("tool", "t"), ("assistant", "b"))
    assert chat.turns(rows, generation_prompt=True).first().transcript == "<bos><|turn>system\nD<turn|>\n<|turn>user\nu<turn|>\n<|turn>model\na<turn|>\nb<turn|>\n<|turn>model\n<|channel>thought\n<channel|>"
    assert chat.turns(conv(spark, ("user", "u")), thinking=True).first().transcript == "<bos><|turn>system\n<|think|>\n<turn|>\n<|turn>user\nu<turn|>\n"
    assert chat.turns(conv(spark, ("system", "s"))).first().transcript == "<bos><|turn>system\ns<turn|>\n"
    r = spark.range(1).select(chat.parse_response(F.lit("<|channel>thought\nwhy<channel|><|tool_call>call:add{a:1}<tool_call|><|tool_call>call:sub{b:2}<tool_call|>text<turn|>")).alias("r")).first().r
    assert (r.thinking, r.content, [(c.name, c.arguments) for c in r.tool_calls]) == ("why", "text", [("add", "{a:1}"), ("sub", "{b:2}")])
    n = {x.turn: (x.prev_role, x.next_role) for x in chat.neighbours(rows).collect()}
    assert n[4] == ("assistant", None) and n[3] == ("assistant", "assistant") and n[0] == (None, "user")


def test_report_and_quota(spark):
    dim = spark.createDataFrame([(0, "prose", 0, "wiki"), (0, "prose", 1, "books"), (1, "code", 0, "py")], "category_ord int, category string, subset_ord int, subset string")
    est = spark.createDataFrame([("wiki", 1963908151), ("py", 1200)], "subset string, tokens long")
    lines = [r.line for r in estimate.report(dim, est).collect()]
    assert lines == ["prose:", "  data/wiki: 1,963,908,151 tokens", "  data/books: 0 tokens", "  -> subtotal: 1,963,908,151 tokens (2.0B)", "", "code:", "  data/py: 1,200 tokens", "  -> subtotal: 1,200 tokens (1.2K)", "", "TOTAL: 1,963,909,351 tokens (2.0B)"]
    assert estimate.shard_quota(100, 7) == 15 and estimate.shard_quota(1, 7) == 1 and estimate.shard_quota(5, 0) == 0
    shards = [f"s{i}" for i in range(20)]
    assert estimate.sampled_shards(shards, 30, 1, "x") == sorted(shards) and len(estimate.sampled_shards(shards, 5, 1, "x")) == 5
    assert sorted(estimate.shuffled_shards(shards, 1, "x")) == sorted(shards) and estimate.shuffled_shards(shards, 1, "x") == estimate.shuffled_shards(shards[::-1], 1, "x")
    with pytest.raises(Exception):
        configs.with_subsets(spark.createDataFrame([("gone",)], "subset string"), est.withColumnRenamed("tokens", "n")).collect()
    few = {r.position: r["rank"] for r in sampling.rank_sampler(spark.range(3), "id", 8, drop_last=False).collect()}
    assert few == {i: i for i in range(8)} and sampling.rank_sampler(spark.range(3), "id", 8).count() == 0
    assert re.fullmatch(r"train/tokens_000007\.bin", spark.range(1).select(text.shard_name(F.lit("train"), F.lit(7)).alias("n")).first().n)


def test_folds_over_sparse_orders(spark):
    """64-bit random keys: the same result as one window, and no window over all rows."""
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(-(2**63), 2**63), rng.randrange(100)) for _ in range(600)] + [("c", 2**63 - 1, 4), ("c", -(2**63), 3)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(3)
    for fold, name in ((sum, "sum"), (min, "min"), (max, "max")):
        got = {(r.g, r.k): r.p for r in prefix.prefix_fold(df, F.col("v"), name, "k", ["g"], chunk=65_536, out="p").collect()}
        want = {}
        for g, k, _ in rows:
            before = [v for h, j, v in rows if h == g and j < k]
            want[(g, k)] = fold(before) if before else None
        assert got == want, name
    spread = prefix.prefix_sum(df.withColumn("one", F.lit(1)), "one", "k", out="n").collect()
    assert sorted(r.n for r in spread) == list(range(len(rows)))


def test_lookup_of_uneven_shards(spark):
    rng = random.Random(6)
    sizes = [rng.choice((1, 2, 50, 1000)) for _ in range(60)]
    starts = [sum(sizes[:i]) for i in range(60)]
    index = spark.createDataFrame([(i, starts[i], n) for i, n in enumerate(sizes)], "shard int, first_block long, blocks long")
    total = sum(sizes)
    asked = [rng.randrange(-total, total) for _ in range(300)]
    got = {r.idx: (r.shard, r.block) for r in packing.lookup(spark.createDataFrame([(a,) for a in set(asked)], "idx long"), index).collect()}
    for a in asked:
        at = a % total
        shard = max(i for i in range(60) if starts[i] <= at)
        assert got[a] == (shard, at - starts[shard])
