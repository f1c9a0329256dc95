import base64
import json
import random

import zstandard

from corpusloom.plans import estimates
from corpusloom.sources import vocabulary


def test_estimate_of_whole_files_is_exact(spark, tmp_path):
    rng = random.Random(4)
    tokens = {}
    for subset, n in (("a", 3), ("b", 9)):
        (tmp_path / subset).mkdir()
        for i in range(n):
            texts = ["w" * rng.randrange(1, 90) for _ in range(40)]
            lines = [json.dumps({"text": t}) for t in texts] + ["broken", json.dumps({"text": " "}), json.dumps([1])]
            (tmp_path / subset / f"s{i}.jsonl.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
            tokens[subset] = tokens.get(subset, 0) + sum(map(len, texts))
    got = {r.subset: r for r in estimates.estimates(spark, str(tmp_path), ["a", "b"]).collect()}
    assert {s: r.tokens for s, r in got.items()} == tokens and got["a"].sample_docs == 120 and got["a"].tokens_per_byte > 0
    some = {r.subset: r for r in estimates.estimates(spark, str(tmp_path), ["a", "b"], sample_docs=50, max_shards=4, specials_per_doc=2).collect()}
    assert some["a"].sample_docs == some["b"].sample_docs == 50 and some["b"].n_sampled_shards == 4 and some["b"].n_shards == 9
    assert some["b"].sampled_shard_names == sorted(some["b"].sampled_shard_names) and some["b"].tokens > 0


def test_vocabulary_tables(spark, tmp_path):
    ranks = [(b"a", 0), (b"\xff\x00", 2), (b" the", 1)]
    (tmp_path / "v.tiktoken").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks) + b"\n")
    table = vocabulary.read_ranks(spark, str(tmp_path / "v.tiktoken"))
    assert sorted((bytes(r.token), r.rank) for r in table.collect()) == sorted(ranks)
    assert [r.value for r in vocabulary.rank_lines(table).collect()] == [f"{base64.b64encode(t).decode()} {r}" for t, r in sorted(ranks, key=lambda x: x[1])]
    (tmp_path / "meta.json").write_text(json.dumps({"special_tokens": {"<e>": 9, "<b>": 8}}))
    assert [tuple(r) for r in vocabulary.special_tokens(spark, str(tmp_path / "meta.json")).collect()] == [("<b>", 8), ("<e>", 9)]
    (tmp_path / "t.json").write_text(json.dumps({"model": {"type": "BPE", "vocab": {"a": 0, "<e>": 1}}, "added_tokens": [{"content": "<e>", "id": 1}]}))
    assert [tuple(r) for r in vocabulary.tokenizer_vocabulary(spark, str(tmp_path / "t.json")).collect()] == [("a", 0)]
    lines = spark.createDataFrame([("x/data/common-books-01",), ("none",)], "value string")
    assert [tuple(r) for r in vocabulary.corpus_listing(lines).collect()] == [("common", "books-01")]
