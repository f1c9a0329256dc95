import json
import random

import numpy as np
import pytest
import zstandard

from corpusloom.functions import tokenizers
from corpusloom.operators import ladder
from corpusloom.plans import dataset
from corpusloom.sources import jsonl, manifest, token_shards
from corpusloom.streaming import ingest

LINES = [
    b'{"text": "  good text here \\u00a0"}', b"", b"not json", b"null", b'{"text": 5}', b'{"text": null}', b"{}", b"[1, 2]", b'{"text": "a", "text": "last wins"}', b'{"text": {"k": 1}}',
    b'{"text": "bad \xff byte"}', '{"text": "　  "}'.encode(), b'{"text": NaN}', '{"text": "🙂 astral"}'.encode(), b'{"text": "x"} trailing', b"{'text': 'single'}", b'{"text": "lone \\ud800"}', b'"just text"', b"7",
]


def expected(line):
    try:
        row = json.loads(line.decode("utf-8", "replace"))
    except ValueError:
        return "malformed", None
    if not isinstance(row, dict):
        return "malformed", None
    t = row.get("text", "")
    return "parsed", (t if isinstance(t, str) else "").encode("utf-8", "replace").decode().strip()


def put(path, lines, end=b"\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(zstandard.compress(end.join(lines)))


def test_scan_is_strict_and_numbered(spark, tmp_path):
    for i in range(5):
        put(tmp_path / "web" / f"s{i}.jsonl.zst", LINES[i:] + LINES[:i])
    put(tmp_path / "code" / "s0.jsonl.zst", LINES, b"\r\n")
    got = {(r.subset, r.shard, r.line_idx): (r.parse_status, r.text) for r in jsonl.scan(spark, [f"{tmp_path}/*/*.jsonl.zst"]).collect()}
    want = {("web", f"s{i}.jsonl.zst", k): expected(x) for i in range(5) for k, x in enumerate(LINES[i:] + LINES[:i])}
    want |= {("code", "s0.jsonl.zst", k): expected(x) for k, x in enumerate(LINES)}
    # a last empty line has no line end and so is no line
    assert got == {k: v for k, v in want.items() if not (k[:2] == ("web", "s2.jsonl.zst") and k[2] == len(LINES) - 1)}
    assert [r.shard for r in jsonl.list_shards(spark, str(tmp_path), "web").collect()] == [f"s{i}.jsonl.zst" for i in range(5)]
    with pytest.raises(ValueError):
        jsonl.scan(spark, [f"{tmp_path}/x.jsonl"])


def test_parsers_agree_on_clean_lines(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    keep = [x for x in LINES if b"trailing" not in x and b"NaN" not in x and b"\xff" not in x and b"ud800" not in x]
    rows = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(keep)], "i int, raw string")
    strict, fast = ({r.i: (r.parse_status, r.text) for r in ladder.parse(rows, fast=f).collect()} for f in (False, True))
    assert strict == fast == {i: expected(x) for i, x in enumerate(keep)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_build_equals_the_sequential_model(spark, tmp_path, partitions):
    rng = random.Random(8)
    subsets = [("b", 900), ("a", 5000), ("c", 1)]
    order = {s: [("x" * rng.randrange(0, 60) + chr(97 + i % 26)) if rng.random() < 0.9 else "" for i in range(80)] for s, _ in subsets}
    rows = [(s, f"{i // 30:03d}", i // 30, i % 30, "parsed", t) for s in order for i, t in enumerate(order[s])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "subset string, shard string, shard_ord int, line_idx long, parse_status string, text string").repartition(partitions)
    recipe = dataset.Recipe(str(tmp_path / "out"), train_shard_tokens=333, val_shard_tokens=100, val_fraction=0.4, max_val_tokens_per_subset=150, min_doc_tokens=8, max_doc_tokens=25, context_length=16)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    made = dataset.build(spark, docs, subsets, recipe)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    cand = dataset.budget.hash_split(docs.withColumn("head", docs.text), 0.4, 42, ["subset", "shard", "line_idx"]).where("candidate").collect()
    vals = {(r.subset, r.shard_ord, r.line_idx) for r in cand}
    flags = {s: [(s, i // 30, i % 30) in vals for i in range(len(order[s]))] for s in order}
    tokenizer = tokenizers.load("utf8_bytes")
    streams, stats = {"train": [], "val": []}, {}
    for name, target in subsets:
        used = val = 0
        for i, text in enumerate(order[name]):
            if used >= target:
                break
            if not text or len(text) < 8:
                continue
            framed = [1, *tokenizer.encode(text), 2]
            split = "val" if flags[name][i] and val + len(framed) <= 150 else "train"
            val += len(framed) * (split == "val")
            streams[split] += framed
            used += len(framed)
        stats[name] = used
    for split, size in (("train", 333), ("val", 100)):
        shards = made["splits"][split]["shards"]
        assert [s["tokens"] for s in shards] == [len(streams[split][i : i + size]) for i in range(0, len(streams[split]), size)]
        data = np.concatenate([np.fromfile(tmp_path / "out" / s["filename"], "<u2") for s in shards])
        assert data.tolist() == streams[split]
    assert {s: v["actual_tokens"] for s, v in made["subsets"].items()} == stats
    back = {(r.split, r.shard, r.start): r.tokens for r in token_shards.read(spark, str(tmp_path / "out"), tokens_per_row=50).collect()}
    assert sum((back[k] for k in sorted(back) if k[0] == "train"), []) == streams["train"]
    blocks = {(r.shard, r.block): (r.input_ids, r.labels) for r in token_shards.read_blocks(spark, str(tmp_path / "out"), "train", 16).collect()}
    want = {}
    for s, _ in enumerate(made["splits"]["train"]["shards"]):
        t = streams["train"][s * 333 : (s + 1) * 333]
        want |= {(s, b): (t[b * 16 : b * 16 + 16], t[b * 16 + 1 : b * 16 + 17]) for b in range((len(t) - 1) // 16)}
    assert blocks == want


def test_modes_and_resume(spark, tmp_path):
    docs = spark.createDataFrame([("a", "0", 0, i, "parsed", f"document number {i} of this subset") for i in range(20)], "subset string, shard string, shard_ord int, line_idx long, parse_status string, text string")
    root = tmp_path / "out"
    recipe = lambda **k: dataset.Recipe(str(root), **k)
    assert dataset.build(spark, docs, [("a", 100)], recipe(dry_run=True))["dry_run"] and not list(root.glob("*/*.bin"))
    with pytest.raises(FileNotFoundError):
        dataset.build(spark, docs, [("a", 100)], recipe(resume=True))
    first = dataset.build(spark, docs, [("a", 100)], recipe(overwrite=True))
    bytes_ = {p.name: p.read_bytes() for p in root.glob("*/*.bin")}
    with pytest.raises(FileExistsError):
        dataset.build(spark, docs, [("a", 100)], recipe())
    with pytest.raises(ValueError):
        dataset.build(spark, docs, [("a", 100)], recipe(resume=True, seed=1))
    assert dataset.build(spark, docs, [("a", 100)], recipe(resume=True)) == first
    (root / "manifest.json").unlink()  # as if cut off before it was published
    ledger = json.loads((root / "progress.json").read_text())
    for wrong in ({"version": 9}, {"counted": {"00000": ["other"]}}, {"counted": {"0": ["a"], "1": ["a"]}}, {"shards": 5}):
        (root / "progress.json").write_text(json.dumps(ledger | wrong))
        with pytest.raises(ValueError):
            dataset.build(spark, docs, [("a", 100)], recipe(resume=True))
    (root / "progress.json").write_text(json.dumps(ledger))
    (root / "train" / "orphan.tmp").write_bytes(b"x")
    assert dataset.build(spark, docs, [("a", 100)], recipe(resume=True)) == first
    assert {p.name: p.read_bytes() for p in root.glob("*/*")} == bytes_
    assert json.loads((root / "progress.json").read_text())["shards"] == 1
    with pytest.raises(FileNotFoundError):
        dataset.build(spark, docs, [("a", 100), ("gone", 5)], recipe(overwrite=True))
    made = dataset.build(spark, docs, [("a", 100), ("gone", 5)], recipe(overwrite=True, skip_missing_subsets=True))
    assert made["subsets"]["gone"]["completed"] and made["subsets"]["gone"]["docs_seen"] == 0
    for bad in ({"resume": True, "overwrite": True}, {"seed": -1}, {"dtype": "int8"}, {"shards_per_step": 0}, {"val_fraction": 2}, {"context_length": 0}, {"profile": "x"}):
        with pytest.raises(ValueError):
            recipe(**bad)
    manifest.write_json(str(tmp_path / "m.json"), {"subsets": {"z": 3, "y": 4}})
    assert manifest.load_mixture(str(tmp_path / "m.json")) == ([("y", 4), ("z", 3)], 7)
    (root / "manifest.json").write_text('{"format": "other"}')
    with pytest.raises(ValueError):
        manifest.read_manifest(str(root))


def test_streaming_budget_over_two_runs(spark, tmp_path):
    text = lambda n: json.dumps({"text": "w" * n}).encode()
    put(tmp_path / "in" / "web" / "s0.jsonl.zst", [text(40), b"broken", text(3), text(50)])
    run = lambda: ingest.start(ingest.lines(spark, f"{tmp_path}/in/*"), {"web": 200}, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    run()
    put(tmp_path / "in" / "web" / "s1.jsonl.zst", [text(60), text(98), text(33), text(34)])
    run()
    got = sorted((r.shard, r.line_idx, r.status, r.n_framed, r.prior) for r in ingest.read(spark, f"{tmp_path}/out").collect())
    assert got == [("s0.jsonl.zst", 0, "written", 42, 0), ("s0.jsonl.zst", 1, "malformed", 0, 42), ("s0.jsonl.zst", 2, "short", 0, 42), ("s0.jsonl.zst", 3, "written", 52, 42), ("s1.jsonl.zst", 0, "written", 62, 94), ("s1.jsonl.zst", 1, "written", 100, 156)]


def test_a_run_that_was_cut_off_ends_with_the_same_bytes(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    for s in ("a", "b", "c"):
        for k in range(3):
            put(tmp_path / "in" / s / f"s{k}.jsonl.zst", [json.dumps({"text": "".join(rng.choice("abc ") for _ in range(rng.randrange(90)))}).encode() for _ in range(20)])
    mixture = [("b", 1200), ("a", 900), ("c", 10_000)]
    recipe = lambda root, **k: dataset.Recipe(str(tmp_path / root), train_shard_tokens=400, val_shard_tokens=200, val_fraction=0.3, min_doc_tokens=4, context_length=16, subsets_per_step=1, shards_per_step=2, **k)
    docs = jsonl.reader(spark, str(tmp_path / "in"))
    whole = dataset.build(spark, docs, mixture, recipe("whole"))
    assert {s: v["shards_seen"] for s, v in whole["subsets"].items()} == {"a": 3, "b": 3, "c": 3}
    read = []

    def failing(names):
        read.append(names)
        if len(read) == 2:
            raise OSError("lost")
        return docs(names)

    with pytest.raises(OSError):
        dataset.build(spark, failing, mixture, recipe("cut"))
    write, wrote = token_shards.write, []

    def failing_write(*a):
        if len(wrote) == 2:
            raise OSError("lost")
        wrote.append(write(*a))

    monkeypatch.setattr(token_shards, "write", failing_write)
    with pytest.raises(OSError):
        dataset.build(spark, failing, mixture, recipe("cut", resume=True))
    assert read == [["b"], ["a"], ["a"], ["c"], ["b", "a", "c"]]  # the first subset is not counted again
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "cut").glob("*/*.bin")}
    assert len(kept) == 4 and json.loads((tmp_path / "cut" / "progress.json").read_text())["shards"] == 4
    (tmp_path / "cut" / "train" / "tokens_000999.bin").write_bytes(b"orphan")
    over = max(kept)
    over.write_bytes(over.read_bytes() + b"xx")  # longer than its shard
    monkeypatch.setattr(token_shards, "write", write)
    assert dataset.build(spark, failing, mixture, recipe("cut", resume=True)) == whole
    files = {r: {p.relative_to(tmp_path / r): p.read_bytes() for p in (tmp_path / r).glob("*/*")} for r in ("cut", "whole")}
    assert files["cut"] == files["whole"]
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items() if p != over)
    order = {r.shard: r.turn for r in token_shards.read_blocks(spark, str(tmp_path / "cut"), "train", 16, seed=5).collect()}
    assert sorted(order.values()) == list(range(len(order))) and list(order) != list(order.values())


@pytest.mark.parametrize("kind", ["tiktoken", "json", ""])
def test_build_with_a_vocabulary(spark, tmp_path, kind):
    import public_tokenizers

    folder = tmp_path / "vocab"
    source = public_tokenizers.path("byte_bpe_50k.json")
    ranks, added = tokenizers.ranks_from_json(source)
    tokenizers.export_bundle(str(folder), "own", public_tokenizers.PATTERN, ranks, added, check=tokenizers.load(f"json:{source}"))
    name = {"tiktoken": f"tiktoken:{folder}", "json": f"json:{source}", "": str(folder)}[kind]
    texts = [f"Document {i}: of the 漢字 and <|endoftext|> more" * (i % 5 + 1) for i in range(30)] + ["x" + " " * 3000]
    docs = spark.createDataFrame([("a", "0", 0, i, "parsed", t.strip()) for i, t in enumerate(texts)], "subset string, shard string, shard_ord int, line_idx long, parse_status string, text string")
    recipe = lambda **k: dataset.Recipe(str(tmp_path / "out"), tokenizer=name, train_shard_tokens=150, val_fraction=0.0, min_doc_tokens=2, max_doc_tokens=40, **k)
    with pytest.raises(ValueError):
        dataset.build(spark, docs, [("a", 10**6)], recipe())
    with pytest.raises(ValueError):
        dataset.build(spark, docs, [("a", 10**6)], recipe(bos="<|endoftext|>", eos="no such token"))
    made = dataset.build(spark, docs, [("a", 10**6)], recipe(bos="<|endoftext|>", eos="<|endoftext|>"))
    library = tokenizers.load(f"json:{source}", "<|endoftext|>", "<|endoftext|>")
    want = [i for t in texts if len(library.encode(t.strip())) >= 2 for i in library.encode(t.strip(), True, True)]
    data = np.concatenate([np.fromfile(tmp_path / "out" / s["filename"], "<u2") for s in made["splits"]["train"]["shards"]])
    assert data.tolist() == want and made["bos_token"] == "<|endoftext|>" and made["bos_token_id"] == 50256


def test_tokenizer_names(tmp_path):
    import public_tokenizers

    for bad in ("nothing", str(tmp_path), "tiktoken:", "whitespace:x"):
        with pytest.raises(ValueError):
            tokenizers.describe(bad)
    source = public_tokenizers.path("byte_bpe_50k.json")
    ranks, added = tokenizers.ranks_from_json(source)
    broken = {k: v for k, v in ranks.items() if k != b" the"}
    with pytest.raises(ValueError):
        tokenizers.export_bundle(str(tmp_path / "b"), "own", public_tokenizers.PATTERN, broken, added, tokenizers.load(f"json:{source}"), ("of the",))
    tokenizers.export_bundle(str(tmp_path / "ok"), "own", public_tokenizers.PATTERN, ranks, added)
    t, j = tokenizers.load(str(tmp_path / "ok")), tokenizers.load(f"json:{source}")
    texts = ["of the", "a<|endoftext|>b", " " * 1_500_000 + "end"]
    assert [t.encode(x) for x in texts] == [j.encode(x) for x in texts] == j.encode_batch(texts)
    assert t.encode_batch(texts[:2]) == j.encode_batch(texts[:2]) and t.decode_batch(t.encode_batch(texts[:2])) == texts[:2]
    assert 50256 not in t.encode_ordinary(texts[1]) and t.token_bytes(t.encode("é")[0]) in ("é".encode(), "é".encode()[:1])
    with pytest.raises(ValueError):
        t.encode("x", add_bos=True)


def test_a_repeated_trigger_counts_once(spark, tmp_path, monkeypatch):
    text = lambda n: json.dumps({"text": "w" * n}).encode()
    put(tmp_path / "in" / "web" / "s0.jsonl.zst", [text(40), text(50)])
    put(tmp_path / "in" / "other" / "s0.jsonl.zst", [text(40)])
    run = lambda: ingest.start(ingest.lines(spark, f"{tmp_path}/in/*"), {"web": 130}, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    run()
    put(tmp_path / "in" / "web" / "s1.jsonl.zst", [text(33), text(34), text(35)])
    write, calls = manifest.write_json, []

    def lost(path, payload):
        write(path, payload)
        calls.append(payload)
        if len(calls) == 1:
            raise OSError("lost after the numbers were kept, before the trigger was committed")

    monkeypatch.setattr(manifest, "write_json", lost)
    with pytest.raises(Exception):
        run()
    run()
    assert calls[0] == calls[1]
    got = sorted((r.shard, r.line_idx, r.prior) for r in ingest.read(spark, f"{tmp_path}/out").collect())
    assert got == [("s0.jsonl.zst", 0, 0), ("s0.jsonl.zst", 1, 42), ("s1.jsonl.zst", 0, 94), ("s1.jsonl.zst", 1, 129)]


def test_lines_are_written_as_they_are_read(spark, tmp_path):
    rows = [(s, f"k{k}", i, json.dumps({"text": f"{s} é{i}"})) for s in "ab" for k in range(2) for i in range(50)]
    random.Random(1).shuffle(rows)
    jsonl.write(spark.createDataFrame(rows, "subset string, shard string, line_idx long, raw string").repartition(5), str(tmp_path / "w"))
    got = sorted((r.subset, r.shard, r.line_idx, r.text) for r in jsonl.reader(spark, str(tmp_path / "w"))(["a", "b"]).where("shard_ord < 2").collect())
    assert got == sorted((s, f"{k}.jsonl.zst", i, f"{s} é{i}") for s, k, i, _ in rows)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace as NS

    from corpusloom import session

    none = NS(isDefined=lambda: False)
    unset = NS(conf=NS(get=lambda *a: None), sparkContext=NS(getConf=lambda: NS(get=lambda *a: None), _jsc=NS(sc=lambda: NS(getCheckpointDir=lambda: none)), master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(unset)
    assert session.scratch(spark, "x").startswith(session.shared_dir(spark).removeprefix("file://"))
