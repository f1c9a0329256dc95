"""Memory of Python workers on batches of long texts, and that pieces leave nothing out."""

import os
import threading
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import pieces, tokenizers
from corpusloom.sources import jsonl

#: MB that a worker may grow by, libraries included, over a batch of 40 MB of text.
MOST_MB = 350


def workers():
    """MB of each Python worker of this process's Spark."""
    parents, found = {}, {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            parents[int(p.name)] = int((p / "stat").read_text().rpartition(")")[2].split()[1])
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                found[int(p.name)] = int((p / "statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20
        except OSError:
            pass

    def ours(pid):
        while pid in parents and pid != os.getpid():
            pid = parents[pid]
        return pid == os.getpid()

    return {pid: mb for pid, mb in found.items() if ours(pid)}


def grown(work):
    """The most MB that a worker grew by while work() ran."""
    before, most, over = workers(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most.append(max((mb - before.get(pid, 0) for pid, mb in workers().items()), default=0))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        work()
    finally:
        over.set()
        watcher.join()
    return max(most)


def long_texts(spark, n=8000, size=5000):
    return spark.range(0, n, 1, 1).select("id", F.concat(F.repeat(F.lit("ab "), size // 3), F.col("id").cast("string")).alias("t"))


def noop(rows):
    rows.write.format("noop").mode("overwrite").save()


def test_pieces_hold_every_row_once():
    for texts in ([], [None], ["a" * 9, None, "", "b" * (2 << 20), "c", None], ["é" * 1000] * 3000):
        array = pa.array(texts, pa.string())
        parts = list(pieces.pieces(array))
        assert [t for at, n in parts for t in array.slice(at, n).to_pylist()] == texts
        assert all(n == 1 or array.slice(at, n).nbytes < 2 * pieces.PIECE_BYTES for at, n in parts)
    assert len(list(pieces.pieces(pa.array(["x" * 1000] * 5000)))) == 5  # 1,048 whole texts in each piece


def bundle(tmp_path):
    folder = str(tmp_path / "bundle")
    tokenizers.export_bundle(folder, "bytes", tokenizers.SPLIT_PATTERN, {bytes([b]): b for b in range(256)}, {"<bos>": 256, "<eos>": 257})
    return folder


def test_round_trips_of_a_bundle(spark, tmp_path):
    texts = ["", None, "Ünï 漢字 🙂", "<bos>in the text<eos>", "x" * 3_000_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r.i: r.r for r in rows.select("i", tokenizers.round_trips(bundle(tmp_path), F.col("t"), "<bos>", "<eos>").alias("r")).collect()}
    assert got[1] is None and [tuple(got[i]) for i in (0, 2, 4)] == [(len(texts[i].encode()) + 2, 256, 257, True) for i in (0, 2, 4)]
    assert tuple(got[3]) == (len("in the text") + 4, 256, 257, False)  # special tokens of the text are ids, too


def test_bundle_round_trip_holds_the_ids_of_a_text(spark, tmp_path, monkeypatch):
    from corpusloom.plans import catalogue_files

    docs = long_texts(spark).select(F.col("id").alias("doc_id"), F.col("t").alias("text"))
    monkeypatch.setattr(catalogue_files, "table", lambda *_: docs)
    assert grown(lambda: noop(catalogue_files.bundle_round_trip(spark, ""))) < MOST_MB


def test_json_lines_are_written_and_scanned_in_pieces(spark, tmp_path):
    rows = long_texts(spark, 6000, 9900).withColumn("t", F.concat("t", F.lit("🙂")))  # a character that makes Python's text four times as large
    lines = rows.select(F.lit("a").alias("subset"), F.lit("s").alias("shard"), F.col("id").alias("line_idx"), F.to_json(F.struct(F.col("t").alias("text"))).alias("raw"))
    assert grown(lambda: jsonl.write(lines, str(tmp_path))) < MOST_MB
    scanned = jsonl.scan(spark, [f"{tmp_path}/a/*.jsonl.zst"])
    assert grown(lambda: noop(scanned)) < MOST_MB
    assert scanned.where("parse_status = 'parsed'").join(rows, (F.col("line_idx") == F.col("id")) & (F.col("text") == F.col("t"))).count() == 6000


def test_ladder_of_written_lines_in_pieces(spark, tmp_path, monkeypatch):
    """Numbers go on from piece to piece and begin anew with each shard."""
    monkeypatch.setattr(pieces, "PIECE_BYTES", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(["/r/a/s0"] * 5 + ["/r/a/s1"] * 2), pa.array(['{"text": " x "}', "null", "", "[]", "{}", '{"text": "y"}', "z"])], names=["path", "raw"]), pa.RecordBatch.from_arrays([pa.array(["/r/a/s1"]), pa.array(['{"text": 1}'])], names=["path", "raw"])]
    got = [tuple(r.values()) for b in jsonl._numbered(iter(batches)) for r in b.to_pylist()]
    bad = lambda s, i: ("a", s, i, "malformed", None)
    assert got == [("a", "s0", 0, "parsed", "x"), bad("s0", 1), bad("s0", 2), bad("s0", 3), ("a", "s0", 4, "parsed", ""), ("a", "s1", 0, "parsed", "y"), bad("s1", 1), ("a", "s1", 2, "parsed", "")]


def test_ids_are_encoded_in_pieces(spark):
    docs = long_texts(spark)
    rows = docs.select("id", "t", tokenizers.ids("utf8_bytes", F.col("t"), True, True).alias("ids"))
    assert grown(lambda: noop(rows.select("id", F.size("ids")))) < MOST_MB
    assert rows.where((F.size("ids") == F.length("t") + 2) & (F.element_at("ids", 1) == 1) & (F.element_at("ids", -1) == 2) & (F.element_at("ids", 2) == ord("a") + 3)).count() == 8000
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "é")], "i int, t string").coalesce(1)
    assert {r.i: r.x for r in odd.select("i", tokenizers.ids("utf8_bytes", F.col("t"), False, True).alias("x")).collect()} == {0: None, 1: [2], 2: [198, 172, 2]}
