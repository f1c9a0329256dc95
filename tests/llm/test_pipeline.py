import hashlib
import math
import struct

import public_tokenizers
from pyspark.sql import functions as F
from test_decontaminate import best
from test_ngram_join import sets
from tokenizers import Tokenizer

import corpus_pipeline as P
from corpusloom.llm import decontaminate, quality_nbsvm, secrets_crf
from corpusloom.llm.tokenizers import default_byte_bpe


def plain_run(spark, rows, labels, items):
    """(doc_id, ids) by plain versions of all stages over a list of (doc_id, text); the two fitted models are those of the
    operators, applied here by their definitions."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_nbsvm.train(frame(rows), labels, ~quality_nbsvm.held_out(F.col("doc_id")))

    def score(text):
        hits = [model.weights[g] for g in quality_nbsvm.ngrams(text, quality_nbsvm._Shapes()) if g in model.weights]
        norm = math.sqrt(sum(b for _, b in hits))
        margin = model.bias + (sum(a for a, _ in hits) / norm if norm else 0.0)
        return 1 / (1 + math.exp(-(model.slope * margin + model.offset)))

    rows = [r for r in rows if score(r[1]) >= 0.7]
    grams, label = sets([t for _, t in rows], 5), list(range(len(rows)))
    for _ in rows:  # the least label spreads over links until nothing changes
        for i in range(len(rows)):
            for j in range(len(rows)):
                if grams[i] and grams[j] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                    label[i] = label[j] = min(label[i], label[j])
    first = {}
    for (k, _), at in zip(rows, label):
        if k is not None:
            first[at] = min(k, first.get(at, k))
    rows = [(k, t) for (k, t), at, g in zip(rows, label, grams) if k is None or not g or first[at] == k]
    padded = lambda t: f" {decontaminate.normalise(t)} "
    rows = [(k, t) for k, t in rows if all(best(padded(x), padded(t)) > int(0.08 * (len(padded(x)) - 2)) for x in items)]
    weights, trans = secrets_crf.train(frame(rows))
    out = []
    for k, t in rows:
        spans = [(s, e) for _, s, e in secrets_crf.base_spans(t or "")]
        tokens = [m.span() for m in secrets_crf.TOKEN.finditer(t or "")]
        tags = secrets_crf.viterbi(secrets_crf.features([t[a:b] for a, b in tokens], secrets_crf.file_feature(t or "")), weights, trans) if tokens else []
        own = []
        for (a, b), tag in zip(tokens, tags):
            if tag == 2 and own:
                own[-1][1] = b
            elif tag:
                own.append([a, b])
        covered = set()
        for a, b in [*spans, *own]:
            covered |= set(range(a, b))
        # spans that overlap are one mask; those that only touch are two
        starts = {a for a, b in [*spans, *own]} - {i for a, b in [*spans, *own] for i in range(a + 1, b)}
        masked = "".join("[SECRET]" if i in starts else "" if i in covered else c for i, c in enumerate(t or ""))
        out.append((k, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(masked, add_special_tokens=False).ids))
    return out


def test_stages(spark, tmp_path):
    item = "Onsh er thention, of andre the lyst inger; haed twelve thatish were on."
    good = "Then the ertion of thatish was on and by the inger, with these. "
    near = " ".join(f"word{i}" for i in range(200))
    rows = [(i, f"{good * (1 + i % 3)}{'abcdefghij'[i % 10]}{i} x{i * 7} y{i * 3}. {good[::-1]}{i}", "en", "s", 0) for i in range(60)]
    rows += [(100 + i, "!!! $$$ ### " * (5 + i), "en", "s", 0) for i in range(30)]
    rows += [(200, near, "en", "s", 0), (201, near + " more", "en", "s", 0), (202, f"Well then. {item} And on.", "en", "s", 0), (203, f'Here password = "{"ab1" * 8}" it is.', "en", "s", 0)]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (None, good + "unique tail", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        docs = P.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {100 + i for i in range(30)} & set(kept["quality_classifier"])
    assert set(range(0, 60)) <= set(kept["quality_classifier"])
    assert 200 in kept["ngram_jaccard_join"] and 201 not in kept["ngram_jaccard_join"]
    assert 202 not in kept["benchmark_decontamination"] and set(kept["secret_scan"]) == set(kept["benchmark_decontamination"])
    assert "ab1ab1" not in kept["secret_scan"][203]
    out = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(kept["secret_scan"])
    assert all(out[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and out[k].n_tokens == len(default_byte_bpe().encode(t or "", allowed_special="all")) for k, t in kept["secret_scan"].items())
    assert quality_nbsvm.THRESHOLD == 0.7
    want = plain_run(spark, [r[:2] for r in rows], spark.read.parquet(f"{tmp_path}/labels.parquet"), [item])
    assert {(k, r.n_tokens, r.ids_sha256) for k, r in out.items()} == {(k, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()) for k, x in want} and len(want) == len(out)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
