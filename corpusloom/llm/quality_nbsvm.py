"""Quality classifier: naive Bayes support vectors.

N-gram indicators of a text are scaled by the log-count ratio of the two classes; a linear model with L2-regularised
hinge loss is fitted on them by dual coordinate descent; a logistic curve, fitted on held-back margins, turns the
margin into a score. The model is fitted on the driver from a bounded sample of labelled rows (MAX_TRAIN, the rows of
smallest hash of doc_id); every document is scored on the executors, from its whole text, in one pass with no shuffle.

Edge cases: a null or empty text has no n-grams and gets the score of the bias alone; without labelled rows of both
classes every score is the smoothed base rate; repeated doc_ids are scored row by row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, prepare, smallest_hashes, table, trim

#: Bound on the labelled rows that the model is fitted on.
MAX_TRAIN = 4000
#: Bound on the UTF-8 bytes of those rows' texts together; rows beyond it, in hash order, are not used.
MAX_TRAIN_BYTES = 32 << 20
#: Bound on the UTF-8 bytes of one text that the model is fitted on; longer ones are scored, but not learnt from.
MAX_TEXT_BYTES = 2 << 20
MIN_DF = 3
ALPHA = 1.0
C = 1.0
EPOCHS = 30
THRESHOLD = 0.7

_WORD = re.compile(r"\S+")
_CORE = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"[^\W\d_]+|\d+|[\W_]")


def shape(word: str) -> str:
    """Letters as a, A or Aa, digits as 0, other characters as they are; runs shrink to one."""
    core = _CORE.match(word)
    if core and core.end() == len(word):
        return "a" if word.islower() else "A" if word.isupper() else "Aa"
    out = []
    for run in _RUNS.findall(word):
        s = ("a" if run.islower() else "A" if run.isupper() else "Aa") if run[0].isalpha() else "0" if run[0].isdigit() else run
        if not out or out[-1] != s:
            out.append(s)
        if len(out) == 6:
            break
    return "".join(out)


class _Shapes(dict):
    """Memo of shapes, emptied when large."""

    def __missing__(self, word: str) -> str:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = s = shape(word) if len(word) <= 64 else "long"
        return s


def ngrams(text: str | None, shapes: dict) -> set:
    """Indicators of a whole text: words, and n-grams of one to three shapes in which a repeated word reads '='."""
    words = (text or "").split()
    if not words:
        return set()
    marks = [shapes[w] for w in words]
    marks[1:] = ["=" if a == b else m for a, b, m in zip(words, words[1:], marks[1:])]
    return set(map(str.lower, set(words))) | set(zip(marks)) | set(zip(marks, marks[1:])) | set(zip(marks, marks[1:], marks[2:]))


@dataclass
class Model:
    weights: dict = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    base: float = 0.5

    def score(self, text: str | None, shapes: dict) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.slope * self.margin(text, shapes) + self.offset))))

    def margin(self, text: str | None, shapes: dict) -> float:
        get, total, norm = self.weights.get, 0.0, 0.0
        for g in ngrams(text, shapes):
            hit = get(g)
            if hit is not None:
                total += hit[0]
                norm += hit[1]
        return self.bias + (total / math.sqrt(norm) if norm else 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, epochs: int, seed: int = 7) -> np.ndarray:
    """L1-loss linear support vectors: min 1/2 |w|^2 + sum cost_i max(0, 1 - y_i w.x_i), one dual variable at a time."""
    w, alpha = np.zeros(width), np.zeros(len(rows))
    diag = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            if diag[i] == 0:
                continue
            ids, v = rows[i], values[i]
            gradient = y[i] * float(w[ids] @ v) - 1.0
            new = min(max(alpha[i] - gradient / diag[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                worst = max(worst, abs(step))
                w[ids] += step * y[i] * v
                alpha[i] = new
        if worst < 1e-4:
            break
    return w


def _svm(grams: list[np.ndarray], y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios and hinge-loss weights; the last feature is the bias."""
    count = np.full((2, width), ALPHA)
    for ids, label in zip(grams, y):
        count[int(label > 0), ids] += 1
    n = np.array([(y <= 0).sum(), (y > 0).sum()])[:, None] + 2 * ALPHA
    ratio = np.log(count[1] / n[1]) - np.log(count[0] / n[0])
    rows, values = [], []
    for ids in grams:
        v = ratio[ids]
        norm = math.sqrt(float(v @ v)) or 1.0
        rows.append(np.append(ids, width).astype(np.int32))
        values.append(np.append(v / norm, 1.0))
    share = np.where(y > 0, (y > 0).mean(), (y <= 0).mean())
    w = dual_coordinate_descent(rows, values, np.sign(y), C * 0.5 / share, width + 1, EPOCHS)
    return ratio, w


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y=1 | margin) by Newton steps on smoothed targets."""
    hi, lo = ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2)
    t, a, b = np.where(y > 0, hi, lo), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        r, s = p - t, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * margins).sum() + 1e-3 * a, r.sum()])
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
        if abs(da) + abs(db) < 1e-7:
            break
    return max(a, 1e-3), b


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Fit on texts with 0/1 labels; with one class only, the model scores the smoothed base rate."""
    ones, n = sum(labels), len(labels)
    base = (ones + 1) / (n + 2)
    if ones == 0 or ones == n:
        return Model(offset=math.log(base / (1 - base)), base=base, slope=0.0)
    shapes = _Shapes()
    # n-grams are made again in each pass: those of all texts together would not fit the driver. The buckets only spare
    # most rare n-grams an entry; a bucket counts no less than each n-gram in it
    buckets = np.zeros(1 << 22, np.int32)
    for t in texts:
        np.add.at(buckets, np.fromiter((hash(g) & (len(buckets) - 1) for g in ngrams(t, shapes)), np.int64), 1)
    df: Counter = Counter()
    for t in texts:
        df.update(g for g in ngrams(t, shapes) if buckets[hash(g) & (len(buckets) - 1)] >= MIN_DF)
    # sorted, so that the fit doesn't depend on set order
    vocab = {g: i for i, g in enumerate(sorted((g for g, k in df.items() if k >= MIN_DF), key=repr))}
    del df, buckets
    grams = [np.array(sorted(vocab[g] for g in ngrams(t, shapes) if g in vocab), np.int32) for t in texts]
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    fold = np.arange(n) % 3
    margins = np.zeros(n)
    for k in range(3):
        train = np.flatnonzero(fold != k)
        if len(set(y[train])) < 2:
            continue
        ratio, w = _svm([grams[i] for i in train], y[train], len(vocab))
        for i in np.flatnonzero(fold == k):
            v = ratio[grams[i]]
            margins[i] = w[-1] + (float(w[grams[i]] @ v) / (math.sqrt(float(v @ v)) or 1.0))
    slope, offset = _logistic(margins, y)
    ratio, w = _svm(grams, y, len(vocab))
    weights = {g: (float(w[i] * ratio[i]), float(ratio[i] ** 2)) for g, i in vocab.items() if ratio[i]}
    return Model(weights, float(w[-1]), slope, offset, base)


def sample(texts: DataFrame, labels: DataFrame, usable: Column | None = None, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> list[tuple[str, int]]:
    """The labelled rows of smallest hash of doc_id, at most max_train of them and max_bytes of text, from both tables'
    doc_id. Of several texts of a doc_id the one of smallest hash counts, of several labels the larger one."""
    picked = labels.where("doc_id is not null and quality in (0, 1)")
    picked = (picked if usable is None else picked.where(usable)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # first bounded by keys alone, then by sizes; only what is kept leaves the executors as text
    keys = smallest_hashes(picked, F.col("doc_id"), max_train).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    keys = keys.sparkSession.createDataFrame(keys.collect(), keys.schema)  # max_train rows of two numbers
    rows = texts.select("doc_id", "text").where(F.octet_length("text") <= MAX_TEXT_BYTES).join(F.broadcast(keys), "doc_id")
    hashed = rows.select("doc_id", "quality", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    first = hashed.groupBy("doc_id", "quality").agg(F.min("h").alias("h"), F.min_by("n", "h").alias("n")).collect()
    kept, total = [], 0
    for r in sorted(first, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
        total += r.n
        if total > max_bytes:
            break
        kept.append((r.doc_id, r.h))
    wanted = texts.sparkSession.createDataFrame(kept, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, h long")
    found = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    got = sorted(found.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return [(r.text, int(r.quality)) for r in got]


def train(texts: DataFrame, labels: DataFrame, usable: Column | None = None, max_train: int = MAX_TRAIN) -> Model:
    rows = sample(texts, labels, usable, max_train)
    model = fit([t for t, _ in rows], [q for _, q in rows])
    del rows
    trim(texts.sparkSession)  # what the fit took would stay with the driver through later stages
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, from its text alone."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make():
        m, shapes = shared.value, _Shapes()
        return lambda ids, texts: {"doc_id": ids, "score": [m.score(t, shapes) for t in texts]}

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(map_rows(["doc_id", "text"], schema, make), "doc_id long, score double")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more; all columns stay, and so do null texts that score it."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m, shapes = shared.value, _Shapes()
        for batch in batches:
            keep = [m.score(t, shapes) >= threshold for t in batch.column(at).to_pylist()]
            if any(keep):
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text has remainder 2 by 4; never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
