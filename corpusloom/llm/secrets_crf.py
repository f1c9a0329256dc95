"""Secret scan: a linear-chain conditional random field over tokens, beside fixed base patterns.

Base spans (assignments, access keys, long hexadecimal runs) are found by their patterns in every whole text. The
field tags tokens as beginning of a secret, inside or outside (B, I, O) from the token's shape, its neighbours and
features of the file, decoded by Viterbi over all tokens of the text. Most tokens are O in every best sequence whatever
stands beside them, which a bound on what the transitions can give shows at once (Decoder.open_tokens); the runs of
other tokens between them are decoded one by one, so that the result is that of one decoding of the whole text.

The field is trained on the driver for conditional likelihood, with forward and backward sums, from a bounded sample
of texts (MAX_TRAIN windows, around tokens that could be secrets and at random places); its labels are the base spans of the sample plus the same windows with secrets of other
kinds planted in them by a seeded generator, so that it learns context and shape rather than the base patterns alone.

One pass over the texts with no shuffle. Memory of a task: one Arrow batch.

Edge cases: null counts as empty (no spans); ties between tag sequences go to the first in the order O, B, I; repeated
rows give repeated results; extra columns are ignored; without training texts the field adds nothing.
"""

from __future__ import annotations

import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import delete, map_rows, materialise, prepare, smallest_hashes, table

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Substrings, in lower case, without one of which ASSIGN has no match.
CUES = ("passw", "secret", "token", "api")

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]+")
#: Tokens around which training windows lie; decoding does not use it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{8,}")
#: Tokens on either side of a candidate in its window, and characters that hold them at most.
REACH, REACH_CHARS = 4, 160
#: Words that often come before a secret.
CREDENTIAL = re.compile(r"(?<![A-Za-z])(?:key|api_?key|secret|token|passw(?:or)?d|passphrase|pwd|credentials?|auth|bearer|pin)(?![A-Za-z])", re.ASCII | re.IGNORECASE)
#: Words whose features a task keeps, at the start of a text; and tokens decoded at once.
CACHE, BLOCK = 100_000, 1 << 16
TAGS = "OBI"
MAX_TRAIN = 4000
#: Bounds of the sample that the field is fitted on: rows, bytes of a text, and bytes of all texts.
TRAIN_DOCS = 3000
TRAIN_TEXT_BYTES = 1 << 16
TRAIN_BYTES = 24 << 20
EPOCHS, RATE, PENALTY = 6, 0.2, 0.01


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns as (kind, start, end), in the order of start, then kind."""
    found = []
    low = text.lower()
    if any(c in low for c in CUES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def windows(text: str) -> list[tuple[int, int]]:
    """Character ranges around candidates, joined where they overlap, ended between tokens."""
    out: list[list[int]] = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        before = [t.start() for t in TOKEN.finditer(text, max(0, a - REACH_CHARS), a)]
        after = [t.end() for t in TOKEN.finditer(text, b, min(len(text), b + REACH_CHARS))]
        a = before[-REACH:][0] if before else a
        b = after[:REACH][-1] if after else b
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _bucket(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


def _shape(word: str) -> str:
    out = re.sub(r"[a-z]+", "a", word)
    out = re.sub(r"[A-Z]+", "A", out)
    out = re.sub(r"[0-9]+", "0", out)
    return out if len(out) <= 8 else "mix"


def _entropy(word: str) -> float:
    word = word
    return -sum(k / len(word) * math.log2(k / len(word)) for k in (word.count(c) for c in set(word)))


def own_features(w: str) -> tuple[list[str], bool]:
    """Features of a token alone, and whether it holds a credential word."""
    cue = CREDENTIAL.search(w) is not None
    if len(w) < 6 or (w.isalpha() and (w.islower() or w.istitle())):
        return [f"w={w.lower()}" if len(w) < 12 else "w", "plain"], cue
    if w.isalpha():
        kind = "letters"
    elif w.isdigit():
        kind = "digits"
    elif re.fullmatch(r"[0-9a-f]+", w):
        kind = "hexed"
    elif re.fullmatch(r"[A-Z0-9]+", w):
        kind = "upper"
    else:
        kind = "mixed" if re.search(r"[0-9]", w) else "joined"
    size = _bucket(len(w), (8, 12, 16, 20, 32, 40))
    switches = _bucket(len(re.findall(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", w)), (1, 2, 4, 8))
    cases = _bucket(len(re.findall(r"[a-z](?=[A-Z])", w)), (1, 2, 3, 5))
    out = [kind, f"s={_shape(w)}", f"l={size}", f"e={_bucket(_entropy(w), (2.0, 2.5, 3.0, 3.5, 4.0))}", f"x={switches}", f"{kind}|{switches}|{size}", f"c={cases}|{kind}|{size}"]
    return [*out, "assigns"] if cue and "=" in w[1:-1] else out, cue


def _beside(d: int, mine: list[str], cue: bool) -> list[str]:
    """Features that a token gives to the one that stands -d tokens after it."""
    return [f"{d}:{mine[0]}"] * (d > -3) + [f"{d}:cue"] * (cue and d < 0)


def features(words: list[str], file: str) -> list[list[str]]:
    """Per token: its shape, length and entropy, its neighbours, and the file's features."""
    own = [own_features(w) for w in words]
    out = []
    for i, (mine, _) in enumerate(own):
        f = [*mine, "bias", file]
        for d in (-3, -2, -1, 1):
            f += _beside(d, *(own[i + d] if 0 <= i + d < len(own) else (["edge"], False)))
        if i and own[i - 1][0][0].startswith("w="):
            f.append(f"{mine[0]}<{own[i - 1][0][0]}")
        out.append(f)
    return out


def file_feature(text: str) -> str:
    """Of the whole text: whether it assigns and quotes much, as code and settings do."""
    signs = text.count("=") + text.count(":") + text.count('"')
    return f"file={_bucket(signs / (len(text) + 1), (0.001, 0.01, 0.03))}"


def best_tags(emit: list[list[float]], trans: dict, before: int = -1, closed: bool = False) -> list[int]:
    """The best tags of tokens with the given scores after a tag (-1: the start), if closed with an O after them."""
    back: list[list[int]] = []
    best = [trans.get((0, 0), 0.0) if before == 0 else 0.0, trans.get((before, 1), 0.0), -1e9]
    for i, e in enumerate(emit):
        if i:
            step, now = [], []
            for t in range(3):
                scores = [best[p] + trans.get((p, t), 0.0) if not (t == 2 and p == 0) else -1e9 for p in range(3)]
                p = max(range(3), key=lambda q: (scores[q], -q))
                step.append(p)
                now.append(scores[p])
            back.append(step)
            best = now
        best = [b + x for b, x in zip(best, e)]
    if closed:
        best = [b + trans.get((t, 0), 0.0) for t, b in enumerate(best)]
    tag = max(range(3), key=lambda t: (best[t], -t))
    tags = [tag]
    for step in reversed(back):
        tag = step[tag]
        tags.append(tag)
    return tags[::-1]


def viterbi(rows: list[list[str]], weights: dict, trans: dict) -> list[int]:
    """The best tags of a token sequence; I follows only B or I."""
    none = (0.0, 0.0, 0.0)
    return best_tags([[sum(x) for x in zip(*(weights.get(f, none) for f in row))] for row in rows], trans) if rows else []


class Decoder:
    """Viterbi over all tokens of a text. Tokens of equal features share a row of scores; words that the field has not
    seen have equal ones."""

    def __init__(self, weights: dict, trans: dict):
        self.weights, self.trans = weights, trans
        pairs = {(f[:i], f[i + 1 :]): x for f, x in weights.items() for i in range(1, len(f)) if f[i] == "<" and f.startswith("w=", i + 1)}
        self.keys = {k: i for i, k in enumerate(sorted({k for pair in pairs for k in pair}))}
        found = sorted((self.keys[a] * len(self.keys) + self.keys[b], x) for (a, b), x in pairs.items())
        self.pair_keys = np.array([k for k, _ in found], np.int64)
        self.pair_scores = np.array([x for _, x in found], np.float64).reshape(-1, 3)
        # words that some feature names; all other plain words are alike
        self.lexicon = {f[m.end() :] for f in weights for m in re.finditer("w=", f)} | {k[2:] for k in self.keys if k.startswith("w=")}
        t = lambda p, n: 0.0 if (p, n) == (-1, 0) or n is None else trans.get((p, n), 0.0)
        # the most that B or I at a token can give over O by transitions: before another tag than I, and before I, which becomes B
        self.bounds = []
        for x in (1, 2):
            into = max(t(p, x) - t(p, 0) for p in ((-1, 0, 1, 2) if x == 1 else (1, 2)))
            plain = max(t(x, n) - t(0, n) for n in (None, 0, 1))
            inside = t(x, 2) - t(0, 1) + max(t(2, n) - t(1, n) for n in (None, 0, 1, 2))
            self.bounds.append((into + plain, into + inside))
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: dict[tuple, int] = {}
        self.scores, self.key = np.zeros((1024, 5, 3)), np.full(1024, -1, np.int64)
        self._row(["edge"], False, [])

    def _sum(self, names: list[str]) -> list[float]:
        rows = [self.weights[f] for f in names if f in self.weights]
        return [sum(x) for x in zip(*rows)] if rows else [0.0, 0.0, 0.0]

    def _row(self, mine: list[str], cue: bool, own: list[str]) -> int:
        name = (cue, *mine)
        n = self.rows.get(name)
        if n is None:
            n = self.rows[name] = len(self.rows)
            if n == len(self.key):
                self.scores, self.key = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.key, np.full(n, -1, np.int64)])
            self.scores[n] = [self._sum(own), *(self._sum(_beside(d, mine, cue)) for d in (-3, -2, -1, 1))]
            self.key[n] = self.keys.get(mine[0], -1)
        return n

    def _id(self, w: str) -> int:
        mine, cue = own_features(w)
        if mine[0].startswith("w=") and mine[0][2:] not in self.lexicon:
            mine = ["w=", *mine[1:]]
        found = self._row(mine, cue, [*mine, "bias"])
        # of long tokens the features are kept, not the text
        if len(w) <= 64:
            self.ids[w] = found
        return found

    def emissions(self, ids: np.ndarray, file: np.ndarray, a: int, b: int) -> np.ndarray:
        """Scores of the tokens a to b; ids has three edges before the first token and one after the last."""
        at = lambda d, k: self.scores[ids[a + 3 + d : b + 3 + d], k]
        out = at(0, 0) + file + at(-3, 1) + at(-2, 2) + at(-1, 3) + at(1, 4)
        if len(self.pair_keys):
            mine, prev = self.key[ids[a + 3 : b + 3]], self.key[ids[a + 2 : b + 2]]
            want = np.where((mine >= 0) & (prev >= 0), mine * len(self.keys) + prev, -1)
            k = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
            hit = np.flatnonzero(self.pair_keys[k] == want)
            out[hit] += self.pair_scores[k[hit]]
        return out

    def open_tokens(self, e: np.ndarray, n: int) -> np.ndarray:
        """Which of the first n tokens need not be O: to make any other O, and an I after it B, may not raise the score.
        e has the scores of the n tokens and of the next one, if there is one."""
        inside = np.full(n, -np.inf)
        inside[: len(e) - 1] = (e[1:, 2] - e[1:, 1])[:n]
        gain = [e[:n, x] - e[:n, 0] + np.maximum(plain, into + inside) for x, (plain, into) in zip((1, 2), self.bounds)]
        return np.maximum(*gain) >= -1e-6

    def tagged(self, text: str) -> list[tuple[int, int]]:
        """Index and tag of all tokens that are not O, in order."""
        if len(self.ids) > CACHE:
            self.clear()
        known, new = self.ids.get, self._id
        words = TOKEN.findall(text) if len(text) <= 1 << 20 else (m[0] for m in TOKEN.finditer(text))
        ids = np.fromiter((new(w) if (i := known(w)) is None else i for w in words), np.int64)
        n, ids = len(ids), np.concatenate([[0, 0, 0], ids, [0]]).astype(np.int64)
        file = np.array(self._sum([file_feature(text)]))
        places, scores = [], []
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            e = self.emissions(ids, file, a, min(n, b + 1))
            at = np.flatnonzero(self.open_tokens(e, b - a))
            places.append(at + a)
            scores.append(e[at])
        at = np.concatenate(places) if places else np.empty(0, np.int64)
        if not len(at):
            return []
        e, out = np.concatenate(scores).tolist(), []
        cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
        where = at.tolist()
        for x, y in zip(cuts, cuts[1:]):
            tags = best_tags(e[x:y], self.trans, -1 if where[x] == 0 else 0, where[y - 1] < n - 1)
            out += [(i, t) for i, t in zip(where[x:y], tags) if t]
        return out


def _planted(rng: random.Random) -> tuple[str, str]:
    """A secret of a kind that the base patterns don't cover, with the words before it."""
    chars = string.ascii_letters + string.digits
    kind = rng.randrange(9)
    body = "".join(rng.choice(chars) for _ in range(rng.choice((20, 24, 32, 40, 44))))
    lead = ("Bearer ", "credential: ", "credential = ", "access_key: ", "client_key = ", "auth: ", "pin: ", "key = ", "pin ", "passphrase ")
    if kind == 5:
        return "".join(rng.choice(string.ascii_letters) for _ in range(len(body))), rng.choice(lead)
    if kind == 6:
        return "-".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(4, 9))) for _ in range(rng.randrange(3, 6))), rng.choice(lead)
    if kind == 7:
        return "".join(rng.choice(string.digits) for _ in range(rng.choice((12, 16, 20, 24)))), rng.choice(lead)
    if kind == 8:
        return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(12, 25))), rng.choice(lead)
    if kind == 0:
        return "ghp_" + body, rng.choice(("", "auth ", "pat: "))
    if kind == 1:
        return "sk-" + body, rng.choice(("", "key ", "bearer "))
    if kind == 2:
        return body[:-1] + "=", rng.choice(("credential ", "private_key: ", "auth_key = "))
    if kind == 3:
        return "xoxb-" + "".join(rng.choice(string.digits) for _ in range(11)) + "-" + body, rng.choice(("", "hook "))
    return body, rng.choice(("Bearer ", "credential=", "access_key: ", "client_key = "))


def _plain(rng: random.Random) -> str:
    """A candidate that is no secret: dates, versions, paths, numbered names."""
    n = rng.randrange
    return rng.choice((f"20{n(30):02d}-{1 + n(12):02d}-{1 + n(28):02d}", f"v{n(9)}.{n(20)}.{n(99)}-rc{n(9)}", f"chapter{n(99999)}", f"images/photo_{n(9999)}.jpg", f"src/file{n(99)}.py", f"item-{n(99999)}-{n(99)}", f"{n(999)}.{n(999)}.{n(99)}kb", f"user{n(999999)}.example.com", f"{n(10 ** rng.randrange(6, 13))}", rng.choice(("JavaScript", "McDonald", "OpenStreetMap", "UNESCO", "PostgreSQL")), rng.choice(("state-of-the-art", "well-known", "mother-in-law", "up-to-date", "end-of-line."))))


def examples(texts: list[str], max_train: int = MAX_TRAIN, seed: int = 11) -> list[tuple[list[str], str, list[int]]]:
    """Windows as (words, file feature, tags) from base spans, and from plants in running words."""
    rng, out = random.Random(seed), []
    for text in texts:
        file, spans = file_feature(text), base_spans(text)
        ranges = windows(text)
        if text and len(out) < max_train:
            at = rng.randrange(len(text))
            ranges = ranges + [(a, b) for a, b in [(text.rfind(" ", 0, at) + 1, text.find(" ", min(len(text), at + 60)))] if b > a]
        for a, b in ranges:
            if len(out) >= max_train:
                return out
            tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]
            words = [text[s:e] for s, e in tokens]
            inside = lambda s, e: any(s < y and e > x for _, x, y in spans) and re.search(r"[0-9]", text[s:e]) and e - s >= 8  # noqa: E731, B023
            tags = []
            for s, e in tokens:
                hit = bool(inside(s, e))
                tags.append((2 if tags and tags[-1] else 1) if hit else 0)
            out.append((words, file, tags))
            clean = [w for w, t in zip(words, tags) if not t]
            if len(clean) >= 2:
                cut = rng.randrange(1, len(clean) + 1)
                secret, lead = _planted(rng)
                parts = [m[0] for m in TOKEN.finditer(lead)]
                pieces = [m[0] for m in TOKEN.finditer(secret)]
                out.append((clean[:cut] + parts + pieces + clean[cut:], file, [0] * (cut + len(parts)) + [1] + [2] * (len(pieces) - 1) + [0] * (len(clean) - cut)))
                # a candidate that is no secret, or a credential word without a secret
                other = [_plain(rng)] if rng.random() < 0.7 else parts
                out.append((clean[:cut] + other + clean[cut:], file, [0] * (len(clean) + len(other))))
    return out


def marginals(emit: list[list[float]], trans: list[list[float]]) -> tuple[list[list[float]], list[list[float]]]:
    """Probability of each tag at each token, and expected counts of each pair of tags (row 3: start), by the forward and
    backward sums of a chain in which I follows only B or I. emit and trans are logarithms."""
    m = [[math.exp(trans[i][j]) for j in range(3)] for i in range(4)]
    m[0][2] = m[3][2] = 0.0
    x = []
    for e in emit:
        top = max(e)
        x.append([math.exp(v - top) for v in e])
    n = len(x)
    alpha, scale = [], []
    for t in range(n):
        row = [(m[3][j] if t == 0 else alpha[-1][0] * m[0][j] + alpha[-1][1] * m[1][j] + alpha[-1][2] * m[2][j]) * x[t][j] for j in range(3)]
        c = sum(row)
        alpha.append([v / c for v in row])
        scale.append(c)
    beta = [[1.0] * 3 for _ in range(n)]
    pairs = [[0.0] * 3 for _ in range(4)]
    for t in range(n - 2, -1, -1):
        after = [x[t + 1][j] * beta[t + 1][j] / scale[t + 1] for j in range(3)]
        for i in range(3):
            for j in range(3):
                pairs[i][j] += alpha[t][i] * m[i][j] * after[j]
        beta[t] = [m[i][0] * after[0] + m[i][1] * after[1] + m[i][2] * after[2] for i in range(3)]
    tags = [[a * b for a, b in zip(alpha[t], beta[t])] for t in range(n)]
    pairs[3] = list(tags[0])
    return tags, pairs


def fit(texts: list[str], max_train: int = MAX_TRAIN, seed: int = 11) -> tuple[dict, dict]:
    """Weights of (feature, tag) and of (tag, tag) that maximise the conditional log-likelihood of the examples' tags with
    an L2 penalty, by stochastic gradient steps."""
    found = [(features(words, file), tags) for words, file, tags in examples(texts, max_train, seed) if words]
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in found for row in rows for f in row}))}
    data = [([np.array(sorted({names[f] for f in row})) for row in rows], tags) for rows, tags in found]
    w, trans = np.zeros((len(names), 3)), [[0.0] * 3 for _ in range(4)]
    rng = random.Random(seed)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        rng.shuffle(data)
        for rows, tags in data:
            probs, pairs = marginals([w[ids].sum(axis=0).tolist() for ids in rows], trans)
            for ids, p, t in zip(rows, probs, tags):
                step = [-rate * q for q in p]
                step[t] += rate
                w[ids] += step
            for a, t in zip([3, *tags], tags):
                trans[a][t] += rate
            for i in range(4):
                for j in range(3):
                    trans[i][j] -= rate * pairs[i][j]
        w *= 1 - PENALTY * rate
    # the start's weight of O is taken as zero, as the decoder does
    out = {(i if i < 3 else -1, j): trans[i][j] - (trans[3][0] if i == 3 else 0.0) for i in range(4) for j in range(3)}
    return {f: tuple(w[i].tolist()) for f, i in names.items()}, out


def scan(text: str, weights: dict, trans: dict, decoder: Decoder | None = None) -> tuple[list, list]:
    """Base spans, and all spans: the base ones and those of the field that no base span holds."""
    base = base_spans(text)
    kept = []
    if weights and text and (tagged := (decoder or Decoder(weights, trans)).tagged(text)):
        need, added, i = iter(tagged), [], 0
        at, tag = next(need)
        for k, m in enumerate(TOKEN.finditer(text)):
            if k < at:
                continue
            if tag == 2 and added:
                added[-1][1] = m.end()
            else:
                added.append([*m.span()])
            if (step := next(need, None)) is None:
                break
            at, tag = step
        reach = 0
        for s, e in added:  # both lists are ordered by start
            while i < len(base) and base[i][1] <= s:
                reach = max(reach, base[i][2])
                i += 1
            if reach < e:
                kept.append(("crf", s, e))
    return base, sorted(base + kept, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def sample(docs: DataFrame, limit: int = TRAIN_DOCS, most: int = TRAIN_BYTES) -> list[str]:
    """At most limit texts of up to TRAIN_TEXT_BYTES, and most bytes in all: the rows of smallest hash, half of them with a
    cue. Copies of one text are one row."""
    short = docs.where(F.octet_length("text") <= TRAIN_TEXT_BYTES).select("text")
    cue = F.col("text").rlike(r"[A-Za-z0-9+/_.=-]{16,}") & F.col("text").rlike(r"[0-9][a-z]|[A-Z][0-9]")
    texts: list[str] = []
    for rows in (short.where(cue), short):
        near = smallest_hashes(rows, F.col("text"), limit // 2).groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
        near = materialise(near, "sample")  # about limit rows
        last, total = None, 0
        for r in near.select("h", F.octet_length("text").alias("n")).orderBy("h").limit(limit // 2).collect():
            total += r.n
            if total > most // 2:
                break
            last = r.h
        texts += [r.text for r in near.where(F.col("h") <= last).orderBy("h").collect()] if last is not None else []
        delete(near)
    return list(dict.fromkeys(texts))


def train(docs: DataFrame) -> tuple[dict, dict]:
    return fit(sample(docs))


def spans(docs: DataFrame, model: tuple[dict, dict]) -> DataFrame:
    """doc_id, base and spans (kind:start:end, comma-joined) and the counts of the base kinds, for every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def make():
        weights, trans = shared.value
        decoder = Decoder(weights, trans)

        def work(keys, texts):
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, text in zip(keys, texts):
                base, every = scan(text or "", weights, trans, decoder)
                out["doc_id"].append(key)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base"].append(",".join(f"{k}:{s}:{e}" for k, s, e in base))
                out["spans"].append(",".join(f"{k}:{s}:{e}" for k, s, e in every))
            return out

        return work

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(map_rows(["doc_id", "text"], schema, make), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame, model: tuple[dict, dict], mask: str = "[SECRET]") -> DataFrame:
    """docs with every span's text replaced by mask and n_chars following the text; other columns stay. Overlapping
    spans are joined. Null texts stay null."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        weights, trans = shared.value
        decoder = Decoder(weights, trans)
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    parts, done = [], 0
                    for _, s, e in scan(text, weights, trans, decoder)[1]:
                        if s >= done:
                            parts += [text[done:s], mask]
                        done = max(done, e)
                    text = "".join([*parts, text[done:]])
                texts.append(text)
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secrets_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = spans(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")
