"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class; only
classes are compared. The shingles of a set are ordered by one global order, rare before frequent; two sets of
similarity t or more share a shingle within their prefixes of n - ceil(t n) + 1. Classes with identical prefix and
size are one group; group pairs that share a prefix shingle are filtered by size and position; what is left is
expanded to members, whose sets are compared exactly.

Results are components, so that a link between members that are connected anyhow need not be proven. Star rounds pair
every group with the leader of most of its buckets (a bucket's leader is the group with the fewest rarer shingles) that
is in another component, and once every member with the first of its group: fewer pairs than groups. Rounds go on while
they link much. The last round pairs what a bucket or a group still holds in different components, filtered by the
positions of their shingles in common. No link that could join two components is skipped, whatever the size of a bucket.

Pairs are proven in two steps. A class has a print: how many of its shingles fall into each of some cells by their hash.
The sum of the lesser counts of two prints is a bound on what their sets have in common, and rules most pairs out; sets
of what is left are compared exactly, from the texts.

The order: shingles that repeat within some block of documents are counted over all documents; those of HEAVY_DF
documents or more (the most frequent MAX_HEAVY of them, 16 MB, or fewer where many have one count) come last, by frequency. Any order gives the same
result; a better one gives fewer pairs.

Shuffles: prefix rows once by shingle, prints and texts of the pairs to compare. Buckets of hot shingles, which the counts
tell, get their leader by a sum and a broadcast instead of a window; a text that is compared with many is salted; hot
classes and components are joined by broadcast (common.join_unique).

Two 64-bit hashes may collide: the chance for one pair of sets of a thousand shingles each is below 1e-13.

Edge cases: null, empty and blank texts have empty sets (n_shingles 0) and link with nothing; texts of fewer words
than a shingle have one shingle of all their words; repeated doc_ids are taken row by row; a null doc_id links like
any other but never names a component unless no other id is in it; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import HOT, delete, join_unique, materialise, prepare, table, trim
from corpusloom.llm.components import components

#: Documents from which a shingle counts as frequent, and how many frequent shingles the order holds.
HEAVY_DF = 16
MAX_HEAVY = 1 << 20
#: Shingles that one block of the frequency count holds.
BLOCK_SHINGLES = 2_000_000
#: Words whose hashes a task keeps, and classes and groups that it knows to have sent.
CODES, SENT = 1 << 17, 1 << 18
#: Ids up to which the documents to compare are picked by broadcast; beyond, by a shuffled join.
MAX_BROADCAST_IDS = 1_000_000
#: Star rounds at most; they end when one links no more than a STAR_SHARE-th of the first.
STAR_ROUNDS, STAR_SHARE = 8, 20
#: Pairs of one text that are compared in one task.
SALT_PAIRS = 256


class Shingler:
    """Sorted distinct shingle hashes of texts. ASCII letters count in lower case; words end at ASCII white space."""

    def __init__(self, words: int):
        self.words = words

        class Codes(dict):
            def __missing__(self, word):
                if len(self) >= CODES:
                    self.clear()
                self[word] = code = xxhash.xxh3_64_intdigest(word)
                return code

        self.codes = Codes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        w = min(self.words, len(words))
        h = np.full(len(words) - w + 1, 0x9E3779B97F4A7C15 + w, np.uint64)
        for i in range(w):
            h ^= codes[i : len(words) - w + 1 + i]
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        h.sort()
        if len(h) > 1:
            h = h[np.append(True, h[1:] != h[:-1])]
        return h


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _class_id(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64))


def frequent(docs: DataFrame, words: int, heavy_df: int | None = None, most: int = MAX_HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their counts: a bounded table for the driver and the broadcast."""
    heavy_df = HEAVY_DF if heavy_df is None else heavy_df
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size, seen = Shingler(words), [], 0, set()

        def counted():
            h = np.concatenate(held) if held else np.empty(0, np.uint64)
            h.sort()
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
            n = np.diff(np.append(starts, len(h)))
            return pa.RecordBatch.from_arrays([pa.array(_signed(h[starts[n > 1]])), pa.array(n[n > 1].astype(np.int64))], schema=schema)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                h = shingler(text)
                key = _class_id(h)
                if len(h) and key not in seen:  # equal sets count once a block
                    seen.add(key)
                    held.append(h)
                    size += len(h)
                if size >= BLOCK_SHINGLES:
                    yield counted()
                    held, size, seen = [], 0, set()
        yield counted()

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= heavy_df)
    counts = materialise(counts, "frequent")
    # the least count from which all fit, in steps of a ninth; a histogram of a few hundred rows
    step = F.floor(F.log2("n") * 6)
    held, least = 0, 1 << 62
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        held += r["count"]
        if held > most:
            break
        least = r.step
    top = counts.where(step >= least).toPandas()
    delete(counts)
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, heavy: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles of a set in the global order."""
    n = len(h)
    p = n - (percent * n + 99) // 100 + 1
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
        hot = heavy[at] == h
        if hot[: p + 1].any() or hot.any():
            light = h[~hot]
            if len(light) >= p:
                return light[:p]
            late = h[hot]
            return np.concatenate([light, late[np.lexsort((late, counts[at[hot]]))]])[:p]
    return h[:p]


def print_of(h: np.ndarray) -> bytes:
    """A set's print: its size, and for each cell how many of the hashes fall into it, 255 for that many or more."""
    cells = 64
    while cells < 4096 and 2 * cells < len(h):
        cells *= 2
    counts = np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return len(h).to_bytes(4, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_be_alike(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets can be similar enough, by their prints."""
    x, y = (np.frombuffer(p, np.uint8, offset=4).astype(np.int64) for p in (a, b))
    x[x == 255] = y[y == 255] = 1 << 40
    cells = min(len(x), len(y))
    most = int(np.minimum(x.reshape(-1, cells).sum(0), y.reshape(-1, cells).sum(0)).sum())
    sizes = [int.from_bytes(p[:4], "little") for p in (a, b)]
    most = min(most, *sizes)
    return 100 * most >= percent * (sum(sizes) - most)


def signatures(docs: DataFrame, words: int, percent: int, counted: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n (set size), cid (class), gid (group), the group's prefix and the class's print, these two once a task and
    group or class. counted: the frequent shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(counted)  # MAX_HEAVY rows at most
    names = ["doc_id", "n", "cid", "gid"]
    schema = pa.schema([*((c, pa.int64()) for c in names), ("keys", pa.list_(pa.int64())), ("print", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, counts = shared.value
        shingler, sent = Shingler(words), OrderedDict()

        def new(key):
            if key in sent:
                return False
            sent[key] = None
            if len(sent) > SENT:
                sent.popitem(last=False)
            return True

        for batch in batches:
            cols, keys, prints = [[] for _ in names], [], []
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                h = shingler(text)
                cid = gid = first = own = None
                if len(h):
                    cid, first = _class_id(h), prefix(h, heavy, counts, percent)
                    gid = _class_id(np.append(first, np.uint64(len(h))))
                    own = print_of(h) if new(cid) else None
                    first = first if new(~gid) else None
                for c, v in zip(cols, (doc_id, len(h), cid, gid)):
                    c.append(v)
                keys.append(None if first is None else _signed(first))
                prints.append(own)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, cid long, gid long, keys array<long>, print binary")


def _may_link(a: str, b: str, percent: int, position: bool = True) -> Column:
    """Size filter, and for a first common shingle the position filter."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    size = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    if not position:
        return size
    return size & ((100 + percent) * F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos")) >= percent * (na + nb))


def over_buckets(rows: DataFrame, hot: DataFrame, **folds: Column) -> DataFrame:
    """Adds folds over all rows of a shingle k: by a window, or for hot shingles by a sum and a broadcast. rows: a table."""
    w = Window.partitionBy("k")
    cold = rows.join(F.broadcast(hot), "k", "left_anti").repartition("k").withColumns({n: f.over(w) for n, f in folds.items()})
    warm = rows.join(F.broadcast(hot), "k")
    sums = warm.groupBy("k").agg(*(f.alias(n) for n, f in folds.items()))  # a row a hot shingle
    return cold.unionByName(warm.join(F.broadcast(sums), "k").select(*cold.columns))


def buckets(sig: DataFrame, counted: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Prefix rows (k, gid, n, pos, lead) of shingles that more than one group has, and the hot shingles (k)."""
    spark = sig.sparkSession
    total = sig.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    # shingles of so many documents; a prefix holds about a share of (100 - percent) % of a set, so they are a few times HOT
    hot = spark.createDataFrame([(int(k),) for k in _signed(counted[0][counted[1] * HOT > max(total, HOT * HOT // 4)])], "k long")
    # tasks may repeat a group's rows, which changes no fold
    rows = sig.where("keys is not null").select("gid", "n", F.posexplode("keys").alias("pos", "k"))
    rows = over_buckets(rows, hot, lo=F.min("gid"), hi=F.max("gid"), lead=F.min(F.struct("pos", "n", "gid")))
    return materialise(rows.where("lo <> hi").select("k", "gid", "n", "pos", "lead"), "buckets"), hot


def stars(shared: DataFrame, percent: int) -> DataFrame:
    """(gid, lead_gid, buckets): every group with the leaders of its buckets that it may link to, and of how many buckets."""
    rows = shared.select("gid", "n", "pos", F.col("lead.gid").alias("lead_gid"), F.col("lead.n").alias("lead_n"), F.col("lead.pos").alias("lead_pos"))
    rows = rows.where((F.col("gid") != F.col("lead_gid")) & _may_link("", "lead_", percent))
    return materialise(rows.groupBy("gid", "lead_gid").agg(F.count("*").alias("buckets")), "stars")


def likely(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that their prints do not rule out."""
    need = materialise(pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid"))).distinct(), "need")
    side = F.broadcast(need) if need.count() <= MAX_BROADCAST_IDS else need
    prints = materialise(sig.where("print is not null").select("cid", "print").join(side, "cid", "left_semi").groupBy("cid").agg(F.min("print").alias("print")), "prints")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([may_be_alike(a, b, percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    first, second = (prints.select(F.col("cid").alias(c), F.col("print").alias(f"print_{c}")) for c in "uv")
    both = join_unique(materialise(join_unique(pairs, first, ["u"]), "halves"), second, ["v"])
    out = materialise(both.select("u", "v", "print_u", "print_v").mapInArrow(run, "u long, v long"), "likely")
    delete(need)
    delete(prints)
    return out


def verified(pairs: DataFrame, docs: DataFrame, sig: DataFrame, names: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar enough. pairs: a table. names: cid and the doc_id of one row of
    each class."""
    pairs = likely(pairs, sig, percent)
    ends = pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid")))
    degrees = ends.groupBy("cid").agg(F.count("*").alias("n"))
    need = materialise(degrees.join(names, "cid"), "need")
    n_need, n_pairs = need.count(), pairs.count()
    small = lambda df, n: F.broadcast(df) if n <= MAX_BROADCAST_IDS else df
    ids = need.select(F.col("doc_id").alias("need_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(ids, n_need), F.col("doc_id").eqNullSafe(F.col("need_id")), "left_semi")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            cids = [_class_id(h) if len(h := shingler(t)) else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), batch.column(1)], names=["cid", "text"])

    texts = materialise(rows.mapInArrow(named, "cid long, text string").join(small(need.select("cid"), n_need), "cid", "left_semi"), "texts")
    if texts.count() > n_need:  # a repeated doc_id brought a class twice
        once = materialise(texts.groupBy("cid").agg(F.min("text").alias("text")), "texts")
        delete(texts)
        texts = once

    # u leads: the class of more pairs; its text goes to SALT_PAIRS of them at a time, and that of v to u
    degree = lambda c: need.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"))
    turned = join_unique(materialise(join_unique(pairs, degree("u"), ["u"]), "turned"), degree("v"), ["v"])
    leads = F.struct("n_u", "u") >= F.struct("n_v", "v")
    turned = materialise(turned.select(F.when(leads, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(leads, F.col("v")).otherwise(F.col("u")).alias("v")), "turned")
    salts = materialise(turned.groupBy("u").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("salts")), "salts")
    salted = join_unique(turned, salts, ["u"]).select("u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("v").alias("cid"))
    heads = salts.select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("u").alias("cid"))
    sent = materialise(salted.unionByName(heads), "sent")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, x = Shingler(words), None
        for batch in batches:
            us, vs = [], []
            for u, role, v, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                y = shingler(text)
                if role == 0:
                    x = y
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    moved = texts.join(small(sent, 2 * n_pairs), "cid").repartition("u", "salt").sortWithinPartitions("u", "salt", "role")
    out = materialise(moved.select("u", "role", "cid", "text").mapInArrow(compared, "u long, v long"), "links")
    for done in (pairs, need, texts, turned, salts, sent):
        delete(done)
    return out


def merged(units: DataFrame, links: DataFrame) -> DataFrame:
    """units (cid, label and more) with the labels after some links between classes; only the labels that they join are
    searched for components."""
    ends = units.select("cid", "label")
    edges = links.join(ends.select(F.col("cid").alias("u"), F.col("label").alias("lu")), "u").join(ends.select(F.col("cid").alias("v"), F.col("label").alias("lv")), "v")
    moved = materialise(components(edges.select(F.col("lu").alias("u"), F.col("lv").alias("v"))).select(F.col("node").alias("label"), F.col("label").alias("to")), "moved")
    out = join_unique(units, moved, ["label"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    out = materialise(out, "units")
    delete(moved)
    delete(units)
    return out


def rest_pairs(shared: DataFrame, hot: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """(u, v) of classes in different components whose groups may be alike, or are one."""
    split = materialise(units.select("gid", "label").distinct(), "split")
    marked = over_buckets(materialise(shared.select("k", "gid", "n", "pos").join(split, "gid"), "marked"), hot, lo=F.min("label"), hi=F.max("label"))
    marked = materialise(marked.where("lo <> hi").drop("lo", "hi").distinct(), "mixed")
    one, two = (marked.select("k", *(F.col(c).alias(f"{s}_{c}") for c in ("gid", "n", "pos", "label"))) for s in "ab")
    # of two that may link, one has few rarer shingles
    one = one.where((100 + percent) * F.col("a_pos") <= (100 - percent) * F.col("a_n"))
    across = one.join(two, "k").where((F.col("a_gid") != F.col("b_gid")) & (F.col("a_label") != F.col("b_label")) & _may_link("a_", "b_", percent))
    across = materialise(across.select(F.least("a_gid", "b_gid").alias("a_gid"), F.greatest("a_gid", "b_gid").alias("b_gid")).distinct(), "across")
    a, b = (units.select(*(F.col(c).alias(f"{s}_{c}") for c in ("gid", "cid", "label"))) for s in "ab")
    apart = F.col("a_label") != F.col("b_label")
    pairs = across.join(a, "a_gid").join(b, "b_gid").where(apart)
    # a group in several components: its members of one, with those of another
    several = split.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").select("gid")
    members = units.join(several, "gid")
    a, b = (members.select("gid", *(F.col(c).alias(f"{s}_{c}") for c in ("cid", "label"))) for s in "ab")
    within = a.join(b, "gid").where((F.col("a_cid") < F.col("b_cid")) & apart)
    ends = (F.least("a_cid", "b_cid").alias("u"), F.greatest("a_cid", "b_cid").alias("v"))
    out = materialise(pairs.select(*ends).unionByName(within.select(*ends)).distinct(), "rest")
    for df in (split, marked, across):
        delete(df)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id (equal sets) and component_id (smallest doc_id reachable by links) of every row."""
    if words < 1 or not 1 <= percent <= 100:
        raise ValueError("words must be positive and percent within 1 and 100")
    prepare(docs.sparkSession)
    counted = frequent(docs, words)
    sig = materialise(signatures(docs, words, percent, counted), "signatures")
    classes = materialise(sig.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min("gid").alias("gid")), "classes")
    groups = materialise(classes.groupBy("gid").agg(F.min("cid").alias("rep"), F.count("*").alias("members")), "groups")
    names, rep = classes.select("cid", "doc_id"), groups.select("gid", "rep")
    shared, hot = buckets(sig, counted)

    # star rounds, the first with each member and the first of its group
    star = stars(shared, percent)
    units = materialise(classes.select("cid", "gid", F.col("cid").alias("label")), "units")
    inner = join_unique(classes.select("cid", "gid"), groups.where("members > 1").select("gid", "rep"), ["gid"]).where("cid <> rep").select(F.col("rep").alias("u"), F.col("cid").alias("v"))
    tried = most = None
    for _ in range(STAR_ROUNDS):
        side = rep.join(units.select(F.col("cid").alias("rep"), "label"), "rep")
        pairs = star.join(side.select("gid", F.col("rep").alias("v"), "label"), "gid")
        pairs = join_unique(materialise(pairs, "half"), side.select(F.col("gid").alias("lead_gid"), F.col("rep").alias("u"), F.col("label").alias("lead_label")), ["lead_gid"]).where("label <> lead_label")
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = pairs.groupBy("v").agg(F.max(F.struct("buckets", "u")).alias("best")).select(F.col("best.u").alias("u"), "v")
        pairs = materialise((inner.unionByName(pairs) if tried is None else pairs).distinct(), "pairs")
        links = verified(pairs, docs, sig, names, words, percent)
        tried, n = pairs if tried is None else tried.unionByName(pairs), links.count()
        most = n if most is None else most
        if n:
            units = merged(units, links)
        delete(links)
        trim(docs.sparkSession)
        if n * STAR_SHARE <= most:
            break

    rest = rest_pairs(shared, hot, units, percent)
    done = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = materialise(rest.join(done, ["u", "v"], "left_anti"), "untried")
    links = verified(rest, docs, sig, names, words, percent)
    trim(docs.sparkSession)
    if not links.isEmpty():
        units = merged(units, links)

    named = materialise(units.select("cid", "label").join(names, "cid"), "named")
    smallest = materialise(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "smallest")
    homes = materialise(join_unique(named, smallest, ["label"]).select("cid", "component_id"), "homes")
    for done_with in (shared, star, units, rest, links, named, smallest, groups, classes, tried):
        delete(done_with)
    out = join_unique(sig.select("doc_id", "n", "cid"), homes, ["cid"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, all columns too: the first by doc_id, then class_id, then the hash of
    its columns. Rows go, not ids, so that rows that repeat a doc_id are judged by their own texts. Rows without a doc_id
    and rows without shingles stay."""
    name, gone_name = (next(c for i in range(len(docs.columns) + 1) if (c := f"{x}_{i}") not in docs.columns) for x in ("row", "gone"))
    # written once, so that the row numbers stay as they are; they stand for doc_ids, which may repeat
    stored = materialise(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(stored.select(F.col(name).alias("doc_id"), "text"), words, percent).where("class_id is not null")
    tie = F.xxhash64(*(f"`{c}`" for c, t in docs.dtypes if "map<" not in t and t != "variant"))
    ids = stored.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("id"), tie.alias("tie")).where("id is not null")
    judged = materialise(found.select(F.col("doc_id").alias("row"), "class_id", "component_id").join(ids, "row"), "judged")
    # one row a group; the group of a third of all rows is never gathered
    first = judged.groupBy("component_id").agg(F.min(F.struct("id", "class_id", "tie", "row")).alias("first")).select(F.col("first.row").alias("row"))
    gone = materialise(judged.select("row").join(first, "row", "left_anti").select(F.col("row").alias(gone_name)), "gone")
    delete(judged)
    side = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone
    return stored.join(side, F.col(name) == F.col(gone_name), "left_anti").drop(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


#: DuckDB SQL for op1: all pairs that share a shingle, then the closure of the links.
ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) end as grams from w),
u as (select doc_id, len(grams) as n, unnest(grams) as g from s),
p as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as k from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p where 100 * k >= 85 * (nx + ny - k)),
l as (select x as a, y as b from e union select y, x from e),
c as (select a, b from l union select c.a, l.b from c join l on c.b = l.a)
select s.doc_id, len(s.grams)::bigint as n_shingles, least(s.doc_id, coalesce(min(c.b), s.doc_id)) as component_id from s left join c on s.doc_id = c.a group by s.doc_id, s.grams"""
