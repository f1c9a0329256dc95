"""The flagship: from documents and a mixture to packed token shards with a manifest.

Order of dependence: ladder, token count, budget cut, hash split, validation cap, offsets, shards. Decisions are made on
rows without texts and written once; texts are joined with them only for encoding. Every step is a plan over all its
subsets at once.

A run keeps a ledger (progress.json, replaced atomically): which subsets are counted, whether decisions are made, which
shards are written. Subsets are counted subsets_per_step at a time and shards written shards_per_step at a time; a
resumed run does the steps that are left, keeps shards whose files are whole, and deletes all other files. As decisions are
written once and a shard's bytes follow from them, it ends with the bytes of a run that was not cut off. The manifest is
written last."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tokenizers
from corpusloom.operators import budget, ladder, packing
from corpusloom.operators.prefix import span_of
from corpusloom.sources import manifest, token_shards


@dataclass(frozen=True)
class Recipe:
    output_root: str
    tokenizer: str = "utf8_bytes"
    context_length: int = 2048
    train_shard_tokens: int = 100_000_000
    val_shard_tokens: int = 20_000_000
    val_fraction: float = 0.002
    max_val_tokens_per_subset: int = budget.MAX_VAL_TOKENS
    seed: int = 42
    min_doc_tokens: int = ladder.MIN_TOKENS
    max_doc_tokens: int = ladder.MAX_TOKENS
    dtype: str = "auto"
    profile: str = "native"
    limit_docs_per_subset: int | None = None
    skip_missing_subsets: bool = False
    dry_run: bool = False
    overwrite: bool = False
    resume: bool = False
    #: Names of special tokens, for tokenizers that have no BOS and EOS of their own.
    bos: str | None = None
    eos: str | None = None
    #: Subsets counted, and shards written, between two entries of the ledger; 0 is all at once.
    subsets_per_step: int = 0
    shards_per_step: int = 4096

    def __post_init__(self):
        for name in ("context_length", "train_shard_tokens", "val_shard_tokens", "max_doc_tokens", "shards_per_step"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.seed < 2**63:
            raise ValueError("seed must be within 0 and 2**63 - 1")
        if self.dtype not in ("auto", "uint16", "uint32"):
            raise ValueError("dtype is auto, uint16 or uint32")
        if not 0 <= self.val_fraction <= 1:
            raise ValueError("val_fraction must be within 0 and 1")
        if self.subsets_per_step < 0 or self.min_doc_tokens < 0 or self.max_val_tokens_per_subset < 0 or (self.limit_docs_per_subset or 0) < 0:
            raise ValueError("limits must not be negative")
        if self.resume and self.overwrite:
            raise ValueError("resume and overwrite exclude each other")
        if self.profile not in ("native", "conformance"):
            raise ValueError("profile is native or conformance")


def counted(docs: DataFrame, mixture: DataFrame, recipe: Recipe) -> DataFrame:
    """docs: subset, shard, shard_ord, line_idx, parse_status, text; mixture: subset_ord, subset, target_tokens. One row a
    line: its counts, status and whether it is a candidate for validation, without its text."""
    rows = docs.join(F.broadcast(mixture), "subset")  # the mixture is a file of subsets, read on the driver
    rows = ladder.ladder(rows, recipe.tokenizer, recipe.min_doc_tokens, recipe.max_doc_tokens)
    key = ["subset", "shard", "line_idx"] if recipe.profile == "native" else ["subset", "shard", "line_idx", "head"]
    rows = budget.hash_split(rows.withColumn("head", F.substring("text", 1, 128)), recipe.val_fraction, recipe.seed, key, recipe.profile)
    return rows.select("subset_ord", "subset", "shard", "target_tokens", "shard_ord", "line_idx", "status", "n_tokens", "n_framed", "is_long", "candidate")


def decisions(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """Of counted rows those that are seen, with their split."""
    span = span_of(rows, "line_idx")
    seen = budget.budget_cut(rows, major=["shard_ord"], span=span)
    if recipe.limit_docs_per_subset is not None:
        seen = budget.doc_limit(seen, recipe.limit_docs_per_subset, major=["shard_ord"], span=span)
    return budget.greedy_cap(seen, recipe.max_val_tokens_per_subset, major=["shard_ord"])


def pieces(docs: DataFrame, placed: DataFrame, recipe: Recipe, wanted: DataFrame | None = None) -> DataFrame:
    """Token pieces of every shard, or of the wanted ones (split, shard): split, shard, shard_off, tokens. placed: seen rows
    with their offsets."""
    train = packing.shard_pieces(placed.where("split = 'train'"), recipe.train_shard_tokens)
    parts = train.unionByName(packing.shard_pieces(placed.where("split = 'val'"), recipe.val_shard_tokens))
    if wanted is not None:
        parts = parts.join(F.broadcast(wanted), ["split", "shard"], "left_semi")  # shards_per_step rows
    parts = parts.groupBy("subset", "shard_ord", "line_idx").agg(F.collect_list(F.struct("split", "shard", "shard_off", "skip", "take")).alias("parts"))
    tokenizer = tokenizers.load(recipe.tokenizer, recipe.bos, recipe.eos)
    kept = docs.select("subset", "shard_ord", "line_idx", "text").join(parts, ["subset", "shard_ord", "line_idx"])
    ids = kept.withColumn("ids", tokenizers.ids(recipe.tokenizer, F.col("text"))).drop("text")
    stream = F.flatten(packing.frame(F.col("ids"), tokenizer.bos, tokenizer.eos, recipe.max_doc_tokens))
    rows = ids.select(stream.alias("stream"), F.explode("parts").alias("p"))
    return rows.select("p.split", F.col("p.shard").cast("int").alias("shard"), "p.shard_off", F.expr("slice(stream, int(p.skip) + 1, int(p.take))").alias("tokens"))


Documents = DataFrame | Callable[[list[str]], DataFrame]


def _opened(recipe: Recipe, settings: dict) -> dict | None:
    """Check the mode against what is in the output folder and clear or keep that; the manifest of a finished run to
    resume, else None."""
    root = recipe.output_root
    if recipe.resume:
        if not manifest.exists(f"{root}/{manifest.SETTINGS}"):
            raise FileNotFoundError("there is no run to resume")
        before = manifest.read_json(f"{root}/{manifest.SETTINGS}")
        differ = [k for k in settings if before.get(k) != settings[k]]
        if differ:
            raise ValueError(f"the run to resume has other settings: {', '.join(differ)}")
        return manifest.read_manifest(root) if manifest.exists(f"{root}/{manifest.MANIFEST}") else None
    if manifest.exists(root) and not recipe.dry_run:
        if not recipe.overwrite:
            raise FileExistsError(root)
        store, place = manifest.filesystem(root)
        store.delete_dir_contents(place)
    return None


LEDGER_VERSION = 1


class Ledger:
    """What is done: counted (folder of counts by the place of its first subset), decided, shards. A ledger that does not fit
    the run is an error."""

    def __init__(self, recipe: Recipe, subsets: list[str]):
        self.path = f"{recipe.output_root}/{'dry_run_' if recipe.dry_run else ''}progress.json"
        kept = manifest.read_json(self.path) if recipe.resume and manifest.exists(self.path) else {}
        if kept.get("version", LEDGER_VERSION) != LEDGER_VERSION:
            raise ValueError(f"the ledger has version {kept['version']}, not {LEDGER_VERSION}")
        self.done = {"version": LEDGER_VERSION, "counted": {}, "decided": False, "shards": 0, "of_shards": None} | kept
        counted_names = [s for names in self.done["counted"].values() for s in names]
        if len(set(counted_names)) != len(counted_names) or not set(counted_names) <= set(subsets) or self.done["shards"] > (self.done["of_shards"] or 0):
            raise ValueError("the ledger contradicts itself or the mixture")

    def commit(self, **facts) -> None:
        self.done |= facts
        manifest.write_json(self.path, self.done | {"updated_at_unix": time.time()})


def _count(spark: SparkSession, docs: Documents, mixture_rows: list[tuple[str, int]], recipe: Recipe, ledger: Ledger, work: str) -> DataFrame:
    """The counted rows of all subsets, of which those in the ledger are there already."""
    places: dict[str, int] = {s: i for i, (s, _) in enumerate(mixture_rows)}
    counted_before = {s: folder for folder, names in ledger.done["counted"].items() for s in names if manifest.exists(f"{work}/counted/{folder}/_SUCCESS")}
    folders = set(counted_before.values())
    left = [s for s in places if s not in counted_before]
    step = recipe.subsets_per_step or max(1, len(left))
    for names in (left[i : i + step] for i in range(0, len(left), step)):
        # without a function, all documents are read for each step
        rows = docs(names) if callable(docs) else docs.where(F.col("subset").isin(names))
        folder = f"{places[names[0]]:05d}"
        mixture = manifest.mixture_frame(spark, mixture_rows).where(F.col("subset").isin(names))
        counted(rows, mixture, recipe).write.mode("overwrite").parquet(f"{work}/counted/{folder}")
        folders.add(folder)
        ledger.commit(counted=ledger.done["counted"] | {folder: names}, decided=False)
    return spark.read.parquet(*(f"{work}/counted/{f}" for f in sorted(folders)))


def build(spark: SparkSession, docs: Documents, mixture_rows: list[tuple[str, int]], recipe: Recipe, listing: DataFrame | None = None) -> dict:
    """Run the recipe; returns the manifest. docs: subset, shard, shard_ord, line_idx, parse_status, text, or a function that
    gives these rows of some subsets, so that a resumed run reads only those (jsonl.reader). listing: (subset, shard) of
    all files; without it, shards are those that lines were read from."""
    recipe = replace(recipe, output_root=manifest.qualify(spark, recipe.output_root))
    root = recipe.output_root
    tokenizer = tokenizers.load(recipe.tokenizer, recipe.bos, recipe.eos)
    if tokenizer.bos is None or tokenizer.eos is None:
        raise ValueError("the tokenizer has no BOS or EOS: name them in the recipe")
    dtype = tokenizers.token_dtype(tokenizer.n_vocab - 1, recipe.dtype)
    free = ("overwrite", "resume", "output_root", "subsets_per_step", "shards_per_step")
    settings = {k: v for k, v in asdict(recipe).items() if k not in free} | {"mixture": {k: v for k, v in mixture_rows}}
    if (finished := _opened(recipe, settings)) is not None:
        return finished
    names = [s for s, _ in mixture_rows]

    def listed(rows: DataFrame) -> dict[str, int]:
        found = {r.subset: r.n for r in rows.where(F.col("subset").isin(names)).groupBy("subset").agg(F.count_distinct("shard").alias("n")).collect()}
        missing = [s for s in names if s not in found]
        if missing and not recipe.skip_missing_subsets:
            raise FileNotFoundError(f"missing subsets: {', '.join(missing)}")
        return found

    shards_of = listed(listing) if listing is not None else None
    manifest.write_json(f"{root}/{manifest.DRY_SETTINGS if recipe.dry_run else manifest.SETTINGS}", settings)
    # texts are read and tokenised once for the counts; prefix sums and joins go over rows without texts. Decisions are
    # written once as well: partitions and retries cannot change them
    work, ledger = f"{root}/_work", Ledger(recipe, names)
    rows = _count(spark, docs, mixture_rows, recipe, ledger, work)
    shards_of = listed(rows) if shards_of is None else shards_of
    if not (ledger.done["decided"] and manifest.exists(f"{work}/placed/_SUCCESS")):
        decisions(rows, recipe).write.mode("overwrite").parquet(f"{work}/decisions")
        seen = spark.read.parquet(f"{work}/decisions")
        packing.offsets(seen.where("n_framed > 0"), major=["subset_ord", "shard_ord"]).write.mode("overwrite").parquet(f"{work}/placed")
        ledger.commit(decided=True)
    seen, placed = spark.read.parquet(f"{work}/decisions"), spark.read.parquet(f"{work}/placed")
    by = {"train": recipe.train_shard_tokens, "val": recipe.val_shard_tokens}
    totals = sorted(placed.groupBy("split").agg(F.sum("n_framed").alias("tokens")).collect())
    shards = [{"split": r.split, "shard": i, "tokens": min(by[r.split], r.tokens - i * by[r.split]), "dtype": dtype} for r in totals for i in range(-(-r.tokens // by[r.split]))]
    counters = {r.subset: r.asDict() for r in budget.subset_counters(seen).collect()}
    none = dict.fromkeys(("docs_seen", "docs_written", "docs_skipped_empty", "docs_skipped_short", "docs_malformed_json", "docs_split_long", "train_tokens", "val_tokens", "actual_tokens"), 0)
    subsets = {s: none | {k: v for k, v in counters.get(s, {}).items() if k != "subset"} | {"target_tokens": t, "shards_seen": shards_of.get(s, 0), "completed": True} for s, t in mixture_rows}
    if not recipe.dry_run:
        there = token_shards.complete(root, shards)
        left = [(s["split"], s["shard"]) for s in shards if (s["split"], s["shard"]) not in there]
        ledger.commit(shards=len(there), of_shards=len(shards))
        texts = docs(names) if callable(docs) else docs
        for i in range(0, len(left), recipe.shards_per_step):
            some = left[i : i + recipe.shards_per_step]
            wanted = spark.createDataFrame(some, "split string, shard long")
            token_shards.write(pieces(texts, placed, recipe, wanted), root, dtype)
            ledger.commit(shards=ledger.done["shards"] + len(some))
    facts = {"tokenizer_path": recipe.tokenizer, "tokenizer_class": type(tokenizer).__name__, "vocab_size": tokenizer.n_vocab, "max_token_id": tokenizer.n_vocab - 1, "dtype": dtype, "bos_token": recipe.bos, "bos_token_id": tokenizer.bos, "eos_token": recipe.eos, "eos_token_id": tokenizer.eos, "context_length": recipe.context_length, "target_total_tokens": sum(t for _, t in mixture_rows)}
    out = manifest.build_manifest(facts, shards, subsets, recipe.dry_run)
    manifest.write_json(f"{root}/{'dry_run_' if recipe.dry_run else ''}{manifest.MANIFEST}", out)
    store, place = manifest.filesystem(work)
    store.delete_dir(place)
    return out
