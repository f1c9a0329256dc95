"""Pluggable tokenizers: an interface, three built in, rank-file bundles through tiktoken and tokenizer.json files through
the tokenizers library, where these are installed.

A tokenizer is described by a name that workers can resolve: utf8_bytes, whitespace, pretoken, tiktoken:<folder>,
json:<file or folder>, or the path of a folder that holds one of the two. Counts of the built-in ones are JVM
expressions; ids of all go through one Arrow UDF."""

from __future__ import annotations

import base64
import functools
import json
import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusloom.functions.pieces import pieces
from corpusloom.sources.manifest import filesystem

# Fixed value: the split pattern of the byte-pair vocabulary.
SPLIT_PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


#: Texts by which an exported bundle is checked: words, numbers, code, white space, several scripts.
SAMPLES = ("Hello there, it's 12345 o'clock.", "def f(x):\n\treturn x ** 2  # 2024-01-31\n\n", "Ünïcödé, 漢字 и кириллица 🙂👍🏽", "  spaces   and\r\nlines \n", "")


def _is_file(path: str) -> bool:
    store, place = filesystem(path)
    return store.get_file_info(place).type == fs.FileType.File


def _read(path: str) -> bytes:
    store, place = filesystem(path)
    with store.open_input_stream(place, compression=None) as f:
        return f.read()


class Tokenizer(Protocol):
    n_vocab: int
    special_token_ids: frozenset[int]

    def encode(self, text: str, add_bos: bool = False, add_eos: bool = False) -> list[int]: ...

    def decode(self, ids: list[int], skip_special: bool = False) -> str: ...

    def token_to_id(self, token: str) -> int | None: ...


class _Framed:
    """BOS and EOS around what _ids gives."""

    bos: int
    eos: int

    def encode(self, text: str, add_bos: bool = False, add_eos: bool = False) -> list[int]:
        return [self.bos] * add_bos + self._ids(text) + [self.eos] * add_eos


class Utf8Bytes(_Framed):
    """Ids 0 to 2 are pad, BOS and EOS; byte b is b + 3."""

    specials = {"<pad>": 0, "<bos>": 1, "<eos>": 2}
    bos, eos, n_vocab = 1, 2, 259
    special_token_ids = frozenset({0, 1, 2})

    def _ids(self, text: str) -> list[int]:
        return [b + 3 for b in text.encode("utf-8", "replace")]

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        names = {v: k for k, v in self.specials.items()}
        return b"".join(bytes([i - 3]) if i > 2 else b"" if skip_special else names[i].encode() for i in ids).decode("utf-8", "replace")

    def token_to_id(self, token: str) -> int | None:
        raw = token.encode()
        return self.specials.get(token, raw[0] + 3 if len(raw) == 1 else None)


class _Pieces(_Framed):
    """Pieces of a pattern; ids are hashes folded into 2**20, after the three special ids."""

    specials = {"<pad>": 0, "<bos>": 1, "<eos>": 2}
    bos, eos, n_vocab = 1, 2, 2**20 + 3
    special_token_ids = frozenset({0, 1, 2})
    pattern = r"\S+"

    def pieces(self, text: str) -> list[str]:
        import regex

        return regex.findall(self.pattern, text)

    def _ids(self, text: str) -> list[int]:
        return [self.token_to_id(p) for p in self.pieces(text)]

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        raise NotImplementedError("hashed pieces have no inverse")

    def token_to_id(self, token: str) -> int | None:
        import zlib

        return self.specials.get(token, zlib.crc32(token.encode("utf-8", "replace")) % 2**20 + 3)


class Whitespace(_Pieces):
    pass


class Pretoken(_Pieces):
    pattern = SPLIT_PATTERN


class _Named(_Framed):
    """BOS and EOS are special tokens of the vocabulary, given by name."""

    bos: int | None = None
    eos: int | None = None

    def _frame(self, bos: str | None, eos: str | None) -> None:
        for side, token in (("bos", bos), ("eos", eos)):
            if token is not None:
                if (found := self.token_to_id(token)) is None:
                    raise ValueError(f"{token!r} is no token of the vocabulary")
                setattr(self, side, found)

    def encode(self, text: str, add_bos: bool = False, add_eos: bool = False) -> list[int]:
        if (add_bos and self.bos is None) or (add_eos and self.eos is None):
            raise ValueError("the tokenizer was loaded without a BOS or EOS token")
        return super().encode(text, add_bos, add_eos)


class RankBundle(_Named):
    """A folder with <name>.tiktoken and tokenizer_meta.json (name, pat_str, special_tokens, n_vocab)."""

    def __init__(self, folder: str, bos: str | None = None, eos: str | None = None, specials: str = "parse"):
        import tiktoken

        meta = json.loads(_read(f"{folder}/tokenizer_meta.json"))
        ranks = parse_ranks(_read(f"{folder}/{meta['name']}.tiktoken"))
        self.enc = tiktoken.Encoding(meta["name"], pat_str=meta["pat_str"], mergeable_ranks=ranks, special_tokens=meta["special_tokens"])
        if meta.get("n_vocab") not in (None, self.enc.n_vocab):
            raise ValueError(f"n_vocab is {self.enc.n_vocab}, the bundle says {meta['n_vocab']}")
        self.n_vocab, self.policy = self.enc.n_vocab, specials
        self.special_token_ids = frozenset(meta["special_tokens"].values())
        self._frame(bos, eos)

    def _ids(self, text: str) -> list[int]:
        try:
            return self.enc.encode(text, allowed_special="all") if self.policy == "parse" else self.enc.encode_ordinary(text)
        except ValueError:  # its split overflows its stack on runs of about a million characters
            return self._ids_by_pieces(text)

    def _ids_by_pieces(self, text: str) -> list[int]:
        import regex

        names = sorted(self.enc.special_tokens_set, key=len, reverse=True) if self.policy == "parse" else []
        parts = regex.split(f"({'|'.join(map(regex.escape, names))})", text) if names else [text]
        out: list[int] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.enc.encode_single_token(part))
            else:
                out += [t for piece in regex.findall(self.enc._pat_str, part) for t in self.enc._encode_single_piece(piece)]
        return out

    def encode_ordinary(self, text: str) -> list[int]:
        """Special tokens in the text count as plain text."""
        return self.enc.encode_ordinary(text)

    def encode_batch(self, texts: list[str], threads: int = 8) -> list[list[int]]:
        return self.enc.encode_batch(texts, num_threads=threads, allowed_special="all") if self.policy == "parse" else self.enc.encode_ordinary_batch(texts, num_threads=threads)

    def decode_batch(self, batch: list[list[int]], threads: int = 8) -> list[str]:
        return self.enc.decode_batch(batch, num_threads=threads)

    def token_bytes(self, token_id: int) -> bytes:
        """The bytes of one token, whole characters or not."""
        return self.enc.decode_single_token_bytes(token_id)

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        return self.enc.decode([i for i in ids if not (skip_special and i in self.special_token_ids)])

    def token_to_id(self, token: str) -> int | None:
        try:
            return self.enc.encode_single_token(token)
        except KeyError:
            return None


class JsonTokenizer(_Named):
    """A tokenizer.json (a file, or the folder that holds it) through the tokenizers library, without truncation, padding
    or the tokens of its post-processor."""

    def __init__(self, path: str, bos: str | None = None, eos: str | None = None):
        import tokenizers

        file = f"{path}/tokenizer.json"
        self.inner = tokenizers.Tokenizer.from_buffer(_read(file if _is_file(file) else path))
        self.inner.no_truncation()
        self.inner.no_padding()
        self.n_vocab = 1 + max(self.inner.get_vocab(with_added_tokens=True).values())
        self.special_token_ids = frozenset(i for i, t in self.inner.get_added_tokens_decoder().items() if t.special)
        self._frame(bos, eos)

    def _ids(self, text: str) -> list[int]:
        return self.inner.encode(text, add_special_tokens=False).ids

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        return self.inner.decode(ids, skip_special_tokens=skip_special)

    def token_to_id(self, token: str) -> int | None:
        return self.inner.token_to_id(token)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64, a space and a rank; blank lines are skipped."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


def format_ranks(ranks: dict[bytes, int]) -> bytes:
    return b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in sorted(ranks.items(), key=lambda x: x[1]))


def export_bundle(folder: str, name: str, pattern: str, ranks: dict[bytes, int], specials: dict[str, int], check: Tokenizer | None = None, samples: tuple[str, ...] = SAMPLES) -> None:
    """Write a bundle. With a tokenizer to check against, the bundle is read back and must give its ids for the samples, and
    the samples for its ids; else the folder is of no use and an error is raised."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{name}.tiktoken"), "wb") as f:
        f.write(format_ranks(ranks))
    with open(os.path.join(folder, "tokenizer_meta.json"), "w", encoding="utf-8") as f:
        json.dump({"name": name, "pat_str": pattern, "special_tokens": specials, "n_vocab": max([*ranks.values(), *specials.values()]) + 1}, f, indent=2)
    if check is not None:
        made = RankBundle(folder)
        for text in (*samples, *specials):
            if made.encode(text) != check.encode(text) or made.decode(made.encode(text)) != text:
                raise ValueError(f"the bundle differs from its source for {text!r}")


def byte_alphabet() -> dict[int, str]:
    """Fixed values, by rule: the printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand
    for themselves, all other bytes, in order, for the characters from 256 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ranks_from_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a byte-level BPE tokenizer.json; other kinds of model are refused."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, added = data["model"], {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("byte_fallback", "end_of_word_suffix", "continuing_subword_prefix")):
        raise ValueError("only byte-level BPE without byte fallback can be converted")
    # a token's characters stand for bytes of the same number once the alphabet is undone
    undone = {ord(c): chr(b) for b, c in byte_alphabet().items()}
    return {t.translate(undone).encode("latin-1"): rank for t, rank in model["vocab"].items() if t not in added}, added


def describe(name: str) -> tuple[str, str]:
    """Kind and place of a tokenizer's name: a built-in one, or that of a folder by what it holds."""
    kind, _, place = name.partition(":")
    if kind in BUILT_IN and not place:
        return kind, ""
    if kind in ("tiktoken", "json") and place:
        return kind, place
    for kind, file in (("tiktoken", "tokenizer_meta.json"), ("json", "tokenizer.json")):
        if _is_file(f"{name}/{file}"):
            return kind, name
    raise ValueError(f"no tokenizer: {name!r} is none of {', '.join(BUILT_IN)}, tiktoken:<folder> or json:<file>, nor a folder with tokenizer_meta.json or tokenizer.json")


BUILT_IN = {"utf8_bytes": Utf8Bytes, "whitespace": Whitespace, "pretoken": Pretoken}


@functools.lru_cache(maxsize=8)
def load(name: str, bos: str | None = None, eos: str | None = None) -> Tokenizer:
    """The tokenizer of a name, with BOS and EOS by their names where it has none of its own; made once a worker."""
    kind, place = describe(name)
    if kind in BUILT_IN:
        return BUILT_IN[kind]()
    return RankBundle(place, bos, eos) if kind == "tiktoken" else JsonTokenizer(place, bos, eos)


def ids(name: str, text: Column, add_bos: bool = False, add_eos: bool = False) -> Column:
    """Ids of every text; null for a null. As Python numbers there are those of one text at a time."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(name)
        for texts in batches:
            for at, rows in pieces(texts):
                yield pa.array((None if t is None else np.array(tokenizer.encode(t, add_bos, add_eos), np.int32) for t in texts.slice(at, rows).to_pylist()), pa.list_(pa.int32()))

    return encode(text)


def round_trips(name: str, text: Column, bos: str, eos: str) -> Column:
    """Of every text framed by the named tokens: n_ids, first_id, last_id, and whether they decode to the text but for
    special tokens (round_trip); null for a null. Ids stay in the worker, those of one text at a time."""

    @F.arrow_udf("n_ids long, first_id long, last_id long, round_trip boolean")
    def tried(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(name, bos, eos)
        kind = pa.struct([("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("round_trip", pa.bool_())])

        def row(t: str) -> dict:
            found = tokenizer.encode(t, True, True)
            return {"n_ids": len(found), "first_id": found[0], "last_id": found[-1], "round_trip": tokenizer.decode(found, skip_special=True) == t}

        for texts in batches:
            for at, rows in pieces(texts):
                yield pa.array((None if t is None else row(t) for t in texts.slice(at, rows).to_pylist()), kind)

    return tried(text)


def count(name: str, text: Column) -> Column:
    """Number of ids without BOS and EOS; the built-in tokenizers are counted on the JVM."""
    if name == "utf8_bytes":
        return F.octet_length(text).cast("long")
    if name in ("whitespace", "pretoken"):
        pattern = r"\S+" if name == "whitespace" else f"(?U){SPLIT_PATTERN}"
        return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")

    @F.pandas_udf("long")
    def lengths(texts: pd.Series) -> pd.Series:
        tokenizer = load(name)
        return texts.map(lambda t: None if t is None else len(tokenizer.encode(t)))

    return lengths(text)


def resolve_stops(tokenizer: Tokenizer, stops: list[str], no_stop: bool = False) -> tuple[list[int], list[str]]:
    """Ids of stop tokens, and the names that are no single token and are ignored."""
    if no_stop:
        return [], []
    found = [(s, tokenizer.token_to_id(s)) for s in stops]
    return [i for _, i in found if i is not None], [s for s, i in found if i is None]


def max_token_id(vocabulary: list[int], *specials: int | None) -> int:
    known = [*vocabulary, *(s for s in specials if s is not None)]
    if not known:
        raise ValueError("no token ids")
    return max(known)


def token_dtype(max_id: int, dtype: str = "auto") -> str:
    """uint16 where ids fit, else uint32; a width that is too small is refused."""
    if dtype == "auto":
        return "uint16" if max_id <= 0xFFFF else "uint32"
    if dtype not in ("uint16", "uint32") or max_id > {"uint16": 0xFFFF, "uint32": 0xFFFFFFFF}[dtype]:
        raise ValueError(f"{dtype} cannot hold id {max_id}")
    return dtype
