"""Licence scan, in DataFrame operations only: TF-IDF cosine of headers and licence files to templates, then inheritance
by directory.

Words (lower case, letters and digits, and numbers with points) are weighted by tf * idf, idf from the templates; a
word that no template has weighs as much as the rarest. A header is any window of the text's words, of the length of
the template it is compared with (the whole text, where that is shorter), wherever it stands and however it is
wrapped; its cosine must be FROM or more. The windows that can reach that are found without comparing all:

* a template's anchors are words that hold so much of its weight that a window without any of them stays below FROM
  (by Cauchy and Schwarz), common words last. Texts without an anchor of any template are passed over;
* the words are cut into blocks of the longest template's length; a block that holds an anchor, with as many words on
  either side, is a region that holds all windows around it. It is compared with the templates of its anchors;
* a window whose words in common with the template hold less than FROM of its weight is passed over.

Templates of more than MAX_WINDOW words (whole licence texts) are no headers. A licence file, whose name fits
FILE_NAMES, is compared as a whole text with all templates, too. The best template of FROM or more is the
file's own licence; a file with such a name, or whose best header is half of its words or more, is a licence file.

A file without a licence of its own inherits that of the nearest ancestor directory that holds a licence file: each
distinct directory is joined by path with its ancestors that have one; of several licence files in a directory the one
of highest cosine, then first path, counts. Directories are made distinct before they are joined, and hot ones are
joined by broadcast. Regions are scored where the text is read; only scores are shuffled, and the words of licence files.

Edge cases: a null text has no header; a null path is in no directory and inherits nothing; ties between templates go
to the first name; repeated rows give repeated results; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import delete, join_unique, materialise, table

# Short forms of public licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work; public domain dedication CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
]
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
FROM = 0.8
MAX_TEMPLATES = 1000
#: Words of the longest template that headers are compared with.
MAX_WINDOW = 64
#: Words that most texts of some language hold.
COMMON = frozenset("a all an and any are as at be by for from has in is it may mit no not of on or that the this to under was which with you".split())
WORD = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"


def words_of(text: str) -> list[str]:
    """Words of a template, as the plan's expression gives them."""
    return re.findall(r"[^\W_]+(?:\.\d+)*", text.lower())


def weights(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """idf of the templates' words, that of any other word, and the templates' unit vectors."""
    bags = [words_of(t) for _, t in templates]
    df: dict[str, int] = {}
    for bag in bags:
        for w in set(bag):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(bags)) / (1 + k)) + 1 for w, k in df.items()}
    other, out = math.log((1 + len(bags)) / 2) + 1, []
    for (name, _), bag in zip(templates, bags):
        v = {w: bag.count(w) * idf[w] for w in set(bag)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append((name, {w: x / norm for w, x in v.items()}))
    return idf, other, out


def anchors(vector: dict[str, float], threshold: float) -> list[str]:
    """Words of a unit vector without which no text reaches the threshold. Any order of the words gives the same result;
    common ones last spares most texts."""
    rest, out = sum(x * x for x in vector.values()), []
    for w, x in sorted(vector.items(), key=lambda e: (e[0] in COMMON or len(e[0]) == 1, -e[1], e[0])):
        if rest < threshold * threshold - 1e-9:
            break
        out.append(w)
        rest -= x * x
    return out


def _constant(value, kind: str) -> Column:
    """A literal map, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def asked(templates: list[tuple[str, str]], threshold: float) -> dict[str, list[int]]:
    """Anchor words, and the numbers of the templates whose headers they may belong to."""
    out: dict[str, list[int]] = {}
    for t, ((_, text), (_, vector)) in enumerate(zip(templates, weights(templates)[2])):
        if 0 < len(words_of(text)) <= MAX_WINDOW:
            for w in anchors(vector, threshold):
                out.setdefault(w, []).append(t)
    return out


def anchored(low: Column, by_word: dict[str, list[int]]) -> Column:
    """Whether a text in lower case holds an anchor."""
    some = "|".join(re.escape(w) for w in sorted(by_word))
    return low.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{some})(?![\p{{L}}\p{{N}}])") if some else F.lit(False)


def headers(rows: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """row, licence, similarity and words (of the window) of the windows of each row's words that reach the threshold.
    rows: row, low (text in lower case)."""
    idf, other, vectors = weights(templates)
    length = {t: len(words_of(text)) for t, (_, text) in enumerate(templates)}
    by_word = asked(templates, threshold)
    short = sorted({t for ts in by_word.values() for t in ts})
    if not short:
        return rows.sparkSession.createDataFrame([], "row long, licence string, similarity double, words int")
    reach = max(length[t] for t in short)
    found = rows.where(anchored(F.col("low"), by_word))
    found = found.select("row", F.explode(F.array(F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))).alias("all"))
    names = _constant(sorted(by_word), "array<string>")
    at = F.filter(F.transform("all", lambda w, i: F.when(F.array_contains(names, w), F.floor(i / reach).cast("int"))), lambda i: i.isNotNull())
    found = found.select("row", "all", F.explode(F.array_distinct(at)).alias("block"))
    first = F.greatest((F.col("block") - 1) * reach, F.lit(0))
    region = F.slice("all", first + 1, (F.col("block") + 2) * reach - first)
    found = found.select("row", F.explode(F.array(region)).alias("words"))
    wanted = _constant(by_word, "map<string,array<int>>")
    ts = F.array_distinct(F.flatten(F.transform(F.array_intersect("words", names), lambda w: F.try_element_at(wanted, w))))
    found = found.select("row", "words", F.explode(ts).alias("t"))
    spark = rows.sparkSession
    sides = spark.createDataFrame([(t, templates[t][0], length[t], vectors[t][1]) for t in short], "t int, licence string, size int, xs map<string,double>")
    found = found.join(F.broadcast(sides), "t")  # MAX_TEMPLATES rows at most
    found = found.withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - F.col("size") + 1, F.lit(1)))))
    window = F.slice("words", F.col("start"), F.col("size"))
    x = lambda w: F.coalesce(F.try_element_at(F.col("xs"), w), F.lit(0.0))
    bound = F.aggregate(window, F.lit(0.0), lambda a, w: a + x(w) * x(w))
    found = found.where(bound >= threshold * threshold - 1e-9).select("row", "licence", "xs", F.explode(F.array(window)).alias("window"))
    idfs = _constant(idf, "map<string,double>")
    weighed = F.transform(F.array_distinct("window"), lambda w: F.struct(w.alias("w"), (F.size(F.filter("window", lambda v: v == w)) * F.coalesce(F.try_element_at(idfs, w), F.lit(other))).alias("weight")))
    found = found.select("row", "licence", "xs", F.size("window").alias("words"), F.explode(F.array(weighed)).alias("weighed"))
    dot = F.aggregate("weighed", F.lit(0.0), lambda a, s: a + s["weight"] * x(s["w"]))
    norm = F.sqrt(F.aggregate("weighed", F.lit(0.0), lambda a, s: a + s["weight"] * s["weight"]))
    return found.select("row", "licence", F.round(dot / norm, 9).alias("similarity"), "words").where(F.col("similarity") >= threshold)


def files(rows: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """row, licence, similarity and words of the templates whose cosine to the row's whole text reaches the threshold.
    rows: row, low."""
    spark = rows.sparkSession
    idf, other, vectors = weights(templates)
    idfs = spark.createDataFrame(sorted(idf.items()), "w string, idf double")
    sparse = spark.createDataFrame([(name, t, w, x) for t, (name, v) in enumerate(vectors) for w, x in sorted(v.items())], "licence string, t int, w string, x double")
    terms = rows.select("row", F.explode(F.regexp_extract_all("low", F.lit(WORD), F.lit(0))).alias("w")).groupBy("row", "w").agg(F.count("*").alias("tf"))
    # both sides are of bounded size, as the templates are
    terms = terms.join(F.broadcast(idfs), "w", "left").select("row", "w", "tf", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("weight"))
    norms = terms.groupBy("row").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.sum("tf").cast("int").alias("words"))
    dots = terms.join(F.broadcast(sparse), "w").groupBy("row", "t", "licence").agg(F.sum(F.col("weight") * F.col("x")).alias("dot"))
    return dots.join(norms, "row").select("row", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("similarity"), "words").where(F.col("similarity") >= threshold)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = FROM) -> DataFrame:
    """doc_id, path, own_licence, similarity, licence, origin (header, file or inherited) and from_dir of every row."""
    if not 0 < len(templates) <= MAX_TEMPLATES or not 0 < threshold <= 1:
        raise ValueError(f"1 to {MAX_TEMPLATES} templates, and a threshold within 0 and 1")
    named = F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False))
    low = F.lower(F.coalesce("text", F.lit("")))
    # written once, so that the row numbers stay as they are; texts without an anchor are not needed again
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.when(named | anchored(low, asked(templates, threshold)), low).alias("low"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    found = materialise(headers(rows, templates, threshold).unionByName(files(rows.where(named), templates, threshold)), "found")
    best = found.groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("licence").alias("l"), (-F.col("words")).alias("n"))).alias("best"))
    best = best.select("row", F.col("best.l").alias("own_licence"), (-F.col("best.s")).alias("similarity"), (-F.col("best.n")).alias("n"))
    sizes = rows.where("low is not null").select("row", F.size(F.regexp_extract_all("low", F.lit(WORD), F.lit(0))).alias("size"))
    sized = sizes.join(best, "row").select("row", "own_licence", "similarity", (2 * F.col("n") >= F.col("size")).alias("mostly"))
    own = rows.select("doc_id", "path", "row", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), named.alias("named")).join(sized, "row", "left")
    own = materialise(own.withColumn("is_file", F.col("own_licence").isNotNull() & (F.col("named") | F.col("mostly"))).drop("named", "mostly"), "own")
    delete(rows)
    delete(found)
    holders = own.where("is_file and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "own_licence")).alias("best")).select(F.col("dir").alias("up"), F.col("best.own_licence").alias("given"))
    parts = F.split("dir", "/", -1)
    dirs = own.where("own_licence is null and path is not null").select("dir").distinct()
    ups = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")).select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("up"))
    near = join_unique(ups, holders, ["up"]).groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("near")).select("dir", F.col("near.up").alias("from_dir"), F.col("near.given").alias("given"))
    out = join_unique(own, materialise(near, "near"), ["dir"], "left")
    free = F.col("own_licence").isNull() & F.col("path").isNotNull()
    origin = F.when(F.col("is_file"), "file").when(F.col("own_licence").isNotNull(), "header").when(free & F.col("given").isNotNull(), "inherited")
    return out.select("doc_id", "path", "own_licence", F.round("similarity", 6).alias("similarity"), F.coalesce("own_licence", F.when(free, F.col("given"))).alias("licence"), origin.alias("origin"), F.when(free, F.col("from_dir")).alias("from_dir"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("long").cast("string"), F.floor(F.col("doc_id") / 50).cast("long").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", "text", path.alias("path")))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = FROM) -> str:
    """DuckDB SQL for op4: every window of every text whose words in common with a template hold enough of its weight. The
    query's paths have no licence file's name, so that no text is compared as a whole."""
    idf, other, vectors = weights(templates)
    idfs = ", ".join(f"('{w}', {x!r}::double)" for w, x in sorted(idf.items()))
    sparse = ", ".join(f"({t}, '{n}', {len(words_of(templates[t][1]))}, '{w}', {x!r}::double)" for t, (n, v) in enumerate(vectors) for w, x in sorted(v.items()))
    return rf"""
with s(t, licence, size, w, x) as (values {sparse}), v(w, idf) as (values {idfs}),
d as (select doc_id, coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 50) as dir, doc_id || '.txt' as name, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') as words from documents),
p as (select doc_id, unnest(words) as w, generate_subscripts(words, 1) as pos, len(words) as total from d),
h as (select doc_id, t, licence, size, total, pos, x * x as xx from p join s on p.w = s.w),
k as (select doc_id, t, licence, size, total, unnest(range(greatest(1, pos - size + 1), least(pos, greatest(1, total - size + 1)) + 1)) as start, xx from h),
c as (select doc_id, t, licence, size, start from k group by all having sum(xx) >= {threshold * threshold - 1e-9}),
n as (select c.*, words[start:start + size - 1] as win from c join d on c.doc_id = d.doc_id),
f as (select doc_id, t, licence, start, len(win) as words, w, count(*) as tf from (select *, unnest(win) as w from n) group by all),
z as (select doc_id, f.licence, f.words, round(sum(tf * coalesce(idf, {other!r}::double) * coalesce(x, 0)) / sqrt(sum(pow(tf * coalesce(idf, {other!r}::double), 2))), 9) as similarity
  from f left join v on f.w = v.w left join s on f.t = s.t and f.w = s.w group by doc_id, f.t, f.licence, start, f.words),
o as (select * from z where similarity >= {threshold} qualify row_number() over (partition by doc_id order by similarity desc, licence, words desc) = 1),
r as (select d.doc_id, dir, dir || '/' || name as path, licence as own_licence, similarity, licence is not null and 2 * o.words >= len(d.words) as is_file from d left join o on d.doc_id = o.doc_id),
g as (select dir as up, own_licence as given from r where is_file qualify row_number() over (partition by dir order by similarity desc, path) = 1),
x as (select r.doc_id, g.up, g.given from r join g on r.own_licence is null and (g.up = r.dir or starts_with(r.dir, g.up || '/') or g.up = '') qualify row_number() over (partition by r.doc_id order by length(g.up) desc) = 1)
select r.doc_id, path, own_licence, round(similarity, 6) as similarity, coalesce(own_licence, given) as licence,
  case when is_file then 'file' when own_licence is not null then 'header' when given is not null then 'inherited' end as origin, up as from_dir
from r left join x on r.doc_id = x.doc_id"""


ORACLE = oracle()
