"""Registered queries of the core engine with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import hashing, text, tokenizers, training
from corpusloom.operators import budget, chat, configs, estimate, ladder, logits, metrics, packing, prefix, sampling

SEED, FRACTION, TARGET, CAP = 7, 0.25, 20_000, 3_000
SHARD, CONTEXT, LONGEST = 5_000, 256, 1_000
STRIP = r"'^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir, min_tokens=ladder.MIN_TOKENS):
    return ladder.ladder(ladder.from_table(table(spark, sf_dir, "documents")), min_tokens=min_tokens, max_tokens=LONGEST)


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


# Shared parts of the oracles.
D = f"""d as (select source as subset, doc_id as line_idx, regexp_replace(text, {STRIP}) as t, text is null as bad from documents),
l as (select *, case when bad then 'malformed' when length(t) = 0 then 'empty' when strlen(t) < {ladder.MIN_TOKENS} then 'short' else 'written' end as status, case when bad or length(t) = 0 then 0 else strlen(t) end as n_tokens from d),
f as (select *, case when status = 'written' then n_tokens + 2 else 0 end as n_framed, status = 'written' and n_tokens > {LONGEST} as is_long from l),
p as (select *, coalesce(sum(n_framed) over (partition by subset order by line_idx rows between unbounded preceding and 1 preceding), 0) as prior from f),
s as (select *, ('0x' || substr(md5('{SEED}|' || subset || '|' || line_idx), 1, 15))::bigint % 1000000 < {int(FRACTION * 1_000_000)} as candidate from p where prior < {TARGET})"""
GREEDY = f"""c as (select subset, line_idx, n_framed, row_number() over (partition by subset order by line_idx) as i from s where candidate and n_framed > 0),
g as (select subset, line_idx, i, n_framed <= {CAP} as fits, case when n_framed <= {CAP} then n_framed else 0 end as used from c where i = 1
  union all select c.subset, c.line_idx, c.i, g.used + c.n_framed <= {CAP}, case when g.used + c.n_framed <= {CAP} then g.used + c.n_framed else g.used end from g join c on c.subset = g.subset and c.i = g.i + 1),
e as (select s.*, case when coalesce(g.fits, false) then 'val' else 'train' end as split from s left join g on s.subset = g.subset and s.line_idx = g.line_idx)"""


def _span(spark, sf_dir):
    return prefix.span_of(table(spark, sf_dir, "documents"), "doc_id")


def _seen(spark, sf_dir):
    return budget.budget_cut(_docs(spark, sf_dir).withColumn("target_tokens", F.lit(TARGET)), span=_span(spark, sf_dir))


def _split(spark, sf_dir):
    candidates = budget.hash_split(_seen(spark, sf_dir), FRACTION, SEED, ["subset", "line_idx"])
    return budget.greedy_cap(candidates, CAP)


@query(f"""with recursive {D}, {GREEDY} select subset, split, count(*) as docs, sum(n_framed)::bigint as tokens from e where status = 'written' group by all""")
def budget_split_summary(spark, sf_dir):
    """Documents and tokens per subset and split under a token budget and a validation cap."""
    return _split(spark, sf_dir).where("status = 'written'").groupBy("subset", "split").agg(F.count("*").alias("docs"), F.sum("n_framed").alias("tokens"))


@query(f"""with {D} select subset, status, count(*) as docs, sum(n_tokens)::bigint as tokens, count(*) filter (is_long) as long_docs from f group by all""")
def doc_ladder_status(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("subset", "status").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.count_if("is_long").alias("long_docs"))


@query(f"""with {D} select subset, line_idx, n_framed::bigint as n_framed, prior::bigint as prior from p where prior < {TARGET}""")
def budget_cut_by_source(spark, sf_dir):
    return _seen(spark, sf_dir).select("subset", "line_idx", "n_framed", "prior")


@query(f"""with {D}, n as (select *, row_number() over (partition by subset order by line_idx) as rn from p) select subset, count(*) as docs, max(line_idx) as last_line from n where rn <= 11 group by subset""")
def doc_limit_by_source(spark, sf_dir):
    return budget.doc_limit(_docs(spark, sf_dir), 11, span=_span(spark, sf_dir)).groupBy("subset").agg(F.count("*").alias("docs"), F.max("line_idx").alias("last_line"))


@query(f"""select source as subset, ('0x' || substr(md5('{SEED}|' || source || '|' || doc_id), 1, 15))::bigint % 1000000 < {int(0.002 * 1_000_000)} as candidate, count(*) as docs from documents group by all""")
def hash_split_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("subset"), "doc_id")
    return budget.hash_split(rows, 0.002, SEED, ["subset", "doc_id"]).groupBy("subset", "candidate").agg(F.count("*").alias("docs"))


@query(f"""with recursive {D}, {GREEDY} select subset, line_idx, n_framed::bigint as n_framed from e where split = 'val'""")
def val_greedy_cap(spark, sf_dir):
    return _split(spark, sf_dir).where("split = 'val'").select("subset", "line_idx", "n_framed")


@query(f"""with recursive {D}, {GREEDY} select subset, count(*) as docs_seen, count(*) filter (status = 'written') as docs_written, count(*) filter (status = 'empty') as docs_skipped_empty, count(*) filter (status = 'short') as docs_skipped_short,
count(*) filter (status = 'malformed') as docs_malformed_json, count(*) filter (is_long) as docs_split_long, coalesce(sum(n_framed) filter (split = 'train'), 0)::bigint as train_tokens, coalesce(sum(n_framed) filter (split = 'val'), 0)::bigint as val_tokens, sum(n_framed)::bigint as actual_tokens from e group by subset""")
def subset_counters(spark, sf_dir):
    return budget.subset_counters(_split(spark, sf_dir))


@query(f"""with recursive {D}, {GREEDY} select split, sum(n_framed)::bigint as tokens, count(*) as docs from e group by rollup(split)""")
def split_totals(spark, sf_dir):
    return _split(spark, sf_dir).rollup("split").agg(F.sum("n_framed").alias("tokens"), F.count("*").alias("docs"))


@query(f"""with {D}, x as (select line_idx, n_tokens, unnest(range(0, greatest(1, ceil(n_tokens / {LONGEST}))::bigint)) as seg_idx from f where status = 'written')
select line_idx, seg_idx::int as seg_idx, (least(n_tokens - seg_idx * {LONGEST}, {LONGEST}) + (seg_idx = 0)::int + (seg_idx = greatest(1, ceil(n_tokens / {LONGEST}))::bigint - 1)::int)::bigint as seg_tokens, seg_idx = 0 as has_bos, seg_idx = greatest(1, ceil(n_tokens / {LONGEST}))::bigint - 1 as has_eos from x""")
def document_segments(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("status = 'written'").select("line_idx", "n_tokens")
    return packing.segment_lengths(docs, longest=LONGEST).select("line_idx", "seg_idx", "seg_tokens", "has_bos", "has_eos")


OFF = f"""{D}, {GREEDY}, o as (select *, coalesce(sum(n_framed) over (partition by split order by subset_ord, line_idx rows between unbounded preceding and 1 preceding), 0) as off from (select *, replace(subset, 'src', '')::int as subset_ord from e) where n_framed > 0),
x as (select *, unnest(range((off // {SHARD})::bigint, ((off + n_framed - 1) // {SHARD})::bigint + 1)) as shard from o),
t as (select *, greatest(off, shard * {SHARD}) as start, least(off + n_framed, (shard + 1) * {SHARD}) as stop from x),
h as (select split, shard, sum(stop - start)::bigint as tokens, count(*) as pieces from t group by all)"""


def _pieces(spark, sf_dir):
    rows = _split(spark, sf_dir).where("n_framed > 0").withColumn("subset_ord", F.regexp_replace("subset", "src", "").cast("int"))
    return packing.shard_pieces(packing.offsets(rows, major=["subset_ord"], span=_span(spark, sf_dir)), SHARD)


@query(f"""with recursive {OFF} select split, line_idx, shard, (start - shard * {SHARD})::bigint as shard_off, (start - off)::bigint as skip, (stop - start)::bigint as take from t""")
def shard_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir).select("split", "line_idx", "shard", "shard_off", "skip", "take")


@query(f"""with recursive {OFF} select split, shard, tokens, pieces, split || '/tokens_' || lpad(shard::varchar, 6, '0') || '.bin' as filename from h""")
def shard_packing(spark, sf_dir):
    return packing.shard_table(_pieces(spark, sf_dir)).withColumn("filename", text.shard_name(F.col("split"), F.col("shard")))


BLOCKS = f"""b as (select *, greatest(0, (tokens - 1) // {CONTEXT}) as blocks from h), i as (select *, coalesce(sum(blocks) over (partition by split order by shard rows between unbounded preceding and 1 preceding), 0)::bigint as first_block from b where blocks > 0)"""


@query(f"""with recursive {OFF}, {BLOCKS} select split, shard, tokens, blocks::bigint as blocks, first_block from i""")
def block_index(spark, sf_dir):
    return packing.block_index(packing.shard_table(_pieces(spark, sf_dir)), CONTEXT).select("split", "shard", "tokens", "blocks", "first_block")


@query(f"""with recursive {OFF}, {BLOCKS}, q as (select unnest([0, 1, 19, 20, 57, -1, -20]) as idx), n as (select sum(blocks) as total from i where split = 'train'),
a as (select idx::bigint as idx, (case when idx < 0 then idx + total else idx end)::bigint as global_idx from q, n)
select idx, global_idx, shard, global_idx - first_block as block from a join i on split = 'train' and global_idx >= first_block and global_idx < first_block + blocks""")
def block_lookup(spark, sf_dir):
    index = packing.block_index(packing.shard_table(_pieces(spark, sf_dir)), CONTEXT).where("split = 'train'").drop("split")
    wanted = spark.createDataFrame([(i,) for i in (0, 1, 19, 20, 57, -1, -20)], "idx long")
    return packing.lookup(wanted, index)


@query("""with e as (select vec_id, list_transform(embedding, lambda x: (round(x::double * 1000))::bigint) as t from embeddings), b as (select vec_id, t, unnest(range(0, (len(t) - 1) // 20)) as block from e)
select vec_id, block::int as block, t[block * 20 + 1:block * 20 + 20] as input_ids, t[block * 20 + 2:block * 20 + 21] as labels from b""")
def block_inputs_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("tokens"))
    return packing.blocks(rows, 20)


@query("""with t as (select vec_id, list_transform(embedding, lambda x: (round(x::double * 1000))::bigint) as t from embeddings) select vec_id, t[1:32] as head, len(t)::bigint as tokens from t where vec_id = (select min(vec_id) from t)""")
def shard_preview(spark, sf_dir):
    """The first 32 tokens of the first row of a token stream."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("t"))
    return rows.orderBy("vec_id").limit(1).select("vec_id", F.slice("t", 1, 32).alias("head"), F.size("t").cast("long").alias("tokens"))


@query(f"""with {D} select count(*) as count, min(n_tokens)::bigint as min, max(n_tokens)::bigint as max, round(avg(n_tokens), 6) as mean, round(median(n_tokens), 6) as median, round(stddev_pop(n_tokens), 6) as std,
round(quantile_cont(n_tokens, 0.5), 6) as p50, round(quantile_cont(n_tokens, 0.75), 6) as p75, round(quantile_cont(n_tokens, 0.9), 6) as p90, round(quantile_cont(n_tokens, 0.95), 6) as p95, round(quantile_cont(n_tokens, 0.99), 6) as p99, round(quantile_cont(n_tokens, 0.999), 6) as p99_9,
count(*) filter (n_tokens > 2048) as n_over_context, round(count(*) filter (n_tokens > 2048) / count(*), 6) as frac_over_context, sum(n_tokens)::bigint as tokens_total from f where status in ('written', 'short')""")
def token_length_summary(spark, sf_dir):
    out = estimate.length_summary(_docs(spark, sf_dir).where("status in ('written', 'short')"), "n_tokens", 2048)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("""with r as (select source as subset, strlen(text) as bytes, len(regexp_extract_all(text, '\\S+')) as tokens, row_number() over (partition by source order by doc_id) as rn from documents),
s as (select subset, count(*) as sample_docs, sum(tokens)::bigint as sample_tokens, sum(bytes)::bigint as sample_bytes from r where rn <= 10 group by subset), t as (select subset, sum(bytes)::bigint as total_bytes from r group by subset)
select t.subset, sample_docs, sample_tokens, sample_bytes, total_bytes, round(sample_tokens / sample_bytes, 9) as tokens_per_byte, round_even(sample_tokens / sample_bytes * total_bytes, 0)::bigint as tokens from t join s on t.subset = s.subset""")
def ratio_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("subset"), "doc_id", F.octet_length("text").cast("long").alias("bytes"), tokenizers.count("whitespace", F.col("text")).alias("n"))
    sample = sampling.first_per_group(docs, "subset", "doc_id", estimate.shard_quota(100, 10)).groupBy("subset").agg(F.count("*").alias("sample_docs"), F.sum("n").alias("sample_tokens"), F.sum("bytes").alias("sample_bytes"))
    out = estimate.ratio_estimate(sample, docs.groupBy("subset").agg(F.sum("bytes").alias("total_bytes")))
    return out.withColumn("tokens_per_byte", F.round("tokens_per_byte", 9)).select("subset", "sample_docs", "sample_tokens", "sample_bytes", "total_bytes", "tokens_per_byte", "tokens")


@query("""with x as (select distinct lang as category, source as subset from documents), e as (select source as subset, sum(strlen(text))::bigint as tokens from documents group by source)
select category, x.subset as subset, coalesce(sum(tokens), 0)::bigint as tokens, case when grouping(category) = 1 then 2 when grouping(x.subset) = 1 then 1 else 0 end::int as level from x left join e on x.subset = e.subset group by rollup(category, x.subset)""")
def category_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dim = docs.select(F.col("lang").alias("category"), F.col("source").alias("subset")).distinct()
    tokens = docs.groupBy(F.col("source").alias("subset")).agg(F.sum(F.octet_length("text")).alias("tokens"))
    return estimate.category_rollup(dim, tokens)


@query("""with m(subset, target) as (values ('src0', 100::bigint), ('src1', 200::bigint), ('nowhere', 300::bigint)), f as (select source as subset, count(*) as n_docs from documents group by source)
select m.subset, target, coalesce(n_docs, 0) as n_docs, n_docs is null as completed from m left join f on m.subset = f.subset""")
def mixture_left_join(spark, sf_dir):
    mixture = spark.createDataFrame([("src0", 100), ("src1", 200), ("nowhere", 300)], "subset string, target long")
    found = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("subset")).agg(F.count("*").alias("n_docs"))
    return configs.with_subsets(mixture, found, skip_missing=True)


@query("""with c(key, v) as (values ('seed', '7'), ('dtype', 'auto'), ('resume', 'true'), ('new', null), ('same', null)), p(key, v) as (values ('seed', '8'), ('dtype', 'auto'), ('resume', 'false'), ('same', null), ('old', '1'))
select c.key, c.v as current_value, p.v as previous_value from c left join p on c.key = p.key where c.key <> 'resume' and (p.key is null or c.v is distinct from p.v)""")
def config_diff(spark, sf_dir):
    now = spark.createDataFrame([("seed", "7"), ("dtype", "auto"), ("resume", "true"), ("new", None), ("same", None)], "key string, value string")
    then = spark.createDataFrame([("seed", "8"), ("dtype", "auto"), ("resume", "false"), ("same", None), ("old", "1")], "key string, value string")
    return configs.differing_settings(now, then)


@query("""select distinct 'tokens_' || lpad((doc_id % 40)::varchar, 6, '0') || '.bin' as name from documents except select 'tokens_' || lpad(x::varchar, 6, '0') || '.bin' from range(0, 35) t(x)""")
def orphan_files(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.format_string("tokens_%06d.bin", F.col("doc_id") % 40).alias("name")).distinct()
    return configs.orphans(files, spark.range(35).select(F.format_string("tokens_%06d.bin", "id").alias("name")))


@query("""select distinct w as token from (select unnest(regexp_extract_all(text, '\\S+')) as w from documents) where w not in ('the', 'of', 'and')""")
def vocab_minus_specials(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("token")).distinct()
    return configs.plain_vocabulary(words, spark.createDataFrame([("the",), ("of",), ("and",)], "token string"))


@query("""select doc_id, len(regexp_extract_all(text, '\\S+'))::bigint as n_tokens from documents""")
def whitespace_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokenizers.count("whitespace", F.col("text")).alias("n_tokens"))


@query(r"""select doc_id, round(length(text) / greatest(len(regexp_extract_all(text, '\S+')), 1), 6) as chars_per_token from documents""")
def chars_per_token(spark, sf_dir):
    n = tokenizers.count("whitespace", F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(F.length("text") / F.greatest(n, F.lit(1)), 6).alias("chars_per_token"))


@query()
def pretoken_counts(spark, sf_dir):
    """The pattern looks ahead, which DuckDB's does not; tests compare with another engine."""
    return table(spark, sf_dir, "documents").select("doc_id", tokenizers.count("pretoken", F.col("text")).alias("n_pieces"))


@query()
def byte_round_trip(spark, sf_dir):
    """Ids by the Arrow UDF, framed, and whether their number is the byte length plus two."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(tokenizers.ids("utf8_bytes", F.col("text"), True, True)).cast("long").alias("n_ids"), F.octet_length("text").cast("long").alias("n_bytes"))


ORACLES["byte_round_trip"] = "select doc_id, strlen(text) + 2 as n_ids, strlen(text) as n_bytes from documents"



@query("""with r as (select *, min(turn) over (partition by conv_id) as first from conversations)
select conv_id, '<|startoftext|>' || coalesce(max('<|im_start|>system' || chr(10) || text || '<|im_end|>' || chr(10)) filter (turn = first and role = 'system' and text <> ''), '') ||
coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) filter (not (turn = first and role = 'system')), '') || '<|im_start|>assistant' || chr(10) as transcript from r group by conv_id""")
def chat_render(spark, sf_dir):
    return chat.hoisted(table(spark, sf_dir, "conversations"), generation_prompt=True)


@query(f"""with r as (select conv_id, turn, role, regexp_replace(text, {STRIP}) as text from conversations), q as (select *, max(turn) filter (role = 'user') over (partition by conv_id) as lastq from r)
select conv_id, string_agg('<|im_start|>' || role || chr(10) || case when role = 'assistant' and turn > lastq then '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) else '' end || text || '<|im_end|>' || chr(10), '' order by turn) as transcript from q group by conv_id""")
def chat_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id").distinct()
    return chat.queries(rows.join(asked, "conv_id", "left_semi"))


ORACLES["chat_queries"] = ORACLES["chat_queries"].replace("from conversations)", "from conversations where conv_id in (select conv_id from conversations where role = 'user'))", 1)


@query(f"""with r as (select conv_id, turn, role, regexp_replace(text, {STRIP}) as text, min(turn) over (partition by conv_id) as first from conversations),
b as (select *, lag(role) over (partition by conv_id order by turn) as before from r where not (turn = first and role = 'system')),
s as (select conv_id, max(case when turn = first and role = 'system' then '<|turn>system' || chr(10) || text || '<turn|>' || chr(10) end) as head from r group by conv_id),
m as (select conv_id, string_agg(case when role = 'assistant' and before = 'assistant' then '' else '<|turn>' || case when role = 'assistant' then 'model' else role end || chr(10) end || text || '<turn|>' || chr(10), '' order by turn) as body from b group by conv_id)
select s.conv_id, '<bos>' || coalesce(head, '') || coalesce(body, '') as transcript from s left join m on s.conv_id = m.conv_id""")
def chat_turns(spark, sf_dir):
    return chat.turns(table(spark, sf_dir, "conversations"))


@query("""select conv_id, turn, coalesce(max(turn) filter (role = 'assistant') over (partition by conv_id), -1) as last_assistant from conversations""")
def chat_last_assistant(spark, sf_dir):
    return chat.last_turn(table(spark, sf_dir, "conversations"), "assistant", "last_assistant").select("conv_id", "turn", "last_assistant")


@query("""select conv_id, turn, lag(role) over w as prev_role, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)""")
def chat_turn_neighbours(spark, sf_dir):
    return chat.neighbours(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "prev_role", "next_role")


@query("""select conv_id, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as assistant_chars, sum(length(text))::bigint as all_chars from conversations group by conv_id""")
def assistant_span_chars(spark, sf_dir):
    return chat.assistant_characters(table(spark, sf_dir, "conversations"))


EXPLODED = "x as (select vec_id, unnest(embedding)::double as logit, unnest(range(0, len(embedding)))::int as id from embeddings)"


@query(f"""with {EXPLODED} select vec_id, min_by(id, (-logit, id)) as id from x group by vec_id""")
def greedy_token(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", logits.greedy(F.col("logits")).alias("id"))


@query(f"""with {EXPLODED} select vec_id, id, round(logit, 6) as logit from x qualify rank() over (partition by vec_id order by logit desc) <= 10""")
def topk_logits(spark, sf_dir):
    out = _logits(spark, sf_dir).select("vec_id", F.posexplode(logits.top_k(F.col("logits"), 10)).alias("id", "logit"))
    return out.where("logit is not null").withColumn("logit", F.round("logit", 6))


TOPP = f"""{EXPLODED}, k as (select * from x qualify rank() over (partition by vec_id order by logit desc) <= 10), e as (select *, exp(logit - max(logit) over (partition by vec_id)) as e from k),
q as (select *, e / sum(e) over (partition by vec_id) as p from e), c as (select *, coalesce(sum(p) over (partition by vec_id order by logit desc, id rows between unbounded preceding and 1 preceding), 0) as before from q)"""


@query(f"""with {TOPP} select vec_id, id, round(logit, 6) as logit from c where before <= 0.5""")
def topp_logits(spark, sf_dir):
    out = _logits(spark, sf_dir).select("vec_id", F.posexplode(logits.top_p(logits.top_k(F.col("logits"), 10), 0.5)).alias("id", "logit"))
    return out.where("logit is not null").withColumn("logit", F.round("logit", 6))


@query(f"""with {TOPP}, s as (select vec_id, id, e / sum(e) over (partition by vec_id) as p from c where before <= 0.5), r as (select *, sum(p) over (partition by vec_id order by id) as cum from s),
u as (select *, ('0x' || substr(md5(vec_id::varchar), 1, 8))::bigint / 4294967296.0::double as u from r) select vec_id, min(id) as id from u where cum > u group by vec_id""")
def multinomial_draw(spark, sf_dir):
    uniform = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return _logits(spark, sf_dir).select("vec_id", logits.draw(logits.top_p(logits.top_k(F.col("logits"), 10), 0.5), uniform).alias("id"))


@query(f"""with {EXPLODED} select vec_id, id, round(case when id % 7 <> 0 then logit when logit < 0 then logit * 1.3::double else logit / 1.3::double end / 0.8::double, 6) as logit from x""")
def repetition_penalty(spark, sf_dir):
    seen = F.array(*(F.lit(i) for i in range(0, 64, 7)))
    out = logits.temperature(logits.repetition_penalty(F.col("logits"), seen, 1.3), 0.8)
    return _logits(spark, sf_dir).select("vec_id", F.posexplode(out).alias("id", "logit")).withColumn("logit", F.round("logit", 6))


@query("""select conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\S+'), lambda w: length(w)::int))) as ids from conversations""")
def distinct_token_ids(spark, sf_dir):
    sizes = F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), lambda w: F.length(w))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", logits.distinct_ids(sizes).alias("ids"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: (floor(x::double * 10))::int) as ids from embeddings), o as (select vec_id, ids[5:] as ids from e)
select vec_id, case when ids[-1] in (0, 1) then ids[:-2] else ids end as shown, list_filter(ids, lambda x: x not in (0, 1)) as plain, ids[-8:] as recent from o""")
def output_slicing(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 10).cast("int")).alias("ids"))
    tail = F.slice("ids", 5, F.size("ids"))
    return ids.select("vec_id", logits.output_ids(F.col("ids"), F.lit(4), [0, 1]).alias("shown"), logits.without(tail, [0, 1]).alias("plain"), packing.last_tokens(tail, 8).alias("recent"))


@query("""with o as (select doc_id, row_number() over (order by md5('7|3|' || doc_id), doc_id) - 1 as position, count(*) over () as n from documents) select doc_id, position, (position % 4)::int as rank from o where position < n - n % 4""")
def rank_sampler(spark, sf_dir):
    return sampling.rank_sampler(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 4, SEED, 3)


@query("""with o as (select doc_id, row_number() over (order by doc_id) - 1 as p, count(*) over () as n from documents), a as (select doc_id, p as position from o union all select doc_id, p + n from o where p < (7 - n % 7) % 7) select doc_id, position, (position % 7)::int as rank from a""")
def rank_sampler_padded(spark, sf_dir):
    return sampling.rank_sampler(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, shuffle=False, drop_last=False)


@query("""with o as (select doc_id, (row_number() over (order by doc_id) - 1) // 8 as batch from documents) select doc_id, batch, (batch + 1) % 3 = 0 or batch = max(batch) over () as steps from o""")
def micro_batches(spark, sf_dir):
    return packing.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8, 3)


@query("""select x as step, round(case when x < 100 then greatest((x + 1) / 100.0::double, 1e-8::double) else 0.1::double + 0.9::double * 0.5::double * (1 + cos(pi() * least(greatest((x - 100) / 900.0::double, 0), 1))) end, 9) as scale from range(0, 1001) t(x)""")
def lr_schedule(spark, sf_dir):
    return spark.range(1001).select(F.col("id").alias("step"), F.round(training.learning_rate_scale(F.col("id"), 1000, 100, 0.1), 9).alias("scale"))


@query("""with w as (select user_id, event_id, epoch_us(ts) / 1e6::double as seconds, event_id * 2048 as tokens from events),
t as (select user_id, event_id, (tokens - lag(tokens) over o) / greatest(seconds - lag(seconds) over o, 1e-9::double) as tps from w window o as (partition by user_id order by event_id))
select user_id, event_id, round(tps, 3) as tokens_per_second, round(6 * 353373184::double * tps / 1e12::double, 9) as tflops, round(6 * 353373184::double * tps / 1e12::double / (989 * 2), 12) as mfu from t""")
def mfu_curve(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast(ts as timestamp_ntz))") / 1e6).alias("seconds"), (F.col("event_id") * 2048).alias("tokens"))
    tps, parameters = F.col("tokens_per_second"), F.lit(353_373_184.0)
    out = metrics.throughput(rows, "event_id", "tokens", "seconds", ["user_id"])
    return out.select("user_id", "event_id", F.round(tps, 3).alias("tokens_per_second"), F.round(training.achieved_tflops(parameters, tps), 9).alias("tflops"), F.round(training.utilisation(parameters, tps, F.lit(989), F.lit(2)), 12).alias("mfu"))


@query("""with w as (select event_type, value as loss, event_id % 5 as n from events) select event_type, round(sum(loss * n) / greatest(sum(n), 1), 6) as loss, round(exp(least(sum(loss * n) / greatest(sum(n), 1), 20)), 2) as perplexity, round(avg(loss), 6) as plain from w group by event_type""")
def weighted_eval_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("loss"), (F.col("event_id") % 5).alias("n"))
    out = rows.groupBy("event_type").agg(metrics.weighted_mean("loss", "n").alias("l"), F.avg("loss").alias("plain"))
    return out.select("event_type", F.round("l", 6).alias("loss"), F.round(training.perplexity(F.col("l")), 2).alias("perplexity"), F.round("plain", 6).alias("plain"))


@query("""select event_type, event_id, min(value) over (w rows between unbounded preceding and current row) as best, coalesce(value < min(value) over (w rows between unbounded preceding and 1 preceding), true) as is_best from events window w as (partition by event_type order by event_id)""")
def running_best(spark, sf_dir):
    return budget.running(table(spark, sf_dir, "events"), "value", "event_id", ["event_type"]).select("event_type", "event_id", "best", "is_best")


@query("""select r_regionkey, case when n < 1000 then printf('%.1f', n::double) when n < 1000000 then printf('%.1fK', n / 1e3::double) when n < 1000000000 then printf('%.1fM', n / 1e6::double) when n < 1000000000000 then printf('%.1fB', n / 1e9::double) else printf('%.1fT', n / 1e12::double) end as amount, format('{:,}', n) as n_text from (select r_regionkey, (r_regionkey * 7 + 1) ** (r_regionkey * 2 + 1)::bigint as m, ((r_regionkey * 7 + 1) ** (r_regionkey * 2 + 1))::bigint as n from region)""")
def human_numbers(spark, sf_dir):
    k = F.col("r_regionkey")
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.pow(k * 7 + 1, k * 2 + 1).cast("long").alias("n"))
    return rows.select("r_regionkey", text.human(F.col("n")).alias("amount"), text.grouped(F.col("n")).alias("n_text"))


@query("""select source, ('0x' || substr(sha1(source), 1, 8))::bigint + 7 as seed from (select distinct source from documents)""")
def sample_seeds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", hashing.sample_seed_column(SEED, F.col("source")).alias("seed"))


@query()
def conformance_split(spark, sf_dir):
    """The BLAKE2b profile of the hash split, which SQL does not have."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("subset"), "doc_id", text.prefix(F.col("text")).alias("head"))
    return budget.hash_split(rows, 0.002, SEED, ["subset", "doc_id", "head"], "conformance").select("doc_id", "bucket", "candidate")


@query("""with s as (select event_type, event_id, value, row_number() over (partition by event_type order by event_id) as n from events) select event_type, event_id from s where n <= 3""")
def shard_quota(spark, sf_dir):
    return sampling.first_per_group(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", estimate.shard_quota(14, 5))


@query("""select m.subset from (values ('src0'), ('src1'), ('src2')) m(subset) where m.subset not in (values ('src1'))""")
def unfinished_subsets(spark, sf_dir):
    mixture = spark.createDataFrame([("src0",), ("src1",), ("src2",)], "subset string")
    return configs.unfinished(mixture, spark.createDataFrame([("src1", True), ("src2", False)], "subset string, committed boolean"))


from corpusloom.plans import catalogue_files  # noqa: E402, F401  (registers its queries here)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


