"""Registered queries that write files into the shared folder and read them back: JSON lines, token shards, vocabularies,
streams; and queries over rich chat messages. Part of corpusloom.plans.catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text, tokenizers, training
from corpusloom.operators import chat, chat_rich, estimate, ladder, packing
from corpusloom.plans import dataset
from corpusloom.plans.catalogue import CAP, CONTEXT, FRACTION, GREEDY, LONGEST, SEED, SHARD, STRIP, TARGET, D, query, table
from corpusloom.session import scratch
from corpusloom.sources import jsonl, manifest, token_shards, vocabulary
from corpusloom.streaming import ingest

#: Lines that are no documents, by the last digit of the document's number.
ODD_LINES = {0: "not json", 1: "[1, 2]", 2: "null", 3: '{"text": 5}', 4: "{}", 5: ""}


def _shards(spark, sf_dir):
    """Documents as JSON lines, three shards a source; some lines are replaced by ODD_LINES."""
    root = scratch(spark, "lines")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    raw = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text")))
    for digit, line in ODD_LINES.items():
        raw = F.when(F.col("doc_id") % 37 == digit, F.lit(line)).otherwise(raw)
    rows = docs.select(F.col("source").alias("subset"), F.format_string("s%d", F.col("doc_id") % 3).alias("shard"), F.col("doc_id").alias("line_idx"), raw.alias("raw"))
    jsonl.write(rows, root)
    return root


LINES = f"""x as (select source as subset, 's' || (doc_id % 3) || '.jsonl.zst' as shard, row_number() over (partition by source, doc_id % 3 order by doc_id) - 1 as line_idx, doc_id, regexp_replace(text, {STRIP}) as t from documents),
n as (select *, case when doc_id % 37 in (0, 1, 2, 5) then 'malformed' else 'parsed' end as parse_status, case when doc_id % 37 in (0, 1, 2, 5) then null when doc_id % 37 in (3, 4) then '' else t end as text from x)"""


@query(f"""with {LINES} select subset, shard, line_idx, parse_status, length(text)::int as n_chars, md5(text) as text_md5 from n""")
def jsonl_scan(spark, sf_dir):
    """Every line of written shards: its number, status and text."""
    rows = jsonl.scan(spark, [f"{_shards(spark, sf_dir)}/*/*.jsonl.zst"])
    return rows.select("subset", "shard", "line_idx", "parse_status", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(f"""with {LINES} select subset, count(distinct shard) as shards, count(*) filter (parse_status = 'malformed') as malformed, count(*) filter (text = '') as empty, count(*) filter (text <> '' and strlen(text) < {ladder.MIN_TOKENS}) as short, count(*) filter (strlen(text) >= {ladder.MIN_TOKENS}) as written from n group by subset""")
def jsonl_ladder(spark, sf_dir):
    """The ladder over written shards, by subset, read one subset at a time as a resumed build does."""
    read = jsonl.reader(spark, _shards(spark, sf_dir))
    names = [r.source for r in table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").collect()]
    rows = ladder.ladder(read(names))
    by = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy("subset").agg(F.count_distinct("shard").alias("shards"), *(by(s) for s in ("malformed", "empty", "short", "written")))


@query(f"""with {LINES}, f as (select *, case when strlen(text) >= {ladder.MIN_TOKENS} then strlen(text) + 2 else 0 end as n_framed from n),
p as (select *, coalesce(sum(n_framed) over (partition by subset order by shard, line_idx rows between unbounded preceding and 1 preceding), 0)::bigint as prior from f) select subset, shard, line_idx, n_framed::bigint as n_framed, prior from p where prior < {TARGET}""")
def streaming_budget(spark, sf_dir):
    """Incremental ingest of written shards under a budget a subset, up to the end of what is there."""
    root, out, place = _shards(spark, sf_dir), scratch(spark, "ingested"), scratch(spark, "ingest")
    names = [r.source for r in table(spark, sf_dir, "documents").select("source").distinct().collect()]
    ingest.start(ingest.lines(spark, f"{root}/*"), dict.fromkeys(names, TARGET), out, place).awaitTermination()
    return ingest.read(spark, out).select("subset", "shard", "line_idx", "n_framed", "prior")


# The build keys its split by shard, too.
D_BUILD = D.replace("'|' || line_idx)", "'|000|' || line_idx)")
STREAM = f"""{D_BUILD}, {GREEDY}, o as (select *, coalesce(sum(n_framed) over (partition by split order by replace(subset, 'src', '')::int, line_idx rows between unbounded preceding and 1 preceding), 0)::bigint as off from e where n_framed > 0)"""


def _built(spark, sf_dir, root=None, **more):
    docs = table(spark, sf_dir, "documents")
    names = sorted((r.source for r in docs.select("source").distinct().collect()), key=lambda s: int(s.removeprefix("src")))
    rows = ladder.from_table(docs).withColumn("shard", F.lit("000")).withColumn("shard_ord", F.lit(0))
    root = root or scratch(spark, "built")
    recipe = dataset.Recipe(root, train_shard_tokens=SHARD, val_shard_tokens=SHARD, val_fraction=FRACTION, max_val_tokens_per_subset=CAP, seed=SEED, max_doc_tokens=10**9, context_length=CONTEXT, **more)
    return root, dataset.build(spark, rows, [(s, TARGET) for s in names], recipe)


@query(f"""with recursive {STREAM}, bytes as (select split, off, unnest(range(0, n_framed)) as i, n_framed, hex(encode(t)) as h from o),
toks as (select split, off + i as place, case when i = 0 then 1 when i = n_framed - 1 then 2 else ('0x' || substr(h, (2 * i - 1)::int, 2))::int + 3 end as token from bytes),
z as (select split, place // {SHARD} as shard, place % {SHARD} as place, token from toks), y as (select split, shard, count(*) as tokens from z group by all)
select z.split, z.shard::int as shard, z.place // {CONTEXT} as block, sum(token)::bigint as input_sum, sum(token * (z.place % {CONTEXT} + 1))::bigint as weighted_sum from z join y on z.split = y.split and z.shard = y.shard
where z.place // {CONTEXT} < (tokens - 1) // {CONTEXT} group by all""")
def shard_blocks(spark, sf_dir):
    """Blocks of a built dataset, read from its binary shards: sums of the inputs, plain and by place."""
    root, _ = _built(spark, sf_dir)
    rows = token_shards.read_blocks(spark, root, "train", CONTEXT).unionByName(token_shards.read_blocks(spark, root, "val", CONTEXT))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    weighted = total(F.transform("input_ids", lambda x, i: x * (i + 1)))
    return rows.select("split", "shard", "block", total(F.col("input_ids")).alias("input_sum"), weighted.alias("weighted_sum"))


@query(f"""with recursive {STREAM}, z as (select split, sum(n_framed)::bigint as tokens from o group by split) select split, tokens, ceil(tokens / {SHARD})::bigint as shards, (tokens - (ceil(tokens / {SHARD})::bigint - 1) * {SHARD})::bigint as last_tokens, 'uint16' as dtype from z""")
def manifest_splits(spark, sf_dir):
    """The manifest of a dry run, by split."""
    root, _ = _built(spark, sf_dir, dry_run=True)
    found = manifest.read_json(f"{root}/dry_run_{manifest.MANIFEST}")["splits"]
    rows = [(s, v["tokens"], len(v["shards"]), v["shards"][-1]["tokens"], v["shards"][-1]["dtype"]) for s, v in found.items() if v["shards"]]
    return spark.createDataFrame(rows, "split string, tokens long, shards long, last_tokens long, dtype string")


@query(f"""with recursive {D_BUILD}, {GREEDY} select subset, count(*) as docs_seen, count(*) filter (status = 'written') as docs_written, sum(n_framed)::bigint as actual_tokens, {TARGET}::bigint as target_tokens, true as completed from e group by subset""")
def manifest_subsets(spark, sf_dir):
    """A build that was resumed after its manifest, its work folder and a shard were lost, by subset."""
    root, _ = _built(spark, sf_dir)
    for lost in (manifest.MANIFEST, "train/tokens_000000.bin"):
        store, place = manifest.filesystem(f"{root}/{lost}")
        store.delete_file(place)
    _built(spark, sf_dir, root, resume=True)
    rows = [(s, v["docs_seen"], v["docs_written"], v["actual_tokens"], v["target_tokens"], v["completed"]) for s, v in manifest.read_manifest(root)["subsets"].items()]
    return spark.createDataFrame(rows, "subset string, docs_seen long, docs_written long, actual_tokens long, target_tokens long, completed boolean")


@query("""select doc_id, strlen(text) + 2 as n_ids, 256::bigint as first_id, 257::bigint as last_id, true as round_trip from documents where text is not null""")
def bundle_round_trip(spark, sf_dir):
    """Ids of an exported bundle of byte tokens, framed by named special tokens, and whether they decode to the text."""
    folder = scratch(spark, "bundle")
    ranks = {bytes([b]): b for b in range(256)}
    tokenizers.export_bundle(folder, "bytes", tokenizers.SPLIT_PATTERN, ranks, {"<bos>": 256, "<eos>": 257})
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", tokenizers.round_trips(folder, F.col("text"), "<bos>", "<eos>").alias("r")).select("doc_id", "r.*")


@query(r"""with w as (select unnest(regexp_extract_all(text, '\S+')) as w from documents), r as (select w, row_number() over (order by count(*) desc, w) - 1 as rank from w group by w) select hex(encode(w)) as token_hex, rank::int as rank from r where rank < 500""")
def rank_file(spark, sf_dir):
    """The 500 most frequent words, written as a rank file and read back."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("w"))
    top = words.groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(500)
    ranked = spark.createDataFrame([(bytearray(r.w.encode()), i) for i, r in enumerate(top.collect())], "token binary, rank int")
    path = scratch(spark, "ranks")
    vocabulary.rank_lines(ranked).coalesce(1).write.text(path)
    return vocabulary.read_ranks(spark, path).select(F.hex("token").alias("token_hex"), "rank")


@query("""with x as (select lang as category, source as subset, sum(strlen(text))::bigint as tokens from documents group by all),
o as (select category, dense_rank() over (order by category) as c, subset, tokens from x),
g as (select category, c, sum(tokens)::bigint as tokens from o group by all),
h as (select tokens, format('{:,}', tokens) || ' tokens (' || case when tokens < 1000 then printf('%.1f', tokens::double) when tokens < 1000000 then printf('%.1fK', tokens / 1e3::double) when tokens < 1000000000 then printf('%.1fM', tokens / 1e6::double) else printf('%.1fB', tokens / 1e9::double) end || ')' as amount from (select tokens from g union select sum(tokens)::bigint from g))
select category || ':' as line from g union all select '  data/' || subset || ': ' || format('{:,}', tokens) || ' tokens' from o union all select '  -> subtotal: ' || amount from g join h on g.tokens = h.tokens union all select '' from g
union all select 'TOTAL: ' || amount from h where tokens = (select sum(tokens) from g)""")
def token_report(spark, sf_dir):
    """Lines of the text report, written and read back; sizes are bytes by language and source."""
    sums = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("category"), F.concat("lang", F.lit("/"), "source").alias("subset"), "source").agg(F.sum(F.octet_length("text")).alias("tokens"))
    rows = sorted(sums.collect(), key=lambda r: (r.category, r.source))
    order = {c: i for i, c in enumerate(sorted({r.category for r in rows}))}
    taxonomy = spark.createDataFrame([(order[r.category], r.category, i, r.subset) for i, r in enumerate(rows)], "category_ord int, category string, subset_ord int, subset string")
    path = scratch(spark, "report")
    estimate.write_report(estimate.report(taxonomy, sums.select("subset", "tokens")), path)
    return spark.read.schema("value string").text(path).select(F.regexp_replace("value", "data/.*?/", "data/").alias("line"))


@query(f"""select conv_id, turn, regexp_replace(text, {STRIP}) || role as answer, role || 'ab' as without_channel, substr(text, 1, 128) as head, upper(role) as upper_role from conversations""")
def thinking_removed(spark, sf_dir):
    """What follows a thinking block, text without channels, the first code points, and upper case."""
    thought = F.concat(F.lit("<think>"), "text", F.lit("</think>\n"), text.strip("text"), "role")
    channels = F.concat(F.lit("  "), "role", F.lit("a<|channel>thought\n"), "text", F.lit("<channel|>b "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.after_thinking(thought).alias("answer"), text.without_channels(channels).alias("without_channel"), text.prefix(F.col("text")).alias("head"), F.upper("role").alias("upper_role"))


@query("""select conv_id, turn, text as thinking, role as content, ['f', 'g'] as names, ['{a:1}', '{t:' || turn || '}'] as arguments from conversations""")
def response_parse(spark, sf_dir):
    """Model turns taken apart: thinking, calls and content."""
    whole = F.concat(F.lit("<|channel>thought\n"), "text", F.lit("<channel|><|tool_call>call:f{a:1}<tool_call|><|tool_call>call:g{t:"), F.col("turn").cast("string"), F.lit("}<tool_call|>"), "role", F.lit("<turn|>\n"))
    p = chat.parse_response(whole)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", p.alias("p"))
    return rows.select("conv_id", "turn", "p.thinking", "p.content", F.transform("p.tool_calls", lambda c: c["name"]).alias("names"), F.transform("p.tool_calls", lambda c: c["arguments"]).alias("arguments"))


def _messages(spark, sf_dir, **extra):
    """Conversations as one JSON list of messages each; extra fields by column."""
    rows = table(spark, sf_dir, "conversations")
    fields = F.struct("turn", "role", F.col("text").alias("content"), *(c.alias(k) for k, c in extra.items()))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(fields)).alias("m"))  # the turns of one conversation
    return lists.select("conv_id", F.to_json("m").alias("messages"))


def _if_assistant(value):
    return F.when(F.col("role") == "assistant", value)


def _call(name, **arguments):
    return _if_assistant(F.array(F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.struct(F.lit(name).alias("name"), F.struct(*(c.alias(k) for k, c in arguments.items())).alias("arguments")).alias("function"))))


NL = "chr(10)"
LAST = "r as (select *, min(turn) over (partition by conv_id) as first, max(turn) filter (role = 'assistant') over (partition by conv_id) as last, lag(role) over (partition by conv_id order by turn) as before, lead(role) over (partition by conv_id order by turn) as after from conversations)"


@query(f"""with {LAST} select conv_id, '<|startoftext|>' || string_agg('<|im_start|>' || role || {NL} || case when role = 'assistant' and turn = last then '<think>because' || turn || '</think>' else '' end ||
case when role = 'assistant' then '<|tool_call_start|>[lookup(turn=' || turn || ', who="user")]<|tool_call_end|>' else '' end || text || '<|im_end|>' || {NL}, '' order by turn) as transcript from r group by conv_id""")
def chat_rich_calls(spark, sf_dir):
    """Rich transcripts with thoughts and calls: thoughts are shown in the last reply alone."""
    rows = _messages(spark, sf_dir, thinking=_if_assistant(F.concat(F.lit("because"), F.col("turn").cast("string"))), tool_calls=_call("lookup", turn=F.col("turn"), who=F.lit("user")))
    return rows.select("conv_id", chat_rich.render(F.col("messages"), "rich").alias("transcript"))


@query(f"""with {LAST}, t as (select *, regexp_replace(text, {STRIP}) as s from r)
select conv_id, sum(case when role = 'assistant' and after = 'user' then 1 else 0 end)::bigint as results, sum(case when role = 'assistant' then 1 else 0 end)::bigint as calls, string_agg(case when role = 'user' and before = 'assistant' then s end, '|' order by turn) as answers from t group by conv_id""")
def chat_tool_results(spark, sf_dir):
    """Transcripts by turns in which the user's words after a reply are the result of its call: results, calls, and the
    results' texts with the name of their call."""
    w = "lag(role) over (partition by conv_id order by turn)"
    rows = table(spark, sf_dir, "conversations").withColumn("is_result", F.expr(f"coalesce({w} = 'assistant' and role = 'user', false)"))
    rows = rows.withColumn("call_id", F.expr("'c' || lag(turn) over (partition by conv_id order by turn)"))
    role = F.when(F.col("is_result"), F.lit("tool")).otherwise(F.col("role"))
    fields = F.struct("turn", role.alias("role"), F.col("text").alias("content"), F.when(F.col("is_result"), F.col("call_id")).alias("tool_call_id"), _call("lookup", q=F.col("turn")).alias("tool_calls"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(fields)).alias("m")).select("conv_id", F.to_json("m").alias("messages"))
    shown = lists.select("conv_id", chat_rich.render(F.col("messages"), "turns").alias("t"))
    quote = chat_rich.QUOTE.replace("|", "\\|")
    found = F.regexp_extract_all("t", F.lit(rf"(?s)<\|tool_response>response:lookup\{{value:{quote}(.*?){quote}\}}<tool_response\|>"), F.lit(1))
    stripped = F.transform(found, lambda x: text.strip(x))
    return shown.select("conv_id", F.size(found).cast("long").alias("results"), F.size(F.regexp_extract_all("t", F.lit(r"<\|tool_call>call:lookup\{q:\d+\}<tool_call\|>"), F.lit(0))).cast("long").alias("calls"), F.when(F.size(found) > 0, F.array_join(stripped, "|")).alias("answers"))


@query("""select event_id, 256 * ((event_id % 4) + 1) * 2 * 3 as step_tokens, value from events""")
def step_tokens(spark, sf_dir):
    """Tokens of an optimiser step, and values that are checked to be finite."""
    return table(spark, sf_dir, "events").select("event_id", training.tokens_per_step(256, F.col("event_id") % 4 + 1, 2, 3).alias("step_tokens"), training.finite(F.col("value")).alias("value"))
