"""Chat transcripts from (conv_id, turn, role, text) rows: one aggregation a conversation, all on the JVM.

Four styles: `hoisted` (system first, thinking of earlier replies dropped), `queries` (reasoning kept after the last user
query, tool results under a user turn), `turns` (one model turn for successive replies, thinking channels dropped) and
`rich`, which takes messages with parts, tools and tool calls (see corpusloom.operators.chat_rich)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import after_thinking, strip, without_channels

# Markers of the formats.
BOS, START, END = "<|startoftext|>", "<|im_start|>", "<|im_end|>"
TURN, TURN_END, CHANNEL, CHANNEL_END = "<|turn>", "<turn|>", "<|channel>", "<channel|>"
TURNS_BOS = "<bos>"

_KEY = ["conv_id"]


def _in_order(rows: DataFrame, piece: Column, head: Column, tail: Column, name: str = "transcript") -> DataFrame:
    """Head, the pieces by turn, and tail of each conversation; null pieces are left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("turn", "_piece"))))
    whole = F.concat(F.col("_head"), F.array_join(F.transform("_all", lambda s: s["_piece"]), ""), F.col("_tail"))
    grouped = rows.withColumn("_piece", piece).withColumn("_head", head).withColumn("_tail", tail).groupBy(*_KEY).agg(ordered.alias("_all"), F.max("_head").alias("_head"), F.max("_tail").alias("_tail"))
    return grouped.select(*_KEY, whole.alias(name))


def last_turn(rows: DataFrame, role: str, name: str) -> DataFrame:
    """Adds the last turn of a role in each conversation, or -1."""
    last = F.max(F.when(F.col("role") == role, F.col("turn"))).over(Window.partitionBy(*_KEY))
    return rows.withColumn(name, F.coalesce(last, F.lit(-1)))


def neighbours(rows: DataFrame) -> DataFrame:
    """Adds prev_role (the last role before, tools skipped) and next_role."""
    w = Window.partitionBy(*_KEY).orderBy("turn")
    before = F.last(F.when(F.col("role") != "tool", F.col("role")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("prev_role", before).withColumn("next_role", F.lead("role").over(w))


def hoisted(rows: DataFrame, bos: str = BOS, keep_thinking: bool = False, generation_prompt: bool = False, tools: list[str] | None = None) -> DataFrame:
    """Start and end markers around role and text. A leading system message and the tools come first, as one message;
    replies but the last lose what stands up to their last thinking marker, unless kept."""
    rows = last_turn(rows, "assistant", "_last").withColumn("_first", F.min("turn").over(Window.partitionBy(*_KEY)))
    leads = (F.col("turn") == F.col("_first")) & (F.col("role") == "system")
    text = F.col("text")
    if not keep_thinking:
        text = F.when((F.col("role") == "assistant") & (F.col("turn") != F.col("_last")), after_thinking(text)).otherwise(text)
    message = F.concat(F.lit(START), "role", F.lit("\n"), text, F.lit(f"{END}\n"))
    system = F.coalesce(F.max(F.when(leads, F.col("text"))).over(Window.partitionBy(*_KEY)), F.lit(""))
    if tools:
        system = F.concat(system, F.when(system != "", "\n").otherwise(""), F.lit(f"List of tools: [{', '.join(tools)}]"))
    rows = rows.withColumn("_system", system)
    head = F.concat(F.lit(bos), F.when(F.col("_system") != "", F.concat(F.lit(f"{START}system\n"), "_system", F.lit(f"{END}\n"))).otherwise(""))
    return _in_order(rows, F.when(~leads, message), head, F.lit(f"{START}assistant\n" if generation_prompt else ""))


def queries(rows: DataFrame, preserve_thinking: bool = False, generation_prompt: bool = False, thinking: bool = True) -> DataFrame:
    """Texts are stripped. A reply is split at its thinking marker; its reasoning is shown after the last user query, or
    everywhere if preserved. Successive tool results stand under one user turn. A conversation without a user query, an
    unknown role, or a system message that is not first is an error."""
    rows = rows.withColumn("text", strip("text"))
    w = Window.partitionBy(*_KEY)
    ordered = w.orderBy("turn")
    answer = F.startswith("text", F.lit("<tool_response>")) & F.endswith("text", F.lit("</tool_response>"))
    last_query = F.max(F.when((F.col("role") == "user") & ~answer, F.col("turn"))).over(w)
    rows = rows.withColumn("_query", last_query).withColumn("_first", F.min("turn").over(w)).withColumn("_before", F.lag("role").over(ordered)).withColumn("_after", F.lead("role").over(ordered))
    text, role = F.col("text"), F.col("role")
    split = F.contains(text, F.lit("</think>"))
    newlines = lambda c: F.regexp_replace(c, r"^\n+", "")
    reason = F.when(split, strip(newlines(F.element_at(F.split(F.regexp_replace(F.element_at(F.split(text, "</think>", -1), 1), r"\n+\z", ""), "<think>", -1), -1)))).otherwise("")
    reply = F.when(split, newlines(F.element_at(F.split(text, "</think>", -1), -1))).otherwise(text)
    shown = F.lit(True) if preserve_thinking else F.col("turn") > F.col("_query")
    tool = F.concat(F.when(F.col("_before").isNotNull() & (F.col("_before") != "tool"), f"{START}user").otherwise(""), F.lit("\n<tool_response>\n"), text, F.lit("\n</tool_response>"), F.when(F.col("_after").isNull() | (F.col("_after") != "tool"), f"{END}\n").otherwise(""))
    fail = lambda m: F.raise_error(F.lit(m)).cast("string")
    piece = (
        F.when(F.col("_query").isNull(), fail("no user query found"))
        .when((role == "system") & (F.col("turn") != F.col("_first")), fail("a system message must come first"))
        .when(role.isin("system", "user"), F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n")))
        .when(role == "assistant", F.concat(F.lit(f"{START}assistant\n"), F.when(shown, F.concat(F.lit("<think>\n"), reason, F.lit("\n</think>\n\n"))).otherwise(""), reply, F.lit(f"{END}\n")))
        .when(role == "tool", tool)
        .otherwise(fail("unexpected role"))
    )
    prompt = f"{START}assistant\n<think>\n" + ("" if thinking else "\n</think>\n\n")
    return _in_order(rows, piece, F.lit(""), F.lit(prompt if generation_prompt else ""))


def turns(rows: DataFrame, bos: str = TURNS_BOS, thinking: bool = False, generation_prompt: bool = False) -> DataFrame:
    """Turn markers; the assistant is called model, and successive replies stand in one turn. A leading system or
    developer message, and the thinking flag, come first. Tool rows are left out; texts are stripped."""
    w = Window.partitionBy(*_KEY)
    rows = rows.withColumn("_first", F.min("turn").over(w))
    leads = (F.col("turn") == F.col("_first")) & F.col("role").isin("system", "developer")
    rows = rows.withColumn("_lead", F.max(F.when(leads, strip("text"))).over(w)).withColumn("_leads", leads)
    body = rows.where(~F.col("_leads") & (F.col("role") != "tool"))
    before = F.lag("role").over(w.orderBy("turn"))
    body = body.withColumn("_before", before)
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    goes_on = (F.col("role") == "assistant") & (F.coalesce(F.col("_before"), F.lit("")) == "assistant")
    text = F.when(F.col("role") == "assistant", without_channels(F.col("text"))).otherwise(strip("text"))
    piece = F.concat(F.when(goes_on, "").otherwise(F.concat(F.lit(TURN), role, F.lit("\n"))), text, F.lit(f"{TURN_END}\n"))
    inner = F.concat(F.lit("<|think|>\n" if thinking else ""), F.coalesce("_lead", F.lit("")))
    head = F.concat(F.lit(bos), F.when(F.lit(thinking) | F.col("_lead").isNotNull(), F.concat(F.lit(f"{TURN}system\n"), inner, F.lit(f"{TURN_END}\n"))).otherwise(""))
    prompt = f"{TURN}model\n" + ("" if thinking else f"{CHANNEL}thought\n{CHANNEL_END}")
    only_lead = rows.where("_leads").withColumn("_before", F.lit(None).cast("string"))
    every = body.withColumn("_piece0", piece).unionByName(only_lead.withColumn("_piece0", F.lit(None).cast("string")))
    return _in_order(every, F.col("_piece0"), head, F.lit(prompt if generation_prompt else ""))


def assistant_characters(rows: DataFrame) -> DataFrame:
    """Code points that a model is trained on, and all code points, of each conversation."""
    size = F.length("text")
    return rows.groupBy(*_KEY).agg(F.coalesce(F.sum(F.when(F.col("role") == "assistant", size)), F.lit(0)).alias("assistant_chars"), F.coalesce(F.sum(size), F.lit(0)).alias("all_chars"))


def parse_response(text: Column) -> Column:
    """thinking, content and tool calls (name and raw arguments) of a model turn, as a struct; absent parts are null."""
    thought = F.regexp_extract(text, r"(?s)^<\|channel>thought\n(.*?)<channel\|>", 1)
    has = text.rlike(r"(?s)^<\|channel>thought\n.*?<channel\|>")
    rest = F.regexp_replace(text, r"(?s)^<\|channel>thought\n.*?<channel\|>", "")
    calls = F.regexp_extract(rest, r"(?s)^(<\|tool_call>.*<tool_call\|>)", 1)
    content = F.regexp_extract(F.when(calls != "", F.substr(rest, F.length(calls) + 1)).otherwise(rest), r"(?s)^((?:(?!<turn\|>)(?!<\|tool_response>).)+)", 1)
    each = F.regexp_extract_all(calls, F.lit(r"(?s)<\|tool_call>(.*?)<tool_call\|>"), F.lit(1))
    parsed = F.transform(each, lambda c: F.struct(F.regexp_extract(c, r"(?s)call:(\w+)(\{.*\})", 1).alias("name"), F.regexp_extract(c, r"(?s)call:(\w+)(\{.*\})", 2).alias("arguments")))
    return F.struct(F.when(has, thought).alias("thinking"), F.when(content != "", content).alias("content"), parsed.alias("tool_calls"))
