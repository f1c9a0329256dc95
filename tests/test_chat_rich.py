import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chat
from corpusloom.operators import chat_rich as R

CALL = {"id": "c1", "function": {"name": "add", "arguments": {"b": 2, "A": "x", "c": {"k": True}}}}


def test_plain_messages_render_as_on_the_jvm(spark):
    rows = [(1, [("system", "S"), ("user", "u"), ("assistant", "<think>t</think> a "), ("user", "v"), ("assistant", "<think>t2</think>b")]), (2, [("user", " q "), ("assistant", "x<|channel>c<channel|>y"), ("assistant", "z")])]
    flat = spark.createDataFrame([(c, i, r, t) for c, ms in rows for i, (r, t) in enumerate(ms)], "conv_id long, turn long, role string, text string")
    nested = spark.createDataFrame([(c, json.dumps([{"role": r, "content": t} for r, t in ms])) for c, ms in rows], "conv_id long, messages string")
    for style, native in (("hoisted", chat.hoisted), ("queries", chat.queries), ("turns", chat.turns)):
        want = {r.conv_id: r.transcript for r in native(flat, generation_prompt=True).collect()}
        got = {r.conv_id: r.t for r in nested.select("conv_id", R.render(F.col("messages"), style, R.Options(generation_prompt=True)).alias("t")).collect()}
        assert got == want, style


def test_hoisted_and_rich_parts_and_calls():
    parts = [{"type": "text", "text": "see "}, {"type": "image"}, {"type": "x", "v": "é"}]
    assert R.hoisted([{"role": "user", "content": parts}], R.Options()) == '<|startoftext|><|im_start|>user\nsee <image>{"type": "x", "v": "é"}<|im_end|>\n'
    messages = [{"role": "user", "content": "q"}, {"role": "assistant", "thinking": "hm", "tool_calls": [CALL], "content": "ok"}]
    o = R.Options(tools=[{"name": "add"}], today="2020-01-02")
    want = '<|startoftext|><|im_start|>system\nToday\'s date: 2020-01-02\n\nList of tools: [{"name": "add"}]<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>hm</think><|tool_call_start|>[add(b=2, A="x", c={"k": true})]<|tool_call_end|>ok<|im_end|>\n'
    assert R.rich(messages, o) == want
    ((a, b),) = R.trained_spans(messages, o)
    assert want[a:b].startswith("<think>hm") and b == len(want)
    assert R.rich(messages, R.Options(continue_final=True)).endswith("ok")
    earlier = [*messages, {"role": "assistant", "content": "end"}]
    assert "<think>hm" not in R.rich(earlier, R.Options()) and "<think>hm" in R.rich(earlier, R.Options(keep_thinking=True))


def test_queries_tools_and_vision():
    ms = [{"role": "system", "content": "S"}, {"role": "user", "content": [{"type": "image"}, {"text": "what"}]}, {"role": "assistant", "reasoning_content": " r ", "content": "", "tool_calls": [CALL, {"name": "z"}]}, {"role": "tool", "content": "1"}]
    out = R.queries(ms, R.Options(tools=[{"n": 1}], vision_ids=True, generation_prompt=True, thinking=False))
    assert out.startswith("<|im_start|>system\n# Tools\n") and '<tools>\n{"n": 1}\n</tools>' in out and out.count("</IMPORTANT>\n\nS<|im_end|>") == 1
    assert "Picture 1: <|vision_start|><|image_pad|><|vision_end|>what" in out
    assert '<think>\nr\n</think>\n\n<tool_call>\n<function=add>\n<parameter=b>\n2\n</parameter>\n<parameter=A>\nx\n</parameter>\n<parameter=c>\n{"k": true}\n</parameter>\n</function>\n</tool_call>\n<tool_call>\n<function=z>\n</function>\n</tool_call><|im_end|>' in out
    assert out.endswith("<|im_start|>user\n<tool_response>\n1\n</tool_response><|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n")
    for bad in ([], [{"role": "assistant", "content": "x"}], [{"role": "system", "content": [{"type": "image"}]}, {"role": "user", "content": "x"}], [{"role": "user", "content": 5}]):
        with pytest.raises(ValueError):
            R.queries(bad, R.Options())


def test_turns_tools():
    tool = {"function": {"name": "f", "description": "d", "parameters": {"type": "object", "required": ["s"], "properties": {"s": {"type": "string", "description": "q", "enum": ["a"]}, "l": {"type": "array", "items": {"type": "integer"}}, "o": {"type": "object", "nullable": True, "properties": {"x": {"type": "number"}}, "required": ["x"]}}}}}
    q = R.QUOTE
    assert R.declaration(tool) == (
        f"declaration:f{{description:{q}d{q},parameters:{{properties:{{l:{{items:{{type:{q}INTEGER{q}}},type:{q}ARRAY{q}}},o:{{nullable:true,properties:{{x:{{type:{q}NUMBER{q}}}}},required:[{q}x{q}],type:{q}OBJECT{q}}},"
        f"s:{{description:{q}q{q},enum:[{q}a{q}],type:{q}STRING{q}}}}},required:[{q}s{q}],type:{q}OBJECT{q}}}}}"
    )
    ms = [{"role": "user", "content": "u"}, {"role": "assistant", "content": "", "reasoning": "why", "tool_calls": [CALL]}, {"role": "tool", "tool_call_id": "c1", "content": "3"}, {"role": "assistant", "content": "done"}]
    out = R.turns(ms, R.Options(generation_prompt=True))
    assert out == f"<bos><|turn>user\nu<turn|>\n<|turn>model\n<|channel>thought\nwhy\n<channel|><|tool_call>call:add{{A:{q}x{q},b:2,c:{{k:true}}}}<tool_call|><|tool_response>response:add{{value:{q}3{q}}}<tool_response|>done<turn|>\n<|turn>model\n<|channel>thought\n<channel|>"
    assert R.turns(ms[:2], R.Options(generation_prompt=True)).endswith("<tool_call|><|tool_response>")


def test_strict(spark):
    rows = spark.createDataFrame([("not json",), (None,), ("[]",)], "m string")
    assert [r.t for r in rows.select(R.render(F.col("m"), "queries", strict=False).alias("t")).collect()] == [None, None, None]
    with pytest.raises(Exception):
        rows.select(R.render(F.col("m"), "queries")).collect()
