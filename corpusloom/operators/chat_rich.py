"""Transcripts of rich messages: content in parts, thinking, tools, tool calls and their results.

Messages are a JSON column (a list of objects), since their shape is open. They are read into turns of typed pieces
(text, media, thought, calls, result); a style moves and drops pieces and shows what is left by its table of formats.
One Arrow UDF renders a column in one of the four styles of corpusloom.operators.chat; plain conversations are rendered
there on the JVM. A message list that a style refuses gives an error, or a null with strict=False."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.operators.chat import BOS, CHANNEL, CHANNEL_END, END, START, TURN, TURN_END, TURNS_BOS

# Texts and markers of the formats.
QUOTE = '<|"|>'
CALL_START, CALL_END = "<|tool_call_start|>", "<|tool_call_end|>"
VISION = {"image": "<|vision_start|><|image_pad|><|vision_end|>", "video": "<|vision_start|><|video_pad|><|vision_end|>"}
MEDIA = {"image": "<|image|>", "audio": "<|audio|>", "video": "<|video|>"}
TOOLS_HEAD = "# Tools\n\nYou have access to the following functions:\n\n<tools>"
TOOLS_TAIL = """
</tools>

If you choose to call a function ONLY reply in the following format with NO suffix:

<tool_call>
<function=example_function_name>
<parameter=example_parameter_1>
value_1
</parameter>
<parameter=example_parameter_2>
This is the value for the second parameter
that can span
multiple lines
</parameter>
</function>
</tool_call>

<IMPORTANT>
Reminder:
- Function calls MUST follow the specified format: an inner <function=...></function> block must be nested within <tool_call></tool_call> XML tags
- Required parameters MUST be specified
- You may provide optional reasoning for your function call in natural language BEFORE the function call, but NOT after
- If there is no function call available, answer the question like normal with your current knowledge and do not tell the user about function calls
</IMPORTANT>"""


@dataclass(frozen=True)
class Options:
    tools: list = field(default_factory=list)
    generation_prompt: bool = False
    keep_thinking: bool = False
    thinking: bool | None = None
    continue_final: bool = False
    vision_ids: bool = False
    today: str = ""
    bos: str | None = None


@dataclass
class Piece:
    """What a turn shows: text, thought, calls (value: name and arguments of each), result (value), a medium, or other."""

    kind: str
    text: str = ""
    value: Any = None


@dataclass
class Turn:
    role: str
    place: int
    message: dict
    pieces: list[Piece]

    def has(self, kind: str) -> bool:
        return any(p.kind == kind for p in self.pieces)

    def show(self, formats: dict[str, Callable[[Piece], str]]) -> str:
        return "".join(formats[p.kind](p) for p in self.pieces)


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def read(messages: list[dict], kind_of: Callable[[dict], str | None]) -> list[Turn]:
    """Messages as turns of the pieces of their content; parts without a kind are left out."""
    out = []
    for place, m in enumerate(messages):
        content = m.get("content")
        if isinstance(content, str):
            pieces = [Piece("text", content)]
        elif content is None or isinstance(content, list):
            pieces = [Piece(kind, p["text"] if kind == "text" else "", p) for p in content or [] if (kind := kind_of(p))]
        else:
            raise ValueError("unexpected content")
        out.append(Turn(m["role"], place, m, pieces))
    return out


def calls_of(message: dict) -> list[Piece]:
    """The message's tool calls as one piece, if it has any."""
    found = [call.get("function", call) for call in message.get("tool_calls") or []]
    return [Piece("calls", value=[(f["name"], f.get("arguments")) for f in found])] if found else []


def last_of(turns: list[Turn], role: str) -> int:
    return max((t.place for t in turns if t.role == role), default=-1)


def _message(role: str, body: str) -> str:
    return f"{START}{role}\n{body}{END}\n"


def _drop_thinking(text: str) -> str:
    return text.rpartition("</think>")[2].strip() if "</think>" in text else text


# The two plain styles: a leading system message and tools in one block, then a block a message.


def _plain_kind(part: dict) -> str:
    return part.get("type") if part.get("type") in ("text", "image") else "other"


def _python_call(call: tuple[str, dict]) -> str:
    shown = ((k, f'"{v}"' if isinstance(v, str) else dumps(v) if isinstance(v, dict) else str(v)) for k, v in (call[1] or {}).items())
    return f"{call[0]}({', '.join(f'{k}={v}' for k, v in shown)})"


PLAIN: dict[str, Callable[[Piece], str]] = {
    "text": lambda p: p.text,
    "image": lambda p: "<image>",
    "other": lambda p: dumps(p.value),
    "thought": lambda p: f"<think>{p.text}</think>",
    "calls": lambda p: f"{CALL_START}[{', '.join(map(_python_call, p.value))}]{CALL_END}",
}


def _lead(turns: list[Turn]) -> tuple[Turn | None, list[Turn]]:
    return (turns[0], turns[1:]) if turns and turns[0].role == "system" else (None, turns)


def hoisted(messages: list[dict], o: Options) -> str:
    lead, turns = _lead(read(messages, _plain_kind))
    blocks = ["".join(p.text for p in lead.pieces)] if lead else []
    if o.tools:
        blocks.append(f"List of tools: [{', '.join(t if isinstance(t, str) else dumps(t) for t in o.tools)}]")
    system = "\n".join(filter(None, blocks))
    out = [BOS if o.bos is None else o.bos, _message("system", system) if system else ""]
    last = last_of(turns, "assistant")
    for t in turns:
        body = t.show(PLAIN)
        out.append(_message(t.role, _drop_thinking(body) if t.role == "assistant" and t.place != last and not o.keep_thinking else body))
    return "".join(out) + (f"{START}assistant\n" if o.generation_prompt else "")


def rich_spans(messages: list[dict], o: Options) -> list[tuple[str, bool]]:
    """Pieces of the transcript, and whether a model is trained on them."""
    lead, turns = _lead(read(messages, _plain_kind))
    blocks = [lead.show(PLAIN)] if lead else []
    if o.tools:
        blocks += [f"Today's date: {o.today}", f"List of tools: {dumps(o.tools)}"]
    system = "\n\n".join(filter(None, blocks))
    out = [((BOS if o.bos is None else o.bos) + (_message("system", system) if system else ""), False)]
    last = last_of(turns, "assistant")
    for t in turns:
        body, end = t.show(PLAIN), f"{END}\n" if "content" in t.message else ""
        out.append((f"{START}{t.role}\n", False))
        if t.role == "assistant":
            whole = o.keep_thinking or t.place == last
            thought = [Piece("thought", t.message["thinking"])] if whole and "thinking" in t.message else []
            before = "".join(PLAIN[p.kind](p) for p in thought + calls_of(t.message))
            left_open = o.continue_final and t is turns[-1]
            out.append((before + (body if whole else _drop_thinking(body)) + ("" if left_open else end), True))
        elif end:
            out.append((body + end, False))
    return out + [(f"{START}assistant\n", False)] * o.generation_prompt


def rich(messages: list[dict], o: Options) -> str:
    return "".join(text for text, _ in rich_spans(messages, o))


# The style of queries: thoughts after the last query alone, calls and results as XML, results under a user turn.


def _visual_kind(part: dict) -> str:
    for kind, keys in (("image", ("image", "image_url")), ("video", ("video",))):
        if part.get("type") == kind or any(k in part for k in keys):
            return kind
    if "text" not in part:
        raise ValueError("unexpected part")
    return "text"


def _xml_call(call: tuple[str, dict]) -> str:
    values = "".join(f"<parameter={k}>\n{v if isinstance(v, str) else dumps(v)}\n</parameter>\n" for k, v in (call[1] or {}).items())
    return f"<tool_call>\n<function={call[0]}>\n{values}</function>\n</tool_call>"


def _xml_result(text: str) -> str:
    return f"\n<tool_response>\n{text}\n</tool_response>"


def _number_media(turns: list[Turn], shown: bool) -> None:
    """Media become text, numbered by kind over the whole transcript if shown."""
    seen: Counter = Counter()
    for t in turns:
        for p in t.pieces:
            if p.kind != "text":
                seen[p.kind] += 1
                title = {"image": "Picture", "video": "Video"}[p.kind]
                p.kind, p.text = "text", (f"{title} {seen[p.kind]}: " if shown else "") + VISION[p.kind]


def _thought_apart(t: Turn, text: str) -> tuple[str, str]:
    """Thought and answer: from the message's own field, or cut out of the text."""
    if isinstance(own := t.message.get("reasoning_content"), str):
        return own.strip(), text
    thought, mark, _ = text.partition("</think>")
    if not mark:
        return "", text
    return thought.rpartition("<think>")[2].strip(), text.rpartition("</think>")[2].lstrip("\n")


def queries(messages: list[dict], o: Options) -> str:
    turns = read(messages, _visual_kind)
    if any(t.role == "system" and (t.place or any(p.kind != "text" for p in t.pieces)) for t in turns):
        raise ValueError("a system message must come first and be text")
    _number_media(turns, o.vision_ids)
    text = {t.place: "".join(p.text for p in t.pieces).strip() for t in turns}
    answer = lambda x: x.startswith("<tool_response>") and x.endswith("</tool_response>")
    asked = max((t.place for t in turns if t.role == "user" and not answer(text[t.place])), default=None)
    if asked is None:
        raise ValueError("no user query found")

    def assistant(t: Turn) -> str:
        thought, rest = _thought_apart(t, text[t.place])
        lead = f"<think>\n{thought}\n</think>\n\n" if o.keep_thinking or t.place > asked else ""
        xml = "\n".join(_xml_call(c) for p in calls_of(t.message) for c in p.value)
        return _message("assistant", lead + rest + ("\n\n" if xml and rest.strip() else "") + xml)

    def results(run: list[Turn]) -> str:
        # results that nothing precedes have no turn's start
        return (f"{START}user" if run[0].place else "") + "".join(_xml_result(text[t.place]) for t in run) + f"{END}\n"

    blocks: dict[str, Callable[[list[Turn]], str]] = {
        "system": lambda run: "" if o.tools else _message("system", text[0]),
        "user": lambda run: "".join(_message("user", text[t.place]) for t in run),
        "assistant": lambda run: "".join(map(assistant, run)),
        "tool": results,
    }
    out = []
    if o.tools:
        first = [text[0]] if turns[0].role == "system" and text[0] else []
        out.append(_message("system", "\n\n".join([TOOLS_HEAD + "".join(f"\n{dumps(t)}" for t in o.tools) + TOOLS_TAIL, *first])))
    for role, run in groupby(turns, key=lambda t: t.role):
        if role not in blocks:
            raise ValueError("unexpected role")
        out.append(blocks[role](list(run)))
    if o.generation_prompt:
        out.append(f"{START}assistant\n<think>\n" + ("\n</think>\n\n" if o.thinking is False else ""))
    return "".join(out)


# The style of turns: calls with their results in the model's turn, values in a notation of its own.


def _quoted(text) -> str:
    return f"{QUOTE}{text}{QUOTE}"


def _by_key(d: dict) -> list[tuple]:
    return sorted(d.items(), key=lambda x: str(x[0]).lower())


def argument(value, quoted_keys: bool = True) -> str:
    """A value: texts in quotes, objects by key."""
    if isinstance(value, dict):
        return "{" + _arguments(value, quoted_keys) + "}"
    if isinstance(value, list):
        return f"[{','.join(argument(v, quoted_keys) for v in value)}]"
    return _quoted(value) if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _arguments(values: dict, quoted_keys: bool = False) -> str:
    return ",".join(f"{_quoted(k) if quoted_keys else k}:{argument(v, quoted_keys)}" for k, v in _by_key(values))


def _names(values: list) -> str:
    return f"[{','.join(map(_quoted, values))}]"


def _kind(node: dict) -> str:
    return str(node.get("type") or "").upper()


def _members(children: dict) -> str:
    """Named schemas, each with its fields in the order of SCHEMA."""
    return "{" + ",".join(f"{name}:{{{','.join(_fields(node))}}}" for name, node in _by_key(children)) + "}"


def _children(node: dict) -> dict:
    """An object's members; without a table of them, all its keys that hold schemas and are no fields of its own."""
    own = node.get("properties")
    return own if isinstance(own, dict) else {k: v for k, v in node.items() if isinstance(v, dict) and k not in OWN_FIELDS}


def _element(items: dict) -> str:
    """The schema of an array's elements: all its keys, those of FORMS in their form, others as values."""
    return "{" + ",".join(f"{k}:{ELEMENT_FORMS.get(k, argument)(v)}" for k, v in _by_key(items) if v is not None) + "}"


# Fixed order of the fields of a schema: name, the types that have it (none: all), and its form, null where it is left out.
SCHEMA: list[tuple[str, str | None, Callable[[dict], str | None]]] = [
    ("description", None, lambda n: _quoted(n["description"]) if n.get("description") else None),
    ("enum", "STRING", lambda n: argument(n["enum"]) if n.get("enum") else None),
    ("items", "ARRAY", lambda n: _element(n["items"]) if isinstance(n.get("items"), dict) and n["items"] else None),
    ("nullable", None, lambda n: "true" if n.get("nullable") else None),
    ("properties", "OBJECT", lambda n: _members(_children(n))),
    ("required", "OBJECT", lambda n: _names(n["required"]) if n.get("required") else None),
    ("type", None, lambda n: _quoted(_kind(n))),
]
OWN_FIELDS = {"description", "type", "properties", "required", "nullable"}
ELEMENT_FORMS: dict[str, Callable[[Any], str]] = {
    "properties": lambda v: _members(v if isinstance(v, dict) else {}),
    "required": _names,
    "type": lambda v: argument(v.upper() if isinstance(v, str) else [x.upper() for x in v]),
}


def _fields(node: dict) -> Iterator[str]:
    for name, only, form in SCHEMA:
        if only in (None, _kind(node)) and (shown := form(node)) is not None:
            yield f"{name}:{shown}"


def _typed_block(name: str, fields: dict[str, str], kind: str) -> str:
    """A tool's own block; it is closed by its type, and stays open without one."""
    return f",{name}:{{" + "".join(f"{k}:{v}," for k, v in fields.items()) + (f"type:{_quoted(kind)}}}" if kind else "")


def declaration(tool: dict) -> str:
    f = tool["function"]
    out = f"declaration:{f['name']}{{description:{_quoted(f['description'])}"
    if p := f.get("parameters"):
        out += _typed_block("parameters", {k: form(p[k]) for k, form in (("properties", _members), ("required", _names)) if p.get(k)}, _kind(p))
    if "response" in f:
        r = f["response"]
        out += _typed_block("response", {"description": _quoted(r["description"])} if r.get("description") else {}, "OBJECT" if _kind(r) == "OBJECT" else "")
    return out + "}"


def _without_channels(text: str) -> str:
    return "".join(p.partition(CHANNEL)[0] for p in text.split(CHANNEL_END)).strip()


def _turn_call(call: tuple[str, Any]) -> str:
    name, given = call
    return f"<|tool_call>call:{name}{{{_arguments(given) if isinstance(given, dict) else given if isinstance(given, str) else ''}}}<tool_call|>"


def _turn_result(p: Piece) -> str:
    name, value = p.value
    return f"<|tool_response>response:{name}{{{_arguments(value if isinstance(value, dict) else {'value': value})}}}<tool_response|>" + p.text


TURNS: dict[str, Callable[[Piece], str]] = {
    "text": lambda p: p.text,
    "thought": lambda p: f"{CHANNEL}thought\n{p.text}\n{CHANNEL_END}",
    "calls": lambda p: "".join(map(_turn_call, p.value)),
    "result": _turn_result,
} | {kind: (lambda p, mark=mark: mark) for kind, mark in MEDIA.items()}


def _media_kind(part: dict) -> str | None:
    return part.get("type") if part.get("type") in ("text", *MEDIA) else None


def _answer(turn: Turn, names: dict) -> Piece:
    """A tool's message as a result of the call with its id; media stand after it."""
    name = names.get(turn.message.get("tool_call_id"), turn.message.get("name", "unknown"))
    if not isinstance(turn.message.get("content"), list):
        return Piece("result", value=(name, turn.message.get("content")))
    return Piece("result", "".join(MEDIA.get(p.kind, "") for p in turn.pieces), (name, "".join(p.text for p in turn.pieces)))


def _with_results(turns: list[Turn]) -> list[Turn]:
    """Turns without those of tools: each becomes a result in the turn whose calls come right before it."""
    out: list[Turn] = []
    for is_tool, run in groupby(turns, key=lambda t: t.role == "tool"):
        if not is_tool:
            out += run
        elif out and out[-1].has("calls") and not out[-1].has("result"):
            names = {c.get("id"): c["function"]["name"] for c in out[-1].message["tool_calls"]}
            at = 1 + next(i for i, p in enumerate(out[-1].pieces) if p.kind == "calls")
            out[-1].pieces[at:at] = [_answer(t, names) for t in run]
    return out


def _turn_head(lead: Turn | None, o: Options) -> str:
    content = lead.message.get("content") if lead else None
    # of parts, each text is followed by a space
    said = content.strip() if isinstance(content, str) else "".join(f"{p['text'].strip()} " for p in content or [])
    tools = "".join(f"<|tool>{declaration(t).strip()}<tool|>" for t in o.tools)
    return ("<|think|>\n" if o.thinking else "") + said + tools


def turns(messages: list[dict], o: Options) -> str:
    found = read(messages, _media_kind)
    lead = found.pop(0) if found and found[0].role in ("system", "developer") else None
    out = [TURNS_BOS if o.bos is None else o.bos]
    if o.thinking or o.tools or lead:
        out.append(f"{TURN}system\n{_turn_head(lead, o)}{TURN_END}\n")
    asked = last_of(found, "user")
    for t in (t for t in found if t.role != "tool"):
        for p in t.pieces:
            p.text = _without_channels(p.text) if t.role == "assistant" else p.text.strip()
        calls = calls_of(t.message)
        thought = t.message.get("reasoning") or t.message.get("reasoning_content")
        given = [Piece("result", value=(r.get("name", "unknown"), r["response"])) for r in t.message.get("tool_responses") or []]
        t.pieces[:0] = [Piece("thought", thought)] * bool(thought and calls and t.place > asked) + calls + given
    found, tail = _with_results(found), None
    for before, t in zip([None, *found], found):
        if not (before and before.role == t.role == "assistant"):
            out.append(f"{TURN}{'model' if t.role == 'assistant' else t.role}\n")
        out.append(t.show(TURNS))
        # the last piece that is no text tells whether something is still to come
        tail = next((p.kind for p in reversed(t.pieces) if p.kind not in ("text", "thought")), None)
        said = any((p.kind == "text" and p.text) or p.kind in MEDIA for p in t.pieces)
        if tail == "calls":
            out.append("<|tool_response>")
        elif said or not t.has("result"):
            out.append(f"{TURN_END}\n")
    if o.generation_prompt and tail not in ("calls", "result"):
        out.append(f"{TURN}model\n" + ("" if o.thinking else f"{CHANNEL}thought\n{CHANNEL_END}"))
    return "".join(out)


STYLES: dict[str, Callable[[list[dict], Options], str]] = {"hoisted": hoisted, "rich": rich, "queries": queries, "turns": turns}


def render(messages: Column, style: str, options: Options | None = None, strict: bool = True) -> Column:
    """Transcripts of a JSON column of message lists."""
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}")
    options = options or Options()

    @F.pandas_udf(StringType())
    def run(column: pd.Series) -> pd.Series:
        out = []
        for raw in column:
            try:
                out.append(None if raw is None else STYLES[style](json.loads(raw), options))
            except (ValueError, KeyError, TypeError):
                if strict:
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(messages)


def trained_spans(messages: list[dict], options: Options | None = None) -> list[tuple[int, int]]:
    """Character ranges of a rich transcript that a model is trained on."""
    out, at = [], 0
    for text, trained in rich_spans(messages, options or Options()):
        if trained:
            out.append((at, at + len(text)))
        at += len(text)
    return out
