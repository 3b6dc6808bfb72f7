"""Chat formatting by schema fingerprints.

The nested field paths of a record (``messages[].role``) are hashed; the digest selects a declarative mapping from that
layout to canonical turns (conversation, turn number, role, text). Layouts come as DataFrames, whose schema is
fingerprinted once, or as JSON records of mixed layouts in one column, fingerprinted one by one.

Canonical turns are rendered with a template that marks turns and escapes its own control strings inside texts: a backslash
goes before every backslash and after the first character of every control string, so no control string of a text survives
in the output, and taking the backslashes out again restores it. The output has one row a turn, in order; a conversation is
the concatenation of its segments, so its length is not bounded by a row. The loss mask is a range of code points of
each segment: the assistant's text, without marks.

Defined results: null text or role is empty. Turns with equal numbers are ordered by role, then text; repeated rows are turns
each. A null conversation id is one conversation. Unknown layouts are returned by ``json_turns`` with the fingerprint and no
turns (status ``unknown``), and raise ValueError for DataFrames; a record whose turns lack a field or hold something else
than text is ``broken``. Columns of a DataFrame that no layout names are ignored, also when turns are rendered; a column that
another layout names makes the layout unknown. Roles of turn rows stay as they are, those of other layouts get common names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: role -> what stands before and after its text. Fixed template.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[REPLY] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
BEGIN = "<s>"
OTHER = ("[TURN ", "] ", " [/TURN]")
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[REPLY]", "[/REPLY]", "[SYS]", "[/SYS]", "[TURN", "[/TURN]")
LOSS_ROLE = "assistant"

_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: m[1], text)


def _role(role: str) -> str:
    return escape(role).replace("]", "\\]")


def render(role: str, text: str, first: bool) -> tuple[str, int, int]:
    """(segment, start and end of its loss mask)."""
    before, after = MARKS.get(role) or (f"{OTHER[0]}{_role(role)}{OTHER[1]}", OTHER[2])
    head = BEGIN * first + before
    body = escape(text)
    start, end = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
    return head + body + after, start, end


_OTHER_HEAD = re.compile(r"\[TURN ((?:[^\\\]]|\\.)*)\] ", re.DOTALL).match


def read(segment: str) -> tuple[str, str]:
    """(role, text) back from a segment."""
    at = len(BEGIN) if segment.startswith(BEGIN) else 0
    for role, (before, after) in MARKS.items():
        if segment.startswith(before, at) and segment.endswith(after):
            return role, unescape(segment[at + len(before) : len(segment) - len(after)])
    if (m := _OTHER_HEAD(segment, at)) and segment.endswith(OTHER[2]):
        return unescape(m[1].replace("\\]", "]")), unescape(segment[m.end() : len(segment) - len(OTHER[2])])
    raise ValueError("not a segment of this template")


# -- layouts -----------------------------------------------------------------------------------------------------------


def paths_of_type(kind: T.DataType, path: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of_type(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of_type(kind.elementType, f"{path}[]")
    return [path]


def paths_of_value(value: object, path: str = "") -> list[str]:
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in paths_of_value(v, f"{path}.{k}" if path else str(k))]
    if isinstance(value, list):
        return [p for v in value for p in paths_of_value(v, f"{path}[]")] or [f"{path}[]"]
    return [path]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


#: Declarative mappings: the layout's field paths, and where its turns are. "each" is a list of records with a role and
#: a text field; "fields" gives one turn a field (or the non-empty ones of several, joined by an empty line); "rows" is
#: one turn a row. Roles are renamed as listed.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
LAYOUTS: tuple[dict, ...] = (
    {"name": "turn rows", "paths": ("conv_id", "turn", "role", "text"), "rows": ("turn", "role", "text")},
    {"name": "messages", "paths": ("conv_id", "messages[].role", "messages[].content"), "each": ("messages", "role", "content")},
    {"name": "conversations", "paths": ("conv_id", "conversations[].from", "conversations[].value"), "each": ("conversations", "from", "value")},
    {"name": "prompt and response", "paths": ("conv_id", "prompt", "response"), "fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "prompt and completion", "paths": ("conv_id", "prompt", "completion"), "fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    {"name": "instruction", "paths": ("conv_id", "instruction", "output"), "fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    {"name": "instruction and input", "paths": ("conv_id", "instruction", "input", "output"), "fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"name": "system, prompt and response", "paths": ("conv_id", "system", "prompt", "response"), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
)
BY_FINGERPRINT = {fingerprint(list(x["paths"])): x for x in LAYOUTS}
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _named(role):
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(names[role], role, F.lit(""))


def to_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table whose schema has a known fingerprint; DataFrame operations only."""
    known = {p.split("[")[0] for x in LAYOUTS for p in x["paths"]}
    layout = BY_FINGERPRINT.get(fingerprint(paths_of_type(T.StructType([f for f in df.schema.fields if f.name in known]))))
    if layout is None:
        raise ValueError(f"no mapping for a layout with the fields {sorted(paths_of_type(df.schema))}")
    key = F.col("conv_id").cast("long").alias("conv_id")
    if "rows" in layout:
        turn, role, text = layout["rows"]
        return df.select(key, F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if "each" in layout:
        items, role, text = layout["each"]
        each = df.select(key, F.posexplode(items).alias("turn", "item"))
        return each.select("conv_id", F.col("turn").cast("long"), _named(F.col("item")[role]).alias("role"), F.coalesce(F.col("item")[text], F.lit("")).alias("text"))
    parts = []
    for number, (role, fields) in enumerate(layout["fields"]):
        filled = F.filter(F.array(*fields), lambda x: x.isNotNull() & (x != ""))
        parts.append(F.struct(F.lit(number).cast("long").alias("turn"), F.lit(role).alias("role"), F.array_join(filled, "\n\n").alias("text")))
    return df.select(key, F.explode(F.array(*parts)).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def turns_of_record(record: dict) -> list[tuple[str, str]] | None:
    """(role, text) of each turn of one decoded record; None without a mapping. Raises ValueError if a turn lacks its role or
    text, or they are no text."""
    layout = BY_FINGERPRINT.get(fingerprint([*paths_of_value({k: v for k, v in record.items() if k != "conv_id"}), "conv_id"]))
    if layout is None or "rows" in layout:
        return None
    if "each" in layout:
        items, role, text = layout["each"]
        return [(ROLE_NAMES.get(_text_of(x, role), _text_of(x, role)), _text_of(x, text)) for x in record[items]]
    return [(role, "\n\n".join(filter(None, (_text_of(record, f) for f in fields)))) for role, fields in layout["fields"]]


def _text_of(record: object, name: str) -> str:
    if not isinstance(record, dict) or name not in record:
        raise ValueError(f"no field {name!r}")
    value = record[name]
    if value is not None and not isinstance(value, str):
        raise ValueError(f"{name!r} is no text")
    return value or ""


def json_turns(df: DataFrame, key: str = "conv_id", column: str = "record") -> DataFrame:
    """(conv_id, turn, role, text, fingerprint, status) of JSON records of any layouts; a record that has no mapping or is
    no JSON object gives one row without a turn and the status ``unknown`` or ``broken``."""
    schema = T.StructType([*TURNS.fields, T.StructField("fingerprint", T.StringType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(text or "")
                    if not isinstance(record, dict):
                        raise ValueError("not an object")
                except ValueError:
                    rows.append((conv, None, None, None, None, "broken"))
                    continue
                mark = fingerprint([*paths_of_value({k: v for k, v in record.items() if k != "conv_id"}), "conv_id"])
                try:
                    turns = turns_of_record(record)
                except ValueError:
                    rows.append((conv, None, None, None, mark, "broken"))
                    continue
                if turns is None:
                    rows.append((conv, None, None, None, mark, "unknown"))
                rows += [(conv, i, role, said, mark, "ok") for i, (role, said) in enumerate(turns or ())]
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 4)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return df.select(F.col(key).cast("long"), column).mapInArrow(run, schema)


# -- rendering ---------------------------------------------------------------------------------------------------------

SEGMENTS = "conv_id long, turn long, segment string, start long, loss_start long, loss_end long"
_NO = object()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, at = _NO, 0
    for batch in batches:
        segments, starts, masks = [], [], []
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if first := conv != now:
                now, at = conv, 0
            segment, a, z = render(role or "", text or "", first)
            segments.append(segment)
            starts.append(at)
            masks.append((at + a, at + z))
            at += len(segment)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(segments, pa.string()), pa.array(starts, pa.int64()), pa.array([a for a, _ in masks], pa.int64()), pa.array([z for _, z in masks], pa.int64())],
            names=["conv_id", "turn", "segment", "start", "loss_start", "loss_end"],
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """Segments of canonical turns, a conversation's in order in one partition; start and loss mask count code points of
    the whole conversation. A task streams: it holds one turn, not a conversation."""
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_render, SEGMENTS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now, state = _NO, None
    for batch in batches:
        done = []
        columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)]
        for conv, segment, start, loss_start, loss_end in zip(*columns, strict=True):
            if conv != now:
                if state:
                    done.append(_closed(now, state))
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            said = unescape(segment[loss_start - start : loss_end - start])
            state[2] += len(said)
            state[3].update(said.encode())
            state[4] += len(segment)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(_closed(now, state), kinds, strict=True)], names=names)


def _closed(conv, state) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the segments alone; they must
    lie as ``format_turns`` leaves them."""
    return segments.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
