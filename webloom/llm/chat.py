"""Chat formatting.

Records of different layouts are recognised by a fingerprint: the hash of their sorted nested field paths.  The fingerprint
selects a declarative mapping that says where the turns are and which fields hold the role and the text.  Turns are rendered
with a template whose control strings cannot appear in a text, because they are escaped there reversibly.

A record that fits no layout, or holds something else than strings where its layout has them, gives no turns; ``canonical_turns``
lists these records, so none is lost.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import tidy

#: Role names of other layouts and their canonical forms.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Control strings of this and other common chat templates; escaped inside texts.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """A backslash goes after the first character of each control string; backslashes are doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _role_out(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _role_in(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list field with role and text fields, or fields that are one turn each."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)

    def read(self, record: dict) -> list[tuple[str, str]]:
        """Canonical turns; TypeError if the record holds something else than strings (or nulls) where they are."""
        if self.turns is not None:
            rows = [record] if not self.turns else record.get(self.turns) or []
            return [(ROLE_NAMES.get(role := _string(r.get(self.role)), role), _string(r.get(self.text))) for r in map(_object, rows) if r is not None]
        out: list[tuple[str, str]] = []
        for field, role in self.fixed:
            text = _string(record.get(field))
            if role.startswith("+"):  # goes on with the turn before it
                if text and out:
                    out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{text}")
            elif text or role != "system":
                out.append((role, text))
        return out


def _string(x: object) -> str:
    """Null as empty; halves of surrogate pairs, which no text can hold, as the replacement character."""
    if x is None:
        return ""
    if not isinstance(x, str):
        raise TypeError("no string")
    return x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _object(x: object) -> dict | None:
    if x is not None and not isinstance(x, dict):
        raise TypeError("no object")
    return x


def _paths(x: object, at: str = "") -> set[str]:
    if isinstance(x, dict):
        return {p for k, v in x.items() for p in _paths(v, f"{at}.{k}" if at else k)} or {at}
    if isinstance(x, list):
        return {p for v in x for p in _paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def _schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in _schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return _schema_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint_of(paths: set[str] | tuple[str, ...]) -> str:
    """Hash of the sorted nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = (
    Mapping("turn rows", ("role", "text"), "", "role", "text"),
    Mapping("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping("prompt and completion", ("prompt", "completion"), fixed=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt and response", ("prompt", "response"), fixed=(("prompt", "user"), ("response", "assistant"))),
    Mapping("question and answer", ("question", "answer"), fixed=(("question", "user"), ("answer", "assistant"))),
    Mapping("instruction", ("instruction", "output"), fixed=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction with input", ("instruction", "input", "output"), fixed=(("instruction", "user"), ("input", "+"), ("output", "assistant"))),
    Mapping("system and instruction", ("system", "instruction", "output"), fixed=(("system", "system"), ("instruction", "user"), ("output", "assistant"))),
)
BY_FINGERPRINT = {m.fingerprint: m for m in MAPPINGS}


def select_mapping(paths: set[str]) -> Mapping | None:
    """By the fingerprint of all paths; else, for records with further fields, the mapping with most of its paths there."""
    found = BY_FINGERPRINT.get(fingerprint_of(paths))
    return found or max((m for m in MAPPINGS if set(m.paths) <= paths), key=lambda m: len(m.paths), default=None)


def _read(raw: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout and turns of a JSON record; what cannot be read has none."""
    try:
        record = json.loads(raw) if raw else None
        mapping = select_mapping(_paths(record)) if isinstance(record, dict) else None
    except (ValueError, RecursionError):
        return None, []
    try:
        return (mapping.name, mapping.read(record)) if mapping else (None, [])
    except TypeError:
        return mapping.name, []


def canonical_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """Turns of JSON records ``(id, record)``: id, layout, turn, role, text.

    A record that is null, no JSON object, of no known layout or mistyped, or that has no turns, gives one row with a null turn, so
    none is lost.  Repeated records give their turns each; extra columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                layout, turns = _read(raw)
                out += [(key, layout, k, role, text) for k, (role, text) in enumerate(turns)] or [(key, layout, None, None, None)]
            kinds = (("id", b.column(0).type), ("layout", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return records.select(F.col("id"), F.col(column).cast("string")).mapInArrow(tidy(run), f"id {records.schema['id'].dataType.simpleString()}, layout string, turn bigint, role string, text string")


def render_turn(role: str, text: str) -> str:
    return f"{OPEN}{_role_out(role)}\n{escape(text)}{CLOSE}\n"


def parse(formatted: str) -> list[tuple[str, str, bool]]:
    """Read back (role, text, under the loss mask) of each turn in a formatted conversation or part of one."""
    return [(_role_in(r), unescape(t), _role_in(r) == "assistant") for r, t in _TURN.findall(formatted)]


_SEGMENTS = "conv_id bigint, turn bigint, part int, formatted string, loss boolean"


def format_records(records: DataFrame) -> DataFrame:
    """JSON records ``(conv_id, turn, record)`` of any known layout as formatted segments: conv_id, turn, part, formatted, loss.

    Each record's fingerprint selects its mapping.  A record may hold one turn or several, which ``part`` numbers.  The segments of a
    conversation in order of (turn, part) are its formatted text; of equal turn numbers the formatted text decides the order.
    ``loss`` marks the segments whose text is trained on.  Null role or text: empty.  Repeated rows stay; records of no turns give
    no segment; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(*key, k, render_turn(*t), t[0] == "assistant") for *key, raw in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, t in enumerate(_read(raw)[1])]
            kinds = (("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss", pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return records.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("record").cast("string")).mapInArrow(tidy(run), _SEGMENTS)


def format_turns(turns: DataFrame) -> DataFrame:
    """``format_records`` for a table ``(conv_id, turn, ...)`` that holds a layout in its columns, as ``role`` and ``text`` or
    ``messages``.  The fingerprint of the schema selects the mapping; columns of no layout are not read."""
    mapping = select_mapping({p for f in turns.schema if f.name not in ("conv_id", "turn") for p in _schema_paths(f.dataType, f.name)})
    if mapping is None:
        raise ValueError(f"no layout has the columns {turns.columns}")
    fields = sorted({re.split(r"[.\[]", p)[0] for p in mapping.paths})
    return format_records(turns.select("conv_id", "turn", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record")))


class _Digest:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss, self.n, self.chars, self.loss_chars = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, loss in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_DIGEST = (("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted segments say when parsed: counts, digests of turns and of the loss text.

    Segments are sorted by (turn, part, segment) within partitions, which spills, and streamed: of a conversation of any size only
    one segment and the running digests are in memory.  Rows with a null conv_id form one conversation.  No segments: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for b in batches:
            done = []
            for key, formatted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is None or key != now.conv_id:
                    if now:
                        done.append(now.row())
                    now = _Digest(key)
                now.add(formatted)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, (_, t) in enumerate(_DIGEST)], [n for n, _ in _DIGEST])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(now.row(), _DIGEST, strict=True)], [n for n, _ in _DIGEST])

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "formatted").select("conv_id", "formatted").mapInArrow(
        tidy(run), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def conversation_texts(segments: DataFrame, max_chars: int = 1 << 20) -> DataFrame:
    """One training text per conversation, or several parts of about ``max_chars`` for longer ones: conv_id, part, formatted,
    loss_spans (start and end offsets of the escaped assistant texts within the part).  A turn is never cut.  No segments: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            names, kinds = ("conv_id", "part", "formatted", "loss_spans"), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, part, "".join(buffer), marks), kinds, strict=True)], names)

        key, part, buffer, marks, size, started = None, 0, [], [], 0, False
        for b in batches:
            for k, formatted, loss in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if started and (k != key or size >= max_chars):
                    yield flush()
                    part, buffer, marks, size = (part + 1 if k == key else 0), [], [], 0
                key, started = k, True
                if loss:
                    marks += [size + formatted.index("\n") + 1, size + len(formatted) - len(CLOSE) - 1]
                buffer.append(formatted)
                size += len(formatted)
        if started:
            yield flush()

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "formatted").select("conv_id", "formatted", "loss").mapInArrow(
        tidy(run), "conv_id bigint, part bigint, formatted string, loss_spans array<bigint>"
    )
