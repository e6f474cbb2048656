"""Conversations as text with loss spans, and back.

A compiled template renders each conversation turn by turn, as its rows come in
order; nothing holds a whole one.  Control strings inside roles and texts are
escaped, so that the marks in the output are those of the template alone, and the
turns can be read back from the output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.template import Template, compile_template

#: Strings that mean something to the reader of the output, two signs or more each.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")

#: A turn: its start, the role, a line end, the text, its end.  What an assistant says is learnt.
TEMPLATE = (
    "{% for message in messages %}"
    "<s>{{ message.role | escape_line }}\n"
    "{% if message.role == 'user' %}[INST] {{ message.text | escape }} [/INST]"
    "{% elif message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "</s>\n"
    "{% endfor %}"
)

_START, _END, _OPEN, _CLOSE = "<s>", "</s>\n", "[INST] ", " [/INST]"

_ANY = "|".join(map(re.escape, CONTROLS))
_INSIDE = re.compile(f"(?=(?:{_ANY}))(.)", re.S)
_PART_AT_END = re.compile("(?:" + "|".join(re.escape(c[:k]) for c in CONTROLS for k in range(len(c) - 1, 0, -1)) + r")\Z")
_PART_AT_START = re.compile("|".join(re.escape(c[k:]) for c in CONTROLS for k in range(1, len(c))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_BACK = {"n": "\n", ".": ""}


def escape(text: str) -> str:
    """``text`` without any control string, nor part of one at its ends; ``unescape`` undoes it.

    Backslashes are doubled; ``\\.`` stands for nothing and is put into what must not be read.
    """
    text = _INSIDE.sub(r"\1\\.", text.replace("\\", "\\\\"))
    if _PART_AT_END.search(text):
        text += "\\."
    if _PART_AT_START.match(text):
        text = "\\." + text
    return text


def escape_line(text: str) -> str:
    """Escaped, and on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK.get(m[1], m[1]), text)


def compiled(source: str) -> Template:
    return compile_template(source, {"escape": escape, "escape_line": escape_line})


def in_order(rows: DataFrame) -> DataFrame:
    """The rows of a conversation next to each other, by turn.

    Rows of one turn go by role and text, null first.  A conversation lies in one
    partition, read as a stream; no task holds more of it than a batch.
    """
    slim = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


#: Signs of output, and rows of it, that go into one Arrow batch.
BATCH_SIGNS, BATCH_ROWS = 2_000_000, 4_000


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    held, signs = [], 0
    for row in rows:
        held.append(row)
        signs += len(row[text])
        if signs >= BATCH_SIGNS or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in held] for i, f in enumerate(schema)}, schema)
            held, signs = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in held] for i, f in enumerate(schema)}, schema)


_PIECES = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]
)


def render(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, piece, start, formatted, spans: the output of each conversation, cut into pieces.

    ``rows``: conv_id, turn, role, text; null role and text are empty, rows without conv_id
    are one conversation.  Put together by ``piece`` (from 0), ``formatted`` is the output, and
    ``spans`` are the [from, to) of it, in code points from the output's start, that a model is
    to learn; ``start`` is the place of the piece.  The pieces of a conversation follow each
    other in one partition.  Other columns are not read.
    """
    compiled(template)  # errors show here, not in a task

    def pieces(batches):
        run = compiled(template)
        for conv, turns in groupby(_stream(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in turns)
            at, start, n, parts, spans = 0, 0, 0, [], []
            for text, learnt in run.render(messages=messages):
                if learnt and text:
                    if spans and spans[-1][1] == at:
                        spans[-1][1] = at + len(text)
                    else:
                        spans.append([at, at + len(text)])
                parts.append(text)
                at += len(text)
                if len(parts) >= 8:
                    yield conv, n, start, "".join(parts), spans
                    start, n, parts, spans = at, n + 1, [], []
            yield conv, n, start, "".join(parts), spans

    schema = "conv_id bigint, piece bigint, start bigint, formatted string, spans array<array<bigint>>"
    return in_order(rows).mapInArrow(lambda b: _batches(pieces(b), _PIECES, 3), schema)


def read_turns(pieces: Iterator[tuple[str, list]]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, what of the text is learnt, signs read) of each turn in the pieces of an output of ``TEMPLATE``."""
    held, spans, at = "", [], 0
    for formatted, more in pieces:
        held += formatted
        spans.extend(more)
        begin = 0
        while (end := held.find(_END, begin)) >= 0:
            line = held.index("\n", begin)
            if not held.startswith(_START, begin):
                raise ValueError("a turn without a start")
            first, last = line + 1, end
            if held.startswith(_OPEN, first):
                first, last = first + len(_OPEN), end - len(_CLOSE)
            learnt = "".join(held[max(a - at, first) : min(b - at, last)] for a, b in spans if a - at < last and b - at > first)
            yield unescape(held[begin + len(_START) : line]), unescape(held[first:last]), unescape(learnt), end + len(_END) - begin
            begin = end + len(_END)
        at += begin
        held = held[begin:]
        spans = [s for s in spans if s[1] > at]
    if held:
        raise ValueError("a turn without an end")


_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)


def digest(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from ``render``'s output.

    ``turns_sha256`` is of role, line end, text, line end of every turn; ``loss_sha256`` and
    ``loss_chars`` of the unescaped text that is learnt.  ``pieces`` must be as ``render`` leaves them.
    """

    def rows(batches):
        for conv, group in groupby(_stream(batches, "conv_id", "formatted", "spans"), key=lambda r: r[0]):
            turns, loss, n, chars, signs = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, learnt, size in read_turns((formatted, spans) for _, formatted, spans in group):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learnt.encode())
                n, chars, signs = n + 1, chars + len(learnt), signs + size
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), signs

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return pieces.mapInArrow(lambda b: _batches(rows(b), _DIGESTS, 2), schema)
