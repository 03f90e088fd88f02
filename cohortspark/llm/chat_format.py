"""Chat formatting of messages whose content is a list of typed parts.

A message is a row (conv_id, turn, role, parts); a part has a type (text, image, audio, document), and text, or a
reference with the sizes that its tokens are counted from. A visitor takes the parts of a turn in order: text is
escaped, every other part becomes a placeholder, and what it stands for is recorded as an attachment with its
place and the number of tokens it expands to. A part of any other type is an error of the caller's and raises.

Conversations are dealt by ranges of (conv_id, turn), so one with many turns is spread over tasks; each task writes
its turns as stretches of at most `stretch_chars` characters, which end at a turn's end and carry their order.
Nothing is gathered per conversation. Reading back parses stretches one by one; only digests, which are
chains, take the stretches of a conversation in order, one at a time.

Control strings are everything of the form <|name|> and the strings of `FOREIGN`. In a text, each gets one more
backslash behind its first character, also where it has some already, and loses one when read back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import stored

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of other templates that texts may hold.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"
#: Characters of a stretch, beyond which the next turn begins another one (a longer turn is one by itself).
STRETCH_CHARS = 1 << 22
#: Order of turns that share a number goes by role, then text; so many characters of a text decide on its task.
PREFIX = 32

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<turn:int,part:int,type:string,ref:string,at:int,tokens:long>"
SPAN = "struct<start:int,end:int>"

_REST = "|".join(sorted((re.escape(s[1:]) for s in FOREIGN), key=len, reverse=True))
_CONTROL = re.compile(rf"([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|{_REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(\|[A-Za-z0-9_]+\|>|{_REST})")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class TokenRule:
    """How many tokens a placeholder expands to: image patches with a row mark, seconds of sound, pages."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 256

    def image(self, part: dict) -> int:
        rows, columns = (math.ceil((part.get(side) or 0) / self.patch) for side in ("height", "width"))
        return rows * (columns + 1)

    def audio(self, part: dict) -> int:
        return math.ceil((part.get("seconds") or 0.0) * self.per_second)

    def document(self, part: dict) -> int:
        return (part.get("pages") or 0) * self.per_page


class PartVisitor:
    """Flattens the parts of one turn: `content`, the `spans` of its texts, and its `attachments`, by place in it."""

    def __init__(self, tokens: TokenRule) -> None:
        self.tokens = tokens
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []
        self.attachments: list[dict] = []

    def visit(self, number: int, part: dict | None) -> None:
        if part is None:
            return
        method = getattr(self, f"visit_{part['type']}", None)
        if method is None:
            raise ValueError(f"unknown type of part: {part['type']!r}")
        method(number, part)

    def _add(self, piece: str) -> int:
        start = self.length
        self.pieces.append(piece)
        self.length += len(piece)
        return start

    def visit_text(self, number: int, part: dict) -> None:
        start = self._add(escape(part.get("text") or ""))
        if self.length > start:
            self.spans.append((start, self.length))

    def _placeholder(self, number: int, part: dict, tokens: int) -> None:
        at = self._add(f"<|{part['type']}|>")
        self.attachments.append({"part": number, "type": part["type"], "ref": part.get("ref"), "at": at, "tokens": tokens})

    def visit_image(self, number: int, part: dict) -> None:
        self._placeholder(number, part, self.tokens.image(part))

    def visit_audio(self, number: int, part: dict) -> None:
        self._placeholder(number, part, self.tokens.audio(part))

    def visit_document(self, number: int, part: dict) -> None:
        self._placeholder(number, part, self.tokens.document(part))

    @property
    def content(self) -> str:
        return "".join(self.pieces)


class Stretch:
    """Formatted turns of one conversation, one after the other, while a task writes them."""

    def __init__(self, conv_id, number: int) -> None:
        self.conv_id, self.number, self.length, self.turns = conv_id, number, 0, 0
        self.pieces: list[str] = []
        self.spans: list[dict] = []
        self.attachments: list[dict] = []

    def add(self, role: str, parts: list, tokens: TokenRule) -> None:
        visitor = PartVisitor(tokens)
        for number, part in enumerate(parts):
            visitor.visit(number, part)
        head = f"{TURN}{escape(role)}{SAYS}"
        start = self.length + len(head)
        if role == LEARNED_ROLE:
            self.spans += [{"start": start + a, "end": start + b} for a, b in visitor.spans]
        self.attachments += [{**a, "turn": self.turns, "at": start + a["at"]} for a in visitor.attachments]
        self.pieces += [head, visitor.content, END]
        self.length = start + visitor.length + len(END)
        self.turns += 1


def _format(tokens: TokenRule, stretch_chars: int):
    kinds = {
        "stretch": pa.int64(),
        "turns": pa.int32(),
        "formatted": pa.string(),
        "loss_spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
        "attachments": pa.list_(
            pa.struct(
                [("turn", pa.int32()), ("part", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]
            )
        ),
        "expanded_tokens": pa.int64(),
        "whole": pa.bool_(),
    }

    def row(stretch: Stretch, whole: bool) -> dict:
        return {
            "conv_id": stretch.conv_id,
            "stretch": stretch.number,
            "turns": stretch.turns,
            "formatted": "".join(stretch.pieces),
            "loss_spans": stretch.spans,
            "attachments": stretch.attachments,
            "expanded_tokens": sum(a["tokens"] for a in stretch.attachments),
            "whole": whole,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # partitions follow the order of conversations and turns, and so do the numbers of their stretches
        number = TaskContext.get().partitionId() << 32
        current, whole, out, size, schema = None, False, [], 0, None
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), *kinds.items()])
            columns = [batch.column(n) for n in ("conv_id", "role", "parts")]
            for at in range(batch.num_rows):
                conv_id, role, parts = (c[at].as_py() for c in columns)
                same = current is not None and current.conv_id == conv_id
                if not same or current.length >= stretch_chars:
                    if current is not None:
                        # the first and the last conversation of a task may go on in another one
                        out.append(row(current, whole and not same))
                        size += current.length
                        whole = not same
                    number += 1
                    current = Stretch(conv_id, number)
                current.add(role, parts or [], tokens)
                if size >= stretch_chars:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if current is not None:
            out.append(row(current, False))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def format_conversations(messages: DataFrame, tokens: TokenRule = TokenRule(), stretch_chars: int = STRETCH_CHARS) -> DataFrame:
    """Formatted conversations in stretches: conv_id, stretch, turns, formatted, loss_spans, attachments, expanded_tokens, whole.

    `messages` has conv_id, turn, role, parts (an array of `PART`); other columns are ignored. Turns go by number,
    null first, equal numbers by role and the first text. A null role counts as empty, a null list of parts, a null
    part and a null text as nothing; rows without a conv_id are one conversation, whose id is null. Repeated rows
    are turns of their own. Loss spans are the texts of assistant turns, without placeholders. `whole` tells that
    the stretch is its whole conversation for certain; stretches of one conversation follow each other by `stretch`.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    text = F.coalesce(F.get(F.filter("parts", lambda p: p["type"] == "text"), F.lit(0))["text"], F.lit(""))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts", text.alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX))
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "parts")
    schema = (
        f"conv_id {kind}, stretch long, turns int, formatted string, loss_spans array<{SPAN}>, "
        f"attachments array<{ATTACHMENT}>, expanded_tokens long, whole boolean"
    )
    return ordered.mapInArrow(_format(tokens, stretch_chars), schema)


def read_turns(formatted: str) -> list[tuple[str, list[dict]]]:
    """(role, parts) of every turn of a stretch; parts are {"type": "text", "text": …} or a placeholder's type."""
    turns, end = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != end:
            raise ValueError("text outside of turns")
        end, parts, at = found.end(), [], 0
        content = found.group(2)
        for place in _PLACEHOLDER.finditer(content):
            if place.start() > at:
                parts.append({"type": "text", "text": unescape(content[at : place.start()])})
            parts.append({"type": place.group(1)})
            at = place.end()
        if at < len(content):
            parts.append({"type": "text", "text": unescape(content[at:])})
        turns.append((unescape(found.group(1)), parts))
    if end != len(formatted):
        raise ValueError("text outside of turns")
    return turns


def _digests():
    """One row a conversation from its stretches in order. State is two digests, whatever its length."""
    kinds = [
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]

    class Reader:
        def __init__(self, conv_id) -> None:
            self.conv_id, self.n, self.learned, self.chars = conv_id, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def read(self, formatted: str, spans: list[dict]) -> None:
            for role, parts in read_turns(formatted):
                text = "".join(p["text"] for p in parts if p["type"] == "text")
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n += 1
            for span in spans:
                text = unescape(formatted[span["start"] : span["end"]])
                self.loss.update(text.encode())
                self.learned += len(text)
            self.chars += len(formatted)

        def row(self) -> dict:
            values = (self.conv_id, self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.chars)
            return dict(zip(["conv_id", *(name for name, _ in kinds)], values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, schema = None, [], None
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), *kinds])
            columns = [batch.column(n) for n in ("conv_id", "formatted", "loss_spans")]
            for at in range(batch.num_rows):
                conv_id, formatted, spans = (c[at].as_py() for c in columns)
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        out.append(current.row())
                    current = Reader(conv_id)
                current.read(formatted, spans)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if current is not None:
            out.append(current.row())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def read_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted stretches.

    Whole conversations are read where they lie; the others' stretches are brought into order first, which are two
    a task beside those of conversations longer than a stretch.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "stretch", "formatted", "loss_spans"]
    whole = formatted.where("whole").select(*columns)
    rest = formatted.where("NOT whole").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    read = _digests()
    return whole.mapInArrow(read, schema).union(rest.mapInArrow(read, schema))


def text_messages(conversations: DataFrame) -> DataFrame:
    """Messages of one text part each from rows with conv_id, turn, role, text."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *empty)
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_and_read(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations and of conversation -1, whose two turns are control strings of another template."""
    spark = conversations.sparkSession
    kinds = ", ".join(f"{n} {conversations.schema[n].dataType.simpleString()}" for n in ("conv_id", "turn", "role", "text"))
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], kinds)
    rows = conversations.select("conv_id", "turn", "role", "text").union(extra)
    return read_digests(stored(format_conversations(text_messages(rows)), "formatted"))


ORACLE = rf"""WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
sized AS (SELECT *, len(regexp_replace(text, '([<\[]\\*)(\|[A-Za-z0-9_]+\|>|{_REST})', '\1\\\2', 'g')) AS written,
  len(regexp_replace(role, '([<\[]\\*)(\|[A-Za-z0-9_]+\|>|{_REST})', '\1\\\2', 'g')) AS named FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = '{LEARNED_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
  sum(written + named + {len(TURN + SAYS + END)})::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
