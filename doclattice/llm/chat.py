"""Chat formatting with typed content parts.

A visitor flattens each message's parts in their order: text is escaped and kept, image, audio and document
parts become numbered placeholders, and for each the reference, its place and the tokens it expands to are
recorded. A message becomes one piece of its conversation, a conversation being its pieces in order; the loss mask
is a span of each piece. Control strings (placeholders, turn marks, and those of other templates) start with ``<``
or ``[``; inside texts these two and the backslash are escaped, so no text can contain a control string, and
every text can be read back.

Defined cases: a null text counts as empty, a null list of parts as no parts, a part of another type or a null type as text; a null
role is the empty role; a null conversation id is a conversation of its own; equal turns go by role, then content; repeated rows are
repeated messages; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "</s>"
#: Tokens that an attachment expands to, by its type.
EXPANDED = {"image": 576, "audio": 1500, "document": 2048}
LOSS_ROLE = "assistant"
PART = "array<struct<type:string,text:string,ref:string>>"
PIECE = "piece string, chars long, loss_start long, loss_stop long, tokens long, attachments array<struct<no:int,type:string,ref:string,at:long,tokens:long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\|\\\\", lambda m: m[1] or "\\", text)


class Visitor:
    """Collects the flat text of one message."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.size = self.tokens = 0
        self.attached: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        text = part["text"] or ""
        self.tokens += len(text.split())
        self._add(escape(text))

    def _attach(self, part: dict) -> None:
        no, kind = len(self.attached) + 1, part["type"]
        self.attached.append({"no": no, "type": kind, "ref": part["ref"], "at": self.size, "tokens": EXPANDED[kind]})
        self.tokens += EXPANDED[kind]
        self._add(f"<|{kind}:{no}|>")

    visit_image = visit_audio = visit_document = _attach

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def format_message(role: str | None, parts: list[dict] | None) -> dict:
    """The piece, its length, the span under the loss mask (from the piece's start), tokens and attachments (places from the body's start)."""
    v = Visitor()
    for part in parts or []:
        if part is not None:
            v.visit(part)
    head = OPEN + escape(role or "") + MIDDLE
    body = "".join(v.out)
    piece = head + body + CLOSE
    lost = role == LOSS_ROLE
    return {"piece": piece, "chars": len(piece), "loss_start": len(head) if lost else 0, "loss_stop": len(head) + len(body) if lost else 0, "tokens": v.tokens + 3, "attachments": v.attached}


def read_piece(piece: str) -> tuple[str, str]:
    """(role, body) of a formatted piece; placeholders stay in the body."""
    role, body = piece[len(OPEN) : -len(CLOSE)].split(MIDDLE, 1)
    return unescape(role), unescape(body)


def format_turns(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, and the fields of its piece. ``content_col`` is a string or a list of parts (type, text, ref).

    Messages are formatted one by one: no conversation is gathered.
    """
    kind = messages.schema[content_col].dataType
    content = F.col(content_col).cast(PART) if isinstance(kind, T.ArrayType) else F.array(F.struct(F.lit("text").alias("type"), F.col(content_col).cast("string").alias("text"), F.lit(None).cast("string").alias("ref")))
    base = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), content.alias("content"))
    fields = T._parse_datatype_string(PIECE)

    @F.arrow_udf(fields)
    def formatted(roles: pa.Array, contents: pa.Array) -> pa.Array:
        rows = [format_message(r, c) for r, c in zip(roles.to_pylist(), contents.to_pylist(), strict=True)]
        attached = pa.list_(pa.struct([("no", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
        return pa.array(rows, pa.struct([("piece", pa.string()), *[(n, pa.int64()) for n in ("chars", "loss_start", "loss_stop", "tokens")], ("attachments", attached)]))

    return base.withColumn("f", formatted("role", "content")).select("conv_id", "turn", "role", "f.*")


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``format_turns``: the whole text, for conversations that fit in one row."""
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "piece", "tokens"))).alias("t"))
    return each.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.expr("aggregate(t.tokens, 0L, (a, x) -> a + x)").alias("tokens"))


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation what its formatted pieces say: turns and loss, as counts and digests.

    Pieces are sorted within partitions and read as a stream: a conversation of any length needs the memory of one batch.
    """
    dealt = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "piece", "loss_start", "loss_stop").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, False
        n = lost = size = 0
        said = loss = hashlib.sha256()

        def row() -> list:
            return [at, n, said.hexdigest(), lost, loss.hexdigest(), size]

        def table(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            done = []
            for conv, piece, start, stop in zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_stop")), strict=True):
                if not open_ or conv != at:
                    if open_:
                        done.append(row())
                    at, open_, n, lost, size, said, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, body = read_piece(piece)
                said.update(f"{role}\n{body}\n".encode())
                under = unescape(piece[start:stop])
                loss.update(under.encode())
                n, lost, size = n + 1, lost + len(under), size + len(piece)
            yield table(done)
        if open_:
            yield table([row()])

    return dealt.mapInArrow(stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
