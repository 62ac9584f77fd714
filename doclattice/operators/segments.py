"""Splitting texts into pieces of bounded size, for columns and rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import chunk_text, is_blank, squeeze, strip


def page_chunks(pages: DataFrame, engine: str, mode: str = "quality", settings: Settings = DEFAULT) -> DataFrame:
    """``page_texts`` to chunks: whole pages for NMT, else paragraphs up to the engine's size; blank pages have none."""
    text = F.col("source_text")
    if engine == "nmt":
        parts = F.array(strip(text))
    else:
        most = settings.chunk_chars_llm if engine.startswith("llm") else settings.chunk_chars_fast if mode == "fast" else settings.chunk_chars_quality
        parts = chunk_text(text, most)
    return pages.where(~is_blank(text)).select("doc_id", "page_no", F.posexplode(parts).alias("chunk_no", "text"))


def count_tokens(text: str) -> int:
    """Our default counter: words and two marks. A model's tokenizer takes its place."""
    return len(text.split()) + 2


def _pack(pieces: list[str], most: int, tokens: Callable[[str], int]) -> list[str]:
    out: list[str] = []
    for piece in pieces:
        joined = f"{out[-1]} {piece}" if out else piece
        if out and tokens(joined) <= most:
            out[-1] = joined
        else:
            out.append(piece)
    return out


def sentence_pieces(text: Column, most: int = DEFAULT.token_input, tokens: Callable[[str], int] = count_tokens) -> Column:
    """Sentences packed in order up to ``most`` tokens; a longer sentence is packed word by word first."""
    sentences = F.filter(F.split(squeeze(text), r"(?<=[.!?])\s+"), lambda s: s != "")

    @F.arrow_udf("array<string>")
    def pack(found: pa.Array) -> pa.Array:
        rows = []
        for units in found.to_pylist():
            cut = [p for u in units or [] for p in ([u] if tokens(u) <= most else _pack(u.split(), most, tokens))]
            rows.append(_pack(cut, most, tokens))
        return pa.array(rows, pa.list_(pa.string()))

    return pack(sentences)


def default_width(char: str) -> float:
    """Ems of a character: half for ASCII, one for others. A font's widths take its place."""
    return 0.5 if ord(char) < 128 else 1.0


def wrap_lines(text: Column, size: float, most: float, width: Callable[[str], float] = default_width, empty: str = "") -> Column:
    """Lines of at most ``most`` points, broken at any character; a null for each run of blank lines but not at the start."""

    def wrap(value: str) -> list[str | None]:
        out: list[str | None] = []
        for paragraph in (p.strip() for p in value.replace("\r", "\n").splitlines()):
            if not paragraph:
                if out and out[-1] is not None:
                    out.append(None)
                continue
            start, used = 0, 0.0
            for i, char in enumerate(paragraph):
                w = width(char) * size
                if used + w > most + 1e-9 and i > start:
                    out.append(paragraph[start:i])
                    start, used = i, 0.0
                used += w
            out.append(paragraph[start:])
        return out or [empty]

    @F.arrow_udf("array<string>")
    def call(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else wrap(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return call(text)


def fit_size(text: Column, width: Column, height: Column, glyph: Callable[[str], float] = default_width) -> Column:
    """The largest of a falling series of font sizes at which the text fits the box; with its line height and lines.

    Below 4.2 points the text is cut to the lines that fit, with an ellipsis.
    """

    def lines_at(value: str, size: float, most: float) -> list[str]:
        per, out, used = [glyph(c) * size for c in value], [""], 0.0
        for c, w in zip(value, per, strict=True):
            if used + w > most + 1e-9 and out[-1]:
                out.append("")
                used = 0.0
            out[-1] += c
            used += w
        return out

    def fit(value: str, w: float, h: float) -> dict:
        size = min(8.2, max(4.8, h * 0.46))
        while size >= 4.2:
            lines = lines_at(value, size, w)
            if len(lines) * size * 1.22 <= h:
                return {"size": size, "line_height": size * 1.22, "lines": lines}
            size -= 0.4
        lines, room = lines_at(value, 4.2, w), max(1, int(h // (4.2 * 1.18)))
        if len(lines) > room:
            last = lines[room - 1] + "..."
            while last and sum(map(glyph, last)) * 4.2 > w:
                last = last[:-4] + "..." if len(last) > 4 else last[:-1]
            lines = [*lines[: room - 1], last]
        return {"size": 4.2, "line_height": 4.2 * 1.18, "lines": lines}

    @F.arrow_udf("struct<size:double,line_height:double,lines:array<string>>")
    def call(texts: pa.Array, ws: pa.Array, hs: pa.Array) -> pa.Array:
        rows = [None if t is None else fit(t, w, h) for t, w, h in zip(texts.to_pylist(), ws.to_pylist(), hs.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([("size", pa.float64()), ("line_height", pa.float64()), ("lines", pa.list_(pa.string()))]))

    return call(squeeze(text), width, height)


