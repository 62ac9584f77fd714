"""Document fingerprints by winnowing [native: SQL functions only].

Hashes of all overlapping k-grams of code points; of every window of w hashes the smallest is chosen, the
rightmost where several are equal; position and hash of each choice are kept. Any run of ``w + k - 1``
code points that two texts share gives a common hash.

Defined cases: a null text counts as empty; a text shorter than k is one gram, the empty text too; texts with
fewer than w grams are one window; a text of any length is read whole (positions up to 2**31 - 1); repeated rows each get their result; an empty table gives an empty
result; other columns are kept, but one named like the result is replaced by it, and names that begin with two underscores are the function's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 12, 8
_TOP = 2**31 - 1


def add_marks(df: DataFrame, text_col: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: the chosen (hash, position) pairs as one long each, in order of the text.

    A long holds 32 bits of XXH64 above ``2**31 - 1 - position``, so that the smallest of a window is also the
    rightmost of equal hashes. Each gram is hashed whole, to the same effect as a rolling update: SQL has no running fold that doesn't copy
    its array at each step, and hashes rolled from those of their parts took twice the time (see README).
    Window minima come by doubling: widths 1, 2, 4, then the rest.
    """
    quoted = [F.col(f"`{c}`") for c in df.columns if c != out]
    grams = f"if(char_length(__text) < {gram}, array(__text), regexp_extract_all(__text, '(?s)(?=(.{{{gram}}})).', 1))"
    step = df.select(*quoted, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    step = step.select(*quoted, F.expr(f"transform({grams}, (g, i) -> shiftleft(xxhash64(g) & 4294967295, 31) | ({_TOP} - i))").alias("__grams"))
    step = step.withColumn("__least", F.col("__grams"))
    width = 1
    while width < window:
        by = min(width, window - width)
        step = step.select(*quoted, "__grams", F.expr(f"zip_with(slice(__least, 1, greatest(size(__least) - {by}, 0)), slice(__least, {1 + by}, size(__least)), (a, b) -> least(a, b))").alias("__least"))
        width += by
    return step.select(*quoted, F.expr(f"if(size(__grams) <= {window}, array(array_min(__grams)), array_distinct(__least))").alias(out))


def edit_start(kept: str, gram: int = GRAM, window: int = WINDOW) -> str:
    """SQL for where to start reading a text that begins with ``kept`` code points of a text whose marks are known.

    Windows that end within the kept part choose as before. A mark more than a window before the last whole gram of that part
    is chosen by such windows only, so reading from one window further back finds all others.
    """
    return f"greatest({kept} - {gram + 2 * (window - 1)}, 0)"


def spliced(marks: str, tail: str, kept: str, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Marks of the edited text from the marks of the original and those of the edited text from ``edit_start`` on."""
    start, last = edit_start(kept, gram, window), f"({kept} - {gram + window - 1})"
    before = f"filter({marks}, x -> {start} > 0 and {_TOP} - (x & {_TOP}) <= {last})"
    after = f"filter(transform({tail}, x -> x - {start}), x -> {start} = 0 or {_TOP} - (x & {_TOP}) > {last})"
    return F.expr(f"concat({before}, {after})")


def positions(marks: str) -> Column:
    """array<struct<hash, pos>> from the marks; positions count code points from 0."""
    return F.expr(f"transform({marks}, x -> struct(shiftright(x, 31) as hash, {_TOP} - (x & {_TOP}) as pos))")


def hashes(marks: str) -> Column:
    """The set of hashes of a fingerprint."""
    return F.expr(f"array_distinct(transform({marks}, x -> shiftright(x, 31)))")


def digest(marks: str) -> Column:
    """64 hexadecimal digits of the whole fingerprint, positions included."""
    return F.sha2(F.expr(f"array_join(cast({marks} as array<string>), ',')"), 256)


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets of hashes, 0 to 1."""
    both = f"size(array_intersect({a}, {b}))"
    return F.expr(f"cast({both} as double) / (size({a}) + size({b}) - {both})")


def fingerprint(docs: DataFrame, text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` and ``winnowed``: array<struct<hash, pos>>."""
    return add_marks(docs, text_col, "winnowed", gram, window).withColumn("winnowed", positions("winnowed"))
