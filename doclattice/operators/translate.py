"""The translator boundary: plug-ins, resilient batches, dedupe before the call and fan-out after it."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ENGINES, MODELS, Settings, batch_limits
from ..functions.text import is_blank, py_chunks, squeeze, strip
from .folds import greedy_batches
from .segments import page_chunks

COPY_MARK = "[Copy only]\n"
EMPTY_PAGE = "No text could be extracted from this page."


class TranslationError(RuntimeError):
    """What a translator raises for a batch that it can't translate; anything else ends the task."""


class Translator(Protocol):
    """What a plug-in offers. ``translate_batch_structured`` may ask its model for another form of reply; a plug-in without it answers as for plain batches."""

    engine: str

    def translate_batch(self, texts: list[str]) -> list[str]: ...


def call_translator(translator: Translator, texts: list[str], structured: bool = False) -> list[str]:
    """One call; another number of texts than asked for is an error like any other."""
    method = getattr(translator, "translate_batch_structured", translator.translate_batch) if structured else translator.translate_batch
    found = method(texts)
    if len(found) != len(texts):
        raise TranslationError("the translator returned another number of texts")
    return found


class CopyTranslator:
    """Returns its input, marked; for tests and dry runs."""

    engine = "copy"

    def translate_batch(self, texts: list[str]) -> list[str]:
        return [COPY_MARK + t.strip() if t.strip() else "" for t in texts]


class FunctionTranslator:
    """A translator made of a function over a list of texts."""

    def __init__(self, function: Callable[[list[str]], list[str]], engine: str = "llm"):
        self.function, self.engine = function, engine

    def translate_batch(self, texts: list[str]) -> list[str]:
        return self.function(texts)


_REGISTRY: dict[str, Callable[[str | None], Translator]] = {"copy": lambda model: CopyTranslator()}


def register_translator(engine: str, make: Callable[[str | None], Translator]) -> None:
    _REGISTRY[engine] = make


def build_translator(engine: str, model: str | None = None) -> Translator:
    """The translator of an engine (``copy``, ``nmt`` or ``ollama``, or one of a caller's own) for a model, by default the engine's first. Model services are plug-ins: theirs must be registered."""
    name = engine.strip().lower()
    if name in _REGISTRY:
        return _REGISTRY[name](model or next(iter(MODELS.get(name, [])), None))
    if name in ENGINES:
        raise LookupError(f"no plug-in is registered for the engine {name}")
    raise ValueError(f"unknown translation engine: {engine}")


def copy_expression(c: Column) -> Column:
    """The copy translator as a built-in expression."""
    return F.when(is_blank(c), "").otherwise(F.concat(F.lit(COPY_MARK), strip(c)))


# A text up to this length isn't cut; the least size of a piece.
UNCUT, LEAST_PIECE = 1200, 900


def resilient(texts: list[str], translator: Translator, settings: Settings = DEFAULT, structured: bool = False) -> list[tuple[str, str]]:
    """(translation, status) of each text. A batch that fails is halved; a single text that failed as structured is tried plain; a long one is cut into chunks; what still fails keeps its source.

    Only engines that answer with free text are retried; others raise.
    """
    try:
        return [(t, "ok") for t in call_translator(translator, texts, structured)]
    except TranslationError:
        if not translator.engine.startswith("llm"):
            raise
    if len(texts) > 1:
        half = len(texts) // 2
        return [x for part in (texts[:half], texts[half:]) for x in resilient(part, translator, settings, structured)]
    return [_single(text, translator, settings, structured) for text in texts]


def _single(text: str, translator: Translator, settings: Settings, structured: bool) -> tuple[str, str]:
    """The last resorts for a text that failed alone."""
    if structured:
        with contextlib.suppress(TranslationError):
            return call_translator(translator, [text])[0], "plain"
    pieces = py_chunks(text, max(LEAST_PIECE, min(settings.chunk_chars_llm // 2, len(text) // 2))) if len(text) > UNCUT else []
    if len(pieces) < 2:
        return text, "source"
    items, chars = batch_limits(translator.engine, "quality", settings)
    batches: list[list[str]] = []
    for piece in pieces:
        if not batches or len(batches[-1]) >= items or sum(map(len, batches[-1])) + len(piece) > chars:
            batches.append([])
        batches[-1].append(piece)
    parts = [t.strip() for batch in batches for t, _ in resilient(batch, translator, settings)]
    return "\n\n".join(filter(None, parts)), "pieces"


def halving(texts: list[str], translator: Translator, settings: Settings = DEFAULT) -> list[tuple[str, str]]:
    """(translation, status) of each text, for segments of TeX: a batch that fails is halved, and a single segment that fails in whatever way keeps its source."""
    try:
        return [(t, "ok") for t in call_translator(translator, texts, True)]
    except TranslationError:
        if len(texts) > 1:
            half = len(texts) // 2
            return [x for part in (texts[:half], texts[half:]) for x in halving(part, translator, settings)]
    except Exception:
        if len(texts) > 1:
            raise
    return [(t, "source") for t in texts]


def structured_regions(texts: list[str], translator: Translator, settings: Settings = DEFAULT) -> list[tuple[str, str]]:
    """(translation, status) of a page's regions: as structured batches, each region alone where that raises; an empty translation is the source."""
    try:
        found = resilient(texts, translator, settings, structured=True)
    except TranslationError:
        found = []
        for text in texts:
            try:
                found += resilient([text], translator, settings)
            except TranslationError:
                found.append((text, "source"))
    return [(t or source, status) for (t, status), source in zip(found, texts, strict=True)]


def zip_fallback(sources: Column, translated: Column) -> Column:
    """Translations by place; a blank one is its source."""
    return F.zip_with(sources, translated, lambda s, t: F.when(is_blank(F.coalesce(t, F.lit(""))), s).otherwise(t))


def translate_batches(df: DataFrame, keys: list[str], translator: Translator, text: str = "text", settings: Settings = DEFAULT, ladder: Callable = resilient) -> DataFrame:
    """Adds ``translated_text`` and ``status`` by ``ladder(texts, translator, settings)``; ``keys`` and ``batch_id`` name the batches, rows of one being adjacent in their partition.

    The plug-in is built once per task and sees one batch at a time.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", translated_text string, status string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in parts:
            whole = part if held is None else pd.concat([held, part], ignore_index=True)
            if not len(whole):
                continue
            ids = whole[[*keys, "batch_id"]]
            new = (ids != ids.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            for a, b in zip(new, new[1:], strict=False):
                yield call(whole.iloc[a:b])
            held = whole.iloc[new[-1] :]
        if held is not None and len(held):
            yield call(held)

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        found = ladder(batch[text].tolist(), translator, settings)
        return batch.assign(translated_text=[f[0] for f in found], status=[f[1] for f in found])

    return df.mapInPandas(run, schema)


def assemble_pages(chunks: DataFrame, keys: list[str], order: str, text: str, default: str = EMPTY_PAGE) -> DataFrame:
    """Chunks back to one text per page, in order; a page without any gets the default."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: strip(x["t"]))
    joined = F.array_join(F.filter(parts, lambda t: t != ""), "\n\n")
    return chunks.groupBy(*keys).agg(F.when(joined == "", default).otherwise(joined).alias("translated_text"))


def translate_pages(pages: DataFrame, translator: Translator, mode: str = "quality", settings: Settings = DEFAULT) -> DataFrame:
    """``page_texts`` to translated pages: chunks, batches over a document, translator, reassembly; empty pages get the default."""
    items, chars = batch_limits(translator.engine, mode, settings)
    chunks = page_chunks(pages, translator.engine, mode, settings).withColumn("n", F.char_length("text"))
    batched = greedy_batches(chunks, ["doc_id"], ["page_no", "chunk_no"], "n", items, chars)
    done = translate_batches(batched, ["doc_id"], translator, settings=settings)
    texts = assemble_pages(done, ["doc_id", "page_no"], "chunk_no", "translated_text")
    return pages.select("doc_id", "page_no", "source_text").join(texts, ["doc_id", "page_no"], "left").withColumn("translated_text", F.coalesce("translated_text", F.lit(EMPTY_PAGE)))


def dedupe_keys(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Distinct texts up to white space: key, the first text by ``order``, and the place of that first one."""
    first = F.min_by(F.col(text), F.struct(*order))
    return rows.groupBy(squeeze(F.col(text)).alias("cache_key")).agg(first.alias("text"), F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("uses"))


def translate_deduped(rows: DataFrame, translate: Callable[[DataFrame], DataFrame], text: str, order: list[str]) -> DataFrame:
    """Each distinct text is translated once and joined back to all rows that hold it. ``translate`` gets (cache_key, text) and adds ``translated_text``.

    The join's left side may hold one text in a third of its rows; the key is unique on the right, so a run-time split of the left is safe.
    """
    keyed = rows.withColumn("cache_key", squeeze(F.col(text)))
    once = translate(dedupe_keys(rows, text, order).select("cache_key", "text")).select("cache_key", "translated_text")
    return keyed.join(once, "cache_key").drop("cache_key")


def translate_regions(regions: DataFrame, translator: Translator, mode: str = "quality", settings: Settings = DEFAULT) -> DataFrame:
    """Regions with ``translated_text``: verbatim for copy; per page for a free-text engine in page mode; else deduplicated across pages and documents, the keys of a document (those first seen there) being batched in order of first sight."""
    wanted = F.col("translatable") & ~is_blank(F.col("text"))
    todo, rest = regions.where(wanted), regions.where(~wanted).withColumn("translated_text", F.lit(""))
    if translator.engine == "copy":
        return todo.withColumn("translated_text", F.col("text")).unionByName(rest)
    if translator.engine.startswith("llm") and mode == "page":
        items, chars = min(settings.overlay_items, settings.overlay_llm_items), min(settings.overlay_chars, settings.overlay_llm_chars)
        sized = greedy_batches(todo.withColumn("n", F.char_length("text")), ["doc_id", "page_no"], ["region_no"], "n", items, chars)
        return translate_batches(sized, ["doc_id", "page_no"], translator, settings=settings, ladder=structured_regions).select(*regions.columns, "translated_text").unionByName(rest)
    items, chars = batch_limits(translator.engine, mode, settings)

    def by_document(keys: DataFrame) -> DataFrame:
        # batches of keys that first occur in the same document, in order
        sized = keys.withColumn("n", F.char_length("cache_key"))
        return translate_batches(greedy_batches(sized, ["doc_id"], ["page_no", "region_no"], "n", items, chars), ["doc_id"], translator, settings=settings)

    order = ["doc_id", "page_no", "region_no"]
    once = by_document(dedupe_keys(todo, "text", order).select("cache_key", "text", "first.*")).select("cache_key", "translated_text")
    done = todo.withColumn("cache_key", squeeze(F.col("text"))).join(once, "cache_key").select(*regions.columns, "translated_text")
    return done.unionByName(rest)
