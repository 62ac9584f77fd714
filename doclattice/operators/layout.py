"""Words to lines, segments, regions and column text.

A page is the unit of order: one exchange deals the words out by (doc_id, page_no), and all windows and aggregates
below refine that key, so none of them shuffles again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.predicates import is_margin_artifact, is_translatable, should_preserve
from ..functions.text import clean_lines, is_blank, strip

PAGE = ["doc_id", "page_no"]


def assign_lines(words: DataFrame, keys: list[str] = PAGE, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``line_no``, from 0: a word starts a line when its top is more than the tolerance below the line's first word.

    A fold over the distinct tops of a page finds the line of each top (a window over the previous word would chain
    words that drift); a word's line is that of its top. A page's words are one row for the fold and rows
    again after it, still dealt by page, so this exchange is the only one.
    """
    rest = [c for c in words.columns if c not in keys]
    page = words.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_words"), F.sort_array(F.collect_set("top")).alias("_tops"))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, top: Column) -> Column:
        new = F.coalesce(top - acc["first"] > settings.line_tolerance, F.lit(True))
        line = acc["line"] + new.cast("int")
        return F.struct(F.when(new, top).otherwise(acc["first"]).alias("first"), line.alias("line"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    numbered = page.select(*keys, "_words", "_tops", F.aggregate("_tops", start, step, lambda acc: acc["lines"]).alias("_lines"))
    line = lambda w: F.coalesce(F.get("_lines", F.array_position("_tops", w["top"]).cast("int") - 1), F.lit(-1))
    placed = F.transform("_words", lambda w: F.struct(*[w[c].alias(c) for c in rest], line(w).alias("line_no")))
    return numbered.select(*keys, F.explode(placed).alias("_w")).select(*keys, "_w.*")


def split_segments(lined: DataFrame, keys: list[str] = PAGE, split_gaps: bool = True, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``seg_no``, from 0: within a line by x0, a gap wider than the limit starts a segment."""
    if not split_gaps:
        return lined.withColumn("seg_no", F.lit(0))
    order = W.partitionBy(*keys, "line_no").orderBy("x0", "top", "word_seq")
    wide = F.coalesce(F.col("x0") - F.lag("x1").over(order) > settings.segment_gap, F.lit(False)).cast("int")
    return lined.withColumn("_wide", wide).withColumn("seg_no", F.sum("_wide").over(order).cast("int")).drop("_wide")


def segment_boxes(segmented: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row per segment: its box and its words' text in order; empty ones go."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "top", "word_seq", "text"))), lambda w: w["text"]), " ")
    lines = segmented.groupBy(*keys, "line_no", "seg_no").agg(
        F.min("top").alias("top"), F.max(F.coalesce("bottom", "top")).alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), strip(text).alias("text")
    )
    return lines.where("text <> ''")


def words_to_lines(words: DataFrame, keys: list[str] = PAGE, split_gaps: bool = True) -> DataFrame:
    return segment_boxes(split_segments(assign_lines(words, keys), keys, split_gaps), keys)


def upright(words: DataFrame) -> DataFrame:
    return words.where(F.coalesce("upright", F.lit(True)))


def two_column(width: Column) -> Column:
    """An aggregate over a page's lines."""
    center = (F.col("x0") + F.col("x1")) / 2
    left, right = F.count_if(center < width / 2), F.count_if(center >= width / 2)
    return (left >= 4) & (right >= 2) & (F.least(left, right) / F.greatest(left + right, F.lit(1)) > 0.15)


def two_column_pages(lines: DataFrame, width: float) -> DataFrame:
    return lines.groupBy(*PAGE).agg(two_column(F.lit(width)).alias("two_column"))


def visible_lines(lines: DataFrame, width: float, height: float) -> DataFrame:
    return lines.where(~is_margin_artifact(F.col("text"), F.col("x0"), F.col("x1"), F.col("top"), F.col("bottom"), F.lit(width), F.lit(height)) & ~is_blank(F.col("text")))


def group_regions(visible: DataFrame, width: float, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``bucket`` (0 full width, 1 left, 2 right) and ``flow``, the number of the region within its bucket."""
    page = W.partitionBy(*PAGE)
    center = (F.col("x0") + F.col("x1")) / 2
    left, right = F.count_if(center < width / 2).over(page), F.count_if(center >= width / 2).over(page)
    columns = (left >= 4) & (right >= 2) & (F.least(left, right) / (left + right) > 0.15)
    full = ~F.col("_columns") | (F.col("x1") - F.col("x0") > width * settings.full_width_share)
    b = visible.withColumn("_columns", columns).withColumn("bucket", F.when(full, 0).when(center < width / 2, 1).otherwise(2)).drop("_columns")
    order = W.partitionBy(*PAGE, "bucket").orderBy("top", "x0", "line_no", "seg_no")
    shift = max(settings.region_shift, width * settings.region_shift_share)
    flows = (F.col("top") - F.lag("bottom").over(order) <= settings.region_gap) & (F.abs(F.col("x0") - F.lag("x0").over(order)) < shift)
    return b.withColumn("_new", (~F.coalesce(flows, F.lit(False))).cast("int")).withColumn("flow", F.sum("_new").over(order).cast("int")).drop("_new")


def regions(grouped: DataFrame, width: float, height: float) -> DataFrame:
    """One row per region: padded box, cleaned text, whether to translate it; ``region_no`` from 0 by (top, x0)."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("top", "x0", "line_no", "seg_no", "text"))), lambda x: x["text"])
    joined = grouped.groupBy(*PAGE, "bucket", "flow").agg(
        F.array_join(lines, "\n").alias("raw"), F.greatest(F.lit(0.0), F.min("x0") - 1.5).alias("x0"), F.greatest(F.lit(0.0), F.min("top") - 1.2).alias("top"),
        F.least(F.lit(width), F.max("x1") + 1.5).alias("x1"), F.least(F.lit(height), F.max("bottom") + 1.2).alias("bottom"),
    )
    text = strip(F.regexp_replace(clean_lines(F.col("raw")), r"\s*\n\s*", " "))
    texted = joined.withColumn("text", text).where("text <> ''")
    flag = is_translatable(F.col("text"), F.col("x0"), F.col("top"), F.col("x1"), F.lit(width))
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("top", "x0", "bucket", "flow")) - 1
    return texted.select(*PAGE, number.alias("region_no"), "text", "x0", "top", "x1", "bottom", flag.alias("translatable"))


def layout_regions(words: DataFrame, width: float, height: float, preserve: bool = True) -> DataFrame:
    """Upright words to regions; pages in Japanese or of unmapped glyphs keep all their regions. Without ``preserve``, ``translatable`` is each region's own flag."""
    lines = words_to_lines(upright(words))
    if not preserve:
        return regions(group_regions(visible_lines(lines, width, height), width), width, height)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "seg_no", "text"))), lambda x: x["text"]), " ")
    kept = lines.groupBy(*PAGE).agg(whole.alias("page_text")).select(*PAGE, should_preserve(F.col("page_text")).alias("preserve"))
    found = regions(group_regions(visible_lines(lines, width, height), width), width, height)
    return found.join(kept, PAGE).withColumn("translatable", F.col("translatable") & ~F.col("preserve")).drop("preserve")


def header_lines(raw_lines: DataFrame, width: float) -> DataFrame:
    """Lines near the top that reach across the page."""
    least = F.min("top").over(W.partitionBy(*PAGE))
    return raw_lines.withColumn("_least", least).where((F.col("top") <= F.col("_least") + 28) & (F.col("x0") < width * 0.25) & (F.col("x1") > width * 0.55)).drop("_least")


def without_headers(words: DataFrame, headers: DataFrame) -> DataFrame:
    """Words that aren't within 3 of a header's top: an anti join within the page."""
    h = headers.select(F.col("doc_id").alias("_d"), F.col("page_no").alias("_p"), F.col("top").alias("_top"))
    return words.join(h, (F.col("doc_id") == F.col("_d")) & (F.col("page_no") == F.col("_p")) & (F.abs(F.col("top") - F.col("_top")) <= 3), "left_anti")


def _blocks(lines: DataFrame, rank: Column) -> DataFrame:
    """Lines to one text per page: blocks by rank, parted by a blank line; lines within a block by top."""
    block = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", "line_no", "seg_no", "text"))), lambda x: x["text"]), "\n")
    each = lines.withColumn("_rank", rank).groupBy(*PAGE, "_rank").agg(block.alias("block"))
    return each.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "block"))), lambda x: x["block"]), "\n\n").alias("text"))


def _two_columns(lines: DataFrame, width: float) -> Column:
    """The flag of a line's page, as a window that needs no join."""
    page, center = W.partitionBy(*PAGE), (F.col("x0") + F.col("x1")) / 2
    left, right = F.count_if(center < width / 2).over(page), F.count_if(center >= width / 2).over(page)
    return (left >= 4) & (right >= 2) & (F.least(left, right) / (left + right) > 0.15)


def column_order_text(lines: DataFrame, width: float) -> DataFrame:
    """A page's lines by top; left column before right where the page has two."""
    center = (F.col("x0") + F.col("x1")) / 2
    flagged = lines.withColumn("two_column", _two_columns(lines, width))
    return _blocks(flagged, F.when(F.col("two_column") & (center >= width / 2), 1).otherwise(0))


def column_word_text(words: DataFrame, width: float) -> DataFrame:
    """Header lines, then the words left of the middle as lines, then those right of it.

    Headers and what lies beside them are marked by windows within the page; ``header_lines`` and ``without_headers`` say the same as joins.
    """
    lined = assign_lines(words)
    line, page = W.partitionBy(*PAGE, "line_no"), W.partitionBy(*PAGE)
    boxed = lined.withColumn("_top", F.min("top").over(line)).withColumn("_x0", F.min("x0").over(line)).withColumn("_x1", F.max("x1").over(line))
    head = (F.col("_top") <= F.min("_top").over(page) + 28) & (F.col("_x0") < width * 0.25) & (F.col("_x1") > width * 0.55)
    marked = boxed.withColumn("_head", head)
    tops = F.collect_set(F.when(F.col("_head"), F.col("_top"))).over(page)
    marked = marked.withColumn("_tops", tops).withColumn("_beside", F.exists("_tops", lambda t: F.abs(F.col("top") - t) <= 3))
    plain = [*words.columns]
    headers = segment_boxes(marked.where("_head").select(*plain, "line_no", F.lit(0).alias("seg_no"))).withColumn("side", F.lit(0))
    body = marked.where("not _beside").select(*plain, F.when(F.col("x0") < width / 2, 1).otherwise(2).alias("side"))
    return _blocks(headers.unionByName(words_to_lines(body, [*PAGE, "side"], split_gaps=False)), F.col("side"))


def page_text(words: DataFrame, width: float) -> DataFrame:
    """Text per page: two-column pages by words, others by lines; cleaned."""
    lines = words_to_lines(words)
    flagged = lines.withColumn("two_column", _two_columns(lines, width))
    one = _blocks(flagged.where("not two_column"), F.lit(0))
    two = column_word_text(words.join(flagged.where("two_column").select(*PAGE).distinct(), PAGE, "left_semi"), width)
    return two.unionByName(one).select(*PAGE, clean_lines(F.col("text")).alias("source_text"))


def page_image_pairs(page_texts: DataFrame, images: DataFrame, default_text: str = "") -> DataFrame:
    """Images and texts of a document by page: all of either; a missing image is the document's last, a missing text the default."""
    last = images.groupBy("doc_id").agg(F.max_by("image_path", "page_no").alias("last_image"))
    both = page_texts.join(images, PAGE, "full_outer").join(last, "doc_id", "left")
    return both.select(*PAGE, F.coalesce("source_text", F.lit(default_text)).alias("source_text"), F.coalesce("image_path", "last_image").alias("image_path"))


# -- drawing boxes, without drawing ----------------------------------------------------------------------------------


def fit_image(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    ratio = F.least(box_width / width, box_height / height)
    return F.struct((width * ratio).alias("width"), (height * ratio).alias("height"))


def draw_boxes(found: DataFrame, width: float, height: float) -> DataFrame:
    """Translated regions with the box to draw; regions without translation or too small a box go."""
    x = F.greatest(F.lit(0.0), F.col("x0") - 1.6)
    y = F.greatest(F.lit(0.0), height - F.col("bottom") - 1.4)
    w = F.least(width - x, F.col("x1") - F.col("x0") + 3.2)
    h = F.least(height - y, F.col("bottom") - F.col("top") + 2.8)
    shown = found.where(F.col("translatable") & ~is_blank(F.col("translated_text")))
    return shown.select(*PAGE, "region_no", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), "translated_text").where("w > 5 and h > 4")
