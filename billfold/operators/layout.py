"""From word and cell boxes to text lines and table rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billfold.functions import constants as K
from billfold.functions.text import bind, is_blank
from billfold.operators.grouping import number_in_place

LAYOUT_KEYS = ("page_num", "block_num", "par_num", "line_num")


def keep_words(words: DataFrame) -> DataFrame:
    """Word boxes whose text is neither null nor blank."""
    return words.where(~is_blank(F.col("text")))


def _joined_by_left(df: DataFrame, separator: str = " ") -> Column:
    """The texts, none of them null, in the order of ``left`` and ``word_idx``, nulls first.

    Each column is gathered on its own, which takes less than half the room of structs in the
    shuffle; the lists of one aggregate have their rows in the same order. A list leaves
    nulls out, so a place that may be null is gathered as a value and whether it is there.
    """

    def gathered(name: str) -> list[Column]:
        value = F.col(name)
        typed = df.schema[name].dataType
        zero = F.lit("" if typed.typeName() == "string" else 0).cast(typed)
        return [F.collect_list(value.isNotNull()), F.collect_list(F.coalesce(value, zero))]

    lists = [*gathered("left"), *gathered("word_idx"), F.collect_list("text")]
    # no element is null, so sort_array sorts like array_sort, without a call of its comparator for every pair
    placed = F.sort_array(F.arrays_zip(*(c.alias(f"c{i}") for i, c in enumerate(lists))))
    return F.array_join(placed[f"c{len(lists) - 1}"], separator)


def lines_from_words(words: DataFrame) -> DataFrame:
    """Words to lines by the layout keys; words sorted by ``left``, joined by one blank.

    Rows with a null key belong to no group and are dropped. Out: doc_id, layout keys,
    raw_text.
    """
    kept = keep_words(words).dropna(subset=list(LAYOUT_KEYS))
    return kept.groupBy("doc_id", *LAYOUT_KEYS).agg(_joined_by_left(kept).alias("raw_text"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Row numbers of layout lines within their page, in layout order."""
    return number_in_place(lines, ["doc_id", "page_num"], LAYOUT_KEYS[1:])


_PAGE = ("doc_id", "page_num")


def _lines(boxes: DataFrame, y: Column, fields: Sequence[str], tolerance: float, mean: Callable) -> DataFrame:
    """doc_id, page_num, line_start, line: the boxes that form a line, from the top of the page down.

    A box joins the open line if its position ``y`` lies within the tolerance of the line's centre,
    and the centre then moves to the ``mean`` of both; otherwise it opens a new line. That depends
    on the order, so it is a fold. The page is cut into segments first: the centre is
    a mean of earlier positions and never above the previous one, so a gap beyond the
    tolerance always starts a line. A segment carries its boxes (``line`` has ``fields``, in page order), a few
    pixel rows of a page; the fold notes where in it lines open, and each line is a slice of it.
    ``mean`` lies between its arguments, so a segment that is no higher than the tolerance is one
    line and needs no fold. The boxes are shuffled once, to their page.
    """
    down = Window.partitionBy(*_PAGE).orderBy("__y")
    gap = F.col("__y") - F.lag("__y").over(down) > tolerance
    placed = boxes.select(*_PAGE, y.alias("__y"), F.struct(*fields).alias("__box")).where(F.col("__y").isNotNull())
    segments = (
        placed.withColumn("__cut", F.coalesce(gap, F.lit(True)).cast("int"))
        .withColumn("__segment", F.sum("__cut").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*_PAGE, "__segment")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("__y").alias("y"), F.col("__box").alias("box")))).alias("boxes"))
    )

    def step(state: Column, b: Column) -> Column:
        joins = F.abs(b["y"] - state["centre"]) <= F.lit(tolerance)  # null centre: opens
        opens = F.coalesce(~joins, F.lit(True))
        centre = F.when(opens, b["y"]).otherwise(mean(state["centre"], b["y"]))
        starts = F.when(opens, F.concat(state["starts"], F.array(state["i"]))).otherwise(state["starts"])
        return F.struct(centre.alias("centre"), (state["i"] + 1).alias("i"), starts.alias("starts"))

    y_type = placed.schema["__y"].dataType
    zero = F.struct(
        F.lit(None).cast(y_type).alias("centre"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts")
    )
    folded = F.aggregate("boxes", zero, step, lambda state: F.concat(state["starts"], F.array(state["i"])))
    height = F.element_at("boxes", -1)["y"] - F.get("boxes", F.lit(0))["y"]
    last = F.when(height <= F.lit(tolerance), F.array(F.lit(0), F.size("boxes"))).otherwise(folded)
    ranges = bind(
        last,
        lambda at: F.zip_with(
            F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1),
            lambda start, stop: F.struct(start.alias("start"), stop.alias("stop")),
        ),
    )
    return (
        segments.select(*_PAGE, "boxes", F.explode(ranges).alias("r"))
        .select(*_PAGE, F.slice("boxes", F.col("r.start") + 1, F.col("r.stop") - F.col("r.start")).alias("boxes"))
        .select(
            *_PAGE,
            F.get("boxes", F.lit(0))["y"].alias("line_start"),
            F.transform("boxes", lambda b: b["box"]).alias("line"),
        )
    )


def lines_from_centres(words: DataFrame, threshold: float = K.LINE_CENTRE_TOLERANCE) -> DataFrame:
    """Words to lines by their vertical centre, for words without layout keys.

    Out: doc_id, page_num, line_start (centre of the line's first word), raw_text.
    """
    centre = F.col("top") + F.col("height") / F.lit(2.0)
    lines = _lines(keep_words(words), centre, ("left", "word_idx", "text"), float(threshold), lambda c, y: (c + y) / 2)
    text = F.array_join(F.sort_array("line")["text"], " ")
    return lines.select(*_PAGE, "line_start", text.alias("raw_text"))


def number_lines_by_position(lines: DataFrame) -> DataFrame:
    """Row numbers within the page by ``line_start``."""
    return number_in_place(lines, _PAGE, ["line_start"])


def keep_cells(cells: DataFrame, min_area: int = K.MIN_CELL_AREA) -> DataFrame:
    """Cell boxes larger than the smallest area that counts as a cell."""
    return cells.where(F.col("w").cast("bigint") * F.col("h") > min_area)


def rows_from_cells(cells: DataFrame, y_tol: int = K.CELL_ROW_TOLERANCE) -> DataFrame:
    """Cell boxes to table rows: same row within the tolerance of its moving top.

    Cells of a row are sorted by ``x``; ``raw_text`` joins the non-blank ones, ``cols``
    keeps all. Out: doc_id, page_num, line_start, raw_text, cols.
    """
    halfway = lambda c, y: F.floor((c + y) / 2).cast("int")
    lines = _lines(cells, F.col("y"), ("x", "y", "w", "h", "text"), y_tol, halfway)
    cols = F.transform(F.sort_array("line")["text"], lambda t: F.coalesce(t, F.lit("")))
    return lines.select(*_PAGE, "line_start", cols.alias("cols")).select(
        *_PAGE,
        "line_start",
        F.array_join(F.filter("cols", lambda t: ~is_blank(t)), K.CELL_SEPARATOR).alias("raw_text"),
        "cols",
    )


def page_confidence(words: DataFrame, drop_missing: bool = True) -> DataFrame:
    """Mean word confidence per page: doc_id, page_num, page_confidence (null if none).

    On lines -1 means "no value" and is dropped; on table cells it is kept. Words
    without a ``conf`` column give 100.
    """
    page = ["doc_id", "page_num"]
    if "conf" not in words.columns:
        return words.select(*page).distinct().withColumn("page_confidence", F.lit(K.DEFAULT_CONFIDENCE))
    conf = F.col("conf").try_cast("double")
    known = ~F.isnan(conf)
    if drop_missing:
        known = known & (conf != K.NO_CONFIDENCE)
    return words.groupBy(*page).agg(F.avg(F.when(known, conf)).alias("page_confidence"))


def avg_confidence(words: DataFrame, drop_missing: bool = True) -> DataFrame:
    """Mean of the page means per document, pages not weighted by their words."""
    return (
        page_confidence(words, drop_missing)
        .groupBy("doc_id")
        .agg(F.avg("page_confidence").alias("avg_confidence"))
    )
