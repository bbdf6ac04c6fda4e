"""Tables from the characters of pages: lines, wrapped lines, cells and columns.

Input is one row per character, ``file_id, page_no, c, x0, x1, y0, height``, as any reader of page
descriptions gives it, or one row per page with its characters as an array. Steps that look at neighbours
are functions of a page's array, or of many pages' arrays at once; a page is the largest thing that is looked at together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from steelyard.functions.numeric import parse_figure

# Fixed values, in points: margins of a page, and how near characters, lines, cells and columns are.
TOP, BOTTOM, LINE, WRAP, CELL, COLUMN = 60.0, 80.0, 3.0, 10.0, 10.0, 15.0
MIN_ROWS, NOTE_MAX = 3, 10_000
NOTE = "^[0-9]{1,4}$"

PAGE = ["file_id", "page_no"]


def body(chars: DataFrame, *, skip_header_footer: bool = True) -> DataFrame:
    """Visible characters, without those in the head and foot of the page."""
    seen = F.trim("c") != ""
    return chars.where(seen & (F.col("y0") > TOP) & (F.col("y0") < F.col("height") - BOTTOM)) if skip_header_footer else chars.where(seen)


def packed(chars: DataFrame) -> DataFrame:
    """Pages ``file_id, page_no, chars``, each with its characters as an array: the one time that they are shuffled."""
    return chars.groupBy(*PAGE).agg(F.collect_list(F.struct("c", "x0", "x1", "y0", "height")).alias("chars"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _ys(page: Column) -> Column:
    """A page's heights, each once, from the top."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(page, lambda c: c["y0"]))))


def _heights(ys: Column) -> Column:
    """The line of each of a page's heights, which are distinct and in order: they are folded over once."""
    state = "struct<top:double,line:int,lines:array<int>>"
    start = F.struct(F.lit(None).alias("top"), F.lit(-1).alias("line"), F.array().alias("lines")).cast(state)

    def step(s: Column, y: Column) -> Column:
        first = s["top"].isNull()
        new = first | (y - s["top"] > LINE)
        line = s["line"] + F.when(new & (first | (y - s["top"] >= WRAP)), 1).otherwise(0)
        return F.struct(F.when(new, y).otherwise(s["top"]).alias("top"), line.alias("line"), F.array_append(s["lines"], line).alias("lines")).cast(state)

    return F.aggregate(ys, start, step, lambda s: s["lines"])


def lines(chars: DataFrame) -> DataFrame:
    """Add ``line``: characters up to 3 points below the first of their physical line share it, and a
    physical line less than 10 points below the one before it is wrapped and joins its line."""
    rest = [c for c in chars.columns if c not in PAGE]
    numbered = lambda page, y, of: F.transform(page, lambda c: F.struct(c.alias("_c"), F.get(of, (F.array_position(y, c["y0"]) - 1).cast("int")).alias("line")))
    pages = chars.groupBy(*PAGE).agg(F.collect_list(F.struct(*rest)).alias("_p"))
    found = once(F.col("_p"), lambda p: once(_ys(p), lambda y: once(_heights(y), lambda of: numbered(p, y, of))))
    return pages.select(*PAGE, F.explode(found).alias("_l")).where("_l.line IS NOT NULL").select(*PAGE, "_l._c.*", "_l.line").select(*chars.columns, "line")


def _cut(own: Column) -> Column:
    """Cells ``line, cell, text, x0, x1, y`` of characters ``line, x0, y0, c, x1``, in order, cut at lines and gaps."""

    def begins(s: Column) -> Column:
        gap = lambda c, i: (c["line"] != F.get(s, i - 1)["line"]) | F.coalesce(c["x0"] - F.get(s, i - 1)["x1"] > CELL, F.lit(False))
        return F.filter(F.transform(s, lambda c, i: F.when((i == 0) | gap(c, i), i)), lambda i: i.isNotNull())

    def cell(s: Column, starts: Column, of: Column, at: Column, k: Column) -> Column:
        part = F.slice(s, at + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - at)
        line = F.get(of, k)
        return once(part, lambda p: F.struct(
            line.alias("line"), (k + 1 - F.array_position(of, line)).cast("int").alias("cell"), F.array_join(F.transform(p, lambda c: c["c"]), "").alias("text"),
            F.array_min(F.transform(p, lambda c: c["x0"])).alias("x0"), F.array_max(F.transform(p, lambda c: c["x1"])).alias("x1"), F.array_min(F.transform(p, lambda c: c["y0"])).alias("y")))

    lines_of = lambda s, starts: F.transform(starts, lambda i: F.get(s, i)["line"])
    return once(own, lambda s: once(begins(s), lambda starts: once(lines_of(s, starts), lambda of: F.transform(starts, lambda at, k: cell(s, starts, of, at, k)))))


_SORTED = ("line", "x0", "y0", "c", "x1")


def cells(lined: DataFrame) -> DataFrame:
    """``line, cell, text, x0, x1, y``: characters of a line cut where more than 10 points lie between two."""
    g = lined.groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list(F.struct(*_SORTED))).alias("_s"))
    return g.select(*PAGE, F.inline(_cut(F.col("_s"))))


#: Characters that are laid out at once: a batch of pages goes through in parts of about so many, whole pages each.
PART = 500_000
WORDS = "array<struct<cell:int,text:string,x0:double,x1:double,y:double>>"


def _number(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, and where they are not null."""
    return pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)


def _numbered(page: np.ndarray, y: np.ndarray) -> np.ndarray:
    """:func:`_heights` of many pages: the line of each character by its page's number and its height."""
    same = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (y[1:] != y[:-1])))
    order = np.lexsort((y[same], page[same]))
    out, at, top, last, line = np.empty(len(same), dtype=np.int64), -1, None, None, -1
    for k, p, v in zip(order.tolist(), page[same][order].tolist(), y[same][order].tolist(), strict=True):
        if p != at:
            at, top, last, line = p, None, None, -1
        # a height counts once; written so that what is no number is far below all others, as it sorts
        if top is None or not (v == last or (v != v and last != last) or v - top <= LINE):
            line += top is None or not v - top < WRAP
            top = v
        out[k], last = line, v
    return np.repeat(out, np.diff(np.append(same, len(page))))


def _laid(pages: pa.ListArray, skip: bool) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """The lines of pages: the page's place, the line's number and its cells. The same as :func:`cells` of :func:`lines`."""
    page, chars = pc.list_parent_indices(pages).to_numpy(), pages.flatten()
    c, x0, x1, y0, height = (dict(zip((f.name for f in chars.type), chars.flatten(), strict=True))[k] for k in ("c", "x0", "x1", "y0", "height"))
    (y, known), (h, high) = _number(y0), _number(height)
    seen = pc.fill_null(pc.not_equal(pc.utf8_trim(c, " "), ""), False).to_numpy(zero_copy_only=False) & known
    if skip:
        seen &= high & ((y > TOP) | np.isnan(y)) & ((y < h - BOTTOM) | (np.isnan(h) & ~np.isnan(y)))
    at = np.flatnonzero(seen)
    page, y, (left, has_left), (right, has_right) = page[at], y[at], *((v[at], w[at]) for v, w in (_number(x0), _number(x1)))
    if not len(at):
        return page, page, pa.array([], pa.list_(pa.struct([])))
    line = _numbered(page, y)
    key = page * (line.max() + 1) + line
    order = np.argsort(key, kind="stable")
    k, x = key[order], np.where(has_left, left, -np.inf)[order]
    # lines whose characters don't follow each other from left to right are sorted as their rows are
    mixed = np.unique(k[1:][(k[1:] == k[:-1]) & ~(x[1:] > x[:-1])])
    if len(mixed):
        own = np.flatnonzero(np.isin(k, mixed))
        i = order[own]
        rank = np.unique(np.array(c.take(pa.array(at[i])).to_pylist(), dtype=object), return_inverse=True)[1]
        order[own] = i[np.lexsort((right[i], has_right[i], rank, y[i], left[i], has_left[i], key[i]))]
    page, line, key, y, left, has_left, right, has_right = (v[order] for v in (page, line, key, y, left, has_left, right, has_right))
    new = np.append(True, key[1:] != key[:-1])
    with np.errstate(invalid="ignore"):
        gap = np.append(False, has_left[1:] & has_right[:-1] & ~(left[1:] - right[:-1] <= CELL))
    starts = np.flatnonzero(new | gap)
    first = np.flatnonzero(new[starts])
    # a cell's text are characters that follow each other: only borders are taken out
    text = c.cast(pa.string()).take(pa.array(at[order]))
    borders = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1][np.append(starts, len(text))]
    number = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    known = lambda has: np.logical_or.reduceat(has, starts)
    found = [
        pa.array(number.astype(np.int32)), pa.StringArray.from_buffers(len(starts), pa.py_buffer(borders.tobytes()), text.buffers()[2]),
        pa.array(np.fmin.reduceat(np.where(has_left, left, np.nan), starts), mask=~known(has_left)),
        pa.array(np.maximum.reduceat(np.where(has_right, right, -np.inf), starts), mask=~known(has_right)), pa.array(np.fmin.reduceat(y, starts)),
    ]
    words = pa.ListArray.from_arrays(pa.array(np.append(first, len(starts)).astype(np.int32)), pa.StructArray.from_arrays(found, names=["cell", "text", "x0", "x1", "y"]))
    return page[starts[first]], line[starts[first]].astype(np.int32), words


def page_lines(pages: DataFrame, *, skip_header_footer: bool = True) -> DataFrame:
    """``line, words`` of pages ``file_id, page_no, chars``: :func:`cells` of :func:`lines` of the :func:`body`, each line
    with its cells as an array and each page by itself, so nothing is shuffled and characters are never rows."""

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy()
            part = (np.cumsum(size) - size) // PART
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(a, b - a)
                page, line, words = _laid(piece.column(2), skip_header_footer)
                if len(page):
                    at = pa.array(page)
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(at), piece.column(1).take(at), pa.array(line), words], names=[*PAGE, "line", "words"])

    keys = StructType([pages.schema[k] for k in PAGE])
    return pages.select(*PAGE, "chars").mapInArrow(laid, StructType([*keys, StructField("line", IntegerType()), StructField("words", DataType.fromDDL(WORDS))]))


def page_cells(pages: DataFrame, *, skip_header_footer: bool = True) -> DataFrame:
    """The cells of :func:`page_lines`, one row each."""
    return page_lines(pages, skip_header_footer=skip_header_footer).select(*PAGE, "line", F.inline("words"))


def columns(cells_: DataFrame, min_rows: int = MIN_ROWS, by: list[str] = PAGE, notes: bool = True) -> DataFrame:
    """``column, left, right_min, right_max`` of each page, or of what ``by`` names: figures are aligned right, so
    cells whose right ends follow each other within 15 points make a column, if there are three. Columns of bare
    small whole numbers are note numbers and go, unless all are or there are no ``notes``."""
    figure = parse_figure(F.col("text"))
    x = cells_.where(figure["value"].isNotNull() | figure["is_dash"])
    w = Window.partitionBy(*by).orderBy("x1", "line", "cell")
    x = x.withColumn("_new", F.when(F.col("x1") - F.lag("x1").over(w) > COLUMN, 1).otherwise(0)).withColumn("column", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    note = F.col("text").rlike(NOTE)
    g = x.groupBy(*by, "column").agg(F.count("*").alias("_n"), F.min(note.cast("int")).alias("_note"), F.min("x0").alias("left"), F.min("x1").alias("right_min"), F.max("x1").alias("right_max")).where(F.col("_n") >= min_rows)
    g = g.withColumn("_all", F.min("_note").over(Window.partitionBy(*by))).where((F.col("_note") == 0) | (F.col("_all") == 1) | F.lit(not notes))
    order = Window.partitionBy(*by).orderBy("right_min")
    return g.select(*by, (F.row_number().over(order) - 1).alias("column"), "left", "right_min", "right_max")


def figure_columns(figures: Column, min_rows: int = MIN_ROWS) -> Column:
    """:func:`columns` of an array of figures ``text, x0, x1``: an array of ``column, left, right_min, right_max``, null if
    there is none."""

    def begins(s: Column) -> Column:
        gap = lambda c, i: F.coalesce(c["x1"] - F.get(s, i - 1)["x1"] > COLUMN, F.lit(False))
        return F.filter(F.transform(s, lambda c, i: F.when((i == 0) | gap(c, i), i)), lambda i: i.isNotNull())

    def group(p: Column) -> Column:
        end = F.transform(p, lambda c: c["x1"])
        return F.struct(F.size(p).alias("n"), (~F.exists(p, lambda c: ~c["note"])).alias("note"), F.array_min(F.transform(p, lambda c: c["x0"])).alias("left"), F.array_min(end).alias("right_min"), F.array_max(end).alias("right_max"))

    def groups(s: Column, starts: Column) -> Column:
        part = lambda at, k: F.slice(s, at + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - at)
        return F.filter(F.transform(starts, lambda at, k: once(part(at, k), group)), lambda g: g["n"] >= min_rows)

    def own(g: Column) -> Column:
        return once(F.exists(g, lambda c: ~c["note"]), lambda some: F.filter(g, lambda c: ~c["note"] | ~some))

    numbered = lambda g: F.transform(g, lambda c, k: F.struct(k.alias("column"), c["left"].alias("left"), c["right_min"].alias("right_min"), c["right_max"].alias("right_max")))
    sorted_ = F.sort_array(F.transform(figures, lambda c: F.struct(c["x1"].alias("x1"), c["x0"].alias("x0"), c["text"].rlike(NOTE).alias("note"))))
    found = once(sorted_, lambda s: once(begins(s), lambda starts: once(groups(s, starts), own)))
    return once(found, lambda g: F.when(F.size(g) > 0, numbered(g)))
