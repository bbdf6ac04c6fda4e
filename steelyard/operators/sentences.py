"""Sentences of report text: wrapped lines joined to paragraphs, tables and headings left out, years of plans carried.

A section's lines are folded once, in their order, into blocks: whether a line goes on with the block before it
depends on that block as it is by then. A section is a page or a chapter's part of one, so a fold is over that many
lines; sections are independent, and what a file carries from one to the next, the year of a plan, is a window over
its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.operators.extraction import PLAN_HEADING, TOP_HEADING
from steelyard.sources import store

# Ends of sentences, ends after which no line goes on, headings, captions of tables, gaps of columns.
END, STOP = "。！？；", "。！？；："
HEADING = r"^(?U)\s*(?:[（(]?[一二三四五六七八九十]+[）)、.]|[（(]?\d+[）)、.]|\d+[、.])\s*[^。！？；]{0,40}$"
CAPTION = r"(数据来源|资料来源|单位[:：]|注[:：])"
GAP = r"(?U)\s{2,}|\t"
# Cells of tables.
NUMERIC = r"^(?U)[-−—–\s]*(?:\d[\d,]*(?:\.\d+)?%?)?[-−—–\s]*$"
BARE = r"^[-−—–]?\d[\d,]*(?:\.\d+)?$"
GLUED = r"^\d[\d,]*(?:\.\d+)?[一-鿿]"
LINK = "http|投资者关系活动记录表"
LABEL_LENGTH, LABEL_HAN = 14, 2
CELLS, RUN, SPREAD, MOSTLY, LONG = 3, 3, 0.18, 0.5, 8
#: Sentences of fewer characters are fragments.
SHORTEST = 8
#: Sections of a task.
SECTIONS = 20_000


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _any(text: Column, characters: str) -> Column:
    return text.rlike(f"[{characters}]")


def is_table_row(line: Column) -> Column:
    """Whether a line is a row of a table, which its gaps tell, never the share of figures among its words: cells of
    figures but for one; a label and a figure; three figures one after the other; one bare figure among cells
    that are no sentences; a label and a figure that its text is glued to; many digits over several cells without an
    end; a link in cells without an end. A line of which most is digits is one without gaps as well."""
    bare = trim(line)
    cells = F.filter(F.split(bare, GAP), lambda c: trim(c) != "")
    n = F.size(cells)
    number = lambda c: c.rlike(NUMERIC)
    numbers = F.size(F.filter(cells, number))
    digits = F.length(F.regexp_replace(bare, r"(?U)[^\d]", ""))
    share = F.try_divide(digits, F.length(bare))
    ended = F.substring(bare, -1, 1).isin(*STOP)
    most = (n >= CELLS) & (numbers >= n - 1)
    pair = (n == 2) & number(F.get(cells, F.lit(1))) & ~ended
    # figures one after the other, as places in the list of cells
    runs = F.exists(F.sequence(F.lit(0), F.greatest(n - RUN, F.lit(0))), lambda k: F.forall(F.slice(cells, k + 1, RUN), number)) & (n >= RUN)
    lone = (n >= CELLS) & (F.size(F.filter(cells, lambda c: trim(c).rlike(BARE))) == 1) & ~F.exists(cells, lambda c: ~trim(c).rlike(BARE) & _any(c, STOP))
    label = F.get(cells, F.lit(0))
    glued = (n == 2) & F.get(cells, F.lit(1)).rlike(GLUED) & (F.length(label) <= LABEL_LENGTH) & ~_any(label, STOP + "，、（）()") & (F.length(F.regexp_replace(label, "[^一-鿿]", "")) >= LABEL_HAN) & ~F.substring(bare, -1, 1).isin(*"。！？")
    spread = (n >= CELLS) & ~_any(bare, END) & (share > SPREAD)
    link = (n >= CELLS) & ~_any(bare, "。！？") & bare.rlike(LINK)
    dense = (F.length(bare) >= LONG) & (share > MOSTLY)
    return F.coalesce((bare != "") & (most | pair | runs | lone | glued | spread | link | dense), F.lit(False))


def _closed(block: Column) -> Column:
    """Whether nothing goes on with a block."""
    return (trim(block) == "") | F.substring(block, -1, 1).isin(*STOP) | block.rlike(HEADING) | block.rlike(CAPTION) | is_table_row(block)


def _begins(line: Column) -> Column:
    """Whether a line begins a block: empty, a heading, a caption of a table, or cells."""
    bare = trim(line)
    return (bare == "") | bare.rlike(HEADING) | bare.rlike("^" + CAPTION) | bare.rlike(GAP)


def blocks(text: Column) -> Column:
    """The text's lines with wrapped ones joined, as an array. Captions are looked for in joined lines as well."""
    state = "struct<done:array<string>,last:string>"
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))

    def step(s: Column, line: Column) -> Column:
        first = s["last"].isNull()
        new = first | _begins(line) | _closed(s["last"])
        done = F.when(new & ~first, F.array_append(s["done"], s["last"])).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(new, line).otherwise(F.concat(s["last"], F.regexp_replace(line, r"^(?U)\s+", ""))).alias("last")).cast(state)

    start = F.struct(F.array().alias("done"), F.lit(None).alias("last")).cast(state)
    return F.aggregate(lines, start, step, lambda s: F.when(s["last"].isNotNull(), F.array_append(s["done"], s["last"])).otherwise(s["done"]))


def _pieces(line: Column) -> Column:
    """The sentences of a paragraph with their offsets in it."""
    state = "struct<at:int,out:array<struct<sentence:string,at:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state)
    cut = F.transform(F.split(line, f"(?<=[{END}])"), trim)

    def step(s: Column, piece: Column) -> Column:
        return F.struct((s["at"] + F.length(piece)).alias("at"), F.array_append(s["out"], F.struct(piece.alias("sentence"), s["at"].alias("at"))).alias("out")).cast(state)

    return F.aggregate(cut, start, step, lambda s: s["out"])


def sentences(sections: DataFrame, *, shortest: int = SHORTEST) -> DataFrame:
    """``file_id, section_id, position, n, sentence, char_at, paragraph, plan_year`` of sections ``file_id, section_id,
    position, text`` (other columns are kept), in the order of ``position`` in a file.

    ``n`` counts a section's sentences, ``char_at`` is the place in its joined text, ``paragraph`` the whole block. Headings,
    rows of tables and fragments are none. A heading of a plan sets ``plan_year`` for all that follows in the
    file, over pages and sections, until another top heading; the heading itself is no sentence.
    """
    rest = [c for c in sections.columns if c not in ("file_id", "section_id", "position", "text")]
    # all windows below are inside of a file; counting the sections is one more pass over them
    x = store.spread(sections, SECTIONS, "file_id").select("file_id", "section_id", "position", *rest, F.posexplode(blocks(F.col("text"))).alias("_b", "_line"))
    w = Window.partitionBy("file_id").orderBy("position", "section_id", "_b").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("file_id", "section_id").orderBy("position", "_b")
    # the texts go through the windows once
    x = x.select("file_id", "section_id", "position", *rest, "_b", trim(F.col("_line")).alias("paragraph"), (F.length("_line") + 1).alias("_length"))
    mark = F.when(F.col("paragraph").rlike(PLAN_HEADING), F.regexp_extract("paragraph", PLAN_HEADING, 1)).when(F.col("paragraph").rlike(TOP_HEADING), "")
    start = F.coalesce(F.sum("_length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumns({"plan_year": F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")), "_start": start})
    x = x.where((F.col("paragraph") != "") & ~is_table_row(F.col("paragraph")) & ~F.col("paragraph").rlike(HEADING))
    x = x.select("*", F.explode(_pieces(F.col("paragraph"))).alias("_p")).where(F.length("_p.sentence") >= shortest)
    n = F.row_number().over(Window.partitionBy("file_id", "section_id").orderBy("position", "_b", "_p.at")) - 1
    return x.select("file_id", "section_id", "position", *rest, n.alias("n"), "_p.sentence", (F.col("_start") + F.col("_p.at")).cast("int").alias("char_at"), "paragraph", "plan_year")


def page_sections(lines: DataFrame) -> DataFrame:
    """Sections ``file_id, section_id, position, kind, text``, one for each page of a report's discussion and each of
    its parts, of lines ``file_id, page_no, line_no, line`` of whole reports."""
    from steelyard.operators import extraction

    own = extraction.subsections(extraction.sections(lines))
    g = own.groupBy("file_id", "page_no", "kind", "title").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    g = g.withColumn("position", F.col("page_no") * F.lit(100_000).cast("long") + F.col("_l")[0]["line_no"])
    text = F.array_join(F.transform("_l", lambda s: s["line"]), "\n")
    return g.select("file_id", F.concat_ws("-", "file_id", F.col("position").cast("string")).alias("section_id"), "position", "kind", text.alias("text"))


def report_claims(lines: DataFrame, reports: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """From lines of whole reports to claims in one go. ``reports`` has ``file_id, project_id, report_period``."""
    from steelyard.operators import extraction

    found = sentences(store.written(page_sections(lines), "sections")).join(reports.select("file_id", "project_id", "report_period"), "file_id")
    return extraction.claims(found, aliases)
