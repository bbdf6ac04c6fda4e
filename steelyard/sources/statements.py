"""Financial statements that run over pages: from the cells of reports to rows with period, scope and unit.

Lines are shuffled once, by file, and everything else is a function of the lines of one statement, six pages at most: titles
are found, lines go to the title that they stand under up to the next one, columns are clustered over all of a statement's
pages, the header above the first row names them, and of several statements of one kind and scope in a file the first that can
be read stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.functions.numeric import parse_figure
from steelyard.sources import geometry, store

# Titles with kind and scope, pages of a statement, cells of a row of data.
TITLES = (
    ("合并资产负债表", "balance", "consolidated"),
    ("合并利润表", "income", "consolidated"),
    ("合并现金流量表", "cashflow", "consolidated"),
    ("母公司资产负债表", "balance", "parent"),
    ("母公司利润表", "income", "parent"),
    ("母公司现金流量表", "cashflow", "parent"),
)
SPAN, DATA_CELLS = 6, 2
# Patterns of a title's number, units, years, header words and references to notes.
NUMBERED = r"^\s*[0-9]{1,2}\s*[、.．]\s*"
UNIT = r"单位[：:]\s*(元|千元|万元|百万元)"
YEAR = r"(20\d{2})\s*年"
HEADER, NO_COLUMN = "项目", "项目|附注|注释"
NOTE = r"^(?:附注|注)?[一二三四五六七八九十]*[（(]?[一二三四五六七八九十]{0,3}[）)]?\s*\d{1,3}$"

FILE, TABLE, PLACE = ["file_id"], ["file_id", "anchor"], ["page_no", "line"]


def place(name: str = "") -> Column:
    return F.struct(*[F.col(name + c).alias(c) for c in PLACE])


def _lines(cells: DataFrame) -> DataFrame:
    """``file_id, page_no, line, words`` of cells."""
    return cells.groupBy("file_id", *PLACE).agg(F.sort_array(F.collect_list(F.struct("cell", "text", "x0", "x1"))).alias("words"))


def _said(x: DataFrame) -> DataFrame:
    """Add ``said`` and ``full``: a line's text as read and without blanks."""
    said = F.array_join(F.transform("words", lambda c: c["text"]), "  ")
    return x.withColumns({"said": said, "full": F.regexp_replace(F.array_join(F.transform("words", lambda c: c["text"]), ""), " ", "")})


def _anchored(lines: DataFrame) -> DataFrame:
    """Each line with ``anchor``, the page of the title that it stands under, and the title lines themselves, which have
    their ``title``.

    A page with more than one title is a table of contents: it begins no statement, but ends the one before.
    A title's last page is the fifth after it or the page of the next title, whichever is earlier.
    """
    page, before = Window.partitionBy("file_id", "page_no").orderBy("line"), Window.partitionBy(*FILE).orderBy(*PLACE)
    title = F.regexp_replace("full", NUMBERED, "")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = lines.where(F.col("file_id").isNotNull()).withColumn("_title", F.when(title.isin(*[t for t, *_ in TITLES]), title))
    x = x.withColumns({"_n": F.count("_title").over(whole), "_at": F.min(F.when(F.col("_title").isNotNull(), F.col("line"))).over(whole)})
    begins = F.col("line") == F.col("_at")
    x = x.withColumn("_under", F.last(F.when(begins, F.struct("page_no", "_n")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.where((F.col("_under._n") == 1) & (F.col("page_no") < F.col("_under.page_no") + SPAN))
    return x.withColumn("title", F.when(begins, F.col("_title"))).withColumn("anchor", F.col("_under.page_no")).drop("_title", "_n", "_at", "_under")


def _figures(words: Column) -> Column:
    """Cells with a figure or a dash, from left to right."""
    read = F.transform(words, lambda c: F.struct(c["cell"].alias("cell"), c["text"].alias("text"), c["x0"].alias("x0"), c["x1"].alias("x1"), parse_figure(c["text"], geometry.once).alias("f")))
    return F.filter(read, lambda c: c["f"]["value"].isNotNull() | c["f"]["is_dash"])


def _labels(heads: Column, columns: Column) -> Column:
    """The header's text for each column from left to right: of the cells right of the one before, that with the
    nearest centre to the column's."""
    state = "struct<last:int,labels:array<string>>"

    def step(s: Column, column: Column) -> Column:
        middle = (column["left"] + column["right_max"]) / 2
        free = F.filter(F.transform(heads, lambda c, k: F.struct(F.abs((c["x0"] + c["x1"]) / 2 - middle).alias("d"), k.alias("k"), c["text"].alias("t"))), lambda c: c["k"] > s["last"])
        best = F.array_min(free)
        return F.struct(F.coalesce(best["k"], s["last"]).alias("last"), F.array_append(s["labels"], F.coalesce(best["t"], F.lit(""))).alias("labels")).cast(state)

    return F.aggregate(columns, F.struct(F.lit(-1).alias("last"), F.array().alias("labels")).cast(state), step, lambda s: s["labels"])


def _years(labels: Column, stated: Column, report: Column) -> tuple[Column, Column]:
    """Each column's year and where it is from: the header, the date above it, or the report's own year. The
    latter two count down from the first column; without any there is none, never a guess."""
    read = F.transform(labels, lambda t: F.nullif(F.regexp_extract(t, YEAR, 1), F.lit("")))
    whole = ~F.exists(read, lambda y: y.isNull())
    first = F.coalesce(stated, report).cast("int")
    counted = F.transform(labels, lambda t, k: (first - k).cast("string"))
    source = F.when(whole, "header").when(stated.isNotNull(), "statement_date").when(report.isNotNull(), "report_year")
    return F.when(whole, read).otherwise(counted), source


def tables(cells: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`of_lines` of the lines that ``cells``, those of :mod:`steelyard.sources.geometry`, make."""
    return of_lines(_lines(cells), reports)


def of_lines(lines: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(statements, rows)``.

    ``lines`` are those of :func:`steelyard.sources.geometry.page_lines`, each once, ``reports`` has ``file_id, report_year`` (text or
    null). ``statements``: ``file_id, page_no, title, kind, scope, unit, period_source, refused``, one row for each
    title, with the reason if it is not read (``no_unit``, ``no_rows``, ``no_header``, ``no_columns``,
    ``no_period``, ``repeated``). ``rows``: ``file_id, kind, scope, title, label, note, column, period,
    period_kind, period_source, value, is_dash, unit, page_no, line, source_text``, one for each figure in a
    column; a dash is no value. A balance is of an instant, flows are of the year.
    """
    whole = store.written(_statements(_labelled(_anchored(_said(lines.select("file_id", *PLACE, "words").repartition(*FILE)))), reports), "statements")
    shown = F.when(F.col("refused").isNull() | (F.col("refused") == "repeated"), F.col("period_source")).alias("period_source")
    period_kind = F.when(F.col("kind") == "balance", "instant").otherwise("current").alias("period_kind")
    x = whole.where("refused IS NULL").select("file_id", "kind", "scope", "title", period_kind, "period_source", "unit", "years", F.explode("rows").alias("_r"))
    x = x.select("*", F.explode("_r.values").alias("_v"))
    rows = x.select(
        "file_id", "kind", "scope", "title", "_r.label", "_r.note", "_v.column", F.get("years", F.col("_v.column")).alias("period"), "period_kind", "period_source",
        F.col("_v.f.value").alias("value"), F.col("_v.f.is_dash").alias("is_dash"), "unit", "_r.page_no", "_r.line", F.col("_r.said").alias("source_text"),
    )
    return whole.select("file_id", F.col("anchor").alias("page_no"), "title", "kind", "scope", "unit", shown, "refused"), rows


def _statements(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """A row for each title: its kind, unit, years and rows, or why it is refused. Its lines meet in one array, as they
    are on six pages at most."""
    own, at = F.col("title").isNull(), [F.col(c) for c in PLACE]
    unit = F.nullif(F.regexp_extract("full", UNIT, 1), F.lit(""))
    year = F.regexp_extract("full", YEAR, 1)
    listed = lambda of, *what: F.collect_list(F.when(own & of, F.struct(*at, *what)))
    x = lines.groupBy(*TABLE).agg(
        F.max("title").alias("title"), F.min(F.when(own & unit.isNotNull(), F.struct(*at, unit.alias("unit"))))["unit"].alias("unit"),
        F.min(F.when(own & (F.size("_f") >= DATA_CELLS), place())).alias("first"), listed(F.col("words").isNotNull(), "words").alias("_heads"),
        listed(F.col("full").rlike(YEAR), year.alias("y")).alias("_dated"), listed(F.size("_f") > 0, "label", "note", "said", "_f").alias("_body"),
    )
    kind = {c: F.element_at(F.create_map(*[F.lit(v) for row in TITLES for v in (row[0], row[k])]), F.col("title")) for k, c in ((1, "kind"), (2, "scope"))}
    of = lambda c: F.struct(*[c[k].alias(k) for k in PLACE])
    # the last line above the first row of data that has the header's word, and the nearest year above that
    x = x.withColumns(kind).withColumn("_head", F.array_max(F.filter("_heads", lambda c: of(c) < F.col("first"))))
    x = x.withColumn("head", F.when(F.col("_head").isNotNull(), of(F.col("_head"))))
    stated = F.array_max(F.filter("_dated", lambda c: of(c) < F.col("head")))["y"]
    body = F.filter("_body", lambda c: of(c) > F.col("head"))
    x = x.withColumns({"heads": F.filter("_head.words", lambda c: ~c["text"].rlike(NO_COLUMN)), "stated": stated, "_body": body})
    x = x.withColumn("columns", geometry.figure_columns(F.flatten(F.transform("_body", lambda c: c["_f"]))))
    x = x.join(reports.select("file_id", F.col("report_year").cast("string").alias("report_year")), "file_id", "left")
    years, source = _years(F.col("_labels"), F.col("stated"), F.col("report_year"))
    x = x.withColumn("_labels", _labels(F.col("heads"), F.col("columns"))).withColumns({"years": years, "period_source": source, "rows": _rows(F.col("_body"), F.col("columns"))})
    refused = (
        F.when(F.col("unit").isNull(), "no_unit").when(F.col("first").isNull(), "no_rows").when(F.col("heads").isNull(), "no_header")
        .when(F.col("columns").isNull(), "no_columns").when(F.exists("years", lambda y: y.isNull()), "no_period").when(F.size("rows") == 0, "no_rows")
    )
    x = x.select(*TABLE, "title", "kind", "scope", "unit", "period_source", "years", "rows", refused.alias("refused"))
    first = F.min(F.when(F.col("refused").isNull(), F.col("anchor"))).over(Window.partitionBy("file_id", "kind", "scope"))
    repeated = F.col("refused").isNull() & (F.col("anchor") > first)
    return x.withColumn("refused", F.when(repeated, "repeated").otherwise(F.col("refused")))


def _labelled(lines: DataFrame) -> DataFrame:
    """Add the figures ``_f``, add ``label`` and ``note`` to lines with figures, and leave cells only to those that may be headers. A line's label
    is what stands before its first figure or reference to a note."""
    note = F.filter("words", lambda c: F.regexp_replace(c["text"], " ", "").rlike(NOTE))
    edge = F.least(F.array_min(F.transform("_f", lambda c: c["x0"])), F.array_min(F.transform("_note", lambda c: c["x0"])))
    label = F.array_join(F.transform(F.filter("words", lambda c: c["x1"] < F.col("_edge")), lambda c: c["text"]), "")
    x = lines.withColumn("_f", _figures(F.col("words"))).withColumn("_note", F.when(F.size("_f") > 0, note)).withColumn("_edge", edge).withColumns({"note": F.get("_note", F.lit(0))["text"], "label": F.trim(label)})
    return x.withColumn("words", F.when(F.col("full").contains(HEADER), F.col("words"))).drop("_note", "_edge")


def _rows(body: Column, columns: Column) -> Column:
    """The figures of each line in their columns, of several in one column the last. Lines without a label are none, nor
    those with no figure in a column."""
    inside = lambda c, k: (c["x1"] >= k["right_min"] - geometry.COLUMN) & (c["x1"] <= k["right_max"] + geometry.COLUMN)
    hit = lambda c, of: F.struct(F.get(F.filter(of, lambda k: inside(c, k)), F.lit(0))["column"].alias("column"), c["cell"].alias("cell"), c["f"].alias("f"))
    hits = lambda line, of: F.filter(F.transform(line["_f"], lambda c: hit(c, of)), lambda h: h["column"].isNotNull())
    last = lambda hs: F.filter(hs, lambda h: ~F.exists(hs, lambda g: (g["column"] == h["column"]) & (g["cell"] > h["cell"])))
    row = lambda line, of: F.struct(*[line[k].alias(k) for k in (*PLACE, "label", "note", "said")], geometry.once(hits(line, of), last).alias("values"))
    return geometry.once(columns, lambda of: F.filter(F.transform(F.filter(body, lambda line: line["label"] != ""), lambda line: row(line, of)), lambda r: F.size(r["values"]) > 0))
