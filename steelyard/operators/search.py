"""Page search: trigram postings ranked by BM25, a scan for short queries, and the choice between them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def trigrams(text: Column) -> Column:
    """All runs of three characters of the lower-case text, in order."""
    # each match takes one character, so the next begins at the next one, and looks ahead for three
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))."), F.lit(1))


def postings(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """The inverted index ``key, gram, tf, length``: recomputed from the pages, so it can't drift from them."""
    grams = pages.select(key, trigrams(F.col(text)).alias("_g")).select(key, F.size("_g").alias("length"), F.explode("_g").alias("gram"))
    return grams.groupBy(key, "gram", "length").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def trigram_search(pages: DataFrame, query: str, *, key: str = "page_id", text: str = "text", limit: int | None = 20, snippets: bool = False) -> DataFrame:
    """Pages that contain the query (three characters or more, any case), best BM25 score first; with
    ``snippets`` each with its :func:`marked_snippet`.

    The query's trigrams are few and known, so their frequencies are counted page by page without an
    index: one scan, then sums of a row per page that has one. Of equal scores the smaller key leads.
    """
    q = query.lower()
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    # overlapping occurrences count: as many places as there are
    occurs = lambda g: F.regexp_count(t, F.concat(F.lit(r"(?=\Q"), F.lit(g), F.lit(r"\E)")))
    length = F.greatest(F.char_length(t) - 2, F.lit(0))
    shown = [marked_snippet(F.col(text), query).alias("snippet")] if snippets else []
    counted = pages.select(key, *shown, t.contains(q).alias("_hit"), length.alias("_len"), *[occurs(g).alias(f"_{i}") for i, g in enumerate(grams)])
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_{i}") > 0).alias(f"_d{i}") for i in range(len(grams))])
    both = counted.where("_hit").crossJoin(F.broadcast(totals))  # one row of totals
    norm = K1 * (1 - B + B * F.col("_len") / F.col("_avg"))
    score = F.lit(0.0)
    for i in range(len(grams)):
        score = score + idf(F.col("_n"), F.col(f"_d{i}")) * F.col(f"_{i}") * (K1 + 1) / (F.col(f"_{i}") + norm)
    out = both.select(key, F.round(score, 6).alias("score"), *["snippet"] * snippets)
    return out.orderBy(F.col("score").desc(), key).limit(limit) if limit else out


def snippet(text: Column, query: str, before: int = 30, size: int = 120) -> Column:
    """The text around the first occurrence."""
    at = F.instr(F.lower(text), query.lower())
    return F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(size))


def marked_snippet(text: Column, query: str, tokens: int = 16, marks: tuple[str, str, str] = ("【", "】", "…")) -> Column:
    """``tokens`` trigrams of the text with the query's first occurrence in their middle, as near as the text's
    ends allow; its occurrences stand between marks, and where text is left out there is another mark."""
    open_, close, more = marks
    q, n = query.lower(), max(len(query) - 2, 1)
    wide = max(tokens, n)
    at = F.instr(F.lower(text), q) - 1
    last = F.char_length(text) - 2 - wide
    start = F.greatest(F.lit(0), F.least(at - (wide - n) // 2, last))
    inside = F.regexp_replace(F.substring(text, start + 1, F.lit(wide + 2)), F.lit("(?i)" + re.escape(query)), F.lit(open_ + "$0" + close))
    shown = F.concat(F.when(start > 0, more).otherwise(""), inside, F.when(start < last, more).otherwise(""))
    return F.when(at >= 0, shown)


def scan_search(pages: DataFrame, query: str, *, key: str = "page_id", text: str = "text", order: list[str] | None = None, limit: int | None = 20) -> DataFrame:
    """Pages that contain the query literally, in order of file and page, with an excerpt."""
    hits = pages.where(F.lower(F.coalesce(F.col(text), F.lit(""))).contains(query.lower())).select(*(order or [key]), *([key] if order and key not in order else []), snippet(F.col(text), query).alias("excerpt"))
    return hits.orderBy(*(order or [key])).limit(limit) if limit else hits


def search(pages: DataFrame, query: str, *, key: str = "page_id", text: str = "text", files: list[str] | None = None, file: str = "file_id", limit: int | None = 20) -> DataFrame:
    """``key``s of the pages that a query finds: nothing for a blank one, by scan under three characters,
    else by score. The filter on files comes before the limit, and the query is text, never a pattern."""
    query = query.strip()
    if files is not None:
        pages = pages.where(F.col(file).isin(files))
    if not query:
        return pages.select(key).limit(0)
    found = trigram_search if len(query) >= 3 else scan_search
    return found(pages, query, key=key, text=text, limit=limit).select(key)


def index_drift(pages: DataFrame, index: DataFrame, key: str = "page_id") -> DataFrame:
    """Keys with pages but no postings, and postings without a page."""
    p = pages.where(F.char_length("text") >= 3).select(key)
    # both sides in one join, so that the index, which may be as dear as its pages, is read once
    both = p.withColumn("_p", F.lit(True)).join(index.select(F.col(key).alias("_k")).distinct().withColumn("_i", F.lit(True)), F.col(key) == F.col("_k"), "full")
    one = both.where("_p IS NULL OR _i IS NULL")
    return one.select(F.when(F.col("_p"), F.col(key)).otherwise(F.col("_k")).alias(key), F.when(F.col("_p"), "not_indexed").otherwise("no_page").alias("side"))


def ranked(pages: DataFrame, queries: DataFrame, index: DataFrame, k: int, key: str = "page_id") -> DataFrame:
    """The top ``k`` pages for each of many queries ``query_id, query`` over an index of postings."""
    n = index.select(key, "length").distinct().agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"))
    grams = queries.select("query_id", F.explode(F.array_distinct(trigrams(F.col("query")))).alias("gram"))
    df = index.groupBy("gram").agg(F.count("*").alias("_df"))
    hits = grams.join(df, "gram").join(index, "gram").crossJoin(F.broadcast(n))
    norm = K1 * (1 - B + B * F.col("length") / F.col("_avg"))
    scored = hits.groupBy("query_id", key).agg(F.sum(idf(F.col("_n"), F.col("_df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
