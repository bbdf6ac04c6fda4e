"""Operator 6: quality rules as a short-circuit cascade, in DataFrame functions alone."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm.common import WORD, table

#: Rows of the sample on which a rule's cost and selectivity are estimated.
SAMPLE_ROWS = 1000
#: How often a rule runs over each row of the sample in one job.
REPEATS = 3
WINDOW = 8


def words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"), 1)


def count(text: str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0)).cast("long")


def dup_lines(text: str) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(lines), lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))[0]


def repeat_words(ws: Column, k: int = WINDOW) -> Column:
    """Words inside windows of ``k`` words that the text holds twice or more.

    A window is the 64-bit hash of its words. Texts without two equal hashes, nearly all, end there;
    else hashes with their positions are sorted, runs of equal hashes keep their positions, and in order
    of position each adds the words up to the next one, ``k`` at most.
    """

    def covered(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda a, i, j: F.coalesce(F.get(a, j)["h"] == F.get(a, i)["h"], F.lit(False))
        hit = lambda a: F.array_sort(F.transform(F.filter(a, lambda x, i: same(a, i, i - 1) | same(a, i, i + 1)), lambda x: x["i"]))
        gaps = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0).cast("long"), lambda s, x: s + x)
        return F.transform(F.transform(F.array(at), hit), gaps)[0]  # arrays of one bind a value, so lambdas don't recompute it

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))[0]

    return F.transform(F.array(ws), lambda w: F.when(F.size(w) > k, of(w)).otherwise(F.lit(0).cast("long")))[0]


def measure(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add the base metrics ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and
    ``base_failed`` (fewer than 20 words, or over 30 in 100 words in repeated windows).

    A null or empty text has no words and fails; input columns of these names, in whatever case, give way; rows are judged
    one by one, so repeated rows agree, and an empty table gives no rows.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_lang_words")
    kept = [c for c in docs.columns if c.lower() not in names]
    # words with their ends only once: the array feeds the window hashes, counts come from the text
    out = docs.select(
        *kept,
        count(text, WORD).alias("n_words"),
        F.coalesce(F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long").alias("word_chars"),
        count(text, r"[#*$%&|<>]").alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        repeat_words(words(text)).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


#: Rules beyond the base, each true where a text is to go. Fixed thresholds.
RULES: dict[str, Column | str] = {
    "symbols": "n_symbols * 10 > n_words",
    "dup_lines": r"n_dup_lines * 10 > 3 * size(filter(split(coalesce(text, ''), '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]'))",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "shouting": r"3 * regexp_count(coalesce(text, ''), '(?<![^\\x20\\x09-\\x0D])\\p{Lu}{2}') > n_words",
    "no_letters": r"2 * regexp_count(coalesce(text, ''), '(?<![^\\x20\\x09-\\x0D])\\p{L}') < n_words",
}


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About ``rows`` rows, measured: the others are not."""
    n = docs.count()
    return measure(docs.sample(min(1.0, rows / n), seed=seed) if n else docs)


def order_rules(sample: DataFrame, rules: dict[str, Column | str], *, repeats: int = REPEATS) -> list[tuple[str, float, float]]:
    """``(rule, seconds, rejected share)`` in order of rejections per second on a measured sample.

    The sample is held in memory with each row ``repeats`` times, so that a rule's own work outweighs a
    job's; each rule runs over it alone, the best of two runs counts, and what a rule that does nothing
    takes is deducted. Only the order comes from here, so a verdict never depends on the sample or the clock.
    """
    sample = sample.coalesce(4).cache()
    try:
        size = max(1, sample.count())
        # the repeat is part of the row, so no rule is evaluated once for all repeats
        many = sample.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def run(rule: Column | str) -> tuple[float, int]:
            bad = F.coalesce(_column(rule), F.lit(False)) & (F.col("_repeat") > 0)
            took = []
            for _ in range(2):
                began = time.perf_counter()
                rejected = many.agg(F.coalesce(F.sum(bad.cast("int")), F.lit(0))).first()[0]
                took.append(time.perf_counter() - began)
            return min(took), rejected

        idle = run(F.lit(False))[0]
        found = [(name, max(took - idle, 1e-6), rejected / repeats / size) for name, rule in rules.items() for took, rejected in (run(rule),)]
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def _column(rule: Column | str) -> Column:
    return F.expr(rule) if isinstance(rule, str) else rule


def cascade(docs: DataFrame, rules: dict[str, Column | str] | None = None, **sample) -> DataFrame:
    """Measure ``docs`` and add ``kept``: whether no rule rejects a row.

    ``base_failed`` rows end the cascade at once. The other rules follow in the order of
    :func:`order_rules`, in one CASE expression, which evaluates no rule behind the first that rejects.
    Which rule that is depends on the clock and is not told; :func:`failures` names all that reject a row.
    A rule that is null counts as passed. Null, empty and repeated texts and empty tables: as in
    :func:`measure`; a very long text is one row like others; input columns of these names give way.
    """
    rules = RULES if rules is None else rules
    chain = F.when(F.coalesce("base_failed", F.lit(False)), False)
    for name, _, _ in order_rules(sample_of(docs, **sample), rules):
        chain = chain.when(F.coalesce(_column(rules[name]), F.lit(False)), False)
    return measure(docs).withColumn("kept", chain.otherwise(True))


def failures(measured: DataFrame, rules: dict[str, Column | str] | None = None) -> DataFrame:
    """Add ``failed_rules``, the names of all rules that reject a measured row, in their own order, for reports."""
    bad = [F.when(F.coalesce(_column(rule), F.lit(False)), name) for name, rule in {"base": "base_failed", **(RULES if rules is None else rules)}.items()]
    return measured.withColumn("failed_rules", F.array_compact(F.array(*bad)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(10)) AS win FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM h),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, text, len(lines) AS n_lines, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, w
      FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 3 * len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}{2}'))) > n_words OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '^\p{L}'))) < n_words) AS kept
FROM b
"""
