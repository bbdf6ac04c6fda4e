"""What reviewers fill in, on its way back: all errors of every row, ids that moved found again, all rows or none.

Rows are text as a sheet has it. A rule is a condition that an error fulfils; a row carries the names of all its errors,
and an import with one error takes no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steelyard.functions.text import squeeze
from steelyard.operators.relational import unique_prefix

PENDING = "pending"
#: Shorter texts find their claim only as a whole.
PREFIX = 12
# What a sheet's verdicts can be, and pages as they are written.
Q2_STATUS = ("pending", "validated", "proxy_net", "unavailable_disclosure", "needs_review")
R_CONCLUSION = ("pending", "sufficient", "insufficient", "not_applicable", "needs_review")
P_CONCLUSION = ("pending", "p_penalty", "no_penalty", "needs_review")
PAGE = r"[0-9]{1,4}(\s*[-–—]\s*[0-9]{1,4})?"
PAGES = rf"^{PAGE}(\s*[、,，]\s*{PAGE})*(\s*[（(].*[）)])?$"
NUMBER = r"^[-+]?[0-9][0-9,]*(\.[0-9]+)?$"


def said(name: str) -> Column:
    """A cell without blanks around it, empty where there is none."""
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _empty(*names: str) -> dict[str, Column]:
    return {f"{n} is empty": said(n) == "" for n in names}


def _given(verdict: str, values: tuple[str, ...], errors: dict[str, Column]) -> dict[str, Column]:
    return {f"{name} ({' or '.join(values)})": said(verdict).isin(*values) & e for name, e in errors.items()}


def _sheet(verdict: str, allowed: tuple[str, ...], errors: dict[str, Column], page: str | None = None) -> dict[str, Column]:
    """A verdict that isn't allowed is the row's only error; the others hold for those that are."""
    known = said(verdict).isin(*allowed)
    pages = {f"{page} is no page": (said(page) != "") & ~said(page).rlike(PAGES)} if page else {}
    return {f"{verdict} is not allowed": ~known} | {name: known & e for name, e in (errors | pages).items()}


def q2_rules() -> dict[str, Column]:
    """Rules of receivables by age."""
    amounts = ("receivable", "over_one_year", "revenue")
    figures = _empty(*amounts) | {f"{n} is no number": (said(n) != "") & ~said(n).rlike(NUMBER) for n in amounts}
    return _sheet("status", Q2_STATUS, _given("status", ("validated",), figures) | _given("status", ("unavailable_disclosure", "needs_review"), _empty("note")), "source_page")


def r_rules() -> dict[str, Column]:
    """Rules of risk disclosures."""
    whole = _given("conclusion", ("sufficient",), _empty("risk_object", "impact_path", "evidence"))
    return _sheet("conclusion", R_CONCLUSION, whole | _given("conclusion", ("not_applicable",), _empty("evidence")), "source_page")


def p_rules() -> dict[str, Column]:
    """Rules of confirmations of claims."""
    return _sheet("conclusion", P_CONCLUSION, {"a verdict without a reviewer": (said("conclusion") != PENDING) & (said("reviewer") == "")})


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``errors``, the names of all rules that a row breaks, in their order."""
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(e, F.lit(False)), name) for name, e in rules.items()])))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Add an error to rows whose key another row has too."""
    twice = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    x = rows.join(twice.withColumn("_twice", F.lit(True)), on, "left")
    return x.withColumn("errors", F.when(F.col("_twice"), F.array_append("errors", F.lit("key comes twice"))).otherwise(F.col("errors"))).select(*rows.columns)


def rekeyed(rows: DataFrame, claims: DataFrame, key: str = "claim_id", text: str = "claim_text", verdict: str = "conclusion") -> DataFrame:
    """Rows with the ids that ``claims`` have now: adds ``how``. An id that is there stays (``same``); another one is found
    by the row's text, if one claim alone has it (``exact``) or begins with it (``prefix``). Rows of no claim are
    ``dropped`` while pending and else ``lost``, and those of several are ``ambiguous``; they keep their ids, and
    :func:`importable` refuses them. Nothing is guessed. Texts are compared by sorted ranges, not row by row."""
    now = claims.select(F.col(key).alias("_id"), squeeze(F.col(text)).alias("_text"))
    known = rows.join(now.select(F.col("_id").alias(key), F.lit(True).alias("_known")), key, "left")
    moved = known.where("_known IS NULL").select(F.col(key).alias("_old"), squeeze(F.col(text)).alias("_text")).where("_text <> ''")
    found = unique_prefix(moved, now, "_old", "_text", PREFIX).withColumnRenamed("how", "_how")
    ids = now.groupBy("_text").agg(F.count("*").alias("_n"), F.min("_id").alias("_new")).withColumnRenamed("_text", "match")
    found = found.join(ids, "match", "left").dropDuplicates(["_old"])
    x = known.join(found.select(F.col("_old").alias(key), "_how", "_n", "_new"), key, "left")
    none = F.when(said(verdict) == PENDING, "dropped").otherwise("lost")
    how = F.when(F.col("_known"), "same").when((F.col("_n") > 1) | (F.col("_how") == "ambiguous"), "ambiguous").when(F.col("_new").isNotNull(), F.col("_how")).otherwise(none)
    x = x.withColumn("how", how)
    return x.withColumn(key, F.when(F.col("how").isin("exact", "prefix"), F.col("_new")).otherwise(F.col(key))).select(*rows.columns, "how")


def importable(rows: DataFrame, rules: dict[str, Column], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)``: all rows that aren't pending, if no row has an error, else none; and the rows with
    errors, all of each. Rows with ``how`` are those of :func:`rekeyed`: dropped ones go, lost and ambiguous ones are
    errors."""
    x = rows
    if "how" in rows.columns:
        x = x.where("how <> 'dropped'")
        rules = rules | {"claim is not there": F.col("how") == "lost", "several claims have its text": F.col("how") == "ambiguous"}
    x = repeated(checked(x, rules), key)
    refused = x.where(F.size("errors") > 0)
    verdict = next(c for c in ("status", "conclusion") if c in rows.columns)
    one = refused.limit(1).select(F.lit(True).alias("_bad"))
    accepted = x.where(said(verdict) != PENDING).join(F.broadcast(one), F.lit(True), "left_anti").drop("errors", "how")
    return accepted, refused
