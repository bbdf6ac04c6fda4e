"""The corpus pipeline: STAGES of (name, function), each (spark, docs, sf_dir) -> DataFrame.

Documents that the quality classifier rejects go, one document of each near-duplicate group stays,
personal data gets pseudonyms, sources are mixed to their target weights, better documents first, and the
mix is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm.common import materialize, table
from steelyard.llm.minhash import keep_one
from steelyard.llm.mixing import LEAST, mix, repeat_rows
from steelyard.llm.packing import pack
from steelyard.llm.pii import pseudonymize, query_key
from steelyard.llm.quality_model import score, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for quality. Null and empty texts score as texts without features,
    repeated rows alike; an empty table gives no rows."""
    name = unused(docs, "_score")
    good = score(docs, train(docs, table(spark, sf_dir, "labels")), name=name).where(F.col(name) >= 0.5)
    return good.drop(name)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``docs``."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates. Null texts are empty ones and
    repeated rows one group; rows without a doc_id all stay."""
    return keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal data, and n_chars of the new text. Null and empty texts stay as they are."""
    return pseudonymize(docs, key=query_key(spark), count=None).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, drawn by the classifier's score; whole documents
    only, so those without a word go. The classifier is fitted to the table as it was before any stage, since
    the documents that it rejects are gone here."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = unused(docs, "_score")
    # the row's own columns stay together, so none of them meets a name that mix() uses
    wide = score(docs, model, name=name).select(F.struct(*docs.columns).alias("_row"), F.col(name).alias("_score"), *[F.col(c).alias(f"_{c}") for c in ("doc_id", "text", "source")])
    mixed = mix(wide, key="_doc_id", text="_text", source="_source", weight=F.greatest("_score", F.lit(LEAST)), split=False)
    return repeat_rows(mixed).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of 2048 tokens, one row per piece; null and empty texts are the end id alone."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", private), ("mixing", mixed), ("packing", packed)]
#: A fitted classifier, sampled signatures and tokens are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
