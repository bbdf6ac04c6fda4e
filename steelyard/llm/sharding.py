"""Operator 9: a reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steelyard.llm.common import key_name, table

ROUNDS = 6
#: Buckets that number the rows, at least, and one for so many rows; a bucket is sorted by itself, so it
#: bounds what one task sorts.
BUCKETS, BUCKET_ROWS = 4096, 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The keyed permutation of ``range(n)`` at ``x``: a balanced network on the next even number of
    bits, walked along its cycle until it falls below ``n`` (four steps on average at most)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in range(ROUNDS):
            key = _mix(np.array([(seed * ROUNDS + k + 1) % 2**64], dtype=np.uint64))
            left, right = right, left ^ (_mix(right ^ key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def row_numbers(docs: DataFrame, key: str, *ties: str, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Add ``_row``, a gapless global number from 0 that depends on the rows alone, and return the count.

    Rows go to ``buckets`` by a hash of key and ties, are numbered inside their bucket by a window, and
    the bucket's first number is the running sum over the buckets' counts, one row for a million rows.
    """
    n = docs.count()
    buckets = buckets or max(BUCKETS, -(-n // BUCKET_ROWS))
    slim = docs.withColumn("_bucket", F.pmod(F.xxhash64(key, *ties), F.lit(buckets)).cast("int"))
    counts = slim.groupBy("_bucket").count()
    first = counts.select("_bucket", (F.sum("count").over(Window.orderBy("_bucket")) - F.col("count")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key, *ties)) - 1
    out = slim.withColumn("_inside", inside).join(F.broadcast(first), "_bucket").withColumn("_row", F.col("_first") + F.col("_inside"))
    return out.drop("_bucket", "_first", "_inside"), n


def shard(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """Add ``size``, ``text_crc32``, ``shard`` and ``slot`` to the columns other than the text.

    The global row number is permuted by :func:`feistel`; ``shard = permuted mod n_shards`` and ``slot =
    permuted div n_shards``, so counts differ by one at most, slots are gapless, and the place of any row
    is computed from its number without a sort or shuffle of texts. A null text counts as empty, a null key
    as a key, and a very long text is one row like others; repeated rows get places of their own; equal keys
    are ordered by the text's checksum and size. An empty table gives no rows. Other columns are kept if their names
    do not clash with those added (a clashing input column gives way, a key gets ``_key`` behind its name).
    """
    added = ("size", "text_crc32", "shard", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    kept = [F.col(c) for c in docs.columns if c.lower() not in (text.lower(), *added)]
    if key.lower() in added:
        kept.append(F.col(key).alias(key_name(key, added)))
    # the row's own columns stay together, so none of them meets a name used here
    slim = docs.select(F.struct(*kept).alias("_own"), F.col(key).alias("_id"), size.alias("size"), crc.alias("text_crc32"))
    numbered, n = row_numbers(slim, "_id", "text_crc32", "size")

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(feistel(rows.to_numpy(), n, seed))

    placed = numbered.withColumn("_at", permuted("_row"))
    return placed.select(
        "_own.*", "size", "text_crc32",
        (F.col("_at") % n_shards).cast("int").alias("shard"),
        F.expr(f"_at div {n_shards}").cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int, *, seed: int = 1) -> None:
    """Write the rows with their texts into ``path/shard=k``, each shard's rows in slot order.

    Large shards are split by slot ranges so that one task never holds a whole shard.
    """
    doc_key = F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    copies = Window.partitionBy("_key").orderBy("_tie")
    placed = shard(docs.select("doc_id", "text"), n_shards, seed=seed)
    placed = placed.withColumn("_key", F.xxhash64("doc_id", "text_crc32")).withColumn("_tie", F.col("slot") * n_shards + F.col("shard"))
    placed = placed.select("_key", "shard", "slot", F.row_number().over(copies).alias("_copy"))
    source = docs.withColumn("_key", doc_key).withColumn("_tie", F.lit(0)).withColumn("_copy", F.row_number().over(copies))
    out = source.join(placed, ["_key", "_copy"]).drop("_key", "_copy", "_tie")
    out.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
