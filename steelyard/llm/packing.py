"""Operator 1: pack documents into fixed sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steelyard.llm.common import materialize, table

CAPACITY = 2048
#: Lengths are counted in units of so many tokens, so the program has CAPACITY / UNIT rows.
UNIT = 8
#: Ranks within a length class are counted in so many hash buckets at least, and in one for so many rows.
BUCKETS, BUCKET_ROWS = 256, 1 << 20
#: A pattern that leaves more of a sequence open is not used: its documents are laid end to end and cut.
OPEN = 0.01
#: Up to so many documents that are laid end to end their places are broadcast; more are joined by shuffle.
FEW = 20_000
#: The program is solved once it is within this factor of its bound.
ENOUGH = 1 + 1e-4
#: The id that ends each document.
END = 1
#: The columns of a piece beside its document's key.
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: A run of white space from which on ``tokenizers`` encodes a text; the lookbehind tries each run once.
LONG_RUN = re.compile(r"(?<!\s)\s{100000}")


def bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text as ``tokenizers`` makes them from the ``.json`` file beside the vocabulary at ``path``,
    without the special tokens that a template would add; a special token's string in a text is that token.

    The ids of other texts come from a library that takes a third of the time (tests/llm compare the two).
    It knows no special tokens, and it steps back over a run of white space one by one and panics on a
    million, so texts with either go to ``tokenizers``."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    file = Path(path).with_suffix(".json")
    special = [x["content"] for x in json.loads(file.read_text("utf-8"))["added_tokens"]]
    slow = []

    def encode(text: str) -> list[int]:
        if not LONG_RUN.search(text) and not any(x in text for x in special):
            return fast(text)
        if not slow:
            slow.append(Tokenizer.from_file(str(file)))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def _ids(path: str, text: str | None) -> np.ndarray:
    if path not in _ENCODERS:
        _ENCODERS[path] = encoder(path)
    return np.array([*_ENCODERS[path](text or ""), END], dtype="<u4")


def tokenized(docs: DataFrame, key: str, text: str, capacity: int, path: str) -> DataFrame:
    """``(key, text_hash, doc_tokens, crcs)``: ``crcs`` has the checksum of each ``capacity`` ids in turn,
    the last of what is left."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crcs = [], []
            for one in batch.column(2):
                ids = _ids(path, one.as_py())
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + capacity].tobytes()) for i in range(0, len(ids), capacity)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], [key, "text_hash", "doc_tokens", "crcs"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.xxhash64(text).alias("text_hash"), text).mapInArrow(of, f"`{key}` {kind}, text_hash long, doc_tokens long, crcs array<long>")


def best_patterns(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack dynamic programming over multisets of weights, which ascend: the worth of the best pattern
    within the capacity, and for each weight the best pattern that has it, where that is worth over 1."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(weights, c, side="right"))
        best[c] = best[c - 1]
        if n:
            got = best[c - weights[:n]] + values[:n]
            k = int(got.argmax())
            if got[k] > best[c]:
                best[c], last[c] = got[k], k
    out = []
    for first in np.flatnonzero(values + best[capacity - weights] > 1 + 1e-9):
        count, c = np.zeros(len(weights)), int(capacity - weights[first])
        count[first] = 1
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                count[last[c]] += 1
                c -= int(weights[last[c]])
        out.append(count)
    return float(best[capacity]), np.array(out).reshape(-1, len(weights))


def plan(demand: dict[int, int], capacity: int, *, enough: float = ENOUGH, rounds: int = 200, pivots: int = 400) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, rounded down: ``[({length: count}, times), ...]``.

    Column generation: the linear program min sum(x), sum(pattern * x) = demand, starts from one pattern
    per length. Its dual prices value the lengths, the knapsack finds the patterns that they value most,
    and those enter the basis one by one while they are worth more than their cost of 1; then lengths are
    valued anew, until the program is within ``enough`` of the bound that the best pattern's worth gives.
    Lengths and capacity are whole units; sizes here depend on the capacity, never on the number of documents.
    """
    sizes = np.array(sorted(k for k, v in demand.items() if v > 0), dtype=np.int64)
    if not len(sizes):
        return []
    want = np.array([demand[int(k)] for k in sizes], dtype=float)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, pool, bound = np.diag(1 / (capacity // sizes)), np.zeros((0, len(sizes))), 0.0
    for _ in range(rounds):
        x, prices = (inverse * want).sum(axis=1), np.maximum(inverse.sum(axis=0), 0)
        worth, new = best_patterns(prices, sizes, capacity)
        bound = max(bound, float((prices * want).sum()) / max(worth, 1.0))
        if worth <= 1 + 1e-7 or x.sum() <= bound * enough:
            break
        pool = np.unique(np.concatenate([pool[-4 * len(sizes) :], new]), axis=0)
        for turn in range(pivots):
            worths = np.einsum("ij,j->i", pool, inverse.sum(axis=0))
            pattern = pool[int(worths.argmax())]
            if worths.max() <= 1 + 1e-6:
                break
            # the pattern takes the place of the one that runs out first; the inverse follows by one row step
            step = (inverse * pattern).sum(axis=1)
            ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.maximum(step, 1e-9), np.inf)
            out = int(np.lexsort((-step, ratio > ratio.min() + 1e-12))[0])
            x = x - ratio[out] * step
            x[out] = ratio[out]
            row = inverse[out] / step[out]
            step[out] -= 1
            inverse -= step[:, None] * row
            basis[:, out] = pattern
        if turn == 0:
            break
    times = np.floor(np.maximum((inverse * want).sum(axis=1), 0) + 1e-9).astype(np.int64)
    out, left = [], want.astype(np.int64)
    for k in np.argsort(-times, kind="stable"):
        column = basis[:, k].astype(np.int64)
        n = min([int(times[k]), *(int(a // b) for a, b in zip(left, column, strict=True) if b)])
        if n > 0:
            left -= n * column
            out.append(({int(s): int(c) for s, c in zip(sizes, column, strict=True) if c}, n))
    return out


def _powers(n: int) -> list[int]:
    """Ends of the powers of two, largest first, that n is the sum of."""
    ends, at = [], 0
    for k in range(n.bit_length() - 1, -1, -1):
        if n >> k & 1:
            at += 1 << k
            ends.append(at)
    return ends


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, unit: int = UNIT, path: str | None = None) -> DataFrame:
    """Place every id of every document: one row per piece with ``key, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``.

    Whole runs of ``capacity`` ids of a long document are sequences of their own. What is left of each
    document has a length class; the histogram of classes (at most ``capacity / unit`` numbers) goes to
    :func:`plan`, and the ranked documents of a class fill that class's places in the patterns. The
    documents that rounding down and patterns with much left open leave over, few as a rule, are laid end
    to end and cut at the capacity, the last part at powers of two, so it needs no padding either.

    A null or empty text is the end id alone; repeated rows are packed each; a null key is a key; a very
    long text is cut into as many sequences as it fills; equal keys rank by the text's hash, and rows that
    agree in both are alike, so either may take either place; an empty table gives no rows. Other columns
    of ``docs`` are not read, and a ``key`` that is named as one of the six other columns comes out with ``_key`` behind its name.
    """
    spark, path = docs.sparkSession, path or bpe_file()
    classes, name = capacity // unit, key
    if name.lower() in PIECE:
        name = f"{name}_key"
    # the key has a name of its own inside, so no name of a column of the table meets one used here
    docs, key, text = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_id", "_text"
    source = docs
    tok = materialize(tokenized(source, key, text, capacity, path), "pack")
    tok = tok.withColumn("_tail", (F.col("doc_tokens") % capacity).cast("int")).withColumn("_full", F.floor(F.col("doc_tokens") / capacity)).withColumn("_class", F.ceil(F.col("_tail") / unit).cast("int"))

    buckets = max(BUCKETS, -(-tok.count() // BUCKET_ROWS))

    # sequences of one piece
    spread = lambda n: F.pmod(F.xxhash64(key, "text_hash"), F.lit(n)).cast("int")
    long = tok.where("_full > 0").select(key, "text_hash", "doc_tokens", "crcs", "_full", spread(16 * buckets).alias("_bucket"))
    sums = long.groupBy("_bucket").agg(F.sum("_full").alias("_sum"))
    first = sums.select("_bucket", (F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")).alias("_first"))
    n_full = tok.agg(F.coalesce(F.sum("_full"), F.lit(0))).first()[0]
    run = Window.partitionBy("_bucket").orderBy(key, "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("_to", F.sum("_full").over(run)).join(F.broadcast(first), "_bucket")
    long = long.select(key, "doc_tokens", (F.col("_first") + F.col("_to") - F.col("_full")).alias("_from"), F.posexplode(F.slice("crcs", F.lit(1), F.col("_full").cast("int"))).alias("_j", "ids_crc32"))
    wholes = long.select(key, (F.col("_j").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("_from") + F.col("_j")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # the plan, from one number per class
    tails = tok.where("_tail > 0").select(key, "text_hash", "doc_tokens", "_tail", "_class", F.element_at("crcs", -1).alias("ids_crc32"), spread(buckets).alias("_bucket"))
    counts = tails.groupBy("_class", "_bucket").count()
    places, taken, at = [], {}, n_full
    for pattern, times in plan({r[0]: r[1] for r in counts.groupBy("_class").sum("count").collect()}, classes):
        if sum(size * n for size, n in pattern.items()) < (1 - OPEN) * classes:
            continue
        for order, (size, n) in enumerate(sorted(pattern.items(), reverse=True)):
            was = taken.get(size, 0)
            places.append((size, was, was + n * times, n, at, order))
            taken[size] = was + n * times
        at += times
    places_df = spark.createDataFrame(places, "_class int, _lo long, _hi long, _n long, _base long, _order int")

    # rank in the class: inside the bucket, and over the buckets before it
    inside = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy(key, "text_hash")) - 1
    before = counts.select("_class", "_bucket", (F.sum("count").over(Window.partitionBy("_class").orderBy("_bucket")) - F.col("count")).alias("_before"))
    ranked = tails.withColumn("_inside", inside).join(before, ["_class", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_inside"))
    fits = (ranked["_class"] == places_df["_class"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    placed = materialize(ranked.join(F.broadcast(places_df), fits, "left").drop(places_df["_class"]), "pack")
    planned = placed.where("_lo IS NOT NULL").withColumn("sequence_id", F.expr("_base + (_rank - _lo) div _n"))
    inner = Window.partitionBy("sequence_id").orderBy("_order", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    begun = (F.col("doc_tokens") - F.col("_tail")).alias("start")
    planned = planned.select(key, begun, F.col("_tail").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("_tail").over(inner), F.lit(0)).alias("offset"))

    # what rounding and open patterns left over, laid end to end and cut; sums as for ranks
    rest = placed.where("_lo IS NULL")
    sums = rest.groupBy("_class", "_bucket").agg(F.sum("_tail").alias("_sum"))
    sums = sums.select("_class", "_bucket", (F.sum("_sum").over(Window.orderBy(F.col("_class").desc(), "_bucket")) - F.col("_sum")).alias("_line"))
    line = Window.partitionBy("_class", "_bucket").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("_run", F.coalesce(F.sum("_tail").over(line), F.lit(0))).join(sums, ["_class", "_bucket"]).withColumn("_at", F.col("_line") + F.col("_run"))
    left, total = placed.where("_lo IS NULL").agg(F.count("*"), F.coalesce(F.sum("_tail"), F.lit(0))).first()
    whole, ends = total // capacity, _powers(total % capacity)
    last = F.array(*[F.lit(whole * capacity + e).cast("long") for e in ends]) if ends else F.expr("cast(array() as array<bigint>)")
    to = F.col("_at") + F.col("_tail")
    cuts = F.array_sort(F.array_distinct(F.concat(
        F.transform(F.sequence(F.floor(F.col("_at") / capacity), F.floor(to / capacity)), lambda k: k * capacity), last)))
    points = F.concat(F.array("_at"), F.filter(cuts, lambda c: (c > F.col("_at")) & (c < to)), F.array(to))
    number = lambda p: F.floor(p / capacity) + F.when(p >= whole * capacity, F.size(F.filter(last, lambda e: e <= p))).otherwise(0)
    origin = lambda p: F.array_max(F.filter(F.concat(F.array(F.floor(p / capacity) * capacity), last), lambda e: e <= p))
    parts = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(F.get(points, i - 1).alias("a"), F.get(points, i).alias("b")))
    rest = rest.select(key, "text_hash", "doc_tokens", begun, F.col("_at"), F.explode(parts).alias("p"))
    rest = rest.select(key, "text_hash", "doc_tokens", (F.col("start") + F.col("p.a") - F.col("_at")).alias("start"), (F.col("p.b") - F.col("p.a")).alias("length"), (number(F.col("p.a")) + at).alias("sequence_id"), (F.col("p.a") - origin(F.col("p.a"))).alias("offset"))
    spans = rest.groupBy(key, "text_hash").agg(F.collect_list(F.struct("start", "length", "doc_tokens", "sequence_id", "offset")).alias("spans"))
    spans = spans.select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"), "spans")
    again = source.withColumn("_h", F.xxhash64(text)).join(F.broadcast(spans) if left <= FEW else spans, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash")))

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, one, spans in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = _ids(path, one.as_py())
                rows += [(k.as_py(), s["start"], s["length"], zlib.crc32(ids[s["start"] : s["start"] + s["length"]].tobytes()), s["doc_tokens"], s["sequence_id"], s["offset"]) for s in spans]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[key]
    cut = again.select(key, text, "spans").mapInArrow(checksums, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    # rows repeated in the table each bring the spans of all of them
    cut = cut.dropDuplicates(["sequence_id", "offset"])
    return wholes.unionByName(planned).unionByName(cut).withColumnRenamed("_id", name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
