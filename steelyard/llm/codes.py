"""Operator 13: product codes of vectors, entries found by Exponion search with exact integer distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm.common import drop, key_name, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components are smaller than this, so that squared distances of vectors of 1000 components fit 64 bits.
LARGEST = 1 << 25
#: Rows that are searched together.
TOGETHER = 1 << 14


class Codebook:
    """The entries of one part, and for each the others by their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, -1)  # an entry leads its own list, before others at the same place
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance, the lower index of equal ones.

        An entry as near as the previous one, p, is at most 2 d(x, p) away from p, so its squared distance from
        p is at most four times that of x: of p's list the entries up to there are looked at, no other can win.
        """
        best = ((x - self.entries[previous]) ** 2).sum(axis=1)
        index, radius = previous.copy(), 4 * best
        rows = np.flatnonzero(radius >= self.apart[previous, 1]) if len(self.entries) > 1 else np.zeros(0, dtype=np.int64)
        k = 1
        while len(rows):
            other = self.order[previous[rows], k]
            d = ((x[rows] - self.entries[other]) ** 2).sum(axis=1)
            nearer = (d < best[rows]) | ((d == best[rows]) & (other < index[rows]))
            best[rows[nearer]], index[rows[nearer]] = d[nearer], other[nearer]
            k += 1
            if k == len(self.entries):
                break
            rows = rows[radius[rows] >= self.apart[previous[rows], k]]
        return index, best


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).reshape(len(column), width).astype(np.int64)


def quantized(vectors: DataFrame, vector: str, *carried) -> DataFrame:
    """Carried columns and ``q``, floor(256 x) of each component in four bytes, of the vectors that are not null
    and hold no null or non-finite component; the others go."""
    x = F.col(vector)
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
    kept = vectors.where(good).select(*carried, x.alias("_x"))
    names = kept.columns[:-1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names))
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            if len(flat) and np.abs(flat).max() >= LARGEST:
                raise ValueError(f"a component's magnitude is {LARGEST // SCALE} or more")
            edges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = flat.astype(np.int32)
            own = pa.array([flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), own], [*names, "q"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes[:-1])
    return kept.mapInArrow(of, f"{kinds}, q binary")


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows ``..., q, code`` with ``code``, an entry's index for each part in one byte, searched anew from where it
    was (null: from entry 0), and ``error``, the squared distances of all parts together."""
    names = [c for c in rows.columns if c not in ("code", "error")]
    parts, _, width = books.shape
    q, code = names.index("q"), len(names)
    shared = rows.sparkSession.sparkContext.broadcast(books)  # PARTS x ENTRIES vectors

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                x = _stack(some.column(q), parts * width)
                was = some.column(code)
                if was.null_count:
                    previous = np.zeros((len(x), parts), dtype=np.int64)
                else:
                    previous = np.frombuffer(b"".join(was.to_pylist()), dtype=np.uint8).reshape(len(x), parts).astype(np.int64)
                found, error = np.zeros((len(x), parts), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
                for p in range(parts):
                    index, d = own[p].nearest(x[:, p * width : (p + 1) * width], previous[:, p])
                    found[:, p] = index
                    error += d
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in range(len(names))), pa.array([r.tobytes() for r in found], pa.binary()), pa.array(error)], [*names, "code", "error"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    return rows.select(*names, "code").mapInArrow(of, f"{schema}, code binary, error long")


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floor of the mean of its parts. Tasks sum up by entry, so what is shuffled
    are PARTS x ENTRIES rows a task."""
    parts, entries, width = books.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            x = _stack(batch.column(0), parts * width).reshape(-1, width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, parts)
            at = (code + np.arange(parts) * entries).ravel()
            np.add.at(sums, at, x)
            counts += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["entry", "n", "sums"])

    found = rows.select("q", "code").mapInArrow(of, "entry int, n long, sums array<long>")
    totals = found.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)])
    out = books.reshape(-1, width).copy()
    for row in totals.collect():  # PARTS x ENTRIES rows
        out[row.entry] = [int(row[f"s{k}"]) // row.n for k in range(width)]
    return out.reshape(books.shape)


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """Codes of vectors, ``(key, label, code, error)``, and the codebooks, parts x entries x components.

    Components become floor(256 x) and vectors 16 equal parts. Each part's codebook begins with that part of the 64
    vectors with the smallest keys, of equal keys the smallest vector first; two rounds assign all parts and move the
    entries to the floor of their parts' mean, an entry without parts stays, and parts are assigned once more. Each
    search starts at the entry that the part had (at first entry 0) and looks at that entry's neighbours alone, in
    exact integers. Passes are maps over the vectors; only sums by entry are shuffled.

    Vectors that are null or hold a null or non-finite component go, and those without a key; all others have one
    length, a multiple of 16, or it is an error, as is a magnitude of 131,072 or more. With fewer than 64 vectors there are as many
    entries. Repeated rows count each and get a code each; an empty table gives no rows and no codebooks; a very long
    vector is read whole; other columns are not read, and a key named as
    one that is added comes out with ``_key`` behind its name.
    """
    name = key_name(key, (label, "code", "error"))
    kept = quantized(vectors.where(F.col(key).isNotNull()), vector, F.col(key).alias("_key"), F.col(label).alias("_label"))
    rows = materialize(kept.withColumn("code", F.lit(None).cast("binary")), "codes")
    lengths = rows.agg(F.min(F.length("q")), F.max(F.length("q"))).first()
    if lengths[0] is None:
        return rows.select(F.col("_key").alias(name), F.col("_label").alias(label), "code", F.lit(None).cast("long").alias("error")), None
    if lengths[0] != lengths[1] or lengths[0] == 0 or lengths[0] % (4 * PARTS):
        raise ValueError(f"vectors have {lengths[0] // 4} to {lengths[1] // 4} components: they need one length, a multiple of {PARTS}")
    unpacked = lambda b: np.frombuffer(b, dtype=np.int32).astype(np.int64)
    smallest = rows.where(F.col("_key") <= (rows.select("_key").orderBy("_key").limit(ENTRIES).agg(F.max("_key")).first()[0]))
    # repeated keys may be many: the first ENTRIES of each, in the order of their vectors, are known by value and count
    firsts = smallest.groupBy("_key", "q").agg(F.count("*").alias("n")).orderBy("_key", _order(lengths[0] // 4)).limit(ENTRIES).collect()
    seeds = [unpacked(r.q) for r in firsts for _ in range(min(r.n, ENTRIES))][:ENTRIES]
    books = np.stack(seeds).reshape(len(seeds), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        was, rows = rows, materialize(assign(rows, books).drop("error"), "codes")
        drop(was)
        books = moved(rows, books)
    out = assign(rows, books).select(F.col("_key").alias(name), F.col("_label").alias(label), "code", "error")
    return out, books


def _order(width: int):
    """A vector as an array of its components, to be put in order."""
    parse = lambda k: F.conv(F.hex(F.reverse(F.substring("q", 4 * k + 1, 4))), 16, 10).cast("long")
    return F.array(*[F.when(parse(k) >= 1 << 31, parse(k) - (1 << 32)).otherwise(parse(k)) for k in range(width)])


def reconstruct(codes: DataFrame, books: np.ndarray, *, key: str = "vec_id") -> DataFrame:
    """``(key, vector)``: what codes stand for, each component the middle of its step of 1 / 256."""
    entries = ((books + 0.5) / SCALE).astype(np.float64)
    shared = codes.sparkSession.sparkContext.broadcast(entries)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, len(own)).astype(np.int64)
            x = np.concatenate([own[p][code[:, p]] for p in range(len(own))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["_k", "vector"])

    return codes.select(F.col(key).alias("_k"), "code").mapInArrow(of, f"_k {dict(codes.dtypes)[key]}, vector array<double>").withColumnRenamed("_k", key)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings`` with their errors, the errors summed by label, and a digest of the codebooks."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    said = "" if books is None else ",".join(map(str, books.ravel().tolist()))
    codes = materialize(codes, "codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = codes.withColumnRenamed("label", "_label").join(totals, F.col("_label").eqNullSafe(F.col("label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))


SQL_OP13 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, s AS part, q[s * (len(q) // 16) + 1 : (s + 1) * (len(q) // 16)] AS x FROM v, range(16) r(s)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
a1 AS MATERIALIZED (SELECT vec_id, p.part, arg_min(entry, DIST * 64 + entry) AS entry FROM p JOIN b0 b ON p.part = b.part GROUP BY vec_id, p.part),
b1 AS MATERIALIZED (MOVED(a1, b0)),
a2 AS MATERIALIZED (SELECT vec_id, p.part, arg_min(entry, DIST * 64 + entry) AS entry FROM p JOIN b1 b ON p.part = b.part GROUP BY vec_id, p.part),
b2 AS MATERIALIZED (MOVED(a2, b1)),
a3 AS MATERIALIZED (
  SELECT vec_id, label, p.part, arg_min(entry, DIST * 64 + entry) AS entry, min(DIST) AS d
  FROM p JOIN b2 b ON p.part = b.part GROUP BY vec_id, label, p.part),
c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""
_DIST = "CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _moved(assigned: str, books: str) -> str:
    """SQL of the entries at the floor of their parts' mean; those without parts stay."""
    return f"""
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
      SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT a.part, a.entry, p.x, unnest(range(1, len(p.x) + 1)) AS i FROM {assigned} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part)
      GROUP BY part, entry, i)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry"""


SQL_OP13 = SQL_OP13.replace("MOVED(a1, b0)", _moved("a1", "b0")).replace("MOVED(a2, b1)", _moved("a2", "b1")).replace("DIST", _DIST)
