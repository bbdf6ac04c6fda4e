"""Operator 5: remove long repeated passages by sorting suffixes in range-partitioned buckets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm import texthash
from steelyard.llm.common import key_name, materialize, shuffle_partitions, table

LENGTH = 400
#: Bytes of the leading token; of the LENGTH - TOKEN + 1 tokens inside a string the least leads.
TOKEN = 100
#: Neighbouring strings that are judged together, then apart.
STEPS = (32, 4, 1)
#: Suffixes in a bucket, about.
BUCKET = 1 << 20


def leaders(data: np.ndarray, length: int, token: int) -> np.ndarray:
    """For each start of a string of ``length`` bytes the place of its leading token: the least token
    fingerprint inside it, the first of equal ones."""
    n = len(data) - token + 1
    bits = np.uint64(max(24, n.bit_length()))
    prefix = texthash.prefixes(data)
    at = np.arange(n)
    key = (texthash.spans(prefix, at, at + token) >> bits << bits) | at.astype(np.uint64)
    wide = length - token + 1
    rows = -(-n // wide)
    padded = np.full(rows * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    blocks = padded.reshape(rows, wide)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(down[: n - wide + 1], up[wide - 1 : n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def strings(data: np.ndarray, offsets: np.ndarray, length: int, token: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all strings of ``length`` bytes inside one text, and where the leading token of each is."""
    if len(data) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lead = leaders(data, length, token)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    big = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][big], 1)
    np.add.at(inside, offsets[1:][big] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(lead)] > 0)
    return start, lead[start]


def leading_tokens(docs: DataFrame, length: int, token: int) -> DataFrame:
    """``(_k, _t, token, n)``: the leading tokens of each text and how often each leads there."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texthash.utf8(batch.column(2))
            for a, b in texthash.chunks(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                _, lead = strings(part, off, length, token)
                lead = np.unique(lead)
                if len(lead):
                    fp = texthash.spans(texthash.prefixes(part), lead, lead + token)
                    text = np.searchsorted(off, lead, side="right") - 1
                    order = np.lexsort((fp, text))
                    fp, text = fp[order], text[order]
                    new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (text[1:] != text[:-1])]))
                    rows = pa.array(text[new] + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(fp[new].astype(np.int64)), pa.array(np.diff(np.append(new, len(fp))).astype(np.int32))], ["_k", "_t", "token", "n"])

    return docs.select("_k", "_t", "_text").mapInArrow(of, f"_k {dict(docs.dtypes)['_k']}, _t long, token long, n int")


def segments(docs: DataFrame, tokens: DataFrame, length: int, token: int, margin: int) -> DataFrame:
    """``(_k, _t, at, bytes)``: the parts of each text whose strings have one of its ``tokens`` in the lead."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ats, out = [], [], []
            data, offsets = texthash.utf8(batch.column(2))
            for r in range(batch.num_rows):
                part = data[offsets[r] : offsets[r + 1]]
                start, lead = strings(part, np.array([0, len(part)]), length, token)
                if not len(start):
                    continue
                runs = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
                fp = texthash.spans(texthash.prefixes(part), lead[runs], lead[runs] + token).astype(np.int64)
                hit = np.isin(fp, np.array(batch.column(3)[r].as_py(), dtype=np.int64))
                lo = np.maximum(start[runs][hit] - margin, 0)
                hi = np.minimum(np.append(runs[1:], len(start))[hit] - 1 + length + margin, len(part))
                at = 0
                while at < len(lo):
                    to = at
                    while to + 1 < len(lo) and lo[to + 1] <= hi[to]:
                        to += 1
                    rows.append(r)
                    ats.append(int(lo[at]))
                    out.append(part[lo[at] : hi[to]].tobytes())
                    at = to + 1
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(ats, pa.int64()), pa.array(out, pa.binary())], ["_k", "_t", "at", "bytes"])

    joined = docs.join(tokens, ["_k", "_t"]).select("_k", "_t", "_text", "tokens").dropDuplicates(["_k", "_t"])
    return joined.mapInArrow(of, f"_k {dict(docs.dtypes)['_k']}, _t long, at long, bytes binary")


def suffixes(parts: DataFrame, length: int, token: int, step: int) -> DataFrame:
    """``(core, whole, _k, _t, lo, hi)``: for each run of at most ``step`` strings with one leading token, at
    fixed distances from it, the fingerprints of what they have in common and of all that they cover.

    ``parts`` has ``_k, _t, at, bytes`` and perhaps ``runs``, the starts ``[lo, hi]`` to keep to.
    """
    some = "runs" in parts.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texthash.utf8(batch.column(3))
            for a, b in texthash.chunks(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, lead = strings(part, off, length, token)
                row = np.searchsorted(off, start, side="right") - 1
                base = np.array(batch.column(2)[a:b].to_pylist(), dtype=np.int64)
                if some:
                    keep = np.zeros(len(part) + 1, dtype=np.int32)
                    for r in range(a, b):
                        runs = np.array([(x["lo"], x["hi"]) for x in batch.column(4)[r].as_py()], dtype=np.int64).reshape(-1, 2) - base[r - a] + off[r - a]
                        runs = runs[(runs[:, 1] >= off[r - a]) & (runs[:, 0] < off[r - a + 1])]
                        np.add.at(keep, np.maximum(runs[:, 0], off[r - a]), 1)
                        np.add.at(keep, np.minimum(runs[:, 1] + 1, off[r - a + 1]), -1)
                    chosen = np.cumsum(keep)[start] > 0
                    start, lead, row = start[chosen], lead[chosen], row[chosen]
                if not len(start):
                    continue
                piece = (lead - start) // step
                new = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (piece[1:] != piece[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
                lo, hi = start[new], start[np.append(new[1:], len(start)) - 1]
                lead, piece, row = lead[new], piece[new], row[new]
                prefix = texthash.prefixes(part)
                late, early = lead - piece * step, lead - piece * step - step + 1
                # with the distance, so that no place is compared with itself by way of another leader
                far = texthash.mix(piece.astype(np.uint64) + np.uint64(1))
                core = texthash.spans(prefix, late, early + length) ^ far
                if step > 1:
                    fits = (early >= off[row]) & (late + length <= off[row + 1])
                    own = texthash.mix(core ^ texthash.mix(lo.astype(np.uint64) + base[row].astype(np.uint64) * np.uint64(1 << 20) + np.frombuffer(np.array(batch.column(1)[a:b].to_pylist(), dtype=np.int64).tobytes(), dtype=np.uint64)[row]))
                    whole = np.where(fits, texthash.spans(prefix, np.where(fits, early, 0), np.where(fits, late + length, 0)) ^ far, own)
                else:
                    whole = core
                take, shift = pa.array(row + a), base[row] - off[row]
                yield pa.RecordBatch.from_arrays([pa.array(core.astype(np.int64)), pa.array(whole.astype(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(lo + shift), pa.array(hi + shift)], ["core", "whole", "_k", "_t", "lo", "hi"])

    return parts.select("_k", "_t", "at", "bytes", *["runs"] * some).mapInArrow(of, f"core long, whole long, _k {dict(parts.dtypes)['_k']}, _t long, lo long, hi long")


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then by the next key among its ties alone, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    x = keys[0][order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    for key in keys[1:]:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        part = order[tied]
        group = np.cumsum(new)[tied]
        part = part[np.lexsort((key[part], group))]
        order[tied] = part
        x = key[part]
        new[tied] = np.concatenate([[True], (x[1:] != x[:-1]) | (group[1:] != group[:-1])]) if len(tied) else new[tied]
    return order


def compared(rows: DataFrame, partitions: int) -> DataFrame:
    """``(_k, _t, lo, hi, state, goes)`` of the suffixes that share their ``core`` with another: state 2 if
    the ``whole`` is shared too, else 1. Of equal ones with other company one ``goes`` on, to be compared.

    Sampled splitters cut the suffixes into ranges by their tokens, with the place in the corpus as the
    last key, so one common passage is cut too. Each range is sorted by itself and neighbours compared;
    its first and last suffix are then compared with those of all other ranges, two rows a range.
    """
    kind = dict(rows.dtypes)["_k"]
    ranged = rows.repartitionByRange(partitions, "core", "whole", "_t", "lo")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        core, whole = t["core"].to_numpy(), t["whole"].to_numpy()
        order = multikey_order(core, whole)
        core, whole = core[order], whole[order]
        state = np.zeros(len(core), dtype=np.int32)
        for same in (core[1:] == core[:-1], (core[1:] == core[:-1]) & (whole[1:] == whole[:-1])):
            state += np.concatenate([[False], same]) | np.concatenate([same, [False]])
        edge = (core == core[0]) | (core == core[-1])
        keep = np.flatnonzero((state > 0) | edge)
        # one of each whole goes on, if its core has others; at an end of the range that is not known here
        first = np.concatenate([[True], (core[1:] != core[:-1]) | (whole[1:] != whole[:-1])])
        heads = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
        wholes = np.add.reduceat(first.astype(np.int64), heads)
        goes = first & (edge | np.repeat(wholes > 1, np.diff(np.append(heads, len(core)))))
        out = t.take(pa.array(order[keep])).append_column("state", pa.array(state[keep]))
        end = np.where(np.isin(keep, [0, len(core) - 1]), TaskContext.get().partitionId(), -1).astype(np.int32)
        yield from out.append_column("end", pa.array(end)).append_column("goes", pa.array(goes[keep])).combine_chunks().to_batches()

    found = materialize(ranged.mapInArrow(of, f"core long, whole long, _k {kind}, _t long, lo long, hi long, state int, end int, goes boolean"), "suffix")
    ends = found.where("end >= 0")
    across = lambda *by: ends.groupBy(*by).agg(F.count_distinct("end").alias("_ranges")).where("_ranges > 1").select(*by)
    # at most two rows for each range
    out = found.join(F.broadcast(across("core").withColumn("_c", F.lit(1))), "core", "left")
    out = out.join(F.broadcast(across("core", "whole").withColumn("_w", F.lit(2))), ["core", "whole"], "left")
    return out.select("_k", "_t", "lo", "hi", F.greatest("state", F.coalesce("_c", F.lit(0)), F.coalesce("_w", F.lit(0))).alias("state"), "goes").where("state > 0")


def removed(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """``(_k, _t, n_removed, n_spans, kept_sha256)`` of the texts that have ``spans``, the starts of strings."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data, offsets = texthash.utf8(batch.column(2))
            for r in range(batch.num_rows):
                part, runs = data[offsets[r] : offsets[r + 1]], batch.column(3)[r].as_py()
                edge = np.zeros(len(part) + 1, dtype=np.int32)
                np.add.at(edge, [x["lo"] for x in runs], 1)
                np.add.at(edge, [x["hi"] + length for x in runs], -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(part[~gone].tobytes()).hexdigest()))
            n, s, h = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())], ["_k", "_t", "n_removed", "n_spans", "kept_sha256"])

    lists = spans.groupBy("_k", "_t").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    kind = dict(docs.dtypes)["_k"]
    return docs.join(lists, ["_k", "_t"]).select("_k", "_t", "_text", "runs").mapInArrow(of, f"_k {kind}, _t long, n_removed long, n_spans long, kept_sha256 string")


def repeated_bytes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, token: int = TOKEN) -> DataFrame:
    """What is left of each text without the bytes that a string of ``length`` bytes covers which starts
    anywhere else too: ``(key, n_bytes, n_removed, n_spans, kept_sha256)``, one row per input row.

    Texts that occur more than once go whole, if they are long enough, and one of them takes part in the
    search. Every string is led by the least fingerprint of ``token`` bytes inside it, so equal strings
    have equal leaders at equal distances. Leaders that occur once, nearly all, end the search; around
    the others the suffixes are sorted (:func:`compared`): first runs of 32 neighbouring strings by what
    they have in common and by all that they cover, then runs of 4 where only the first is shared, then
    single strings. Strings are told apart by 64-bit fingerprints.

    A null text has no bytes; rows with a null key are handled by their text; repeated rows count as
    occurrences of their own; an empty table gives no rows; other columns are not read, and a
    key named as one that is added comes out with ``_key`` behind its name.
    """
    name = key_name(key, ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    docs, key, text = docs.select(F.col(key).alias("_id"), F.col(text).alias("_body")), "_id", "_body"
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key), F.md5(t.cast("binary")).alias("_m"), F.xxhash64(t).alias("_t"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("_sha"))
    slim = materialize(slim, "suffix")
    copies = materialize(slim.where(F.col("n_bytes") >= length).groupBy("_m", "_t").agg(F.count("*").alias("_copies"), F.min(F.coalesce(F.xxhash64(key), F.lit(0))).alias("_k")), "suffix")
    # a row is named by the hashes of its key and text; of equal texts the least takes part
    base = docs.where(F.octet_length(text) >= length).select(F.coalesce(F.xxhash64(key), F.lit(0)).alias("_k"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))

    tokens = materialize(leading_tokens(base, length, token), "suffix")
    shared = tokens.groupBy("token").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.max("n").alias("_n")).where("_a <> _b OR _n > 1").select("token")
    lists = tokens.join(shared, "token").join(copies.select("_k", "_t"), ["_k", "_t"], "left_semi").groupBy("_k", "_t").agg(F.collect_set("token").alias("tokens"))
    parts = materialize(segments(base, lists, length, token, STEPS[0]), "suffix")

    spans, left = None, parts
    for step in STEPS:
        rows = materialize(suffixes(left, length, token, step), "suffix")
        buckets = max(shuffle_partitions(spark), math.ceil(rows.count() / BUCKET))
        found = materialize(compared(rows, buckets), "suffix")
        whole = found.where("state = 2").select("_k", "_t", "lo", "hi")
        spans = whole if spans is None else spans.unionByName(whole)
        if step > 1:
            runs = found.where("state = 1 OR goes").groupBy("_k", "_t").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
            left = parts.join(runs, ["_k", "_t"])

    cut = removed(base, spans.join(copies.where("_copies = 1").select("_k", "_t"), ["_k", "_t"], "left_semi"), length)
    many = copies.select("_m", "_copies")
    out = slim.withColumn("_k", F.coalesce(F.xxhash64(key), F.lit(0))).join(many, "_m", "left").join(cut, ["_k", "_t"], "left")
    gone = F.coalesce(F.col("_copies") > 1, F.lit(False))
    return out.select(
        F.col(key).alias(name), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
    )


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Every string of the corpus by its digest, counted.
SQL_OP5 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT k, i, md5(b[i + 1:i + {LENGTH}]) AS h FROM (SELECT k, b, unnest(range(0, n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH})),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r),
u AS (SELECT k, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM g) GROUP BY k, s),
s AS (SELECT k, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS ends, list(z ORDER BY a) AS starts FROM u GROUP BY k),
p AS (SELECT s.k, list_concat([0], starts) AS starts, list_concat(ends, [n]) AS ends, b FROM s JOIN d ON d.k = s.k),
q AS (SELECT k, sha256(list_reduce(list_transform(range(1, len(starts) + 1), lambda j: b[starts[j] + 1:ends[j]]), lambda x, y: x || y)) AS h FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(q.h, sha256(b)) AS kept_sha256
FROM d LEFT JOIN s ON s.k = d.k LEFT JOIN q ON q.k = d.k
"""
