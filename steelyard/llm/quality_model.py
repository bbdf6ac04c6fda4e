"""Operator 10: a quality classifier, naive Bayes scaled support vectors by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm import texthash
from steelyard.llm.common import materialize, table

#: Features are hashed to so many bits.
BITS = 18
#: Labelled rows of each class that are learned from, about; more are thinned evenly by their key's hash.
ROWS_PER_CLASS = 2000
#: Bytes of features that go to the driver, about: of more, rows are thinned by their hash.
SAMPLE_BYTES = 64 << 20
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 15

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 punctuation
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 4)):
    _KIND[list(_chars)] = _kind


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, features, first)`` for chunks of texts: each text's distinct n-gram indicators.

    The n-grams are words and word pairs, and one to three words' shapes: how many capitals, small
    letters, digits and punctuation marks, the last mark, and whether the word repeats the one before.
    """
    data, offsets = texthash.utf8(texts)
    for a, b in texthash.chunks(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = texthash.words(part, off)
        keys = [np.zeros(0, dtype=np.uint64)]
        if len(starts):
            word = texthash.spans(texthash.prefixes(part), starts, ends)
            kind = _KIND[part]
            shape = np.zeros(len(word), dtype=np.uint64)
            for k, most in ((1, 1), (2, 2), (3, 1), (4, 4)):
                total = np.concatenate([[0], np.cumsum(kind == k)])
                shape = shape * np.uint64(8) + np.minimum(total[ends] - total[starts], most).astype(np.uint64)
            shape = shape * np.uint64(256) + np.where(kind[ends - 1] == 4, part[ends - 1], 0).astype(np.uint64)
            again = np.zeros(len(word), dtype=bool)
            again[1:] = word[1:] == word[:-1]
            again[first[:-1][first[:-1] < len(word)]] = False
            shape = texthash.mix(shape * np.uint64(2) + again.astype(np.uint64) + np.uint64(1))
            for seed, (items, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
                grams, at = texthash.ngrams(items, first, n, seed + 1)
                text = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(at))
                keys.append((text << np.uint64(BITS)) | (grams >> np.uint64(64 - BITS)))
        key = np.sort(np.concatenate(keys))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        text = (key >> np.uint64(BITS)).astype(np.int64)
        yield a, b, (key & np.uint64((1 << BITS) - 1)).astype(np.int32), np.searchsorted(text, np.arange(b - a + 1))


@dataclass
class Model:
    """A text's margin is the sum of ``value`` over its features by the root of the sum of ``square``, plus
    ``bias``; the score is the logistic function of ``slope`` * margin + ``shift``."""

    value: np.ndarray
    square: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[ids], dtype=np.float64)])[first])
        return total(self.value) / np.sqrt(np.maximum(total(self.square), 1e-12)) + self.bias

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids, first) + self.shift, -60, 60)))


def fit_margin(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, *, cost: float = COST, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Log-count ratios of the indicators, then the linear hinge loss by dual coordinate descent.

    Each step solves one row's dual variable exactly within ``[0, cost * weight]`` and moves the weights.
    """
    size = 1 << BITS
    of_class = lambda s: np.concatenate([np.zeros(0, dtype=np.int32), *(r for r, y in zip(rows, labels, strict=True) if y == s)])
    counts = [SMOOTHING + np.bincount(of_class(s), minlength=size) for s in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scale = [1 / max(np.sqrt((ratio[r] ** 2).sum()), 1e-6) for r in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    w, bias, alpha, top = np.zeros(size), 0.0, np.zeros(len(rows)), cost * weights
    norm = np.array([(ratio[r] ** 2).sum() * c * c + 1 for r, c in zip(rows, scale, strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = ratio[r] * scale[i]
            gradient = y[i] * ((w[r] * x).sum() + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), top[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model(w * ratio, ratio**2, bias)


def calibrated(model: Model, margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
    """Slope and shift of the logistic function by Newton's method on rows that the margin wasn't fitted to."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g, h = weights * (p - labels), weights * p * (1 - p) + 1e-9
        ga, gb = (g * margins).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * margins**2).sum() + 1e-3, (h * margins).sum(), h.sum()
        det = haa * hbb - hab**2
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return Model(model.value, model.square, model.bias, max(a, 1e-3), b)


def held_out(key: str) -> Column:
    """Rows that no label is learned from: crc32 of the key as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows_per_class: int = ROWS_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit the model on labelled rows that are not held out, ``rows_per_class`` of each class at most, about,
    and ``sample_bytes`` of features in all, about (a text, however long, has 1 MiB at most).

    Rows without a key, label or text count as unlabelled; of repeated label rows each counts, and so do
    repeated documents; rows are taken in the order of their hash, so ties don't matter. With one class
    alone every text scores near 0 or 1 for it; without labels, or from an empty table, near 1.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).select(key, F.col(label).cast("int").alias("_y"))
    totals = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if len(totals) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, -60.0 if 0 in totals else 60.0)
    share = F.when(F.col("_y") == 1, rows_per_class / totals[1]).otherwise(rows_per_class / totals[0])
    known = known.where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) < share * (1 << 30))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, first in features(batch.column(2)):
                blobs = [ids[first[k] : first[k + 1]].tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(blobs, pa.binary())], ["k", "y", "ids"])

    # the sample is bounded by its parameter
    sample = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(known), key).select(F.xxhash64(F.lit(12), key, text).alias("k"), "_y", text)
    found = materialize(sample.mapInArrow(of, "k long, y int, ids binary"), "quality")
    thinned = F.lit(sample_bytes) / F.greatest(F.lit(found.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]), F.lit(1))
    kept = found.where(F.pmod(F.xxhash64(F.lit(13), "k"), F.lit(1 << 30)) < thinned * (1 << 30))
    found = kept.toArrow().sort_by([("k", "ascending"), ("y", "ascending"), ("ids", "ascending")])
    rows, y = [np.frombuffer(r.as_buffer(), dtype=np.int32) for r in found["ids"]], found["y"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, -60.0 if 0 in y else 60.0)
    # classes weigh the same in the fit; the calibration has them as they are in the table
    even = np.where(y == 1, len(y) / 2 / max((y == 1).sum(), 1), len(y) / 2 / max((y == 0).sum(), 1))
    true = np.where(y == 1, totals[1] / max((y == 1).sum(), 1), totals[0] / max((y == 0).sum(), 1))
    fold = np.arange(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3) if len(y) >= 30 else ():
        model = fit_margin([r for r, f in zip(rows, fold, strict=True) if f != k], y[fold != k], even[fold != k])
        at = np.flatnonzero(fold == k)
        first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in at])])
        margins[at] = model.margin(np.concatenate([rows[i] for i in at]) if len(at) else np.zeros(0, dtype=np.int32), first)
    model = fit_margin(rows, y, even)
    return calibrated(model, margins, y, true / true.mean()) if len(y) >= 30 else model


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """Add ``score``, 0 to 1, of each text alone. A null or empty text gets the score of no features; a very
    long one is scored whole, by itself; repeated rows score alike, whatever their keys; an input column of
    that name, in whatever case, gives way; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    slim = docs.select(*kept, *([] if text in kept else [F.col(text).alias("_scored")]))
    at = slim.columns.index(text if text in kept else "_scored")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(ids, first) for _, _, ids, first in features(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.concatenate(out) if out else np.zeros(0))], [*kept, name])

    schema = docs.select(*kept).schema.add(name, "double")
    return slim.mapInArrow(of, schema)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
