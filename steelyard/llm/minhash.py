"""Operator 3: near-duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm import texthash
from steelyard.llm.common import components, key_name, materialize, runs, table

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 3
#: A shingle in one document weighs 1 + IDF_GAIN, one in all documents 1, by the logarithm in between.
IDF_GAIN = 0.25
#: Candidates are verified from so many equal samples of BANDS * ROWS on; at the threshold fewer have odds under 1e-8.
AGREE = 20
#: Documents in a block that is shingled together, shingles in a bin that is counted together, blocks whose
#: counts in a bin are summed together.
BLOCK, BIN, TOGETHER = 200, 1 << 20, 4096
#: Members of a bucket that are compared together, from each side.
CHUNK = 256
#: Buckets of more members are verified in place, others pair by pair.
SMALL = 8


#: What a block, or a group of blocks, sends a bin: shingles, the places of those in several documents, in how many.
DEALT = pa.schema([("_block", pa.int32()), ("_group", pa.int32()), ("_bin", pa.int32()), ("_hashes", pa.binary()), ("_more", pa.binary()), ("_counts", pa.binary())])


def _tables(n: int, seed: int, size: int = 1 << 16) -> tuple[np.ndarray, ...]:
    """Per sample and slot: r, ln c of the Gamma(2, 1) variates and beta, uniform."""
    rng = np.random.default_rng(seed)
    r = rng.gamma(2.0, 1.0, (n, size)).astype(np.float32)
    c = rng.gamma(2.0, 1.0, (n, size))
    return r, (1 / r).astype(np.float32), np.log(c).astype(np.float32), rng.random((n, size)).astype(np.float32), rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TABLES: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}


def samples(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Improved consistent weighted samples: ``n`` values for each set of weighted elements; two sets agree
    in a sample with the odds of their weighted Jaccard similarity. No set may be empty.

    For element k, ``t = floor(ln w / r + beta)``, ``ln a = ln c - r (t - beta + 1)``; the element with
    the least ``a`` and its ``t`` are the sample.
    """
    if (n, seed) not in _TABLES:
        _TABLES[n, seed] = _tables(n, seed)
    rs, inverses, logs, betas, odd = _TABLES[n, seed]
    out = np.empty((len(first) - 1, n), dtype=np.uint32)
    ln_w, starts, which = np.log(weights), first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
    for i in range(n):
        slot = ((hashes * odd[i]) >> np.uint64(48)).astype(np.int64)
        r, beta = rs[i][slot], betas[i][slot]
        t = np.floor(ln_w * inverses[i][slot] + beta)
        a = logs[i][slot] - r * (t - beta + 1)
        least = np.flatnonzero(a == np.minimum.reduceat(a, starts)[which])
        value = texthash.mix(hashes[least] + (t[least].astype(np.int64) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # elements of one slot tie: the least value is taken
        at = np.searchsorted(which[least], np.arange(len(starts)))
        out[:, i] = np.minimum.reduceat(value, at) >> np.uint64(32)
    return out


def shingles(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(from, to, hashes, counts, first)`` for chunks of texts: each text's distinct shingles in order."""
    data, offsets = texthash.utf8(texts)
    for a, b in texthash.chunks(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = texthash.words(part, off)
        grams, first = texthash.ngrams(texthash.spans(texthash.prefixes(part), starts, ends), first, WORDS)
        if len(grams):
            text = np.repeat(np.arange(b - a), np.diff(first))
            for k in range(b - a):
                grams[first[k] : first[k + 1]].sort()
            new = np.ones(len(grams), dtype=bool)
            new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            yield a, b, grams[at], np.diff(np.append(at, len(grams))), np.searchsorted(text[at], np.arange(b - a + 1))
        else:
            yield a, b, grams, np.zeros(0, dtype=np.int64), np.zeros(b - a + 1, dtype=np.int64)


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _ordered(block: pa.Table, key: str) -> pa.Table:
    return block.sort_by([(key, "ascending"), ("_md5", "ascending")])


def _log_step(n: int) -> float:
    """Document frequencies are told apart in 255 steps of the logarithm of the number of documents."""
    return math.log(max(n, 2)) / 255


def sketched(docs: DataFrame, key: str, text: str, *, threshold: float, seed: int) -> DataFrame:
    """``(key, _md5, signature, hashes, weights)`` of the documents that can have a near-duplicate.

    Each block of documents has its shingles combined and dealt to bins by their hash, with 32 bits of it
    in one array per block and bin and the counts over 1 beside it. A bin sums up in how many documents a
    shingle is and answers every block with the places of the shared ones; of many blocks, groups are
    summed first and then the groups' sums, so a shingle of all documents is one number per block and then
    one per group. So document frequencies cover all documents and no row is made per shingle. A document
    can reach the threshold only if as much of its weight is in shared shingles.
    """
    sizes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    n, blocks, bins = sizes[0], max(1, math.ceil(sizes[0] / BLOCK)), max(48, math.ceil(sizes[1] / 6 / BIN))
    step = _log_step(n)
    base = docs.select(F.col(key), _digest(text).alias("_md5"), F.col(text).alias("_text"))
    base = base.withColumn("_block", F.pmod(F.xxhash64(key, "_md5"), F.lit(blocks)).cast("int"))

    def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles by bin and 32 bits, where each of ``h`` is among them, how often, and where bins begin."""
        some, at, counts = np.unique((h >> np.uint64(32)) % np.uint64(bins) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF)), return_inverse=True, return_counts=True)
        return some, at, counts, np.searchsorted(some >> np.uint64(32), np.arange(bins + 1, dtype=np.uint64))

    def deal(block: pa.Table) -> pa.Table:
        parts = [h for _, _, h, _, _ in shingles(_ordered(block, key)["_text"])]
        some, _, counts, edges = places(np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64))
        low, own, rows = some.astype(np.uint32), block["_block"][0].as_py(), []
        for k in np.flatnonzero(np.diff(edges)):
            n = counts[edges[k] : edges[k + 1]]
            more = np.flatnonzero(n > 1)
            rows.append((own, own // TOGETHER, int(k), low[edges[k] : edges[k + 1]].tobytes(), more.astype(np.uint32).tobytes(), n[more].astype(np.int64).tobytes()))
        return pa.table(list(map(pa.array, zip(*rows, strict=True), DEALT.types)) if rows else [pa.array([], t) for t in DEALT.types], schema=DEALT)

    def gathered(rows: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the rows' arrays, the distinct shingles of all, where each is among them, and their sums."""
        arrays = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in rows["_hashes"]]
        counts = [np.ones(len(x), dtype=np.int64) for x in arrays]
        for x, more, m in zip(counts, rows["_more"], rows["_counts"], strict=True):
            x[np.frombuffer(more.as_py(), dtype=np.uint32)] = np.frombuffer(m.as_py(), dtype=np.int64)
        some, at = np.unique(np.concatenate(arrays), return_inverse=True)
        return [len(x) for x in arrays], some, at, np.bincount(at, weights=np.concatenate(counts), minlength=len(some)).astype(np.int64)

    def answered(rows: pa.Table, lengths: list[int], at: np.ndarray, codes: np.ndarray) -> pa.Array:
        """For each row the places of its shared shingles and their codes."""
        out, edges = [], np.concatenate([[0], np.cumsum(lengths)])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = codes[at[a:b]]
            shared = np.flatnonzero(part)
            out.append(shared.astype(np.uint32).tobytes() + part[shared].tobytes())
        return pa.array(out, pa.binary())

    def coded(counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 1, np.rint(np.log(np.maximum(counts, 1)) / step).clip(1, 255), 0).astype(np.uint8)

    def count(rows: pa.Table) -> pa.Table:
        lengths, _, at, sums = gathered(rows)
        return pa.table({"_block": rows["_block"], "_bin": rows["_bin"], "_shared": answered(rows, lengths, at, coded(sums))})

    def group(rows: pa.Table) -> pa.Table:
        _, some, _, sums = gathered(rows)
        more = np.flatnonzero(sums > 1)
        one = (rows["_group"][0].as_py(), rows["_group"][0].as_py(), rows["_bin"][0].as_py(), some.tobytes(), more.astype(np.uint32).tobytes(), sums[more].tobytes())
        return pa.table([pa.array([x], t) for x, t in zip(one, DEALT.types, strict=True)], schema=DEALT)

    def answer(rows: pa.Table, total: pa.Table) -> pa.Table:
        lengths, some, at, _ = gathered(rows)
        codes, found = np.zeros(len(some), dtype=np.uint8), total["_shared"][0].as_py()
        m = len(found) // 5
        codes[np.frombuffer(found, dtype=np.uint32, count=m)] = np.frombuffer(found, dtype=np.uint8, offset=4 * m)
        return pa.table({"_block": rows["_block"], "_bin": rows["_bin"], "_shared": answered(rows, lengths, at, codes)})

    def sketch(block: pa.Table, answers: pa.Table) -> pa.Table:
        block = _ordered(block, key)
        parts = list(shingles(block["_text"])) if block.num_rows else []
        h = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, dtype=np.uint64)
        tf = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0)
        length = np.concatenate([np.diff(p[4]) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        some, at, _, edges = places(h)
        code = np.zeros(len(some), dtype=np.uint8)
        for k, found in zip(answers["_bin"].to_pylist(), answers["_shared"].to_pylist(), strict=True):
            m = len(found) // 5
            code[edges[k] + np.frombuffer(found, dtype=np.uint32, count=m)] = np.frombuffer(found, dtype=np.uint8, offset=4 * m)
        code = code[at]
        idf = 1 + IDF_GAIN * (1 - np.arange(256) / 255)
        w = (tf * idf[code]).astype(np.float32)
        first = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        sums = np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)])
        own = np.concatenate([[0.0], np.cumsum(np.where(code > 0, w, 0), dtype=np.float64)])
        keep = np.flatnonzero((length > 0) & (np.diff(own[first]) >= (threshold - 0.01) * np.diff(sums[first])))
        out = {key: block[key].take(pa.array(keep)), "_md5": block["_md5"].take(pa.array(keep))}
        spans = [slice(first[k], first[k + 1]) for k in keep]
        signature = np.zeros((0, BANDS * ROWS), dtype=np.uint32)
        if len(keep):
            hs, ws = np.concatenate([h[s] for s in spans]), np.concatenate([w[s] for s in spans])
            signature = samples(hs, ws, np.concatenate([[0], np.cumsum(length[keep])]), BANDS * ROWS, seed)
        out |= {"signature": pa.array([x.tobytes() for x in signature], pa.binary()), "hashes": pa.array([h[s].tobytes() for s in spans], pa.binary()), "weights": pa.array([w[s].tobytes() for s in spans], pa.binary())}
        return pa.table(out)

    dealt = base.groupBy("_block").applyInArrow(deal, "_block int, _group int, _bin int, _hashes binary, _more binary, _counts binary")
    shared = "_block int, _bin int, _shared binary"
    if blocks <= TOGETHER:
        answers = dealt.groupBy("_bin").applyInArrow(count, shared)
    else:
        dealt = materialize(dealt, "minhash")
        groups = dealt.groupBy("_bin", "_group").applyInArrow(group, "_block int, _group int, _bin int, _hashes binary, _more binary, _counts binary")
        totals = groups.groupBy("_bin").applyInArrow(count, shared).withColumnRenamed("_block", "_group")
        answers = dealt.groupBy("_bin", "_group").cogroup(totals.groupBy("_bin", "_group")).applyInArrow(answer, shared)
    kind = dict(docs.dtypes)[key]
    return base.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(sketch, f"`{key}` {kind}, _md5 string, signature binary, hashes binary, weights binary")


def banded(sketches: DataFrame, key: str) -> DataFrame:
    """``(h, band, id)``: the buckets of each document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
                h = np.zeros(s.shape[:2], dtype=np.uint64)
                for k in range(ROWS):
                    h = texthash.mix(h + s[:, :, k] + np.uint64(k + 1))
                h = texthash.mix(h + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(h))), batch.column(0).take(pa.array(np.repeat(np.arange(len(h)), BANDS)))], ["h", "band", "id"])

    return sketches.select(F.col(key).cast("long"), "signature").mapInArrow(of, "h long, band int, id long")


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    at = np.searchsorted(ha, hb)
    at[at == len(ha)] = 0
    both = ha[at] == hb
    common = np.minimum(wa[at[both]], wb[both]).sum(dtype=np.float64)
    return float(common / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - common))


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose exact weighted Jaccard similarity reaches the threshold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, x in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                a, wa, b, wb = (np.frombuffer(v, dtype=d) for v, d in zip(x, (np.uint64, np.float32) * 2, strict=True))
                if weighted_jaccard(a, wa, b, wb) >= threshold:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], ["a", "b"])

    side = lambda c: vectors.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}"), F.col("weights").alias(f"w{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "wa", "hb", "wb")
    return both.mapInArrow(of, "a long, b long")


def compared(members: DataFrame, agree: int, threshold: float | None = None) -> DataFrame:
    """Pairs ``(a, b)`` across components in one bucket that agree in enough samples, each in the first
    bucket that it shares. ``members`` has ``h, band, id, component, signature`` and of its bucket ``big``,
    the largest component, with its ``n_big`` members, and the number ``n_rest`` of the others.

    The others, in chunks, are compared with the chunks of the largest component and with each other;
    members of the largest are never compared among themselves. So a bucket of n copies and a few strays
    makes about 2 n rows, and no task gathers a bucket.

    With a ``threshold``, ``members`` has ``hashes, weights`` too, pairs are verified in place, best
    agreement first, and only those that join two components are returned.
    """
    pieces = lambda n: F.greatest(F.ceil(F.col(n) / CHUNK), F.lit(1)).cast("int")
    place = lambda i, j, left: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(left).alias("left"))
    own, bigs, rests = F.col("_c"), F.col("_bigs"), F.col("_rests")
    rows = members.withColumn("_bigs", pieces("n_big")).withColumn("_rests", pieces("n_rest")).withColumn("_c", F.pmod(F.xxhash64("id"), F.when(F.col("component") == F.col("big"), F.col("_bigs")).otherwise(F.col("_rests"))).cast("int"))
    # j counts the chunks of the largest component and then those of the others; a chunk with itself is -1
    with_rest = F.transform(F.sequence(F.lit(0), rests - 1), lambda i: place(i, own, False))
    as_left = F.transform(F.filter(F.sequence(F.lit(0), bigs + rests - 1), lambda j: (j < bigs) | (j >= bigs + own)), lambda j: place(own, F.when(j == bigs + own, -1).otherwise(j), True))
    as_right = F.transform(F.filter(F.sequence(F.lit(0), rests - 1), lambda i: i < own), lambda i: place(i, bigs + own, False))
    columns = ["h", "band", "id", "component", "signature", *(["hashes", "weights"] if threshold else [])]
    rows = rows.select(*columns, F.explode(F.when(F.col("component") == F.col("big"), with_rest).otherwise(F.concat(as_left, as_right))).alias("p")).select("h", "p.*", *columns[1:])
    rows = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    def joining(group: pd.DataFrame, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> list[int]:
        vectors = [(np.frombuffer(h, dtype=np.uint64), np.frombuffer(w, dtype=np.float32)) for h, w in zip(group["hashes"], group["weights"], strict=True)]
        root = {c: c for c in group["component"]}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        comp, out = group["component"].tolist(), []
        for k in np.argsort(-equal, kind="stable"):
            x, y = find(comp[a[k]]), find(comp[b[k]])
            if x != y and weighted_jaccard(*vectors[a[k]], *vectors[b[k]]) >= threshold:
                root[x] = y
                out.append(k)
        return out

    def of(group: pd.DataFrame) -> pd.DataFrame:
        ids, comp, band, left = (group[c].to_numpy() for c in ("id", "component", "band", "left"))
        s = np.frombuffer(b"".join(group["signature"]), dtype=np.uint32).reshape(len(group), BANDS, ROWS)
        itself, right = group["j"].iloc[0] < 0, np.flatnonzero(~left)
        a, b, equal = [], [], []
        for k in np.flatnonzero(left):
            others = np.arange(k + 1, len(ids)) if itself else right
            same = s[others] == s[k]
            count = same.sum(axis=(1, 2))
            found = np.flatnonzero((count >= agree) & (comp[others] != comp[k]) & (same.all(axis=2).argmax(axis=1) == band[k]))
            a.append(np.full(len(found), k))
            b.append(others[found])
            equal.append(count[found])
        a, b, equal = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (a, b, equal))
        if threshold and len(a):
            keep = joining(group, a, b, equal)
            a, b = a[keep], b[keep]
        return pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])}).drop_duplicates()

    return rows.mapInPandas(lambda frames: (of(g) for g in runs(frames, ["h", "i", "j"])), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, seed: int = 5, digest: str | None = None) -> DataFrame:
    """Group documents whose texts are equal or reach the weighted Jaccard similarity ``threshold`` over
    TF-IDF shingles of five words, directly or by way of others: ``(key, class_id, kept)``, one row per
    input row. ``class_id`` is the smallest key of the group, whose row is ``kept``.

    Equal texts share a class by their digest; of each text the smallest key is compared. Documents that
    share a band of samples are candidates, and every pair counts only once it is verified. First each
    bucket's members are compared with its smallest; after that only members outside a bucket's largest
    component with all of other components, and where a bucket is large inside the task, best agreement
    first, so a group of copies is never expanded into its pairs, yet no pair of different components
    stays uncompared.

    A null text is an empty one; texts without a word equal only themselves; a text of fewer than five
    words is one shingle; a very long text is shingled whole, by itself; rows without a key get a null class and are kept; repeated rows share a class;
    an empty table gives no rows. ``key`` is a whole number. ``digest`` names a column with each row's
    digest of its text. Other columns are not read, and a key named as one that is added comes out with ``_key``
    behind its name.
    """
    name = key_name(key, ("class_id", "kept", digest or "kept"))
    docs, key, text = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_body")), "_doc", "_body"
    own = docs.where(F.col(key).isNotNull())
    sketches = materialize(sketched(own, key, text, threshold=threshold, seed=seed), "minhash")
    first = sketches.groupBy("_md5").agg(F.min(key).alias("id"))
    firsts = materialize(sketches.join(first, (F.col(key) == F.col("id")) & (sketches["_md5"] == first["_md5"]), "left_semi").dropDuplicates([key]).select(F.col(key).cast("long").alias("id"), "signature", "hashes", "weights"), "minhash")
    buckets = materialize(banded(firsts.withColumnRenamed("id", key), key), "minhash")

    low = buckets.groupBy("h").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = buckets.join(low, "h").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    tested = materialize(pairs, "minhash")
    edges = materialize(verified(tested, firsts, threshold), "minhash")
    labels = components(edges)
    marked = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = marked.groupBy("h", "component").agg(F.count("*").alias("_m"))
    split = parts.groupBy("h").agg(F.max_by("component", F.struct("_m", -F.col("component"))).alias("big"), F.max("_m").alias("n_big"), F.sum("_m").alias("n")).where("n > n_big")
    members = materialize(marked.join(split.withColumn("n_rest", F.col("n") - F.col("n_big")), "h"), "minhash")
    few = compared(members.where(F.col("n") <= SMALL).join(firsts.select("id", "signature"), "id"), AGREE)
    more = verified(few.join(tested, ["a", "b"], "left_anti"), firsts, threshold)
    many = compared(members.where(F.col("n") > SMALL).join(firsts, "id"), AGREE, threshold)
    more = materialize(more.unionByName(many), "minhash")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))

    rows = docs.select(key, _digest(text).alias("_md5"))
    classes = rows.where(F.col(key).isNotNull()).groupBy("_md5").agg(F.min(key).alias("_first"))
    classes = classes.join(labels.select(F.col("id").alias("_first"), "component"), "_first", "left")
    classes = classes.select("_md5", F.coalesce("component", "_first").alias("class_id"))
    out = rows.join(classes, "_md5", "left").withColumn("class_id", F.when(F.col(key).isNotNull(), F.col("class_id")))
    out = out.withColumn("kept", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True)))
    return out.select(F.col(key).alias(name), "class_id", "kept", *([F.col("_md5").alias(digest)] if digest else []))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **plan) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, one of each group, with all their columns.

    A row is known by its key and text; rows without a key all stay.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kept = near_duplicates(slim, key="_key", text="_text", digest="_digest", **plan)
    kept = kept.where("kept AND _key IS NOT NULL").select("_key", "_digest")
    own = docs.where(F.col(key).isNotNull()).select(F.struct("*").alias("_row"), F.col(key).alias("_key"), _digest(text).alias("_digest"))
    own = own.join(kept, ["_key", "_digest"], "left_semi").dropDuplicates(["_key", "_digest"])
    return own.select("_row.*").unionByName(docs.where(F.col(key).isNull()))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs that share a shingle, compared without samples or bands.
SQL_OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g FROM d),
t AS (SELECT doc_id, g, count(*) AS tf FROM s GROUP BY 1, 2),
f AS (SELECT g, count(*) AS df FROM t GROUP BY 1),
k AS (SELECT g, CASE WHEN df = 1 THEN 0 ELSE least(255, greatest(1, round(ln(df) / (ln(greatest((SELECT count(*) FROM documents), 2)) / 255)))) END AS code FROM f),
x AS (SELECT doc_id, t.g, tf * (1 + {IDF_GAIN}::DOUBLE * (1 - code / 255.0::DOUBLE)) AS w FROM t JOIN k ON k.g = t.g),
m AS (SELECT doc_id, sum(w) AS total FROM x GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.w, b.w)) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN m u ON u.doc_id = a JOIN m v ON v.doc_id = b WHERE c / (u.total + v.total - c) >= {THRESHOLD} UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.text = b.text AND a.doc_id < b.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, doc_id <= coalesce(low, doc_id) AS kept FROM documents LEFT JOIN c ON c.a = doc_id
"""
