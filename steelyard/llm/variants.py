"""Operator 12: spelling variants by full neighbourhood generation and a hash join to the vocabulary."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm.common import drop, materialize, table
from steelyard.llm.texthash import mix, powers, utf8

#: Runs of letters of the contract, all of which one byte holds in Latin-1.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
LATIN = "ISO-8859-1"
LEAST_LENGTH, LEAST_COUNT, RATIO, CHANGED = 7, 2, 10, 31
#: Bits of the filter for each word, and its largest size in 64-bit words (64 MiB). Beyond it more candidates
#: reach the join, which alone decides.
BITS, MOST = 32, 1 << 23
#: Rows of the filter that one row of a table holds.
SEGMENT = 1 << 10
#: Words whose candidates one task makes, about.
DEALT = 1 << 15
#: Candidates that are looked up together, about.
TOGETHER = 1 << 21
_CODES = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, a row for each run of letters: A-Z in lower case, and where 31 divides the checksum of
    ``key:word`` without the code point that the checksum names."""
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("_w"))
    h = F.crc32(F.concat("_k", F.lit(":"), "_w").cast("binary"))
    at = (h % F.length("_w")).cast("int")
    less = F.concat(F.substring("_w", F.lit(1), at), F.expr("substring(_w, _at + 2)"))
    return runs.withColumns({"_h": h, "_at": at}).select(F.when(F.col("_h") % CHANGED == 0, less).otherwise(F.col("_w")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """``(word, n)`` of rows ``word``: long enough and more than once."""
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Neighbours:
    """The neighbourhoods of many words, as places in them and letters.

    A word's number is the sum of its letters' codes times powers of a base, so that of each deletion,
    replacement and insertion follows from sums over the word's beginning and end. Of equal candidates of a word
    one is made: a letter that repeats the one before it is not deleted again, a letter is not put behind itself,
    and none is replaced by itself.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray):
        self.data, self.offsets, self.alphabet = data, offsets, alphabet
        up, self.down = powers(len(data) + 2)
        self.up = up
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[data] * up[: len(data)])])

    def _own(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of data[start:end]."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def numbers(self) -> np.ndarray:
        return self._own(self.offsets[:-1], self.offsets[1:])

    def candidates(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
        """``(kind, word, place, letter, number)``, parts of all candidates, each once."""
        lengths = np.diff(self.offsets)
        step = max(1, TOGETHER // (2 * len(self.alphabet) + 1))
        firsts = np.concatenate([[0], np.cumsum(lengths + 1)])
        for lo in range(0, int(firsts[-1]), step):
            flat = np.arange(lo, min(lo + step, firsts[-1]))
            word = np.searchsorted(firsts, flat, side="right") - 1
            place = flat - firsts[word]
            start, end = self.offsets[word], self.offsets[word + 1]
            here = start + place
            head = self._own(start, here)
            inside = here < end
            power, letters = self.up[place], _CODES[self.alphabet]
            tail = self._own(here, end)
            put = head + tail * self.up[place + 1]
            ins = put[:, None] + letters * power[:, None]
            behind = np.where(place > 0, self.data[np.maximum(here - 1, 0)].astype(np.int64), -1)
            new = behind[:, None] != self.alphabet
            r, c = np.nonzero(new)
            yield "insert", word[r], place[r], self.alphabet[c], ins[new]
            word, place, here, end, head, power, behind, start = (x[inside] for x in (word, place, here, end, head, power, behind, start))
            own = self.data[here]
            rep = (self._own(start, end) - _CODES[own] * power)[:, None] + letters * power[:, None]
            new = own[:, None] != self.alphabet
            r, c = np.nonzero(new)
            yield "replace", word[r], place[r], self.alphabet[c], rep[new]
            once = behind != own
            yield "delete", word[once], place[once], None, (head + self._own(here + 1, end) * power)[once]

    def built(self, kind: str, word: np.ndarray, place: np.ndarray, letter: np.ndarray | None) -> pa.Array:
        """The bytes of candidates."""
        change = {"insert": 1, "replace": 0, "delete": -1}[kind]
        lengths = np.diff(self.offsets)[word] + change
        edges = np.concatenate([[0], np.cumsum(lengths)])
        row = np.repeat(np.arange(len(word)), lengths)
        at = np.arange(edges[-1]) - edges[:-1][row]
        later = at > place[row] if kind != "delete" else at >= place[row]
        out = self.data[np.minimum(self.offsets[word][row] + at - np.where(later, change, 0), len(self.data) - 1)]
        if letter is not None:
            out[edges[:-1] + place] = letter
        return pa.Array.from_buffers(pa.large_binary(), len(word), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _probe(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each number's word of the filter, and its three bits there."""
    numbers = mix(numbers)
    six = np.uint64(63)
    bits = np.uint64(1) << (numbers & six) | np.uint64(1) << (numbers >> np.uint64(6) & six) | np.uint64(1) << (numbers >> np.uint64(12) & six)
    return ((numbers >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), bits


def _filter_size(n: int) -> int:
    """64-bit words of the filter for n words, a power of two."""
    return min(MOST, max(SEGMENT, 1 << math.ceil(math.log2(max(1, n * BITS / 64)))))


def word_filter(vocab: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the words, MOST 64-bit words at most: tasks set bits of their own range of it."""
    size = _filter_size(n)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            at, bits = _probe(Neighbours(data, offsets, np.zeros(0, np.uint8)).numbers(), size)
            yield pa.RecordBatch.from_arrays([pa.array((at // SEGMENT).astype(np.int32)), pa.array((at % SEGMENT).astype(np.int32)), pa.array(bits.view(np.int64))], ["segment", "at", "bits"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, at, bits = (batch.column(c).to_numpy() for c in range(3))
            for k in np.unique(segment).tolist():
                mine = segment == k
                np.bitwise_or.at(own.setdefault(k, np.zeros(SEGMENT, dtype=np.int64)), at[mine], bits[mine])
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["segment", "bits"])

    found = vocab.select("latin").mapInArrow(probes, "segment int, at int, bits long").repartition("segment").mapInArrow(segments, "segment int, bits binary")
    out = np.zeros(size, dtype=np.uint64)
    for row in found.toLocalIterator():
        out[row.segment * SEGMENT : (row.segment + 1) * SEGMENT] = np.frombuffer(row.bits, dtype=np.uint64)
    return out


def near_words(vocab: DataFrame) -> DataFrame:
    """``(latin, n_near, best)`` of words ``latin, n``, in Latin-1: how many words are one insertion, deletion or
    replacement away, and of these the most frequent, ``best.n, best.latin``.

    Each word hands its count to all its candidates over the letters that occur. A candidate that is a word is
    near it, and the relation has no direction, so what a word receives are its near words. Candidates that can't
    be words stop at the filter; the others are combined by candidate and joined to the words.
    """
    letters = vocab.select(F.explode(F.split(F.decode("latin", LATIN), "")).alias("c")).distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect() if r.c), dtype=np.uint8)  # 256 at most
    n = vocab.count()
    known = vocab.sparkSession.sparkContext.broadcast(word_filter(vocab, n))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_ = known.value
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            words, counts = Neighbours(data, offsets, alphabet), batch.column(1)
            for kind, word, place, letter, number in words.candidates():
                at, bits = _probe(number, len(bits_))
                hit = np.flatnonzero(bits_[at] & bits == bits)
                word, place, letter = word[hit], place[hit], None if letter is None else letter[hit]
                rows = pa.array(word)
                yield pa.RecordBatch.from_arrays([words.built(kind, word, place, letter), batch.column(0).take(rows), counts.take(rows)], ["to", "latin", "n"])

    # a word makes about a thousand candidates, so words are dealt out to more tasks than their files are
    dealt = vocab.select("latin", "n").repartition(max(1, -(-n // DEALT)))
    found = dealt.mapInArrow(of, "to binary, latin binary, n long")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("latin").alias("l")))
    got = found.groupBy(F.col("to").alias("latin")).agg(F.count("*").alias("n_near"), best.alias("_b"))
    return got.join(vocab.select("latin"), "latin").select("latin", "n_near", F.struct((-F.col("_b.m")).alias("n"), F.col("_b.l").alias("latin")).alias("best"))


def spelling_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n, n_near, form, form_n, root)``, one row per word of the whole texts.

    Words are runs of Latin letters, A-Z in lower case, of 7 code points at least that occur twice at least (with
    the contract's rule for runs that lose a letter). Words are near if one inserted, deleted or replaced code
    point apart; a word's form is its most frequent near word, of equal ones the first in code-point order, if
    that occurs ten times as often; its root is the last form that forms lead to.

    All deletions, replacements and insertions over the letters that occur are made and joined to the
    vocabulary by their text, so no distance is computed. They are combined by candidate before the shuffle and a
    word has no more near words than its neighbourhood, so no key is hot. Forms are at least ten times as
    frequent, so a chain of them is as long as the largest count has digits, and doubling ends it.

    Null and empty texts have no words; a very long text or word is taken whole; repeated rows count each; a null
    key is an empty one in checksums; an empty table gives no rows; other columns are not read.
    """
    words = vocabulary(occurrences(docs, key, text))
    vocab = materialize(words.select(F.encode("word", LATIN).alias("latin"), "n"), "words")
    enough = F.col("best.n") >= RATIO * F.col("n")
    near = near_words(vocab)
    found = vocab.join(near, "latin", "left").withColumns({"form": F.when(enough, F.col("best.latin")), "form_n": F.when(enough, F.col("best.n"))})
    found = materialize(found.select("latin", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n"), "words")
    most = found.agg(F.max("form_n")).first()[0] or 1
    hops = found.where("form IS NOT NULL").select("latin", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, len(str(most)))))):
        was, hops = hops, materialize(hops.join(hops.select(F.col("latin").alias("root"), F.col("root").alias("_r")), "root", "left").select("latin", F.coalesce("_r", "root").alias("root")), "words")
        if hasattr(was, "_scratch"):
            drop(was)
    out = found.join(hops, "latin", "left")
    said = lambda c, name: F.decode(c, LATIN).alias(name)
    return out.select(said("latin", "word"), "n", "n_near", said("form", "form"), "form_n", said(F.coalesce("root", "latin"), "root"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL_OP12 = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS w FROM documents)
  GROUP BY doc_id, w),
b AS (SELECT doc_id, w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r),
h AS (
  SELECT w, k, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST(instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 17 AS BIGINT))),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h FROM b, crc),
v AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
e AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
n AS (SELECT e.a AS word, count(*) AS n_near, max(v.n) AS most FROM e JOIN v ON v.word = e.b GROUP BY e.a),
f AS MATERIALIZED (
  SELECT n.word, min(e.b) AS form, any_value(n.most) AS form_n FROM n JOIN v ON v.word = n.word JOIN e ON e.a = n.word JOIN v o ON o.word = e.b AND o.n = n.most
  WHERE n.most >= 10 * v.n GROUP BY n.word),
u(word, root) AS (SELECT word, form FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON f.word = u.root),
l AS (SELECT word, root FROM u WHERE root NOT IN (SELECT word FROM f))
SELECT v.word, v.n, coalesce(n.n_near, 0) AS n_near, f.form, f.form_n, coalesce(l.root, v.word) AS root
FROM v LEFT JOIN n ON n.word = v.word LEFT JOIN f ON f.word = v.word LEFT JOIN l ON l.word = v.word
"""
