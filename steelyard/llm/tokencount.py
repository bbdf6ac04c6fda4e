"""Operator 2: token counts by a count-only Viterbi search over Aho-Corasick matches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm.common import key_name, table

#: Words whose counts a worker remembers; then it starts anew.
REMEMBERED = 1 << 19
#: Characters of new words that are searched together.
TOGETHER = 1 << 19
#: Words of so many characters are searched one by one: together, each step along them costs as much as for many.
LONG = 4096
SPACE = "▁"
#: What an unknown character scores below the worst piece.
PENALTY = 10.0


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of the model at ``path`` as a unigram vocabulary: a piece scores the logarithm of its
    share under Zipf's law, by its rank. (The public files hold no unigram model, and none is trained.)"""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = math.log(sum(1 / (k + 2) for k in range(n)))
    return [(model.id_to_piece(k), -math.log(k + 2) - total) for k in range(n)]


class Counter:
    """Counts of pieces of words, as the unigram tokenizer with byte fallback cuts them.

    The tokenizer starts pieces from left to right and a later path must score more to replace an
    earlier one, so of equal paths to a place the one with the longest last piece stays. A character
    that is no piece by itself may be unknown: it scores the worst piece less PENALTY and becomes its
    UTF-8 bytes.
    """

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (piece, _) in enumerate(vocab):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.scores = np.array([s for _, s in vocab])
        self.lengths = np.array([len(p) for p, _ in vocab])
        self.unknown = min(s for _, s in vocab) - PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each word, every word from its first character on at the same time."""
        lengths = np.array([len(w) for w in words])
        joined = "\x00".join(words)  # inside no piece
        first = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), dtype=np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        start, score = end - self.lengths[piece], self.scores[piece]
        single = np.zeros(len(joined), dtype=bool)
        single[start[self.lengths[piece] == 1]] = True
        units = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        bytes_ = 1 + (units >= 0x80).astype(np.int64) + (units >= 0x800) + (units >= 0x10000)
        lone = np.flatnonzero(~single & np.repeat(np.tile([True, False], len(words)), np.stack([lengths, np.ones_like(lengths)], axis=1).ravel())[: len(joined)])
        # matches come by end, the longest first; unknown characters go behind those that end with them
        at = np.searchsorted(end, lone + 1, side="right")
        start, score = np.insert(start, at, lone), np.insert(score, at, self.unknown)
        worth = np.insert(np.ones(len(end), dtype=np.int64), at, bytes_[lone])
        end = np.insert(end, at, lone + 1)
        owner = np.repeat(first, lengths + 1)
        depth = end - owner[start]
        order = np.argsort(depth.astype(np.int16) if depth.max(initial=0) < 1 << 15 else depth, kind="stable")
        start, end, score, worth, depth = (x[order] for x in (start, end, score, worth, depth))
        best, count = np.zeros(len(joined) + 1), np.zeros(len(joined) + 1, dtype=np.int64)
        edges = np.searchsorted(depth, np.arange(1, depth[-1] + 2) if len(depth) else [])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            total, at = best[start[a:b]] + score[a:b], end[a:b]
            heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            top = np.maximum.reduceat(total, heads)
            hits = np.flatnonzero(total == np.repeat(top, np.diff(np.append(heads, b - a))))
            hits = hits[np.concatenate([[True], at[hits[1:]] != at[hits[:-1]]])]
            best[at[hits]], count[at[hits]] = total[hits], count[start[a:b][hits]] + worth[a:b][hits]
        return count[first + lengths], best[first + lengths]

    def walk(self, word: str) -> tuple[int, float]:
        """Pieces and score of one word, end by end; the same as :meth:`search`, faster for a long word."""
        best, count = [0.0] * (len(word) + 1), [0] * (len(word) + 1)
        scores, lengths, at, top, pieces, single = self.scores.tolist(), self.lengths.tolist(), 0, -math.inf, 0, False

        def close(end: int) -> None:
            nonlocal at, top, pieces, single
            if not single and best[end - 1] + self.unknown > top:
                top, pieces = best[end - 1] + self.unknown, count[end - 1] + len(word[end - 1].encode())
            best[end], count[end] = top, pieces
            at, top, pieces, single = end, -math.inf, 0, False

        for last, piece in self.automaton.iter(word):
            while at < last:
                close(at + 1)
            start = last + 1 - lengths[piece]
            single = single or start == last
            total = best[start] + scores[piece]
            if total > top:
                top, pieces = total, count[start] + 1
        while at < len(word):
            close(at + 1)
        return count[-1], best[-1]

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        part, size = [], 0
        for w in sorted(words):
            if len(w) > LONG:
                self.known[w] = self.walk(SPACE + w)
                continue
            part.append(SPACE + w)
            size += len(w)
            if size > TOGETHER:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)

    def _learn(self, words: list[str]) -> None:
        for w, n, s in zip(words, *(x.tolist() for x in self.search(words)), strict=True):
            self.known[w[1:]] = n, s

    def counts(self, texts: list[str | None]) -> list[tuple[int, float]]:
        """Pieces and score of each text; words are joined to the space before them."""
        cut = [t.replace(" ", SPACE).removeprefix(SPACE).split(SPACE) if t else [] for t in texts]
        words = set().union(*cut)
        new = words - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            new = words
        if new:
            self.learn(new)
        known, out = self.known, []
        for ws in cut:
            got = [known[w] for w in ws]
            out.append((sum(n for n, _ in got), math.fsum(s for _, s in got)))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, n_tokens, score)``: how many tokens the unigram tokenizer makes of each text, and the score
    of that cut, without making the tokens.

    Spaces end words, as for the tokenizer, so a word's count is found once and remembered by the worker
    within a bound. No row is shuffled. A null or empty text has 0 tokens; a very long text is counted whole,
    and a very long word piece by piece; equal paths follow the tokenizer's rule; repeated rows are counted each; an empty table gives no rows;
    other columns are not read, and a key named as one that is added comes out with ``_key`` behind its name.
    """
    path = path or piece_file()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = counter(path)
        for batch in batches:
            out: list[tuple[int, float]] = []
            part, size = [], 0
            for one in batch.column(1):
                part.append(one.as_py())
                size += len(part[-1] or "")
                if size > TOGETHER:
                    out += find.counts(part)
                    part, size = [], 0
            out += find.counts(part)
            n, s = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.float64())], ["_k", "n_tokens", "score"])

    out = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(of, f"_k {dict(docs.dtypes)[key]}, n_tokens long, score double")
    return out.withColumnRenamed("_k", key_name(key, ("n_tokens", "score")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
