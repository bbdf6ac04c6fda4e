"""Operator 11: byte-level BPE by a queue of merge ranks under a hierarchical bitmap, and its decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm import texthash
from steelyard.llm.common import key_name, table

#: Pre-tokens that a worker remembers, and the longest of them in bytes; then it keeps those of the texts at hand.
REMEMBERED, LONGEST = 1 << 19, 64
#: Texts that are encoded together, in bytes.
TOGETHER = 1 << 22
#: The pattern whose matches :func:`piece_starts` finds by classes of characters; any other goes by ``regex``.
BY_CLASS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, BLANK, OTHER = range(4)
#: Bits of one word of the bitmap.
FAN = 256


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, which are their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Each code point's class, as the pattern's engine has it."""
    import regex

    points = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.full(len(points), OTHER, dtype=np.uint8)
    for kind, named in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for run in regex.finditer(named, points):
            out[run.start() : run.end()] = kind
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the class of its character."""
    known = classes()
    out = known[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        point = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for more in range(1, 4):
            some = size > more
            point[some] = point[some] << 6 | data[lead[some] + more] & 0x3F
        kind = known[point]
        for more in range(4):
            some = size > more
            out[lead[some] + more] = kind[some]
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of BY_CLASS begin in texts that lie one after the other; each byte is in one of them.

    Characters of one class stay together. A blank before others is apart from the blanks before it, and a
    space there begins what follows it. An apostrophe that begins a match takes the letters of a short form.
    """
    kind = byte_classes(data)
    start = np.ones(len(data) + 4, dtype=bool)
    start[1 : len(data)] = kind[1:] != kind[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    inner = start[: len(data)].copy()
    inner[heads] = False
    start[heads] = True
    after = np.flatnonzero(inner[1:] & (kind[:-1] == BLANK)) + 1
    last = after - 1
    for _ in range(2):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[after[data[last] == 0x20]] = False
    mark = np.flatnonzero((data == 0x27) & start[: len(data)])
    end = offsets[np.searchsorted(offsets, mark, side="right")]
    wide = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
    one, two = np.where(mark + 1 < end, wide[mark + 1], 0), np.where(mark + 2 < end, wide[mark + 2], 0)
    short = mark[np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))]
    long = mark[(((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]
    start[short + 1], start[long + 1] = False, False
    start[short + 2], start[long + 3] = True, True
    return np.flatnonzero(start[: len(data)])


class RankQueue:
    """Positions by merge rank. A bit for each rank with positions, a bit for each word of those bits with one
    set, and so on up to one word, so the least rank is found by a find-first-set on each level."""

    def __init__(self, ranks: int):
        self.levels = []
        while not self.levels or ranks > 1:
            ranks = -(-ranks // FAN)
            self.levels.append([0] * ranks)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        for words in self.levels:
            rank, bit = divmod(rank, FAN)
            was = words[rank]
            words[rank] = was | 1 << bit
            if was:
                return

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Queue arrays of positions, one for each rank."""
        order = np.argsort(ranks.astype(np.uint16) if len(self.levels[0]) * FAN <= 1 << 16 else ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1], [True]])).tolist() if len(ranks) else []
        for rank, a, b in zip(ranks[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
            self.push(rank, [positions[a:b]])

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank, with its bucket."""
        top = self.levels[-1][0]
        if not top:
            return None
        rank = (top & -top).bit_length() - 1
        for words in self.levels[-2::-1]:
            word = words[rank]
            rank = rank * FAN + (word & -word).bit_length() - 1
        at = rank
        for words in self.levels:
            at, bit = divmod(at, FAN)
            words[at] ^= 1 << bit
            if words[at]:
                break
        return rank, self.buckets.pop(rank)


class Encoder:
    """Ids of texts by the ranks of a vocabulary: each match of the pattern by itself, the pair of least rank
    merged first, of equal ones the leftmost."""

    def __init__(self, ranks: dict[bytes, int], split: str):
        import regex

        self.ranks, self.split, self.find = ranks, split, regex.compile(split).findall
        self.size = max(ranks.values()) + 1
        self.queue = RankQueue(self.size)
        self.known: dict[bytes, bytes] = {}
        self.bytes = np.array([ranks.get(bytes([b]), self.size) for b in range(256)], dtype=np.int32)
        pairs = {ranks[t[:k]] * (self.size + 1) + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        # open addressing: a pair lies at its hash or, where others do, behind them
        self.shift = np.uint64(64 - max(4 * len(pairs), 2).bit_length())
        self.slots = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.merged = np.full(len(self.slots), -1, dtype=np.int32)
        todo, rank = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32)
        at = self.slot(todo)
        while len(todo):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]], self.merged[at[free]] = todo[free], rank[free]
            left = np.flatnonzero(self.slots[at] != todo)
            at, todo, rank = (at[left] + 1) % len(self.slots), todo[left], rank[left]
        self.two = self.look(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token. Its pieces are a linked list, named by their first byte; a position of the
        queue is stale if the pair that begins there has another rank by now."""
        n, ranks, queue = len(data), self.ranks, self.queue
        before, after, pair = list(range(-1, n - 1)), list(range(1, n + 1)), [-1] * n

        def look(at: int) -> int:
            """Queue the pair at a place, and its rank, or one past all ranks."""
            rank = ranks.get(data[at : after[after[at]]], -1) if after[at] < n else -1
            pair[at] = rank
            if rank < 0:
                return self.size
            queue.push(rank, [at])
            return rank

        for at in range(n):
            look(at)
        while (least := queue.pop()) is not None:
            rank, bucket = least
            bucket.sort()
            for k, at in enumerate(bucket):
                if pair[at] != rank:
                    continue
                gone = after[at]
                end = after[at] = after[gone]
                pair[gone] = -1
                if end < n:
                    before[end] = at
                new = look(at)
                if before[at] >= 0:
                    new = min(new, look(before[at]))
                if new < rank:  # it goes before the rest of the bucket
                    if bucket[k + 1 :]:
                        queue.push(rank, bucket[k + 1 :])
                    break
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : after[at]]])
            at = after[at]
        return out

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, -1 without one."""
        key = left.astype(np.int64) * (self.size + 1) + right
        at = self.slot(key)
        found, out = self.slots[at], self.merged[at]
        other = np.flatnonzero(found != key)
        while len(other):
            out[other] = -1
            other = other[found[other] >= 0]
            at[other] = (at[other] + 1) % len(self.slots)
            found[other], out[other] = self.slots[at[other]], self.merged[at[other]]
            other = other[found[other] != key[other]]
        return out

    def together(self, words: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens, in four bytes each: one linked list with a border between two of them and one queue, so a
        bucket is merged at once in all of them. Where a merge makes a pair of a lower rank than its own, the
        rest of the bucket would have to wait, so such a pre-token is merged by itself."""
        lengths = np.array([len(w) for w in words])
        first = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
        border = self.size
        data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", dtype=np.uint8)
        ids = self.bytes[data]
        edge = first - 1
        ids[edge] = border
        n, queue, alone = len(ids), self.queue, set()
        before, after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        pair = self.two[np.append(data[:-1].astype(np.uint16) << 8 | data[1:], np.uint16(0))]
        pair[edge], pair[edge[1:] - 1] = -1, -1  # none across a border
        at = np.flatnonzero(pair >= 0)
        queue.push_all(pair[at], at)
        while (least := queue.pop()) is not None:
            rank, bucket = least
            at = np.concatenate(bucket)
            at = at[pair[at] == rank]
            if len(at) > 1:
                at.sort()
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                follows = after[at[:-1]] == at[1:]
                if follows.any():  # of pairs that share a piece every second one, from the left
                    start = np.concatenate([[True], ~follows])
                    run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            # what a merge would make with the next pair's first piece, before that pair is merged
            next_to = np.flatnonzero(end[:-1] == at[1:])
            between = self.look(np.full(len(next_to), rank), ids[end[next_to]])
            low = at[next_to[(between >= 0) & (between < rank)]]
            after[at], before[end], ids[at], ids[gone], pair[gone] = end, at, rank, -1, -1
            left = before[at]
            places = np.concatenate([at, left[ids[left] != border]])
            new = self.look(ids[places], ids[after[places]])
            pair[places] = new
            places, new = places[new >= 0], new[new >= 0]
            low = np.concatenate([low, places[new < rank]])
            if len(low):
                alone.update((np.searchsorted(first, low, side="right") - 1).tolist())
            queue.push_all(new, places)
        live = np.flatnonzero((ids >= 0) & (ids != border))
        edges, flat = (np.searchsorted(live, first) * 4).tolist(), ids[live].astype(np.int32).tobytes()
        return [np.array(self.merge(w), dtype=np.int32).tobytes() if k in alone else flat[edges[k] : edges[k + 1]] for k, w in enumerate(words)]

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of texts one after the other, and each text's first (n + 1)."""
        if self.split == BY_CLASS:
            start = piece_starts(data, offsets)
            ends = pa.py_buffer(np.append(start, len(data)))
            return pa.Array.from_buffers(pa.large_binary(), len(start), [None, ends, pa.py_buffer(data)]), np.searchsorted(start, offsets)
        cut = [self.find(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.array([p.encode() for own in cut for p in own], pa.large_binary()), np.cumsum([0, *map(len, cut)])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other and each text's first (n + 1); pre-tokens that are new are
        merged together."""
        pieces, edges = self.cut(data, offsets)
        coded = pieces.dictionary_encode()
        own, known = coded.dictionary.to_pylist(), self.known
        new = [p for p in own if p not in known]
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {p: known[p] for p in own if p in known}
        known.update((p, self.ranks[p].to_bytes(4, "little")) for p in new if p in self.ranks)
        new = [p for p in new if p not in self.ranks]
        if new:
            known.update(zip(new, self.together(new), strict=True))
        flat, ends = texthash.utf8(pa.array([known[p] for p in own], pa.large_binary()).take(coded.indices))
        for piece in [p for p in new if len(p) > LONGEST]:
            del known[piece]
        return flat.view("<i4"), ends[edges] // 4

    def texts(self, texts: list[str | None]) -> tuple[bytes, list[int]]:
        """The ids of texts one after the other, in four bytes each, and how many each has."""
        flat, edges = self.ids(*texthash.utf8(pa.array(texts, pa.large_string())))
        return flat.tobytes(), np.diff(edges).tolist()


@lru_cache(maxsize=2)
def encoder(path: str, split: str) -> Encoder:
    return Encoder(read_ranks(path), split)


@lru_cache(maxsize=2)
def tokens(path: str) -> pa.Array:
    """Each id's bytes; ids that the vocabulary leaves free are empty."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, split: str | None = None) -> DataFrame:
    """``(key, ids)``: the ids of each whole text by the ranks in the file at ``path``, without special tokens.

    A text is cut by the pattern ``split``, that of the public files by classes of characters, and each match is encoded by itself: pairs wait in one bucket for
    each rank, a bitmap over the buckets gives the least rank, and a pre-token of n bytes takes about n steps
    however long it is. Workers remember short pre-tokens within a bound. No row is shuffled.

    A null or empty text has no ids; special tokens in a text are ordinary text; equal ranks merge from the
    left; repeated rows are encoded each; an empty table gives no rows; other columns are not read, and a
    key named as one that is added comes out with ``_key`` behind its name.
    """
    path, split = path or rank_file(), split or pattern()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = encoder(path, split)
        for batch in batches:
            batch.column(1).validate(full=True)
            data, offsets = texthash.utf8(batch.column(1))
            for a, b in texthash.chunks(offsets, TOGETHER):
                flat, edges = find.ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["_k", "ids"])

    out = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(of, f"_k {dict(docs.dtypes)[key]}, ids array<int>")
    return out.select(F.col("_k").alias(key_name(key, ("ids",))), "ids")


def decode(encoded: DataFrame, *, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``(key, ids, bytes)``: the ids with the bytes that they stand for, null for null. An id that is not in the
    vocabulary is an error."""
    path = path or rank_file()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(path)
        for batch in batches:
            own = batch.column(1)
            flat, edges = own.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(own), 0).to_numpy(), dtype=np.int64)])
            if flat.null_count:
                raise ValueError("an id is null")
            for a, b in texthash.chunks(edges, TOGETHER // 8):
                data, ends = texthash.utf8(known.take(flat.slice(edges[a], edges[b] - edges[a])))
                ends = pa.py_buffer(ends[edges[a : b + 1] - edges[a]].astype(np.int32))
                out = pa.Array.from_buffers(pa.binary(), b - a, [None, ends, pa.py_buffer(data)])
                out = pc.if_else(own.slice(a, b - a).is_valid(), out, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 1)), out], ["_k", "_i", "bytes"])

    kinds = dict(encoded.dtypes)
    out = encoded.select(F.col(key).alias("_k"), F.col(ids).alias("_i")).mapInArrow(of, f"_k {kinds[key]}, _i {kinds[ids]}, bytes binary")
    return out.select(F.col("_k").alias(key_name(key, (ids, "bytes"))), F.col("_i").alias(ids), "bytes")


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text of ``documents``, as counts and digests."""
    both = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
