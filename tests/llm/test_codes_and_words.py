"""Byte pairs, spelling variants and vector codes against brute force."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

SCHEMA = "doc_id long, text string, n long, ids string, word string"


def texts():
    r = random.Random(11)
    long = "".join(r.choice("etaoinéß漢1") for _ in range(30000))
    out = [None, "", " ", "\n\n \t", "it's  we'll", "<|endoftext|>", "aaaaaaa", "é" * 900, long, "=-" * 3000, " " * 5000 + "x", "日本語の文章" * 50, "\x1c\x85　a"]
    return out + ["".join(r.choice("aab bc's\n\t 1é漢.the in") for _ in range(r.randint(1, 90))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 5, "x", "y") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[7], rows[7], (None, "no key", 1, "", "")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    from steelyard.llm.bytepairs import rank_file, read_ranks

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(rank_file()), special_tokens={})


def test_byte_pairs_round_trip(docs, reference):
    from steelyard.llm.bytepairs import decode, encode

    got = decode(encode(docs)).collect()
    assert len(got) == docs.count()
    by_id = dict(enumerate(texts())) | {None: "no key"}
    for row in got:
        assert row.ids == reference.encode_ordinary(by_id[row.doc_id] or "")
        assert bytes(row.bytes) == (by_id[row.doc_id] or "").encode()


def test_byte_pairs_of_all_code_points(reference):
    from steelyard.llm.bytepairs import Encoder, pattern, rank_file, read_ranks

    encoder = Encoder(read_ranks(rank_file()), pattern())
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x30000, 0x110000, 61)]
    some = ["\n".join(f"a{c} 1{c}" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    flat, counts = encoder.texts(some)
    edges = np.concatenate([[0], np.cumsum(counts)])
    flat = np.frombuffer(flat, dtype=np.int32)
    assert flat.tolist() == [i for ids in reference.encode_ordinary_batch(some) for i in ids]
    assert edges[-1] == len(flat)


def test_merges_in_queue_order():
    """Vocabularies in which a merge makes a pair of a lower rank, so the rest of its bucket waits; against the
    plain rule, one word by itself and many together."""
    from steelyard.llm.bytepairs import Encoder

    def plain(ranks, data):
        parts = [data[k : k + 1] for k in range(len(data))]
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(5)
    waited = 0
    for _ in range(300):
        tokens = {"".join(r.choice("abc") for _ in range(r.randint(2, 5))).encode() for _ in range(14)}
        order = r.sample(sorted(tokens), len(tokens))
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(order)}
        encoder = Encoder(ranks, r"(?s).+")
        words = sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 40))).encode() for _ in range(40)} - set(ranks))
        alone = []
        merge = encoder.merge
        encoder.merge = lambda w: alone.append(w) or merge(w)  # noqa: B023
        got = encoder.together(words)
        waited += len(alone)
        for w, ids in zip(words, got, strict=True):
            assert np.frombuffer(ids, dtype=np.int32).tolist() == plain(ranks, w) == merge(w)
    assert waited


def test_rank_queue_gives_least_rank():
    from steelyard.llm.bytepairs import RankQueue

    r, queue, held = random.Random(2), RankQueue(70_000), collections.defaultdict(list)
    assert len(queue.levels) == 3
    for k in range(5000):
        if r.random() < 0.6:
            rank = r.randrange(70_000)
            queue.push(rank, [k])
            held[rank].append(k)
        elif held:
            assert queue.pop() == (min(held), held.pop(min(held)))
    while held:
        assert queue.pop() == (min(held), held.pop(min(held)))
    assert queue.pop() is None


def test_forgetting_changes_nothing(reference, monkeypatch):
    from steelyard.llm import bytepairs

    monkeypatch.setattr(bytepairs, "REMEMBERED", 20)
    encoder = bytepairs.Encoder(bytepairs.read_ranks(bytepairs.rank_file()), bytepairs.pattern())
    for t in texts():
        assert np.frombuffer(encoder.texts([t])[0], dtype=np.int32).tolist() == reference.encode_ordinary(t or "")
    assert all(len(p) <= bytepairs.LONGEST for p in encoder.known)


def test_pieces_by_classes_are_the_pattern_s():
    """Blanks, apostrophes and characters of one to four bytes in any order, in texts that lie one after the other."""
    import pyarrow as pa
    import regex

    from steelyard.llm import texthash
    from steelyard.llm.bytepairs import BY_CLASS, pattern, piece_starts

    assert pattern() == BY_CLASS
    r = random.Random(9)
    parts = [*" \t\n\r\x1c\x85\xa0\u2003\u3000aestmdrvlzSTé中𝒜😀5٣½Ⅷ_.\u0301\u200b\0", *"'" * 4, *" " * 3, "'s", "'re", "'ve", "'ll", "'S", "  "]
    some = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    some += ["a'", "s", " ", "b", "", "x ", "'", "'r", "e", "'l", "\u3000", "y", None]
    data, offsets = texthash.utf8(pa.array(some, pa.large_string()))
    start = piece_starts(data, offsets)
    assert len(piece_starts(data[:0], offsets[:1])) == 0
    got = [data[a:b].tobytes() for a, b in zip(start, np.append(start[1:], len(data)), strict=True)]
    assert got == [p.encode() for t in some for p in regex.findall(BY_CLASS, t or "")]


def test_byte_pairs_cut_by_classes_or_by_another_pattern(reference):
    import tiktoken

    from steelyard.llm.bytepairs import Encoder, pattern, rank_file, read_ranks

    ranks = read_ranks(rank_file())
    encoder = Encoder(ranks, pattern())
    encoder.find = None  # no text goes through the pattern's engine
    flat, counts = encoder.texts(texts())
    assert np.frombuffer(flat, dtype=np.int32).tolist() == [i for t in texts() for i in reference.encode_ordinary(t or "")]
    assert counts == [len(reference.encode_ordinary(t or "")) for t in texts()]
    split = r"\p{L}{1,3}|\s+|[^\s\p{L}]+"
    other = tiktoken.Encoding("other", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    flat, counts = Encoder(ranks, split).texts(texts())
    assert np.frombuffer(flat, dtype=np.int32).tolist() == [i for t in texts() for i in other.encode_ordinary(t or "")]
    assert counts == [len(other.encode_ordinary(t or "")) for t in texts()]


@pytest.mark.parametrize("wrong", [-1, 1 << 20, None])
def test_ids_outside_the_vocabulary_are_errors(spark, wrong):
    from steelyard.llm.bytepairs import decode

    with pytest.raises(Exception, match="out of bounds|is null"):
        decode(spark.createDataFrame([(1, [5, 6]), (2, [7, wrong])], "doc_id long, ids array<int>")).collect()


def test_decoding_with_nulls_between(spark):
    from steelyard.llm.bytepairs import decode, rank_file, read_ranks

    known = {r: t for t, r in read_ranks(rank_file()).items()}
    rows = [(k, None if k % 7 == 3 else [(k * 31 + j * 977) % len(known) for j in range(k % 5)]) for k in range(60)]
    got = {r.doc_id: r for r in decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)).collect()}
    for k, ids in rows:
        assert got[k].ids == ids
        assert got[k].bytes == (None if ids is None else b"".join(known[i] for i in ids))


def test_byte_pairs_of_nothing_and_of_clashing_names(spark, docs):
    from steelyard.llm.bytepairs import decode, encode

    assert decode(encode(docs.limit(0))).count() == 0
    named = docs.select(docs.doc_id.alias("ids"), docs.text.alias("bytes"), docs.n.alias("_k"))
    assert encode(named, key="ids", text="bytes").columns == ["ids_key", "ids"]
    assert encode(named, key="ids", text="bytes").count() == docs.count()
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.bytes for r in decode(nulls).orderBy("doc_id").collect()] == [None, b""]


def neighbours(word, alphabet):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + a + word[k + 1 :] for k in range(len(word)) for a in alphabet}
    out |= {word[:k] + a + word[k:] for k in range(len(word) + 1) for a in alphabet}
    return out - {word}


def grouped(rows):
    import regex

    find, low = regex.compile("[A-Za-zÀ-ÿ]+").findall, str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = collections.Counter()
    for key, text in rows:
        for w in find((text or "").translate(low)):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    alphabet, out = set("".join(n)), {}
    form = {}
    for w, k in n.items():
        near = [v for v in neighbours(w, alphabet) if v in n]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * k else None
        out[w] = [k, len(near), form[w], n[best] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def variant_rows():
    r = random.Random(7)
    rows = [(k, t) for k, t in enumerate([None, "", "12 345", "Übermut übermut ÜBERMUT ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷×", "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + "y"])]
    # chains: each form ten times as frequent as the one that points to it
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb"]
    rows += [(100 + k, " ".join([w] * (2 * 11**k))) for k, w in enumerate(chain)]
    rows += [(200 + k, " ".join([w] * 30 + [w[:-1] + "q"] * 2 + ["Z" + w] * 3)) for k, w in enumerate(["Mississippi", "bookkeeper", "aardvarks", "nananana"])]
    rows += [(300 + k, " ".join("".join(r.choice("aeß") for _ in range(r.randint(6, 8))) for _ in range(60))) for k in range(120)]
    return [*rows, rows[-1], rows[-1], (None, "nothing nothing nothings nothings")]


def test_variants_equal_all_neighbourhoods(spark):
    from steelyard.llm.variants import spelling_groups

    rows = variant_rows()
    df = spark.createDataFrame([(k, t, 1, "x", "y") for k, t in rows], "doc_id long, text string, n long, word string, latin string").repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_groups(df).collect()}
    want = grouped(rows)
    assert got == want
    assert sum(v[1] for v in want.values()) > 100
    assert max(sum(1 for v in want.values() if v[4] == w) for w in want) > 3
    assert any(v[2] and v[4] != v[2] for v in want.values())
    assert spelling_groups(df.limit(0)).count() == 0


def test_variants_with_a_full_filter(spark, monkeypatch):
    """The filter only spares the join: with one word of it, and many words, results are the same."""
    from steelyard.llm import variants

    monkeypatch.setattr(variants, "_filter_size", lambda n: variants.SEGMENT)
    r = random.Random(1)
    rows = [(k, " ".join(["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(2500)] * 2)) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in variants.spelling_groups(df).collect()} == grouped(rows)


def test_neighbourhoods_are_whole_and_distinct():
    from steelyard.llm.texthash import utf8
    from steelyard.llm.variants import Neighbours

    import pyarrow as pa

    words = [b"a", b"aab", b"abab", b"cccc", b"abc" * 40]
    data, offsets = utf8(pa.array(words, pa.binary()))
    made = Neighbours(data, offsets, np.frombuffer(b"abcd", dtype=np.uint8))
    found, number = collections.defaultdict(list), {}
    for kind, word, place, letter, numbers in made.candidates():
        for w, text, h in zip(word.tolist(), made.built(kind, word, place, letter).to_pylist(), numbers.tolist(), strict=True):
            found[words[w]].append(text)
            assert number.setdefault(text, h) == h
    for w in words:
        want = {x.encode() for x in neighbours(w.decode(), "abcd")}
        assert sorted(found[w]) == sorted(want)


def test_variants_equal_their_sql(spark, sf):
    from steelyard.llm.variants import SQL_OP12, op12_variants

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = op12_variants(spark, sf)
    want = con.execute(f"SELECT {','.join(df.columns)} FROM ({SQL_OP12})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int"


def vector_rows(n=700, dim=32):
    r = np.random.default_rng(13)
    rows = [(int(k), np.round(x, 1).tolist(), int(k % 4) if k % 5 else None, "c", 1) for k, x in zip(r.permutation(n), r.normal(0, 0.4, (n, dim)), strict=True)]
    bad = [[None] * dim, [math.nan] * dim, [math.inf] + [0.0] * (dim - 1), [0.5] * (dim - 1) + [None], None]
    return [*rows, rows[3], rows[3], *[(2000 + k, x, 1, "c", 1) for k, x in enumerate(bad)], (-5, [0.25] * dim, 2, "", 0), (None, [0.0] * dim, 1, "", 0)]


def brute_codes(rows):
    kept = [(k, [math.floor(256 * float(np.float32(v))) for v in x], lab) for k, x, lab, *_ in rows if k is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda t: (t[0], t[1]))
    q = np.array([x for _, x, _ in kept]).reshape(len(kept), 16, -1)
    books = q[:64].transpose(1, 0, 2).copy()

    def nearest():
        d = ((q[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2).sum(axis=1)

    for _ in range(2):
        code, _ = nearest()
        for p in range(16):
            for e in range(books.shape[1]):
                mine = q[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    code, error = nearest()
    by_label = collections.Counter()
    for (_, _, lab), e in zip(kept, error.tolist(), strict=True):
        by_label[lab] += e
    return sorted((k, bytes(c.tolist()).hex(), e, by_label[lab]) for (k, _, lab), c, e in zip(kept, code, error.tolist(), strict=True)), books


@pytest.mark.parametrize("n", [700, 40])
def test_codes_equal_a_full_search(spark, tmp_path, n):
    from steelyard.llm.codes import compress, op13_codes, reconstruct

    rows = vector_rows(n)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = brute_codes(rows)
    got = op13_codes(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}
    codes, found = compress(df)
    assert (found == books).all()
    near = {r.vec_id: r.vector for r in reconstruct(codes, found).collect()}
    assert all(np.abs(np.array(near[k]) - np.array(x)).max() < 2 for k, x, *_ in rows if k in near)


def test_code_search_keeps_ties_and_looks_at_few():
    from steelyard.llm.codes import Codebook

    r = np.random.default_rng(3)
    for spread in (2, 40):
        entries = r.integers(-spread, spread, (64, 3))
        x, start = r.integers(-spread, spread, (4000, 3)), r.integers(0, 64, 4000)
        d = ((x[:, None] - entries) ** 2).sum(axis=2)
        index, best = Codebook(entries).nearest(x, start)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        again, _ = Codebook(entries).nearest(x, index)
        assert (again == index).all()


def test_codes_of_nothing_and_of_uneven_vectors(spark):
    from steelyard.llm.codes import compress

    codes, books = compress(spark.createDataFrame([], VECTORS))
    assert books is None and codes.count() == 0 and codes.columns == ["vec_id", "label", "code", "error"]
    same = spark.createDataFrame([(1, [1.0] * 16, None, "", 0)] * 200, VECTORS)
    codes, books = compress(same)
    assert books.shape == (16, 64, 1) and {(r.code.hex(), r.error) for r in codes.collect()} == {("00" * 16, 0)} and codes.count() == 200
    for bad in ([1.0] * 17, []):
        with pytest.raises(ValueError, match="multiple"):
            compress(spark.createDataFrame([(1, bad, 1, "", 0)], VECTORS))
    with pytest.raises(ValueError, match="multiple"):
        compress(spark.createDataFrame([(1, [1.0] * 16, 1, "", 0), (2, [1.0] * 32, 1, "", 0)], VECTORS))


def test_codes_equal_their_sql(spark, sf):
    from steelyard.llm.codes import SQL_OP13, op13_codes

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = op13_codes(spark, sf)
    want = con.execute(f"SELECT {','.join(df.columns)} FROM ({SQL_OP13})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


#: Operators with the columns that each adds.
ADDED = {
    "packing": "start length ids_crc32 doc_tokens sequence_id offset", "tokencount": "n_tokens score", "minhash": "class_id kept", "embeddings": "n_links component_id kept", "suffixes": "n_bytes n_removed n_spans kept_sha256",
    "quality_rules": "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "mixing": "size source_size target taken", "sharding": "size text_crc32 shard slot", "quality_model": "score", "bytepairs": "ids", "codes": "code error",
}


def applied(name, df, key, labels):
    import importlib

    m = importlib.import_module(f"steelyard.llm.{name}")
    if name == "quality_model":
        return m.score(df, m.train(labels.select("doc_id", "text"), labels.select("doc_id", "quality")))
    if name == "quality_rules":
        return m.cascade(df)
    f = {"packing": "pack", "tokencount": "count_tokens", "minhash": "near_duplicates", "embeddings": "near_vectors", "suffixes": "repeated_bytes", "mixing": "mix", "sharding": "shard", "bytepairs": "encode", "codes": "compress"}[name]
    if name == "sharding":
        return m.shard(df, 3, key=key)
    out = getattr(m, f)(df, key=key)
    return out[0] if name == "codes" else out


@pytest.mark.parametrize("name", sorted(ADDED))
@pytest.mark.parametrize("upper", [False, True])
def test_names_that_clash_and_repeated_rows(spark, name, upper):
    """A key named as a column that is added, in either case, and other columns of such names, with repeated rows."""
    added = ADDED[name].split()
    key = added[0].upper() if upper else added[0]
    others = [c.upper() if upper else c for c in added[1:]]
    rows = [(k, f"{k} some words of a text number {k} that goes on for a while so that it has more than twenty words in all, {k} and {k + 1} and so on", "s", [float(k)] * 16, 1, *("x" for _ in others)) for k in range(30)]
    fields = ", ".join(f"`{c}` string" for c in others)
    df = spark.createDataFrame([*rows, rows[0], rows[0]], f"`{key}` long, text string, source string, embedding array<float>, label int" + (f", {fields}" if fields else ""))
    labels = spark.createDataFrame([(k, ("good text here " if k % 2 else "bad thing there ") * 9, k % 2) for k in range(60)], "doc_id long, text string, quality int")
    out = applied(name, df, key, labels)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert {c.lower() for c in added} <= {c.lower() for c in out.columns}
    found = out.collect()
    assert len(found) >= 32
    if name not in ("quality_model", "quality_rules", "mixing"):
        named = next(c for c in out.columns if c.lower() == f"{key}_key".lower())
        assert {r[named] for r in found} == set(range(30))


def test_no_silent_demonstration_key_on_a_cluster():
    from types import SimpleNamespace

    from steelyard.llm.pii import DEMO_KEY, KEY_SETTING, secret_key

    session = lambda master, **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get("key", d) if k == KEY_SETTING else d), sparkContext=SimpleNamespace(master=master))
    assert secret_key(session("local[4]")) == DEMO_KEY and secret_key(session("yarn", key="own")) == "own"
    with pytest.raises(ValueError, match="unset"):
        secret_key(session("yarn"))
