"""Each corpus operator against brute force, on texts with every edge case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, _md5 string, score double, kept boolean"


def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeñ漢") for _ in range(r.randint(1, 9))) for _ in range(400)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = make(120), make(110)
    out = [None, "", " \t\n ", "one", "one two", "é" * 700, "se " * 300, base, base, base, passage * 40, make(5000)]
    for _ in range(6):
        ws = base.split(" ")
        ws[r.randrange(len(ws))] = "changed%d" % r.randrange(99)
        out.append(" ".join(ws))
    out += [make(30) + "\n" + passage + "\n" + make(30) for _ in range(5)]
    out += [make(r.randint(1, 200)) for _ in range(40)]
    out += ["SHOUT!! LOUD!! " * 20 + make(3), "a$$$ b### c%%% " * 9]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, 5, 1, "x", 0.1, False) for i, t in enumerate(texts())]
    return [*out, out[7], out[7], (None, "no key", "en", "s1", 1, 1, 1, "", 0.0, True)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def keyed(docs):
    return docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_round_trip(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from steelyard.llm.packing import CAPACITY, pack

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pack(docs).collect()
    left = collections.Counter()
    for row in rows:
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        left[row[0], len(ids)] += len(ids)
        for p in pieces:
            if p.doc_id == row[0] and p.doc_tokens == len(ids):
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for p in pieces:
        left[p.doc_id, p.doc_tokens] -= p.length
    assert not any(left.values())
    for own in sequences(pieces).values():
        assert sum(p.length for p in own) <= CAPACITY
    assert pack(none).count() == 0


def sequences(pieces):
    out = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sum(x.length for x in out[p.sequence_id])
        out[p.sequence_id].append(p)
    return out


def test_ids_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    from steelyard.llm.packing import bpe_file, encoder

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder(bpe_file())
    for low in range(0, 0x110000, 512):
        text = "".join(f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(low, low + 512) if not 0xD800 <= c < 0xE000)
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext|"):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_packing_pads_little_and_not_at_a_power_of_two(spark):
    from steelyard.llm.packing import CAPACITY, pack

    r = random.Random(6)
    rows = [(i, " ".join(r.choice(("ab", "cd", "ef")) for _ in range(r.choice((3, 40, 300, 900, 1500, 2500))))) for i in range(400)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    filled = [sum(p.length for p in own) for own in sequences(pieces).values()]
    padding = sum(CAPACITY - n for n in filled if n & (n - 1))
    assert all(0 < n <= CAPACITY for n in filled) and padding <= 0.02 * sum(filled)
    # what rounding leaves over is cut at powers of two, so one document alone needs no padding either
    for n in (1, 5, 700, 2047, 2048, 5000):
        one = pack(spark.createDataFrame([(7, " a" * (n - 1))], "doc_id long, text string")).collect()
        assert sum(p.length for p in one) == n
        assert all(m & (m - 1) == 0 or CAPACITY - m < 8 for m in (sum(p.length for p in own) for own in sequences(one).values()))


@pytest.mark.parametrize("key", ["length", "_class", "text_hash", "_key"])
def test_packing_takes_a_key_of_any_name(docs, key):
    from steelyard.llm.packing import pack

    out = pack(docs.withColumnRenamed("doc_id", key), key=key)
    assert out.columns[0] == ("length_key" if key == "length" else key)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, pack(docs).collect()), key=str)


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 1_200_000, "\u3000\r\n" * 400_000])
def test_long_runs_of_white_space_are_encoded(spark, run):
    import public_tokenizers
    from tokenizers import Tokenizer

    from steelyard.llm.packing import bpe_file, encoder, pack

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder(bpe_file())
    for text in (run, f"one{run}two <s>", run[:99_999], f"x{run[:100_000]}y"):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    pieces = pack(spark.createDataFrame([(1, f"one{run}two"), (2, "short")], "doc_id long, text string")).collect()
    for key, text in ((1, f"one{run}two"), (2, "short")):
        assert sum(p.length for p in pieces if p.doc_id == key) == len(tokenizer.encode(text, add_special_tokens=False).ids) + 1


def test_plan_covers_no_more_than_there_is():
    from steelyard.llm.packing import plan

    r = random.Random(1)
    demand = {k: r.randint(0, 400) for k in range(1, 33)}
    used = collections.Counter()
    patterns = plan(demand, 64)
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 64 and times > 0
        for k, n in pattern.items():
            used[k] += n * times
    assert all(used[k] <= demand[k] for k in demand)
    rest = sum(k * (demand[k] - used[k]) for k in demand)
    assert sum(t for _, t in patterns) * 64 + rest <= 1.01 * sum(k * n for k, n in demand.items())
    assert plan({}, 64) == []


def test_token_counts_equal_the_unigram_tokenizer(docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from steelyard.llm.tokencount import Counter, count_tokens, piece_file, vocabulary

    vocab = vocabulary(piece_file())
    tokenizer = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = collections.Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.select("doc_id", "text").collect())
    assert collections.Counter((r.doc_id, r.n_tokens) for r in count_tokens(docs).collect()) == want
    assert count_tokens(none).count() == 0
    # ties: equal scores everywhere
    flat = [("<unk>", -1.0), ("▁", -1.0), *((p, -1.0) for p in ("a", "b", "ab", "ba", "aba", "bb", "▁a", "▁ab"))]
    tie = Tokenizer(models.Unigram(flat, unk_id=0, byte_fallback=False))
    tie.pre_tokenizer = tokenizer.pre_tokenizer
    r = random.Random(2)
    some = ["".join(r.choice("ab ") for _ in range(r.randint(0, 30))) for _ in range(300)]
    assert [n for n, _ in Counter(flat).counts(some)] == [len(tie.encode(t, add_special_tokens=False).ids) for t in some]


def shingles(text):
    ws = WORD.findall(text or "")
    return collections.Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else collections.Counter()


def near_classes(rows):
    """Classes by brute force: (key, text) to the smallest key reached."""
    from steelyard.llm.minhash import IDF_GAIN

    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1]) for r in rows]
    df = collections.Counter(k for s in sets for k in s)
    step = math.log(max(len(rows), 2)) / 255
    idf = {k: 1 + IDF_GAIN * (1 - (0 if n == 1 else max(1, min(255, round(math.log(n) / step)))) / 255) for k, n in df.items()}
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            common = sum(min(n, sets[j][k]) * idf[k] for k, n in sets[i].items())
            total = sum(n * idf[k] for s in (sets[i], sets[j]) for k, n in s.items()) - common
            if (rows[i][1] or "") == (rows[j][1] or "") or total and common / total >= 0.8:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((rows[i][0], min(groups[find(i)])) for i in range(len(rows)))


def test_near_duplicates(docs, rows, none):
    from steelyard.llm.minhash import keep_one, near_duplicates

    got = near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == near_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in near_classes(rows)})
    assert near_duplicates(none).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    from steelyard.llm import minhash

    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "CHUNK", 8)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        ws = list(base)
        for _ in range(i % 12):
            ws[r.randrange(len(ws))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.class_id) for x in got) == near_classes(rows)


def test_counts_by_groups_of_blocks(docs, rows, monkeypatch):
    from steelyard.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "TOGETHER", 3)
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == near_classes(rows)


def test_recall_by_similarity(spark):
    """Pairs of 300 words with k of them changed: all from the threshold on are found, none below it."""
    from steelyard.llm.minhash import near_duplicates

    r = random.Random(8)
    rows, found = [], collections.Counter()
    for i in range(600):
        ws = [f"w{r.randrange(10**7)}" for _ in range(300)]
        other = list(ws)
        for at in r.sample(range(300), i % 12):
            other[at] = f"x{r.randrange(10**7)}"
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(other))]
    want = collections.Counter(dict(near_classes_of_pairs(rows)))
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[b] == b or got[b] == b - 1 for b in range(1, 1200, 2))
    table = collections.defaultdict(lambda: [0, 0])
    for b, similarity in want.items():
        table[math.floor(similarity * 20) / 20][0] += 1
        table[math.floor(similarity * 20) / 20][1] += got[b] == b - 1
        found[similarity >= 0.8, got[b] == b - 1] += 1
    print({f"{k:.2f}": tuple(v) for k, v in sorted(table.items())})
    assert found[True, False] == 0 and found[False, True] == 0 and found[True, True] > 200


def near_classes_of_pairs(rows):
    """(second key, weighted similarity) of rows 2 i and 2 i + 1, which share shingles with no others."""
    from steelyard.llm.minhash import IDF_GAIN

    one, two = 1 + IDF_GAIN, 1 + IDF_GAIN * (1 - max(1, round(math.log(2) / (math.log(len(rows)) / 255))) / 255)
    for (_, x), (b, y) in zip(rows[::2], rows[1::2], strict=True):
        common = len(set(shingles(x)) & set(shingles(y)))
        apart = len(set(shingles(x)) ^ set(shingles(y)))
        yield b, common * two / (common * two + apart * one)


def test_samples_collide_by_weighted_jaccard():
    from steelyard.llm.minhash import samples, weighted_jaccard

    r = np.random.default_rng(1)
    h = np.sort(r.integers(0, 2**63, 400, dtype=np.uint64))
    w = r.choice([1.0, 1.2, 1.5], 400).astype(np.float32)
    want = weighted_jaccard(h[:300], w[:300], h[60:], w[60:])
    s = samples(np.concatenate([h[:300], h[60:]]), np.concatenate([w[:300], w[60:]]), np.array([0, 300, 640]), 3000, 9)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


@pytest.mark.parametrize("dim", [1, 4, 8])
def test_cells_of_a_vector_have_names_of_their_own(dim):
    from steelyard.llm.embeddings import _cells, _name

    steps = np.indices((2,) * dim).reshape(dim, -1).T
    for base in np.random.default_rng(dim).integers(-5000, 5000, (20, dim)):
        assert len(np.unique(_name(base + steps))) == len(steps)
    z = np.random.default_rng(6).uniform(-4, 4, (40, dim))
    home, guests = _cells(z)
    near = {(i, *c) for rows, cells in guests for i, c in zip(rows.tolist(), cells.tolist(), strict=True)}
    assert all((i, *c) in near for i, c in enumerate(home.tolist()))
    # whoever is within the ball is at home in a cell that it reaches
    turn = np.random.default_rng(7).standard_normal((40, 50, dim))
    others = z[:, None] + 0.4999 * turn / np.linalg.norm(turn, axis=2, keepdims=True)
    assert all((i, *c) in near for i in range(40) for c in np.floor(others[i]).tolist())


@pytest.mark.parametrize(("dim", "few"), [(16, 10_000), (64, 1)])
def test_vectors(spark, monkeypatch, dim, few):
    from steelyard.llm import embeddings
    from steelyard.llm.embeddings import near_vectors

    monkeypatch.setattr(embeddings, "FEW", few)  # few: a grid of more coordinates

    r = np.random.default_rng(4)
    base = r.standard_normal((12, dim))
    vectors = [(i, [float(v) for v in base[i % 12] * (1 + i) + 0.05 * i / 60 * r.standard_normal(dim) * (1 + i)], i % 2 if i % 5 else 0) for i in range(60)]
    vectors += [(60, None, 0), (61, [0.0] * dim, 0), (62, [float("nan")] * dim, 0), (63, [None] * dim, 0), (64, [1.0, float("inf")], 0), (65, [], 1), (66, vectors[3][1], None), (67, vectors[3][1], vectors[3][2]), (68, vectors[3][1], vectors[3][2]), (69, [1.0, 2.0], 1), (70, [2.0, 4.0], 1), (71, [1e-300, 2e-300], 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS n_links", "1 AS component_id", "true AS kept", "2 AS m", "3 AS id", "4 AS _d")
    ok = {i: (np.array(v), lab) for i, v, lab in vectors if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, (v, _) in ok.items()}
    links = {i: {j for j in ok if j != i and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and unit[i] @ unit[j] >= 0.98} for i in ok}
    for x in near_vectors(df).collect():
        reach, todo = {x.vec_id}, [x.vec_id]
        while todo:
            todo += [j for j in links.get(todo.pop(), ()) if j not in reach and not reach.add(j)]
        assert (x.n_links, x.component_id, x.kept) == (len(links.get(x.vec_id, ())), min(reach), x.vec_id == min(reach)), x
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("length", "token"), [(400, 100), (40, 10)])
def test_repeated_bytes(docs, rows, none, length, token):
    from steelyard.llm.suffixes import repeated_bytes

    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    want = []
    for key, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((key, len(b), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    got = [tuple(r) for r in repeated_bytes(docs, length=length, token=token).collect()]
    order = lambda x: (x[0] is None, x)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert repeated_bytes(none).count() == 0


def test_repeated_bytes_counts_bytes_not_words(spark):
    """Passages of 51 to 80 words in two texts each: those of 400 bytes go, shorter ones stay, other texts too."""
    from steelyard.llm.suffixes import repeated_bytes

    r = np.random.default_rng(8)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, n)) for n in r.integers(2, 10, 500)]
    prose = lambda n: " ".join(words[i] for i in r.integers(0, len(words), n))
    passages = [prose(n) for n in (*range(51, 81), 51, 51)]
    passages[-2], passages[-1] = (passages[-2] + "x" * 400)[:399], (passages[-1] + "x" * 400)[:400]
    texts = [prose(70) + before + p + after + prose(70) for p in passages for before, after in (("\n", "\t"), (";", ":"))]
    rows = [*enumerate(texts), *((1000 + i, prose(150)) for i in range(20))]
    got = {x.doc_id: x for x in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {len(p) < 400 for p in passages[:-2]} == {True, False}
    for i, text in rows:
        part = passages[i // 2] if i < len(texts) and len(passages[i // 2]) >= 400 else ""
        left = text.replace(part, "", 1)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(text), len(part), int(part != "")), i
        assert got[i].kept_sha256 == hashlib.sha256(left.encode()).hexdigest()


def test_multikey_order():
    from steelyard.llm.suffixes import multikey_order

    r = np.random.default_rng(2)
    keys = [r.integers(0, 5, 300) for _ in range(3)]
    assert [tuple(k[i] for k in keys) for i in multikey_order(*keys)] == sorted(zip(*keys, strict=True))


def test_quality_rules(docs, none):
    from steelyard.llm.quality_rules import cascade, failures

    for r in cascade(docs).collect():
        ws = WORD.findall(r.text or "")
        windows = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        hit = {i + k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(ws) < 20 or 100 * len(hit) > 30 * len(ws))
        assert not (r.base_failed and r.kept)
    assert cascade(none).count() == 0
    for r in failures(cascade(docs)).collect():
        assert r.kept == (not r.failed_rules) and r.base_failed == ("base" in r.failed_rules)


def test_cascade_order_changes_no_verdict(docs):
    from steelyard.llm.quality_rules import RULES, cascade

    one = {(r.doc_id, r.text): r.kept for r in cascade(docs).collect()}
    other = cascade(docs, dict(reversed(RULES.items())), rows=5, seed=1).collect()
    assert {(r.doc_id, r.text): r.kept for r in other} == one


KEY = "a key of tests"


def plain_feistel(x, a, b, key, kind):
    """The network on halves modulo a and b, in plain integers."""
    left, right = divmod(x, b)
    for i in range(1, 9):
        if i % 2:
            left = (left + int(hashlib.sha256(f"{key}|{kind}|{i}|{right}|{a}".encode()).hexdigest()[:15], 16) % a) % a
        else:
            right = (right + int(hashlib.sha256(f"{key}|{kind}|{i}|{left}|{b}".encode()).hexdigest()[:15], 16) % b) % b
    return left * b + right


def plain_pseudonym(value, key):
    """A card, address, number or ISO date by plain integers."""
    import datetime

    if "-" in value and len(value) == 10:
        first = datetime.date(1800, 1, 1)
        return (first + datetime.timedelta(plain_feistel((datetime.date.fromisoformat(value) - first).days, 773, 189, key, "date"))).isoformat()
    if "-" in value:
        a, g, s = map(int, value.split("-"))
        y = plain_feistel(((a - 2 if a > 666 else a - 1) * 99 + g - 1) * 9999 + s - 1, 897 * 99, 9999, key, "ssn")
        a = y // 9999 // 99
        return f"{a + 2 if a >= 665 else a + 1:03}-{y // 9999 % 99 + 1:02}-{y % 9999 + 1:04}"
    if "." in value:
        y = plain_feistel(int.from_bytes(map(int, value.split(".")), "big"), 65536, 65536, key, "ip")
        return ".".join(map(str, y.to_bytes(4, "big")))
    body = value[:-1]
    low = len(body) // 2
    new = str(plain_feistel(int(body), 10 ** (len(body) - low), 10**low, key, "card")).zfill(len(body))
    luhn = lambda d: (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    return next(new + str(c) for c in range(10) if luhn([int(x) for x in new + str(c)][::-1]))


def test_pseudonyms_against_plain_integers(spark):
    from steelyard.llm.pii import pseudonymize

    r = random.Random(4)
    values = ["4111111111111111", "378282246310005", "123-45-6789", "899-99-9999", "001-01-0001", "0.0.0.0", "255.255.255.255", "1800-01-01", "2199-12-31", "2024-02-29"]
    values += [".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(40)] + [f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}" for _ in range(40)]
    gap = ["x", "(", " and ", "\n", "é "]
    texts = [(i, "".join(f"{r.choice(gap)} {v}, " for v in r.choices(values, k=i % 7))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "word " * 100_000 + values[0]), (63, f" {values[2]}"), (63, f" {values[2]}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    any_value = re.compile("|".join(sorted(map(re.escape, values), key=len, reverse=True)))
    plain = lambda t: t if t is None else any_value.sub(lambda m: plain_pseudonym(m[0], KEY), t)
    got = collections.Counter((x.doc_id, x.text, x.n_replaced) for x in pseudonymize(df, key=KEY).collect())
    assert got == collections.Counter((i, plain(t), len(any_value.findall(t or ""))) for i, t in texts)
    assert pseudonymize(df.limit(0), key=KEY).count() == 0
    assert pseudonymize(df, key="another").where("doc_id = 63").first().text != pseudonymize(df, key=KEY).where("doc_id = 63").first().text


CASES = [
    "mail ann.b@mail.example.org twice ann.b@mail.example.org", "card 4111 1111 1111 1111 ok", "card 4111111111111112 not",
    "born 1999-02-28, 2024-02-30 is none, 31/12/1999 and 01.01.2000", "ssn 123-45-6789 but 000-45-6789 not", "ip 10.1.2.3 and 300.1.1.1",
    "iban DE89370400440532013000 bad DE89370400440532013001", "call +49 30 1234567 or (555) 123-4567", "key 0123456789abcdef0123456789abcdef", "plain 12 345 text", None, "",
]


def test_pseudonyms(spark):
    from steelyard.llm.pii import pseudonymize

    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, n_replaced string")
    out = {r.doc_id: r for r in pseudonymize(df, key=KEY).collect()}
    again = {r.doc_id: r for r in pseudonymize(df.repartition(5), key=KEY).collect()}
    assert {k: r.text for k, r in out.items()} == {k: r.text for k, r in again.items()}
    assert [out[i].n_replaced for i in range(len(CASES))] == [2, 1, 0, 3, 1, 1, 1, 2, 1, 0, 0, 0]
    first, second = re.findall(r"\S+@\S+", out[0].text)
    assert first == second != "ann.b@mail.example.org"
    assert re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4} ok", out[1].text) and out[1].text != CASES[1]
    digits = [int(c) for c in re.sub(r"\D", "", out[1].text)][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert "2024-02-30" in out[3].text and "000-45-6789" in out[4].text and "300.1.1.1" in out[5].text
    assert out[9].text == CASES[9] and out[10].text is None and out[11].text == ""


def test_pseudonyms_of_other_spellings(spark):
    import datetime

    from steelyard.llm.pii import pseudonymize

    ibans = ["DE89 3704 0044 0532 0130 00", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947", "GB29 NWBK 6016 1331 9268 19", "FR14 2004 1010 0505 0001 3M02 606"]
    phones = ["555 123 4567", "01 23 45 67 89", "020 7946 0958", "0171 234 5678"]
    dates = ["12/25/1990", "12.25.1990", "5/3/1990", "5.3.1990", "5/25/1990", "1990-5-3"]
    values = [*ibans, *phones, *dates]
    df = spark.createDataFrame([(i, f"see {v} EUR, {v}.") for i, v in enumerate(values)], "doc_id long, text string")
    for r in pseudonymize(df, key=KEY).collect():
        was, found = values[r.doc_id], re.fullmatch(r"see (.+) EUR, (.+)\.", r.text)
        assert r.n_replaced == 2 and found[1] == found[2] != was, (was, r.text)
        if was in dates:
            p = [int(x) for x in re.split("[-/.]", found[1])]
            datetime.date(*p) if "-" in was else datetime.date(p[2], p[0], p[1]) if "25" in was else datetime.date(p[2], p[1], p[0])
            assert "25" not in was or p[1] > 12
        else:
            assert re.sub("[0-9]", "0", found[1]) == re.sub("[0-9]", "0", was)
        if was in ibans:
            x = found[1].replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    # no two dates get one pseudonym, whichever way they are written
    span = [datetime.date(1996, 1, 1) + datetime.timedelta(i) for i in range(1500)] + [datetime.date(1800, 1, 13), datetime.date(2199, 12, 31)]
    spelt = [f"{d:%d/%m/%Y}" for d in span] + [f"{d:%m/%d/%Y}" for d in span if d.day > 12]
    out = [r.text for r in pseudonymize(spark.createDataFrame([(i, t) for i, t in enumerate(spelt)], "doc_id long, text string"), key=KEY).collect()]
    assert len(set(out)) == len(spelt) and all(re.fullmatch("[0-9]{2}/[0-9]{2}/[0-9]{4}", x) for x in out)


def test_feistel_permutes(spark):
    from pyspark.sql import functions as F

    from steelyard.llm import pii, sharding

    df = spark.range(97 * 11).select(pii.feistel(F.col("id"), F.lit(97), F.lit(11), "k", "t").alias("y"))
    assert sorted(r.y for r in df.collect()) == list(range(97 * 11))
    for n in (1, 2, 3, 1000, 4097):
        assert sorted(sharding.feistel(np.arange(n), n, 7).tolist()) == list(range(n))


def test_mix(docs, rows, none):
    from steelyard.llm.mixing import mix, repeat_rows

    got = mix(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else level * weight[s]
            left -= target[s]
        free -= over or free
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, mix(docs.repartition(7)).collect())) == sorted(map(key, got))
    whole = mix(docs, keep_text=True, split=False)
    assert repeat_rows(whole).count() == sum(r.taken // r.size for r in whole.collect() if r.size)
    assert mix(none).count() == 0


def test_mix_cuts_hot_weights_and_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from steelyard.llm import mixing

    # a third of the rows has the least weight, a third no key, and one source has most rows
    text = F.when(F.col("id") % 3 == 0, F.lit("### $$$ %%% &&&")).otherwise(F.concat(F.lit("plain words here "), F.col("id").cast("string")))
    wide = spark.range(12000).select(F.when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("doc_id"), text.alias("text"), F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("source"))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 500)
    seen = []
    kept = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: seen.append(kept(df, name)) or seen[-1])
    got = mixing.mix(wide).collect()
    parts = [r["count"] for r in seen[1].groupBy("_s", "_r").count().collect()]
    assert sum(parts) == 12000 and max(parts) < 1500
    for source in ("hot", "cold"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    # better texts are drawn more often
    share = lambda least: sum(r.taken for r in got if (r.size == 4 and (r.doc_id or 1) % 3 == 0) == least) / sum(r["size"] for r in got if (r.size == 4 and (r.doc_id or 1) % 3 == 0) == least)
    assert share(True) < share(False)


def test_shards_against_plain_integers(spark):
    from steelyard.llm.sharding import ROUNDS, row_numbers, shard

    full = (1 << 64) - 1

    def finish(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def place(x, n, seed):
        half = 1
        while 1 << 2 * half < n:
            half += 1
        while True:
            a, b = x >> half, x & (1 << half) - 1
            for k in range(ROUNDS):
                a, b = b, a ^ finish(b ^ finish(seed * ROUNDS + k + 1)) & (1 << half) - 1
            x = a << half | b
            if x < n:
                return x

    rows = [(i, f"text {i % 11}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    from pyspark.sql import functions as F

    slim = df.select(F.col("doc_id").alias("_id"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), (F.octet_length("text").cast("long") + 8).alias("size"))
    numbers = {r._id: r._row for r in row_numbers(slim, "_id", "text_crc32", "size")[0].collect()}
    assert sorted(numbers.values()) == list(range(300))
    for r in shard(df, 24, seed=5).collect():
        at = place(numbers[r.doc_id], 300, 5)
        assert (r.shard, r.slot, r.text_crc32, r["size"]) == (at % 24, at // 24, zlib.crc32(rows[r.doc_id][1].encode()), len(rows[r.doc_id][1]) + 8)


def test_dual_coordinate_descent_against_projected_gradient():
    from steelyard.llm.quality_model import BITS, SMOOTHING, fit_margin

    r = np.random.default_rng(3)
    y = np.array([0, 1] * 15)
    rows = [np.unique(r.integers(0, 40, 12) + (15 if k else 0)).astype(np.int32) for k in y]
    weights = r.uniform(0.5, 1.5, len(y))
    model = fit_margin(rows, y, weights, epochs=3000)
    counts = [SMOOTHING + np.bincount(np.concatenate([x for x, k in zip(rows, y, strict=True) if k == c]), minlength=1 << BITS) for c in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((len(y), 56))
    for i, ids in enumerate(rows):
        x[i, ids] = ratio[ids] / np.linalg.norm(ratio[ids])
    x[:, 55] = 1.0  # the bias
    z = x * np.where(y == 1, 1.0, -1.0)[:, None]
    alpha, gram = np.zeros(len(y)), z @ z.T
    for _ in range(200_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, weights)
    w = alpha @ z
    first = np.concatenate([[0], np.cumsum([len(i) for i in rows])])
    assert np.allclose(model.margin(np.concatenate(rows), first), x @ w, atol=0.02) and abs(model.bias - w[55]) < 0.02


def test_sample_of_the_classifier_is_bounded(spark, sf):
    from steelyard.llm.common import table
    from steelyard.llm.quality_model import score, train

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    small = train(docs, labels, sample_bytes=100_000)
    assert not np.array_equal(small.value, train(docs, labels).value)
    assert all(0 <= r.score <= 1 for r in score(docs, small).collect())


def test_shards(docs, rows, none):
    from steelyard.llm.sharding import shard

    got = shard(docs, 24).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values()) if len(slots) == 24 else [0]) <= 1
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    place = lambda xs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in xs)
    assert place(shard(docs.repartition(5), 24).collect()) == place(got)
    assert shard(none, 24).count() == 0


def test_classifier_on_held_out_rows(spark, sf, none):
    from pyspark.sql import functions as F

    from steelyard.llm.common import table
    from steelyard.llm.quality_model import held_out, score, train

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = train(docs, labels)
    rows = score(docs, model).join(labels, "doc_id").where(held_out("doc_id")).select("score", "quality").collect()
    assert len(rows) > 10 and sum((r.score >= 0.5) == (r.quality == 1) for r in rows) >= 0.9 * len(rows)
    # the labels of held-out rows, and all other columns, change nothing
    other = train(docs, labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(model.value, other.value) and model.bias == other.bias
    assert score(none, model).count() == 0


def test_classifier_takes_any_text(docs, spark):
    from steelyard.llm.quality_model import score, train

    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = score(docs, train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    for known in (labels.where("quality = 1"), labels.limit(0)):
        assert all(0 <= r.score <= 1 for r in score(docs, train(docs, known)).collect())


def test_pipeline(spark, sf):
    import corpus_pipeline
    from steelyard.llm.common import materialize, table
    from steelyard.llm.quality_model import score, train

    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        seen.append((name, before, docs))
        assert docs.columns == columns or name == "packing"
    kept = {r.doc_id for r in seen[0][2].collect()}
    model = train(seen[0][1], table(spark, sf, "labels"))
    assert kept == {r.doc_id for r in score(seen[0][1], model).collect() if r.score >= 0.5}
    rows = [(r.doc_id, r.text) for r in seen[1][1].collect()]
    assert sorted(r.doc_id for r in seen[1][2].collect()) == sorted({c for _, c in near_classes(rows)})
    assert seen[2][2].count() == seen[2][1].count()
    mixed = seen[3][2].collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in seen[3][1].collect()}
    packed = seen[4][2].collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in mixed}
    sequences(packed)


def test_stages_of_the_pipeline_take_any_rows(docs, rows, none, sf, spark):
    import corpus_pipeline
    from pyspark.sql import functions as F
    from steelyard.llm.common import materialize

    names = ["_score", "_row", "_n", "target", "taken", "length", "sequence_id", "_id", "class_id", "n_replaced"]
    wide = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    wide, empty = materialize(wide, "wide"), materialize(none.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]), "wide")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, sf)
        got = out.collect()
        if name != "packing":
            assert out.columns == wide.columns and all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in got), name
        assert stage(spark, empty, sf).count() == 0
        if name == "pii":
            assert len(got) == len(rows) and sum(r.text is None for r in got) == sum(r[1] is None for r in rows)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({c for _, c in near_classes(rows)})
            assert sum(r.doc_id is None for r in got) == sum(r[0] is None for r in rows)
        if name == "packing":
            assert {p.doc_id for p in got} == {r[0] for r in rows}


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from steelyard.llm.common import drop, materialize, shared_dir

    def session(master, folder):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder}), conf=SimpleNamespace(get=lambda _: "file:/w"))

    assert shared_dir(session("spark://a:7077", "s3a://b/c")) == "s3a://b/c" and shared_dir(session("local[4]", None)) == "file:/w/scratch"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session("spark://a:7077", None))
    written = materialize(spark.range(5), "test")
    assert written.count() == 5
    drop(written)
    with pytest.raises(Exception, match="(?i)not.?(found|exist)"):
        spark.read.parquet(written._scratch)


def test_long_words_are_walked(monkeypatch):
    from steelyard.llm import tokencount

    c = tokencount.counter(tokencount.piece_file())
    r = random.Random(9)
    for alphabet in ("abcdefgh", "aé漢b🙂\x07", "the"):
        word = tokencount.SPACE + "".join(r.choice(alphabet) for _ in range(5000))
        n, score = c.search([word])
        assert c.walk(word) == (n[0], score[0])
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(50)]
    c.known.clear()
    want = c.counts(words)
    monkeypatch.setattr(tokencount, "LONG", 10)
    c.known.clear()
    assert c.counts(words) == want


def test_columns_named_like_inner_ones_stay(docs):
    from steelyard.llm.minhash import keep_one
    from steelyard.llm.mixing import mix, repeat_rows
    from steelyard.llm.pii import pseudonymize
    from steelyard.llm.quality_rules import cascade
    from steelyard.llm.sharding import shard

    names = ["_k", "_t", "_s", "_r", "_run", "_row", "_out", "_at", "_key", "_digest", "_own", "_bucket", "_n", "Size"]
    from pyspark.sql import functions as F

    wide = docs.select("doc_id", "text", "source", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for out in (keep_one(wide), repeat_rows(mix(wide, keep_text=True, split=False)), pseudonymize(wide, key=KEY), shard(wide, 3), cascade(wide)):
        inner = [n for n in names if n != "Size"]
        row = out.select(*inner).distinct().collect()
        assert [tuple(r) for r in row] == [tuple(range(len(inner)))]
