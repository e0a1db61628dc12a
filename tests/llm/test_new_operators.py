"""Phrases, centroids and best fit against brute force and the tokenizers library, on odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bestfit, centroids, phrases, wordbpe
from lodestone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLASHING = ("id", "word", "lang2", "gid", "n", "a", "b", "row", "ids", "vector", "ints", "raw", "cluster", "rank", "length", "piece", "draw")


def mined(rows, least=30, longest=4, top=2000, share=80):
    """Every phrase of every language by plain loops."""
    f, n, low = defaultdict(Counter), Counter(), str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {q[i : i + k] for q, b in frequent.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= share * frequent[q[i : i + k]]}
        rows = []
        for p, a in frequent.items():
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows += [(-score, -a, " ".join(p).encode(), left, right)] * (p not in covered)
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def said():
    r = random.Random(8)
    rows = [(r.choice(["en", "de", None]), "".join(r.choice("aAbcéü ") + r.choice("  \t.,\n \x0bx!") for _ in range(r.randint(0, 60)))) for _ in range(300)]
    return rows + [("en", None), ("fr", ""), (None, None), ("en", "ha " * 500), ("en", "ha\tha. ha"), ("und", "A b a b")] + [("de", "one two three four five")] * 40


@pytest.mark.parametrize("sent", [phrases.SENT_WORDS, 2])
def test_phrases_by_plain_loops(spark, said, monkeypatch, sent):
    """Sent tables and joined ones give the same; nulls, repeated rows, overlaps, ties and clashing columns among them."""
    monkeypatch.setattr(phrases, "SENT_WORDS", sent)
    monkeypatch.setattr(phrases, "SENT_GRAMS", sent)
    monkeypatch.setattr(phrases, "OFTEN", 20)
    df = spark.createDataFrame(said, "lang string, text string").withColumns({c: F.lit("x") for c in CLASHING}).repartition(5)
    assert sorted(map(tuple, phrases.mine(df, 5, 4, 30).collect())) == mined(said, 5, 4, 30)
    assert phrases.mine(df.limit(0)).count() == 0 and phrases.mine(df, 10**6).count() == 0


def test_phrases_of_long_texts_and_slices(spark, said, monkeypatch):
    monkeypatch.setattr(phrases, "_SLICE", 50)
    monkeypatch.setattr(phrases, "_HELD", 10)
    rows = [("en", " ".join(f"{t or ''}." for _, t in said) * 5)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.mine(df, 7, 5, 40).collect())) == mined(rows, 7, 5, 40)


def test_phrase_keys_stay_with_their_rows(spark, monkeypatch):
    """Beyond what is sent, a row holds the keys of one row of a text, not those of a batch of texts."""
    r, most, cut = random.Random(3), [], phrases.cut
    rows = [("en", " ".join(f"w{r.randrange(400)}" + r.choice(["", "", ","]) for _ in range(600))) for _ in range(60)]

    def measured(df):
        out = cut(df)
        if "keys" in out.columns:
            most.append(out.agg(F.max(F.size("keys"))).first()[0])
        return out

    monkeypatch.setattr(phrases, "cut", measured)
    monkeypatch.setattr(phrases, "SENT_GRAMS", 2)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert sorted(map(tuple, phrases.mine(df, 3, 3, 50).collect())) == mined(rows, 3, 3, 50)
    assert most and max(most) <= 1024


def test_phrase_tables_that_are_sent():
    """Known words have their numbers, others -1, those with the hash of a known one too."""
    import pyarrow as pa

    words = [f"en w{k}".encode() for k in range(50)]
    known = phrases._sorted_keys(pa.chunked_array([pa.array(words[:20], pa.binary()), pa.array(words[20:], pa.binary())]), np.arange(50, dtype=np.int32))
    assert phrases._numbers(known, [*words[::-1], b"en x", b"de w1", b"w1"]) == [*range(49, -1, -1), -1, -1, -1]
    seed, hashes, gids, of = known
    clash = (seed, hashes, gids, pa.array([b"en other"] * 50, pa.binary()))
    assert phrases._numbers(clash, words) == [-1] * 50
    assert phrases._numbers(phrases._sorted_keys(pa.chunked_array([], pa.binary()), np.zeros(0, np.int32)), words[:2]) == [-1, -1]


def test_phrase_scores_are_exact(spark):
    a, left, right = 3 * 10**15 + 7, 5 * 10**15 + 1, 10**15 + 3
    level = spark.createDataFrame([("en", bytearray(b"x y"), a, [left], [right])], "lang string, phrase binary, n long, begins array<long>, ends array<long>")
    assert phrases._scored(level).first()["score"] == 2_000_000 * a // (left + right)


def clustered(rows, k=16, rounds=3, dim=64, scale=64, seed=1):
    rows = [(i, centroids.integers(v, scale)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in first[:k]]
    for turn in range(rounds + 1):
        found = [centroids.nearest_large(v, c) for _, v in rows]
        for j in range(len(c) if turn < rounds else 0):
            if own := [v for (_, v), (at, _) in zip(rows, found, strict=True) if at == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    spent = Counter()
    for at, d in found:
        spent[at] += d
    fits = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((i, at, fits(d), fits(spent[at]), fits(sum(spent.values())), digest[at]) for (i, _), (at, d) in zip(rows, found, strict=True))


@pytest.mark.parametrize("size", [0.02, 1.0, 3e5, 1e30])
def test_centroids_by_plain_integers(spark, size):
    """Small components make ties; large ones leave 64 bits. Nulls, other lengths, repeats and clashing columns among them."""
    r = random.Random(4)
    rows = [(k, [r.gauss(0, size) for _ in range(5)]) for k in range(150)]
    rows += rows[:20] + [(None, [0.0] * 5), (None, [size] * 5), (200, None), (201, [1.0] * 4), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] + [0.0] * 4), (204, [float("inf")] * 5), (205, [])]
    if size == 1.0:
        rows.append((206, [1e12, -1e12, 0.5, 0.0, 0.0]))  # one large vector, so one large centroid
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)
    assert Counter(map(tuple, centroids.cluster(df, 7, 3, 5).collect())) == clustered(rows, 7, 3, 5)
    assert centroids.cluster(df, 500, 1, 5).select("cluster").distinct().count() > 100  # fewer vectors than centroids
    assert centroids.cluster(df.limit(0)).count() == 0 and centroids.cluster(df, dim=9).count() == 0


def test_screening_leaves_the_nearest_in(spark):
    """Centroids whose distances float32 can't tell apart are settled by integers, ties by the smaller number."""
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 25), 1 << 25, (400, 64))
    c = np.repeat(x[:1] + rng.integers(-3, 4, (20, 64)), 2, axis=0)
    best, distance, still = centroids.nearest(x, c)
    exact = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert still == len(x) and (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    far = rng.integers(-1000, 1000, (40, 64)) * 1000
    best, distance, still = centroids.nearest(x, far)
    assert still < len(x) and (best == ((x[:, None, :] - far[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_words_on_any_text():
    """The encoder by ranks gives the library's ids: settled characters by words, all others by the library."""
    r, lib = random.Random(3), Tokenizer.from_file(WORD_TOKENIZER)
    enc = wordbpe.WordEncoder(open(WORD_TOKENIZER).read())
    assert enc.ranks
    letters = wordbpe._PLAIN + list("abcdefghijklmnopqrstuvwxyzéü'  \n\t") * 15 + ["<|endoftext|>", "Σ", "é", "中文", "İ", " ", "١", "K", "'s", "'LL", "🙂"]
    vocab = [x.replace("</w>", "") for x in lib.get_vocab()]
    rows = ["".join(r.choice(letters) for _ in range(r.randrange(70))) for _ in range(4000)]
    rows += ["".join(r.choice(vocab) for _ in range(r.randrange(1, 4))) for _ in range(4000)] + [None, "", "a" * 50_000, "ab'll " * 3000]
    want = [lib.encode(x or "", add_special_tokens=False).ids for x in rows]
    assert [x.tolist() for x in enc.encode(rows)] == want
    enc.forget()
    assert [enc.encode([x])[0].tolist() for x in rows[:200]] == want[:200]


def test_search_ends_where_no_exchange_helps():
    """Every document stays, no bin overflows, and no exchange of two bins is left unless no packing needs fewer bins."""
    r = random.Random(6)
    saved = 0
    for _ in range(120):
        capacity = r.choice([20, 100, 1000])
        histogram = {r.randint(1, capacity): r.randint(1, r.choice([1, 3, 50])) for _ in range(r.randint(1, 30))}
        if r.random() < 0.4:
            histogram = {r.randint(capacity // 5, capacity * 3 // 5): r.randint(1, 9) for _ in range(20)}
        first = bestfit.best_fit(histogram, capacity)
        bins = bestfit.local_search(first, capacity)
        for found in (first, bins, bestfit.local_search(first, capacity, 50)):
            held = Counter()
            for pattern, n in found.items():
                assert bestfit.fill(pattern) <= capacity and n > 0
                held.update({length: each * n for length, each in pattern})
            assert held == Counter(histogram)
        saved += sum(first.values()) - sum(bins.values())
        open_ = {p: n for p, n in bins.items() if bestfit.fill(p) < capacity}
        left = [1 for a in open_ for b in open_ if (a != b or open_[a] > 1) and improves(a, b, capacity)]
        assert not left or sum(bins.values()) == -(-sum(k * v for k, v in histogram.items()) // capacity)
    assert saved > 10


def improves(a, b, capacity):
    """By plain loops: whether an exchange fits ``b`` and makes the sum of squares greater."""
    a_one, b_one = ([length for length, n in x for _ in range(min(n, 2))] for x in (a, b))
    two = lambda x: [x[i] + x[j] for i in range(len(x)) for j in range(i)]
    fa, fb = bestfit.fill(a), bestfit.fill(b)
    gains = [*a_one, *(x - y for x in a_one for y in b_one), *(x - y for x in two(a_one) for y in b_one), *(x - y for x in a_one for y in two(b_one))]
    return any(fb + g <= capacity and (fb + g) ** 2 + (fa - g) ** 2 > fa**2 + fb**2 and g > 0 for g in gains)


def packed(rows, docs, capacity):
    """Checks the pieces of ``docs`` ((id, text) pairs) and gives the number of sequences."""
    lib, want, spans = Tokenizer.from_file(WORD_TOKENIZER), Counter(), defaultdict(list)
    for i, text in docs:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            want[i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in spans.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= capacity
    return len(spans), -(-sum(r["length"] for r in rows) // capacity)


def test_best_fit_packing(spark):
    r = random.Random(1)
    docs = [(k, " ".join(r.choice(["alpha", "Beta", "zqx"]) for _ in range(r.randrange(30)))) for k in range(200)]
    docs += docs[:5] + [(None, "x y"), (None, None), (900, ""), (901, None), (902, "word " * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)
    sequences, fewest = packed(bestfit.pack(df, WORD_TOKENIZER, capacity=40).collect(), docs, 40)
    assert fewest <= sequences <= fewest + 1
    assert bestfit.pack(df.limit(0), WORD_TOKENIZER).count() == 0


def test_op13(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sequences, fewest = packed(QUERIES["op13_bestfit"](spark, SF).collect(), docs, 2048)
    assert sequences == fewest
