"""Each operator against brute force, a library or a round trip, on fixtures with nulls, ties, repeats and long texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, caps, language, licenses, neighbours, packing, pii, sharding, simhash, substrings

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    shared, long = say(70), say(6000)
    out = [None, "", " \n\t ", "one", "one two three", say(60), say(300), long, long[:-3] + "end"]
    out += [say(20) + " " + shared + " " + say(10), shared, say(5) + "\n" + shared, shared + " " + say(90)]
    base = say(400).split()
    for k in range(6):
        near = list(base)
        near[k * 60 + 3] = "changed"
        out.append(" ".join(near))
    out += ["same same " * 80, "same same " * 80, "Ünïcödé 漢字 <|endoftext|> 🙂  x\x1cy", "a" * 3000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, x, "en", "s", -1) for k, x in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, n int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_fingerprints(docs):
    def plain(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {k: plain(x) for k, x in enumerate(texts())}
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert got == want


@pytest.mark.parametrize("list_rows", [8192, 20])
def test_fingerprint_components(spark, list_rows):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:
        for bits in (1, 3, 4, 5):
            g = f
            for b in r.sample(range(64), bits):
                g ^= 1 << b
            fps.append(g)
    hub = r.getrandbits(64)
    fps += [hub ^ (1 << b) for b in range(40)] + [hub] * 3
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    df = spark.createDataFrame([(k, int(np.uint64(f).view(np.int64))) for k, f in enumerate(fps)], "id long, fp long")
    roots = {x["node"]: x["root"] for x in simhash.connected_components(simhash.links(df, "fp", list_rows)).collect()}
    group = {}
    for k, f in enumerate(fps):
        f = int(np.uint64(f).view(np.int64))
        group.setdefault(roots.get(f, f), []).append(k)
    assert sorted(map(sorted, group.values())) == sorted([k for k, x in enumerate(label) if x == y] for y in set(label))


def test_simhash_near(docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(texts()) and got[0] == got[1] == got[2] == 0 and got[19] == got[20] == 19


def test_licences(spark):
    apache = dict((k, t) for k, t in licenses.TEMPLATES[::-1])["apache-2.0"]
    rows = [None, "", "CC BY cc by-cc  by x", "all rights, reserved. (General) Public-License!", "start " + licenses.TEMPLATES[3][1] + " end", "the of and to in a is it", apache, "general public"]
    df = spark.createDataFrame([(k, x, "a") for k, x in enumerate(rows)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for k, x in enumerate(rows):
        n, places = licenses.brute_force(x)
        assert (got[k]["n_words"], sorted((p["label"], p["start"]) for p in got[k]["places"])) == (n, places)
    assert [(s["label"], s["start"]) for s in got[4]["spans"]] == [("mit", 1)] and got[4]["spans"][0]["covered"] == got[4]["spans"][0]["template_words"]
    assert {s["label"] for s in got[6]["spans"]} == {"apache-2.0"}
    assert not any(got[k]["spans"] for k in (0, 1, 2, 5, 7))


def test_licence_that_goes_on_as_another():
    """Each template whole, followed by the words that stand after its last words in another one."""
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, 5, 6, 0.6)
    for text in ("Licensed under the Apache License, Version 2.0. The code is here", "Licensed under the Apache License, Version 2.0 (the License); you may not copy it"):
        assert ("apache-2.0", 0, 8, 8, 8) in scanner.spans(licenses.words_of(text.encode()))
    every = [licenses.words_of(t.encode()) for _, t in licenses.TEMPLATES]
    for (label, _), own in zip(licenses.TEMPLATES, every, strict=True):
        for other in every:
            for k in (k for k, w in enumerate(other) if w == own[-1]):
                assert any(s[0] == label and s[1] == 0 and s[3] == s[4] == len(own) for s in scanner.spans(own + other[k + 1 : k + 6]))


def test_licence_chain_from_any_place_of_a_repeated_passage():
    """A passage that a template has twice, once before what the text goes on with and once elsewhere."""
    template = "one two three four five alpha beta gamma delta epsilon one two three four five six seven eight nine ten eleven twelve"
    scanner = licenses.Scanner({}, [("twice", template)], 5, 6, 0.4)
    text = "so one two three four five now six seven eight nine ten eleven"
    assert scanner.spans(licenses.words_of(text.encode())) == [("twice", 1, 13, 11, 22)]


def test_automaton_against_all_runs():
    """Each template's own maximal runs, by comparing every run of the text with every template."""
    r = random.Random(1)
    for _ in range(150):
        seqs = [[r.randrange(3) for _ in range(r.randrange(1, 12))] for _ in range(3)]
        a = licenses.Automaton(seqs)
        a.prepare(2)
        text = [r.randrange(4) for _ in range(25)]
        want = set()
        for t, seq in enumerate(seqs):
            runs = {tuple(seq[i:j]) for i in range(len(seq)) for j in range(i, len(seq) + 1)}
            longest = [max(n for n in range(e + 1) if tuple(text[e - n : e]) in runs) for e in range(len(text) + 1)]
            want |= {(t, e - longest[e], longest[e]) for e in range(1, len(text) + 1) if longest[e] >= 2 and (e == len(text) or longest[e + 1] != longest[e] + 1)}
        got = a.matches(text, 2)
        assert {(t, s, n) for t, s, n, _ in got} == want and len(got) == len(want)
        for t, s, n, ends in got:
            assert sorted(ends) == [e for e in range(n - 1, len(seqs[t])) if seqs[t][e - n + 1 : e + 1] == text[s : s + n]]


def test_chains_against_all_chains():
    """The best chain that ends with each run, by going through all chains; the first one taken covers most of all."""
    r = random.Random(5)
    for _ in range(300):
        seq, gap = [r.randrange(4) for _ in range(r.randrange(4, 14))], r.randrange(4)
        a = licenses.Automaton([seq])
        a.prepare(2)
        runs = [(s, n, ends) for _, s, n, ends in a.matches([r.randrange(5) for _ in range(22)], 2)]

        def chains(at, place):
            s, n, _ = runs[at]
            yield n, s
            for k, (s2, n2, ends2) in enumerate(runs):
                fresh = s + n - max(s, s2 + n2)
                for before in ends2:
                    new = min(n, fresh, place - before)
                    if s2 + n2 < s + n and s - s2 - n2 <= gap and new > 0 and place - before <= gap + n:
                        yield from ((c + new, first) for c, first in chains(k, before))

        every = [(*max(x for place in ends for x in chains(k, place)), s + n) for k, (s, n, ends) in enumerate(runs)]
        got = licenses.best_chains(runs, gap)
        assert bool(got) == bool(runs)
        want = []
        for covered, start, end in sorted(every, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if all(end <= s or e <= start for s, e, _ in want):
                want.append((start, end, covered))
        assert got == sorted(want)


def test_licence_with_a_repeated_line():
    """A whole licence with five or six of its own words once more somewhere inside is found whole."""
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, 5, 6, 0.6)
    r = random.Random(7)
    for label, text in licenses.TEMPLATES:
        words = licenses.words_of(text.encode())
        for _ in range(10 if len(words) >= 20 else 0):
            k, at, n = r.randrange(len(words) - 6), r.randrange(5, len(words) - 5), r.choice([5, 6])
            found = scanner.spans(words[:at] + words[k : k + n] + words[at:])
            assert any(s[0] == label and s[3] == s[4] == len(words) for s in found), (label, at, k)


def test_language(spark):
    r = random.Random(2)
    parts = {"xx": ["tha", "ing", "ou", "er"], "yy": ["ción", "ñ", "ado", "que"], "zz": ["ß", "ung", "sch", "ei"]}
    rows = []
    for k in range(400):
        lang = r.choice(sorted(parts))
        rows.append((k, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    rows += [(1000, None, "xx"), (1001, "", None), (1002, "12 34 !", "yy"), (1003, rows[0][1] * 500, None), (None, rows[1][1], "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(language.sample(df, ~language.held_out()))
    got = language.identify(df, model, keep=["lang"]).withColumn("held", language.held_out()).collect()
    held = [g for g in got if g["held"] and g["doc_id"] < 1000]
    assert all(g["held"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) for g in got if g["doc_id"] is not None)
    assert len(got) == len(rows) and sum(g["lang"] == g["lang_pred"] for g in held) >= 0.99 * len(held) > 0
    assert [g["lang_pred"] for g in got if g["doc_id"] in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= g["score"] <= 1 for g in got)


def test_language_kernel_by_sets():
    x, y = [language.grams(t.encode()) for t in ("abcab", "", "añb")], [language.grams(t.encode()) for t in ("abc", "añ")]
    k = language.presence_kernel(x, y)
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            assert k[i, j] == pytest.approx(len({*a.tolist()} & {*b.tolist()}) / max(len(a), 1) ** 0.5 / max(len(b), 1) ** 0.5)


def test_language_scores_by_the_full_kernel():
    """With every text a landmark the scores are those of weighted kernel ridge regression on the whole kernel."""
    r = random.Random(8)
    rows = sorted({(lang, "".join(r.choice(letters) for _ in range(r.randrange(3, 60)))) for lang, letters in (("aa", "abcde "), ("bb", "cdefgñ "), ("cc", "hijka ")) for _ in range(25)})
    model = language.train(rows, landmarks=10_000, ridge=0.1)
    sets = [{*language.grams(t.encode()).tolist()} for _, t in rows]
    kernel = lambda a, b: len(a & b) / max(len(a), 1) ** 0.5 / max(len(b), 1) ** 0.5
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    n = {x: sum(lang == x for lang, _ in rows) for x in model.languages}
    system = np.block([[np.zeros((1, 1)), np.ones((1, len(rows)))], [np.ones((len(rows), 1)), k + 0.1 * np.diag([n[lang] for lang, _ in rows])]])
    y = np.array([[0.0] * 3] + [[1.0 if lang == x else -1.0 for x in model.languages] for lang, _ in rows])
    solved = np.linalg.solve(system, y)
    new = ["abba cd", "ñg fed", "hi", "", "zzzz" * 50, "é" * 3000, *("ab cde " * n for n in range(40))]
    want = np.array([solved[0] + np.array([kernel({*language.grams(t.encode()).tolist()}, s) for s in sets]) @ solved[1:] for t in new])
    assert model.scores([t.encode() for t in new]) == pytest.approx(want, abs=1e-4)


def test_language_sample(spark):
    """A text in thousands of copies is one text; languages with few, only repeated or only long texts are learned; the sample is bounded."""
    rows = [(k, "copied text", "aa") for k in range(6000)] + [(k, f"text number {k}", "bb") for k in range(900)] + [(1, "long " * 9000, "cc"), (2, "long " * 9000 + "x", "cc")]
    rows += [(k, f"t{k}", f"l{k:04d}") for k in range(30)] + [(5, None, "dd"), (6, "", "ee"), (7, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(df, F.lit(True)).rows
    count = lambda x: sum(lang == x for lang, _ in got)
    assert (count("aa"), count("cc"), len(got)) == (1, 2, 1 + 2 + 30 + count("bb")) and count("bb") == 8192 // 33
    assert {x for lang, x in got if lang == "cc"} == {language.grams(("long " * 9000 + end).encode()).tobytes() for end in ("", "x")}  # whole texts
    assert {lang for lang, _ in language.sample(df, F.lit(True), total=3).rows} == {"aa", "bb", "cc"}
    assert len(language.sample(df, F.lit(True), total=40).rows) == 33
    thin = language.sample(df, F.lit(True), most=2000)
    assert 0 < thin.share < 1 and sum(len(x) // 8 for _, x in thin.rows) < 3000


def test_language_of_many_labels(monkeypatch):
    """A thousand labels with alphabets of their own stay within the bounds of the model, and so does a small bound."""
    r = random.Random(9)
    rows = [(f"l{k:04d}", "".join(chr(0x4E00 + 12 * k + r.randrange(12)) for _ in range(300))) for k in range(1000) for _ in range(2)]
    model = language.train(rows)
    assert len(model.languages) == 1000 and model.weights.size <= language.WEIGHTS and model.share < 1
    monkeypatch.setattr(language, "VOCABULARY", 300)
    two = [(lang, " ".join(r.choice(words) for _ in range(80))) for lang, words in (("aa", ["tha", "ing", "ou"]), ("bb", ["que", "los", "era"])) for _ in range(40)]
    small = language.train(two)
    assert len(small.vocabulary) <= 300 and [small.predict([x.encode()])[0][0] for _, x in two] == [lang for lang, _ in two]


def test_language_letters(spark):
    df = spark.createDataFrame([(1, "½ Ⅷ ²"), (2, "aaa"), (3, "漢")], "doc_id long, text string")
    model = language.train([("aa", "aaa bbb"), ("bb", "ccc 漢漢")])
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()} == {1: "und", 2: "aa", 3: "bb"}


def test_language_nothing_learned(docs, empty):
    model = language.train(language.sample(empty, ~language.held_out()))
    assert {r["lang_pred"] for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_sharding(spark):
    df = spark.createDataFrame([(k % 1900, k) for k in range(2000)] + [(None, 1), (None, 2)], "doc_id long, shard long")
    got = sharding.assign(df, [1.0] * 24, payload=[F.col("shard").alias("size")]).collect()
    assert len(got) == 2002
    for s in range(24):
        assert sorted(g["slot"] for g in got if g["shard"] == s) == list(range(sum(g["shard"] == s for g in got)))
    assert all(g["grown_shard"] in (g["shard"], 24) for g in got) and 40 < sum(g["grown_shard"] == 24 for g in got) < 130
    by = {}
    for g in got:
        by.setdefault(g["doc_id"], set()).add(g["shard"])
    assert all(len(v) == 1 for v in by.values())
    heavy = [g["shard"] for g in sharding.assign(df, [3.0, 1.0]).collect()]
    assert 0.68 < heavy.count(0) / len(heavy) < 0.82


def test_patterns_cover_the_histogram():
    r = random.Random(9)
    for _ in range(30):
        histogram = {r.randrange(1, 65): r.randrange(1, 500) for _ in range(r.randrange(1, 30))}
        patterns = packing.shortest_pack_first(dict(histogram), 64)
        assert all(sum(p) <= 64 for _, p in patterns)
        placed = {}
        for n, p in patterns:
            for x in p:
                placed[x] = placed.get(x, 0) + n
        assert placed == histogram


def test_packing(docs, empty):
    lib = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for g in got:
        by_doc.setdefault(g["doc_id"], []).append(g)
        by_sequence.setdefault(g["sequence_id"], []).append(g)
    for k, x in enumerate(texts()):
        own = sorted(by_doc[k], key=lambda g: g["start"])
        want = [*lib.encode(x or "", add_special_tokens=False).ids, 0]
        assert [i for g in own for i in g["ids"]] == want and own[0]["start"] == 0
        for g in own:
            assert g["doc_tokens"] == len(want) and g["length"] == len(g["ids"])
            assert g["ids_crc32"] == zlib.crc32(np.array(g["ids"], "<u4").tobytes())
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s in by_sequence.values():
        at = 0
        for g in sorted(s, key=lambda g: g["offset"]):
            assert g["offset"] == at
            at += g["length"]
        assert at <= 1024
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_bpe_round_trip(docs, empty):
    lib = Tokenizer.from_file(TOKENIZER)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER).collect()}
    for k, x in enumerate(texts()):
        assert got[k]["ids"] == lib.encode(x or "", add_special_tokens=False).ids
        assert got[k]["decoded"] == lib.decode(got[k]["ids"], skip_special_tokens=False) == (x or "")
    assert bpe.encode(empty, TOKENIZER).count() == 0


def test_bpe_any_text():
    lib, own, r = Tokenizer.from_file(TOKENIZER), bpe.Encoder(open(TOKENIZER).read()), random.Random(4)
    letters = "aA b  \n\t\x1c\x85 'sétdll19٣½ª@.<|endoftext|>　é́漢字🙂\x00"
    for _ in range(1500):
        s = "".join(r.choice(letters) if r.random() < 0.95 else r.choice(["<|endoftext|>", "  ", " 's", "'ll", " " * 5]) for _ in range(r.randrange(60)))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert own.encode([s])[0].tolist() == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        odd = [r.randrange(50257) for _ in range(9)]
        assert own.decode(odd) == lib.decode(odd, skip_special_tokens=False)


def test_pii(spark, empty):
    rows = [None, "", "mail a.b@c.de, x@y then a@b.co.uk_foo@bar.com", "1.2.3.4.5.6.7.8 and 300.1.1.1 or 001.02.3.255", "card 4111 1111 1111 1111 no 4111 1111 1111 1112 4111-1111-1111-1111",
            "call +49 (30) 1234.567-8 now +12 +1 +1 2 +123456789012345678", "é" * 20 + " ü@x.de +33 1 23 45 67 89é", "9" * 40_000, "a" * 40_000, "a.b" * 9000 + "@", "x@1.2.3.4 4111111111111111@a.b"]
    r = random.Random(8)
    rows += ["".join(r.choice("ab1234567890.@+- ()é_%") for _ in range(200)) for _ in range(150)]
    df = spark.createDataFrame([(k, x, "z") for k, x in enumerate(rows)], "doc_id long, text string, base string")
    for g in pii.find(df).collect():
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in g["base"]] == pii.brute_force(rows[g["doc_id"]])
        assert {tuple(s) for s in g["base"]} <= {tuple(s) for s in g["spans"]}
    assert pii.find(empty).count() == 0


def test_pii_terms_and_text(spark):
    rows = [f"word{'abcdefgh'[k]} Zorblax writes to zor@blax.org about lunch" for k in range(6)] + ["lunch about writes to a friend"] * 30 + [f"about lunch writes u{k}@x.org" for k in range(9)] + [None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: [(pii.KINDS[s["kind"]], s["value"]) for s in r["spans"]] for r in pii.find(df).collect()}
    assert all(got[k] == [("term", "zorblax"), ("email", "zor@blax.org")] for k in range(6)) and not any(got[k] for k in range(6, 36))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0] == "worda [TERM] writes to [EMAIL] about lunch" and clean[6] == rows[6] and clean[45] is None


def test_pii_terms_of_two_entities(spark):
    """A name split evenly between a mail address and a phone number, and one with a part of its places beside a rare entity."""
    rows = [f"{w} Zorblax writes to zor@blax.org now" for w in ("a", "b", "c")] + [f"{w} Zorblax calls +49 30 1234567 then" for w in ("a", "b", "c")]
    rows += [f"Quimby sees qq@quim.by {w}" for w in ("a", "b", "c")] + ["Quimby is here"] * 4 + ["sees writes calls now then is here to"] * 400
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["spans"] if pii.KINDS[s["kind"]] == "term"] for r in pii.find(df).collect()}
    assert all(got[k] == ["zorblax"] for k in range(6)) and all(got[k] == ["quimby"] for k in range(6, 13)) and not any(got[k] for k in range(13, len(rows)))


def test_pii_terms_by_plain_loops(spark):
    """Terms wherever they stand, against plain loops over random texts with entities, odd letters and overlapping spans."""
    import regex

    r = random.Random(21)
    people = [(f"Nam{c}lo Sur{c}name", e) for c, e in zip("abcdef", ["a@b.co", "+49 30 12345678", "4111 1111 1111 1111", "10.1.2.3", "Ünï@x.org", "q.r@s.t.u"])]
    common = "über straße the and to is of in it was for on are with они были".split()
    rows = [None, ""]
    for _ in range(400):
        words = [r.choice(common) for _ in range(r.randrange(3, 40))]
        if r.random() < 0.3:
            name, entity = r.choice(people)
            at = r.randrange(len(words))
            words[at:at] = [name, *r.sample(common, r.randrange(3)), entity]
        if r.random() < 0.1:
            words.insert(r.randrange(len(words)), r.choice(people)[0].upper())
        rows.append(r.choice(" \n")[0].join(words) + r.choice(["", ".", " @", "@x"]))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    telling = pii.brute_force_terms(rows)
    assert len(telling) >= 6
    for g in pii.find(df).collect():
        text = rows[g["doc_id"]] or ""
        base = pii.brute_force(text)
        want = [("term", m.start(), m.end()) for m in regex.finditer(r"\p{L}{3,}+", text) if m[0].lower() in telling and not any(s < m.end() and m.start() < e for _, s, e in base)]
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in g["spans"]] == sorted(base + want, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_long_texts_in_proportion(spark):
    """Texts of a megabyte that are all numbers, addresses or names take seconds."""
    import time

    rows = [",".join(str(k % 997) for k in range(260_000)), "1.2.3.4," * 125_000, "me a@b.co " * 50_000 + "Zorblax " * 60_000, " ".join("4111 1111 1111 1111;" for _ in range(50_000))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find(df).select("doc_id", *[pii.count_of("base", k).alias(k) for k in pii.KINDS[:4]]).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert [(got[k]["email"], got[k]["ip"], got[k]["card"]) for k in range(4)] == [(0, 0, 0), (0, 125_000, 0), (50_000, 0, 0), (0, 0, 50_000)]
    assert clean[0] == rows[0] and clean[1] == "[IP]," * 125_000 and clean[3] == ";".join(["[CARD]"] + [" [CARD]"] * 49_999) + ";"
    assert time.time() - began < 90


def vectors():
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[50:80] = x[50] + 0.05 * r.standard_normal((30, 16))
    x[100:140] = x[100]
    out = {k: v.tolist() for k, v in enumerate(x)}
    out |= {400: None, 401: [0.0] * 16, 402: [float("nan")] * 16, 403: [1.0] * 15 + [None], 404: [float("inf")] * 16, 405: [], 406: (x[3] * 2).tolist(), 407: [1.0, 2.0], 408: [1.0, 2.1]}
    return out


@pytest.mark.parametrize("block_rows", [512, 7])
def test_caps(spark, block_rows):
    v = vectors()
    df = spark.createDataFrame([(k, x, 1) for k, x in v.items()], "vec_id long, embedding array<float>, n int").repartition(3)
    want = caps.brute_force({k: None if x is None else [None if c is None else float(np.float32(c)) for c in x] for k, x in v.items()})
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_duplicates(df, block_rows=block_rows).collect()}
    assert got == want
    assert caps.near_duplicates(df.limit(0)).count() == 0


def test_caps_recall_at_the_threshold(spark):
    """Pairs just over the threshold among tens of thousands of vectors; others are far from all."""
    r = np.random.default_rng(12)
    x = r.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((3000, 64))
    y -= (x[:3000] * y).sum(axis=1, keepdims=True) * x[:3000]
    y = 0.9001 * x[:3000] + np.sqrt(1 - 0.9001**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(np.concatenate((x, y)).tolist())], "vec_id long, embedding array<double>")
    got = {g["vec_id"]: g for g in caps.near_duplicates(df).filter("n_links > 0").collect()}
    assert all(g["n_links"] == 1 and g["component_id"] == k for k, g in got.items() if k < 3000)
    missed = [k for k in range(3000) if k not in got]
    assert not any(3000 <= k < 20_000 for k in got) and len(missed) <= 0.01 * 3000
    assert all(got[20_000 + k]["component_id"] == k and not got[20_000 + k]["kept"] for k in range(3000) if k in got)


@pytest.mark.parametrize("cell_rows,lot_queries", [(16_384, 65_536), (25, 3)])
def test_neighbours(spark, cell_rows, lot_queries):
    v = vectors()
    df = spark.createDataFrame([(k, x, 1) for k, x in v.items()], "vec_id long, embedding array<float>, q int").repartition(3)
    got = {}
    for r in neighbours.search(df, leaf_rows=40, trials=8, cell_rows=cell_rows, lot_queries=lot_queries).collect():
        assert r["trial_recall"] >= neighbours.RECALL and r["leaves"] > 0
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {k: np.array(x, np.float32).astype(float) for k, x in v.items() if x and len(x) == 16 and all(c is not None and np.isfinite(c) for c in x) and any(x)}
    hit = total = 0
    assert sorted(got) == [k for k in ok if k % 20 == 0]
    for q, rows in got.items():
        rows.sort()
        want = sorted(((-ok[q] @ x, k) for k, x in ok.items() if k != q))[:20]
        assert [r for r, _, _ in rows] == list(range(1, 21)) and rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        assert all(s == pytest.approx(ok[q] @ ok[k]) and k != q for _, k, s in rows) and len({k for _, k, _ in rows}) == 20
        hit, total = hit + len({k for _, k in want} & {k for _, k, _ in rows}), total + 20
    assert hit / total >= 0.9
    assert neighbours.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3000, 30_000])
def test_neighbours_recall(spark, n):
    """Random vectors, which have no structure to exploit, at two sizes: recall holds and nothing is listed twice."""
    x = np.random.default_rng(n).standard_normal((n, 32))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got: dict[int, list[int]] = {}
    for r in neighbours.search(df, every=100).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == list(range(0, n, 100)) and all(len(set(v)) == len(v) == 20 for v in got.values())
    score = x[::100] @ x.T
    score[np.arange(len(score)), np.arange(0, n, 100)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert sum(len({*v.tolist()} & {*got[100 * k]}) for k, v in enumerate(best)) >= 0.9 * 20 * len(best)


def test_leaves_in_the_order_of_the_queue():
    x = np.random.default_rng(3).standard_normal((500, 6))
    trees = [neighbours.Tree(x, 16, np.random.default_rng(k)) for k in range(3)]
    for q in x[:20]:
        crossed = [t.crossed(q[None])[0] for t in trees]
        order = [crossed[t][leaf] for t, leaf in neighbours.search_leaves(trees, q, 10_000)]
        assert order == sorted(np.concatenate(crossed).tolist())


@pytest.mark.parametrize("bucket_rows", [256, 1])
def test_substrings(docs, empty, bucket_rows):
    want = substrings.brute_force(list(enumerate(texts())))
    got = {r["doc_id"]: r for r in substrings.dedup(docs, bucket_rows=bucket_rows, keep=["lang"]).collect()}
    assert {k: (g["n_words"], g["n_removed"], g["kept_sha256"]) for k, g in got.items()} == {k: (a, b, hashlib.sha256(c.encode()).hexdigest()) for k, (a, b, c) in want.items()}
    assert got[0]["text"] is None and any(g["n_removed"] for g in got.values())
    assert substrings.dedup(empty).count() == 0


def test_repeated_rows_and_null_ids(spark):
    say = " ".join(WORDS * 4)
    df = spark.createDataFrame([(1, say), (1, say), (2, say), (None, say), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.dedup(df).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 80)]
    assert simhash.near_duplicates(df).count() == 5 and packing.pack(df, TOKENIZER).count() == 5 and bpe.encode(df, TOKENIZER).count() == 5 and pii.find(df).count() == 5 and licenses.scan(df).count() == 5


def test_packing_encoder_on_any_text(spark):
    """The encoder by ranks gives the library's ids on texts of odd letters, so its plain path and the other one agree."""
    r, lib = random.Random(14), Tokenizer.from_file(TOKENIZER)
    encode = packing._encoding(bpe.specification(spark.createDataFrame([], "doc_id long"), TOKENIZER))
    letters = "aAbetnoi  \n\t\x1c\x85 'sétdll19٣½ª@.<|endoftext|>　é́漢字🙂\x00İßſ"
    for _ in range(1500):
        s = "".join(r.choice(letters) if r.random() < 0.9 else r.choice(["<|endoftext|>", "  ", " 's", "'ll", " the", "ing", " " * 5]) for _ in range(r.randrange(80)))
        assert list(encode([s])[0]) == lib.encode(s, add_special_tokens=False).ids
    long = "word " * 120_000  # beyond the library's limit
    assert len(long) > packing._LIBRARY_CHARS and list(encode([long])[0]) == lib.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_places_and_terms_by_shuffle(spark, monkeypatch, limit):
    """The ways beyond the bounds of a broadcast give what the broadcast gives."""
    monkeypatch.setattr(packing, "BROADCAST_PLACES", limit)
    monkeypatch.setattr(pii, "BROADCAST_TERMS", limit)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", limit)
    rows = [f"word{'abcdefgh'[k]} Zorblax writes to zor@blax.org about lunch" for k in range(6)] + ["lunch about writes to a friend"] * 30 + [None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = {r["doc_id"]: [s["value"] for s in r["spans"]] for r in pii.find(df).collect()}
    assert all(spans[k] == ["zorblax", "zor@blax.org"] for k in range(6)) and not any(spans[k] for k in range(6, 37))
    packed = packing.pack(df, TOKENIZER).collect()
    assert len(packed) == 37 and len({(r["sequence_id"], r["offset"]) for r in packed}) == 37


@pytest.mark.parametrize("vectors_of", [10_000, 100_000, 1_000_000])
def test_caps_miss_rate(vectors_of):
    """Other random pairs than those that the number of codes was chosen on, at the threshold and closer."""
    rng, d = np.random.default_rng(99), 64
    codes = [caps.ProductCode(d, vectors_of, 0.9, caps.LISTS, caps.CAP_ROWS, 7, k) for k in range(caps.code_count(d, vectors_of, 0.9, caps.LISTS, caps.CAP_ROWS, 7))]
    for cosine in (0.9, 0.92, 0.95):
        x, y = rng.standard_normal((2, 600, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        met = set()
        for code in codes:
            (i, a), (j, b) = code.decode(x), code.decode(y)
            met |= set((np.intersect1d(i * code.directions + a, j * code.directions + b) // code.directions).tolist())
        assert len(met) >= 0.985 * 600


def test_null_ids_and_clashing_columns(spark):
    """Null ids beside links, repeated ids, and columns with the names that operators use inside."""
    rows = [(None, "cc by x", [1.0, 0.0]), (None, "cc by x", [1.0, 0.01]), (1, "cc by x", [1.0, 0.0]), (1, None, [0.0, 1.0]), (2, "", None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, embedding array<double>, cls string").withColumns({c: F.lit("x") for c in ("id", "fp", "key", "row", "vector", "first", "n", "word", "spans", "places")})
    near = simhash.near_duplicates(df).collect()
    assert len(near) == 5 and all(r["component_id"] in (1, 2) for r in near if r["doc_id"] is not None)
    assert sorted((r["doc_id"] or 0, len(r["places"])) for r in licenses.scan(df).collect()) == [(0, 1), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert licenses.scan(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0
    linked = caps.near_duplicates(df, "doc_id").collect()
    assert sorted((r["doc_id"] or 0, r["n_links"], r["kept"]) for r in linked) == [(0, 0, False), (0, 0, False), (1, 0, True), (1, 0, True), (2, 0, True)]
    found = neighbours.search(df, 2, 1, "doc_id").collect()
    assert {r["query_id"] for r in found} <= {1} and sharding.assign(df.limit(0), [1.0, 2.0]).count() == 0
