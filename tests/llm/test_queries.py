"""The registered queries against their contracts, on the smallest tables: every column is made again by plain means."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lodestone.llm import caps, licenses, pii, substrings
from lodestone.llm.queries import QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r["vec_id"]: r["embedding"] for r in rows}


def ran(spark, name, key="doc_id"):
    rows = QUERIES[name](spark, SF).collect()
    found = {r[key]: r.asDict() for r in rows}
    assert len(found) == len(rows)
    return found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, texts):
    def plain(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got, want = ran(spark, "op1_simhash"), {k: plain(t) for k, t in texts.items()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{f:016x}" for k, f in want.items()}
    root = {k: k for k in want}
    ids = sorted(want)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (want[i] ^ want[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if x == b else x for k, x in root.items()}
    assert {k: r["component_id"] for k, r in got.items()} == root


def test_op2(spark, texts):
    got = ran(spark, "op2_licenses")
    assert got.keys() == texts.keys()
    for k, r in got.items():
        n, places = licenses.brute_force(texts[k])
        starts, labels = [at for _, at in places], sorted({label for label, _ in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert set(labels) <= set(filter(None, r["labels"].split(","))) and r["labels"] == ",".join(sorted(filter(None, r["labels"].split(","))))
        assert 0 <= r["score"] <= 1


def test_op3(spark, texts):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = ran(spark, "op3_language")
    known = {x for x in langs.values() if x}
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[k] or "")) and r["lang_pred"] in known | {"und"}
    held = [k for k, r in got.items() if r["held_out"] and langs[k] and r["lang_pred"] != "und"]
    assert sum(got[k]["lang_pred"] == langs[k] for k in held) >= 0.9 * len(held) > 0


def test_op4(spark, texts):
    got = ran(spark, "op4_sharding")
    draw = lambda k, s: -1 / math.log((int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52))
    for k, r in got.items():
        raw = (texts[k] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["shard"] == max(range(24), key=lambda s: draw(k, s)) and r["grown_shard"] == max(range(25), key=lambda s: draw(k, s))
    for s in range(24):
        own = sorted((k for k, r in got.items() if r["shard"] == s))
        assert [got[k]["slot"] for k in own] == list(range(len(own)))


def test_op5(spark, texts):
    lib, rows = Tokenizer.from_file(TOKENIZER), [r.asDict() for r in QUERIES["op5_packing"](spark, SF).collect()]
    by_doc, used = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 1024 and by_doc.keys() == texts.keys()
    for k, own in by_doc.items():
        ids, at = [*lib.encode(texts[k] or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    padded = sum(1024 if x & (x - 1) else x for x in used.values())
    assert padded <= 1.05 * sum(used.values())


def test_op6(spark, texts):
    lib, got = Tokenizer.from_file(TOKENIZER), ran(spark, "op6_bpe")
    for k, text in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_op7(spark, texts):
    got, told = ran(spark, "op7_pii"), pii.brute_force_terms(list(texts.values()))
    for k, text in texts.items():
        base = pii.brute_force(text)
        r = got[k]
        assert [r[f"n_{kind}"] for kind in pii.KINDS[:4]] == [sum(s[0] == kind for s in base) for kind in pii.KINDS[:4]]
        assert r["base_sha256"] == sha(",".join(f"{kind}:{a}:{b}" for kind, a, b in base))
        terms = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text or "") if m[0].lower() in told and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert r["spans"] == ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(base + terms, key=lambda s: (s[1], pii.KINDS.index(s[0]))))


def test_op8(spark, vectors):
    rows = sorted((r.asDict() for r in QUERIES["op8_neighbours"](spark, SF).collect()), key=lambda r: (r["query_id"], r["rank"]))
    x = {k: np.array(v, np.float64) for k, v in vectors.items() if v is not None and np.isfinite(v).all() and any(v)}
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), rel=1e-12, abs=1e-12) and r["vec_id"] != r["query_id"]
    assert by.keys() == {k for k in x if k % 20 == 0}
    hits = 0
    for q, own in by.items():
        n = min(20, len(x) - 1)
        assert [r["rank"] for r in own] == list(range(1, n + 1)) and len({r["vec_id"] for r in own}) == n
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))
        best = sorted((k for k in x if k != q), key=lambda k: (-float(x[q] @ x[k]), k))[:n]
        hits += len(set(best) & {r["vec_id"] for r in own}) / n
    assert hits >= 0.9 * len(by)


def test_op9(spark, vectors):
    got, want = ran(spark, "op9_caps", "vec_id"), caps.brute_force(vectors)
    assert {k: (r["n_links"], r["component_id"], r["kept"]) for k, r in got.items()} == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_op10(spark, texts):
    got, want = ran(spark, "op10_substrings"), substrings.brute_force(list(texts.items()))
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == {k: (n, gone, sha(left)) for k, (n, gone, left) in want.items()}
