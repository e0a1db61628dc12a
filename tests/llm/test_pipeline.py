"""Each stage of the pipeline against a plain form of it over what the stage before kept, and the whole run against the stages."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import language, pii, substrings

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """The input and what each stage but the last kept, as lists of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, frames = [docs.collect()], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        frames.append(docs)
        out.append(docs.collect())
    return out, frames


def test_stages_are_those_of_the_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "drop_near_copies", "drop_repeated_passages", "remove_personal_data", "pack"]


def test_columns(kept):
    _, frames = kept
    assert all(f.columns == COLUMNS for f in frames)


def test_language_stage(spark, kept):
    """The kernel classifier in plain numpy, one text at a time."""
    (before, after, *_), _ = kept
    docs = spark.createDataFrame(before)
    model = language.train(language.sample(docs, ~language.held_out()))
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert {r["doc_id"]: r["lang"] for r in after} == {k: r["lang_pred"] for k, r in found.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    rejected = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    prose = {r["doc_id"] for r in before if r["text"] and len(re.findall(r"[^\W\d_]+", r["text"])) >= 20}
    assert len(rejected & prose) <= 0.02 * len(prose)  # clean documents stay


def test_near_copies_stage(kept):
    """Links are pairs that share 0.8 of their five-word shingles, found by comparing all."""
    (_, before, after, *_), _ = kept
    words = {r["doc_id"]: (r["text"] or "").lower().split() for r in before}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} for k, w in words.items()}
    ids = sorted(sets)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r["doc_id"] for r in after) == [k for k in ids if find(k) == k]


def test_passages_stage(kept):
    (_, _, before, after, _), _ = kept
    want = substrings.brute_force([(r["doc_id"], r["text"]) for r in before])
    got = {r["doc_id"]: r["text"] for r in after}
    texts = {r["doc_id"]: r["text"] for r in before}
    for k, (n, removed, left) in want.items():
        if removed and removed == n:
            assert k not in got
        else:
            assert got.pop(k) == (left if removed else texts[k])
    assert not got


def test_personal_data_stage(kept):
    (_, _, _, before, after), _ = kept
    old, new = ({r["doc_id"]: r for r in rows} for rows in (before, after))
    assert old.keys() == new.keys()
    touched = 0
    for k, r in new.items():
        spans = pii.brute_force(old[k]["text"])
        values = [old[k]["text"][s:e] for _, s, e in spans]
        assert not any(v in r["text"] for v in values) and r["n_chars"] == len(r["text"])
        touched += bool(values)
        if "[TERM]" not in r["text"]:
            plain, at = "", 0
            for kind, s, e in spans:
                if s >= at:
                    plain, at = plain + old[k]["text"][at:s] + f"[{kind.upper()}]", e
            if all(b[1] >= a[2] for a, b in zip(spans, spans[1:])):
                assert r["text"] == plain + old[k]["text"][at:]
    assert touched


def test_run_packs_what_the_stages_kept(spark, kept):
    (*_, last), _ = kept
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    tokens = {}
    for r in got:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {r["doc_id"]: len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in last}
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 1024 and sorted(used) == list(range(len(used)))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns with names that the operators use."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [(1, None, "en", "a", 1), (2, "", "en", None, None), (3, "hello there", None, "a", 2), (3, "hello there", None, "a", 2), (None, "good day", None, None, None), (4, long, "en", "b", 5), (5, long, "en", "b", 5), (6, "12 34", "en", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("id", "fp", "component_id", "spans", "base", "score", "start", "length", "tid", "rank", "key", "n"):
        docs = docs.withColumn(extra, F.lit("x"))
    got = stage(spark, docs, SF).collect()
    ids = [r["doc_id"] for r in got]
    if name == "near copies":
        assert ids.count(4) == 1 and 5 not in ids and None in ids
    elif name == "language":
        assert not {1, 2, 6} & set(ids)  # no letters
        assert ids.count(3) == 2  # nothing to learn from but repetitions of one language: those with letters stay
    elif name == "repeated passages":
        assert ids.count(4) == 1 and 5 not in ids and {1, 2, 6, None} <= set(ids)
    elif name == "personal data":
        assert len(ids) == len(rows)
    else:
        assert {1, 2, 3, 4, 5, 6, None} == set(ids)


def test_rows_without_ids_or_with_repeated_ones(spark):
    """Copies go and repeated passages are cut whether or not a row has an id of its own."""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    word = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows = [(1, word("a", 99)), (9, word("a", 99)), (None, word("a", 99)), (2, word("b", 99)), (2, word("b", 99)), (None, word("c", 99)), (None, word("c", 99)), (2, word("a", 98)), (7, word("d", 99)), (7, word("e", 99))]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], shape).repartition(3)
    got = [(r["doc_id"], r["text"][0]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (2, "b"), (None, "c"), (7, "d"), (7, "e")], key=str)

    passage = word("p", 60)
    for low in ([(-5, f"x {passage} y")], []):
        rows = [*low, (None, f"u {passage} v"), (None, f"s {passage} t")]
        docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], shape)
        got = corpus_pipeline.drop_repeated_passages(spark, docs, SF).collect()
        assert len(got) == len(rows) and sum(passage in r["text"] for r in got) == 1
        assert sum(r["doc_id"] is None for r in got) == 2 and all(passage in r["text"] for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_nothing(spark, name, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, docs, SF)
    assert got.count() == 0 and (name == "packing" or got.columns == COLUMNS)
