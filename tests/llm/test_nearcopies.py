"""The near-copy stage against brute force, on texts with edits on both sides of the least similarity."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestone.llm import nearcopies


def edited():
    r = random.Random(6)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    out = [None, "", " \n", "one two", "One  two"]
    for k in range(90):
        base = say(r.randrange(40, 300))
        near = list(base)
        for at in r.sample(range(len(near)), max(1, len(near) * (k % 6) // 100)):
            near[at] = "edit"
        out += [" ".join(base), " ".join(near)]
    return out


def plain(texts):
    words = [(x or "").lower().split() for x in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} for w in words]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


@pytest.mark.parametrize("key_bytes,cell_rows", [(None, 1024), (3, 1024), (2, 2)])
def test_components(spark, key_bytes, cell_rows):
    want = plain(edited())
    df = spark.createDataFrame([(k, x, "a") for k, x in enumerate(edited())], "doc_id long, text string, fp string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.components(df, key_bytes=key_bytes, cell_rows=cell_rows).collect()}
    assert [got[k] for k in range(len(want))] == want and 120 < len(set(want)) < 170


def test_components_of_a_group_around_the_threshold(spark):
    """One text edited everywhere, so that its copies are on both sides of the threshold to each other; and odd rows."""
    r = random.Random(16)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    texts = []
    for k in range(150):
        near = list(base)
        for at in r.sample(range(120), r.randrange(1, 5)):
            near[at] = f"e{r.randrange(50)}"
        texts.append(" ".join(near))
    want = plain(texts)
    rows = [(k, x) for k, x in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (None, None), (900, ""), (901, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for cell_rows in (1024, 8):
        got = [(g["doc_id"], g["component_id"]) for g in nearcopies.components(df, cell_rows=cell_rows).collect()]
        own = dict(got)
        assert len(got) == len(rows) and [own[k] for k in range(150)] == want and own[900] == own[901] == 900
        assert sorted(c for k, c in got if k is None) == sorted([want[3], 900])
    assert nearcopies.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [1024, 32])
def test_a_large_group_meets_once(spark, monkeypatch, cell_rows):
    """Texts of one group share dozens of lists; a pair of them meets in one, and as many links are found as by brute force."""
    r = random.Random(8)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    texts = []
    for _ in range(240):
        near = list(base)
        for at in r.sample(range(120), r.randrange(2, 6)):
            near[at] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(near))
    rows = []
    cut = nearcopies.cut

    def counted(df):
        out = cut(df)
        if {"p", "q"} <= set(out.columns):
            rows.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "cut", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {g["doc_id"]: g["component_id"] for g in nearcopies.components(df, cell_rows=cell_rows).collect()}
    want = plain(texts)
    assert [got[k] for k in range(240)] == want and len(set(want)) > 20
    assert max(rows) <= 240 * (2 if cell_rows == 1024 else 16)


@pytest.mark.parametrize("rows", [1, 3, 7, 50, 1000])
def test_lists_stream_through(rows):
    """Lists cut by batches anywhere, short and long: who stays, their hub and their distance from it."""
    r = random.Random(rows)
    listed = []
    for key in range(60):
        word = r.getrandbits(64)
        for cls in sorted(r.sample(range(1000), r.choice([1, 2, 3, 15, 16, 17, 40]))):
            listed.append((key, cls, word ^ r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64) if r.random() < 0.5 else r.getrandbits(64)))
    want = []
    for key in range(60):
        own = [x for x in listed if x[0] == key]
        for _, cls, word in own:
            if len(own) > nearcopies._SHORT or any(c != cls and (word ^ w).bit_count() <= nearcopies.MOST_BITS for _, c, w in own):
                want.append((key, cls, own[0][1], (word ^ own[0][2]).bit_count()))
    columns = [pa.array([x[0] for x in listed]), pa.array([x[1] for x in listed]), pa.array(np.array([x[2] for x in listed], np.uint64).view(np.int64))]
    batch = pa.RecordBatch.from_arrays(columns, ["list", "cls", "word"])
    got = [tuple(row[c] for c in ("list", "cls", "hub", "bits")) for b in nearcopies._met(batch.slice(k, rows) for k in range(0, len(listed), rows)) for row in b.to_pylist()]
    assert got == want


def test_texts_of_different_roots_share_a_cell(spark):
    r = random.Random(2)
    rows = [(lst, cls, r.choice([1, 1, 1, 2, 3, cls])) for lst in range(4) for cls in range(10, 10 + r.randrange(1, 60))]
    df = spark.createDataFrame([(*x, 0) for x in rows], "list long, cls long, root long, word long")
    cells = {}
    for c in nearcopies._cells(df, 7).collect():
        cells.setdefault((c["list"], c["p"], c["q"]), []).append((c["cls"], c["root"]))
    met = {(k[0], a, b) for k, own in cells.items() for a, x in own for b, y in own if x != y}
    assert met == {(lst, a, b) for lst, a, x in rows for other, b, y in rows if lst == other and x != y}
    assert max(map(len, cells.values())) <= 40


@pytest.mark.parametrize("key_bytes", [2, 3])
def test_recall_of_the_index(key_bytes):
    """Shingle sets just at 0.8, swapped and grown: nearly all share a list, near first words and enough bytes."""
    rng = np.random.default_rng(5)
    groups, count = nearcopies.groups_of(key_bytes), nearcopies.GROUPS[key_bytes]
    for shared, a_only, b_only in ((40, 5, 5), (240, 30, 30), (240, 0, 60), (800, 100, 100)):
        hit = 0
        for _ in range(250):
            x = rng.integers(0, 1 << 64, shared + a_only + b_only, np.uint64)
            (fa, pa), (fb, pb) = (nearcopies.fingerprint(own, groups, count) for own in (x[: shared + a_only], np.concatenate((x[:shared], x[shared + a_only :]))))
            lists = any((fa[groups[g]] == fb[groups[g]]).all() for g in np.intersect1d(pa, pb))
            words = [f[:8].view(np.uint64)[None] for f in (fa, fb)]
            hit += bool(lists and nearcopies.near_bytes(fa, fb) and nearcopies.near_bits(*words)[()].all())
        assert hit >= 0.97 * 250


def test_stage_drops_edited_copies(spark):
    rows = [(k, x, "en", "s", 1) for k, x in enumerate(edited())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert got == sorted(set(plain(edited())))
