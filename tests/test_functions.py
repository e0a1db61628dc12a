"""Functions without SQL of the same result, against plain forms of them."""

import io
import itertools
import lzma
import random
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.functions import chemistry, composition, spectra
from lodestone.operators import reports, windows
from lodestone.queries import QUERIES
from lodestone.registry import table
from lodestone.sources import files

SF = "/root/testdata/sf0.001"


def vectors(spark):
    rows = table(spark, SF, "embeddings").collect()
    return {r["vec_id"]: np.array(r["embedding"], float) for r in rows}, {r["vec_id"]: float(r["label"]) for r in rows}


def test_sublattice_fit():
    assert chemistry.sublattice_fit({"O": 4}, {"La": 1}) == 9.9 and chemistry.sublattice_fit({"La": 2}, {"La": 1, "Cu": 1}) == 0.1
    assert chemistry.sublattice_fit({"La": 2, "Cu": 1}, {"Sr": 4, "Ni": 2, "O": 1}) == pytest.approx(0)
    assert chemistry.sublattice_fit({"La": 1.85, "Sr": 0.15, "Cu": 1}, {"La": 2, "Cu": 1}) == pytest.approx(0.2)
    r = random.Random(3)
    for _ in range(40):  # against every way of joining, one at a time
        ours, theirs = ({e: r.randrange(1, 9) for e in r.sample(["La", "Sr", "Cu", "Ni", "Ba", "Y"], r.randrange(1, n))} for n in (7, 5))
        a, b = (sorted((x / sum(c.values()) for x in c.values()), reverse=True) for c in (ours, theirs))
        if len(a) < len(b):
            continue
        every = []
        for way in itertools.product(range(len(b)), repeat=len(a) - len(b)):
            sums = [x + sum(y for y, k in zip(a[len(b) :], way) if k == i) for i, x in enumerate(a[: len(b)])]
            every.append(sum(abs(x - y) for x, y in zip(sorted(sums, reverse=True), b)))
        assert chemistry.sublattice_fit(ours, theirs) == pytest.approx(min(every) + 0.2 * (len(a) - len(b)))


def test_subshells(spark):
    # Z, charge and outer electrons in s, p, d and f.
    for z, charge, want in [(1, 0, [1, 0, 0, 0]), (1, 3, [0, 0, 0, 0]), (8, 0, [2, 4, 0, 0]), (10, 0, [2, 6, 0, 0]), (26, 0, [2, 0, 6, 0]), (26, 3, [0, 0, 5, 0]), (60, 3, [0, 0, 0, 3]), (83, 3, [2, 0, 10, 14]), (29, 0, [1, 0, 10, 0]), (29, 2, [0, 0, 9, 0]), (41, 0, [1, 0, 4, 0]), (79, 0, [1, 0, 10, 14]), (8, -2, [2, 6, 0, 0]), (46, 0, [0, 0, 10, 0])]:
        assert chemistry.subshells(z, charge) == want
    blocks, counts = {z: block for _, z, block, *_ in chemistry.atoms()}, {z: n for _, z, _, n, *_ in chemistry.atoms()}
    assert [counts[z] for z in (1, 3, 8, 26, 29, 56, 57, 60, 72, 83)] == [1, 1, 3, 5, 8, 2, 0, 0, 1, 2]
    assert len(blocks) == 118 and [blocks[z] for z in (3, 8, 20, 26, 30, 31, 60, 83)] == ["s", "p", "s", "d", "d", "p", "f", "p"]


def test_parse_edge_cases(spark):
    df = spark.createDataFrame([(None,), ("",), ("La2(CuO4)",), ("La2CuO-y",), ("O1.2.3",), ("Cu2Cu1",)], "f string")
    assert [r[0] for r in df.select(composition.parse(F.col("f"))).collect()] == [None, None, None, None, None, {"Cu": 3.0}]


def test_nested_formulas(spark):
    rows = {"La2(CuO4)": {"La": 2, "Cu": 1, "O": 4}, "Ca[Al(OH)4]2": {"Ca": 1, "Al": 2, "O": 8, "H": 8}, "(NH4)2SO4": {"N": 2, "H": 8, "S": 1, "O": 4}, "Cu(": None, "Cu)": None, "": None, "cu": None, "Cu1.2.3": None}
    df = spark.createDataFrame([*[(k,) for k in rows], (None,)], "f string").withColumn("c", chemistry.parse_nested(F.col("f")))
    assert {r["f"]: r["c"] for r in df.collect()} == rows | {None: None}


def test_density_on_grid():
    one = lambda x, level: spectra.densities(np.array([x]), np.array([level]), -10, 5, 128, 0.3)[0]
    assert one([1.0], 0.0) is None and one(np.ones(9), np.nan) is None and one(np.ones(9), 100.0) is None
    assert one(np.ones(200), 50.0) == pytest.approx(np.ones(128))  # smoothing loses nothing at the edges
    r = np.random.default_rng(4)
    x, level, grid = r.standard_normal((7, 30)), r.uniform(-3, 12, 7), np.linspace(-10, 5, 128)
    for row, at, got in zip(x, level, spectra.densities(x, level, -10, 5, 128, 0.3), strict=True):
        plain = np.interp(grid + at, np.arange(30) * 0.5, row, left=0.0, right=0.0)
        near = np.array([[np.exp(-((a - b) ** 2) / 0.18) if abs(a - b) <= 0.9 + 1e-9 else 0.0 for b in grid] for a in grid])
        assert got == pytest.approx(np.maximum(near @ plain / near.sum(axis=1), 0))


def test_bin_means_keep_the_integral():
    x = np.arange(4001) * 0.002
    y = np.exp(-((x - 3) ** 2))
    assert (spectra.bin_weights(4001, 0.002, 16, 8.0) @ y).sum() * 0.5 == pytest.approx(np.trapezoid(y, x), rel=1e-3)
    w = spectra.bin_weights(5, 0.5, 4, 8.0)  # data end at 2
    assert not w[1:].any() and w[0].sum() == pytest.approx(1)


def test_gram_rank_whitening_and_ridge(spark):
    v, label = vectors(spark)
    x = np.stack(list(v.values()))
    n, sums, g = spectra.gram(table(spark, SF, "embeddings").repartition(5), "embedding")
    assert n == len(v) and g[:-2, :-2] == pytest.approx(x.T @ x) and sums[:-2] == pytest.approx(x.sum(axis=0))
    s = np.linalg.svd(x, compute_uv=False) ** 2
    assert QUERIES["fn_eff_rank"](spark, SF).first()["eff_rank"] == next(k for k in range(1, 65) if s[:k].sum() >= 0.9 * s.sum())
    pcs = np.array([r[1:] for r in QUERIES["fn_pca_whiten"](spark, SF).collect()])
    assert np.cov(pcs.T) == pytest.approx(np.eye(4), abs=1e-4)  # by n - 1

    train = [k for k in v if k % 5]
    a = np.hstack([np.stack([v[k] for k in train]), np.ones((len(train), 1))])
    y, shrink = np.array([label[k] for k in train]), np.eye(65)
    shrink[64, 64] = 0
    fits = {p: np.linalg.solve(a.T @ a + p * shrink, a.T @ y) for p in (0.1, 1.0, 10.0, 100.0)}
    say = lambda w, k: v[k] @ w[:-1] + w[-1]
    best = min(fits, key=lambda p: np.mean([abs(say(fits[p], k) - label[k]) for k in v if k % 5 == 0]))
    for r in QUERIES["fn_ridge"](spark, SF).collect():
        assert r["alpha"] == best and r["pred"] == pytest.approx(np.clip(say(fits[best], r["vec_id"]), y.min(), y.max()), abs=1e-4)


def test_gram_of_nothing(spark):
    n, _, g = spectra.gram(spark.createDataFrame([(None,)], "v array<float>"), "v")
    assert n == 0 and g.size == 0 and spectra.effective_rank(np.zeros((3, 3)), 0.9) == 0


def test_bootstrap_interval(spark):
    r = QUERIES["agg_bootstrap_paired"](spark, SF).first()
    d = [e["d"] for e in reports.estimates(spark, SF).select((F.abs(F.col("p") - F.col("y")) - F.abs(F.col("q") - F.col("y"))).alias("d")).collect()]
    half = 1.96 * np.std(d) / len(d) ** 0.5
    assert r["mean"] == pytest.approx(np.mean(d)) and r["low"] == pytest.approx(r["mean"] - half, abs=0.3 * half) and r["high"] == pytest.approx(r["mean"] + half, abs=0.3 * half)


def test_batches_are_cut_where_they_must(spark):
    rows = QUERIES["win_size_grouped_batches"](spark, SF).collect()
    assert len({r["l_orderkey"] for r in rows}) == len(rows) == table(spark, SF, "lineitem").select("l_orderkey").distinct().count()
    batches = {}
    for r in sorted(rows, key=lambda r: (r["pool"], r["batch"], r["size"], r["l_orderkey"])):
        batches.setdefault((r["pool"], r["batch"]), []).append(r["size"])
    assert all(len(b) <= 8 and (sum(b) <= 40 or len(b) == 1) for b in batches.values())
    for (p, k), b in batches.items():
        after = batches.get((p, k + 1))
        assert after is None or len(b) == 8 or sum(b) + after[0] > 40


def test_guards(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None)], "id long, a double, b double")
    assert reports.drop_empty_columns(df, ["a", "b"]).columns == ["id", "a"]
    with pytest.raises(PySparkException, match="no value"):
        reports.require(df, F.col("a").isNotNull(), "no value").collect()
    assert reports.require(df, F.col("id") > 0, "x").count() == 2
    assert reports.stacked([df, df.select("id", F.lit("x").alias("c"))]).columns == ["id", "a", "b", "c"]


def test_archive_headers(spark, tmp_path):
    for k, body in enumerate(["a: 1\nb: two\nrest:\n- 5\n", "b: 3\n", None]):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("x/p.yaml.xz" if body else "other", lzma.compress((body or "").encode()))
        (tmp_path / f"{k}.zip").write_bytes(raw.getvalue())
    got = files.read_header_fields(spark.read.format("binaryFile").load(str(tmp_path)), "p.yaml.xz", ["a", "b"]).collect()
    assert sorted((r["path"][-5:], r["a"], r["b"]) for r in got) == [("0.zip", "1", "two"), ("1.zip", None, "3"), ("2.zip", None, None)]


def test_smooth_guide_is_a_line(spark):
    rows = sorted(QUERIES["win_smooth_guide"](spark, SF).collect())
    assert len(rows) == 300 and all(r["y"] >= 0 for r in rows) and len({round(b["x"] - a["x"], 4) for a, b in itertools.pairwise(rows)}) == 1


def test_deal_by_single_steps():
    """The runs of the greedy split against giving the groups one at a time."""
    r = random.Random(11)
    for _ in range(200):
        sizes = [(n, r.randrange(1, 30)) for n in r.sample(range(1, 40), r.randrange(1, 8))]
        ratios = dict(zip(windows.SPLITS, r.choice([(0.1, 0.1, 0.8), (0.25, 0.25, 0.5), (0.3, 0.5, 0.2)])))
        lack = {s: ratios[s] * sum(n * c for n, c in sizes) for s in windows.SPLITS}
        given = []
        for n, count in sorted(sizes, reverse=True):
            for k in range(count):
                s = max(windows.SPLITS, key=lambda x: lack[x])
                lack[s] -= n
                given.append((n, k, s))
        runs = windows.deal(sizes, ratios)
        assert [(n, k, turns[(k - lo) % len(turns)]) for n, lo, hi, turns in runs for k in range(lo, hi)] == given
