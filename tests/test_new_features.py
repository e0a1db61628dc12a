"""Features that SQL can't show whole: runs that break off, plans, brute force over small cases, and the stated golden results."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import doping, oxidation
from lodestone.functions.composition import parse
from lodestone.operators import frameworks, neighbourhoods, runs
from lodestone.registry import scratch
from lodestone.sources import crystal, harvest, paged
from lodestone.streaming import stateful

SF = "/root/testdata/sf0.001"


def test_oxidation_of_known_superconductors(spark):
    golden = [
        ("La2CuO4", "La2CuO4", "Cu", 2.0), ("La1.85Sr0.15CuO4", "La2CuO4", "Cu", 2.15), ("Nd1.85Ce0.15CuO4", "Nd2CuO4", "Cu", 1.85), ("Y1Ba2Cu3O7", "Y1Ba2Cu3O7", "Cu", 2.333), ("Y1Ba2Cu3O6.9", "Y1Ba2Cu3O7", "Cu", 2.267),
        ("Bi2Sr2Ca1Cu2O8", "Bi2Sr2Ca1Cu2O8", "Cu", 2.0), ("Ba1Fe2As2", "Ba1Fe2As2", "Fe", 2.0), ("Mg1B2", "Mg1B2", None, None), ("Au0.9Ga0.1", "Au1Ga1", None, None),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, *_) in enumerate(golden)], "id int, f string, parent string")
    rows = df.select("id", "parent", parse(F.col("f")).alias("comp"), parse(F.col("parent")).alias("pcomp"))
    got = {r["id"]: r["ox"] for r in oxidation.with_oxidation(rows).collect()}
    for k, (_, _, redox, state) in enumerate(golden):
        assert got[k]["redox"] == redox and (state is None or round(got[k]["redox_state"], 3) == state)
        assert got[k]["source"] == ("intermetallic" if redox is None else "redox_balance")


def test_balance_against_all_combinations(spark):
    r, names = random.Random(4), list(oxidation.COMMON)
    comps = [{e: float(r.randint(0, 4)) for e in [*r.sample(names, r.randint(1, 4)), *r.sample(["O", "S", "N", "C", "As", "Te"], 2)]} for _ in range(300)] + [{}, {"Xx": 1.0, "O": 1.0}, {"Cu": 0.4, "O": 0.3}]

    def best(comp):
        parts = sorted((e, round(n)) for e, n in comp.items() if round(n) > 0)
        if not parts or any(e not in oxidation.COMMON for e, _ in parts):
            return None
        ways = [(sum(k for k, _ in w), [s for _, s in w]) for w in itertools.product(*[list(enumerate(oxidation.COMMON[e])) for e, _ in parts]) if sum(n * s for (_, n), (_, s) in zip(parts, w, strict=True)) == 0]
        return dict(zip([e for e, _ in parts], min(ways)[1], strict=True)) if ways else None

    df = spark.createDataFrame([(k, c) for k, c in enumerate(comps)], "id int, comp map<string,double>")
    got = {x["id"]: x["b"] for x in df.select("id", oxidation.balance(F.col("comp")).alias("b")).collect()}
    assert [got[k] for k in range(len(comps))] == [best(c) for c in comps] and sum(x is not None for x in got.values()) > 15


def vertices(cost, allowed, supply, least, most):
    """The least cost over all vertices, with slack variables for both bounds of a site; None without any."""
    e, p = cost.shape
    cells = [(i, j) for i in range(e) for j in range(p) if allowed[i, j]]
    a = [[float(c[0] == i) for c in cells] + [0.0] * 2 * p for i in range(e)]
    a += [[float(c[1] == j) for c in cells] + [float(k == j) for k in range(p)] + [0.0] * p for j in range(p)]
    a += [[float(c[1] == j) for c in cells] + [0.0] * p + [-float(k == j) for k in range(p)] for j in range(p)]
    a, b, price = np.array(a), np.array([*supply, *most, *least]), np.array([cost[c] for c in cells] + [0.0] * 2 * p)
    best = None
    for basis in itertools.combinations(range(a.shape[1]), len(a)):
        m = a[:, basis]
        if abs(np.linalg.det(m)) > 1e-9 and (x := np.linalg.solve(m, b)).min() >= -1e-9:
            best = min(best, price[list(basis)] @ x) if best is not None else price[list(basis)] @ x
    return best


def test_transport_against_vertices():
    r, feasible = np.random.default_rng(1), 0
    for _ in range(80):
        e, p = r.integers(1, 4), r.integers(1, 3)
        cost, allowed, most = r.random((e, p)).round(2), r.random((e, p)) < 0.8, r.integers(1, 4, p) * 1.0
        least, s = most * r.choice([0, 0.5, 0.9], p), r.random(e)
        s = s / s.sum() * most.sum() * r.choice([0.95, 0.7, 1.0])
        flows, full = doping.transport(cost[None], allowed[None], s[None], least[None], most[None])
        want = vertices(cost, allowed, s, least, most)
        assert bool(full[0]) == (want is not None)
        if want is not None:
            feasible += 1
            assert abs((flows[0] * cost).sum() - want) < 1e-6 and np.allclose(flows[0].sum(axis=1), s)
    assert feasible > 20


def test_doping_shares(spark):
    rows = [("La1.85Sr0.15Cu0.875Ni0.125O4", 1, "La2CuO4"), ("YBa2Cu3O6.9", 2, "YBa2Cu3O7"), ("LaCuO2", 3, "YCu9O7"), ("NbTi", 4, "MgB2"), ("FeSe", 5, "O2"), (None, 6, "FeSe")]
    df = spark.createDataFrame(rows, "formula string, parent long, p string").select("formula", "parent", parse(F.col("formula")).alias("comp"), parse(F.col("p")).alias("pcomp"))
    got = doping.shares(df).collect()
    of = lambda k: {(r["sublattice"], r["element"]): round(r["occupancy"], 6) for r in got if r["parent"] == k and r["element"]}
    assert of(1) == {("Cu", "Cu"): 0.875, ("Cu", "Ni"): 0.125, ("La", "La"): 0.925, ("La", "Sr"): 0.075, ("O", "O"): 1.0}
    assert of(2) == {("Y", "Y"): 1.0, ("Ba", "Ba"): 1.0, ("Cu", "Cu"): 1.0, ("O", "O"): 0.985714}
    assert {r["parent"]: r["outcome"] for r in got if r["element"] is None} == {3: "no feasible site distribution", 4: "no shared element", 5: "no shared element"}
    assert all(r["residual"] < 1e-9 for r in got if r["element"])


def test_equivalence_against_all_permutations(spark):
    def canon(labels, edges):
        n = len(labels)
        return min((tuple(labels[p.index(i)] for i in range(n)), tuple(sorted((min(p[a], p[b]), max(p[a], p[b]), w) for a, b, w in edges))) for p in itertools.permutations(range(n)))

    r = random.Random(2)
    ring = lambda at, n: [(at + k, at + (k + 1) % n, 0) for k in range(n)]
    rows = [(k, [r.randint(0, 1) for _ in range(n)], [(r.randrange(n), r.randrange(n), r.randint(0, 1)) for _ in range(r.randint(0, 5))] if n else []) for k in range(120) for n in [r.randint(0, 5)]]
    mixed = [3, 1, 5, 0, 2, 4]
    for k, edges in enumerate((ring(0, 6), ring(0, 3) + ring(3, 3))):  # which refinement alone can't tell apart
        rows += [(1000 + k, [1] * 6, edges), (2000 + k, [1] * 6, [(mixed[a], mixed[b], w) for a, b, w in edges])]
    first, want = {}, {}
    for k, labels, edges in rows:
        want[k] = first.setdefault(canon(labels, edges), k)
    df = spark.createDataFrame([(k, labels, [x for e in edges for x in e]) for k, labels, edges in rows] + [(5000, None, None)], "id long, labels array<int>, ends array<int>")
    assert {x["id"]: x["class_id"] for x in frameworks.equivalence(df).collect()} == want
    assert frameworks.equivalence(df.limit(0)).count() == 0


def test_points_within_reach(spark):
    """Every pair within reach is found, at the bound and on the edges of cells too."""
    r = random.Random(3)
    points = [(b, b * 100 + k, [x, 1 - x - y, y] if b else [x, 1 - x]) for b in (0, 1) for k in range(60) for x, y in [(r.randrange(40) / 200, r.randrange(40) / 200)]]
    df = spark.createDataFrame(points, "block long, point long, vec array<double>")
    got = {(x["a"], x["b"]) for x in neighbourhoods.within(df, 0.03).collect()}
    near = lambda u, v: round(sum(abs(p - q) for p, q in zip(u, v, strict=True)), 9) <= 0.03
    assert got == {(a, b) for x, a, u in points for y, b, v in points if x == y and near(u, v)}


def test_pages_that_are_asked(spark):
    """The filter goes to the service, what it can't be asked stays with Spark, and a limit looks at no more pages than it takes."""
    pages = paged.read_pages(spark, f"{SF}/part.parquet", "p_partkey long, p_retailprice double, p_name string", 20)
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert pages.rdd.getNumPartitions() == -(-part.count() // 20)
    condition = "p_retailprice >= 905 AND p_partkey NOT IN (3, 5) AND (p_name LIKE '%a%') AND length(p_name) > 3"
    assert pages.filter(condition).count() == part.filter(condition).count()
    reader = paged.PagedReader(pages.schema, {"path": f"{SF}/part.parquet", "page_rows": "10", "limit": "25"})
    from pyspark.sql.datasource import GreaterThan

    class Odd(GreaterThan):
        pass

    assert list(reader.pushFilters([GreaterThan(("p_partkey",), 7), GreaterThan(("a", "b"), 1), Odd(("p_partkey",), 1)]))[0].attribute == ("a", "b")
    assert reader.asked == ["GreaterThan(attribute=('p_partkey',), value=7)"]
    asked = reader.partitions()
    assert [p.most for p in asked] == [2, 10, 10, 3] and sum(b.num_rows for p in asked for b in reader.read(p)) == 25
    plan = pages.filter("p_retailprice >= 905")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan  # the service answers for it


def test_a_harvest_that_breaks_off_goes_on(spark):
    """After k chunks the service is gone; the next run asks only for the ids of the other chunks."""
    ids, folder, asked = spark.range(200).select("id"), scratch(spark), spark.sparkContext.accumulator(0)

    def service(breaks):
        def fetch(own):
            n = own.count()
            asked.add(n)
            if breaks and asked.value > 90:
                return own.withColumn("price", F.raise_error("gone").cast("double"))
            return own.withColumn("price", F.col("id").cast("double"))

        return fetch

    broken = harvest.harvest(ids, service(True), folder, "id long, price double", 8)
    done = harvest.banked(spark, folder, "id long, price double").count()
    assert 0 < done < 200 and 0 < len(broken) < 8 and all("gone" in b for b in broken)
    before = asked.value
    assert harvest.harvest(ids, service(False), folder, "id long, price double", 8) == []
    assert asked.value - before == 200 - done
    got = harvest.banked(spark, folder, "id long, price double")
    assert got.count() == got.select("id").distinct().count() == 200
    before = asked.value
    assert harvest.harvest(ids, service(True), folder, "id long, price double", 8) == [] and asked.value == before


def test_settling_touches_only_its_buckets(spark):
    target, schema = scratch(spark), "id long, outcome string, bucket int"
    first = spark.range(50).select("id", F.lit("a").alias("outcome"))
    assert harvest.settle(first, target, 8) == list(range(8))
    files = lambda: {r["f"]: r["n"] for r in spark.read.parquet(target).select(F.input_file_name().alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()}
    before = files()
    touched = harvest.settle(spark.createDataFrame([(3, "b"), (70, "b"), (4, "gone")], "id long, outcome string"), target, 8, "outcome = 'gone'")
    assert 1 <= len(touched) <= 3 and len(set(before) & set(files())) >= 8 - len(touched)
    state = {r["id"]: r["outcome"] for r in harvest.settled(spark, target, schema).collect()}
    assert state == {k: "b" if k == 3 else "a" for k in range(50) if k != 4} | {70: "b"}
    assert harvest.settle(first.limit(0), target, 8) == []


def test_a_breaker_ends_the_stream(spark):
    rows = lambda ids, bad: spark.createDataFrame([(1, k, bad(k)) for k in ids] + [(2, 1000 + k, k % 3 > 0) for k in ids], "worker long, event_id long, bad boolean")
    fails = [rows(range(15), lambda k: k > 1), rows(range(15, 30), lambda k: True)]
    assert stateful.aborts(spark, fails, 25) is not None and "worker 1 failed 25 times in a row at 26" in stateful.aborts(spark, fails, 25)
    reset = [fails[0], rows(range(15, 30), lambda k: k != 20)]
    assert stateful.aborts(spark, reset, 25) is None


def test_small_gains_add_up(spark):
    """Gains of 1e-7 an epoch don't count one by one; a running minimum would never stop."""
    slow, good = [(k, 1 - k * 1e-7) for k in range(40)], [(k, 1 - k * 1e-2) for k in range(40)]
    df = spark.createDataFrame([("slow", slow), ("good", good), ("one", [(0, 5.0)])], "run string, e array<struct<epoch long, val double>>")
    got = {r["run"]: tuple(r["s"]) for r in df.select("run", runs.stopped(F.col("e"), 8).alias("s")).collect()}
    assert got["slow"] == (True, 9, 1.0, 0) and got["good"][:2] == (False, 40) and got["one"] == (False, 1, 5.0, 0)
    assert {r["run"]: r["s"]["epochs"] for r in df.select("run", runs.stopped(F.col("e"), 12).alias("s")).collect()}["slow"] == 40  # eleven epochs gain enough to count


@pytest.mark.parametrize("text,want", [
    ("data_x\nloop_\n_atom_site_label\n_atom_site_occupancy\nCu1 0.5(2)\n'O 1' ?\nFe2\n", [("Cu", 0.5), ("O", 1.0)]),
    ("# loop_ in a comment\nloop_\n_other\n1 2\nloop_\n_atom_site_type_symbol\n_atom_site_fract_x\nNd3+ .25\nBa2+ 1/3\n_cell_volume 1", [("Nd", 1.0), ("Ba", 1.0)]),
    ("_text\n;\nloop_\n_atom_site_label\nX1\n;\n", None), (None, None), ("", None),
])
def test_loops_of_sites(text, want):
    got = crystal.sites(text)
    assert (None if got is None else [(s["element"], s["occupancy"]) for s in got]) == want


def test_composition_from_sites(spark):
    text = "data_x\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_occupancy\n_atom_site_symmetry_multiplicity\nY1 Y3+ 1 1\nBa1 Ba2+ 1 2\nCu1 Cu2+ 1 1\nCu2 Cu2+ 1 2\nO1 O2- 0.9 7\n? ? 1 1\n"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y")], "id int, value string, sites_of string")
    got = {r["id"]: r for r in crystal.read_cif_sites(df).collect()}
    assert {k: round(v, 6) for k, v in got[1]["comp"].items()} == {"Y": 1.0, "Ba": 2.0, "Cu": 3.0, "O": 6.3} and got[1]["sites_of"] == "x"
    assert got[2]["sites"] is None and got[2]["comp"] is None


def test_counted_drops_in_order(spark):
    df = spark.range(100)
    kept, seen = harvest.counted(df, {"even": F.col("id") % 2 == 0, "small": F.col("id") < 10, "null": F.lit(None).cast("boolean")})
    assert kept.count() == 45 and dict(seen.get) == {"kept": 45, "even": 50, "small": 5, "null": 0}
    assert Counter(kept.columns) == Counter(["id"])
