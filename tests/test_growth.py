"""Work that follows what is different and not the rows, seen in plans, and the same results on either way of joining."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import composition
from lodestone.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fn_assign_oxidation", "fn_cation_fit", "fn_comp_error", "fn_diff_elements", "fn_foreign_fraction", "join_formula_similarity", "fn_format_amount"])
def test_formulas_are_read_once(spark, name):
    """Rows are never sent to every task, and formulas aren't parsed row by row."""
    text = plan(QUERIES[name](spark, SF))
    assert "BuildLeft" not in text and "regexp_extract_all" not in text


def test_either_way_of_meeting(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "FeSe", 1), (2, "FeSe", None), (3, None, 1), (4, "CuO", 2), (5, None, None)], "id int, f string, p int")
    tell = lambda d: d.filter("p IS NULL OR p < 2").select("f", "p", F.explode(F.array(F.length("f"), F.lit(0))).alias("n"))
    small = sorted(map(str, composition.once(rows, ["f", "p"], tell).collect()))
    monkeypatch.setattr(composition, "SENT", 0)
    large = composition.once(rows, ["f", "p"], tell)
    assert "BroadcastHashJoin" not in plan(large)
    assert sorted(map(str, large.collect())) == small and len(small) == 8


@pytest.mark.parametrize("name", ["audit_nine", "audit_classify", "audit_doping", "audit_ferrite"])
def test_audits_judge_compositions_once(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "BuildLeft" not in text and "regexp_extract_all" not in text


def test_angles_and_statistics_travel_as_lines(spark):
    """One shuffle by structure for the 41 statistics and the angles of a node, and no array functions that are interpreted."""
    assert plan(QUERIES["agg_descriptors41"](spark, SF)).count("Exchange hashpartitioning") + plan(QUERIES["agg_descriptors41"](spark, SF)).count("REPARTITION_BY_COL") <= 2
    assert "partial_stddev_pop" not in plan(QUERIES["agg_descriptors41"](spark, SF)).split("Exchange")[1]
    assert plan(QUERIES["agg_dihedral_node"](spark, SF)).count("Exchange") == 1
    angles = plan(QUERIES["agg_angle_rbf_mean"](spark, SF))
    assert "posexplode" not in angles.split("Exchange")[-1]
    assert "lambda" not in plan(QUERIES["fn_min_image"](spark, SF))


def test_site_lists_are_the_sites():
    from lodestone.sources import crystal

    text = "data_x\nloop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_occupancy\n'Cu 1' 0.5(2) ?\nO1 . 0.25\n"
    texts = [text, None, "data_y", text.replace("Cu", "9"), ""]
    assert crystal._site_lists(texts).to_pylist() == [crystal.sites(x) for x in texts]
    assert crystal.sites(text)[0] == {"label": "Cu 1", "element": "Cu", "x": 0.5, "y": None, "z": None, "occupancy": 1.0, "multiplicity": 1}


def test_cif_texts_are_read_once(spark):
    assert plan(QUERIES["scan_cif_sites"](spark, SF)).count("MapInArrow") == 1


def test_values_without_ones_own(spark):
    """Medians and ranges around a point, against lists; own values never meet all of those around."""
    import random
    import statistics

    from lodestone.operators import neighbourhoods

    r = random.Random(5)
    lists = {p: [r.randrange(8) / 2 for _ in range(r.randint(1, 9))] for p in range(60)}
    around = spark.createDataFrame([(p, v, x.count(v)) for p, x in lists.items() for v in set(x)], "point long, value double, k long")
    found = neighbourhoods.without_own(around, around.select("point", F.col("value").alias("own")))
    want = {}
    for p, x in lists.items():
        for v in set(x):
            rest = list(x)
            rest.remove(v)
            if rest:
                want[p, v] = (len(rest), statistics.median(rest), min(rest), max(rest))
    assert {(x["point"], x["own"]): (x["n"], x["around"], x["low"], x["high"]) for x in found.collect()} == want


def test_first_batch_wins(spark):
    """The smallest of the first batch stands, though a later batch has a smaller one; no key goes through Python."""
    from lodestone.streaming import stateful

    rows = [[(1, "a", 5), (1, "a", 4), (2, "b", 9)], [(1, "a", 1), (2, "c", 7), (None, "c", 3)], [(2, "b", 2), (2, "c", 8)]]
    parts = [spark.createDataFrame(x, "user_id long, event_type string, event_id long") for x in rows]
    got = stateful.first_wins(spark, parts, ["user_id", "event_type"], "event_id").collect()
    assert {tuple(x) for x in got} == {(1, "a", 4), (2, "b", 9), (2, "c", 7), (None, "c", 3)} and len(got) == 4
