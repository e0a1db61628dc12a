"""Parents for formulas without an exact one: four kinds of candidates, each with its own order, and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.chemistry import _SIMILAR, RARE_EARTHS, SYMBOLS, canonical_set, cation_fit, similarity
from lodestone.functions.composition import _LIST, _PAIRED, _PARTS, _POOL, chemsys, parents, subsets, told, whole
from lodestone.registry import ORACLE_SQL, query, written

# Anions of the ratio; metals that form solid solutions; how far apart the ratios of a class may be; the share
# of metal from which something else in it is dilute.
RATIO_ANIONS = ["O", "F", "Cl", "Br", "I", "S", "Se", "Te", "N", "H"]
ALLOYING = (
    "Li Be Na Mg Al K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Th U Ge Si Sb"
).split()
RATIO_CAP, DILUTE = 1.0, 0.97


def anion_ratio(comp: Column) -> Column:
    """Anions for each other atom; null without one."""
    total = lambda of: whole(F.map_filter(comp, of))
    return F.try_divide(total(lambda e, _: e.isin(RATIO_ANIONS)), F.nullif(total(lambda e, _: ~e.isin(RATIO_ANIONS)), F.lit(0.0)))


def centre(comp: Column) -> Column:
    """The element that a family stands on, or null."""
    has = lambda e: F.map_contains_key(comp, e)
    partner = F.arrays_overlap(F.map_keys(comp), F.array(*map(F.lit, ("As", "P", "Se", "Te", "S"))))
    return F.when(has("Cu") & has("O"), "Cu").when(has("Fe") & partner, "Fe").when(has("Ni") & has("O"), "Ni")


def metallic(comp: Column) -> tuple[Column, Column]:
    """(all elements alloy, metal with something dilute in it)."""
    every = F.forall(F.map_keys(comp), lambda e: e.isin(ALLOYING))
    return every, ~every & (whole(F.map_filter(comp, lambda e, _: e.isin(ALLOYING))) / whole(comp) >= DILUTE - 1e-9)


def gate(comp: Column, pcomp: Column) -> Column:
    """Whether a parent has the centre of the family and is of the same class by its anions; metals pass by the centre alone."""
    every, dilute = metallic(comp)
    near = F.coalesce(F.abs(anion_ratio(pcomp) - anion_ratio(comp)) <= RATIO_CAP + 1e-9, F.lit(True))
    return F.coalesce(F.map_contains_key(pcomp, centre(comp)), F.lit(True)) & (every | dilute | near)


def apart(comp: Column, pcomp: Column) -> Column:
    """The step of a parent whose ratio is so far away, 6 and more."""
    every, _ = metallic(comp)
    return F.when(every, 6).otherwise(6 + F.bround(F.coalesce(F.abs(anion_ratio(pcomp) - anion_ratio(comp)), F.lit(0.0)) * 4 + 1e-9).cast("int"))


def candidates(f: DataFrame, pool: DataFrame) -> DataFrame:
    """(formula, parent, swapped, step, second, third) of every candidate of formulas (formula, comp) in a pool (parent, pcomp).

    Gated parents of a subset of the elements: by tier of similarity (steps 1 to 3, then the difference), and as a last
    resort by how far their anions are away (6 and more, then the fit of the cations, then how many elements they lack).
    For metals, and metals with something dilute, also the element's own lattice, the majority's first (4, 5). Gated
    parents that match once rare earths are one token, and have one that the target lacks, are ``swapped`` (6 and more).
    """
    f = f.select("formula", "comp", F.explode(subsets(F.map_keys("comp"))).alias("s")).hint("merge")
    pool = pool.filter(F.size("pcomp") >= 1)
    key = lambda c: chemsys(F.col(c))
    own = f.join(pool.select("parent", "pcomp", key("pcomp").alias("s")), "s").filter(gate(F.col("comp"), F.col("pcomp")))
    lacking = F.size("comp") - F.size("pcomp")
    tier, total = similarity(F.col("comp"), F.col("pcomp"))
    fit = F.round(cation_fit("comp", "pcomp"), 2)
    of = lambda df, swapped, step, second, third: df.select("formula", "parent", F.lit(swapped).alias("swapped"), step.cast("int").alias("step"), second.cast("double").alias("second"), third.cast("int").alias("third"))
    tiers = of(own.withColumn("tier", tier).filter("tier IS NOT NULL"), False, F.col("tier"), F.round(F.round(total, 6), 5), F.lit(0))
    fallback = of(own, False, apart(F.col("comp"), F.col("pcomp")), fit, lacking)
    every, dilute = metallic(F.col("comp"))
    metal = F.map_filter("comp", lambda e, _: e.isin(ALLOYING))
    major = F.array_max(F.transform(F.map_entries(metal), lambda e: F.struct(e["value"].alias("n"), (-F.array_position(F.array(*map(F.lit, SYMBOLS)), e["key"])).alias("z"), e["key"].alias("e"))))["e"]
    alloys = f.dropDuplicates(["formula"]).filter(every | dilute).select("formula", major.alias("major"), F.map_keys(metal).alias("es")).select("formula", "major", F.explode("es").alias("s"))
    elements = of(alloys.join(pool.filter(F.size("pcomp") == 1).select("parent", key("pcomp").alias("s")), "s"), False, F.when(F.col("s") == F.col("major"), 4).otherwise(5), F.lit(1.0), F.lit(0))
    rare = F.array(*map(F.lit, RARE_EARTHS))
    canon = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split("s", "-"), lambda e: F.when(e.isin(RARE_EARTHS), "RE").otherwise(e)))), "-")
    re_f = f.filter(F.arrays_overlap(F.map_keys("comp"), rare)).select("formula", "comp", F.size(F.split("s", "-")).alias("size"), canon.alias("k"))
    swaps = re_f.groupBy("formula", "k").agg(F.first("comp").alias("comp"), F.max("size").alias("size")).join(pool.select("parent", "pcomp", canonical_set(F.col("pcomp")).alias("k")), "k")
    foreign = F.array_except(F.map_keys("pcomp"), F.map_keys("comp"))
    swaps = swaps.filter((F.size(foreign) > 0) & F.forall(foreign, lambda e: e.isin(RARE_EARTHS)) & gate(F.col("comp"), F.col("pcomp")))
    swapped = of(swaps, True, apart(F.col("comp"), F.col("pcomp")), fit, F.size("comp") - F.col("size"))
    return tiers.unionByName(fallback).unionByName(elements).unionByName(swapped)


def lattices(f: DataFrame) -> DataFrame:
    """(parent, pcomp): each element of the formulas as a parent of its own, under its number below zero."""
    each = f.select(F.explode(F.map_keys("comp")).alias("e")).distinct()
    return each.select((-F.array_position(F.array(*map(F.lit, SYMBOLS)), F.col("e"))).cast("long").alias("parent"), F.create_map("e", F.lit(1.0)).alias("pcomp"))


_FITS = ORACLE_SQL["fn_cation_fit"]
_IN = lambda names: "('" + "', '".join(names) + "')"
_KIND = f"""(SELECT id, list(e ORDER BY e) AS es, count(*) AS k, bool_and(e IN {_IN(ALLOYING)}) AS metal, NOT bool_and(e IN {_IN(ALLOYING)}) AND coalesce(sum(n) FILTER (e IN {_IN(ALLOYING)}), 0) / sum(n) >= {DILUTE} - 1e-9 AS dilute,
    coalesce(sum(n) FILTER (e IN {_IN(RATIO_ANIONS)}), 0) / nullif(coalesce(sum(n) FILTER (e NOT IN {_IN(RATIO_ANIONS)}), 0), 0) AS ratio,
    CASE WHEN bool_or(e = 'Cu') AND bool_or(e = 'O') THEN 'Cu' WHEN bool_or(e = 'Fe') AND bool_or(e IN ('As', 'P', 'Se', 'Te', 'S')) THEN 'Fe' WHEN bool_or(e = 'Ni') AND bool_or(e = 'O') THEN 'Ni' END AS centre,
    arg_max(e, (n, -list_position({SYMBOLS!r}, e))) FILTER (e IN {_IN(ALLOYING)}) AS major FROM {_PARTS} GROUP BY id)"""
_SWAPS = f"""(SELECT a.id, p.parent FROM {_KIND} a JOIN {_POOL} p ON len(list_filter(p.pes, lambda e: NOT list_contains(a.es, e))) > 0 AND len(list_filter(p.pes, lambda e: NOT list_contains(a.es, e) AND e NOT IN {_IN(RARE_EARTHS)})) = 0
    AND len(list_filter(a.es, lambda e: e IN {_IN(RARE_EARTHS)})) > 0 AND len(list_filter(p.pes, lambda e: e IN {_IN(RARE_EARTHS)})) > 0
    AND len(list_filter(a.es, lambda e: e NOT IN {_IN(RARE_EARTHS)} AND NOT list_contains(p.pes, e))) + greatest(0, len(list_filter(a.es, lambda e: e IN {_IN(RARE_EARTHS)})) - len(list_filter(a.es, lambda e: e IN {_IN(RARE_EARTHS)}))) <= 3)"""


def _step(swapped: bool) -> str:
    return "CASE WHEN a.metal THEN 6 ELSE 6 + round_even(coalesce(abs(p.ratio - a.ratio), 0) * 4 + 1e-9, 0)::INT END"


_GATED = f"(a.centre IS NULL OR list_contains(p.es, a.centre)) AND (a.metal OR a.dilute OR coalesce(abs(p.ratio - a.ratio) <= {RATIO_CAP} + 1e-9, true))"


@query(f"""WITH kind AS MATERIALIZED (SELECT * FROM {_KIND}), paired AS MATERIALIZED (SELECT * FROM {_PAIRED}), swaps AS MATERIALIZED (SELECT * FROM {_SWAPS}), fits AS MATERIALIZED ({_FITS}), swapfits AS MATERIALIZED ({_FITS.replace(_PAIRED, 'swaps')}),
    c AS (SELECT a.id, s.parent, false AS swapped, tier AS step, round(trd, 5) AS second, 0 AS third FROM {_SIMILAR} s JOIN kind a USING (id) JOIN kind p ON p.id = s.parent WHERE tier IS NOT NULL AND {_GATED}
    UNION ALL SELECT a.id, w.parent, false, {_step(False)}, round(fit, 2), a.k - p.k FROM paired w JOIN fits f USING (id, parent) JOIN kind a ON a.id = w.id JOIN kind p ON p.id = w.parent WHERE {_GATED}
    UNION ALL SELECT a.id, -list_position({SYMBOLS!r}, e), false, CASE WHEN e = a.major THEN 4 ELSE 5 END, 1.0, 0 FROM (SELECT *, unnest(es) AS e FROM kind WHERE metal OR dilute) a WHERE e IN {_IN(ALLOYING)}
    UNION ALL SELECT a.id, w.parent, true, {_step(True)}, round(fit, 2), len(list_filter(a.es, lambda e: e NOT IN {_IN(RARE_EARTHS)} AND NOT list_contains(p.es, e))) FROM swaps w JOIN swapfits f USING (id, parent) JOIN kind a ON a.id = w.id JOIN kind p ON p.id = w.parent WHERE {_GATED}),
    best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, parent ORDER BY step, second, third) = 1)
    SELECT id, parent, swapped, step, round(second, 5) AS second, third FROM best QUALIFY row_number() OVER (PARTITION BY id, swapped ORDER BY step, second, third, parent) <= 3""")
def join_fallback_ranked(spark, sf):
    """The three best parents of each formula by its own elements and the three best with rare earths swapped; a parent counts once,
    in its best place. Equal formulas are matched once."""
    from lodestone.operators.windows import top_k

    def kept(each: DataFrame) -> DataFrame:
        found = candidates(each, written(parents(spark, sf).select("parent", "pcomp").unionByName(lattices(each))))
        order = F.struct("step", "second", "third")
        best = found.groupBy("formula", "parent").agg(F.min(F.struct(order.alias("o"), "swapped")).alias("b")).select("formula", "parent", "b.swapped", "b.o.*")
        return top_k(best, ["formula", "swapped"], ["step", "second", "third", "parent"], 3)

    return told(spark, sf, kept).select("id", "parent", "swapped", "step", F.round("second", 5).alias("second"), "third")
