"""Oxidation states: which whole charges balance a formula, and where the charge of a doped one goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.chemistry import SYMBOLS, place_of
from lodestone.functions.composition import _BOTH, _PARTS, _ROWS, pairs, told
from lodestone.registry import query, written

# Common oxidation states of the elements, the usual order of each list kept.
COMMON = {
    "H": (1, -1), "Li": (1,), "Be": (2,), "B": (3,), "C": (-4, 4), "N": (-3, 3, 5), "O": (-2,), "F": (-1,), "Na": (1,), "Mg": (2,), "Al": (3,), "Si": (-4, 4), "P": (-3, 3, 5), "S": (-2, 2, 4, 6),
    "Cl": (-1, 1, 3, 5, 7), "K": (1,), "Ca": (2,), "Sc": (3,), "Ti": (4,), "V": (5,), "Cr": (3, 6), "Mn": (2, 4, 7), "Fe": (2, 3), "Co": (2, 3), "Ni": (2,), "Cu": (2,), "Zn": (2,), "Ga": (3,),
    "Ge": (-4, 2, 4), "As": (-3, 3, 5), "Se": (-2, 2, 4, 6), "Br": (-1, 1, 3, 5, 7), "Rb": (1,), "Sr": (2,), "Y": (3,), "Zr": (4,), "Nb": (5,), "Mo": (4, 6), "Tc": (4, 7), "Ru": (3, 4), "Rh": (3,),
    "Pd": (2, 4), "Ag": (1,), "Cd": (2,), "In": (3,), "Sn": (-4, 2, 4), "Sb": (-3, 3, 5), "Te": (-2, 2, 4, 6), "I": (-1, 1, 3, 5, 7), "Cs": (1,), "Ba": (2,), "La": (3,), "Ce": (3, 4), "Pr": (3,),
    "Nd": (3,), "Pm": (3,), "Sm": (3,), "Eu": (2, 3), "Gd": (3,), "Tb": (3,), "Dy": (3,), "Ho": (3,), "Er": (3,), "Tm": (3,), "Yb": (3,), "Lu": (3,), "Hf": (4,), "Ta": (5,), "W": (4, 6), "Re": (4,),
    "Os": (4,), "Ir": (3, 4), "Pt": (2, 4), "Au": (3,), "Hg": (1, 2), "Tl": (1, 3), "Pb": (2, 4), "Bi": (3,), "Th": (4,), "U": (6,),
}
# Smallest and largest state seen in crystals of the metals that can take up a charge.
SEEN = {
    "Ti": (2, 4), "V": (2, 5), "Cr": (2, 6), "Mn": (2, 7), "Fe": (2, 3), "Co": (1, 4), "Ni": (1, 4), "Cu": (1, 3), "Zr": (2, 4), "Nb": (2, 5), "Mo": (2, 6), "Ru": (2, 6), "Rh": (3, 4), "Pd": (2, 4),
    "Ag": (1, 3), "Hf": (4, 4), "Ta": (3, 5), "W": (2, 6), "Re": (3, 7), "Os": (4, 8), "Ir": (3, 5), "Pt": (2, 4), "Au": (1, 5),
}
# What anions are pinned to; coinage metals; states that oxides prefer.
ANION_STATE = {"O": -2, "F": -1, "Cl": -1, "Br": -1, "I": -1, "S": -2, "Se": -2, "Te": -2, "N": -3, "P": -3, "As": -3}
COINAGE = ("Ag", "Au")
OXIDE_STATE = {"Hg": 2, "Tl": 3, "Ge": 4}
#: Combinations of charges of one half of a formula's elements up to which they are searched.
HALF = 20_000

def takes_charge(element: str) -> bool:
    """Whether a metal of the d block can take up a charge: groups 4 to 11."""
    _, group, block = place_of(SYMBOLS.index(element) + 1)
    return block == "d" and 4 <= group <= 11

def pinned(element: str) -> float:
    """The state of a cation that isn't free: by its group, by what oxides prefer, or its first positive one."""
    _, group, block = place_of(SYMBOLS.index(element) + 1)
    if element != "H" and group <= 2:
        return float(group)
    if group == 3 or block == "f":
        return 3.0
    if element in OXIDE_STATE:
        return float(OXIDE_STATE[element])
    states = COMMON.get(element, ())
    return float(next((s for s in states if s > 0), states[0] if states else 0))

def _lookup(values: dict, kind: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), (F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)).cast(kind))])

def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def balance(comp: Column) -> Column:
    """map element -> whole charge that balances a formula rounded to whole amounts; null where nothing does.

    Each element takes one of its common states. Of all balances the one whose states come first in their lists (the
    smallest sum of places) is taken, then the one of the smallest charges in the order of the elements. The elements
    are dealt into two halves; a half's combinations are rows of an array, those of the second are kept by their sum, and
    each row of the first looks up what it needs. Formulas with an element without states, or with more than ``HALF``
    combinations in a half, stay null.
    """
    states = _lookup(COMMON, "array<int>")
    parts = F.array_sort(F.filter(F.transform(F.map_entries(comp), lambda e: F.struct(e["key"].alias("e"), F.bround(e["value"]).cast("int").alias("n"))), lambda p: p["n"] > 0))
    start = F.array(F.struct(F.lit(0).alias("sum"), F.lit(0).alias("places"), F.array().cast("array<int>").alias("charges")))

    def combined(half: Column) -> Column:
        def more(rows: Column, p: Column) -> Column:
            of = F.try_element_at(states, p["e"])
            new = lambda r: F.transform(of, lambda s, k: F.struct((r["sum"] + p["n"] * s).alias("sum"), (r["places"] + k).alias("places"), F.concat(r["charges"], F.array(s)).alias("charges")))
            return F.flatten(F.transform(rows, new))

        size = F.aggregate(half, F.lit(1).cast("long"), lambda n, p: n * F.size(F.try_element_at(states, p["e"])))
        return F.when(size <= HALF, F.aggregate(half, start, more))

    def by_sum(rows: Column) -> Column:
        each = F.filter(rows, lambda r, k: (k == 0) | (F.get(rows, k - 1)["sum"] != r["sum"]))  # sorted, so the first of each sum is the best
        return F.map_from_entries(F.transform(each, lambda r: F.struct(r["sum"], r)))

    def whole(r: Column, of: Column) -> Column:
        rest = F.try_element_at(of, -r["sum"])
        return F.struct((r["places"] + rest["places"]).alias("places"), F.concat(r["charges"], rest["charges"]).alias("charges"))

    def searched(parts: Column) -> Column:
        middle = F.ceil(F.size(parts) / 2).cast("int")
        first, second = combined(F.slice(parts, F.lit(1), middle)), F.array_sort(combined(F.slice(parts, middle + 1, F.size(parts) - middle)))
        rows = bound(bound(second, by_sum), lambda of: F.transform(first, lambda r: whole(r, of)))
        best = F.array_min(F.filter(rows, lambda r: r["places"].isNotNull()))
        ok = F.forall(parts, lambda p: F.map_contains_key(states, p["e"])) & (F.size(parts) > 0)
        return F.when(ok, F.map_from_arrays(F.transform(parts, lambda p: p["e"]), best["charges"]))

    return bound(parts, searched)

def assigned(comp: Column, parent: Column, reference: Column) -> Column:
    """(states, redox, redox_state, imbalance, source, flipped) of a doped formula, given its parent and the parent's ``balance``.

    Without an anion all states are zero (``intermetallic``). Anions are pinned, elements of the parent take its balance,
    new ones the state that differs from the host they replace (the one with the largest drop, the first by name of
    equal ones; between two metals that take up charge the state nearest to the host's), all else is pinned. What is left
    goes to a metal of the parent that takes up charge: coinage metals last, then the most abundant, then the highest
    group. The first whose state lies within one of what is seen in crystals is the centre (``redox_balance``); where
    none does, the first is pinned to its commonest state (``redox_pinned_fallback``); where there is no such metal, the
    imbalance stays (``pinned_only``).
    """
    elements = list(COMMON)
    states, fixed = _lookup(COMMON, "array<double>"), _lookup({e: pinned(e) for e in elements}, "double")
    anion, group = _lookup(ANION_STATE, "double"), _lookup({e: place_of(SYMBOLS.index(e) + 1)[1] for e in SEEN}, "int")
    low, high = (_lookup({e: x[k] for e, x in SEEN.items()}, "double") for k in (0, 1))
    free = [e for e in SEEN if takes_charge(e)]
    entries = F.array_sort(F.map_entries(comp))
    hosts = F.filter(F.array_sort(F.map_entries(parent)), lambda e: ~F.map_contains_key(anion, e["key"]))
    drops = F.transform(hosts, lambda e: F.struct((F.coalesce(F.try_element_at(comp, e["key"]), F.lit(0.0)) - e["value"]).alias("left"), e["key"].alias("host")))

    def of_host(host: Column) -> Column:
        return F.struct(host.alias("e"), F.coalesce(F.try_element_at(reference, host).cast("double"), F.try_element_at(fixed, host)).alias("s"))

    def dopant(e: Column, host: Column) -> Column:
        def chosen(own: Column) -> Column:
            positive = F.get(F.filter(own, lambda s: s > 0), F.lit(0))
            nearest = F.array_min(F.transform(own, lambda s, k: F.struct(F.abs(s - host["s"]).alias("d"), k.alias("k"), s.alias("s"))))["s"]
            other = F.get(F.filter(own, lambda s: (F.abs(s - host["s"]) > 1e-9) & (s > 0)), F.lit(0))
            usual = F.coalesce(positive, F.get(own, F.lit(0)))
            return F.when((F.size(own) == 1) | host["e"].isNull(), usual).when(e.isin(free) & host["e"].isin(free), nearest).otherwise(F.coalesce(other, usual))

        return bound(F.try_element_at(states, e), chosen)

    def state(e: Column, host: Column) -> Column:
        known = F.coalesce(F.try_element_at(anion, e), F.try_element_at(reference, e).cast("double"))
        return F.coalesce(known, F.when(~F.map_contains_key(parent, e), dopant(e, host)), F.try_element_at(fixed, e), F.lit(0.0))

    def with_charge(parts: Column) -> Column:
        return F.struct(parts.alias("parts"), F.aggregate(parts, F.lit(0.0), lambda t, p: t + p["n"] * p["s"]).alias("charge"))

    def candidate(p: Column, charge: Column) -> Column:
        def solved(x: Column) -> Column:
            e = p["e"]
            ok = (x >= F.try_element_at(low, e) - 1 - 1e-9) & (x <= F.try_element_at(high, e) + 1 + 1e-9)
            return F.struct(e.isin(*COINAGE).alias("coinage"), (-p["n"]).alias("n"), (-F.try_element_at(group, e)).alias("group"), e.alias("e"), x.alias("solved"), ok.alias("ok"), p["s"].alias("s"))

        return bound(-(charge - p["n"] * p["s"]) / p["n"], solved)

    def with_centre(x: Column) -> Column:
        free_ones = F.filter(x["parts"], lambda p: p["e"].isin(free) & F.map_contains_key(parent, p["e"]))
        centres = F.array_sort(F.transform(free_ones, lambda p: candidate(p, x["charge"])))
        chosen = lambda c: F.struct(F.get(c, F.lit(0)).alias("first"), F.get(F.filter(c, lambda y: y["ok"]), F.lit(0)).alias("good"))
        return F.struct(x["parts"].alias("parts"), x["charge"].alias("charge"), bound(centres, chosen).alias("centre"))

    metallic = ~F.exists(entries, lambda e: F.map_contains_key(anion, e["key"]))

    def told(x: Column) -> Column:
        good, first, charge = x["centre"]["good"], x["centre"]["first"], x["charge"]
        usual = F.get(F.try_element_at(states, first["e"]), F.lit(0))
        redox, redox_state = F.coalesce(good["e"], first["e"]), F.when(good.isNotNull(), good["solved"]).otherwise(usual)
        source = F.when(metallic, "intermetallic").when(first.isNull(), "pinned_only").when(good.isNotNull(), "redox_balance").otherwise("redox_pinned_fallback")
        final = F.transform(x["parts"], lambda p: F.when(metallic, 0.0).when(p["e"] == redox, redox_state).otherwise(p["s"]))
        imbalance = F.when(first.isNull(), charge).otherwise(charge + F.abs(first["n"]) * (usual - first["s"]))
        return F.struct(
            F.map_from_arrays(F.transform(x["parts"], lambda p: p["e"]), final).alias("states"),
            F.when(~metallic, redox).alias("redox"),
            F.when(~metallic, F.when(redox.isNotNull(), redox_state)).alias("redox_state"),
            F.when(~metallic, F.when(good.isNotNull(), 0.0).otherwise(imbalance)).alias("imbalance"),
            source.alias("source"),
            (~metallic & good.isNotNull() & (good["e"] != first["e"])).alias("flipped"),
        )

    parts = bound(bound(F.array_min(drops)["host"], of_host), lambda host: F.transform(entries, lambda e: F.struct(e["key"].alias("e"), e["value"].alias("n"), state(e["key"], host).alias("s"))))
    return bound(bound(bound(parts, with_charge), with_centre), told)


def with_oxidation(rows: DataFrame) -> DataFrame:
    """``rows`` (id, comp, parent, pcomp) with ``ox``, their assigned oxidation. Equal parents are balanced once."""
    each = written(rows.select("parent", "pcomp").dropDuplicates(["parent"]).select("parent", balance(F.col("pcomp")).alias("reference")))
    return rows.hint("merge").join(each, "parent").withColumn("ox", assigned(F.col("comp"), F.col("pcomp"), F.col("reference")))

def _states(table: dict[str, tuple[int, ...]]) -> str:
    return "(VALUES " + ", ".join(f"('{e}', {s}, {k})" for e, x in table.items() for k, s in enumerate(x)) + ") st(el, s, place)"

#: (id, e, charge) of the best balance: every element's states against each other, an element at a time.
_GUESS = f"""g AS MATERIALIZED (WITH RECURSIVE p AS (SELECT id, e, k, max(k) OVER (PARTITION BY id) AS last, n FROM (SELECT id, e, n, row_number() OVER (PARTITION BY id ORDER BY e) AS k FROM (SELECT id, e, round_even(n, 0)::INT AS n FROM {_PARTS} WHERE id IN (SELECT min(id) FROM {_ROWS} WHERE formula IN (SELECT formula FROM {_ROWS}) GROUP BY formula)) WHERE n > 0)),
    w AS (SELECT id, k, last, n * s AS total, place AS places, [s] AS charges, [e] AS es FROM p JOIN {_states(COMMON)} ON el = e WHERE k = 1
        UNION ALL SELECT w.id, p.k, w.last, total + p.n * s, places + place, list_append(charges, s), list_append(es, e) FROM w JOIN p ON p.id = w.id AND p.k = w.k + 1 JOIN {_states(COMMON)} ON el = e)
    SELECT id, unnest(es) AS e, unnest(charges) AS charge FROM (SELECT * FROM w WHERE k = last AND total = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY places, charges) = 1))"""

@query(f"WITH {_GUESS} SELECT f.id, g.e AS element, g.charge FROM {_ROWS} f JOIN (SELECT formula, min(id) AS first FROM {_ROWS} GROUP BY formula) u USING (formula) JOIN g ON g.id = u.first")
def fn_oxidation_balance(spark, sf):
    """Whole charges that balance each formula; those that nothing balances give no row. Equal formulas are searched once."""
    return told(spark, sf, lambda f: f.select("formula", F.explode(balance(F.col("comp"))).alias("element", "charge")))

def _ladder(column: str, values: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in values.items()) + " END"

_FREE = "(" + ", ".join(f"'{e}'" for e in SEEN if takes_charge(e)) + ")"
_ANIONS = "(" + ", ".join(f"'{e}'" for e in ANION_STATE) + ")"
_ASSIGNED = f"""{_GUESS}, b AS MATERIALIZED (SELECT * FROM {_BOTH}),
    host AS (SELECT id, parent, arg_min(e, (a - b, e)) AS host FROM b WHERE b > 0 AND e NOT IN {_ANIONS} GROUP BY 1, 2),
    s AS (SELECT b.id, b.parent, b.e, b.a AS n, b.b > 0 AS native, host, coalesce(h.charge, {_ladder('host', {e: pinned(e) for e in COMMON})}) AS hs, {_ladder('b.e', ANION_STATE)} AS an, g.charge AS ref, {_ladder('b.e', {e: pinned(e) for e in COMMON})} AS pin
        FROM b LEFT JOIN host USING (id, parent) LEFT JOIN g ON g.id = b.parent AND g.e = b.e LEFT JOIN g h ON h.id = b.parent AND h.e = host WHERE b.a > 0),
    dop AS (SELECT id, parent, e, count(*) AS k, arg_min(s, place) FILTER (s > 0) AS pos, arg_min(s, place) AS top, arg_min(s, (abs(s - hs), place)) AS nearest, arg_min(s, place) FILTER (s > 0 AND abs(s - hs) > 1e-9) AS other
        FROM s JOIN {_states(COMMON).replace('st(el, s, place)', 'st(el, s, place)')} ON el = e WHERE NOT native GROUP BY 1, 2, 3),
    o AS (SELECT s.id, s.parent, s.e, n, native, coalesce(an, ref, CASE WHEN NOT native THEN CASE WHEN k = 1 OR host IS NULL THEN coalesce(pos, top) WHEN s.e IN {_FREE} AND host IN {_FREE} THEN nearest ELSE coalesce(other, pos, top) END END, pin, 0)::DOUBLE AS st FROM s LEFT JOIN dop USING (id, parent, e)),
    t AS (SELECT id, parent, sum(n * st) AS charge, bool_or(e IN {_ANIONS}) AS ionic FROM o GROUP BY 1, 2),
    c AS (SELECT *, row_number() OVER (PARTITION BY id, parent ORDER BY coin, -n, -grp, e) AS r, solved BETWEEN lo - 1 - 1e-9 AND hi + 1 + 1e-9 AS ok FROM (SELECT o.id, o.parent, e, n, st, e IN ('Ag', 'Au') AS coin, {_ladder('e', {e: place_of(SYMBOLS.index(e) + 1)[1] for e in SEEN})} AS grp, {_ladder('e', {e: x[0] for e, x in SEEN.items()})} AS lo, {_ladder('e', {e: x[1] for e, x in SEEN.items()})} AS hi, -(charge - n * st) / n AS solved FROM o JOIN t USING (id, parent) WHERE native AND e IN {_FREE})),
    x AS (SELECT t.*, f.e AS first, {_ladder('f.e', {e: COMMON[e][0] for e in SEEN if e in COMMON})} AS usual, f.n AS fn, f.st AS fst, q.e AS good, q.solved FROM t LEFT JOIN (SELECT * FROM c WHERE r = 1) f USING (id, parent) LEFT JOIN (SELECT * FROM c WHERE ok QUALIFY row_number() OVER (PARTITION BY id, parent ORDER BY r) = 1) q USING (id, parent))"""

@query(f"""WITH {_ASSIGNED} SELECT o.id, o.parent, o.e AS element, round(CASE WHEN NOT ionic THEN 0 WHEN o.e = coalesce(good, first) THEN coalesce(solved, usual) ELSE st END, 5) + 0.0 AS oxidation,
    CASE WHEN NOT ionic THEN 'intermetallic' WHEN first IS NULL THEN 'pinned_only' WHEN good IS NOT NULL THEN 'redox_balance' ELSE 'redox_pinned_fallback' END AS source, ionic AND coalesce(o.e = coalesce(good, first), false) AS centre, ionic AND coalesce(good <> first, false) AS flipped,
    round(CASE WHEN ionic THEN CASE WHEN good IS NOT NULL THEN 0 WHEN first IS NULL THEN charge ELSE charge + fn * (usual - fst) END END, 5) + 0.0 AS imbalance FROM o JOIN x USING (id, parent)""")
def fn_assign_oxidation(spark, sf):
    """Each element's state in each formula against each of its parents, the metal that takes up the charge, and what stays open."""
    centre = F.coalesce(F.col("redox") == F.col("element"), F.lit(False))

    def each(p: DataFrame) -> DataFrame:
        found = with_oxidation(p).select("formula", "parent", F.col("ox.*"))
        rows = found.select("formula", "parent", F.explode("states").alias("element", "state"), "redox", "imbalance", "source", "flipped")
        return rows.select("formula", "parent", "element", (F.round("state", 5) + 0.0).alias("oxidation"), "source", centre.alias("centre"), F.coalesce("flipped", F.lit(False)).alias("flipped"), (F.round("imbalance", 5) + 0.0).alias("imbalance"))

    return pairs(spark, sf, each)
