"""Audits of labelled formulas: what a label, a composition or a parent can't be. One column for each rule, exploded to flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.composition import _PARTS, _PARTS_OF, _ROWS, _SHARES, _balance, OXIDATION, OXIDATION_STRICT, amount, distance, entries, fractions, meet, norm_key, once, oxidation_of, parse, whole
from lodestone.operators.projections import cascade
from lodestone.registry import query, written

# What counts as an anion and as a metal; cations of several charges.
ANIONS = ["O", "F", "Cl", "Br", "I", "S", "Se", "Te", "N", "H", "D"]
METALS = (
    "Sc Y La Lu Ti Zr Hf V Nb Ta Cr Mo W Mn Tc Re Fe Ru Os Co Rh Ir Ni Pd Pt Cu Ag Au Zn Cd Hg Al Ga In Sn Pb Bi Sb Ge Si Mg Be Li Na K Ca Sr Ba Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Th U"
).split()
MIXED = "Fe Co Mn Cr V Ni Ru Ti Ce Pr Tb Eu Yb Sn Sb Mo W Re Os Ir Rh Pd Pt U".split()
# Charges for the check of typing errors, beyond those of the short balance.
CHARGES = OXIDATION | {
    "Y": 3, "Bi": 3, "Tl": 3, "Pb": 2, "Hg": 2, "Fe": 3, "Co": 3, "Mn": 3, "Ru": 4, "Ga": 3, "Ti": 4, "Al": 3, "Zn": 2, "Ni": 2, "Cd": 2, "In": 3, "Sb": 3, "Sc": 3, "Lu": 3, "Tb": 3,
    "Dy": 3, "Ho": 3, "Er": 3, "Tm": 3, "Yb": 3, "Th": 4, "Ta": 5, "Nb": 5, "Mo": 6, "W": 6, "V": 5, "Cr": 3, "Zr": 4, "Hf": 4, "Mg": 2, "Li": 1, "Rb": 1, "Cs": 1, "Ag": 1, "Au": 3,
    "Sn": 4, "Ge": 4, "Si": 4, "B": 3, "C": 4, "P": 5, "As": 5, "Re": 7, "Os": 4, "Ir": 4, "Pt": 2, "Pd": 2, "Rh": 3, "U": 4, "Ce": 3, "Tc": 7, "Be": 2, "D": 1,
}
# The highest critical temperature of each class; others 165.
LIMITS = {"alloy": 25.0, "elemental": 10.0, "hydride": 40.0, "fe-based": 60.0, "cuprate": 140.0}
# Of iron compounds, the lanthanoids, the alkaline earths, the ceilings of frames and cations that count as heavy.
LANTHANOIDS = "La Ce Pr Nd Sm Gd Tb Dy Y Eu Ho Er".split()
EARTHS = "Ba Sr Ca Eu".split()
CEILINGS = {"122": 42.0, "11": 17.0, "111": 27.0, "245": 34.0}
HEAVY = "Co Ni Mn Cr Cu Zn Ru Ir Rh".split()
# Cations that break pairs.
BREAKERS = "Pr Ce Zn Ni Fe Co Mn Ga Al".split()
#: A difference that reaches a bound but for rounding hasn't passed it.
_EPS = 1e-9


def _has(comp: Column, *elements: str) -> Column:
    return F.arrays_overlap(F.map_keys(comp), F.array(*map(F.lit, elements)))


def _amount(comp: Column, elements: list[str]) -> Column:
    return whole(F.map_filter(comp, lambda e, _: e.isin(elements)))


def kind(comp: Column) -> Column:
    """The class of a compound, by its elements."""
    metal = F.forall(F.map_keys(comp), lambda e: e.isin(METALS))
    rules = [(metal & (F.size(comp) == 1), "elemental"), (metal, "alloy"), (_has(comp, "Cu") & _has(comp, "O"), "cuprate"), (_has(comp, "Fe") & _has(comp, "As", "P", "Se", "Te", "S"), "fe-based"), (_has(comp, "H", "D") & ~_has(comp, "O"), "hydride")]
    return cascade(rules, "other")


def anion_ratio(comp: Column) -> Column:
    """Anions for each cation; null without a cation."""
    a = _amount(comp, ANIONS)
    return F.when(F.exists(F.map_keys(comp), lambda e: ~e.isin(ANIONS)), a / (whole(comp) - a))


def flagged(rows: DataFrame, rules: dict[str, Column], name: str = "flag", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, ``name``): a row for each rule that holds."""
    return rows.select(*keep, F.explode(F.array_compact(F.array(*[F.when(rule, label) for label, rule in rules.items()]))).alias(name))


def _composed(f: DataFrame) -> DataFrame:
    """What the nine rules and their routes look at in (formula, parent_formula, built) alone, as columns."""
    f = f.withColumns({"comp": parse(F.col("formula")), "pc": parse(F.col("parent_formula")), "bc": parse(F.col("built"))})
    f = f.withColumns({"class": kind(F.col("comp")), "key": norm_key(F.col("comp"))})
    c, p, kinds = F.col("comp"), F.col("pc"), F.col("class")
    n, top, least = whole(c), F.array_max(F.map_values(c)), F.array_min(F.map_values(fractions(c)))
    cu, cations = amount(c, "Cu"), F.map_filter("comp", lambda e, _: ~e.isin(ANIONS))
    balance = oxidation_of(c, "Cu", CHARGES)
    told = {
        "parsed": c.isNotNull(),
        "limit": F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv]), kinds), F.lit(165.0)),
        "top": top,
        "huge": (top > 60) | (n > 300),
        "trace": (least > 0) & (least < 0.005),
        "charged": (kinds == "cuprate") & ~oxidation_of(c, "Cu", OXIDATION, 0.0).between(1.4 - _EPS, 3.3 + _EPS),
        "off_centre": F.when(kinds == "cuprate", ~_has(p, "Cu")).when(kinds == "fe-based", ~_has(p, "Fe")).otherwise(False),
        "ratio_gap": F.abs(anion_ratio(c) - anion_ratio(p)),
        "built_gap": distance(c, F.col("bc"), True),
        "typo": (kinds == "cuprate") & (cu >= 0.2 * whole(cations)) & (_amount(c, MIXED) < 0.3 * cu) & ((balance < 0.8) | (balance > 4.0)),
        "foreign": whole(F.map_filter(cations, lambda e, _: ~F.map_contains_key(F.col("pc"), e))) / F.nullif(whole(cations), F.lit(0.0)),
    }
    return f.select("formula", "parent_formula", "built", "class", "key", *[x.alias(k) for k, x in told.items()])


def _judged(spark, sf, broken: bool = False) -> DataFrame:
    """The formulas with what the nine rules and their routes look at; those that aren't formulas stay, without anything of it.

    ``broken``: a bracket stands before some texts, so that they aren't formulas.
    """
    f = entries(spark, sf)
    if broken:
        f = f.withColumn("formula", F.when(F.col("id") % 23 == 0, F.concat(F.lit("("), "formula")).otherwise(F.col("formula")))
    f = once(f, ["formula", "parent_formula", "built"], _composed)
    reports = f.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("same"), F.min("tc").alias("lo"), F.max("tc").alias("hi"))  # partial sums; copies of a key never meet
    return meet(f, written(reports), ["key"], "left")


def _nine(j: DataFrame) -> dict[str, Column]:
    tc = F.col("tc")
    return {
        "A:huge": F.col("huge"),
        "A:trace": F.col("trace"),
        "B": tc > F.col("limit"),
        "I:high": tc > 165,
        "I:low": (tc > 0) & (tc < 0.05),
        "C": F.col("charged"),
        "G:parent": F.col("off_centre"),
        "G:ratio": (F.col("ratio_gap") > 0.25 + _EPS) & (F.col("class") != "alloy"),
        "E": (F.col("reports") >= 2) & (F.col("iqr") > F.greatest(F.lit(5.0), 0.5 * tc)),
        "F": (tc == 0) & (F.col("hi") > 0),
        "D": (F.col("same") >= 2) & (F.col("hi") - F.col("lo") > F.greatest(F.lit(5.0), 0.3 * F.col("hi")) + _EPS),
        "H": (F.col("id") % 2 == 0) & (F.col("built_gap") > 0.02 + _EPS),
    }


def _in(names: list[str]) -> str:
    return "e IN (" + ", ".join(f"'{x}'" for x in names) + ")"


def _features(parts: str) -> str:
    return f"""(SELECT id, max(n) AS top, sum(n) AS total, min(n) / sum(n) AS least, bool_and({_in(METALS)}) AS metal, count(*) AS k, bool_or(e = 'Cu') AS cu, bool_or(e = 'O') AS o, bool_or(e = 'Fe') AS fe, bool_or({_in(['As', 'P', 'Se', 'Te', 'S'])}) AS pn, bool_or({_in(['H', 'D'])}) AS h,
        coalesce(sum(n) FILTER ({_in(ANIONS)}), 0) / nullif(sum(n) FILTER (NOT {_in(ANIONS)}), 0) AS ratio FROM {parts} GROUP BY id)"""


_CLASS = "CASE WHEN metal AND k = 1 THEN 'elemental' WHEN metal THEN 'alloy' WHEN cu AND o THEN 'cuprate' WHEN fe AND pn THEN 'fe-based' WHEN h AND NOT o THEN 'hydride' ELSE 'other' END"
_KEY = f"(SELECT id, string_agg(e || printf('%.3f', round(f + 1e-9, 3)), '|' ORDER BY e) AS key FROM {_SHARES} GROUP BY id)"
_OF = {c: _PARTS_OF.format(rows=f"(SELECT id, {c} AS formula FROM {_ROWS})") for c in ("parent_formula", "built")}
_SHARES_BUILT = f"(SELECT id, e, n / sum(n) OVER (PARTITION BY id) AS f FROM {_OF['built']})"
_BUILT = f"(SELECT id, max(d) AS built_err FROM (SELECT id, e, abs(sum(f)) AS d FROM (SELECT id, e, f FROM {_SHARES} UNION ALL SELECT id, e, -f FROM {_SHARES_BUILT}) GROUP BY 1, 2) GROUP BY 1)"
_JUDGED = f"""r AS (SELECT t.*, c.* EXCLUDE (id), p.cu AS pcu, p.fe AS pfe, p.ratio AS pratio, key, ox, built_err FROM {_ROWS} t JOIN {_features(_PARTS)} c USING (id) JOIN {_features(_OF['parent_formula'])} p USING (id) JOIN {_KEY} USING (id) JOIN {_balance(OXIDATION, False)} USING (id) JOIN {_BUILT} USING (id)),
    j AS (SELECT *, {_CLASS} AS class, min(tc) OVER w AS lo, max(tc) OVER w AS hi, count(*) OVER w AS same FROM r WINDOW w AS (PARTITION BY key)),
    f AS (SELECT j.*, x AS flag FROM j, (SELECT unnest(['A:huge', 'A:trace', 'B', 'I:high', 'I:low', 'C', 'G:parent', 'G:ratio', 'E', 'F', 'D', 'H']) AS x) WHERE CASE x WHEN 'A:huge' THEN top > 60 OR total > 300 WHEN 'A:trace' THEN least > 0 AND least < 0.005
        WHEN 'B' THEN tc > CASE class WHEN 'alloy' THEN 25 WHEN 'elemental' THEN 10 WHEN 'hydride' THEN 40 WHEN 'fe-based' THEN 60 WHEN 'cuprate' THEN 140 ELSE 165 END WHEN 'I:high' THEN tc > 165 WHEN 'I:low' THEN tc > 0 AND tc < 0.05
        WHEN 'C' THEN class = 'cuprate' AND NOT ox BETWEEN 1.4 - 1e-9 AND 3.3 + 1e-9 WHEN 'G:parent' THEN (class = 'cuprate' AND NOT pcu) OR (class = 'fe-based' AND NOT pfe) WHEN 'G:ratio' THEN abs(ratio - pratio) > 0.25 + 1e-9 AND class <> 'alloy'
        WHEN 'E' THEN reports >= 2 AND iqr > greatest(5.0, 0.5 * tc) WHEN 'F' THEN tc = 0 AND hi > 0 WHEN 'D' THEN same >= 2 AND hi - lo > greatest(5.0, 0.3 * hi) + 1e-9 ELSE id % 2 = 0 AND built_err > 0.02 + 1e-9 END)"""


@query(f"WITH {_JUDGED.replace(f'FROM {_ROWS} t JOIN', f'FROM (SELECT * FROM {_ROWS} WHERE id % 23 > 0) t JOIN', 1)} SELECT id, flag FROM f UNION ALL SELECT p_partkey, 'A:unparseable' FROM part WHERE p_partkey % 23 = 0")
def audit_nine(spark, sf):
    """Texts that aren't formulas (A:unparseable, and nothing else of such a row), coefficients (A), class limits (B), oxidation (C), reports that disagree (D, E), negatives with positive reports (F), the
    parent's centre and anions (G), what was built (H) and impossible temperatures (I)."""
    j = _judged(spark, sf, broken=True)
    parsed = F.col("parsed")
    return flagged(j, {"A:unparseable": ~parsed} | {name: parsed & rule for name, rule in _nine(j).items()})


_TYPO = f"""(SELECT id, sum(n) FILTER (e = 'Cu') AS cu, sum(n) FILTER (NOT {_in(ANIONS)}) AS cations, coalesce(sum(n) FILTER ({_in(MIXED)}), 0) AS mixed, count(*) FILTER (e <> 'Cu' AND val IS NULL) AS open, -coalesce(sum(n * val) FILTER (e <> 'Cu'), 0) AS charge
    FROM {_PARTS} LEFT JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in CHARGES.items())}) v(el, val) ON el = e GROUP BY id)"""
_NEW = f"(SELECT a.id, sum(a.n) FILTER (p.e IS NULL) / sum(a.n) AS foreign_share FROM (SELECT * FROM {_PARTS} WHERE NOT {_in(ANIONS)}) a LEFT JOIN {_OF['parent_formula']} p ON p.id = a.id AND p.e = a.e GROUP BY 1)"


@query(f"""WITH {_JUDGED}, hard AS (SELECT id, 'typo: oxidation' AS reason FROM j JOIN {_TYPO} y USING (id) WHERE class = 'cuprate' AND y.cu >= 0.2 * cations AND open = 0 AND mixed < 0.3 * y.cu AND (charge / y.cu < 0.8 OR charge / y.cu > 4.0)
    UNION SELECT id, 'structure: centre' FROM f WHERE flag = 'G:parent' UNION SELECT id, 'structure: class' FROM f WHERE flag = 'G:ratio' AND abs(ratio - pratio) > 1 + 1e-9 UNION SELECT id, 'structure: composition' FROM f WHERE flag = 'H'
    UNION SELECT id, 'typo: temperature' FROM f WHERE flag = 'B' AND class IN ('alloy', 'elemental') UNION SELECT id, 'typo: coefficient' FROM f WHERE flag = 'A:huge' AND top > 500), review AS (SELECT id, 'label: zero' AS reason FROM f WHERE flag = 'D' AND tc = 0 AND hi > 20),
    late AS (SELECT id, foreign_share FROM j JOIN {_NEW} USING (id) WHERE id % 4 = 0 AND id NOT IN (SELECT id FROM hard)), every AS (SELECT id, 1 AS h, reason FROM hard UNION ALL SELECT id, 0, reason FROM review UNION ALL SELECT id, (foreign_share > 0.5)::INT, 'structure: foreign' FROM late WHERE foreign_share > 0.35 + 1e-9)
    SELECT id, CASE WHEN max(h) = 1 THEN 'hard' ELSE 'review' END AS route, string_agg(reason, '; ' ORDER BY reason) AS reasons FROM every GROUP BY id""")
def audit_classify(spark, sf):
    """Findings that exclude a row and those that somebody must look at; a row with any hard one is hard."""
    j = _judged(spark, sf)
    nine = _nine(j)
    hard = {
        "typo: oxidation": F.col("typo"),
        "structure: centre": nine["G:parent"],
        "structure: class": nine["G:ratio"] & (F.col("ratio_gap") > 1 + _EPS),
        "structure: composition": nine["H"],
        "typo: temperature": nine["B"] & F.col("class").isin("alloy", "elemental"),
        "typo: coefficient": nine["A:huge"] & (F.col("top") > 500),
    }
    found = lambda rules: F.array_compact(F.array(*[F.when(r, n) for n, r in rules.items()]))
    r = j.select("id", found(hard).alias("hard"), found({"label: zero": nine["D"] & (F.col("tc") == 0) & (F.col("hi") > 20)}).alias("review"), "foreign")
    late = (F.col("id") % 4 == 0) & (F.size("hard") == 0) & (F.col("foreign") > 0.35 + _EPS)
    reasons = F.array_sort(F.concat("hard", "review", F.when(late, F.array(F.lit("structure: foreign"))).otherwise(F.array().cast("array<string>"))))
    route = F.when((F.size("hard") > 0) | (late & (F.col("foreign") > 0.5)), "hard").otherwise("review")
    return r.filter((F.size("hard") > 0) | (F.size("review") > 0) | late).select("id", route.alias("route"), F.array_join(reasons, "; ").alias("reasons"))


def near_conflicts(rows: DataFrame, apart: float, reach: float = 0.01) -> DataFrame:
    """``rows`` (id, parent, elements, shares, tc and others; see ``placed``) that have one of the same elements and parent within ``reach`` whose value differs by more than ``apart``.

    Equal compositions become one row with their lowest and highest value before they meet; others meet in bands of
    their first element's share, so a group is never compared all with all.
    """
    each = written(rows.groupBy("parent", "elements", "shares").agg(F.min("tc").alias("lo"), F.max("tc").alias("hi")))
    band = F.floor(F.element_at("shares", 1) / reach)
    left = each.select("parent", "elements", "shares", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    right = each.select("parent", "elements", F.col("shares").alias("other"), band.alias("band"), "lo", "hi")
    gap = F.aggregate(F.zip_with("shares", "other", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    around = left.join(right, ["parent", "elements", "band"]).filter(gap < reach - _EPS).groupBy("parent", "elements", "shares").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    near = meet(rows, written(around), ["parent", "elements", "shares"])
    return near.filter((F.col("tc") - F.col("lo") > apart + _EPS) | (F.col("hi") - F.col("tc") > apart + _EPS)).select(*rows.columns)


def placed(comp: Column) -> dict[str, Column]:
    """The elements of a composition and their rounded shares, by which ``near_conflicts`` compares."""
    shares = F.transform(F.array_sort(F.map_entries(fractions(comp))), lambda e: F.round(e["value"], 9))
    return {"elements": F.array_join(F.array_sort(F.map_keys(comp)), "-"), "shares": shares}


def _near(apart: float, where: str = "true") -> str:
    s = f"(SELECT t.id, parent_formula AS parent, tc, string_agg(e, '-' ORDER BY e) AS els, list(f ORDER BY e) AS v FROM {_ROWS} t JOIN {_SHARES} s USING (id) WHERE {where} GROUP BY 1, 2, 3)"
    d = f"(SELECT parent, els, v, min(tc) AS lo, max(tc) AS hi FROM {s} GROUP BY 1, 2, 3)"
    return f"(SELECT DISTINCT a.id FROM {s} a JOIN {d} b ON a.parent = b.parent AND a.els = b.els AND list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2]))) < 0.01 - 1e-9 WHERE a.tc - b.lo > {apart} + 1e-9 OR b.hi - a.tc > {apart} + 1e-9)"


@query(f"""WITH r AS (SELECT t.*, key, ox FROM {_ROWS} t JOIN {_KEY} USING (id) JOIN {_balance(OXIDATION_STRICT, True)} USING (id)), d AS (SELECT *, ox IS NOT NULL AND contains(formula, 'O') AS oxide, count(*) OVER w AS same, max(tc) OVER w - min(tc) OVER w AS spread FROM r WINDOW w AS (PARTITION BY key))
    SELECT id, x AS flag FROM d, (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'G']) AS x) WHERE CASE x WHEN 'A' THEN oxide AND ox BETWEEN 1.98 - 1e-9 AND 2.02 + 1e-9 AND tc > 5 WHEN 'B' THEN oxide AND (ox > 2.6 + 1e-9 OR ox < 1.7 - 1e-9) AND tc > 10 WHEN 'C' THEN oxide AND ox > 2.35 + 1e-9 AND ox < 2.6 - 1e-9 AND tc > 20
    WHEN 'D' THEN same > 1 AND spread > 15 + 1e-9 WHEN 'E' THEN iqr > 10 ELSE oxide AND ox BETWEEN 2.10 - 1e-9 AND 2.35 + 1e-9 AND tc = 0 AND NOT regexp_matches(formula, '{'|'.join(BREAKERS)}') END UNION ALL SELECT id, 'F' FROM {_near(30)}""")
def audit_doping(spark, sf):
    """Oxidation against temperature (A, B, C, G), equal and nearly equal compositions that disagree (D, F), sources that do (E)."""
    def composed(f: DataFrame) -> DataFrame:
        f = f.withColumn("comp", parse(F.col("formula")))
        own = {"key": norm_key(F.col("comp")), "ox": F.round(oxidation_of(F.col("comp"), "Cu"), 5), "oxygen": F.col("formula").contains("O"), "breaker": F.col("formula").rlike("|".join(BREAKERS))}
        return f.withColumns(own | placed(F.col("comp"))).drop("comp")

    f = once(entries(spark, sf), ["formula"], composed)
    j = meet(f, written(f.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("same"), (F.max("tc") - F.min("tc")).alias("spread"))), ["key"], "left")
    ox, tc = F.col("ox"), F.col("tc")
    oxide = ox.isNotNull() & F.col("oxygen")
    rules = {
        "A": oxide & ox.between(1.98 - _EPS, 2.02 + _EPS) & (tc > 5),
        "B": oxide & ((ox > 2.6 + _EPS) | (ox < 1.7 - _EPS)) & (tc > 10),
        "C": oxide & (ox > 2.35 + _EPS) & (ox < 2.6 - _EPS) & (tc > 20),
        "D": (F.col("same") > 1) & (F.col("spread") > 15 + _EPS),
        "E": F.col("iqr") > 10,
        "G": oxide & ox.between(2.10 - _EPS, 2.35 + _EPS) & (tc == 0) & ~F.col("breaker"),
    }
    near = near_conflicts(f.select("id", F.col("parent_formula").alias("parent"), "elements", "shares", "tc"), 30)
    return flagged(j, rules).unionByName(near.select("id", F.lit("F").alias("flag")))


def frame(c: Column) -> Column:
    """The frame of an iron compound."""
    pnictide, chalcogen, oxygen = _has(c, "As", "P"), _has(c, "Se", "Te", "S"), _has(c, "O")
    rules = [
        (pnictide & oxygen & _has(c, *LANTHANOIDS), "1111"), (pnictide & ~oxygen & _has(c, *EARTHS), "122"), (pnictide & _has(c, "Li", "Na") & ~oxygen, "111"),
        (chalcogen & ~pnictide & ~_has(c, "K", "Rb", "Cs", "Tl", "Li") & ~oxygen, "11"), (chalcogen & _has(c, "K", "Rb", "Cs", "Tl"), "245"),
    ]
    return cascade(rules, "other")


def _sum(names: list[str]) -> str:
    return f"coalesce(sum(n) FILTER ({_in(names)}), 0)"


_NAMES = {"Fe": "fe", "As": "arsenic", "P": "p", "O": "o", "F": "f", "K": "k", "Co": "co", "Ni": "ni", "Se": "se", "Te": "te"}
_FERRITE = f"""(SELECT id, tc, parent_formula, kinds, ln, ln1, ae, ae1, {', '.join(_NAMES.values())}, heavy, earths, CASE WHEN pn AND hasO AND ln > 0 THEN '1111' WHEN pn AND NOT hasO AND ae > 0 THEN '122' WHEN pn AND lina AND NOT hasO THEN '111' WHEN ch AND NOT pn AND NOT alkali AND NOT hasO THEN '11' WHEN ch AND alkali2 THEN '245' ELSE 'other' END AS frame FROM
    (SELECT t.id, tc, parent_formula, count(*) AS kinds, count(*) FILTER ({_in(LANTHANOIDS)}) AS ln, count(*) FILTER ({_in(LANTHANOIDS)} AND n = 1) AS ln1, count(*) FILTER ({_in(EARTHS)}) AS ae, count(*) FILTER ({_in(EARTHS)} AND n = 1) AS ae1, {', '.join(f"{_sum([x])} AS {name}" for x, name in _NAMES.items())},
    {_sum(HEAVY)} AS heavy, {_sum(EARTHS)} AS earths, bool_or({_in(['As', 'P'])}) AS pn, bool_or(e = 'O') AS hasO, bool_or({_in(['Se', 'Te', 'S'])}) AS ch, bool_or({_in(['Li', 'Na'])}) AS lina, bool_or({_in(['K', 'Rb', 'Cs', 'Tl', 'Li'])}) AS alkali, bool_or({_in(['K', 'Rb', 'Cs', 'Tl'])}) AS alkali2
    FROM {_ROWS} t JOIN {_PARTS} USING (id) GROUP BY 1, 2, 3) WHERE fe > 0)"""


@query(f"""SELECT id, frame, x AS flag FROM {_FERRITE}, (SELECT unnest(['FA', 'FB', 'FF', 'FG']) AS x) WHERE CASE x WHEN 'FA' THEN tc > 5 AND ((frame = '1111' AND ln = 1 AND ln1 = 1 AND fe = 1 AND arsenic = 1 AND o = 1 AND kinds = 4) OR (frame = '122' AND ae = 1 AND ae1 = 1 AND fe = 2 AND (arsenic = 2 OR p = 2) AND kinds = 3))
    WHEN 'FB' THEN tc > CASE frame WHEN '122' THEN 42 WHEN '11' THEN 17 WHEN '111' THEN 27 WHEN '245' THEN 34 ELSE 1e9 END WHEN 'FF' THEN id IN {_near(12, "t.id IN (SELECT id FROM " + _PARTS + " WHERE e = 'Fe')")}
    ELSE tc = 0 AND CASE frame WHEN '1111' THEN heavy < 0.05 - 1e-9 AND f / greatest(o + f, 1e-9) BETWEEN 0.08 - 1e-9 AND 0.30 + 1e-9 WHEN '122' THEN (k / greatest(earths + k, 1e-9) BETWEEN 0.25 - 1e-9 AND 0.55 + 1e-9 AND heavy < 0.05 - 1e-9) OR co * 2.0 / (greatest(fe, 1e-9) + co + ni) BETWEEN 0.05 - 1e-9 AND 0.15 + 1e-9 WHEN '11' THEN heavy < 0.05 - 1e-9 AND se + te > 0 AND te / (se + te) BETWEEN 0.35 - 1e-9 AND 0.65 + 1e-9 ELSE false END END""")
def audit_ferrite(spark, sf):
    """Exact parents with a temperature (FA), temperatures over a frame's ceiling (FB), nearly equal ones that disagree (FF), zeros
    in the window where doping works (FG)."""
    c, kind_of = F.col("comp"), F.col("frame")
    n = lambda e: amount(c, e)
    one = lambda names: (F.size(F.map_filter(c, lambda e, _: e.isin(names))) == 1) & (_amount(c, names) == 1)
    exact = ((kind_of == "1111") & one(LANTHANOIDS) & (n("Fe") == 1) & (n("As") == 1) & (n("O") == 1) & (F.size(c) == 4)) | ((kind_of == "122") & one(EARTHS) & (n("Fe") == 2) & ((n("As") == 2) | (n("P") == 2)) & (F.size(c) == 3))
    ceiling = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CEILINGS.items() for x in kv]), kind_of), F.lit(1e9))
    light, tiny = _amount(c, HEAVY) < 0.05 - _EPS, F.lit(1e-9)
    within = lambda x, lo, hi: x.between(lo - _EPS, hi + _EPS)
    potassium = n("K") / F.greatest(_amount(c, EARTHS) + n("K"), tiny)
    cobalt = n("Co") * 2.0 / (F.greatest(n("Fe"), tiny) + n("Co") + n("Ni"))
    chalcogens = n("Se") + n("Te")
    window = F.when(kind_of == "1111", light & within(n("F") / F.greatest(n("O") + n("F"), tiny), 0.08, 0.30)).when(kind_of == "122", (within(potassium, 0.25, 0.55) & light) | within(cobalt, 0.05, 0.15)).when(kind_of == "11", light & (chalcogens > 0) & within(F.try_divide(n("Te"), chalcogens), 0.35, 0.65)).otherwise(False)

    def composed(f: DataFrame) -> DataFrame:
        f = f.withColumn("comp", parse(F.col("formula"))).filter(_has(c, "Fe")).withColumn("frame", frame(c))
        return f.withColumns({"exact": exact, "ceiling": ceiling, "window": window} | placed(c)).drop("comp")

    f, tc = once(entries(spark, sf), ["formula"], composed), F.col("tc")
    rules = {"FA": F.col("exact") & (tc > 5), "FB": tc > F.col("ceiling"), "FG": F.col("window") & (tc == 0)}
    near = near_conflicts(f.select("id", "frame", F.col("parent_formula").alias("parent"), "elements", "shares", "tc"), 12)
    return flagged(f, rules, keep=("id", "frame")).unionByName(near.select("id", "frame", F.lit("FF").alias("flag")))
