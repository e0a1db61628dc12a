"""Chemical formulas as maps from element to amount, built from SQL expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.registry import query, table, written

# Formulas with flat subscripts, of which the rows of ``part`` are made here, and what they are doped with.
BASES = [
    "La2CuO4", "Nd2CuO4", "YBa2Cu3O7", "YBa2Cu3O6.9", "Bi2Sr2CaCu2O8", "MgB2", "Ba1Fe2As2", "SrFe2As2", "LaFeAsO", "CeFeAsO", "FeSe", "FeTe", "LiFeAs", "KFe2Se2",
    "NdNiO2", "LaNiO2", "CuO", "Fe2O3", "Nb3Sn", "Nb50Zr50", "Nb0.75Ti0.25", "Mo0.6Re0.4", "V3Ir", "AuGa", "LaH10", "Ba2Ca0.7Ce0.3Cu2Tl2O8",
]
DOPANTS = ["Sr", "Ce", "Ni", "Zn", "Co", "K", "F", "Te"]
# Oxidation numbers of three balances: a short one where others count nothing, a long one of that kind, and a
# strict one where others leave the balance open.
OXIDATION = {"La": 3, "Sr": 2, "Ba": 2, "Ce": 4, "Nd": 3, "Eu": 3, "Gd": 3, "Sm": 3, "Pr": 3, "Ca": 2, "K": 1, "Na": 1, "Li": 1, "Zn": 2, "Ni": 2, "O": -2}
OXIDATION_LONG = OXIDATION | {
    "Y": 3, "Bi": 3, "Tl": 3, "Hg": 2, "Pb": 2, "Al": 3, "Ti": 4, "B": 3, "Cd": 2, "Tb": 3, "Lu": 3, "Sc": 3, "Ga": 3, "Cs": 1, "Rb": 1, "Ho": 3, "Er": 3, "Tm": 3, "Yb": 3, "Dy": 3,
    "F": -1, "I": -1, "Co": 3, "Fe": 3, "S": -2, "Se": -2, "Te": -2, "Cl": -1, "Br": -1,
}
OXIDATION_STRICT = {
    "La": 3, "Sr": 2, "Ba": 2, "Ce": 4, "Nd": 3, "Eu": 3, "Gd": 3, "Sm": 3, "Pr": 3, "Ca": 2, "K": 1, "Na": 1, "Li": 1, "Rb": 1, "Cs": 1, "Y": 3, "Dy": 3, "Ho": 3, "Er": 3, "Tm": 3, "Yb": 3,
    "Lu": 3, "Tb": 3, "Sc": 3, "Mg": 2, "Zn": 2, "Cd": 2, "Hg": 2, "O": -2, "F": -1, "Cl": -1, "Br": -1,
}
# Valence electrons of the transition metals; alloys with any other element have no value.
VALENCE = {
    "Sc": 3, "Y": 3, "La": 3, "Lu": 3, "Ti": 4, "Zr": 4, "Hf": 4, "V": 5, "Nb": 5, "Ta": 5, "Cr": 6, "Mo": 6, "W": 6, "Mn": 7, "Tc": 7, "Re": 7, "Fe": 8, "Ru": 8, "Os": 8,
    "Co": 9, "Rh": 9, "Ir": 9, "Ni": 10, "Pd": 10, "Pt": 10,
}

#: Rows, and characters of their keys, up to which a table is sent to every task; larger ones meet their rows by a shuffle.
SENT, SENT_CHARS = 20_000, 2_000_000

_PAIR = r"([A-Z][a-z]?)([0-9.]*)"


def parse(formula: Column) -> Column:
    """map element -> amount of a flat formula; repeated elements add up; null where anything else is in the text."""
    symbols, amounts = (F.regexp_extract_all(formula, F.lit(_PAIR), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(symbols, amounts, lambda e, n: F.struct(e.alias("e"), F.when(n == "", 1.0).otherwise(n.try_cast("double")).alias("n")))
    names = F.array_sort(F.array_distinct(symbols))
    sums = F.transform(names, lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0.0), lambda s, p: s + p["n"]))
    return F.when(formula.rlike(rf"^(?:[A-Z][a-z]?[0-9.]*)+$") & F.forall(pairs, lambda p: p["n"].isNotNull()), F.map_from_arrays(names, sums))


def amount(comp: Column, element: str) -> Column:
    return F.coalesce(F.try_element_at(comp, F.lit(element)), F.lit(0.0))


def whole(comp: Column) -> Column:
    return F.aggregate(F.map_values(comp), F.lit(0.0), lambda s, x: s + x)


def fractions(comp: Column) -> Column:
    n = whole(comp)
    return F.transform_values(comp, lambda _, v: v / n)


def chemsys(comp: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(comp)), "-")


def norm_key(comp: Column, digits: int = 3) -> Column:
    """element:share of the whole, rounded, sorted by element and joined by a pipe."""
    entries = F.array_sort(F.map_entries(fractions(comp)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.format_string(f"%.{digits}f", F.round(e["value"] + 1e-9, digits)))), "|")


def weighted(comp: Column, values: dict[str, float], missing: float | None = None) -> Column:
    """Sum of amount times value; elements without one count ``missing``, or make the result null."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1]))])
    each = F.transform(F.map_entries(comp), lambda e: e["value"] * F.coalesce(F.try_element_at(table, e["key"]), F.lit(missing).cast("double")))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def oxidation_of(comp: Column, centre: str, numbers: dict[str, float] | None = None, missing: float | None = None) -> Column:
    """The charge that balances all elements but ``centre``, for each atom of it; null without any. Elements without a number
    count ``missing``, or leave the result null."""
    rest = F.map_filter(comp, lambda k, _: k != centre)
    return F.try_divide(-weighted(rest, numbers or OXIDATION_STRICT, missing), F.try_element_at(comp, F.lit(centre)))


def distance(a: Column, b: Column, largest: bool = False) -> Column:
    """Sum (or the largest) of the differences of two compositions' shares, over the elements of both."""
    d = F.map_values(F.map_zip_with(fractions(a), fractions(b), lambda _, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))))
    return F.array_max(d) if largest else F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def subsets(elements: Column, drop: int = 3, least: int = 2) -> Column:
    """Keys of the sorted element list and of it without up to ``drop`` elements, while ``least`` stay."""
    def less(lists: Column) -> Column:
        shorter = F.flatten(F.transform(lists, lambda s: F.transform(s, lambda x: F.array_remove(s, x))))
        return F.array_distinct(F.filter(shorter, lambda s: F.size(s) >= least))

    levels = reduce(lambda done, _: [*done, less(done[-1])], range(drop), [F.array(F.array_sort(elements))])
    return F.array_distinct(F.transform(F.flatten(F.array(*levels)), lambda s: F.array_join(s, "-")))


def meet(rows: DataFrame, each: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``each`` (a written table) that has the same keys; nulls are equal.

    Which side is sent isn't left to estimates: ``rows`` never is, and ``each`` is where it was counted to be small.
    """
    texts = reduce(lambda a, b: a + b, [F.coalesce(F.length(F.col(k).cast("string")), F.lit(0)) for k in keys])
    n, chars = each.agg(F.count("*"), F.coalesce(F.sum(texts), F.lit(0))).first()
    right = each.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in each.columns if c not in keys])
    right = F.broadcast(right) if n <= SENT and chars <= SENT_CHARS else right.hint("merge")
    return rows.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def once(rows: DataFrame, keys: list[str], tell: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``tell`` finds for their keys: it gets the different ones and gives any number of rows for each.

    These are written first, or a filter of ``tell`` would be pushed below the distinct and run for every row.
    """
    return meet(rows, written(tell(written(rows.select(*keys).distinct()))), keys)


def entries(spark, sf) -> DataFrame:
    """(id, formula, plain, parent_formula, tc, reports, iqr, built): a row for each of ``part``, all from its key and size.

    Plain formulas are bases; the others hold a dopant besides. One in seven names another base as its parent.
    """
    k, share = F.col("p_partkey"), F.col("p_size") % 10 * 5
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    dopant = F.concat(of(DOPANTS, F.floor(k / len(BASES))), F.lit("0."), F.lpad(share.cast("string"), 2, "0"))
    formula = F.concat(of(BASES, k), F.when(share > 0, dopant).otherwise(""))
    parent = of(BASES, k + F.when(k % 7 == 0, 1).otherwise(0))
    tc = F.when(k % 5 == 0, 0.0).otherwise(k * 37 % 1800 / 10.0)
    rows = table(spark, sf, "part").select(k.alias("id"), formula.alias("formula"), (share == 0).alias("plain"), parent.alias("parent_formula"), tc.alias("tc"), (1 + k % 3).alias("reports"), (k % 13).cast("double").alias("iqr"))
    return rows.withColumn("built", F.when(F.col("id") % 11 == 0, F.col("parent_formula")).otherwise(F.col("formula")))


def formulas(spark, sf) -> DataFrame:
    """``entries`` with ``comp``, their parsed formula."""
    return entries(spark, sf).withColumn("comp", parse(F.col("formula")))


def told(spark, sf, tell: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, ...): what ``tell`` finds for each formula. It gets (formula, comp), a row for each different one, and keeps ``formula``."""
    return once(entries(spark, sf).select("id", "formula"), ["formula"], lambda f: tell(f.withColumn("comp", parse(F.col("formula"))))).drop("formula")


def parents(spark, sf) -> DataFrame:
    """(parent, pcomp, elements): each plain formula once, under its smallest id, with its sorted elements joined."""
    each = entries(spark, sf).filter("plain").groupBy("formula").agg(F.min("id").alias("parent")).withColumn("pcomp", parse(F.col("formula")))
    return each.select("parent", "pcomp", chemsys(F.col("pcomp")).alias("elements"))


def pairs(spark, sf, tell: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, ...): what ``tell`` finds for each formula and the plain ones whose elements are its own without three at most.

    It gets (formula, comp, parent, pcomp), a row for each pair of different formulas, and keeps ``formula``.
    """

    def each(f: DataFrame) -> DataFrame:
        keys = f.select("formula", "comp", F.explode(subsets(F.map_keys("comp"))).alias("elements"))
        return tell(keys.hint("merge").join(written(parents(spark, sf)), "elements").select("formula", "comp", "parent", "pcomp"))

    return told(spark, sf, each)


def _pick(values: list[str], at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({at} % {len(values)} + 1)::INT]"


_ROWS = f"""(SELECT *, CASE WHEN id % 11 = 0 THEN parent_formula ELSE formula END AS built FROM (SELECT p_partkey AS id, {_pick(BASES, 'p_partkey')} || CASE WHEN p_size % 10 > 0 THEN {_pick(DOPANTS, f'(p_partkey // {len(BASES)})')} || '0.' || lpad((p_size % 10 * 5)::VARCHAR, 2, '0') ELSE '' END AS formula,
    p_size % 10 = 0 AS plain, {_pick(BASES, '(p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END)')} AS parent_formula, CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE (p_partkey * 37 % 1800)::DOUBLE / 10 END AS tc, 1 + p_partkey % 3 AS reports, (p_partkey % 13)::DOUBLE AS iqr FROM part))"""
_LIST = f"(SELECT id, formula FROM {_ROWS})"
_TOKENS_OF = "(SELECT id, unnest(regexp_extract_all(formula, '[A-Z][a-z]?[0-9.]*')) AS t FROM {rows})"
_PARTS_OF = "(SELECT id, e, sum(n) AS n FROM (SELECT id, regexp_extract(t, '^[A-Z][a-z]?') AS e, CASE WHEN regexp_extract(t, '[0-9.]+$') = '' THEN 1.0::DOUBLE ELSE regexp_extract(t, '[0-9.]+$')::DOUBLE END AS n FROM " + _TOKENS_OF + ") GROUP BY id, e)"
_PARTS = _PARTS_OF.format(rows=_LIST)
_SHARES = f"(SELECT id, e, n, n / sum(n) OVER (PARTITION BY id) AS f FROM {_PARTS})"
_ELEMENTS = f"(SELECT id, list(e ORDER BY e) AS es FROM {_PARTS} GROUP BY id)"
_POOL = f"(SELECT parent, es AS pes FROM (SELECT min(id) AS parent FROM {_ROWS} WHERE plain GROUP BY formula) JOIN {_ELEMENTS} ON id = parent)"
_PAIRED = f"(SELECT id, parent FROM {_ELEMENTS} JOIN {_POOL} ON list_has_all(es, pes) AND len(es) - len(pes) <= 3 AND len(pes) >= 2)"
#: (id, parent, e, a, b, fa, fb): amounts and shares of both sides of each pair, zero where absent.
_BOTH = f"(SELECT id, parent, e, sum(a) AS a, sum(b) AS b, sum(fa) AS fa, sum(fb) AS fb FROM (SELECT pr.id, pr.parent, e, n AS a, 0 AS b, f AS fa, 0 AS fb FROM {_PAIRED} pr JOIN {_SHARES} s ON s.id = pr.id UNION ALL SELECT pr.id, pr.parent, e, 0, n, 0, f FROM {_PAIRED} pr JOIN {_SHARES} s ON s.id = pr.parent) GROUP BY 1, 2, 3)"


def _values(t: dict[str, float]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in t.items()) + ") v(el, val)"


@query(f"SELECT id, e AS element, round(n, 6) AS amount FROM {_PARTS}")
def fn_parse_composition(spark, sf):
    each = lambda f: f.select("formula", F.explode("comp").alias("element", "amount")).withColumn("amount", F.round("amount", 6))
    return told(spark, sf, each)


@query(f"SELECT id, string_agg(e || printf('%.3f', round(f + 1e-9, 3)), '|' ORDER BY e) AS key FROM {_SHARES} GROUP BY id")
def fn_norm_key(spark, sf):
    return told(spark, sf, lambda f: f.select("formula", norm_key(F.col("comp")).alias("key")))


@query(f"SELECT id, string_agg(e, '-' ORDER BY e) AS chemsys FROM {_PARTS} GROUP BY id")
def fn_chemsys(spark, sf):
    return told(spark, sf, lambda f: f.select("formula", chemsys(F.col("comp")).alias("chemsys")))


@query(f"SELECT id, CASE WHEN count(val) = count(*) THEN round(sum(n * val) / sum(n), 5) END AS ea FROM {_PARTS} LEFT JOIN {_values(VALENCE)} ON el = e GROUP BY id")
def fn_valence_per_atom(spark, sf):
    c = F.col("comp")
    return told(spark, sf, lambda f: f.select("formula", F.round(weighted(c, VALENCE) / whole(c), 5).alias("ea")))


def _balance(numbers: dict[str, float], strict: bool) -> str:
    total = f"(SELECT id, round(-coalesce(sum(n * coalesce(val, 0)) FILTER (e <> 'Cu'), 0) / sum(n) FILTER (e = 'Cu'), 5) AS ox, count(*) FILTER (e <> 'Cu' AND val IS NULL) AS open FROM {_PARTS} LEFT JOIN {_values(numbers)} ON el = e GROUP BY id)"
    return f"(SELECT id, CASE WHEN open = 0 THEN ox END AS ox FROM {total})" if strict else f"(SELECT id, ox FROM {total})"


@query(f"SELECT id, a.ox AS short, b.ox AS long, c.ox AS strict FROM {_balance(OXIDATION, False)} a JOIN {_balance(OXIDATION_LONG, False)} b USING (id) JOIN {_balance(OXIDATION_STRICT, True)} c USING (id)")
def fn_cu_oxidation(spark, sf):
    """The three balances: two where unknown elements count nothing, and one that is left open by them."""
    of = lambda numbers, missing: F.round(oxidation_of(F.col("comp"), "Cu", numbers, missing), 5)
    return told(spark, sf, lambda f: f.select("formula", of(OXIDATION, 0.0).alias("short"), of(OXIDATION_LONG, 0.0).alias("long"), of(OXIDATION_STRICT, None).alias("strict")))


@query(f"SELECT id, round(sum(n) FILTER (e = 'O') / nullif(sum(n) FILTER (e <> 'O'), 0), 5) AS ratio FROM {_PARTS} GROUP BY id HAVING count(*) FILTER (e = 'O') > 0")
def fn_anion_ratio(spark, sf):
    o = amount(F.col("comp"), "O")
    return told(spark, sf, lambda f: f.filter(o > 0).select("formula", F.round(F.try_divide(o, whole(F.col("comp")) - o), 5).alias("ratio")))


@query(f"SELECT id, round(coalesce((2 * coalesce(sum(n) FILTER (e = 'O'), 0) - 3 * coalesce(sum(n) FILTER (e IN ('La', 'Nd')), 0) - 2 * coalesce(sum(n) FILTER (e = 'Sr'), 0)) / sum(n) FILTER (e = 'Ni'), -1), 5) AS ni FROM {_PARTS} GROUP BY id")
def fn_ni_valence(spark, sf):
    c = F.col("comp")
    ni = F.try_divide(2 * amount(c, "O") - 3 * (amount(c, "La") + amount(c, "Nd")) - 2 * amount(c, "Sr"), F.nullif(amount(c, "Ni"), F.lit(0.0)))
    return told(spark, sf, lambda f: f.select("formula", F.round(F.coalesce(ni, F.lit(-1.0)), 5).alias("ni")))


@query(f"SELECT id, parent AS other, round(sum(abs(fa - fb)), 5) AS l1, round(max(abs(fa - fb)), 5) AS largest FROM {_BOTH} GROUP BY 1, 2")
def fn_comp_error(spark, sf):
    d = lambda largest: F.round(distance(F.col("comp"), F.col("pcomp"), largest), 5)
    return pairs(spark, sf, lambda p: p.select("formula", F.col("parent").alias("other"), d(False).alias("l1"), d(True).alias("largest")))


@query(f"SELECT id, count(*)::INT AS n_subsets FROM (SELECT DISTINCT p.id, m FROM (SELECT id, count(*)::INT AS k FROM {_PARTS} GROUP BY id) p, range(1, 512) r(m) WHERE m < pow(2, k) AND bit_count(m::INT) >= greatest(k - 3, least(k, 2)) AND (bit_count(m::INT) >= 2)) GROUP BY id")
def fn_subsets(spark, sf):
    return told(spark, sf, lambda f: f.select("formula", F.size(subsets(F.map_keys("comp"))).alias("n_subsets")))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(k, '-MP-(mp-[0-9]+)', 1), ''), k) AS parent, regexp_extract(k, '^(.*?)(?:-(?:MP|ICSD)-.*)?$', 1) AS formula FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE source || '-MP-mp-' || doc_id || '.cif' END AS k FROM documents)")
def fn_parent_id(spark, sf):
    k = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat("source", F.lit("-MP-mp-"), F.col("doc_id").cast("string"), F.lit(".cif")))
    d = table(spark, sf, "documents").select("doc_id", k.alias("k"))
    parent = F.coalesce(F.nullif(F.regexp_extract("k", "-MP-(mp-[0-9]+)", 1), F.lit("")), F.col("k"))
    return d.select("doc_id", parent.alias("parent"), F.regexp_extract("k", "^(.*?)(?:-(?:MP|ICSD)-.*)?$", 1).alias("formula"))


@query("SELECT event_id, CASE WHEN t > 0 AND t < 2000 THEN round(t, 4) END AS kelvin FROM (SELECT event_id, round(value, 2) + CASE WHEN event_id % 2 = 0 THEN 273.15 ELSE 0 END AS t FROM events)")
def fn_parse_temp(spark, sf):
    text = F.concat(F.lit("T = "), F.format_string("%.2f", F.round("value", 2)), F.when(F.col("event_id") % 2 == 0, " °C").otherwise(" K"))
    e = table(spark, sf, "events").select("event_id", text.alias("s"))
    t = F.regexp_extract("s", r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") + F.when(F.col("s").contains("°C"), 273.15).otherwise(0.0)
    return e.select("event_id", F.when((t > 0) & (t < 2000), F.round(t, 4)).alias("kelvin"))
