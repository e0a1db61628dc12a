"""Readers of crystal files: the loops of CIF texts, spectra of two columns, and edges from both ends, as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf

from lodestone.registry import query, table

_TOKEN = re.compile(r"(?m)^;(?P<text>.*?)^;|'(?P<one>[^\n]*?)'(?=\s|\Z)|\"(?P<two>[^\n]*?)\"(?=\s|\Z)|#[^\n]*|(?P<bare>\S+)", re.DOTALL)
_NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?:\(\d+\))?")
_SITE = {
    "label": "_atom_site_label", "type": "_atom_site_type_symbol", "x": "_atom_site_fract_x", "y": "_atom_site_fract_y", "z": "_atom_site_fract_z",
    "occupancy": "_atom_site_occupancy", "multiplicity": "_atom_site_symmetry_multiplicity",
}
_SITES = pa.list_(pa.struct([("label", pa.string()), ("element", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("occupancy", pa.float64()), ("multiplicity", pa.int32())]))


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(value, whether it was quoted) of a CIF text: bare words, quoted strings and text fields; comments go."""
    for m in _TOKEN.finditer(text):
        if kind := m.lastgroup:
            yield m[kind], kind != "bare"


@lru_cache(1 << 14)
def element_of(name: str) -> str | None:
    """The symbol that a type or a label begins with."""
    m = re.match(r"[A-Z][a-z]?", name)
    return m[0] if m else None


def loops(text: str) -> Iterator[dict[str, list[str | None]]]:
    """The columns of each ``loop_`` by tag; ``.`` and ``?`` are None, and values that fill no whole row go."""
    tags: list[str] = []
    values: list[str | None] = []
    state = ""

    def done() -> Iterator[dict[str, list[str | None]]]:
        if tags and state == "values":
            n = len(values) // len(tags)
            yield {t: values[k : n * len(tags) : len(tags)] for k, t in enumerate(tags)}

    for value, quoted in tokens(text):
        word = "" if quoted else value.lower()
        if word == "loop_":
            yield from done()
            tags, values, state = [], [], "tags"
        elif state == "tags" and word.startswith("_"):
            tags.append(word)
        elif state and (word.startswith(("_", "data_", "save_")) or word in ("global_", "stop_")):
            yield from done()
            state = ""
        elif state:
            state = "values"
            values.append(None if word in (".", "?") else value)
    yield from done()


@lru_cache(1 << 14)
def number(value: str | None) -> float | None:
    """A value without its uncertainty in brackets; None where it isn't a number."""
    m = _NUMBER.fullmatch(value or "")
    return float(m[1]) if m else None


def site_columns(text: str | None) -> dict[str, list] | None:
    """The columns of the first loop that has sites: the element from the type or else the label, one where no occupancy or
    multiplicity is given. None where there is no such loop."""
    for loop in loops(text or ""):
        if _SITE["label"] in loop or _SITE["type"] in loop:
            n = len(next(iter(loop.values())))
            of = {k: loop.get(t, [None] * n) for k, t in _SITE.items()}
            numbers = {k: list(map(number, of[k])) for k in ("x", "y", "z", "occupancy", "multiplicity")}
            return {
                "label": of["label"], "element": [element_of(kind or label or "") for kind, label in zip(of["type"], of["label"], strict=True)], **{c: numbers[c] for c in "xyz"},
                "occupancy": [1.0 if x is None else x for x in numbers["occupancy"]], "multiplicity": [1 if x is None else int(x) for x in numbers["multiplicity"]],
            }
    return None


def sites(text: str | None) -> list[dict] | None:
    """``site_columns`` as a row for each site."""
    found = site_columns(text)
    return None if found is None else [dict(zip(found, row, strict=True)) for row in zip(*found.values(), strict=True)]


def _site_lists(texts: list[str | None]) -> pa.Array:
    """The sites of each text, put together column by column."""
    found = [site_columns(x) for x in texts]
    counts = np.array([0 if x is None else len(x["label"]) for x in found], np.int32)
    kind = _SITES.value_type
    columns = [pa.array([v for x in found if x is not None for v in x[f.name]], f.type) for f in kind]
    ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(kind)), type=_SITES, mask=pa.array([x is None for x in found], pa.bool_()))


def read_cif_sites(files: DataFrame, text_col: str = "value") -> DataFrame:
    """``files`` with ``sites`` and their ``comp``, the sum of occupancy times multiplicity by element, in place of the text.

    One CIF text is one row, as ``wholetext`` reads files. A text without a loop of sites has null for both; nothing is
    built from the sites, so symmetry counts only where the file gives multiplicities.
    """
    rest = [c for c in files.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _site_lists(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), found], [*rest, "sites"])

    site = "array<struct<label string, element string, x double, y double, z double, occupancy double, multiplicity int>>"
    out = files.mapInArrow(run, T.StructType([*(files.schema[c] for c in rest), *T._parse_datatype_string(f"sites {site}").fields]))
    names = F.array_sort(F.array_compact(F.array_distinct("sites.element")))
    amounts = F.transform(names, lambda e: F.aggregate(F.filter("sites", lambda s: s["element"] == e), F.lit(0.0), lambda t, s: t + s["occupancy"] * s["multiplicity"]))
    return out.withColumn("comp", F.map_from_arrays(names, amounts))


#: The order of a line's element.
_KINDS = ["Y", "Ba", "Cu", "O", "Nd", "Fe", "As"]


@query(f"""WITH s AS (SELECT l_orderkey AS id, {_KINDS!r}[l_linenumber] AS element, CASE WHEN l_tax < 0.07 THEN round(1 - l_discount, 2) ELSE 1 END AS occ, l_suppkey % 4 + 1 AS mult, l_quantity AS x FROM lineitem)
    SELECT id, element, round(sum(occ * mult), 6) AS amount, count(*) AS sites, round(max(x / 100), 6) AS x FROM s GROUP BY 1, 2""")
def scan_cif_sites(spark, sf):
    """Sites of CIF texts, one for each order, with quotes, comments, uncertainties and absent occupancies, and the composition from them."""
    line = F.concat_ws(
        " ", F.concat(F.lit("'"), F.element_at(F.array(*map(F.lit, _KINDS)), F.col("l_linenumber").cast("int")), F.lit(" 1'")), F.concat(F.element_at(F.array(*map(F.lit, _KINDS)), F.col("l_linenumber").cast("int")), F.lit("3+")),
        F.concat(F.format_string("%.2f", F.col("l_quantity") / 100), F.lit("(4)")), F.lit("0.5 ."), F.when(F.col("l_tax") < 0.07, F.format_string("%.2f", 1 - F.col("l_discount"))).otherwise("?"), (F.col("l_suppkey") % 4 + 1).cast("string"), F.lit("# a site"),
    )
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    head = "stray line\ndata_x\n_cell_volume 173.1(2)\nloop_\n_symmetry_equiv_pos_as_xyz\n'x, y, z'\n\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n_atom_site_occupancy\n_atom_site_symmetry_multiplicity\n"
    text = F.concat(F.lit(head), "body", F.lit("\n_refine_note\n;\nloop_ of words\n;\n"))
    found = read_cif_sites(lines.select("id", text.alias("value")))
    # a text is parsed once: its elements come with their sites, and nothing is joined
    each = found.select("id", "sites", F.explode("comp").alias("element", "amount"))
    own = F.filter("sites", lambda s: s["element"] == F.col("element"))
    return each.select("id", "element", F.round("amount", 6).alias("amount"), F.size(own).cast("long").alias("sites"), F.round(F.array_max(F.transform(own, lambda s: s["x"])), 6).alias("x"))


# What a rydberg is in THz and in kelvin, and below how many kelvin a spectrum is smearing.
RYDBERG_THZ, RYDBERG_KELVIN, SMEARED_KELVIN = 13605.693122994 / 4.135667696, 157887.5, 12.0


@arrow_udtf(returnType="id long, thz double, a2f double")
class ReadSpectrum:
    """(id, thz, a2f) of a table (id, text): the lines whose first two words are numbers, the first of them in rydbergs and above what is smearing."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        least, of, rows = SMEARED_KELVIN * RYDBERG_THZ / RYDBERG_KELVIN, [], []
        for k, x in enumerate(batch.column("text").to_pylist()):
            for line in (x or "").splitlines():
                words = line.split()
                if len(words) >= 2 and not words[0].startswith("#"):
                    try:
                        rows.append((float(words[0]), float(words[1])))
                    except ValueError:
                        continue
                    of.append(k)
        at, value = np.array(rows, np.float64).reshape(-1, 2).T
        at, keep = at * RYDBERG_THZ, at * RYDBERG_THZ > least
        yield pa.table({"id": batch.column("id").take(pa.array(np.array(of, np.int64)[keep])), "thz": at[keep], "a2f": value[keep]})


@arrow_udtf(returnType="id long, center int, other int, edge int, image array<int>")
class EdgeDirections:
    """Both ways of each edge of a table (id, edge, source, target, image): from its source with its image, and from its target with the image turned round."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        ids, edge, source, target, image = (batch.column(c) for c in ("id", "edge", "source", "target", "image"))
        turned = pa.ListArray.from_arrays(image.offsets, pc.negate(image.values), mask=image.is_null())
        both = lambda a, b: pa.concat_arrays([a, b])
        yield pa.table({"id": both(ids, ids), "center": both(source, target), "other": both(target, source), "edge": both(edge, edge), "image": both(image.cast(turned.type), turned)})


def register(spark: SparkSession) -> None:
    """Both for SQL, as ``read_spectrum(TABLE(...))`` and ``edge_directions(TABLE(...))``: each part of the table goes through in batches, where it is."""
    spark.udtf.register("read_spectrum", ReadSpectrum)
    spark.udtf.register("edge_directions", EdgeDirections)


@query(f"""WITH l AS (SELECT l_orderkey AS id, l_quantity / 1000 * {RYDBERG_THZ!r} / 100 AS thz, l_discount AS a2f, l_linenumber FROM lineitem WHERE l_returnflag <> 'A')
    SELECT id, count(*) AS points, round(sum(thz), 5) AS thz, round(sum(a2f), 5) AS a2f FROM l WHERE thz > {SMEARED_KELVIN * RYDBERG_THZ / RYDBERG_KELVIN!r} GROUP BY 1""")
def fn_read_a2f(spark, sf):
    """Spectra from texts of two columns, one for each order, by a table function; comments and lines of words are passed over."""
    flag = F.col("l_returnflag")
    line = F.concat(F.when(flag == "A", "# ").otherwise(""), F.format_string("%.6f", F.col("l_quantity") / 100000), F.lit(" "), F.format_string("%.2f", "l_discount"), F.lit(" third"))
    texts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("omega a2f\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    register(spark)
    rows = spark.sql("SELECT * FROM read_spectrum(TABLE(SELECT id, text FROM {texts}))", texts=texts)
    return rows.groupBy("id").agg(F.count("*").alias("points"), F.round(F.sum("thz"), 5).alias("thz"), F.round(F.sum("a2f"), 5).alias("a2f"))


@query("""WITH x AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS k, l_tax > 0.03 AS has FROM lineitem)
    SELECT id, i::INT AS center, ((i + 1) % k)::INT AS other, i::INT AS edge, CASE WHEN has THEN i::INT END AS last FROM x UNION ALL SELECT id, ((i + 1) % k)::INT, i::INT, i::INT, CASE WHEN has THEN -i::INT END FROM x""")
def fn_edge_directions(spark, sf):
    """Each bond of the full records from both of its ends, with the last number of the cell that the other end is in."""
    from lodestone.operators.projections import full_records

    register(spark)
    edges = full_records(spark, sf).select("id", F.explode("edges").alias("e"))
    edges = edges.select("id", *[F.col(f"e.{c}").cast("int").alias(c) for c in ("source", "target")], F.col("e.id").cast("int").alias("edge"), F.col("e.to_jimage").cast("array<int>").alias("image"))
    rows = spark.sql("SELECT * FROM edge_directions(TABLE(SELECT id, edge, source, target, image FROM {edges}))", edges=edges)
    return rows.select("id", "center", "other", "edge", F.get("image", F.lit(2)).alias("last"))
