"""Readers with explicit schemas, and writes that appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.windows import global_position
from lodestone.registry import query, scratch, table, written

# Columns that a property table may have beside its id.
TARGETS = ("tc", "e_above_hull", "formation_energy_per_atom", "energy_per_atom", "bandgap", "eph_lambda", "eph_wlog")


def read_properties(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``cif`` and the known targets of a CSV file, absent ones null; without a header ``cif, tc``."""
    if not header:
        return spark.read.schema("cif string, tc double").csv(path)
    raw = spark.read.option("header", True).csv(path)
    return raw.select("cif", *[(F.col(t).try_cast("double") if t in raw.columns else F.lit(None).cast("double")).alias(t) for t in TARGETS])


def frames(documents: DataFrame, column: str) -> DataFrame:
    """(outer, inner, energy, structure) of ``{outer: {inner: frame}}`` documents; frames without structure or energy go."""
    frame = "struct<energy: double, corrected: double, structure: string>"
    outer = documents.select(F.explode(F.from_json(column, f"map<string, map<string, {frame}>>")).alias("outer", "frames"))
    each = outer.select("outer", F.explode("frames").alias("inner", "f"))
    return each.filter("f.structure IS NOT NULL").select("outer", "inner", F.coalesce("f.corrected", "f.energy").alias("energy"), "f.structure").filter("energy IS NOT NULL")


@query("SELECT 'n' || n_nationkey AS cif, n_regionkey::DOUBLE AS tc, NULL::DOUBLE AS bandgap FROM nation")
def scan_csv_header(spark, sf):
    path = scratch(spark)
    table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("cif"), F.col("n_regionkey").alias("tc"), F.col("n_name").alias("extra")).write.option("header", True).csv(path)
    return read_properties(spark, path).select("cif", "tc", "bandgap")


@query("SELECT 'n' || n_nationkey AS cif, n_regionkey::DOUBLE AS tc FROM nation")
def scan_csv_headerless(spark, sf):
    path = scratch(spark)
    table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), "n_regionkey").write.csv(path)
    return read_properties(spark, path, header=False)


@query("(SELECT c_custkey AS id, 'c' AS src FROM customer ORDER BY c_custkey LIMIT 10) UNION ALL (SELECT s_suppkey, 's' FROM supplier ORDER BY s_suppkey LIMIT 10)")
def scan_limit_per_source(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("src")).orderBy("id").limit(10)
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("src")).orderBy("id").limit(10))


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(id, value, label, graph_path) of an index table whose columns may be fewer: no label is 0, no path is the id's file, and rows
    without an id or a value go."""
    df = spark.read.schema(schema).parquet(path)
    have = lambda c, otherwise: F.coalesce(F.col(c), otherwise) if c in df.columns else otherwise
    rows = df.select(F.col("id").cast("string").alias("id"), F.col("value").cast("double").alias("value"), have("label", F.lit(0)).cast("int").alias("label"), have("graph_path", F.concat(F.lit("graphs/"), F.col("id").cast("string"), F.lit(".json"))).alias("graph_path"))
    return rows.filter(F.col("id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


@query("SELECT o_orderkey::VARCHAR AS id, o_totalprice AS value, (o_orderstatus = 'F')::INT AS label, 'graphs/' || o_orderkey || '.json' AS graph_path FROM orders WHERE o_orderkey % 9 > 0 UNION ALL SELECT 'c' || c_custkey, c_acctbal, 0, 'own/' || c_custkey FROM customer WHERE c_acctbal IS NOT NULL")
def scan_pickle_index(spark, sf):
    """Two indexes with different columns, each read by the part that it needs."""
    a, b = scratch(spark), scratch(spark)
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")).alias("value"), F.when(F.col("o_orderstatus") == "F", 1).alias("label"), "o_custkey").write.parquet(a)
    table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_acctbal").alias("value"), F.concat(F.lit("own/"), F.col("c_custkey").cast("string")).alias("graph_path")).write.parquet(b)
    return read_index(spark, a, "id long, value double, label int").unionByName(read_index(spark, b, "id string, value double, graph_path string"))


GRAPH = "id long, nodes array<struct<Z: long, chi: double>>, edges array<struct<source: int, target: int, bond_length: double>>"


@query("""SELECT l_orderkey AS id, count(*) AS n_nodes, count(*) - 1 AS n_edges, round(coalesce(sum(l_quantity) FILTER (i < n), 0), 2) AS bonds, sum(l_partkey) AS z FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)) GROUP BY 1""")
def scan_graph_json(spark, sf):
    """Nested graph records, written as JSON and read back with their whole schema; a key that isn't in it is passed over."""
    path = scratch(spark)
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount")))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rows.alias("r"))
    edge = lambda x, i: F.struct(i.alias("source"), (i + 1).alias("target"), x["l_quantity"].alias("bond_length"))
    nodes = F.transform("r", lambda x: F.struct(x["l_partkey"].alias("Z"), x["l_discount"].alias("chi"), F.lit("unread").alias("note")))
    g.select("id", nodes.alias("nodes"), F.transform(F.slice("r", F.lit(1), F.size("r") - 1), edge).alias("edges")).write.json(path)
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return spark.read.schema(GRAPH).json(path).select("id", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), F.round(sums(F.col("edges.bond_length")), 2).alias("bonds"), F.aggregate("nodes.Z", F.lit(0).cast("long"), lambda s, x: s + x).alias("z"))


@query("SELECT 'm' || (event_id % 9) AS \"outer\", 'f' || event_id AS \"inner\", round(value, 4) AS energy FROM events WHERE event_id % 4 <> 0 AND value IS NOT NULL")
def scan_json_kv_stream(spark, sf):
    frame = F.struct(F.round("value", 4).alias("energy"), F.when(F.col("event_id") % 4 != 0, F.lit("s")).alias("structure"))
    doc = F.to_json(F.create_map(F.concat(F.lit("m"), F.col("event_id") % 9), F.create_map(F.concat(F.lit("f"), F.col("event_id").cast("string")), frame)))
    return frames(table(spark, sf, "events").select(doc.alias("doc")), "doc").select("outer", "inner", "energy")


@query("SELECT page_id, url FROM pages")
def scan_jsonl_gz(spark, sf):
    path = scratch(spark)
    table(spark, sf, "pages").select("page_id", "url").write.option("compression", "gzip").json(path)
    return spark.read.schema("page_id long, url string, location string").json(path).select("page_id", F.coalesce("url", "location").alias("url"))


@query("SELECT 'mb-' || lpad((row_number() OVER (ORDER BY p_partkey) - 1)::VARCHAR, greatest(6, len((row_number() OVER (ORDER BY p_partkey) - 1)::VARCHAR))::INT, '0') AS id, p_partkey FROM part")
def scan_json_gz_split_orient(spark, sf, rows: int = 1000):
    """``{first, columns, data}`` documents of ``rows`` rows each; a row's id is its place among all of them."""
    path = scratch(spark)
    at = global_position(table(spark, sf, "part").select("p_partkey"), ["p_partkey"]).withColumn("document", F.floor(F.col("position") / rows))
    data = F.transform(F.array_sort(F.collect_list(F.struct("position", "p_partkey"))), lambda r: F.array(r["p_partkey"]))  # ``rows`` at most
    at.groupBy("document").agg(F.min("position").alias("first"), data.alias("data")).select("first", F.array(F.lit("p_partkey")).alias("columns"), "data").write.option("compression", "gzip").json(path)
    back = spark.read.schema("first long, columns array<string>, data array<array<long>>").json(path).select("first", F.posexplode("data").alias("pos", "row"))
    return back.select(F.format_string("mb-%06d", F.col("first") + F.col("pos")).alias("id"), F.get("row", F.lit(0)).alias("p_partkey"))


@query("SELECT o_orderkey AS x, round(o_totalprice, 2) AS y FROM orders")
def scan_text_regex(spark, sf):
    path = scratch(spark)
    line = F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit("   "), F.format_string("%.2f", "o_totalprice"))
    table(spark, sf, "orders").select(F.explode(F.array(F.lit("# a comment"), line)).alias("value")).write.text(path)
    number = r"^\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*$"
    t = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return t.select(F.regexp_extract("value", number, 1).cast("long").alias("x"), F.regexp_extract("value", number, 2).cast("double").alias("y"))


def listed_ids(spark: SparkSession, folders: list[str], pattern: str) -> DataFrame:
    """(id, path): an id for each file of ``folders`` whose name fits ``pattern`` (its first group), from the first folder that has it.

    Only the listing is used; contents aren't read.
    """
    out = None
    for k, folder in enumerate(folders):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1).alias("id"), F.lit(k).alias("folder"))
        out = found if out is None else out.unionByName(found)
    return out.filter("id <> ''").groupBy("id").agg(F.min_by("path", F.struct("folder", "path")).alias("path"), F.min("folder").alias("folder"))


@query("SELECT 'mp-' || n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END AS folder FROM nation WHERE n_nationkey % 4 <> 1 OR n_nationkey % 3 = 0")
def scan_dir_listing(spark, sf):
    """Two folders of files named after ids: the first folder wins, files with other names don't count."""
    path, hadoop = scratch(spark), spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in table(spark, sf, "nation").select("n_nationkey").collect():  # 25 nations: the files that are listed afterwards
        k = r["n_nationkey"]
        names = [f"a/mp-{k}.json"] * (k % 3 == 0) + [f"b/other-{k}.json" if k % 4 == 1 else f"b/mp-{k}.cif.json"]
        for name in names:
            out = fs.create(hadoop(f"{path}/{name}"))
            out.writeByte(1)  # readers pass over empty files
            out.close()
    return listed_ids(spark, [f"{path}/a", f"{path}/b"], r"^(mp-.*?)(?:\.cif)?\.json$").select("id", "folder")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderstatus = 'F'")
def source_chunked_resumable(spark, sf):
    """Banked ids first, then the rest by an anti-join; running it again adds nothing."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").filter("o_orderkey % 3 <> 0 OR o_orderstatus = 'F'")
    banked = written(o.filter("o_orderstatus = 'F'").select("o_orderkey"))
    return banked.unionByName(o.join(banked, "o_orderkey", "left_anti").select("o_orderkey"))


@query("SELECT c_custkey, c_name FROM customer")
def sink_atomic(spark, sf):
    """A table that replaces an older one in one move."""
    c, target = table(spark, sf, "customer").select("c_custkey", "c_name"), scratch(spark)
    swap_in(c.withColumn("c_name", F.lit("old")), target)
    swap_in(c, target)
    return spark.read.schema(c.schema).parquet(target)


@query("SELECT doc_id % 5 AS material, CASE WHEN doc_id % 2 = 0 THEN 'dfpt' ELSE 'togo' END AS method, count(*) AS n FROM documents GROUP BY 1, 2")
def scan_npz(spark, sf):
    """Arrays of a material with the method that made them, as a partitioned table: a filter on the method reads only its files."""
    path = scratch(spark)
    method = F.when(F.col("doc_id") % 2 == 0, "dfpt").otherwise("togo")
    table(spark, sf, "documents").select((F.col("doc_id") % 5).alias("material"), F.array(F.col("n_chars")).alias("values"), method.alias("method")).write.partitionBy("method").parquet(path)
    return spark.read.parquet(path).groupBy("material", "method").agg(F.count("*").alias("n"))


def read_header_fields(archives: DataFrame, member: str, fields: list[str]) -> DataFrame:
    """(path, fields...) of the top-level ``key: value`` lines of an xz member of zip archives, as ``binaryFile`` reads them.

    Lines are read until all fields are found, so the large tables after the header are never unpacked. A field that isn't
    there is null; an archive without the member gives nulls.
    """
    import io
    import lzma
    import zipfile

    import pandas as pd

    def read(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                found: dict[str, str | None] = dict.fromkeys(fields)
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == member]
                    if names:
                        with z.open(names[0]) as raw, lzma.open(raw, "rt", encoding="utf-8") as lines:
                            for line in lines:
                                key, colon, value = line.partition(":")
                                if colon and found.get(key, "") is None:
                                    found[key] = value.strip()
                                    if all(v is not None for v in found.values()):
                                        break
                rows.append([path, *found.values()])
            yield pd.DataFrame(rows, columns=["path", *fields])

    return archives.select("path", "content").mapInPandas(read, ", ".join(["path string", *[f"{f} string" for f in fields]]))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey::VARCHAR END AS natom, CASE WHEN n_nationkey % 4 > 0 THEN 'P' || n_nationkey END AS space_group FROM nation")
def scan_zip_yaml_xz(spark, sf):
    """Headers of compressed members of archives, one archive a nation; some lack a field, some the member."""
    import io
    import lzma
    import zipfile

    path, hadoop = scratch(spark), spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect():  # 25 nations: the archives that are read afterwards
        k, raw = r["n_nationkey"], io.BytesIO()
        body = "".join([f"natom: {k}\n"] * (k % 5 > 0) + [f"space_group: P{k}\n"] * (k % 4 > 0) + ["forces:\n"] + ["- [0, 0, 0]\n"] * 50)
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("run/phonopy_params.yaml.xz" if k % 20 > 0 else "other.txt", lzma.compress(body.encode()))
        out = fs.create(hadoop(f"{path}/{r['n_name']}.zip"))
        out.write(bytearray(raw.getvalue()))
        out.close()
    found = read_header_fields(spark.read.format("binaryFile").load(path), "phonopy_params.yaml.xz", ["natom", "space_group"])
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*)\.zip$", 1)
    return found.select(F.url_decode(F.regexp_replace(name, r"\+", "%2B")).alias("name"), "natom", "space_group")


def read_cif_header(files: DataFrame) -> DataFrame:
    """(path, formula, cell volume) from the tags of CIF text, one file a row as ``wholetext`` reads them; stray lines before the
    data block don't matter. Structures themselves aren't built."""
    formula = F.regexp_extract("value", r"(?m)^_chemical_formula_sum\s+['\"]?([^'\"\n]+?)['\"]?\s*$", 1)
    volume = F.regexp_extract("value", r"(?m)^_cell_volume\s+([0-9.]+)", 1).try_cast("double")
    return files.select("path", F.nullif(formula, F.lit("")).alias("formula"), volume.alias("volume"))


@query("SELECT 'Nb' || (n_nationkey + 1) || ' Sn1' AS formula, n_nationkey + 0.5::DOUBLE AS volume FROM nation")
def scan_cif(spark, sf):
    path = scratch(spark)
    n = F.col("n_nationkey")
    body = F.concat(F.lit("stray\ndata_x\n_chemical_formula_sum 'Nb"), (n + 1).cast("string"), F.lit(" Sn1'\n_cell_volume "), (n + 0.5).cast("string"), F.lit("(3)"))
    table(spark, sf, "nation").select(body.alias("value"), n).write.partitionBy("n_nationkey").text(path)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    return read_cif_header(files).select("formula", "volume")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def sink_pickle_csv_twin(spark, sf):
    """The index as Parquet and as CSV with the same order of columns; the Parquet side is read back with the CSV's names."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    twin, path = written(s), scratch(spark)
    twin.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(twin.schema).csv(path)


def swap_in(df: DataFrame, target: str) -> None:
    """Write beside ``target`` and rename when whole; what a broken run leaves is ``target.partial`` or ``target.old``, never a half-written target."""
    spark = df.sparkSession
    part = f"{target}.partial"
    df.write.mode("overwrite").parquet(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, old = path(target).getFileSystem(spark._jsc.hadoopConfiguration()), f"{target}.old"
    fs.delete(path(old), True)
    # the old table steps aside first, so at each moment one whole table is there
    if fs.exists(path(target)) and not fs.rename(path(target), path(old)):
        raise OSError(f"could not move {target} aside")
    if not fs.rename(path(part), path(target)):
        fs.rename(path(old), path(target))
        raise OSError(f"could not move {part} to {target}")
    fs.delete(path(old), True)


@query("SELECT n_nationkey, n_name FROM nation")
def sink_partial_on_abort(spark, sf):
    """A run that fails midway leaves the table that was there as it was."""
    from pyspark.errors import PySparkException

    n, target = table(spark, sf, "nation").select("n_nationkey", "n_name"), scratch(spark)
    swap_in(n, target)
    broken = n.withColumn("n_name", F.when(F.col("n_nationkey") < 10, F.col("n_name")).otherwise(F.raise_error("the source broke off")))
    try:
        swap_in(broken, target)
    except PySparkException:
        pass
    return spark.read.schema(n.schema).parquet(target)


@query("SELECT l_orderkey, count(*)::BIGINT AS n_nodes, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1")
def sink_pack(spark, sf):
    """Nested records in a columnar table; a later read takes only the parts it names."""
    node = F.struct("l_linenumber", "l_partkey", "l_quantity")
    packed = written(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(node).alias("nodes")))
    return packed.select("l_orderkey", F.size("nodes").cast("long").alias("n_nodes"), F.array_min("nodes.l_linenumber").alias("first_line"))


@query("SELECT event_id, event_type FROM events WHERE value > 10")
def sink_incremental_csv(spark, sf):
    """Two appends to the same CSV table; readers see whole files only."""
    e, path = table(spark, sf, "events").filter("value > 10").select("event_id", "event_type"), scratch(spark)
    for odd in (0, 1):
        e.filter(F.col("event_id") % 2 == odd).write.mode("append").csv(path)
    return spark.read.schema(e.schema).csv(path)
