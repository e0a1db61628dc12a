"""Targets, masks, filters and rule cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.registry import query, table


def resolve_target_column(df: DataFrame, wanted: str | None, fallbacks: tuple[str, ...] = ("value", "tc")) -> str:
    """The first of ``wanted`` and the fallbacks that exists and has a value somewhere; an error if there is none."""
    names = [c for c in ((wanted,) if wanted else fallbacks) if c in df.columns]
    if names:
        some = df.agg(*[F.count(c).alias(c) for c in names]).first()
        for c in names:
            if some[c]:
                return c
    raise ValueError(f"no usable target among {wanted or fallbacks}")


def cascade(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds; the order of the rules is part of the meaning."""
    out = F.when(rules[0][0], rules[0][1])
    for c, label in rules[1:]:
        out = out.when(c, label)
    return out.otherwise(otherwise)


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


@query("SELECT o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_totalprice IS NOT NULL")
def resolve_target(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("double").alias("value"), F.col("o_totalprice").alias("tc"))
    return df.select("id", F.col(resolve_target_column(df, None)).alias("value")).filter("value IS NOT NULL")


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL AND event_type <> 'view'")
def drop_null_target(spark, sf):
    return table(spark, sf, "events").filter("value IS NOT NULL AND event_type <> 'view'").select("event_id", "value")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS target, try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL AS present FROM events")
def keep_all_masked(spark, sf):
    target = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf, "events").select("event_id", target.alias("target"), target.isNotNull().alias("present"))


@query("SELECT doc_id, try_cast(split_part(text, ' ', 1) AS DOUBLE) AS number FROM documents")
def coerce_numeric(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).try_cast("double").alias("number"))


@query("SELECT count(*) = count(o_custkey) AS usable, count(DISTINCT o_custkey) AS n_groups FROM orders")
def groups_all_or_nothing(spark, sf):
    return table(spark, sf, "orders").agg((F.count("*") == F.count("o_custkey")).alias("usable"), F.count_distinct("o_custkey").alias("n_groups"))


@query("SELECT c_custkey, c_name, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def project_map_column(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    c = table(spark, sf, "customer")
    return c.join(nation, c.c_nationkey == nation.n_nationkey, "left").select("c_custkey", "c_name", "nation")


@query("SELECT c_custkey AS id, c_acctbal AS value, 1 AS label FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 0 FROM supplier")
def label_from_source(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit(1).alias("label"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"), F.lit(0).alias("label")))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS role FROM lineitem")
def enum_encode(spark, sf):
    codes = F.create_map(F.lit("A"), F.lit(1), F.lit("R"), F.lit(-1))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.try_element_at(codes, F.col("l_returnflag")), F.lit(0)).alias("role"))


@query("SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0.0 ELSE value END AS feature FROM events")
def null_to_zero_features(spark, sf):
    return table(spark, sf, "events").select("event_id", finite_or_zero(F.col("value")).alias("feature"))


def renamed(props: Column, names: list[str], prefix: str) -> Column:
    """The first of ``names`` that a JSON object has; the job fails where it has none of them but another key of that prefix."""
    value = F.coalesce(*[F.get_json_object(props, f"$.{n}") for n in names])
    strange = F.exists(F.coalesce(F.json_object_keys(props), F.array().cast("array<string>")), lambda k: F.startswith(k, F.lit(prefix)))
    return F.when(value.isNull() & strange, F.raise_error(F.concat(F.lit("the schema has changed: "), props))).otherwise(value)


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.k_all')) AS field FROM events")
def renamed_field_coalesce(spark, sf):
    return table(spark, sf, "events").select("event_id", renamed(F.col("props"), ["k", "k_all"], "k").alias("field"))


@query("SELECT vec_id, round(sum(CASE WHEN i BETWEEN 6 AND 12 OR i = 2 THEN 0 ELSE x END), 4) AS kept_sum FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY vec_id")
def mask_columns(spark, sf):
    masked = F.transform("embedding", lambda x, i: F.when((i == 1) | i.between(5, 11), F.lit(0.0)).otherwise(x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(masked, F.lit(0.0), lambda a, b: a + b), 4).alias("kept_sum"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%gizmo%' AND p_name NOT LIKE '%new%'")
def row_filters_family(spark, sf):
    words = F.split("p_name", " ")
    return table(spark, sf, "part").filter(F.array_contains(words, "gizmo") & ~F.arrays_overlap(words, F.array(F.lit("new")))).select("p_partkey")


@query("SELECT doc_id, source FROM documents WHERE NOT regexp_matches(source, 'src1[0-4]$')")
def regex_placeholder_filter(spark, sf):
    return table(spark, sf, "documents").filter(~F.col("source").rlike("src1[0-4]$")).select("doc_id", "source")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount > 0.02 AND l_discount < 0.07")
def range_filter(spark, sf):
    keep = F.col("l_quantity").between(10, 20) & (F.col("l_discount") > 0.02) & (F.col("l_discount") < 0.07)
    return table(spark, sf, "lineitem").filter(keep).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey WHERE o_custkey IS NULL AND coalesce(c_acctbal, 0) >= 1000")
def screen_filters(spark, sf):
    seen = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").filter(F.coalesce("c_acctbal", F.lit(0.0)) >= 1000).join(seen, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%gizmo%' AND p_size > 25 THEN 'large brass' WHEN p_name LIKE '%gizmo%' THEN 'brass' WHEN p_size > 40 THEN 'large' ELSE 'other' END AS class FROM part")
def classify_case(spark, sf):
    brass = F.col("p_name").contains("gizmo")
    return table(spark, sf, "part").select("p_partkey", cascade([(brass & (F.col("p_size") > 25), "large brass"), (brass, "brass"), (F.col("p_size") > 40, "large")], "other").alias("class"))


@query("SELECT o_orderkey, CASE WHEN fm AND af THEN 'both' WHEN fm THEN 'FM' WHEN af THEN 'AFM' ELSE 'none' END AS mag FROM (SELECT o_orderkey, o_totalprice > 100000 AS fm, o_orderstatus = 'O' AS af FROM orders)")
def order_flag_case(spark, sf):
    fm, af = F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "O"
    return table(spark, sf, "orders").select("o_orderkey", cascade([(fm & af, "both"), (fm, "FM"), (af, "AFM")], "none").alias("mag"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'Other' END AS family FROM customer")
def fold_family(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).otherwise("Other").alias("family"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 0 WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 ELSE -1 END AS gs FROM events")
def ground_state_class(spark, sf):
    gs = F.when(F.col("value") > 50, 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(-1)
    return table(spark, sf, "events").select("event_id", gs.alias("gs"))


@query("SELECT event_id, round(value * (-1.0::DOUBLE / 1602.1766208::DOUBLE), 8) AS stress FROM events")
def rescale_units(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") * F.lit(-1.0 / 1602.1766208), 8).alias("stress"))


@query("SELECT l_partkey, round(least(1.0, 0.3 + 0.1 * count(*))::DOUBLE, 6) AS weight FROM lineitem GROUP BY l_partkey")
def weights_expr(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.least(F.lit(1.0), 0.3 + 0.1 * F.count("*")), 6).alias("weight"))


_LINE = "struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey, q := l_quantity, d := l_discount, t := l_tax, r := l_returnflag)"
_FULL = f"(SELECT l_orderkey, list({_LINE} ORDER BY {_LINE}) AS l FROM lineitem GROUP BY 1)"


def full_records(spark, sf) -> DataFrame:
    """(id, nodes, edges): a nested record for each order, with absent and renamed fields as builders leave them."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("r"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    node = lambda x: F.struct(
        (x["p"] % 90 + 1).alias("Z"), F.when(x["q"] > 10, x["q"]).alias("oxidation_state"), F.when(x["r"] == "R", "cation").when(x["r"] == "A", "anion").otherwise("neutral").alias("ion_role"),
        F.when(x["d"] > 0.02, x["d"]).alias("chi_pauling"), F.when(x["n"] % 2 == 0, F.struct((x["s"] % 4).alias("corner"), (x["s"] % 3).alias("edge"))).alias("hist"),
        F.when(x["n"] % 3 == 0, F.struct((x["s"] % 5).alias("corner"), (x["s"] % 2).alias("edge"))).alias("hist_all"),
    )
    edge = lambda x, i: F.struct(i.alias("id"), i.alias("source"), ((i + 1) % F.size("l")).alias("target"), x["q"].alias("bond_length"), F.when(x["d"] > 0.05, "core").otherwise("outer").alias("coordination_sphere"), F.when(x["t"] > 0.03, F.array(F.lit(0), F.lit(1), i)).alias("to_jimage"))
    return lines.select("id", F.transform("l", node).alias("nodes"), F.transform("l", edge).alias("edges"))


def compact(records: DataFrame) -> DataFrame:
    """(id, nodes, edges, adjacency): what a model reads of each record: roles and spheres as numbers, absent values as zero, either
    name of a renamed histogram, and for each node the edges that touch it with the node at their other end."""
    role = lambda r: F.when(r == "cation", 1).when(r == "anion", -1).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hist = lambda x: F.coalesce(x["hist"], x["hist_all"])
    nodes = F.transform("nodes", lambda x: F.struct(x["Z"].alias("Z"), zero(x["oxidation_state"]).alias("oxidation_state"), role(x["ion_role"]).alias("ion_role"), zero(x["chi_pauling"]).alias("chi_pauling"), F.coalesce(hist(x)["corner"], F.lit(0)).alias("hist_corner"), F.coalesce(hist(x)["edge"], F.lit(0)).alias("hist_edge")))
    edges = F.transform("edges", lambda x: F.struct(x["id"].alias("id"), x["source"].alias("source"), x["target"].alias("target"), x["bond_length"].alias("bond_length"), (x["coordination_sphere"] == "core").cast("int").alias("coord_sphere"), x["to_jimage"].alias("to_jimage")))
    touching = lambda i: F.flatten(F.transform("edges", lambda x: F.concat(F.when(x["source"] == i, F.array(F.struct(x["id"].alias("edge"), x["target"].alias("node")))).otherwise(F.array().cast("array<struct<edge:int,node:int>>")), F.when(x["target"] == i, F.array(F.struct(x["id"].alias("edge"), x["source"].alias("node")))).otherwise(F.array().cast("array<struct<edge:int,node:int>>")))))
    return records.select("id", nodes.alias("nodes"), edges.alias("edges"), F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), touching).alias("adjacency"))


@query(f"""WITH x AS (SELECT l_orderkey AS id, len(l) AS k, i, l[i + 1] AS x FROM {_FULL}, range(64) r(i) WHERE i < len(l)), e AS (SELECT id, i AS edge, i AS source, ((i + 1) % k) AS target, x FROM x),
    a AS (SELECT id, node, string_agg(edge || '>' || other, ' ' ORDER BY edge, w) AS touching, count(*) AS degree FROM (SELECT id, source AS node, edge, target AS other, 0 AS w FROM e UNION ALL SELECT id, target, edge, source, 1 FROM e) GROUP BY 1, 2)
    SELECT x.id, i AS node, (x.p % 90 + 1)::BIGINT AS z, CASE WHEN x.q > 10 THEN x.q ELSE 0 END AS oxidation, CASE x.r WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS role, CASE WHEN x.d > 0.02 THEN x.d ELSE 0 END AS chi, CASE WHEN x.n % 2 = 0 THEN x.s % 4 WHEN x.n % 3 = 0 THEN x.s % 5 ELSE 0 END AS corner,
    touching, degree, (x.d > 0.05)::INT AS core, CASE WHEN x.t > 0.03 THEN i END AS image FROM x JOIN a ON a.id = x.id AND a.node = x.i""")
def compact_projection(spark, sf):
    c = compact(full_records(spark, sf)).select("id", F.posexplode(F.arrays_zip("nodes", "adjacency", "edges")).alias("node", "x"))
    n, touching = F.col("x.nodes"), F.transform("x.adjacency", lambda t: F.concat(t["edge"].cast("string"), F.lit(">"), t["node"].cast("string")))
    return c.select(
        "id", F.col("node").cast("long").alias("node"), n["Z"].alias("z"), n["oxidation_state"].alias("oxidation"), n["ion_role"].alias("role"), n["chi_pauling"].alias("chi"), n["hist_corner"].alias("corner"),
        F.array_join(touching, " ").alias("touching"), F.size("x.adjacency").cast("long").alias("degree"), F.col("x.edges.coord_sphere").alias("core"), F.get("x.edges.to_jimage", F.lit(2)).cast("long").alias("image"),
    )


def with_material(df: DataFrame, id_col: str = "id", name: str = "mp_id") -> DataFrame:
    """``df`` with the material's id, the record's without a trailing ``.cif``; a column of that name that is there stays as it is."""
    return df if name in df.columns else df.withColumn(name, F.regexp_replace(id_col, r"\.cif$", ""))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'own-' || doc_id END AS mp_id FROM documents")
def derive_mp_id(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(".cif")).alias("id"))
    own = d.filter("doc_id % 2 = 1").withColumn("mp_id", F.concat(F.lit("own-"), F.col("doc_id").cast("string")))
    return with_material(d.filter("doc_id % 2 = 0")).unionByName(with_material(own)).select("doc_id", "mp_id")
