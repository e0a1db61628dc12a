"""Consensus, conflict, binning, segment and summary aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.registry import query, table


def iqr(c: str) -> Column:
    return F.percentile(c, 0.75) - F.percentile(c, 0.25)


def right_closed_bin(c: Column, low: float, width: float) -> Column:
    """The bin (a, b] that holds ``c``, from 0; null for values at or below the first edge."""
    return F.when(c > low, F.ceil((c - low) / width).cast("int") - 1)


def segment_softmax(df: DataFrame, segment: str, score: str) -> DataFrame:
    """``df`` with ``share``: the score's softmax within its segment, from the segment's maximum and sum as aggregates."""
    top = df.groupBy(segment).agg(F.max(score).alias("__top"))
    j = df.join(top, segment).withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    total = j.groupBy(segment).agg(F.sum("__e").alias("__total"))
    return j.join(total, segment).withColumn("share", F.col("__e") / F.col("__total")).drop("__top", "__e", "__total")


@query("""SELECT l_partkey, min(p_name) AS name, round(median(l_extendedprice), 4) AS tc, count(*) AS n_reports, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS tc_iqr,
    max(l_extendedprice) - min(l_extendedprice) > greatest(5, 0.3 * max(l_extendedprice)) AS conflict FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_partkey IS NOT NULL GROUP BY l_partkey""")
def agg_consensus_label(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    c = F.col("l_extendedprice")
    spread = F.max(c) - F.min(c)
    own = table(spark, sf, "lineitem").filter("l_partkey IS NOT NULL").groupBy("l_partkey")
    own = own.agg(F.round(F.median(c), 4).alias("tc"), F.count("*").alias("n_reports"), F.round(iqr("l_extendedprice"), 4).alias("tc_iqr"), (spread > F.greatest(F.lit(5.0), 0.3 * F.max(c))).alias("conflict"))
    names = p.groupBy("l_partkey").agg(F.min("p_name").alias("name"))
    return own.join(names, "l_partkey", "left").select("l_partkey", "name", "tc", "n_reports", "tc_iqr", "conflict")


@query("""SELECT p, round(median(q), 4) AS t_order, max(n) AS n, min_by(flag, (-k, flag)) AS mag_order FROM (SELECT l_partkey AS p, l_returnflag AS flag, l_quantity AS q, count(*) OVER (PARTITION BY l_partkey) AS n, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS k FROM lineitem) GROUP BY p""")
def agg_consensus_mode(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p"))
    return l.agg(F.round(F.median("l_quantity"), 4).alias("t_order"), F.count("*").alias("n"), F.mode("l_returnflag", True).alias("mag_order"))


@query("SELECT o_custkey, max(o_totalprice) AS best FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey")
def agg_max_by_key(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice > 0").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND max(l_quantity) - min(l_quantity) > greatest(5, 0.3 * max(l_quantity))")
def agg_spread_conflict(spark, sf):
    q = F.col("l_quantity")
    out = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min(q).alias("lo"), F.max(q).alias("hi"))
    return out.filter((F.col("n") >= 2) & (F.col("hi") - F.col("lo") > F.greatest(F.lit(5.0), 0.3 * F.col("hi")))).select("l_partkey", "n")


@query("SELECT l_suppkey, count(*) AS n, min(l_quantity) AS ea_min, max(l_quantity) AS ea_max, max(l_extendedprice) AS tc_max, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY 1 HAVING count(*) >= 4 ORDER BY span DESC, l_suppkey LIMIT 25")
def agg_minmax_span(spark, sf):
    q = F.col("l_quantity")
    out = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min(q).alias("ea_min"), F.max(q).alias("ea_max"), F.max("l_extendedprice").alias("tc_max"), (F.max(q) - F.min(q)).alias("span"))
    return out.filter("n >= 4").orderBy(F.desc("span"), "l_suppkey").limit(25)


@query("SELECT (ceil((l_quantity - 1) / 5.0) - 1)::INT AS bin, count(*) AS n, max(l_extendedprice) AS top, round(median(l_extendedprice), 4) AS mid FROM lineitem WHERE l_quantity > 1 AND l_quantity <= 51 GROUP BY 1")
def agg_binned(spark, sf):
    l = table(spark, sf, "lineitem").filter("l_quantity <= 51").withColumn("bin", right_closed_bin(F.col("l_quantity"), 1.0, 5.0)).filter("bin IS NOT NULL")
    return l.groupBy("bin").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("top"), F.round(F.median("l_extendedprice"), 4).alias("mid"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def agg_value_counts(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_linestatus = 'F') AS closed FROM lineitem GROUP BY 1")
def agg_crosstab(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().na.fill(0)
    return p.select("l_returnflag", F.col("O").alias("open"), F.col("F").alias("closed"))


@query("SELECT o_orderpriority, count(*) FILTER (o_totalprice > 150000) AS sc, count(*) AS n FROM orders GROUP BY 1")
def agg_conditional_count(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 150000).alias("sc"), F.count("*").alias("n"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def agg_explode_count(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, '; ' ORDER BY l_linenumber, l_returnflag) AS reasons FROM lineitem GROUP BY 1")
def agg_string_join(spark, sf):
    one = F.struct("l_linenumber", "l_returnflag")
    joined = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat(x["l_returnflag"], x["l_linenumber"].cast("string")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(joined, "; ").alias("reasons"))


@query("SELECT l_orderkey, sum(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END)::BIGINT AS severity FROM lineitem GROUP BY 1")
def agg_severity(spark, sf):
    weight = F.create_map(F.lit("R"), F.lit(3), F.lit("A"), F.lit(2))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("l_returnflag")), F.lit(1))).alias("severity"))


@query("SELECT label, i::INT AS dim, round(avg(x), 5) AS mean, round(max(x), 5) AS top, round(sum(x), 4) AS total FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def agg_segment_mean(spark, sf):
    long = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "f")).withColumn("x", F.col("f").cast("double"))
    return long.groupBy("label", "dim").agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.max("x"), 5).alias("top"), F.round(F.sum("x"), 4).alias("total"))


@query("SELECT l_orderkey, round(sum(e * l_extendedprice) / sum(e), 3) AS pooled FROM (SELECT *, exp(l_quantity - max(l_quantity) OVER (PARTITION BY l_orderkey)) AS e FROM lineitem) GROUP BY 1")
def agg_segment_softmax_sum(spark, sf):
    s = segment_softmax(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), "l_orderkey", "l_quantity")
    return s.groupBy("l_orderkey").agg(F.round(F.sum(F.col("share") * F.col("l_extendedprice")), 3).alias("pooled"))


@query("SELECT l_orderkey, round(sum(greatest(l_discount - 0.02, 0) * l_quantity) / greatest(sum(greatest(l_discount - 0.02, 0)), 1e-8), 4) AS mean, round(ln(1 + sum(greatest(l_discount - 0.02, 0))), 6) AS magnitude FROM lineitem GROUP BY 1")
def agg_weighted_mean_norm(spark, sf):
    w = F.greatest(F.col("l_discount") - 0.02, F.lit(0.0))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(w * F.col("l_quantity")) / F.greatest(F.sum(w), F.lit(1e-8)), 4).alias("mean"), F.round(F.log1p(F.sum(w)), 6).alias("magnitude"))


@query("SELECT l_orderkey, round(ln(1 + sum(greatest(l_tax, 0))), 6) AS magnitude FROM lineitem GROUP BY 1")
def agg_coord_magnitude(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.log1p(F.sum(F.greatest("l_tax", F.lit(0.0)))), 6).alias("magnitude"))


@query("SELECT label, 2 * max(len(embedding))::INT AS width, round(avg(embedding[1]::DOUBLE), 5) AS first_mean, round(max(embedding[64]::DOUBLE), 5) AS last_max FROM embeddings GROUP BY label")
def agg_meanmax_pool(spark, sf):
    long = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.max(F.col("x").cast("double")).alias("t"))
    parts = long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m", "t"))).alias("p"))
    pooled = parts.select("label", F.concat(F.transform("p", lambda s: s["m"]), F.transform("p", lambda s: s["t"])).alias("v"))
    return pooled.select("label", F.size("v").alias("width"), F.round(F.col("v")[0], 5).alias("first_mean"), F.round(F.element_at("v", -1), 5).alias("last_max"))


@query("SELECT l_orderkey, count(*) AS n, round(avg(l_quantity), 5) AS q_mean, round(stddev_pop(l_quantity), 5) AS q_std, round(ln(1 + count(*)), 6) AS log_n FROM lineitem GROUP BY 1")
def agg_descriptors(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 5).alias("q_mean"), F.round(F.stddev_pop("l_quantity"), 5).alias("q_std"), F.round(F.log1p(F.count("*")), 6).alias("log_n"))


@query("SELECT i::INT AS dim, round(avg(x), 5) AS mean, round(CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END, 5) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1")
def agg_feature_stats(spark, sf):
    long = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("dim", "f")).withColumn("x", F.col("f").cast("double"))
    std = F.stddev_pop("x")
    return long.groupBy("dim").agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.when(std < 1e-6, 1.0).otherwise(std), 5).alias("std"))


@query("SELECT o_orderstatus, round(greatest(coalesce(stddev_samp(o_totalprice), 1.0), 1e-6), 3) AS std FROM orders GROUP BY 1")
def agg_target_stats(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(F.greatest(F.coalesce(F.stddev_samp("o_totalprice"), F.lit(1.0)), F.lit(1e-6)), 3).alias("std"))


@query("SELECT p_partkey, round(coalesce(avg(l_tax), 0), 6) AS tax, round(coalesce(avg(l_discount), 0), 6) AS discount, round(ln(1 + count(l_tax)), 6) AS log_n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def agg_poly_node_summary(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_tax").alias("t"), F.avg("l_discount").alias("d"), F.count("l_tax").alias("n"))
    j = table(spark, sf, "part").select("p_partkey").join(l, "p_partkey", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("p_partkey", F.round(zero("t"), 6).alias("tax"), F.round(zero("d"), 6).alias("discount"), F.round(F.log1p(zero(F.col("n").cast("double"))), 6).alias("log_n"))


@query("SELECT l_partkey, c AS center, round(avg(exp(-pow(cos(l_discount * 10) - (-1 + 2.0 * c / 11), 2) / (2 * pow(2.0 / 11, 2)))), 6) AS rbf FROM lineitem, range(12) r(c) GROUP BY 1, 2")
def agg_angle_rbf_mean(spark, sf):
    from lodestone.functions.arrays import rbf

    # equal angles of a part are counted before their functions are taken, and no function goes through a shuffle
    angles = table(spark, sf, "lineitem").groupBy("l_partkey", "l_discount").agg(F.count("*").alias("n"))
    each = angles.withColumn("g", rbf(F.cos(F.col("l_discount") * 10)))
    means = each.groupBy("l_partkey").agg(*[F.round(F.try_divide(F.sum(F.get("g", F.lit(k)) * F.col("n")), F.sum(F.when(F.get("g", F.lit(k)).isNotNull(), F.col("n")))), 6).alias(f"g{k}") for k in range(12)])
    return means.select("l_partkey", F.posexplode(F.array(*[f"g{k}" for k in range(12)])).alias("center", "rbf")).withColumn("center", F.col("center").cast("long"))


@query("SELECT round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, event_type FROM events GROUP BY event_type")
def agg_quantiles(spark, sf):
    from lodestone.operators.windows import quantiles

    shares = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    return quantiles(table(spark, sf, "events"), "event_type", "value", shares).select(*[F.round(c, 4).alias(c) for c in shares], "event_type")


@query("SELECT o_orderkey, round((a + b + coalesce(c, 0)) / (CASE WHEN c IS NULL THEN 2 ELSE 3 END), 4) AS mean, least(a, b, c) AS lo, greatest(a, b, c) AS hi FROM (SELECT o_orderkey, o_totalprice AS a, o_totalprice * 1.1 AS b, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 0.9 END AS c FROM orders)")
def agg_rowwise(spark, sf):
    v = F.col("o_totalprice")
    o = table(spark, sf, "orders").select("o_orderkey", F.array(v, v * 1.1, F.when(F.col("o_orderstatus") == "O", v * 0.9)).alias("v"))
    o = o.withColumn("v", F.filter("v", lambda x: x.isNotNull()))
    return o.select("o_orderkey", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v"), 4).alias("mean"), F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS average FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def agg_running_average_weighted(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity > 0").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("average"))


@query("SELECT l_suppkey, round(coalesce(sum(l_tax) FILTER (l_returnflag = 'R'), 0) / greatest(count(*) FILTER (l_returnflag = 'R'), 1), 6) AS masked FROM lineitem GROUP BY 1")
def agg_masked_mean(spark, sf):
    m = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.coalesce(F.sum(F.when(m, F.col("l_tax"))), F.lit(0.0)) / F.greatest(F.count_if(m), F.lit(1)), 6).alias("masked"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def agg_distinct(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def agg_tally(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'purchase'), min_by(event_id, (value, event_id))) AS best, count(*) AS n FROM events GROUP BY 1")
def agg_config_best_row(spark, sf):
    marked = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.coalesce(marked, F.min_by("event_id", F.struct("value", "event_id"))).alias("best"), F.count("*").alias("n"))


@query("SELECT a, b, count(*) AS n FROM (SELECT DISTINCT x.l_orderkey, x.l_returnflag AS a, y.l_returnflag AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_returnflag < y.l_returnflag) GROUP BY 1, 2")
def pair_tally(spark, sf):
    flags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return flags.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_returnflag, round(count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey), 6) AS fraction FROM lineitem GROUP BY 1, 2")
def occupancy_average(spark, sf):
    l = table(spark, sf, "lineitem")
    one, every = l.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n")), l.groupBy("l_orderkey").agg(F.count("*").alias("of"))
    return one.join(every, "l_orderkey").select("l_orderkey", "l_returnflag", F.round(F.col("n") / F.col("of"), 6).alias("fraction"))


@query("SELECT count(*) AS n, bool_or(embedding IS NOT NULL) AS has_embedding, sum(len(embedding))::BIGINT AS elements, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings")
def pack_header_flags(spark, sf):
    n = F.size("embedding")
    return table(spark, sf, "embeddings").agg(F.count("*").alias("n"), F.bool_or(F.col("embedding").isNotNull()).alias("has_embedding"), F.sum(n).alias("elements"), (F.min(n) == F.max(n)).alias("uniform"))


@query("SELECT p_brand, floor(p_retailprice / 100)::BIGINT AS bin, count(*) AS n FROM part GROUP BY 1, 2")
def histogram_by_family(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", F.floor(F.col("p_retailprice") / 100).alias("bin")).agg(F.count("*").alias("n"))
