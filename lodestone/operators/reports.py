"""Guards, coverage, backfill and report tables: what a run checks before and tells after."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.metrics import _TRUTH, estimates
from lodestone.operators.projections import cascade
from lodestone.operators.windows import global_position, quantiles
from lodestone.registry import query, table, written


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``; the job fails with ``message`` on the first row where ``condition`` isn't true."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(condition, F.lit(False)), F.col(first)).otherwise(F.raise_error(message)))


def drop_empty_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without those of ``names`` that have no value anywhere; one aggregation over all of them."""
    some = df.agg(*[F.count(c).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if not some[c]])


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Rows of all ``frames`` with the union of their columns in order of first appearance, absent ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


@query("SELECT p_partkey, CASE WHEN p_retailprice < 905 AND m > 920 THEN 'low in high cloud' WHEN p_retailprice > 920 AND m < 905 THEN 'high in low cloud' WHEN abs(p_retailprice - m) > 10 THEN 'mid' ELSE 'in' END AS class FROM (SELECT *, median(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part)")
def outlier_classes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    j = p.join(p.groupBy("p_brand").agg(F.median("p_retailprice").alias("m")), "p_brand")
    v, m = F.col("p_retailprice"), F.col("m")
    return j.select("p_partkey", cascade([((v < 905) & (m > 920), "low in high cloud"), ((v > 920) & (m < 905), "high in low cloud"), (F.abs(v - m) > 10, "mid")], "in").alias("class"))


@query("SELECT a.l_orderkey, a.k = b.k AS aligned FROM (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS k FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, list(CASE WHEN l_quantity > 49 THEN 'X' ELSE l_returnflag END ORDER BY l_linenumber, l_partkey, CASE WHEN l_quantity > 49 THEN 'X' ELSE l_returnflag END) AS k FROM lineitem GROUP BY 1) b USING (l_orderkey)")
def alignment_guard(spark, sf):
    """Both records of an id must have equal lists, order included."""
    def listed(c: Column, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", c.alias("k"))))
        return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["k"]).alias(name))

    j = listed(F.col("l_returnflag"), "a").join(listed(F.when(F.col("l_quantity") > 49, "X").otherwise(F.col("l_returnflag")), "b"), "l_orderkey")
    return j.select("l_orderkey", (F.col("a") == F.col("b")).alias("aligned"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS baked, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) IN (0, count(*)) AS uniform FROM events GROUP BY 1")
def pack_uniformity(spark, sf):
    has = F.count_if(F.get_json_object("props", "$.k").isNotNull())
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), has.alias("baked"), has.isin(F.lit(0), F.count("*")).alias("uniform"))


@query("SELECT count(*) AS checked, count(*) FILTER (l_linenumber > 7) AS stale, count(*) FILTER (l_linenumber > 7) = 0 AS ok FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 400)")
def schema_gate(spark, sf):
    """400 records are the sample that this gate is defined on."""
    s = table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(400)
    stale = F.count_if(F.col("l_linenumber") > 7)
    return s.agg(F.count("*").alias("checked"), stale.alias("stale"), (stale == 0).alias("ok"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'holdout' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'train' WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'train' END AS split
    FROM orders WHERE o_orderstatus <> 'P'""")
def holdout_force(spark, sf):
    """Excluded rows go; of the rest a held-out group wins over one forced into training, and that over the split."""
    c = table(spark, sf, "customer")
    held = c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("holdout").alias("a"))
    forced = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit("train").alias("b"))
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").join(held, "o_custkey", "left").join(forced, "o_custkey", "left")
    return o.select("o_orderkey", F.coalesce("a", "b", F.when(F.col("o_orderkey") % 10 == 0, "test").otherwise("train")).alias("split"))


@query("SELECT p_brand, count(*) AS required, count(*) FILTER (s IS NOT NULL) AS native, count(*) FILTER (s IS NULL AND p_size < 10) AS template, count(*) FILTER (s IS NULL AND p_size >= 10) AS missing FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS s FROM lineitem WHERE l_quantity > 45) ON s = p_partkey GROUP BY 1")
def coverage_report(spark, sf):
    have = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("s")).distinct()
    j = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size").join(have, "p_partkey", "left")
    absent, small = F.col("s").isNull(), F.col("p_size") < 10
    return j.groupBy("p_brand").agg(F.count("*").alias("required"), F.count_if(~absent).alias("native"), F.count_if(absent & small).alias("template"), F.count_if(absent & ~small).alias("missing"))


@query(f"SELECT family, count(*) AS n, round(median(y / q), 5) AS ratio, round(quantile_cont(y / q, 0.25), 5) AS p25, round(quantile_cont(y / q, 0.75), 5) AS p75 FROM {_TRUTH} WHERE q > 0 AND grp = 'F' GROUP BY 1")
def screen_calibration(spark, sf):
    e = estimates(spark, sf).filter("q > 0 AND grp = 'F'").withColumn("r", F.col("y") / F.col("q"))
    shares = {"ratio": 0.5, "p25": 0.25, "p75": 0.75}
    return quantiles(e, "family", "r", shares).select("family", "n", *[F.round(c, 5).alias(c) for c in shares])


@query("SELECT o_orderkey, c_mktsegment AS carried FROM orders JOIN customer ON o_custkey = c_custkey")
def carry_over_keys(spark, sf):
    """Only named columns come over from the old record; a row whose old record lacks one stops the job."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("carried"))
    j = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(old, "o_custkey")
    return require(j.select("o_orderkey", "carried"), F.col("carried").isNotNull(), "a required key is absent")


@query("SELECT l_orderkey AS center, l_partkey AS other FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, l_orderkey FROM lineitem WHERE l_linestatus = 'O'")
def neighbor_gather_conditional(spark, sf):
    """Both directions of an edge, each only if the other end has the role; one pass, no self-join."""
    way = lambda keep, a, b: F.when(keep, F.struct(F.col(a).alias("center"), F.col(b).alias("other")))
    ends = F.array_compact(F.array(way(F.col("l_returnflag") == "R", "l_orderkey", "l_partkey"), way(F.col("l_linestatus") == "O", "l_partkey", "l_orderkey")))
    return table(spark, sf, "lineitem").select(F.inline(ends))


@query("SELECT event_id, 'not a number' AS reason FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NULL UNION ALL SELECT event_id, 'too large' FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 90")
def failure_manifest(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf, "events").select("event_id", F.when(k.isNull(), "not a number").when(k > 90, "too large").alias("reason")).filter("reason IS NOT NULL")


@query("SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL")
def parse_basic_rows(spark, sf):
    rows = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "n_chars")
    if rows.isEmpty():
        raise ValueError("no rows to parse")
    return rows


@query("SELECT c_custkey, c_acctbal FROM customer")
def drop_all_null_columns(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(None).cast("double").alias("magmom"))
    return drop_empty_columns(c, ["c_acctbal", "magmom"])


@query("SELECT l_orderkey AS segment, l_linenumber, start + l_partkey % 3 AS neighbour FROM lineitem JOIN (SELECT l_orderkey, coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)) USING (l_orderkey)")
def collate_offset(spark, sf):
    """Local neighbour numbers shifted by the nodes of all segments before."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    start = global_position(l.groupBy("l_orderkey").agg(F.count("*").alias("n")), ["l_orderkey"], "start", F.col("n")).drop("n")
    return l.join(start, "l_orderkey").select(F.col("l_orderkey").alias("segment"), "l_linenumber", (F.col("start") + F.col("l_partkey") % 3).alias("neighbour"))


@query("SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def dataset_atom_counts(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "orders").select("o_orderkey").join(n, "o_orderkey", "left")


@query("SELECT c_custkey, (c_acctbal <= 0)::INT AS class FROM customer")
def binary_hurdle_labels(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") <= 0).cast("int").alias("class"))


@query("SELECT event_type, round(avg(-ln(p)), 6) AS loss, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 50 THEN 0 WHEN value > 20 THEN 1 ELSE -1 END AS gs, 0.05 + 0.9 * (event_id % 10) / 10.0 AS p FROM events) WHERE gs >= 0 GROUP BY 1")
def masked_cross_entropy_rows(spark, sf):
    gs = F.when(F.col("value") > 50, 0).when(F.col("value") > 20, 1).otherwise(-1)
    e = table(spark, sf, "events").select("event_type", gs.alias("gs"), (0.05 + 0.9 * (F.col("event_id") % 10) / 10).alias("p")).filter("gs >= 0")
    return e.groupBy("event_type").agg(F.round(F.avg(-F.log("p")), 6).alias("loss"), F.count("*").alias("n"))


@query(f"SELECT id, round(exp((ln(1 + p) + ln(1 + y)) / 2) - 1, 2) AS pred, round(abs(ln(1 + p) - ln(1 + y)) / 2, 6) AS spread, round(((p > 150000)::INT + (y > 150000)::INT) / 2, 3) AS p_class FROM {_TRUTH}")
def ensemble_predict(spark, sf):
    """The seeds of a row are columns, so their mean in log1p, population deviation and class share need no shuffle."""
    seeds = F.array("p", "y")
    total = lambda f: F.aggregate(seeds, F.lit(0.0), lambda s, x: s + f(x))
    mean = total(F.log1p) / 2
    spread = F.sqrt(total(lambda x: (F.log1p(x) - mean) * (F.log1p(x) - mean)) / 2)
    return estimates(spark, sf).select("id", F.round(F.expm1(mean), 2).alias("pred"), F.round(spread, 6).alias("spread"), F.round(total(lambda x: (x > 150000).cast("double")) / 2, 3).alias("p_class"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(l_extendedprice), 3) AS p50, round(quantile_cont(l_extendedprice, 0.05), 3) AS p5, round(quantile_cont(l_extendedprice, 0.95), 3) AS p95 FROM lineitem GROUP BY 1, 2")
def phonon_report(spark, sf):
    """Exact percentiles: equal values are counted before they meet, so a group's state grows with its distinct values."""
    l = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_extendedprice").agg(F.count("*").alias("k"))
    at = lambda p: F.round(F.percentile("l_extendedprice", F.lit(p), F.col("k")), 3)
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("k").alias("n"), at(0.5).alias("p50"), at(0.05).alias("p5"), at(0.95).alias("p95"))


@query("SELECT c_custkey AS id, c_acctbal AS mae, NULL::DOUBLE AS rmse FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_metric_columns(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("mae"))
    return stacked([a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("rmse"))])


@query("SELECT p_partkey AS config, round(p_retailprice, 2) AS score FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def resume_leaderboard(spark, sf):
    """Scored configurations are left out; a record of another version than this run's stops it."""
    scored = table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("config"), F.lit(1).alias("version"))
    scored = require(scored, F.col("version") == 1, "the leaderboard is of another version")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("config"), F.round("p_retailprice", 2).alias("score")).join(scored, "config", "left_anti")


@query("SELECT CASE WHEN count(o_custkey) = count(*) THEN 'material' ELSE 'frame' END AS split_by FROM orders")
def resolve_split_by(spark, sf):
    whole = F.count("o_custkey") == F.count("*")
    return table(spark, sf, "orders").agg(F.when(whole, "material").otherwise("frame").alias("split_by"))


@query("SELECT o_orderpriority, n, least(round_even(n / 2.5, 0), available)::BIGINT AS wanted FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n, count(*) FILTER (o_orderstatus <> 'F') AS available FROM orders GROUP BY 1)")
def expand_ratio(spark, sf):
    f = F.col("o_orderstatus") == "F"
    o = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(f).alias("n"), F.count_if(~f).alias("available"))
    return o.select("o_orderpriority", "n", F.least(F.bround(F.col("n") / 2.5).cast("long"), "available").alias("wanted"))


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def join_left_merge(spark, sf):
    meta = table(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, sf, "lineitem").join(meta, "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer WHERE c_acctbal IS NOT NULL")
def join_positions(spark, sf):
    """Places of ids in the sorted table; an id without a place stops the job."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    at = global_position(c.select("id"), ["id"])
    j = c.filter("c_acctbal IS NOT NULL").select("id").join(at, "id", "left")
    return require(j, F.col("position").isNotNull(), "an id has no position")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def sort_newest(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1 ORDER BY first_event LIMIT 25")
def limit_streamed(spark, sf):
    """The first 25 different keys in order of arrival: deduplicate, then limit."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event")).orderBy("first_event").limit(25)


@query("SELECT l_suppkey, arg_min(l_orderkey, (CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_orderkey)) AS chosen, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END)::INT AS source FROM lineitem GROUP BY 1")
def union_sources_with_priority(spark, sf):
    """The best source of an id, as an aggregate: no window, no sort of a hot id."""
    source = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_orderkey", F.struct(source, "l_orderkey")).alias("chosen"), F.min(source).alias("source"))


@query("SELECT user_id, min(event_id) AS kept, count(*) - 1 AS dropped FROM events GROUP BY 1")
def dedup_stream_first(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("kept"), (F.count("*") - 1).alias("dropped"))


@query("SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, least(count(*) FILTER (toxic = 1) OVER (), count(*) FILTER (toxic = 0) OVER ()) AS k FROM labels) WHERE r <= k")
def sample_balanced_subset(spark, sf):
    """As many of each class as the smaller one has, in hash order; places by ranges, not by one task for each class."""
    l = table(spark, sf, "labels").select("doc_id", "toxic", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    sizes = l.agg(F.least(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).alias("k"))  # one row
    first = l.groupBy("toxic").agg(F.count("*").alias("n"))
    r = global_position(l, ["toxic", "h", "doc_id"], "r")
    before = F.coalesce(F.sum(F.when(F.col("o.toxic") < F.col("f.toxic"), F.col("o.n"))), F.lit(0))
    starts = first.alias("f").join(first.alias("o"), F.col("o.toxic") <= F.col("f.toxic")).groupBy(F.col("f.toxic").alias("toxic")).agg(before.alias("start"))
    return r.join(starts, "toxic").crossJoin(F.broadcast(sizes)).filter("r - start < k").select("doc_id", "toxic")


_POISSON = [0.36787944117144233]  # exp(-1) and the further levels of a Poisson variable of mean one
for _k in range(1, 8):
    _POISSON.append(_POISSON[-1] + _POISSON[0] / math.factorial(_k))


@query(f"""WITH d AS (SELECT id, abs(p - y) - abs(q - y) AS d FROM {_TRUTH}), w AS (SELECT b, d, u, {' + '.join(f'(u >= {x!r}::DOUBLE)::INT' for x in _POISSON)} AS w FROM (SELECT b, d, ('0x' || substr(md5(id || ':' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d, range(1, 201) r(b))),
    m AS (SELECT b, sum(d * w) / sum(w) AS m FROM w GROUP BY 1) SELECT (SELECT round(avg(d), 3) FROM d) AS mean, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM m""")
def agg_bootstrap_paired(spark, sf, replicates: int = 200):
    """Mean paired difference and its 95 % interval. Each row gets a Poisson weight a replicate from a hash of both, so all
    replicates come from one pass with partial sums: 200 rows leave each task, however large the table is."""
    d = estimates(spark, sf).select("id", (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("q") - F.col("y"))).alias("d"))
    r = d.select("id", "d", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("b").cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)
    means = r.withColumn("u", u).withColumn("w", sum(((F.col("u") >= x).cast("int") for x in _POISSON), F.lit(0))).groupBy("b").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("m"))
    ci = means.agg(F.round(F.percentile("m", F.lit(0.025)), 3).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 3).alias("high"))  # a row for each replicate
    return ci.crossJoin(d.agg(F.round(F.avg("d"), 3).alias("mean"))).select("mean", "low", "high")


@query(f"""SELECT round(a, 6) AS l1_tc, round(b, 6) AS mse_gap, round(c, 6) AS huber_e, round(a + 0.5 * b + 2 * c, 6) AS total FROM (SELECT avg(abs(p - y) / s) AS a, avg(pow((q - y) / s, 2)) FILTER (grp = 'F') AS b, avg(CASE WHEN abs(p - q) / s <= 1 THEN 0.5 * pow((p - q) / s, 2) ELSE abs(p - q) / s - 0.5 END) FILTER (grp <> 'P') AS c
    FROM {_TRUTH}, (SELECT stddev_samp(y) AS s FROM {_TRUTH}))""")
def agg_multitask_loss(spark, sf):
    """A loss a task on standardised residuals, rows without the task's target left out; their weighted sum."""
    e = estimates(spark, sf)
    e = e.crossJoin(F.broadcast(e.agg(F.stddev_samp("y").alias("s"))))  # one row
    z = lambda a, b: (F.col(a) - F.col(b)) / F.col("s")
    h = F.abs(z("p", "q"))
    tasks = e.agg(
        F.avg(F.abs(z("p", "y"))).alias("a"),
        F.avg(F.when(F.col("grp") == "F", z("q", "y") * z("q", "y"))).alias("b"),
        F.avg(F.when(F.col("grp") != "P", F.when(h <= 1, 0.5 * h * h).otherwise(h - 0.5))).alias("c"),
    )
    return tasks.select(F.round("a", 6).alias("l1_tc"), F.round("b", 6).alias("mse_gap"), F.round("c", 6).alias("huber_e"), F.round(F.col("a") + 0.5 * F.col("b") + 2 * F.col("c"), 6).alias("total"))


def cut_batches(sizes: DataFrame, key: str, size: str, pool: int = 64, rows: int = 8, total: int = 40) -> DataFrame:
    """(key, pool, batch): pools of ``pool`` rows in hash order, each sorted by size and cut at ``rows`` rows or ``total`` size.

    The cut carries a sum, so a pool is one group; pools are of a fixed size, so groups don't grow with the table.
    """
    import pandas as pd

    h = sizes.select(key, size, F.md5(F.col(key).cast("string").cast("binary")).alias("h"))
    at = global_position(h, ["h", key], "r").select(F.col(key).alias("key"), F.col(size).alias("size"), F.floor(F.col("r") / pool).alias("pool"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, batch, n, s, out = pdf.sort_values(["size", "key"]), 0, 0, 0, []
        for x in pdf["size"]:
            if n and (n == rows or s + x > total):
                batch, n, s = batch + 1, 0, 0
            n, s = n + 1, s + x
            out.append(batch)
        return pdf.assign(batch=out)[["key", "size", "pool", "batch"]]

    return at.groupBy("pool").applyInPandas(cut, "key long, size long, pool long, batch long")


@query("""WITH RECURSIVE n AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1), h AS (SELECT *, (row_number() OVER (ORDER BY md5(l_orderkey::VARCHAR), l_orderkey) - 1) // 64 AS pool FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY size, l_orderkey) AS i FROM h),
    s AS (SELECT l_orderkey, size, pool, i, 0::BIGINT AS batch, 1::BIGINT AS k, size::BIGINT AS total FROM r WHERE i = 1
    UNION ALL SELECT r.l_orderkey, r.size, r.pool, r.i, CASE WHEN k = 8 OR total + r.size > 40 THEN batch + 1 ELSE batch END, CASE WHEN k = 8 OR total + r.size > 40 THEN 1 ELSE k + 1 END, CASE WHEN k = 8 OR total + r.size > 40 THEN r.size ELSE total + r.size END FROM s JOIN r ON r.pool = s.pool AND r.i = s.i + 1)
    SELECT l_orderkey, size, pool, batch FROM s""")
def win_size_grouped_batches(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return cut_batches(n, "l_orderkey", "n").withColumnRenamed("key", "l_orderkey")


@query("SELECT l_orderkey, round(avg(l_quantity), 6) AS mean, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) AS weighted, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) + coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) * 0.5, 4) AS two FROM lineitem GROUP BY 1")
def mp_aggregate(spark, sf):
    """Messages of neighbours as a mean, a weighted mean and a sum over two relations, from one aggregation."""
    q, r = F.col("l_quantity"), F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.avg(q), 6).alias("mean"),
        F.round(F.sum(q * F.col("l_extendedprice")) / F.sum("l_extendedprice"), 6).alias("weighted"),
        F.round(F.sum(F.when(r, q).otherwise(0.5 * q)), 4).alias("two"),
    )
