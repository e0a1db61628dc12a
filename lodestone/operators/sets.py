"""Unions with priority, differences, votes, replication and hash-ordered samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.windows import top_k
from lodestone.registry import query, table


def first_by_priority(frames: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """The union of ``frames``; of rows with the same key the one of the first frame, then the first by ``order``."""
    every = frames[0].withColumn("priority", F.lit(0))
    for n, f in enumerate(frames[1:], 1):
        every = every.unionByName(f.withColumn("priority", F.lit(n)), allowMissingColumns=True)
    return top_k(every, [key], ["priority", *order], 1, "__r").drop("__r")


@query("SELECT k, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority) AS r FROM (SELECT DISTINCT l_partkey AS k, 'R' AS src, 0 AS priority FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT DISTINCT l_partkey, 'A', 1 FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT DISTINCT l_partkey, 'N', 2 FROM lineitem WHERE l_returnflag = 'N')) WHERE r = 1")
def union_dedup_priority(spark, sf):
    l = table(spark, sf, "lineitem")
    parts = [l.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"), F.lit(f).alias("src")).distinct() for f in "RAN"]
    return first_by_priority(parts, "k", ["src"]).select("k", "src")


@query("SELECT o_orderkey AS id, o_totalprice AS tc FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey, 0.0 FROM orders WHERE o_orderstatus <> 'F'")
def union_append_negatives(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("tc")).unionByName(o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("tc"))).distinct()


@query("SELECT c_custkey AS id, c_acctbal AS energy, NULL::DOUBLE AS dos, 0 AS member FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal, 1 FROM supplier")
def union_masked(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("energy"), F.lit(0).alias("member"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("dos"), F.lit(1).alias("member"))
    return a.unionByName(b, allowMissingColumns=True).select("id", "energy", "dos", "member")


@query("SELECT md5(text) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_first(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("k")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT p_brand, p_size, floor(p_retailprice / 10)::BIGINT AS v, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2, 3")
def dedup_solution_key(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", "p_size", F.floor(F.col("p_retailprice") / 10).alias("v")).agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity < 3")
def set_difference(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.filter("l_quantity > 40").select(F.col("l_suppkey").alias("k")).subtract(l.filter("l_discount > 0.09 AND l_quantity < 3").select("l_suppkey"))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey FROM lineitem WHERE l_discount = 0 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def set_union_of_exclusions(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.filter("l_quantity > 49 OR l_discount = 0").select(F.col("l_partkey").alias("k")).union(table(spark, sf, "part").filter("p_size = 1").select("p_partkey")).distinct()


@query("""SELECT l_partkey, CASE WHEN z = 0 OR s = 0 THEN 'keep' WHEN z + s >= 3 AND z < s THEN 'drop zero' WHEN z + s >= 3 AND s < z THEN 'drop positive' WHEN z = s THEN 'drop both' ELSE 'keep' END AS verdict
    FROM (SELECT l_partkey, count(*) FILTER (l_discount = 0) AS z, count(*) FILTER (l_discount > 0) AS s FROM lineitem GROUP BY 1)""")
def majority_vote_conflict(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_discount") == 0).alias("z"), F.count_if(F.col("l_discount") > 0).alias("s"))
    z, s = F.col("z"), F.col("s")
    out = F.when((z == 0) | (s == 0), "keep").when((z + s >= 3) & (z < s), "drop zero").when((z + s >= 3) & (s < z), "drop positive").when(z == s, "drop both").otherwise("keep")
    return v.select("l_partkey", out.alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, unnest(range(1, l_linenumber + 1)) AS copy FROM lineitem WHERE l_linenumber BETWEEN 1 AND 3")
def weighted_replication(spark, sf):
    return table(spark, sf, "lineitem").filter("l_linenumber BETWEEN 1 AND 3").select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1).cast("long"), F.col("l_linenumber").cast("long"))).alias("copy"))


@query("""WITH m AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT doc_id, 1 AS toxic FROM m UNION ALL SELECT doc_id, 0 FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':5'), doc_id) AS r FROM labels WHERE toxic = 0) WHERE r <= (SELECT count(*) FROM m)""")
def sample_balanced_epoch(spark, sf):
    """All of the smaller class and as many of the larger one, the first by hash; places by ranges, so no task holds them all."""
    from lodestone.operators.windows import global_position

    l = table(spark, sf, "labels").select("doc_id", "toxic")
    few = l.filter("toxic = 1")
    hashed = l.filter("toxic = 0").withColumn("h", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":5")).cast("binary")))
    many = global_position(hashed, ["h", "doc_id"]).crossJoin(F.broadcast(few.agg(F.count("*").alias("n"))))  # one row
    return few.unionByName(many.filter("position < n").select("doc_id", "toxic"))


@query("SELECT p_partkey FROM part ORDER BY md5(p_partkey || ':9'), p_partkey LIMIT 50")
def sample_fixed(spark, sf):
    return table(spark, sf, "part").select("p_partkey").orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(":9")).cast("binary")), "p_partkey").limit(50)
