"""Top rows of a key, strides, slots, offsets, splits and shards. No window spans a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.registry import query, table, written


def top_k(df: DataFrame, key: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(rank) <= k)


def global_position(df: DataFrame, order: list[str], name: str = "position", amount: Column | None = None) -> DataFrame:
    """``df`` with the exclusive running sum of ``amount`` (1: the position) in the order of ``order``, in any number of tasks.

    Rows are dealt by ranges; each range sums on its own, and a table with one row for each range tells where it starts.
    """
    amount = F.lit(1) if amount is None else amount
    dealt = written(df.withColumn("__amount", amount).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    sums = dealt.groupBy("__part").agg(F.sum("__amount").alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    own = F.coalesce(F.sum("__amount").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__own", own).join(before.drop("__sum"), "__part").withColumn(name, F.col("__own") + F.col("__before")).select(*df.columns, name)


#: Different values of all groups up to which a group's may meet in one task.
FEW = 200_000


def rank_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, below, total): how many rows have the value, a smaller one, and any, in each group. Nulls are left out.

    Equal values are counted before they meet. Up to ``FEW`` different ones a group is summed up in order; beyond that
    places go by ranges, with the same result: a group may be of any size.
    """
    each = written(df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n")))
    if each.count() <= FEW:
        own = Window.partitionBy(group)
        below = F.coalesce(F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return each.select(group, value, "n", below.alias("below"), F.sum("n").over(own).alias("total"))
    at = global_position(each, [group, value], "__before", F.col("n"))
    starts = at.groupBy(group).agg(F.min("__before").alias("__start"), F.sum("n").alias("total"))
    j = at.alias("a").join(starts.alias("s"), F.col(f"a.{group}").eqNullSafe(F.col(f"s.{group}")))
    return j.select(f"a.{group}", f"a.{value}", "n", (F.col("__before") - F.col("__start")).alias("below"), "total")


def with_average_rank(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with the rank of ``value`` in its group, ties sharing the mean of their ranks."""
    ranks = rank_counts(df, group, value).select(F.col(group).alias("__g"), F.col(value).alias("__v"), (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, df[group].eqNullSafe(F.col("__g")) & (df[value] == F.col("__v")), "left").drop("__g", "__v")


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, a column for each of ``shares``): exact percentiles between neighbours, from counts of equal values."""
    c = rank_counts(df, group, value)
    at = lambda share: share * (F.col("total") - 1)
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
    picked = [F.max(F.when(holds(f(at(share))), F.col(value))).alias(f"__{name}_{side}") for name, share in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    q = c.groupBy(group).agg(F.max("total").alias("n"), *picked)
    part = lambda share: share * (F.col("n") - 1) - F.floor(share * (F.col("n") - 1))
    return q.select(group, "n", *[(F.col(f"__{k}_low") + (F.col(f"__{k}_high") - F.col(f"__{k}_low")) * part(share)).alias(k) for k, share in shares.items()])


@query("SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_extendedprice, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 8")
def win_topk_per_key(spark, sf):
    return top_k(table(spark, sf, "lineitem"), ["l_partkey"], ["l_discount", "l_extendedprice", "l_orderkey", "l_linenumber"], 8).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("SELECT l_partkey, arg_min(l_orderkey, (l_discount, round(l_extendedprice, 1), l_orderkey)) AS best FROM lineitem GROUP BY 1")
def win_best_per_key(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_discount", F.round("l_extendedprice", 1), "l_orderkey")).alias("best"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag = 'R' ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def win_two_quota_topk(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("swapped", F.col("l_returnflag") == "R")
    return top_k(l, ["l_partkey", "swapped"], ["l_extendedprice", "l_orderkey", "l_linenumber"], 3).select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT l_partkey, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS winner FROM lineitem WHERE l_discount > 0.03 GROUP BY 1")
def win_first_success(spark, sf):
    return table(spark, sf, "lineitem").filter("l_discount > 0.03").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("winner"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE (r - 1) % 5 = 0")
def win_stride_subsample(spark, sf):
    e = table(spark, sf, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.filter((F.col("r") - 1) % 5 == 0).select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, slot FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) - 1 AS slot FROM lineitem) WHERE slot < 4")
def win_neighbor_slots(spark, sf):
    return top_k(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity", "l_linenumber"], 4).select("l_orderkey", "l_linenumber", (F.col("rank") - 1).cast("long").alias("slot"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) = 2 THEN -1 ELSE 1 END AS sign FROM lineitem")
def win_selfimage_sign(spark, sf):
    second = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber")) == 2
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(second, -1).otherwise(1).alias("sign"))


@query("SELECT l_orderkey, l_suppkey, max(l_linenumber) AS slot FROM lineitem GROUP BY 1, 2")
def win_slot_lookup_last_wins(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_linenumber").alias("slot"))


@query("SELECT l_orderkey, n, coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def win_cumulative_offsets(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return global_position(n, ["l_orderkey"], "start", F.col("n"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, md5(o_custkey || ':7') AS h FROM orders GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM g)
    SELECT o_custkey, CASE WHEN before < floor(0.1 * total) THEN 'test' WHEN before < floor(0.2 * total) THEN 'val' ELSE 'train' END AS split FROM c""")
def win_fill_split_material(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("h", F.md5(F.concat(F.col("o_custkey").cast("string"), F.lit(":7")).cast("binary")))
    c = global_position(g, ["h", "o_custkey"], "before", F.col("n"))
    total = table(spark, sf, "orders").agg(F.count("*").alias("total"))  # one row
    split = F.when(F.col("before") < F.floor(0.1 * F.col("total")), "test").when(F.col("before") < F.floor(0.2 * F.col("total")), "val").otherwise("train")
    return c.crossJoin(F.broadcast(total)).select("o_custkey", split.alias("split"))


@query("SELECT doc_id, CASE WHEN r < floor(0.1 * n) THEN 'test' WHEN r < floor(0.1 * n) + floor(0.1 * n) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':3'), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)")
def win_fill_split_row(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":3")).cast("binary")).alias("h"))
    total = d.agg(F.floor(0.1 * F.count("*")).alias("tenth"))  # one row
    r = global_position(d, ["h", "doc_id"], "r").crossJoin(F.broadcast(total))
    return r.select("doc_id", F.when(F.col("r") < F.col("tenth"), "test").when(F.col("r") < 2 * F.col("tenth"), "val").otherwise("train").alias("split"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY md5(o_orderkey || ':18012019'), o_orderkey) - 1) % 5)::BIGINT AS fold FROM orders")
def win_kfold(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":18012019")).cast("binary")).alias("h"))
    return global_position(o, ["h", "o_orderkey"], "r").select("o_orderkey", (F.col("r") % 5).alias("fold"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def win_leak_guard(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n")).filter("n > 1").select("o_custkey")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS r FROM part")
def win_rank_avg(spark, sf):
    return with_average_rank(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size", "r").select("p_partkey", "r")


@query("SELECT event_id, ((row_number() OVER (ORDER BY md5(event_id || ':1'), event_id) - 1) % 4)::BIGINT AS shard FROM events")
def win_shard(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":1")).cast("binary")).alias("h"))
    return global_position(e, ["h", "event_id"], "r").select("event_id", (F.col("r") % 4).alias("shard"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderpriority DESC, o_orderkey LIMIT 100")
def sort_multi_key_desc(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("o_orderpriority"), "o_orderkey").limit(100)


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")
def sort_mixed(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(50)


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r = 1 AND n > 1")
def sort_best_of_group(spark, sf):
    best = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max_by("p_partkey", F.struct("p_size", "p_retailprice", -F.col("p_partkey"))).alias("p_partkey"))
    return best.filter("n > 1").select("p_brand", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def topk_global(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 12")
def topk_per_class(spark, sf):
    return top_k(table(spark, sf, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 12).select("o_orderpriority", "o_orderkey")


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def topk_frequency(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


@query("SELECT round(sum(n) FILTER (r <= 10) / sum(n), 6) AS share FROM (SELECT n, row_number() OVER (ORDER BY n DESC, l_suppkey) AS r FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1))")
def topk_cumulative_share(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "l_suppkey").limit(10).agg(F.sum("n").alias("top"))
    return top.crossJoin(n.agg(F.sum("n").alias("every"))).select(F.round(F.col("top") / F.col("every"), 6).alias("share"))


#: The splits, in the order in which ties go.
SPLITS = ("test", "val", "train")


def deal(sizes: list[tuple[int, int]], ratios: dict[str, float]) -> list[tuple[int, int, int, list[str]]]:
    """(size, first rank, end of ranks, splits in turn): who takes the groups of each size, largest size first.

    Each group goes to the split that lacks most rows. While one split lacks more than the others by whole groups it takes
    all; then it takes turns with the next one, and at last all three do: three runs a size at most, whatever the count.
    """
    total = sum(n * count for n, count in sizes)
    lack = {s: ratios[s] * total for s in SPLITS}
    out = []
    for n, count in sorted(sizes, reverse=True):
        at = 0
        while at < count:
            first, second, third = sorted(SPLITS, key=lambda s: (-lack[s], SPLITS.index(s)))
            ahead = lambda a, b, k=0: (lack[a] - k * n, -SPLITS.index(a)) > (lack[b], -SPLITS.index(b))
            if not ahead(first, third, 1):
                turns, rounds = [first, second, third], -(-(count - at) // 3)
            else:
                turns = [first] if ahead(first, second, 1) else [first, second]
                rounds, rival = 1, second if len(turns) == 1 else third
                rounds = max(int((lack[turns[-1]] - lack[rival]) // n) - 1, 1)
                while ahead(turns[-1], rival, rounds):
                    rounds += 1
            taken = min(rounds * len(turns), count - at)
            out.append((n, at, at + taken, turns))
            for k, s in enumerate(turns):
                lack[s] -= n * ((taken - k + len(turns) - 1) // len(turns))
            at += taken
    return out


def grouped_split(groups: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """(family, grp, n, split) of (family, grp, n, h): each group goes to the split that lacks most rows, largest first, then by h and grp, in a family.

    The choice is made over the histogram of sizes, whose length is at most the root of twice a family's rows; each group
    finds its split by its rank among those of its size.
    """
    import pandas as pd

    at = global_position(groups, ["family", F.desc("n"), "h", "grp"], "__at")
    sizes = written(at.groupBy("family", "n").agg(F.count("*").alias("count"), F.min("__at").alias("start")))

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        found = deal(list(zip(pdf["n"].tolist(), pdf["count"].tolist())), ratios)
        return pd.DataFrame([(pdf["family"].iloc[0], *x) for x in found], columns=["family", "n", "low", "high", "turns"])

    table_of = sizes.groupBy("family").applyInPandas(runs, "family string, n long, low long, high long, turns array<string>").join(sizes, ["family", "n"])
    j = at.join(table_of, ["family", "n"]).withColumn("rank", F.col("__at") - F.col("start")).filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    turn = ((F.col("rank") - F.col("low")) % F.size("turns")).cast("int")
    return j.select("family", "grp", "n", F.get("turns", turn).alias("split"))


@query("""WITH RECURSIVE g AS (SELECT o_orderpriority AS family, o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, md5(grp::VARCHAR), grp) AS i, sum(n) OVER (PARTITION BY family) AS total FROM g),
    s AS (SELECT family, 0::BIGINT AS i, 0::BIGINT AS grp, 0::BIGINT AS n, ''::VARCHAR AS split, 0.1::DOUBLE * total AS test, 0.1::DOUBLE * total AS val, 0.8::DOUBLE * total AS train FROM (SELECT DISTINCT family, total FROM r)
    UNION ALL SELECT family, i, grp, n, split, test - CASE WHEN split = 'test' THEN n ELSE 0 END, val - CASE WHEN split = 'val' THEN n ELSE 0 END, train - CASE WHEN split = 'train' THEN n ELSE 0 END
    FROM (SELECT s.family, r.i, r.grp, r.n, test, val, train, CASE WHEN test >= val AND test >= train THEN 'test' WHEN val >= train THEN 'val' ELSE 'train' END AS split FROM s JOIN r ON r.family = s.family AND r.i = s.i + 1))
    SELECT family, grp, n, split FROM s WHERE i > 0""")
def win_greedy_grouped_split(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("grp")).agg(F.count("*").alias("n"))
    return grouped_split(o.withColumn("h", F.md5(F.col("grp").cast("string").cast("binary"))), {"test": 0.1, "val": 0.1, "train": 0.8})
