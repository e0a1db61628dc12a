"""Scores of predictions: regression, classification, discovery, ranks and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.registry import query, table

#: Truth, two estimates, a family and a class for each order, as the queries here use them.
_TRUTH = "(SELECT o_orderkey AS id, o_orderpriority AS family, o_orderstatus AS grp, o_totalprice AS y, o_totalprice * (0.8 + (o_orderkey % 5) * 0.1) AS p, o_totalprice + (o_orderkey % 7 - 3) * 1000 AS q FROM orders)"


def estimates(spark, sf) -> DataFrame:
    y = F.col("o_totalprice")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("grp"), y.alias("y"), (y * (0.8 + (F.col("o_orderkey") % 5) * 0.1)).alias("p"), (y + (F.col("o_orderkey") % 7 - 3) * 1000).alias("q"))


def regression(y: Column, p: Column) -> list[Column]:
    e, positive = p - y, F.greatest(p, F.lit(0.0))
    logs = F.log1p(positive) - F.log1p(y)
    r2 = 1 - F.sum(e * e) / (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y))
    return [F.count(y).alias("n"), F.round(F.avg(F.abs(e)), 3).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"), F.round(F.avg(logs * logs), 6).alias("msle"), F.round(F.avg(F.abs(logs)), 6).alias("mae_log1p"), F.round(r2, 5).alias("r2")]


_REGRESSION = "count(y) AS n, round(avg(abs(p - y)), 3) AS mae, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + y), 2)), 6) AS msle, round(avg(abs(ln(1 + greatest(p, 0)) - ln(1 + y))), 6) AS mae_log1p, round(1 - sum((p - y) * (p - y)) / (count(y) * var_pop(y)), 5) AS r2"


@query(f"SELECT {_REGRESSION} FROM {_TRUTH}")
def agg_mae(spark, sf):
    return estimates(spark, sf).agg(*regression(F.col("y"), F.col("p")))


@query(f"SELECT family, grp, {_REGRESSION} FROM {_TRUTH} GROUP BY GROUPING SETS ((), (family), (grp))")
def agg_grouping_report(spark, sf):
    e = estimates(spark, sf)
    return e.groupingSets([[], ["family"], ["grp"]], "family", "grp").agg(*regression(F.col("y"), F.col("p")))


@query(f"SELECT family, round(avg(abs(p - y)) FILTER (y > 100000), 3) AS mae_pos, count(*) FILTER (y <= 100000) AS zeros FROM {_TRUTH} GROUP BY 1")
def agg_pos_only(spark, sf):
    sc = F.col("y") > 100000
    return estimates(spark, sf).groupBy("family").agg(F.round(F.avg(F.when(sc, F.abs(F.col("p") - F.col("y")))), 3).alias("mae_pos"), F.count_if(~sc).alias("zeros"))


def classification(truth: Column, said: Column) -> list[Column]:
    tp, fp, fn = (F.count_if(c).cast("double") for c in (truth & said, ~truth & said, truth & ~said))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return [F.round(F.count_if(truth == said) / F.count("*"), 6).alias("accuracy"), zero(F.try_divide(tp, tp + fp)).alias("precision"), zero(F.try_divide(tp, tp + fn)).alias("recall"), zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1")]


@query(f"""SELECT family, round(count(*) FILTER (t = s) / count(*), 6) AS accuracy, round(coalesce(count(*) FILTER (t AND s) / nullif(count(*) FILTER (s), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (t AND s) / nullif(count(*) FILTER (t), 0), 0), 6) AS recall,
    round(coalesce(2 * count(*) FILTER (t AND s) / nullif(count(*) FILTER (s) + count(*) FILTER (t), 0), 0), 6) AS f1 FROM (SELECT family, y > 150000 AS t, p > 150000 AS s FROM {_TRUTH}) GROUP BY 1""")
def agg_classification(spark, sf):
    return estimates(spark, sf).groupBy("family").agg(*classification(F.col("y") > 150000, F.col("p") > 150000))


def auc_by(df: DataFrame, group: str, truth: str, score: str) -> DataFrame:
    """Exact area under the ROC curve by group: average ranks from counts of equal scores; null with one class only."""
    from lodestone.operators.windows import rank_counts

    pos = df.groupBy(group, score).agg(F.count_if(truth).alias("pos"))
    ranked = rank_counts(df, group, score).join(pos, [group, score]).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    s = ranked.groupBy(group).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("m"))
    return s.select(group, F.round(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("m")), 6).alias("auc"))


@query(f"""SELECT family, round((sum(r) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2) / nullif(count(*) FILTER (t) * count(*) FILTER (NOT t), 0), 6) AS auc FROM
    (SELECT family, t, rank() OVER (PARTITION BY family ORDER BY s) + (count(*) OVER (PARTITION BY family, s) - 1) / 2 AS r FROM (SELECT family, y > 150000 AS t, floor(p / 5000) AS s FROM {_TRUTH})) GROUP BY 1""")
def agg_auc(spark, sf):
    e = estimates(spark, sf).select("family", (F.col("y") > 150000).alias("t"), F.floor(F.col("p") / 5000).alias("s"))
    return auc_by(e, "family", "t", "s")


@query(f"""SELECT tag, count(*) FILTER (t AND s) AS tp, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (NOT t AND NOT s) AS tn,
    round((count(*) FILTER (t AND s) / nullif(count(*) FILTER (s), 0)) / nullif(count(*) FILTER (t) / count(*), 0), 5) AS daf FROM
    (SELECT 'all' AS tag, y < 100000 AS t, p < 100000 AS s FROM {_TRUTH} UNION ALL SELECT 'unique', y < 100000, p < 100000 FROM {_TRUTH} WHERE grp = 'F') GROUP BY 1""")
def agg_discovery_metrics(spark, sf):
    e = estimates(spark, sf).select("grp", (F.col("y") < 100000).alias("t"), (F.col("p") < 100000).alias("s"))
    tags = F.when(F.col("grp") == "F", F.array(F.lit("all"), F.lit("unique"))).otherwise(F.array(F.lit("all")))
    e = e.withColumn("tag", F.explode(tags))
    t, s = F.col("t"), F.col("s")
    n = lambda c: F.count_if(c)
    daf = F.try_divide(F.try_divide(n(t & s).cast("double"), n(s)), F.try_divide(n(t).cast("double"), F.count("*")))
    return e.groupBy("tag").agg(n(t & s).alias("tp"), n(~t & s).alias("fp"), n(t & ~s).alias("fn"), n(~t & ~s).alias("tn"), F.round(daf, 5).alias("daf"))


@query(f"""SELECT c AS class, round(coalesce(count(*) FILTER (t = c AND s = c) / nullif(count(*) FILTER (s = c), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (t = c AND s = c) / nullif(count(*) FILTER (t = c), 0), 0), 6) AS recall
    FROM (SELECT (floor(y / 100000)::INT % 3) AS t, (floor(p / 100000)::INT % 3) AS s FROM {_TRUTH}), range(3) r(c) GROUP BY 1""")
def agg_per_class_pr(spark, sf):
    cls = lambda c: F.floor(F.col(c) / 100000) % 3
    e = estimates(spark, sf).select(cls("y").alias("t"), cls("p").alias("s"))
    one = e.groupBy("t", "s").agg(F.count("*").alias("n"))
    c = one.withColumn("class", F.explode(F.array_distinct(F.array("t", "s"))))
    hit = F.sum(F.when((F.col("t") == F.col("class")) & (F.col("s") == F.col("class")), F.col("n")).otherwise(0))
    of = lambda k: F.sum(F.when(F.col(k) == F.col("class"), F.col("n")).otherwise(0))
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return c.groupBy("class").agg(zero(F.try_divide(hit, of("s"))).alias("precision"), zero(F.try_divide(hit, of("t"))).alias("recall"))


@query(f"SELECT family, CASE WHEN count(*) > 2 THEN round(corr(y, p), 5) END AS r FROM {_TRUTH} GROUP BY 1")
def agg_pearson(spark, sf):
    return estimates(spark, sf).groupBy("family").agg(F.when(F.count("*") > 2, F.round(F.corr("y", "p"), 5)).alias("r"))


@query(f"""SELECT family, round(corr(a, b), 5) AS rho FROM (SELECT family, rank() OVER (PARTITION BY family ORDER BY y) + (count(*) OVER (PARTITION BY family, y) - 1) / 2 AS a, rank() OVER (PARTITION BY family ORDER BY z) + (count(*) OVER (PARTITION BY family, z) - 1) / 2 AS b FROM (SELECT *, floor(p / 1000) AS z FROM {_TRUTH})) GROUP BY 1""")
def agg_spearman(spark, sf):
    from lodestone.operators.windows import with_average_rank

    e = estimates(spark, sf).select("family", "y", F.floor(F.col("p") / 1000).alias("z"))
    r = with_average_rank(with_average_rank(e, "family", "y", "a"), "family", "z", "b")
    return r.groupBy("family").agg(F.round(F.corr("a", "b"), 5).alias("rho"))


@query(f"SELECT id, round((p + q) / 2, 3) AS mean, round(abs(p - q) / 2, 3) AS std, round(exp((ln(1 + greatest(p, 0)) + ln(1 + greatest(q, 0))) / 2) - 1, 2) AS log_mean FROM {_TRUTH}")
def agg_ensemble(spark, sf):
    m = estimates(spark, sf).unpivot(["id"], ["p", "q"], "series", "pred")
    return m.groupBy("id").agg(F.round(F.avg("pred"), 3).alias("mean"), F.round(F.stddev_pop("pred"), 3).alias("std"), F.round(F.expm1(F.avg(F.log1p(F.greatest("pred", F.lit(0.0))))), 2).alias("log_mean"))


@query(f"""SELECT family, round(avg(abs(e)), 5) AS l1, round(avg(e * e), 5) AS mse, round(avg(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END), 5) AS huber FROM (SELECT family, (p - y) / 50000 AS e FROM {_TRUTH}) GROUP BY 1""")
def agg_reg_losses(spark, sf):
    e = F.col("e")
    r = estimates(spark, sf).select("family", ((F.col("p") - F.col("y")) / 50000).alias("e"))
    return r.groupBy("family").agg(F.round(F.avg(F.abs(e)), 5).alias("l1"), F.round(F.avg(e * e), 5).alias("mse"), F.round(F.avg(F.when(F.abs(e) <= 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5)), 5).alias("huber"))


@query(f"SELECT series, round(avg(abs(v - y)), 3) AS mae FROM (SELECT y, 'p' AS series, p AS v FROM {_TRUTH} UNION ALL SELECT y, 'q', q FROM {_TRUTH}) GROUP BY 1")
def discover_series(spark, sf):
    return estimates(spark, sf).unpivot(["y"], ["p", "q"], "series", "v").groupBy("series").agg(F.round(F.avg(F.abs(F.col("v") - F.col("y"))), 3).alias("mae"))


@query("SELECT toxic AS class, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY toxic")
def class_weights(spark, sf):
    l = table(spark, sf, "labels")
    return l.groupBy(F.col("toxic").alias("class")).agg(F.count("*").alias("n")).crossJoin(l.agg(F.count("*").alias("every"))).select("class", F.round(F.col("every") / (2.0 * F.col("n")), 6).alias("weight"))


@query(f"SELECT id, round((y - m) / s, 5) AS z FROM {_TRUTH}, (SELECT avg(y) AS m, stddev_samp(y) AS s FROM {_TRUTH} WHERE id % 5 <> 0)")
def train_only_standardize(spark, sf):
    e = estimates(spark, sf)
    fit = e.filter("id % 5 <> 0").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"))  # one row
    return e.crossJoin(F.broadcast(fit)).select("id", F.round((F.col("y") - F.col("m")) / F.col("s"), 5).alias("z"))


@query(f"SELECT id, round(CASE WHEN grp = 'O' THEN 0.7 ELSE 0.2 END * p, 4) AS expected FROM {_TRUTH}")
def hurdle_expectation(spark, sf):
    return estimates(spark, sf).select("id", F.round(F.when(F.col("grp") == "O", 0.7).otherwise(0.2) * F.col("p"), 4).alias("expected"))


@query(f"""WITH g AS (SELECT s AS factor, avg(abs(p * s - y)) FILTER (id % 10 > 1) AS train, avg(abs(p * s - y)) FILTER (id % 10 <= 1) AS held FROM {_TRUTH}, (SELECT unnest([0.9, 1.0, 1.1, 1.2])::DOUBLE AS s) GROUP BY 1)
    SELECT factor, round(train, 3) AS train_mae, round(held, 3) AS held_mae, held < (SELECT held FROM g WHERE factor = 1.0) AS better_than_none FROM g ORDER BY train, factor LIMIT 1""")
def grid_search_argmin(spark, sf):
    """Every factor scored in one pass; the best one on the training fold, and what the held-out fold says of it against none."""
    e = estimates(spark, sf).withColumn("factor", F.explode(F.array(*map(F.lit, (0.9, 1.0, 1.1, 1.2)))))
    miss, held = F.abs(F.col("p") * F.col("factor") - F.col("y")), F.col("id") % 10 <= 1
    g = e.groupBy("factor").agg(F.avg(F.when(~held, miss)).alias("train"), F.avg(F.when(held, miss)).alias("held"))
    one = g.agg(F.min_by(F.struct("factor", "train", "held"), F.struct("train", "factor")).alias("best"), F.max(F.when(F.col("factor") == 1.0, F.col("held"))).alias("none"))  # a row for each factor
    return one.select("best.factor", F.round("best.train", 3).alias("train_mae"), F.round("best.held", 3).alias("held_mae"), (F.col("best.held") < F.col("none")).alias("better_than_none"))
