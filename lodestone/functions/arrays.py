"""Expressions on arrays, spectra and normalised values."""

from __future__ import annotations



from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.registry import query, table


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Zero where one vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def rbf(c: Column, n: int = 12, low: float = -1.0, high: float = 1.0) -> Column:
    """exp(-(c - centre)^2 / 2w^2) for ``n`` centres; w is their distance."""
    w = (high - low) / (n - 1)
    return F.array(*[F.exp(-F.pow(c - (low + k * w), F.lit(2.0)) / (2 * w * w)) for k in range(n)])


def gaussian_expand(d: Column, centres: list[float], width: float) -> Column:
    """exp(-(d - centre)^2 / width^2), without the factor two."""
    return F.array(*[F.exp(-F.pow(d - c, F.lit(2.0)) / width**2) for c in centres])


def trapezoid(y: Column, step: float) -> Column:
    inner = F.zip_with(F.slice(y, F.lit(1), F.greatest(F.size(y) - 1, F.lit(0))), F.slice(y, F.lit(2), F.greatest(F.size(y) - 1, F.lit(0))), lambda a, b: (a + b).cast("double") / 2)
    return total(inner) * step


def rebin_mean(v: Column, n: int, blocks: int) -> Column:
    size = n // blocks
    return F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: total(F.transform(F.slice(v, k * size + 1, F.lit(size)), lambda x: x.cast("double"))) / size)


def allen_dynes(lam: Column, w_log: Column, w2: Column, mu: float = 0.1) -> Column:
    """Critical temperature with both correction factors; zero where the exponent's denominator isn't positive."""
    d = lam - mu * (1 + 0.62 * lam)
    f1 = F.pow(1 + F.pow(lam / (2.46 * (1 + 3.8 * mu)), F.lit(1.5)), F.lit(1 / 3))
    r = w2 / w_log
    l2 = 1.82 * (1 + 6.3 * mu) * r
    f2 = 1 + (r - 1) * lam * lam / (lam * lam + l2 * l2)
    return F.when(d > 0, f1 * f2 * w_log / 1.2 * F.exp(-1.04 * (1 + lam) / d)).otherwise(0.0)


@query("SELECT o_orderkey, round((ln(1 + o_totalprice) - m) / s, 5) AS z FROM orders, (SELECT avg(ln(1 + o_totalprice)) AS m, stddev_samp(ln(1 + o_totalprice)) AS s FROM orders)")
def fn_znorm_log1p(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.log1p("o_totalprice").alias("v"))
    fit = o.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))  # one row
    return o.crossJoin(F.broadcast(fit)).select("o_orderkey", F.round((F.col("v") - F.col("m")) / F.col("s"), 5).alias("z"))


@query("SELECT l_orderkey, l_linenumber, c AS centre, round(exp(-pow(l_quantity - c * 10, 2) / 25.0), 8) AS g FROM lineitem, range(6) r(c)")
def fn_gaussian_expand(spark, sf):
    g = gaussian_expand(F.col("l_quantity"), [10.0 * k for k in range(6)], 5.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(g).alias("c", "g")).select("l_orderkey", "l_linenumber", F.col("c").cast("long").alias("centre"), F.round("g", 8).alias("g"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding)), lambda i: (embedding[i]::DOUBLE + embedding[i + 1]::DOUBLE) / 2)) * 0.5, 4) AS area FROM embeddings")
def fn_trapz(spark, sf):
    wide = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(trapezoid(wide, 0.5), 4).alias("area"))


@query("SELECT vec_id, k AS block, round(list_sum(embedding[k * 16 + 1:k * 16 + 16]::DOUBLE[]) / 16, 5) + 0 AS mean FROM embeddings, range(4) r(k)")
def rebin_blocks(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(rebin_mean(F.col("embedding"), 64, 4)).alias("block", "m"))
    return e.select("vec_id", F.col("block").cast("long").alias("block"), (F.round("m", 5) + 0).alias("mean"))


_LAMBDA = "(SELECT event_id, value / 50.0 AS lam, 100.0 + event_id % 200 AS w, (100.0 + event_id % 200) * 1.1 AS w2 FROM events)"


@query(f"""SELECT event_id, round(CASE WHEN lam - 0.1 * (1 + 0.62 * lam) > 0 THEN pow(1 + pow(lam / (2.46 * 1.38), 1.5), 1.0 / 3) * (1 + (w2 / w - 1) * lam * lam / (lam * lam + pow(1.82 * 1.63 * (w2 / w), 2))) * w / 1.2 * exp(-1.04 * (1 + lam) / (lam - 0.1 * (1 + 0.62 * lam))) ELSE 0 END, 4) AS tc
    FROM (SELECT event_id, lam::DOUBLE AS lam, w::DOUBLE AS w, w2::DOUBLE AS w2 FROM {_LAMBDA})""")
def fn_allen_dynes(spark, sf):
    w = F.lit(100.0) + F.col("event_id") % 200
    return table(spark, sf, "events").select("event_id", F.round(allen_dynes(F.col("value") / 50.0, w, w * 1.1), 4).alias("tc"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS l1, len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AS present FROM embeddings")
def fn_nan_mask(spark, sf):
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(total(F.transform("embedding", lambda x: F.abs(x.cast("double")))), 4).alias("l1"), ok.alias("present"))


@query("SELECT l_orderkey, list_aggregate(list_concat(s[1:3], list_transform(range(greatest(3 - len(s), 0)), lambda x: 0.0)), 'string_agg', ',') AS padded FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS s FROM lineitem GROUP BY 1)")
def fn_pad_truncate(spark, sf):
    s = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"])
    padded = F.slice(F.concat(F.slice("s", 1, 3), F.array_repeat(F.lit(0.0), 3)), 1, 3)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(s.alias("s")).select("l_orderkey", F.array_join(padded.cast("array<string>"), ",").alias("padded"))


