"""Rows against their neighbourhood: compositions within a distance, by a grid on the components that tell most apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.composition import _ROWS, _SHARES, chemsys, entries, fractions, meet, once, parse
from lodestone.registry import query, written

#: Distances are compared after rounding to so many digits, so that the order of additions doesn't matter.
DIGITS = 9


def l1(a: Column, b: Column) -> Column:
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x), DIGITS)


def within(points: DataFrame, reach: float, axes: int = 2) -> DataFrame:
    """(block, a, b, dist): pairs of points (block, point, vec) of a block within ``reach`` in L1, each with itself too.

    Vectors are shares of a whole, so what one component gains the others lose and no component differs by more than half
    of ``reach``. Points are dealt into cells of that width on the ``axes`` components with the widest spread in their
    block, and a point looks into its cell and those around it; only points of such cells are compared. Blocks of fewer
    components have fewer axes.
    """
    width = reach / 2
    each = points.select("block", F.posexplode("vec").alias("at", "x")).groupBy("block", "at").agg((F.max("x") - F.min("x")).alias("spread"))
    widest = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("spread", (-F.col("at")).alias("at"))), False).alias("order"))  # a row for each component
    chosen = widest.select("block", F.transform(F.slice("order", 1, axes), lambda o: -o["at"]).alias("axes"))
    placed = points.join(chosen, "block").withColumn("cell", F.transform("axes", lambda k: F.floor(F.get("vec", k) / width + 1e-6).cast("long")))

    def around(cell: Column) -> Column:
        start = F.array(F.array().cast("array<long>"))
        steps = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
        return F.aggregate(cell, start, lambda done, c: F.flatten(F.transform(done, lambda p: F.transform(steps, lambda k: F.concat(p, F.array(c + k))))))

    left = placed.select("block", F.col("point").alias("a"), F.col("vec").alias("va"), F.explode(around(F.col("cell"))).alias("cell"))
    right = placed.select("block", F.col("point").alias("b"), F.col("vec").alias("vb"), "cell")
    return left.join(right, ["block", "cell"]).select("block", "a", "b", l1(F.col("va"), F.col("vb")).alias("dist")).filter(F.col("dist") <= reach)


def without_own(around: DataFrame, own: DataFrame) -> DataFrame:
    """(point, own, n, around, low, high): how many of the values around a point (point, value, k) are left once ``own`` (point, own),
    one of them, is taken out once, their median, and their range.

    What is taken out moves each place behind it by one, so the two values in the middle are read off the running counts: a
    point's own values never meet all those around it.
    """
    by = Window.partitionBy("point").orderBy("value")
    upto = F.sum("k").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = around.withColumns({"upto": upto, "before": upto - F.col("k"), "next": F.lead("value").over(by), "last": F.lag("value").over(by)})
    total = around.groupBy("point").agg(F.sum("k").alias("all"))
    left = F.col("all") - 1
    places = F.array(*[f(f((left - 1) / 2) + d).cast("long") for f in (F.floor, F.ceil) for d in (0, 1)])
    at = F.filter(F.array_distinct("places"), lambda p: (p >= F.col("before")) & (p < F.col("upto")))
    middle = ranked.join(total.select("point", "all", places.alias("places")), "point").select("*", F.explode_outer(at).alias("place"))
    edge = lambda first: F.max(F.when(F.col("last" if first else "next").isNull(), F.struct("value", "k", F.col("next" if first else "last").alias("other"))))
    facts = middle.groupBy("point").agg(F.max("all").alias("all"), edge(True).alias("first"), edge(False).alias("end"), F.map_from_entries(F.collect_set(F.when(F.col("place").isNotNull(), F.struct("place", "value")))).alias("of"))
    starts = ranked.select("point", F.col("value").alias("own"), "before")
    j = own.join(starts, ["point", "own"]).join(facts, "point").withColumn("n", left).filter("n > 0")
    value = lambda f: F.try_element_at("of", (f((F.col("n") - 1) / 2) + F.when(f((F.col("n") - 1) / 2) >= F.col("before"), 1).otherwise(0)).cast("long"))
    end = lambda c: F.when((F.col(c)["value"] == F.col("own")) & (F.col(c)["k"] == 1), F.col(c)["other"]).otherwise(F.col(c)["value"])
    return j.select("point", "own", "n", ((value(F.floor) + value(F.ceil)) / 2).alias("around"), end("first").alias("low"), end("end").alias("high"))


def neighbourhood(rows: DataFrame, reach: float = 0.03, least: int = 3) -> DataFrame:
    """(id, n, around, low, high, nearest, distance, flag) of rows (id, block, vec, value) with ``least`` others within ``reach``.

    ``around`` is the median of the others' values, ``low`` and ``high`` their range, ``nearest`` the closest of them, the
    smallest id of equal ones. ``flag`` tells a value that is further from the median than 10 and half of the larger one:
    a zero among high ones, a high one among zeros, or a jump.

    Equal vectors are one point, and a point's equal values are counted before points meet, so work follows the distinct
    compositions and values and not the rows. A row's own value is taken out of the counts around its point.
    """
    rows = rows.filter(F.col("vec").isNotNull() & F.col("value").isNotNull())
    points = written(rows.groupBy("block", "vec").agg(F.min(F.struct("id", "value")).alias("first")).withColumn("point", F.monotonically_increasing_id()))
    mine = written(meet(rows, points.select("block", "vec", "point", F.col("first.id").alias("first_id")), ["block", "vec"]).select("id", "point", "value", "first_id"))
    near = written(within(points.select("block", "point", "vec"), reach).select("a", "b", "dist"))
    counts = written(mine.groupBy("point", "value").agg(F.count("*").alias("k")))
    around = near.join(counts.select(F.col("point").alias("b"), "value", "k"), "b").groupBy(F.col("a").alias("point"), "value").agg(F.sum("k").alias("k"))
    told = written(without_own(written(around), counts.select("point", F.col("value").alias("own"))).filter(F.col("n") >= least))
    second = mine.filter("id <> first_id").groupBy("point").agg(F.min("id").alias("second_id"))
    closest = near.filter("a <> b").join(points.select(F.col("point").alias("b"), F.col("first.id").alias("other")), "b").groupBy("a").agg(F.min(F.struct("dist", "other")).alias("c"))
    extra = points.select("point").join(second, "point", "left").join(closest.withColumnRenamed("a", "point"), "point", "left")
    j = meet(meet(mine, told.withColumnRenamed("own", "value"), ["point", "value"]), written(extra), ["point"])
    same = F.when(F.col("id") == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id"))
    apart = F.abs(F.col("value") - F.col("around")) > F.greatest(F.lit(10.0), 0.5 * F.greatest("value", "around"))
    kind = F.when((F.col("value") == 0) & (F.col("around") > 10), "zero among high").when((F.col("around") == 0) & (F.col("value") > 10), "high among zeros").otherwise("jump")
    return j.select(
        "id", "n", "around", "low", "high", F.coalesce(same, F.col("c.other")).alias("nearest"), F.when(same.isNotNull(), 0.0).otherwise(F.col("c.dist")).alias("distance"), F.when(apart, kind).alias("flag")
    )


@query(f"""WITH v AS (SELECT s.id, r.tc, string_agg(e, '-' ORDER BY e) AS block, list(f ORDER BY e) AS vec FROM {_SHARES} s JOIN {_ROWS} r USING (id) GROUP BY 1, 2),
    p AS (SELECT a.id, a.tc, b.id AS other, b.tc AS t, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: abs(x[1] - x[2]))), 9) AS dist FROM v a JOIN v b ON a.block = b.block AND a.id <> b.id WHERE round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: abs(x[1] - x[2]))), 9) <= 0.03),
    g AS (SELECT id, tc, count(*) AS n, median(t) AS around, min(t) AS low, max(t) AS high, arg_min(other, (dist, other)) AS nearest, min(dist) AS distance FROM p GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT id, n, round(around, 4) AS around, low, high, nearest, round(distance, 6) AS distance, CASE WHEN abs(tc - around) > greatest(10, 0.5 * greatest(tc, around)) THEN CASE WHEN tc = 0 AND around > 10 THEN 'zero among high' WHEN around = 0 AND tc > 10 THEN 'high among zeros' ELSE 'jump' END END AS flag FROM g""")
def join_band_self(spark, sf):
    """Formulas of a chemical system within 0.03 in L1 of their shares, and whether a temperature fits those around it."""
    comp = F.col("comp")
    vec = F.transform(F.array_sort(F.map_entries(fractions(comp))), lambda e: e["value"])
    f = once(entries(spark, sf).select("id", "formula", F.col("tc").alias("value")), ["formula"], lambda f: f.withColumn("comp", parse(F.col("formula"))).select("formula", chemsys(comp).alias("block"), vec.alias("vec")))
    found = neighbourhood(f.select("id", "block", "vec", "value"))
    return found.withColumn("around", F.round("around", 4)).withColumn("distance", F.round("distance", 6))
