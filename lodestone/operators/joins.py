"""Joins: lookups, semi and anti joins, blocked self-joins, and theta joins turned into joins on generated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.composition import _PARTS, VALENCE, formulas
from lodestone.registry import query, table, written


def in_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that every frame has: one aggregation over the union instead of a chain of joins."""
    tagged = [f.select(key, F.lit(n).alias("member")).distinct() for n, f in enumerate(frames)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return every.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(frames)).select(key)


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no customer' WHEN n_nationkey IS NULL THEN 'no nation' ELSE 'kept' END AS outcome, coalesce(r_name, 'Other') AS family
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def join_assemble(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_nationkey")
    n, r = table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf, "region").filter("r_regionkey < 3")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    outcome = F.when(F.col("c_custkey").isNull(), "no customer").when(F.col("n_nationkey").isNull(), "no nation").otherwise("kept")
    return j.select("o_orderkey", outcome.alias("outcome"), F.coalesce("r_name", F.lit("Other")).alias("family"))


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id)")
def join_left_dict(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def join_inner(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").filter("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")


@query("SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT l_partkey AS k, count(*) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS y FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.k = b.k")
def join_outer(spark, sf):
    l = table(spark, sf, "lineitem").filter("l_returnflag IN ('R', 'A')")
    n = lambda f, c: l.filter(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias(c))
    return n("R", "x").join(n("A", "y"), "k", "full")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_semi_isin(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey FROM lineitem WHERE l_discount = 0)")
def join_anti_isin(spark, sf):
    gone = table(spark, sf, "lineitem").filter("(l_quantity > 49 OR l_discount = 0) AND l_partkey IS NOT NULL").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(gone, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def join_intersection_n(spark, sf):
    l = table(spark, sf, "lineitem")
    return in_all([l.filter(F.col("l_returnflag") == f) for f in "RAN"], "l_partkey")


@query("SELECT p_partkey, best FROM part LEFT JOIN (SELECT p_brand AS b, max(p_retailprice) AS best FROM part WHERE p_size < 10 GROUP BY 1) ON p_brand = b")
def join_set_lookup_exact(spark, sf):
    p = table(spark, sf, "part")
    best = p.filter("p_size < 10").groupBy("p_brand").agg(F.max("p_retailprice").alias("best"))
    return p.select("p_partkey", "p_brand").join(best, "p_brand", "left").select("p_partkey", "best")


@query("""SELECT p_partkey, CASE WHEN e.t IS NOT NULL THEN 'exact' WHEN f.s IS NOT NULL THEN 'family' ELSE 'none' END AS match FROM (SELECT *, array_to_string(list_sort(string_split(p_name, ' ')), '-') AS s FROM part) q
    LEFT JOIN (SELECT DISTINCT p_name AS t FROM part WHERE p_size = 1) e ON e.t = q.p_name LEFT JOIN (SELECT DISTINCT array_to_string(list_sort(string_split(p_name, ' ')), '-') AS s FROM part WHERE p_size < 3) f ON f.s = q.s""")
def join_set_lookup_elementset(spark, sf):
    p = table(spark, sf, "part").withColumn("s", F.array_join(F.array_sort(F.split("p_name", " ")), "-"))
    exact = p.filter("p_size = 1").select("p_name").distinct().withColumn("e", F.lit(True))
    family = p.filter("p_size < 3").select("s").distinct().withColumn("f", F.lit(True))
    j = p.join(exact, "p_name", "left").join(family, "s", "left")
    return j.select("p_partkey", F.when(F.col("e"), "exact").when(F.col("f"), "family").otherwise("none").alias("match"))


@query("""WITH w AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS a, p_retailprice AS v FROM part),
    k AS (SELECT p_partkey, array_to_string(a, '-') AS s FROM w UNION SELECT p_partkey, array_to_string(list_filter(a, lambda x: x <> a[i]), '-') FROM (SELECT p_partkey, a, unnest(range(1, len(a) + 1)) AS i FROM w WHERE len(a) > 2))
    SELECT k.p_partkey, count(*) AS parents FROM k JOIN (SELECT string_agg(DISTINCT x, '-' ORDER BY x) AS s FROM (SELECT p_partkey, unnest(a[1:2]) AS x FROM w) GROUP BY p_partkey) q ON q.s = k.s GROUP BY 1""")
def join_subset_match(spark, sf):
    w = table(spark, sf, "part").select("p_partkey", F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("a"))
    fewer = F.when(F.size("a") > 2, F.transform("a", lambda x: F.array_join(F.array_remove("a", x), "-"))).otherwise(F.array().cast("array<string>"))
    keys = w.select("p_partkey", F.explode(F.array_distinct(F.concat(F.array(F.array_join("a", "-")), fewer))).alias("s"))
    pool = w.select(F.array_join(F.slice("a", 1, 2), "-").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return keys.join(pool, "s").groupBy("p_partkey").agg(F.sum("n").alias("parents"))


@query("SELECT DISTINCT a.p_partkey FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 30")
def join_elementwise_tolerance(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    a, b = p.alias("a"), p.alias("b")
    on = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.p_partkey") != F.col("b.p_partkey")) & (F.abs(F.col("a.p_retailprice") - F.col("b.p_retailprice")) <= 30)
    return a.join(b, on, "left_semi").select("p_partkey")


def band_neighbours(df: DataFrame, block: str, key: str, value: str, reach: float, itself: bool = False) -> DataFrame:
    """(block, a, b) rows within ``reach`` of each other in a block: an equi-join on the block and the band of the value."""
    band = F.floor(F.col(value) / reach)
    left = df.select(F.col(block).alias("block"), F.col(key).alias("a"), F.col(value).alias("va"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    right = df.select(F.col(block).alias("block"), F.col(key).alias("b"), F.col(value).alias("vb"), band.alias("band"))
    near = left.join(right, ["block", "band"]).filter(F.abs(F.col("va") - F.col("vb")) <= reach)
    return near if itself else near.filter(F.col("a") != F.col("b"))


@query("""SELECT a.p_partkey AS id, count(*) AS n, round(median(b.p_size), 4) AS around FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 25 GROUP BY 1 HAVING count(*) >= 3""")
def join_band_prices(spark, sf):
    """Equal prices and sizes of a brand are counted before they meet, so pairs are of distinct prices and not of rows; a part's own
    size is taken out of the counts around it."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    counts = written(p.groupBy("p_brand", "p_retailprice", "p_size").agg(F.count("*").alias("k")))
    prices = counts.select("p_brand", "p_retailprice").distinct().withColumn("key", F.col("p_retailprice"))
    near = band_neighbours(prices, "p_brand", "key", "p_retailprice", 25.0, itself=True).select("block", "a", "b")
    sizes = counts.select(F.col("p_brand").alias("block"), F.col("p_retailprice").alias("b"), F.col("p_size").alias("size"), "k")
    around = near.join(sizes, ["block", "b"]).groupBy("block", "a", "size").agg(F.sum("k").alias("k"))
    own = counts.select(F.col("p_brand").alias("block"), F.col("p_retailprice").alias("a"), F.col("p_size").alias("own"))
    left = around.join(own, ["block", "a"]).withColumn("k", F.col("k") - F.when(F.col("size") == F.col("own"), 1).otherwise(0)).filter("k > 0")
    told = left.groupBy("block", "a", "own").agg(F.sum("k").alias("n"), F.round(F.percentile("size", F.lit(0.5), F.col("k")), 4).alias("around")).filter("n >= 3")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.col("p_retailprice").alias("a"), F.col("p_size").alias("own")).join(told, ["block", "a", "own"]).select("id", "n", "around")


@query("""SELECT DISTINCT id FROM (SELECT unnest([a.p_partkey, b.p_partkey]) AS id FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) > 10)""")
def join_near_duplicate_pairs(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand", "p_type")
    spread = p.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")).filter("hi - lo > 10")
    j = table(spark, sf, "part").join(spread, ["p_brand", "p_type"])
    return j.filter("p_size - lo > 10 OR hi - p_size > 10").select(F.col("p_partkey").alias("id"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_group_expand(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(o.filter("o_totalprice > 300000").select("o_custkey"), "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT l_orderkey AS center, l_partkey AS other FROM lineitem UNION ALL SELECT l_partkey, l_orderkey FROM lineitem")
def join_adjacency(spark, sf):
    ends = F.array(F.struct(F.col("l_orderkey").alias("center"), F.col("l_partkey").alias("other")), F.struct(F.col("l_partkey").alias("center"), F.col("l_orderkey").alias("other")))
    return table(spark, sf, "lineitem").select(F.inline(ends))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def join_edges_by_id(spark, sf):
    o, l = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'"), table(spark, sf, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).select("o_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def join_cross_source_pairs(spark, sf):
    from lodestone.functions.arrays import cosine

    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("""SELECT count(*) FILTER (both_runs) AS shared, count(*) AS either, count(*) FILTER (both_runs) >= 0.95 * count(*) AS enough FROM (SELECT doc_id, count(*) = 2 AS both_runs FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY doc_id)""")
def join_paired_runs(spark, sf):
    l = table(spark, sf, "labels")
    a, b = (l.filter(c).select("doc_id", F.lit(1).alias(n)) for c, n in (("quality = 1", "a"), ("toxic = 0", "b")))
    j = a.join(b, "doc_id", "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count("*").alias("either"))
    return j.withColumn("enough", F.col("shared") >= 0.95 * F.col("either"))


@query("SELECT coalesce(split, 'unmapped') AS split, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'test' ELSE 'train' END AS split FROM labels) USING (doc_id) GROUP BY 1")
def join_fixed_split(spark, sf):
    s = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "test").otherwise("train").alias("split"))
    return table(spark, sf, "documents").select("doc_id").join(s, "doc_id", "left").groupBy(F.coalesce("split", F.lit("unmapped")).alias("split")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id + CASE WHEN toxic = 1 THEN 1000000000 ELSE 0 END AS doc_id FROM labels) SELECT doc_id, source, (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)) AS missing FROM documents WHERE doc_id IN (SELECT doc_id FROM l)""")
def eval_ids_import(spark, sf):
    """Exactly the rows of a shared list of ids, and how many of its ids aren't there (some of this list are of another table)."""
    d, l = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    listed = l.select((F.col("doc_id") + F.when(F.col("toxic") == 1, 1_000_000_000).otherwise(0)).alias("doc_id"))
    missing = listed.join(d, "doc_id", "left_anti").agg(F.count("*").alias("missing"))  # one row
    return d.join(listed, "doc_id", "left_semi").crossJoin(F.broadcast(missing))


def backfill(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, outcome, positions, lattice, forces, magmom, stress) for each incoming (id, z, coords, lattice, force, magmom, stress),
    given existing (id, z, positions, lattice, forces, magmom, stress).

    ``missing``: no such record; ``skip``: it has forces already; ``fail``: the incoming structure can't be read or its
    stress isn't nine numbers; ``mismatch``: another number or order of atoms, or a force for another number of them; else
    ``ok``, and only then is anything attached: positions and lattice always, forces, moments and stress where they are
    given, moments only where there is one for each atom. A record keeps what isn't replaced. Images of bonds aren't made
    again: they are the builder's.
    """
    i, e = incoming.alias("i"), existing.alias("e")
    n = F.size("e.z")
    bad = (n != F.size("i.z")) | (F.col("e.z") != F.col("i.z")) | (F.col("i.force").isNotNull() & (F.size("i.force") != n))
    odd = F.col("i.stress").isNotNull() & (F.size("i.stress") != 9)
    outcome = F.when(F.col("e.z").isNull(), "missing").when(F.col("e.forces").isNotNull(), "skip").when(F.col("i.coords").isNull(), "fail").when(bad, "mismatch").when(odd, "fail").otherwise("ok")
    j = i.join(e, "id", "left").withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    taken = lambda new, old, also=F.lit(True): F.when(ok & F.col(f"i.{new}").isNotNull() & also, F.col(f"i.{new}")).otherwise(F.col(f"e.{old}")).alias(old)
    each = F.size("i.magmom") == n
    return j.select("id", "outcome", taken("coords", "positions"), taken("lattice", "lattice"), taken("force", "forces"), taken("magmom", "magmom", each), taken("stress", "stress"))


_ATOMS = "(SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS z, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1)"


@query(f"""WITH e AS (SELECT id, z, q, CASE WHEN id % 6 < 2 THEN q END AS positions, CASE WHEN id % 6 = 0 THEN q END AS forces, CASE WHEN id % 4 = 0 THEN q END AS magmom FROM {_ATOMS} WHERE id % 5 <> 0),
    i AS (SELECT id, q, CASE WHEN id % 7 = 0 THEN z[1:len(z) - 1] WHEN id % 11 = 0 THEN list_reverse(z) ELSE z END AS z, CASE WHEN id % 13 > 0 THEN list_transform(q, lambda x: x + 1) END AS coords, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 17 = 0 THEN q[1:1] ELSE q END AS force,
        CASE WHEN id % 8 < 3 THEN list_transform(q, lambda x: x / 10) WHEN id % 8 = 3 THEN q[1:1] END AS magmom, CASE WHEN id % 10 < 4 THEN list_transform(range(9), lambda x: x + id % 7) WHEN id % 10 = 4 THEN [1.0, 2.0] END AS stress FROM {_ATOMS}),
    o AS (SELECT i.id, e.positions AS ep, e.forces AS ef, e.magmom AS em, len(e.z) AS n, coords, force, i.magmom AS im, stress, i.q[1] AS edge,
        CASE WHEN e.z IS NULL THEN 'missing' WHEN e.forces IS NOT NULL THEN 'skip' WHEN coords IS NULL THEN 'fail' WHEN len(e.z) <> len(i.z) OR e.z <> i.z OR (force IS NOT NULL AND len(force) <> len(e.z)) THEN 'mismatch' WHEN stress IS NOT NULL AND len(stress) <> 9 THEN 'fail' ELSE 'ok' END AS outcome FROM i LEFT JOIN e USING (id))
    SELECT id, outcome, round(list_sum(CASE WHEN outcome = 'ok' THEN coords ELSE ep END), 3) AS positions, round(list_sum(CASE WHEN outcome = 'ok' THEN coalesce(force, ef) ELSE ef END), 3) AS forces, CASE WHEN outcome = 'ok' THEN round(edge, 3) END AS lattice,
        round(list_sum(CASE WHEN outcome = 'ok' AND im IS NOT NULL AND len(im) = n THEN im ELSE em END), 3) AS magmom, round(CASE WHEN outcome = 'ok' THEN list_sum(stress)::DOUBLE END, 3) AS stress FROM o""")
def update_backfill(spark, sf):
    """Positions, lattices, forces, moments and stress attached to the records that were built, from the frames they came from."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    atoms = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rows.alias("r")).select("id", F.col("r.l_partkey").alias("z"), F.col("r.l_quantity").alias("q"))
    k, q, none = F.col("id"), F.col("q"), F.lit(None).cast("array<double>")
    existing = atoms.filter("id % 5 <> 0").select("id", "z", F.when(k % 6 < 2, q).alias("positions"), none.alias("lattice"), F.when(k % 6 == 0, q).alias("forces"), F.when(k % 4 == 0, q).alias("magmom"), none.alias("stress"))
    z = F.when(k % 7 == 0, F.slice("z", F.lit(1), F.size("z") - 1)).when(k % 11 == 0, F.reverse("z")).otherwise(F.col("z"))
    force = F.when(k % 3 == 0, F.lit(None)).when(k % 17 == 0, F.slice("q", 1, 1)).otherwise(q)
    magmom = F.when(k % 8 < 3, F.transform("q", lambda x: x / 10)).when(k % 8 == 3, F.slice("q", 1, 1))
    stress = F.when(k % 10 < 4, F.transform(F.sequence(F.lit(0), F.lit(8)), lambda x: (x + k % 7).cast("double"))).when(k % 10 == 4, F.array(F.lit(1.0), F.lit(2.0)))
    incoming = atoms.select("id", z.alias("z"), F.when(k % 13 > 0, F.transform("q", lambda x: x + 1)).alias("coords"), F.slice("q", 1, 1).alias("lattice"), force.alias("force"), magmom.alias("magmom"), stress.alias("stress"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 3).alias(c)
    return backfill(existing, incoming).select("id", "outcome", *map(total, ("positions", "forces", "lattice", "magmom", "stress")))


@query(f"SELECT e AS element, count(*) AS formulas FROM {_PARTS} WHERE e NOT IN ({', '.join(repr(x) for x in VALENCE)}) GROUP BY 1")
def validate_elements(spark, sf):
    """Elements of the formulas that a table of values doesn't cover, with how many formulas need them."""
    known = F.broadcast(spark.createDataFrame([(x,) for x in VALENCE], "element string"))  # a row for each element
    return formulas(spark, sf).select(F.explode(F.map_keys("comp")).alias("element")).join(known, "element", "left_anti").groupBy("element").agg(F.count("*").alias("formulas"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def worklist_resume(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(done, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")
