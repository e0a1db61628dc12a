"""Harvests that resume: chunks banked one by one, misses settled in a table that only changes where it must, counters in the same pass."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.registry import query, scratch, table, written


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark._jsc.hadoopConfiguration()), p


def banked(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What chunks have banked in ``folder`` so far; unfinished ones don't count."""
    fs, p = _fs(spark, folder)
    done = [str(s.getPath()) for s in fs.listStatus(p(folder)) if s.getPath().getName().startswith("chunk-")] if fs.exists(p(folder)) else []
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def harvest(ids: DataFrame, fetch: Callable[[DataFrame], DataFrame], folder: str, schema: str, chunks: int = 8) -> list[str]:
    """Fetch the rows of all ``ids`` (id) that ``folder`` doesn't hold yet, chunk by chunk, and say what broke.

    Banked ids are read first and aren't asked for again. The rest is dealt into ``chunks`` by a hash of the id, written
    once, so that a chunk reads its own ids only. A chunk is written beside the others and becomes one of them by a
    rename when it is whole, so a run that breaks off leaves whole chunks; a chunk whose fetch fails is left for the next
    run, and the others go on. ``fetch`` takes a chunk's ids and returns rows (id, ...) of ``schema``; ids that it gives
    no row for are banked with nulls, so they are settled too.
    """
    spark = ids.sparkSession
    fs, p = _fs(spark, folder)
    fs.mkdirs(p(folder))
    left = ids.select("id").filter("id IS NOT NULL").distinct().join(banked(spark, folder, schema).select("id"), "id", "left_anti")
    work = scratch(spark)
    left.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).write.partitionBy("chunk").parquet(work)
    todo = sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(p(work)) if s.getPath().getName().startswith("chunk="))
    broken, run = [], uuid.uuid4().hex
    for k in todo:
        part = f"{folder}/partial-{run}-{k}"
        own = spark.read.schema(left.schema).parquet(f"{work}/chunk={k}")
        try:
            own.join(fetch(own), "id", "left").write.parquet(part)
        except PySparkException as e:
            broken.append(f"chunk {k}: {str(e).splitlines()[0][:90]}")
            fs.delete(p(part), True)
            continue
        if not fs.rename(p(part), p(f"{folder}/chunk-{run}-{k}")):
            raise OSError(f"could not bank chunk {k}")
    return broken


def settle(rows: DataFrame, target: str, buckets: int = 16, gone: str = "false") -> list[int]:
    """Merge ``rows`` (id, ...), one for each id, into the table at ``target``; returns the buckets that were written.

    A row takes the place of the one of its id; one that is ``gone`` only removes it. The table is dealt into ``buckets`` by a hash of the id. Only buckets that a row falls into are read and written
    again; each is written beside the table and takes its old self's place when it is whole, which steps aside first.
    """
    spark = rows.sparkSession
    fs, p = _fs(spark, target)
    fs.mkdirs(p(target))
    new = written(rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    there = [k for k in touched if fs.exists(p(f"{target}/bucket={k}"))]
    stay = new.filter(f"NOT ({gone})")
    both = stay
    if there:
        old = spark.read.option("basePath", target).schema(new.schema).parquet(*[f"{target}/bucket={k}" for k in there])
        both = old.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(stay)
    part = f"{target}-{uuid.uuid4().hex}"
    both.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(part)
    for k in touched:
        at, aside = p(f"{target}/bucket={k}"), p(f"{part}/old-{k}")
        if fs.exists(at) and not fs.rename(at, aside):
            raise OSError(f"could not move bucket {k} aside")
        whole = p(f"{part}/bucket={k}")
        if fs.exists(whole) and not fs.rename(whole, at):
            fs.rename(aside, at)
            raise OSError(f"could not put bucket {k} in its place")
    fs.delete(p(part), True)
    return touched


def settled(spark: SparkSession, target: str, schema: str) -> DataFrame:
    fs, p = _fs(spark, target)
    if not fs.exists(p(target)) or not len(fs.listStatus(p(target))):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(target)


_STATE = "id long, outcome string, grid array<double>"


def attach(records: DataFrame, has: DataFrame, fetch: Callable[[DataFrame], DataFrame], target: str, retry_no_object: bool = False) -> dict[str, int]:
    """Fetch what the records (id) miss and settle it in ``target`` (id, outcome, grid); returns how many had which outcome.

    ``skip``: a grid or a miss is settled already (with ``retry_no_object`` a ``no_object`` is open again). The rest is
    first held against ``has`` (id), what the service has at all: others are ``no_dos`` without a fetch. ``fetch`` gives
    (id, grid, outcome): a grid is ``ok``; ``no_dos`` and ``no_object`` are settled too; ``fail`` isn't, so the next run
    asks again. Counts come from the same pass that settles.
    """
    spark = records.sparkSession
    state = settled(spark, target, _STATE)
    again = (F.col("outcome") == "no_object") & F.lit(retry_no_object)
    known = state.select("id", (~again).alias("known"))
    j = records.select("id").distinct().join(known, "id", "left").join(has.select("id", F.lit(True).alias("there")).distinct(), "id", "left")
    todo = written(j.select("id", "known", "there"))  # known: null where nothing is settled, false where it is open again
    asked = fetch(todo.filter("NOT coalesce(known, false) AND there").select("id"))
    got = todo.filter("NOT coalesce(known, false)").join(asked, "id", "left")
    outcome = F.when(F.col("there").isNull(), "no_dos").when(F.col("grid").isNotNull(), "ok").otherwise(F.coalesce("outcome", F.lit("fail")))
    seen = Observation(f"attach-{uuid.uuid4().hex}")
    kinds = ("ok", "no_dos", "no_object", "fail")
    told = got.select("id", "known", outcome.alias("outcome"), "grid").observe(seen, *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
    settle(told.filter("outcome <> 'fail' OR known IS NOT NULL").drop("known"), target, gone="outcome = 'fail'")
    return {"skip": todo.filter("known").count(), **{k: int(seen.get[k]) for k in kinds}}


def counted(df: DataFrame, drops: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` without the rows that a condition of ``drops`` names, and how many each dropped: the first that holds counts.

    The counts are observed as the rows go by, so they cost no second pass; they are there once the rows have been used.
    """
    reason = F.lit(None).cast("string")
    for name, condition in reversed(drops.items()):
        reason = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(reason)
    seen = Observation(f"counted-{uuid.uuid4().hex}")
    told = df.withColumn("__reason", reason).observe(seen, F.count_if(F.col("__reason").isNull()).alias("kept"), *[F.count_if(F.col("__reason") == n).alias(n) for n in drops])
    return told.filter("__reason IS NULL").drop("__reason"), seen


_CHUNK = "id long, price double"


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS price FROM orders")
def source_api_chunked_resumable(spark, sf):
    """A run whose service fails for some chunks, and a second run over more ids that asks only for what isn't banked."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("price"))
    folder = scratch(spark)

    def failing(ids: DataFrame) -> DataFrame:
        bad = F.pmod(F.xxhash64("id"), F.lit(8)) == 3
        return ids.join(orders, "id").withColumn("price", F.when(bad, F.raise_error("the service broke off").cast("double")).otherwise(F.col("price")))

    harvest(orders.filter("id % 5 > 0").select("id"), failing, folder, _CHUNK)
    harvest(orders.select("id"), lambda ids: ids.join(orders, "id"), folder, _CHUNK)
    return banked(spark, folder, _CHUNK)


def _service(lines: DataFrame, fixed: bool) -> Callable[[DataFrame], DataFrame]:
    """Grids are the quantities of an order's large lines; a ``fixed`` service finds half of the objects that were missing."""
    grids = lines.filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_quantity")).alias("found"))

    def fetch(ids: DataFrame) -> DataFrame:
        gone = (F.col("id") % 4 == 1) & ~(F.lit(fixed) & (F.col("id") % 8 == 1))
        j = ids.join(grids, "id", "left")
        return j.select("id", F.when(~gone, F.col("found")).alias("grid"), F.when(gone, "no_object").when(F.col("found").isNull(), "fail").alias("outcome"))

    return fetch


@query("""WITH g AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1), o AS (SELECT o_orderkey AS id, coalesce(n, 0) AS n FROM orders LEFT JOIN g ON id = o_orderkey)
    SELECT id, CASE WHEN id % 4 = 0 THEN 'no_dos' WHEN id % 8 = 5 THEN 'no_object' ELSE 'ok' END AS outcome, CASE WHEN id % 4 > 0 AND id % 8 <> 5 THEN n ELSE 0 END AS points FROM o WHERE id % 4 = 0 OR id % 8 = 5 OR n > 0""")
def source_api_dos(spark, sf):
    """What is settled after a run and one that asks again for objects that weren't found; failures stay open."""
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    lines, target = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), scratch(spark)
    has = ids.filter("id % 4 <> 0")
    attach(ids, has, _service(lines, False), target)
    attach(ids, has, _service(lines, True), target, retry_no_object=True)
    return settled(spark, target, _STATE).select("id", "outcome", F.coalesce(F.size("grid"), F.lit(0)).cast("long").alias("points"))


@query("""WITH g AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1), o AS (SELECT o_orderkey AS id, coalesce(n, 0) AS n FROM orders LEFT JOIN g ON id = o_orderkey),
    r AS (SELECT 1 AS run, CASE WHEN id % 4 = 0 THEN 'no_dos' WHEN id % 4 = 1 THEN 'no_object' WHEN n = 0 THEN 'fail' ELSE 'ok' END AS outcome FROM o
        UNION ALL SELECT 2, CASE WHEN id % 4 = 0 OR (id % 4 > 1 AND n > 0) THEN 'skip' WHEN id % 8 = 5 THEN 'no_object' WHEN n = 0 THEN 'fail' ELSE 'ok' END FROM o)
    SELECT run, outcome, count(*) AS n FROM r GROUP BY 1, 2""")
def source_api_dos_counts(spark, sf):
    """How many records had which outcome in each of the two runs."""
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    lines, target = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), scratch(spark)
    runs = [attach(ids, ids.filter("id % 4 <> 0"), _service(lines, bool(k)), target, bool(k)) for k in (0, 1)]
    return spark.createDataFrame([(k, name, n) for k, run in enumerate(runs, 1) for name, n in run.items() if n], "run int, outcome string, n long")


@query("""SELECT count(*) FILTER (r IS NULL) AS kept, count(*) FILTER (r = 0) AS theoretical, count(*) FILTER (r = 1) AS no_structure, count(*) FILTER (r = 2) AS no_energy, count(*) FILTER (r = 3) AS bad_cif FROM
    (SELECT CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_custkey % 10 = 0 THEN 1 WHEN o_totalprice < 20000 THEN 2 WHEN o_orderkey % 97 = 0 THEN 3 END AS r FROM orders)""")
def source_api_energy(spark, sf):
    """Rejects of a harvest in their order, counted as the kept rows are written."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    drops = {"theoretical": F.col("o_orderstatus") == "P", "no_structure": F.col("o_custkey") % 10 == 0, "no_energy": F.col("o_totalprice") < 20000, "bad_cif": F.col("o_orderkey") % 97 == 0}
    kept, seen = counted(o, drops)
    written(kept.select("o_orderkey", "o_totalprice"))
    return spark.createDataFrame([tuple(int(seen.get[k]) for k in ("kept", *drops))], ", ".join(f"{k} long" for k in ("kept", *drops)))


@query("""WITH j AS (SELECT o_orderkey, c_custkey, n_nationkey, o_totalprice FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey)
    SELECT count(*) FILTER (c_custkey IS NOT NULL AND n_nationkey IS NOT NULL AND o_totalprice >= 50000) AS kept, count(*) FILTER (c_custkey IS NULL) AS no_customer, count(*) FILTER (c_custkey IS NOT NULL AND n_nationkey IS NULL) AS no_nation,
    count(*) FILTER (c_custkey IS NOT NULL AND n_nationkey IS NOT NULL AND o_totalprice < 50000) AS too_small FROM j""")
def join_assemble_counts(spark, sf):
    """The ordered drops of an assembled table, counted in the pass that writes it."""
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").filter("n_regionkey < 3").select("n_nationkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    drops = {"no_customer": F.col("c_custkey").isNull(), "no_nation": F.col("n_nationkey").isNull(), "too_small": F.col("o_totalprice") < 50000}
    kept, seen = counted(j, drops)
    written(kept.select("o_orderkey"))
    return spark.createDataFrame([tuple(int(seen.get[k]) for k in ("kept", *drops))], ", ".join(f"{k} long" for k in ("kept", *drops)))
