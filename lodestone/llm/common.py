"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch where whole texts travel, so that a worker's memory follows this number and the longest text.
TEXT_BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def slim_batches(spark: SparkSession) -> None:
    """The usual Arrow batch size, for rows of a few numbers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there; later stages never recompute what came before.

    The table goes when the application ends, or by ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def id_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def global_rank(df: DataFrame, group: list[str], order: list[str], rank: str) -> DataFrame:
    """Add ``rank``, gapless from 0 within each value of ``group``, in the order of ``order``; no group meets in one task.

    Rows are dealt by ranges of (group, order) and numbered within their range; a table of one row for each range and
    group (ranges + groups rows at most) holds where each range goes on. ``df`` should be slim: it is written once.
    """
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = cut(dealt.withColumn("__at", F.monotonically_increasing_id()))
    # the upper bits of the number are the range's, so a range and a group have consecutive numbers
    part = F.shiftright(F.col("__at"), 33)
    runs = dealt.groupBy(part.alias("__part"), *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    starts = (
        runs.alias("a")
        .join(runs.alias("b"), _all([*before, F.col("b.__part") < F.col("a.__part")]), "left")
        .groupBy("a.__part", "a.__first", *[f"a.{c}" for c in group])
        .agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__start"))
    ) if not group else _running(runs, group)
    keyed = dealt.withColumn("__part", part).alias("d")
    on = _all([F.col("d.__part") == F.col("s.__part"), *[F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]])
    return keyed.join(starts.alias("s"), on).select(
        *[F.col(f"d.{c}") for c in df.columns], (F.col("d.__at") - F.col("s.__first") + F.col("s.__start")).cast("long").alias(rank)
    )


def _running(runs: DataFrame, group: list[str]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("__start", F.coalesce(F.sum("__n").over(w), F.lit(0)))


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys`` (integers without nulls), yield tables of whole groups with the groups' bounds.

    Only the last group of what has been read waits for more rows.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        if rest and all(rest[0].column(k)[0] == x and batch.column(k)[0] == x for k, x in zip(keys, last, strict=True)):
            rest.append(batch)
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        bounds = group_bounds([table.column(k).to_numpy() for k in keys])
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        tail = table.slice(int(bounds[-2])).to_batches()
        rest = tail
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, group_bounds([table.column(k).to_numpy() for k in keys])


def group_bounds(columns: list[np.ndarray]) -> np.ndarray:
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n])) if n else np.zeros(1, dtype=np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Links of a node up to which they meet in one task.
OFTEN = 1024


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has a link; ``root`` is the smallest node reachable. Ids are longs.

    Alternates two steps until nothing changes: each node links its larger neighbours to its smallest one, then itself
    and its smaller neighbours to that one. Each round is an aggregation with partial sums and a join in which the links
    of a node that has very many are dealt over several tasks; nothing is collected, and each round is written to the
    checkpoint folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e, seen = _counted(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        low = cut(low)
        large = cut(_with_low(both.filter("v > u"), low, 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        own = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = _with_low(large, own, 2 * seen[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = e
        e, now = _counted(small.unionByName(own.select("u", F.col("m").alias("v"))).distinct())
        drop(before, low, large, own)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _with_low(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with the ``m`` of u, from a written table. A node with many of the ``total`` rows is dealt into lots; there are 10,000 such nodes at most."""
    most = max(OFTEN, total // 10_000)
    lots = F.ceil(F.col("n") / most).cast("int")
    dealt = rows.join(F.broadcast(low.filter(F.col("n") > most).select("u", lots.alias("lots"))), "u", "left")
    dealt = dealt.withColumn("lot", F.pmod(F.xxhash64("v"), F.coalesce("lots", F.lit(1))).cast("int"))
    return dealt.join(low.select("u", "m", F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot")), ["u", "lot"]).select("u", "v", "m")


def _counted(e: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    e = cut(e)
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return e, (row["n"], row["x"])
