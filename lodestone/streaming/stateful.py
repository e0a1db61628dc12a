"""Streams with a state for each key: first-wins deduplication, and a breaker that counts failures in a row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.registry import query, scratch, table

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(spark: SparkSession, parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], own_state: bool = False, mode: str = "append") -> DataFrame:
    """What the stream ``build(input)`` writes when ``parts`` arrive one after the other in a folder, each as the files it has.

    After each arrival the query runs over what is new and stops; its checkpoint carries the state on. A batch replaces
    its own folder, so one that is run again isn't counted twice. ``own_state``: the state is the stream's own and needs a
    store with columns. In ``update`` mode the rows have the number of their ``batch`` too.
    """
    path, out, state = scratch(spark), scratch(spark), scratch(spark)
    schema = parts[0].schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    stream = build(spark.readStream.schema(schema).parquet(path))

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    if own_state:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for part in parts:
        part.write.mode("append").parquet(path)
        stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if mode == "update":
        return spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(out)
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


def first_wins(spark: SparkSession, parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """(keys, value): the smallest value of the first batch that has the key; later ones change nothing.

    The state is the stream's own aggregate, summed up where the rows are. A batch gives the keys it touched, and the first
    that was given for a key stands.
    """
    out = arrivals(spark, parts, lambda s: s.groupBy(*keys).agg(F.min(value).alias(value)), own_state=True, mode="update")
    return out.groupBy(*keys).agg(F.min_by(value, "batch").alias(value))


class Breaker(StatefulProcessor):
    """Counts a worker's failures in a row over batches, from its last success; one row for each worker and batch."""

    def __init__(self, most: int, abort: bool) -> None:
        self.most, self.abort = most, abort

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.strikes = handle.getValueState("strikes", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = int(self.strikes.get()[0]) if self.strikes.exists() else 0
        seen, worst, broken = 0, 0, None
        results = pd.concat(list(rows)).sort_values("event_id")  # one worker's results of one batch
        for at, bad in zip(results["event_id"].tolist(), results["bad"].tolist(), strict=True):
            n = n + 1 if bad else 0
            seen, worst = seen + 1, max(worst, n)
            if n >= self.most and broken is None:
                broken = at
        if self.abort and broken is not None:
            raise RuntimeError(f"worker {key[0]} failed {self.most} times in a row at {broken}")
        self.strikes.update((n,))
        yield pd.DataFrame({"worker": [key[0]], "seen": [seen], "worst": [worst], "broken_at": pd.array([broken], dtype="Int64")})

    def close(self) -> None:
        pass


def breaker(stream: DataFrame, most: int = 25, abort: bool = True) -> DataFrame:
    """(worker, seen, worst, broken_at) of a stream (worker, event_id, bad). With ``abort`` the query ends at the first worker that breaks."""
    out = "worker long, seen long, worst long, broken_at long"
    return stream.groupBy("worker").transformWithStateInPandas(Breaker(most, abort), out, "append", "none")


def aborts(spark: SparkSession, parts: list[DataFrame], most: int = 25) -> str | None:
    """The message a query that is watched ends with, or None where nothing broke."""
    try:
        arrivals(spark, parts, lambda s: breaker(s, most), own_state=True)
    except StreamingQueryException as e:
        found = re.search(r"worker \S+ failed \d+ times in a row at \d+", str(e))
        return found[0] if found else str(e)
    return None


def halves(df: DataFrame, by: str = "event_id") -> list[DataFrame]:
    """The rows up to the median of ``by``, and the others."""
    middle = df.agg(F.percentile_approx(by, 0.5).alias("m")).first()["m"]
    return [df] if middle is None else [df.filter(F.col(by) <= middle), df.filter(F.coalesce(F.col(by) > middle, F.lit(True)))]


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def stream_dedup_first(spark, sf):
    """The first event of each user and type: the smallest id of the batch in which they come first; later ones meet a state that has the key."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return first_wins(spark, halves(e), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("""WITH e AS (SELECT user_id AS worker, event_id, event_type IN ('error', 'signup') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT *, i - max(CASE WHEN NOT bad THEN i ELSE 0 END) OVER (PARTITION BY worker ORDER BY i ROWS UNBOUNDED PRECEDING) AS strikes FROM e)
    SELECT worker, count(*) AS seen, max(strikes) AS worst, min(event_id) FILTER (strikes >= 4) AS broken_at FROM s GROUP BY 1""")
def stream_failure_breaker(spark, sf):
    """Workers' failures in a row, counted over the batches of a stream."""
    bad = F.col("event_type").isin("error", "signup").alias("bad")
    e = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("worker"), "event_id", bad)
    found = arrivals(spark, halves(e), lambda s: breaker(s, 4, abort=False), own_state=True)
    return found.groupBy("worker").agg(F.sum("seen").alias("seen"), F.max("worst").alias("worst"), F.min("broken_at").alias("broken_at"))
