"""What a run leaves behind and reads again: prediction files, metrics, epoch logs, names, paths and durations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.metrics import _TRUTH, estimates
from lodestone.registry import query, scratch, table

#: Prediction columns of a table with a header, and its column of true values.
_SERIES, _TRUE = re.compile(r"tc_(.+)_K"), "tc_true_K"


def unpivot_series(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, truth, series, pred): a row for each prediction column, found by its name; an error where there is none."""
    names = {c: m[1] for c in df.columns if c != _TRUE and (m := _SERIES.fullmatch(c))}
    if not names:
        raise ValueError(f"no prediction columns among {df.columns}")
    long = df.unpivot([*keys, _TRUE], list(names), "series", "pred").withColumnRenamed(_TRUE, "truth")
    return long.withColumn("series", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("series")))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, truth, series, pred) of CSV files with a header and a column for each series, or of headerless ones: the first line tells."""
    first = spark.read.text(path).first()
    if first and _TRUE in first[0]:
        raw = spark.read.option("header", True).csv(path)
        typed = raw.select("id", *[F.col(c).try_cast("double").alias(c) for c in raw.columns if c == _TRUE or _SERIES.fullmatch(c)])
        return unpivot_series(typed, ["id"])
    return spark.read.schema("id string, truth double, pred double").csv(path).select("id", "truth", F.lit("only").alias("series"), "pred")


def _predictions(spark, sf) -> DataFrame:
    three = lambda c: F.format_string("%.3f", c)
    return estimates(spark, sf).select("id", "family", F.col("grp").alias("group"), three("y").alias(_TRUE), three("p").alias("tc_probe_K"), three("q").alias("tc_head_K"))


@query(f"SELECT id, round(y, 3) AS truth, unnest(['probe', 'head']) AS series, round(unnest([p, q]), 3) AS pred FROM {_TRUTH}")
def unpivot_series_by_name(spark, sf):
    wide = estimates(spark, sf).select("id", F.round("y", 3).alias(_TRUE), F.round("p", 3).alias("tc_probe_K"), F.round("q", 3).alias("tc_head_K"))
    return unpivot_series(wide, ["id"]).select("id", "truth", "series", "pred")


@query(f"SELECT 'headed' AS file, id::VARCHAR AS id, round(y + 1e-7, 1) AS truth, unnest(['probe', 'head']) AS series, round(unnest([p, q]) + 1e-7, 1) AS pred FROM {_TRUTH} UNION ALL SELECT 'plain', id::VARCHAR, round(y + 1e-7, 1), 'only', round(p + 1e-7, 1) FROM {_TRUTH}")
def sniff_format(spark, sf):
    """The same rows written with a header and without one, and read by what the first line says."""
    headed, plain, p = scratch(spark), scratch(spark), _predictions(spark, sf)
    p.write.option("header", True).csv(headed)
    p.select("id", _TRUE, "tc_probe_K").write.csv(plain)
    both = read_predictions(spark, headed).withColumn("file", F.lit("headed")).unionByName(read_predictions(spark, plain).withColumn("file", F.lit("plain")))
    return both.select("file", "id", F.round(F.col("truth") + 1e-7, 1).alias("truth"), "series", F.round(F.col("pred") + 1e-7, 1).alias("pred"))


@query(f"SELECT family, count(*) AS n, round(avg(abs(round(q, 3) - round(y, 3))), 2) AS from_rows, round(avg(abs(q - y)), 2) AS from_metrics FROM {_TRUTH} GROUP BY 1")
def sink_predictions(spark, sf):
    """predictions.csv with three decimals and metrics.json with the errors of each family under a head; both are read back."""
    rows, metrics, e = scratch(spark), scratch(spark), estimates(spark, sf)
    _predictions(spark, sf).write.option("header", True).csv(rows)
    scored = e.groupBy("family").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("q") - F.col("y"))).alias("mae_K"))
    every = F.map_from_entries(F.collect_list(F.struct("family", F.struct("n", "mae_K"))))  # a row for each family
    scored.agg(every.alias("families")).select(F.to_json(F.struct(F.struct("families").alias("head"))).alias("value")).coalesce(1).write.text(metrics)
    told = spark.read.schema("head struct<families: map<string, struct<n: long, mae_K: double>>>").json(metrics).select(F.explode("head.families").alias("family", "m"))
    read = spark.read.option("header", True).schema("id long, family string, `group` string, tc_true_K double, tc_probe_K double, tc_head_K double").csv(rows)
    again = read.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("tc_head_K") - F.col(_TRUE))), 2).alias("from_rows"))
    return again.join(told, "family").select("family", "n", "from_rows", F.round("m.mae_K", 2).alias("from_metrics"))


def remapped(path: Column, old: str, new: str) -> Column:
    """``path`` with its beginning ``old`` replaced by ``new``; other paths, and the same words further on, stay."""
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'database/datafiles/MP/' || source || '/database/MP/x' ELSE 'other/database/MP/' || source END AS path FROM documents")
def fn_prefix_remap(spark, sf):
    path = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("database/MP/"), "source", F.lit("/database/MP/x"))).otherwise(F.concat(F.lit("other/database/MP/"), "source"))
    return table(spark, sf, "documents").select("doc_id", remapped(path, "database/MP/", "database/datafiles/MP/").alias("path"))


_RUN = r"^(.+?)_([0-9]{4}-[0-9]{2}-[0-9]{2})_([0-9]{2}-[0-9]{2}-[0-9]{2})(_.*)?$"


def run_name(name: Column) -> list[Column]:
    """tag, date and time of a run's name, up to the first date in it; null where the name isn't one."""
    fits = name.rlike(_RUN)
    return [F.when(fits, F.regexp_extract(name, _RUN, k)).alias(label) for k, label in enumerate(("tag", "date", "time"), 1)]


@query("""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_type || CASE WHEN event_id % 2 = 0 THEN '_v2' ELSE '' END END AS tag, CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%H-%M-%S') END AS time FROM events""")
def fn_run_name_parse(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd_HH-mm-ss")
    k = F.col("event_id") % 5
    name = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "_v2").otherwise(""), F.lit("_"), F.when(k > 0, stamp).otherwise("latest"), F.when(k == 1, "_2020-01-01_00-00-00").when(k == 2, "_again").otherwise(""))
    return table(spark, sf, "events").select("event_id", *run_name(name))


def duration(seconds: Column) -> Column:
    """45s, 3m12s or 2h41m; nothing below zero."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, s % 60)).otherwise(F.format_string("%ds", s))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS took FROM (SELECT event_id, greatest(floor(value * 37 - 50), 0)::BIGINT AS s FROM events)")
def fn_fmt_duration(spark, sf):
    return table(spark, sf, "events").select("event_id", duration(F.col("value") * 37 - 50).alias("took"))


_LOG = "(SELECT user_id AS run, event_id AS epoch, CASE WHEN event_id % 17 > 0 THEN value END AS val, value * (0.5 + (event_id % 5) * 0.1) AS train FROM events)"


def _epochs(spark, sf) -> DataFrame:
    val = F.when(F.col("event_id") % 17 > 0, F.col("value"))
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), val.alias("val"), (F.col("value") * (0.5 + (F.col("event_id") % 5) * 0.1)).alias("train"))


@query(f"SELECT run, min(val) AS best_val, arg_min(epoch, (val, epoch)) FILTER (val IS NOT NULL) AS best_epoch, count(*) AS n_epochs, round(coalesce(arg_max(coalesce(val, 0), epoch), 0) - arg_max(train, epoch), 4) AS gap FROM {_LOG} GROUP BY 1")
def argmin_epoch(spark, sf):
    """A run's best validation error and epoch, and how far validation is over training at its end; epochs without a value don't win."""
    best = F.min_by("epoch", F.when(F.col("val").isNotNull(), F.struct("val", "epoch")))
    gap = F.max_by(F.coalesce("val", F.lit(0.0)), "epoch") - F.max_by("train", "epoch")
    return _epochs(spark, sf).groupBy("run").agg(F.min("val").alias("best_val"), best.alias("best_epoch"), F.count("*").alias("n_epochs"), F.round(gap, 4).alias("gap"))


def stopped(epochs: Column, patience: int, least: float = 1e-6) -> Column:
    """(stopped, epochs, best, best_epoch) of a run, an array of (epoch, val) in order: an epoch counts as better only where it is below the
    last one that counted by more than ``least``, so many small gains add up to one; after ``patience`` epochs that don't
    count, the run ends."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("bad"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(s: Column, e: Column) -> Column:
        better = s["best"].isNull() | (e["val"] < s["best"] - least)
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        new = F.struct(F.when(better, e["val"]).otherwise(s["best"]).alias("best"), F.when(better, e["epoch"]).otherwise(s["at"]).alias("at"), bad.alias("bad"), (s["n"] + 1).alias("n"), (bad >= patience).alias("over"))
        return F.when(s["over"], s).otherwise(new)

    done = lambda s: F.struct(s["over"].alias("stopped"), s["n"].cast("long").alias("epochs"), s["best"].alias("best"), s["at"].alias("best_epoch"))
    return F.aggregate(epochs, start, step, done)


#: Every fifth run gains less than counts in an epoch, but more over many.
_SLOW = "(SELECT user_id AS run, event_id AS epoch, CASE WHEN event_id % 17 > 0 THEN CASE WHEN user_id % 5 = 0 THEN 50 - event_id * 1e-9::DOUBLE ELSE value END END AS val FROM events)"


@query(f"""WITH l AS (SELECT run, list({{'v': val, 'e': epoch::BIGINT, 'bad': 0, 'n': 0, 'over': false}} ORDER BY epoch) AS l FROM {_SLOW} WHERE val IS NOT NULL GROUP BY 1),
    r AS (SELECT run, list_reduce(list_concat([{{'v': 1e308::DOUBLE, 'e': NULL::BIGINT, 'bad': 0, 'n': 0, 'over': false}}], l), lambda s, x: CASE WHEN s.over THEN s WHEN x.v < s.v - 1e-6 THEN {{'v': x.v, 'e': x.e, 'bad': 0, 'n': s.n + 1, 'over': false}} ELSE {{'v': s.v, 'e': s.e, 'bad': s.bad + 1, 'n': s.n + 1, 'over': s.bad + 1 >= 8}} END) AS s FROM l)
    SELECT run, s.over AS stopped, s.n::BIGINT AS epochs, s.v AS best_val, s.e AS best_epoch FROM r""")
def early_stopping(spark, sf, patience: int = 8):
    """Where each run ends, and the best value and epoch that counted until then. A run's epochs are one row, as many as were trained."""
    val = F.when(F.col("epoch") % 17 > 0, F.when(F.col("run") % 5 == 0, 50 - F.col("epoch") * F.lit(1e-9)).otherwise(F.col("value")))
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").cast("long").alias("epoch"), "value").select("run", "epoch", val.alias("val")).filter("val IS NOT NULL")
    runs = e.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "val"))).alias("epochs"))
    s = stopped(F.col("epochs"), patience)
    return runs.select("run", s.alias("s")).select("run", "s.stopped", "s.epochs", F.col("s.best").alias("best_val"), "s.best_epoch")


@query("""WITH e AS (SELECT user_id AS worker, event_id, event_type IN ('error', 'signup') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT *, i - max(CASE WHEN NOT bad THEN i ELSE 0 END) OVER (PARTITION BY worker ORDER BY i ROWS UNBOUNDED PRECEDING) AS strikes FROM e)
    SELECT worker, count(*) AS seen, min(event_id) FILTER (strikes >= 4) AS broken_at, max(strikes) AS worst FROM s GROUP BY 1""")
def failure_breaker(spark, sf, strikes: int = 4):
    """Where a worker's results fail ``strikes`` times in a row, counted from its last success."""
    w = Window.partitionBy("worker").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").select(F.col("user_id").alias("worker"), "event_id", F.col("event_type").isin("error", "signup").alias("bad")).withColumn("i", F.count("*").over(w))
    e = e.withColumn("strikes", F.col("i") - F.max(F.when(~F.col("bad"), F.col("i")).otherwise(0)).over(w))
    return e.groupBy("worker").agg(F.count("*").alias("seen"), F.min(F.when(F.col("strikes") >= strikes, F.col("event_id"))).alias("broken_at"), F.max("strikes").alias("worst"))
