"""Equivalence of graph records: colours refined within a record, records joined on them, and equality proved within a key."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestone.operators.projections import compact, full_records
from lodestone.registry import query, table, written

#: Rounds of refinement that make a key. More tell more records apart before they are compared; the result is the same.
ROUNDS = 4


def colours(labels: Column, ends: Column) -> Column:
    """A colour for each node: its label and, round by round, the colours around it. ``ends``: s, t, w of each edge in one array."""
    size = F.size(ends)
    edges = F.transform(F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(3))).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.get(ends, k).alias("s"), F.get(ends, k + 1).alias("t"), F.get(ends, k + 2).alias("w")))
    none = F.array().cast("array<struct<w:int,n:int>>")

    def around(edges: Column, i: Column) -> Column:
        ways = lambda e: F.concat(F.when(e["s"] == i, F.array(F.struct(e["w"].alias("w"), e["t"].alias("n")))).otherwise(none), F.when(e["t"] == i, F.array(F.struct(e["w"].alias("w"), e["s"].alias("n")))).otherwise(none))
        return F.flatten(F.transform(edges, ways))

    adjacency = F.get(F.transform(F.array(edges), lambda e: F.transform(labels, lambda _, i: around(e, i))), F.lit(0))
    start = F.transform(labels, lambda x: F.xxhash64(x))
    seen = lambda c, a: F.array_sort(F.transform(a, lambda e: F.xxhash64(e["w"], F.get(c, e["n"]))))
    refined = lambda adj: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda c, _: F.transform(adj, lambda a, i: F.xxhash64(F.get(c, i), seen(c, a))))
    return F.get(F.transform(F.array(adjacency), refined), F.lit(0))


def isomorphic(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two small graphs (labels, ends) are the same but for the numbers of their nodes. Edges are undirected, and may repeat.

    Both are refined together until no colour splits; then nodes are matched one by one, rare colours first, and a choice
    is taken back where the edges to the nodes matched so far differ.
    """
    graphs = []
    for labels, ends in (a, b):
        links = [Counter() for _ in labels]
        for s, t, w in np.asarray(ends).reshape(-1, 3).tolist():
            links[s][t, w] += 1
            links[t][s, w] += 1
        graphs.append(links)
    if len(a[0]) != len(b[0]):
        return False
    colour = [list(a[0]), list(b[0])]
    for _ in range(len(a[0]) + 1):
        seen = [[(c[i], tuple(sorted(Counter((w, c[j]) for (j, w), k in x.items() for _ in range(k)).items()))) for i, x in enumerate(g)] for c, g in zip(colour, graphs, strict=True)]
        if sorted(seen[0]) != sorted(seen[1]):
            return False
        number = {x: k for k, x in enumerate(sorted(set(seen[0])))}
        new = [[number[x] for x in s] for s in seen]
        if len(number) == len(set(colour[0])):
            break
        colour = new
    else:
        new = colour
    rare, (ga, gb) = Counter(new[0]), graphs
    order = sorted(range(len(ga)), key=lambda i: (rare[new[0][i]], new[0][i]))
    to, used = {}, set()

    def fits(i: int, j: int) -> bool:
        ours = {(to[k], w): n for (k, w), n in ga[i].items() if k in to}
        theirs = {(k, w): n for (k, w), n in gb[j].items() if k in used}
        loops = [{w: n for (k, w), n in g[x].items() if k == x} for g, x in ((ga, i), (gb, j))]
        return ours == theirs and loops[0] == loops[1]

    choices = [iter([j for j in range(len(gb)) if new[1][j] == new[0][i]]) for i in order[:1]]
    while choices:
        i = order[len(choices) - 1]
        if i in to:
            used.discard(to.pop(i))
        j = next((j for j in choices[-1] if j not in used and fits(i, j)), None)
        if j is None:
            choices.pop()
            continue
        to[i] = j
        used.add(j)
        if len(to) == len(order):
            return True
        after = order[len(choices)]
        choices.append(iter([j for j in range(len(gb)) if new[1][j] == new[0][after]]))
    return not order


@F.pandas_udf(BooleanType())
def _same(la: pd.Series, ea: pd.Series, lb: pd.Series, eb: pd.Series) -> pd.Series:
    return pd.Series([isomorphic((a, b), (c, d)) for a, b, c, d in zip(la, ea, lb, eb, strict=True)], dtype="bool")


def equivalence(graphs: DataFrame) -> DataFrame:
    """(id, class_id): for each graph (id, labels array<int>, ends array<int>) the smallest id of one that is the same but for node numbers.

    Equal graphs are one row before anything is compared. A key is the sorted colours, so graphs with different keys
    differ; within a key each graph is compared with the smallest only, and those that differ from it form the next
    round, so no key is compared pair by pair. Colours alone can't tell some regular graphs apart (two triangles and one
    ring of six); the comparison does. A null graph has no class; an empty one is like any other empty one.
    """
    three = F.transform(F.when(F.size("ends") > 0, F.sequence(F.lit(0), F.size("ends") - 1, F.lit(3))).otherwise(F.array().cast("array<int>")), lambda k: F.array(F.least(F.get("ends", k), F.get("ends", k + 1)), F.greatest(F.get("ends", k), F.get("ends", k + 1)), F.get("ends", k + 2)))
    rows = written(graphs.filter(F.col("labels").isNotNull() & F.col("ends").isNotNull()).select("id", "labels", F.flatten(F.array_sort(three)).alias("ends")))
    each = rows.groupBy("labels", "ends").agg(F.min("id").alias("first"))
    left = written(each.withColumn("key", F.array_sort(colours(F.col("labels"), F.col("ends")))))
    found: DataFrame | None = None
    while not left.isEmpty():
        best = left.groupBy("key").agg(F.min(F.struct("first", "labels", "ends")).alias("best"))
        same = F.when(F.col("first") == F.col("best.first"), True).otherwise(_same("labels", "ends", "best.labels", "best.ends"))
        judged = written(left.join(best, "key").withColumn("same", same).select("key", "labels", "ends", "first", "same", F.col("best.first").alias("class_id")))
        mine = judged.filter("same").select("labels", "ends", "class_id")
        found = mine if found is None else found.unionByName(mine)
        left = judged.filter("NOT same").select("labels", "ends", "first", "key")
    if found is None:
        return rows.select("id", F.col("id").alias("class_id"))
    return rows.join(found, ["labels", "ends"]).select("id", "class_id")


def framework(records: DataFrame) -> DataFrame:
    """(id, labels, ends) of what is left of a compact record without its anions, every other node alike and every bond alike."""
    kept = F.filter(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.get("nodes", i)["ion_role"] >= 0)
    place = lambda of, i: (F.array_position(of, i) - 1).cast("int")
    both = F.filter("edges", lambda e: F.array_contains("kept", e["source"]) & F.array_contains("kept", e["target"]))
    ends = F.flatten(F.transform(both, lambda e: F.array(place(F.col("kept"), e["source"]), place(F.col("kept"), e["target"]), F.lit(0))))
    return records.withColumn("kept", kept).select("id", F.transform("kept", lambda _: F.lit(1)).alias("labels"), ends.alias("ends"))


#: Without its anions a ring of sites is one ring, or paths whose lengths say all.
_RINGS = """(WITH x AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS k, l_returnflag = 'A' AS gone FROM lineitem),
    g AS (SELECT id, i, k, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i), first_value(i) OVER (PARTITION BY id ORDER BY i) + k) - i - 1 AS run FROM x WHERE gone)
    SELECT a.id, coalesce('paths ' || string_agg(run, ' ' ORDER BY run) FILTER (run > 0), CASE WHEN any_value(g.id) IS NULL THEN 'ring ' || any_value(a.k) ELSE 'none' END) AS shape FROM (SELECT DISTINCT id, k FROM x) a LEFT JOIN g USING (id) GROUP BY a.id)"""


@query(f"""WITH s AS (SELECT id, shape, min(id) OVER (PARTITION BY shape) AS class_id FROM {_RINGS}), h AS (SELECT id, class_id, o_orderstatus = 'P' AS held, max((o_orderstatus = 'P' AND id % 3 = 0)::INT) OVER (PARTITION BY class_id) = 1 AS protected FROM s JOIN orders ON o_orderkey = id)
    SELECT id, class_id, CASE WHEN held AND protected THEN 'holdout' WHEN protected THEN 'exclude' WHEN held THEN 'dropped' ELSE 'train' END AS outcome FROM h""")
def join_structure_equivalence(spark, sf):
    """Classes of records with the same framework, and what a holdout of protected frameworks does with each record.

    Held rows with a protected framework stay held and other rows with one are excluded; held rows without one are dropped
    from the holdout. Distances and cell volumes aren't there to be compared.
    """
    same = written(equivalence(framework(compact(full_records(spark, sf)))))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("held"))
    j = same.join(o, "id")
    guarded = j.filter("held AND id % 3 = 0").select("class_id").distinct().withColumn("protected", F.lit(True))
    known = F.coalesce("protected", F.lit(False))
    outcome = F.when(F.col("held") & known, "holdout").when(known, "exclude").when(F.col("held"), "dropped").otherwise("train")
    return j.join(guarded, "class_id", "left").select("id", "class_id", outcome.alias("outcome"))
