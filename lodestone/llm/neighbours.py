"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Trees are grown on a sample of stated size: a node's direction is the difference of two sample vectors, its threshold
the sample's median along it. Every vector is dealt to a leaf of each tree. A query descends all trees through one
priority queue: the subtree with the smallest crossed margin goes next, whichever tree it is in, until enough leaves
are gathered. There exact inner products rank the vectors.

How many leaves are enough is measured: for a stated number of queries the true neighbours are found by comparing them
with all rows, and the places of those neighbours' leaves in the queue tell how many leaves reach the wanted recall.

For inner products the trees see vectors with one more component that makes all norms equal; a query has zero there.

Neighbouring leaves are put together into cells of about ``CELL_ROWS`` vectors; a larger leaf is dealt over several
cells. A query travels once to each cell that holds leaves of its own. Cells that many queries visit are repeated for
lots of them. So a task holds one cell and a few queries at a time, whatever the data.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, slim_batches
from lodestone.llm.vectors import classes, matrix

TREES, LEAF_ROWS, SAMPLE_ROWS = 8, 256, 65_536
#: Components of the sampled vectors, so that long vectors don't fill the driver.
SAMPLE_NUMBERS = 8_388_608
#: The recall that the number of leaves is chosen for, and the queries on which it is measured.
RECALL, TRIALS = 0.93, 256
#: Vectors of a cell, and queries that visit one copy of it.
CELL_ROWS, LOT_QUERIES = 16_384, 65_536


class Tree:
    def __init__(self, x: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> None:
        self.direction: list[np.ndarray] = []
        self.threshold: list[float] = []
        self.child: list[list[int]] = []  # numbers of nodes, or -1 - leaf; leaves are numbered from left to right
        self.leaves = 0
        self.root = self._grow(x, np.arange(len(x)), leaf_rows, rng)
        self.directions, self.thresholds, self.children = (np.array(v) for v in (self.direction or [np.zeros(x.shape[1])], self.threshold or [0.0], self.child or [[-1, -1]]))

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        if len(at) > max(leaf_rows, 1):
            for _ in range(4):
                a, b = rng.choice(at, 2, replace=False)
                d = x[a] - x[b]
                length = np.linalg.norm(d)
                if length > 1e-9:
                    along = x[at] @ (d / length)
                    t = float(np.median(along))
                    right = along > t
                    if 0 < right.sum() < len(at):
                        k = len(self.child)
                        self.direction.append(d / length), self.threshold.append(t), self.child.append([0, 0])
                        self.child[k][0] = self._grow(x, at[~right], leaf_rows, rng)
                        self.child[k][1] = self._grow(x, at[right], leaf_rows, rng)
                        return k
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            right = np.einsum("ij,ij->i", x[inner], self.directions[at]) > self.thresholds[at]
            node[inner] = self.children[at, right.astype(int)]
        return -1 - node

    def crossed(self, q: np.ndarray) -> np.ndarray:
        """queries x leaves: the largest margin crossed on the way to each leaf, by which the queue is ordered."""
        margin = q @ self.directions.T - self.thresholds
        out, node = np.zeros((len(q), self.leaves)), np.zeros((len(q), len(self.directions)))
        for k in range(len(self.child)):  # parents come before their children
            for right in (0, 1):
                own = np.maximum(node[:, k], np.where((margin[:, k] > 0) == bool(right), 0.0, np.abs(margin[:, k])))
                c = int(self.children[k, right])
                (node if c >= 0 else out)[:, c if c >= 0 else -1 - c] = own
        return out


def search_leaves(trees: list[Tree], q: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue."""
    margins = [(t.directions @ q - t.thresholds).tolist() for t in trees]
    children = [t.child for t in trees]
    queue = [(0.0, k, t.root) for k, t in enumerate(trees)]
    out: list[tuple[int, int]] = []
    while queue and len(out) < leaves:
        crossed, k, node = heapq.heappop(queue)
        own, below = margins[k], children[k]
        while node >= 0:
            m = own[node]
            left, right = below[node]
            near, far = (right, left) if m > 0 else (left, right)
            heapq.heappush(queue, (max(crossed, abs(m)), k, far))
            node = near
        out.append((k, -1 - node))
    return out


def leaves_for(trees: list[Tree], q: np.ndarray, found: list[np.ndarray], recall: float) -> tuple[int, float]:
    """(leaves to visit, recall reached) so that the queries ``q`` meet that share of the vectors ``found`` (one array for each)."""
    crossed = [t.crossed(q) for t in trees]
    every = np.sort(np.concatenate(crossed, axis=1), axis=1)
    place = []
    for i, x in enumerate(found):
        margin = np.min([c[i, t.leaf_of(x)] for t, c in zip(trees, crossed, strict=True)], axis=0)
        place.append(np.searchsorted(every[i], margin, side="right"))  # of equal margins the last place
    place = np.sort(np.concatenate(place))
    if not len(place):
        return 1, 1.0
    leaves = max(int(place[min(int(np.ceil(recall * len(place))), len(place)) - 1]), 1)
    return leaves, float((place <= leaves).mean())


def grow_forest(sample: list[list[float]], rows: dict[int, int], largest: dict[int, float], trees: int, leaf_rows: int, seed: int) -> dict[int, list[Tree]]:
    """A forest for each dimension; leaves of the sample are smaller than ``leaf_rows`` by the sample's share of the rows."""
    out = {}
    for d, n in rows.items():
        x = np.array([v for v in sample if len(v) == d], np.float64).reshape(-1, d)
        x = x[np.lexsort(x.T[::-1])]
        x = lifted(x, largest[d])
        least = max(2, round(leaf_rows * len(x) / max(n, 1)))
        out[d] = [Tree(x, least, np.random.default_rng([seed, d, k])) for k in range(trees)]
    return out


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0.0))
    return np.concatenate((x, rest[:, None]), axis=1) / max(largest, 1e-300)


def as_query(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate((x, np.zeros((len(x), 1))), axis=1) / max(largest, 1e-300)


def _best(q: np.ndarray, cls: np.ndarray, first: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best classes of each query, each once; ties to the smaller first id. A pair has one score wherever it is met."""
    order = np.lexsort((cls, q))
    q, cls, first, score = q[order], cls[order], first[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (cls[1:] != cls[:-1])
    q, cls, first, score = q[new], cls[new], first[new], score[new]
    order = np.lexsort((first, -score, q))
    q, cls, first, score = q[order], cls[order], first[order], score[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate((start, [len(q)]))))
    return q[rank < k], cls[rank < k], first[rank < k], score[rank < k]


def ranked(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, inner product) of the ``k`` largest for each row of x, and of all within rounding of the last.

    A matrix product sums in an order that follows its shape, so what it selects is summed again in one fixed order.
    """
    score = x @ y.T
    if k < len(y):
        edge = np.partition(score, len(y) - k, axis=1)[:, len(y) - k]
        i, j = np.nonzero(score >= (edge - 1e-9 * (np.abs(edge) + np.abs(x).max(axis=1) * np.abs(y).max()))[:, None])
    else:
        i, j = (a.ravel() for a in np.indices(score.shape))
    return i, j, (x[i] * y[j]).sum(axis=1)


def _true_neighbours(each: DataFrame, trial: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(q, vector): the ``k`` nearest classes of each trial query among all rows, which are compared block by block."""
    shared = each.sparkSession.sparkContext.broadcast(trial)  # ``TRIALS`` vectors for each dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, first = b.column("cls").to_numpy(), b.column("first").to_numpy()
            for at, x in matrix(b.column("vector")):
                own, q = shared.value[x.shape[1]]
                i, j, score = ranked(q, x, min(k + 1, len(x)))
                best = _best(own[i], cls[at[j]], first[at[j]], score, k + 1)
                of = np.searchsorted(cls, best[1], sorter=(order := np.argsort(cls)))
                keep = best[0] != best[1]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (best[0], best[3], best[2])] + [b.column("vector").take(pa.array(order[of][keep]))], ["q", "score", "first", "vector"])

    kinds = dict(each.dtypes)
    near = each.select("cls", "first", "vector").mapInArrow(run, f"q long, score double, first {kinds['first']}, vector {kinds['vector']}")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    return near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("q", "vector")


def _cells(counts: dict[tuple[int, int, int], int], cell_rows: int) -> tuple[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], dict[int, int]]:
    """({(dim, tree): (first cell, cells) by leaf}, {cell: rows}): neighbouring leaves share a cell, a large leaf has several."""
    out: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    rows: dict[int, int] = {}
    cell = -1
    before, last = None, 0
    for (dim, tree, leaf), n in sorted(counts.items()):
        if (dim, tree) != before or rows[cell] + n > cell_rows:
            cell += 1
            rows[cell] = 0
        before = dim, tree
        lots = -(-n // cell_rows)
        first, many = out.setdefault(before, ([], []))
        first += [cell] * (leaf + 1 - len(first))
        many += [0] * (leaf - len(many)) + [lots]  # a leaf without vectors has no cell
        first[leaf] = cell
        for k in range(lots):
            rows[cell + k] = rows.get(cell + k, 0) + -(-n // lots)
        cell += lots - 1
        last = cell
    return {k: (np.array(a, np.int64), np.array(b, np.int64)) for k, (a, b) in out.items()}, {c: rows[c] for c in range(last + 1)} if counts else {}


def _rank(k: int, most: int = 400_000):
    """For partitions sorted by (cell, lot, asks, code): (q, cls, first, score), the best of each query in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held, at = 0, None
        parts: list[pa.RecordBatch] = []
        there: dict[int, tuple[np.ndarray, ...]] = {}

        def rows(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["q", "cls", "first", "score"])

        def dense(column: pa.Array) -> np.ndarray:
            return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)

        def open_cell() -> None:
            t = pa.Table.from_batches(parts).combine_chunks()
            code, cls, first = (t.column(c).to_numpy() for c in ("code", "cls", "first"))
            x = dense(t.column("vector").combine_chunks())
            edges = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                there[int(code[lo])] = x[lo:hi], cls[lo:hi], first[lo:hi]

        for batch in batches:
            cell, lot, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "lot", "asks"))
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (lot[1:] != lot[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)], strict=True):
                if lo == hi:
                    continue
                if at != (cell[lo], lot[lo]):
                    at, parts, there = (cell[lo], lot[lo]), [], {}
                own = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    parts.append(own)
                    continue
                if parts:
                    open_cell()
                    parts = []
                if not there:
                    continue
                lists = own.column("codes")
                wanted, q, x = lists.flatten().to_numpy(), own.column("cls").to_numpy(), dense(own.column("vector"))
                of = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
                order = np.argsort(wanted, kind="stable")
                wanted, of = wanted[order], of[order]
                turns = np.concatenate(([0], np.flatnonzero(wanted[1:] != wanted[:-1]) + 1, [len(wanted)]))
                for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
                    if int(wanted[a]) not in there:
                        continue  # another part of a leaf that is dealt over several cells
                    y, cls, first = there[int(wanted[a])]
                    for s in range(a, b, 256):
                        part = of[s : min(s + 256, b)]
                        i, j, score = ranked(x[part], y, min(k, len(y)))
                        kept.append((q[part[i]], cls[j], first[j], score))
                        held += len(i)
                        if held > most:
                            kept = [_best(*(np.concatenate(c) for c in zip(*kept, strict=True)), k)]
                            held = len(kept[0][0])
                            if held > most // 2:
                                yield rows(kept[0])
                                kept, held = [], 0
        if kept:
            yield rows(_best(*(np.concatenate(c) for c in zip(*kept, strict=True)), k))

    return run


def search(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, trials: int = TRIALS, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, lot_queries: int = LOT_QUERIES, seed: int = 11) -> DataFrame:
    """(query_id, rank from 1, ``id_col``, score, leaves, trial_recall): the ``k`` nearest found for each row whose id is divisible by ``every``.

    Nearness is the inner product in double precision, ties to the smaller id; a query's own id is no candidate. Fewer
    candidates than ``k``: all that were found. ``leaves`` is how many leaves each query visits, ``trial_recall`` the
    recall against brute force that this number gave for ``trials`` queries (``recall`` at least). Vectors that are null,
    empty, zero or hold null or non-finite components and rows with a null id take no part; vectors of different lengths
    don't meet. Equal vectors are indexed once and their smallest ids are listed, so nothing is listed twice. The forest
    is fitted on ``sample_rows`` vectors and ``SAMPLE_NUMBERS`` components at most; every vector is indexed. Repeated ids are candidates each; an empty
    table gives an empty result; further columns aren't read.
    """
    spark = rows.sparkSession
    slim_batches(spark)
    each, members = classes(rows, id_col, vector_col)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    stats = each.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("largest")).collect()  # a row for each dimension
    largest = {r["d"]: r["largest"] for r in stats}
    total = sum(r["n"] for r in stats)
    sample_rows = min(sample_rows, max(1, SAMPLE_NUMBERS // max(largest, default=1)))
    hashed = F.xxhash64("vector").bitwiseAND((1 << 62) - 1)
    some = each.filter(hashed < int((1 << 62) * min(1.0, sample_rows / max(total, 1)))) if total > sample_rows else each
    sample = [r["vector"] for r in some.select("vector").collect()]
    forest = grow_forest(sample, {r["d"]: r["n"] for r in stats}, largest, trees, leaf_rows, seed)

    kinds = dict(each.dtypes)
    queries = cut(members.filter(F.col("id") % every == 0))
    asking = cut(each.join(queries.select("cls").distinct(), "cls", "left_semi").select("cls", "vector"))
    leaves, reached = {d: 1 for d in forest}, {d: 1.0 for d in forest}
    first_by_hash = Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("vector", F.lit(seed)), "cls")
    tried = asking.withColumn("r", F.row_number().over(first_by_hash)).filter(F.col("r") <= trials).collect()  # ``trials`` rows for each dimension
    if tried:
        by_dim: dict[int, list] = {}
        for r in tried:
            by_dim.setdefault(len(r["vector"]), []).append(r)
        trial = {d: (np.array([r["cls"] for r in own]), np.array([r["vector"] for r in own], np.float64)) for d, own in by_dim.items()}
        comparable = each.filter(F.size("vector").isin(list(trial)))
        near: dict[int, list] = {}
        for r in _true_neighbours(comparable, trial, k).collect():  # ``k`` rows for each trial
            near.setdefault(r["q"], []).append(r["vector"])
        for d, (own, q) in trial.items():
            found = [lifted(np.array(near.get(c, []), np.float64).reshape(-1, d), largest[d]) for c in own.tolist()]
            leaves[d], reached[d] = leaves_for(forest[d], as_query(q, largest[d]), found, recall)
    shared = spark.sparkContext.broadcast((forest, largest, leaves))  # bounded by the sample

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_of, widest, _ = shared.value
        for b in batches:
            for _, x in matrix(b.column("vector")):
                up, d = lifted(x, widest[x.shape[1]]), x.shape[1]
                for t, tree in enumerate(trees_of[d]):
                    leaf, n = np.unique(tree.leaf_of(up), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), v, np.int32)) for v in (d, t)] + [pa.array(leaf.astype(np.int32)), pa.array(n)], ["dim", "tree", "leaf", "n"])

    located = each.select("vector").mapInArrow(locate, "dim int, tree int, leaf int, n long").groupBy("dim", "tree", "leaf").agg(F.sum("n").alias("n"))
    layout, _ = _cells({(r["dim"], r["tree"], r["leaf"]): r["n"] for r in located.collect()}, cell_rows)  # a row for each leaf, bounded by the sample
    plan = spark.sparkContext.broadcast(layout)
    names = ["cell", "cls", "first", "code", "codes", "vector"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_of, widest, _ = shared.value
        for b in batches:
            for at, x in matrix(b.column("vector")):
                d = x.shape[1]
                up, own = lifted(x, widest[d]), b.take(pa.array(at))
                spread = (own.column("cls").to_numpy() * 0x9E3779B1) >> 7
                for t, tree in enumerate(trees_of[d]):
                    leaf = tree.leaf_of(up)
                    first, lots = plan.value[d, t]
                    cell = first[leaf] + spread % lots[leaf]
                    code = pa.array((leaf * len(trees_of[d]) + t).astype(np.int32))
                    none = pa.nulls(len(at), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), own.column("cls"), own.column("first"), code, none, own.column("vector")], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_of, widest, most = shared.value
        for b in batches:
            for at, x in matrix(b.column("vector")):
                d = x.shape[1]
                up = as_query(x, widest[d])
                for i, row in enumerate(at.tolist()):
                    found = np.array(search_leaves(trees_of[d], up[i], most[d]), np.int64)
                    cells, codes = [], []
                    for t in np.unique(found[:, 0]).tolist():
                        first, lots = plan.value[d, t]
                        leaf = found[found[:, 0] == t, 1]
                        leaf = leaf[(leaf < len(lots))]
                        leaf = leaf[lots[leaf] > 0]
                        again = lots[leaf]
                        step = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                        cells.append(np.repeat(first[leaf], again) + step), codes.append(np.repeat(leaf * len(trees_of[d]) + t, again))
                    cell, code = np.concatenate(cells), np.concatenate(codes)
                    order = np.lexsort((code, cell))
                    cell, code = cell[order], code[order]
                    starts = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1))
                    n = len(starts)
                    lists = pa.ListArray.from_arrays(np.concatenate((starts, [len(code)])).astype(np.int32), code.astype(np.int32))
                    same = pa.array(np.full(n, row))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[starts]), b.column("cls").take(same), pa.nulls(n, b.schema.field("first").type), pa.nulls(n, pa.int32()), lists, b.column("vector").take(same)], names)

    shape = f"cell long, cls long, first {kinds['first']}, code int, codes array<int>, vector {kinds['vector']}"
    asked = asking.select("cls", F.lit(None).cast(kinds["first"]).alias("first"), "vector").mapInArrow(ask, shape)
    slim = cut(asked.select("cell", "cls", "codes"))
    busy = F.broadcast(slim.groupBy("cell").agg(F.ceil(F.count("*") / lot_queries).cast("int").alias("lots")))  # a row for each cell, bounded by the leaves and the rows of a cell
    questions = slim.join(asking, "cls").join(busy, "cell").select("cell", F.pmod(F.xxhash64("cls"), F.col("lots")).cast("int").alias("lot"), F.lit(True).alias("asks"), "cls", F.lit(None).cast(kinds["first"]).alias("first"), F.lit(None).cast("int").alias("code"), "codes", "vector")
    index = each.select("cls", "first", "vector").mapInArrow(deal, shape).join(busy, "cell").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    index = index.select("cell", "lot", F.lit(False).alias("asks"), "cls", "first", "code", "codes", "vector")
    dealt = index.unionByName(questions).repartition("cell", "lot").sortWithinPartitions("cell", "lot", "asks", "code")
    near = dealt.mapInArrow(_rank(k + 1), f"q long, cls long, first {kinds['first']}, score double").dropDuplicates(["q", "cls"])
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).filter(F.col("r") <= k + 1).select("cls", F.col("id").alias("found"))
    ids = near.select("q", "cls", "score").join(few, "cls")
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "found"))).filter(F.col("r") <= k + 1)
    told = F.create_map(*[F.lit(x) for d in forest for x in (d, leaves[d])]) if forest else F.lit(None).cast("map<int,int>")
    rates = F.create_map(*[F.lit(x) for d in forest for x in (d, reached[d])]) if forest else F.lit(None).cast("map<int,double>")
    dims = asking.select(F.col("cls").alias("q"), F.size("vector").alias("d"))
    ids = cut(ids.join(dims, "q").select(F.col("q").alias("cls"), "found", "score", told[F.col("d")].alias("leaves"), rates[F.col("d")].alias("trial_recall")))
    answers = queries.select(F.col("id").alias("query_id"), "cls").join(ids, "cls").filter("found <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "found"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(id_col), "score", "leaves", "trial_recall")
