"""Centroid clustering of integer vectors with exact assignments.

Components are scaled and floored to integers. A round screens with one float32 matrix product for a lot of rows: each
product has an interval that holds the exact value, whatever the order of the additions, and the centroids whose interval
reaches below the smallest upper end are the shortlist. Where more than one is left, their distances are computed again
with integers, and the smallest number wins a tie. Tasks return sums for each centroid, so a round is one narrow pass
and an aggregate of k x dimension rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, id_type

#: Components of vectors below this magnitude, and those of centroids below twice it, are handled as 64-bit integers.
SMALL = 1 << 26
#: Sums travel as limbs of so many bits.
LIMB = 60
#: Components of the rows that are handled at once.
_LOT = 1_000_000


def integers(values: list[float], scale: int) -> list[int]:
    """floor(scale * x) of each component, exactly."""
    return [math.floor(Fraction(x) * scale) for x in values]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest row of ``centroids`` for each row of ``x``, the squared distance, and how many rows the screening left open.

    Both are 64-bit integers of small magnitude (``SMALL``). With u = 2^-24, a float32 product of d components is within
    g |x| |c| of the exact one, g = (d + 2) u / (1 - (d + 2) u), for any order of additions; the two more are the
    roundings of the integers to float32.
    """
    m = (x.shape[1] + 2) * 2.0**-24
    dot = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = np.einsum("ij,ij->i", centroids, centroids).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)))
    error = 2.001 * (m / (1 - m)) * norm[:, None] * np.sqrt(squares) + 2.0**-50 * (squares + 2 * np.abs(dot))
    middle = squares - 2 * dot
    short = middle - error <= (middle + error).min(axis=1)[:, None]
    best = short.argmax(axis=1)
    still = np.flatnonzero(short.sum(axis=1) > 1)
    if len(still):
        row, number = np.nonzero(short[still])
        exact = np.full((len(still), len(centroids)), np.iinfo(np.int64).max)
        step = max(1, _LOT // x.shape[1])
        for at in range(0, len(row), step):
            r, c = row[at : at + step], number[at : at + step]
            exact[r, c] = ((x[still[r]] - centroids[c]) ** 2).sum(axis=1)
        best[still] = exact.argmin(axis=1)  # the first of equal ones
    return best, ((x - centroids[best]) ** 2).sum(axis=1), len(still)


def nearest_large(values: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    """The nearest centroid and the squared distance, with integers of any size."""
    return min((sum((a - b) ** 2 for a, b in zip(values, c, strict=True)), k) for k, c in enumerate(centroids))[::-1]


class _Assigner:
    """Assigns lots of rows to centroids of any magnitude."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.all = centroids
        small = [max(map(abs, c), default=0) < 2 * SMALL for c in centroids]
        self.small = np.flatnonzero(small)
        self.matrix = np.array([centroids[k] for k in self.small], np.int64)
        self.large = np.array([[float(min(max(v, -(10**150)), 10**150)) for v in c] for c, ok in zip(centroids, small, strict=True) if not ok])

    def lot(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Numbers and squared distances of rows of small components."""
        if not len(self.small):
            found = [nearest_large(r, self.all) for r in x.tolist()]
            return np.array([k for k, _ in found], np.int64), [d for _, d in found]
        best, distance, _ = nearest(x, self.matrix)
        best, distance = self.small[best], distance.tolist()
        for c in self.large:  # a large centroid can only win where its rough distance isn't clearly greater
            rough = ((x - c) ** 2).sum(axis=1)
            for r in np.flatnonzero(rough * (1 - 1e-9) <= np.array(distance, np.float64)):
                best[r], distance[r] = nearest_large(x[r].tolist(), self.all)
        return best, distance


def _limbs(n: int) -> list[int]:
    out, sign = [], -1 if n < 0 else 1
    n = abs(n)
    while n:
        out.append(sign * (n & (1 << LIMB) - 1))
        n >>= LIMB
    return out


def _lots(batch: pa.RecordBatch, dim: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray | list[list[int]]]]:
    """(rows, their integers): a matrix for those of small components, lists for the others."""
    plain = batch.column("ints").is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(plain)
    flat = batch.column("ints").filter(pa.array(plain)).flatten().to_numpy().reshape(len(at), dim)
    step = max(1, _LOT // max(dim, 1))
    for k in range(0, len(at), step):
        yield at[k : k + step], flat[k : k + step].astype(np.int64)
    if len(at) < batch.num_rows:
        rest = np.flatnonzero(~plain)
        yield rest, [integers(batch.column("raw")[int(k)].as_py(), scale) for k in rest]


def kept(vector: Column, dim: int) -> Column:
    """Whether a vector has exactly ``dim`` components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dim) & finite, F.lit(False))


def _sums(rows: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> dict[tuple[int, int], int]:
    """The sum of each component (and, at component -1, the number of rows) of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, k = _Assigner(centroids), len(centroids)
        total, large = np.zeros((k, dim + 1), np.int64), {}
        for b in batches:
            for _, x in _lots(b, dim, scale):
                if isinstance(x, list):
                    for v in x:
                        c, _ = nearest_large(v, centroids)
                        total[c, dim] += 1
                        large[c] = [p + q for p, q in zip(large.get(c, [0] * dim), v, strict=True)]
                    continue
                number, _ = assign.lot(x)
                order = np.argsort(number, kind="stable")
                present, first, n = np.unique(number[order], return_index=True, return_counts=True)
                total[present, :dim] += np.add.reduceat(x[order], first, axis=0)
                total[present, dim] += n
        out = [(c, j if j < dim else -1, 0, int(v)) for c in range(k) for j, v in enumerate(total[c].tolist()) if v]
        out += [(c, j, i, v) for c, x in large.items() for j, n in enumerate(x) for i, v in enumerate(_limbs(n))]
        yield pa.RecordBatch.from_pylist([dict(zip(("cluster", "at", "limb", "value"), r, strict=True)) for r in out], pa.schema([("cluster", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))

    each = rows.select("ints", "raw").mapInArrow(run, "cluster int, at int, limb int, value long")
    found = each.groupBy("cluster", "at", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[tuple[int, int], int] = {}
    for r in found.collect():  # clusters x components, whatever the number of rows
        out[r["cluster"], r["at"]] = out.get((r["cluster"], r["at"]), 0) + (int(r["value"]) << LIMB * r["limb"])
    return out


def _assigned(rows: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> DataFrame:
    """(id, cluster, distance); a distance that doesn't fit a long is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _Assigner(centroids)
        for b in batches:
            for at, x in _lots(b, dim, scale):
                if isinstance(x, list):
                    number, distance = map(list, zip(*(nearest_large(v, centroids) for v in x), strict=True))
                else:
                    number, distance = assign.lot(x)
                fits = [d if d < 1 << 63 else None for d in distance]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(number, pa.int32()), pa.array(fits, pa.int64())], ["id", "cluster", "distance"])

    fields = [T.StructField("id", id_type(rows, "id")), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    return rows.mapInArrow(run, T.StructType(fields))


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``id_col``, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256) of each kept vector.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; the others, null ones too, give no row. A
    component x becomes floor(``scale`` * x), x as double (``scale`` is a power of two, so this is exact). The first
    centroids are the ``k`` kept vectors whose sha256 of ``seed:id`` is smallest (all, where there are fewer; a null id
    counts as empty, and of rows that repeat an id the smaller vector comes first). Each round assigns every vector to
    the nearest centroid, ties to the smaller number, and replaces each centroid that has vectors by floor(sum / count).
    Repeated rows count each; further columns aren't read; an empty table gives an empty result. Components of any finite
    size are exact; a distance or an inertia that doesn't fit a long is null.

    Centroids and sums on the driver are k x dim numbers. The integers are written once and read in every round.
    """
    if scale < 1 or scale & scale - 1:
        raise ValueError("scale must be a power of two")
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(1, min(10_000, _LOT // max(dim, 1)))))
    vector = F.col("vector")
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(kept(vector, dim))
    large = F.exists(vector, lambda x: F.abs(x) >= SMALL / scale - 1)
    ints = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    own = cut(own.select("id", F.when(~large, ints).alias("ints"), F.when(large, vector).alias("raw")))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    scaled = F.transform("raw", lambda x: F.when(F.abs(x) < 2.0**52 / scale, F.floor(x * F.lit(float(scale))).cast("double")).otherwise(x * F.lit(float(scale))))
    first = own.select("ints", "raw").orderBy(draw, F.coalesce(F.col("ints").cast("array<double>"), scaled)).limit(k).collect()
    centroids = [r["ints"] or integers(r["raw"] or [], scale) for r in first]
    if not centroids:
        fields = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, id_type(rows, id_col)), *T._parse_datatype_string(fields).fields]))
    for _ in range(rounds):
        sums = _sums(own, centroids, dim, scale)
        centroids = [[sums.get((c, j), 0) // n for j in range(dim)] if (n := sums.get((c, -1), 0)) else old for c, old in enumerate(centroids)]
    found = cut(_assigned(own, centroids, dim, scale))
    spent = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.bool_or(F.col("distance").isNull()).alias("over")).collect()  # k rows
    fits = lambda n: n if n is not None and n < 1 << 63 else None
    own_inertia = {r["cluster"]: None if r["over"] else int(r["s"]) for r in spent}
    total = None if None in own_inertia.values() else sum(own_inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, fits(own_inertia[c]), fits(total), digest[c]) for c in own_inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
