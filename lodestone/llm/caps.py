"""Embedding near-duplicates by spherical caps.

The directions of the caps come from several random product codes. In each the dimensions, turned by a random rotation
of its own, are cut into blocks, each block has a few random code words, and every combination of code words is a
direction. A vector is listed under each direction whose inner product with it exceeds a threshold, in each code under
its best one at least; the list is decoded block by block, keeping only beginnings that can still exceed it. Vectors
that share a direction meet and are verified by their cosine. A pair that shares several directions counts in the first
one only.

The directions of one code share code words, so a vector lies in many of its caps or in few; over codes with rotations
of their own that evens out. Directions and threshold follow the number of vectors: a cap holds about ``CAP_ROWS`` random
vectors, a vector lies in about ``LISTS`` caps of a code. The codes are as many as it takes until, of ``PAIRS`` random
pairs at the least cosine, a share of ``MISS`` at most shares no cap; as the rotations are random, that rate is the
same for pairs of any data. Caps with more than ``BLOCK_ROWS`` vectors are compared block against block, in tasks of
their own: links are counted, so all pairs of such a cap are looked at, but a vector that travels meets thousands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import connected_components, cut, forest, slim_batches, sorted_groups
from lodestone.llm.vectors import classes, matrix, usable

CAP_ROWS, LISTS, BLOCK_ROWS = 64, 2, 4096
#: Random pairs on which the miss rate is measured, the largest rate allowed, and the codes beyond which it is an error.
PAIRS, MISS, MOST_CODES = 4000, 0.005, 1024
#: The largest share of random vectors that a cap holds, for small tables; and the largest threshold of a cap, as a part
#: of the least cosine: in few dimensions a cap that is to hold a pair holds more than ``CAP_ROWS`` vectors.
_WIDEST, _STEEPEST = 0.02, 0.8


@lru_cache(maxsize=64)
def _cap(dimension: int, share: float, highest: float) -> tuple[float, float]:
    """(threshold, share) of the cap that holds ``share`` of random vectors, or of the one at ``highest`` if that is larger."""
    angle = np.linspace(0, np.pi, 200_001)
    held = np.cumsum(np.sin(angle) ** (dimension - 2 if dimension > 1 else 0))
    held /= held[-1]
    at = max(int(np.searchsorted(held, share)), int(np.searchsorted(angle, np.arccos(highest))))
    return float(np.cos(angle[at])), float(held[at])


class ProductCode:
    """Cap directions for one dimension; the same seed and number give the same directions on every executor."""

    def __init__(self, dimension: int, vectors: int, least: float, lists: float, cap_rows: int, seed: int, number: int) -> None:
        self.threshold, share = _cap(dimension, min(_WIDEST, cap_rows / max(vectors, 1)), _STEEPEST * least)
        directions = lists / share
        blocks = min(max(dimension // 4, 1), 2 if directions <= 250_000 else 3 if directions <= 5e7 else 4)
        self.words = int(np.ceil(directions ** (1 / blocks)))
        self.directions = self.words**blocks
        rng = np.random.default_rng([seed, dimension, number])
        turn = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
        self.blocks = []
        for at in np.array_split(np.arange(dimension), blocks):
            code = rng.standard_normal((self.words, len(at)))
            self.blocks.append(turn[:, at] @ (code / np.linalg.norm(code, axis=1, keepdims=True) * np.sqrt(len(at) / dimension)).T)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of the directions that each unit vector exceeds, by row; its best one where it exceeds none."""
        scores = [unit @ code for code in self.blocks]
        best = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]  # from block k on
        threshold = np.minimum(self.threshold, best[0] - 1e-12)
        row, number, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, s in enumerate(scores):
            rest = best[k + 1] if k + 1 < len(scores) else np.zeros(len(unit))
            sums = total[:, None] + s[row]
            i, j = np.nonzero(sums >= (threshold - rest)[row][:, None])
            row, number, total = row[i], number[i] * self.words + j, sums[i, j]
        return row, number


@lru_cache(maxsize=64)
def code_count(dimension: int, vectors: int, least: float, lists: float, cap_rows: int, seed: int) -> int:
    """Codes until of random pairs at a cosine of ``least`` no more than ``MISS`` share no cap, by trial."""
    if dimension == 1 or vectors < 2:
        return 1
    rng = np.random.default_rng([seed, dimension])
    x, y = rng.standard_normal((2, PAIRS, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = least * x + np.sqrt(1 - least**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for number in range(MOST_CODES):
        code = ProductCode(dimension, vectors, least, lists, cap_rows, seed, number)
        met = []
        for at in range(0, len(x), 64):
            (i, a), (j, b) = code.decode(x[at : at + 64]), code.decode(y[at : at + 64])
            met.append(at + np.intersect1d(i * code.directions + a, j * code.directions + b) // code.directions)
        apart = np.setdiff1d(np.arange(len(x)), np.concatenate(met))
        x, y = x[apart], y[apart]
        if len(x) <= MISS * PAIRS:
            return number + 1
    raise ValueError(f"{MOST_CODES} codes miss {len(x)} of {PAIRS} pairs at a cosine of {least} in {dimension} dimensions")


def _caps(codes: list[ProductCode], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cap) over all codes, sorted by row and cap."""
    found = [(row, number + k * code.directions) for k, code in enumerate(codes) for row, number in [code.decode(unit)]]
    row, cap = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((cap, row))
    return row[order], cap[order]


def _decoder(sizes: dict[int, tuple[int, int]], least: float, lists: float, cap_rows: int, seed: int):
    """For the column of vectors: (dimension, their rows, row, cap) in parts of bounded size."""
    codes: dict[int, list[ProductCode]] = {}

    def run(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for rows, x in matrix(column):
            d = x.shape[1]
            if d not in codes:
                codes[d] = [ProductCode(d, sizes[d][0], least, lists, cap_rows, seed, k) for k in range(sizes[d][1])]
            x = normal(x)
            for at in range(0, len(rows), 64):
                yield d, rows[at : at + 64], *_caps(codes[d], x[at : at + 64])

    return run


def normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _counts(each: DataFrame, *setting) -> DataFrame:
    """(dim, cap, rows): how many classes lie in each cap; a batch's caps are counted before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(*setting)
        for b in batches:
            caps: dict[int, list[np.ndarray]] = {}
            for d, _, _, cap in decode(b.column(0)):
                caps.setdefault(d, []).append(cap)
            for d, found in caps.items():
                cap, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cap), d, np.int32)), pa.array(cap), pa.array(n)], ["dim", "cap", "rows"])

    return each.select("vector").mapInArrow(run, "dim int, cap long, rows long").groupBy("dim", "cap").agg(F.sum("rows").alias("rows"))


def _postings(each: DataFrame, *setting) -> DataFrame:
    """(dim, cap, cls, n, before array<long>, vector): a row for each cap that a class lies in, with its smaller caps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(*setting)
        for b in batches:
            for d, part, row, cap in decode(b.column(2)):
                first = np.searchsorted(row, row)
                ahead = np.arange(len(row)) - first
                ends = np.cumsum(ahead)
                flat = cap[np.repeat(first - (ends - ahead), ahead) + np.arange(ends[-1])]
                before = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), flat)
                own = pa.array(part[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(cap), b.column(0).take(own), b.column(1).take(own), before, b.column(2).take(own)], ["dim", "cap", "cls", "n", "before", "vector"])

    return each.select("cls", "n", "vector").mapInArrow(run, f"dim int, cap long, cls long, n long, before array<long>, vector {dict(each.dtypes)['vector']}")


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` shares a number with the same row of ``b`` (-1 and -2 fill up)."""
    out = np.zeros(len(a), bool)
    for k in range(a.shape[1]):
        out |= (a[:, k][:, None] == b).any(axis=1)
    return out


def _verify(least: float):
    """For partitions sorted by (dim, cap, p, q): rows (kind, a, b): 0: a has b more links; 1: a and b are connected."""

    def group(p: int, q: int, cls: np.ndarray, n: np.ndarray, block: np.ndarray, x: np.ndarray, size: np.ndarray, flat: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        a_all, b_all = [], []
        links, width, at = np.zeros(len(cls), np.int64), int(size.max()), np.cumsum(size) - size
        for lo in range(0, len(cls), 256):
            near = x[lo : lo + 256] @ x.T >= least
            i, j = np.nonzero(near)
            i += lo
            ahead = i < j if p == q else (block[i] == p) & (block[j] == q)
            i, j = i[ahead], j[ahead]
            for s in range(0, len(i), 50_000):
                u, v = i[s : s + 50_000], j[s : s + 50_000]
                if width:
                    left, right = np.full((len(u), width), -1, np.int64), np.full((len(v), width), -2, np.int64)
                    for out, of in ((left, u), (right, v)):
                        held = np.arange(width) < size[of][:, None]
                        out[held] = flat[(at[of][:, None] + np.arange(width))[held]]
                    first = ~_share(left, right)  # no smaller cap in common
                    u, v = u[first], v[first]
                np.add.at(links, u, n[v]), np.add.at(links, v, n[u])
                a_all.append(u), b_all.append(v)
        some = np.flatnonzero(links)
        if len(some):
            root = forest(len(cls), np.concatenate(a_all), np.concatenate(b_all))
            tied = np.flatnonzero(root != np.arange(len(cls)))
            yield np.zeros(len(some), np.int32), cls[some], links[some]
            yield np.ones(len(tied), np.int32), cls[tied], cls[root[tied]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in sorted_groups(batches, ["dim", "cap", "p", "q"]):
            table = table.combine_chunks()
            p, q, dim, cls, n, block = (table.column(c).to_numpy() for c in ("p", "q", "dim", "cls", "n", "block"))
            before = table.column("before").combine_chunks()
            offsets, flat = before.offsets.to_numpy(), before.values.to_numpy()
            vector = table.column("vector").combine_chunks()
            start, values = vector.offsets.to_numpy(), vector.values.to_numpy()
            found = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo > 1:
                    x = normal(values[start[lo] : start[hi]].astype(np.float64).reshape(hi - lo, dim[lo]))
                    found += group(p[lo], q[lo], cls[lo:hi], n[lo:hi], block[lo:hi], x, np.diff(offsets[lo : hi + 1]), flat[offsets[lo] : offsets[hi]])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["kind", "a", "b"])

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, lists: float = LISTS, cap_rows: int = CAP_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """(``id_col``, n_links, component_id, kept) for each row: links are other vectors with a cosine of ``least`` or more.

    Found pairs are all verified; a pair at the threshold shares no cap with a probability of ``MISS``, as measured for the
    vectors' number and length, a closer one with less. Equal vectors are one class and their links are counted, not written. Vectors that are null, empty, zero
    or hold null or non-finite components have no links and are their own component, as have rows with a null id (whose
    component is null and which aren't kept). Vectors of different lengths never link. Repeated ids are separate
    vectors. An empty table gives an empty result; further columns aren't read.
    """
    slim_batches(rows.sparkSession)
    each, members = classes(rows, id_col, vector_col)
    counts = {r["d"]: r["n"] for r in each.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    setting = {d: (n, code_count(d, n, least, lists, cap_rows, seed)) for d, n in counts.items()}, least, lists, cap_rows, seed
    large = cut(_counts(each, *setting).filter(F.col("rows") > block_rows))
    split = _postings(each, *setting).join(large.select("dim", "cap", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")), ["dim", "cap"], "left")
    split = split.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(seed)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("p"), F.greatest(o, F.col("block")).alias("q")))
    dealt = split.withColumn("pair", F.explode(pairs)).select("dim", "cap", "pair.p", "pair.q", "block", "cls", "n", "before", "vector")
    keys = ["dim", "cap", "p", "q"]
    found = cut(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(least), "kind int, a long, b long"))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("links"))
    roots = connected_components(found.filter("kind = 1"))
    named = each.select("cls", "first", "n").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").join(links, "cls", "left")
    named = cut(named.select("cls", "first", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    table = cut(named.join(lowest, "root").select("cls", "n_links", "component_id"))
    own = members.join(table, "cls").select(F.col("id").alias(id_col), "n_links", "component_id")
    rest = rows.filter(~usable(F.col(vector_col)) | F.col(id_col).isNull()).select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def brute_force(vectors: dict[int, list[float] | None], least: float = 0.9) -> dict[int, tuple[int, int]]:
    """(n_links, component) by id, from all pairs; for tests."""
    ok = {k: np.array(v, np.float64) for k, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    out = {k: [0, k] for k in vectors}
    for i in ids:
        for j in ids:
            if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= least:
                out[i][0] += 1
                low = min(out[i][1], out[j][1])
                old = {out[i][1], out[j][1]}
                for v in out.values():
                    if v[1] in old:
                        v[1] = low
    return {k: tuple(v) for k, v in out.items()}
