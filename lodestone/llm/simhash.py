"""Near-duplicate documents by SimHash fingerprints.

Method: a byte-position inverted index with count filtering. Two 64-bit fingerprints that differ in at most four bits
share at least four of their eight positional bytes. The index lists each fingerprint under triples of positional
bytes; the 20 triples are chosen so that any four positions contain one of them whole, so every pair that shares four
positional bytes meets in a posting list. There the bytes that a pair shares are tallied, pairs that reach four are
kept, and the kept pairs are verified on all 64 bits.

Equal fingerprints are one entry of the index. A posting list writes a spanning forest of its links, never all pairs.
Lists that are too long for one task aren't put together: their members are dealt one by one to values near them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import connected_components, cut, forest, id_type, slim_batches, sorted_groups, text_batches

#: Positions 0-7 in three classes; a triple lies in one class or has two positions in a class and one in the next.
_CLASSES = ((0, 1, 2), (3, 4, 5), (6, 7))
#: Differing bits up to which fingerprints link, and the positional bytes that such a pair shares at least.
MAX_BITS, LEAST_BYTES = 4, 4
#: Posting lists up to this length meet in one task; the members of longer ones go through midpoints.
LIST_ROWS = 8192
#: Posting lists up to this length are compared by shifted columns, many lists at once.
_SHORT = 16


def byte_triples() -> list[tuple[int, int, int]]:
    from itertools import combinations

    out = [t for c in _CLASSES for t in combinations(c, 3)]
    for k, c in enumerate(_CLASSES):
        out += [tuple(sorted((*pair, x))) for pair in combinations(c, 2) for x in _CLASSES[(k + 1) % 3]]
    return sorted(out)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text in UTF-8; zero for a text without words."""
    words = (text or b"").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(flat, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(``id_col``, ``fp`` long: the fingerprint's 64 bits). One row for each row of ``docs``; a null text has fingerprint zero."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(run, T.StructType([T.StructField("id", id_type(docs, id_col)), T.StructField("fp", T.LongType())]))
    return out.withColumnRenamed("id", id_col)


def _linked(x: np.ndarray) -> np.ndarray:
    """Whether fingerprints whose XOR is ``x`` link: tally the positional bytes that are equal, then verify the bits."""
    tally = np.zeros(x.shape, dtype=np.uint8)
    for k in range(8):
        tally += ((x >> np.uint64(8 * k)) & np.uint64(255)) == 0
    kept = tally >= LEAST_BYTES
    kept[kept] = np.bitwise_count(x[kept]) <= MAX_BITS
    return kept


def list_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is connected within one posting list, block by block."""
    label, n, step = np.arange(len(fps)), len(fps), 256
    a, b = [], []
    for at in range(0, n, step):
        i, j = np.nonzero(_linked(fps[at : at + step, None] ^ fps[None, at:]))
        ahead = i < j
        i, j = i[ahead] + at, j[ahead] + at
        if len(i):
            new = forest(n, np.concatenate((np.arange(n), i)), np.concatenate((label, j)))
            label = new
    other = np.flatnonzero(label != np.arange(n))
    a, b = fps[label[other]], fps[other]
    return a, b


def midpoints(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with all values within two bits of it: fingerprints within four bits of each other share one."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate((np.zeros(1, np.uint64), bits, bits[i] | bits[j]))
    return (fps[:, None] ^ masks[None, :]).ravel(), np.repeat(fps, len(masks))


def find_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For partitions of (key, fp) sorted by key: (a, b), links that span what is connected in each list."""

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for table, bounds in sorted_groups(batches, ["key"]):
        keys, fps = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        sizes = np.diff(bounds)
        short = np.repeat(sizes, sizes) <= _SHORT
        for d in range(1, int(min(sizes.max(initial=1), _SHORT))):
            at = np.flatnonzero((keys[d:] == keys[:-d]) & short[d:])
            at = at[_linked(fps[at] ^ fps[at + d])]
            if len(at):
                yield rows(fps[at], fps[at + d])
        for k in np.flatnonzero(sizes > _SHORT):
            a, b = list_links(fps[bounds[k] : bounds[k + 1]])
            if len(a):
                yield rows(a, b)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(near, fp): each fingerprint with the values within two bits of it."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            near, fp = midpoints(b.column(0).to_numpy()[at : at + 64].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(fp.view(np.int64))], ["near", "fp"])


def links(fps: DataFrame, fp_col: str = "fp", list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b) longs: links between different fingerprints, enough of them to connect all that are within four bits.

    The members of posting lists longer than ``list_rows`` don't meet in a task: each is written once with all values
    within two bits of it, and members that share such a value link to the smallest of them. That is exact as well, as
    fingerprints within four bits share such a value. Null fingerprints have no links; an empty table gives none.
    """
    slim_batches(fps.sparkSession)
    fp = F.col("fp")
    byte = [F.shiftrightunsigned(fp, 8 * k).bitwiseAND(255) for k in range(8)]
    keys = [(F.lit(n << 24) + F.shiftleft(byte[i], 16) + F.shiftleft(byte[j], 8) + byte[k]).cast("long") for n, (i, j, k) in enumerate(byte_triples())]
    postings = fps.select(F.col(fp_col).alias("fp")).filter("fp IS NOT NULL").distinct().select(F.explode(F.array(*keys)).alias("key"), "fp")
    postings = cut(postings)
    long = cut(postings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > list_rows).select("key"))
    if long.isEmpty():
        short, members = postings, None
    else:
        # their number is bounded by the postings over ``list_rows``; a large one is joined by a shuffle of keys
        short = postings.join(long, "key", "left_anti")
        members = postings.join(long, "key", "left_semi").select("fp").distinct()
    found = cut(short.repartition("key").sortWithinPartitions("key").mapInArrow(find_links, "a long, b long"))
    if members is None:
        return found.distinct()
    shared = cut(members.mapInArrow(_spread, "near long, fp long"))
    hubs = shared.groupBy("near").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("near", "hub")
    through = shared.join(hubs, "near").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return found.unionByName(through).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_rows: int = LIST_ROWS) -> DataFrame:
    """(``id_col``, ``fp`` long, ``component_id``): the smallest id that links reach, the row's own included.

    Every row gets a row, repeated rows and ids too. Texts that are null, empty or without words have fingerprint zero
    and link like any other. A null id stays null and never becomes a component's id unless the component has no other.
    An empty table gives an empty result. Other columns of ``docs`` aren't read.
    """
    fps = cut(fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("id"), "fp"))
    each = fps.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(links(fps, "fp", list_rows))
    rooted = cut(each.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(smallest, "root").select("fp", "component")
    return fps.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", F.col("component").alias("component_id"))
