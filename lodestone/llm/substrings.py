"""Exact substring deduplication over windows of words, by super-k-mers.

A window is ``window`` consecutive words. Its minimiser is the smallest hash of ``seed_words`` consecutive words in it.
Consecutive windows with the same minimiser make a super-k-mer, a passage that travels as one to the minimiser's bucket.

Passages go first as a digest only. Equal passages are one entry with the smallest document id, so copies cost a row
each and never meet in a task. Passages that share a minimiser but differ travel as one packed string of each distinct
passage; in its bucket all windows are sorted, and runs of equal windows give the smallest document that has them.
A bucket with more than ``bucket_rows`` distinct passages is split into lots of about that size. Each lot is sorted in
the same way and sends its distinct windows' digests on, dealt by digest into as many parts as there are lots; a part
holds one row for each lot and compares the lots' smallest documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, id_type, slim_batches, text_batches

WINDOW, SEED_WORDS, BUCKET_ROWS = 50, 8, 256
_KEPT_WORDS = 500_000
_ODD = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], dtype=np.uint64)


class _Hashes:
    """64-bit hashes of words; words that were seen are looked up."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _KEPT_WORDS:
            self.known.clear()
        known = self.known
        for w in {*words}.difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def super_kmers(hashes: np.ndarray, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each super-k-mer of a text, given its words' hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = np.zeros(len(hashes) - seed_words + 1, np.uint64)
    for k in range(seed_words):
        seeds += hashes[k : k + len(seeds)] * _ODD[k]
    seeds ^= seeds >> np.uint64(29)
    seeds *= np.uint64(0xBF58476D1CE4E5B9)
    least, width = seeds, window - seed_words + 1  # the minimum over `width` seeds, by doubling
    size = 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return starts, np.diff(np.concatenate((starts, [n]))), least[starts]


def _bounds(words: list[bytes]) -> np.ndarray:
    """Where each word begins in the words joined by one space, and one past the end plus one."""
    return np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def passages(docs: DataFrame, id_col: str, text_col: str, window: int, seed_words: int) -> DataFrame:
    """(id, tid, start, n, key, sid): super-k-mers as digests; besides, a row with null key for each document with
    its number of words as ``n`` and, in ``kept``, the digest of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                yield one(b.slice(at, 64), cache)

    def one(b: pa.RecordBatch, cache: _Hashes) -> pa.RecordBatch:
        of, start, count, key, sid, kept = [], [], [], [], [], []
        for k, x in enumerate(b.column(2)):
            words = (x.as_py() or b"").split()
            flat = b" ".join(words)
            first, n, least = super_kmers(cache.of(words), window, seed_words)
            of.append(np.full(len(first) + 1, k)), start.append([-1, *first]), count.append([len(words), *n]), key.append([0, *least.view(np.int64).tolist()])
            digests = [0]
            if len(first):
                at = _bounds(words)
                for lo, hi in zip(at[first].tolist(), (at[first + n + window - 1] - 1).tolist(), strict=True):
                    digests.append(xxhash.xxh3_64_intdigest(flat[lo:hi]))
            sid.append(np.array(digests, np.uint64).view(np.int64))
            kept.extend([hashlib.sha256(flat).hexdigest(), *[None] * len(first)])
        of = np.concatenate(of)
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in (start, count, key, sid)]
        at = pa.array(of)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *columns, pa.array(kept, pa.string())], ["id", "tid", "start", "n", "key", "sid", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("tid"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("id", id_type(docs, id_col)), *(T.StructField(c, T.LongType()) for c in ("tid", "start", "n", "key", "sid")), T.StructField("kept", T.StringType())])
    return rows.mapInArrow(run, schema)


def _packed(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(key, sid, lot, lots, low, packed): the words of each wanted passage (id, tid, start, n, key, sid, lot, lots)."""
    fields = ["start", "n", "key", "sid", "lot", "lots"]
    lists = wanted.groupBy("id", "tid").agg(F.collect_list(F.struct(*fields)).alias("parts"))  # at most a document's passages
    texts = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("tid"), F.col(text_col).cast("binary").alias("text")).filter(F.col("id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words = b.column(1)[k].as_py().split()
                flat, at = b" ".join(words), _bounds(words)
                parts = b.column(2)[k].as_py()
                packed = [flat[at[p["start"]] : at[p["start"] + p["n"] + window - 1] - 1] for p in parts]
                columns = [pa.array([p[c] for p in parts], t) for c, t in (("key", pa.int64()), ("sid", pa.int64()), ("lot", pa.int32()), ("lots", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, b.column(0).take(pa.array([k] * len(parts))), pa.array(packed, pa.binary())], ["key", "sid", "lot", "lots", "low", "packed"])

    joined = texts.join(lists, ["id", "tid"]).select("id", "text", "parts")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("lot", T.IntegerType()), T.StructField("lots", T.IntegerType()), T.StructField("low", docs.schema[id_col].dataType), T.StructField("packed", T.BinaryType())])
    return joined.mapInArrow(run, schema)


def _windows(packed: bytes, window: int) -> list[bytes]:
    words = packed.split()
    at = _bounds(words).tolist()
    return [packed[at[k] : at[k + window] - 1] for k in range(len(words) - window + 1)]


def _sort_lots(window: int):
    """For partitions sorted by key and lot: rows (key, part, digests, lows, sids, ws).

    Part -1: windows ``ws`` of passage ``sids[0]``, each of which a smaller document of the lot has. Other parts, where
    the key has further lots: the digests of the lot's distinct windows, dealt by digest, with their smallest document
    and the passages and windows where that has them.
    """

    def lot(rows: list[tuple]) -> Iterator[tuple]:
        key, lots = rows[0][0], rows[0][2]
        found = sorted((x, low, sid, w) for _, _, _, sid, low, packed in rows for w, x in enumerate(_windows(packed, window)))
        later: dict[int, list[int]] = {}
        parts: dict[int, list[tuple]] = {}
        least, before, digest = None, None, b""
        for x, low, sid, w in found:
            if x != before:
                least, before = low, x
                digest = xxhash.xxh3_128_digest(x) if lots > 1 else b""
            if low > least:
                later.setdefault(sid, []).append(w)
            elif lots > 1:
                parts.setdefault(int.from_bytes(digest[:4], "big") % lots, []).append((digest, low, sid, w))
        for sid, ws in later.items():
            yield key, -1, [], [], [sid], ws
        for part, entries in parts.items():
            yield key, part, *map(list, zip(*entries, strict=True))

    def out(rows: list[tuple], low_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*lot(rows), strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(low_type), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "part", "digests", "lows", "sids", "ws"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[0][:2] != row[:2]:
                    yield out(rows, b.column(4).type)
                    rows = []
                rows.append(row)
        if rows:
            yield out(rows, b.column(4).type)

    return run


def _resolve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For partitions sorted by key and part: (key, sid, windows) of windows that a smaller document of another lot has."""
    at, entries = None, []

    def out() -> pa.RecordBatch:
        least: dict[bytes, object] = {}
        for digest, low, _, _ in entries:
            if digest not in least or low < least[digest]:
                least[digest] = low
        later: dict[int, list[int]] = {}
        for digest, low, sid, w in entries:
            if low > least[digest]:
                later.setdefault(sid, []).append(w)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(later), pa.int64()), pa.array(list(later), pa.int64()), pa.array(list(later.values()), pa.list_(pa.int64()))], ["key", "sid", "windows"])

    for b in batches:
        for key, part, *lists in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != (key, part):
                if entries:
                    yield out()
                at, entries = (key, part), []
            entries.extend(zip(*lists, strict=True))
    if entries:
        yield out()


def _shared_windows(packed: DataFrame, window: int) -> DataFrame:
    """(key, sid, windows): the windows of each passage that a document smaller than the passage's first one has."""
    low = packed.schema["low"].dataType.simpleString()
    dealt = packed.select("key", "lot", "lots", "sid", "low", "packed").repartition("key", "lot").sortWithinPartitions("key", "lot")
    found = cut(dealt.mapInArrow(_sort_lots(window), f"key long, part int, digests array<binary>, lows array<{low}>, sids array<long>, ws array<long>"))
    parts = found.filter("part >= 0").repartition("key", "part").sortWithinPartitions("key", "part")
    across = parts.mapInArrow(_resolve_parts, "key long, sid long, windows array<long>")
    every = found.filter("part < 0").select("key", F.col("sids")[0].alias("sid"), F.col("ws").alias("windows")).unionByName(across)
    return every.groupBy("key", "sid").agg(F.array_distinct(F.flatten(F.collect_list("windows"))).alias("windows"))  # at most a passage's windows


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, tid, n, kept, runs array<start, end>): a row for each distinct (id, text) with the words that go, as runs.

    ``tid`` is the text's hash, ``n`` its words, ``kept`` the SHA-256 of all its words joined by a space.
    """
    text_batches(docs.sparkSession)
    found = cut(passages(docs, id_col, text_col, window, seed_words))
    spans = found.filter("start >= 0 AND id IS NOT NULL").drop("kept")
    one = spans.groupBy("key", "sid").agg(F.min(F.struct("id", "tid", "start", "n")).alias("first"), F.max("id").alias("last"))
    one = cut(one.select("key", "sid", F.col("first.id").alias("id"), F.col("first.tid").alias("tid"), F.col("first.start").alias("start"), F.col("first.n").alias("n"), "last"))
    shared = cut(one.groupBy("key").agg(F.count("*").alias("distinct")).filter("distinct > 1"))
    wanted = one.join(shared, "key").withColumn("lots", F.ceil(F.col("distinct") / bucket_rows).cast("int"))
    wanted = wanted.withColumn("lot", F.pmod(F.xxhash64("sid"), F.col("lots")).cast("int"))
    packed = cut(_packed(docs, wanted, id_col, text_col, window).distinct())
    slim_batches(docs.sparkSession)
    inner = cut(_shared_windows(packed, window))
    # a later document than the first loses the whole passage; the first one loses the windows that others have before it
    useful = cut(one.select("key", "sid", F.col("id").alias("low"), "last").join(inner, ["key", "sid"], "left").filter("last > low OR windows IS NOT NULL").drop("last"))
    hits = spans.join(useful, ["key", "sid"]).filter("id > low OR windows IS NOT NULL")
    run = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n") + window - 1).alias("end"))
    singles = F.transform("windows", lambda w: F.struct((F.col("start") + w).alias("start"), (F.col("start") + w + window).alias("end")))
    hits = hits.select("id", "tid", F.when(F.col("id") > F.col("low"), F.array(run)).otherwise(singles).alias("runs"))
    merged = hits.groupBy("id", "tid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"))  # at most a document's windows
    whole = found.filter("start < 0").select("id", "tid", "n", "kept").distinct()
    return whole.join(merged, (whole["id"].eqNullSafe(merged["id"])) & (whole["tid"] == merged["tid"]), "left").select(whole["id"], whole["tid"], "n", "kept", "runs")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS, bucket_rows: int = BUCKET_ROWS, keep: list[str] | None = None) -> DataFrame:
    """(``id_col``, ``keep`` columns, ``text_col`` with what is kept, n_words, n_removed, kept_sha256) for each row of ``docs``.

    A word goes where a window covers it whose words also start in a document with a smaller id; windows are judged on
    the input. The text stays as it is, white space included, where nothing goes; else it is the kept words joined by
    one space. Null text: no words, and null stays null. Rows with the same id are one document: none is smaller than
    the other. Rows without an id are left whole and don't count for others. Empty tables give an empty result.
    """
    keep = keep or []
    found = repeated_words(docs, id_col, text_col, window, seed_words, bucket_rows)
    text_batches(docs.sparkSession)
    plan = found.select(F.col("id").alias("f_id"), F.col("tid").alias("f_tid"), "n", "kept", "runs")
    rows = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("tid"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)])
    rows = rows.join(plan, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("tid") == F.col("f_tid"))).drop("tid", "f_id", "f_tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed, digests = [], [], []
            for text, n, digest, runs in zip(*(b.column(c) for c in ("text", "n", "kept", "runs")), strict=True):
                if not runs.is_valid:
                    texts.append(text.as_py()), removed.append(0), digests.append(digest.as_py())
                    continue
                words = text.as_py().encode().split()
                gone = np.zeros(n.as_py() + 1, np.int32)
                ends = runs.values
                np.add.at(gone, ends.field("start").to_numpy(), 1), np.add.at(gone, ends.field("end").to_numpy(), -1)
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                flat = b" ".join([words[k] for k in left.tolist()])
                texts.append(flat.decode()), removed.append(len(words) - len(left)), digests.append(hashlib.sha256(flat).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(f"k{k}") for k in range(len(keep))), pa.array(texts, pa.string()), b.column("n"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names)

    names = ["id", *(f"k{k}" for k in range(len(keep))), "text", "n_words", "n_removed", "kept_sha256"]
    kinds = [id_type(docs, id_col), *(docs.schema[c].dataType for c in keep), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    out = rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]))
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], F.col("text").alias(text_col), "n_words", "n_removed", "kept_sha256")


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """(n_words, n_removed, kept words) by id, comparing all windows; for tests. Ids must be distinct and not null."""
    first: dict[tuple, int] = {}
    cut_up = {i: (t or "").encode().split() for i, t in rows}
    for i, words in cut_up.items():
        for k in range(len(words) - window + 1):
            x = tuple(words[k : k + window])
            first[x] = min(first.get(x, i), i)
    out = {}
    for i, words in cut_up.items():
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return out
