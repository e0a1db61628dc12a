"""Packing into few sequences: best fit over the histogram of lengths, then a local search of swaps.

Only documents longer than a sequence are cut. The histogram of the pieces has as many rows as a sequence has tokens, and
bins that hold the same lengths are one pattern with a count, so packing takes the driver the same work for any corpus.
The search exchanges documents between underfull bins, one for one, two for one or one for two, or moves one, each time
for a greater sum of squared fills, so the emptiest bins drain until they are gone. Pieces find their bins by their rank
among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import specification
from lodestone.llm.common import cut, global_rank, id_type, slim_batches, text_batches
from lodestone.llm.wordbpe import worker_encoder

#: (length, how many) for each length in a bin, longest first.
Pattern = tuple[tuple[int, int], ...]
#: Differences that the search may look at before it stops where it is; the packing is whole wherever it stops.
SEARCH = 1_000_000_000


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """How many bins have each pattern when lengths are placed longest first, each into the fullest bin that has room."""
    done: Counter[Pattern] = Counter()
    bins: dict[int, list[tuple[int, Pattern]]] = {}  # by the room that is left
    rooms: list[int] = []

    def put(count: int, pattern: Pattern, room: int) -> None:
        if not count:
            return
        if not room:
            done[pattern] += count
            return
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                count, pattern, room = -(-left // (capacity // length)), (), capacity
            else:
                room = rooms[at]
                count, pattern = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            each = room // length
            used = min(count, left // each)
            put(used, (*pattern, (length, each)), room - each * length)
            left -= used * each
            if used < count and left:
                put(1, (*pattern, (length, left)), room - left * length)
                left, used = 0, used + 1
            if pattern:
                put(count - used, pattern, room)
    for room in rooms:
        for count, pattern in bins[room]:
            done[pattern] += count
    return dict(done)


def fill(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def _changed(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    held = Counter(dict(pattern))
    held.subtract(out)
    held.update(into)
    return tuple(sorted(((length, n) for length, n in held.items() if n), reverse=True))


def _pairs(pattern: Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum, first, second) of two documents of a bin."""
    lengths, n = (np.array(x, np.int64) for x in zip(*pattern, strict=True))
    i, j = np.triu_indices(len(lengths))
    ok = (i != j) | (n[i] > 1)
    i, j = i[ok], j[ok]
    return lengths[i] + lengths[j], lengths[i], lengths[j]


def exchange(a: Pattern, b: Pattern, capacity: int) -> tuple[tuple[tuple[int, ...], tuple[int, ...]] | None, int]:
    """What to take from ``a`` for what of ``b`` so that the sum of squared fills grows most, or none; and the differences looked at."""
    room, least = capacity - fill(b), max(0, fill(a) - fill(b))
    if room <= least:
        return None, 1
    ones_a, ones_b = (np.array([length for length, _ in x], np.int64) for x in (a, b))
    (two_a, *parts_a), (two_b, *parts_b) = _pairs(a), _pairs(b)
    best, found, looked = least, None, len(ones_a)
    gain = np.where(ones_a <= room, ones_a, -1)
    if (top := int(gain.max())) > best:
        best, found = top, ((top,), ())
    for kind, x, y in (("one", ones_a, ones_b), ("two", two_a, ones_b), ("for two", ones_a, two_b)):
        if best == room or not len(x) or not len(y):
            continue
        looked += len(x) * len(y)
        gain = x[:, None] - y[None, :]
        at = int(np.where(gain <= room, gain, -1).argmax())
        i, j = divmod(at, len(y))
        if best < gain[i, j] <= room:
            best = int(gain[i, j])
            take = (int(parts_a[0][i]), int(parts_a[1][i])) if kind == "two" else (int(x[i]),)
            give = (int(parts_b[0][j]), int(parts_b[1][j])) if kind == "for two" else (int(y[j]),)
            found = take, give
    return found, looked


def local_search(bins: dict[Pattern, int], capacity: int, search: int = SEARCH) -> dict[Pattern, int]:
    """``bins`` after exchanges between underfull bins, the emptiest first, until the fewest bins that any packing needs
    are reached or no exchange makes the sum of squared fills greater. An exchange is made in all bins of both patterns at
    once. After ``search`` differences the bins stay as they are then.
    """
    full = {p: n for p, n in bins.items() if fill(p) == capacity}
    open_ = {p: n for p, n in bins.items() if fill(p) < capacity}
    fewest = -(-sum(fill(p) * n for p, n in open_.items()) // capacity)
    looked, tried = 0, set()

    def add(pattern: Pattern, n: int) -> None:
        if pattern and n:
            to = full if fill(pattern) == capacity else open_
            to[pattern] = to.get(pattern, 0) + n

    while sum(open_.values()) + sum(full.values()) - sum(n for p, n in bins.items() if fill(p) == capacity) > fewest and looked < search:
        order = sorted(open_, key=lambda p: (fill(p), p))
        step = None
        for a in order:
            for b in reversed(order):
                if (a, b) in tried or a == b and open_[a] < 2:
                    continue
                found, cost = exchange(a, b, capacity)
                looked += cost
                if found:
                    step = a, b, *found
                    break
                tried.add((a, b))
                if looked >= search:
                    break
            if step or looked >= search:
                break
        if not step:
            break
        a, b, take, give = step
        n = open_[a] // 2 if a == b else min(open_[a], open_[b])
        for p in (a, b):
            open_[p] -= n
            if not open_[p]:
                del open_[p]
        add(_changed(a, take, give), n)
        add(_changed(b, give, take), n)
    for p, n in open_.items():
        full[p] = full.get(p, 0) + n
    return full


def places(bins: dict[Pattern, int]) -> np.ndarray:
    """Rows (length, first rank, how many in a bin, first sequence, offset), sorted: where the pieces of a length go by rank."""
    rank: Counter[int] = Counter()
    sequence, out = 0, []
    for pattern, count in sorted(bins.items(), reverse=True):
        offset = 0
        for length, each in pattern:
            out.append((length, rank[length], each, sequence, offset))
            rank[length] += count * each
            offset += length * each
        sequence += count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the ids of each text, ``end_id`` last, whole or cut into pieces of ``capacity``."""
    text_batches(docs.sparkSession)
    spec = specification(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(spec)
        for b in batches:
            of, rows = [], []
            for at in range(0, b.num_rows, 64):
                for k, own in enumerate(enc.encode(b.column(1).slice(at, 64).to_pylist()), at):
                    ids = np.append(own, end_id).astype("<u4")
                    for n, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        of.append(k), rows.append((n, s, len(part), zlib.crc32(part.tobytes())))
            n, start, length, crc = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(n.astype(np.int32)), *map(pa.array, (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    fields = [T.StructField("id", id_type(docs, id_col)), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, search: int = SEARCH) -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32, sequence_id, offset) of each piece.

    Documents of up to ``capacity`` ids, ``end_id`` included, are whole; longer ones are cut into pieces of that many, the
    last of which may be shorter. Null and empty texts are a document of ``end_id`` alone. Repeated rows are packed each,
    a null id stays null, further columns aren't read, and an empty table gives an empty result. The table of places has
    one row for each pattern and length; it follows the histogram, not the documents.
    """
    spark = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id))
    histogram = {r["length"]: r["count"] for r in cutted.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(local_search(best_fit(histogram, capacity), capacity, search))
    sent = spark.sparkContext.broadcast(table)
    ranked = global_rank(cutted, ["length"], ["id", "start", "ids_crc32"], "rank")
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        length_at = {int(n): (lo, hi) for n, lo, hi in zip(*_runs(t[:, 0]), strict=True)}
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                lo, hi = length_at[int(n)]
                of = np.flatnonzero(length == n)
                row[of] = lo + np.searchsorted(t[lo:hi, 1], rank[of], side="right") - 1
            _, first, each, sequence, offset = t[row].T
            bin_, within = np.divmod(rank - first, np.maximum(each, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:5]), pa.array(sequence + bin_), pa.array(offset + within * length)], names)

    slim_batches(spark)
    fields = [*cutted.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first = np.unique(sorted_, return_index=True)
    return values, first, np.append(first[1:], len(sorted_))
