"""Packing of tokenised documents into sequences: shortest pack first over the histogram of lengths.

A document is cut into whole sequences and a rest. The histogram of the pieces' lengths has as many rows as a sequence
has tokens, whatever the corpus. Over it, lengths are placed longest first, each into the packs that are shortest so
far; packs that look alike are one pattern with a count. Then each piece finds its place by its rank among the pieces
of its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import WORDS, specification, worker_encoder
from lodestone.llm.common import cut, global_rank, id_type, text_batches

_ENCODINGS: dict[int, Callable[[list[str | None]], list[list[int]]]] = {}
#: Characters of a text above which the library's backtracking may give up; such texts go to the encoder of this package.
_LIBRARY_CHARS = 500_000


def _encoding(spec: Broadcast) -> Callable[[list[str | None]], list[list[int]]]:
    """A function from texts to ids for a specification, made once in a worker.

    Where the merges are in the order of their ids (so that an id is a rank), a library encodes by ranks; it gives the
    ids that the specification gives. Other specifications go through the encoder of this package.
    """
    key = spec.value["key"]
    if key not in _ENCODINGS:
        import tiktoken

        own = worker_encoder(spec)
        plain = {b: i for i, b in own.bytes_of.items() if i not in own.special.values()}
        by_rank = len(plain) + len(own.special) == len(own.bytes_of) and bool((np.diff(own.merged) > 0).all())
        library = tiktoken.Encoding("corpus", pat_str=WORDS, mergeable_ranks=plain, special_tokens=own.special) if by_rank else None

        def run(texts: list[str | None]) -> list[list[int]]:
            return [library.encode(x or "", allowed_special="all") if library and len(x or "") <= _LIBRARY_CHARS else own.encode([x])[0].tolist() for x in texts]

        _ENCODINGS.clear()
        _ENCODINGS[key] = run
    return _ENCODINGS[key]


#: Rows of the table of places up to which it is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_PLACES = 200_000


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern. Lengths are placed longest first, into the shortest packs that have room."""
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by the tokens so far
    sums: list[int] = []  # a heap of those
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(total: int, count: int, pattern: tuple[int, ...]) -> None:
        if total == capacity:
            done.append((count, pattern))
            return
        if total not in packs:
            packs[total] = []
            heapq.heappush(sums, total)
        packs[total].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        while left:
            total = sums[0] if sums else capacity
            if total + length > capacity:
                put(length, left, (length,))
                break
            count, pattern = packs[total].pop()
            if not packs[total]:
                del packs[total]
                heapq.heappop(sums)
            used = min(count, left)
            if used < count:
                put(total, count - used, pattern)
            put(total + length, used, (*pattern, length))
            left -= used
    return done + [x for total in sorted(packs) for x in packs[total]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset) of each place that a pattern has for a length."""
    rank: dict[int, int] = {}
    sequence, out = 0, []
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            at = rank.get(length, 0)
            out.append((length, at, at + count, sequence, offset))
            rank[length], offset = at + count, offset + length
        sequence += count
    return out


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of the pieces into which the tokens of each text, ``end_id`` last, are cut.

    The tokenizer's file is read on the driver and travels with the function (its size is that of a vocabulary).
    """
    text_batches(docs.sparkSession)
    spec = specification(docs, tokenizer_path)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(spec)
        for b in batches:
            of, start, length, crc, total, ids = [], [], [], [], [], []
            for k, x in enumerate(b.column(1)):
                a = np.array([*encode([x.as_py()])[0], end_id], dtype="<u4")
                for s in range(0, len(a), capacity):
                    part = a[s : s + capacity]
                    of.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes())), total.append(len(a))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            arrays = [b.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], names)

    fields = [T.StructField("id", id_type(docs, id_col)), *(T.StructField(n, T.LongType()) for n in names[1:5])]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(``id_col``, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset) of each piece.

    Null and empty texts are a document of ``end_id`` alone. Repeated rows are packed each; a null id stays null. An
    empty table gives an empty result. The table of places is bounded by the histogram (one row for each pattern and
    length), not by the documents.
    """
    spark = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids))
    histogram = {r["length"]: r["count"] for r in cutted.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(shortest_pack_first(histogram, capacity))
    slim = cutted.select("id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids)
    ranked = global_rank(slim, ["length"], ["id", "start", "ids_crc32", "doc_tokens"], "rank")
    where = spark.createDataFrame(table, "p_length long, low long, high long, first_sequence long, `offset` long")
    on = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    if len(table) <= BROADCAST_PLACES:
        where = F.broadcast(where)
    placed = ranked.join(where, on).withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("low"))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "sequence_id", "offset")
