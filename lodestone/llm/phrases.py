"""Phrases whose words stand together more often than apart, found level by level.

Level k counts the k-grams both of whose overlapping (k-1)-grams are frequent; no other can be frequent. The frequent
(k-1)-grams have numbers, and texts are rows of these numbers with a break wherever a gram isn't frequent or a piece
ends, so a k-gram is a pair of neighbouring numbers. Workers count pairs of a batch before anything is shuffled. The
frequent grams are sent to every worker up to a stated size; beyond it the numbers come by a join. Cuts are scored from
the level tables.

Rows of numbers are byte strings of bounded length, what is sent are sorted arrays, and workers pass on small batches, so
that an executor's memory doesn't follow the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, drop, text_batches

#: Frequent words and their bytes, and frequent longer grams, up to which they are sent to every worker.
SENT_WORDS, SENT_BYTES, SENT_GRAMS = 1_000_000, 16_000_000, 2_000_000
#: Occurrences of a gram from which, at 1 / 10,000 of all or more, it isn't shuffled by its own value.
OFTEN = 1024
#: Bytes of a text that are cut into words at once, and different grams that a worker counts before it passes them on.
_SLICE, _HELD = 1_000_000, 300_000
#: Numbers in a row of encoded texts, from which it ends at the next break.
_ROW = 1024
#: Words whose numbers a worker keeps at hand, and rows of a batch that it passes on: of encoded texts, and of counts.
_KEPT, _PASSED_ROWS, _PASSED_COUNTS = 100_000, 256, 16_384
#: Rows that are read from a table of encoded texts at once.
_READ_ROWS = 1024
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, and ``b"."`` (which no word holds) where a piece ends, a slice of the text at a time."""
    text, at = text.lower().translate(_BREAKS), 0
    while at < len(text):
        end = text.find(b".", at + _SLICE) + 1 or len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end


def _kind(count: int) -> type:
    """Of the numbers below ``count`` in packed rows."""
    return np.int32 if count < 1 << 31 else np.int64


def _packed(ids: np.ndarray, ends: list[int], kind: type) -> pa.Array:
    """``ids`` up to each of ``ends`` as a byte string."""
    data = ids.astype(kind)
    offsets = np.array([0, *ends], np.int32) * np.int32(data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of a column of packed ones."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


def _passed(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in small ones; the JVM holds each whole, outside of its heap."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _rows(ids: np.ndarray, kind: type) -> Iterator[pa.RecordBatch]:
    """``ids``, which end with a break, as packed rows that end with one."""
    breaks = np.flatnonzero(ids < 0) + 1
    ends = np.unique(breaks[np.searchsorted(breaks, [*range(_ROW, len(ids), _ROW), len(ids)])]) if len(breaks) else breaks
    return _passed(pa.RecordBatch.from_arrays([_packed(ids, ends, kind)], ["ids"]), _PASSED_ROWS)


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n), not yet summed; a null word has the number of all words."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            yield from _passed(pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], schema=schema), _PASSED_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        read = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for words in tokens(text.as_py()):
                    held.setdefault(lang, Counter()).update(words)
                    read += len(words)
                    if read > _HELD // 4:
                        read = 0
                        if sum(map(len, held.values())) > _HELD:
                            yield from rows(_with_totals(held))
                            held = {}
        yield from rows(_with_totals(held))

    return docs.mapInArrow(run, "lang string, word binary, n long")


def _with_totals(held: dict[str, Counter]) -> dict[str, Counter]:
    for c in held.values():
        c.pop(b".", None)
        c[None] = sum(c.values())
    return held


def _numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` as a written table with gapless numbers ``gid`` from 0, and its count."""
    table = cut(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    start, starts = 0, []
    for r in table.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row for each partition that was written
        starts.append((r["p"], start))
        start += r["count"]
    first = table.sparkSession.createDataFrame(starts, "__p int, __start long")
    gid = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return table.join(F.broadcast(first), F.col("__p") == part).select(*df.columns, gid.alias("gid")), start


def _closed(ids: np.ndarray) -> np.ndarray:
    """``ids`` with one break (-1) for each run of breaks, and one at the end."""
    ids = np.append(ids, -1)
    known = ids >= 0
    return ids[known | np.append(False, known[:-1])]


def _key(lang: Column, word: Column) -> Column:
    """Of a word in its language; words hold no space, so no two have the same one."""
    return F.concat(F.encode(lang, "UTF-8"), F.lit(b" "), word)


def _encoded_words(docs: DataFrame, words: DataFrame, count: int) -> DataFrame:
    """(ids): the numbers of the frequent words of all texts, with breaks."""
    keyed, kind = words.select(_key(F.col("lang"), F.col("word")).alias("key"), "n", "gid"), _kind(count)
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]
    if count > SENT_WORDS or size > SENT_BYTES:
        return _joined_words(docs, keyed, kind)
    table = keyed.select("key", "gid").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(_sorted_keys(table.column("key"), table.column("gid").to_numpy().astype(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        held: list[tuple[str, list[bytes]]] = []
        read = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for slice_ in tokens(text.as_py()):
                    held.append((lang, slice_))
                    read += len(slice_)
                    if read > _SLICE // 16 and slice_[-1:] == [b"."]:
                        yield from _rows(encoded(held, known), kind)
                        held, read = [], 0
                held.append((lang, [b"."]))
                if read > _SLICE // 16:
                    yield from _rows(encoded(held, known), kind)
                    held, read = [], 0
        yield from _rows(encoded(held, known), kind)

    def encoded(held: list[tuple[str, list[bytes]]], known: dict[str, dict[bytes, int]]) -> np.ndarray:
        if sum(map(len, known.values())) > _KEPT:
            known.clear()
        met: dict[str, set[bytes]] = {}
        for lang, words in held:
            met.setdefault(lang, set()).update(words)
        for lang, own in met.items():
            of, before = known.setdefault(lang, {}), lang.encode() + b" "
            fresh = [*own.difference(of)]
            of.update(zip(fresh, _numbers(sent.value, [before + w for w in fresh]), strict=True))
        out: list[int] = []
        for lang, words in held:
            out.extend(map(known[lang].__getitem__, words))
        return _closed(np.array(out, np.int64))

    return docs.mapInArrow(run, "ids binary")


def _sorted_keys(keys: pa.ChunkedArray, gids: np.ndarray, seed: int = 0) -> tuple[int, np.ndarray, np.ndarray, pa.Array]:
    """(seed, hashes in order, their numbers and keys), with a seed that tells all keys apart."""
    digest = xxhash.xxh64_intdigest
    hashes = np.concatenate([np.zeros(0, np.uint64), *(np.array([digest(k, seed) for k in c.to_pylist()], np.uint64) for c in keys.chunks)])
    order = np.argsort(hashes)
    hashes = hashes[order]
    if (hashes[1:] == hashes[:-1]).any():
        return _sorted_keys(keys, gids, seed + 1)
    taken = keys.take(pa.array(order))
    return seed, hashes, gids[order], pa.concat_arrays([pa.array([], pa.binary()), *taken.chunks])


def _numbers(known: tuple[int, np.ndarray, np.ndarray, pa.Array], keys: list[bytes]) -> list[int]:
    """The number of each key, -1 where it isn't known."""
    seed, hashes, gids, of = known
    if not len(hashes) or not keys:
        return [-1] * len(keys)
    place = np.minimum(np.searchsorted(hashes, np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64)), len(hashes) - 1)
    same = pc.equal(of.take(pa.array(place)), pa.array(keys, pa.binary())).to_numpy(zero_copy_only=False)
    return np.where(same, gids[place], -1).tolist()


def _lines(words: list[bytes]) -> Iterator[list[bytes]]:
    """``words`` cut at breaks into lists of bounded length."""
    at = 0
    while at < len(words):
        try:
            end = words.index(b".", at + _ROW) + 1
        except ValueError:
            end = len(words)
        yield words[at:end]
        at = end


def _joined_words(docs: DataFrame, words: DataFrame, kind: type) -> DataFrame:
    def rows(lists: list[list[bytes]], places: list[list[int]]) -> pa.RecordBatch:
        at, ends = np.concatenate([np.array(x, np.int64) for x in places]), np.cumsum([len(x) for x in places])
        keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array([k for x in lists for k in x], pa.binary()))
        return pa.RecordBatch.from_arrays([keys, _packed(at, ends, np.int32)], ["keys", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, places = [], []
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                before = lang.encode() + b" "
                for line in (x for slice_ in tokens(text.as_py()) for x in _lines(slice_)):
                    place = {w: k for k, w in enumerate(dict.fromkeys(w for w in line if w != b"."))}
                    places.append([*(place.get(w, -1) for w in line), -1])
                    lists.append([before + w for w in place])
                    if len(lists) == _PASSED_ROWS:
                        yield rows(lists, places)
                        lists, places = [], []
        if lists:
            yield rows(lists, places)

    return _looked_up(docs.mapInArrow(run, "keys array<binary>, at binary"), words, "key", kind)


def _encoded_grams(ids: DataFrame, grams: DataFrame, count: int, below: int) -> DataFrame:
    """(ids) with the numbers of the frequent pairs of neighbours; ``below`` bounds the numbers in ``ids``."""
    given, kind = _kind(below), _kind(count)
    if count > SENT_GRAMS or below >= 1 << 31:
        return _joined_grams(ids, grams, given, kind)
    table = grams.select("a", "b", "gid").toArrow()
    a, b, gid = (c.to_numpy() for c in table.columns)
    code = a << 32 | b
    order = np.argsort(code)
    sent = ids.sparkSession.sparkContext.broadcast((code[order], gid[order].astype(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, gids = sent.value
        for batch in batches:
            flat = _flat(batch.column(0), given)
            out = np.full(len(flat), -1, np.int64)
            at = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
            if len(at) and len(codes):
                pair = flat[at] << 32 | flat[at + 1]
                place = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
                out[at] = np.where(codes[place] == pair, gids[place], -1)
            yield from _rows(_closed(out), kind)

    return ids.mapInArrow(run, "ids binary")


def _joined_grams(ids: DataFrame, grams: DataFrame, given: type, kind: type) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, places = [], []
            for row in batch.column(0):
                flat = np.frombuffer(row.as_py(), given).astype(np.int64)
                at = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
                (a, b, _), index = _pairs(flat[at], flat[at + 1], with_index=True)
                out = np.full(len(flat), -1, np.int64)
                out[at] = index
                lists.append((a, b)), places.append(out)
            if not lists:
                continue
            keys = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*lists, strict=True)], ["a", "b"])
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(a) for a, _ in lists)]), pa.int32()), keys)
            yield from _passed(pa.RecordBatch.from_arrays([keys, _packed(np.concatenate(places), np.cumsum([len(x) for x in places]), np.int32)], ["keys", "at"]), _PASSED_ROWS)

    rows = ids.mapInArrow(run, "keys array<struct<a:long,b:long>>, at binary")
    return _looked_up(rows, grams.select(F.struct("a", "b").alias("key"), "n", "gid"), "key", kind)


def _looked_up(rows: DataFrame, table: DataFrame, key: str, kind: type) -> DataFrame:
    """(ids) of ``rows`` (keys, the different keys of a row; at, which of them stands where) by a join with ``table``.

    Keys with 1 / 10,000 of all occurrences or more are 10,000 at most and are sent; the others are shuffled.
    """
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.posexplode("keys").alias("d", key))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(OFTEN, total // 10_000)
    told = each.join(F.broadcast(table.filter(hot).select(key, "gid")), key, "left")
    rest = told.filter(F.col("gid").isNull()).drop("gid").join(table.filter(~hot).select(key, "gid"), key)
    found = told.filter(F.col("gid").isNotNull()).select("row", "d", "gid").unionByName(rest.select("row", "d", "gid"))
    found = found.groupBy("row").agg(F.collect_list("d").alias("d"), F.collect_list("gid").alias("gid"))  # at most a row's different keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros(0, np.int64)]
            for at, d, gid in zip(*b.columns, strict=True):
                at, d = np.frombuffer(at.as_py(), np.int32), np.array(d.values if d.is_valid else [], np.int64)
                number = np.full(max([-1, *at.tolist(), *d.tolist()]) + 2, -1, np.int64)
                number[d] = np.array(gid.values if gid.is_valid else [], np.int64)
                out.append(number[at])  # number[-1] is a break
            yield from _rows(_closed(np.concatenate(out)), kind)

    return rows.join(found, "row", "left").select("at", "d", "gid").mapInArrow(run, "ids binary")


def _pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, with_index: bool = False):
    """The different pairs with their counts (or sums of ``n``), and where each given pair is among them."""
    low, back = np.zeros(0, np.int64), None
    if len(a) and max(a.max(), b.max()) >= 1 << 31:
        low, back = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = back[: len(a)], back[len(a) :]
    if n is None and not with_index:
        code, counts = np.unique(a << 32 | b, return_counts=True)
        index = None
    else:
        code, index, counts = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
        counts = counts if n is None else np.bincount(index, n, len(code)).astype(np.int64) if n.sum() < 1 << 52 else np.array([n[index == k].sum() for k in range(len(code))], np.int64)
    a, b = code >> 32, code & (1 << 32) - 1
    out = (a, b, counts) if back is None else (low[a], low[b], counts)
    return (out, index) if with_index else out


def _pair_counts(ids: DataFrame, kind: type) -> DataFrame:
    """(a, b, n) of neighbouring numbers, not yet summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            flat = _flat(batch.column(0), kind)
            ok = (flat[:-1] >= 0) & (flat[1:] >= 0)
            own = _pairs(flat[:-1][ok], flat[1:][ok])
            held = _pairs(*(np.concatenate(x) for x in zip(held, own, strict=True)))
            if len(held[0]) > _HELD:
                yield from _passed(pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["a", "b", "n"]), _PASSED_COUNTS)
                held = [np.zeros(0, np.int64)] * 3
        yield from _passed(pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["a", "b", "n"]), _PASSED_COUNTS)

    return ids.mapInArrow(run, "a long, b long, n long")


def _level(grams: DataFrame, below: DataFrame) -> DataFrame:
    """A level's table: the phrase, its count, and the counts of its beginnings (short to long) and ends (long to short)."""
    both = grams.alias("g").join(below.alias("x"), F.col("g.a") == F.col("x.gid")).join(below.alias("y"), F.col("g.b") == F.col("y.gid"))
    return both.select(
        "g.gid", "x.lang", F.concat("x.phrase", F.lit(b" "), "y.last").alias("phrase"), "y.last", "g.n", "g.a", "g.b",
        F.concat("x.begins", F.array("x.n")).alias("begins"), F.concat(F.array("y.n"), "y.ends").alias("ends"),
    )


def _decimal(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _scored(level: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) by the lowest-scoring cut, the first of equal ones."""

    def of_cut(c: Column, k: Column) -> Column:
        score = F.call_function("div", _decimal(F.col("n")) * F.lit(2_000_000), _decimal(c["begins"]) + _decimal(c["ends"]))
        return F.struct(score.cast("long").alias("score"), k.alias("k"), c["begins"].alias("l"), c["ends"].alias("r"))

    best = F.array_min(F.transform(F.arrays_zip("begins", "ends"), of_cut))
    return level.withColumn("cut", best).select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, share: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, then count, then bytes.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``.
    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times in their language within pieces,
    overlaps included. A cut after some words gives l and r, the counts of its two parts, and floor(2000000 a / (l + r));
    a phrase has the cut of the lowest score, the first of equal ones. A candidate inside a longer one that has
    ``share`` percent of its count is dropped; it is enough to look one word further, as a phrase's count is at most
    that of each phrase inside it. ``n`` counts all words of the language.

    A null language is ``und``; a null text is empty. Repeated rows count each, further columns aren't read, and an
    empty table or one without candidates gives an empty result. Counts are exact (longs, and decimals in products).
    """
    spark = docs.sparkSession
    text_batches(spark)
    reads = "spark.sql.parquet.columnarReaderBatchSize"
    usual = spark.conf.get(reads)
    spark.conf.set(reads, str(_READ_ROWS))
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counted = cut(_word_counts(own).groupBy("lang", "word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("word").isNull()))
    totals = counted.filter(F.col("word").isNull()).select("lang", F.col("n").alias("total"))
    words, count = _numbered(counted.filter(F.col("word").isNotNull()))
    none = F.lit([]).cast("array<long>")
    below = words.select("gid", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("begins"), none.alias("ends"))
    ids = cut(_encoded_words(own, words, count))
    levels: list[DataFrame] = []
    for k in range(2, longest + 1):
        grams, n = _numbered(_pair_counts(ids, _kind(count)).groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
        below = cut(_level(grams, below))
        levels.append(below)
        if k < longest:
            before, ids = ids, cut(_encoded_grams(ids, grams, n, count))
            drop(before)
            count = n
    drop(ids)
    spark.conf.set(reads, usual)
    kept = []
    for level, longer in zip(levels, [*levels[1:], None], strict=True):
        if longer is not None:
            inside = longer.select(F.explode(F.array("a", "b")).alias("gid"), F.col("n").alias("m")).groupBy("gid").agg(F.max("m").alias("m"))
            covered = F.coalesce(_decimal(F.col("m")) * 100 >= _decimal(F.col("n")) * share, F.lit(False))
            level = level.join(inside, "gid", "left").filter(~covered)
        kept.append(_scored(level))
    found = kept[0]
    for x in kept[1:]:
        found = found.unionByName(x)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each share of a language, then the first of those, so that no language meets in one task
    lots = found.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(spark.sparkContext.defaultParallelism * 4)))
    some = lots.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).filter(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return first.join(F.broadcast(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score"
    )
