"""SimHash near-dedup for edited texts: wide fingerprints in a byte-position index, count filter, verified shingle sets.

Texts are near copies where the Jaccard similarity of their five-word shingles reaches 0.8. At that similarity each bit
of a SimHash fingerprint differs with a probability of 0.15, so 64 bits and four differences, the rule for fingerprints
alone, find few of them. Here a fingerprint has ``WORDS`` words of 64 bits. The index lists it under groups of
positional bytes; of all groups a text takes those that are least likely to differ in a near copy, as told by the
distance of their bits' tallies from a tie. Random texts rarely share such a group, near copies share several.

In a list the texts are compared by their first word of bits, then the positional bytes that two whole fingerprints
share are tallied and pairs below ``LEAST_BYTES`` go (a pair at 0.8 has 26 of 96 on average, a random one has fewer
than one), and what is left is verified on the whole shingle sets.

That goes in rounds. First each text is verified against two hubs of its lists, then against the text of its lists that
shares most with it among those it isn't connected with; that connects nearly all copies without looking at all pairs of a
group. In the last round only texts of a list that are still not connected are compared, in cells of bounded size: the list's largest connected part is dealt into lots and the rest into blocks, and
two texts of the largest part never meet. So a text meets every text that it isn't connected with and shares a list with.

Many texts around the threshold share dozens of lists, each pair of them several. A family is what the hubs connect when
all pairs with enough positional bytes count, verified or not. Where all pairs of a family are no more than those that its
lists would compare, the family is one list of its own, in which each pair meets once, and other lists compare only texts
of different families.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import connected_components, cut, drop, group_bounds, id_type, slim_batches, sorted_groups, text_batches

SHINGLE, LEAST = 5, 0.8
#: Words of 64 bits of a fingerprint; random partitions of its bytes into groups.
WORDS, ROUNDS = 12, 16
#: Groups that a text is listed under, by the bytes of a group. Wider groups keep lists short for more texts.
GROUPS = {2: 80, 3: 256}
#: Distinct texts up to which groups have two bytes; lists would grow with the texts beyond it.
PAIR_TEXTS = 1 << 22
#: Bits in which the first words may differ, and positional bytes that whole fingerprints share at least.
MOST_BITS, LEAST_BYTES = 21, 8
#: Nearest hubs that a text is compared with besides its first one.
HUBS = 4
#: Texts of a list on either side of a cell.
CELL_ROWS = 1024
_SHORT = 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: For each byte a number whose eight bytes are its bits, so that sums of up to 255 of them count all bits at once.
_LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k) for k in range(8))


def shingles(text: bytes | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a shorter text is one shingle, as is one without words."""
    words = (text or b"").lower().split()  # bytes: lower() and split() know ASCII only
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(flat[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)], np.uint64))


def wide_tally(own: np.ndarray) -> np.ndarray:
    """bytes x 8: of how many shingles each bit is set; each shingle's hash is mixed anew for each word of the fingerprint."""
    ones = np.zeros((8 * WORDS, 8), np.int64)
    for at in range(0, len(own), 4080):  # bounded memory for very long texts
        x = own[at : at + 4080, None] + _MIX[0] * np.arange(1, WORDS + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        lanes = _LANES[(x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(x), -1)]
        ones += np.add.reduceat(lanes, np.arange(0, len(x), 255), axis=0).view(np.uint8).reshape(-1, *ones.shape).sum(axis=0, dtype=np.int64)
    return ones


def groups_of(key_bytes: int, seed: int = 42) -> np.ndarray:
    """groups x key_bytes: positions of the bytes of each group; a partition of all bytes in each round."""
    rng = np.random.default_rng([seed, key_bytes])
    return np.concatenate([rng.permutation(8 * WORDS).reshape(-1, key_bytes) for _ in range(ROUNDS)])


def fingerprint(own: np.ndarray, groups: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(positional bytes, numbers of the ``count`` groups that are least likely to differ in a near copy)."""
    ones, n = wide_tally(own), len(own)
    far = 1.94 * np.abs(2 * ones - n) / np.sqrt(n)  # by how many deviations a near copy at 0.8 must move a bit to turn it
    steady = np.log1p(-0.5 * np.exp(-0.717 * far - 0.416 * far * far)).sum(axis=1)  # about the normal distribution's tail
    picked = np.argsort(-steady[groups].sum(axis=1), kind="stable")[:count]
    return np.packbits(2 * ones > n, axis=1, bitorder="little").ravel(), picked.astype(np.uint16)


def _prints(rows: DataFrame, shingle: int, key_bytes: int, seed: int) -> DataFrame:
    """(id, key, same, fp, picked): ``same`` is the digest of the shingle set, which texts of the same shingles share."""
    groups, count = groups_of(key_bytes, seed), GROUPS[key_bytes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, fps, picks = [], [], []
            for x in b.column(2):
                own = shingles(x.as_py(), shingle, seed)
                fp, picked = fingerprint(own, groups, count)
                same.append(xxhash.xxh3_128_hexdigest(own.tobytes())), fps.append(fp.tobytes()), picks.append(picked.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.string()), pa.array(fps, pa.binary()), pa.array(picks, pa.binary())], ["id", "key", "same", "fp", "picked"])

    fields = [T.StructField("id", id_type(rows, "id")), *(T.StructField(c, T.StringType()) for c in ("key", "same")), *(T.StructField(c, T.BinaryType()) for c in ("fp", "picked"))]
    return rows.select("id", "key", "text").mapInArrow(run, T.StructType(fields))


def _dense(column: pa.Array, kind: type) -> np.ndarray:
    """A column of byte strings of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _postings(each: DataFrame, key_bytes: int, seed: int) -> DataFrame:
    """(list, cls, word): a row for each group of bytes that a text is listed under."""
    groups = groups_of(key_bytes, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, picked = _dense(b.column(1), np.uint8), _dense(b.column(2), np.uint16).astype(np.int64)
            key = picked.copy()
            for k in range(key_bytes):
                key = key << 8 | np.take_along_axis(fp, groups[:, k][picked], axis=1)
            n = picked.shape[1]
            word = np.ascontiguousarray(fp[:, :8]).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(len(fp)), n))), pa.array(np.repeat(word, n))], ["list", "cls", "word"])

    return each.select("cls", "fp", "picked").mapInArrow(run, "list long, cls long, word long")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For partitions of (list, cls, word) sorted by list and cls: (list, cls, hub, bits, word) of the texts that may have a near copy there.

    The hub is a list's first text, ``bits`` how far its first word is. Texts alone in their list go, and of lists of up to
    ``_SHORT`` texts those whose first words are near nobody else's. Rows stream through; no list is put together.
    """
    rest: pa.Table | None = None
    open_list, hub, hub_word = None, 0, np.uint64(0)  # the long list that is still going on

    def out(lists: np.ndarray, cls: np.ndarray, hubs: np.ndarray, bits: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (lists, cls, hubs, bits.astype(np.int32), word.view(np.int64))], ["list", "cls", "hub", "bits", "word"])

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lists, cls, word = (t.column(c).to_numpy() for c in ("list", "cls", "word"))
        word = word.view(np.uint64)
        bounds = group_bounds([lists])
        sizes = np.diff(bounds)
        first = np.repeat(bounds[:-1], sizes)
        keep = np.repeat(sizes, sizes) > _SHORT
        short = ~keep
        for d in range(1, int(min(sizes.max(initial=1), _SHORT))):
            i = np.flatnonzero(short[d:] & (lists[d:] == lists[:-d]))
            i = i[np.bitwise_count(word[i] ^ word[i + d]) <= MOST_BITS]
            keep[i] = keep[i + d] = True
        if keep.any():
            yield out(lists[keep], cls[keep], cls[first[keep]], np.bitwise_count(word ^ word[first])[keep], word[keep])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        lists = t.column("list").to_numpy()
        if open_list is not None and len(lists):
            n = int(np.searchsorted(lists, open_list, side="right"))
            if n:
                cls, word = (t.column(c).to_numpy()[:n] for c in ("cls", "word"))
                yield out(lists[:n], cls, np.full(n, hub), np.bitwise_count(word.view(np.uint64) ^ hub_word), word.view(np.uint64))
            t, lists = t.slice(n), lists[n:]
            if not len(lists):
                rest = None
                continue
            open_list = None
        n = int(np.searchsorted(lists, lists[-1])) if len(lists) else 0  # where the last list begins: it may go on
        if n:
            yield from whole(t.slice(0, n))
        rest = t.slice(n)
        if rest.num_rows > _SHORT:
            open_list, hub, hub_word = lists[-1], rest.column("cls")[0].as_py(), rest.column("word").to_numpy()[:1].view(np.uint64)[0]
            yield from whole(rest)
            rest = None
    if rest is not None and rest.num_rows:
        yield from whole(rest)


def near_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the first words of fingerprints (as one number each) are near enough."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]) <= MOST_BITS


def near_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints share enough positional bytes."""
    return (a == b).sum(axis=-1) >= LEAST_BYTES


def _apart(root: np.ndarray, fam: np.ndarray, own: slice, of: slice) -> np.ndarray:
    """Which texts of ``own`` have another root and another family than which of ``of``."""
    return (root[own, None] != root[None, of]) & (fam[own, None] != fam[None, of])


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For partitions of (list, p, q, cls, root, fam, value) sorted by the first three: (a, b, shared), for each text the one of another
    root and ``fam`` in its cell with which it shares most positional bytes, where these are enough."""
    for table, bounds in sorted_groups(batches, ["list", "p", "q"]):
        value, cls = _dense(table.column("value").combine_chunks(), np.uint8), table.column("cls").to_numpy()
        root, fam = (table.column(c).to_numpy() for c in ("root", "fam"))
        a, b, most = [], [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for s in range(lo, hi, 64):
                own = slice(s, min(s + 64, hi))
                shared = (value[own, None] == value[None, lo:hi]).sum(axis=2) * _apart(root, fam, own, slice(lo, hi))
                best = shared.argmax(axis=1)
                top = shared[np.arange(len(best)), best]
                ok = np.flatnonzero(top >= LEAST_BYTES)
                a.append(cls[lo + best[ok]]), b.append(cls[s + ok]), most.append(top[ok])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, most)], ["a", "b", "shared"])


def _mark(near, kind: type, across: bool):
    """For partitions sorted by (list, p, q): the rows that have a partner in their cell, near and of another root, with ``across`` of another ``fam`` too."""

    def partners(at: np.ndarray, root: np.ndarray, fam: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Which rows of each cell have one; ``at`` holds the cells' bounds."""
        sizes = np.diff(at)
        cell, out = np.repeat(np.arange(len(sizes)), sizes), np.zeros(at[-1], bool)
        short = sizes[cell] <= _SHORT
        for d in range(1, int(min(sizes.max(initial=1), _SHORT))):
            i = np.flatnonzero(short[d:] & (cell[d:] == cell[:-d]) & (root[d:] != root[:-d]) & (fam[d:] != fam[:-d]))
            i = i[near(value[i], value[i + d])]
            out[i] = out[i + d] = True
        for lo, hi in ((at[k], at[k + 1]) for k in np.flatnonzero(sizes > _SHORT)):
            for s in range(lo, hi, 64):
                own = slice(s, min(s + 64, hi))
                i, j = np.nonzero(_apart(root, fam, own, slice(lo, hi)))
                if len(i):
                    hit = near(value[own][i], value[lo:hi][j])
                    out[s + i[hit]] = out[lo + j[hit]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in sorted_groups(batches, ["list", "p", "q"]):
            value = table.column("value").combine_chunks()
            value = _dense(value, np.uint8) if kind is bytes else value.to_numpy().view(np.uint64)[:, None]
            root = table.column("root").to_numpy()
            marked = partners(bounds, root, table.column("fam").to_numpy() if across else root, value)
            if marked.any():
                yield from table.select(["list", "p", "q", "cls", "root", "fam"]).filter(pa.array(marked)).to_batches()

    return run


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Of two sorted sets; zero where their sizes alone rule out ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _verify(least: float):
    """For partitions of (list, p, q, cls, root, fam, own) sorted by the first three: links (a, b) that connect all that link.

    Texts of the same root are connected already, those of the same ``fam`` meet elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in sorted_groups(batches, ["list", "p", "q"]):
            cls, root, fam = (table.column(c).to_numpy() for c in ("cls", "root", "fam"))
            column = table.column("own").combine_chunks()
            at, flat = column.offsets.to_numpy(), column.values.to_numpy()
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                label, sets, met = np.unique(root[lo:hi], return_inverse=True)[1], [flat[at[k] : at[k + 1]] for k in range(lo, hi)], fam[lo:hi]
                for i in range(hi - lo - 1):
                    for j in (np.flatnonzero((label[i + 1 :] != label[i]) & (met[i + 1 :] != met[i])) + i + 1).tolist():
                        if label[j] != label[i] and jaccard(sets[i], sets[j], least) >= least:
                            label[label == label[j]] = label[i]
                            a.append(cls[lo + i]), b.append(cls[lo + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a)), pa.array(np.array(b))], ["a", "b"])

    return run


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, fa, fb) the pairs whose fingerprints share enough positional bytes."""
    for b in batches:
        keep = pa.array(near_bytes(_dense(b.column(2), np.uint8), _dense(b.column(3), np.uint8))) if b.num_rows else pa.array([], pa.bool_())
        yield b.select(["a", "b"]).filter(keep)


def _cells(listed: DataFrame, cell_rows: int) -> DataFrame:
    """(list, p, q, cls, root, ...): lists with more than one root, in cells where texts of different roots meet.

    The root with most texts of a list is dealt into lots, the others into blocks numbered after the lots. Of lists with the
    same texts one stays.
    """
    member = F.xxhash64("cls")
    by_root = listed.groupBy("list", "root").agg(F.count("*").alias("c"), F.bit_xor(member).alias("x"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    mixed = by_root.groupBy("list").agg(F.count("*").alias("roots"), F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top"), F.bit_xor("x").alias("x"), F.min("low").alias("low"), F.max("high").alias("high")).filter("roots > 1")
    mixed = mixed.groupBy("n", "x", "low", "high").agg(F.min(F.struct("list", "top")).alias("one")).select("n", "one.list", "one.top")
    lots = lambda n: F.ceil(n / cell_rows).cast("int")
    mixed = mixed.select("list", F.col("top.root").alias("major"), lots(F.col("top.c")).alias("lots"), lots(F.col("n") - F.col("top.c")).alias("blocks"))
    rows = listed.join(mixed, "list").withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("root") == F.col("major"), F.col("lots")).otherwise(F.col("blocks"))).cast("int"))
    pair = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    first, block = F.col("lots"), F.col("lots") + F.col("own")
    with_blocks = F.transform(upto(F.col("blocks")), lambda o: pair(F.col("own"), first + o))
    with_all = F.transform(upto(first + F.col("blocks")), lambda o: pair(block, o))
    cell: Column = F.explode(F.when(F.col("root") == F.col("major"), with_blocks).otherwise(with_all))
    return rows.withColumn("cell", cell).select("list", "cell.p", "cell.q", *[c for c in listed.columns if c != "list"])


def _families(met: DataFrame, likely: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, fam): the texts of ``likely`` pairs; ``fam`` is null where a family has more pairs than its lists would compare."""
    family = cut(connected_components(likely).select("node", F.col("root").alias("fam")))
    shares = met.join(family, met["cls"] == family["node"], "left").groupBy("list", F.coalesce("fam", "cls").alias("fam")).agg(F.count("*").alias("c"))
    compared = shares.groupBy("fam").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    dense = family.groupBy("fam").agg(F.count("*").alias("n")).join(compared, "fam").filter("n * n <= pairs").select(F.col("fam").alias("dense"))
    named = family.join(roots, "node", "left").select("node", "fam", F.coalesce("root", "node").alias("root"))
    return cut(named.join(dense, named["fam"] == dense["dense"], "left").select("node", "root", F.col("dense").alias("fam")))


def _row_key(id_col: str, key: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), F.lit(" "), key), 256)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The digest of a row's id and text, never null; a null text is empty."""
    return _row_key(id_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of ``docs`` one row: the smallest id's, one without an id where there is no other; of its texts that of the smallest digest."""
    found = components(docs, id_col, text_col, with_groups=True)
    one = found.groupBy("group").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), id_col, "row_key")).alias("first")).select(F.col("first.row_key").alias("row_key"))
    return docs.withColumn("row_key", row_key(id_col, text_col)).join(one, "row_key", "left_semi").dropDuplicates(["row_key"])


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, shingle: int = SHINGLE, key_bytes: int | None = None, cell_rows: int = CELL_ROWS, seed: int = 42, with_groups: bool = False) -> DataFrame:
    """(``id_col``, ``component_id``[, row_key, group]): the smallest id that links reach, the row's own included.

    Texts link where the Jaccard similarity of their shingles is ``least`` or more; whatever is found is verified. Every
    row gets a row, repeated rows too; texts of the same shingles are one class, as are null and empty ones. A null id is
    no component's id unless the component has no other. ``with_groups`` adds a number of the component, which is one where
    ids are null or repeat in several, and the row's ``row_key``. Other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("key"))
    if key_bytes is None:
        key_bytes = 2 if rows.select(F.approx_count_distinct("key")).first()[0] <= PAIR_TEXTS else 3
    prints = cut(_prints(rows, shingle, key_bytes, seed))
    each = prints.groupBy("same").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("low"), F.min(F.struct("fp", "picked")).alias("print"))
    each = cut(each.select("same", F.col("low.id").alias("first"), F.col("low.key").alias("key"), "print.fp", "print.picked").withColumn("cls", F.monotonically_increasing_id()))
    slim_batches(spark)
    postings = _postings(each, key_bytes, seed).repartition("list").sortWithinPartitions("list", "cls")
    met = cut(postings.mapInArrow(_met, "list long, cls long, hub long, bits int, word long"))

    def sets(needed: DataFrame) -> DataFrame:
        """(cls, own): the shingle sets of the classes ``needed``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = pa.array([shingles(x.as_py(), shingle, seed).view(np.int64) for x in b.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), own], ["cls", "own"])

        text_batches(spark)
        # the row with the class's smallest id; its copies have other ids, so they don't meet in one task
        wanted = each.join(needed, "cls", "left_semi").select("cls", F.col("first").alias("w_id"), F.col("key").alias("w_key"))
        of = rows.join(wanted, rows["id"].eqNullSafe(F.col("w_id")) & (rows["key"] == F.col("w_key"))).dropDuplicates(["cls"])
        return cut(of.select("cls", "text").mapInArrow(run, "cls long, own array<long>"))

    # hubs for each text: the first one, which the others of its group are likely to have too, and the nearest ones
    hubs = met.filter(f"cls <> hub AND bits <= {MOST_BITS}").groupBy("cls").agg(F.array_distinct(F.concat(F.array(F.min("hub")), F.slice(F.sort_array(F.collect_set(F.struct("bits", "hub"))), 1, HUBS)["hub"])).alias("hubs"))
    stars = cut(hubs.select(F.explode("hubs").alias("a"), F.col("cls").alias("b")))
    fps = each.select("cls", "fp")
    of = lambda df, side: df.select(F.col("cls").alias(side), F.col(df.columns[1]).alias(f"f{side}"))
    kept = stars.join(of(fps, "a"), "a").join(of(fps, "b"), "b").select("a", "b", "fa", "fb").mapInArrow(_tallied, "a long, b long")
    kept = cut(kept)
    own_stars = sets(kept.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    common = F.size(F.array_intersect("fa", "fb"))
    linked = kept.join(of(own_stars, "a"), "a").join(of(own_stars, "b"), "b").filter(common / (F.size("fa") + F.size("fb") - common) >= least).select("a", "b")
    linked = cut(linked)
    roots = cut(connected_components(linked))

    keys = ["list", "p", "q"]
    shape = "list long, p int, q int, cls long, root long, fam long"
    by_cell = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)

    member_of = _families(met, kept, roots)
    slim_batches(spark)
    # in a list only texts of different families meet; a family's own texts meet in a list of theirs, of a negative number
    label = F.coalesce("fam", "root", "cls")
    listed = met.join(member_of, met["cls"] == member_of["node"], "left").select("list", "cls", label.alias("root"), F.coalesce("root", "cls").alias("linked"), "word")
    dealt = by_cell(_cells(listed, cell_rows).select(*keys, "cls", F.col("linked").alias("root"), F.col("root").alias("fam"), F.col("word").alias("value")))
    left = cut(dealt.mapInArrow(_mark(near_bits, int, False), shape))  # the texts of each list that have one of another root near them there, in cells
    own_lists = member_of.filter("fam IS NOT NULL").select((-1 - F.col("fam")).alias("list"), F.col("node").alias("cls"), "root")
    inside = _cells(own_lists, max(cell_rows // 2, 1)).select(*keys, "cls", "root", F.col("cls").alias("fam"))
    # whole fingerprints are joined to cells once, for both of the steps that read them
    whole = cut(left.unionByName(inside).join(fps, "cls").select(*keys, "cls", "root", "fam", F.col("fp").alias("value")))

    # texts that neither hub connects are verified against the one that shares most with them, before all of a cell meet
    nearest = by_cell(whole).mapInArrow(_partners, "a long, b long, shared long").groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    second = cut(nearest.select("a", "b"))
    own_second = sets(second.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    linked_second = cut(second.join(of(own_second, "a"), "a").join(of(own_second, "b"), "b").filter(common / (F.size("fa") + F.size("fb") - common) >= least).select("a", "b"))
    both = linked.unionByName(linked_second)
    roots_second = cut(connected_components(both))
    slim_batches(spark)
    # roots only grow together, so texts that are apart now shared a cell then; those that are connected now don't meet in it
    still = whole.drop("root").join(roots_second, whole["cls"] == roots_second["node"], "left").select(*keys, "cls", F.coalesce("root", "cls").alias("root"), "fam", "value")
    marked = cut(by_cell(still).mapInArrow(_mark(near_bytes, bytes, True), shape))
    # cells with the same texts are one
    member = F.xxhash64("cls")
    alike = marked.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(member).alias("x"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    alike = alike.groupBy("n", "x", "low", "high", F.col("list") < 0).agg(F.min(F.struct(*keys)).alias("cell")).select("cell.*")
    cells = cut(marked.join(alike, keys))
    own_cells = sets(cells.select("cls").distinct())
    dealt = by_cell(cells.join(own_cells, "cls").select(*keys, "cls", "root", "fam", "own"))
    more = cut(dealt.mapInArrow(_verify(least), "a long, b long"))
    final = roots_second if more.isEmpty() else connected_components(both.unionByName(more))
    rooted = cut(each.join(final.select(F.col("node").alias("cls"), "root"), "cls", "left").select("same", "first", F.coalesce("root", "cls").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("same", "component_id", "root")
    more_columns = [_row_key("id", F.col("key")).alias("row_key"), F.col("root").alias("group")] * with_groups
    done = cut(prints.select("id", "key", "same").join(named, "same").select(F.col("id").alias(id_col), "component_id", *more_columns))
    drop(prints, each, met, stars, kept, own_stars, linked, roots, member_of, left, whole, second, own_second, linked_second, roots_second, marked, cells, own_cells, more, rooted)
    return done
