"""Byte-level BPE encoding and decoding with a contiguous array of ranks.

A short word is a row of part boundaries with the ranks of its adjacent parts beside them. The row is scanned for its
smallest rank, that boundary is deleted, the two neighbouring ranks are looked up again, and so on until no adjacent
parts merge. Rows of equal length are handled together as one array. Words longer than ``LONG`` bytes, where repeated
scans would take time in the square of the length, keep their ranks in a heap.

Texts are cut at single spaces into chunks; a chunk's ids don't depend on its neighbours where a visible character
stands on both sides of the space, so they are kept for the chunks to come. Elsewhere neighbouring chunks are joined.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import id_type, text_batches

#: Bytes of a word up to which ranks are scanned, and bytes of kept chunks before all are forgotten, with the bytes that an
#: entry takes beside its text, as measured.
LONG, KEPT, ENTRY = 64, 60_000_000, 300
_NONE = np.int32(2**31 - 1)
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The words of byte-level BPE. Contractions stand where an apostrophe could begin another alternative.
WORDS = rf" ?\p{{L}}+| ?\p{{N}}+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_WORDS = regex.compile(WORDS)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class _Pool:
    """Rows of ids of any length, one after another."""

    def __init__(self) -> None:
        self.flat, self.start, self.size, self.used, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        """The number of the first new row."""
        first, n = self.n, len(sizes)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while first + n > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[first : first + n], self.size[first : first + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.n = self.used + len(flat), first + n
        return first

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows ``at``, and each row's count."""
        size = self.size[at]
        where = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[where], size


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``values`` with ``counts`` members, of which some may be zero."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Encoder:
    """Ids of texts and texts of ids, for a byte-level BPE specification in JSON."""

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        vocab, merges = d["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        kind = d.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or d.get("normalizer"):
            raise ValueError("only byte-level BPE without a prefix space or normalizer is supported")
        letters = byte_alphabet()
        self.byte_id = np.array([vocab[x] for x in letters], np.int32)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.pair, self.pair_rank = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.special = {x["content"]: x["id"] for x in d.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = {x: b for b, x in enumerate(letters)}
        self.bytes_of = {i: bytes(map(byte.__getitem__, x)) for x, i in vocab.items() if x not in self.special} | {i: x.encode() for x, i in self.special.items()}
        self.forget()

    def forget(self) -> None:
        self.words, self.word_ids = {}, _Pool()
        self.first, self.later, self.chunk_ids, self.opens, self.closes = {}, {}, _Pool(), np.zeros(0, bool), np.zeros(0, bool)
        self.kept = 0

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], _NONE)

    def _same_length(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of ``ids`` (one word a row, one part a byte). Returns the rows, -1 behind their ends, and the parts of each."""
        n, width = ids.shape
        out, parts = np.full((n, width), -1, np.int32), np.full(n, width)
        row, a = np.arange(n), np.concatenate((ids, np.full((n, 1), -1, np.int32)), axis=1)
        ranks = np.concatenate((self.rank_of(ids[:, :-1], ids[:, 1:]), np.full((n, 1), _NONE, np.int32)), axis=1)
        columns, left = np.arange(width), width
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            over = best == _NONE
            if over.any():
                out[row[over], :left], parts[row[over]] = a[over, :left], left
                row, a, ranks, at, best = row[~over], a[~over], ranks[~over], at[~over], best[~over]
                if not len(row):
                    break
            lines, left = np.arange(len(row)), left - 1
            keep = columns[: left + 1] + (columns[: left + 1] > at[:, None])  # part at+1 goes, and its rank with it
            a = np.take_along_axis(a, keep, axis=1)
            a[lines, at] = self.merged[best]
            ranks = np.take_along_axis(ranks, keep[:, :left], axis=1)
            ranks[:, left - 1] = _NONE
            for x in (at - 1, at):
                ok = (x >= 0) & (x + 1 < left)
                ranks[lines[ok], x[ok]] = self.rank_of(a[lines[ok], x[ok]], a[lines[ok], x[ok] + 1])
        return out, parts

    def _long(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i, r in enumerate(self.rank_of(np.array(ids[:-1]), np.array(ids[1:])).tolist()) if r != _NONE]
        heapq.heapify(heap)
        rank = {i: r for r, i in heap}

        def refresh(i: int) -> None:
            r = int(self.rank_of(np.array([ids[i]]), np.array([ids[after[i]]]))[0]) if i >= 0 and after[i] >= 0 else int(_NONE)
            rank[i] = r
            if r != _NONE:
                heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank.get(i) != r:
                continue
            gone = after[i]
            ids[i], after[i] = int(self.merged[r]), after[gone]
            if after[gone] >= 0:
                before[after[gone]] = i
            rank[gone] = int(_NONE)
            ids[gone] = -1
            refresh(i), refresh(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def _learn_words(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            if size > LONG:
                for k in of:
                    flat[k] = self._long(raw[k])
                continue
            for lot in np.array_split(of, -(-len(of) // 20_000)):
                out, parts = self._same_length(self.byte_id[np.frombuffer(b"".join([raw[k] for k in lot]), np.uint8)].reshape(len(lot), size))
                for k, row, n in zip(lot.tolist(), out, parts.tolist(), strict=True):
                    flat[k] = row[:n]
        first = self.word_ids.add(np.concatenate(flat), np.fromiter(map(len, flat), np.int64, len(flat)))
        self.words.update(zip(words, range(first, first + len(words)), strict=True))

    def _learn_chunks(self, chunks: list[tuple[bool, str]]) -> None:
        """``chunks``: whether the space before it belongs to it, and the chunk without it; none is known yet."""
        cut = [[" " + x] if spaced and x.isalpha() else _WORDS.findall(" " + x if spaced else x) for spaced, x in chunks]
        known = self.words
        if new := list(dict.fromkeys(w for c in cut for w in c if w not in known)):
            self._learn_words(new)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        flat, sizes = self.word_ids.rows(np.fromiter((known[w] for c in cut for w in c), np.int64, int(counts.sum())))
        first = self.chunk_ids.add(flat, sums_of(sizes, counts))
        self.opens = np.concatenate((self.opens, [not x or x[0].isspace() for _, x in chunks]))
        self.closes = np.concatenate((self.closes, [not x or x[-1].isspace() for _, x in chunks]))
        self.kept += sum(ENTRY + 6 * len(x) for _, x in chunks)
        for k, (spaced, x) in enumerate(chunks, first):
            (self.later if spaced else self.first)[x] = k

    def _numbers(self, pieces: list[list[str]]) -> list[np.ndarray]:
        """The chunks' numbers; the first of a list has no space before it."""
        new = dict.fromkeys((False, p[0]) for p in pieces if p[0] not in self.first)
        later = self.later
        for p in pieces:
            new.update(dict.fromkeys((True, x) for x in p[1:] if x not in later))
        if new:
            self._learn_chunks(list(new))
        return [np.fromiter((self.first[p[0]], *map(later.__getitem__, p[1:])), np.int64, len(p)) for p in pieces]

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [x.split(" ") for x in texts]
        numbers = self._numbers(pieces)
        joined = {}
        for k, at in enumerate(numbers):
            tied = self.closes[at[:-1]] | self.opens[at[1:]]
            if tied.any():
                p, out = pieces[k], []
                starts = [0, *(np.flatnonzero(~tied) + 1).tolist()]
                for a, b in zip(starts, [*starts[1:], len(p)], strict=True):
                    out.append(p[a] if b == a + 1 else " ".join(p[a:b]))
                joined[k] = out
        if joined:
            for k, at in zip(joined, self._numbers(list(joined.values())), strict=True):
                numbers[k] = at
        return [self.chunk_ids.rows(at)[0] for at in numbers]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, no special tokens added; a null text is empty. Special tokens' strings in a text are their ids."""
        if self.kept > KEPT:
            self.forget()
        texts = [x or "" for x in texts]
        parts = [self.split.split(x) if self.split and any(s in x for s in self.special) else [x] for x in texts]
        plain = self._encode_plain([p for x in parts for p in x[::2]])
        out, at = [], 0
        for x in parts:
            own = plain[at : at + len(x[::2])]
            at += len(own)
            for k in range(1, len(x), 2):
                own.insert(k, np.array([self.special[x[k]]], np.int32))
            out.append(own[0] if len(own) == 1 else np.concatenate(own))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, special tokens included; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(spec: Broadcast) -> Encoder:
    """The encoder of a broadcast specification, made once in a worker."""
    if spec.value["key"] not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec.value["key"]] = Encoder(spec.value["json"])
    return _ENCODERS[spec.value["key"]]


def specification(docs: DataFrame, tokenizer_path: str) -> Broadcast:
    """The tokenizer's file, read on the driver; its size is that of a vocabulary, whatever the corpus."""
    text = Path(tokenizer_path).read_text()
    return docs.sparkSession.sparkContext.broadcast({"key": hash(text), "json": text})


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>): a row for each row of ``docs``.

    A null or empty text has no ids. Null ids, repeated rows and further columns of any name (which aren't read) are
    fine; an empty table gives an empty result. A text's whole length is encoded; a very long one is one array.
    """
    text_batches(docs.sparkSession)
    spec = specification(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(spec)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids = enc.encode(part.column(1).to_pylist())
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(bounds, np.concatenate(ids))], ["id", "ids"])

    fields = [T.StructField("id", id_type(docs, id_col)), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_col``: the text of the ids; null for null ids, empty for none. An unknown id is an error."""
    text_batches(encoded.sparkSession)
    spec = specification(encoded, tokenizer_path)
    names = [*encoded.columns, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(spec)
        for b in batches:
            column = b.column(ids_col)
            flat, bounds = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [enc.decode(flat[x:y].tolist()) if ok else None for x, y, ok in zip(bounds, bounds[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())]))
