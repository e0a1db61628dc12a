"""Language identification with a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression.

The kernel of two texts is the number of byte n-grams (every length of ``LENGTHS``) that both contain, counted once
each, over the root of the product of the numbers that each contains. A sample of labelled texts of a stated size is
split into landmarks and the rest; kernel values with the landmarks, made orthonormal, are the features of a ridge
regression for each language against all others.

Scoring: for a batch, the presence matrix X over the landmarks' n-grams times L^T times the coefficients. As the kernel
is an inner product, the product is taken from the right: L^T times the coefficients is made once, and each batch is
one matrix product with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, id_type, text_batches

LENGTHS = (2, 3, 4)
#: Bounds of the sample that the model is fitted on: texts of each language, texts of all, and distinct n-grams of them all.
#: Texts take part whole; beyond the last bound one share of all n-grams, chosen by their hash, stands for them everywhere.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_GRAMS = 300, 8192, 24_000_000
#: Bounds of the model: n-grams of the landmarks, and weights (one for each of them and language). Beyond them the share gets smaller.
VOCABULARY, WEIGHTS = 400_000, 8_000_000
LANDMARKS, RIDGE = 256, 1e-3
_LETTER = regex.compile(r"\p{L}")
_BLOCK, _TEXTS, _BYTES = 1 << 20, 32, 1 << 18


def _codes(b: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of a byte string as numbers; those of different lengths don't clash."""
    code = np.full(max(len(b) - n + 1, 0), n, np.uint64)
    for k in range(n):
        code = code << np.uint64(8) | b[k : k + len(code)]
    return code


def grams(text: bytes) -> np.ndarray:
    """The distinct n-grams of a text as numbers, sorted. Long texts go block by block."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = [np.unique(_codes(b[at : at + _BLOCK + n - 1], n)) for n in LENGTHS for at in range(0, max(len(b) - n + 1, 0), _BLOCK)]
    return np.unique(np.concatenate(out)) if len(out) > len(LENGTHS) else np.concatenate(out) if out else np.zeros(0, np.uint64)


def thinned(codes: np.ndarray, share: float) -> np.ndarray:
    """Which n-grams are of the ``share`` that stands for all; a smaller share is a part of a larger one."""
    if share >= 1:
        return np.ones(len(codes), bool)
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) < np.uint64(int(share * 2**32))


def batch_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of the distinct n-grams of each text, sorted; all texts of a lot are sorted at once."""
    rows, found, at = [], [], 0
    while at < len(texts):
        lot, size = [], 0
        while at < len(texts) and len(lot) < _TEXTS and (not lot or size + len(texts[at]) <= _BYTES):
            lot.append(at)
            size += len(texts[at])
            at += 1
        if len(lot) == 1:
            found.append(grams(texts[lot[0]]))
            rows.append(np.full(len(found[-1]), lot[0]))
            continue
        own = [_codes(np.frombuffer(texts[k], np.uint8).astype(np.uint64), n) | np.uint64((k - lot[0]) << 40) for k in lot for n in LENGTHS]
        code = np.unique(np.concatenate(own))
        rows.append((code >> np.uint64(40)).astype(np.int64) + lot[0])
        found.append(code & np.uint64((1 << 40) - 1))
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # the landmarks' n-grams, sorted
    weights: np.ndarray  # n-grams x languages: L^T times the coefficients
    bias: np.ndarray
    share: float = 1.0  # of all n-grams that are looked at

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages: for a lot of texts the product of their presence matrix with ``weights``."""
        out = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(texts), _TEXTS):
            lot = texts[lo : lo + _TEXTS]
            row, gram = batch_grams(lot)
            if self.share < 1:
                of = thinned(gram, self.share)
                row, gram = row[of], gram[of]
            at = np.minimum(np.searchsorted(self.vocabulary, gram), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == gram
            presence = np.zeros((len(lot), len(self.vocabulary)))
            presence[row[known], at[known]] = 1.0
            size = np.bincount(row, minlength=len(lot))
            out[lo : lo + len(lot)] = presence @ self.weights / np.sqrt(np.maximum(size, 1))[:, None]
        return out + self.bias

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The best language of each text, ties to the first by name, and a share of the softmax of ten times the scores."""
        s = self.scores(texts)
        best = s.argmax(axis=1)
        e = np.exp(10 * (s - s.max(axis=1, keepdims=True)))
        return [self.languages[k] for k in best], e[np.arange(len(s)), best] / e.sum(axis=1)


def presence_kernel(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Kernel values of n-gram sets, as a product of presence matrices over the columns' n-grams, block by block."""
    vocabulary = np.unique(np.concatenate(columns))
    norm = lambda sets: np.sqrt(np.array([max(len(x), 1) for x in sets]))
    x_at, y_at = ([np.searchsorted(vocabulary, s)[np.isin(s, vocabulary, assume_unique=True)] for s in sets] for sets in (rows, columns))
    out = np.zeros((len(rows), len(columns)))

    def presence(places: list[np.ndarray], lo: int, n: int) -> np.ndarray:
        part = np.zeros((len(places), n), np.float32)
        for k, at in enumerate(places):
            a, b = np.searchsorted(at, [lo, lo + n])
            part[k, at[a:b] - lo] = 1
        return part

    for lo in range(0, len(vocabulary), 1 << 13):
        n = min(1 << 13, len(vocabulary) - lo)
        out += presence(x_at, lo, n) @ presence(y_at, lo, n).T
    return out / norm(rows)[:, None] / norm(columns)[None, :]


@dataclass
class Sample:
    """(language, n-grams as bytes) of whole texts, of which the n-grams of ``share`` are there."""

    rows: list[tuple[str, bytes]]
    share: float = 1.0


def train(labelled: Sample | list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``labelled``: a sample, or (language, text) in any order; sorted here, so the same sample gives the same model."""
    if not isinstance(labelled, Sample):
        labelled = Sample([(lang, grams(x.encode()).tobytes()) for lang, x in labelled])
    rows, share = sorted(set(labelled.rows)), labelled.share
    languages = sorted({x for x, _ in rows})
    sets = [np.frombuffer(x, np.uint64) for _, x in rows]
    by_language: dict[str, list[int]] = {}
    for k, (lang, _) in enumerate(rows):
        by_language.setdefault(lang, []).append(k)
    each = max(1, landmarks // max(len(languages), 1))
    chosen = [k for lang in languages for own in [by_language[lang]] for k in own[:: max(1, len(own) // each)][:each] if len(sets[k])]
    if not chosen:
        return Model(languages, np.zeros(1, np.uint64), np.zeros((1, max(len(languages), 1))), np.zeros(max(len(languages), 1)))
    chosen = chosen[:: -(-len(chosen) // max(landmarks, 1))]  # more languages than landmarks: those in between have none of their own
    while (size := len(np.unique(np.concatenate([sets[k] for k in chosen])))) > (most := min(VOCABULARY, max(WEIGHTS // len(languages), 1))):
        share *= most / size * 0.98
        sets = [s[thinned(s, share)] for s in sets]
    marks = [sets[k] for k in chosen]
    among, vectors = np.linalg.eigh(presence_kernel(marks, marks))
    keep = among > 1e-8 * among.max()
    root = vectors[:, keep] / np.sqrt(among[keep])  # K^-1/2 on the landmarks' span
    x = presence_kernel(sets, marks) @ root
    of = np.array([languages.index(lang) for lang in by_language for _ in by_language[lang]])
    order = np.array([k for lang in by_language for k in by_language[lang]])
    balance = np.array([1.0 / len(by_language[lang]) for lang, _ in rows])[:, None]
    xc = x - (x * balance).sum(0) / balance.sum()
    # a target is 1 for its own language and -1 for the others; as the weighted rows sum to zero, sums by language say all
    sums = np.zeros((len(languages), x.shape[1]))
    np.add.at(sums, of, (xc * balance)[order])
    mean_y = np.full(len(languages), 2.0 / len(languages) - 1)
    w = np.linalg.solve((xc * balance).T @ xc + ridge * np.eye(x.shape[1]), 2 * sums.T)
    coefficients = root @ w / np.sqrt([[max(len(s), 1)] for s in marks])
    vocabulary = np.unique(np.concatenate(marks))
    weights = np.zeros((len(vocabulary), len(languages)))
    for s, c in zip(marks, coefficients, strict=True):
        weights[np.searchsorted(vocabulary, s)] += c
    return Model(languages, vocabulary, weights, mean_y - (x * balance).sum(0) / balance.sum() @ w, share)


def sample(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL, most: int = SAMPLE_GRAMS) -> Sample:
    """The n-grams of at most ``rows`` different whole texts of each language, those with the smallest hashes.

    Copies of a text are one text before any is chosen, so every language with a text takes part, however often or seldom
    and however long its texts are. Many languages share ``total`` texts, one at least for each; of more labels than
    ``total`` those with most texts take part. The n-grams are taken on the executors; of more than ``most`` a share of about that many,
    chosen by hash, reaches the driver, and no text does.
    """
    spark = docs.sparkSession
    own = docs.filter(usable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    own = own.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    counts = own.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(total)
    known = [r["lang"] for r in counts.select("lang").collect()]
    if not known:
        return Sample([])
    each = max(1, min(rows, total // len(known)))
    first = Window.partitionBy("lang").orderBy("h")  # every task keeps the smallest ones of its own before rows travel
    ranked = own.select("lang", "h").join(F.broadcast(counts.select("lang")), "lang", "left_semi").distinct().withColumn("r", F.row_number().over(first))
    chosen = F.broadcast(ranked.filter(F.col("r") <= each).select("lang", "h"))  # ``total`` rows at most
    texts = own.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [grams(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["lang", "grams"])

    text_batches(spark)
    lang = T.StructField("lang", docs.schema[lang_col].dataType)
    sets = cut(texts.mapInArrow(run, T.StructType([lang, T.StructField("grams", T.BinaryType())])))
    size = sets.agg(F.sum(F.octet_length("grams"))).first()[0] // 8
    share = min(1.0, most / max(size, 1))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [s[thinned(s, share)].tobytes() for x in b.column(1) for s in [np.frombuffer(x.as_py(), np.uint64)]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], ["lang", "grams"])

    sent = sets if share >= 1 else sets.mapInArrow(part, sets.schema)
    return Sample([(r["lang"], bytes(r["grams"])) for r in sent.collect()], share)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(``id_col``, ``keep`` columns, lang_pred, score 0 to 1): a row for each row of ``docs``, from its whole text alone.

    ``und`` and score 0 where the text is null, empty or has no letter, or where no language was learned. Null ids and
    repeated rows stay; columns outside ``keep`` aren't read, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    keep = keep or []
    shared = spark.sparkContext.broadcast(model)  # bounded by VOCABULARY and WEIGHTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [x.as_py() for x in b.column(0)]
            usable = [k for k, x in enumerate(texts) if m.languages and x and _LETTER.search(x)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if usable:
                best, share = m.predict([texts[k].encode() for k in usable])
                for k, x in zip(usable, best, strict=True):
                    lang[k] = x
                score[usable] = share
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score)], ["id", *(f"k{k}" for k in range(len(keep))), "lang_pred", "score"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)])
    fields = [T.StructField("id", id_type(docs, id_col)), *(T.StructField(f"k{k}", docs.schema[c].dataType) for k, c in enumerate(keep))]
    out = rows.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the checksum of the id as text leaves 2 when divided by four; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
