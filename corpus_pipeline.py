"""From raw documents to packed sequences, in five stages that each take what the one before kept.

Each stage but the last returns the columns of documents; each is written as Parquet and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, nearcopies, packing, pii, substrings
from lodestone.llm.common import cut, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language has a smaller score are rejected; so are those without letters.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that is told with some confidence, and that language as ``lang``.

    Null and empty texts and those without letters go. Where no language can be learned, the documents with letters stay.
    """
    model = language.train(language.sample(docs, ~language.held_out()))
    found = language.identify(docs, model, keep=["text", "lang", "source", "n_chars"])
    if not model.languages:
        return found.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    sure = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return sure.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: the document with the smallest id, or one without an id where the group has no other.

    Near copies share 0.8 of their five-word shingles. Null and empty texts are one group. Rows that repeat an id go like any others.
    """
    return nearcopies.first_of_groups(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; documents with nothing left go. Those without an id come last, in the order of a hash."""
    ids = docs.agg(F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    last = -1 if ids["last"] is None else ids["last"]
    room = min(1 << 62, (1 << 63) - 2 - last) if ids["none"] else 0
    if room > 0:
        docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(last + 1) + F.pmod(F.xxhash64("text"), F.lit(room))))
    found = substrings.dedup(docs, keep=["lang", "source"])
    if room > 0:
        found = found.withColumn("doc_id", F.when(F.col("doc_id") <= last, F.col("doc_id")))
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that give it away generalised."""
    found = pii.sanitise(docs, keep=["lang", "source"])
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeated_passages),
    ("personal data", remove_personal_data),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokens; the tests hold the stages' operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
