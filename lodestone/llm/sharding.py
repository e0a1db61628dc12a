"""Shards by weighted rendezvous hashing of a stable record key.

Each shard draws a number from the key's hash with the shard's; the largest of weight / -ln(number) wins. A shard that
is added draws for every key but changes nobody else's number, so it only takes rows into itself, and as many as its
weight asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, global_rank


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """weight / -ln(u), with u in (0, 1) from 52 bits of the MD5 of the key as text, a colon and the shard's number.

    A null key counts as an empty text.
    """
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.lit(float(weight)) / -F.log(u)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The number of the shard with the largest score; ties to the smaller number. A null key is a key like any other."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    return -_best([shard_score(key, k, w) for k, w in enumerate(weights)])["shard"]


def _best(scores: list[Column]) -> Column:
    """(score, minus the number) of the largest score, ties to the smaller number."""
    draws = [F.struct(s.alias("score"), F.lit(-k).alias("shard")) for k, s in enumerate(scores)]
    return draws[0] if len(draws) == 1 else F.greatest(*draws)


def assign(docs: DataFrame, weights: list[float], key_col: str = "doc_id", payload: list[Column] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """(key, payload..., ``shard`` int, ``grown_shard`` int: with one more shard, ``slot`` long: gapless from 0 in a shard).

    An empty table gives an empty result; further columns of any name aren't read. Slots follow the key's order (nulls first, then the payload's order for repeated keys). One row for each row of
    ``docs``. ``payload``: slim columns that travel along; the rows' other columns don't.
    """
    payload = payload or []
    slim = cut(docs.select(F.col(key_col).alias("__key"), *payload))
    names = slim.columns[1:]
    if not weights or any(w <= 0 for w in [*weights, grown_weight]):
        raise ValueError("weights must be positive, one for each shard")
    # the shard that is added changes nobody else's draw, so it wins where its own draw is the largest
    best = _best([shard_score(F.col("__key"), k, w) for k, w in enumerate(weights)])
    drawn = slim.select("*", best.alias("__best"), shard_score(F.col("__key"), len(weights), grown_weight).alias("__new"))
    shard = -F.col("__best.shard")
    rows = drawn.select("__key", *names, shard.cast("int").alias("shard"), F.when(F.col("__new") > F.col("__best.score"), len(weights)).otherwise(shard).cast("int").alias("grown_shard"))
    ranked = global_rank(rows, ["shard"], ["__key", *names], "slot")
    return ranked.select(F.col("__key").alias(key_col), *names, "shard", "grown_shard", "slot")
