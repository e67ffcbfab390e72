"""Sharding by weighted rendezvous hashing.

Every (record key, shard) pair gets a uniform number u from a 64-bit hash, and the record goes to the shard with the
largest weight / -ln(u).  A shard's score for a key depends on no other shard, so an added shard takes records only into
itself (about its share of the weights) and a removed one gives its records to the rest.

Defined results: a null text counts as empty where sizes are taken; a null key is a key like others (all such rows share a shard); equal keys share a shard; shards of
weight 0 take nothing; an empty table gives an empty table; all columns of the input are kept, but one with the output
column's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import ranked


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) of a key among ``len(weights)`` weighted shards, by built-in functions alone."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be at least 0, one of them above")
    table = F.array(*[F.struct(F.lit(shard).alias("shard"), F.lit(float(weight)).alias("weight")) for shard, weight in enumerate(weights) if weight > 0])

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.log(u) / s["weight"]).alias("score"), s["shard"].alias("shard"))

    return F.array_max(F.transform(table, score))["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row: a projection, without shuffle or state, that runs the same anywhere."""
    return df.withColumn(column, shard_of(F.col(key), weights))


def shard_slots(sharded: DataFrame, columns: list[str], shard: str = "shard") -> DataFrame:
    """(``columns``, ``shard``, slot): a gapless position from 0 of each row in its shard, in an order of hashes."""
    return ranked(sharded.select(shard, *columns), [shard], columns, "slot")
