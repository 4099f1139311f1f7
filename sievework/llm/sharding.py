"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, running, written

#: Leading hexadecimal digits of a hash that make its number: 52 bits, which a double holds.
DIGITS = 13


def arrival(key: Column, shard: Column, weight: Column) -> Column:
    """When a key reaches a shard: an exponential time of rate `weight`, from a hash of both. A key belongs to the shard that
    it reaches first, so a shard's share is its weight's, and a shard that comes or goes or changes its weight leaves the
    order of all others as it was."""
    number = F.conv(F.substring(F.md5(F.concat(shard.cast("string"), F.lit(":"), key)), 1, DIGITS), 16, 10).cast("long")
    return -F.ln((number + F.lit(0.5)) / float(1 << 4 * DIGITS)) / weight


def first_of(key: Column, weights: Sequence[float], start: int = 0) -> Column:
    """struct(time, shard) of the shard, numbered from `start`, that the key reaches first; of equal times the lower shard.
    A shard of weight 0 gets nothing."""
    if any(w < 0 for w in weights) or not any(w > 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    shards = F.array(*(F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights, start) if w > 0))
    return F.array_min(F.transform(shards, lambda s: F.struct(arrival(key, s["shard"], s["weight"]).alias("time"), s["shard"].alias("shard"))))


def assign(docs: DataFrame, weights: Sequence[float], added: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes of the text and one), text_crc32, law ("key"), shard, slot, grown_shard.

    The shard is decided by the id and the weights alone; grown_shard is the one after a further shard of weight `added`
    has come, and either the same or that one. Slots number a shard's documents from 0 in order of id, null ids last;
    of equal ids by the text's hash, and equal rows in any order.

    A null text has size 1 and the hash of an empty text. All null ids are one key, and so are repeated ids, whose rows
    share a shard. A row weighs nothing in the law, so a third of all rows under one id makes that shard large; ranges of
    ids, texts and rows are numbered in tasks of their own. An empty table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(
        F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), first_of(key, weights).alias("now"),
        (arrival(key, F.lit(len(weights)), F.lit(float(added))) if added > 0 else F.lit(float("inf"))).alias("new"), F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.select("id", "size", "text_crc32", F.col("now.shard").alias("shard"), F.when(F.col("new") < F.col("now.time"), F.lit(len(weights))).otherwise(F.col("now.shard")).alias("grown_shard"), "row")
    rows = written(rows, "sharded")
    numbered = running(rows, [F.col("shard"), F.col("id").isNull(), F.col("id"), F.col("text_crc32"), F.col("size"), F.col("row")], [], "slots")
    # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slot = (F.col("number") - F.col("base")).cast("long")
    return numbered.join(F.broadcast(bases), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id") -> None:
    """Write the documents, with all their columns, as Parquet below path/shard=K, each shard in ranges of ids in order.

    Many files hold a shard where it is large, and no task has more than a range. Null and repeated ids are as in
    `assign`. The shard's column gets a longer name where the documents have one of that name.
    """
    name = free_name(docs, "shard")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    order = [F.col(name), F.col(id_col)]
    placed = docs.withColumn(name, first_of(key, weights)["shard"])
    placed.repartitionByRange(*order, F.xxhash64(*docs.columns)).sortWithinPartitions(*order).write.partitionBy(name).parquet(path)
