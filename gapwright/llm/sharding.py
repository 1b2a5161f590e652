"""Sharding by weighted rendezvous hashing of stable record keys.  DataFrame functions only.

Every record scores every shard with a hash of (key, shard) and takes the highest, so the shard depends on the key and
the shard list alone; a new shard takes records only into itself.  With u the hash as a number in (0, 1) the score of a
shard of weight w is ``w / -ln(u)``, which gives it a share of w / sum of weights.

Slots number the records of each shard from 0 without gaps: records are counted in cells of one shard and one range of
ids, the counts are summed up, and each cell numbers its own records.  No task sees a whole shard.

A null id hashes as the empty string and sorts first; null texts have size 1; repeated rows get slots of their own; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwright.session import cut_lineage

def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash of key and shard."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def score(key: Column, shard: int, weight: float) -> Column:
    """Rendezvous score of a shard for ``key``."""
    return F.lit(float(weight)) / -F.log(uniform(key, shard))


def winner(key: Column, weights: list[float]) -> Column:
    """Struct (v: best score, s: minus the number of its shard); the lower number wins a tie."""
    each = [F.struct(score(key, s, w).alias("v"), F.lit(-s).alias("s")) for s, w in enumerate(weights) if w > 0]
    return F.greatest(*each) if len(each) > 1 else each[0]


def assign(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, grown_shard (with one more shard of mean weight)."""
    new, mean = len(weights), sum(weights) / len(weights)
    scored = (docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__t"))
              .select("__id", (F.octet_length("__t") + 1).cast("long").alias("size"), F.crc32("__t").alias("text_crc32"),
                      winner(F.col("__id"), weights).alias("__best")))
    shard = -F.col("__best.s")
    takes = score(F.col("__id"), new, mean) > F.col("__best.v")
    return scored.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), shard.cast("int").alias("shard"),
                         F.when(takes, F.lit(new)).otherwise(shard).cast("int").alias("grown_shard"))


def numbered(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard, in order of id, crc and size.

    Rows are dealt by ranges of that order (the running row id splits an id that many rows repeat), counted per
    (shard, range) and numbered inside it.
    """
    order = [id_col, "text_crc32", "size"]
    dealt = cut_lineage(rows.withColumn("__m", F.monotonically_increasing_id())
                        .repartitionByRange(*order, "__m").withColumn("__cell", F.spark_partition_id()))
    sums = dealt.groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    inner = Window.partitionBy("shard", "__cell").orderBy(*order, "__m")
    return (dealt.withColumn("__r", F.row_number().over(inner) - 1).join(starts, ["shard", "__cell"])
            .withColumn("slot", (F.col("__at") + F.col("__r")).cast("long")).drop("__cell", "__at", "__r", "__m"))


def shard_documents(docs: DataFrame, shards: int = 16, weights: list[float] | None = None,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole placement of ``docs`` over ``shards`` shards of equal weight, or over weighted ones."""
    out = numbered(assign(docs, weights or [1.0] * shards, id_col, text), id_col)
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
