"""Shard assignment by jump consistent hashing (Lamping and Veach), with DataFrame functions only.

The generator of the published algorithm is a 64-bit linear congruential one. Its products
need 128 bits, so they are taken in DECIMAL(38,0) and reduced modulo 2^64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.common import save, table, text_or_empty

MULTIPLIER = "2862933555777941757"
TWO_64 = "18446744073709551616"
SLOT_GROUPS = 1024  # pieces in which a shard's rows are numbered


def _walk(key: Column, n_shards: int) -> Column:
    """The state (b, j) after the jumps below n_shards; b is the shard, j the next jump's aim.

    About ln n_shards jumps are expected and most keys end within the first fold; the others go on in
    a second one that allows for n_shards of them.
    """
    m, two64 = F.lit(MULTIPLIER).cast("decimal(19,0)"), F.lit(TWO_64).cast("decimal(20,0)")
    start = F.struct(
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        F.pmod(key.cast("decimal(38,0)"), two64).cast("decimal(20,0)").alias("k"),
    )

    def step(s: Column, _: Column) -> Column:
        k = F.pmod(s["k"] * m + F.lit(1).cast("decimal(1,0)"), two64).cast("decimal(20,0)")
        top = F.floor(k / F.lit(2**33).cast("decimal(11,0)")).cast("double") + F.lit(1.0)
        aim = F.floor((s["j"] + 1).cast("double") * (F.lit(float(2**31)) / top)).cast("long")
        return F.when(s["j"] >= n_shards, s).otherwise(F.struct(s["j"].alias("b"), aim.alias("j"), k.alias("k")))

    few = min(n_shards, 2 * n_shards.bit_length() + 4)
    first = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, step)
    if few == n_shards:
        return first
    more = lambda s: F.aggregate(F.sequence(F.lit(few + 1), F.lit(n_shards)), s, step)
    return F.transform(F.array(first), lambda s: F.when(s["j"] >= n_shards, s).otherwise(more(s)))[0]


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard 0..n_shards-1 of an integer key. A null key counts as 0."""
    return _walk(F.coalesce(key.cast("long"), F.lit(0).cast("long")), n_shards)["b"].cast("int")


def jump_hash_grown(key: Column, n_shards: int) -> Column:
    """(shard, grown): the shard among n_shards and among n_shards + 1. The walk for one more
    shard differs only if its next jump aims at the new shard exactly."""
    w = _walk(F.coalesce(key.cast("long"), F.lit(0).cast("long")), n_shards)
    return F.transform(
        F.array(w),
        lambda s: F.struct(
            s["b"].cast("int").alias("shard"),
            F.when(s["j"] == n_shards, F.lit(n_shards)).otherwise(s["b"]).cast("int").alias("grown"),
        ),
    )[0]


def with_shard(df: DataFrame, n_shards: int, key: str = "doc_id", shard: str = "shard", grown: str | None = None) -> DataFrame:
    """df with its shard column(s); a narrow map, no shuffle. Existing columns of these names are replaced.

    Keys that aren't integers are hashed to such first; null keys count as 0. Rows that share a key
    share a shard, whatever else they hold; an empty table gives no rows.
    """
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    number = F.col(key) if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    both = df.withColumn("__jump", jump_hash_grown(number, n_shards))
    both = both.withColumn(shard, F.col("__jump.shard"))
    if grown:
        both = both.withColumn(grown, F.col("__jump.grown"))
    return both.drop("__jump")


def number_rows(df: DataFrame, shard: str = "shard", slot: str = "slot", order: str = "doc_id") -> DataFrame:
    """Gapless numbers from 0 within each shard, without a task that sees a whole shard.

    Rows are dealt to SLOT_GROUPS pieces of each shard by a stored row number, so equal rows
    spread too; a table of (shard, piece) counts, at most n_shards x SLOT_GROUPS rows, gives the
    offsets. df is written once, so that counting and numbering see the same rows.
    """
    kept = save(df.withColumn("__row", F.monotonically_increasing_id()), "slots")
    kept = kept.withColumn("__piece", F.pmod(F.xxhash64("__row"), F.lit(SLOT_GROUPS)))
    before = Window.partitionBy(shard).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy(shard, "__piece").count().select(
        shard, "__piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(shard, "__piece").orderBy(order, "__row")
    numbered = kept.withColumn("__at", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, [shard, "__piece"])
        .withColumn(slot, (F.col("__before") + F.col("__at")).cast("long"))
        .drop("__before", "__at", "__piece", "__row")
    )


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null texts have size 16 and the CRC of no bytes; null ids hash as 0; repeated rows get slots
    of their own; other columns are left out. An empty table gives no rows.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = with_shard(rows, n_shards, grown="grown_shard")
    return number_rows(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
