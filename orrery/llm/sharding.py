"""Shards by jump consistent hashing (Lamping and Veach, 2014).

A row's key is 60 bits of the MD5 of its id; the shard follows from the key and the number of shards alone, so no ring
or table of shards is kept, and one more shard takes rows only into itself.  The 64-bit generator of the method runs on
two 32-bit halves, since SQL arithmetic raises an error where 64 bits overflow.

Places within a shard ("slots") run without gaps: rows are ranked within (shard, bucket), where the bucket is part of
the key, and the sizes of the buckets before are added.  So no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, whole_text

#: Buckets in which a shard's rows are ranked; the table of bucket sizes has shards x BUCKETS rows, whatever the input.
BUCKETS = 256
SHARDS = 40

# 2862933555777941757 = _CH * 2^32 + _C1 * 2^16 + _C0
_C = 2862933555777941757
_CH, _C1, _C0 = _C >> 32, (_C >> 16) & 0xFFFF, _C & 0xFFFF


def key60(column: str) -> Column:
    """The first 60 bits of the MD5 of the id as text; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def jump_hash(key: str, shards: int) -> Column:
    """The shard, from 0, of a 60-bit non-negative long in the column ``key``."""
    if shards < 1:
        raise ValueError("at least one shard")
    step = f"""CASE WHEN s.j >= {shards} THEN s ELSE named_struct(
        'hi', ((s.lo * {_CH}L & 4294967295L) + ((s.hi * {_C0}L + shiftleft(s.hi * {_C1}L & 65535L, 16)) & 4294967295L)
               + shiftright(s.lo * {_C0}L + 1L + shiftleft(s.lo * {_C1}L & 65535L, 16), 32) + shiftright(s.lo * {_C1}L, 16)) & 4294967295L,
        'lo', (s.lo * {_C0}L + 1L + shiftleft(s.lo * {_C1}L & 65535L, 16)) & 4294967295L,
        'b', s.j, 'j', s.j) END"""
    jump = f"""CASE WHEN t.b < t.j OR t.j >= {shards} THEN t ELSE named_struct('hi', t.hi, 'lo', t.lo, 'b', t.b,
        'j', CAST(floor((t.b + 1) * (2147483648D / (shiftright(t.hi, 1) + 1))) AS BIGINT)) END"""
    # every step raises j, so that as many steps as shards are enough
    return F.expr(f"""aggregate(sequence(1, {shards + 1}),
        named_struct('hi', shiftright({key}, 32), 'lo', {key} & 4294967295L, 'b', -1L, 'j', 0L),
        (s, i) -> transform(array({step}), t -> {jump})[0], s -> CAST(s.b AS INT))""")


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
               keep_text: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    The law is ``key``: the id and the number of shards decide.  Rows that repeat an id share its shard and have slots
    of their own; a null id is one more key; a null text has no bytes (size 16, CRC of nothing, 0), an empty one the
    same.  Ties in a bucket are ranked by id, then CRC, then size.  Other columns are ignored.
    """
    text = [F.col(text_col).alias("text")] if keep_text else []
    rows = docs.select(F.col(id_col).alias("doc_id"), key60(id_col).alias("key"), (F.octet_length(whole_text(text_col)) + F.lit(16)).cast("long").alias("size"),
                       F.crc32(whole_text(text_col).cast("binary")).alias("text_crc32"), *text)
    rows = rows.withColumns({"shard": jump_hash("key", shards), "grown_shard": jump_hash("key", shards + 1), "bucket": (F.col("key") % buckets).cast("int")})
    w = Window.partitionBy("shard", "bucket")
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy("doc_id", "text_crc32", "size")))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    placed = ranked.join(F.broadcast(before), ["shard", "bucket"])  # shards x buckets rows at most
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"), "grown_shard",
                         *(["text"] if keep_text else []))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **columns: str) -> None:
    """The shards as folders ``shard=N`` of Parquet files, ordered by slot within each file."""
    rows = shard_rows(docs, shards, keep_text=True, **columns)
    rows.repartition("shard", (F.col("slot") / 100_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))

