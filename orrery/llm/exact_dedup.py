"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed number of UTF-8 bytes.  The distinct blocks are sorted and numbered; then
adjacent numbers are paired, the distinct pairs sorted and numbered, and so on until one number is left of each text.
Two texts end with the same (level, number) if and only if they are equal byte by byte: numbers stand for contents,
not for hashes of them.

A block's content crosses the network once, in the step that finds the distinct blocks.  The numbers go back to the
documents by the block's SHA-256; the numbering step has seen every content, so it knows whether a digest stands for
two contents, and such blocks (none are known) are joined by content.  Hot blocks and hot pairs are reduced before the
shuffle, and the joins read plain tables, whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table, whole_text

#: UTF-8 bytes in a block; the levels are the binary logarithm of the blocks in the longest text.
BLOCK_BYTES = 4096


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row for each block; an empty text has one empty block."""
    return rows.select("doc_id", "sha", F.expr(f"""explode(transform(
        sequence(0, greatest(0, int(ceil(octet_length(raw) / {size})) - 1)),
        i -> struct(i AS pos, substring(raw, i * {size} + 1, {size}) AS block)))""").alias("b")).select(
        "doc_id", "sha", "b.pos", "b.block")


def _numbered(contents: DataFrame, keys: list[str]) -> DataFrame:
    """Integers for distinct contents.  Equal contents share a partition, which is sorted; the integer is the partition and the place in it."""
    return contents.distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(spark: SparkSession, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, sha, level, name) for each distinct (doc_id, text): equal (level, name) means equal text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("raw")).withColumn(
        "sha", F.sha2("raw", 256))
    blocks = _blocks(rows, block_bytes)
    digest = F.unhex(F.sha2("block", 256)).alias("h")
    names = scratch.save(_numbered(blocks.select(digest, "block"), ["block"]).select("h", "name"), "names0")
    twice = names.groupBy("h").count().filter("count > 1").select("h")
    at = blocks.select("doc_id", "sha", "pos", digest)
    level = at.distinct().join(names.join(twice, "h", "left_anti"), "h")
    if twice.limit(1).count():  # contents that share a digest: by content
        shared = blocks.select("doc_id", "sha", "pos", digest, "block").join(twice, "h", "left_semi").distinct()
        top = names.agg(F.max("name")).first()[0]
        own = scratch.save(_numbered(shared.select("block"), ["block"]), "names0-shared")
        level = level.select("doc_id", "sha", "pos", "name").unionByName(
            shared.join(own, "block").select("doc_id", "sha", "pos", (F.col("name") + top + 1).alias("name")))
    level = scratch.save(level.select("doc_id", "sha", "pos", "name"), "level0")
    done, n = [], 0
    while True:
        counted = level.groupBy("doc_id", "sha").agg(F.count("*").alias("n"), F.min("name").alias("name"))
        done.append(counted.filter("n = 1").select("doc_id", "sha", F.lit(n).alias("level"), "name"))
        pairs = level.groupBy("doc_id", "sha", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        more = level.filter("pos > 0").select("doc_id", "sha").distinct()  # texts of several blocks
        pairs = scratch.save(pairs.join(more, pairs["doc_id"].eqNullSafe(more["doc_id"]) & (pairs["sha"] == more["sha"]), "left_semi"), f"pairs{n}")
        if not pairs.limit(1).count():
            break
        n += 1
        names = scratch.save(_numbered(pairs.select("a", "b"), ["a", "b"]), f"names{n}")
        level = scratch.save(pairs.join(names, ["a", "b"]).select("doc_id", "sha", "pos", "name"), f"level{n}")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def dedup_exact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when no byte of them differs; a null text counts as an empty one, and all empty texts are one
    group.  The row with the largest doc_id stays (a null doc_id is the smallest); of rows that repeat both doc_id and
    text, one stays.  Other columns are ignored, whatever their names.  An empty table gives an empty table.
    """
    scratch = Scratch(spark, "exact")
    ids = identities(spark, docs, scratch, id_col, text_col, block_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(whole_text(text_col).cast("binary"), 256).alias("sha")).groupBy(
        "doc_id", "sha").agg(F.count("*").alias("n")).alias("r")
    ids = ids.alias("i")
    named = scratch.save(rows.join(ids, F.col("r.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("r.sha") == F.col("i.sha"))).select(
        "r.doc_id", "r.sha", "n", "level", "name"), "named")
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.expr("explode(sequence(1L, n))").alias("copy"), F.col("sha").alias("text_sha256"), "level", "name").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(spark, table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""
