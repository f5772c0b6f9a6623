"""Line dedup by pairwise alignment.

Documents are linked by the hashes of lines and of short runs of lines: each links every later document to the first that
holds it, so links grow with the lines of the input and not with the square of a line's holders, and no line has to be left
out for being frequent.  Each linked pair is aligned by patience diff, and common blocks of enough words, unbroken in both,
are deleted from the later document; blocks that stand in another order are found by their runs.

A run is the fewest adjacent lines that have enough words, from each line on and up to each line.  Every common block of
enough words consists of such runs, so a line goes if and only if it lies in a block that some earlier document holds, even
if each line of the block has its first use elsewhere.

What crosses the network for linking and aligning are digests of lines.  Documents are ordered by id, then by digest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

#: Words that a block of deleted lines has at least.
MIN_WORDS = 5
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _uses(items: list) -> list[tuple]:
    """Each item with the number of its use so far."""
    n: Counter = Counter()
    out = []
    for x in items:
        n[x] += 1
        out.append((x, n[x]))
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of equal items, by patience diff: ends first, then unique common items in order, then between them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {(x, 1): i for i, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        if not where:  # no item is unique: the first use here meets the first use there, and so on
            where = {x: i for i, x in enumerate(_uses(b[b0:b1]), b0) if x[0] in in_a}
        common = [(i, where[x]) for i, x in enumerate(_uses(a[a0:a1]), a0) if x in where]
        tails: list[int] = []  # of the longest increasing runs of places in b, by length
        ends: list[int] = []
        back = [-1] * len(common)
        for k, (_, j) in enumerate(common):
            n = bisect_left(tails, j)
            if n == len(tails):
                tails.append(j)
                ends.append(k)
            else:
                tails[n], ends[n] = j, k
            back[k] = ends[n - 1] if n else -1
        k, anchors = ends[-1] if ends else -1, []
        while k >= 0:
            anchors.append(common[k])
            k = back[k]
        last = (a0, b0)
        for i, j in reversed(anchors):
            todo.append((last[0], i, last[1], j))
            out.append((i, j))
            last = (i + 1, j + 1)
        if anchors:
            todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words_a: list[int], words_b: list[int], min_words: int) -> list[int]:
    """Places in ``b`` of blocks, unbroken in both, that have enough words: those that one alignment finds, then moved ones."""
    out: set[int] = set()
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-4, -4)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words_b[x] for x in block) >= min_words:
                out.update(block)
            block = []
        block.append(j)
        last = (i, j)
    in_a = set(a)
    left = [j for j, x in enumerate(b) if j not in out and x in in_a]
    out.update(j for j in left if words_b[j] >= min_words)
    if any(j not in out for j in left):
        there = set(runs(np.array(a, dtype=np.int64).view(np.uint64)[:, None], words_a, min_words)[0])
        for x, i, j in zip(*runs(np.array(b, dtype=np.int64).view(np.uint64)[:, None], words_b, min_words), strict=True):
            if x in there:
                out.update(range(int(i), int(j)))
    return sorted(out)


def _align(min_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], []]
            for dig, *pair in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if places := common_blocks(*pair, min_words):
                    for column, x in zip(rows, (dig, places), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.binary(), pa.list_(pa.int32())), strict=True)], names=["dig", "places"])

    return run


def runs(digests: np.ndarray, words: list[int], min_words: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Hash, start and stop of the shortest runs of two or more lines with enough words, from each line on and up to each line.

    ``digests`` has a row for each line, of one or two 64-bit parts; the hashes have as many.
    """
    size = len(words)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    stop = np.searchsorted(total, total[:-1] + min_words, "left")
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    at = np.arange(size)
    found = np.concatenate([np.stack([at, stop], 1)[stop <= size], np.stack([start, at + 1], 1)[start >= 0]])
    found = np.unique(found[found[:, 1] - found[:, 0] > 1], axis=0)
    start, stop = found[:, 0], found[:, 1]
    if not len(found):
        return [], start, stop
    hashed = []
    with np.errstate(over="ignore"):
        for part, base in zip(digests.T, _BASES, strict=False):  # sums of digests times powers of a base; a run's is moved to power 0 by the inverse
            power, back = (np.cumprod(np.array([1] + [b] * size, dtype=np.uint64), dtype=np.uint64) for b in (base, pow(base, -1, 2**64)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[:-1], dtype=np.uint64)])
            hashed.append((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))
    return [x.tobytes() for x in np.stack(hashed, 1)], start, stop


def _runs(min_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, digs, found = [], [], []
            for doc, dig, digests, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(words) > 1:
                    new = set(runs(np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2), words, min_words)[0])
                    found += new
                    docs += [doc] * len(new)
                    digs += [dig] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(digs, pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "dig", "h"])

    return run


def _digest(id_col: str, text_col: str):
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit(""))).cast("binary")))


def deletions(spark: SparkSession, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(dig, places): the lines to delete, from 0, of each document that loses any."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(id_col, text_col).alias("dig"), F.split(F.coalesce(text_col, F.lit("")), "\n", -1).alias("l"))
    rows = rows.select("doc_id", "dig", F.transform("l", lambda x: F.trim(x)).alias("l"))
    rows = rows.select("doc_id", "dig", F.transform("l", lambda x: F.unhex(F.md5(x.cast("binary")))).alias("h"), F.transform("l", lambda x: F.xxhash64(x)).alias("k"),
                       F.transform("l", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+", -1)))).alias("n"))
    rows = scratch.save(rows.dropDuplicates(["dig"]), "documents")  # rows that repeat both id and text are one document
    # lines of enough words by themselves, and runs
    lines = rows.select("doc_id", "dig", F.explode(F.array_distinct(F.filter(F.arrays_zip("h", "n"), lambda x: x["n"] >= min_words))).alias("x")).select("doc_id", "dig", "x.h")
    series = rows.select("doc_id", "dig", "h", "n").mapInArrow(_runs(min_words), "doc_id long, dig binary, h binary")
    keys = scratch.save(lines.unionByName(series), "keys")
    held = keys.groupBy("h").agg(F.count("*").alias("df"), F.min(F.struct("doc_id", "dig")).alias("first")).filter("df > 1").select("h", F.col("first.dig").alias("first"))
    held = scratch.save(held, "held")
    pairs = scratch.save(keys.join(held, "h").filter("dig <> first").select("dig", "first").distinct(), "pairs")
    scratch.drop("keys", "held")
    of = rows.select(F.col("dig").alias("first"), F.col("k").alias("first_k"), F.col("n").alias("first_n"))
    both = pairs.join(of, "first").join(rows.select("dig", "k", "n"), "dig").select("dig", "first_k", "k", "first_n", "n")
    found = scratch.save(both.mapInArrow(_align(min_words), "dig binary, places array<int>"), "found")
    return scratch.save(found.groupBy("dig").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")), "deletions")


def _rewrite(text: int, length: int | None, schema: pa.Schema | None = None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[:-1])
            texts = columns[text].to_pylist()
            lengths = columns[length].to_pylist() if length is not None else []
            changed = False
            for i, places in enumerate(b.column(b.num_columns - 1)):
                if places.is_valid:
                    gone = set(places.as_py())
                    texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in gone])
                    if lengths:
                        lengths[i] = len(texts[i])
                    changed = True
            if changed:
                columns[text] = pa.array(texts, columns[text].type)
                if length is not None:
                    columns[length] = pa.array(lengths, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return run


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with all their columns and without the lines that an earlier document holds.

    Lines are compared without the white space around them.  Blank lines link nothing and are deleted only within a
    common block.  Earlier is the smaller id (null first), then the smaller digest; rows that repeat both id and text are
    one document and are edited alike.  A line goes if it lies in a run of lines that has ``min_words`` words and that an
    earlier document holds unbroken, whatever the number of holders.  A document that loses all its lines stays, with an
    empty text; a null text stays null.  ``n_chars``, where there is one, follows where a text changes.  An empty table gives an empty one.
    """
    scratch = Scratch(spark, "lines")
    gone = deletions(spark, docs, scratch, id_col, text_col, min_words)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    marked = rows.withColumn("_dig", _digest(at[id_col], at[text_col])).join(gone.select(F.col("dig").alias("_dig"), F.col("places").alias("_places")), "_dig", "left").select(*names, "_places")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return marked.mapInArrow(_rewrite(docs.columns.index(text_col), length), rows.schema).toDF(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines and bytes that are left, and the SHA-256 of what is left (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
