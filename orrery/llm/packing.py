"""Packing of documents into training sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the capacity; full pieces are sequences by themselves.  The remainders are dealt
by row into groups of a bounded number of tokens.  In a group, every piece begins as a partition of its own into as many
windows as the group's tokens need; the two partitions of largest imbalance are merged again and again, the fullest windows
of one with the emptiest of the other, until one partition is left, whose windows are nearly equal.  If a window is over the
capacity, the group is differenced anew with one window more.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table, whole_text
from .tokens import batches_of, chunked

CAPACITY, END = 4096, 2
#: Windows that a group of remainders fills on average: the work and memory of one differencing.
GROUP_WINDOWS = 64


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The places of ``sizes`` in each of ``windows`` windows whose sums are nearly equal."""
    # a partition: its windows that hold anything, fullest first, as (sum less the least sum, places)
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, a = heapq.heappop(heap)
        _, second, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        merged, rest = a[:], []
        for j, (s, places) in enumerate(b):  # the fullest of b meets the emptiest of a
            at = windows - 1 - j
            if at < len(merged):
                merged[at] = merged[at][0] + s, merged[at][1] + places
            else:
                rest.append((s, places))
        merged = sorted(merged + rest, key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == windows else 0
        if least:
            merged = [(s - least, places) for s, places in merged]
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)), min(first, second), merged))
    return [places for _, places in heap[0][2]] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; the fewest that differencing fills without exceeding it, counting up."""
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, n)
        if all(sum(sizes[i] for i in places) <= capacity for places in found):
            return found
        n += 1


def _pieces(path: str, capacity: int, end: int, keep: bool) -> Callable:
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = chunked(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            ids = []
            found = (x for texts in batches_of(batch.column(1)) for x in of.ids(texts))
            for doc, x in zip(batch.column(0).to_pylist(), found, strict=True):
                data = b"".join([*x, last])
                for at in range(0, len(data), capacity * 4):
                    part = data[at:at + capacity * 4]
                    for column, x in zip(rows, (doc, at // 4, len(part) // 4, crc32(part), len(data) // 4), strict=True):
                        column.append(x)
                    if keep:
                        ids.append(np.frombuffer(part, dtype="<u4").astype("int64"))
            arrays = [pa.array(x, pa.int64()) for x in rows[:5]] + ([pa.array(ids, pa.list_(pa.int64()))] if keep else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep else [])])

    return run


def _deal(capacity: int) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        whole = (rows["length"] == capacity).to_numpy()
        small = np.nonzero(~whole)[0]
        found = windows_of(rows["length"].to_numpy()[small].tolist(), capacity) if len(small) else []
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for n, places in enumerate(found):
            at = small[sorted(places)]
            lengths = rows["length"].to_numpy()[at]
            sequence[at], offset[at] = n, np.cumsum(lengths) - lengths
        sequence[whole] = len(found) + np.arange(whole.sum())
        return rows.drop(columns=["uid", "part"]).assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text",
         group_windows: int = GROUP_WINDOWS, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece, and its ids if asked for.

    A null text counts as an empty one; such a document is the single id ``end``.  Rows that repeat are packed each by
    itself.  Sequence ids are unique, not gapless.  Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "packing")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    pieces = rows.mapInArrow(_pieces(path, capacity, end, keep_ids), schema).withColumn("uid", F.monotonically_increasing_id())
    pieces = scratch.save(pieces, "pieces")
    total = pieces.filter(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (capacity * group_windows)))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(_deal(capacity), schema + ", sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
