"""Near duplicates by order MinHash, verified by banded alignment.

A text is its words: lower case, letters, digits and underscores.  Its k-mers of five words are labelled by occurrence, so
that the second use of a k-mer is another element than the first.  For each of several hash functions the sketch takes the
LENGTH k-mers of least hash and keeps them in the order of the text; texts that are alike in edit distance share such an
ordered tuple with a probability that grows with their likeness.  Texts that share a tuple are candidates.

Recall is that of one shared tuple in SKETCHES: a pair whose words are changed one by one, evenly, keeps few k-mers of five
words, about a fifth at similarity 0.8.  Measured on texts of 150 and 400 words with words replaced at random, more than
0.9 of pairs share a tuple at similarity 0.8 and nearly all from 0.85 up; of texts of 30 to 60 words about 0.8 at 0.8
(tests/llm measures it on planted pairs of 200 words).  Edits that stand together cost fewer k-mers.

Candidates are verified by a banded alignment of their words: similarity is 1 - edit distance / longer length, and 0.8 or
more makes a link; the band is as wide as such a distance allows.  Classes are the connected components of links.

Equal texts are one node throughout.  Each node is first compared with the least of all members of like length in its
buckets, then with the least members of the buckets where it lies in another component, so that n near copies cost about
n comparisons.  Buckets whose members then still lie in several components are compared exhaustively: each member outside the
component of the bucket's least one with all members of other components, in the first bucket that both share, where their
words do not differ too much for the similarity: each word, with the number of its use, sets one of BITS bits, and each bit
that only one text has takes an edit.  Words of long texts often meet in a bit, so pairs that pass are counted again by the
uses of their words among USES.  So every pair that shares a tuple is either compared or already joined, or cannot be alike,
and no cap drops any.  Texts that share a long passage and little else meet in such a bucket pair by pair; bits and uses
refuse most of these pairs within the join.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

K, SIMILARITY = 5, 0.8
#: Hash functions, and k-mers that each picks.
SKETCHES, LENGTH = 80, 2
#: Bits by hash that a text's words set.
BITS = 2048
#: Values by hash that the uses of words have; one takes two bytes.
USES = 2**16
_WORDS = re.compile(r"\w+").findall
_MIX = np.random.default_rng(20240501).integers(1, 2**31, size=(2, SKETCHES), dtype=np.uint32) | np.uint32(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Hash functions that are worked out at once.
_ROWS = 8


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


class _Hashes:
    """64-bit hashes of words; the table starts anew when it is full."""

    def __init__(self, size: int = 400_000):
        self.size, self.kept = size, {}

    def new(self, word: str) -> int:
        if len(self.kept) >= self.size:
            self.kept.clear()
        h = self.kept[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def of(self, found: list[str]) -> np.ndarray:
        get, new = self.kept.get, self.new
        return np.array([get(w) or new(w) for w in found], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers, in order; fewer words than k make one k-mer."""
    if not len(h):
        return h
    k = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            out = out * _BASE + h[i:len(h) - k + 1 + i]
        out = _mixed(out)
        order = np.argsort(out, kind="stable")
        first = np.concatenate([[True], out[order][1:] != out[order][:-1]])
        starts = np.nonzero(first)[0]
        label = np.empty(len(out), dtype=np.uint64)
        label[order] = (np.arange(len(out)) - np.repeat(starts, np.diff(np.append(starts, len(out))))).astype(np.uint64)
        out = _mixed(out + label * _BASE)
    return out


def sketch(x: np.ndarray) -> np.ndarray:
    """For each hash function a hash of the chosen k-mers in text order."""
    low = (x >> np.uint64(32)).astype(np.uint32)
    at = np.empty((LENGTH, SKETCHES), dtype=np.int64)
    rows, largest = np.arange(_ROWS), np.uint32(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for f in range(0, SKETCHES, _ROWS):
            h = low[None, :] * _MIX[0][f:f + _ROWS, None] + _MIX[1][f:f + _ROWS, None]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x9E3779B1)
            for i in range(LENGTH):
                at[i, f:f + _ROWS] = best = h.argmin(1)
                h[rows, best] = largest
        at.sort(0)
        out = np.arange(SKETCHES, dtype=np.uint64)
        for row in at:
            out = _mixed(out * _BASE + x[row])
    return out.view(np.int64)


def bits(h: np.ndarray) -> np.ndarray:
    """The bits that words, each with the number of its use, set; two texts differ by an edit at least for each that one has alone."""
    out = np.zeros(BITS, dtype=np.uint8)
    out[(kmers(h, 1) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def uses(h: np.ndarray) -> np.ndarray:
    """What ``bits`` says, of USES bits, as the numbers of those set."""
    return np.unique((kmers(h, 1) % np.uint64(USES)).astype(np.uint16)).view(np.int16)


@lru_cache(maxsize=64)
def _counted(text: str) -> tuple[list[str], Counter]:
    found = words(text)
    return found, Counter(found)


def alike(x: str, y: str, least: float = SIMILARITY) -> bool:
    """Whether two texts' words are so alike; most that are not differ in their counts of words already."""
    (a, in_a), (b, in_b) = _counted(x), _counted(y)
    longer = max(len(a), len(b))
    room = longer - int((1 - least) * longer + 1e-9)  # words that must be common
    if min(len(a), len(b)) < room or sum((in_a & in_b).values()) < room:
        return False
    return edit_similarity(a, b, least) >= least


def edit_similarity(a: list[str], b: list[str], least: float = SIMILARITY) -> float:
    """1 - edit distance / longer length, exact where it is ``least`` or more, else 0; texts without words are alike."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    band = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > band:
        return 0.0
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    d = max(len(a), len(b)) if not a or not b else _banded(a, b, band)
    return 1 - d / longer if d <= band else 0.0


def _banded(a: list[str], b: list[str], band: int) -> int:
    """Edit distance by bit-parallel rows; matches outside the band are masked, so it is exact up to ``band``."""
    n = len(a)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, last = (1 << n) - 1, 1 << n - 1
    plus, minus, d = every, 0, n
    window = (1 << 2 * band + 1) - 1
    for j, x in enumerate(b):
        eq = at.get(x, 0)
        if eq:
            eq &= window << j - band if j >= band else window >> band - j
        eq |= minus
        d0 = (((eq & plus) + plus) ^ plus | eq) & every
        up, down = minus | every & ~(d0 | plus), d0 & plus
        if up & last:
            d += 1
        elif down & last:
            d -= 1
        up = (up << 1 | 1) & every
        down = down << 1 & every
        plus, minus = down | every & ~(d0 | up), d0 & up
    return d


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for b in batches:
        n, bags, sketches = [], [], []
        for t in b.column(2):
            found = words(t.as_py())
            n.append(len(found))
            h = hashes.of(found)
            bags.append(bits(h))
            sketches.append(sketch(kmers(h)) if found else [])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(bags, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "bits", "sketch"])


def _used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([uses(hashes.of(words(t.as_py()))) for t in b.column(1)], pa.list_(pa.int16()))], names=["vid", "uses"])


def _verify(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, x, y = b.columns
            keep = [alike(s.as_py(), t.as_py(), least) for s, t in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a, c], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(vid, comp): the least vid of its component, for each vid that an edge (a, b) touches."""
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = scratch.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("vid"), F.least("a", "b").alias("comp")), f"{name}-0")
    i = 0
    while True:
        i += 1
        near = both.join(label.withColumnRenamed("vid", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = scratch.save(label.join(near, label["vid"] == near["a"]).select("vid", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")), f"{name}-step{i}")
        jump = step.select(F.col("vid").alias("comp"), F.col("comp").alias("further"))
        moved = step.join(jump, "comp", "left").select("vid", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "old")
        moved = scratch.save(moved, f"{name}-{i}")
        label = moved.select("vid", "comp")
        scratch.drop(f"{name}-step{i}", f"{name}-{i - 1}")
        if not moved.filter("comp <> old").limit(1).count():
            return label


def merged(comp: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``comp`` (vid, comp) after further links (a, b) between its vids or new ones; only components that the links join are walked anew."""
    if comp is None:
        return components(links, scratch, name)
    ends = links.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    grown = components(ends.filter("a <> b"), scratch, name).toDF("comp", "root")
    fresh = grown.select(F.col("comp").alias("vid")).join(comp, "vid", "left_anti").select("vid", F.col("vid").alias("comp"))
    return scratch.save(comp.unionByName(fresh).join(grown, "comp", "left").select("vid", F.coalesce("root", "comp").alias("comp")), f"{name}-all")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def _apart(one: str, other: str) -> Column:
    """The bits that only ``one`` has."""
    return reduce(add, (F.bit_count(F.col(one)[i].bitwiseAND(F.bitwise_not(F.col(other)[i]))) for i in range(BITS // 64)))


def classify(spark: SparkSession, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The rows as (uid, doc_id, key), and (key, class_id, class_size, keep_uid, links) for each distinct key, the digest of a text."""
    rows = _keyed(docs, id_col, text_col)
    signed = rows.mapInArrow(_signed, "doc_id long, key binary, n int, bits array<bigint>, sketch array<bigint>")
    signed = scratch.save(signed.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "key", "n", "bits", "sketch"), "signed")
    # nodes: distinct texts, each with its least document
    order = F.struct("doc_id", "uid")
    nodes = signed.groupBy("key").agg(F.min(order).alias("top"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("n", "bits", "sketch")])
    nodes = scratch.save(nodes.select("key", F.col("top.doc_id").alias("doc_id"), F.col("top.uid").alias("uid"), "copies", F.monotonically_increasing_id().alias("vid"), "n", "bits", "sketch"), "nodes")
    members = nodes.select("vid", "n", F.explode("sketch").alias("sig"))
    shared = scratch.save(members.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1").select("sig"), "shared")
    buckets = members.join(shared, "sig").withColumn("size", F.floor(F.log("n") / F.log(F.lit(1 / similarity))).cast("int"))
    buckets = scratch.save(buckets.select("sig", "vid", "n", "size"), "buckets")
    scratch.drop("shared")
    like = (F.least("n", "m") >= F.greatest("n", "m") * similarity)
    # texts of the nodes that share a bucket; rows that repeat id and text give a text twice, and its links are made distinct
    wanted = scratch.save(buckets.select("vid").distinct().join(nodes.select("vid", "key", F.col("doc_id").alias("least"), "n", "bits"), "vid"), "wanted")
    texts = rows.join(wanted.select("vid", "key", "least").hint("merge"), "key").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("vid", "text")
    texts = scratch.save(texts, "texts")
    room = F.floor(F.greatest("n", "m") * (1 - similarity) + 1e-9)  # edits that are allowed
    near = (F.greatest(_apart("ba", "bb") + F.greatest(F.col("m") - F.col("n"), F.lit(0)), _apart("bb", "ba") + F.greatest(F.col("n") - F.col("m"), F.lit(0))) <= room)
    bits_a, bits_b = wanted.select(F.col("vid").alias("a"), "n", F.col("bits").alias("ba")), wanted.select(F.col("vid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("bb"))

    def verified(pairs: DataFrame, name: str, unseen: bool = True) -> DataFrame:
        """The links among the pairs; ``unseen``: their bits have not been compared yet."""
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if unseen:
            pairs = pairs.join(bits_a, "a").join(bits_b, "b").filter(near).select("a", "b")
        pairs = scratch.save(pairs, f"{name}-pairs")
        x, y = texts.select(F.col("vid").alias("a"), F.col("text").alias("x")), texts.select(F.col("vid").alias("b"), F.col("text").alias("y"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        found = scratch.save(both.mapInArrow(_verify(similarity), "a long, b long").distinct(), f"{name}-links")
        scratch.drop(f"{name}-pairs")
        return found

    # first with the least member of the same and of the next smaller size in all the buckets, then in each
    reps = scratch.save(buckets.groupBy("sig", "size").agg(F.min(F.struct("vid", "n")).alias("r")).select("sig", "size", F.col("r.vid").alias("b"), F.col("r.n").alias("m")), "reps")
    of = reps.select("sig", F.explode(F.array("size", F.col("size") + 1)).alias("size"), "b", "m")
    stars = scratch.save(buckets.withColumnRenamed("vid", "a").join(of, ["sig", "size"]).filter(like).filter("a <> b").select("a", "b").distinct(), "stars")
    links = verified(stars.groupBy("a").agg(F.min("b").alias("b")), "star")
    comp = merged(None, links, scratch, "star-comp")
    apart = stars.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    more = verified(apart, "stars")
    links, comp = links.union(more).distinct(), merged(comp, more, scratch, "stars-comp")
    scratch.drop("stars", "reps")
    # then what still lies apart
    placed = scratch.save(buckets.join(comp, "vid", "left").select("sig", "vid", "n", F.coalesce("comp", "vid").alias("comp")), "placed")
    main = placed.groupBy("sig").agg(F.min_by("comp", "vid").alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("sig", "main")
    placed = scratch.save(placed.join(main, "sig"), "apart")
    scratch.drop("placed", "buckets")
    low = lambda c: c.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    left = placed.select("vid").distinct()
    used = texts.join(left, "vid", "left_semi").mapInArrow(_used, "vid long, uses array<smallint>").groupBy("vid").agg(F.any_value("uses").alias("uses"))
    sketches = left.join(nodes.select("vid", "bits", F.transform("sketch", low).alias("sketch")), "vid").join(used, "vid")
    placed = scratch.save(placed.join(sketches, "vid"), "apart-sketched")
    scratch.drop("apart")
    a = placed.filter("comp <> main").select("sig", F.col("vid").alias("a"), "n", F.col("comp").alias("ca"), F.col("sketch").alias("ka"), F.col("bits").alias("ba"), F.col("uses").alias("ua"))
    b = placed.select(F.col("sketch").alias("kb"), F.col("bits").alias("bb"), F.col("uses").alias("ub"), F.col("sig").alias("s2"), F.col("vid").alias("b"), F.col("n").alias("m"), F.col("comp").alias("cb"), (F.col("comp") == F.col("main")).alias("in_main"))
    tuples = F.filter(F.zip_with("ka", "kb", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    once = F.get(tuples, F.lit(0)) == low(F.col("sig"))  # in the first of the pair's buckets only
    alone = F.greatest(F.size("ua") + F.greatest(F.col("m") - F.col("n"), F.lit(0)), F.size("ub") + F.greatest(F.col("n") - F.col("m"), F.lit(0))) - F.size(F.array_intersect("ua", "ub"))
    more = verified(a.join(b, (a["sig"] == b["s2"]) & (a["ca"] != b["cb"]) & (b["in_main"] | (a["a"] < b["b"])) & like & near & once & (alone <= room)), "rest", unseen=False)
    scratch.drop("apart-sketched", "texts", "wanted")
    links, comp = links.union(more), merged(comp, more, scratch, "comp")
    degree = links.select(F.col("a").alias("vid")).union(links.select(F.col("b").alias("vid"))).groupBy("vid").agg(F.count("*").alias("links"))
    whole = scratch.save(nodes.join(comp, "vid", "left").join(degree, "vid", "left").select("key", "doc_id", "uid", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "vid").alias("comp")), "classes")
    scratch.drop("nodes")
    groups = whole.groupBy("comp").agg(F.min(F.struct("doc_id")).alias("least"), F.sum("copies").alias("class_size"), F.min(order).alias("top"))
    groups = scratch.save(groups.select("comp", F.col("least.doc_id").alias("class_id"), "class_size", F.col("top.uid").alias("keep_uid")), "groups")
    return signed.select("uid", "doc_id", "key"), scratch.save(whole.join(groups, "comp").select("key", "class_id", "class_size", "keep_uid", "links"), "keyed")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, links, kept for each row, repeated rows too.

    ``class_id`` is the least doc_id of the class (null before all), ``links`` counts the verified links of the row's text to
    different texts; texts that are joined already are not compared, so it is a lower bound.  The row of least doc_id stays;
    of rows that repeat it, one.  Texts of equal words are alike; texts without any word are alike if they are equal (null:
    empty).  Other columns are ignored.  An empty table gives an empty one.
    """
    signed, keyed = classify(spark, docs, Scratch(spark, "near"), id_col, text_col, similarity)
    return signed.join(keyed, "key").select("doc_id", "class_id", "class_size", "links", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with all their columns, one row of each class; of rows that repeat both id and text, any one."""
    scratch = Scratch(spark, "near")
    signed, keyed = classify(spark, docs, scratch, id_col, text_col, similarity)
    tops = signed.join(keyed.select(F.col("keep_uid").alias("uid")).distinct(), "uid", "left_semi").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
    n = signed.groupBy("key", "doc_id").agg(F.count("*").alias("_n"))
    kept = scratch.save(tops.join(n, (n["key"] == tops["_key"]) & n["doc_id"].eqNullSafe(tops["_id"])).select("_key", "_id", "_n"), "kept")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*names)
    marked = renamed.withColumn("_k", F.unhex(F.md5(F.coalesce(at[text_col], F.lit("")).cast("binary"))))
    found = marked.join(kept.hint("merge"), (F.col("_k") == F.col("_key")) & F.col(at[id_col]).cast("long").eqNullSafe(F.col("_id")))
    single = found.filter("_n = 1").select(*names)
    if kept.filter("_n > 1").limit(1).count():
        single = single.unionByName(found.filter("_n > 1").dropDuplicates(["_key", "_id"]).select(*names))
    return single.toDF(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
