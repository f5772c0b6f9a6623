"""Token counts with a digest cache, and the chunk-wise tokenizer that counting and packing share.

A count belongs to the digest of the content and the digest of the tokenizer's file.  Contents are joined to the stored
counts; only distinct contents without one are encoded, and their counts are appended for the next run.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CHUNK, LETTERS, PLAIN, SPACE, pieces
from .shared import Scratch, table, whole_text

LIMIT = 1024
#: Chunks kept by a Python worker; the table starts anew when it is full, at about 60 MB.
CACHE = 400_000
_WORD = regex.compile(f"[^{SPACE}]+")
#: The words of a splitter that drops white space, keeps digits apart and has lower case only, in plain text.
LOWER_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOWER = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\t-\r ]+")


def _lower_pieces(text: str) -> list[str]:
    if PLAIN(text):
        return _LOWER.findall(text.lower())
    out: list[str] = []
    for chunk in _WORD.findall(text):
        if PLAIN(chunk):
            out += _LOWER.findall(chunk.lower())
        else:
            out.append(chunk)
    return out


class Chunked:
    """A tokenizer of the public library, asked once for each distinct piece of a batch of texts.

    Pieces are words where the file's splitter is one whose words are known here and the text is plain, else chunks: no
    token spans a place where white space begins.  Either way a text's ids are those of its pieces in turn; texts that hold
    an added token's string go to the library whole.  Files of the sentence-piece kind know no such places, and all texts
    go to the library whole.
    """

    def __init__(self, path: str, size: int = CACHE):
        self.size, self.kept, self.added, self.ends = size, {}, None, None
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: processor.encode(texts, num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        if hasattr(t.model, "_resize_cache"):
            t.model._resize_cache(0)  # every piece is asked for once
        self.whole = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        self.added = [x.content for x in t.get_added_tokens_decoder().values()]
        spec = json.loads(t.to_str())
        self.cut = self._cut(spec, self.whole([" a"]) != self.whole(["a"]))
        suffix = spec["model"].get("end_of_word_suffix")
        if self.cut is _lower_pieces and suffix:
            self.ends = np.zeros(t.get_vocab_size(), dtype=bool)
            self.ends[[i for x, i in t.get_vocab().items() if x.endswith(suffix) and x not in self.added]] = True

    @staticmethod
    def _cut(spec: dict, spaces: bool) -> Callable[[str], list[str]]:
        normal, split = spec["normalizer"], spec["pre_tokenizer"]
        if not normal and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return pieces
        steps = [n["type"] for n in (normal or {}).get("normalizers", [])]
        first = ((split or {}).get("pretokenizers") or [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": LOWER_SPLIT} and first.get("behavior") == "Removed" and first.get("invert"):
            return _lower_pieces
        return (CHUNK if spaces else _WORD).findall

    def encoded(self, part: list[str]) -> list[bytes]:
        """The ids of each piece; words of a vocabulary that marks their last tokens are encoded as one text."""
        if self.ends is not None:
            words = [p for p in part if PLAIN(p)]
            found = np.array([i for x in self.whole([" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]) for i in x], dtype="<u4")
            stops = np.nonzero(self.ends[found])[0] + 1
            if len(stops) == len(words):
                data, places = found.tobytes(), (stops * 4).tolist()
                of = {w: data[a:b] for w, a, b in zip(words, [0, *places], places, strict=False)}
                rest = [p for p in part if p not in of]
                of.update(zip(rest, (array("I", x).tobytes() for x in self.whole(rest)), strict=True))
                return [of[p] for p in part]
        return [array("I", x).tobytes() for x in self.whole(part)]

    def ids(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its pieces, as little-endian unsigned 32-bit integers."""
        if self.added is None:
            return [[np.array(x, dtype="<u4").tobytes()] for x in self.whole(texts)]
        special = [any(x in text for x in self.added) for text in texts]
        cut = [None if s else self.cut(text) for s, text in zip(special, texts, strict=True)]
        kept = self.kept
        new = list(set().union(*filter(None, cut)) - kept.keys())
        if len(kept) + len(new) > self.size:
            kept = self.kept = {}
            new = list(set().union(*filter(None, cut)))
        for i in range(0, len(new), 10_000):
            part = new[i:i + 10_000]
            kept.update(zip(part, self.encoded(part), strict=True))
        of = kept.__getitem__
        return [[array("I", self.whole([text])[0]).tobytes()] if c is None else list(map(of, c)) for c, text in zip(cut, texts, strict=True)]


def batches_of(texts: pa.Array, most: int = 4_000_000) -> Iterator[list[str]]:
    """The texts in turn, in lists of about so many characters at most, or of one text."""
    out, n = [], 0
    for t in texts:
        text = t.as_py()
        if out and n + len(text) > most:
            yield out
            out, n = [], 0
        out.append(text)
        n += len(text)
    yield out


@lru_cache(maxsize=2)
def chunked(path: str) -> Chunked:
    """One for each Python worker, whatever its tasks."""
    return Chunked(path)


def _counts(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = chunked(path)
        for batch in batches:
            n = [sum(map(len, x)) // 4 for texts in batches_of(batch.column(1)) for x in of.ids(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def version(path: str) -> str:
    """The digest of the tokenizer's file, read on the driver."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``, repeated rows too.

    ``path``: the tokenizer's file, at the same place on all machines.  ``cache``: a folder for the table of counts
    (tokenizer, digest, n_tokens), made if missing; entries of other tokenizers there are left alone.  A null text counts
    as an empty one; the content is not changed in any way before it is digested.  Other columns are ignored.
    """
    scratch, name = Scratch(spark, "tokens"), version(path)
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"))
    keyed = scratch.save(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "keyed")
    schema = "tokenizer string, digest string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)
    stored = spark.read.schema(schema).parquet(cache).filter(F.col("tokenizer") == name)
    # one row stands for each content; another run may have appended the same count
    known = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    distinct = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left")
    distinct = scratch.save(distinct, "distinct")
    missing = distinct.filter("n_tokens IS NULL").select("digest", "doc_id")
    # by id as well, so that a content's copies are spread over tasks
    texts = rows.join(missing, (rows["digest"] == missing["digest"]) & rows["doc_id"].eqNullSafe(missing["doc_id"]), "left_semi").select("digest", "text")
    fresh = scratch.save(texts.mapInArrow(_counts(path), "digest string, n_tokens long").distinct(), "fresh")
    fresh.select(F.lit(name).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = scratch.save(distinct.filter("n_tokens IS NOT NULL").select("digest", "n_tokens").unionByName(fresh), "counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache: every distinct text of the table is encoded."""
    import public_tokenizers

    cache = Scratch(spark, "token-cache").path("counts")
    return count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
