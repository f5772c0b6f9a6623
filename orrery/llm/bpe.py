"""Byte-level BPE: an exact linear-time encoder and an offset-table decoder.

The encoder walks a word from left to right.  At each place the longest token that begins there (all tokens in the word are
found in one pass of an Aho-Corasick automaton) is tried first; it is taken if it is compatible with the token before, that
is if merging the bytes of both would give just these two tokens.  If no token fits, the last one is given up for the next
shorter one.  The tokens so found are those that the merges give.  Compatibility of pairs is a table filled as pairs occur.

Decoding: all tokens' bytes lie in one array; a table of offsets tells where each begins, so ids become bytes by one gather.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, whole_text

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode defines it.
SPACE = "\t-\r \x85\xa0  -     　"
#: No word of SPLIT goes on from another character to white space, so a text may be cut there.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Letters, and other characters but white space and digits, that every version of Unicode classes alike and that normal forms leave as they are.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_OTHERS = "!-/:-@[-`{-~\x00-\x08\x0e-\x1f\x7f¡-©«-±´¶-¸»¿×÷‐-‧"
PLAIN = re.compile(f"[{LETTERS}{_OTHERS}0-9\t-\r ]*").fullmatch
#: The words of SPLIT in plain text.  Each is a word by itself too, so that its ids do not depend on what surrounds it.
WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[{_OTHERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Words and chunks whose ids a Python worker keeps; it starts anew when they are full, about 150 MB.
CACHE = 600_000


def pieces(text: str) -> list[str]:
    """A text cut at places that no token spans: words where it is plain, else chunks."""
    if PLAIN(text):
        return WORDS.findall(text)
    out: list[str] = []
    for chunk in CHUNK.findall(text):
        if PLAIN(chunk):
            out += WORDS.findall(chunk)
        else:
            out.append(chunk)
    return out


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a) + raw(b)]) for rank, (a, b) in enumerate(pairs)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, whole) in self.merges.items():
            if whole not in self.parts or rank < self.parts[whole][2]:
                self.parts[whole] = a, b, rank
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        size = max(self.bytes) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for i, b in self.bytes.items():
            lengths[i] = len(b)
        self.size, self.decimal = lengths.tolist(), list(map(str, range(size)))
        self.lengths, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.store = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), dtype=np.uint8)
        self._split = regex.compile(SPLIT)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens in turn are encoded as just these two."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        limit = float("inf")
        while True:
            merge = self.merges.get((left, right))
            if merge and merge[0] < limit:
                return False
            l, r = self.parts.get(left), self.parts.get(right)
            # undo the later merge of both: the tokens that stood at the seam before it
            if l and (not r or l[2] > r[2]):
                limit, left = l[2], l[1]
            elif r:  # of two uses of one merge the right one is later, so the same merge across the seam comes first
                limit, right = r[2] + 0.5, r[0]
            else:
                return True

    def word(self, word: bytes) -> list[int]:
        """The ids of one word of the splitting pattern."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n, size = len(word), self.size
        starts: list[list[int]] = [[] for _ in range(n)]  # tokens by where they begin, the longest last
        for end, i in self.automaton.iter(word.decode("latin-1")):
            starts[end - size[i] + 1].append(i)
        out, at, fits = [], 0, self.fits.get
        while at < n:  # mostly the longest match fits at every place
            i = starts[at][-1]
            if out and not fits((out[-1], i)):
                break
            out.append(i)
            at += size[i]
        else:
            return out
        return self._backtrack(n, starts, out, at)

    def _backtrack(self, n: int, starts: list[list[int]], out: list[int], at: int) -> list[int]:
        """Goes on from ``out``, each of which is the longest match at its place."""
        size, dead = self.size, set()
        tried = [1] * len(out) + [1]  # the token taken at each place, counted from the longest
        while at < n:
            k, options, last = tried[-1], starts[at], out[-1] if out else None
            while k <= len(options):
                i = options[-k]
                if at + size[i] not in dead and (last is None or self.compatible(last, i)):
                    break
                k += 1
            else:  # no token fits here after the last one
                dead.add(at)
                at -= size[out.pop()]
                tried.pop()
                tried[-1] += 1
                continue
            tried[-1] = k
            out.append(i)
            at += size[i]
            tried.append(1)
        return out

    def plain(self, text: str) -> list[int]:
        """The ids of a text, or a chunk of one, without special strings."""
        core = text[1:] if text[:1] == " " else text
        if core.isalpha():  # one word: the pattern's letters are those of str.isalpha
            return self.word(text.encode())
        if core[-1:] in (",", ".") and core[:-1].isalpha():
            return self.word(text[:-1].encode()) + self.word(text[-1:].encode())
        return [i for w in self._split.findall(text) for i in self.word(w.encode())]

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The stretches between special strings, each with the id of the one that follows it."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield text[at:m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text):
            out += self.plain(part)
            if special is not None:
                out.append(special)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are no UTF-8 become replacement characters; ids that the vocabulary lacks add nothing."""
        ids = np.fromiter(ids, dtype=np.int64) if not isinstance(ids, np.ndarray) else ids
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        n = self.lengths[ids]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n) + np.repeat(self.offsets[ids], n)
        return self.store[places].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


class Chunks:
    """A text's ids by words and chunks, whose ids are kept."""

    def __init__(self, codec: Codec, size: int = CACHE):
        self.codec, self.size, self.kept = codec, size, {}

    def _new(self, chunk: str) -> bytes:
        if len(self.kept) >= self.size:
            self.kept.clear()
        ids = array("i", self.codec.plain(chunk)).tobytes()
        if len(chunk) < 64:
            self.kept[chunk] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        out, get, new = [], self.kept.get, self._new
        for part, special in self.codec.segments(text):
            out += [get(c) or new(c) for c in pieces(part)]
            if special is not None:
                out.append(array("i", [special]).tobytes())
        return np.frombuffer(b"".join(out), dtype=np.int32)


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    """One for each Python worker, whatever its tasks."""
    return Chunks(codec(path))


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _digests(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = chunks(path)
        for batch in batches:
            n, ids, decoded, decimal = [], [], [], of.codec.decimal
            for text in batch.column(1):
                found = of(text.as_py())
                n.append(len(found))
                ids.append(_sha(",".join([decimal[i] for i in found.tolist()]).encode()))
                decoded.append(_sha(of.codec.decode(found).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = chunks(path)
        for batch in batches:
            ids = [of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row; a null text counts as an empty one and has no ids; special strings give their ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path)
        for batch in batches:
            texts = [of.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, repeated rows too."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
