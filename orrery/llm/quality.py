"""Text quality by a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins.  Shallow trees are boosted feature by feature in turn, each adding to that
feature's lookup table; then the pairs of features that explain most of what is left get tables of their own in the same
way.  A score is the logistic function of the sum of the bins' entries, looked up for a whole batch at once.

The model is fitted on the driver on at most MAX_LABELLED labelled rows; scoring reads every text once and moves nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, whole_text

#: The bound of the labelled sample that is sent to the driver: rows of the least hashes of their ids.
MAX_LABELLED = 20_000
FEATURES = ("length", "capitals", "symbols", "exclamations", "bars", "signs", "digits", "stops", "distinct", "top_word", "repeats",
            "line_repeats", "word_length", "line_words", "other_bytes", "spaces")

_CLASS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\n", "stop": b".,;:?",
          "bang": b"!", "bar": b"|", "sign": b"*$%&#@^~=+<>{}[]\\/_"}
_BYTES = {k: np.frombuffer(v, dtype=np.uint8) for k, v in _CLASS.items()}


def features(text: str) -> list[float]:
    """The features of a whole text, in the order of FEATURES; all of an empty one are 0."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = text.split()
    if not words:
        return [float(np.log1p(len(raw))), *[0.0] * (len(FEATURES) - 1)]
    counts = np.bincount(raw, minlength=256)
    n = {k: int(counts[v].sum()) for k, v in _BYTES.items()}
    letters, size, of = max(1, n["upper"] + n["lower"]), len(raw), Counter(words)
    lines = [x for x in text.split("\n") if x]
    plain = n["upper"] + n["lower"] + n["digit"] + n["space"] + int(counts[128:].sum())
    return [float(np.log1p(size)), n["upper"] / letters, (size - plain) / size, n["bang"] / len(words), n["bar"] / len(words), n["sign"] / len(words), n["digit"] / size,
            n["stop"] / len(words), len(of) / len(words), max(of.values()) / len(words), sum(map(eq, words, words[1:])) / len(words),
            1 - len(set(lines)) / max(1, len(lines)), (size - n["space"]) / len(words), len(words) / max(1, len(lines)), int(counts[128:].sum()) / size, n["space"] / size]


class Additive:
    """Lookup tables by feature and by pair of features, over fixed bins."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges, self.intercept = edges, 0.0
        self.single = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=int)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for i, entries in enumerate(self.single):
            out += entries[bins[:, i]]
        for (i, j), entries in self.pairs.items():
            out += entries[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """A tree over ordered bins with few leaves, as one value for each bin."""
    spans = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in spans:
            if b - a > 1:
                cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                gains = _gain(cg[:-1], ch[:-1], ridge) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], ridge) - _gain(cg[-1], ch[-1], ridge)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best cut of both axes of a table into four leaves, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(cg.shape) < 2:
        return np.zeros_like(g), 0.0
    tl, tlh = cg[:-1, :-1], ch[:-1, :-1]
    tr, trh = cg[:-1, -1:] - tl, ch[:-1, -1:] - tlh
    bl, blh = cg[-1:, :-1] - tl, ch[-1:, :-1] - tlh
    br, brh = cg[-1, -1] - tl - tr - bl, ch[-1, -1] - tlh - trh - blh
    gains = sum(_gain(a, b, ridge) for a, b in ((tl, tlh), (tr, trh), (bl, blh), (br, brh)))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:] = _leaf(tl[i, j], tlh[i, j], ridge), _leaf(tr[i, j], trh[i, j], ridge)
    out[i + 1:, :j + 1], out[i + 1:, j + 1:] = _leaf(bl[i, j], blh[i, j], ridge), _leaf(br[i, j], brh[i, j], ridge)
    return out, float(gains[i, j] - _gain(cg[-1, -1], ch[-1, -1], ridge))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 6, ridge: float = 1.0) -> Additive:
    """Cyclic boosting of the logistic loss; without rows of both labels the model is the constant that the labels suggest."""
    model = Additive([np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for i in range(len(FEATURES))])
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    at = model.bins(x)
    margin = np.full(len(y), model.intercept)

    def push() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, entries in enumerate(model.single):
            g, h = push()
            step = rate * _tree(np.bincount(at[:, i], g, len(entries)), np.bincount(at[:, i], h, len(entries)), ridge)
            entries += step
            margin += step[at[:, i]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.single[i]), len(model.single[j])
        flat, (g, h) = at[:, i] * shape[1] + at[:, j], push()
        return flat, *(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    ranked = sorted(((_tree2(*grid(i, j)[1:], ridge)[1], i, j) for i, j in combinations(range(len(FEATURES)), 2)), reverse=True)[:pairs]
    model.pairs = {(i, j): np.zeros((len(model.single[i]), len(model.single[j]))) for _, i, j in ranked}
    for _ in range(rounds // 3):
        for (i, j), entries in model.pairs.items():
            flat, g, h = grid(i, j)
            step = rate * _tree2(g, h, ridge)[0]
            entries += step
            margin += step.ravel()[flat]
    return model


def _held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fits on labelled rows whose crc32 of the id as text leaves another remainder than 1 by 3; null ids and labels are left out."""
    chosen = labels.select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("label")).filter("key IS NOT NULL AND label IN (0, 1)").filter(~_held_out("key"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "label").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), texts["id"] == chosen["key"]).select("label", "text")  # max_labelled rows at most
    found = rows.mapInArrow(_with_features, "label int, x array<double>").limit(max_labelled).collect()
    found.sort(key=lambda r: (r.label, r.x))
    return fit(np.array([r.x for r in found]).reshape(len(found), len(FEATURES)), np.array([r.label for r in found], dtype=float))


def _scores(model, text: int) -> Callable:
    def of(b: pa.RecordBatch) -> np.ndarray:
        return model.value.score(np.array([features(t.as_py() or "") for t in b.column(text)]).reshape(-1, len(FEATURES)))

    return of


def score(spark: SparkSession, docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row, repeated rows too.

    A null text counts as an empty one, and an empty one is scored as any other.  A null id is not held out.  Only the
    text decides a score.  Other columns are ignored; an empty table gives an empty one.
    """
    of = _scores(spark.sparkContext.broadcast(model), 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = of(b)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(_held_out(id_col), F.lit(False)).alias("held_out"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(spark: SparkSession, docs: DataFrame, model: Additive, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least 0.5, with all their columns."""
    of = _scores(spark.sparkContext.broadcast(model), docs.columns.index(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(of(b) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(spark, docs, train(docs, table(spark, sf_dir, "labels")))
