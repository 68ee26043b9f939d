"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are counts over its whole length. Training bins each statistic
into at most 64 quantile bins and grows trees of fixed depth on logistic loss from
gradient histograms. The trees are flattened into arrays (feature, threshold, leaf
values), and a batch of documents goes down all of them by numpy indexing.

The model learns from at most ``max_train`` labelled documents (default 16,000, taken by
the smallest hashes of their ids, so the choice depends on neither order nor size of the
tables). Scoring covers every document. Neither labels, lang, source nor doc_id are
inputs of a score. Defined results: a null text is an empty text and is scored as one;
labels that are null, or of documents that are not there, teach nothing; if a document
has several labels the smallest counts; without labels of both kinds every score is the
share of label 1 (0.5 if there are none). Repeated rows are scored alike; other columns are
handed on as they are, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import claim, emit, rows, sliced

MAX_TRAIN = 16_000
STOP = frozenset("the of and to in is that it for was on are with as be at by this have from or an they which you a der die und das ist in den von zu mit sich des auf für nicht ein eine el la de que y en los se las por un con una su para es le les et des du est une dans qui pour au".split())
_LOW, _UP = np.zeros(256, bool), np.zeros(256, bool)
_LOW[97:123] = True
_UP[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[33, 46, 63]] = True
_COMMA = np.zeros(256, bool)
_COMMA[[44, 58, 59]] = True
_MARK = np.zeros(256, bool)
_MARK[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = True
_WIDE = np.zeros(256, bool)
_WIDE[128:] = True
_LEAD = np.zeros(256, bool)
_LEAD[192:] = True
_CLASSES = np.stack([_LOW, _UP, _DIGIT, _SPACE, _STOPS, _COMMA, _MARK, _WIDE, _LEAD]).astype(np.float64)
FEATURES = ["log_bytes", "lower", "upper", "digit", "space", "stops", "comma", "mark", "wide", "letters", "log_words", "word_len", "distinct_words", "stop_words", "capital_words", "top_word", "distinct_bigrams", "long_words", "one_letter", "lines", "line_words", "distinct_lines", "short_lines", "packed", "bang", "quote", "entropy", "words_in_stops", "marked_words", "all_upper_words"]


def statistics(text: str | None) -> list[float]:
    """The statistics named in ``FEATURES``; every one is finite for every text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    low, up, digit, space, stops, comma, mark, wide, lead = (_CLASSES @ hist).tolist()
    p = hist[hist > 0] / n
    words = text.split()
    nw = len(words)
    seen: dict[str, int] = {}
    get = seen.get
    for w in words:
        seen[w] = get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    d = max(nw, 1)
    of = lambda f: sum([c for w, c in seen.items() if f(w)]) / d
    return [
        math.log1p(n), low / n, up / n, digit / n, space / n, stops / n, comma / n, mark / n, wide / n, (low + up + lead) / n,
        math.log1p(nw), sum(map(len, words)) / d, len(seen) / d, of(lambda w: w.strip(".,!?;:").lower() in STOP), of(lambda w: w[0].isupper()), max(seen.values(), default=0) / d,
        pairs / max(nw - 1, 1), of(lambda w: len(w) > 12), of(lambda w: len(w) == 1), len(lines) / d, nw / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), sum([len(x) < 20 for x in lines]) / max(len(lines), 1),
        len(zlib.compress(data, 1)) / n, hist[33] / n, (hist[34] + hist[39]) / n, float(-(p * np.log2(p)).sum()), stops / d, of(lambda w: not w[-1].isalnum()), of(str.isupper),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth, flattened: node ``k`` has children ``2k+1`` and
    ``2k+2``; a document goes right where its statistic is over the threshold."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, at = np.full(len(x), self.base), np.arange(len(x))
        depth = int(math.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[at, f[node]] > t[node])
            out += v[node - f.shape[0]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 5.0, least: int = 20) -> Trees:
    """Boosted trees on logistic loss. Deterministic: no sampling, first best split wins."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    base = math.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        if len(y):
            base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return Trees(np.empty((0, inner), np.int64), np.empty((0, inner)), np.empty((0, leaves)), base)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = code + np.arange(m) * bins
    f_all, t_all, v_all = [], [], []
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (m * bins) + flat).ravel()
            size = count * m * bins
            sums = [np.bincount(key, np.repeat(v, m), size).reshape(count, m, bins) for v in (g, h, np.ones(n))]
            left = [np.cumsum(s, axis=2)[:, :, :-1] for s in sums]
            total = [s.sum(axis=2, keepdims=True) for s in sums]
            gl, hl, nl = left
            gt, ht, nt = total
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins - 1)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += value[leaf]
        f_all.append(feature)
        t_all.append(threshold)
        v_all.append(value)
    return Trees(np.array(f_all), np.array(t_all), np.array(v_all), base)


def is_held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, trees: int = 120) -> Trees:
    """Trains on the driver, from a sample of at most ``max_train`` labelled documents."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~is_held_out())
    lab = lab.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = [(r[0], r[1]) for r in lab.collect()]
    if not chosen:
        return train(np.empty((0, len(FEATURES))), np.empty(0))
    # The documents and nothing of their other columns, whatever the names of these.
    small = F.broadcast(docs.sparkSession.createDataFrame(chosen, "_q_id long, _q_label int"))  # max_train rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(((i, statistics(t), y) for i, t, y in rows(batches)), _TRAIN)

    got = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text")).join(small, F.col("_d") == F.col("_q_id")).select("_d", "text", "_q_label").mapInArrow(run, "i long, x array<double>, y int").groupBy("i").agg(F.min(F.struct("x", "y")).alias("r")).select("i", "r.x", "r.y").collect()
    got = sorted(got, key=lambda r: r["i"])
    return train(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], dtype=np.float64), trees)


_TRAIN = pa.schema([("i", pa.int64()), ("x", pa.list_(pa.float64())), ("y", pa.int32())])
THRESHOLD = 0.7


def with_score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """``docs`` with the score of every text in column ``name``, which replaces a column of that
    name; no shuffle. The model's size is fixed by the number of trees and their depth."""
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in sliced(batches):
            x = np.array([statistics(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(x), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
