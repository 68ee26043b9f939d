"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of every window of ``w`` consecutive
hashes the smallest is selected, the rightmost one where several are equal. Positions
of the selected grams are kept. Any passage of at least ``w + k - 1`` code points that
two texts share has at least one selected gram in common (the match guarantee).

Defined results: a null text is an empty text and has an empty fingerprint; a text of
fewer than ``k`` code points is one gram; a text of fewer than ``w`` grams is one
window. Two empty fingerprints have likeness 1, an empty and another one 0. Repeated rows
give a row each; other columns are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucket_count, bucket_udf, emit, range_bounds, rows

K, W = 16, 16
_BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram of code points: a polynomial modulo 2**64, built by doubling
    the gram length, then mixed."""
    if len(points) < k:
        k = len(points)
    if k == 0:
        return np.empty(0, np.uint64)
    n = len(points) - k + 1
    power = points.astype(np.uint64) + np.uint64(1)  # hashes of grams of 2**j points
    have, size, base = None, 0, _BASE
    step, mult = 1, base
    while step <= k:
        if k & step:
            if have is None:
                have, size = power, step
            else:  # the longer gram goes in front, the ones taken so far follow it
                m = len(power) - size
                have = power[:m] * np.uint64(pow(base, size, 1 << 64)) + have[step : step + m] if m > 0 else power[:0]
                size += step
        if step * 2 <= k:
            power = power[:-step] * np.uint64(mult) + power[step:]
            mult = mult * mult % (1 << 64)
        step *= 2
    h = have[:n].copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def select(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the window minima, rightmost among equals, ascending and distinct."""
    if not len(h):
        return np.empty(0, np.int64)
    w = min(w, len(h))
    val, pos, size = h, np.arange(len(h), dtype=np.int64), 1
    while size < w:
        s = min(size, w - size)
        a, b = val[:-s], val[s:]
        right = b <= a
        val, pos = np.where(right, b, a), np.where(right, pos[s:], pos[:-s])
        size += s
    return pos[np.r_[True, pos[1:] != pos[:-1]]]


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the selected grams, in order of position."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = gram_hashes(points, k)
    pos = select(h, w)
    return h[pos], pos


def digest(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """One string for a whole fingerprint: equal for equal hashes at equal positions."""
    h, pos = print_
    return hashlib.blake2b(h.tobytes() + pos.tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct sorted hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])


def fingerprints(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hashes array, positions array of every document; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for i, text in rows(batches):
                h, pos = winnow(text, k, w)
                yield i, h.view(np.int64), pos

        return emit(found(), FINGERPRINTS, 500)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, hashes array<bigint>, positions array<bigint>")


PAIRS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_selected", pa.int64())])


def compare_with_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each document against its successor in descending doc_id (the first follows the
    last) and against its edited text: the last ``n // 2`` code points replaced by the
    first as many of the successor.

    Ids are cut into ranges, and each range is sorted in one task. The head of a range
    is sent to the range before it as well, which is the only row sent twice, so the
    text is shuffled once. Repeated ids are ordered by text, a null id comes last.
    An empty table gives an empty result; a single row is its own successor."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = d.sparkSession
    bounds = range_bounds(d, "doc_id", bucket_count(spark))
    bucket = bucket_udf(bounds)
    heads = d.select("doc_id", bucket("doc_id").alias("b")).groupBy("b").agg(F.max("doc_id").alias("top")).orderBy(F.desc("b")).collect()  # one row a bucket
    goes: dict = {}
    for at, row in enumerate(heads):  # the head of a bucket follows the end of the bucket above
        goes[row["top"]] = heads[at - 1]["b"]
    ids = np.asarray(sorted(i for i in goes if i is not None), dtype=np.int64)
    to = np.asarray([goes[int(i)] for i in ids], dtype=np.int64)
    null_to = goes.get(None, -1)
    cut = np.asarray(bounds, dtype=np.int64)

    @F.pandas_udf("array<int>")
    def targets(s: pd.Series) -> pd.Series:
        null, v = s.isna().to_numpy(), s.fillna(0).astype("int64").to_numpy()
        own = np.where(null, 0, np.searchsorted(cut, v, side="left"))
        at = np.minimum(np.searchsorted(ids, v), max(0, len(ids) - 1))
        head = (ids[at] == v) & ~null if len(ids) else np.zeros(len(v), bool)
        ghost = np.where(head, to[at], -1) if len(ids) else np.full(len(v), -1)
        ghost = np.where(null, null_to, ghost)
        return pd.Series([[2 * int(o)] if g < 0 else [2 * int(o), 2 * int(g) + 1] for o, g in zip(own, ghost, strict=True)])

    dealt = d.select("doc_id", "text", F.explode(targets("doc_id")).alias("slot")).withColumn("bucket", F.expr("slot div 2")).withColumn("ghost", F.expr("slot % 2"))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), F.desc("text")).select("bucket", "ghost", "doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            last = None
            for b, ghost, i, text in rows(batches):
                if last is not None and last[0] == b and last[1]:
                    continue  # more heads with the same id: only the first follows
                print_ = winnow(text, k, w)
                now = (b, ghost, i, text, print_, np.unique(print_[0]))
                if last is not None and last[0] == b:
                    yield pair(last, now)
                last = now

        def pair(a, b):
            n = len(a[3])
            cut = n - n // 2
            edited = a[3][:cut] + b[3][: n // 2]
            e = winnow(edited, k, w) if edited != a[3] else a[4]
            return a[2], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(a[4]), digest(e), likeness(a[5], np.unique(e[0])), likeness(a[5], b[5]), len(a[4][1])

        return emit(found(), PAIRS)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_selected long")
