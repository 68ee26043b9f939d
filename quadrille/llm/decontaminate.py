"""Benchmark decontamination by word windows.

Words are runs of digits, lower-cased letters a-z and characters outside ASCII. Every
``window`` consecutive words of a benchmark item form a window; an item of fewer words is
one window of its own length. The windows are a hash set that is broadcast; a document's
words are mapped to ids of the benchmark's vocabulary, rolling hashes of all its windows
are looked up, and each hit is verified word by word. Words inside any occurrence are hit.

The set is broadcast in blocks of at most ``block_bytes`` of benchmark text. A larger
benchmark becomes several passes over the same rows, without a shuffle, so no row is lost
and no broadcast grows with the benchmark; a task holds one block at a time. Repeated rows
are scanned alike, and columns of the documents are handed on whatever their names. Defined
results: null texts and texts without
words have no words, no hits and no items; items without words never match; items with
equal texts all count; a null item id is left out of the list of items.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import claim, free_name, materialize, sliced

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Windows:
    """The windows of some benchmark items: a vocabulary, the word ids of all items one after
    the other, and for each window length the sorted hashes with places and items. About 24
    bytes a word and 150 a distinct word."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.ids, parts, starts, at = [], [], {}, 0
        for item, text in items:
            w = words(text)
            if not w:
                continue
            n = min(window, len(w))
            parts.append(np.fromiter((self.vocab.setdefault(x, len(self.vocab) + 1) for x in w), np.int32, len(w)))
            starts.setdefault(n, []).append((at, len(w) - n + 1, len(self.ids)))
            self.ids.append(item)
            at += len(w)
        self.seq = np.concatenate(parts) if parts else np.empty(0, np.int32)
        rng = np.random.default_rng(7)
        self.code = rng.integers(1, 1 << 63, len(self.vocab) + 1, dtype=np.uint64)
        self.code[0] = 0
        self.sets = {}
        for n, found in starts.items():
            every = self.hashes(self.seq, n)
            place = np.concatenate([np.arange(lo, lo + count) for lo, count, _ in found])
            owner = np.repeat(np.array([k for _, _, k in found], np.int32), [count for _, count, _ in found])
            h = every[place]
            order = np.lexsort((owner, h))
            h, place, owner = h[order], place[order], owner[order]
            keep = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
            for k in np.flatnonzero(~keep):  # leave out what an item repeats, but no collision
                keep[k] = (self.seq[place[k] : place[k] + n] != self.seq[place[k - 1] : place[k - 1] + n]).any()
            self.sets[n] = h[keep], place[keep], owner[keep]

    def hashes(self, ids: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h = h * _MIX + self.code[ids[k : len(ids) - n + 1 + k]]
        return h

    def hits(self, w: list[bytes]) -> tuple[np.ndarray, set]:
        """(mask of hit words, items with occurring windows)."""
        mask, items = np.zeros(len(w), bool), set()
        get = self.vocab.get
        ids = np.fromiter((get(x, 0) for x in w), np.int32, len(w))
        if not ids.any():
            return mask, items
        for n, (h, place, owner) in self.sets.items():
            if len(ids) < n:
                continue
            run = np.concatenate(([0], np.cumsum(ids > 0)))
            at = np.flatnonzero(run[n:] - run[:-n] == n)  # windows of known words only
            if not len(at):
                continue
            mine = self.hashes(ids, n)[at]
            lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            for k in np.flatnonzero(lo < hi):
                same = (self.seq[place[lo[k] : hi[k], None] + np.arange(n)] == ids[at[k] : at[k] + n]).all(axis=1)
                if same.any():
                    mask[at[k] : at[k] + n] = True
                    items.update(self.ids[c] for c in owner[lo[k] : hi[k]][same].tolist())
        return mask, items


#: Bytes of benchmark text in one broadcast. Its windows take some 30 times as much at most.
BLOCK_BYTES = 4 << 20


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Parts of the benchmark, each about ``block_bytes`` of text at most."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-2 * size // block_bytes) if size > block_bytes else 1
    return [b.where(F.expr(f"pmod(xxhash64(item_id, text), {parts}) = {k}")) for k in range(parts)] if parts > 1 else [b]


Hits = list[tuple[np.ndarray, list]]


def _passes(docs: DataFrame, blocks: list[DataFrame], window: int, finish: Callable[[pa.RecordBatch, Hits, Windows], pa.RecordBatch], schema) -> DataFrame:
    """One pass over ``docs`` for each block of the benchmark. The last hands ``finish`` the rows
    and their hits (numbers of hit words, ids of items) in all blocks. Passes before it are
    written, so that a task never holds more than one block."""
    names, out = docs.columns, docs
    p = free_name(names, "_hits")
    for k, block in enumerate(blocks):
        held = docs.sparkSession.sparkContext.broadcast(Windows([(r[0], r[1]) for r in block.toLocalIterator()], window))
        first, last = k == 0, k == len(blocks) - 1

        def run(batches: Iterable[pa.RecordBatch], held=held, first=first, last=last) -> Iterator[pa.RecordBatch]:
            claim()
            for b in sliced(batches):
                col = lambda name, b=b: b.column(b.schema.get_field_index(name))
                hits = []
                for text in col("text").to_pylist():
                    mask, items = held.value.hits(words(text))
                    hits.append((np.flatnonzero(mask).astype(np.int32), sorted(x for x in items if x is not None)))
                if not first:
                    hits = [(np.union1d(w, w0).astype(np.int32), sorted({*i, *i0})) for (w, i), w0, i0 in zip(hits, col(f"{p}w").to_pylist(), col(f"{p}i").to_pylist(), strict=True)]
                rest = pa.RecordBatch.from_arrays([col(n) for n in names], names=names)
                if last:
                    yield finish(rest, hits, held.value)
                else:
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([w for w, _ in hits], pa.list_(pa.int32())), pa.array([i for _, i in hits], pa.list_(pa.int64()))], names=[*names, f"{p}w", f"{p}i"])

        if last:
            return out.mapInArrow(run, schema)
        out = materialize(out.mapInArrow(run, docs.select("*", F.array().cast("array<int>").alias(f"{p}w"), F.array().cast("array<bigint>").alias(f"{p}i")).schema), "hits")
    raise ValueError("a benchmark has one block at least")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs``, then ``_hit_words`` (array of word numbers that are hit) and
    ``_hit_items`` (array of item ids), which replace columns of these names."""
    d = docs.drop("_hit_words", "_hit_items")
    schema = d.select("*", F.array().cast("array<int>").alias("_hit_words"), F.array().cast("array<bigint>").alias("_hit_items")).schema

    def finish(b: pa.RecordBatch, hits: Hits, _: Windows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([w for w, _ in hits], pa.list_(pa.int32())), pa.array([i for _, i in hits], pa.list_(pa.int64()))], names=[*b.schema.names, "_hit_words", "_hit_items"])

    return _passes(d, benchmark_blocks(benchmark, block_bytes), window, finish, schema)


REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, hit words, items, digest of the item ids."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finish(b: pa.RecordBatch, hits: Hits, _: Windows) -> pa.RecordBatch:
        found = []
        for i, text, (hit, items) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), hits, strict=True):
            ids = ",".join(sorted(map(str, items)))
            found.append((i, len(words(text)), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), REPORT, strict=True)], schema=REPORT)

    return _passes(d, benchmark_blocks(benchmark, block_bytes), window, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut_words(text: str, hit: Iterable[int]) -> str:
    """``text`` without the given words and without what stands between two such words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at, last = [], 0, None
    for k in hit:
        a, b = spans[k]
        if last is None or k != last + 1:
            out.append(text[at:a])
        at, last = b, k
    return "".join([*out, text[at:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, mode: str = "spans") -> DataFrame:
    """Documents without benchmark passages, with the columns of ``docs``.

    ``mode="spans"`` cuts the hit words out (``n_chars`` is counted anew where there is
    such a column); ``mode="documents"`` drops the documents that have any. A cut can bring
    parts of a window together; texts are scanned again until nothing is hit. A benchmark of
    several blocks is scanned block by block in every round, and rounds are written."""
    if mode not in ("spans", "documents"):
        raise ValueError("mode is spans or documents")
    names, blocks = docs.columns, benchmark_blocks(benchmark, block_bytes)
    mark = free_name(names, "_hit")
    schema = docs.select("*", F.lit(0).cast("int").alias(mark)).schema
    again = mode == "spans" and len(blocks) == 1

    def clean(text: str | None, hit: np.ndarray, windows: Windows) -> str | None:
        while len(hit):
            text = cut_words(text, hit)
            hit = np.flatnonzero(windows.hits(words(text))[0]) if again else []
        return text

    def finish(b: pa.RecordBatch, hits: Hits, windows: Windows) -> pa.RecordBatch:
        at = b.schema.get_field_index("text")
        cols = list(b.columns)
        if mode == "spans" and any(len(w) for w, _ in hits):
            cols[at] = pa.array([clean(t, w, windows) for t, (w, _) in zip(b.column(at).to_pylist(), hits, strict=True)], b.schema.field(at).type)
        return pa.RecordBatch.from_arrays([*cols, pa.array([len(w) for w, _ in hits], pa.int32())], names=[*names, mark])

    out = _passes(docs, blocks, window, finish, schema)
    if mode == "documents":
        return out.where(F.col(mark) == 0).drop(mark)
    cut = out.drop(mark)
    while len(blocks) > 1:
        out = materialize(out, "cut")
        cut = out.drop(mark)
        if out.where(F.col(mark) > 0).limit(1).count() == 0:
            break
        out = _passes(cut, blocks, window, finish, schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return cut
