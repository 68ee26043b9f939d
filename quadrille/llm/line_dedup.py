"""Removal of repeated runs of lines.

Each distinct text is a sequence of line ids (128-bit hashes of its stripped lines; blank
lines stand outside the sequence). A run of consecutive lines that holds at least
``min_words`` words and occurs at an earlier place (in order of doc_id, then of line)
is a later copy and is deleted; overlapping copies are deleted as far as they reach.
The first occurrence of every line stays.

Ranks of the suffixes come from distributed prefix doubling: ranks by one line, then by
two, four ... lines, each made by sorting pairs of ranks with the range partitioner.
Suffixes whose prefix is unique leave the table at once. Two suffixes lie in one
longest-common-prefix interval of depth ``m`` if their ranks by ``2^k <= m`` lines agree
at both ends of the first ``m`` lines, so an interval is a group of equal
``(m, rank, rank)`` and its first member is the smallest position; groups are aggregated
before the shuffle. A very common line still has a row for each of its places, but these
rows are dealt evenly (``spread_join``), and which of them are later copies is told by
leaving out the first of each group by its place, so no task sees all places of one line.

How deep doubling must go does not depend on the data. Of a repeated run, the shortest
stretches with ``min_words`` words that begin at each of its lines, and the one that ends
at its last line, cover it wholly; each of these has at most ``min_words`` lines, since a
line that counts has a word. So depths up to ``min_words`` decide every line exactly.

A text that is wholly equal to an earlier one is one run, so only the first of equal texts
enters the doubling. Rows that repeat both doc_id and text are one document. Null and
blank texts have no lines and stay as they are. A null doc_id comes before all others.
Columns of ``docs`` but text and n_chars are handed on as they are, whatever their names;
n_lines and n_deleted, where asked for, replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import claim, drop_path, emit, free_name, fresh_path, hot_from, materialize, rows, sliced, spread_join, with_ids

MIN_WORDS = 10
_SEQ = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("line", pa.list_(pa.int32())), ("key", pa.list_(pa.binary())), ("words", pa.list_(pa.int32()))])


_WANT = pa.schema([("d", pa.int64()), ("i", pa.int32()), ("m", pa.int32())])


def line_sequences(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, and for each line with words its number, key and word count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()

        def found():
            for i, text in rows(batches):
                line, key, n = [], [], []
                for k, s in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    if w := len(s.split()):  # words are runs without ASCII white space
                        line.append(k)
                        key.append(xxhash.xxh3_128_digest(s.strip()))
                        n.append(w)
                yield i, xxhash.xxh3_128_digest(text), line, key, n

        return emit(found(), _SEQ)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.where(F.col("text").isNotNull()).mapInArrow(run, "doc_id long, text_key binary, line array<int>, key array<binary>, words array<int>")


def _stretches(n: list[int], least: int) -> list[tuple[int, int]]:
    """(start, lines) of the shortest stretches with ``least`` words: from each start, and
    to each end."""
    found, hi, total = set(), 0, 0
    for lo in range(len(n)):
        while hi < len(n) and total < least:
            total += n[hi]
            hi += 1
        if total < least:
            break
        found.add((lo, hi - lo))
        total -= n[lo]
    lo = total = 0
    for end in range(len(n)):
        total += n[end]
        while total - n[lo] >= least:
            total -= n[lo]
            lo += 1
        if total >= least:
            found.add((lo, end + 1 - lo))
    return sorted(found)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each distinct text with ``min_words`` words that has more than one document
    or a line to delete:
    text_key, first_id (smallest doc_id), copies, n_words, cut (numbers of deleted lines of
    the first document, ascending)."""
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    spark = docs.sparkSession
    folder = fresh_path(spark, "lines")
    seq = line_sequences(docs)
    texts = seq.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id"))["doc_id"].alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.any_value("line").alias("line"), F.any_value("key").alias("key"), F.any_value("words").alias("words"))
    # The order of texts, which makes positions comparable: (d, i) for line i of text d.
    texts = materialize(with_ids(texts, ["doc_id", "text_key"], "d"), "texts", f"{folder}/texts")
    at = texts.select("d", F.posexplode("key").alias("i", "key"))
    ranks = materialize(with_ids(at.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["key"], "r"), "rank", f"{folder}/rank0")
    level = materialize(spread_join(at, ranks, ["key"], "n").select("d", "i", F.col("r").alias("r0")), "level", f"{folder}/level0")
    levels, k = [level], 0
    while 2 ** (k + 1) <= min_words:
        here = f"r{k}"
        right = level.select("d", (F.col("i") - 2**k).alias("i"), F.col(here).alias("b"))
        pairs = level.select("d", "i", F.col(here).alias("a")).join(right, ["d", "i"])
        pairs = materialize(pairs, "pairs", f"{folder}/pairs{k}")
        ranks = materialize(with_ids(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["a", "b"], "r"), "rank", f"{folder}/rank{k + 1}")
        k += 1
        level = materialize(spread_join(pairs, ranks, ["a", "b"], "n").select("d", "i", F.col("r").alias(f"r{k}")), "level", f"{folder}/level{k}")
        drop_path(spark, f"{folder}/pairs{k - 1}")
        levels.append(level)

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(((d, i, m) for d, n in rows(batches) for i, m in _stretches(n, min_words)), _WANT, 20_000)

    want = texts.select("d", "words").mapInArrow(stretches, "d long, i int, m int").withColumn("k", F.expr("cast(floor(log2(m)) as int)"))
    hits = None
    for k, level in enumerate(levels):  # a stretch without a rank is unique
        mine = want.where(F.col("k") == k)
        both = mine.join(level.select("d", "i", F.col(f"r{k}").alias("a")), ["d", "i"])
        if k:
            both = both.withColumn("j", F.expr(f"i + m - {2**k}")).join(level.select("d", F.col("i").alias("j"), F.col(f"r{k}").alias("b")), ["d", "j"])
        else:
            both = both.withColumn("b", F.col("a"))
        both = both.select("k", "d", "i", "m", "a", "b")
        hits = both if hits is None else hits.unionByName(both)
    hits = materialize(hits, "hits", f"{folder}/hits")
    # All of a group but its first place; single hits are the first of their groups.
    first = hits.groupBy("k", "m", "a", "b").agg(F.min(F.struct("d", "i")).alias("first")).select("first.d", "first.i", "m")
    later = hits.select("d", "i", "m").join(first, ["d", "i", "m"], "left_anti")
    cut = later.select("d", F.explode(F.expr("sequence(i, i + m - 1)")).alias("i")).groupBy("d").agg(F.sort_array(F.collect_set("i")).alias("at"))
    out = texts.join(cut, "d", "left").where("copies > 1 or at is not null").withColumn("n_words", F.expr("aggregate(words, 0L, (x, w) -> x + w)"))
    out = out.where(F.col("n_words") >= min_words).select("text_key", F.col("doc_id").alias("first_id"), "copies", "n_words", F.expr("transform(coalesce(at, array()), i -> line[i])").alias("cut"))
    out = materialize(out, "cut", f"{folder}/cut")
    for name in ("hits", *(f"{x}{k}" for k in range(len(levels)) for x in ("rank", "level"))):
        drop_path(spark, f"{folder}/{name}")
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """``docs`` with the later copies deleted from ``text`` (and ``n_chars`` counted anew
    where there is such a column). ``counts`` adds n_lines and n_deleted."""
    if counts:
        docs = docs.drop("n_lines", "n_deleted")
    names, schema = docs.columns, docs.schema
    p = free_name([*names, "n_lines", "n_deleted"], "_ld")
    cut = repeated_lines(docs, min_words).select(F.col("text_key").alias(f"{p}key"), F.col("first_id").alias(f"{p}first"), F.col("copies").alias(f"{p}copies"), F.col("cut").alias(f"{p}cut"))

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            data = [None if t is None else t.encode("utf-8", "surrogatepass") for t in text]
            key = pa.array([None if t is None or len(t.split(None, min_words)) < min_words else xxhash.xxh3_128_digest(t) for t in data], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, key], names=[*b.schema.names, f"{p}key"])

    keyed = docs.mapInArrow(keys, docs.select("*", F.lit(None).cast("binary").alias(f"{p}key")).schema)
    # Later copies of very common texts need no more than the id of the first, which few rows
    # tell; these copies, and texts that are too short to be cut, are dealt evenly.
    most = hot_from(cut.agg(F.sum(f"{p}copies")).first()[0])
    common = F.broadcast(cut.where(F.col(f"{p}copies") > most).select(F.col(f"{p}key").alias(f"{p}hot"), F.col(f"{p}first").alias(f"{p}of")))
    keyed = keyed.join(common, F.col(f"{p}key") == F.col(f"{p}hot"), "left")
    after = lambda first: F.coalesce(F.when(F.col(first).isNull(), F.col("doc_id").isNotNull()).otherwise(F.col("doc_id") > F.col(first)), F.lit(False))
    keyed = keyed.withColumn(f"{p}late", F.col(f"{p}hot").isNotNull() & after(f"{p}of"))
    keyed = keyed.withColumn(f"{p}s", F.when(F.col(f"{p}late") | F.col(f"{p}key").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    j = keyed.join(cut.withColumn(f"{p}s", (F.col(f"{p}copies") < 0).cast("long")), [f"{p}key", f"{p}s"], "left")
    copy = F.col(f"{p}late") | (F.col(f"{p}copies").isNotNull() & after(f"{p}first"))
    lines = F.split("text", "\n")
    kept = F.array_join(F.expr(f"transform(filter(transform(split(text, '\\n'), (s, k) -> struct(s as s, k as k)), x -> not array_contains({p}cut, x.k)), x -> x.s)"), "\n")
    blank = F.array_join(F.filter(lines, lambda s: s.rlike(r"^\s*$")), "\n")
    some = F.coalesce(F.size(f"{p}cut"), F.lit(0)) > 0
    out = j.withColumn(f"{p}new", F.when(copy, blank).when(some, kept).otherwise(F.col("text")))
    if counts:
        n = F.coalesce(F.size(F.filter(lines, lambda s: s.rlike(r"\S"))), F.lit(0)).cast("long")
        out = out.withColumn("n_lines", n).withColumn("n_deleted", F.when(copy, n).when(some, F.size(f"{p}cut").cast("long")).otherwise(F.lit(0).cast("long")))
    new = F.col(f"{p}new")
    cols = [new.cast(schema["text"].dataType).alias("text") if c == "text" else F.col(c) for c in names]
    if "n_chars" in names:
        kind = schema["n_chars"].dataType
        cols[names.index("n_chars")] = F.when(new.isNull() | (new == F.col("text")), F.col("n_chars")).otherwise(F.length(new).cast(kind)).alias("n_chars")
    return out.select(*cols, *(["n_lines", "n_deleted"] if counts else []))
