"""Helpers shared by the training-data operators: shared folders, tables that cut
lineage, range buckets, and files that executors write and read."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a local session gets a temporary folder; any other
    master is refused, because its executors would not see such a folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="quadrille-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quadrille/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back. That cuts the
    lineage with a table that outlives any executor."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def with_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a unique id that grows in the order of ``keys``, which must be distinct rows.
    The range partitioner deals the keys, so no task sees them all."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, lengthened until no column begins with it: a safe name, and a safe prefix."""
    while any(c.lower().startswith(base.lower()) for c in columns):
        base += "_"
    return base


#: A key is hot with more rows than this and than one in ``HOT_KEYS`` of all, so that the hot
#: keys are ``HOT_KEYS`` at most, whatever the size of the table.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def hot_from(total: int | None) -> int:
    return max(HOT_ROWS, (total or 0) // HOT_KEYS)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Joins ``left`` with ``right``, which has one row for each key and tells in ``weight`` how
    many rows of ``left`` have it (``right`` is read three times, so it should be a table).

    Rows with a hot key get their values from a broadcast of the hot keys, of which there are
    few by definition, and are dealt evenly, as rows with a null key are; all others meet their
    key in a shuffle. So no task gets more than its share because of one key."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    stats = right.agg(F.sum(weight), F.max(weight)).first()
    most = hot_from(stats[0])
    values = [c for c in right.columns if c not in (*keys, weight)]
    p = free_name([*left.columns, *right.columns], "_sj")
    spread = reduce(or_, [F.col(k).isNull() for k in keys])
    if has_hot := (stats[1] or 0) > most:
        named = [F.col(k).alias(f"{p}k{i}") for i, k in enumerate(keys)] + [F.col(v).alias(f"{p}h{i}") for i, v in enumerate(values)]
        hot = F.broadcast(right.where(F.col(weight) > most).select(*named, F.lit(True).alias(f"{p}hot")))
        left_in = left.join(hot, reduce(and_, [F.col(k) == F.col(f"{p}k{i}") for i, k in enumerate(keys)]), "left")
        spread = F.coalesce(F.col(f"{p}hot"), F.lit(False)) | spread
    else:
        left_in = left
    dealt = left_in.withColumn(f"{p}s", F.when(spread, F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    rest = right.where(F.col(weight) <= most)
    # Always 0, but not a literal, which the optimizer would take out of the join's keys.
    zero = (F.col(weight) < 0).cast("long").alias(f"{p}s")
    rest = rest.select(*keys, zero, *[F.col(v).alias(f"{p}v{i}") for i, v in enumerate(values)], (F.col(weight) >= 0).alias(f"{p}m"))
    j = dealt.join(rest, [*keys, f"{p}s"], "left" if how == "left" or has_hot else "inner")
    if how == "inner" and has_hot:
        j = j.where(F.col(f"{p}hot") | F.col(f"{p}m"))
    pick = lambda i: F.when(F.col(f"{p}hot"), F.col(f"{p}h{i}")).otherwise(F.col(f"{p}v{i}")) if has_hot else F.col(f"{p}v{i}")
    return j.select(*left.columns, *[pick(i).alias(v) for i, v in enumerate(values)])


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Upper bounds (ascending, distinct) that split ``key`` into about ``buckets`` equal
    ranges. The list is as long as the number of buckets, never as the data."""
    at = [i / buckets for i in range(1, buckets)]
    if not at:
        return []
    row = df.agg(F.percentile_approx(key, at, max(10_000, 20 * buckets)).alias("q")).first()
    return sorted({int(x) for x in row["q"] or []})


def bucket_count(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_udf(bounds: list[int]):
    """Index of the range that an id lies in; a null id counts as smaller than all."""
    cut = np.asarray(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        at = np.searchsorted(cut, ids.fillna(0).astype("int64").to_numpy(), side="left")
        return pd.Series(np.where(null, 0, at).astype(np.int32))

    return bucket


def sliced(batches: Iterable[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size``, so that few of them are Python objects
    at a time; at the end a worker gives free memory back to the system."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in sliced(batches):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def emit(found: Iterable[tuple], schema: pa.Schema, size: int = 2000, weigh: Callable[[tuple], int] | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Packs rows into Arrow batches of at most ``size`` rows; with ``weigh`` (bytes of a row),
    a batch also ends once its rows weigh ``most``."""
    held: list[tuple] = []
    heavy = 0
    for r in found:
        held.append(r)
        heavy += weigh(r) if weigh else 0
        if len(held) >= size or heavy >= most:
            yield _batch(held, schema)
            held, heavy = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder or file that Spark names by URI."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def small_frame(spark: SparkSession, found: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows (one per file or bucket) as a frame with one row in each task."""
    df = spark.createDataFrame(found, schema)
    return df.repartition(max(1, len(found))) if found else df


_caches: list[weakref.ref] = []


def claim(*mine: BoundedCache) -> None:
    """Empties every cache of this worker but those named: a worker serves one operator after
    another, and none shall hold memory for those before it."""
    for ref in _caches:
        c = ref()
        if c is not None and not any(c is m for m in mine):
            c.clear()


class BoundedCache(dict):
    """A dictionary that makes missing values (strings, bytes or integers) by ``make``. Once keys and
    values take about ``limit`` bytes it begins anew, and keys over ``longest`` characters are
    never kept, so a worker's memory stays bounded whatever the corpus holds; words in use come
    back soon, and a hit costs no more than in a plain dictionary."""

    def __init__(self, make, limit: int, longest: int = 64):
        self.make, self.limit, self.longest, self.used = make, limit, longest, 0
        _caches.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.make(key)
        if len(key) > self.longest:
            return value
        size = 180 + len(key) + (0 if isinstance(value, int) else len(value))  # two objects and a slot
        if self.used + size > self.limit:
            self.clear()
        self.used += size
        self[key] = value
        return value

    def clear(self):
        super().clear()
        self.used = 0


#: Code points for which Python and the tokenizers library are sure to agree on classes,
#: case and normal forms: ASCII and precomposed Latin letters.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PLAIN = re.compile(f"[!-~{LATIN}]*\\Z")
#: The same for whole texts, with the usual white space.
PLAIN_TEXT = re.compile(f"[ \t\n\r!-~{LATIN}]*\\Z")


def _alphabet() -> dict[int, str]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


_ALPHABET = _alphabet()


def byte_alphabet(piece: str) -> str:
    """The bytes of a piece as the printable characters that byte-level files use."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", "\u0120")
    return piece.encode().decode("latin-1").translate(_ALPHABET)
