"""Token ids in length-delimited binary records.

Frame of a record: length (u64), masked CRC-32C of those 8 bytes (u32), payload, masked
CRC-32C of the payload (u32); all little-endian. That is the framing of TFRecord files.
Payload: 1 byte of flags (bit 0: the id is null, bit 1: ids are 32 bits wide, else 16),
document id (i64), ids. An index file beside each data file holds the offset of every
frame (u64), so that a reader can fetch records in any order.

Documents are written in ascending doc_id: ids are cut into ranges, each range is sorted
in one task and goes to one file. A null id comes first, repeated ids are ordered by
text, a null text is an empty text (its record holds the end id alone). Other columns are
left behind, whatever their names. Writers use
names of their own for each attempt, and only files listed in the manifest (a table that
Spark commits) are read, so a lost or repeated task leaves no trace in the result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LATIN, PLAIN, BoundedCache, bucket_count, bucket_udf, byte_alphabet, claim, emit, fresh_path, materialize, open_fs, range_bounds, rows, small_frame

_BLOCK = 256


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
    return t


_T = _table()


def _shift_tables() -> list[np.ndarray]:
    """What ``_BLOCK`` zero bytes make of each byte of a state."""
    found = []
    for k in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_BLOCK):
            c = _T[c & np.uint32(255)] ^ (c >> np.uint32(8))
        found.append(c)
    return found


_S = _shift_tables()


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of buffers of at least 4 bytes, all in parallel: blocks are lanes of a
    table-driven loop, and a block's state is carried over the next by linearity."""
    if not buffers:
        return np.empty(0, np.uint32)
    size = np.array([len(b) for b in buffers], np.int64)
    blocks = -(-size // _BLOCK)
    end = np.cumsum(blocks)
    lanes = np.zeros(int(end[-1]) * _BLOCK, np.uint8)  # each buffer is padded in front
    for b, e, n in zip(buffers, end * _BLOCK, size, strict=True):
        lanes[e - n : e] = np.frombuffer(b, np.uint8)
        lanes[e - n : e - n + 4] ^= 255
    cols = np.ascontiguousarray(lanes.reshape(-1, _BLOCK).T)
    c = np.zeros(cols.shape[1], np.uint32)
    for col in cols:
        c = _T[(c ^ col) & np.uint32(255)] ^ (c >> np.uint32(8))
    first = end - blocks
    out = c[first].copy()
    order = np.argsort(-blocks, kind="stable")
    many = blocks[order]
    for d in range(1, int(blocks.max())):
        live = order[: np.searchsorted(-many, -d, side="left")]
        s = out[live]
        out[live] = _S[0][s & np.uint32(255)] ^ _S[1][(s >> np.uint32(8)) & np.uint32(255)] ^ _S[2][(s >> np.uint32(16)) & np.uint32(255)] ^ _S[3][s >> np.uint32(24)] ^ c[first[live] + d]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    a, b = masked(crc32c(heads)).astype("<u4").tobytes(), masked(crc32c(payloads)).astype("<u4").tobytes()
    return [h + a[4 * i : 4 * i + 4] + p + b[4 * i : 4 * i + 4] for i, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def unframe(data: bytes, at: np.ndarray) -> list[bytes]:
    """Payloads of the frames that begin at the given offsets of ``data``; raises where
    a length or a checksum is wrong."""
    heads = [data[o : o + 8] for o in at]
    size = [int.from_bytes(h, "little") for h in heads]
    if any(len(h) < 8 or o + 16 + n > len(data) for h, o, n in zip(heads, at, size, strict=True)):
        raise ValueError("a frame is cut short")
    payloads = [data[o + 12 : o + 12 + n] for o, n in zip(at, size, strict=True)]
    told = np.frombuffer(b"".join(data[o + 8 : o + 12] + data[o + 12 + n : o + 16 + n] for o, n in zip(at, size, strict=True)), "<u4").reshape(-1, 2)
    if (told[:, 0] != masked(crc32c(heads))).any() or (told[:, 1] != masked(crc32c(payloads))).any():
        raise ValueError("a checksum is wrong")
    return payloads


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return bytes([(doc_id is None) + 2 * wide]) + (doc_id or 0).to_bytes(8, "little", signed=True) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags = payload[0]
    return None if flags & 1 else int.from_bytes(payload[1:9], "little", signed=True), np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


#: What the fast split below does not handle: runs of white space, white space other
#: than single blanks and line ends, and text that looks like a special token.
_WIDE = re.compile("[\t\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = ("  ", " \n", "\n ", "\n\n", "<|")


def _odd(text: str) -> bool:
    return any(x in text for x in _RUNS) or _WIDE.search(text) is not None


_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^ \n0-9{LATIN}]+")


class ByteLevelEncoder:
    """Ids of a text as the tokenizers library gives them for a byte-level BPE file.

    Byte-level pre-tokens never cross from a non-blank into the blank after it, so the
    words of a text are encoded apart by the library and kept in caches of at most
    ``cache_bytes`` together.
    Texts with unusual white space or special tokens go to the library whole."""

    def __init__(self, path: str, cache_bytes: int = 256 << 20):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.split = self.whole.pre_tokenizer.pre_tokenize_str
        self.model = self.whole.model
        self.four = [k.to_bytes(4, "little") for k in range(self.whole.get_vocab_size(with_added_tokens=True))]
        self.pieces = BoundedCache(self._piece, cache_bytes // 8)
        self.words = BoundedCache(self._word, cache_bytes - cache_bytes // 8)
        self.caches = (self.pieces, self.words)

    def _piece(self, piece: str) -> bytes:
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(piece)])

    def _word(self, key: str) -> bytes:
        if key.isascii():  # a word, or a word and one mark after it
            if key.isalpha():
                return self._piece("\u0120" + key)
            if key[:-1].isalpha() and key[-1] in ".,;:!?":
                return self.pieces["\u0120" + key[:-1]] + self.pieces[key[-1]]
        if key[:1] == "\n":
            return self.pieces["\u010a"] + self._run(key[1:])
        return self._run(" " + key)

    def _run(self, text: str) -> bytes:
        if text == " ":
            return self.pieces["\u0120"]
        if PLAIN.match(text, text[:1] == " "):
            found = _PIECE.findall(text)
            if len(found) == 1:  # the word itself is cached
                return self._piece(byte_alphabet(text))
            return b"".join([self.pieces[byte_alphabet(p)] for p in found])
        return b"".join([self.pieces[p] for p, _ in self.split(text)])

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _odd(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._run(first) + b"".join(map(self.words.__getitem__, rest))


MANIFEST = pa.schema([("bucket", pa.int64()), ("data", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())])
_BATCH = 8 << 20


def write_records(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int | None = 0, folder: str | None = None) -> DataFrame:
    """Encodes and writes every document; returns the manifest (one row a file).
    ``encoder()`` is called once in each worker; what it returns maps a text to ids."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "records")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = range_bounds(d, "doc_id", bucket_count(spark))
    dealt = d.withColumn("bucket", bucket_udf(bounds)("doc_id")).repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "text").select("bucket", "doc_id", "text")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fs, top = encoder(), *open_fs(folder)
        claim(*getattr(encode, "caches", ()))
        fs.create_dir(top, recursive=True)

        class File:
            def __init__(self, bucket):
                self.bucket, self.name = bucket, f"{bucket:08d}-{uuid.uuid4().hex}"
                self.data = fs.open_output_stream(f"{top}/{self.name}.rec")
                self.at, self.offsets, self.tokens, self.held, self.size = 0, [], 0, [], 0

            def add(self, i, text):
                ids = np.frombuffer(encode(text) + end, "<u4")
                self.tokens += len(ids)
                self.held.append(pack(i, ids))
                self.size += len(self.held[-1])
                if self.size >= _BATCH:
                    self.flush()

            def flush(self):
                made = frames(self.held)
                for f in made:
                    self.offsets.append(self.at)
                    self.at += len(f)
                self.data.write(b"".join(made))
                self.held, self.size = [], 0

            def close(self):
                self.flush()
                self.data.close()
                with fs.open_output_stream(f"{top}/{self.name}.idx") as x:
                    x.write(np.array(self.offsets, "<u8").tobytes())
                return self.bucket, f"{folder}/{self.name}.rec", f"{folder}/{self.name}.idx", len(self.offsets), self.tokens

        def found():
            out = None
            for b, i, text in rows(batches):
                if out is None or out.bucket != b:
                    if out:
                        yield out.close()
                    out = File(b)
                out.add(i, text)
            if out:
                yield out.close()

        return emit(found(), MANIFEST, 1)

    made = dealt.mapInArrow(run, "bucket long, data string, index string, records long, tokens long")
    return materialize(made, "manifest", f"{folder}/manifest")


def iter_records(data_uri: str, index_uri: str, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one file, in file order or in any other ``order`` of record numbers."""
    fs, path = open_fs(data_uri)
    with fs.open_input_stream(open_fs(index_uri)[1]) as x:
        at = np.frombuffer(x.read(), "<u8").astype(np.int64)
    if order is not None:
        with fs.open_input_file(path) as f:
            total = f.size()
            for k in order:
                hi = int(at[k + 1]) if k + 1 < len(at) else total
                (p,) = unframe(f.read_at(hi - int(at[k]), int(at[k])), np.array([0]))
                yield unpack(p)
        return
    with fs.open_input_file(path) as f:
        ends, k = np.append(at[1:], f.size()), 0
        while k < len(at):
            stop = max(k + 1, int(np.searchsorted(ends, at[k] + _BATCH, side="right")))
            lo = int(at[k])
            for p in unframe(f.read_at(int(ends[stop - 1]) - lo, lo), at[k:stop] - lo):
                yield unpack(p)
            k = stop


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("record", pa.int64())])


def read_back(manifest: DataFrame) -> DataFrame:
    """Reads every file of a manifest: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, and the file and record number that hold it."""
    spark, base, plan = manifest.sparkSession, 0, []
    for m in sorted(manifest.collect(), key=lambda m: m["bucket"]):  # one row a file
        plan.append((m["data"], m["index"], m["records"], base))
        base += m["tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for data, index, records, start in rows(batches):
                k = -1
                for k, (i, ids) in enumerate(iter_records(data, index)):
                    yield i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), data, k
                    start += len(ids)
                if k + 1 != records:
                    raise ValueError(f"{data} has {k + 1} records, its manifest {records}")

        return emit(found(), READ)

    return small_frame(spark, plan, "data string, index string, records long, base long").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, record long")


def byte_level(path: str) -> Callable[[], ByteLevelEncoder]:
    """An encoder factory for ``write_records``; a worker keeps its encoder between tasks."""
    return lambda: _kept(path)


_encoders: dict[str, ByteLevelEncoder] = {}


def _kept(path: str) -> ByteLevelEncoder:
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]
