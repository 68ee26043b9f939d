"""BPE encoding and decoding with forced boundaries.

Two neighbouring characters of the byte alphabet that stand side by side in no token of
the vocabulary can never be merged, so a cut between them is certain. Text is cut at
white space (which no token holds), at the pre-tokenizer's boundaries, and inside a
pre-token at every forced boundary. The fragments are encoded independently, and their
ids are concatenated: only the last fragment of a pre-token carries the word end.

Defined results: a null text is an empty text, which has no ids and decodes to "".
Texts that may hold a special token, or characters that are white space to Python and
not to the library, are encoded by the library whole. Repeated rows are encoded alike,
one result each. What a worker keeps is bounded in bytes, and pre-tokens of more than 64
characters are not kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LATIN, PLAIN, PLAIN_TEXT, BoundedCache, byte_alphabet, claim, emit, rows

_ODD = re.compile("[\x1c-\x1f\x85\u180e\ufeff]|<\\|")


_PIECE = re.compile(f"[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t\n\r0-9{LATIN}]+")


class ForcedBoundaryEncoder:
    """Encodes as the tokenizers library does with a BPE file that has a word-end suffix,
    lower-cases and drops white space. Pre-tokens and fragments are kept, as the text of
    their ids, in caches of at most ``cache_bytes`` together."""

    def __init__(self, path: str, cache_bytes: int = 96 << 20):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tokens = {str(i): t for t, i in vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = forced_pairs(vocab, self.suffix)
        self.last = self.whole.model
        self.inner = BPE(vocab, merges)
        self.fragments = BoundedCache(self._fragment, cache_bytes // 8)
        self.pieces = BoundedCache(self._piece, cache_bytes - cache_bytes // 8)
        self.caches = (self.fragments, self.pieces)

    def _fragment(self, text: str) -> str:
        return " ".join([str(t.id) for t in self.inner.tokenize(text)])

    def _final(self, text: str) -> str:
        return " ".join([str(t.id) for t in self.last.tokenize(text)])

    def pre_token(self, piece: str) -> str:
        """Ids, joined by blanks, of one pre-token in the byte alphabet, cut at its forced
        boundaries."""
        pairs = self.pairs
        if pairs.issuperset(map(add, piece, piece[1:])):  # no pair is a certain cut
            return self._final(piece)
        cuts = [k for k, (a, b) in enumerate(zip(piece, piece[1:], strict=False), 1) if a + b not in pairs]
        found = [self.fragments[piece[a:b]] for a, b in zip([0, *cuts], cuts, strict=False)]
        return " ".join([x for x in (*found, self._final(piece[cuts[-1] :])) if x])

    def _piece(self, piece: str) -> str:
        return self.pre_token(byte_alphabet(piece))

    def _chunk(self, chunk: str) -> str:
        """Ids of a run without white space, whatever its characters."""
        found = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(chunk))
        return " ".join([x for x in [self.pre_token(p) for p, _ in found] if x])

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids joined by blanks, decoded text)."""
        if not text:
            return 0, "", ""
        if _ODD.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return len(ids), " ".join(map(str, ids)), self.whole.decode(ids, skip_special_tokens=False)
        low = text.lower()
        if PLAIN_TEXT.match(text) and PLAIN_TEXT.match(low):  # pre-tokens never hold white space
            found = map(self.pieces.__getitem__, _PIECE.findall(low))
        else:
            found = map(self._run, text.split())
        numbers = " ".join([x for x in found if x]).split()
        return len(numbers), " ".join(numbers), " ".join(map(self.tokens.__getitem__, numbers))

    def _run(self, chunk: str) -> str:
        low = chunk.lower()
        if PLAIN.match(chunk) and PLAIN.match(low):
            return " ".join([x for x in map(self.pieces.__getitem__, _PIECE.findall(low)) if x])
        return self._chunk(chunk)

    def ids(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode(text)[1].split()]


def forced_pairs(vocab: Iterable[str], suffix: str) -> set[str]:
    """The neighbouring characters found inside tokens; any other pair is a certain cut."""
    pairs: set[str] = set()
    for token in vocab:
        bare = token.removesuffix(suffix) if suffix else token
        pairs.update(bare[k : k + 2] for k in range(len(bare) - 1))
    return pairs


_encoders: dict[str, ForcedBoundaryEncoder] = {}


def kept_encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = ForcedBoundaryEncoder(path)
    return _encoders[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every document (or SHA-256 digests of both); no shuffle.

    One row for each row of ``docs``, repeated rows included; its other columns are left
    behind, whatever their names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_encoder(path)
        claim(*coder.caches)

        def found():
            for i, text in rows(batches):
                n, ids, decoded = coder.encode(text)
                if digests:
                    yield i, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                else:
                    yield i, n, np.fromstring(ids, np.int32, sep=" "), decoded

        return emit(found(), DIGESTS) if digests else emit(found(), ENCODED, weigh=lambda r: 4 * r[1] + 4 * len(r[3]))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, n_tokens long, ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
