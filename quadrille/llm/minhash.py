"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles (64-bit hashes). Of 128 minima each, bands
of 4 give candidate pairs: at a similarity of 0.8 or more, the chance that all 32 bands
miss a pair is below 5e-8. The low 2 bits of each minimum are packed in bit planes; the
share of equal minima, counted by bit operations and corrected for chance collisions
(``(m - 1/4) / (1 - 1/4)``), estimates the similarity. Candidates whose estimate lies five
standard errors below the threshold leave. The rest are confirmed on the full sets.

Hot groups: equal sets are one node from the start (grouped by a 128-bit digest, before
the shuffle), and joins by digest, bucket, node or label deal the rows of hot keys evenly. In a bucket, a set is compared with those that no link has reached yet, and
only one edge from each member to the smallest one of its group is kept, never all pairs. The components
of these forests are candidate clusters; every true link joins members of one cluster.
In a cluster links are confirmed on the full sets, again with one edge for each member, which
gives the components of all links. Buckets and clusters beyond a fixed size are dealt in pairs
of blocks to different tasks, so none of them meets in one task and no pair is left out.
Buckets, links and components stay distributed.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a text of
fewer words than a shingle is one shingle, its whole sequence; null and blank texts have
an empty set, are linked with nothing, and are each their own component. Rows with equal
doc_id and equal sets are one document. Null ids are smaller than none: a group's
component is its smallest id that is not null. Other columns of the documents are left
behind (``keep_one`` hands them on as they are), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BoundedCache, claim, drop_path, emit, fresh_path, materialize, rows, spread_join

HASHES, BAND = 128, 4
_BANDS = HASHES // BAND
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)
_words: BoundedCache = BoundedCache(lambda w: xxhash.xxh3_64_intdigest(w), 20 << 20)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    k = min(n, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out * _M + h[j : len(w) - k + 1 + j])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """The 128 minima of a set that isn't empty, over blocks so that memory is bounded."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(best, (x[at : at + 4096, None] * _A + _B).min(axis=0), out=best)
    return best


def signature(best: np.ndarray) -> tuple[list[int], list[int]]:
    """(key of each band, two bit planes of two words each)."""
    wide = best.astype(np.uint64).reshape(_BANDS, BAND)
    key = np.arange(_BANDS, dtype=np.uint64)
    for j in range(BAND):
        key = _mix(key * _M + wide[:, j])
    low = _mix(best.astype(np.uint64) * _M + np.arange(HASHES, dtype=np.uint64))
    planes = [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view("<i8") for b in (0, 1)]
    return key.view(np.int64).tolist(), np.concatenate(planes).tolist()


_FEAT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("key", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size of the set, digest of the set, hash of the text, band keys, packed signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_words)

        def found():
            for i, text, key in rows(batches):
                s = shingles(text, n)
                bands, sig = signature(minima(s)) if len(s) else ([], [])
                yield i, len(s), _digest(s), key, bands, sig

        return emit(found(), _FEAT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("key")).mapInArrow(run, "doc_id long, n long, digest binary, key long, bands array<bigint>, sig array<bigint>")


def _estimates(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarity of one packed signature to each of many."""
    x = (sig ^ one).view(np.uint64)  # numpy counts the bits of absolute values
    other = np.bitwise_count(x[:, 0] | x[:, 2]).astype(np.int64) + np.bitwise_count(x[:, 1] | x[:, 3])
    return (1 - other / HASHES - 0.25) / 0.75


def _grow(n: np.ndarray, sig: np.ndarray, percent: int, least: float, sure=None) -> list[list[int]]:
    """The components of the links among some sets, of two members or more: each set is
    compared once with those not reached yet, so a group that hangs together costs little
    more than its size. ``sure(i, candidates)`` confirms links."""
    left, out = np.arange(len(n)), []
    while len(left):
        seed, left = int(left[0]), left[1:]
        order, group = [seed], [seed]
        while order and len(left):
            i = order.pop()
            m = n[left]
            near = (100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])) & (_estimates(sig[left], sig[i]) >= least)
            if sure is not None and near.any():
                near[near] = sure(i, left[near])
            order += left[near].tolist()
            group += left[near].tolist()
            left = left[~near]
        if len(group) > 1:
            out.append(group)
    return out


def _star(nodes: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Edges from the smallest node of a group to the others: groups of several bands that
    have their smallest node in common give the same edges."""
    root = min(nodes)
    return ((root, x) for x in nodes if x != root)


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, by equal values of the first ``keys`` columns."""
    held: list[tuple] = []
    for r in rows(batches):
        if held and held[-1][:keys] != r[:keys]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def _blocked(df: DataFrame, key: str, size: str, node: str, most: int, path: str) -> DataFrame:
    """Deals the rows of each ``key`` to blocks of about ``most`` (summed ``size``), and each
    row to every pair of blocks that its own is part of: columns bi, bj. A key of one block
    has one pair, so only keys beyond ``most`` are replicated, and none meets in one task."""
    count = df.groupBy(key).agg(F.sum(size).alias("_t"), F.count(F.lit(1)).alias("_c")).where("_c > 1").select(key, "_c", F.expr(f"cast(ceil(_t / {most}) as int)").alias("_b"))
    j = spread_join(df, materialize(count, "count", path), [key], "_c").withColumn("_i", F.expr(f"pmod(xxhash64({node}), _b)"))
    return j.withColumn("_j", F.explode(F.expr("sequence(0, _b - 1)"))).withColumn("bi", F.least("_i", "_j")).withColumn("bj", F.greatest("_i", "_j")).drop("_b", "_i", "_j")


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])
#: Members of a bucket, and shingles of a cluster, that one task compares with each other.
BUCKET_BLOCK, CLUSTER_BLOCK = 16_384, 2_000_000
#: So many rows of one or two numbers are broadcast, so that texts need not be shuffled.
FEW_ROWS = 500_000


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) of every node with an edge: the smallest node of its component, by alternating steps
    of taking the smallest label of the neighbours and of the label's own label. The node in the
    middle of a star, and a label that many nodes have, are hot keys, which joins spread."""
    spark, step = edges.sparkSession, 0
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "both", f"{folder}/both")
    lab = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"), F.count(F.lit(1)).alias("degree")).select(F.col("u").alias("node"), "label", "degree"), "label", f"{folder}/label0")
    while True:
        near = spread_join(both, lab.select(F.col("node").alias("v"), "label", "degree"), ["v"], "degree").groupBy("u").agg(F.min("label").alias("near")).select(F.col("u").alias("node"), "near")
        new = lab.join(near, "node").select("node", F.col("label").alias("was"), "degree", F.least("label", "near").alias("to"))
        new = materialize(new, "near", f"{folder}/near{step}")
        jump = new.groupBy("to").agg(F.count(F.lit(1)).alias("n")).join(lab.select(F.col("node").alias("to"), F.col("label").alias("jump")), "to")
        new = spread_join(new, materialize(jump, "jump", f"{folder}/jump{step}"), ["to"], "n", "left")
        new = materialize(new.select("node", "was", "degree", F.least("to", F.coalesce("jump", "to")).alias("label")), "label", f"{folder}/label{step + 1}")
        changed = new.where("label <> was").limit(1).count()
        for name in ("label", "near", "jump"):
            drop_path(spark, f"{folder}/{name}{step}")
        step += 1
        lab = new.select("node", "label", "degree")
        if not changed:
            drop_path(spark, f"{folder}/both")
            return lab.select("node", "label")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, key (hash of the text) for every row: documents with
    ``100 * shared >= percent * union`` are linked, and a component is what links reach."""
    if not 60 <= percent <= 100:  # at 60, bands find a pair with a chance of 1 - (1 - 0.6 ** 4) ** 32 = 0.988
        raise ValueError("percent must lie in 60..100: the bands are chosen for that")
    spark = docs.sparkSession
    folder = fresh_path(spark, "minhash")
    feat = materialize(features(docs, n), "features", f"{folder}/features")
    some = feat.where("n > 0")
    groups = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    j = percent / 100
    least = j - 5 * ((1 - j) * (j + 1 / 3) / HASHES) ** 0.5  # standard error of the corrected estimate
    # Band rows of distinct sets carry no more than the node; what is known of the nodes is
    # joined to the few rows whose bucket has other members.
    uniq = some.groupBy("digest").agg(F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.any_value("n").alias("n"))
    band = uniq.select(F.col("digest").alias("node"), F.explode("bands").alias("band"), F.lit(1).alias("one"))
    about = some.groupBy("digest").agg(F.any_value("sig").alias("sig"), F.any_value("n").alias("n")).withColumnRenamed("digest", "node")

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_words)

        def found():
            for g in _runs(batches, 3):
                if len(g) > 1:
                    sig = np.array([r[5] for r in g], dtype=np.int64)
                    for group in _grow(np.array([r[4] for r in g]), sig, percent, least):
                        yield from _star([g[i][3] for i in group])

        return emit(found(), _EDGE, 20_000)

    dealt = _blocked(band, "band", "one", "node", BUCKET_BLOCK, f"{folder}/buckets").join(about, "node").select("band", "bi", "bj", "node", "n", "sig")
    dealt = dealt.repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj")
    near = materialize(dealt.mapInArrow(candidates, "a binary, b binary").distinct(), "near", f"{folder}/near")
    # Every link joins two sets of one candidate cluster; links are confirmed in clusters.
    lab = components(near, f"{folder}/clusters")
    member = lab.join(groups.select(F.col("digest").alias("node"), "rep"), "node").join(about, "node")
    member = materialize(_blocked(member, "label", "n", "node", CLUSTER_BLOCK, f"{folder}/sizes").select("label", "bi", "bj", "node", "rep", "n", "sig"), "members", f"{folder}/members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = member.select(F.col("rep").alias("_rep")).distinct()
    if wanted.count() <= FEW_ROWS:  # only the texts of clusters move; else all of them do
        texts = texts.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    full = member.join(texts, member["rep"].eqNullSafe(texts["doc_id"])).select("label", "bi", "bj", "node", "n", "sig", "text")
    full = full.repartition("label", "bi", "bj").sortWithinPartitions("label", "bi", "bj", "node")

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_words)

        def found():
            for g in _runs(batches, 3):
                node, size, sig, sets = [], [], [], []
                for r in g:
                    s = shingles(r[6], n)
                    if (not node or node[-1] != r[3]) and _digest(s) == r[3]:
                        node.append(r[3])
                        size.append(len(s))
                        sig.append(r[5])
                        sets.append(s)
                if len(node) < 2:
                    continue
                words, code = np.unique(np.concatenate(sets), return_inverse=True)
                at = np.concatenate(([0], np.cumsum(size)))
                code = code.astype(np.int32)
                parts = [code[at[k] : at[k + 1]] for k in range(len(node))]
                mark, count = np.zeros(len(words), bool), np.array(size)

                def sure(i, which, mark=mark, parts=parts, count=count):
                    mark[parts[i]] = True
                    both = np.array([np.count_nonzero(mark[parts[k]]) for k in which])
                    mark[parts[i]] = False
                    return 100 * both >= percent * (count[which] + count[i] - both)

                for group in _grow(count, np.array(sig, dtype=np.int64), percent, least, sure):
                    yield from _star([node[i] for i in group])

        return emit(found(), _EDGE, 20_000)

    edges = materialize(full.mapInArrow(confirm, "a binary, b binary").distinct(), "links", f"{folder}/links")
    lab = components(edges, f"{folder}/components")
    reps = groups.select(F.col("digest").alias("node"), "rep", "copies")
    least_id = lab.join(reps, "node").groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("members"))
    by = spread_join(lab, materialize(least_id, "least", f"{folder}/least"), ["label"], "members")
    # Only texts with copies or links have a component other than their own id.
    by = reps.join(by.select("node", "component"), "node", "left").select(F.col("node").alias("digest"), F.coalesce("component", "rep").alias("component"), "copies").where("copies > 1 or not component <=> rep")
    left = feat.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"), "key")
    out = spread_join(left, materialize(by, "by", f"{folder}/by"), ["digest"], "copies", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "key")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id. Rows that repeat
    a doc_id with one set of shingles stay or go together."""
    gone = near_duplicates(docs, n, percent).where("not kept").select(F.col("doc_id").alias("_mh_id"), F.col("key").alias("_mh_key")).distinct()
    gone = materialize(gone, "gone")
    if gone.count() <= FEW_ROWS:  # of two numbers each; else the texts move to meet them
        gone = F.broadcast(gone)
    mine = docs["doc_id"].cast("long") == gone["_mh_id"]
    return docs.join(gone, mine & (F.xxhash64(docs["text"].cast("string")) == gone["_mh_key"]), "left_anti")
