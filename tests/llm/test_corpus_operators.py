"""Line dedup, near-duplicates, the quality classifier and the pipeline against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import _common, decontaminate, line_dedup, minhash, quality, queries
from quadrille.llm._common import bucket_udf, range_bounds, spread_join, with_ids
from tests.util import connect, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


# -- 4
def slow_lines(texts, least=line_dedup.MIN_WORDS):
    """Lines of each text that survive: a run with enough words that occurs before goes."""
    lines = [[] if t is None else t.split("\n") for t in texts]
    seq = [[k for k, s in enumerate(x) if s.split()] for x in lines]
    first, gone = {}, [set() for _ in texts]
    for d, keep in enumerate(seq):
        for a in range(len(keep)):
            for b in range(a + 1, min(len(keep), a + least) + 1):
                run = tuple(lines[d][k].strip() for k in keep[a:b])
                if sum(len(s.split()) for s in run) >= least:
                    if run in first:
                        gone[d] |= set(keep[a:b])
                    else:
                        first[run] = (d, a)
    return [None if t is None else "\n".join(s for k, s in enumerate(x) if k not in g) for t, x, g in zip(texts, lines, gone, strict=True)], [len(g) for g in gone]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    for least in (1, 4, 10):
        vocab = ["a b c", "one two three four five six seven eight nine ten eleven", "x", "  x  ", "", "longer line of five words", "y z", "u v w"]
        texts = ["\n".join(rng.choice(vocab) for _ in range(rng.randrange(9))) for _ in range(25)] + [None, "", "\n\n", "x " * 30, "x " * 30]
        want, n = slow_lines(texts, least)
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts), least, counts=True).collect()}
        assert [got[i]["text"] for i in range(len(texts))] == want
        assert [got[i]["n_deleted"] for i in range(len(texts))] == n
        assert all(r["text"] is None or r["text"] == texts[i] or r["n_chars"] == len(r["text"]) for i, r in got.items())


def test_line_dedup_edges(spark):
    same(queries.op4_line_dedup(spark, SF), connect(SF), queries.ORACLES["op4_line_dedup"])
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    line = "this line has more than ten words in it so it counts alone"
    twice = spark.createDataFrame([(1, line), (1, line), (None, line), (2, line), (3, line + "\nnew")], "doc_id bigint, text string").withColumn("d", F.lit("clash")).withColumn("key", F.lit(0))
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(twice).collect()), key=repr)
    assert got == sorted([(None, line), (1, ""), (1, ""), (2, ""), (3, "new")], key=repr)
    assert line_dedup.dedup_lines(twice).columns == twice.columns


def test_line_dedup_of_hot_lines(spark, monkeypatch):
    """Very common lines and texts, dealt evenly, give the same result."""
    monkeypatch.setattr(_common, "HOT_ROWS", 3)
    rng = random.Random(9)
    hot, whole = "one two three four five six seven eight nine ten", "a whole text of more than ten words that many documents share"
    texts = [rng.choice([hot, whole, f"own {i}", "", None, f"{hot}\nown {i}", f"own {i}\n{hot}\nx", f"{whole}\n{hot}"]) for i in range(80)]
    want, n = slow_lines(texts)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts), counts=True).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert [got[i]["n_deleted"] for i in range(len(texts))] == n


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(None, 0)] * 7 + [(1, 0)] * 20 + [(2, 0), (3, 0)], "k bigint, x int")
    right = spark.createDataFrame([(1, 20, "a"), (2, 1, "b"), (9, 0, "c")], "k bigint, n bigint, v string")
    count = lambda how: {(r["k"], r["v"]): r["c"] for r in spread_join(left, right, ["k"], "n", how).groupBy("k", "v").agg(F.count("*").alias("c")).collect()}
    assert count("inner") == {(1, "a"): 20, (2, "b"): 1}
    assert count("left") == {(1, "a"): 20, (2, "b"): 1, (3, None): 1, (None, None): 7}
    assert spread_join(left, right.limit(0), ["k"], "n", "left").count() == 29
    dealt = spread_join(left, right, ["k"], "n", "left").select(F.spark_partition_id().alias("p")).distinct().count()
    assert dealt > 1


# -- 10
def slow_near(texts, n, percent):
    sets = []
    for t in texts:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def near_texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \n", "one", "One", "one two", "ONE two", "one two three"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(8)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    for seed in (1, 2):
        texts = near_texts(seed)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, texts), n, percent).collect())
        assert got == slow_near(texts, n, percent)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Buckets and clusters over several tasks give the same components."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 200)
    texts = near_texts(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, texts), 3, 85).collect())
    assert got == slow_near(texts, 3, 85)


def test_near_duplicates_of_one_hot_text(spark, monkeypatch):
    """One digest on most rows, and a star of many near copies."""
    monkeypatch.setattr(_common, "HOT_ROWS", 3)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 60, 4)]
    texts = ["the same text of some words again"] * 40 + [""] * 20 + [None] * 9 + [" ".join(base)] + near + near
    random.Random(3).shuffle(texts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, texts), 3, 85).collect())
    assert got == slow_near(texts, 3, 85)


@pytest.mark.parametrize("percent", [60, 80])
def test_recall_near_the_threshold(spark, percent):
    """Pairs whose similarity lies just over the threshold are found."""
    rng, texts = random.Random(6), []
    for k in range(150):
        base = [f"v{k}x{i}" for i in range(120)]
        cut = int(120 * (1 - percent / 100) / (1 + percent / 100))
        texts += [" ".join(base), " ".join(base[: 120 - cut] + [f"u{k}x{rng.random()}" for _ in range(cut)])]
    want, got = slow_near(texts, 1, percent), {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), 1, percent).collect()}
    linked = [i for i, _, c in want if c != i]
    assert len(linked) == 150
    assert sum(got[i] != i for i in linked) >= 0.98 * len(linked)
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs(spark, texts), 1, 50)


def test_op10_query(spark):
    same(queries.op10_minhash(spark, SF), connect(SF), queries.ORACLES["op10_minhash"])


@pytest.mark.parametrize("most", [500_000, 0])
def test_keep_one(spark, monkeypatch, most):
    monkeypatch.setattr(minhash, "FEW_ROWS", most)
    texts = near_texts(4)
    comp = {i: c for i, _, c in slow_near(texts, 5, 80)}
    kept = minhash.keep_one(docs(spark, texts).withColumn("key", F.lit(1)).withColumn("_h", F.lit(2)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in comp if comp[i] == i]
    assert minhash.keep_one(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "other words here"), (None, "a b c d e f")], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in minhash.keep_one(twice).collect()), key=repr) == sorted([(1, "a b c d e f")] * 2 + [(2, "other words here"), (None, "a b c d e f")], key=repr)


def test_bbit_estimate():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shared in (0, 500, 1000):
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - shared : 2000 - shared])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sa, sb = (np.array([minhash.signature(minhash.minima(x))[1]], dtype=np.int64) for x in (a, b))
        assert abs(float(minhash._estimates(sa, sb[0])[0]) - true) < 0.25


# -- 8
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, sf).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) >= 0.97


def test_quality_learns_nothing_from_held_out_labels(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = lab.withColumn("quality", F.when(quality.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(d, x, trees=10) for x in (lab, flipped))
    assert (a.leaf == b.leaf).all() and a.base == b.base


def test_quality_edges(spark):
    d = docs(spark, [None, "", "text", "x " * 50_000]).withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(0, None, 1), (None, 1, 0), (99, 1, 0), (1, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    for lab in (none, odd):
        got = quality.with_score(d, quality.fit(d, lab), "_s").collect()
        assert len(got) == 4 and all(0 <= r["_s"] <= 1 for r in got) and got[0]["score"] == "mine"
    assert {len(quality.statistics(t)) for t in (None, "", "a", "A b.\nC!")} == {len(quality.FEATURES)}


def slow_train(x, y, trees, depth, rate, bins, l2, least):
    """The same boosting, each split tried row by row."""
    import math

    n, m = x.shape
    share = y.mean()
    margin = np.full(n, math.log(share / (1 - share)))
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(m)]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)

        def grow(rows, left):
            if left:
                best = (1e-6, None, None)
                for j in range(m):
                    for c in cuts[j]:
                        a, b = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                        if len(a) >= least and len(b) >= least:
                            gain = sum(g[k].sum() ** 2 / (h[k].sum() + l2) for k in (a, b)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                            if gain > best[0] + 1e-9:
                                best = (gain, j, c)
                _, j, c = best
                if j is not None:
                    grow(rows[x[rows, j] <= c], left - 1)
                    grow(rows[x[rows, j] > c], left - 1)
                    return
            margin[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)

        grow(np.arange(n), depth)
    return margin


def test_training_equals_brute_force():
    rng = np.random.default_rng(2)
    x = rng.random((150, 4)).round(2)
    y = ((x[:, 0] + x[:, 1] * rng.random(150)) > 0.8).astype(float)
    model = quality.train(x, y, trees=6, depth=3, rate=0.2, bins=8, l2=1.0, least=5)
    assert np.allclose(model.margin(x), slow_train(x, y, 6, 3, 0.2, 8, 1.0, 5))


def test_trees_split_as_asked():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.train(x, y, trees=60, depth=3)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    k = 17  # one document by hand
    total = model.base
    for f, t, v in zip(model.feature, model.threshold, model.leaf, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(x[k, f[node]] > t[node])
        total += v[node - len(f)]
    assert abs(total - model.margin(x)[k]) < 1e-9


# -- helpers and the pipeline
def test_ranges_and_ids(spark):
    d = spark.createDataFrame([(None,), (5,), (5,), (1,), (9,), (7,)], "k bigint")
    bounds = range_bounds(d, "k", 4)
    b = {r["k"]: r["b"] for r in d.withColumn("b", bucket_udf(bounds)("k")).collect()}
    assert b[None] == 0 and b[1] <= b[5] <= b[7] <= b[9]
    ids = [tuple(r) for r in with_ids(d.distinct(), ["k"], "i").orderBy("i").collect()]
    assert [k for k, _ in ids] == [None, 1, 5, 7, 9]


def slow_pipeline(spark, d, sf):
    """The stages one after the other on plain lists."""
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = quality.fit(d, spark.read.parquet(f"{sf}/labels.parquet"))
    left = sorted((r["doc_id"], r["text"]) for r in d.collect())
    score = model.score(np.array([quality.statistics(t) for _, t in left]))
    left = [x for x, s in zip(left, score, strict=True) if s >= corpus_pipeline.REJECT_BELOW]
    new, gone = slow_lines([t for _, t in left])
    left = [(i, n) for (i, t), n, g in zip(left, new, gone, strict=True) if g == 0 or any(s.split() for s in n.split("\n"))]
    left = [left[i] for i, _, c in slow_near([t for _, t in left], 5, 80) if c == i]
    windows = decontaminate.Windows(bench, 10)
    out = {}
    for i, t in left:
        while (mask := windows.hits(decontaminate.words(t))[0]).any():
            t = decontaminate.cut_words(t, np.flatnonzero(mask).tolist())
        if t.strip():
            out[i] = t
    return out


def test_benchmark_stage_keeps_what_was_blank(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs(spark, [None, "", " \n\t", passage, f"before {passage} after", "clean words"])
    left = corpus_pipeline.benchmark_stage(spark, d, str(tmp_path))
    assert left.columns == d.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 4, 5]


def test_pipeline_equals_brute_force(spark):
    from quadrille.llm.bpe import kept_encoder

    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_pipeline(spark, d, SF)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    coder = kept_encoder(corpus_pipeline.VOCABULARY)
    for r in got:
        n, ids, decoded = coder.encode(want[r["doc_id"]])
        assert (r["n_tokens"], " ".join(map(str, r["ids"])), r["decoded"]) == (n, ids, decoded)


def test_stages_with_the_names_of_the_code(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = ["_quality", "_ldkey", "_ld", "n_lines", "n_deleted", "_blank", "_hits", "_hit", "_mh_id", "_sjs", "key", "n", "digest", "_d", "_q_id"]
    for n in names:
        d = d.withColumn(n, F.lit(n))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        assert all(r[n] == n for r in out.collect() for n in names)
    assert quality.with_score(d, quality.train(np.empty((0, len(quality.FEATURES))), np.empty(0)), "n").columns.count("n") == 1
    assert line_dedup.dedup_lines(d, counts=True).columns.count("n_lines") == 1


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    d = docs(spark, [None, "", " ", "clean text of a few words", "clean text of a few words", "x" * 20_000])
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        out.collect()
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == 6
