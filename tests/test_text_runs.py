"""A text index made of sorted runs, against counts by brute force."""

import math
from collections import Counter

from quadrille.operators.text import TextIndex, counted

DOCS = [(1, "the cat and The dog"), (2, "and AND and"), (1, "the end"), (3, None), (4, "größe the 42"), (None, "the lost")]


def test_runs_are_sorted_and_need_no_shuffle(spark):
    df = counted(spark.createDataFrame(DOCS, "rec bigint, text string").coalesce(1), 4)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = Counter((w, r) for r, t in DOCS for w in (t or "").lower().split())
    got = Counter()
    for r in df.collect():
        got[r["word"], r["rec"]] += int(r["score"])
    assert got == want
    rows = [(r["word"], r["rec"] is None, r["rec"]) for r in counted(spark.createDataFrame(DOCS, "rec bigint, text string").coalesce(1), 10**6).collect()]
    assert rows == sorted(rows, key=lambda x: (x[0].encode(), x[1], x[2] or 0)) and len(rows) == len(want)


def test_counts_in_several_runs_are_added(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "rec bigint, text string").repartition(4)
    index = TextIndex.build(docs, scoring="bm25")
    assert index.runs
    length = Counter()
    for r, t in DOCS:
        length[r] += len((t or "").split())
    mean = sum(length.values()) / len([r for r in length if length[r]])
    tf = Counter(r for r, t in DOCS for w in (t or "").lower().split() if w == "the")
    idf = math.log2(len(length) / len(tf))
    bm25 = {r: n * 2.75 / (1.75 * (0.25 + 0.75 * length[r] / mean) + n) * idf for r, n in tf.items()}
    index.save(f"file://{tmp_path}/i")
    for i in (index, TextIndex.load(spark, f"file://{tmp_path}/i", "bm25")):
        got = {r["v_d"]: r["v_s"] for r in i.word("d", "the", "s").df.collect() if r["v_d"] is not None}
        assert set(got) == {1, 4} and all(abs(got[r] - bm25[r]) < 1e-9 for r in got)
        assert sorted(r["v_s"] for r in i.scored_by("count").word("d", "the", "s").df.collect()) == sorted(map(float, tf.values()))
