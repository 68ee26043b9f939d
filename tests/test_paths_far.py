"""Walks over more edges than are broadcast send none of them through the driver."""

from quadrille.operators import paths


def test_long_walks_use_no_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(f"c{k}", f"n{k % 7}") for k in range(300)] + [(f"n{k}", f"r{k % 2}") for k in range(7)], "a string, b string")
    seeds = spark.createDataFrame([(f"c{k}",) for k in range(300)], "a string")
    plans = []

    def kept(df, label, run=paths.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return run(df, label)

    monkeypatch.setattr(paths, "materialize", kept)
    far = paths.closure(edges, seeds, 1, None, limit=50)
    near = paths.closure(edges, seeds, 1, None)
    want = {(f"c{k}", x) for k in range(300) for x in (f"n{k % 7}", f"r{k % 7 % 2}")}
    assert {tuple(r) for r in far.collect()} == {tuple(r) for r in near.collect()} == want
    assert sorted(map(tuple, paths.closure(edges, seeds, 2, 3, limit=50).collect())) == sorted((a, b) for a, b in want if b[0] == "r")
    plans.append(far.join(seeds, "a")._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
