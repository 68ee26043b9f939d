"""Queries that range over the whole graph, against brute force over the rows of all tables."""

import unicodedata
from collections import Counter

from quadrille.queries import KEYS, QUERIES, REFS

SF = "/root/testdata/sf0.001"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
T = "http://example.org/t/"


def words(s):
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in s.lower()).split()


def test_whole_graph_queries(spark, tmp_path):
    pred, graphs, found, subjects = Counter(), Counter(), Counter(), []
    for name in KEYS:
        df = spark.createDataFrame(spark.read.parquet(f"{SF}/{name}.parquet").limit(4).collect(), spark.read.parquet(f"{SF}/{name}.parquet").schema)
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        for r in df.collect():
            have = {c: v for c, v in r.asDict().items() if v is not None}
            graphs[f"{T}graph/{name}"] += 1
            mine = [TYPE, *(f"{T}{name}#{c}" for c in have), *(f"{T}{name}#ref-{c}" for c in REFS.get(name, {}) if c in have)]
            pred.update(mine)
            found.update(w for v in have.values() if isinstance(v, str) for w in words(v))
            subjects.append(len([p for p in mine if p not in (TYPE, T + "nation#n_name", T + "nation#n_regionkey")]))
    want = {"path_negated": sorted(subjects), "graph_var": graphs, "has_word": found}
    for name in ("scan_var_predicate", "path_negated", "has_predicate", "predicate_counts", "graph_var", "has_word"):
        rows = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        if name == "path_negated":
            assert len({s for s, _ in rows}) == len(rows) and sorted(n for _, n in rows) == want[name]
        else:
            expect = dict(want.get(name, pred))
            assert dict(rows) == expect, (name, list(set(rows) ^ set(expect.items()))[:12])


def test_distinct_subjects_are_counted_without_triples(spark):
    """Keys that repeat, keys that are null and rows without a key: as brute force over triples has it."""
    from quadrille.engine import Engine
    from quadrille.sources.relational import BASE, RelationalGraph, Table

    a = spark.createDataFrame([(1, "x", None), (1, None, 2.0), (2, "y", None), (None, "z", None)], "k int, s string, d double")
    b = spark.createDataFrame([("u", 1), ("u", 1), (None, 2)], "s string, n int")
    g = RelationalGraph(spark, {"a": Table(a, ("k",)), "b": Table(b)})
    df = Engine(spark, g).query("SELECT ?p (COUNT(DISTINCT ?s) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p")
    triples, c = g.any_predicate(None, None)
    want = Counter()
    for p, s in {(r["p"], r["s"]) for r in triples.collect()}:
        want[p] += s is not None
    assert dict(map(tuple, df.collect())) == want and want[TYPE] == 5 and want[f"{BASE}a#s"] == 2
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan


def test_rows_without_a_key_are_named_without_a_shuffle(spark, tmp_path):
    """Equal rows in several files are subjects of their own, the same ones in every scan."""
    from quadrille.queries import engine, graph

    for name in KEYS:
        df = spark.read.parquet(f"{SF}/{name}.parquet").limit(20)
        (df.union(df).repartition(3) if name == "lineitem" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = spark.read.parquet(f"{tmp_path}/lineitem.parquet").count()
    s = graph(spark, str(tmp_path), "lineitem").any_predicate(None, None)[0].select("s", "p")
    assert s.select("s").distinct().count() == rows == s.where(f"p = '{TYPE}'").count()
    same = engine(spark, str(tmp_path), "lineitem").query("SELECT (COUNT(*) AS ?n) WHERE { ?l ?p ?o . ?l lineitem:l_quantity ?q FILTER(?p = lineitem:l_quantity && ?o = ?q) }")
    assert same.first()["n"] == rows
    for name in ("path_negated", "has_predicate"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan, name
