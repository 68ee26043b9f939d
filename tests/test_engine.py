"""Semantics on small graphs written as Turtle."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quadrille.engine import Engine
from quadrille.functions import geo
from quadrille.functions.terms import E
from quadrille.operators import frames as fr
from quadrille.operators import paths
from quadrille.operators.frames import Frame, column_name
from quadrille.operators.text import TextIndex
from quadrille.plans.parser import SparqlError, parse_query
from quadrille.sources.rdfio import parse_lines, turtle
from quadrille.sources.store import SCHEMA, QuadStore

E1 = """
@prefix : <http://x/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p 1 ; :q "one"@en, "eins"@de ; :link :b .
:b :p 2.5 ; :q "two" ; :link :c .
:c :p "text" ; :link :a ; :when "2024-02-29T10:20:30Z"^^xsd:dateTime .
:d :p true ; :born "1999-12-31"^^xsd:date ; :year "2001"^^xsd:gYear ; :len "PT1H30M"^^xsd:dayTimeDuration ; :near [ :p 7 ; :near [ :p 8 ] ] .
"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, QuadStore.write(spark.createDataFrame(turtle(E1), SCHEMA)), prefixes={"": "http://x/"})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_parser_errors():
    for bad in ("SELECT ?x WHERE { ?x <p> }", "SELECT ?x { ?x <p> ?y } GROUP BY ?y", "SELECT (?x AS ?x) { ?x <p> ?y }", "ASK { ?s ?p ?o } LIMIT 1", "SELECT * { ?s ?p ?o } GROUP BY ?s", "SELECT ?s { ?s z:p ?o }", "SELECT ?s { ?s <p> ?o BIND(1 AS ?o) }"):
        with pytest.raises(SparqlError):
            parse_query(bad)


def test_mixed_types_order_and_compare(engine):
    got = [r["t"] for r in engine.query("SELECT ?t { ?s :p ?v FILTER(!isBlank(?s)) BIND(STR(?v) AS ?t) } ORDER BY ?v").collect()]
    assert got == ["true", "1", "2.5", "text"]
    assert rows(engine.query("SELECT ?s { ?s :p ?v FILTER(?v > 1) FILTER(isIRI(?s)) }")) == [("http://x/b",)]
    assert rows(engine.query('SELECT ?s { ?s :p ?v FILTER(?v != "x") }')) == [("http://x/c",)]


def test_language_and_dates(engine):
    assert rows(engine.query('SELECT ?t { :a :q ?v FILTER(LANGMATCHES(LANG(?v), "EN")) BIND(STR(?v) AS ?t) }')) == [("one",)]
    assert rows(engine.query('SELECT ?s { ?s :q "one" }')) == []
    assert rows(engine.query('SELECT ?s { ?s :q "one"@en }')) == [("http://x/a",)]
    got = engine.query("SELECT ?y ?m ?h ?z ?t { :c :when ?w BIND(YEAR(?w) AS ?y) BIND(MONTH(?w) AS ?m) BIND(HOURS(?w) AS ?h) BIND(TZ(?w) AS ?z) BIND(STR(?w) AS ?t) }")
    assert rows(got) == [(2024, 2, 10, "Z", "2024-02-29T10:20:30Z")]
    assert rows(engine.query("SELECT ?y ?m ?l { :d :year ?w ; :len ?x BIND(YEAR(?w) AS ?y) BIND(MONTH(?w) AS ?m) BIND(STR(?x) AS ?l) }")) == [(2001, None, "PT1H30M")]


def test_aggregate_poison_and_empty(engine):
    assert rows(engine.query("SELECT (SUM(?v) AS ?s) { ?x :p ?v FILTER(isIRI(?x)) }")) == [(None,)]
    assert engine.query("SELECT (AVG(?v) AS ?a) (MAX(?v) AS ?m) (STDEV(?v) AS ?d) { ?x :none ?v }").first()["m"] is None
    assert rows(engine.query("SELECT (GROUP_CONCAT(?v) AS ?g) { :a :q ?v }")) == [("eins one",)]
    assert rows(engine.query("SELECT (GROUP_CONCAT(?v) AS ?g) { ?x :p ?v }")) == [(None,)]
    assert rows(engine.query("SELECT (COUNT(DISTINCT ?v) AS ?n) { ?x :p ?v }")) == [(6,)]


def test_paths(engine):
    assert rows(engine.query("SELECT ?y { :a :link+ ?y }")) == [("http://x/a",), ("http://x/b",), ("http://x/c",)]
    assert rows(engine.query("SELECT ?x { ?x :link+ ?x }")) == [("http://x/a",), ("http://x/b",), ("http://x/c",)]
    assert rows(engine.query("SELECT ?y { :a :link{2} ?y }")) == [("http://x/c",)]
    assert rows(engine.query("SELECT ?x { ?x ^:link/:p 1 }")) == [("http://x/b",)]
    assert rows(engine.query("SELECT ?y { <http://x/nowhere> :link* ?y }")) == []
    assert engine.ask("ASK { :a :link* :a }") and not engine.ask("ASK { :d :link+ :a }")
    assert engine.query("SELECT ?x ?y { ?x :link? ?y }").count() == 3 + engine.query("SELECT DISTINCT ?n { { ?n ?p ?o } UNION { ?s ?p ?n } }").count()


def test_describe_follows_blank_nodes(engine):
    got = engine.query("DESCRIBE :d")
    assert got.where("p = 'http://x/p'").count() == 3


def test_construct_and_exports(engine):
    out = "".join(engine.export("CONSTRUCT { ?s :name ?v . [] :of ?s } WHERE { ?s :q ?v }", "ntriples"))
    assert '<http://x/a> <http://x/name> "one"@en .' in out and out.count("http://x/of") == 3
    doc = json.loads("".join(engine.export("SELECT ?s ?v ?z { ?s :p ?v OPTIONAL { ?s :q ?z FILTER(LANG(?z) = 'de') } } ORDER BY ?s", "json")))
    a = next(b for b in doc["results"]["bindings"] if b["s"]["value"] == "http://x/a")
    assert a["v"]["value"] == "1" and a["z"] == {"type": "literal", "value": "eins", "xml:lang": "de"}
    tsv = "".join(engine.export("SELECT ?v { :b :p ?v }", "tsv"))
    assert tsv == '?v\n"2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>\n'
    assert "".join(engine.export("SELECT ?v { :b :p ?v }", "csv")) == "v\n2.5\n"
    assert "<literal xml:lang=\"en\">one</literal>" in "".join(engine.export("SELECT ?v { :a :q ?v }", "xml"))
    assert "".join(engine.export("ASK { :a :p 1 }", "json")) == '{"head": {}, "boolean": true}'


def test_lines_match_turtle(spark):
    text = ['<http://x/s> <http://x/p> "a\\"b\\n\\u00e9"@en .', '<http://x/s> <http://x/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <http://x/g> .', "# note", "_:b <http://x/p> <http://x/o> .", '<http://x/s> <http://x/p> "x"^^<http://x/dt> .', '<http://x/s> <http://x/d> "2020-13-01"^^<http://www.w3.org/2001/XMLSchema#date> .']
    got = rows(parse_lines(spark.createDataFrame([(t,) for t in text], "value string")).selectExpr("s", "p", "o.k", "o.i", "o.s", "o.dt", "o.lang", "g"))
    assert ("http://x/s", "http://x/p", 4, None, 'a"b\né', None, "en", "") in got
    assert ("http://x/s", "http://x/p", 2, 5, None, None, None, "http://x/g") in got
    assert ("_:b", "http://x/p", 5, None, "http://x/o", None, None, "") in got
    assert ("http://x/s", "http://x/d", 4, None, "2020-13-01", None, None, "") in got
    with pytest.raises(Exception, match="not a statement"):
        parse_lines(spark.createDataFrame([("nonsense",)], "value string")).collect()


def test_updates_keep_snapshots(spark):
    e = Engine(spark, prefixes={"": "http://x/"})
    e.update('INSERT DATA { :a :p 1, 2 . GRAPH :g { :a :p 1 ; :q "x" } }')
    before = e.query("SELECT ?v { :a :p ?v }")
    assert rows(before) == [(1,), (2,)]  # a triple in two graphs counts once
    e.update("DELETE { ?s :p ?v } INSERT { ?s :p ?w } WHERE { ?s :p ?v BIND(?v + 10 AS ?w) }")
    assert rows(before) == [(1,), (2,)]
    assert rows(e.query("SELECT ?v { :a :p ?v }")) == [(1,), (11,), (12,)]
    assert rows(e.query("SELECT ?g ?v { GRAPH ?g { ?s :p ?v } }")) == [("http://x/g", 1)]
    e.update("ADD :g TO :h ; CLEAR GRAPH :g ; DELETE WHERE { GRAPH :h { ?s :q ?o } }")
    assert rows(e.query("SELECT ?g ?p { GRAPH ?g { ?s ?p ?v } }")) == [("http://x/h", "http://x/p")]
    e.update("DROP ALL")
    assert not e.ask("ASK { ?s ?p ?o }")
    with pytest.raises(SparqlError):
        e.update("DELETE DATA { _:b :p 1 }")


def test_undef_joins_match_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        a = [(rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), k) for k in range(7)]
        b = [(rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), k) for k in range(7)]

        def make(data, third):
            df = spark.createDataFrame(data, f"{column_name('x')} bigint, {column_name('y')} bigint, {column_name(third)} bigint")
            return Frame(df, {v: E(F.col(column_name(v)), "int", v in "xy") for v in ("x", "y", third)})

        fits = lambda r, s: all(p is None or q is None or p == q for p, q in zip(r[:2], s[:2], strict=True))
        pick = lambda p, q: q if p is None else p
        joined = [(pick(r[0], s[0]), pick(r[1], s[1]), r[2], s[2]) for r, s in itertools.product(a, b) if fits(r, s)]
        got = fr.join(make(a, "m"), make(b, "n"))
        assert rows(got.select(["x", "y", "m", "n"]).df) == sorted(joined, key=repr)
        left = joined + [(*r, None) for r in a if not any(fits(r, s) for s in b)]
        assert rows(fr.left_join(make(a, "m"), make(b, "n")).select(["x", "y", "m", "n"]).df) == sorted(left, key=repr)
        gone = [r for r in a if any(fits(r, s) and any(p is not None and p == q for p, q in zip(r[:2], s[:2], strict=True)) for s in b)]
        assert rows(fr.minus(make(a, "m"), make(b, "n")).df) == sorted((r for r in a if r not in gone), key=repr)
        has = [r for r in a if any(fits(r, s) for s in b)]
        assert rows(fr.exists(make(a, "m"), make(b, "n"), False).select(["x", "y", "m"]).df) == sorted(has, key=repr)


def test_closure_by_joins_equals_local_walk(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame(sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(25)}), "a bigint, b bigint")
    for lo, hi in ((0, None), (1, None), (2, 4)):
        assert rows(paths.closure(edges, None, lo, hi)) == rows(paths.closure(edges, None, lo, hi, limit=0))
    two = spark.createDataFrame([(0,), (1,)], "source bigint")
    ends = spark.createDataFrame([(3,), (4,), (5,)], "target bigint")
    pairs = spark.createDataFrame([(0, 4), (1, 5)], "source bigint, target bigint")
    for per_target in (None, 1, 2):
        for targets, of in ((None, None), (ends, None), (ends, pairs)):
            both = [rows(paths.all_paths(edges, two, targets, of, 4, per_target, limit)) for limit in (1000, 0)]
            assert both[0] == both[1] and both[0]


def test_paths_per_target_are_the_shortest_whatever_the_size(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 4), (1, 3), (4, 1)], "a bigint, b bigint")
    one, to = spark.createDataFrame([(1,)], "source bigint"), spark.createDataFrame([(4,)], "target bigint")
    for limit in (100, 2):
        got = paths.all_paths(edges, one, to, per_target=1, limit=limit).orderBy("edge").collect()
        assert [(r["a"], r["b"]) for r in got] == [(1, 2), (2, 4)]


def test_geometry(spark):
    w = [("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POINT(1 1)"), ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POINT(9 9)"), ("LINESTRING(0 0,4 4)", "LINESTRING(0 4,4 0)"), ("bad", "POINT(1 1)")]
    df = spark.createDataFrame(w, "a string, b string")
    f = lambda n, *x: geo.function(n, list(x)).col
    a, b = E(F.col("a"), "wkt"), E(F.col("b"), "wkt")
    got = df.select(f("sfContains", a, b).alias("c"), f("sfIntersects", a, b).alias("i"), f("sfCrosses", a, b).alias("x"), f("geometryType", a).alias("t"), f("maxX", b).alias("m")).collect()
    assert [r["c"] for r in got] == [True, False, False, None] and [r["i"] for r in got] == [True, False, True, None] and got[2]["x"]
    assert got[0]["t"].endswith("Polygon") and got[1]["m"] == 9.0


def test_text_index_from_words_file(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("hello\t0\t1\t2\nhelp\t0\t2\t5\n<http://x/e>\t1\t1\t1\n")
    e = Engine(spark, text=TextIndex.from_words(spark, f"file://{tmp_path}/w.tsv"))
    assert rows(e.query('SELECT ?t ?ql_matchingword_t_hel ?ql_score_prefix_t_hel { ?t ql:contains-word "hel*" }')) == [(1, "hello", 2.0), (2, "help", 5.0)]
    assert rows(e.query('SELECT ?t ?e { ?t ql:contains-word "hello" ; ql:contains-entity ?e }')) == [(1, "http://x/e")]
    with pytest.raises(SparqlError):
        e.query("SELECT ?t { ?t ql:contains-entity ?e }")


def test_streaming_ingest(spark, tmp_path):
    from quadrille.functions.terms import K_INT, struct
    from quadrille.streaming.ingest import ingest, snapshot

    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
    quads = lambda df: df.select(F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("s"), F.lit("http://x/v").alias("p"), struct(k=F.lit(K_INT), i=F.col("id")).alias("o"), F.lit("").alias("g"))
    ingest(stream, quads, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    e = Engine(spark, snapshot(spark, f"{tmp_path}/out"))
    assert e.query("SELECT ?s ?v { ?s <http://x/v> ?v }").count() == 5


def test_graphs_as_documents(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix : <http://x/> . :a :p 1 ; :q \"x\" .")
    (tmp_path / "b.nt").write_text("<http://x/b> <http://x/p> <http://x/c> .\n")
    e = Engine(spark)
    e.put_graph(f"file://{tmp_path}/a.ttl", "http://x/g")
    e.post_graph(f"file://{tmp_path}/b.nt", "http://x/g")
    assert e.get_graph("http://x/g").count() == 3 and not e.has_graph()
    e.put_graph(f"file://{tmp_path}/b.nt", "http://x/g")
    assert e.get_graph("http://x/g").count() == 1
    assert "Scan parquet" in e.explain("SELECT ?s { ?s <http://x/p> ?o }")
    assert not e.delete_graph("http://x/g").quads.count()


def small_store(spark):
    return QuadStore.write(spark.createDataFrame(turtle(E1), SCHEMA))


def test_distinct_with_order_on_what_is_not_selected(engine):
    got = lambda q: [r[0] for r in engine.query(q).collect()]
    assert got("SELECT DISTINCT ?x { VALUES (?x ?y) { (1 2) (1 3) (2 1) } } ORDER BY ?y") == [2, 1]
    assert got("SELECT DISTINCT ?x { VALUES (?x ?y) { (1 2) (1 3) (2 1) (UNDEF 9) (UNDEF 0) } } ORDER BY DESC(?y)") == [None, 1, 2]
    assert got("SELECT DISTINCT ?x { VALUES (?x ?y) { (1 2) (1 3) (2 1) } } ORDER BY ?x") == [1, 2]
    assert got("SELECT ?x { VALUES ?x { 3 1 2 } } ORDER BY ?x LIMIT 1 VALUES ?x { 2 3 }") == [2]


def test_turtle_literals_stay_as_they_are():
    got = turtle('@base <http://b/> . @prefix : <http://x/> .\nPREFIX q: <http://q/>\n:a q:p "mail @base and @prefix here" , "x"@base ; :r <rel> .')
    assert [r[2][4] for r in got] == ["mail @base and @prefix here", "x", "http://b/rel"]
    assert got[1][2][6] == "base"


def test_service_gets_prologue_and_bindings(spark):
    asked = []

    def fetch(url, query):
        asked.append(query)
        return {"head": {"vars": ["x", "v"]}, "results": {"bindings": [{"x": {"type": "uri", "value": "http://x/a"}, "v": {"type": "literal", "value": "1"}}]}}

    e = Engine(spark, small_store(spark), prefixes={"": "http://x/"}, fetch=fetch)
    text = "PREFIX ex: <http://e/> SELECT (STR(?x) AS ?a) (STR(?v) AS ?b) { ?x :link :b SERVICE <http://s/> { ?x ex:p ?v FILTER(?v != 'ex:') } }"
    assert rows(e.query(text)) == [("http://x/a", "1")]
    assert asked[-1].startswith("PREFIX ex: <http://e/> SELECT * WHERE { VALUES (?x) { (<http://x/a>) }  ?x ex:p ?v")
    parse_query(asked[-1], {})  # the endpoint can read it
    e.set_parameter("service-max-value-rows", 0)
    assert rows(e.query(text)) == [("http://x/a", "1")] and "VALUES" not in asked[-1]


def test_updates_write_a_log(spark):
    store = small_store(spark)
    e = Engine(spark, store, prefixes={"": "http://x/"})
    n = store.quads.count()
    for text, more in (
        ("INSERT DATA { :new :p 5 . :a :p 1 }", 1),  # the second is there
        ("DELETE DATA { :a :p 1 . :new :p 5 . :none :p 3 }", -2),
        ("INSERT DATA { :a :p 1 }", 1),
        ("DELETE { :a :p 1 } INSERT { :a :p 1 } WHERE {}", 0),
        ('INSERT DATA { :a :p "of another kind" ; :fresh :b . GRAPH :g { :a :p 1 } }', 3),
        ("DELETE WHERE { ?s :link ?o }", -3),
    ):
        e.update(text)
        n += more
        assert e.source.quads.count() == n, text
        assert e.source.base is store.base  # nothing but the log was written
    assert rows(e.query("SELECT (STR(?o) AS ?t) { :a :p ?o }")) == [("1",), ("of another kind",)]
    assert rows(e.query("SELECT ?s { ?s :fresh :b }")) == [("http://x/a",)]
    assert not rows(e.query("SELECT ?s { ?s :link ?o }")) and len(rows(Engine(spark, store, prefixes={"": "http://x/"}).query("SELECT ?s { ?s :link ?o }"))) == 3
    again = QuadStore.write(e.source.quads)
    assert rows(again.quads.select("s", "p", "o.s", "o.i", "g")) == rows(e.source.quads.select("s", "p", "o.s", "o.i", "g"))


def test_long_logs_are_merged(spark, monkeypatch):
    from quadrille.sources import store as module

    monkeypatch.setattr(module, "LOG_QUADS", 2)
    e = Engine(spark, small_store(spark), prefixes={"": "http://x/"})
    base = e.source.base
    e.update("INSERT DATA { :n1 :p 1 . :n2 :p 2 . :n3 :p 3 . :n4 :p 3 . :n5 :p 3 . :n6 :p 3 }")
    assert e.source.base is not base and e.source.added is None
    assert len(rows(e.query("SELECT ?s { ?s :p 3 }"))) == 4


def test_constant_objects_read_the_copy_sorted_by_object(spark):
    e = Engine(spark, small_store(spark), prefixes={"": "http://x/"})
    plan = e.explain("SELECT ?s { ?s :link :c }")
    assert "by_object" in plan and "EqualTo(o.s,http://x/c)" in plan and "pred" in plan
    assert "by_object" not in e.explain("SELECT ?o { :a :link ?o }")
    assert rows(e.query("SELECT ?s { ?s :link :c }")) == [("http://x/b",)]


def test_toggled_graph_cache_limits_and_documents(spark, tmp_path):
    (tmp_path / "a.nt").write_text("<http://x/b> <http://x/p> <http://x/c> .\n<http://x/d> <http://x/p> <http://x/c> .\n")
    (tmp_path / "b.nt").write_text("<http://x/d> <http://x/p> <http://x/c> .\n<http://x/e> <http://x/p> <http://x/c> .\n")
    e = Engine(spark, prefixes={"": "http://x/"})
    e.load(f"file://{tmp_path}/a.nt")
    e.set_parameter("cache-max-num-entries", 1)
    q = "SELECT ?s { ?s :p ?o } ORDER BY ?s"
    assert [r[0][-1] for r in e.rows(q)] == ["b", "d"] and q in e.results
    e.toggle_graph(f"file://{tmp_path}/b.nt")
    assert not e.results
    assert [r[0][-1] for r in e.rows(q, timeout=100)] == ["b", "e"]
    doc = json.loads("".join(e.export(q, "native", send=1)))
    assert doc["res"] == [["<http://x/b>"]] and doc["resultSizeTotal"] == 2 and doc["selected"] == ["?s"]
    assert len(json.loads("".join(e.export(q, "json", send=1)))["results"]["bindings"]) == 1
    twice = "CONSTRUCT { :x :y ?o } { ?s :p ?o }"
    assert e.query(twice).count() == 2
    e.set_parameter("construct-distinct", True)
    assert e.query(twice).count() == 1
    with pytest.raises(SparqlError):
        e.set_parameter("nothing", 1)


def test_slow_queries_are_cancelled(spark):
    from quadrille.engine import QueryTimeout

    e = Engine(spark, small_store(spark))
    slow = "SELECT (COUNT(*) AS ?n) { " + " ".join(f"?s{k} ?p{k} ?o{k} ." for k in range(5)) + " FILTER(SHA512(CONCAT(STR(?o0), STR(?o1), STR(?o2), STR(?o3), STR(?o4))) = 'x') }"
    with pytest.raises(QueryTimeout):
        e.rows(slow, timeout=1)
    assert e.rows("SELECT (1 AS ?x) {}")[0][0] == 1


def test_spatial_predicates(spark):
    points = """@prefix : <http://x/> . @prefix geo: <http://www.opengis.net/ont/geosparql#> .
    :a :at "POINT(0 0)"^^geo:wktLiteral . :b :at "POINT(0.001 0)"^^geo:wktLiteral . :c :at "POINT(1 0)"^^geo:wktLiteral . :d :is "POINT(0 0.002)"^^geo:wktLiteral . :e :is "POINT(3 0)"^^geo:wktLiteral ."""
    e = Engine(spark, QuadStore.write(spark.createDataFrame(turtle(points), SCHEMA)), prefixes={"": "http://x/"})
    q = lambda p: rows(e.query(f"SELECT ?x ?y {{ ?x :at ?g . ?y :is ?h . ?g <{p}> ?h }}"))
    x = lambda *names: sorted((f"http://x/{a}", f"http://x/{b}") for a, b in names)
    assert q("max-distance-in-meters:300") == x("ad", "bd")
    assert q("nearest-neighbors:1") == x("ad", "bd", "cd")
    assert q("nearest-neighbors:2:300") == x("ad", "bd")
    for bad in ("max-distance-in-meters:x", "nearest-neighbors:-1"):
        with pytest.raises(SparqlError):
            q(bad)
    with pytest.raises(SparqlError):
        e.query("SELECT ?g { ?x :at ?g ; :at ?h . ?g <nearest-neighbors:1> ?h }")


def test_text_index_saved_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "hello world hello"), (2, "world of words")], "rec bigint, text string")
    TextIndex.build(docs, scoring="bm25").save(f"file://{tmp_path}/t")
    for scoring in ("count", "tfidf", "bm25"):
        want, got = (rows(i.word("t", "hello", "s").df.select("v_s")) for i in (TextIndex.build(docs, scoring=scoring), TextIndex.load(spark, f"file://{tmp_path}/t", scoring)))
        assert want == got and len(got) == 1
    e = Engine(spark, text=TextIndex.load(spark, f"file://{tmp_path}/t"))
    e.set_parameter("min-prefix-size", 4)
    with pytest.raises(SparqlError):
        e.query('SELECT ?t { ?t ql:contains-word "hel*" }')
    assert e.query('SELECT ?t { ?t ql:contains-word "worl*" }').count() == 2
