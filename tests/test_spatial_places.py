"""Spatial joins of rows that share places, against brute force over pairs of rows."""

import json
import math
from collections import defaultdict

import pytest

from quadrille.engine import Engine
from quadrille.operators import spatial
from quadrille.sources.relational import RelationalGraph, Table

PLACES = [(0.0, 0.0), (1.5, 0.5), (179.9, 10.0), (-179.9, 10.2), (-0.0, 0.0), (30.0, 89.9), (-150.0, 89.9)]
LEFT = [(k, "POINT({} {})".format(*PLACES[k % len(PLACES)])) for k in range(60)] + [(60, "LINESTRING(0 0,1 1)"), (61, "POINT(200 0)")]
RIGHT = [(k, "POINT({} {})".format(*PLACES[k % 6])) for k in range(40)] + [(40, None)]
SIDES = "{ SELECT ?a ?ga WHERE { ?x <http://example.org/t/l#a> ?a ; <http://example.org/t/l#g> ?ga } }"
OTHER = "{ SELECT ?b ?gb WHERE { ?y <http://example.org/t/r#b> ?b ; <http://example.org/t/r#g> ?gb } }"
PRE = "PREFIX geof: <http://www.opengis.net/def/function/geosparql/> PREFIX spatialSearch: <http://quadrille.example/spatialSearch/> "


def km(p, q):
    (x, y), (u, v) = [tuple(map(math.radians, z)) for z in (p, q)]
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))


def points(rows):
    return [(k, PLACES[k % n]) for rows, n in (rows,) for k, g in rows if g and g.startswith("POINT") and "200" not in g]


@pytest.fixture
def engine(spark):
    a, b = spark.createDataFrame(LEFT, "a bigint, g string"), spark.createDataFrame(RIGHT, "b bigint, g string")
    return Engine(spark, RelationalGraph(spark, {"l": Table(a, ("a",), wkt=("g",)), "r": Table(b, ("b",), wkt=("g",))}))


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that spatial joins write, by what they are."""
    found = defaultdict(list)

    def count(df, label, run=spatial.materialize):
        out = run(df, label)
        found[label].append(out.count())
        return out

    monkeypatch.setattr(spatial, "materialize", count)
    return found


@pytest.mark.parametrize("op", ["<=", "<"])
def test_distances_are_taken_between_places(engine, written, op):
    far = km(PLACES[0], PLACES[1])
    df = engine.query(f"{PRE}SELECT ?a ?b WHERE {{ {SIDES} {OTHER} FILTER(geof:distance(?ga, ?gb) {op} {far!r}e0 && ?a != 7) }}")
    near = {(a, b) for a, p in points((LEFT, len(PLACES))) for b, q in points((RIGHT, 6)) if a != 7 and (km(p, q) < far - 1e-6 or op == "<=" and abs(km(p, q) - far) < 1e-6)}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == near
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "asin" not in plan, "the filter is not computed again for each pair of rows"
    assert written["pairs"] and max(written["pairs"]) <= 36


def test_nearest_are_sought_once_for_each_place(engine, written):
    df = engine.query(f"{PRE}SELECT ?a ?b ?d WHERE {{ {SIDES} SERVICE spatialSearch: {{ _:c spatialSearch:left ?ga ; spatialSearch:right ?gb ; spatialSearch:numNearestNeighbors 8 ; spatialSearch:maxDistance 300000 ; spatialSearch:bindDistance ?d {OTHER} }} }}")
    want, text = {}, dict(RIGHT)
    for a, p in points((LEFT, len(PLACES))):
        ranked = sorted((round(km(p, q), 6), json.dumps({"v_b": b, "v_gb": text[b]}, separators=(",", ":")), b) for b, q in points((RIGHT, 6)))
        want[a] = [(b, d) for d, _, b in ranked if d <= 300][:8]
    got = defaultdict(list)
    for r in df.collect():
        got[r["a"]].append((r["b"], round(r["d"], 6)))
    assert {a: sorted(x) for a, x in got.items()} == {a: sorted(x) for a, x in want.items() if x}
    assert max(written["near"]) <= 6 * 8, "not one for each row"
