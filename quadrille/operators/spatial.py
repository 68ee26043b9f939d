"""Spatial joins without cross joins.

Points are put on a sphere and hashed to a grid of cubes as wide as the chord of the
distance; a point is compared with those of its own and the 26 neighbouring cubes, so
neither poles nor the date line are special. The nearest neighbours come from joins with
growing distances: only places that have too few neighbours go to the next round. Rows at
one place share its distances and neighbours. Other geometries are joined by grid cells that their boxes touch; a pair is taken in one cell."""

from __future__ import annotations

import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import GEOF, Scope, compile_expr
from ..functions.terms import E, ebv
from ..plans.algebra import Call, Lit, Var
from ..shared import materialize
from .frames import Frame, column_name

_DISTANCE = "_:distance"
REPEATED = 4  # pairs of rows for each pair of places from which places are joined first
TASK_ROWS = 20_000_000  # results that a task makes of repeated places
MOST_TASKS = 5_000


def _xyz(lng: Column, lat: Column) -> list[Column]:
    a, b = F.radians(lng), F.radians(lat)
    r = geo.EARTH_KM
    return [F.cos(b) * F.cos(a) * r, F.cos(b) * F.sin(a) * r, F.sin(b) * r]


def _prepared(df: DataFrame, e: E, tag: str) -> DataFrame:
    """Rows with a point, and its coordinates. The text is read once: a generator isn't copied
    into what uses its rows."""
    df = df.select("*", F.explode(F.array(geo.point(geo.wkt(e)))).alias("_p")).where("_p is not null")
    return df.withColumn(f"_x{tag}", F.col("_p.x")).withColumn(f"_y{tag}", F.col("_p.y")).drop("_p")


def _near(a: DataFrame, b: DataFrame, km: float, spread: str = "b") -> DataFrame:
    """Pairs of prepared rows within a distance, with column _km. ``spread``: the side whose
    rows are copied to the neighbouring cubes."""
    if km >= math.pi * geo.EARTH_KM:
        pairs = a.crossJoin(b)  # every pair is asked for
    else:
        size = max(2 * geo.EARTH_KM * math.sin(km / (2 * geo.EARTH_KM)), 1e-6) * (1 + 1e-9)
        cell = lambda d, tag: d.select("*", *[F.floor(c / size).alias(n) for c, n in zip(_xyz(F.col(f"_x{tag}"), F.col(f"_y{tag}")), ("_ci", "_cj", "_ck"), strict=True)])
        near = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]

        def copied(d: DataFrame) -> DataFrame:
            d = d.select("*", F.explode(F.array(*near)).alias("_n"))
            return d.withColumns({f"_c{x}": F.col(f"_c{x}") + F.col(f"_n.{x}") for x in "ijk"}).drop("_n")

        left, right = cell(a, "a"), cell(b, "b")
        left, right = (copied(left), right) if spread == "a" else (left, copied(right))
        pairs = left.join(right, ["_ci", "_cj", "_ck"]).drop("_ci", "_cj", "_ck")
    d = geo.haversine_km(F.col("_xa"), F.col("_ya"), F.col("_xb"), F.col("_yb"))
    return pairs.withColumn("_km", d).where(F.col("_km") <= km)


def _joined(pa: DataFrame, pb: DataFrame, km: float, keep: Column | None) -> DataFrame:
    """Pairs of rows within a distance for which ``keep``, a condition on _km, holds. Where
    places repeat, distances are taken between places, and only pairs that are results are
    pairs of rows; rows are dealt out by the number of results, not by place."""
    if km >= math.pi * geo.EARTH_KM:
        pairs = _near(pa, pb, km)
        return pairs if keep is None else pairs.where(keep)
    pa, pb = materialize(pa, "left"), materialize(pb, "right")  # evaluated once
    at = [materialize(d.groupBy(f"_x{t}", f"_y{t}").agg(F.count(F.lit(1)).alias(f"_n{t}")), "places") for d, t in ((pa, "a"), (pb, "b"))]
    (rows_a, places_a), (rows_b, places_b) = [tuple(d.agg(F.coalesce(F.sum(f"_n{t}"), F.lit(0)), F.count(F.lit(1))).first()) for d, t in zip(at, "ab", strict=True)]
    if rows_a * rows_b < REPEATED * places_a * places_b:
        pairs = _near(pa, pb, km)
        return pairs if keep is None else pairs.where(keep)
    pairs = _near(*at, km)
    pairs = materialize(pairs if keep is None else pairs.where(keep), "pairs")
    total = pairs.agg(F.sum(F.col("_na").cast("double") * F.col("_nb"))).first()[0] or 0
    tasks = min(MOST_TASKS, max(pa.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_ROWS)))
    return pa.repartition(tasks).join(pairs.drop("_na", "_nb"), ["_xa", "_ya"]).join(pb, ["_xb", "_yb"])


def _finish(df: DataFrame, a: Frame, b: Frame, distance: str | None) -> Frame:
    env = dict(a.env) | dict(b.env)
    if distance:
        df = df.withColumn(column_name(distance), F.col("_km"))
        env[distance] = E(F.col(column_name(distance)), "dbl", False)
    return Frame(df.select(*[column_name(v) for v in env]), env)


def within(a: Frame, left: str, b: Frame, right: str, metres: float, distance: str | None = None, keep: Column | None = None) -> Frame:
    """Pairs of points at most so many metres apart; ``distance`` names the km between them,
    ``keep`` is a further condition on these (column _km)."""
    pa = _prepared(a.df, E(a.col(left), a.env[left].kind, True), "a")
    pb = _prepared(b.df, E(b.col(right), b.env[right].kind, True), "b")
    return _finish(_joined(pa, pb, metres / 1000, keep), a, b, distance)


def nearest(a: Frame, left: str, b: Frame, right: str, k: int, metres: float | None = None, distance: str | None = None) -> Frame:
    """The ``k`` nearest points of ``b`` for each row of ``a``; ties go by the row's text. They
    are sought once for each place, among the first ``k`` rows of every other: no more of one
    place can be among the nearest."""
    pa = materialize(_prepared(a.df, E(a.col(left), a.env[left].kind, True), "a"), "points")
    pb = _prepared(b.df, E(b.col(right), b.env[right].kind, True), "b").withColumn("_text", F.to_json(F.struct(*[F.col(column_name(v)) for v in b.env])))
    same = Window.partitionBy("_xb", "_yb").orderBy("_text")
    pb = materialize(pb.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r"), "points")
    todo = materialize(pa.select("_xa", "_ya").distinct(), "places")
    n = pb.count()
    top = math.pi * geo.EARTH_KM + 1
    limit = min(top, metres / 1000) if metres is not None else top
    km = min(limit, max(0.1, 2 * geo.EARTH_KM * math.sqrt(4 * k / max(n, 1))))
    order = Window.partitionBy("_xa", "_ya").orderBy("_km", "_text")
    out = None
    while True:
        last = km >= limit or n <= k
        if last and km < limit:
            km = limit
            continue
        near = _near(todo, pb, km, spread="a").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        near = materialize(near.drop("_text", "_xb", "_yb"), "near")
        full = near.where(F.col("_r") == k).select("_xa", "_ya")
        done = near if last else near.join(full, ["_xa", "_ya"], "left_semi")
        out = done if out is None else out.unionByName(done)
        if not last:
            todo = materialize(todo.join(full, ["_xa", "_ya"], "left_anti"), "left")
            last = todo.isEmpty()
        if last:
            return _finish(pa.join(out.drop("_r"), ["_xa", "_ya"]), a, b, distance)
        km = min(limit, km * 4)


def _boxes(metres: float):
    schema = "struct<x0:double,y0:double,x1:double,y1:double>"

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        found = []
        for t in s:
            g = geo.parse(t)
            c = g.coords() if g is not None else ()
            found.append((*c.min(axis=0), *c.max(axis=0)) if len(c) else (None,) * 4)
        return pd.DataFrame(found, columns=["x0", "y0", "x1", "y1"], dtype=float)

    return run


def related(a: Frame, left: str, b: Frame, right: str, relation: str, cell: float = 1.0) -> Frame:
    """Pairs of geometries in a simple-feature relation. ``cell``: width of the grid, degrees."""
    box = _boxes(0.0)
    ga, gb = geo.wkt(E(a.col(left), a.env[left].kind, True)), geo.wkt(E(b.col(right), b.env[right].kind, True))

    def celled(df: DataFrame, w: Column, tag: str) -> DataFrame:
        d = df.withColumn(f"_w{tag}", w).where(F.col(f"_w{tag}").isNotNull()).withColumn(f"_b{tag}", box(F.col(f"_w{tag}"))).where(F.col(f"_b{tag}.x0").isNotNull())
        lo = lambda n: F.floor(F.col(f"_b{tag}.{n}") / cell).cast("int")
        d = d.withColumn("_ci", F.explode(F.sequence(lo("x0"), lo("x1"))))
        return d.withColumn("_cj", F.explode(F.sequence(lo("y0"), lo("y1"))))

    pairs = celled(a.df, ga, "a").join(celled(b.df, gb, "b"), ["_ci", "_cj"])
    # Boxes that meet share the cell of the lower corner of their common part: once a pair.
    x, y = F.greatest(F.col("_ba.x0"), F.col("_bb.x0")), F.greatest(F.col("_ba.y0"), F.col("_bb.y0"))
    meet = (x <= F.least(F.col("_ba.x1"), F.col("_bb.x1"))) & (y <= F.least(F.col("_ba.y1"), F.col("_bb.y1")))
    pairs = pairs.where(meet & (F.floor(x / cell) == F.col("_ci")) & (F.floor(y / cell) == F.col("_cj")))
    return _finish(pairs.where(geo.relation_udf(relation)(F.col("_wa"), F.col("_wb"))), a, b, None)


def from_filter(e: Any, a: Frame, b: Frame) -> Frame | None:
    """A spatial join for FILTER(geof:distance(?x, ?y) <= c) or FILTER(geof:sf...(?x, ?y))
    over two patterns that share no variable. The filter holds for all pairs on a distance,
    else it is still to be applied."""
    if not isinstance(e, Call):
        return None
    relate = e.name == GEOF + "relate" and len(e.args) == 3 and isinstance(e.args[2], Lit)
    if (relate or e.name.startswith(GEOF + "sf")) and all(isinstance(x, Var) for x in e.args[:2]):
        p, q = (x.name for x in e.args[:2])
        name = geo.named_relation(e.args[2].value) if relate else e.name[len(GEOF) + 2 :].lower()
        if name == "disjoint":  # no cells in common: for pairs of all rows, the filter decides
            return None
        if p in a.env and q in b.env:
            return related(a, p, b, q, name)
        if q in a.env and p in b.env and name in ("intersects", "equals", "touches", "overlaps", "crosses"):
            return related(a, q, b, p, name)
        return None
    if e.name in ("<=", "<") and isinstance(e.args[0], Call) and e.args[0].name in (GEOF + "distance", GEOF + "metricDistance") and isinstance(e.args[1], Lit):
        call = e.args[0]
        if not all(isinstance(x, Var) for x in call.args[:2]):
            return None
        if len(call.args) > 2 and not hasattr(call.args[2], "value"):
            return None
        unit = 1.0 if call.name.endswith("metricDistance") else geo.LENGTH_UNITS[call.args[2].value.rsplit("/", 1)[-1]] if len(call.args) > 2 and hasattr(call.args[2], "value") else 1000.0
        p, q = (x.name for x in call.args[:2])
        metres = float(e.args[1].value) * unit * (1 + 1e-9)
        km = E(F.col("_km") * (1000.0 / unit), "dbl", True)
        keep = ebv(compile_expr(Call(e.name, (Var(_DISTANCE), e.args[1])), Scope({_DISTANCE: km})))
        if p in a.env and q in b.env:
            return within(a, p, b, q, metres, keep=keep)
        if q in a.env and p in b.env:
            return within(a, q, b, p, metres, keep=keep)
    return None
