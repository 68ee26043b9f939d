"""GeoSPARQL functions. Points and boxes are computed in the JVM; other geometries are
parsed in Arrow batches with numpy (no geometry library is needed)."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import IRI
from ..plans.parser import SparqlError
from .terms import K_GEO, K_LIT, WKT, E, as_double

EARTH_KM = 6371.0088
LENGTH_UNITS = {"M": 1.0, "KiloM": 1000.0, "MI": 1609.344, "FT": 0.3048, "YD": 0.9144, "CentiM": 0.01, "NauticalMI": 1852.0}
AREA_UNITS = {"M2": 1.0, "KiloM2": 1e6, "MI2": 1609.344**2, "FT2": 0.3048**2, "YD2": 0.9144**2, "AC": 4046.8564224, "ARE": 100.0, "HA": 10_000.0, "CentiM2": 1e-4}
_NUM = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
POINT = rf"(?i)^\s*POINT\s*\(\s*({_NUM})\s+({_NUM})\s*\)\s*$"


def wkt(e: E) -> Column:
    """The text of a geometry; NULL for other terms."""
    if e.kind == "wkt":
        return e.col
    if e.kind == "term":
        return F.when((e.col["k"] == K_GEO) | ((e.col["k"] == K_LIT) & (e.col["dt"] == WKT)), e.col["s"])
    return F.lit(None).cast("string")


def point(w: Column) -> Column:
    """struct(x, y) of a point on Earth; NULL for other geometries. The lambdas keep the
    text from being copied into every place that reads a coordinate."""
    part = lambda s, k: F.regexp_extract(s, POINT, k).try_cast("double")
    read = F.transform(F.array(w), lambda s: F.when(s.rlike(POINT), F.struct(part(s, 1).alias("x"), part(s, 2).alias("y"))))
    return F.get(F.filter(read, lambda p: (F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90)), F.lit(0))


def lng_lat(w: Column) -> tuple[Column, Column]:
    """Coordinates of a point; NULL for other geometries and for places not on Earth."""
    p = point(w)
    return p["x"], p["y"]


def haversine_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    a, b = F.radians(y1), F.radians(y2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_KM)


_TEXT = re.compile(r"\s*(MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION|POINT|LINESTRING|POLYGON)\s*(.*)\Z", re.I | re.S)


class Geometry:
    """kind, and parts: points (n, 2 arrays), lines, polygons (lists of rings)."""

    def __init__(self, kind: str, points=(), lines=(), polygons=(), members=()):
        self.kind, self.points, self.lines, self.polygons, self.members = kind, list(points), list(lines), list(polygons), list(members)

    def coords(self) -> np.ndarray:
        found = [np.array(p).reshape(1, 2) for p in self.points] + [*self.lines] + [r for p in self.polygons for r in p]
        return np.concatenate(found) if found else np.empty((0, 2))


def _ring(s: str) -> np.ndarray:
    return np.array([[float(x) for x in p.split()[:2]] for p in s.split(",")]).reshape(-1, 2)


def _split(s: str) -> list[str]:
    """Top-level parenthesised parts."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(s):
        if c == "(":
            depth += 1
            if depth == 1:
                at = k + 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                out.append(s[at:k])
    if depth:
        raise ValueError("parentheses")
    return out


def _members(s: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(s + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(s[at:k])
            at = k + 1
    return out


def parse(s: str | None) -> Geometry | None:
    m = s and _TEXT.match(s)
    if not m:
        return None
    kind, body = m[1].upper(), m[2].strip()
    try:
        (inner,) = _split(body)
        if kind == "POINT":
            return Geometry(kind, points=[_ring(inner)[0]])
        if kind == "LINESTRING":
            return Geometry(kind, lines=[_ring(inner)])
        if kind == "POLYGON":
            return Geometry(kind, polygons=[[_ring(r) for r in _split(inner)]])
        if kind == "MULTIPOINT":
            return Geometry(kind, points=list(_ring(inner.replace("(", " ").replace(")", " "))), members=[f"POINT({p.strip(' ()')})" for p in inner.split(",")])
        if kind == "MULTILINESTRING":
            return Geometry(kind, lines=[_ring(r) for r in _split(inner)], members=[f"LINESTRING({r})" for r in _split(inner)])
        if kind == "MULTIPOLYGON":
            return Geometry(kind, polygons=[[_ring(r) for r in _split(p)] for p in _split(inner)], members=[f"POLYGON({p})" for p in _split(inner)])
        parts = [parse(x) for x in _members(inner)]
        if None in parts:
            return None
        return Geometry(kind, [p for g in parts for p in g.points], [x for g in parts for x in g.lines], [p for g in parts for p in g.polygons], [x.strip() for x in _members(inner)])
    except (ValueError, IndexError):
        return None


def _km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[..., 1] - a[..., 1]) / 2) ** 2 + np.cos(a[..., 1]) * np.cos(b[..., 1]) * np.sin((b[..., 0] - a[..., 0]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))


def length_m(g: Geometry) -> float:
    lines = g.lines + [r for p in g.polygons for r in p]
    return float(sum(_km(x[:-1], x[1:]).sum() for x in lines)) * 1000


def area_m2(g: Geometry) -> float:
    def ring(r):
        lng, lat = np.radians(r[:, 0]), np.radians(r[:, 1])
        return abs(float(((np.roll(lng, -1) - lng) * (2 + np.sin(lat) + np.sin(np.roll(lat, -1)))).sum())) / 2 * (EARTH_KM * 1000) ** 2

    return sum(ring(p[0]) - sum(ring(h) for h in p[1:]) for p in g.polygons)


def centroid(g: Geometry) -> tuple[float, float]:
    if g.polygons:
        total, cx, cy = 0.0, 0.0, 0.0
        for p in g.polygons:
            for k, r in enumerate(p):
                x, y = r[:, 0], r[:, 1]
                c = x * np.roll(y, -1) - np.roll(x, -1) * y
                a = c.sum() / 2
                sign = (1 if a >= 0 else -1) * (1 if k == 0 else -1)
                total += sign * a
                cx += sign * ((x + np.roll(x, -1)) * c).sum() / 6
                cy += sign * ((y + np.roll(y, -1)) * c).sum() / 6
        if total:
            return cx / total, cy / total
    if g.lines:
        mid = np.concatenate([(x[:-1] + x[1:]) / 2 for x in g.lines])
        w = np.concatenate([np.hypot(*(x[1:] - x[:-1]).T) for x in g.lines])
        if w.sum():
            return tuple((mid * w[:, None]).sum(axis=0) / w.sum())
    return tuple(g.coords().mean(axis=0))


def _segments(g: Geometry) -> np.ndarray:
    found = [np.stack([x[:-1], x[1:]], axis=1) for x in g.lines + [r for p in g.polygons for r in p] if len(x) > 1]
    return np.concatenate(found) if found else np.empty((0, 2, 2))


def _place(p: np.ndarray, g: Geometry) -> int:
    """1 inside, 0 on the boundary, -1 outside of the polygons of a geometry."""
    best = -1
    for rings in g.polygons:
        inside = False
        for r in rings:
            a, b = r[:-1], r[1:]
            if not np.array_equal(r[0], r[-1]):
                a, b = r, np.roll(r, -1, axis=0)
            cross = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])
            on = (np.abs(cross) < 1e-12) & (np.minimum(a, b) <= p + 1e-12).all(axis=1) & (np.maximum(a, b) >= p - 1e-12).all(axis=1)
            if on.any():
                return 0
            up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
            with np.errstate(divide="ignore", invalid="ignore"):
                x = a[:, 0] + (p[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
            inside ^= bool((up & (p[0] < x)).sum() % 2)
        if inside:
            best = 1
    return best


def _crossings(a: np.ndarray, b: np.ndarray) -> tuple[bool, bool]:
    """(segments meet at all, some cross in their interiors)."""
    if not len(a) or not len(b):
        return False, False
    p, q = a[:, None, 0], a[:, None, 1]
    r, s = b[None, :, 0], b[None, :, 1]
    side = lambda u, v, w: (v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0])
    d1, d2, d3, d4 = side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)
    proper = (d1 * d2 < 0) & (d3 * d4 < 0)
    box = lambda u, v, w: (np.minimum(u, v) <= w).all(-1) & (np.maximum(u, v) >= w).all(-1)
    touch = ((d1 == 0) & box(p, q, r)) | ((d2 == 0) & box(p, q, s)) | ((d3 == 0) & box(r, s, p)) | ((d4 == 0) & box(r, s, q))
    return bool((proper | touch).any()), bool(proper.any())


def _samples(g: Geometry) -> np.ndarray:
    """Points that stand for a geometry: its vertices and the middles of its segments."""
    seg = _segments(g)
    return np.concatenate([g.coords(), seg.mean(axis=1)]) if len(seg) else g.coords()


def _on_lines(p: np.ndarray, seg: np.ndarray) -> bool:
    if not len(seg):
        return False
    a, b = seg[:, 0], seg[:, 1]
    cross = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])
    return bool(((np.abs(cross) < 1e-12) & (np.minimum(a, b) <= p + 1e-12).all(axis=1) & (np.maximum(a, b) >= p - 1e-12).all(axis=1)).any())


def relation(name: str, a: Geometry, b: Geometry) -> bool:
    """Simple-feature relations between two geometries in the plane of degrees."""
    if name == "within":
        return relation("contains", b, a)
    ca, cb = a.coords(), b.coords()
    if not len(ca) or not len(cb) or (ca.min(axis=0) > cb.max(axis=0)).any() or (cb.min(axis=0) > ca.max(axis=0)).any():
        return False
    sa, sb = _segments(a), _segments(b)
    meet, proper = _crossings(sa, sb)

    def where(p, g, seg):  # 1 interior, 0 boundary, -1 outside
        if g.polygons:
            return _place(p, g)
        if len(seg):
            return 1 if _on_lines(p, seg) else -1
        return 1 if (np.abs(g.coords() - p).max(axis=1) < 1e-12).any() else -1

    in_b = [where(p, b, sb) for p in _samples(a)]
    in_a = [where(p, a, sa) for p in _samples(b)]
    meets = meet or max(in_b) >= 0 or max(in_a) >= 0
    interior = proper or max(in_b) > 0 or max(in_a) > 0
    if a.polygons and b.polygons and not interior and min(in_b) == 0 and min(in_a) == 0:
        interior = True  # equal areas
    if name == "intersects":
        return meets
    if name == "equals":
        return min(in_b) >= 0 and min(in_a) >= 0 and not proper
    if name == "covers":
        return min(in_a) >= 0 and not proper
    if name == "contains":
        return min(in_a) >= 0 and not proper and (interior or max(in_a) > 0)
    dim = lambda g: 2 if g.polygons else 1 if g.lines else 0
    if name == "touches":
        if not (meets and not interior):
            if dim(a) == dim(b) == 1 and meets and not proper:  # lines that meet at ends only
                ends = np.concatenate([x[[0, -1]] for x in a.lines + b.lines])
                hit = [p for p, w in zip(_samples(a), in_b, strict=True) if w >= 0] + [p for p, w in zip(_samples(b), in_a, strict=True) if w >= 0]
                return bool(hit) and all((np.abs(ends - p).max(axis=1) < 1e-12).any() for p in hit)
            return False
        return True
    if name == "crosses":
        if dim(a) == dim(b) == 1:
            return proper
        if dim(a) < dim(b):
            return interior and (min(in_b) < 0 or proper)
        return dim(a) > dim(b) and interior and (min(in_a) < 0 or proper)
    if name == "overlaps":
        return dim(a) == dim(b) and (interior if dim(a) else max(in_b) > 0) and (min(in_b) < 0 or proper) and (min(in_a) < 0 or proper)
    raise SparqlError(f"unknown relation {name}")


def _map(kind: str, f):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(g) if (g := parse(x)) is not None else None for x in s], dtype=object)

    return run


def relation_udf(name: str):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        cache: dict = {}

        def of(s):
            if s not in cache:
                cache[s] = parse(s)
            return cache[s]

        return pd.Series([None if (g := of(x)) is None or (h := of(y)) is None else relation(name, g, h) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


#: Patterns of DE-9IM and the relations that they stand for (fixed values of the standard).
DE9IM = {"T*F**FFF*": "equals", "T*****FF*": "contains", "T*F**F***": "within", "T********": "intersects", "FT*******": "touches", "F**T*****": "touches", "F***T****": "touches", "T*T***T**": "overlaps", "T*T******": "crosses", "FF*FF****": "disjoint"}


def named_relation(pattern: str) -> str:
    if pattern.upper() not in DE9IM:
        raise SparqlError("this DE-9IM pattern is not supported")
    return DE9IM[pattern.upper()]


def _unit(e: E | None, table: dict[str, float], default: str) -> float:
    if e is None:
        return table[default]
    if isinstance(e.const, IRI):
        name = e.const.value.rsplit("/", 1)[-1]
    elif e.const is not None:
        name = e.const.value.rsplit("/", 1)[-1]
    else:
        raise SparqlError("the unit must be constant")
    if name not in table:
        raise SparqlError(f"unknown unit {name}")
    return table[name]


def distance_km(a: E, b: E) -> Column:
    """Great-circle distance of two points, km."""
    return haversine_km(*lng_lat(wkt(a)), *lng_lat(wkt(b)))


def _box(corner: str):
    def f(g):
        c = g.coords()
        lo, hi = c.min(axis=0), c.max(axis=0)
        if corner == "low":
            return f"POINT({lo[0]:g} {lo[1]:g})"
        if corner == "high":
            return f"POINT({hi[0]:g} {hi[1]:g})"
        return f"POLYGON(({lo[0]:g} {lo[1]:g},{hi[0]:g} {lo[1]:g},{hi[0]:g} {hi[1]:g},{lo[0]:g} {hi[1]:g},{lo[0]:g} {lo[1]:g}))"

    return f


def simplify(g: Geometry, tolerance: float) -> Geometry:
    """Douglas-Peucker on every line and ring."""

    def thin(r):
        if len(r) < 3:
            return r
        keep, todo = {0, len(r) - 1}, [(0, len(r) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d = r[b] - r[a]
            n = np.hypot(*d)
            v = r[a + 1 : b] - r[a]
            dist = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / n if n else np.hypot(*v.T)
            k = int(dist.argmax())
            if dist[k] > tolerance:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return r[sorted(keep)]

    return Geometry(g.kind, g.points, [thin(x) for x in g.lines], [[t if len(t := thin(r)) > 3 else r for r in p] for p in g.polygons])


def to_wkt(g: Geometry) -> str:
    line = lambda r: ",".join(f"{x:.12g} {y:.12g}" for x, y in r)
    poly = lambda p: ",".join(f"({line(r)})" for r in p)
    parts = {"POINT": lambda: line(g.points), "MULTIPOINT": lambda: line(g.points), "LINESTRING": lambda: line(g.lines[0]), "MULTILINESTRING": lambda: ",".join(f"({line(x)})" for x in g.lines), "POLYGON": lambda: poly(g.polygons[0]), "MULTIPOLYGON": lambda: ",".join(f"({poly(p)})" for p in g.polygons)}
    return f"{g.kind}({parts[g.kind]()})" if g.kind in parts else ""


def function(name: str, a: list[E]) -> E:
    w = wkt(a[0])
    is_point = w.rlike(POINT)
    x, y = lng_lat(w)
    if name == "longitude":
        return E(x, "dbl", True)
    if name == "latitude":
        return E(y, "dbl", True)
    if name in ("distance", "metricDistance"):
        scale = 1.0 if name == "metricDistance" else _unit(a[2] if len(a) > 2 else None, LENGTH_UNITS, "KiloM")
        return E(distance_km(a[0], a[1]) * (1000.0 / scale), "dbl", True)
    if name == "geometryType":
        kind = F.upper(F.regexp_extract(w, r"^\s*([A-Za-z]+)", 1))
        names = F.create_map(*[F.lit(v) for n in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection") for v in (n.upper(), "http://www.opengis.net/ont/sf#" + n)])
        return E(names[kind], "iri", True)
    if name in ("minX", "maxX", "minY", "maxY"):
        axis, low = "XY".index(name[-1]), name.startswith("min")
        slow = _map("double", lambda g: float((g.coords().min(axis=0) if low else g.coords().max(axis=0))[axis]))
        return E(F.when(is_point, (x, y)[axis]).otherwise(slow(w)), "dbl", True)
    if name == "centroid":
        return E(F.when(is_point, w).otherwise(_map("string", lambda g: "POINT({:.12g} {:.12g})".format(*centroid(g)))(w)), "wkt", True)
    if name == "envelope":
        return E(_map("string", _box("all"))(w), "wkt", True)
    if name in ("envelopeLowerLeft", "envelopeUpperRight"):
        return E(F.when(is_point, w).otherwise(_map("string", _box("low" if "Lower" in name else "high"))(w)), "wkt", True)
    if name == "simplifyGeometry":
        if a[1].const is None:
            raise SparqlError("the tolerance must be constant")
        tolerance = float(a[1].const.value)
        return E(F.when(is_point, w).otherwise(_map("string", lambda g: to_wkt(simplify(g, tolerance)))(w)), "wkt", True)
    if name in ("metricLength", "length"):
        scale = 1.0 if name == "metricLength" else _unit(a[1] if len(a) > 1 else None, LENGTH_UNITS, "M")
        return E(F.when(is_point, F.lit(0.0)).otherwise(_map("double", length_m)(w)) / scale, "dbl", True)
    if name in ("metricArea", "area"):
        scale = 1.0 if name == "metricArea" else _unit(a[1] if len(a) > 1 else None, AREA_UNITS, "M2")
        return E(F.when(is_point, F.lit(0.0)).otherwise(_map("double", area_m2)(w)) / scale, "dbl", True)
    if name == "numGeometries":
        return E(F.when(is_point, F.lit(1).cast("bigint")).otherwise(_map("bigint", lambda g: max(1, len(g.members)))(w)), "int", True)
    if name == "geometryN":
        n = as_double(a[1]).cast("int")

        @F.pandas_udf("string")
        def nth(s: pd.Series, k: pd.Series) -> pd.Series:
            def one(t, i):
                g = parse(t)
                if g is None or i is None or math.isnan(i):
                    return None
                parts = g.members or [t]
                return parts[int(i) - 1] if 1 <= i <= len(parts) else None

            return pd.Series([one(t, i) for t, i in zip(s, k, strict=True)], dtype=object)

        return E(nth(w, n), "wkt", True)
    if name.startswith("sf"):
        return E(relation_udf(name[2:].lower())(w, wkt(a[1])), "bool", True)
    if name == "relate":
        if len(a) < 3 or a[2].const is None:
            raise SparqlError("geof:relate takes two geometries and a constant pattern")
        rel = named_relation(a[2].const.value)
        return E(relation_udf(rel)(w, wkt(a[1])), "bool", True)
    raise SparqlError(f"unknown function geof:{name}")
