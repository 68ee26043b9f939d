"""Predicates that stand for spatial joins: ``?a <max-distance-in-meters:N> ?b`` is a filter on
the distance, ``?a <nearest-neighbors:K> ?b`` (or ``:K:N``) a search whose right side are the
patterns that ``?b`` hangs together with."""

from __future__ import annotations

from typing import Any

from ..functions.scalar import GEOF
from .algebra import IRI, XSD, Bind, Call, Filter, Group, Lit, Service, Triple, Var, expr_vars, visible
from .parser import SparqlError

DISTANCE, NEAREST = "max-distance-in-meters:", "nearest-neighbors:"
SEARCH = "http://quadrille.example/spatialSearch/"


def _number(s: str) -> float:
    try:
        x = float(s)
    except ValueError:
        x = -1.0
    if x < 0:
        raise SparqlError(f"not a distance or number: {s!r}")
    return x


def _vars(p: Any) -> set[str]:
    if isinstance(p, Bind):
        return {p.var} | expr_vars(p.expr)
    if isinstance(p, Triple):  # blank nodes connect patterns as well
        return {x.name for x in (p.s, p.p, p.o) if isinstance(x, Var)}
    return visible(Group((p,)))


def magic_predicates(g: Group) -> Group:
    magic = [p for p in g.parts if isinstance(p, Triple) and isinstance(p.p, IRI) and p.p.value.startswith((DISTANCE, NEAREST))]
    if not magic:
        return g
    parts = [p for p in g.parts if p not in magic]
    for t in magic:
        if not (isinstance(t.s, Var) and isinstance(t.o, Var)) or t.s == t.o:
            raise SparqlError("a spatial join has two variables")
        if t.p.value.startswith(DISTANCE):
            metres = _number(t.p.value.removeprefix(DISTANCE))
            parts.append(Filter(Call("<=", (Call(GEOF + "metricDistance", (t.s, t.o)), Lit(repr(metres), XSD + "double")))))
            continue
        number, _, metres = t.p.value.removeprefix(NEAREST).partition(":")
        reached, inner = {t.o.name}, []
        while more := [p for p in parts if not isinstance(p, Filter) and p not in inner and _vars(p) & reached]:
            inner += more
            reached |= set().union(*map(_vars, more))
        if t.s.name in reached:
            raise SparqlError("the sides of a spatial join hang together")
        config = Var("_:spatial")
        told = [("left", t.s), ("right", t.o), ("numNearestNeighbors", Lit(str(int(_number(number))), XSD + "integer"))]
        told += [("maxDistance", Lit(repr(_number(metres)), XSD + "double"))] if metres else []
        own = [p for p in parts if isinstance(p, Filter) and expr_vars(p.expr) <= reached]
        body = Group(tuple(p for p in parts if p in inner or p in own))
        service = Service(IRI(SEARCH), Group((*(Triple(config, IRI(SEARCH + n), v) for n, v in told), body)))
        parts = [p for p in parts if p not in inner and p not in own] + [service]
    return Group(tuple(parts))
