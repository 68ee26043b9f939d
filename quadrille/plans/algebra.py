"""Terms, paths, patterns, expressions and statements as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
GEO = "http://www.opengis.net/ont/geosparql#"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Lit:
    value: str
    dt: str = XSD + "string"
    lang: str | None = None


@dataclass(frozen=True)
class Path:
    """op: seq, alt, inv, neg (args: (IRI, inverse) pairs), rep (lo, hi; hi None: no bound)."""

    op: str
    args: tuple
    lo: int = 0
    hi: int | None = None


@dataclass(frozen=True)
class Triple:
    s: Any
    p: Any
    o: Any


@dataclass(frozen=True)
class Filter:
    expr: Any


@dataclass(frozen=True)
class Optional_:
    group: Group


@dataclass(frozen=True)
class Union_:
    groups: tuple


@dataclass(frozen=True)
class Minus:
    group: Group


@dataclass(frozen=True)
class GraphPattern:
    graph: Any
    group: Group


@dataclass(frozen=True)
class Bind:
    expr: Any
    var: str


@dataclass(frozen=True)
class Values:
    names: tuple
    rows: tuple


@dataclass(frozen=True)
class SubSelect:
    query: Query


@dataclass(frozen=True)
class Service:
    iri: Any
    group: Group
    silent: bool = False
    text: str = ""
    prologue: str = ""


@dataclass(frozen=True)
class Group:
    parts: tuple = ()


@dataclass(frozen=True)
class Call:
    """An operator or function; args are expressions. ``distinct`` and ``sep`` are for
    aggregates."""

    name: str
    args: tuple = ()
    distinct: bool = False
    sep: str = " "


@dataclass(frozen=True)
class Exists:
    group: Group
    negated: bool = False


@dataclass(frozen=True)
class Query:
    kind: str  # select, ask, construct, describe
    where: Group
    select: tuple = ()  # (name, expression or None); empty: *
    distinct: bool = False
    reduced: bool = False
    group: tuple = ()  # (name, expression)
    grouped: bool = False
    having: tuple = ()
    order: tuple = ()  # (expression, descending)
    limit: int | None = None
    offset: int = 0
    textlimit: int | None = None
    values: Values | None = None
    template: tuple = ()
    targets: tuple = ()  # of DESCRIBE
    default_graphs: tuple | None = None
    named_graphs: tuple | None = None
    internal_sort: tuple = ()


@dataclass(frozen=True)
class Update:
    """kind: insert_data, delete_data, modify, load, clear, drop, create, add, move, copy."""

    kind: str
    delete: tuple = ()  # (graph or None, Triple)
    insert: tuple = ()
    where: Group | None = None
    graph: Any = None  # WITH
    using: tuple | None = None
    using_named: tuple | None = None
    silent: bool = False
    source: Any = None
    target: Any = None
    extra: dict = field(default_factory=dict)


AGGREGATES = frozenset("COUNT SUM AVG MIN MAX SAMPLE GROUP_CONCAT STDEV".split())


def walk(e: Any):
    """An expression and everything inside it."""
    yield e
    if isinstance(e, Call):
        for a in e.args:
            yield from walk(a)


def has_aggregate(e: Any) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(e))


def expr_vars(e: Any) -> set[str]:
    found = {x.name for x in walk(e) if isinstance(x, Var)}
    for x in walk(e):
        if isinstance(x, Exists):
            found |= visible(x.group)
    return found


def visible(g: Group) -> set[str]:
    """Variables that a group may bind, in scope outside it."""
    out: set[str] = set()
    for p in g.parts:
        if isinstance(p, Triple):
            out |= {x.name for x in (p.s, p.p, p.o) if isinstance(x, Var)}
        elif isinstance(p, Optional_ | GraphPattern):
            out |= visible(p.group)
            if isinstance(p, GraphPattern) and isinstance(p.graph, Var):
                out.add(p.graph.name)
        elif isinstance(p, Union_):
            out |= set().union(*(visible(x) for x in p.groups))
        elif isinstance(p, Bind):
            out.add(p.var)
        elif isinstance(p, Values):
            out |= set(p.names)
        elif isinstance(p, SubSelect):
            out |= {n for n, _ in p.query.select} or visible(p.query.where)
        elif isinstance(p, Service):
            out |= visible(p.group)
        elif isinstance(p, Group):
            out |= visible(p)
    return {v for v in out if not v.startswith("_:")}
