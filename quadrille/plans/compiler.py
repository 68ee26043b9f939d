"""Algebra to DataFrame plans. Nothing is run here but for paths and services that need
bounded facts on the driver; joins, filters and aggregates are left to Catalyst."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.scalar import GEOF, QL, Scope, compile_expr
from ..functions.terms import E, common_kind, constant, convert, ebv, lit_fields, nothing, order_key, struct, to_term
from ..operators import frames as fr
from ..operators import paths, spatial
from ..operators.frames import Frame, column_name, frame
from ..sources.base import Source, join_all
from .algebra import AGGREGATES, IRI, RDF, Bind, BNode, Call, Exists, Filter, GraphPattern, Group, Lit, Minus, Optional_, Path, Query, Service, SubSelect, Triple, Union_, Values, Var, expr_vars, has_aggregate, visible, walk
from .magic import magic_predicates
from .parser import SparqlError

HAS_PREDICATE = QL + "has-predicate"
HAS_WORD = QL + "has-word"


def sort_columns(f: Frame, order: list[tuple[str, bool]]) -> list:
    """Sort keys of variables; ``order``: names, and whether they go down."""
    cols = []
    for n, down in order:
        for c in order_key(E(f.col(n), f.env[n].kind, f.env[n].null)):
            cols.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return cols


class Compiler:
    def __init__(self, engine: Any, source: Source, default: list[str] | None = None, named: list[str] | None = None):
        """``default``: graphs of the default graph (None: the union of all); ``named``: those
        that GRAPH may use (None: all)."""
        self.engine, self.source, self.default, self.named = engine, source, default, named
        self.spark = source.spark
        self.fresh = 0

    def new(self) -> Var:
        self.fresh += 1
        return Var(f"_:p{self.fresh}")

    def identity(self) -> Frame:
        return Frame(self.spark.range(1).select(), {})

    # -- queries
    def query(self, q: Query) -> Frame:
        """The solutions of a SELECT, or of the pattern of another form."""
        f = self.group(q.where, (self.default, None))
        aggregated = q.grouped or any(e is not None and has_aggregate(e) for _, e in q.select) or any(has_aggregate(h) for h in q.having)
        if aggregated:
            f, scope = self.aggregated(q, f)
        else:
            for n, e in q.select:
                if e is not None:
                    f = self.bind(f, n, e)
            scope = Scope(f.scope(), now=self.engine.now)
        if q.values is not None:  # before anything is cut off
            f = fr.join(f, self.values(q.values))
            scope = Scope(f.scope(), scope.ready, scope.now, scope.base)
        names = [n for n, _ in q.select] or [v for v in f.env if not v.startswith("_:")]
        if q.kind != "select":
            names = [v for v in f.env if not v.startswith("_:")] if not aggregated else names
        if q.textlimit is not None:
            f = self.text_limit(f, q.textlimit)
        order = []
        if q.order:
            for i, (e, down) in enumerate(q.order):
                f2 = self.bind(f, f"_:o{i}", e, scope if aggregated else None)
                f = f2
                order.append((f"_:o{i}", down))
        if q.distinct:
            keep = [n for n, _ in order]
            if all(expr_vars(e) <= set(names) for e, _ in q.order):
                f = f.select([*names, *keep]).distinct()
            else:  # of rows that are equal in what is selected, the first in the order stays
                w = Window.partitionBy(*[f.col(v) for v in names]).orderBy(*sort_columns(f, order))
                f = Frame(f.df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first"), f.env).select([*names, *keep])
        if order:
            f = Frame(f.df.orderBy(*sort_columns(f, order)), f.env)
        if q.internal_sort:
            f = Frame(f.df.orderBy(*[f.col(v).asc_nulls_first() for v in q.internal_sort if v in f.env]), f.env)
        f = f.select(names)
        if q.offset:
            f = Frame(f.df.offset(q.offset), f.env)
        if q.limit is not None:
            f = Frame(f.df.limit(q.limit), f.env)
        return f

    def bind(self, f: Frame, name: str, e: Any, scope: Scope | None = None) -> Frame:
        f, ready = self.existence(f, e)
        sc = scope or Scope(f.scope(), now=self.engine.now, base=self.engine.base)
        made = compile_expr(e, Scope(sc.env, {**sc.ready, **ready}, sc.now, sc.base))
        return f.with_var(name, replace(made, const=None))

    def existence(self, f: Frame, e: Any) -> tuple[Frame, dict]:
        """Adds a column for each EXISTS inside an expression."""
        ready = {}
        for x in walk(e):
            if isinstance(x, Exists) and x not in ready:
                name = self.new().name
                f = fr.flag(f, self.group(x.group, self.here), name)
                c = f.col(name)
                ready[x] = E(~c if x.negated else c, "bool", False)
        return f, ready

    def aggregated(self, q: Query, f: Frame) -> tuple[Frame, Scope]:
        now, base = self.engine.now, self.engine.base
        for n, e in q.group:
            if not (isinstance(e, Var) and e.name == n):
                f = self.bind(f, n, e)
            elif n not in f.env:
                f = f.with_var(n, nothing())
        keys = [n for n, _ in q.group]
        calls: dict[Call, str] = {}
        exprs = [e for _, e in q.select if e is not None] + list(q.having) + [e for e, _ in q.order]
        for e in exprs:
            for x in walk(e):
                if isinstance(x, Call) and x.name in AGGREGATES:
                    calls.setdefault(x, f"_:a{len(calls)}")
        shown = [v for v in f.env if not v.startswith("_:")]
        row = F.struct(*[f.col(v) for v in shown]) if shown else F.struct(F.lit(1))
        made = {}
        for x in calls:
            arg = None
            if x.args:
                f, ready = self.existence(f, x.args[0])
                arg = compile_expr(x.args[0], Scope(f.scope(), ready, now, base))
                arg = replace(arg, const=None)
            made[x] = aggregate(x, arg, row)
        cols = [e.col.alias(column_name(calls[x])) for x, e in made.items()] or [F.lit(True).alias("_one")]
        grouped = self._subject_counts(q, keys, calls)
        if grouped is None:
            grouped = f.df.groupBy(*[f.col(k) for k in keys]).agg(*cols)
        env = {k: f.env[k] for k in keys} | {calls[x]: E(F.col(column_name(calls[x])), e.kind, e.null) for x, e in made.items()}
        g = Frame(grouped, env)
        ready = {x: E(g.col(n), made[x].kind, made[x].null) for x, n in calls.items()}
        for n, e in q.select:
            if e is not None:
                g = self.bind(g, n, e, Scope(g.scope(), ready, now, base))
        scope = Scope(g.scope(), ready, now, base)
        for h in q.having:
            g = g.where(ebv(compile_expr(h, scope)))
        return g, scope

    def _subject_counts(self, q: Query, keys: list[str], calls: dict[Call, str]):
        """Of ``?s ?p ?o`` the distinct ?s for each ?p: sources may know a way without triples."""
        t = q.where.parts[0] if len(q.where.parts) == 1 else None
        if not (isinstance(t, Triple) and all(isinstance(x, Var) for x in (t.s, t.p, t.o)) and len({t.s, t.p, t.o}) == 3):
            return None
        if keys != [t.p.name] or any(e != t.p for _, e in q.group) or not calls or any(x.name != "COUNT" or not x.distinct or x.args != (t.s,) for x in calls):
            return None
        made = self.source.subject_counts(self.default)
        return None if made is None else made.select(F.col("p").alias(column_name(t.p.name)), *[F.col("n").alias(column_name(v)) for v in calls.values()])

    def text_limit(self, f: Frame, k: int) -> Frame:
        """The best ``k`` text records for each combination of entities."""
        scores = [v for v in f.env if v.startswith("ql_score_")]
        texts = [v for v in f.env if v in self.engine.text_vars]
        entities = [v for v in f.env if v not in scores and v not in texts and not v.startswith(("_:", "ql_"))]
        total = F.lit(0.0)
        for v in scores:
            total = total + F.coalesce(f.col(v).cast("double"), F.lit(0.0))
        w = Window.partitionBy(*[f.col(v) for v in entities]).orderBy(total.desc(), *[f.col(v).desc() for v in texts])
        ranked = f.df.withColumn("_rank", F.dense_rank().over(w)).where(F.col("_rank") <= k).drop("_rank")
        return Frame(ranked, f.env)

    # -- patterns
    here: tuple = (None, None)

    def group(self, g: Group, where: tuple) -> Frame:
        before, self.here = self.here, where
        try:
            return self._filtered(g, where)
        finally:
            self.here = before

    def _filtered(self, g: Group, where: tuple) -> Frame:
        g = magic_predicates(g)
        filters = [e for p in g.parts if isinstance(p, Filter) for e in _conjuncts(p.expr)]
        f = self._patterns(g, where, filters)
        for e in filters:
            f = self.filter(f, e)
        return f

    def filter(self, f: Frame, e: Any) -> Frame:
        if isinstance(e, Call) and e.name == "&&":
            return self.filter(self.filter(f, e.args[0]), e.args[1])
        neg = isinstance(e, Call) and e.name == "!" and isinstance(e.args[0], Exists)
        if isinstance(e, Exists) or neg:
            x = e.args[0] if neg else e
            return fr.exists(f, self.group(x.group, self.here), x.negated != neg)
        names = f.env
        f, ready = self.existence(f, e)
        made = compile_expr(e, Scope(f.scope(), ready, self.engine.now, self.engine.base))
        f = f.where(ebv(made))
        return f.select(list(names)) if ready else f

    def _patterns(self, g: Group, where: tuple, filters: list) -> Frame:
        f: Frame | None = None
        triples: list[Triple] = []
        parts = [p for p in g.parts if not isinstance(p, Filter)]
        for i, p in enumerate(parts):
            if isinstance(p, Triple):
                triples.append(p)
                if i + 1 < len(parts) and isinstance(parts[i + 1], Triple):
                    continue
                f = self.bgp(triples, f, where, filters)
                triples = []
                continue
            if isinstance(p, Bind):
                f = self.bind(f or self.identity(), p.var, p.expr)
                continue
            if isinstance(p, Optional_):
                f = self.optional(f or self.identity(), p.group, where)
                continue
            if isinstance(p, Minus):
                f = fr.minus(f or self.identity(), self.group(p.group, where))
                continue
            if isinstance(p, Service):
                f = self.engine.service(self, p, f, where)
                continue
            if isinstance(p, Union_):
                right = fr.union([self.group(x, where) for x in p.groups])
            elif isinstance(p, Values):
                right = self.values(p)
            elif isinstance(p, SubSelect):
                right = Compiler(self.engine, self.source, where[0] if where[1] is None else self.default, self.named).query(p.query)
            elif isinstance(p, GraphPattern):
                right = self.graph(p, where)
            elif isinstance(p, Group):
                right = self.group(p, where)
            else:
                raise SparqlError(f"not a pattern: {p!r}")
            f = right if f is None else self.combine(f, right, filters)
        return f if f is not None else self.identity()

    def combine(self, a: Frame, b: Frame, filters: list) -> Frame:
        """Joins; where nothing is shared, a filter on the distance or relation of two
        geometries makes it a spatial join."""
        if not (a.names & b.names):
            for e in filters:
                if (made := spatial.from_filter(e, a, b)) is not None:
                    if e.name in ("<=", "<"):  # it holds for every pair
                        filters.remove(e)
                    return made
        return fr.join(a, b)

    def graph(self, p: GraphPattern, where: tuple) -> Frame:
        if isinstance(p.graph, Var):
            inner = self.group(p.group, (self.named, p.graph.name))
            if p.graph.name not in inner.env:
                names = self.source.any_predicate(self.named, p.graph.name)
                inner = fr.join(inner, frame(names[0].select("g").distinct(), {p.graph.name: names[1]["g"]}))
            return inner
        ok = self.named is None or p.graph.value in self.named
        return self.group(p.group, ([p.graph.value] if ok else [], None))

    def optional(self, f: Frame, g: Group, where: tuple) -> Frame:
        own = visible(g)
        inside, outer = [], []
        for p in g.parts:
            if isinstance(p, Filter):
                simple = not any(isinstance(x, Exists) for x in walk(p.expr))
                (outer if simple and not expr_vars(p.expr) <= own and expr_vars(p.expr) & f.names else inside).append(p)
        body = Group(tuple(p for p in g.parts if not isinstance(p, Filter)) + tuple(inside))
        right = self.group(body, where)
        cond = None
        if outer:

            def cond(env):
                out = F.lit(True)
                for p in outer:
                    out = out & ebv(compile_expr(p.expr, Scope(env, now=self.engine.now, base=self.engine.base)))
                return out

        return fr.left_join(f, right, cond)

    def values(self, v: Values) -> Frame:
        cols: dict[str, E] = {}
        kinds = []
        for k in range(len(v.names)):
            found = [constant(r[k]).kind for r in v.rows if r[k] is not None]
            kind = found[0] if found else "term"
            for x in found[1:]:
                kind = common_kind(kind, x)
            kinds.append(kind)
        if not v.rows:
            empty = self.spark.range(0)
            return frame(empty, {n: E(nothing().col, "term", True) for n in v.names})
        items = []
        for r in v.rows:
            fields = []
            for k, x in enumerate(r):
                e = nothing(kinds[k]) if x is None else convert(constant(x), kinds[k])
                fields.append(e.col.alias(f"c{k}"))
            items.append(F.struct(*fields, F.lit(1).alias("_")))
        df = self.spark.range(1).select(F.explode(F.array(*items)).alias("r"))
        for k, n in enumerate(v.names):
            cols[n] = E(F.col(f"r.c{k}"), kinds[k], any(r[k] is None for r in v.rows))
        return frame(df, cols)

    # -- basic graph patterns
    def bgp(self, triples: list[Triple], f: Frame | None, where: tuple, filters: list) -> Frame:
        graphs, gvar = where
        plain: dict[Any, list[Triple]] = {}
        found: list[Frame] = []
        later: list[Triple] = []
        text: list[Triple] = []
        for t in triples:
            t = Triple(*[Var("_:" + x.label) if isinstance(x, BNode) else x for x in (t.s, t.p, t.o)])
            if isinstance(t.p, Path) and t.p.op == "inv" and isinstance(t.p.args[0], IRI):
                t = Triple(t.o, t.p.args[0], t.s)
            if isinstance(t.p, Path):
                later.append(t)
            elif isinstance(t.p, IRI) and self.engine.is_special(t.p.value):
                text.append(t)
            elif isinstance(t.p, IRI) and t.p.value == HAS_PREDICATE:
                df, c = self.source.has_predicate(graphs)
                from ..sources.base import match

                found.append(match(df, [(t.s, c["s"]), (t.o, c["p"])]))
            elif isinstance(t.p, IRI) and isinstance(t.s, Var | IRI):
                plain.setdefault(t.s, []).append(t)
            elif isinstance(t.p, Var):
                found.append(self.source.scan(t, graphs, gvar))
            else:
                raise SparqlError("a literal is no subject")
        for s, ts in plain.items():
            found += self.source.star(s, ts, graphs, gvar)
        if text:
            found += self.engine.special(self, text, where)
        for part in components(found):
            made = join_all(part)
            f = made if f is None else self.combine(f, made, filters)
        for t in sorted(later, key=lambda t: _open(t, f)):
            p = self.path(t.s, t.p, t.o, where, f)
            f = p if f is None else self.combine(f, p, filters)
        return f if f is not None else self.identity()

    # -- property paths
    def path(self, s: Any, p: Any, o: Any, where: tuple, bound: Frame | None = None) -> Frame:
        graphs, gvar = where
        if isinstance(p, IRI):
            return join_all(self.source.star(s, [Triple(s, p, o)], graphs, gvar))
        if p.op == "inv":
            return self.path(o, p.args[0], s, where, bound)
        if p.op == "seq":
            ends = [s, *[self.new() for _ in p.args[1:]], o]
            f = self.path(ends[0], p.args[0], ends[1], where, bound)
            for k in range(1, len(p.args)):
                f = fr.join(f, self.path(ends[k], p.args[k], ends[k + 1], where, f))
            keep = [v for v in f.env if v not in {x.name for x in ends[1:-1]}]
            return Frame(f.select(keep).df, {v: f.env[v] for v in keep})
        if p.op == "alt":
            return fr.union([self.path(s, x, o, where, bound) for x in p.args])
        if p.op == "neg":
            return self.negated(s, p, o, where)
        return self.repeated(s, p, o, where, bound)

    def negated(self, s, p, o, where) -> Frame:
        graphs, gvar = where
        out = []
        for inverse in (False, True):
            iris = [i.value for i, inv in p.args if inv == inverse]
            if not iris and not (inverse is False and not any(inv for _, inv in p.args)):
                continue
            v = self.new()
            f = self.source.scan(Triple(o, v, s) if inverse else Triple(s, v, o), graphs, gvar)
            f = f.where(~f.col(v.name).isin(iris)) if iris else f
            out.append(f.select([n for n in f.env if n != v.name]))
        return fr.union(out)

    def repeated(self, s, p, o, where, bound) -> Frame:
        """Transitive paths: distinct pairs. The walk begins at the side that is known."""
        lo, hi = p.lo, p.hi
        if isinstance(s, Lit):
            raise SparqlError("a literal is no subject")
        same = isinstance(s, Var) and isinstance(o, Var) and s.name == o.name
        a, b = Var("_:ta"), Var("_:tb")
        step = self.path(a, p.args[0], b, where)
        known = lambda x: isinstance(x, Var) and bound is not None and x.name in bound.env and not bound.env[x.name].null
        flip = isinstance(s, Var) and (not isinstance(o, Var) or (known(o) and not known(s)))
        start, end = (o, s) if flip else (s, o)
        kind = common_kind(step.env["_:ta"].kind, step.env["_:tb"].kind)
        need_nodes = lo == 0 and (not isinstance(start, Var) or not known(start))
        if need_nodes or (lo == 0 and known(start)):
            kind = common_kind(kind, bound.env[start.name].kind) if known(start) else kind if not isinstance(start, Var) and constant(start).kind == "iri" and kind != "int" else "term"
        if not isinstance(start, Var) and kind in ("int", "dbl", "bool", "str", "ts", "date"):
            kind = common_kind(kind, constant(start).kind)
        step = step.to_kinds({"_:ta": kind, "_:tb": kind})
        x, y = (step.col("_:tb"), step.col("_:ta")) if flip else (step.col("_:ta"), step.col("_:tb"))
        edges = step.df.select(x.alias("a"), y.alias("b"))
        seeds = nodes = None
        if known(start):
            seeds = bound.to_kinds({start.name: kind}) if common_kind(bound.env[start.name].kind, kind) == kind else None
            seeds = seeds.df.select(seeds.col(start.name).alias("a")).distinct() if seeds is not None else None
        elif not isinstance(start, Var):
            seeds = self._seed(start, kind)
            if lo == 0 and seeds is not None:  # no edge is needed, but the term must occur
                term = E(F.col("a"), "term", False)
                there = self.source.nodes(where[0])
                from ..functions.terms import compare_const

                there = there.where(compare_const(term, start)).limit(1).select(F.lit(1).alias("_e"))
                seeds = seeds.join(there, F.lit(True), "left_semi")
            if seeds is None:
                seeds = edges.select("a").limit(0)
        if lo == 0 and seeds is None:
            nodes = self.source.nodes(where[0])
        pairs = paths.closure(edges, seeds, lo, hi, nodes)
        cs = E(F.col("b" if flip else "a"), kind, False)
        co = E(F.col("a" if flip else "b"), kind, False)
        from ..sources.base import match

        out = match(pairs, [(s, cs), (o, co)])
        return out.distinct() if same else out

    def _seed(self, term: Any, kind: str):
        e = constant(term)
        if kind.startswith("ref:"):
            key = term.value.removeprefix(kind[4:]) if isinstance(term, IRI) and term.value.startswith(kind[4:]) else ""
            if not key.lstrip("-").isdigit():
                return None
            e = E(F.lit(int(key)).cast("bigint"), kind, False)
        elif kind == "term":
            e = E(to_term(e), "term", False)
        elif {e.kind, kind} - {"iri", "res"} and e.kind != kind:
            return None
        return self.spark.range(1).select(e.col.alias("a"))

    # -- other forms
    def construct(self, q: Query):
        """Triples (s, p, o as terms) of a template; unbound terms leave a triple out."""
        f = self.query(replace(q, kind="construct"))
        df, env = f.df, f.scope()
        df = df.withColumn("_row", F.monotonically_increasing_id())
        made = [F.struct(*[c.alias(n) for n, c in zip("spo", cols, strict=True)]) for cols in (self.template(t, env) for t in q.template)]
        rows = df.select(F.explode(F.array(*made)).alias("t")).select("t.s", "t.p", "t.o")
        return rows.where("s is not null and p is not null and o is not null")

    def template(self, t: Triple, env: dict[str, E]):
        def term(x: Any, place: str):
            if isinstance(x, Var) and x.name.startswith("_:"):
                e = E(F.concat(F.lit(x.name.replace("_:", "_:c") + "-"), F.col("_row").cast("string")), "res", False)
            elif isinstance(x, Var):
                e = env.get(x.name) or nothing()
            else:
                e = constant(x)
            c = to_term(e)
            return c if place == "o" else F.when(c["k"].isin(5, 8) if place == "s" else c["k"] == 5, c["s"])

        return [term(x, n) for n, x in zip("spo", (t.s, t.p, t.o), strict=True)]

    def describe(self, q: Query):
        """Triples of the resources as subjects, and of the blank nodes reached from them."""
        from ..shared import materialize

        f = self.query(replace(q, kind="describe")) if q.where.parts else self.identity()
        wanted = [v for v in f.env] if q.targets == ("*",) else [t.name for t in q.targets if isinstance(t, Var)]
        parts = [f.df.select(E_text(f, v).alias("r")) for v in wanted if v in f.env]
        iris = [t.value for t in q.targets if isinstance(t, IRI)]
        if iris:
            parts.append(self.spark.createDataFrame([(x,) for x in iris], "r string"))
        if not parts:
            raise SparqlError("nothing to describe")
        todo = parts[0]
        for x in parts[1:]:
            todo = todo.union(x)
        todo = todo.where("r is not null").distinct()
        df, c = self.source.any_predicate(self.default, None)
        s = convert(c["s"], "res") if c["s"].kind != "term" else c["s"]
        all_ = df.select(s.col.alias("s"), c["p"].col.alias("p"), c["o"].col.alias("o"))
        out, seen = None, todo
        while True:
            part = materialize(all_.join(todo, F.col("s") == F.col("r"), "left_semi"), "describe")
            out = part if out is None else out.union(part)
            todo = part.where(F.col("o.k") == 8).select(F.col("o.s").alias("r")).distinct().join(seen, "r", "left_anti")
            todo = materialize(todo, "blank")
            if todo.isEmpty():
                return out
            seen = seen.union(todo)


def E_text(f: Frame, v: str):  # noqa: N802
    t = to_term(E(f.col(v), f.env[v].kind, f.env[v].null))
    return F.when(t["k"].isin(5, 8), t["s"])


def _conjuncts(e: Any) -> list:
    return [x for a in e.args for x in _conjuncts(a)] if isinstance(e, Call) and e.name == "&&" else [e]


def _open(t: Triple, f: Frame | None) -> int:
    """Paths with a known end come first."""
    names = f.names if f else set()
    return sum(isinstance(x, Var) and x.name not in names for x in (t.s, t.o))


def components(found: list[Frame]) -> list[list[Frame]]:
    """Groups of frames that share variables, directly or through others."""
    out: list[list[Frame]] = []
    for f in found:
        touch = [g for g in out if any(f.names & x.names for x in g)]
        out = [g for g in out if g not in touch]
        out.append([x for g in touch for x in g] + [f])
    return out


__all__ = ["GEOF", "HAS_PREDICATE", "HAS_WORD", "RDF", "Compiler", "lit_fields", "struct"]
