"""The engine: queries, updates, views, cached results, text indexes and services over a graph."""

from __future__ import annotations

import datetime
import re
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import results
from .functions import geo
from .functions.scalar import QL
from .functions.terms import E, compare_const, constant, convert, lit_fields, nothing, ref_iri, struct, to_term
from .operators import frames as fr
from .operators import paths, spatial
from .operators.frames import Frame, column_name, frame
from .operators.text import TextIndex, escaped, tokens
from .plans.algebra import IRI, Group, Lit, Service, SubSelect, Triple, Update, Var, visible
from .plans.compiler import HAS_WORD, Compiler
from .plans.parser import SparqlError, parse_query, parse_update
from .shared import fresh_path, materialize
from .sources.base import Source
from .sources.rdfio import read_rdf
from .sources.store import DEFAULT, QuadStore, empty_store, within, without

NS = "http://quadrille.example/"
PATH_SEARCH, SPATIAL_SEARCH, TEXT_SEARCH, VIEW = NS + "pathSearch/", NS + "spatialSearch/", NS + "textSearch/", NS + "view/"
CACHED = QL + "cached-result-"
TABLE = QL + "table-"
PREFIXES = {"ql": QL, "pathSearch": PATH_SEARCH, "spatialSearch": SPATIAL_SEARCH, "textSearch": TEXT_SEARCH, "view": VIEW}


#: Runtime parameters and their defaults: seconds that ``rows`` may take (None: any time);
#: results that are kept (0: none); whether CONSTRUCT leaves out repeated triples; rows of
#: bindings that are sent along with a SERVICE request; fewest letters before the * of a prefix.
PARAMETERS: dict[str, Any] = {"timeout": None, "cache-max-num-entries": 0, "construct-distinct": False, "service-max-value-rows": 100, "min-prefix-size": 1}


class QueryTimeout(RuntimeError):
    """A query took longer than it may."""


class Engine:
    def __init__(self, spark: SparkSession, source: Source | None = None, text: TextIndex | None = None, prefixes: dict[str, str] | None = None, base: str = "", fetch: Callable[[str, str], dict] | None = None, allowed: Callable[[str], bool] | None = None):
        """``fetch(endpoint, query)`` returns SPARQL JSON for SERVICE; ``allowed`` decides which
        endpoints may be asked."""
        self.spark, self.source, self.text, self.base = spark, source or empty_store(spark), text, base
        self.prefixes, self.fetch, self.allowed = PREFIXES | (prefixes or {}), fetch, allowed
        self.views: dict[str, tuple[str, dict[str, str]]] = {}
        self.cached: dict[str, Frame] = {}
        #: Materialised results by query text, oldest first; an update empties it.
        self.results: dict[str, Frame] = {}
        self.parameters: dict[str, Any] = dict(PARAMETERS)
        self.text_vars: set[str] = set()
        self.now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)

    # -- queries
    def frame(self, text: str) -> tuple[Frame, list[str]]:
        q = parse_query(text, self.prefixes)
        if q.kind != "select":
            raise SparqlError("not a SELECT query")
        self.now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        most = self.parameters["cache-max-num-entries"]
        if text in self.results:
            f = self.results[text]
            return f, list(f.env)
        f = self._compiler(q).query(q)
        if most and not re.search(r"\b(?:RAND|NOW|UUID|STRUUID|BNODE)\s*\(", text, re.I):
            f = Frame(materialize(f.df, "result"), {v: E(F.col(column_name(v)), e.kind, e.null) for v, e in f.env.items()})
            while len(self.results) >= most:
                self.results.pop(next(iter(self.results)))
            self.results[text] = f
        return f, list(f.env)

    def set_parameter(self, name: str, value: Any) -> None:
        if name not in PARAMETERS:
            raise SparqlError(f"no parameter {name}")
        self.parameters[name] = value

    def rows(self, text: str, timeout: float | None = None) -> list:
        """The rows of a query; its jobs are cancelled once it took ``timeout`` seconds (or what
        the parameter of that name says)."""
        limit, tag, over = timeout if timeout is not None else self.parameters["timeout"], f"quadrille-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            over.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(limit, stop) if limit is not None else None
        self.spark.addTag(tag)
        try:
            if timer:
                timer.start()
            got = self.query(text).collect()
            if over.is_set():
                raise QueryTimeout(f"the query took longer than {limit} s")
            return got
        except Exception as e:
            if over.is_set():
                raise QueryTimeout(f"the query took longer than {limit} s") from e
            raise
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(tag)

    def cancel_all(self) -> None:
        """Cancels what runs in this session."""
        self.spark.interruptAll()

    def statistics(self, text: str) -> dict[str, Any]:
        """Runtime information of a query after running it: operators of the final plan and
        their metrics, as Spark counted them."""
        df = self.query(text)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan()
        n = df.count()
        return {"result-size": n, "plan": plan.toString(), "columns": df.columns}

    def _compiler(self, q: Any) -> Compiler:
        default = None if q.default_graphs is None and q.named_graphs is None else list(q.default_graphs or [])
        named = None if q.named_graphs is None and q.default_graphs is None else list(q.named_graphs or [])
        return Compiler(self, self.source, default, named)

    def query(self, text: str) -> DataFrame:
        """SELECT: a column for each variable, native where its terms have one datatype, IRIs
        as text. ASK: one row (ask). CONSTRUCT and DESCRIBE: s, p, o (o is a term)."""
        q = parse_query(text, self.prefixes)
        if q.kind == "select":
            return shown(*self.frame(text))
        c = self._compiler(q)
        if q.kind == "ask":
            return c.query(replace(q, kind="ask")).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if q.kind == "construct":
            made = c.construct(q)
            return made.distinct() if self.parameters["construct-distinct"] else made
        return c.describe(q)

    def ask(self, text: str) -> bool:
        return bool(self.query(text).first()["ask"])

    def export(self, text: str, form: str, send: int | None = None) -> Iterator[str]:
        """The result as a document: json, xml, csv, tsv, native (JSON with the rows as lists), or
        (for triples) turtle, ntriples. ``send`` truncates the document, not the result."""
        q = parse_query(text, self.prefixes)
        if q.kind in ("construct", "describe"):
            if form not in ("turtle", "ntriples"):
                raise SparqlError(f"triples have no form {form}")
            triples = self.query(text)
            return (r["value"] + "\n" for r in results.triple_lines(triples if send is None else triples.limit(send)).toLocalIterator())
        if q.kind == "ask":
            yes = self.ask(text)
            return iter(['{"head": {}, "boolean": %s}' % ("true" if yes else "false")] if form == "json" else [f"{yes}\n".lower()])
        f, names = self.frame(text)
        if form == "native":
            return results.to_native(f, names, text, send)
        if send is not None:
            f = Frame(f.df.limit(send), f.env)
        if form in ("csv", "tsv"):
            return (line + "\n" for line in results.lines(f, names, form))
        if form == "json":
            return results.to_json(f, names)
        if form == "xml":
            return results.to_xml(f, names)
        raise SparqlError(f"unknown form {form}")

    # -- caches and views
    def pin(self, name: str, text: str) -> None:
        """Holds a result under a name, for SERVICE ql:cached-result-NAME."""
        f, _ = self.frame(text)
        self.cached[name] = Frame(materialize(f.df, "cached"), f.env)

    def unpin(self, name: str) -> None:
        del self.cached[name]

    def write_view(self, name: str, text: str) -> None:
        """A SELECT result as a Parquet table sorted by its first columns."""
        f, names = self.frame(text)
        path = fresh_path(self.spark, f"view-{escaped(name)}")
        keys = [column_name(v) for v in names[:3] if f.env[v].kind != "term"]
        df = f.df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else f.df
        df.write.parquet(path)
        self.views[name] = (path, {v: f.env[v].kind for v in names})

    def load_view(self, name: str, path: str, kinds: dict[str, str]) -> None:
        self.views[name] = (path, dict(kinds))

    def delete_view(self, name: str) -> None:
        del self.views[name]

    def view(self, name: str) -> Frame:
        if name not in self.views:
            raise SparqlError(f"no view {name}")
        path, kinds = self.views[name]
        return Frame(self.spark.read.parquet(path), {v: E(F.col(column_name(v)), k, True) for v, k in kinds.items()})

    def _view_rows(self, name: str, wanted: dict[str, Any]) -> Frame:
        v = self.view(name)
        out, loose = v.df, {}
        for c, x in wanted.items():
            if c not in v.env:
                raise SparqlError(f"view {name} has no column {c}")
            if isinstance(x, Var):
                loose[x.name] = E(v.col(c), v.env[c].kind, True)
            else:
                out = out.where(compare_const(E(v.col(c), v.env[c].kind, False), x))
        return frame(out, loose)

    # -- special predicates
    def is_special(self, iri: str) -> bool:
        return iri in (QL + "contains-word", QL + "contains-entity", HAS_WORD) or iri == QL + "langtag" or iri.startswith(VIEW)

    def special(self, c: Compiler, triples: list[Triple], where: tuple) -> list[Frame]:
        out: list[Frame] = []
        words = [t for t in triples if t.p.value == QL + "contains-word"]
        for t in triples:
            p = t.p.value
            if p == QL + "contains-word":
                for w in t.o.value.split(" "):
                    if w.endswith("*") and len(w) <= self.parameters["min-prefix-size"]:
                        raise SparqlError(f"a prefix has at least {self.parameters['min-prefix-size']} letters")
                    tag = escaped(w.rstrip("*").lower())
                    kind = "prefix" if w.endswith("*") else "word"
                    out.append(self._index().word(t.s.name, w, f"ql_score_{kind}_{t.s.name}_{tag}", f"ql_matchingword_{t.s.name}_{tag}"))
                self.text_vars.add(t.s.name)
            elif p == QL + "contains-entity":
                if not any(w.s == t.s for w in words):
                    raise SparqlError("contains-entity needs a contains-word on the same text")
                if isinstance(t.o, Var):
                    out.append(self._index().entity(t.s.name, t.o.name, f"ql_score_{t.s.name}_var_{t.o.name}"))
                else:
                    out.append(self._index().entity(t.s.name, ("iri", t.o.value), f"ql_score_{t.s.name}_fixedEntity_{escaped(t.o.value)}"))
            elif p in (HAS_WORD, QL + "langtag"):  # every literal and each of its words, or its language
                from .sources.base import match

                df, cols = self.source.any_predicate(where[0], None)
                o = to_term(cols["o"])
                if p == HAS_WORD:
                    df = df.where(o["k"] == 4).select(o.alias("o"), F.explode(tokens(o["s"])).alias("w"))
                else:
                    df = df.where((o["k"] == 4) & o["lang"].isNotNull()).select(o.alias("o"), o["lang"].alias("w")).distinct()

                out.append(match(df, [(t.s, E(F.col("o"), "term", False)), (t.o, E(F.col("w"), "str", False))]))
            elif p.startswith(VIEW):
                name, _, col = p.removeprefix(VIEW).partition("-")
                first = next(iter(self.view(name).env))
                out.append(self._view_rows(name, {first: t.s, col: t.o}))
            else:
                raise SparqlError(f"unknown predicate {p}")
        return out

    def _index(self) -> TextIndex:
        if self.text is None:
            raise SparqlError("there is no text index")
        return self.text

    # -- services
    def service(self, c: Compiler, s: Service, f: Frame | None, where: tuple) -> Frame:
        iri = s.iri.value if isinstance(s.iri, IRI) else None
        both = lambda made: made if f is None else fr.join(f, made)
        if iri is None:
            raise SparqlError("SERVICE takes a constant endpoint")
        if iri.startswith(CACHED):
            name = iri.removeprefix(CACHED).removeprefix("with-name-")
            if name not in self.cached:
                raise SparqlError(f"no cached result {name}")
            return both(self.cached[name])
        if iri.startswith(TABLE):
            return both(self.cached[iri.removeprefix(TABLE)])
        params = [p for p in s.group.parts if isinstance(p, Triple)]
        inner = [p for p in s.group.parts if not isinstance(p, Triple)]
        if iri.startswith(VIEW) and iri != VIEW:
            name = iri.removeprefix(VIEW)
            return both(self._view_rows(name, {_local(t.p.value).removeprefix("column-"): t.o for t in params}))
        if iri == TEXT_SEARCH:
            return both(self._text_search(params))
        if iri == PATH_SEARCH:
            return both(self._path_search(c, params, inner, where, f))
        if iri == SPATIAL_SEARCH:
            return self._spatial_search(c, params, inner, where, f)
        return both(self._remote(iri, s, f))

    def _text_search(self, params: list[Triple]) -> Frame:
        from .sources.base import join_all

        configs: dict[str, dict[str, Any]] = {}
        for t in params:
            if _local(t.p.value) == "contains":
                configs.setdefault(t.o.name, {})["text"] = t.s.name
            else:
                configs.setdefault(t.s.name, {})[_local(t.p.value)] = t.o
        out = []
        for cfg in configs.values():
            if "text" not in cfg or ("word" in cfg) == ("entity" in cfg):
                raise SparqlError("a text search takes contains, and either word or entity")
            score = cfg["score"].name if "score" in cfg else None
            self.text_vars.add(cfg["text"])
            if "word" in cfg:
                w = cfg["word"].value
                if "prefix-match" in cfg and not w.endswith("*"):
                    raise SparqlError("prefix-match goes with a prefix")
                out.append(self._index().word(cfg["text"], w, score, cfg["prefix-match"].name if "prefix-match" in cfg else None))
            else:
                e = cfg["entity"]
                out.append(self._index().entity(cfg["text"], e.name if isinstance(e, Var) else ("iri", e.value), score))
        return join_all(out)

    def _path_search(self, c: Compiler, params, inner, where, f: Frame | None) -> Frame:
        cfg: dict[str, list] = {}
        for t in params:
            cfg.setdefault(_local(t.p.value), []).append(t.o)
        if "algorithm" in cfg and _local(cfg["algorithm"][0].value) != "allPaths":
            raise SparqlError("the algorithm is allPaths")
        for need in ("start", "end", "pathColumn", "edgeColumn"):
            if need not in cfg:
                raise SparqlError(f"path search needs {need}")
        start, end = cfg["start"][0].name, cfg["end"][0].name
        props = [v.name for v in cfg.get("edgeProperty", [])]
        body = c.group(Group(tuple(inner)), where)
        kind = fr.common_kind(body.env[start].kind, body.env[end].kind)
        if kind == "term":
            cols = {v: E(_resource(body, v), "res", True) for v in (start, end)} | {v: E(body.col(v), body.env[v].kind, body.env[v].null) for v in props}
            body, kind = frame(body.df, cols), "res"
        else:
            body = body.to_kinds({start: kind, end: kind})
        edges = body.df.select(body.col(start).alias("a"), body.col(end).alias("b"), *[body.col(v).alias(f"x_{v}") for v in props]).where("a is not null and b is not null")

        def ends(*sides: str) -> DataFrame | None:
            """The ends that are given, as columns: constants, or what a variable is bound to."""
            given = [cfg[n] for n in sides if n in cfg]
            if len(given) < len(sides):
                return None
            loose = [x.name for side in given for x in side if isinstance(x, Var)]
            for v in loose:
                if f is None or v not in f.env:
                    raise SparqlError(f"?{v} is not bound before the path search")
            if loose and any(len(side) > 1 for side in given) and len(sides) > 1:
                raise SparqlError("pairs of ends are constants, or two variables")
            made: DataFrame | None = None
            if loose:
                g = f.to_kinds({v: kind for v in loose})
                if len(sides) > 1:
                    cols = [g.col(side[0].name) if isinstance(side[0], Var) else F.lit(_native(side[0], kind)) for side in given]
                    return g.df.select(*[c.alias(n) for c, n in zip(cols, sides, strict=True)]).distinct()
                for v in loose:
                    one = g.df.select(g.col(v).alias(sides[0])).where(F.col(sides[0]).isNotNull())
                    made = one if made is None else made.union(one)
            fixed = [[_native(x, kind) for x in side if not isinstance(x, Var)] for side in given]
            if fixed[0] or not loose:
                if len({len(x) for x in fixed}) > 1:
                    raise SparqlError("pairs of ends need as many sources as targets")
                schema = ", ".join(f"{n} {edges.schema['a'].dataType.simpleString()}" for n in sides)
                more = self.spark.createDataFrame(list(zip(*fixed, strict=True)), schema)
                made = more if made is None else made.union(more)
            return made.distinct()

        sources, targets = ends("source"), ends("target")
        pairs = None
        cartesian = str(cfg["cartesian"][0].value).lower() != "false" if "cartesian" in cfg else True
        if not cartesian:
            if sources is None or targets is None:
                raise SparqlError("pairs of ends need as many sources as targets")
            pairs = ends("source", "target")
        number = lambda n: int(cfg[n][0].value) if n in cfg else None
        got = paths.all_paths(edges, sources, targets, pairs, number("maxDepth"), number("numPathsPerTarget"))
        cols = {start: E(F.col("a"), kind, False), end: E(F.col("b"), kind, False), cfg["pathColumn"][0].name: E(F.col("path"), "int", False), cfg["edgeColumn"][0].name: E(F.col("edge"), "int", False)}
        for n, column in (("source", "source"), ("target", "target")):
            for x in cfg.get(n, []):
                if isinstance(x, Var):
                    cols[x.name] = E(F.col(column), kind, False)
        cols |= {v: E(F.col(f"x_{v}"), body.env[v].kind, True) for v in props}
        return frame(got, cols)

    def _spatial_search(self, c: Compiler, params, inner, where, f: Frame | None) -> Frame:
        cfg = {}
        payload = []
        for t in params:
            if _local(t.p.value) == "payload":
                payload.append(t.o)
            else:
                cfg[_local(t.p.value)] = t.o
        if "algorithm" in cfg and _local(cfg["algorithm"].value) not in ("baseline", "s2", "boundingBox", "s2PointPolyline", "libspatialjoin"):
            raise SparqlError("unknown algorithm of a spatial search")  # all give one result; the plan is Spark's
        if "left" not in cfg or "right" not in cfg:
            raise SparqlError("a spatial search needs left and right")
        left, right = cfg["left"].name, cfg["right"].name
        right_f = c.group(Group(tuple(inner)), where)
        left_f = f
        if left_f is None or left not in left_f.env:
            raise SparqlError(f"?{left} must be bound before the spatial search")
        keep = [v for v in right_f.env if v == right or not payload or any(isinstance(p, Var) and p.name == v or isinstance(p, IRI) for p in payload)]
        right_f = right_f.select(keep)
        shared = left_f.names & right_f.names
        if shared:
            raise SparqlError(f"?{min(shared)} is on both sides of the spatial search")
        distance = cfg["bindDistance"].name if "bindDistance" in cfg else None
        metres = float(cfg["maxDistance"].value) if "maxDistance" in cfg else None
        if "numNearestNeighbors" in cfg:
            return spatial.nearest(left_f, left, right_f, right, int(cfg["numNearestNeighbors"].value), metres, distance)
        kind = _local(cfg["joinType"].value) if "joinType" in cfg else "within-dist"
        if kind == "within-dist":
            if metres is None:
                raise SparqlError("within-dist needs maxDistance")
            return spatial.within(left_f, left, right_f, right, metres, distance)
        if kind == "de9im":
            if "de9imFilter" not in cfg:
                raise SparqlError("de9im needs de9imFilter")
            kind = geo.named_relation(cfg["de9imFilter"].value)
        return spatial.related(left_f, left, right_f, right, kind)

    def _bindings(self, s: Service, f: Frame | None) -> str:
        """VALUES with the bindings that the request shares with what is known before it, if they
        are few and constants."""
        shared = [] if f is None else sorted(v for v in f.names & visible(s.group) if not v.startswith("_:"))
        most = self.parameters["service-max-value-rows"]
        if not shared or not most:
            return ""
        got = results.as_text(f, shared).distinct().limit(most + 1).collect()
        if len(got) > most or any(x is None or x.startswith("_:") for r in got for x in r):
            return ""
        return f"VALUES ({' '.join('?' + v for v in shared)}) {{ {' '.join('(' + ' '.join(r) + ')' for r in got)} }} "

    def _remote(self, iri: str, s: Service, f: Frame | None = None) -> Frame:
        try:
            if self.fetch is None:
                raise SparqlError("no fetcher for SERVICE")
            if self.allowed is not None and not self.allowed(iri):
                raise SparqlError(f"{iri} may not be asked")
            known = self._bindings(s, f)
            body = "{ " + known + s.text[s.text.index("{") + 1 :] if known else s.text
            got = self.fetch(iri, s.prologue + "SELECT * WHERE " + body)
        except Exception:
            if s.silent:
                return Frame(self.spark.range(1).select(), {})
            raise
        names = got["head"]["vars"]
        rows = []
        for b in got["results"]["bindings"]:
            row = []
            for n in names:
                x = b.get(n)
                if x is None:
                    row.append(None)
                    continue
                term = IRI(x["value"]) if x["type"] == "uri" else "_:" + x["value"] if x["type"] == "bnode" else Lit(x["value"], x.get("datatype", Lit("").dt), x.get("xml:lang"))
                fields = lit_fields(term)
                row.append(tuple(fields.get(k) for k in ("k", "i", "d", "t", "s", "dt", "lang")))
            rows.append(tuple(row))
        from .functions.terms import TERM

        df = self.spark.createDataFrame(rows, ", ".join(f"c{k} {TERM}" for k in range(len(names))))
        return frame(df, {n: E(F.col(f"c{k}"), "term", True) for k, n in enumerate(names)})

    # -- updates
    def update(self, text: str) -> QuadStore:
        """Runs a sequence of updates. Each makes a new version of the store; queries made
        before keep the version they saw."""
        for u in parse_update(text, self.prefixes):
            self._apply(u)
        return self._store()

    def _store(self) -> QuadStore:
        if not isinstance(self.source, QuadStore):
            raise SparqlError("this graph can't be updated")
        return self.source

    def load(self, path: str, graph: str = DEFAULT) -> QuadStore:
        self._change(None, read_rdf(self.spark, path, graph))
        return self._store()

    # -- graphs as documents: what the Graph Store Protocol asks for
    def get_graph(self, graph: str = DEFAULT) -> DataFrame:
        """s, p, o of one graph."""
        return self._store().quads.where(F.col("g") == graph).select("s", "p", "o")

    def has_graph(self, graph: str = DEFAULT) -> bool:
        return not self.get_graph(graph).limit(1).isEmpty()

    def put_graph(self, path: str, graph: str = DEFAULT) -> QuadStore:
        """Replaces a graph by the triples of a file."""
        rest = self._store().quads.where(F.col("g") != graph).select("s", "p", "o", "g")
        self._new(rest.unionByName(read_rdf(self.spark, path, graph)))
        return self._store()

    def post_graph(self, path: str, graph: str = DEFAULT) -> QuadStore:
        """Adds the triples of a file to a graph."""
        return self.load(path, graph)

    def toggle_graph(self, path: str, graph: str = DEFAULT) -> QuadStore:
        """For each triple of a file: removes it from a graph that has it, else adds it (TSOP)."""
        rows = materialize(read_rdf(self.spark, path, graph).distinct(), "toggled")
        here = self._store().quads.where(F.col("g") == graph)
        self._change(within(here, rows), without(rows, here))
        return self._store()

    def delete_graph(self, graph: str = DEFAULT) -> QuadStore:
        self._new(self._store().quads.where(F.col("g") != graph).select("s", "p", "o", "g"))
        return self._store()

    def explain(self, text: str) -> str:
        """The physical plan of a query."""
        df = self.query(text)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _new(self, quads: DataFrame) -> None:
        self.source = QuadStore.write(quads)
        self.results.clear()

    def _change(self, gone: DataFrame | None, new: DataFrame | None) -> None:
        self.source = self._store().changed(gone, new)
        self.results.clear()

    def _graph(self, x: Any) -> str:
        return DEFAULT if x in (None, "DEFAULT") else x.value

    def _apply(self, u: Update) -> None:
        base = self._store().quads.select("s", "p", "o", "g")
        g = F.col("g")
        if u.kind == "create":
            return
        if u.kind in ("clear", "drop"):
            gone = F.lit(True) if u.target == "ALL" else g != DEFAULT if u.target == "NAMED" else g == self._graph(u.target)
            return self._new(base.where(~gone))
        if u.kind in ("add", "copy", "move"):
            a, b = self._graph(u.source), self._graph(u.target)
            if a == b:
                return None
            if u.kind == "add":
                return self._change(None, base.where(g == a).withColumn("g", F.lit(b)))
            rest = base.where(g != b)
            rest = rest.where(g != a) if u.kind == "move" else rest
            return self._new(rest.unionByName(base.where(g == a).withColumn("g", F.lit(b))))
        if u.kind == "load":
            try:
                added = read_rdf(self.spark, u.source.removeprefix("file://") if u.source.startswith("file://") else u.source, self._graph(u.target))
                return self._change(None, added)
            except Exception:
                if u.silent:
                    return None
                raise
        where = u.where or Group()
        default = list(u.using) if u.using is not None else [u.graph] if u.graph else None
        named = list(u.using_named) if u.using_named is not None else None
        c = Compiler(self, self.source, default, named)
        f = c.group(where, (default, None))
        f = Frame(materialize(f.df, "where"), f.env) if f.env else f  # evaluated once
        self._change(self._quads(c, f, u.delete, u.graph), self._quads(c, f, u.insert, u.graph))

    def _quads(self, c: Compiler, f: Frame, template: tuple, graph: str | None) -> DataFrame | None:
        if not template:
            return None
        env, df = f.scope(), f.df.withColumn("_row", F.monotonically_increasing_id())
        made = []
        for g, t in template:
            s, p, o = c.template(t, env)
            if isinstance(g, Var):
                gc = _resource_col(env.get(g.name) or nothing())
            else:
                gc = F.lit(self._graph(g) if g is not None else graph or DEFAULT)
            made.append(F.struct(s.alias("s"), p.alias("p"), o.alias("o"), gc.alias("g")))
        rows = df.select(F.explode(F.array(*made)).alias("t")).select("t.s", "t.p", "t.o", "t.g")
        return rows.where("s is not null and p is not null and o is not null and g is not null")


def _local(iri: str) -> str:
    return iri.replace("#", "/").rsplit("/", 1)[-1]


def _resource_col(e: E):
    c = to_term(e)
    return F.when(c["k"].isin(5, 8), c["s"])


def _resource(f: Frame, v: str):
    return _resource_col(E(f.col(v), f.env[v].kind, f.env[v].null))


def _native(x: Any, kind: str) -> Any:
    """A constant as the Python value of a kind."""
    if kind.startswith("ref:"):
        return int(x.value.removeprefix(kind[4:]))
    fields = lit_fields(x)
    return x.value if kind in ("iri", "res", "str") else fields["i"] if kind == "int" else fields["d"]


def shown(f: Frame, names: list[str]) -> DataFrame:
    """Columns named as the variables; keys become IRIs."""
    low = [n.lower() for n in names]
    if len(set(low)) < len(low):
        raise SparqlError("two variables differ by case only; rename one")
    cols = []
    for v in names:
        e = E(f.col(v), f.env[v].kind, f.env[v].null)
        cols.append((ref_iri(e) if e.kind.startswith("ref:") else e).col.alias(v))
    return f.df.select(*cols)


__all__ = ["NS", "PREFIXES", "Engine", "SubSelect", "constant", "convert", "shown", "struct"]
