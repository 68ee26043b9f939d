"""Quads in Parquet, partitioned by predicate.

Each predicate is a directory, so a pattern with a constant predicate reads one. Quads are
held twice: ranges of subjects go to files sorted by subject, ranges of objects to files
sorted by object, so that file and row-group statistics skip most of a directory when either
is given. The number of files grows with the number of quads. A catalogue says of each
predicate how many triples it has and whether its objects have one kind: these are then read
as native columns.

Versions are immutable. An update writes a log of added and removed quads, which is merged
when a predicate it holds is read; a long log is merged into a new base."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import K_BNODE, K_BOOL, K_DATE, K_DBL, K_INT, K_IRI, K_LIT, TERM, WKT, E
from ..operators.frames import Frame, frame
from ..plans.algebra import XSD, Triple, Var
from ..shared import fresh_path, materialize
from .base import Source, match

DEFAULT = ""  # the name of the default graph
SCHEMA = f"s string, p string, o {TERM}, g string"


def _kind(o: Column) -> Column:
    k, dt, lang = o["k"], o["dt"], o["lang"]
    when = F.when((dt == XSD + "dateTime") & o["s"].isNull(), "ts").when((dt == XSD + "date") & o["s"].isNull(), "date").when(dt == XSD + "dayTimeDuration", "dur").otherwise("term")
    return F.when(k == K_INT, "int").when(k == K_DBL, "dbl").when(k == K_BOOL, "bool").when(k == K_IRI, "iri").when(k == K_BNODE, "res").when((k == K_LIT) & dt.isNull() & lang.isNull(), "str").when(k == K_DATE, when).when(dt == WKT, "wkt").otherwise("term")


def _common(kinds: set[str]) -> str | None:
    """The one kind of the objects of a predicate, if there is one."""
    if kinds <= {"iri", "res"}:
        return "iri" if kinds == {"iri"} else "res"
    return next(iter(kinds)) if len(kinds) == 1 else None


def native(o: Column, kind: str) -> Column:
    field = {"int": o["i"], "dbl": o["d"], "bool": o["i"] == 1, "ts": o["t"], "date": o["t"].cast("date"), "dur": o["d"]}
    return o if kind == "term" else field.get(kind, o["s"])


#: Quads in one file, about.
FILE_QUADS = 2_000_000
#: A log of this many quads, or of a quarter of the base, is merged into a new base.
LOG_QUADS = 200_000
#: Order of the copy that is sorted by object.
_OBJECT = ("o.s", "o.i", "o.d", "o.t")


def without(base: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows that are not in ``gone``; terms are compared field by field, nulls as equal."""
    return _matched(base, gone, "left_anti")


def within(base: DataFrame, some: DataFrame) -> DataFrame:
    """Rows that are in ``some``."""
    return _matched(base, some, "left_semi")


def _matched(base: DataFrame, some: DataFrame, how: str) -> DataFrame:
    key = F.xxhash64("s", "p", "o", "g")
    a, b = base.withColumn("_h", key), some.withColumn("_h", key).select("_h", *[F.col(n).alias(f"_{n}") for n in "spog"])
    on = a["_h"] == b["_h"]
    for n in "spog":
        on = on & a[n].eqNullSafe(b[f"_{n}"])
    return a.join(b, on, how).drop("_h")


class QuadStore(Source):
    def __init__(self, spark: SparkSession, base: DataFrame, kinds: dict[str, str] | None = None, one_graph: bool = False, by_object: DataFrame | None = None, count: int = 0):
        """``base`` (columns s, p, o, g) holds no quad twice. ``kinds``: of the objects of a
        predicate, where they are all of one. ``one_graph``: no triple is in two graphs.
        ``by_object``: the same quads sorted by object. ``count``: how many there are."""
        self.spark, self.base, self.kinds, self.one_graph = spark, base, kinds or {}, one_graph
        self.by_object, self.count = by_object, count
        #: The log: quads that are not in the base, and quads of the base that are no more;
        #: with the predicates of each.
        self.added: DataFrame | None = None
        self.removed: DataFrame | None = None
        self.added_p: frozenset[str] = frozenset()
        self.removed_p: frozenset[str] = frozenset()
        self.graphs: frozenset[str] = frozenset()

    @classmethod
    def write(cls, quads: DataFrame, path: str | None = None) -> QuadStore:
        spark = quads.sparkSession
        path = path or fresh_path(spark, "quads")
        rows = materialize(quads.select("s", "p", "o", "g").distinct(), "distinct")  # counted, and sorted twice
        parts = max(1, -(-rows.count() // FILE_QUADS))
        for name, keys in (("quads", ("s", "o.s")), ("by_object", _OBJECT)):
            rows.withColumn("pred", F.col("p")).repartitionByRange(parts, "p", *keys).sortWithinPartitions("p", *keys).write.partitionBy("pred").parquet(f"{path}/{name}")
        held = spark.read.schema(SCHEMA + ", pred string").parquet(f"{path}/quads")
        info = held.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.collect_set(_kind(F.col("o"))).alias("kinds"), F.min("g").alias("g0"), F.max("g").alias("g1"))
        info.coalesce(1).write.parquet(f"{path}/catalogue")  # one row a predicate
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuadStore:
        rows = spark.read.parquet(f"{path}/catalogue").collect()  # one row a predicate
        kinds = {r["p"]: k for r in rows if (k := _common(set(r["kinds"]))) is not None}
        graphs = frozenset(x for r in rows for x in (r["g0"], r["g1"]))
        held, by_object = (spark.read.schema(SCHEMA + ", pred string").parquet(f"{path}/{n}") for n in ("quads", "by_object"))
        store = cls(spark, held, kinds, len(graphs) <= 1, by_object, sum(r["n"] for r in rows))
        store.path, store.graphs = path, graphs
        return store

    @property
    def quads(self) -> DataFrame:
        """Every quad: s, p, o, g."""
        return self._merged(self.base, None)

    def _merged(self, df: DataFrame, p: str | None) -> DataFrame:
        """The quads of the base in ``df``, all or of one predicate, after the log."""
        if p is not None:
            df = df.where(F.col("pred") == p) if "pred" in df.columns else df.where(F.col("p") == p)
        of = lambda log: log if p is None else log.where(F.col("p") == p)
        if self.removed is not None and (p is None or p in self.removed_p):
            df = without(df.select("s", "p", "o", "g"), of(self.removed))
        if self.added is not None and (p is None or p in self.added_p):
            df = df.select("s", "p", "o", "g").unionByName(of(self.added))
        return df

    def changed(self, gone: DataFrame | None, new: DataFrame | None) -> QuadStore:
        """The store after an update: quads of ``gone`` leave, then those of ``new`` come. Only
        the log is written; the base is read for the predicates of the update alone."""
        none = self.spark.createDataFrame([], SCHEMA)
        gone = none if gone is None else materialize(gone.select("s", "p", "o", "g").distinct(), "gone")
        new = none if new is None else materialize(new.select("s", "p", "o", "g").distinct(), "new")
        touched = [r["p"] for r in gone.select("p").union(new.select("p")).distinct().limit(1001).collect()]
        base = self.base
        if len(touched) <= 1000:  # else all of the base is read
            base = base.where(F.col("pred" if "pred" in base.columns else "p").isin(touched))
        base = base.select("s", "p", "o", "g")
        removed = without((none if self.removed is None else self.removed).unionByName(within(base, gone)).distinct(), new)
        added = without(none if self.added is None else self.added, gone).unionByName(without(new, base)).distinct()
        out = QuadStore(self.spark, self.base, dict(self.kinds), self.one_graph, self.by_object, self.count)
        out.added, out.removed = materialize(added, "added"), materialize(removed, "removed")
        info = out.added.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.collect_set(_kind(F.col("o"))).alias("kinds"), F.collect_set("g").alias("g")).collect()  # one row a predicate
        lost = out.removed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
        out.added_p, out.removed_p = frozenset(r["p"] for r in info), frozenset(r["p"] for r in lost)
        out.graphs = self.graphs | {x for r in info for x in r["g"]}
        out.one_graph = len(out.graphs) <= 1
        known = {r["p"] for r in base.select("p").distinct().collect()} if info else set()  # as long as the schema
        for r in info:
            kind = _common(set(r["kinds"]) | ({self.kinds[r["p"]]} if r["p"] in self.kinds else {"term"} if r["p"] in known else set()))
            out.kinds.pop(r["p"], None)
            if kind is not None:
                out.kinds[r["p"]] = kind
        if sum(r["n"] for r in info) + sum(r["n"] for r in lost) > max(LOG_QUADS, self.count // 4):
            return QuadStore.write(out.quads)
        return out

    def _part(self, graphs: list[str] | None, graph_var: str | None, p: str | None = None, by_object: bool = False) -> DataFrame:
        df = self._merged(self.by_object if by_object and self.by_object is not None else self.base, p)
        if graph_var is not None:
            return df.where(F.col("g") != DEFAULT if graphs is None else F.col("g").isin(graphs) & (F.col("g") != DEFAULT))
        if graphs is not None:
            df = df.where(F.col("g").isin(graphs))
        if self.one_graph or (graphs is not None and len(graphs) == 1):
            return df
        return df.select("s", "p", "o").distinct()  # a triple counts once, in however many graphs it is

    def star(self, subject: Any, triples: list[Triple], graphs: list[str] | None, graph_var: str | None) -> list[Frame]:
        out = []
        for t in triples:
            p = t.p.value
            df = self._part(graphs, graph_var, p, isinstance(subject, Var) and not isinstance(t.o, Var))
            kind = self.kinds.get(p, "term")
            pairs = [(subject, E(F.col("s"), "res", False)), (t.o, E(native(F.col("o"), kind), kind, False))]
            if graph_var is not None:
                pairs.append((Var(graph_var), E(F.col("g"), "iri", False)))
            out.append(match(df, pairs))
        return out

    def any_predicate(self, graphs: list[str] | None, graph_var: str | None) -> tuple[DataFrame, dict[str, E]]:
        return self._part(graphs, graph_var), {"s": E(F.col("s"), "res", False), "p": E(F.col("p"), "iri", False), "o": E(F.col("o"), "term", False), "g": E(F.col("g"), "iri", False)}


def empty_store(spark: SparkSession) -> QuadStore:
    return QuadStore(spark, spark.createDataFrame([], SCHEMA), {}, True)


__all__ = ["DEFAULT", "SCHEMA", "QuadStore", "empty_store", "frame", "native"]
