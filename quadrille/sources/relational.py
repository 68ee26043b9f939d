"""Relational tables as a graph, without making triples.

A row of a table with an integer key is the IRI ``BASE/table/key``, kept as the native key
until it is shown; a row of a table with other keys is an IRI made of them, and a row
without a key is a blank node. A column is the predicate ``BASE/table#column``; a foreign
key is also ``BASE/table#ref-column``, whose object is the IRI of the row referred to. Every
row has the type ``BASE/table``. A null is no triple. Each table is a graph of its own,
``BASE/graph/table``. All triples of one subject are answered by one scan of the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import K_LIT, E, common_kind, convert, spark_type, struct, to_term
from ..operators.frames import Frame, frame
from ..plans.algebra import IRI, RDF, Triple, Var
from .base import Source, match

BASE = "http://example.org/t/"
BITS = 62  # of a word that tells which predicates a subject has
_KINDS = {"string": "str", "double": "dbl", "float": "dbl", "boolean": "bool", "timestamp_ntz": "ts", "date": "date"}


@dataclass(frozen=True)
class Table:
    """``refs``: column to table; ``langs``: text column to the column with its language;
    ``wkt``: columns that hold geometries; ``row``: a text that differs for each row of a table
    without a key, and is the same in every scan (see ``file_row``)."""

    df: DataFrame
    key: tuple[str, ...] = ()
    refs: dict[str, str] = field(default_factory=dict)
    langs: dict[str, str] = field(default_factory=dict)
    wkt: tuple[str, ...] = ()
    row: Column | None = None


def file_row() -> Column:
    """The file and the place in it: names the rows of a table that is read from Parquet files,
    where nothing is derived from it yet. Needs no shuffle."""
    return F.concat(F.md5(F.col("_metadata.file_path").cast("binary")), F.lit("-"), F.col("_metadata.row_index").cast("string"))


class LazyTables(Mapping):
    """Tables by name, each opened when a query first needs it."""

    def __init__(self, names: list[str], open_: Callable[[str], Table]):
        self.names, self.open, self.held = list(names), open_, {}

    def __getitem__(self, name: str) -> Table:
        if name not in self.names:
            raise KeyError(name)
        if name not in self.held:
            self.held[name] = self.open(name)
        return self.held[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


class RelationalGraph(Source):
    def __init__(self, spark: SparkSession, tables: Mapping[str, Table], base: str = BASE):
        self.spark, self.tables, self.base = spark, tables, base

    def subject(self, name: str) -> E:
        t = self.tables[name]
        kinds = dict(t.df.dtypes)
        if len(t.key) == 1 and kinds[t.key[0]] in ("int", "bigint", "smallint", "tinyint"):
            return E(F.col(t.key[0]).cast("bigint"), f"ref:{self.base}{name}/", True)
        if t.key:
            return E(F.concat(F.lit(f"{self.base}{name}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in t.key])), "iri", True)
        if t.row is not None:
            return E(F.concat(F.lit(f"_:{name}-"), t.row), "res", False)
        row = F.md5(F.to_json(F.struct(*[F.col(c) for c in t.df.columns])))  # equal rows are told apart by a number
        return E(F.concat(F.lit(f"_:{name}-"), row, F.lit("-"), F.row_number().over(Window.partitionBy(row).orderBy(F.lit(1)))), "res", False)

    def columns(self, name: str) -> dict[str, E]:
        """Predicate to object of a table."""
        t, out = self.tables[name], {}
        for c, kind in t.df.dtypes:
            if c in t.wkt:
                out[f"{self.base}{name}#{c}"] = E(F.col(c), "wkt", True)
            elif c in t.langs:
                out[f"{self.base}{name}#{c}"] = E(F.when(F.col(c).isNotNull(), struct(k=F.lit(K_LIT), s=F.col(c), lang=F.lower(F.col(t.langs[c])))), "term", True)
            elif kind in ("int", "bigint", "smallint", "tinyint"):
                out[f"{self.base}{name}#{c}"] = E(F.col(c).cast("bigint"), "int", True)
            elif kind in _KINDS:
                out[f"{self.base}{name}#{c}"] = E(F.col(c).cast("double") if kind == "float" else F.col(c), _KINDS[kind], True)
            elif kind == "timestamp":
                out[f"{self.base}{name}#{c}"] = E(F.col(c).cast("timestamp_ntz"), "ts", True)
            if c in t.refs:
                out[f"{self.base}{name}#ref-{c}"] = E(F.col(c).cast("bigint"), f"ref:{self.base}{t.refs[c]}/", True)
        out[RDF + "type"] = E(F.lit(self.base + name), "iri", False)
        return out

    def _named(self, graphs: list[str] | None) -> list[str]:
        return [n for n in self.tables if graphs is None or f"{self.base}graph/{n}" in graphs]

    def _of(self, p: str, graphs) -> list[str]:
        names = self._named(graphs)
        if p == RDF + "type":
            return names
        name = p.removeprefix(self.base).partition("#")[0]
        return [name] if name in names and p in self.columns(name) else []

    def star(self, subject: Any, triples: list[Triple], graphs: list[str] | None, graph_var: str | None) -> list[Frame]:
        by: dict[str, list[Triple]] = {}
        types = [t for t in triples if t.p.value == RDF + "type"]
        for t in triples:
            if t in types:
                continue
            by.setdefault((self._of(t.p.value, graphs) or ["?"])[0], []).append(t)
        if not by or (types and len(by) > 1):
            for t in types:  # rows of every table, or of the one named
                names = self._named(graphs)
                if isinstance(t.o, IRI):
                    names = [n for n in names if self.base + n == t.o.value]
                by.setdefault("|".join(names) or "?", []).append(t)
        elif types:
            next(iter(by.values())).extend(types)
        return [self._scan(n, subject, ts, graph_var) for n, ts in by.items()]

    def _scan(self, names: str, subject: Any, triples: list[Triple], graph_var: str | None) -> Frame:
        from ..operators.frames import union

        made = []
        for n in names.split("|"):
            if n == "?":
                continue
            cols = self.columns(n)
            pairs = [(subject, self.subject(n))] + [(t.o, cols[t.p.value]) for t in triples]
            if graph_var:
                pairs.append((Var(graph_var), E(F.lit(f"{self.base}graph/{n}"), "iri", False)))
            made.append(match(self.tables[n].df, pairs))
        if made:
            return made[0] if len(made) == 1 else union(made)
        # Nothing fits: no rows, with the kinds that rows would have.
        kinds: dict[str, str] = {graph_var: "iri"} if graph_var else {}
        for t in triples:
            home = self._of(t.p.value, None)
            for x, e in ((subject, self.subject(home[0]) if home else None), (t.o, self.columns(home[0])[t.p.value] if home else None)):
                if isinstance(x, Var):
                    kinds.setdefault(x.name, e.kind if e else "iri")
        return frame(self.spark.range(0), {v: E(F.lit(None).cast(spark_type(k)), k, False) for v, k in kinds.items()})

    def any_predicate(self, graphs: list[str] | None, graph_var: str | None) -> tuple[DataFrame, dict[str, E]]:
        """One scan a table; its columns become rows."""
        out, names = None, self._named(graphs)
        kinds = {self.subject(n).kind for n in names}
        kind = "iri" if not kinds else next(iter(kinds))
        for k in kinds:
            kind = common_kind(kind, k)
        for n in names:
            cols = self.columns(n)
            s = convert(self.subject(n), kind)
            # Subjects come before the rows are spread: a numbered subject is one for all its triples.
            pairs = F.array(*[F.struct(F.lit(p).alias("p"), to_term(e).alias("o")) for p, e in cols.items()])
            df = self.tables[n].df.select(s.col.alias("s"), pairs.alias("x")).select("s", F.explode("x").alias("x"), F.lit(f"{self.base}graph/{n}").alias("g")).select("s", "x.p", "x.o", "g").where("o is not null")
            out = df if out is None else out.unionByName(df)
        if out is None:
            out = self.spark.range(0).select(F.lit("").alias("s"), F.lit("").alias("p"), struct().alias("o"), F.lit("").alias("g"))
        return out, {"s": E(F.col("s"), kind, False), "p": E(F.col("p"), "iri", False), "o": E(F.col("o"), "term", False), "g": E(F.col("g"), "iri", False)}

    def has_predicate(self, graphs: list[str] | None) -> tuple[DataFrame, dict[str, E]]:
        """Predicates are single-valued here, so the pairs are distinct without a shuffle."""
        return self.any_predicate(graphs, None)

    def subject_counts(self, graphs: list[str] | None) -> DataFrame:
        """Rows of one subject become one row of native keys and bits, which tell the predicates
        it has; a row without a key is a subject of its own, and nothing is shuffled for it."""
        out = None
        for n in self._named(graphs):
            cols = self.columns(n)
            has = [F.when(e.col.isNotNull(), 1).otherwise(0) if e.null else F.lit(1) for e in cols.values()]
            words = [has[k : k + BITS] for k in range(0, len(has), BITS)]
            masks = [sum((F.shiftleft(b.cast("bigint"), i) for i, b in enumerate(w)), F.lit(0).cast("bigint")).alias(f"m{k}") for k, w in enumerate(words)]
            s = self.subject(n).col if self.tables[n].key else F.lit(True)
            df = self.tables[n].df.select(s.alias("s"), *masks)
            if self.tables[n].key:
                df = df.groupBy("s").agg(*[F.bit_or(f"m{k}").alias(f"m{k}") for k in range(len(masks))])
            bit = lambda i: F.col(f"m{i // BITS}").bitwiseAND(F.lit(1 << i % BITS).cast("bigint")) != 0
            counts = [F.count(F.when(bit(i), F.col("s"))).alias(f"n{i}") for i in range(len(cols))] + [F.count(F.when(bit(i), 1)).alias(f"r{i}") for i in range(len(cols))]
            rows = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")) for i, p in enumerate(cols)])
            made = df.agg(*counts).select(F.explode(rows).alias("x")).select("x.*").where("r > 0")
            out = made if out is None else out.unionByName(made)
        if out is None:
            return self.spark.range(0).select(F.lit("").alias("p"), F.col("id").alias("n"))
        return out.groupBy("p").agg(F.sum("n").alias("n"))
