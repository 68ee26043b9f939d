"""RDF files as quads (s, p, o, g). N-Triples and N-Quads are read line by line with JVM
functions, so a file is split over tasks; Turtle has to be read file by file."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import DBL_TYPES, INT_TYPES, K_BNODE, K_BOOL, K_DATE, K_DBL, K_GEO, K_INT, K_IRI, K_LIT, WKT, lit_fields, struct
from ..plans.algebra import IRI, XSD, Var
from ..plans.parser import Parser, SparqlError
from .store import DEFAULT, SCHEMA

_NODE = r"<[^>]*>|_:[^\s<\"]+"
_LINE = rf'^\s*({_NODE})\s+<([^>]*)>\s+({_NODE}|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*({_NODE})?\s*\.\s*(?:#.*)?$'
_OBJECT = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


def _node(c: Column) -> Column:
    return F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def _unescaped(c: Column) -> Column:
    """The escapes of N-Triples are those of JSON, but for ``\\'`` and ``\\U``."""
    json = F.regexp_replace(F.regexp_replace(c, r"\\'", "'"), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    return F.when(c.contains("\\"), F.from_json(F.concat(F.lit('{"x":"'), json, F.lit('"}')), "x string")["x"]).otherwise(c)


def typed(lex: Column, dt: Column, lang: Column) -> Column:
    """The term of a literal; ill-formed values of known types become plain strings."""
    t = F.trim(lex)
    i, d = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")), F.regexp_replace(F.regexp_replace(t, "INF", "Infinity"), r"^\+", "").try_cast("double")
    full = F.when(dt == XSD + "gYear", F.concat(lex, F.lit("-01-01"))).when(dt == XSD + "gYearMonth", F.concat(lex, F.lit("-01"))).otherwise(lex)
    zone = F.regexp_extract(full, r"(Z|[+-]\d\d:\d\d)$", 1)
    when = F.regexp_replace(full, r"(Z|[+-]\d\d:\d\d)$", "")
    when = F.when(full.rlike(r"^-?\d{4,}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?$"), when.try_cast("timestamp_ntz"))
    plain = struct(k=F.lit(K_LIT), s=lex)
    dates = dt.isin(*[XSD + x for x in ("dateTime", "date", "gYear", "gYearMonth")])
    dur = F.regexp_extract
    part = lambda n: F.coalesce(dur(lex, r"^-?P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$", n).try_cast("double"), F.lit(0.0))
    seconds = (part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)) * F.when(lex.startswith("-"), -1.0).otherwise(1.0)
    good = lex.rlike(r"^-?P(?=.)(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$")
    out = F.when(lang != "", struct(k=F.lit(K_LIT), s=lex, lang=F.lower(lang)))
    out = out.when((dt == "") | (dt == XSD + "string"), plain)
    out = out.when(dt.isin(*sorted(INT_TYPES)), F.when(i.isNotNull(), struct(k=F.lit(K_INT), i=i)).when(t.rlike(r"^[+-]?[0-9]+$"), struct(k=F.lit(K_DBL), d=d)).otherwise(plain))
    out = out.when(dt.isin(*sorted(DBL_TYPES)), F.when(d.isNotNull(), struct(k=F.lit(K_DBL), d=d)).otherwise(plain))
    out = out.when(dt == XSD + "boolean", F.when(t.isin("true", "1"), struct(k=F.lit(K_BOOL), i=F.lit(1))).when(t.isin("false", "0"), struct(k=F.lit(K_BOOL), i=F.lit(0))).otherwise(plain))
    out = out.when(dates, F.when(when.isNotNull(), struct(k=F.lit(K_DATE), t=when, dt=dt, s=F.when(zone != "", zone))).otherwise(plain))
    out = out.when(dt == XSD + "dayTimeDuration", F.when(good, struct(k=F.lit(K_DATE), d=seconds, dt=dt)).otherwise(plain))
    out = out.when(dt == WKT, struct(k=F.when(lex.rlike(r"(?i)^\s*POINT\s*\("), K_GEO).otherwise(K_LIT), s=lex, dt=dt))
    return out.otherwise(struct(k=F.lit(K_LIT), s=lex, dt=dt))


def parse_lines(lines: DataFrame, graph: str = DEFAULT) -> DataFrame:
    """Quads of N-Triples or N-Quads lines (column value). A line that is neither a comment
    nor a statement stops the job."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    rows = rows.select(F.when(F.col("value").rlike(_LINE), part(1)).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.substring("value", 1, 200)))).alias("s"), part(2).alias("p"), part(3).alias("x"), part(4).alias("g"))
    x = F.col("x")
    lit = typed(_unescaped(F.regexp_extract(x, _OBJECT, 1)), F.regexp_extract(x, _OBJECT, 3), F.regexp_extract(x, _OBJECT, 2))
    o = F.when(x.startswith("<"), struct(k=F.lit(K_IRI), s=_node(x))).when(x.startswith("_:"), struct(k=F.lit(K_BNODE), s=x)).otherwise(lit)
    return rows.select(_node(F.col("s")).alias("s"), "p", o.alias("o"), F.when(F.col("g") == "", F.lit(graph)).otherwise(_node(F.col("g"))).alias("g"))


def turtle(text: str, graph: str = DEFAULT, tag: str = "") -> list[tuple]:
    """Quads of a Turtle document; blank nodes get ``tag`` in front of their labels."""
    p = Parser(text)
    out: list = []
    while p.peek()[0] != "end":
        if p.peek()[0] == "lang" and (word := p.peek()[1]) in ("@prefix", "@base"):  # a directive only where a statement begins
            p.toks[p.i] = ("word", word[1:], p.peek()[2])
        if p.is_word("PREFIX", "BASE"):
            p.prologue_one()
            p.take(".")
            continue
        out += p.triples_same_subject()
        p.want(".")
    name = lambda v: "_:" + tag + v.name.removeprefix("_:")
    rows = []
    for t in out:
        if not isinstance(t.p, IRI) or not isinstance(t.s, IRI | Var) or any(isinstance(x, Var) and not x.name.startswith("_:") for x in (t.s, t.o)):
            raise SparqlError("not a Turtle statement")
        f = lit_fields(name(t.o) if isinstance(t.o, Var) else t.o)
        rows.append((t.s.value if isinstance(t.s, IRI) else name(t.s), t.p.value, tuple(f.get(n) for n in ("k", "i", "d", "t", "s", "dt", "lang")), graph))
    return rows


def read_turtle(spark: SparkSession, path: str, graph: str = DEFAULT) -> DataFrame:
    files = spark.read.option("wholetext", True).text(path).select("value", F.concat(F.md5(F.input_file_name()).substr(1, 8), F.lit("-")).alias("tag"))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for text, tag in zip(p["value"], p["tag"], strict=True):
                rows = turtle(text, graph, tag)
                fields = ("k", "i", "d", "t", "s", "dt", "lang")
                yield pd.DataFrame({"s": [r[0] for r in rows], "p": [r[1] for r in rows], "o": [dict(zip(fields, r[2], strict=True)) for r in rows], "g": [r[3] for r in rows]})

    return files.mapInPandas(run, SCHEMA)


def read_rdf(spark: SparkSession, path: str, graph: str = DEFAULT, form: str | None = None) -> DataFrame:
    """Quads of a file or folder: .nt, .nq (split over tasks) or .ttl; compressed as Spark reads it."""
    form = form or path.rstrip("/").removesuffix(".gz").removesuffix(".bz2").rpartition(".")[2]
    if form in ("nt", "nq"):
        return parse_lines(spark.read.text(path), graph)
    if form in ("ttl", "turtle"):
        return read_turtle(spark, path, graph)
    raise SparqlError(f"unknown RDF format {form!r}")
