"""RDF terms in columns: static kinds, the generic term struct, conversions, order.

A column whose terms all have one datatype holds native values (kind ``int``, ``dbl``,
``bool``, ``str``, ``iri``, ``res``, ``ts``, ``date``, ``dur``, ``wkt``, or ``ref:PREFIX``: the key of an
IRI that begins with PREFIX). Any mixture is kind ``term``: a struct. NULL is unbound.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import GEO, IRI, RDF, XSD, Lit

TERM = "struct<k:int,i:bigint,d:double,t:timestamp_ntz,s:string,dt:string,lang:string>"
K_BOOL, K_INT, K_DBL, K_LIT, K_IRI, K_DATE, K_GEO, K_BNODE = 1, 2, 3, 4, 5, 6, 7, 8
INT_TYPES = frozenset(XSD + t for t in "integer int long short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split())
DBL_TYPES = frozenset(XSD + t for t in ("double", "float", "decimal"))
WKT = GEO + "wktLiteral"
_FIELDS = {"k": "int", "i": "bigint", "d": "double", "t": "timestamp_ntz", "s": "string", "dt": "string", "lang": "string"}


@dataclass(frozen=True)
class E:
    """An expression: column, static kind, whether it may be unbound, constant if known."""

    col: Column
    kind: str
    null: bool = True
    const: Any = None

    def named(self, name: str) -> E:
        return replace(self, col=F.col(name), const=None)


def nothing(kind: str = "term") -> E:
    return E(F.lit(None).cast(SPARK_TYPE.get(kind, TERM)), kind)


SPARK_TYPE = {"int": "bigint", "dbl": "double", "bool": "boolean", "str": "string", "iri": "string", "res": "string", "ts": "timestamp_ntz", "date": "date", "dur": "double", "wkt": "string", "term": TERM}


def struct(**f: Column) -> Column:
    return F.struct(*[(f[n] if n in f else F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()])


def spark_type(kind: str) -> str:
    return "bigint" if kind.startswith("ref:") else SPARK_TYPE[kind]


def ref_iri(e: E) -> E:
    """The IRI of a native key."""
    return E(F.concat(F.lit(e.kind[4:]), e.col.cast("string")), "iri", e.null)


def to_term(e: E) -> Column:
    if e.kind == "term":
        return e.col
    c = e.col
    if e.kind.startswith("ref:"):
        c = ref_iri(e).col
        s = struct(k=F.lit(K_IRI), s=c)
    elif e.kind == "int":
        s = struct(k=F.lit(K_INT), i=c)
    elif e.kind == "dbl":
        s = struct(k=F.lit(K_DBL), d=c)
    elif e.kind == "bool":
        s = struct(k=F.lit(K_BOOL), i=c.cast("int"))
    elif e.kind == "str":
        s = struct(k=F.lit(K_LIT), s=c)
    elif e.kind == "iri":
        s = struct(k=F.lit(K_IRI), s=c)
    elif e.kind == "res":
        s = struct(k=F.when(c.startswith("_:"), K_BNODE).otherwise(K_IRI), s=c)
    elif e.kind == "ts":
        s = struct(k=F.lit(K_DATE), t=c, dt=F.lit(XSD + "dateTime"))
    elif e.kind == "date":
        s = struct(k=F.lit(K_DATE), t=c.cast("timestamp_ntz"), dt=F.lit(XSD + "date"))
    elif e.kind == "dur":
        s = struct(k=F.lit(K_DATE), d=c, dt=F.lit(XSD + "dayTimeDuration"))
    elif e.kind == "wkt":
        s = struct(k=F.when(c.rlike(r"(?i)^\s*POINT"), K_GEO).otherwise(K_LIT), s=c, dt=F.lit(WKT))
    else:
        raise ValueError(e.kind)
    return F.when(c.isNotNull(), s) if e.null else s


def convert(e: E, kind: str) -> E:
    if e.kind == kind:
        return e
    if kind in ("iri", "res") and e.kind.startswith("ref:"):
        return replace(ref_iri(e), kind=kind)
    if kind == "res" and e.kind == "iri":
        return replace(e, kind="res")
    return E(to_term(e), "term", e.null)


def common_kind(a: str, b: str) -> str:
    if a == b:
        return a
    pair = {"ref" if k.startswith("ref:") else k for k in (a, b)}
    if pair <= {"ref", "iri"}:
        return "iri"
    if pair <= {"ref", "iri", "res"}:
        return "res"
    return "term"


_DATE = re.compile(r"(-?\d{4,})-(\d\d)-(\d\d)(Z|[+-]\d\d:\d\d)?\Z")
_DT = re.compile(r"(-?\d{4,})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d)?\Z")
_DUR = re.compile(r"(-)?P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?\Z")


def parse_duration(s: str) -> float | None:
    m = _DUR.match(s)
    if not m or s[-1] in "PT":
        return None
    v = int(m[2] or 0) * 86400 + int(m[3] or 0) * 3600 + int(m[4] or 0) * 60 + float(m[5] or 0)
    return -v if m[1] else v


def lit_fields(x: Any) -> dict[str, Any] | None:
    """The fields of the term struct of a constant, as plain Python values."""
    if isinstance(x, IRI):
        return {"k": K_IRI, "s": x.value}
    if isinstance(x, str):  # a blank node
        return {"k": K_BNODE, "s": x}
    v, dt = x.value, x.dt
    if x.lang:
        return {"k": K_LIT, "s": v, "lang": x.lang}
    try:
        if dt in INT_TYPES:
            n = int(v.strip())
            return {"k": K_INT, "i": n} if -(2**63) <= n < 2**63 else {"k": K_DBL, "d": float(n)}
        if dt in DBL_TYPES:
            return {"k": K_DBL, "d": float(v.strip().replace("INF", "inf"))}
        if dt == XSD + "boolean":
            return {"k": K_BOOL, "i": {"true": 1, "1": 1, "false": 0, "0": 0}[v.strip()]}
    except (ValueError, KeyError):
        return {"k": K_LIT, "s": v}
    local = dt.removeprefix(XSD)
    if dt.startswith(XSD) and local in ("dateTime", "date", "gYear", "gYearMonth", "dayTimeDuration"):
        if local == "dayTimeDuration":
            d = parse_duration(v)
            return {"k": K_DATE, "d": d, "dt": dt} if d is not None else {"k": K_LIT, "s": v}
        full = {"gYear": v + "-01-01", "gYearMonth": v + "-01"}.get(local, v)
        m = (_DT if local == "dateTime" else _DATE).match(full)
        if not m:
            return {"k": K_LIT, "s": v}  # ill-formed: a plain string
        import datetime as dtm

        try:
            frac = int(float(m[7] or 0) * 1e6) if local == "dateTime" else 0
            t = dtm.datetime(int(m[1]), int(m[2]), int(m[3]), *([int(m[4]), int(m[5]), int(m[6]), frac] if local == "dateTime" else []))
        except ValueError:
            return {"k": K_LIT, "s": v}
        return {"k": K_DATE, "t": t, "dt": dt, "s": m[8] if local == "dateTime" else m[4]}
    if dt == WKT:
        return {"k": K_GEO if re.match(r"\s*POINT\s*\(", v, re.I) else K_LIT, "s": v, "dt": dt}
    return {"k": K_LIT, "s": v, "dt": None if dt == XSD + "string" else dt}


def constant(x: Any) -> E:
    """A literal or IRI as an expression of the narrowest kind."""
    f = lit_fields(x)
    k = f["k"]
    if k == K_IRI:
        return E(F.lit(f["s"]), "iri", False, x)
    if k == K_BOOL:
        return E(F.lit(bool(f["i"])), "bool", False, x)
    if k == K_INT:
        return E(F.lit(f["i"]).cast("bigint"), "int", False, x)
    if k == K_DBL:
        return E(F.lit(f["d"]).cast("double"), "dbl", False, x)
    if k == K_LIT and not f.get("lang") and not f.get("dt"):
        return E(F.lit(f["s"]), "str", False, x)
    if k == K_DATE and f["dt"] == XSD + "dateTime" and not f.get("s"):
        return E(F.lit(f["t"]).cast("timestamp_ntz"), "ts", False, x)
    if k == K_DATE and f["dt"] == XSD + "date" and not f.get("s"):
        return E(F.lit(f["t"].date()), "date", False, x)
    if k == K_DATE and f["dt"] == XSD + "dayTimeDuration":
        return E(F.lit(float(f["d"])), "dur", False, x)
    if f.get("dt") == WKT:
        return E(F.lit(f["s"]), "wkt", False, x)
    return E(struct(**{n: F.lit(v) for n, v in f.items() if v is not None}), "term", False, x)


def number(e: E) -> E:
    """The numeric value: kind int or dbl, or a term with a number in it; else NULL."""
    if e.kind in ("int", "dbl"):
        return e
    if e.kind == "bool":
        return E(e.col.cast("bigint"), "int", e.null)
    if e.kind == "term":
        k = e.col["k"]
        return E(F.when(k.isin(K_INT, K_DBL), e.col).when(k == K_BOOL, struct(k=F.lit(K_INT), i=e.col["i"])), "term", True)
    return E(F.lit(None).cast("double"), "dbl", True)


def as_double(e: E) -> Column:
    n = number(e)
    return F.coalesce(n.col["d"], n.col["i"].cast("double")) if n.kind == "term" else n.col.cast("double")


def double_text(c: Column) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def time_text(c: Column) -> Column:
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.rtrim(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0")))


def duration_text(c: Column) -> Column:
    a = F.abs(c)
    day, hour, minute, sec = F.floor(a / 86400), F.floor(F.pmod(a, F.lit(86400.0)) / 3600), F.floor(F.pmod(a, F.lit(3600.0)) / 60), F.pmod(a, F.lit(60.0))
    part = lambda x, u: F.when(x > 0, F.concat(x.cast("string"), F.lit(u))).otherwise("")
    time = F.concat(part(hour, "H"), part(minute, "M"), F.when(sec > 0, F.concat(double_text(sec), F.lit("S"))).otherwise(""))
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.lit("P"), part(day, "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.when(a == 0, "PT0S").otherwise(text)


def text(e: E) -> Column:
    """STR(): the lexical text of a term."""
    c = e.col
    if e.kind in ("str", "iri", "wkt"):
        return c
    if e.kind == "res":
        return F.when(~c.startswith("_:"), c)
    if e.kind.startswith("ref:"):
        return ref_iri(e).col
    if e.kind in ("int", "bool", "date"):
        return c.cast("string")
    if e.kind == "dbl":
        return double_text(c)
    if e.kind == "ts":
        return time_text(c)
    if e.kind == "dur":
        return duration_text(c)
    k, dt = c["k"], c["dt"]
    when = F.when(dt == XSD + "dayTimeDuration", duration_text(c["d"])).when(dt == XSD + "gYear", F.date_format(c["t"], "yyyy")).when(dt == XSD + "gYearMonth", F.date_format(c["t"], "yyyy-MM")).when(dt == XSD + "date", F.date_format(c["t"], "yyyy-MM-dd")).otherwise(time_text(c["t"]))
    when = F.when(dt == XSD + "dayTimeDuration", when).otherwise(F.concat(when, F.coalesce(c["s"], F.lit(""))))
    return F.when(k.isin(K_LIT, K_IRI, K_GEO), c["s"]).when(k == K_INT, c["i"].cast("string")).when(k == K_DBL, double_text(c["d"])).when(k == K_BOOL, (c["i"] == 1).cast("string")).when(k == K_DATE, when)


def literal(e: E) -> Column:
    """The text of a plain or language-tagged literal; NULL for every other term."""
    if e.kind == "str":
        return e.col
    if e.kind == "term":
        return F.when((e.col["k"] == K_LIT) & e.col["dt"].isNull(), e.col["s"])
    return F.lit(None).cast("string")


def language(e: E) -> Column:
    return e.col["lang"] if e.kind == "term" else F.lit(None).cast("string")


def like(e: E, new: Column) -> E:
    """A literal with other text and the language of ``e``."""
    if e.kind != "term":
        return E(new, "str", True)
    return E(F.when(new.isNotNull(), struct(k=F.lit(K_LIT), s=new, lang=e.col["lang"])), "term", True)


def ebv(e: E) -> Column:
    c = e.col
    if e.kind == "bool":
        return c
    if e.kind == "int":
        return c != 0
    if e.kind == "dbl":
        return (c != 0) & ~F.isnan(c)
    if e.kind in ("str", "iri", "wkt"):
        return c != ""
    if e.kind == "res":
        return F.when(~c.startswith("_:"), F.lit(True))
    if e.kind == "term":
        k = c["k"]
        return F.when(k.isin(K_BOOL, K_INT), c["i"] != 0).when(k == K_DBL, (c["d"] != 0) & ~F.isnan(c["d"])).when(k.isin(K_LIT, K_IRI), c["s"] != "").when(k != K_BNODE, F.lit(True))
    return F.when(c.isNotNull(), F.lit(True))


def collated(c: Column) -> Column:
    return F.collate(c, "UNICODE")


def order_key(e: E) -> list[Column]:
    """Columns that sort as the total order of terms: by datatype, then by value."""
    if e.kind == "term":
        c = e.col
        k = c["k"]
        rank = F.when(k == K_DBL, K_INT).when(k == K_IRI, K_LIT).otherwise(k)
        return [rank, F.when(k == K_DBL, c["d"]).when(k.isin(K_INT, K_BOOL), c["i"].cast("double")), F.when(k.isin(K_LIT, K_IRI), k), collated(c["s"]), c["s"], c["t"], c["d"], c["lang"], c["dt"]]
    if e.kind in ("str", "iri", "res", "wkt"):
        return [collated(e.col), e.col]
    if e.kind.startswith("ref:"):
        return [collated(ref_iri(e).col)]
    return [e.col]


def datatype(e: E) -> E:
    fixed = {"int": "int", "dbl": "double", "bool": "boolean", "str": "string", "ts": "dateTime", "date": "date", "dur": "dayTimeDuration"}
    if e.kind in fixed:
        return E(F.when(e.col.isNotNull(), F.lit(XSD + fixed[e.kind])), "iri", e.null)
    if e.kind == "wkt":
        return E(F.when(e.col.isNotNull(), F.lit(WKT)), "iri", e.null)
    if e.kind != "term":
        return nothing("iri")
    c = e.col
    k = c["k"]
    return E(F.when(k == K_INT, XSD + "int").when(k == K_DBL, XSD + "double").when(k == K_BOOL, XSD + "boolean").when(c["lang"].isNotNull(), RDF + "langString").when(k.isin(K_LIT, K_DATE, K_GEO), F.coalesce(c["dt"], F.lit(XSD + "string"))), "iri", True)


def is_literal_const(x: Any) -> bool:
    return isinstance(x, Lit)


def compare_const(e: E, x: Any) -> Column:
    """Whether a term of a triple is the constant ``x`` (the same term, not the same value)."""
    c = constant(x)
    if e.kind.startswith("ref:"):
        key = x.value.removeprefix(e.kind[4:]) if isinstance(x, IRI) else ""
        fits = isinstance(x, IRI) and x.value.startswith(e.kind[4:]) and re.fullmatch(r"0|-?[1-9]\d{0,18}", key)
        return e.col == int(key) if fits and -(2**63) <= int(key) < 2**63 else F.lit(False)
    if e.kind == c.kind or {e.kind, c.kind} == {"iri", "res"}:
        return e.col == c.col
    if e.kind != "term":
        return F.lit(False)
    out, t = F.lit(True), e.col
    for name, v in lit_fields(x).items():
        out = out & (t[name].isNull() if v is None else t[name] == F.lit(v))
    return out & (t["lang"].isNull() if not getattr(x, "lang", None) else F.lit(True)) & (t["dt"].isNull() if not lit_fields(x).get("dt") else F.lit(True))


def rdf_text(e: E) -> Column:
    """A term in N-Triples syntax."""
    c = to_term(e)
    k, dt, lang = c["k"], c["dt"], c["lang"]
    plain = text(E(c, "term", True))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), F.lit('"'))
    typed = lambda t: F.concat(quoted, F.lit(f"^^<{t}>"))
    dbl = F.when(F.isnan(c["d"]) | (F.abs(c["d"]) == float("inf")), typed(XSD + "double")).otherwise(F.concat(F.lit('"'), decimal_text(c["d"]), F.lit(f'"^^<{XSD}decimal>')))
    lit = F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang)).when(dt.isNotNull(), F.concat(quoted, F.lit("^^<"), dt, F.lit(">"))).otherwise(quoted)
    return F.when(k == K_IRI, F.concat(F.lit("<"), c["s"], F.lit(">"))).when(k == K_BNODE, c["s"]).when(k == K_INT, typed(XSD + "int")).when(k == K_DBL, dbl).when(k == K_BOOL, typed(XSD + "boolean")).otherwise(lit)


def decimal_text(c: Column) -> Column:
    """Doubles as results show them: one decimal place if whole, else 13 significant digits."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.format_string("%.1f", c)).otherwise(double_text(c))
