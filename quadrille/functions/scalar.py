"""SPARQL expressions as columns. An error is NULL; nothing here raises at run time."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import AGGREGATES, IRI, RDF, XSD, Call, Exists, Lit, Var
from ..plans.parser import SparqlError
from . import geo
from .terms import K_BNODE, K_BOOL, K_DATE, K_DBL, K_GEO, K_INT, K_IRI, K_LIT, WKT, E, as_double, collated, constant, convert, common_kind, datatype, ebv, language, like, literal, nothing, number, ref_iri, struct, text, to_term

MATH = "http://www.w3.org/2005/xpath-functions/math#"
GEOF = "http://www.opengis.net/def/function/geosparql/"
QL = "http://quadrille.example/fn#"  # functions beyond the standard, by local name
STRINGS = ("str", "iri", "res", "wkt")


class Scope:
    """What an expression may use: variables, and aggregates or EXISTS computed before."""

    def __init__(self, env: dict[str, E], ready: dict[Any, E] | None = None, now: Any = None, base: str = ""):
        self.env, self.ready, self.now, self.base = env, ready or {}, now, base


def _cmp(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _strings(op: str, a: Column, b: Column) -> Column:
    return _cmp(op, a, b) if op in ("=", "!=") else _cmp(op, collated(a), collated(b))


def compare(op: str, a: E, b: E) -> E:
    """Comparison of compatible terms; NULL where types are incompatible, also for !=."""
    null = a.null or b.null
    for x, y in ((a, b), (b, a)):  # a key against a constant IRI: compare keys
        if x.kind.startswith("ref:") and isinstance(y.const, IRI) and op in ("=", "!="):
            key = y.const.value.removeprefix(x.kind[4:])
            if y.const.value.startswith(x.kind[4:]) and key.lstrip("-").isdigit():
                return E(_cmp(op, x.col, F.lit(int(key))), "bool", x.null)
    if a.kind == b.kind and a.kind.startswith("ref:") and op in ("=", "!="):
        return E(_cmp(op, a.col, b.col), "bool", null)
    if a.kind.startswith("ref:"):
        a = ref_iri(a)
    if b.kind.startswith("ref:"):
        b = ref_iri(b)
    ka, kb = a.kind, b.kind
    if ka in ("int", "dbl") and kb in ("int", "dbl"):
        return E(_cmp(op, a.col, b.col), "bool", null)
    if ka == kb and ka in ("bool", "ts", "date", "dur"):
        return E(_cmp(op, a.col, b.col), "bool", null)
    if {ka, kb} <= {"iri", "res"} or ka == kb == "str":
        return E(_strings(op, a.col, b.col), "bool", null)
    if ka != "term" and kb != "term":
        if {ka, kb} <= {"str", "iri", "res", "wkt"}:  # all are strings: literals before IRIs
            rank = {"str": 0, "wkt": 0}
            x, y = rank.get(ka, 1), rank.get(kb, 1)
            if x == y:
                return E(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "!=")), "bool", null) if op in ("=", "!=") else nothing("bool")
            known = {"=": False, "!=": True, "<": x < y, "<=": x < y, ">": x > y, ">=": x > y}[op]
            return E(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(known)), "bool", null)
        return nothing("bool")
    # One side of a known kind: only the branch that can apply.
    for x, y, flip in ((a, b, False), (b, a, True)):
        if x.kind == "term" and y.kind != "term":
            c, k = x.col, x.col["k"]
            o = op if not flip else {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
            if y.kind in ("int", "dbl"):
                return E(F.when(k == K_INT, _cmp(o, c["i"], y.col)).when(k == K_DBL, _cmp(o, c["d"], y.col)), "bool", True)
            if y.kind == "str":
                plain = c["dt"].isNull() & c["lang"].isNull()
                same = F.when((k == K_LIT) & plain, _strings(o, c["s"], y.col))
                other = {"=": F.lit(False), "!=": F.lit(True)}.get(o, _strings(o, c["s"], y.col) if o in "<>" or o in ("<=", ">=") else None)
                return E(same.when(k == K_LIT, other).when(k == K_IRI, F.lit(o in ("!=", ">", ">="))), "bool", True)
            if y.kind in ("iri", "res"):
                return E(F.when(k.isin(K_IRI, K_BNODE), _strings(o, c["s"], y.col)).when(k == K_LIT, F.lit(o in ("!=", "<", "<="))), "bool", True)
            if y.kind == "bool":
                return E(F.when(k == K_BOOL, _cmp(o, c["i"] == 1, y.col)), "bool", True)
    x, y = to_term(a), to_term(b)
    kx, ky = x["k"], y["k"]
    num = lambda t: F.coalesce(t["d"], t["i"].cast("double"))
    lit_eq = x["s"].eqNullSafe(y["s"]) & x["dt"].eqNullSafe(y["dt"]) & x["lang"].eqNullSafe(y["lang"])
    if op in ("=", "!="):
        strs = (lit_eq & (kx == ky)) if op == "=" else ~(lit_eq & (kx == ky))
    else:
        strs = F.when(kx == ky, _strings(op, x["s"], y["s"])).otherwise(_cmp(op, kx, ky))
    out = F.when((kx == K_INT) & (ky == K_INT), _cmp(op, x["i"], y["i"])).when(kx.isin(K_INT, K_DBL) & ky.isin(K_INT, K_DBL), _cmp(op, num(x), num(y)))
    out = out.when((kx == K_BOOL) & (ky == K_BOOL), _cmp(op, x["i"], y["i"])).when(kx.isin(K_LIT, K_IRI) & ky.isin(K_LIT, K_IRI), strs)
    out = out.when((kx == K_DATE) & (ky == K_DATE) & x["t"].isNotNull() & y["t"].isNotNull(), _cmp(op, x["t"], y["t"])).when((kx == K_DATE) & (ky == K_DATE) & x["d"].isNotNull() & y["d"].isNotNull(), _cmp(op, x["d"], y["d"]))
    if op in ("=", "!="):
        out = out.when((kx == ky) & kx.isin(K_GEO, K_BNODE), _cmp(op, x["s"], y["s"]))
    return E(out, "bool", True)


_TRY = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


def arith(op: str, a: E, b: E) -> E:
    null = a.null or b.null
    if op in "+-" and ({a.kind, b.kind} & {"ts", "date", "dur"}):
        micro = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
        if a.kind == b.kind == "ts" and op == "-":
            return E(micro(a.col) - micro(b.col), "dur", null)
        if a.kind == b.kind == "date" and op == "-":
            return E(F.datediff(a.col, b.col).cast("double") * 86400, "dur", null)
        if a.kind == b.kind == "dur":
            return E(a.col + b.col if op == "+" else a.col - b.col, "dur", null)
        if a.kind in ("ts", "date") and b.kind == "dur":
            d = b.col if op == "+" else -b.col
            made = F.timestamp_micros((F.unix_micros(a.col.cast("timestamp_ntz").cast("timestamp")) + F.round(d * 1e6)).cast("bigint")).cast("timestamp_ntz")
            return E(made if a.kind == "ts" else made.cast("date"), a.kind, null)
        return nothing("dbl")
    a, b = number(a), number(b)
    if op == "/":
        return E(F.try_divide(as_double(a), as_double(b)), "dbl", True)
    if a.kind == b.kind == "int":
        return E(_TRY[op](a.col, b.col), "int", True)
    if "term" not in (a.kind, b.kind):
        x, y = a.col.cast("double"), b.col.cast("double")
        return E({"+": x + y, "-": x - y, "*": x * y}[op], "dbl", null)
    x, y = to_term(a), to_term(b)
    both = (x["k"] == K_INT) & (y["k"] == K_INT)
    i = _TRY[op](x["i"], y["i"])
    p, q = as_double(a), as_double(b)
    d = {"+": p + q, "-": p - q, "*": p * q}[op]
    return E(F.when(both, F.when(i.isNotNull(), struct(k=F.lit(K_INT), i=i))).when(d.isNotNull(), struct(k=F.lit(K_DBL), d=d)), "term", True)


def _numeric(e: E, f: Callable[[Column, bool], Column]) -> E:
    """A type-preserving function; the flag says whether the input is an integer."""
    n = number(e)
    if n.kind == "int":
        return E(f(n.col, True), "int", True)
    if n.kind == "dbl":
        return E(f(n.col, False), "dbl", n.null)
    i, d = f(n.col["i"], True), f(n.col["d"], False)
    return E(F.when(n.col["k"] == K_INT, struct(k=F.lit(K_INT), i=i)).when(n.col["k"] == K_DBL, struct(k=F.lit(K_DBL), d=d)), "term", True)


def round_half_up(c: Column) -> Column:
    """Ties go towards positive infinity."""
    return F.when(F.isnan(c) | (F.abs(c) >= 2.0**52), c).otherwise(F.floor(c + 0.5).cast("double"))


def merge(items: list[E]) -> tuple[list[Column], str]:
    """Branches of one conditional in a common kind."""
    kinds = [x.kind for x in items if x.const is not None or x.kind != "void"]
    kind = kinds[0]
    for k in kinds[1:]:
        kind = common_kind(kind, k)
    return [convert(x, kind).col for x in items], kind


def _substr(s: Column, start: Column, length: Column | None) -> Column:
    """1-based; arguments are rounded; a start before 1 shortens the length."""
    a = round_half_up(start)
    end = F.lit(float(2**31 - 1)) if length is None else a + round_half_up(length)
    lo = F.greatest(a, F.lit(1.0))
    n = F.least(end, F.lit(float(2**31 - 1))) - lo
    ok = s.isNotNull() & start.isNotNull() & (F.lit(True) if length is None else length.isNotNull())
    bad = F.isnan(a) | F.isnan(end) | (n <= 0)
    return F.when(ok & bad, F.lit("")).when(ok, F.substring(s, F.least(lo, F.lit(2.0**31 - 1)).cast("int"), n.cast("int")))


def _regex_flags(flags: E | None, pattern: str) -> str:
    if flags is None:
        return pattern
    if not (isinstance(flags.const, Lit) and not flags.const.lang):
        raise SparqlError("regex flags must be a simple literal")
    f = flags.const.value
    if set(f) - set("imsU"):
        raise SparqlError(f"unknown regex flags {f!r}")
    f = f.replace("U", "")
    return f"(?{f}){pattern}" if f else pattern


def _check_regex(p: str) -> None:
    import re as _re

    try:
        _re.compile(_re.sub(r"\\p\{\w+\}|\\P\{\w+\}", "x", p))
    except _re.error as e:
        raise SparqlError(f"invalid regex {p!r}: {e}") from None


def _encode_uri(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _before_after(name: str, a: E, b: E) -> E:
    s, p = literal(a), literal(b)
    at = F.position(p, s)
    fits = language(b).isNull() | language(a).eqNullSafe(language(b))
    if name == "STRBEFORE":
        found = like(a, F.when(fits & (p == ""), F.lit("")).when(fits & (at > 0), F.substring(s, F.lit(1), at - 1)))
    else:
        found = like(a, F.when(fits & (p == ""), s).when(fits & (at > 0), F.substring(s, at + F.length(p), F.lit(2**31 - 1))))
    plain = E(F.when(fits & (p != "") & (at == 0), F.lit("")), "str", True)
    cols, kind = merge([found, plain])
    return E(F.coalesce(*cols), kind, True)


def _concat(items: list[E]) -> E:
    if not items:
        return E(F.lit(""), "str", False)
    made = F.concat(*[literal(x) for x in items])
    if all(x.kind == "str" for x in items):
        return E(made, "str", any(x.null for x in items))
    lang = language(items[0])
    same = F.lit(True)
    for x in items[1:]:
        same = same & lang.eqNullSafe(language(x))
    return E(F.when(made.isNotNull(), struct(k=F.lit(K_LIT), s=made, lang=F.when(same, lang))), "term", True)


def _lexical(e: E) -> Column:
    """Text to be cast: of any literal, trimmed; NULL for IRIs."""
    if e.kind in ("iri", "res") or e.kind.startswith("ref:"):
        return F.lit(None).cast("string")
    t = F.trim(text(e))
    return F.when(e.col["k"] != K_IRI, t) if e.kind == "term" else t


def cast_to(name: str, e: E) -> E:
    if name == "string":
        return E(text(e), "str", True)
    s = _lexical(e)
    if name in ("integer", "int", "long", "short", "byte", "nonNegativeInteger"):
        if e.kind in ("int", "bool"):
            return replace(number(e))
        d = as_double(e)
        lex = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))
        whole = F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < 2.0**63), F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))).cast("bigint") if e.kind in ("dbl", "term") else F.lit(None).cast("bigint")
        if e.kind == "term":
            exact = F.when(e.col["k"].isin(K_INT, K_BOOL), e.col["i"])
            return E(F.coalesce(exact, whole, lex), "int", True)
        return E(F.coalesce(whole, lex), "int", True)
    if name in ("double", "float", "decimal"):
        d = as_double(e)
        ok = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$" if name == "decimal" else r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|INF|NaN)$"
        lex = F.when(s.rlike(ok), F.regexp_replace(s, r"^\+", "").try_cast("double"))
        return E(F.coalesce(d, lex) if e.kind in ("int", "dbl", "bool", "term") else lex, "dbl", True)
    if name == "boolean":
        if e.kind == "bool":
            return e
        d = as_double(e)
        lex = F.when(s.isin("true", "1"), F.lit(True)).when(s.isin("false", "0"), F.lit(False))
        return E(F.coalesce((d != 0) & ~F.isnan(d), lex) if e.kind in ("int", "dbl", "term") else lex, "bool", True)
    if name == "dateTime":
        if e.kind == "ts":
            return e
        if e.kind == "date":
            return E(e.col.cast("timestamp_ntz"), "ts", e.null)
        lex = F.when(s.rlike(r"^-?\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?$"), s.try_cast("timestamp_ntz"))
        return E(F.coalesce(e.col["t"], lex) if e.kind == "term" else lex, "ts", True)
    if name == "date":
        if e.kind == "date":
            return e
        if e.kind == "ts":
            return E(e.col.cast("date"), "date", e.null)
        lex = F.when(s.rlike(r"^-?\d{4}-\d\d-\d\d"), F.substring(s, 1, 10).try_cast("date"))
        return E(F.coalesce(e.col["t"].cast("date"), lex) if e.kind == "term" else lex, "date", True)
    raise SparqlError(f"no cast to xsd:{name}")


def _moment(e: E) -> Column:
    if e.kind == "ts":
        return e.col
    if e.kind == "date":
        return e.col.cast("timestamp_ntz")
    return e.col["t"] if e.kind == "term" else F.lit(None).cast("timestamp_ntz")


def _has(e: E, *types: str) -> Column:
    """Whether the date is one of the datatypes (local names)."""
    if e.kind == "ts":
        return F.lit("dateTime" in types)
    if e.kind == "date":
        return F.lit("date" in types)
    return e.col["dt"].isin(*[XSD + t for t in types]) if e.kind == "term" else F.lit(False)


def _is(e: E, *ks: int) -> Column:
    if e.kind == "term":
        return F.coalesce(e.col["k"].isin(*ks), F.lit(False))
    if e.kind == "res":
        return F.coalesce(F.when(e.col.startswith("_:"), F.lit(K_BNODE in ks)).otherwise(F.lit(K_IRI in ks)), F.lit(False)) & e.col.isNotNull()
    k = {"bool": K_BOOL, "int": K_INT, "dbl": K_DBL, "str": K_LIT, "ts": K_DATE, "date": K_DATE, "dur": K_DATE, "wkt": K_GEO, "iri": K_IRI}.get(e.kind, K_IRI)
    return e.col.isNotNull() & F.lit(k in ks)


def compile_expr(x: Any, scope: Scope) -> E:
    if x in scope.ready:
        return scope.ready[x]
    if isinstance(x, Var):
        return scope.env.get(x.name) or nothing()
    if isinstance(x, Lit | IRI):
        return constant(x)
    if isinstance(x, Exists):
        raise SparqlError("EXISTS is not allowed here")
    if not isinstance(x, Call):
        raise SparqlError(f"not an expression: {x!r}")
    if x.name in AGGREGATES:
        raise SparqlError(f"{x.name} outside of an aggregated query")
    a = [compile_expr(y, scope) for y in x.args]
    return function(x.name, a, scope)


def function(name: str, a: list[E], scope: Scope) -> E:
    if name in ("=", "!=", "<", "<=", ">", ">="):
        return compare(name, *a)
    if name in ("+", "-", "*", "/"):
        return arith(name, *a)
    if name == "neg":
        return _numeric(a[0], lambda c, whole: F.try_subtract(F.lit(0), c) if whole else -c)
    if name == "&&":
        return E(ebv(a[0]) & ebv(a[1]), "bool", True)
    if name == "||":
        return E(ebv(a[0]) | ebv(a[1]), "bool", True)
    if name == "!":
        return E(~ebv(a[0]), "bool", a[0].null)
    if name in ("IN", "NOT IN"):
        out = F.lit(False)
        for y in a[1:]:
            out = out | compare("=", a[0], y).col
        return E(out if name == "IN" else ~out, "bool", True)
    if name == "IF":
        c = ebv(a[0])
        cols, kind = merge(a[1:])
        return E(F.when(c, cols[0]).when(~c, cols[1]), kind, True)
    if name == "COALESCE":
        cols, kind = merge(a)
        return E(F.coalesce(*cols), kind, all(x.null for x in a))
    if name == "BOUND":
        return E(a[0].col.isNotNull(), "bool", False)
    if name in ("ISIRI", "ISURI"):
        return E(_is(a[0], K_IRI), "bool", False)
    if name == "ISBLANK":
        return E(_is(a[0], K_BNODE), "bool", False)
    if name == "ISLITERAL":
        return E(_is(a[0], K_BOOL, K_INT, K_DBL, K_LIT, K_DATE, K_GEO), "bool", False)
    if name == "ISNUMERIC":
        return E(_is(a[0], K_INT, K_DBL), "bool", False)
    if name == "SAMETERM":
        return E(to_term(a[0]) == to_term(a[1]), "bool", True)
    if name == "LANG":
        e = a[0]
        if e.kind == "term":
            return E(F.when(e.col["k"].isin(K_IRI, K_BNODE), None).otherwise(F.when(e.col.isNotNull(), F.coalesce(e.col["lang"], F.lit("")))), "str", True)
        return nothing("str") if e.kind in ("iri", "res") or e.kind.startswith("ref:") else E(F.when(e.col.isNotNull(), F.lit("")), "str", e.null)
    if name == "LANGMATCHES":
        t, r = F.lower(literal(a[0])), F.lower(literal(a[1]))
        bare = F.when(r.endswith("*"), F.substring(r, F.lit(1), F.length(r) - 1))
        return E(F.when((t == "") | (r == ""), F.lit(False)).when(r.endswith("*"), t.startswith(bare)).otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))), "bool", True)
    if name == "DATATYPE":
        return datatype(a[0])
    if name == "STR":
        return E(text(a[0]), "str", a[0].null)
    if name in ("IRI", "URI"):
        e = a[0]
        if e.kind == "iri" or e.kind.startswith("ref:"):
            return e
        s = F.when(e.col["k"].isin(K_IRI, K_LIT), e.col["s"]) if e.kind == "term" else text(e) if e.kind in STRINGS else F.lit(None).cast("string")
        return E(F.when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), s).otherwise(F.concat(F.lit(scope.base), s)) if scope.base else s, "iri", True)
    if name == "BNODE":
        return E(F.concat(F.lit("_:b"), F.uuid() if not a else F.md5(F.concat_ws("|", literal(a[0]), F.monotonically_increasing_id()))), "res", False)
    if name == "STRLANG":
        s = F.when(language(a[0]).isNull(), literal(a[0]))
        return E(F.when(s.isNotNull(), struct(k=F.lit(K_LIT), s=s, lang=F.lower(literal(a[1])))), "term", True)
    if name == "STRDT":
        s, dt = F.when(language(a[0]).isNull(), literal(a[0])), a[1].const
        if not isinstance(dt, IRI):
            raise SparqlError("STRDT takes a constant datatype")
        local = dt.value.removeprefix(XSD)
        if dt.value.startswith(XSD) and local in ("string", "integer", "int", "double", "float", "decimal", "boolean", "date", "dateTime"):
            return cast_to(local, E(s, "str", True))
        return E(s, "wkt", True) if dt.value == WKT else E(F.when(s.isNotNull(), struct(k=F.lit(K_LIT), s=s, dt=F.lit(dt.value))), "term", True)
    if name == "UUID":
        return E(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri", False)
    if name == "STRUUID":
        return E(F.uuid(), "str", False)
    if name == "STRLEN":
        return E(F.length(literal(a[0])).cast("bigint"), "int", True)
    if name == "SUBSTR":
        return like(a[0], _substr(literal(a[0]), as_double(a[1]), as_double(a[2]) if len(a) > 2 else None))
    if name == "UCASE":
        return like(a[0], F.upper(literal(a[0])))
    if name == "LCASE":
        return like(a[0], F.lower(literal(a[0])))
    if name in ("STRSTARTS", "STRENDS", "CONTAINS"):
        s, p = literal(a[0]), literal(a[1])
        return E({"STRSTARTS": F.startswith, "STRENDS": F.endswith, "CONTAINS": F.contains}[name](s, p), "bool", True)
    if name in ("STRBEFORE", "STRAFTER"):
        return _before_after(name, *a)
    if name == "ENCODE_FOR_URI":
        return E(_encode_uri(literal(a[0])), "str", True)
    if name == "CONCAT":
        return _concat(a)
    if name in ("REGEX", "REPLACE"):
        s, flags = literal(a[0]), a[(2 if name == "REGEX" else 3)] if len(a) > (2 if name == "REGEX" else 3) else None
        if isinstance(a[1].const, Lit):
            p = _regex_flags(flags, a[1].const.value)
            _check_regex(p)
            pattern = F.lit(p)
        else:
            pattern = F.concat(F.lit(_regex_flags(flags, "")), literal(a[1]))
        if name == "REGEX":
            return E(F.regexp_like(s, pattern), "bool", True)
        return like(a[0], F.regexp_replace(s, pattern, literal(a[2])))
    if name in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
        s = literal(a[0])
        return E({"MD5": F.md5, "SHA1": F.sha1}.get(name, lambda c: F.sha2(c, int(name[3:])))(s.cast("binary")), "str", True)
    if name == "ABS":
        return _numeric(a[0], lambda c, whole: F.abs(c))
    if name == "CEIL":
        return _numeric(a[0], lambda c, whole: c if whole else F.ceil(c).cast("double"))
    if name == "FLOOR":
        return _numeric(a[0], lambda c, whole: c if whole else F.floor(c).cast("double"))
    if name == "ROUND":
        return _numeric(a[0], lambda c, whole: c if whole else round_half_up(c))
    if name == "RAND":
        return E(F.rand(), "dbl", False)
    if name == "NOW":
        return E(F.lit(scope.now).cast("timestamp_ntz") if scope.now else F.current_timestamp().cast("timestamp_ntz"), "ts", False)
    if name == "YEAR":
        return E(F.when(_has(a[0], "dateTime", "date", "gYear", "gYearMonth"), F.year(_moment(a[0])).cast("bigint")), "int", True)
    if name == "MONTH":
        return E(F.when(_has(a[0], "dateTime", "date", "gYearMonth"), F.month(_moment(a[0])).cast("bigint")), "int", True)
    if name == "DAY":
        return E(F.when(_has(a[0], "dateTime", "date"), F.dayofmonth(_moment(a[0])).cast("bigint")), "int", True)
    if name == "HOURS":
        return E(F.when(_has(a[0], "dateTime"), F.hour(_moment(a[0])).cast("bigint")), "int", True)
    if name == "MINUTES":
        return E(F.when(_has(a[0], "dateTime"), F.minute(_moment(a[0])).cast("bigint")), "int", True)
    if name == "SECONDS":
        return E(F.when(_has(a[0], "dateTime"), F.extract(F.lit("SECOND"), _moment(a[0])).cast("double")), "dbl", True)
    if name in ("TZ", "TIMEZONE"):
        e = a[0]
        tz = F.when(e.col["k"] == K_DATE, F.coalesce(e.col["s"], F.lit(""))) if e.kind == "term" else F.when(_has(e, "dateTime", "date") & e.col.isNotNull(), F.lit(""))
        if name == "TZ":
            return E(tz, "str", True)
        sec = (F.substring(tz, 2, 2).try_cast("double") * 3600 + F.substring(tz, 5, 2).try_cast("double") * 60) * F.when(tz.startswith("-"), -1.0).otherwise(1.0)
        return E(F.when(tz == "Z", F.lit(0.0)).when(tz != "", sec), "dur", True)
    if name.startswith(MATH):
        return _math(name[len(MATH) :], a)
    if name.startswith(XSD):
        return cast_to(name[len(XSD) :], a[0])
    if name.startswith(GEOF):
        return geo.function(name[len(GEOF) :], a)
    if name.startswith(QL):
        local = name[len(QL) :]
        if local == "toEpoch":
            return E(F.when(_moment(a[0]).isNotNull(), F.floor(F.unix_micros(_moment(a[0]).cast("timestamp")) / 1e6).cast("bigint")), "int", True)
        if local == "prefix-match":
            return E(F.startswith(F.coalesce(literal(a[0]), text(a[0])), literal(a[1])), "bool", True)
        if local == "isGeoPoint":
            e = a[0]
            return E(F.coalesce(e.col.rlike(r"(?i)^\s*POINT"), F.lit(False)) if e.kind == "wkt" else _is(e, K_GEO) if e.kind == "term" else F.lit(False), "bool", False)
        if local == "isEncodedIri":
            return E(F.lit(a[0].kind.startswith("ref:")) & a[0].col.isNotNull(), "bool", False)
        if local in ("envelopeLowerLeft", "envelopeUpperRight", "simplifyGeometry"):
            return geo.function(local, a)
    raise SparqlError(f"unknown function <{name}>")


def _math(name: str, a: list[E]) -> E:
    x = as_double(a[0])
    if name == "log":
        return E(F.when(x > 0, F.log(x)).when(x == 0, F.lit(-math.inf)).when(x.isNotNull(), F.lit(math.nan)), "dbl", True)
    if name == "pow":
        return E(F.pow(x, as_double(a[1])), "dbl", True)
    f = {"exp": F.exp, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan}.get(name)
    if not f:
        raise SparqlError(f"unknown function math:{name}")
    return E(f(x), "dbl", True)


__all__ = ["GEOF", "MATH", "QL", "RDF", "Scope", "arith", "compare", "compile_expr", "merge"]
