"""SPARQL 1.1 query and update text to algebra, by recursive descent."""

from __future__ import annotations

import re
from typing import Any

from .algebra import AGGREGATES, RDF, XSD, Bind, BNode, Call, Exists, Filter, GraphPattern, Group, IRI, Lit, Minus, Optional_, Path, Query, Service, SubSelect, Triple, Union_, Update, Values, Var, has_aggregate, visible


class SparqlError(ValueError):
    """The text is not a valid query, or asks for what the engine refuses."""


_TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)
|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
|(?P<str>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
|(?P<var>[?$][\w\u00b7\u0300-\u036f]+)
|(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
|(?P<tagged>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*@(?=<|[A-Za-z\u00c0-\uffff][\w.\-]*:|:))
|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
|(?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
|(?P<incl>%[\w]+)
|(?P<pname>(?:[A-Za-z\u00c0-\uffff](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
|(?P<word>[A-Za-z_][\w]*)
|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;*/|^?+\-!=<>])""",
    re.X | re.S,
)
_ESC = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    def one(m):
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" and len(x) > 1 else _ESC.get(x) or _bad(x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.S)


def _bad(x):
    raise SparqlError(f"unknown escape \\{x}")


_BUILTIN = frozenset("STR LANG LANGMATCHES DATATYPE BOUND IRI URI BNODE RAND ABS CEIL FLOOR ROUND CONCAT STRLEN UCASE LCASE ENCODE_FOR_URI CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ NOW UUID STRUUID MD5 SHA1 SHA256 SHA384 SHA512 COALESCE IF STRLANG STRDT SAMETERM ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC REGEX SUBSTR REPLACE".split())
_ARITY = {"IF": (3, 3), "REGEX": (2, 3), "SUBSTR": (2, 3), "REPLACE": (3, 4), "COALESCE": (1, 99), "CONCAT": (0, 99), "RAND": (0, 0), "NOW": (0, 0), "UUID": (0, 0), "STRUUID": (0, 0), "BNODE": (0, 1)} | {n: (2, 2) for n in ("LANGMATCHES", "CONTAINS", "STRSTARTS", "STRENDS", "STRBEFORE", "STRAFTER", "STRLANG", "STRDT", "SAMETERM")}
PREFIXES = {
    "rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": XSD, "owl": "http://www.w3.org/2002/07/owl#",
    "geo": "http://www.opengis.net/ont/geosparql#", "geof": "http://www.opengis.net/def/function/geosparql/", "math": "http://www.w3.org/2005/xpath-functions/math#", "fn": "http://www.w3.org/2005/xpath-functions#", "unit": "http://qudt.org/vocab/unit/",
}


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = ""):
        self.text, self.base = text, base
        self.prefixes = PREFIXES | (prefixes or {})
        self.toks: list[tuple[str, str, int]] = []
        self.i = self.fresh = 0
        self.named: dict[str, Query] = {}
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup != "ws":
                self.toks.append((m.lastgroup, m[0], at))
            at = m.end()
        self.toks.append(("end", "", at))

    # -- tokens
    def peek(self, k: int = 0):
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def next(self):
        t = self.peek()
        self.i += 1
        return t

    def is_op(self, *ops: str) -> bool:
        return self.peek()[0] == "op" and self.peek()[1] in ops

    def take(self, op: str) -> bool:
        if self.is_op(op):
            self.i += 1
            return True
        return False

    def want(self, op: str) -> None:
        if not self.take(op):
            self.fail(f"expected {op!r}")

    def is_word(self, *words: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1].upper() in words

    def word(self, *words: str) -> str | None:
        if self.is_word(*words):
            return self.next()[1].upper()
        return None

    def want_word(self, *words: str) -> str:
        return self.word(*words) or self.fail(f"expected {' or '.join(words)}")

    def fail(self, why: str):
        kind, s, at = self.peek()
        raise SparqlError(f"{why}, found {s or 'the end'!r} at {at}")

    # -- prologue
    def prologue(self) -> None:
        while self.prologue_one():
            pass

    def prologue_one(self) -> bool:
        if self.word("PREFIX"):
            kind, s, _ = self.next()
            if kind != "pname" or not s.endswith(":"):
                self.i -= 1
                self.fail("expected a prefix")
            self.prefixes[s[:-1]] = self.iri_ref()
        elif self.word("BASE"):
            self.base = self.iri_ref()
        else:
            return False
        return True

    def iri_ref(self) -> str:
        kind, s, _ = self.next()
        if kind != "iri":
            self.i -= 1
            self.fail("expected an IRI")
        s = unescape(s[1:-1])
        if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", s):
            from urllib.parse import urljoin

            return urljoin(self.base, s)
        return s

    def iri(self) -> IRI | None:
        kind, s, _ = self.peek()
        if kind == "iri":
            return IRI(self.iri_ref())
        if kind == "pname":
            self.i += 1
            p, _, local = s.partition(":")
            if p not in self.prefixes:
                raise SparqlError(f"prefix {p!r} is not declared")
            return IRI(self.prefixes[p] + re.sub(r"\\(.)", r"\1", local))
        return None

    # -- entry points
    def query(self) -> Query:
        self.prologue()
        while self.is_word("WITH"):
            self.i += 1
            name = self.next()[1]
            self.want_word("AS")
            self.want("{")
            self.named[name] = self.select(sub=True)
            self.want("}")
        q = self.any_query()
        if self.peek()[0] != "end":
            self.fail("text after the query")
        return q

    def any_query(self) -> Query:
        if self.is_word("SELECT"):
            return self.select()
        if self.word("ASK"):
            d, n = self.datasets()
            self.word("WHERE")
            where = self.group()
            q = self.modifiers(dict(kind="ask", where=where, default_graphs=d, named_graphs=n))
            if q.limit is not None or q.offset or q.textlimit is not None:
                raise SparqlError("ASK takes no LIMIT, OFFSET or TEXTLIMIT")
            return q
        if self.word("CONSTRUCT"):
            if self.is_op("{"):
                template = self.template()
                d, n = self.datasets()
                self.word("WHERE")
                where = self.group()
            else:
                d, n = self.datasets()
                self.want_word("WHERE")
                where = self.group()
                template = tuple(p for p in where.parts if isinstance(p, Triple))
                if len(template) != len(where.parts):
                    raise SparqlError("the short form of CONSTRUCT takes triples only")
            return self.modifiers(dict(kind="construct", where=where, template=template, default_graphs=d, named_graphs=n))
        if self.word("DESCRIBE"):
            targets: list = []
            if self.take("*"):
                targets = ["*"]
            else:
                while (x := self.iri()) or self.peek()[0] == "var":
                    targets.append(x or Var(self.next()[1][1:]))
            if not targets:
                self.fail("expected something to describe")
            d, n = self.datasets()
            where = Group()
            if self.word("WHERE") or self.is_op("{"):
                where = self.group()
            return self.modifiers(dict(kind="describe", where=where, targets=tuple(targets), default_graphs=d, named_graphs=n))
        return self.fail("expected SELECT, ASK, CONSTRUCT or DESCRIBE")

    def datasets(self):
        default, named, any_ = [], [], False
        while self.word("FROM"):
            any_ = True
            (named if self.word("NAMED") else default).append(self.iri().value)
        return (tuple(default), tuple(named)) if any_ else (None, None)

    def select(self, sub: bool = False) -> Query:
        self.want_word("SELECT")
        mode = self.word("DISTINCT", "REDUCED")
        items: list = []
        star = self.take("*")
        while not star:
            if self.peek()[0] == "var":
                items.append((self.next()[1][1:], None))
            elif self.take("("):
                e = self.expr()
                self.want_word("AS")
                items.append((self.var(), e))
                self.want(")")
            else:
                break
        if not star and not items:
            self.fail("expected variables")
        d, n = (None, None) if sub else self.datasets()
        self.word("WHERE")
        where = self.group()
        q = self.modifiers(dict(kind="select", where=where, select=tuple(items), distinct=mode == "DISTINCT", reduced=mode == "REDUCED", default_graphs=d, named_graphs=n))
        self.validate(q, star)
        return q

    def validate(self, q: Query, star: bool) -> None:
        names = [n for n, _ in q.select]
        inside = visible(q.where)
        grouped = q.grouped or any(e is not None and has_aggregate(e) for _, e in q.select) or bool(q.having)
        if star and grouped:
            raise SparqlError("SELECT * does not go with GROUP BY")
        seen: set[str] = set()
        for n, e in q.select:
            if e is not None and (n in inside or n in seen):
                raise SparqlError(f"?{n} is bound already")
            if n in seen:
                raise SparqlError(f"?{n} is selected twice")
            seen.add(n)
        if grouped:
            keys, made = {n for n, _ in q.group}, set()
            for n, e in q.select:
                loose = self.loose(e, keys | made) if e is not None else ({n} - keys)
                if loose:
                    raise SparqlError(f"?{min(loose)} is neither grouped nor aggregated")
                made.add(n)
        del names

    def loose(self, e: Any, ok: set[str]) -> set[str]:
        if isinstance(e, Var):
            return {e.name} - ok
        if isinstance(e, Call) and e.name not in AGGREGATES:
            return set().union(*(self.loose(a, ok) for a in e.args)) if e.args else set()
        return set()

    def modifiers(self, kw: dict) -> Query:
        if self.word("GROUP"):
            self.want_word("BY")
            keys: list = []
            while True:
                if self.peek()[0] == "var":
                    v = self.next()[1][1:]
                    keys.append((v, Var(v)))
                elif self.take("("):
                    e = self.expr()
                    name = self.var() if self.word("AS") else self.name()
                    self.want(")")
                    keys.append((name, e))
                elif self.starts_call():
                    keys.append((self.name(), self.primary()))
                else:
                    break
            if not keys:
                self.fail("expected a group key")
            kw |= {"group": tuple(keys), "grouped": True}
        if self.word("HAVING"):
            found = []
            while self.is_op("(") or self.starts_call():
                found.append(self.primary())
            kw["having"] = tuple(found)
        if self.is_word("INTERNAL"):
            self.i += 1
            self.want_word("SORT")
            self.want_word("BY")
            found = []
            while self.peek()[0] == "var":
                found.append(self.next()[1][1:])
            kw["internal_sort"] = tuple(found)
        if self.word("ORDER"):
            self.want_word("BY")
            order: list = []
            while True:
                if d := self.word("ASC", "DESC"):
                    self.want("(")
                    order.append((self.expr(), d == "DESC"))
                    self.want(")")
                elif self.peek()[0] == "var" or self.is_op("(") or self.starts_call():
                    order.append((self.primary(), False))
                else:
                    break
            kw["order"] = tuple(order)
        while w := self.word("LIMIT", "OFFSET", "TEXTLIMIT"):
            n = int(self.next()[1])
            kw[w.lower()] = n
        if self.is_word("VALUES"):
            self.i += 1
            kw["values"] = self.values()
        return Query(**kw)

    def var(self) -> str:
        kind, s, _ = self.next()
        if kind != "var":
            self.i -= 1
            self.fail("expected a variable")
        return s[1:]

    def name(self) -> str:
        self.fresh += 1
        return f"_:g{self.fresh}"

    # -- patterns
    def group(self) -> Group:
        self.want("{")
        if self.is_word("SELECT"):
            q = self.select(sub=True)
            self.want("}")
            return Group((SubSelect(q),))
        parts: list = []
        while not self.take("}"):
            if self.word("FILTER"):
                parts.append(Filter(self.constraint()))
            elif self.word("OPTIONAL"):
                parts.append(Optional_(self.group()))
            elif self.word("MINUS"):
                parts.append(Minus(self.group()))
            elif self.word("BIND"):
                self.want("(")
                e = self.expr()
                self.want_word("AS")
                v = self.var()
                self.want(")")
                if v in visible(Group(tuple(parts))):
                    raise SparqlError(f"?{v} is bound already")
                parts.append(Bind(e, v))
            elif self.word("VALUES"):
                parts.append(self.values())
            elif self.word("GRAPH"):
                g = Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.iri()
                parts.append(GraphPattern(g, self.group()))
            elif self.word("SERVICE"):
                silent = bool(self.word("SILENT"))
                g = Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.iri()
                a = self.peek()[2]
                first = self.i
                inner = self.group()
                used = sorted({s.split(":", 1)[0] for kind, s, _ in self.toks[first : self.i] if kind == "pname"})
                prologue = f"BASE <{self.base}> " if self.base else ""
                prologue += "".join(f"PREFIX {n}: <{self.prefixes[n]}> " for n in used if n in self.prefixes)
                parts.append(Service(g, inner, silent, self.text[a : self.toks[self.i - 1][2] + 1], prologue))
            elif self.word("INCLUDE"):
                name = self.next()[1]
                if name not in self.named:
                    raise SparqlError(f"{name} is not a named subquery")
                parts.append(SubSelect(self.named[name]))
            elif self.is_op("{"):
                g = [self.group()]
                while self.word("UNION"):
                    g.append(self.group())
                parts.append(Union_(tuple(g)) if len(g) > 1 else g[0])
            elif self.take("."):
                pass
            else:
                parts += self.triples_same_subject()
                if not self.is_op("}"):
                    self.take(".")
        return Group(tuple(parts))

    def constraint(self):
        if self.is_op("(") or self.starts_call():
            return self.primary()
        return self.fail("expected a condition")

    def values(self) -> Values:
        if self.peek()[0] == "var":
            names, single = (self.var(),), True
        else:
            self.want("(")
            found = []
            while self.peek()[0] == "var":
                found.append(self.var())
            self.want(")")
            names, single = tuple(found), False
        self.want("{")
        rows: list = []
        while not self.take("}"):
            if single:
                rows.append((self.data_value(),))
            else:
                self.want("(")
                row = []
                while not self.take(")"):
                    row.append(self.data_value())
                if len(row) != len(names):
                    raise SparqlError("a row of VALUES has the wrong length")
                rows.append(tuple(row))
        return Values(names, tuple(rows))

    def data_value(self):
        if self.word("UNDEF"):
            return None
        x = self.iri() or self.literal()
        return x if x is not None else self.fail("expected a value")

    def template(self) -> tuple:
        self.want("{")
        out: list = []
        while not self.take("}"):
            if self.take("."):
                continue
            out += self.triples_same_subject()
        return tuple(out)

    def triples_same_subject(self) -> list:
        out: list = []
        if self.is_op("[", "("):
            s = self.node(out)
            if not self.is_op(".", "}"):
                self.property_list(s, out)
        else:
            s = self.term()
            if s is None:
                self.fail("expected a triple")
            self.property_list(s, out)
        return out

    def property_list(self, s, out: list) -> None:
        while True:
            tag = self.next()[1][1:-1].lower() if self.peek()[0] == "tagged" else None  # @en@iri: objects in one language
            p = Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                o = self.node(out)
                out.append(Triple(s, p, o))
                if tag is not None:
                    out.append(Filter(Call("=", (Call("LANG", (o,)), Lit(tag)))))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.is_op(".", "}", "]"):
                return

    def node(self, out: list):
        if self.take("["):
            b = self.blank()
            if not self.take("]"):
                self.property_list(b, out)
                self.want("]")
            return b
        if self.take("("):
            first = prev = None
            while not self.take(")"):
                cell = self.blank()
                if prev is None:
                    first = cell
                else:
                    out.append(Triple(prev, IRI(RDF + "rest"), cell))
                out.append(Triple(cell, IRI(RDF + "first"), self.node(out)))
                prev = cell
            if prev is None:
                return IRI(RDF + "nil")
            out.append(Triple(prev, IRI(RDF + "rest"), IRI(RDF + "nil")))
            return first
        x = self.term()
        return x if x is not None else self.fail("expected a term")

    def blank(self) -> Var:
        self.fresh += 1
        return Var(f"_:b{self.fresh}")

    def term(self):
        kind, s, _ = self.peek()
        if kind == "var":
            self.i += 1
            return Var(s[1:])
        if kind == "bnode":
            self.i += 1
            return Var(s)
        return self.iri() or self.literal()

    def literal(self) -> Lit | None:
        kind, s, _ = self.peek()
        if kind == "str":
            self.i += 1
            v = unescape(s[3:-3] if s[:3] in ('"""', "'''") else s[1:-1])
            if self.peek()[0] == "lang":
                return Lit(v, RDF + "langString", self.next()[1][1:].lower())
            if self.take("^^"):
                return Lit(v, self.iri().value)
            return Lit(v)
        sign = ""
        if kind == "op" and s in "+-" and self.peek(1)[0] == "num":
            sign = s if s == "-" else ""
            self.i += 1
            kind, s, _ = self.peek()
        if kind == "num":
            self.i += 1
            dt = "double" if "e" in s.lower() else "decimal" if "." in s else "integer"
            return Lit(sign + s, XSD + dt)
        if kind == "word" and s.lower() in ("true", "false"):
            self.i += 1
            return Lit(s.lower(), XSD + "boolean")
        return None

    # -- paths
    def path(self):
        parts = [self.path_seq()]
        while self.take("|"):
            parts.append(self.path_seq())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_seq(self):
        parts = [self.path_elt()]
        while self.take("/"):
            parts.append(self.path_elt())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_elt(self):
        if self.take("^"):
            return Path("inv", (self.path_elt(),))
        if self.take("!"):
            items = []
            if self.take("("):
                while not self.take(")"):
                    inv = self.take("^")
                    items.append((self.path_iri(), inv))
                    self.take("|")
            else:
                inv = self.take("^")
                items.append((self.path_iri(), inv))
            p: Any = Path("neg", tuple(items))
        elif self.take("("):
            p = self.path()
            self.want(")")
        else:
            p = self.path_iri()
        while self.is_op("?", "*", "+", "{"):
            op = self.next()[1]
            if op == "{":
                lo = int(self.next()[1]) if self.peek()[0] == "num" else 0
                hi: int | None = lo
                if self.take(","):
                    hi = int(self.next()[1]) if self.peek()[0] == "num" else None
                self.want("}")
                p = Path("rep", (p,), lo, hi)
            else:
                p = Path("rep", (p,), 1 if op == "+" else 0, 1 if op == "?" else None)
        return p

    def path_iri(self) -> IRI:
        if self.peek()[0] == "word" and self.peek()[1] == "a":
            self.i += 1
            return IRI(RDF + "type")
        return self.iri() or self.fail("expected a predicate")

    # -- expressions
    def expr(self):
        e = self.and_()
        while self.take("||"):
            e = Call("||", (e, self.and_()))
        return e

    def and_(self):
        e = self.rel()
        while self.take("&&"):
            e = Call("&&", (e, self.rel()))
        return e

    def rel(self):
        e = self.add()
        if self.is_op("=", "!=", "<", ">", "<=", ">="):
            op = self.next()[1]
            return Call(op, (e, self.add()))
        neg = self.is_word("NOT") and self.peek(1)[1].upper() == "IN"
        if neg:
            self.i += 1
        if self.word("IN"):
            self.want("(")
            items = []
            while not self.take(")"):
                items.append(self.expr())
                self.take(",")
            return Call("NOT IN" if neg else "IN", (e, *items))
        return e

    def add(self):
        e = self.mul()
        while self.is_op("+", "-"):
            op = self.next()[1]
            e = Call(op, (e, self.mul()))
        return e

    def mul(self):
        e = self.unary()
        while self.is_op("*", "/"):
            op = self.next()[1]
            e = Call(op, (e, self.unary()))
        return e

    def unary(self):
        if self.take("!"):
            return Call("!", (self.unary(),))
        if self.take("-"):
            return Call("neg", (self.unary(),))
        if self.take("+"):
            return self.unary()
        return self.primary()

    def starts_call(self) -> bool:
        kind, s, _ = self.peek()
        return kind in ("iri", "pname") or kind == "word" and (s.upper() in _BUILTIN or s.upper() in AGGREGATES or s.upper() in ("EXISTS", "NOT"))

    def args(self) -> tuple:
        self.want("(")
        found: list = []
        while not self.take(")"):
            found.append(self.expr())
            if not self.is_op(")"):
                self.want(",")
        return tuple(found)

    def primary(self):
        if self.take("("):
            e = self.expr()
            self.want(")")
            return e
        kind, s, _ = self.peek()
        if kind == "var":
            self.i += 1
            return Var(s[1:])
        if kind == "word":
            up = s.upper()
            if up in AGGREGATES:
                self.i += 1
                self.want("(")
                distinct = bool(self.word("DISTINCT"))
                if up == "COUNT" and self.take("*"):
                    self.want(")")
                    return Call("COUNT", (), distinct)
                e, sep = self.expr(), " "
                if self.take(";"):
                    self.want_word("SEPARATOR")
                    self.want("=")
                    sep = self.literal().value
                self.want(")")
                return Call(up, (e,), distinct, sep)
            if up == "NOT" or up == "EXISTS":
                neg = bool(self.word("NOT"))
                self.want_word("EXISTS")
                return Exists(self.group(), neg)
            if up in _BUILTIN:
                self.i += 1
                a = self.args()
                lo, hi = _ARITY.get(up, (1, 1))
                if not lo <= len(a) <= hi:
                    raise SparqlError(f"{up} takes {lo} to {hi} arguments")
                return Call(up, a)
        x = self.iri()
        if x is not None:
            if self.is_op("("):
                return Call(x.value, self.args())
            return x
        x = self.literal()
        return x if x is not None else self.fail("expected an expression")

    # -- updates
    def updates(self) -> list[Update]:
        out: list[Update] = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            out.append(self.update())
            if not self.take(";"):
                if self.peek()[0] != "end":
                    self.fail("text after the update")
                return out

    def graph_ref(self):
        if w := self.word("DEFAULT", "NAMED", "ALL"):
            return w
        self.word("GRAPH")
        return self.iri() or self.fail("expected a graph")

    def quads(self, data: bool = False) -> tuple:
        self.want("{")
        out: list = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.word("GRAPH"):
                g = Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.iri()
                out += [(g, t) for t in self.template()]
            else:
                out += [(None, t) for t in self.triples_same_subject()]
        if data and any(isinstance(x, Var) and not x.name.startswith("_:") for g, t in out for x in (g, t.s, t.p, t.o)):
            raise SparqlError("DATA takes no variables")
        return tuple(out)

    def update(self) -> Update:
        w = self.want_word("INSERT", "DELETE", "WITH", "LOAD", "CLEAR", "DROP", "CREATE", "ADD", "MOVE", "COPY")
        if w == "LOAD":
            silent = bool(self.word("SILENT"))
            src = self.iri()
            return Update("load", silent=silent, source=src.value, target=self.graph_ref() if self.word("INTO") else None)
        if w in ("CLEAR", "DROP", "CREATE"):
            silent = bool(self.word("SILENT"))
            return Update(w.lower(), silent=silent, target=self.graph_ref())
        if w in ("ADD", "MOVE", "COPY"):
            silent = bool(self.word("SILENT"))
            a = self.graph_ref()
            self.want_word("TO")
            return Update(w.lower(), silent=silent, source=a, target=self.graph_ref())
        graph = None
        if w == "WITH":
            graph = self.iri().value
            w = self.want_word("INSERT", "DELETE")
        if self.word("DATA"):
            q = self.quads(data=True)
            if w == "DELETE" and any(isinstance(x, Var) for _, t in q for x in (t.s, t.o)):
                raise SparqlError("DELETE DATA takes no blank nodes")
            return Update("insert_data" if w == "INSERT" else "delete_data", insert=q if w == "INSERT" else (), delete=q if w == "DELETE" else ())
        if w == "DELETE" and self.word("WHERE"):
            q = self.quads()
            parts = tuple(t if g is None else GraphPattern(g, Group((t,))) for g, t in q)
            return Update("modify", delete=q, where=Group(parts), graph=graph)
        delete = insert = ()
        if w == "DELETE":
            delete = self.quads()
            if self.word("INSERT"):
                insert = self.quads()
        else:
            insert = self.quads()
        using: list = []
        named: list = []
        while self.word("USING"):
            (named if self.word("NAMED") else using).append(self.iri().value)
        self.want_word("WHERE")
        any_ = bool(using or named)
        return Update("modify", delete=delete, insert=insert, where=self.group(), graph=graph, using=tuple(using) if any_ else None, using_named=tuple(named) if any_ else None)


def parse_query(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None) -> list[Update]:
    return Parser(text, prefixes).updates()


__all__ = ["BNode", "Parser", "SparqlError", "parse_query", "parse_update"]
