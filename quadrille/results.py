"""Result formats. Small results are streamed through the driver row by row; large ones
are formatted and written by the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.terms import E, decimal_text, rdf_text, text, to_term
from .operators.frames import Frame

MEDIA = {"json": "application/sparql-results+json", "xml": "application/sparql-results+xml", "csv": "text/csv", "tsv": "text/tab-separated-values", "turtle": "text/turtle", "ntriples": "application/n-triples"}


def as_text(f: Frame, names: list[str], plain: bool = False) -> DataFrame:
    """One string column a variable: RDF syntax, or (``plain``) bare values as in CSV."""
    cols = []
    for v in names:
        e = E(f.col(v), f.env[v].kind, f.env[v].null)
        if plain:
            t = to_term(e)
            c = F.when(t["k"] == 3, decimal_text(t["d"])).when(t["k"] == 8, t["s"]).otherwise(text(E(t, "term", True))) if e.kind in ("dbl", "term", "res") else text(e)
        else:
            c = rdf_text(e)
        cols.append(c.alias(v))
    return f.df.select(*cols)


def lines(f: Frame, names: list[str], form: str) -> Iterator[str]:
    """Lines of a CSV or TSV document."""
    if form == "tsv":
        yield "\t".join("?" + n for n in names)
        for r in as_text(f, names).toLocalIterator():
            yield "\t".join("" if x is None else x for x in r)
        return
    yield ",".join(names)
    for r in as_text(f, names, plain=True).toLocalIterator():
        yield ",".join("" if x is None else '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') else x for x in r)


def write_lines(f: Frame, names: list[str], path: str, form: str = "tsv") -> None:
    """CSV or TSV files written by the executors, without a header."""
    if form == "csv":
        as_text(f, names, plain=True).write.csv(path, escape='"')
    else:
        as_text(f, names).select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names])).write.text(path)


def _binding(s: str) -> dict[str, str]:
    if s.startswith("<"):
        return {"type": "uri", "value": s[1:-1]}
    if s.startswith("_:"):
        return {"type": "bnode", "value": s[2:]}
    end = s.rindex('"')
    value = json.loads(s[: end + 1])
    rest = s[end + 1 :]
    if rest.startswith("@"):
        return {"type": "literal", "value": value, "xml:lang": rest[1:]}
    return {"type": "literal", "value": value} | ({"datatype": rest[3:-1]} if rest else {})


def to_json(f: Frame, names: list[str]) -> Iterator[str]:
    """SPARQL JSON; unbound variables are left out of their row."""
    yield json.dumps({"head": {"vars": names}})[:-1] + ', "results": {"bindings": ['
    for k, r in enumerate(as_text(f, names).toLocalIterator()):
        yield (", " if k else "") + json.dumps({n: _binding(x) for n, x in zip(names, r, strict=True) if x is not None}, ensure_ascii=False)
    yield "]}}"


def to_native(f: Frame, names: list[str], query: str, send: int | None = None) -> Iterator[str]:
    """JSON with each row as a list of terms in RDF syntax, and the number of all rows."""
    size = f.df.count()
    yield json.dumps({"query": query, "status": "OK", "selected": ["?" + n for n in names]})[:-1] + ', "res": ['
    rows = as_text(f, names) if send is None else as_text(Frame(f.df.limit(send), f.env), names)
    for k, r in enumerate(rows.toLocalIterator()):
        yield (", " if k else "") + json.dumps(list(r), ensure_ascii=False)
    yield f'], "resultSizeTotal": {size}}}'


def to_xml(f: Frame, names: list[str]) -> Iterator[str]:
    yield '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head>' + "".join(f"<variable name={quoteattr(n)}/>" for n in names) + "</head>\n<results>\n"
    for r in as_text(f, names).toLocalIterator():
        out = ""
        for n, x in zip(names, r, strict=True):
            if x is None:
                continue
            b = _binding(x)
            if b["type"] == "literal":
                attr = f" xml:lang={quoteattr(b['xml:lang'])}" if "xml:lang" in b else f" datatype={quoteattr(b['datatype'])}" if "datatype" in b else ""
                body = f"<literal{attr}>{escape(b['value'])}</literal>"
            else:
                body = f"<{b['type']}>{escape(b['value'])}</{b['type']}>"
            out += f"<binding name={quoteattr(n)}>{body}</binding>"
        yield f"<result>{out}</result>\n"
    yield "</results>\n</sparql>\n"


def triple_lines(triples: DataFrame) -> DataFrame:
    """N-Triples lines (which are Turtle as well) of s, p, o; column value."""
    node = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), F.col("s"), F.lit(">")))
    return triples.select(F.concat(node, F.lit(" <"), F.col("p"), F.lit("> "), rdf_text(E(F.col("o"), "term", False)), F.lit(" .")).alias("value"))
