"""What a graph source offers to the compiler."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import E, common_kind, compare_const, convert, to_term
from ..operators.frames import Frame, column_name, frame, join
from ..plans.algebra import Triple, Var


class Source:
    """A set of quads. ``graphs`` is None (all graphs, as one set) or a list of graph names;
    ``graph_var`` asks for the graph of every triple."""

    spark: SparkSession

    def star(self, subject: Any, triples: list[Triple], graphs: list[str] | None, graph_var: str | None) -> list[Frame]:
        """Frames whose join answers triples of one subject with constant predicates."""
        raise NotImplementedError

    def any_predicate(self, graphs: list[str] | None, graph_var: str | None) -> tuple[DataFrame, dict[str, E]]:
        """All triples: a frame with s, p, o (and g), and their expressions."""
        raise NotImplementedError

    def has_predicate(self, graphs: list[str] | None) -> tuple[DataFrame, dict[str, E]]:
        """Distinct (s, p)."""
        df, cols = self.any_predicate(graphs, None)
        return df.select(cols["s"].col.alias("s"), cols["p"].col.alias("p")).distinct(), {"s": E(F.col("s"), cols["s"].kind, False), "p": E(F.col("p"), cols["p"].kind, False)}

    def subject_counts(self, graphs: list[str] | None) -> DataFrame | None:
        """Predicates and the numbers of their distinct subjects (columns p, n), if the source
        counts them without making triples."""
        return None

    def nodes(self, graphs: list[str] | None) -> DataFrame:
        """Distinct subjects and objects (column a, as terms)."""
        df, c = self.any_predicate(graphs, None)
        return df.select(F.explode(F.array(to_term(c["s"]), to_term(c["o"]))).alias("a")).distinct()

    def scan(self, t: Triple, graphs: list[str] | None, graph_var: str | None) -> Frame:
        """One triple pattern with a variable predicate."""
        df, cols = self.any_predicate(graphs, graph_var)
        return match(df, [(t.s, cols["s"]), (t.p, cols["p"]), (t.o, cols["o"])] + ([(Var(graph_var), cols["g"])] if graph_var else []))


def match(df: DataFrame, pairs: list[tuple[Any, E]]) -> Frame:
    """Rows of ``df`` in which expressions fit terms of a pattern: constants are compared,
    a variable that stands twice must be equal in both places."""
    out: dict[str, E] = {}
    for term, e in pairs:
        if e.null:
            df = df.where(e.col.isNotNull())
        e = E(e.col, e.kind, False)
        if not isinstance(term, Var):
            df = df.where(compare_const(e, term))
        elif term.name in out:
            kind = common_kind(out[term.name].kind, e.kind)
            df = df.where(convert(out[term.name], kind).col == convert(e, kind).col)
        else:
            out[term.name] = e
    return frame(df, out)


def join_all(frames: list[Frame]) -> Frame:
    """Joins frames in an order in which each shares a variable with those before, if any does."""
    left, out = frames[1:], frames[0]
    while left:
        k = next((i for i, f in enumerate(left) if f.names & out.names), 0)
        out = join(out, left.pop(k))
    return out


__all__ = ["Source", "column_name", "join_all", "match"]
