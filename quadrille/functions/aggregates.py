"""Aggregates. Unlike in SQL, one value of a wrong type makes a whole group unbound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Call, Var
from .terms import K_DBL, K_INT, E, as_double, collated, literal, number, order_key, struct


def _guard(e: E, seen: Column, value: Column) -> Column:
    """NULL if any member of the group has no value."""
    return F.when(F.count(F.lit(1)) == F.count(seen), value) if e.null else value


def aggregate(call: Call, e: E | None, row: Column) -> E:
    """``e`` is the argument (None for COUNT(*)), ``row`` a struct of the visible variables."""
    name, distinct = call.name, call.distinct
    empty = F.count(F.lit(1)) == 0
    if name == "COUNT":
        if e is None:
            return E(F.count_distinct(row) if distinct else F.count(F.lit(1)), "int", False)
        if not distinct and isinstance(call.args[0], Var) and not e.null:  # what it is needn't be made
            return E(F.count(F.lit(1)), "int", False)
        return E(F.count_distinct(e.col) if distinct else F.count(e.col), "int", False)
    if name in ("SUM", "AVG", "STDEV"):
        n = number(e)
        if name == "SUM" and n.kind == "int":
            s = F.sum_distinct(n.col) if distinct else F.try_sum(n.col)
            return E(F.when(empty, F.lit(0).cast("bigint")).otherwise(_guard(n, n.col, s)), "int", True)
        if name == "SUM" and n.kind == "term":
            whole = F.count(F.lit(1)) == F.count(F.when(n.col["k"] == K_INT, 1))
            i = F.sum_distinct(n.col["i"]) if distinct else F.try_sum(n.col["i"])
            d = F.sum_distinct(as_double(n)) if distinct else F.sum(as_double(n))
            made = F.when(empty, struct(k=F.lit(K_INT), i=F.lit(0))).when(whole, struct(k=F.lit(K_INT), i=i)).when(F.count(F.lit(1)) == F.count(as_double(n)), struct(k=F.lit(K_DBL), d=d))
            return E(made, "term", True)
        x = as_double(n)
        if name == "SUM":
            s = F.sum_distinct(x) if distinct else F.sum(x)
            return E(F.when(empty, F.lit(0.0)).otherwise(_guard(n, x, s)), "dbl", True)
        if name == "AVG":
            s = F.try_divide(F.sum_distinct(x), F.count_distinct(x)) if distinct else F.avg(x)
            return E(F.when(empty, F.lit(0.0)).otherwise(_guard(n, x, s)), "dbl", True)
        if distinct:  # equal squared deviations count once, as each is taken
            return E(_guard(n, x, _stdev_distinct(F.collect_list(x), F.avg(x))), "dbl", True)
        return E(_guard(n, x, F.coalesce(F.stddev_samp(x), F.lit(0.0))), "dbl", True)
    if name in ("MIN", "MAX"):
        f = F.min if name == "MIN" else F.max
        if e.kind in ("str", "iri", "res", "wkt"):
            made = f(F.struct(collated(e.col).alias("a"), e.col.alias("b")))["b"]
            made = F.when(F.count(e.col) > 0, f(F.when(e.col.isNotNull(), F.struct(collated(e.col).alias("a"), e.col.alias("b"))))["b"]) if e.null else made
        elif e.kind == "term":
            keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order_key(e))], e.col.alias("x"))
            made = f(F.when(e.col.isNotNull(), keys))["x"]
        else:
            made = f(e.col)
        return E(_guard(e, e.col, made) if name == "MIN" else made, e.kind, True)
    if name == "SAMPLE":
        return E(F.min(e.col), e.kind, True)
    if name == "GROUP_CONCAT":
        s = literal(e)
        items = F.sort_array(F.collect_set(s) if distinct else F.collect_list(s))
        return E(_guard(E(s, "str", True), s, F.array_join(items, call.sep)), "str", True)
    raise ValueError(name)


def _stdev_distinct(items: Column, mean: Column) -> Column:
    dev = F.array_distinct(F.transform(items, lambda v: (v - mean) * (v - mean)))
    n = F.size(dev)
    total = F.aggregate(dev, F.lit(0.0), lambda a, v: a + v)
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.sqrt(total / (n - 1)))

