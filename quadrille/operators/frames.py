"""Solution tables: a DataFrame with one column per variable, and what is known of each
variable (kind, whether it may be unbound). Joins match compatible rows: variables that
both sides bind must be equal, an unbound one matches anything.

Where a shared variable may be unbound on a side, that side is split by which of them are
bound, and each pair of parts is joined by equality on what both bind. No join condition
has an OR, so no plan falls back to a nested loop because of an unbound variable."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import E, common_kind, convert, nothing


def column_name(var: str) -> str:
    """Spark compares names without case, SPARQL with case."""
    return "v_" + re.sub(r"[^a-z0-9]", lambda m: f"_{ord(m[0]):x}_", var)


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    env: dict[str, E]  # columns are named by column_name

    @property
    def names(self) -> set[str]:
        return set(self.env)

    def scope(self) -> dict[str, E]:
        return {v: E(F.col(column_name(v)), e.kind, e.null) for v, e in self.env.items()}

    def col(self, var: str) -> Column:
        return F.col(column_name(var))

    def where(self, cond: Column) -> Frame:
        return Frame(self.df.where(cond), self.env)

    def select(self, names: list[str]) -> Frame:
        """Chosen variables, in order; one that isn't there is unbound."""
        env = {v: self.env.get(v) or nothing() for v in names}
        cols = [self.col(v) if v in self.env else nothing().col.alias(column_name(v)) for v in names]
        return Frame(self.df.select(*cols), env)

    def with_var(self, var: str, e: E) -> Frame:
        return Frame(self.df.withColumn(column_name(var), e.col), self.env | {var: E(F.col(column_name(var)), e.kind, e.null)})

    def to_kinds(self, kinds: dict[str, str]) -> Frame:
        change = {v: k for v, k in kinds.items() if v in self.env and self.env[v].kind != k}
        if not change:
            return self
        df, env = self.df, dict(self.env)
        made = {}
        for v, k in change.items():
            e = convert(E(self.col(v), env[v].kind, env[v].null), k)
            made[column_name(v)] = e.col
            env[v] = E(self.col(v), k, env[v].null)
        return Frame(df.withColumns(made), env)

    def distinct(self) -> Frame:
        return Frame(self.df.distinct(), self.env)


def frame(df: DataFrame, cols: dict[str, E]) -> Frame:
    """A frame from expressions over ``df``."""
    made = df.select(*[e.col.alias(column_name(v)) for v, e in cols.items()])
    return Frame(made, {v: E(F.col(column_name(v)), e.kind, e.null) for v, e in cols.items()})


def unify(a: Frame, b: Frame) -> tuple[Frame, Frame, list[str]]:
    shared = [v for v in a.env if v in b.env]
    kinds = {v: common_kind(a.env[v].kind, b.env[v].kind) for v in shared}
    return a.to_kinds(kinds), b.to_kinds(kinds), shared


def _parts(f: Frame, loose: list[str]) -> list[tuple[frozenset, Frame]]:
    """Rows by which of the loose variables are bound."""
    mine = [v for v in loose if f.env[v].null]
    out = []
    for mask in itertools.product((True, False), repeat=len(mine)):
        cond = F.lit(True)
        for v, bound in zip(mine, mask, strict=True):
            cond = cond & (f.col(v).isNotNull() if bound else f.col(v).isNull())
        unbound = frozenset(v for v, bound in zip(mine, mask, strict=True) if not bound)
        out.append((unbound, f.where(cond) if mine else f))
    return out


def _rename(f: Frame, shared: list[str]) -> tuple[DataFrame, dict[str, str]]:
    names = {v: column_name(v) + "_r" for v in shared}
    return f.df.withColumnsRenamed({column_name(v): n for v, n in names.items()}), names


def _paired(a: Frame, b: Frame, shared: list[str], keys: list[str], how: str, cond=None) -> DataFrame:
    """Join on ``keys``; other shared variables are coalesced. ``cond`` gets the scope of the
    joined row."""
    right, names = _rename(b, shared)
    on = F.lit(True)
    for v in keys:
        on = on & (a.df[column_name(v)] == right[names[v]])
    if cond is not None:
        env = {v: E(a.df[column_name(v)], e.kind, e.null) for v, e in a.env.items()}
        env |= {v: E(right[column_name(v)], e.kind, e.null) for v, e in b.env.items() if v not in a.env}
        for v in shared:
            if v not in keys:
                env[v] = E(F.coalesce(a.df[column_name(v)], right[names[v]]), a.env[v].kind, True)
        on = on & F.coalesce(cond(env), F.lit(False))
    if not keys and cond is None and how == "inner":
        return a.df.crossJoin(right), names
    return a.df.join(right, on, how), names


def _merged(joined: DataFrame, names: dict[str, str], a: Frame, b: Frame, keys: list[str]) -> DataFrame:
    cols = []
    for v in [*a.env, *(v for v in b.env if v not in a.env)]:
        c = F.col(column_name(v))
        if v in names and v not in keys:
            c = F.coalesce(c, F.col(names[v])).alias(column_name(v))
        cols.append(c)
    return joined.select(*cols)


def _env(a: Frame, b: Frame, how: str) -> dict[str, E]:
    env = dict(a.env)
    for v, e in b.env.items():
        if v not in env:
            env[v] = E(e.col, e.kind, e.null or how == "left")
        elif how == "inner":
            env[v] = E(e.col, env[v].kind, env[v].null and e.null)
        else:
            env[v] = E(e.col, env[v].kind, env[v].null)
    return env


def join(a: Frame, b: Frame, cond=None) -> Frame:
    """Inner join of compatible rows."""
    a, b, shared = unify(a, b)
    loose = [v for v in shared if a.env[v].null or b.env[v].null]
    out = None
    for ua, fa in _parts(a, loose):
        for ub, fb in _parts(b, loose):
            keys = [v for v in shared if v not in ua and v not in ub]
            joined, names = _paired(fa, fb, shared, keys, "inner", cond)
            made = _merged(joined, names, fa, fb, keys)
            out = made if out is None else out.unionByName(made)
    return Frame(out, _env(a, b, "inner"))


def left_join(a: Frame, b: Frame, cond=None) -> Frame:
    """OPTIONAL. ``cond`` is the filter of the optional group."""
    a, b, shared = unify(a, b)
    loose = [v for v in shared if a.env[v].null or b.env[v].null]
    if not loose:
        joined, names = _paired(a, b, shared, shared, "left", cond)
        return Frame(_merged(joined, names, a, b, shared), _env(a, b, "left"))
    out = None
    rights = _parts(b, loose)
    for ua, fa in _parts(a, loose):
        rest = fa
        for ub, fb in rights:
            keys = [v for v in shared if v not in ua and v not in ub]
            joined, names = _paired(fa, fb, shared, keys, "inner", cond)
            made = _merged(joined, names, fa, fb, keys)
            out = made if out is None else out.unionByName(made)
            rest = Frame(_paired(rest, fb, shared, keys, "left_anti", cond)[0], fa.env)
        lonely = rest.df.select(*[F.col(column_name(v)) for v in a.env], *[F.lit(None).cast(b.df.schema[column_name(v)].dataType).alias(column_name(v)) for v in b.env if v not in a.env])
        out = out.unionByName(lonely)
    return Frame(out, _env(a, b, "left"))


def minus(a: Frame, b: Frame) -> Frame:
    """Rows of ``a`` without a compatible row of ``b`` that shares a bound variable."""
    shared = [v for v in a.env if v in b.env]
    if not shared:
        return a
    a, b, shared = unify(a, b.select(shared))
    loose = [v for v in shared if a.env[v].null or b.env[v].null]
    out = None
    for ua, fa in _parts(a, loose):
        for ub, fb in _parts(b, loose):
            keys = [v for v in shared if v not in ua and v not in ub]
            if keys:
                fa = Frame(_paired(fa, fb, shared, keys, "left_anti")[0], fa.env)
        out = fa.df if out is None else out.unionByName(fa.df)
    return Frame(out, a.env)


def exists(a: Frame, b: Frame, negated: bool) -> Frame:
    """Rows of ``a`` with (or without) a compatible row of ``b``: semi and anti joins."""
    shared = [v for v in a.env if v in b.env]
    if not shared:
        one = b.df.limit(1).select(F.lit(1).alias("_e"))
        return Frame(a.df.join(one, F.lit(True), "left_anti" if negated else "left_semi"), a.env)
    a2, b2, shared = unify(a, b.select(shared))
    loose = [v for v in shared if a2.env[v].null or b2.env[v].null]
    if not loose:
        return Frame(_paired(a2, b2, shared, shared, "left_anti" if negated else "left_semi")[0], a2.env)
    flagged = flag(a, b, "_:e")
    c = flagged.col("_:e")
    env = {v: e for v, e in flagged.env.items() if v != "_:e"}
    return Frame(flagged.df.where(~c if negated else c).drop(column_name("_:e")), env)


def flag(a: Frame, b: Frame, name: str) -> Frame:
    """``a`` with a column that says whether a compatible row of ``b`` exists."""
    shared = [v for v in a.env if v in b.env]
    col = column_name(name)
    env = lambda f: f.env | {name: E(F.col(col), "bool", False)}
    if not shared:
        one = b.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(col))
        return Frame(a.df.crossJoin(one), env(a))
    a, b, shared = unify(a, b.select(shared))
    loose = [v for v in shared if a.env[v].null or b.env[v].null]
    out = None
    for ua, fa in _parts(a, loose):
        yes, rest = None, fa
        for ub, fb in _parts(b, loose):
            keys = [v for v in shared if v not in ua and v not in ub]
            hit = _paired(rest, fb, shared, keys, "left_semi", None if keys else (lambda _: F.lit(True)))[0]
            yes = hit if yes is None else yes.unionByName(hit)
            rest = Frame(_paired(rest, fb, shared, keys, "left_anti", None if keys else (lambda _: F.lit(True)))[0], fa.env)
        made = yes.withColumn(col, F.lit(True)).unionByName(rest.df.withColumn(col, F.lit(False)))
        out = made if out is None else out.unionByName(made)
    return Frame(out, env(a))


def union(frames: list[Frame]) -> Frame:
    """Bag union; variables that a part lacks are unbound in it."""
    names = list(dict.fromkeys(v for f in frames for v in f.env))
    kinds = {}
    for v in names:
        found = [f.env[v].kind for f in frames if v in f.env]
        k = found[0]
        for x in found[1:]:
            k = common_kind(k, x)
        kinds[v] = k
    out, null = None, {v: any(v not in f.env or f.env[v].null for f in frames) for v in names}
    for f in frames:
        f = f.to_kinds(kinds)
        cols = [f.col(v) if v in f.env else nothing(kinds[v]).col.alias(column_name(v)) if not kinds[v].startswith("ref:") else F.lit(None).cast("bigint").alias(column_name(v)) for v in names]
        df = f.df.select(*cols)
        out = df if out is None else out.unionByName(df)
    return Frame(out, {v: E(F.col(column_name(v)), kinds[v], null[v]) for v in names})
