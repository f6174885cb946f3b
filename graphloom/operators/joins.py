"""Joins under SPARQL compatibility: an unbound shared variable agrees with anything.

Where all shared variables are bound on both sides these are plain equi-joins.
Where some are, those are the join keys and the rest is a condition. Where none
are, each side is split by which variables are bound, so that every pair of
parts is an equi-join again; there is never a nested loop on `= OR IS NULL`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as T
from .frame import Frame, fresh_name

Condition = Callable[[Callable[[str], object]], Column]


def same(left: Frame, right: Frame, var: str) -> Column:
    """Equality of a variable of two frames, on native values if the shapes agree."""
    if left.shape(var) == right.shape(var):
        return left.col(var) == right.col(var)
    return left.key(var) == right.key(var)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def _loose(left: Frame, right: Frame, var: str) -> Column:
    return same(left, right, var) | left.col(var).isNull() | right.col(var).isNull()


def merged_value(left: Frame, right: Frame, var: str):
    """The variable in a row made of both sides."""
    from ..functions.expressions import of_shape

    if var not in left.cols:
        return right.value(var) if var in right.cols else None
    if var not in right.cols or var in left.bound:
        return left.value(var)
    if left.shape(var) == right.shape(var):
        return of_shape(F.coalesce(left.col(var), right.col(var)), left.shape(var))
    return of_shape(F.coalesce(left.key(var), right.key(var)), T.KEY)


def _output(df, left: Frame, right: Frame, bound: set[str]) -> Frame:
    columns, cols = [], {}
    for v in [*left.cols, *(v for v in right.cols if v not in left.cols)]:
        if v in left.cols and (v not in right.cols or v in left.bound):
            name, shape = left.cols[v]
            columns.append(F.col(name))
        elif v not in left.cols:
            name, shape = right.cols[v]
            columns.append(F.col(name))
        else:
            value = merged_value(left, right, v)
            name, shape = fresh_name(), left.shape(v) if left.shape(v) == right.shape(v) else T.KEY
            columns.append(value.col.alias(name))
        cols[v] = (name, shape)
    return Frame(df.select(*columns, *([] if columns else [F.lit(1).alias(fresh_name())])), cols, bound, left.size + right.size)


def _apart(left: Frame, right: Frame) -> Frame:
    taken = set(left.df.columns)
    return right.renewed() if taken & set(right.df.columns) else right


def _masks(frame: Frame, variables: list[str]) -> list[tuple[frozenset[str], Frame]]:
    """Parts of a frame by which of the variables are bound."""
    parts = []
    open_ = [v for v in variables if v not in frame.bound]
    for choice in product((True, False), repeat=len(open_)):
        on = {v for v, x in zip(open_, choice, strict=True) if x}
        condition = _all([frame.col(v).isNotNull() if v in on else frame.col(v).isNull() for v in open_])
        part = frame.where(condition) if open_ else frame
        parts.append((frozenset(on | (set(variables) & frame.bound)), replace(part, bound=frame.bound | on)))
    return parts


def union(frames: list[Frame]) -> Frame:
    """Bag union by variable name; variables that a side lacks are unbound there."""
    names: dict[str, T.Shape] = {}
    for f in frames:
        for v, (_, shape) in f.cols.items():
            names[v] = shape if names.get(v, shape) == shape else T.KEY
    out = {v: (fresh_name(), s) for v, s in names.items()}
    dfs = []
    for f in frames:
        columns = []
        for v, (name, shape) in out.items():
            if v not in f.cols:
                kind = "string" if shape.type in ("string", "computed") else shape.type
                kind = "double" if shape.type == "computed" else kind
                columns.append(F.lit(None).cast(kind).alias(name))
            else:
                columns.append((f.col(v) if f.shape(v) == shape else f.key(v)).alias(name))
        dfs.append(f.df.select(*columns) if columns else f.df.select(F.lit(1).alias("one")))
    df = reduce(lambda a, b: a.unionByName(b), dfs)
    return Frame(df, out, set.intersection(*(f.bound for f in frames)) & set(out), sum(f.size for f in frames))


def join(left: Frame, right: Frame) -> Frame:
    """Inner join; multiplicities are kept."""
    right = _apart(left, right)
    shared = [v for v in left.cols if v in right.cols]
    bound = left.bound | right.bound
    if not shared:
        return _output(left.df.crossJoin(right.df), left, right, bound)
    sure = [v for v in shared if v in left.bound and v in right.bound]
    rest = [v for v in shared if v not in sure]
    if sure:
        on = _all([same(left, right, v) for v in sure] + [_loose(left, right, v) for v in rest])
        return _output(left.df.join(right.df, on), left, right, bound)
    parts = []
    for on_left, l in _masks(left, shared):
        for on_right, r in _masks(right, shared):
            both = [v for v in shared if v in on_left and v in on_right]
            r = r.renewed()
            df = l.df.join(r.df, _all([same(l, r, v) for v in both])) if both else l.df.crossJoin(r.df)
            parts.append(_output(df, l, r, l.bound | r.bound))
    return replace(union(parts), bound=bound)


def left_join(left: Frame, right: Frame, condition: Condition | None = None) -> Frame:
    """OPTIONAL: matching rows merged, other left rows kept. The condition decides what matches, on the merged row."""
    right = _apart(left, right)
    shared = [v for v in left.cols if v in right.cols]
    sure = [v for v in shared if v in left.bound and v in right.bound]
    rest = [v for v in shared if v not in sure]

    def test(l: Frame, r: Frame) -> list[Column]:
        return [condition(lambda v: merged_value(l, r, v))] if condition else []

    if sure or not shared:
        on = _all([same(left, right, v) for v in sure] + [_loose(left, right, v) for v in rest] + test(left, right))
        return _output(left.df.join(right.df, on, "left"), left, right, set(left.bound))
    parts = []
    for on_left, l in _masks(left, shared):
        missing = l
        for on_right, r in _masks(right, shared):
            r = r.renewed()
            both = [v for v in shared if v in on_left and v in on_right]
            on = _all([same(l, r, v) for v in both] + test(l, r))
            df = l.df.join(r.df, on) if both or condition else l.df.crossJoin(r.df)
            parts.append(_output(df, l, r, set(left.bound)))
            missing = replace(missing, df=missing.df.join(r.df, on, "left_anti"))
        parts.append(missing)
    return replace(union(parts), bound=set(left.bound))


def _reduce(left: Frame, right: Frame, keep: bool, minus: bool, condition: Condition | None) -> Frame:
    """Left rows that have (keep) or lack a compatible right row. minus: it must share a bound variable."""
    right = _apart(left, right)
    shared = [v for v in left.cols if v in right.cols]
    how = "left_semi" if keep else "left_anti"

    def test(l: Frame, r: Frame) -> list[Column]:
        return [condition(lambda v: merged_value(l, r, v))] if condition else []

    sure = [v for v in shared if v in left.bound and v in right.bound]
    rest = [v for v in shared if v not in sure]
    if sure or not shared:
        if not shared and not condition:  # one row decides
            right = replace(right, df=right.df.limit(1))
        on = _all([same(left, right, v) for v in sure] + [_loose(left, right, v) for v in rest] + test(left, right))
        return replace(left, df=left.df.join(right.df, on, how))
    parts = []
    for on_left, l in _masks(left, shared):
        missing = l
        for on_right, r in _masks(right, shared):
            both = [v for v in shared if v in on_left and v in on_right]
            if minus and not both:
                continue
            r = r.renewed()
            if not both and not condition:
                r = replace(r, df=r.df.limit(1))
            on = _all([same(l, r, v) for v in both] + test(l, r))
            if keep:
                parts.append(replace(missing, df=missing.df.join(r.df, on, "left_semi")))
            missing = replace(missing, df=missing.df.join(r.df, on, "left_anti"))
        if not keep:
            parts.append(missing)
    if not parts:
        return left.where(F.lit(False))
    return replace(union(parts), bound=set(left.bound)) if len(parts) > 1 else parts[0]


def minus(left: Frame, right: Frame) -> Frame:
    """Left rows without a compatible right row that shares a bound variable."""
    if not set(left.cols) & set(right.cols):
        return left
    return _reduce(left, right, False, True, None)


def semi(left: Frame, right: Frame, keep: bool = True, condition: Condition | None = None) -> Frame:
    """EXISTS (keep) or NOT EXISTS."""
    return _reduce(left, right, keep, False, condition)


def marked(left: Frame, right: Frame, condition: Condition | None = None) -> tuple[Frame, str]:
    """left with a column that says whether a compatible right row exists: one join where all shared variables are bound."""
    name = fresh_name()
    shared = [v for v in left.cols if v in right.cols]
    if shared and condition is None and all(v in left.bound and v in right.bound for v in shared):
        hidden, other = f"__mark_{name}", _apart(left, right)
        keys = replace(other.only(shared), df=other.df.select(*(other.col(v) for v in shared)).distinct().withColumn(name, F.lit(True)))
        df = left.df.join(keys.df, _all([same(left, keys, v) for v in shared]), "left")
        return Frame(df.select(*left.df.columns, F.coalesce(F.col(name), F.lit(False)).alias(name)), {**left.cols, hidden: (name, T.BOOLEAN)}, left.bound | {hidden}, left.size), hidden
    yes, no = semi(left, right, True, condition), semi(left, right, False, condition)
    hidden = f"__mark_{name}"
    both = union([yes.with_column(hidden, F.lit(True), T.BOOLEAN, True), no.with_column(hidden, F.lit(False), T.BOOLEAN, True)])
    return replace(both, bound=left.bound | {hidden}), hidden
