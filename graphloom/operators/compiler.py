"""Compiles algebra to frames, over any source of triples.

One lazy plan comes out for everything but closures; Catalyst does pushdown,
pruning, folding and the choice of joins. What is ours: scopes, which variables are
surely bound, the order of patterns, EXISTS as semi and anti joins.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import Compiler as Expressions
from ..functions.expressions import Unsupported, Value, of_shape
from ..plans import algebra as A
from . import joins
from .frame import Frame, empty, fresh_name, unit, written
from .paths import Pairs, Paths, has_closure, inverted, plain


class Compiler:
    def __init__(self, source):
        self.source = source
        self.spark = source.spark
        self.paths = Paths(source)
        self._closures: dict = {}
        self._kept: list = []  # frames that closures are known by

    # -- patterns
    def pattern(self, p: A.Pattern, seed: Frame | None = None) -> Frame:
        """seed: outer rows whose variables filters inside may read (EXISTS)."""
        match p:
            case A.Bgp():
                return self.source.bgp(p.triples) if p.triples else unit(self.spark)
            case A.PathPattern():
                return self.path(p)
            case A.Join():
                return self.join(p, seed)
            case A.LeftJoin():
                return self.left_join(p, seed)
            case A.Union():
                return joins.union([self.pattern(p.left, seed), self.pattern(p.right, seed)])
            case A.Minus():
                return joins.minus(self.pattern(p.left, seed), self.pattern(p.right))
            case A.Filter():
                return self.filter(self._seeded(self.pattern(p.pattern, seed), seed, A.expr_variables(p.condition)), p.condition)
            case A.Extend():
                return self.extend(self._seeded(self.pattern(p.pattern, seed), seed, A.expr_variables(p.expr)), p.var, p.expr)
            case A.Group():
                return self.group(p)
            case A.Values():
                return self.values(p)
            case A.Select():
                return self.select(p)
        raise Unsupported(f"unsupported pattern {type(p).__name__}")

    def join(self, p: A.Join, seed: Frame | None) -> Frame:
        """A path with a closure beside another pattern starts at the nodes which that pattern gives."""
        for path, other in ((p.right, p.left), (p.left, p.right)):
            if isinstance(path, A.PathPattern) and not (isinstance(other, A.PathPattern) and path is p.left) and has_closure(path.path):
                frame = self.pattern(other, seed)
                beside = None
                if isinstance(path.s, A.Var) and isinstance(path.o, A.Var) and path.s != path.o:
                    beside = next(((frame, node.name, back) for node, back in ((path.s, False), (path.o, True)) if node.name in frame.bound), None)
                pairs = self.path(path, beside)
                return joins.join(pairs, frame) if path is p.left else joins.join(frame, pairs)
        return joins.join(self.pattern(p.left, seed), self.pattern(p.right, seed))

    def _seeded(self, frame: Frame, seed: Frame | None, names: set[str]) -> Frame:
        wanted = [v for v in (seed.cols if seed is not None else ()) if v in names and v not in frame.cols]
        if not wanted:
            return frame
        outer = seed.only(wanted).renewed()
        return joins.join(frame, replace(outer, df=outer.df.distinct()))

    def left_join(self, p: A.LeftJoin, seed: Frame | None) -> Frame:
        if p.condition is None and seed is None:
            # an optional property of a subject that the left side already scans is just a nullable column
            extra, left = [], p
            while isinstance(left, A.LeftJoin) and left.condition is None and isinstance(left.right, A.Bgp) and len(left.right.triples) == 1:
                extra.append(left.right.triples[0])
                left = left.left
            if isinstance(left, A.Bgp) and left.triples:
                frame = self.source.bgp(left.triples, tuple(reversed(extra)))
                if frame is not None:
                    return frame
        left, right = self.pattern(p.left, seed), self.pattern(p.right, seed)
        condition = None
        if p.condition is not None:
            if A.has_exists(p.condition):
                return self.left_join_exists(left, right, p.condition)

            def condition(scope):
                return Expressions(scope).ebv(p.condition)

        return joins.left_join(left, right, condition)

    def left_join_exists(self, left: Frame, right: Frame, condition: A.Expr) -> Frame:
        """OPTIONAL whose filter holds EXISTS: rows are numbered, so that those without a match can be told."""
        numbered = left.with_column("__row", F.monotonically_increasing_id(), T.INTEGER, True)
        numbered = replace(numbered, df=written(numbered.df))
        matched = self.filter(joins.join(numbered, right), condition)
        seen = matched.df.select(matched.col("__row").alias("__seen")).distinct()
        alone = replace(numbered, df=numbered.df.join(seen, numbered.col("__row") == F.col("__seen"), "left_anti"))
        both = joins.union([matched, alone])
        return replace(both.only([v for v in both.cols if v != "__row"]), bound=set(left.bound))

    # -- expressions
    def filter(self, frame: Frame, condition: A.Expr) -> Frame:
        for c in A.conjuncts(condition):
            inner, negated = c, False
            while isinstance(inner, A.Not):
                inner, negated = inner.arg, not negated
            if isinstance(inner, A.Exists):
                right, test = self.exists_right(frame, inner.pattern)
                frame = joins.semi(frame, right, inner.negated == negated, test)
            else:
                marks, column = self.expression(frame, c)
                frame = marks.where(column.ebv())
        return self._unmarked(frame)

    def exists_right(self, outer: Frame, p: A.Pattern):
        """The inside of EXISTS, and what of its outermost filter must wait for the outer row."""
        self._allowed(p)
        test = None
        if isinstance(p, A.Filter):
            here = set(A.variables(p.pattern))
            late = [c for c in A.conjuncts(p.condition) if not A.has_exists(c) and (A.expr_variables(c) - here) & set(outer.cols)]
            early = [c for c in A.conjuncts(p.condition) if c not in late]
            p = A.Filter(reduce(A.And, early), p.pattern) if early else p.pattern
            if late:
                whole = reduce(A.And, late)

                def test(scope):
                    return Expressions(scope).ebv(whole)

        needs = A.free_variables(p) & set(outer.cols)
        return self.pattern(p, outer if needs else None), test

    def _allowed(self, p: A.Pattern) -> None:
        match p:
            case A.Bgp() | A.PathPattern():
                return
            case A.Filter():
                return self._allowed(p.pattern)
            case A.Join() | A.Union() | A.LeftJoin():
                self._allowed(p.left)
                return self._allowed(p.right)
        raise Unsupported(f"{type(p).__name__} inside EXISTS is not supported")

    def expression(self, frame: Frame, e: A.Expr) -> tuple[Frame, Value]:
        """The frame (with a mark for each EXISTS in e) and the value over it."""
        state = {"frame": frame}

        def exists(x: A.Exists) -> Column:
            right, test = self.exists_right(state["frame"], x.pattern)
            state["frame"], name = joins.marked(state["frame"], right, test)
            return name

        marks: dict[A.Exists, str] = {}

        def collect(x) -> None:
            match x:
                case A.Exists():
                    marks.setdefault(x, exists(x))
                case A.Or() | A.And() | A.Compare() | A.Arith():
                    collect(x.left), collect(x.right)
                case A.Not() | A.Sign():
                    collect(x.arg)
                case A.In():
                    [collect(y) for y in (x.arg, *x.items)]
                case A.Call():
                    [collect(y) for y in x.args]

        collect(e)
        now = state["frame"]
        scope = lambda v: now.value(v) if v in now.cols else None
        return now, Expressions(scope, lambda x: now.col(marks[x])).value(e)

    def _unmarked(self, frame: Frame) -> Frame:
        return replace(frame, cols={v: c for v, c in frame.cols.items() if not v.startswith("__mark_")})

    def extend(self, frame: Frame, var: str, e: A.Expr) -> Frame:
        if isinstance(e, A.VarExpr) and e.name in frame.cols:
            return replace(frame, cols={**frame.cols, var: frame.cols[e.name]}, bound=frame.bound | ({var} & {var if e.name in frame.bound else ""}))
        frame, value = self.expression(frame, e)
        if value.shape is not None and value.constant is None:
            column, shape = value.col, value.shape
        elif value.cls == "num" and value.constant is None:
            column, shape = value.col, T.DOUBLE
        elif value.cls == "bool" and value.constant is None:
            column, shape = value.col, T.BOOLEAN
        elif value.cls == "str":
            column, shape = value.col, T.STRING
        else:
            column, shape = (F.lit(e.key) if isinstance(e, A.Const) else value.key()), T.KEY
        return self._unmarked(frame.with_column(var, column, shape, isinstance(e, A.Const)))

    # -- grouping
    def group(self, p: A.Group) -> Frame:
        frame = self.pattern(p.pattern)
        for k in p.keys:
            if k not in frame.cols:
                raise Unsupported(f"GROUP BY variable ?{k} is not in scope")
        aggregates = []
        for name, agg in p.aggregates:
            if agg.arg is not None and A.has_exists(agg.arg):
                hidden = f"__arg_{fresh_name()}"
                frame, agg = self.extend(frame, hidden, agg.arg), replace(agg, arg=A.VarExpr(hidden))
            aggregates.append((name, agg))
        outs, cols, bound = [], {}, set(p.keys) & frame.bound
        columns = [frame.cols[k][0] for k in dict.fromkeys(p.keys)]
        for k in p.keys:
            cols[k] = frame.cols[k]
        shapes = {}
        for name, agg in aggregates:
            column, shape, sure = self.aggregate(frame, agg, bool(p.keys))
            alias = fresh_name()
            outs.append(column.alias(alias))
            shapes[name] = (alias, shape)
            if sure:
                bound.add(name)
        if not outs:
            outs = [F.count(F.lit(1)).alias(fresh_name())]
        df = frame.df.groupBy(*columns).agg(*outs) if columns else frame.df.agg(*outs)
        return Frame(df, {**cols, **shapes}, bound, frame.size / 10)

    def aggregate(self, frame: Frame, agg: A.Aggregate, keyed: bool) -> tuple[Column, T.Shape, bool]:
        """(column, shape, is bound in every group)."""
        if agg.name == "COUNT":
            if agg.arg is None:
                visible = [frame.col(v) for v in frame.cols if not v.startswith("__")]
                c = F.count_distinct(F.struct(*visible, F.lit(1))) if agg.distinct else F.count(F.lit(1))
            else:
                v = self._argument(frame, agg)
                c = F.lit(0).cast("bigint") if v is None else F.count_distinct(frame.col(v)) if agg.distinct else F.count(frame.col(v))
            return c, T.INTEGER, True
        if agg.name in ("SUM", "AVG"):
            scope = lambda v: frame.value(v) if v in frame.cols else None
            value = Expressions(scope).value(agg.arg)
            x = value.number()
            total = {"SUM": F.sum_distinct if agg.distinct else F.sum, "AVG": (lambda c: F.sum_distinct(c) / F.count_distinct(c)) if agg.distinct else F.avg}[agg.name](x)
            simple = value.cls in ("num", "bool")
            if simple and keyed and isinstance(agg.arg, A.VarExpr) and agg.arg.name in frame.bound:
                return total, T.DOUBLE, True
            zero = F.lit(T.literal("0", T.XSD + "integer"))
            result = F.when(F.count(x) == 0, zero).otherwise(T.key(total, T.DOUBLE))
            if not simple:  # a bound value that is no number spoils the group
                result = F.when(F.count_if(value.key().isNotNull() & x.isNull()) == 0, result)
            return result, T.KEY, simple
        v = self._argument(frame, agg)
        if agg.name == "GROUP_CONCAT":
            if v is None:
                return F.lit(""), T.STRING, True
            key = frame.key(v)
            gathered = F.collect_set(key) if agg.distinct else F.collect_list(key)
            texts = F.transform(F.sort_array(gathered), lambda k: T.lexical(k, T.KEY))
            return F.array_join(texts, agg.separator), T.STRING, True
        if v is None:
            return F.max(F.lit(None).cast("string")), T.KEY, False
        shape, column = frame.shape(v), frame.col(v)
        sure = keyed and v in frame.bound
        if agg.name == "SAMPLE":
            return F.min(column), shape, sure
        f = F.min if agg.name == "MIN" else F.max
        if shape.form in ("str", "time", "bool") or shape.form == "num" and shape.type != "computed" or shape.form == "iri" and shape.type == "string":
            return f(column), shape, sure
        by = F.min_by if agg.name == "MIN" else F.max_by
        rank = F.when(column.isNotNull(), F.struct(*self.sort_columns(frame.value(v)), frame.key(v)))
        return by(column, rank), shape, sure

    def _argument(self, frame: Frame, agg: A.Aggregate) -> str | None:
        return agg.arg.name if agg.arg.name in frame.cols else None

    @staticmethod
    def sort_columns(v: Value) -> list[Column]:
        """Columns that sort as ORDER BY does: unbound, blank, number or boolean, IRI, other literals."""
        if v.cls == "num":
            return [v.col]
        if v.cls == "bool":
            return [v.col]
        if v.cls == "typed" and v.shape is not None:
            return [v.col]
        if v.cls in ("str", "lang", "typed", "blank") or v.cls == "iri" and (v.shape is None or v.shape.type == "string"):
            return [v.text() if v.shape is None else v.col]
        if v.cls == "iri":
            return [v.text()]
        code = v.code()
        rank = F.when(code.isNull(), 0).when(code == "B", 1).when(code.isin("N", "O"), 2).when(code == "I", 3).otherwise(4)
        return [rank, F.coalesce(v.number(), F.lit(0.0)), F.when(rank == 2, "").otherwise(F.coalesce(v.lex(), F.lit("")))]

    # -- inline data
    def values(self, p: A.Values) -> Frame:
        cols = {v: (fresh_name(), T.KEY) for v in p.vars}
        schema = ", ".join(f"{c} string" for c, _ in cols.values())
        if not p.vars:
            base = self.spark.range(len(p.rows)).select(F.lit(1).alias(fresh_name()))
            return Frame(base, {}, set(), 0)
        df = self.spark.createDataFrame(list(p.rows), schema)
        bound = {v for i, v in enumerate(p.vars) if all(r[i] is not None for r in p.rows)}
        return Frame(df, cols, bound, 0)

    # -- paths
    def path(self, p: A.PathPattern, beside: tuple[Frame, str, bool] | None = None) -> Frame:
        """beside: (frame, variable, whether it is the end): rows whose values of a variable are the only starts wanted."""
        path, s, o = plain(p.path), p.s, p.o
        if isinstance(s, A.Var) and isinstance(o, A.Const) or beside and beside[2]:
            path, s, o = plain(inverted(path)), o, s
        seeds = None
        if isinstance(s, A.Const):
            seeds = Pairs(self.spark.createDataFrame([(s.key,)], "s string"), T.KEY, (s.key,))
        elif beside:
            frame, name, _ = beside
            seeds = Pairs(frame.df.select(frame.col(name).alias("s")).distinct(), frame.shape(name))
        memo = (path, s if isinstance(s, A.Const) else None, id(beside[0]) if beside else None)
        if memo not in self._closures:
            self._closures[memo] = self.paths.pairs(path, seeds)
            self._kept.append(beside)
        pairs = self._closures[memo]
        df, shape = pairs.df, pairs.shape
        if isinstance(s, A.Const) and isinstance(o, A.Const):
            found = df.where((T.key(F.col("s"), shape) == F.lit(s.key)) & (T.key(F.col("o"), shape) == F.lit(o.key))).limit(1)
            return Frame(found.select(F.lit(1).alias(fresh_name())), {}, set(), 0)
        if isinstance(s, A.Const):
            name = fresh_name()
            out = df.where(T.key(F.col("s"), shape) == F.lit(s.key)).select(F.col("o").alias(name)).distinct()
            return Frame(out, {o.name: (name, shape)}, {o.name}, 1e6)
        if s == o:
            name = fresh_name()
            return Frame(df.where("s = o").select(F.col("s").alias(name)).distinct(), {s.name: (name, shape)}, {s.name}, 1e6)
        a, b = fresh_name(), fresh_name()
        first, second = (s.name, o.name)
        out = df.select(F.col("s").alias(a), F.col("o").alias(b)).distinct()
        return Frame(out, {first: (a, shape), second: (b, shape)}, {first, second}, 1e7)

    # -- SELECT and its modifiers
    def select(self, p: A.Select) -> Frame:
        frame = self.pattern(p.pattern)
        names = list(p.vars) if p.vars is not None else [v for v in frame.cols if not v.startswith("__")]
        for n in names:
            if n not in frame.cols:
                raise Unsupported(f"SELECT variable ?{n} does not appear in pattern")
        names = list(dict.fromkeys(names))
        order: list[Column] = []
        if p.order:
            keys = []
            for e, down in p.order:
                frame, value = self.expression(frame, e)
                keys += [(c, down) for c in self.sort_columns(value)]
            hidden = [(f"__sort_{i}", down) for i, (_, down) in enumerate(keys)]
            aliases = [fresh_name() for _ in keys]
            frame = replace(frame, df=frame.df.select("*", *(c.alias(a) for (c, _), a in zip(keys, aliases, strict=True))))
            order = [F.col(a).desc() if down else F.col(a).asc() for a, (_, down) in zip(aliases, hidden, strict=True)]
        columns = list(dict.fromkeys(frame.cols[n][0] for n in names))
        df = frame.df
        if p.distinct:
            if not p.order:
                df = df.select(*columns).distinct() if columns else df.limit(1)
            else:  # a row stands where it first occurs
                firsts = [(F.max if down else F.min)(a).alias(a) for a, (_, down) in zip(aliases, hidden, strict=True)]
                df = df.groupBy(*columns).agg(*firsts) if columns else df.agg(*firsts)
        if order:
            df = df.orderBy(*order, *(F.col(c) for c in columns))  # ties by what is shown, so that limits are repeatable
        if p.offset:
            df = df.offset(p.offset)
        if p.limit is not None:
            df = df.limit(p.limit)
        out = replace(frame, df=df).only(names)
        return replace(out, bound=out.bound & set(names))


def reject_cap(frame: Frame, cap: int | None) -> Frame:
    """With a row cap, an error instead of a result that is longer."""
    if cap is not None and frame.df.limit(cap + 1).count() > cap:
        raise Unsupported(f"result exceeds {cap} rows")
    return frame


__all__ = ["Compiler", "Unsupported", "empty", "of_shape", "reject_cap"]
