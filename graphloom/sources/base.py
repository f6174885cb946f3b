"""What the compiler asks of a source of triples."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import joins
from ..operators.frame import Frame, fresh_name
from ..operators.paths import Pairs
from ..plans import algebra as A
from ..plans.inference import DOMAIN, RANGE, SUBCLASS, SUBPROPERTY, Schema

#: Statements about properties, and classes above theirs, that are closed on the driver.
SCHEMA_ROWS = 10_000


def _after(left: Frame, right: Frame) -> Frame:
    """What is known of a join without making it: its variables, an estimate of its size, different values."""
    size = max(1.0, left.size) * max(1.0, right.size)
    shared = set(left.cols) & set(right.cols)
    for v in shared:
        size /= max(left.values_of(v), right.values_of(v))
    values = {v: min(f.values_of(v) for f in (left, right) if v in f.cols) for v in {*left.cols, *right.cols}}
    return Frame(left.df, {**right.cols, **left.cols}, set(), size, values)


def in_order(units: list[Frame]) -> list[Frame]:
    """The order of joins whose intermediate results are smallest together, by estimate: greedy from each start.

    A join on a variable that is unique on one side keeps the size of the other; one on a variable with few values
    multiplies. So a cycle is closed by its last condition instead of by a product. Cross products come last.
    """
    best: tuple[float, list[Frame]] | None = None
    for first in sorted(units, key=lambda u: u.size):
        out, now, cost = [first], first, first.size
        left = [u for u in units if u is not first]
        while left and (best is None or cost < best[0]):
            near = [u for u in left if set(u.cols) & set(now.cols) or not u.cols]
            steps = [(_after(now, u), u) for u in near or left]
            if not near:
                cost += 1e18
            now, pick = min(steps, key=lambda x: x[0].size)
            cost += now.size
            out.append(pick)
            left = [u for u in left if u is not pick]
        if not left and (best is None or cost < best[0]):
            best = cost, out
    return best[1] if best else []


def pattern_frame(df, names: tuple[str, str, str], shapes: tuple[T.Shape, ...], t: A.Triple, size: float, equal, values: tuple[float | None, ...] = (None, None, None)) -> Frame:
    """Rows of df, whose columns names hold subject, predicate and object, that match a triple pattern.

    values: estimates of how many different subjects, predicates and objects there are.
    """
    conditions: list[Column] = []
    cols: dict[str, tuple[str, T.Shape]] = {}
    columns: list[Column] = []
    at: dict[str, int] = {}
    for i, n in enumerate((t.s, t.p, t.o)):
        if isinstance(n, A.Const):
            conditions.append(equal(F.col(names[i]), shapes[i], n.key))
            size /= values[i] or (50 if i != 1 else 5)
        elif n.name in at:
            j = at[n.name]
            conditions.append(F.col(names[i]) == F.col(names[j]) if shapes[i] == shapes[j] else T.key(F.col(names[i]), shapes[i]) == T.key(F.col(names[j]), shapes[j]))
        else:
            at[n.name] = i
            name = fresh_name()
            cols[n.name] = (name, shapes[i])
            columns.append(F.col(names[i]).alias(name))
    if conditions:
        df = df.where(reduce(lambda a, b: a & b, conditions))
    known = {v: values[i] for v, i in at.items() if values[i]}
    return Frame(df.select(*columns) if columns else df.select(F.lit(1).alias(fresh_name())), cols, set(cols), size, known)


class Source:
    """scan gives the rows of one triple pattern; the rest follows from it."""

    spark: SparkSession

    def scan(self, t: A.Triple) -> Frame:
        raise NotImplementedError

    def bgp(self, triples: tuple[A.Triple, ...], optional: tuple[A.Triple, ...] = ()) -> Frame | None:
        """Join of triple patterns; with optional patterns None, if the source has no better way than a left join."""
        if optional:
            return None
        return reduce(joins.join, in_order([self.scan(t) for t in triples]))

    def edges(self, iri: str) -> Pairs:
        f = self.scan(A.Triple(A.Var("s"), A.Const(T.iri(iri)), A.Var("o")))
        return self._pairs(f)

    def edges_but(self, iris: tuple[str, ...]) -> Pairs:
        f = self.scan(A.Triple(A.Var("s"), A.Var("p"), A.Var("o")))
        if iris:
            f = f.where(~f.key("p").isin(*(T.iri(i) for i in iris)))
        return self._pairs(f)

    def _pairs(self, f: Frame) -> Pairs:
        if f.shape("s") != f.shape("o"):
            f = f.keyed("s").keyed("o")
        return Pairs(f.df.select(f.col("s").alias("s"), f.col("o").alias("o")).distinct(), f.shape("s"))

    def nodes(self) -> Pairs:
        """All subjects and objects, as keys."""
        f = self.scan(A.Triple(A.Var("s"), A.Var("p"), A.Var("o")))
        f = f.keyed("s").keyed("o")
        both = f.df.select(f.col("s").alias("s")).union(f.df.select(f.col("o").alias("s")))
        return Pairs(both.distinct(), T.KEY)

    def schema(self) -> Schema | None:
        """The statements about properties, closed; None if they are more than `SCHEMA_ROWS`. Looked up once, as sources never change."""
        if "_schema" not in self.__dict__:
            self._schema = self._read_schema()
        return self._schema

    def _read_schema(self) -> Schema | None:
        s, o = A.Var("s"), A.Var("o")
        kinds = [self.scan(A.Triple(s, A.Const(T.iri(k)), o)).keyed("s").keyed("o").df_of("s", "o", T.iri(k)) for k in (SUBPROPERTY, DOMAIN, RANGE)]
        rows = reduce(lambda a, b: a.union(b), kinds).limit(SCHEMA_ROWS + 1).collect()
        above: dict[str, set[str]] = {}
        known = {r["o"] for r in rows if r["p"] != T.iri(SUBPROPERTY)}
        if len(rows) > SCHEMA_ROWS or len(known) > SCHEMA_ROWS // 10:
            return None
        # the classes above those of domains and ranges, a level a job
        front, steps = sorted(known), {}
        while front:
            f = self.scan(A.Triple(s, A.Const(T.iri(SUBCLASS)), o)).keyed("s").keyed("o").df_of("s", "o", T.iri(SUBCLASS))
            found = f.where(F.col("s").isin(front)).limit(SCHEMA_ROWS + 1).collect()
            if len(found) + len(known) > SCHEMA_ROWS:
                return None
            for r in found:
                steps.setdefault(r["s"], set()).add(r["o"])
            front = sorted({r["o"] for r in found} - known)
            known |= set(front)
        for c in known:
            seen, rest = set(), [c]
            while rest:
                rest = [y for x in rest for y in steps.get(x, ()) if y not in seen and not seen.add(y)]
            above[c] = seen
        return Schema.of([(r["s"], r["p"], r["o"]) for r in rows], lambda _: above)

    def among_nodes(self, keys: Pairs) -> Pairs:
        """Those of the keys that are nodes; constants are looked up by themselves."""
        if keys.constants:
            found = []
            for k in keys.constants:
                s, p, o = A.Var("s"), A.Var("p"), A.Var("o")
                for t in (A.Triple(A.Const(k), p, o), A.Triple(s, p, A.Const(k))):
                    found.append(self.scan(t).df.select(F.lit(k).alias("s")).limit(1))
            return Pairs(reduce(lambda a, b: a.union(b), found).distinct(), T.KEY)
        return Pairs(keys.df.join(self.nodes().df, "s", "left_semi").distinct(), T.KEY)


__all__ = ["Source", "in_order", "pattern_frame", "replace"]
