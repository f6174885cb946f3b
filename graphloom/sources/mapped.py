"""Ordinary tables read as triples, without materialising any.

A mapping gives each table a subject (an IRI prefix before the values of a key
column) and each column a predicate. A triple pattern with a constant predicate
is then a scan of two columns; patterns with one subject variable whose
predicates are columns of one table collapse into a single scan, and an optional
one of them is just a nullable column. Column values keep their own types, so
filters on them reach the Parquet reader and joins compare numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import native_equal
from ..operators import joins
from ..operators.frame import Frame, empty, fresh_name
from ..operators.paths import Pairs
from ..plans import algebra as A
from .base import Source, in_order, pattern_frame


@dataclass
class Property:
    """An expression over the table's columns and the shape of its values."""

    column: str
    shape: T.Shape


@dataclass
class Table:
    df: DataFrame
    subject: Property
    properties: dict[str, Property]  # by predicate IRI
    types: tuple[str, ...] = ()  # class IRIs of every subject
    size: float = 1e9
    extra: dict = field(default_factory=dict)

    def column(self, p: Property) -> Column:
        return F.expr(p.column)

    def has(self, iri: str) -> bool:
        return iri in self.properties


class Unopened:
    """A table that is opened when a pattern may read it: predicates tell by their prefix, classes are known."""

    def __init__(self, prefix: str, types: tuple[str, ...], open_: Callable[[], Table]):
        self.prefix, self.types, self._open = prefix, types, open_

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        self.__dict__.setdefault("_table", None)
        if self.__dict__["_table"] is None:
            self.__dict__["_table"] = self._open()
        return getattr(self.__dict__["_table"], name)

    def has(self, iri: str) -> bool:
        return iri.startswith(self.prefix) and iri in self.properties


def shape_of(kind: str) -> T.Shape | None:
    """The literal shape of a column type; None if it has no RDF form."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return T.Shape("num", T.XSD + "integer", "int" if kind != "bigint" else "bigint")
    if kind in ("double", "float") or kind.startswith("decimal"):
        return T.Shape("num", T.XSD + "double", "double")
    return {"string": T.STRING, "boolean": T.BOOLEAN, "timestamp": T.TIME, "timestamp_ntz": T.TIME}.get(kind)


class Mapped(Source):
    def __init__(self, spark: SparkSession, tables: list[Table | Unopened]):
        self.spark = spark
        self.tables = tables

    # -- single patterns
    def scan(self, t: A.Triple) -> Frame:
        if isinstance(t.p, A.Const):
            iri = T.parse_key(t.p.key).value
            found = [self._property(table, iri, t) for table in self.tables if table.has(iri)]
            if iri == T.RDF + "type":
                found += [self._type(table, c, t) for table in self.tables for c in table.types]
            if not found:
                return empty(self.spark, [v for v in A.variables(A.Bgp((t,)))])
            return found[0] if len(found) == 1 else joins.union(found)
        parts = []
        for table in self.tables:
            parts += [self._property(table, iri, t, iri) for iri in table.properties]
            parts += [self._type(table, c, t, T.RDF + "type") for c in table.types]
        return joins.union(parts)

    def _property(self, table: Table, iri: str, t: A.Triple, as_predicate: str | None = None) -> Frame:
        p = table.properties[iri]
        df = table.df.select(table.column(table.subject).alias("s"), F.lit(T.iri(iri)).alias("p"), table.column(p).alias("o")).where("s is not null and o is not null")
        return pattern_frame(df, ("s", "p", "o"), (table.subject.shape, T.KEY, p.shape), t, table.size, native_equal, (table.size if table.extra.get("unique", True) else None, 1.0, None))

    def _type(self, table: Table, c: str, t: A.Triple, as_predicate: str | None = None) -> Frame:
        df = table.df.select(table.column(table.subject).alias("s"), F.lit(T.iri(T.RDF + "type")).alias("p"), F.lit(T.iri(c)).alias("o")).where("s is not null")
        if not table.extra.get("unique", True):
            df = df.distinct()
        return pattern_frame(df, ("s", "p", "o"), (table.subject.shape, T.KEY, T.KEY), t, table.size, native_equal)

    # -- stars
    def _table_of(self, t: A.Triple) -> Table | None:
        """The one table whose column a pattern reads."""
        if not isinstance(t.p, A.Const):
            return None
        iri = T.parse_key(t.p.key).value
        found = [table for table in self.tables if table.has(iri)]
        return found[0] if len(found) == 1 and iri != T.RDF + "type" else None

    def bgp(self, triples: tuple[A.Triple, ...], optional: tuple[A.Triple, ...] = ()) -> Frame | None:
        stars: dict[tuple, list[A.Triple]] = {}
        rest: list[A.Triple] = []
        for t in dict.fromkeys(triples):
            table = self._table_of(t)
            if table is None:
                rest.append(t)
            else:
                stars.setdefault((t.s, id(table)), []).append(t)
        extra: dict[tuple, list[A.Triple]] = {}
        known = set(A.variables(A.Bgp(triples)))
        for t in optional:
            table = self._table_of(t)
            key = (t.s, id(table))
            if table is None or key not in stars or not isinstance(t.o, A.Var) or t.o.name in known or not table.extra.get("unique", True):
                return None
            known.add(t.o.name)
            extra.setdefault(key, []).append(t)
        units = [self._star(next(x for x in self.tables if id(x) == at), s, group, extra.get((s, at), [])) for (s, at), group in stars.items()]
        # the class of a subject that a star already scans costs nothing
        for t in rest:
            whole = [table for table in self.tables if isinstance(t.o, A.Const) and T.parse_key(t.o.key).value in table.types]
            is_type = isinstance(t.p, A.Const) and t.p.key == T.iri(T.RDF + "type")
            if is_type and len(whole) == 1 and (t.s, id(whole[0])) in stars:
                continue
            units.append(self.scan(t))
        return reduce(joins.join, in_order(units))

    def _star(self, table: Table, s: A.Node, group: list[A.Triple], optional: list[A.Triple]) -> Frame:
        """One scan for all patterns about one subject."""
        conditions: list[Column] = []
        columns: dict[str, Column] = {}
        shapes: dict[str, T.Shape] = {}
        size = table.size

        def meet(node: A.Node, column: Column, shape: T.Shape) -> None:
            nonlocal size
            if isinstance(node, A.Const):
                conditions.append(native_equal(column, shape, node.key))
                size /= 50
            elif node.name in columns:
                other, its = columns[node.name], shapes[node.name]
                conditions.append(column == other if its == shape else T.key(column, shape) == T.key(other, its))
            else:
                conditions.append(column.isNotNull())
                columns[node.name], shapes[node.name] = column, shape

        meet(s, table.column(table.subject), table.subject.shape)
        for t in group:
            p = table.properties[T.parse_key(t.p.key).value]
            meet(t.o, table.column(p), p.shape)
        bound = set(columns)
        for t in optional:
            p = table.properties[T.parse_key(t.p.key).value]
            columns[t.o.name], shapes[t.o.name] = table.column(p), p.shape
        names = {v: fresh_name() for v in columns}
        df = table.df.where(reduce(lambda a, b: a & b, conditions))
        df = df.select(*(c.alias(names[v]) for v, c in columns.items())) if columns else df.select(F.lit(1).alias(fresh_name()))
        if not table.extra.get("unique", True):  # triples are a set
            df = df.distinct()
        one = {s.name: table.size} if isinstance(s, A.Var) and table.extra.get("unique", True) else {}
        return Frame(df, {v: (names[v], shapes[v]) for v in columns}, bound, size, one)

    def among_nodes(self, keys: Pairs) -> Pairs:
        return super().among_nodes(keys)


def auto_table(df: DataFrame, name: str, key: str, base: str, foreign: dict[str, str] | None = None, unique: bool = True, subject: Property | None = None, skip: tuple[str, ...] = ()) -> Table:
    """The direct mapping of a table: subjects <base>name/key, predicates <base>name#column, class <base>name.

    foreign: column -> table whose subjects its values name. Columns without an RDF form are left out.
    """
    kinds = dict(df.dtypes)
    subject = subject or Property(f"`{key}`", T.Shape("iri", f"{base}{name}/", kinds[key] if kinds[key] in ("int", "bigint") else "string"))
    properties = {}
    for c, kind in df.dtypes:
        if c in skip:
            continue
        if foreign and c in foreign:
            # foreign keys are compared with keys of their own width
            properties[f"{base}{name}#{c}"] = Property(f"cast(`{c}` as bigint)", T.Shape("iri", f"{base}{foreign[c]}/", "bigint"))
            continue
        shape = shape_of(kind)
        if shape is not None:
            properties[f"{base}{name}#{c}"] = Property(f"`{c}`" if kind not in ("float", "smallint", "tinyint") and not kind.startswith("decimal") else f"cast(`{c}` as {'double' if kind == 'float' or kind.startswith('decimal') else 'int'})", shape)
    if subject.shape.form == "iri" and subject.shape.type == "int":
        subject = Property(f"cast({subject.column} as bigint)", T.Shape("iri", subject.shape.extra, "bigint"))
    size = float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return Table(df, subject, properties, (f"{base}{name}",), size, {"unique": unique})
