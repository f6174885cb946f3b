"""A synthetic graph: filler edges by hash, planted triangles and chains.

Every row is an expression over its number and the seed, so any number of tasks
make the same graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from .graph import Graph

BASE = "http://example.org/"


def _entity(n: Column) -> Column:
    return F.concat(F.lit(f"I{T.SEP}{BASE}entity_"), n.cast("string"))


def _predicate(n: Column | int) -> Column:
    return F.concat(F.lit(f"I{T.SEP}{BASE}predicate_"), (F.lit(n) if isinstance(n, int) else n).cast("string"))


def synthetic(spark: SparkSession, entities: int = 50_000, predicates: int = 100, triples: int = 1_000_000, triangles: int = 1_000, chains: int = 2_000, seed: int = 42) -> Graph:
    """Triangles lie on predicate_0, chains on predicate_0, predicate_1, predicate_2."""

    def draw(what: str, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(below))

    def edges(n: int, what: str, steps: list[tuple[str, str, Column]]) -> DataFrame:
        rows = spark.range(n)
        return reduce(DataFrame.union, [rows.select(_entity(draw(what + a, entities)).alias("s"), p.alias("p"), _entity(draw(what + b, entities)).alias("o")) for a, b, p in steps])

    filler = edges(triples, "filler", [("s", "o", _predicate(draw("p", predicates)))])
    triangle = edges(triangles, "triangle", [(a, b, _predicate(0)) for a, b in (("0", "1"), ("1", "2"), ("2", "0"))])
    chain = edges(chains, "chain", [("0", "1", _predicate(0)), ("1", "2", _predicate(1)), ("2", "3", _predicate(2))])
    return Graph.of_frame(filler.union(triangle).union(chain))
