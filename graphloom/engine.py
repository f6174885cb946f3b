"""The engine: SPARQL text over a source of triples."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

from pyspark.sql import DataFrame

from .operators.compiler import Compiler, Unsupported, reject_cap
from .operators.frame import Frame
from .plans import algebra as A
from .plans.inference import rewrite
from .plans.parser import parse_query
from .sources import results
from .sources.base import Source


@dataclass
class Result:
    """form: SELECT or ASK. Nothing runs until rows are asked for."""

    form: str
    vars: list[str]
    frame: Frame

    def df(self, types: dict[str, str] | None = None) -> DataFrame:
        """Typed columns; ASK gives one row (boolean)."""
        if self.form == "ASK":
            from pyspark.sql import functions as F

            return self.frame.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("boolean"))
        return results.typed(self.frame, self.vars, types)

    def ask(self) -> bool:
        return not self.frame.df.isEmpty()

    def count(self) -> int:
        return self.frame.df.count()

    def json(self) -> str:
        """SPARQL 1.1 JSON results."""
        if self.form == "ASK":
            return '{"head":{},"boolean":%s}' % str(self.ask()).lower()
        return results.sparql_json(self.frame, self.vars)

    def count_json(self) -> str:
        return '{"boolean":%s}' % str(self.ask()).lower() if self.form == "ASK" else '{"count":%d}' % self.count()

    def ndjson(self) -> Iterator[str]:
        if self.form == "ASK":
            return iter([self.json()])
        return results.ndjson(self.frame, self.vars)

    def rows(self) -> list[dict[str, str]]:
        """Bound variables of each row as keys; for tests and small results."""
        from pyspark.sql import functions as F

        names = self.vars
        got = self.frame.df.select(*(self.frame.key(n).alias(f"k{i}") for i, n in enumerate(names)), F.lit(1)).collect()
        return [{n: r[i] for i, n in enumerate(names) if r[i] is not None} for r in got]


class Engine:
    """cap: an optional limit on the rows of a result, beyond which there is an error; cache: finished JSON texts to keep."""

    def __init__(self, source: Source, cap: int | None = None, cache: int = 0):
        self.source = source
        self.cap = cap
        self._cache: dict[tuple, str] = {}
        self._room = cache

    def query(self, text: str, infer: str | None = None) -> Result:
        return self.run(parse_query(text), infer)

    def run(self, query: A.Query, infer: str | None = None) -> Result:
        select = query.select
        if infer == "rdfs":
            select = rewrite(select, self.source)
        frame = reject_cap(Compiler(self.source).select(select), self.cap)
        return Result(query.form, list(frame.cols), frame)

    def match(self, triples: list[A.Triple]) -> Frame:
        """A basic graph pattern without SPARQL text."""
        return self.source.bgp(tuple(triples))

    def select(self, text: str, types: dict[str, str] | None = None, infer: str | None = None) -> DataFrame:
        return self.query(text, infer).df(types)

    def json(self, text: str, infer: str | None = None) -> str:
        """The JSON of a query, remembered up to `cache` queries; sources never change, so nothing gets stale."""
        at = (infer == "rdfs", text)
        if at not in self._cache:
            out = self.query(text, infer).json()
            if self._room:
                if len(self._cache) >= self._room:
                    self._cache.pop(next(iter(self._cache)))
                self._cache[at] = out
            return out
        return self._cache[at]

    def profile(self, text: str, runs: int = 3, infer: str | None = None) -> dict[str, float]:
        """Median seconds to parse, to plan, and to run and write a query."""
        parse, plan, run = [], [], []
        for _ in range(runs):
            t0 = time.perf_counter()
            q = parse_query(text)
            t1 = time.perf_counter()
            r = self.run(q, infer)
            t2 = time.perf_counter()
            r.json()
            parse.append(t1 - t0), plan.append(t2 - t1), run.append(time.perf_counter() - t2)
        return {"parse": median(parse), "plan": median(plan), "run": median(run)}


__all__ = ["Engine", "Result", "Unsupported"]
