"""Property paths: sets of (start, end) pairs; closures by semi-naive joins.

A closure from given starts keeps the pairs found so far and extends only the newest by one
edge; the closure of all pairs doubles the length of its paths each round. Each
round is written to the shared folder, and tables that later rounds replace are deleted. Edge sets of at most `LOCAL_EDGES`
(counted, not guessed) are walked on the driver instead, since a round of joins
costs more than the whole walk; larger ones, or ones with more pairs than
`LOCAL_PAIRS`, never are.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans import algebra as A
from .frame import dropped, written

LOCAL_EDGES = 20_000
LOCAL_PAIRS = 200_000


@dataclass
class Pairs:
    """df(s, o), distinct, without nulls; one shape for both ends.

    constants: of a set of nodes, their keys, where they come from the query.
    """

    df: DataFrame
    shape: T.Shape
    constants: tuple[str, ...] = ()

    def keyed(self) -> Pairs:
        if self.shape == T.KEY:
            return self
        return Pairs(self.df.select(T.key(F.col("s"), self.shape).alias("s"), T.key(F.col("o"), self.shape).alias("o")), T.KEY)


def inverted(path: A.Path) -> A.Path:
    """The path read backwards, with inverses only at its links."""
    match path:
        case A.Link():
            return A.Inverse(path)
        case A.Inverse():
            return plain(path.path)
        case A.Sequence():
            return A.Sequence(inverted(path.right), inverted(path.left))
        case A.Either():
            return A.Either(inverted(path.left), inverted(path.right))
        case A.Repeat():
            return A.Repeat(inverted(path.path), path.kind)
        case A.Negated():
            # a part without links exists only if it is the sole one
            return A.Inverse(path)
    raise TypeError(path)


def plain(path: A.Path) -> A.Path:
    """The path with inverses only at its links."""
    match path:
        case A.Inverse():
            return inverted(path.path) if not isinstance(path.path, (A.Link, A.Negated)) else path
        case A.Sequence():
            return A.Sequence(plain(path.left), plain(path.right))
        case A.Either():
            return A.Either(plain(path.left), plain(path.right))
        case A.Repeat():
            return A.Repeat(plain(path.path), path.kind)
    return path


def has_closure(path: A.Path) -> bool:
    match path:
        case A.Repeat():
            return True
        case A.Inverse():
            return has_closure(path.path)
        case A.Sequence() | A.Either():
            return has_closure(path.left) or has_closure(path.right)
    return False


class Paths:
    """Evaluates paths over a source that gives edges(iri), edges_but(iris) and nodes()."""

    def __init__(self, source):
        self.source = source
        self.spark = source.spark

    def pairs(self, path: A.Path, seeds: Pairs | None = None) -> Pairs:
        """All pairs of a path; seeds (a set of nodes as s) limit the starts."""
        match path:
            case A.Link():
                return self._from(self.source.edges(path.iri), seeds)
            case A.Inverse():
                inner = path.path
                if isinstance(inner, A.Link):
                    return self._from(self._swap(self.source.edges(inner.iri)), seeds)
                return self._from(self._swap(self.pairs(inner)), seeds)
            case A.Negated():
                parts = []
                if path.forward or not path.backward:
                    parts.append(self.source.edges_but(path.forward))
                if path.backward:
                    parts.append(self._swap(self.source.edges_but(path.backward)))
                return self._from(self._union(parts), seeds)
            case A.Either():
                return self._union([self.pairs(path.left, seeds), self.pairs(path.right, seeds)])
            case A.Sequence():
                left = self.pairs(path.left, seeds)
                right = self.pairs(path.right, Pairs(left.df.select(F.col("o").alias("s")).distinct(), left.shape))
                return self._compose(left, right)
            case A.Repeat():
                return self._repeat(path, seeds)
        raise TypeError(path)

    def _swap(self, p: Pairs) -> Pairs:
        return Pairs(p.df.select(F.col("o").alias("s"), F.col("s").alias("o")), p.shape)

    def _same(self, *pairs: Pairs) -> list[Pairs]:
        return list(pairs) if len({p.shape for p in pairs}) == 1 else [p.keyed() for p in pairs]

    def _union(self, parts: list[Pairs]) -> Pairs:
        parts = self._same(*parts)
        df = parts[0].df
        for p in parts[1:]:
            df = df.unionByName(p.df)
        return Pairs(df.distinct() if len(parts) > 1 else df, parts[0].shape)

    def _from(self, p: Pairs, seeds: Pairs | None) -> Pairs:
        if seeds is None:
            return p
        if seeds.shape != p.shape:
            p = p.keyed()
            seeds = self.nodes_keyed(seeds)
        return Pairs(p.df.join(seeds.df, "s", "left_semi"), p.shape)

    @staticmethod
    def nodes_keyed(n: Pairs) -> Pairs:
        return n if n.shape == T.KEY else Pairs(n.df.select(T.key(F.col("s"), n.shape).alias("s")), T.KEY)

    def _compose(self, left: Pairs, right: Pairs) -> Pairs:
        left, right = self._same(left, right)
        r = right.df.select(F.col("s").alias("m"), F.col("o").alias("e"))
        return Pairs(left.df.join(r, left.df["o"] == r["m"]).select("s", F.col("e").alias("o")).distinct(), left.shape)

    def _repeat(self, path: A.Repeat, seeds: Pairs | None) -> Pairs:
        if path.kind == "?":
            inner = self.pairs(path.path, seeds)
            return self._union([inner, self._itself(seeds)])
        edges = self.pairs(path.path)
        closure = self.closure(edges, seeds)
        return closure if path.kind == "+" else self._union([closure, self._itself(seeds)])

    def _itself(self, seeds: Pairs | None) -> Pairs:
        """Paths of length zero: every node, or every start that is a node."""
        nodes = self.source.nodes()
        if seeds is None:
            return Pairs(nodes.df.select("s", F.col("s").alias("o")), nodes.shape)
        known = self.source.among_nodes(seeds if seeds.constants else self.nodes_keyed(seeds))
        return Pairs(known.df.select("s", F.col("s").alias("o")), known.shape)

    def closure(self, edges: Pairs, seeds: Pairs | None) -> Pairs:
        """Transitive closure, from the seeds if there are any."""
        if seeds is not None and seeds.shape != edges.shape:
            edges, seeds = edges.keyed(), self.nodes_keyed(seeds)
        local = self._walked(edges, seeds)
        if local is not None:
            return local
        links = written(edges.df.distinct())
        if seeds is None:
            return Pairs(self._doubled(links), edges.shape)
        step = links.select(F.col("s").alias("m"), F.col("o").alias("e"))
        found = newest = written(links.join(seeds.df.distinct(), "s", "left_semi"))
        while True:
            reached = newest.join(step, newest["o"] == step["m"]).select("s", F.col("e").alias("o")).distinct()
            newest = written(reached.join(found, ["s", "o"], "left_anti"))
            if newest.isEmpty():
                return Pairs(found, edges.shape)
            found = found.union(newest)

    def _doubled(self, found: DataFrame) -> DataFrame:
        """All pairs: a round joins the pairs found with themselves, so paths of up to 2**n edges take n rounds."""
        known = found.count()
        while True:
            ends = found.select(F.col("s").alias("m"), F.col("o").alias("e"))
            longer = found.join(ends, found["o"] == ends["m"]).select("s", F.col("e").alias("o"))
            more = written(found.union(longer).distinct())
            dropped(found)
            found, before, known = more, known, more.count()
            if known == before:
                return found

    def _walked(self, edges: Pairs, seeds: Pairs | None) -> Pairs | None:
        """The closure by breadth-first walks on the driver, or None if edges, starts or pairs are too many."""
        rows = edges.df.limit(LOCAL_EDGES + 1).collect()
        if len(rows) > LOCAL_EDGES:
            return None
        out = defaultdict(set)
        for r in rows:
            out[r[0]].add(r[1])
        starts = list(out)
        if seeds is not None:
            some = seeds.df.distinct().limit(LOCAL_EDGES + 1).collect()
            if len(some) > LOCAL_EDGES:
                return None
            starts = [r[0] for r in some]
        pairs = []
        for s in starts:
            seen, front = set(), [s]
            while front:
                front = [o for x in front for o in out.get(x, ()) if o not in seen and not seen.add(o)]
            pairs += [(s, o) for o in seen]
            if len(pairs) > LOCAL_PAIRS:
                return None
        kind = edges.df.schema["s"].dataType.simpleString()
        return Pairs(self.spark.createDataFrame(pairs, f"s {kind}, o {kind}"), edges.shape)
