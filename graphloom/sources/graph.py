"""A graph as a DataFrame of triples: loading, changing, versions on disk.

On disk a graph is a directory of versions: each a Parquet table of triples
bucketed into directories by a hash of the predicate (a pattern with a bound
predicate reads one of them), small tables of changes on top, and a pointer file
that names what is current and is replaced atomically.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators.frame import Frame
from ..plans import algebra as A
from ..plans.parser import parse_update
from . import ntriples, turtle
from .base import Source, pattern_frame

PARTITIONS = 64


def predicate_bucket(p: Column) -> Column:
    return F.pmod(F.xxhash64(p), F.lit(PARTITIONS)).cast("int")


class Graph(Source):
    """An immutable set of triples; changes give new graphs."""

    def __init__(self, spark: SparkSession, triples: DataFrame, counts: dict[str, int] | None = None):
        self.spark = spark
        self.triples = triples
        #: Triples of each predicate, if known: to put selective patterns first.
        self.counts = counts or {}

    # -- making one
    @classmethod
    def of(cls, spark: SparkSession, triples: list[tuple[str, str, str]]) -> Graph:
        """From keys."""
        return cls(spark, spark.createDataFrame(sorted(set(triples)), ntriples.TRIPLES))

    @classmethod
    def of_names(cls, spark: SparkSession, triples: list[tuple[str, str, str]], base: str = "") -> Graph:
        """From bare strings, all of them IRIs."""
        return cls.of(spark, [tuple(T.iri(base + x) for x in t) for t in triples])

    @classmethod
    def load(cls, spark: SparkSession, path: str | list[str]) -> Graph:
        """From files: .ttl as Turtle, others as N-Triples."""
        paths = [path] if isinstance(path, str) else list(path)
        parts = []
        ttl = [p for p in paths if p.lower().endswith(".ttl")]
        nt = [p for p in paths if p not in ttl]
        if ttl:
            parts.append(turtle.read_turtle(spark, ttl))
        if nt:
            parts.append(ntriples.read_ntriples(spark, nt))
        df = parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()
        return cls(spark, df)

    @classmethod
    def of_frame(cls, triples: DataFrame) -> Graph:
        """From any DataFrame of keys (s, p, o)."""
        return cls(triples.sparkSession, triples.select("s", "p", "o").distinct())

    def counted(self) -> Graph:
        """With statistics: one aggregation over the graph."""
        rows = self.triples.groupBy("p").count().orderBy(F.desc("count")).limit(10_000).collect()
        return Graph(self.spark, self.triples, {r["p"]: r["count"] for r in rows})

    # -- reading
    def scan(self, t: A.Triple) -> Frame:
        df, size = self.triples, float(sum(self.counts.values()) or 1e9)
        if isinstance(t.p, A.Const):
            if "pb" in df.columns:
                df = df.where(F.col("pb") == predicate_bucket(F.lit(t.p.key)))
            if self.counts:
                size = 5.0 * self.counts.get(t.p.key, 0 if len(self.counts) < 10_000 else 1)  # a bound predicate divides it by 5
        # a subject has few triples of a predicate
        subjects = max(1.0, size / 10) if isinstance(t.p, A.Const) else None
        return pattern_frame(df, ("s", "p", "o"), (T.KEY,) * 3, t, size, lambda c, _, k: c == F.lit(k), (subjects, 5.0, None))

    def query(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Triples that match the keys given."""
        conditions = [F.col(c) == F.lit(k) for c, k in (("s", s), ("p", p), ("o", o)) if k is not None]
        df = self.triples.select("s", "p", "o")
        for c in conditions:
            df = df.where(c)
        return df

    def objects_of(self, s: str, p: str) -> DataFrame:
        return self.query(s=s, p=p).select("o")

    def subjects_of(self, p: str, o: str) -> DataFrame:
        return self.query(p=p, o=o).select("s")

    def subjects_with_predicate(self, p: str) -> DataFrame:
        return self.query(p=p).select("s").distinct()

    def objects_with_predicate(self, p: str) -> DataFrame:
        return self.query(p=p).select("o").distinct()

    def po_pairs_of(self, s: str) -> DataFrame:
        return self.query(s=s).select("p", "o")

    def sp_pairs_of(self, o: str) -> DataFrame:
        return self.query(o=o).select("s", "p")

    def distinct_subjects(self) -> DataFrame:
        return self.triples.select("s").distinct()

    def distinct_objects(self) -> DataFrame:
        return self.triples.select("o").distinct()

    def has_predicate(self, p: str) -> bool:
        return not self.query(p=p).isEmpty()

    def intersect_objects(self, s1: str, p1: str, s2: str, p2: str) -> DataFrame:
        """Objects that both (s1, p1) and (s2, p2) have."""
        return self.objects_of(s1, p1).join(self.objects_of(s2, p2), "o", "left_semi")

    def join_chain(self, p1: str, p2: str, end: str) -> DataFrame:
        """(x, y) with x p1 y and y p2 end."""
        first = self.query(p=p1).select(F.col("s").alias("x"), F.col("o").alias("y"))
        return first.join(self.subjects_of(p2, end).withColumnRenamed("s", "y"), "y").select("x", "y")

    def count(self) -> int:
        return self.triples.count()

    # -- changing
    def insert(self, triples: list[tuple[str, str, str]]) -> Graph:
        # the few new triples take the place of equal ones; the graph is not made distinct again
        new = self.spark.createDataFrame(sorted(set(triples)), ntriples.TRIPLES)
        old = self.triples.select("s", "p", "o").join(new, ["s", "p", "o"], "left_anti")
        return Graph(self.spark, old.union(new), self.counts)

    def delete(self, triples: list[tuple[str, str, str]]) -> Graph:
        gone = self.spark.createDataFrame(triples, ntriples.TRIPLES)
        return Graph(self.spark, self.triples.select("s", "p", "o").join(gone, ["s", "p", "o"], "left_anti"), self.counts)

    def append(self, other: Graph) -> Graph:
        return Graph(self.spark, self.triples.select("s", "p", "o").union(other.triples.select("s", "p", "o")).distinct())

    def apply(self, changes: list[A.Change]) -> Graph:
        """Changes in the order of the request."""
        out = self
        for c in changes:
            if c.triples:
                out = (out.insert if c.insert else out.delete)(list(c.triples))
        return out

    def update(self, text: str) -> Graph:
        """INSERT DATA and DELETE DATA; nothing is changed if any part of the request is wrong."""
        return self.apply(parse_update(text))

    # -- writing
    def dump(self, path: str) -> None:
        """As N-Triples files."""
        ntriples.write_ntriples(self.triples.select("s", "p", "o"), path)

    def save(self, path: str) -> None:
        write_table(self.triples, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark, spark.read.parquet(path))


def write_table(triples: DataFrame, path: str) -> None:
    """Triples as Parquet, in directories by predicate hash, sorted so that row groups can be skipped.

    A predicate with a large share of all triples is spread over tasks by subject.
    """
    spread = F.pmod(F.xxhash64("s"), F.lit(8))
    df = triples.select("s", "p", "o", predicate_bucket(F.col("p")).alias("pb"))
    df.repartition("pb", spread).sortWithinPartitions("pb", "p", "s").write.partitionBy("pb").parquet(path)


@dataclass(frozen=True)
class Version:
    number: int
    base: str
    changes: tuple[tuple[str, bool], ...] = ()  # (table, is insert), in order
    before: tuple[str, ...] = ()  # tables of the version that the last fold replaced


class Store:
    """A graph in a directory, with durable updates.

    An update is one small table and a new pointer; it is durable when the pointer
    is. checkpoint() folds the changes into a new base. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, graph: Graph, path: str) -> Store:
        """Write a graph as a new store; a store that is there gets a new version that replaces its contents."""
        store = cls(graph.spark, path)
        base = f"base-{uuid.uuid4().hex}"
        write_table(graph.triples, f"{store.path}/{base}")
        store._count(base)
        store._point(Version(store.version().number + 1 if store.exists() else 1, base))
        return store

    def exists(self) -> bool:
        return self._fs.exists(self._fs_path(f"{self.path}/CURRENT"))

    def version(self) -> Version:
        raw = self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0]
        d = json.loads(raw)
        return Version(d["number"], d["base"], tuple((n, i) for n, i in d["changes"]), tuple(d.get("before", ())))

    def _point(self, v: Version) -> None:
        tmp, final = self._fs_path(f"{self.path}/.CURRENT-{uuid.uuid4().hex}"), self._fs_path(f"{self.path}/CURRENT")
        out = self._fs.create(tmp, True)
        out.write(json.dumps({"number": v.number, "base": v.base, "changes": v.changes, "before": v.before, "at": time.time()}).encode())
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        context.rename(tmp, final, options)

    def _count(self, base: str) -> None:
        """Keep the triples of each predicate of a base, for the order of joins."""
        counts = Graph(self.spark, self.spark.read.parquet(f"{self.path}/{base}")).counted().counts
        out = self._fs.create(self._fs_path(f"{self.path}/{base}.counts"), True)
        out.write(json.dumps(counts).encode())
        out.close()

    def _counts(self, v: Version) -> dict[str, int]:
        """Those of the base; a few changes make no difference, but predicates that only changes have are not in it."""
        if v.changes or not self._fs.exists(self._fs_path(f"{self.path}/{v.base}.counts")):
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/{v.base}.counts", wholetext=True).first()[0])

    def graph(self) -> Graph:
        v = self.version()
        df = self.spark.read.parquet(f"{self.path}/{v.base}")
        if not v.changes:
            return Graph(self.spark, df, self._counts(v))
        # of each changed triple only the last change counts; changes are few, the base is only filtered by them
        parts = [self.spark.read.schema(ntriples.TRIPLES).parquet(f"{self.path}/{name}").select("s", "p", "o", F.lit(i).alias("n"), F.lit(insert).alias("insert")) for i, (name, insert) in enumerate(v.changes)]
        changes = parts[0]
        for part in parts[1:]:
            changes = changes.union(part)
        last = changes.groupBy("s", "p", "o").agg(F.max_by("insert", "n").alias("insert"))
        kept = df.select("s", "p", "o", "pb").join(last.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select("s", "p", "o", "pb")
        return Graph(self.spark, kept.union(last.where("insert").select("s", "p", "o", predicate_bucket(F.col("p")).alias("pb"))), self._counts(v))

    def update(self, text: str) -> int:
        """Apply INSERT DATA and DELETE DATA durably; returns the new version's number."""
        changes = [c for c in parse_update(text) if c.triples]
        v = self.version()
        names = []
        for c in changes:
            name = f"change-{uuid.uuid4().hex}"
            self.spark.createDataFrame(list(c.triples), ntriples.TRIPLES).coalesce(1).write.parquet(f"{self.path}/{name}")
            names.append((name, c.insert))
        v = replace(v, number=v.number + 1, changes=(*v.changes, *names))
        self._point(v)
        return v.number

    def append(self, triples: DataFrame) -> int:
        """Add the triples of a DataFrame of keys as one change."""
        name = f"change-{uuid.uuid4().hex}"
        triples.select("s", "p", "o").write.parquet(f"{self.path}/{name}")
        v = self.version()
        v = replace(v, number=v.number + 1, changes=(*v.changes, (name, True)))
        self._point(v)
        return v.number

    def checkpoint(self) -> int:
        """Fold the changes into a new base; returns the number of triples. The tables of the version before stay for its readers until the next fold."""
        old = self.version()
        base = f"base-{uuid.uuid4().hex}"
        write_table(self.graph().triples, f"{self.path}/{base}")
        self._count(base)
        self._point(Version(old.number + 1, base, (), (old.base, *(n for n, _ in old.changes))))
        for name in old.before:
            for path in (name, f"{name}.counts"):
                self._fs.delete(self._fs_path(f"{self.path}/{path}"), True)
        return self.spark.read.parquet(f"{self.path}/{base}").count()
