"""Solution sequences: a DataFrame, and which column holds which variable in what shape."""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import Value, of_shape

_numbers = itertools.count(1)


def fresh_name() -> str:
    """A column name that no other frame has: joins never meet the same name twice, and case never matters."""
    return f"c{next(_numbers)}"


@dataclass
class Frame:
    """cols: variable -> (column, shape), in order. bound: variables that no row leaves unbound."""

    df: DataFrame
    cols: dict[str, tuple[str, T.Shape]]
    bound: set[str] = field(default_factory=set)
    size: float = 1e9  # an estimate in bytes or rows, to order joins
    distinct: dict[str, float] = field(default_factory=dict)  # estimates of different values, where there are better ones than the root of size

    def values_of(self, var: str) -> float:
        return max(1.0, min(self.size, self.distinct.get(var, self.size**0.5)))

    def col(self, var: str) -> Column:
        return F.col(self.cols[var][0])

    def shape(self, var: str) -> T.Shape:
        return self.cols[var][1]

    def value(self, var: str) -> Value:
        return of_shape(self.col(var), self.shape(var))

    def key(self, var: str) -> Column:
        return T.key(self.col(var), self.shape(var))

    def where(self, condition: Column) -> Frame:
        return replace(self, df=self.df.where(condition))

    def renewed(self) -> Frame:
        """The same rows under new column names."""
        names = {v: (fresh_name(), s) for v, (_, s) in self.cols.items()}
        columns = [F.col(self.cols[v][0]).alias(n) for v, (n, _) in names.items()]
        return replace(self, df=self.df.select(*columns) if columns else self.df.select(F.lit(1).alias(fresh_name())), cols=names)

    def with_column(self, var: str, value: Column, shape: T.Shape, bound: bool) -> Frame:
        name = fresh_name()
        return replace(self, df=self.df.withColumn(name, value), cols={**self.cols, var: (name, shape)}, bound=self.bound | ({var} if bound else set()))

    def only(self, variables: list[str]) -> Frame:
        cols = {v: self.cols[v] for v in variables}
        columns = [F.col(c) for c, _ in cols.values()] or [F.lit(1).alias(fresh_name())]
        return replace(self, df=self.df.select(*columns), cols=cols, bound=self.bound & set(variables))

    def df_of(self, s: str, o: str, p: str) -> DataFrame:
        """(s, p, o) of two variables and a constant."""
        return self.df.select(self.col(s).alias("s"), F.lit(p).alias("p"), self.col(o).alias("o"))

    def keyed(self, var: str) -> Frame:
        """The variable as keys."""
        if self.shape(var) == T.KEY:
            return self
        name = fresh_name()
        others = [F.col(c) for v, (c, _) in self.cols.items() if v != var]
        return replace(self, df=self.df.select(*others, self.key(var).alias(name)), cols={**self.cols, var: (name, T.KEY)})


def unit(spark: SparkSession) -> Frame:
    """One row that binds nothing: the identity of join."""
    return Frame(spark.range(1).select(F.lit(1).alias(fresh_name())), {}, set(), 0)


def empty(spark: SparkSession, variables: list[str]) -> Frame:
    cols = {v: (fresh_name(), T.KEY) for v in variables}
    columns = [F.lit(None).cast("string").alias(c) for c, _ in cols.values()]
    return Frame(spark.range(1).select(*columns, F.lit(1).alias(fresh_name())).where(F.lit(False)), cols, set(variables), 0)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; in a local session without one, a temporary folder."""
    import atexit
    import re
    import shutil
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, path, True)
        found = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df computed once and kept as a table in the shared folder: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read again."""
    spark, path = df.sparkSession, getattr(df, "_graphloom_path", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
