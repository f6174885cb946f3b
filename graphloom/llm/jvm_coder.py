"""The range coder of `range_coder.py` as Spark functions of a block, compiled by the compiler that Spark brings along.

A block is coded without any other, so one block at a time does as well as many in lockstep; the JVM takes a
small part of numpy's time for it. The bytes are the same (tested), so either can read what the other wrote.
"""

from __future__ import annotations

import tempfile
import zipfile
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_CLASS = "graphloom.RangeCoder"
_jars: dict[str, str] = {}  # by application


def _jar(spark: SparkSession) -> str:
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(resources.files(__package__).joinpath("RangeCoder.java").read_text(encoding="utf-8"))
    path = Path(tempfile.mkdtemp(prefix="graphloom-code-")).resolve() / "graphloom-coder.jar"
    with zipfile.ZipFile(path, "w") as z:
        for name, code in compiler.getBytecodes().items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    return str(path)


def _registered(spark: SparkSession) -> None:
    """Both functions in this session, their class on the driver and, served by it, on every executor."""
    names = {f"graphloom_{name}".lower(): name for name in ("Encode", "Decode")}
    if all(map(spark.catalog.functionExists, names)):
        return
    app = spark.sparkContext.applicationId
    if app not in _jars:
        _jars[app] = _jar(spark)
    spark.sql(f"ADD JAR '{_jars[app]}'")
    loader = spark._jsparkSession.sharedState().jarClassLoader()
    kind = spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType
    for name, of in names.items():
        spark._jsparkSession.udf().register(name, loader.loadClass(f"{_CLASS}${of}").newInstance(), kind)


def encoded(spark: SparkSession, ids: str) -> Column:
    """Coded bytes of a block, from its ids as little-endian unsigned 16-bit integers."""
    _registered(spark)
    return F.call_udf("graphloom_encode", F.col(ids))


def decoded(spark: SparkSession, coded: str, n_ids: str) -> Column:
    """The ids of a block, given how many it has. Whatever a damaged block gives, there is no error here."""
    _registered(spark)
    return F.call_udf("graphloom_decode", F.col(coded), F.col(n_ids))
