"""Results as SPARQL-JSON, as newline-delimited JSON, and as typed DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators.frame import Frame


def binding(key: Column) -> Column:
    """A term as the struct of SPARQL-JSON; fields that do not apply are null."""
    kind = F.substring(key, 1, 1)
    tag = F.substring(key, F.lit(2), F.locate(T.SEP, key) - 2)
    named = F.struct(
        F.when(kind == "I", "uri").when(kind == "B", "bnode").otherwise("literal").alias("type"),
        T.lexical(key, T.KEY).alias("value"),
        F.when(kind == "D", tag).alias("datatype"),
        F.when(kind == "G", tag).alias("xml:lang"),
    )
    return F.when(key.isNotNull(), named)


def json_rows(frame: Frame, names: list[str], nulls: bool) -> DataFrame:
    """(value): each row as a JSON object; nulls: unbound variables as null, else left out."""
    if not names:
        return frame.df.select(F.lit("{}").alias("value"))
    # names may differ in case only, which struct fields may not rely on: objects are put together as text
    parts = []
    for n in names:
        text = F.to_json(binding(frame.key(n)))
        label = json.dumps(n, ensure_ascii=False) + ":"
        parts.append(F.concat(F.lit(label), F.coalesce(text, F.lit("null")) if nulls else text))
    kept = F.array(*parts) if nulls else F.array_compact(F.array(*parts))
    return frame.df.select(F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}")).alias("value"))


def sparql_json(frame: Frame, names: list[str]) -> str:
    """The whole result as one document, collected."""
    rows = [r[0] for r in json_rows(frame, names, False).collect()]
    head = json.dumps({"vars": names}, ensure_ascii=False)
    return f'{{"head":{head},"results":{{"bindings":[{",".join(rows)}]}}}}'


def ndjson(frame: Frame, names: list[str]) -> Iterator[str]:
    """A header line, then a line for each row, fetched partition by partition."""
    yield json.dumps({"head": {"vars": names}}, ensure_ascii=False, separators=(",", ":"))
    for r in json_rows(frame, names, True).toLocalIterator(prefetchPartitions=True):
        yield r[0]


def write_ndjson(frame: Frame, names: list[str], path: str) -> None:
    """The rows as files, written by the executors."""
    json_rows(frame, names, True).write.text(path)


_KIND = {"string": "string", "iri": "string", "double": "double", "long": "bigint", "int": "int", "boolean": "boolean", "timestamp": "timestamp"}


def typed(frame: Frame, names: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Columns named as the variables.

    types: variable -> string | double | long | int | boolean | timestamp (of the value), local (IRI without its
    prefix, as long), key. By default native columns keep their type, IRIs are strings, keys lexical forms.
    """
    out = []
    for n in names:
        want = (types or {}).get(n)
        shape, column = frame.shape(n), frame.col(n)
        if want == "key":
            value = frame.key(n)
        elif want == "local":
            value = column if shape.form == "iri" and shape.type != "string" else F.regexp_extract(T.lexical(column, shape), r"([^/#]*)$", 1).try_cast("bigint")
        elif want is None:
            value = column if shape.form in ("num", "bool", "time", "str") else T.lexical(column, shape)
        elif want in ("string", "iri"):
            value = T.lexical(column, shape)
        elif shape.form in ("num", "bool", "time"):
            value = column.cast(_KIND[want])
        else:
            text = T.lexical(column, shape)
            value = F.when(text.isin("true", "1"), True).when(text.isNotNull(), False) if want == "boolean" else text.try_cast("double").try_cast(_KIND[want]) if want in ("long", "int") else text.try_cast(_KIND[want])
        out.append(value.alias(n))
    return frame.df.select(*out)
