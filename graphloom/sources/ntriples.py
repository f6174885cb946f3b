"""N-Triples: reading files as a distributed scan, writing them back.

The grammar is applied line by line; lines that do not match it are skipped, as
are blank lines and comments. After the three terms only a dot may follow. Blank
labels and language tags end at white space. A literal may stand anywhere.

Lines without escapes and with plain white space are taken apart by JVM expressions. The
others, few as a rule, are picked out by a scan of their own and go to a parser in Python, batch by batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

TRIPLES = "s string, p string, o string"

_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class BadLine(ValueError):
    pass


def _unescaped(text: str, single: bool) -> str:
    """Undo \\u and \\U, and, in literals, the single-character escapes."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2]
        if code:
            try:
                value = int(code, 16)
                if 0xD800 <= value <= 0xDFFF:
                    raise BadLine("surrogate")
                return chr(value)
            except (ValueError, OverflowError) as e:
                raise BadLine(str(e)) from e
        if single and m[3] in _ESCAPES:
            return _ESCAPES[m[3]]
        raise BadLine("escape")

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.?))", one, text, flags=re.S) if "\\" in text else text


_IRI = re.compile(r"<([^>]*)>")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)


def _term(line: str, at: int) -> tuple[str, int]:
    c = line[at : at + 1]
    if c == "<":
        m = _IRI.match(line, at)
        if not m:
            raise BadLine("IRI")
        return T.iri(_unescaped(m[1], False)), m.end()
    if c == "_":
        m = re.compile(r"_:(\S+)").match(line, at)
        if not m:
            raise BadLine("label")
        return T.blank(m[1]), m.end()
    m = _STRING.match(line, at)
    if not m:
        raise BadLine("term")
    text, at = _unescaped(m[1], True), m.end()
    if line[at : at + 1] == "@":
        m = re.compile(r"@(\S+)").match(line, at)
        if not m:
            raise BadLine("language")
        return T.literal(text, lang=m[1]), m.end()
    if line[at : at + 2] == "^^":
        m = _IRI.match(line, at + 2)
        if not m:
            raise BadLine("datatype")
        return T.literal(text, _unescaped(m[1], False)), m.end()
    return T.literal(text), at


def parse_line(line: str) -> tuple[str, str, str] | None:
    """The keys of a line's triple, or None if it has none."""
    line = line.strip()
    if not line or line[0] == "#":
        return None
    try:
        out, at = [], 0
        for _ in range(3):
            key, at = _term(line, at)
            out.append(key)
            while at < len(line) and line[at].isspace():
                at += 1
        return tuple(out) if line[at:] == "." else None
    except BadLine:
        return None


def parse_lines(text: str) -> list[tuple[str, str, str]]:
    return [t for t in map(parse_line, text.split("\n")) if t]


#: Lines that the JVM expressions leave to the parser: escapes, and white space that Java and Python see differently.
_ODD = r"[\\\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A term; what it takes is never given back, as in the parser.
_TERM = r'(<[^>]*+>|_:\S++|"[^"]*+"(?>@\S++|\^\^<[^>]*+>)?+)'
_LINE = rf"^\s*+{_TERM}\s*+{_TERM}\s*+{_TERM}\s*+\.\s*+$"


def _key(term: Column) -> Column:
    """The key of a term without escapes."""
    size = F.length(term)
    text = F.regexp_extract(term, '^"([^"]*)"', 1)
    rest = F.substring(term, F.length(text) + 3, size)  # nothing, @language or ^^<datatype>
    kind = F.substring(rest, F.lit(4), F.length(rest) - 4)
    plain = F.concat(F.lit("L" + T.SEP), text)
    typed = F.when(kind.isin("", T.XSD + "string"), plain).otherwise(F.concat(F.lit("D"), kind, F.lit(T.SEP), text))
    literal = F.when(rest == "", plain).when(F.startswith(rest, F.lit("@")), F.concat(F.lit("G"), F.substring(rest, F.lit(2), size), F.lit(T.SEP), text)).otherwise(typed)
    first = F.substring(term, 1, 1)
    return F.when(first == "<", F.concat(F.lit("I" + T.SEP), F.substring(term, F.lit(2), size - 2))).when(first == "_", F.concat(F.lit("B" + T.SEP), F.substring(term, F.lit(3), size))).otherwise(literal)


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [t for t in map(parse_line, b["value"]) if t]
        yield pd.DataFrame(rows, columns=["s", "p", "o"])


def read_lines(lines: DataFrame) -> DataFrame:
    """Triples (s, p, o as keys) of lines (value); not yet distinct."""
    rows = lines.select("value").where("value is not null")
    odd = F.col("value").rlike(_ODD)
    terms = rows.where(~odd & F.col("value").rlike(_LINE)).select(*(F.regexp_extract("value", _LINE, i + 1).alias(n) for i, n in enumerate("spo")))
    return terms.select(*(_key(F.col(n)).alias(n) for n in "spo")).union(rows.where(odd).mapInPandas(_exact, TRIPLES))


def read_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The distinct triples of N-Triples files."""
    return read_lines(spark.read.text(path)).distinct()


def serialised(key: Column) -> Column:
    """A term in N-Triples syntax, by JVM expressions; parsing it gives the same key."""
    kind, lex = F.substring(key, 1, 1), T.lexical(key, T.KEY)
    tag = F.substring(key, F.lit(2), F.locate(T.SEP, key) - 2)
    text = F.replace(lex, F.lit("\\"), F.lit("\\\\"))
    for raw, out in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(raw), F.lit(out))
    others = [c for c in [*range(0x20), 0x7F] if chr(c) not in "\n\r\t\b\f"]
    rare = text.rlike(r"[\x00-\x07\x0B\x0E-\x1F\x7F]")
    spelled = text
    for c in others:
        spelled = F.replace(spelled, F.lit(chr(c)), F.lit(f"\\u{c:04X}"))
    text = F.when(rare, spelled).otherwise(text)

    def iri(x: Column) -> Column:
        bad = x.rlike(r'[\x00-\x20<>"{}|^`\\]')
        out = F.replace(x, F.lit("\\"), F.lit("\\u005C"))
        for c in [*range(0x21), *map(ord, '<>"{}|^`')]:
            out = F.replace(out, F.lit(chr(c)), F.lit(f"\\u{c:04X}"))
        return F.concat(F.lit("<"), F.when(bad, out).otherwise(x), F.lit(">"))

    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    return (
        F.when(kind == "I", iri(lex))
        .when(kind == "B", F.concat(F.lit("_:"), lex))
        .when(kind == "L", quoted)
        .when(kind == "G", F.concat(quoted, F.lit("@"), tag))
        .otherwise(F.concat(quoted, F.lit("^^"), iri(tag)))
    )


def lines_of(triples: DataFrame) -> DataFrame:
    """(value): an N-Triples line for each triple."""
    return triples.select(F.concat_ws(" ", serialised(F.col("s")), serialised(F.col("p")), serialised(F.col("o")), F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    lines_of(triples).write.text(path)


def export_names(names: DataFrame, path: str, base: str = "http://example.org/") -> None:
    """Write rows of three bare names as IRIs under base."""
    cols = [F.concat(F.lit("I" + T.SEP + base), F.col(c)).alias(n) for c, n in zip(names.columns[:3], "spo", strict=True)]
    write_ntriples(names.select(*cols), path)
