"""RDF terms as Spark values.

The general form of a term is a *key*: one string that holds all of it, so that
two terms are the same exactly if their keys are equal. A letter gives the kind,
U+0001 ends the datatype or language, the rest is the lexical form:

    I<sep>iri   B<sep>label   L<sep>plain string   G<lang><sep>text   D<datatype><sep>lexical

Columns of ordinary tables need not be turned into keys to be queried. A *shape*
says how a column's native values stand for terms; columns of equal shapes are
joined and grouped as they are, others through their keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"

# The datatypes whose values are numbers.
NUMERIC = tuple(
    XSD + n
    for n in (
        "integer", "decimal", "double", "float", "int", "long", "short", "byte",
        "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger",
        "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte",
    )
)

#: What counts as a number: Spark's cast accepts more (`1d`, blanks, hex floats).
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)(inf|infinity|nan))$"


def iri(value: str) -> str:
    return f"I{SEP}{value}"


def blank(label: str) -> str:
    return f"B{SEP}{label}"


def literal(lexical: str, datatype: str | None = None, lang: str | None = None) -> str:
    if lang:
        return f"G{lang}{SEP}{lexical}"
    if datatype and datatype != XSD + "string":
        return f"D{datatype}{SEP}{lexical}"
    return f"L{SEP}{lexical}"


@dataclass(frozen=True)
class Term:
    """A key taken apart."""

    kind: str
    value: str
    datatype: str | None = None
    lang: str | None = None


def parse_key(key: str) -> Term:
    head, _, value = key.partition(SEP)
    kind, extra = head[0], head[1:]
    if kind == "I":
        return Term("iri", value)
    if kind == "B":
        return Term("blank", value)
    return Term("literal", value, extra if kind == "D" else None, extra if kind == "G" else None)


@dataclass(frozen=True)
class Shape:
    """How a column holds terms.

    form: key | iri (prefix + value) | str | num (value of a numeric datatype) |
    bool | time (timestamp without zone, as xsd:dateTime) | lang.
    extra: prefix of the IRIs, datatype of the numbers, or the language tag.
    Equal shapes mean equal values stand for the same terms.
    """

    form: str
    extra: str = ""
    type: str = "string"


KEY = Shape("key")
STRING = Shape("str")
BOOLEAN = Shape("bool", type="boolean")
DOUBLE = Shape("num", XSD + "double", "computed")
INTEGER = Shape("num", XSD + "integer", "bigint")
TIME = Shape("time", XSD + "dateTime", "timestamp")


def format_number(x: Column) -> Column:
    """Lexical form of a computed double: integral values without a fraction, others in the shortest positional notation."""
    whole = (x == F.floor(x)) & (F.abs(x) < float(2**63))
    size = F.abs(x)
    plain = x.cast("string")
    # Spark writes digits and exponent outside 1e-3 .. 1e7; the digits are kept and the point moved
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^-?([0-9.]+)E", 1), r"\.0$|\.", "")
    exponent = F.coalesce(F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    sign = F.when(x < 0, "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), (-exponent - 1).cast("int")), mantissa)
    digits = F.length(mantissa)
    large = F.when(exponent + 1 >= digits, F.concat(sign, F.rpad(mantissa, exponent + 1, "0"))).otherwise(
        F.concat(sign, F.substring(mantissa, F.lit(1), exponent + 1), F.lit("."), F.substring(mantissa, exponent + 2, digits))
    )
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(special.isNotNull(), special)
        .when(whole, x.try_cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), plain)
        .when(size < 1, small)
        .otherwise(large)
    )


def time_text(x: Column) -> Column:
    """Lexical form of a timestamp as xsd:dateTime, with a fraction only if there is one."""
    text = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$|(\.\d*?)0+$", "$1")


def lexical(x: Column, shape: Shape) -> Column:
    if shape.form == "key":
        return F.substring(x, F.locate(SEP, x) + 1, F.length(x))
    if shape.form == "iri":
        return F.concat(F.lit(shape.extra), x.cast("string"))
    if shape.form == "num":
        return format_number(x) if shape.type == "computed" else x.cast("string")
    if shape.form == "bool":
        return F.when(x, "true").when(~x, "false")
    if shape.form == "time":
        return time_text(x)
    return x


def key(x: Column, shape: Shape) -> Column:
    """The key of a column's values; null stays null."""
    if shape.form == "key":
        return x
    head = {"iri": f"I{SEP}", "str": f"L{SEP}", "num": f"D{shape.extra}{SEP}", "bool": f"D{XSD}boolean{SEP}", "time": f"D{XSD}dateTime{SEP}", "lang": f"G{shape.extra}{SEP}"}[shape.form]
    return F.concat(F.lit(head), lexical(x, shape))


def shape_of_key(value: str) -> tuple[Shape, str | float | bool] | None:
    """A constant in a native shape, or None if it only has a key."""
    t = parse_key(value)
    if t.kind == "iri":
        return Shape("iri"), t.value
    if t.kind == "literal" and not t.datatype and not t.lang:
        return STRING, t.value
    return None
