"""SPARQL expressions as Spark columns.

An error and an unbound variable are both NULL: Spark's three-valued AND, OR and
NOT are then exactly SPARQL's, and a filter drops what is NULL as it drops false.
Nothing here may throw, so there are only `try_` casts and guarded functions.

Every compiled value has a static class; only values of unknown class (keys) are
looked at at run time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import algebra as A
from . import terms as T


class Unsupported(ValueError):
    """A construct that the engine refuses, named in the message."""


_NULL_STRING = lambda: F.lit(None).cast("string")
_NULL_DOUBLE = lambda: F.lit(None).cast("double")
_NULL_BOOL = lambda: F.lit(None).cast("boolean")


@dataclass
class Value:
    """A compiled expression.

    cls: iri | blank | str | num | bool | lang | typed | unknown. col holds the lexical
    form, the number, the truth value, or, for unknown, the key. shape: the
    native column it came from, if any. text: a constant's lexical form.
    """

    cls: str
    col: Column
    extra: str | Column = ""
    shape: T.Shape | None = None
    constant: object = None
    _memo: dict = field(default_factory=dict)

    def _once(self, name: str, make: Callable[[], Column]) -> Column:
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    # parts of a key
    def kind(self) -> Column:
        return self._once("kind", lambda: F.substring(self.col, 1, 1))

    def lex(self) -> Column:
        return self._once("lex", lambda: T.lexical(self.col, T.KEY))

    def tag(self) -> Column:
        return self._once("tag", lambda: F.substring(self.col, F.lit(2), F.locate(T.SEP, self.col) - 2))

    def pure_number(self) -> Column:
        """The number of a numeric term, else NULL; booleans are none."""
        if self.cls == "num":
            return self.col.cast("double")
        if self.cls != "unknown":
            return _NULL_DOUBLE()
        return self._once("pure", lambda: F.when((self.kind() == "D") & self.tag().isin(*T.NUMERIC) & self.lex().rlike(T.NUMBER), F.regexp_replace(F.lower(self.lex()), "^[+]?(-?)inf(inity)?$", "$1Infinity").try_cast("double")))

    def truth(self) -> Column:
        """The value of a boolean term, else NULL."""
        if self.cls == "bool":
            return self.col
        if self.cls != "unknown":
            return _NULL_BOOL()
        return self._once("truth", lambda: F.when((self.kind() == "D") & (self.tag() == T.XSD + "boolean"), self.lex().isin("true", "1")))

    def number(self) -> Column:
        """A number, or 0 and 1 for a boolean."""
        if self.cls == "bool":
            return self.col.cast("double")
        if self.cls == "unknown":
            return self._once("number", lambda: F.coalesce(self.pure_number(), self.truth().cast("double")))
        return self.pure_number()

    def code(self) -> Column:
        """A letter for the class: I B L G, N number, O boolean, D other typed literal."""
        letter = {"iri": "I", "blank": "B", "str": "L", "lang": "G", "num": "N", "bool": "O", "typed": "D"}
        if self.cls != "unknown":
            return F.when(self.col.isNotNull(), letter[self.cls])
        return self._once("code", lambda: F.when(self.col.isNull(), _NULL_STRING()).when(self.kind() != "D", self.kind()).when(self.truth().isNotNull(), "O").when(self.pure_number().isNotNull(), "N").otherwise("D"))

    def key(self) -> Column:
        if self.cls == "unknown":
            return self.col
        if self.shape is not None:
            return T.key(self.col, self.shape)
        if self.cls == "num":
            return T.key(self.col, T.DOUBLE)
        if self.cls == "bool":
            return T.key(self.col, T.BOOLEAN)
        head = {"iri": F.lit("I"), "blank": F.lit("B"), "str": F.lit("L")}.get(self.cls)
        if head is None:
            extra = self.extra if isinstance(self.extra, Column) else F.lit(self.extra)
            head = F.concat(F.lit("G" if self.cls == "lang" else "D"), extra)
        return F.concat(head, F.lit(T.SEP), self.text())

    def text(self) -> Column:
        """Lexical form of the stored term (numbers as computed)."""
        if self.cls == "unknown":
            return self.lex()
        if self.shape is not None:
            return T.lexical(self.col, self.shape)
        if self.cls == "num":
            return T.format_number(self.col)
        if self.cls == "bool":
            return T.lexical(self.col, T.BOOLEAN)
        return self.col

    def string(self) -> Column:
        """STR(): numbers in computed form, booleans as true and false."""
        if self.cls == "num":
            return T.format_number(self.col.cast("double"))
        if self.cls == "unknown":
            return F.when(self.pure_number().isNotNull(), T.format_number(self.pure_number())).when(self.truth().isNotNull(), F.when(self.truth(), "true").otherwise("false")).otherwise(self.lex())
        return self.text()

    def as_string(self) -> Column:
        """The string of an argument: any literal but a number or boolean, or an IRI; else an error."""
        if self.cls in ("num", "bool", "blank"):
            return _NULL_STRING()
        if self.cls == "unknown":
            return self._once("as_string", lambda: F.when(self.code().isin("I", "L", "G", "D"), self.lex()))
        return self.text()

    def ebv(self) -> Column:
        if self.cls == "bool":
            return self.col
        if self.cls == "num":
            x = self.col.cast("double")
            return (x != 0) & ~F.isnan(x)
        if self.cls == "str":
            return self.text() != ""
        if self.cls == "unknown":
            n = self.pure_number()
            return F.when(self.truth().isNotNull(), self.truth()).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(self.kind() == "L", self.lex() != "")
        return _NULL_BOOL()

    def datatype_or_lang(self) -> Column:
        if self.cls == "unknown":
            return self.tag()
        return self.extra if isinstance(self.extra, Column) else F.lit(self.extra)


def of_shape(col: Column, shape: T.Shape) -> Value:
    """The value of a variable's column."""
    cls = {"key": "unknown", "iri": "iri", "str": "str", "num": "num", "bool": "bool", "time": "typed", "lang": "lang"}[shape.form]
    return Value(cls, col, shape.extra, None if cls == "unknown" else shape)


def constant(key: str) -> Value:
    t = T.parse_key(key)
    if t.kind == "iri":
        return Value("iri", F.lit(t.value), constant=t.value)
    if t.kind == "blank":
        return Value("blank", F.lit(t.value), constant=t.value)
    if t.lang:
        return Value("lang", F.lit(t.value), t.lang, constant=t.value)
    if t.datatype == T.XSD + "boolean":
        return Value("bool", F.lit(t.value in ("true", "1")), constant=t.value)
    if t.datatype in T.NUMERIC and re.match(T.NUMBER.replace("(?i)", ""), t.value, re.I):
        return Value("num", F.lit(float(t.value)), t.datatype, T.Shape("num", t.datatype, "computed"), constant=float(t.value))
    if t.datatype:
        return Value("typed", F.lit(t.value), t.datatype, constant=t.value)
    return Value("str", F.lit(t.value), constant=t.value)


_CANONICAL_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d")


def _times(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Both sides as timestamps, if they are xsd:dateTime columns or canonical constants: their order is then that of their texts."""

    def one(v: Value) -> Column | None:
        if v.shape is not None and v.shape.form == "time":
            return v.col
        if v.cls == "typed" and v.extra == T.XSD + "dateTime" and isinstance(v.constant, str) and _CANONICAL_TIME.fullmatch(v.constant):
            return F.lit(v.constant.replace("T", " ")).cast("timestamp")
        return None

    x, y = one(a), one(b)
    return (x, y) if x is not None and y is not None and (a.shape or b.shape) else None


def equal(a: Value, b: Value) -> Column:
    numeric = ("num", "bool")
    if a.cls in numeric and b.cls in numeric:
        if a.cls == b.cls:
            return a.col == b.col
        return a.number() == b.number()
    if a.cls != "unknown" and b.cls != "unknown":
        if a.cls != b.cls:
            return _NULL_BOOL()
        times = _times(a, b)
        if times:
            return times[0] == times[1]
        if a.shape is not None and a.shape == b.shape:
            return a.col == b.col
        for x, y in ((a, b), (b, a)):  # a native IRI column against a constant: the column stays bare, so the scan can filter
            if x.shape is not None and x.shape.form == "iri" and isinstance(y.constant, str):
                return native_equal(x.col, x.shape, T.iri(y.constant))
        same = a.text() == b.text()
        if a.cls in ("lang", "typed"):
            same = same & (a.datatype_or_lang() == b.datatype_or_lang())
        return same
    number = a.number() == b.number()
    if a.cls in numeric or b.cls in numeric:
        return number
    keyed = F.when(a.code() == b.code(), a.key() == b.key())
    if "unknown" == a.cls == b.cls:
        return F.when(number.isNotNull(), number).otherwise(keyed)
    return keyed


def native_equal(col: Column, shape: T.Shape, key: str) -> Column:
    """Is a column's term the constant? Compared as native values where the constant has one."""
    t = T.parse_key(key)
    if shape.form == "key":
        return col == F.lit(key)
    if shape.form == "iri" and t.kind == "iri":
        rest = t.value[len(shape.extra) :]
        if not t.value.startswith(shape.extra):
            return F.lit(False)
        if shape.type in ("int", "bigint"):
            ok = re.fullmatch(r"-?(0|[1-9]\d*)", rest) and rest != "-0" and abs(int(rest)) < 2**63
            return col == F.lit(int(rest)) if ok else F.lit(False)
        return col == F.lit(rest)
    if shape.form == "str" and t.kind == "literal" and not t.datatype and not t.lang:
        return col == F.lit(t.value)
    if shape.form == "num" and shape.type in ("int", "bigint") and t.kind == "literal" and t.datatype == shape.extra:
        ok = re.fullmatch(r"-?(0|[1-9]\d*)", t.value) and t.value != "-0" and abs(int(t.value)) < 2**63
        return col == F.lit(int(t.value)) if ok else F.lit(False)
    return T.key(col, shape) == F.lit(key)


def _order(op: str, x: Column, y: Column) -> Column:
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def compare(op: str, a: Value, b: Value) -> Column:
    if op == "=":
        return equal(a, b)
    numeric = ("num", "bool")
    if a.cls in numeric or b.cls in numeric:
        other = b if a.cls in numeric else a
        if other.cls not in (*numeric, "unknown"):
            return _NULL_BOOL()
        x, y = (a.col, b.col) if a.cls == b.cls == "num" else (a.number(), b.number())
        result = _order(op, x, y)
        for v in (a, b):  # NaN compares with nothing; Spark would rank it highest
            if v.constant is not None or v.cls == "bool" or v.shape is not None and v.shape.type in ("int", "bigint"):
                continue
            if v.shape is not None and v.shape.type == "double":  # kept as a conjunct, so the scan can filter
                result = result & F.when(~F.isnan(v.col), True)
            else:
                result = F.when(~F.isnan(v.number()), result)
        return result
    if a.cls != "unknown" and b.cls != "unknown":
        if a.cls != b.cls:
            return _NULL_BOOL()
        times = _times(a, b)
        if times:
            return _order(op, *times)
        result = _order(op, a.text(), b.text())
        if a.cls == "typed":
            return F.when(a.datatype_or_lang() == b.datatype_or_lang(), result)
        return result
    text = F.when((a.code() == b.code()) & ((a.code() != "D") | (a.datatype_or_lang() == b.datatype_or_lang())), _order(op, a.text(), b.text()))
    if a.cls == b.cls == "unknown":
        x, y = a.number(), b.number()
        return F.when(x.isNotNull() & y.isNotNull(), F.when(~F.isnan(x) & ~F.isnan(y), _order(op, x, y))).otherwise(text)
    return text


# -- dates: the parts of an xsd:date or xsd:dateTime text, checked, zone not applied
_DATE = r"^(-?)([0-9]{4,})-([0-9]{1,2})-([0-9]{1,2})(?:(?:Z|[+-][0-9:]{5})|T([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2}(?:\.[0-9]*)?)(?:Z|[+-][0-9:]{5})?)?$"


def date_part(v: Value, part: str) -> Column:
    if v.shape is not None and v.shape.form == "time":
        c = v.col
        if part == "SECONDS":
            return (F.second(c) + F.date_format(c, "SSSSSS").cast("double") / 1e6).cast("double")
        return {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute}[part](c).cast("double")
    s = v.as_string()

    def group(i: int) -> Column:
        return F.regexp_extract(s, _DATE, i).try_cast("double")

    zero = F.lit(0.0)
    month, day, hours, minutes, seconds = (F.coalesce(group(i), zero) for i in (3, 4, 5, 6, 7))
    valid = s.rlike(_DATE) & month.between(1, 12) & day.between(1, 31) & (hours <= 24) & (minutes <= 59) & (seconds < 60)
    year = F.when(F.regexp_extract(s, _DATE, 1) == "-", -group(2)).otherwise(group(2))
    return F.when(valid, {"YEAR": year, "MONTH": month, "DAY": day, "HOURS": hours, "MINUTES": minutes, "SECONDS": seconds}[part])


def java_pattern(pattern: str, flags: str) -> str | None:
    """The pattern with flags for Java, or None if it is none."""
    if set(flags) - set("ims"):
        return None
    whole = f"(?{''.join(sorted(set(flags)))})" + pattern if flags else pattern
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    try:
        sc._jvm.java.util.regex.Pattern.compile(whole)
    except IllegalArgumentException:
        return None
    return whole


class Compiler:
    """Compiles expressions over a scope: variable name -> Value, None if it is unbound in every row.

    exists: compiles EXISTS patterns to a truth column (set by the plan compiler).
    """

    def __init__(self, scope: Callable[[str], Value | None], exists: Callable[[A.Exists], Column] | None = None):
        self.scope = scope
        self.exists = exists

    def value(self, e: A.Expr) -> Value:
        if isinstance(e, A.Const):
            return constant(e.key)
        if isinstance(e, A.VarExpr):
            found = self.scope(e.name)
            return found if found is not None else Value("unknown", _NULL_STRING())
        if isinstance(e, A.Or):
            return Value("bool", self.ebv(e.left) | self.ebv(e.right))
        if isinstance(e, A.And):
            return Value("bool", self.ebv(e.left) & self.ebv(e.right))
        if isinstance(e, A.Not):
            return Value("bool", ~self.ebv(e.arg))
        if isinstance(e, A.Compare):
            a, b = self.value(e.left), self.value(e.right)
            return Value("bool", ~equal(a, b) if e.op == "!=" else compare(e.op, a, b))
        if isinstance(e, A.In):
            left = self.value(e.arg)
            hit = F.lit(False)
            for x in e.items:  # errors among the items count as no match
                hit = hit | F.coalesce(equal(left, self.value(x)), F.lit(False))
            result = F.when(left.key().isNotNull(), hit)
            return Value("bool", ~result if e.negated else result)
        if isinstance(e, A.Arith):
            a, b = self.value(e.left).number(), self.value(e.right).number()
            return Value("num", {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, F.try_divide(a, b))}[e.op]())
        if isinstance(e, A.Sign):
            x = self.value(e.arg).number()
            return Value("num", -x if e.negative else x)
        if isinstance(e, A.Exists):
            if self.exists is None:
                raise Unsupported("EXISTS is not supported here")
            mark = self.exists(e)
            return Value("bool", ~mark if e.negated else mark)
        if isinstance(e, A.Call):
            return self.call(e.name, e.args)
        raise Unsupported(f"unsupported expression {type(e).__name__}")

    def ebv(self, e: A.Expr) -> Column:
        return self.value(e).ebv()

    def choose(self, values: list[Value], pick: Callable[[list[Column]], Column]) -> Value:
        """One of several values, as it is if all have the same class and shape, else by key."""
        first = values[0]
        if first.cls in ("num", "bool") and all(v.cls == first.cls and (v.shape is None or v.shape.type == "computed" and v.shape.extra == T.XSD + "double") for v in values):
            return Value(first.cls, pick([v.col for v in values]))
        if first.cls in ("str", "iri") and all(v.cls == first.cls for v in values):
            return Value(first.cls, pick([v.text() for v in values]))
        return Value("unknown", pick([v.key() for v in values]))

    def call(self, name: str, args: list[A.Expr]) -> Value:
        if name == "BOUND":
            if not isinstance(args[0], A.VarExpr):
                raise Unsupported("BOUND takes a variable")
            found = self.scope(args[0].name)
            return Value("bool", F.lit(False) if found is None else found.col.isNotNull())
        if name == "IF":
            test = self.ebv(args[0])
            return self.choose([self.value(args[1]), self.value(args[2])], lambda c: F.when(test, c[0]).when(~test, c[1]))
        if name == "COALESCE":
            if not args:
                return Value("unknown", _NULL_STRING())
            return self.choose([self.value(a) for a in args], lambda c: F.coalesce(*c))
        make = FUNCTIONS.get(name)
        if make is None:
            raise Unsupported(f"unsupported function {name}")
        least, most, build = make
        if not least <= len(args) <= most:
            raise Unsupported(f"{name} does not take {len(args)} arguments")
        return build(*[self.value(a) for a in args])


def _str(c: Column) -> Value:
    return Value("str", c)


def _num(c: Column) -> Value:
    return Value("num", c)


def _bool(c: Column) -> Value:
    return Value("bool", c)


def _is(*codes: str) -> Callable[[Value], Value]:
    return lambda v: _bool(v.code().isin(*codes))


def _same_term(a: Value, b: Value) -> Value:
    return _bool(a.key() == b.key())


def _lang(v: Value) -> Value:
    if v.cls == "lang":
        return _str(F.when(v.col.isNotNull(), v.datatype_or_lang()))
    if v.cls == "unknown":
        return _str(F.when(v.kind() == "G", v.tag()).when(v.col.isNotNull(), ""))
    return _str(F.when(v.col.isNotNull(), ""))


def _datatype(v: Value) -> Value:
    fixed = {"num": T.XSD + "double", "bool": T.XSD + "boolean", "str": T.XSD + "string", "lang": T.RDF + "langString"}
    if v.cls in ("iri", "blank"):
        return Value("iri", _NULL_STRING())
    if v.cls == "typed":
        return Value("iri", F.when(v.col.isNotNull(), v.datatype_or_lang()))
    if v.cls == "unknown":
        c = v.code()
        return Value("iri", F.when(c == "N", fixed["num"]).when(c == "O", fixed["bool"]).when(c == "L", fixed["str"]).when(c == "G", fixed["lang"]).when(c == "D", v.tag()))
    return Value("iri", F.when(v.col.isNotNull(), fixed[v.cls]))


def _regex(text: Value, pattern: Value, flags: Value | None = None) -> Value:
    if not isinstance(pattern.constant, str) or (flags is not None and not isinstance(flags.constant, str)):
        raise Unsupported("REGEX takes a constant pattern and constant flags")
    java = java_pattern(pattern.constant, flags.constant if flags is not None else "")
    return _bool(_NULL_BOOL() if java is None else text.as_string().rlike(java))


def _replace(text: Value, pattern: Value, new: Value, flags: Value | None = None) -> Value:
    if not all(isinstance(x.constant, str) for x in (pattern, new, *([flags] if flags is not None else []))):
        raise Unsupported("REPLACE takes a constant pattern, replacement and flags")
    java = java_pattern(pattern.constant, flags.constant if flags is not None else "")
    if java is None:
        return _str(_NULL_STRING())
    groups = re.compile(r"\((?!\?)|\(\?<(?![=!])").findall(re.sub(r"\\.|\[[^]]*\]", "", java))
    # a reference to a group that is not there is empty, as is a lone dollar's; Java would throw
    replacement = re.sub(r"\$(\d+)", lambda m: m[0] if int(m[1]) <= len(groups) else "", new.constant.replace("\\", "\\\\"))
    replacement = re.sub(r"\$(?!\d)", r"\\$", replacement)
    return _str(F.regexp_replace(text.as_string(), F.lit(java), F.lit(replacement)))


def _substr(text: Value, start: Value, length: Value | None = None) -> Value:
    s, at = text.as_string(), F.round(start.number())
    begin = F.greatest(at, F.lit(1.0))
    if length is None:
        size = F.length(s).cast("double")
    else:
        n = F.round(length.number())
        size = F.when(F.isnan(n), 0.0).otherwise(at + n - begin)
    finite = ~F.isnan(at) & (F.abs(at) != float("inf"))
    cut = F.substring(s, F.least(begin, F.lit(2e9)).try_cast("int"), F.greatest(F.least(size, F.lit(2e9)), F.lit(0.0)).try_cast("int"))
    known = s.isNotNull() & at.isNotNull()
    if length is not None:
        known = known & length.number().isNotNull()
    return _str(F.when(known, F.when(finite, cut).otherwise("")))


def _concat(*parts: Value) -> Value:
    return _str(F.concat(*[p.string() for p in parts]) if parts else F.lit(""))


def _text(f: Callable[[Column], Column]) -> tuple:
    return 1, 1, lambda v: _str(f(v.as_string()))


def _test(f: Callable[[Column, Column], Column]) -> tuple:
    return 2, 2, lambda a, b: _bool(f(a.as_string(), b.as_string()))


def _math(f: Callable[[Column], Column]) -> tuple:
    return 1, 1, lambda v: _num(f(v.number()))


def _date(part: str) -> tuple:
    return 1, 1, lambda v: _num(date_part(v, part))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding that stays in doubles: beyond 2**53 every double is whole."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= float(2**53)), x).otherwise(f(x).cast("double"))


#: Name -> (fewest, most arguments, build). Whatever is not here is refused by name.
FUNCTIONS: dict[str, tuple] = {
    "STR": (1, 1, lambda v: _str(v.string())),
    "LANG": (1, 1, _lang),
    "DATATYPE": (1, 1, _datatype),
    "STRLEN": (1, 1, lambda v: _num(F.char_length(v.as_string()).cast("double"))),
    "UCASE": _text(F.upper),
    "LCASE": _text(F.lower),
    "CONTAINS": _test(F.contains),
    "STRSTARTS": _test(F.startswith),
    "STRENDS": _test(F.endswith),
    "ISIRI": (1, 1, _is("I")),
    "ISURI": (1, 1, _is("I")),
    "ISBLANK": (1, 1, _is("B")),
    "ISLITERAL": (1, 1, _is("L", "G", "D", "N", "O")),
    "ISNUMERIC": (1, 1, _is("N")),
    "SAMETERM": (2, 2, _same_term),
    "REGEX": (2, 3, _regex),
    "SUBSTR": (2, 3, _substr),
    "CONCAT": (0, 1000, _concat),
    "REPLACE": (3, 4, _replace),
    "ABS": _math(F.abs),
    "CEIL": _math(_whole(F.ceil)),
    "FLOOR": _math(_whole(F.floor)),
    "ROUND": _math(_whole(F.round)),
    "YEAR": _date("YEAR"),
    "MONTH": _date("MONTH"),
    "DAY": _date("DAY"),
    "HOURS": _date("HOURS"),
    "MINUTES": _date("MINUTES"),
    "SECONDS": _date("SECONDS"),
    "MD5": _text(F.md5),
    "SHA1": _text(F.sha1),
    "SHA256": _text(lambda c: F.sha2(c, 256)),
    "SHA384": _text(lambda c: F.sha2(c, 384)),
    "SHA512": _text(lambda c: F.sha2(c, 512)),
}
