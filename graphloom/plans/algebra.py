"""The algebra: patterns, paths, expressions and queries as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace  # noqa: F401

# -- terms of patterns


@dataclass(frozen=True)
class Var:
    """Names that start with `__` are hidden: blank nodes of the query and helpers."""

    name: str


@dataclass(frozen=True)
class Const:
    """A constant term, by key; also an expression."""

    key: str


Node = Var | Const


@dataclass(frozen=True)
class Triple:
    s: Node
    p: Node
    o: Node


# -- paths


@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: Path


@dataclass(frozen=True)
class Sequence:
    left: Path
    right: Path


@dataclass(frozen=True)
class Either:
    left: Path
    right: Path


@dataclass(frozen=True)
class Repeat:
    """kind: * + ?"""

    path: Path
    kind: str


@dataclass(frozen=True)
class Negated:
    forward: tuple[str, ...]
    backward: tuple[str, ...]
    both: bool = False


Path = Link | Inverse | Sequence | Either | Repeat | Negated

# -- expressions


@dataclass(frozen=True)
class VarExpr:
    name: str


@dataclass(frozen=True)
class Or:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class And:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not:
    arg: Expr


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class In:
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Arith:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Sign:
    arg: Expr
    negative: bool


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Exists:
    pattern: Pattern
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    """arg None: COUNT(*)."""

    name: str
    arg: Expr | None
    distinct: bool = False
    separator: str = " "


Expr = Const | VarExpr | Or | And | Not | Compare | In | Arith | Sign | Call | Exists | Aggregate

# -- patterns


@dataclass(frozen=True)
class Bgp:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class PathPattern:
    s: Node
    path: Path
    o: Node


@dataclass(frozen=True)
class Join:
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class LeftJoin:
    left: Pattern
    right: Pattern
    condition: Expr | None = None


@dataclass(frozen=True)
class Union:
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class Minus:
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class Filter:
    condition: Expr
    pattern: Pattern


@dataclass(frozen=True)
class Extend:
    pattern: Pattern
    var: str
    expr: Expr


@dataclass(frozen=True)
class Group:
    pattern: Pattern
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, Aggregate], ...]


@dataclass(frozen=True)
class Values:
    vars: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class Select:
    """A SELECT with its modifiers; vars None: all visible ones."""

    pattern: Pattern
    vars: tuple[str, ...] | None
    distinct: bool = False
    order: tuple[tuple[Expr, bool], ...] = ()  # (key, is descending)
    limit: int | None = None
    offset: int = 0


Pattern = Bgp | PathPattern | Join | LeftJoin | Union | Minus | Filter | Extend | Group | Values | Select


@dataclass(frozen=True)
class Query:
    """form: SELECT or ASK."""

    form: str
    select: Select


@dataclass(frozen=True)
class Change:
    """INSERT DATA or DELETE DATA: ground triples by key."""

    insert: bool
    triples: tuple[tuple[str, str, str], ...]


EMPTY = Bgp(())


def variables(p: Pattern) -> list[str]:
    """Variables in scope after a pattern, in order of first appearance."""
    out: dict[str, None] = {}

    def add(*names: str) -> None:
        out.update(dict.fromkeys(names))

    match p:
        case Bgp():
            for t in p.triples:
                add(*(n.name for n in (t.s, t.p, t.o) if isinstance(n, Var)))
        case PathPattern():
            add(*(n.name for n in (p.s, p.o) if isinstance(n, Var)))
        case Join() | LeftJoin() | Union():
            add(*variables(p.left), *variables(p.right))
        case Minus():
            add(*variables(p.left))
        case Filter():
            add(*variables(p.pattern))
        case Extend():
            add(*variables(p.pattern), p.var)
        case Group():
            add(*p.keys, *(n for n, _ in p.aggregates))
        case Values():
            add(*p.vars)
        case Select():
            add(*(p.vars if p.vars is not None else (v for v in variables(p.pattern) if not v.startswith("__"))))
    return list(out)


def expr_variables(e: Expr | None) -> set[str]:
    """Variables that an expression reads, those inside EXISTS included."""
    match e:
        case None | Const():
            return set()
        case VarExpr():
            return {e.name}
        case Or() | And() | Compare() | Arith():
            return expr_variables(e.left) | expr_variables(e.right)
        case Not() | Sign():
            return expr_variables(e.arg)
        case In():
            return expr_variables(e.arg).union(*(expr_variables(x) for x in e.items))
        case Call():
            return set().union(*(expr_variables(x) for x in e.args))
        case Exists():
            return set(variables(e.pattern)) | free_variables(e.pattern)
        case Aggregate():
            return expr_variables(e.arg)
    raise TypeError(e)


def free_variables(p: Pattern) -> set[str]:
    """Variables that filters inside a pattern read but the pattern there does not bind."""
    match p:
        case Filter():
            return free_variables(p.pattern) | (expr_variables(p.condition) - set(variables(p.pattern)))
        case Join() | Union() | Minus():
            return free_variables(p.left) | free_variables(p.right)
        case LeftJoin():
            inner = expr_variables(p.condition) - set(variables(p.left)) - set(variables(p.right))
            return free_variables(p.left) | free_variables(p.right) | inner
        case Extend():
            return free_variables(p.pattern) | (expr_variables(p.expr) - set(variables(p.pattern)))
    return set()


def conjuncts(e: Expr) -> list[Expr]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, And) else [e]


def has_exists(e: Expr | None) -> bool:
    match e:
        case Exists():
            return True
        case Or() | And() | Compare() | Arith():
            return has_exists(e.left) or has_exists(e.right)
        case Not() | Sign():
            return has_exists(e.arg)
        case In():
            return has_exists(e.arg) or any(map(has_exists, e.items))
        case Call():
            return any(map(has_exists, e.args))
    return False
