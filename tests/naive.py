"""A plain evaluator of the algebra over lists of dicts: what the engine is compared with."""

from __future__ import annotations

from graphloom.functions import terms as T
from graphloom.plans import algebra as A

NUM = set(T.NUMERIC)


class Err(Exception):
    pass


def compatible(a: dict, b: dict) -> bool:
    return all(b.get(k, v) == v for k, v in a.items())


def value(e, row):
    """A Python value: ('num', float) | ('bool', x) | (kind, text, extra)."""
    if isinstance(e, A.VarExpr):
        if e.name not in row:
            raise Err
        return of_key(row[e.name])
    if isinstance(e, A.Const):
        return of_key(e.key)
    if isinstance(e, A.Compare):
        a, b = value(e.left, row), value(e.right, row)
        if e.op in ("=", "!="):
            return ("bool", equal(a, b) == (e.op == "="))
        return ("bool", less(e.op, a, b))
    if isinstance(e, A.Not):
        return ("bool", not ebv(e.arg, row))
    if isinstance(e, (A.And, A.Or)):
        out = []
        for x in (e.left, e.right):
            try:
                out.append(ebv(x, row))
            except Err:
                out.append(None)
        decided = isinstance(e, A.Or)
        if decided in out:
            return ("bool", decided)
        if None in out:
            raise Err
        return ("bool", not decided)
    if isinstance(e, A.Call) and e.name == "BOUND":
        return ("bool", e.args[0].name in row)
    if isinstance(e, A.Arith):
        a, b = number(value(e.left, row)), number(value(e.right, row))
        if e.op == "/":
            if b == 0:
                raise Err
            return ("num", a / b)
        return ("num", {"+": a + b, "-": a - b, "*": a * b}[e.op])
    raise NotImplementedError(e)


def of_key(key):
    t = T.parse_key(key)
    if t.datatype in NUM:
        try:
            return ("num", float(t.value))
        except ValueError:
            pass
    if t.datatype == T.XSD + "boolean":
        return ("bool", t.value in ("true", "1"))
    return (t.kind if t.kind != "literal" else "lang" if t.lang else "typed" if t.datatype else "str", t.value, t.lang or t.datatype)


def number(v):
    if v[0] in ("num", "bool"):
        return float(v[1])
    raise Err


def equal(a, b):
    if a[0] in ("num", "bool") and b[0] in ("num", "bool"):
        return number(a) == number(b)
    if a[0] != b[0]:
        raise Err
    return a == b


def less(op, a, b):
    if a[0] in ("num", "bool") and b[0] in ("num", "bool"):
        x, y = number(a), number(b)
    elif a[0] != b[0] or a[0] == "typed" and a[2] != b[2]:
        raise Err
    else:
        x, y = a[1].encode(), b[1].encode()
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def ebv(e, row) -> bool:
    v = value(e, row)
    if v[0] == "bool":
        return v[1]
    if v[0] == "num":
        return v[1] != 0 and v[1] == v[1]
    if v[0] == "str":
        return v[1] != ""
    raise Err


def holds(e, row) -> bool:
    try:
        return ebv(e, row)
    except Err:
        return False


def evaluate(p, triples) -> list[dict]:
    match p:
        case A.Bgp():
            rows = [{}]
            for t in p.triples:
                new = []
                for row in rows:
                    for triple in triples:
                        r = dict(row)
                        for n, k in zip((t.s, t.p, t.o), triple, strict=True):
                            if isinstance(n, A.Const):
                                if n.key != k:
                                    break
                            elif r.setdefault(n.name, k) != k:
                                break
                        else:
                            new.append(r)
                rows = new
            return rows
        case A.Join():
            return [a | b for a in evaluate(p.left, triples) for b in evaluate(p.right, triples) if compatible(a, b)]
        case A.LeftJoin():
            out, right = [], evaluate(p.right, triples)
            for a in evaluate(p.left, triples):
                hits = [a | b for b in right if compatible(a, b) and (p.condition is None or holds(p.condition, a | b))]
                out += hits or [a]
            return out
        case A.Union():
            return evaluate(p.left, triples) + evaluate(p.right, triples)
        case A.Minus():
            right = evaluate(p.right, triples)
            return [a for a in evaluate(p.left, triples) if not any(compatible(a, b) and a.keys() & b.keys() for b in right)]
        case A.Filter():
            if isinstance(p.condition, A.Exists):
                right = evaluate(p.condition.pattern, triples)
                return [a for a in evaluate(p.pattern, triples) if any(compatible(a, b) for b in right) != p.condition.negated]
            return [a for a in evaluate(p.pattern, triples) if holds(p.condition, a)]
        case A.Values():
            return [{v: k for v, k in zip(p.vars, r, strict=True) if k is not None} for r in p.rows]
        case A.Extend():
            out = []
            for a in evaluate(p.pattern, triples):
                try:
                    v = value(p.expr, a)
                    out.append(a | {p.var: v})
                except Err:
                    out.append(a)
            return out
    raise NotImplementedError(p)
