"""XPath 1.0 expressions as values, and their canonical unabbreviated text."""

from __future__ import annotations

from dataclasses import dataclass

#: The axes; reverse ones number their nodes backwards.
AXES = ("child", "descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "self", "attribute", "following-sibling", "preceding-sibling", "following", "preceding", "namespace")
REVERSE = {"parent", "ancestor", "ancestor-or-self", "preceding-sibling", "preceding"}
#: The functions with the fewest and the most arguments (None: any number).
FUNCTIONS = {
    "last": (0, 0), "position": (0, 0), "count": (1, 1), "id": (1, 1), "local-name": (0, 1), "namespace-uri": (0, 1), "name": (0, 1), "string": (0, 1), "concat": (2, None), "starts-with": (2, 2), "contains": (2, 2), "substring-before": (2, 2), "substring-after": (2, 2),
    "substring": (2, 3), "string-length": (0, 1), "normalize-space": (0, 1), "translate": (3, 3), "boolean": (1, 1), "not": (1, 1), "true": (0, 0), "false": (0, 0), "lang": (1, 1), "number": (0, 1), "sum": (1, 1), "floor": (1, 1), "ceiling": (1, 1), "round": (1, 1),
}
#: Binary operators, loosest first.
LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))


class Expr:
    def __str__(self) -> str:
        return render(self)


@dataclass(frozen=True)
class Number(Expr):
    value: float


@dataclass(frozen=True)
class Literal(Expr):
    value: str


@dataclass(frozen=True)
class Variable(Expr):
    name: str


@dataclass(frozen=True)
class Test:
    """kind: name, any, local (any namespace), prefix (any name of a namespace), node, text, comment, pi."""

    kind: str
    local: str | None = None
    uri: str | None = None
    prefix: str | None = None


@dataclass(frozen=True)
class Step:
    axis: str
    test: Test
    predicates: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Path(Expr):
    """Steps from the root (absolute), the context node, or the nodes of start."""

    steps: tuple[Step, ...]
    absolute: bool = False
    start: Expr | None = None


@dataclass(frozen=True)
class Filter(Expr):
    base: Expr
    predicates: tuple[Expr, ...]


@dataclass(frozen=True)
class Negate(Expr):
    """`times` minus signs."""

    base: Expr
    times: int


@dataclass(frozen=True)
class Chain(Expr):
    """Operators of one level, from the left: first op operand op operand ..."""

    first: Expr
    rest: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Union(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


def _quote(s: str) -> str:
    return f'"{s}"' if '"' not in s else f"'{s}'"


def _test(t: Test) -> str:
    if t.kind == "name":
        return f"{t.prefix}:{t.local}" if t.prefix else t.local
    return {"any": "*", "local": f"*:{t.local}", "prefix": f"{t.prefix}:*", "node": "node()", "text": "text()", "comment": "comment()", "pi": f"processing-instruction({_quote(t.local) if t.local is not None else ''})"}[t.kind]


def _step(s: Step) -> str:
    return f"{s.axis}::{_test(s.test)}" + "".join(f"[{render(p)}]" for p in s.predicates)


def _level(e: Expr) -> int:
    if isinstance(e, Chain):
        return next(k for k, ops in enumerate(LEVELS) if e.rest[0][0] in ops)
    return 6 if isinstance(e, Negate) else 7 if isinstance(e, Union) else 8


def _inner(e: Expr, least: int) -> str:
    return render(e) if _level(e) >= least else f"({render(e)})"


def render(e: Expr) -> str:
    """Canonical text; it compiles to an equal expression."""
    from xylem.functions.scalars import format_number

    if isinstance(e, Number):
        return format_number(e.value)
    if isinstance(e, Literal):
        return _quote(e.value)
    if isinstance(e, Variable):
        return f"${e.name}"
    if isinstance(e, Call):
        return f"{e.name}({', '.join(map(render, e.args))})"
    if isinstance(e, Path):
        steps = "/".join(map(_step, e.steps))
        if e.start is not None:
            plain = isinstance(e.start, (Filter, Call, Variable, Literal, Number))
            return (render(e.start) if plain else f"({render(e.start)})") + f"/{steps}"
        return ("/" if e.absolute else "") + steps
    if isinstance(e, Filter):
        plain = isinstance(e.base, (Call, Variable, Literal, Number))
        return (render(e.base) if plain else f"({render(e.base)})") + "".join(f"[{render(p)}]" for p in e.predicates)
    if isinstance(e, Negate):
        return "-" * e.times + _inner(e.base, 7)
    if isinstance(e, Union):
        return " | ".join(_inner(p, 8) for p in e.parts)
    level = _level(e)
    return _inner(e.first, level + 1) + "".join(f" {op} {_inner(x, level + 1)}" for op, x in e.rest)
