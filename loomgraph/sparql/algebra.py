"""What a query says, as plain data."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = "string"  # string, integer, decimal, double, boolean, or a full IRI
    lang: str | None = None


Term = Var | Iri | Literal


@dataclass(frozen=True)
class Path:
    """``op``: seq, alt, inv, star, plus, opt, not; parts are IRIs or paths."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Any
    o: Term
    graph: Term | None = None


@dataclass(frozen=True)
class Expr:
    """``op`` is an operator or a function's name in upper case; ``args`` are expressions or terms."""

    op: str
    args: tuple = ()
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Group:
    """Elements in order: triples, filters, optionals and so on."""

    parts: tuple


@dataclass(frozen=True)
class Filter:
    expr: Any


@dataclass(frozen=True)
class Optional:
    group: Group


@dataclass(frozen=True)
class Union:
    groups: tuple


@dataclass(frozen=True)
class Minus:
    group: Group


@dataclass(frozen=True)
class Bind:
    expr: Any
    var: Var


@dataclass(frozen=True)
class Values:
    vars: tuple
    rows: tuple  # of tuples of terms, None for UNDEF


@dataclass(frozen=True)
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    where: Group
    items: tuple = ()  # Var or (expr, Var); empty for *
    distinct: bool = False
    group_by: tuple = ()
    having: tuple = ()
    order_by: tuple = ()  # (expr, descending)
    limit: int | None = None
    offset: int = 0
    values: Values | None = None
    template: tuple = ()
    graphs: tuple = ()  # (iri, named)
    prefixes: dict = field(default_factory=dict, compare=False)


AGGREGATES = frozenset(("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"))


def children(x: Any) -> tuple:
    return x.args if isinstance(x, Expr) else ()


def aggregates(x: Any) -> list[Expr]:
    """Aggregates of an expression, outermost only."""
    if isinstance(x, Expr) and x.op in AGGREGATES:
        return [x]
    return [a for c in children(x) for a in aggregates(c)]


def variables(x: Any) -> list[str]:
    """Names of variables of a pattern or expression that it shows outside, in order of first appearance."""
    match x:
        case Var(name):
            return [name]
        case Triple():
            found = [n for t in (x.s, x.p, x.o, x.graph) if isinstance(t, Var) for n in [t.name]]
        case Group(parts) | Union(parts):
            found = [n for p in parts if not isinstance(p, (Filter, Minus)) for n in variables(p)]
        case Optional(group):
            found = variables(group)
        case Bind():
            found = [x.var.name]
        case Values():
            found = [v.name for v in x.vars]
        case Query():
            found = [i.name if isinstance(i, Var) else i[1].name for i in x.items] or variables(x.where)
        case Expr():
            found = [n for a in x.args if not isinstance(a, Group) for n in variables(a)]
        case _:
            found = []
    return list(dict.fromkeys(found))


def _iris(x: Any) -> Iterator[str]:
    if isinstance(x, Iri):
        yield x.value
    elif isinstance(x, (tuple, list)):
        for part in x:
            yield from _iris(part)
    elif is_dataclass(x):
        for f in fields(x):
            if f.name != "prefixes":
                yield from _iris(getattr(x, f.name))


def iris(q: Query) -> list[str]:
    """IRIs that a query names, in order of first appearance."""
    return list(dict.fromkeys(_iris(q)))


def canonical(q: Query) -> str:
    """A key that two queries share if they say the same, however spelled."""
    return hashlib.sha256(repr(replace(q, prefixes={})).encode()).hexdigest()
