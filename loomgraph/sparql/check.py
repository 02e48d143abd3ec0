"""Whether a parsed query means anything: names and arguments of functions, scopes of variables, places of aggregates."""

from __future__ import annotations

from typing import Any

from .algebra import AGGREGATES, Bind, Expr, Filter, Group, Iri, Minus, Optional, Query, Union, Var, aggregates, variables
from .lexer import SparqlSyntaxError

XSD = "http://www.w3.org/2001/XMLSchema#"
#: Functions by how many arguments they take (least and most).
ARITY = {
    (0, 0): "NOW RAND UUID STRUUID",
    (0, 1): "BNODE",
    (1, 1): "STR LANG DATATYPE BOUND IRI URI ABS CEIL FLOOR ROUND STRLEN UCASE LCASE ENCODE_FOR_URI YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ MD5 SHA1 SHA256 SHA384 SHA512 ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC",
    (2, 2): "LANGMATCHES CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER STRLANG STRDT SAMETERM",
    (2, 3): "SUBSTR REGEX",
    (3, 3): "IF",
    (3, 4): "REPLACE",
    (0, 99): "CONCAT COALESCE",
}
_TAKES = {name: bounds for bounds, names in ARITY.items() for name in names.split()}
_OPERATORS = frozenset(("&&", "||", "!", "=", "!=", "<", "<=", ">", ">=", "+", "-", "*", "/", "NEG", "IN", "NOT IN"))
#: Datatypes that a value can be turned into.
_CASTS = frozenset("integer int long nonNegativeInteger decimal double float boolean dateTime date string".split())


def check(q: Query) -> Query:
    """The same query, or an error that says what is wrong with it."""
    _group(q.where)
    shown, seen = set(variables(q.where)), set()
    for item in q.items:
        if not isinstance(item, tuple):
            continue
        expr, var = item
        _expression(expr, counted=True)
        if var.name in shown or var.name in seen:
            raise SparqlSyntaxError(f"?{var.name} is bound already")
        seen.add(var.name)
    for expr, var in q.group_by:
        _expression(expr)
        if var and var != expr and var.name in shown:
            raise SparqlSyntaxError(f"?{var.name} is bound already")
    for expr in (*q.having, *(e for e, _ in q.order_by)):
        _expression(expr, counted=True)
    return q


def _group(g: Group) -> None:
    bound: set[str] = set()
    for part in g.parts:
        match part:
            case Filter(expr):
                _expression(expr)
            case Bind(expr, var):
                _expression(expr)
                if var.name in bound:
                    raise SparqlSyntaxError(f"?{var.name} is bound already")
            case Optional(inner) | Minus(inner):
                _group(inner)
            case Union(groups):
                for inner in groups:
                    _group(inner)
            case Group():
                _group(part)
            case Query():
                check(part)
        if not isinstance(part, (Filter, Minus)):
            bound |= set(variables(part))


def _expression(x: Any, counted: bool = False) -> None:
    if not isinstance(x, Expr):
        return
    if x.op == "EXISTS":
        return _group(x.args[0])
    if x.op in AGGREGATES:
        if not counted:
            raise SparqlSyntaxError(f"{x.op} can't stand here, only in SELECT, HAVING and ORDER BY")
        if any(aggregates(a) for a in x.args):
            raise SparqlSyntaxError(f"{x.op} can't hold another aggregate")
    elif x.op == "CAST":
        name = x.args[0].value
        if not name.startswith(XSD) or name.removeprefix(XSD) not in _CASTS:
            raise SparqlSyntaxError(f"unknown function <{name}>")
        if len(x.args) != 2:
            raise SparqlSyntaxError(f"<{name}> takes 1 argument, not {len(x.args) - 1}")
    elif x.op not in _OPERATORS:
        if x.op not in _TAKES:
            raise SparqlSyntaxError(f"unknown function {x.op}")
        least, most = _TAKES[x.op]
        if not least <= len(x.args) <= most:
            wanted = str(least) if least == most else f"{least} to {most}"
            raise SparqlSyntaxError(f"{x.op} takes {wanted} arguments, not {len(x.args)}")
        if x.op == "BOUND" and not isinstance(x.args[0], Var):
            raise SparqlSyntaxError("BOUND takes a variable")
    for a in x.args:
        if not isinstance(a, Iri):
            _expression(a, counted)
