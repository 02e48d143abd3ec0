"""SPARQL expressions as columns. An error is null, as filters and BIND need it."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, functions as F

from ..sparql.algebra import Expr, Group, Iri, Literal, Var
from ..sparql.lexer import SparqlSyntaxError
from ..sparql.parser import RDF, XSD
from .values import DATATYPES, KIND_OF, NUMERIC, SQL_TYPES, Value, alike, comparable

#: A date or a time of a day, as written.
MOMENT = r"^-?\d{4,}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?$"


def moment(text: Column) -> Column:
    return F.when(text.rlike(MOMENT) & text.try_cast("timestamp").isNotNull(), text)


def a_term(lex: Column, datatype: Column, lang: Column) -> Value:
    whole = F.struct(F.lit("lit").alias("kind"), lex.alias("lex"), datatype.cast("string").alias("datatype"), lang.cast("string").alias("lang"))
    return Value(F.when(lex.isNotNull(), whole), "term")


def constant(t: Iri | Literal) -> Value:
    """A term of a query. Text with a language, and text of a datatype of its own, is more than its characters."""
    if isinstance(t, Iri):
        return Value(F.lit(t.value), "iri")
    if t.lang or t.datatype not in KIND_OF:
        return a_term(F.lit(t.value), F.lit("langString" if t.lang else t.datatype), F.lit(t.lang))
    kind = KIND_OF[t.datatype]
    if kind == "str":
        return Value(F.lit(t.value), "str")
    return Value(moment(F.lit(t.value)) if kind == "date" else F.lit(t.value).try_cast(SQL_TYPES[kind]), kind)


def fold(text: Column) -> Column:
    """Lower case in which a final sigma is any sigma, so that parts of words compare."""
    return F.translate(F.lower(text), "ς", "σ")


#: The collation of the query at hand.
COLLATION: ContextVar[str | None] = ContextVar("collation", default=None)


def collated(*texts: Column) -> list[Column]:
    """Texts to compare under the query's collation. A final sigma is any sigma."""
    name = COLLATION.get()
    return [F.collate(F.translate(t, "ς", "σ"), name) for t in texts] if name else list(texts)


class Expressions:
    """Compiles expressions over a scope of values; ``exists`` compiles the patterns in them."""

    def __init__(self, scope: dict[str, Value], exists: Callable[[Group], Column] | None = None):
        self.scope, self.exists = scope, exists

    def __call__(self, x) -> Value:
        if isinstance(x, Var):
            return self.scope.get(x.name) or Value(F.lit(None).cast("string"), "str", maybe=True)
        if isinstance(x, (Iri, Literal)):
            return constant(x)
        if x.op == "EXISTS":
            if not self.exists:
                raise SparqlSyntaxError("EXISTS is not accepted here")
            return Value(self.exists(x.args[0]), "bool")
        if x.op == "BOUND":
            return Value(self(x.args[0]).col.isNotNull(), "bool")
        if x.op in ("COALESCE", "IF"):
            return getattr(self, "_" + x.op.lower())(x)
        if x.op in ("IN", "NOT IN"):
            tests = [self(Expr("=", (x.args[0], a))).col for a in x.args[1:]]
            found = tests[0] if tests else F.lit(False)
            for t in tests[1:]:
                found = found | t
            return Value(~found if x.op == "NOT IN" else found, "bool")
        if x.op == "CAST":
            return self._cast(x.args[0].value, self(x.args[1]))
        if x.op == "STR" and len(x.args) == 1 and isinstance(x.args[0], Literal):
            return Value(F.lit(x.args[0].value), "str")  # as it is written
        args = [self(a) for a in x.args]
        if x.op in _OPERATORS:
            return _OPERATORS[x.op](*args)
        if x.op in _FUNCTIONS:
            try:
                return _FUNCTIONS[x.op](*args)
            except TypeError as error:
                raise SparqlSyntaxError(f"{x.op} doesn't take {len(args)} arguments") from error
        raise SparqlSyntaxError(f"unknown function {x.op}")

    def truth(self, x) -> Column:
        return self(x).truth()

    def _coalesce(self, x: Expr) -> Value:
        values = [self(a) for a in x.args]
        kind = values[0]
        for v in values[1:]:
            kind = common(kind, v)
        return Value(F.coalesce(*[into(v, kind) for v in values]), kind.kind, kind.prefix, maybe=all(v.maybe for v in values))

    def _if(self, x: Expr) -> Value:
        test, yes, no = self.truth(x.args[0]), self(x.args[1]), self(x.args[2])
        kind = common(yes, no)
        return Value(F.when(test, into(yes, kind)).when(~test, into(no, kind)), kind.kind, kind.prefix, maybe=True)

    def _cast(self, name: str, v: Value) -> Value:
        if not name.startswith(XSD) or name.removeprefix(XSD) not in KIND_OF:
            raise SparqlSyntaxError(f"unknown function <{name}>")
        kind = KIND_OF[name.removeprefix(XSD)]
        if kind == "str":
            return Value(v.lex(), "str", maybe=True)
        if kind == "date":
            return Value(moment(F.trim(v.lex())), "date", maybe=True)
        if kind == "bool":
            text = F.lower(v.lex())
            made = (v.col != 0) if v.kind in NUMERIC else F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
            return Value(made, "bool", maybe=True)
        if kind == "int" and v.kind in ("dec", "double"):
            return Value(v.col.try_cast("bigint"), "int", maybe=True)
        if kind == "int" and v.kind not in NUMERIC and v.kind != "bool":
            text = F.trim(v.lex())
            return Value(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), "int", maybe=True)
        source = v.col if v.kind in NUMERIC else v.col.cast("int") if v.kind == "bool" else F.trim(v.lex())
        return Value(source.try_cast(SQL_TYPES[kind]), kind, maybe=True)


def common(a: Value, b: Value) -> Value:
    """A value that stands for the kind both can take."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return a if NUMERIC.index(a.kind) >= NUMERIC.index(b.kind) else b
    return alike(a, b)[0]


def into(v: Value, kind: Value) -> Column:
    if kind.kind == "term":
        return v.term()
    if kind.kind == "iri":
        return v.lex()
    return v.col.cast(SQL_TYPES[kind.kind]) if v.kind != kind.kind else v.col


def _text(v: Value) -> Column:
    return v.lex()


def _foreign(term: Column) -> Column:
    return (term["kind"] == "lit") & ~F.coalesce(term["datatype"].isin(*KIND_OF, "langString"), F.lit(True))


def _compare(op: Callable[[Column, Column], Column], same: bool | None = None):
    def run(a: Value, b: Value) -> Value:
        pair = comparable(a, b)
        if pair is None:
            unlike = F.lit(same) if same is not None else F.lit(None).cast("boolean")
            return Value(F.when(a.col.isNotNull() & b.col.isNotNull(), unlike), "bool")
        if same is not None and a.kind == b.kind == "str":
            return Value(op(*collated(a.col, b.col)), "bool")
        if same is not None and "term" in (a.kind, b.kind) and not {a.kind, b.kind} & set(NUMERIC):
            x, y = alike(a, b)  # literals of unknown datatypes are equal if they are one term; else nobody knows
            return Value(F.when(x.col == y.col, not same).when(~_foreign(x.col) & ~_foreign(y.col), same), "bool")
        return Value(op(*pair), "bool")

    return run


def divided(x: Column, y: Column, whole: bool) -> Column:
    """A quotient to 18 places: of numbers without many places it has them all, of others six."""
    part = lambda kind: (x.try_cast(kind), y.try_cast(kind))
    to = "decimal(38,18)"
    if whole:
        return F.try_divide(*part("decimal(20,0)")).cast(to)
    (a, b), (c, d) = part("decimal(20,9)"), part(to)
    return F.when((a == c) & (b == d), F.try_divide(a, b).cast(to)).otherwise(F.try_divide(c, d).try_cast(to))


def _arithmetic(op: str):
    def run(a: Value, b: Value) -> Value:
        x, y = a.number(), b.number()
        kind = "double" if "double" in (a.kind, b.kind) or "term" in (a.kind, b.kind) else "dec" if "dec" in (a.kind, b.kind) or op == "/" else "int"
        if op == "/" and kind == "dec":
            return Value(divided(x, y, a.kind == b.kind == "int"), "dec", maybe=True)
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op](x.cast(SQL_TYPES[kind]), y.cast(SQL_TYPES[kind]))
        return Value(made.cast(SQL_TYPES[kind]), kind, maybe=True)

    return run


def _bool(f):
    return lambda *vs: Value(f(*map(_text, vs)), "bool")


def _string(f):
    return lambda *vs: Value(f(*map(_text, vs)), "str")


def _numeric(f):
    return lambda v: Value(f(v.number()).cast(SQL_TYPES[v.kind if v.kind in NUMERIC else "double"]), v.kind if v.kind in NUMERIC else "double")


def _moment_part(pattern: str, kind: str = "int"):
    """A part of a date as it is written, in its own time zone."""

    def run(v: Value) -> Value:
        text = v.col if v.kind == "date" else moment(v.lex())
        found = F.regexp_extract(text, pattern, 1)
        return Value(F.when(found != "", found).try_cast(SQL_TYPES[kind]), kind, maybe=True)

    return run


_OFFSET = r"(Z|[+-]\d\d:\d\d)$"


def _tz(v: Value) -> Value:
    text = v.col if v.kind == "date" else moment(v.lex())
    return Value(F.regexp_extract(text, "T.*?" + _OFFSET, 1), "str")


def _timezone(v: Value) -> Value:
    """The offset as a duration; without one an error."""
    at = _tz(v).col
    hours, minutes = F.regexp_extract(at, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(at, r":(\d\d)", 1).try_cast("int")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    sign = F.when(F.startswith(at, F.lit("-")), "-PT").otherwise("PT")
    some = F.concat(sign, part(hours, "H"), part(minutes, "M"))
    return Value(F.when(at == "", None).when((at == "Z") | ((hours == 0) & (minutes == 0)), F.lit("PT0S")).otherwise(some), "str", maybe=True)


def _is(*kinds: str):
    def run(v: Value) -> Value:
        if v.kind == "term":
            return Value(v.col["kind"].isin("iri" if "iri" in kinds else "bnode" if "bnode" in kinds else "lit"), "bool")
        return Value(F.when(v.col.isNotNull(), F.lit(v.kind in kinds)), "bool")

    return run


def _is_numeric(v: Value) -> Value:
    return Value(v.number().isNotNull() if v.kind == "term" else F.when(v.col.isNotNull(), F.lit(v.kind in NUMERIC)), "bool")


def _substr(v: Value, start: Value, length: Value | None = None) -> Value:
    """Characters from the rounded start on, which may lie before the first, to start and length together."""
    text, rounded = _text(v), lambda n: F.floor(n.number() + F.lit(0.5)).cast("bigint")
    first = F.greatest(rounded(start), F.lit(1))
    end = rounded(start) + rounded(length) if length is not None else F.length(text) + 1
    return Value(F.when(start.col.isNotNull() & end.isNotNull(), F.substring(text, first.cast("int"), F.greatest(end - first, F.lit(0)).cast("int"))), "str")


def _around(after: bool):
    def run(v: Value, by: Value) -> Value:
        text, part = _text(v), _text(by)
        at = F.call_function("instr", text, part)
        found = F.substring(text, at + F.length(part), F.length(text)) if after else F.substring(text, F.lit(1), at - 1)
        return Value(F.when(at > 0, found).otherwise(F.when(text.isNotNull() & part.isNotNull(), F.lit(""))), "str")

    return run


def _flags(flags: Value | None, pattern: Value) -> Column:
    """A pattern under flags; ``q`` makes it plain text."""
    p = _text(pattern)
    if flags is None:
        return p
    f = _text(flags)
    quoted = F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    body, known = F.when(F.contains(f, F.lit("q")), quoted).otherwise(p), F.regexp_replace(f, "[^imsx]", "")
    return F.when(known != "", F.concat(F.lit("(?"), known, F.lit(")"), body)).otherwise(body)


def _replace(v: Value, pattern: Value, by: Value, flags: Value | None = None) -> Value:
    new = _text(by)
    if flags is not None:
        new = F.when(F.contains(_text(flags), F.lit("q")), F.regexp_replace(new, r"([\\\\$])", r"\\$1")).otherwise(new)
    return Value(F.regexp_replace(_text(v), _flags(flags, pattern), new), "str")


def _encode(v: Value) -> Value:
    out = F.url_encode(_text(v))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return Value(out, "str")


def _lang(v: Value) -> Value:
    return Value(F.when(v.col.isNotNull(), F.coalesce(v.col["lang"], F.lit("")) if v.kind == "term" else F.lit("")), "str")


def _lang_matches(tag: Value, wanted: Value) -> Value:
    t, w = F.lower(_text(tag)), F.lower(_text(wanted))
    return Value(F.when(w == "*", F.length(t) > 0).otherwise((t == w) | F.startswith(t, F.concat(w, F.lit("-")))), "bool")


def _datatype(v: Value) -> Value:
    if v.kind != "term":
        return Value(F.when(v.col.isNotNull(), F.lit(XSD + DATATYPES[v.kind]) if v.kind in DATATYPES else F.lit(None).cast("string")), "iri", maybe=True)
    name = v.col["datatype"]
    return Value(F.when(name == "langString", F.lit(RDF + "langString")).when(F.contains(name, F.lit(":")), name).otherwise(F.concat(F.lit(XSD), name)), "iri", maybe=True)


_OPERATORS = {
    "=": _compare(lambda a, b: a == b, False),
    "!=": _compare(lambda a, b: a != b, True),
    "<": _compare(lambda a, b: a < b),
    "<=": _compare(lambda a, b: a <= b),
    ">": _compare(lambda a, b: a > b),
    ">=": _compare(lambda a, b: a >= b),
    "&&": lambda a, b: Value(a.truth() & b.truth(), "bool"),
    "||": lambda a, b: Value(a.truth() | b.truth(), "bool"),
    "!": lambda a: Value(~a.truth(), "bool"),
    "NEG": lambda a: Value(-a.number(), a.kind if a.kind in NUMERIC else "double"),
    **{op: _arithmetic(op) for op in "+-*/"},
}
_FUNCTIONS = {
    "STR": _string(lambda x: x),
    "STRSTARTS": _bool(lambda a, b: F.startswith(*collated(a, b))),
    "STRENDS": _bool(lambda a, b: F.endswith(*collated(a, b))),
    "CONTAINS": _bool(lambda a, b: F.contains(*(collated(a, b) if COLLATION.get() else (F.translate(a, "ς", "σ"), F.translate(b, "ς", "σ"))))),
    "LCASE": _string(F.lower),
    "UCASE": _string(F.upper),
    "STRLEN": lambda v: Value(F.length(_text(v)).cast("bigint"), "int"),
    "SUBSTR": _substr,
    "STRBEFORE": _around(False),
    "STRAFTER": _around(True),
    "CONCAT": _string(lambda *xs: F.concat(*xs)),
    "REPLACE": _replace,
    "REGEX": lambda v, p, f=None: Value(F.regexp_like(_text(v), _flags(f, p)), "bool"),
    "ENCODE_FOR_URI": _encode,
    "LANG": _lang,
    "LANGMATCHES": _lang_matches,
    "DATATYPE": _datatype,
    "ISIRI": _is("iri", "key"),
    "ISURI": _is("iri", "key"),
    "ISBLANK": _is("bnode"),
    "ISLITERAL": _is("str", "int", "dec", "double", "bool", "date"),
    "ISNUMERIC": _is_numeric,
    "SAMETERM": lambda a, b: Value((lambda p: p[0].col.eqNullSafe(p[1].col))(alike(a, b)) if a.kind == b.kind or "term" in (a.kind, b.kind) or {a.kind, b.kind} <= {"key", "iri"} else F.lit(False), "bool"),
    "IRI": lambda v: Value(v.lex(), "iri"),
    "URI": lambda v: Value(v.lex(), "iri"),
    "BNODE": lambda v=None: Value(F.struct(F.lit("bnode").alias("kind"), (F.concat(F.lit("_:"), F.uuid() if v is None else F.md5(v.lex()))).alias("lex"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")), "term"),
    "STRDT": lambda v, t: a_term(v.lex(), F.replace(t.lex(), F.lit(XSD), F.lit("")), F.lit(None)),
    "STRLANG": lambda v, t: a_term(v.lex(), F.lit("langString"), F.lower(t.lex())),
    "UUID": lambda: Value(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri"),
    "STRUUID": lambda: Value(F.uuid(), "str"),
    "ABS": _numeric(F.abs),
    "CEIL": _numeric(F.ceil),
    "FLOOR": _numeric(F.floor),
    "ROUND": _numeric(lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)"))),
    "RAND": lambda: Value(F.rand(), "double"),
    "NOW": lambda: Value(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "date"),
    "YEAR": _moment_part(r"^(-?\d+)-"),
    "MONTH": _moment_part(r"^-?\d+-(\d\d)"),
    "DAY": _moment_part(r"^-?\d+-\d\d-(\d\d)"),
    "HOURS": _moment_part(r"T(\d\d)"),
    "MINUTES": _moment_part(r"T\d\d:(\d\d)"),
    "SECONDS": _moment_part(r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", "dec"),
    "TZ": _tz,
    "TIMEZONE": _timezone,
    "MD5": _string(F.md5),
    "SHA1": _string(F.sha1),
    "SHA256": _string(lambda x: F.sha2(x, 256)),
    "SHA384": _string(lambda x: F.sha2(x, 384)),
    "SHA512": _string(lambda x: F.sha2(x, 512)),
}
