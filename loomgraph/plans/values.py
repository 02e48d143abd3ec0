"""Columns together with what they stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Kinds of literals with a column type of their own; ``key`` is an instance's number, ``term`` a struct, and
#: ``date`` is as written, so that its offset and fraction stay.
NUMERIC = ("int", "dec", "double")
SQL_TYPES = {"int": "bigint", "dec": "decimal(38,18)", "double": "double", "bool": "boolean", "date": "string", "str": "string", "iri": "string"}
DATATYPES = {"int": "integer", "dec": "decimal", "double": "double", "bool": "boolean", "date": "dateTime", "str": "string"}
KIND_OF = {"integer": "int", "int": "int", "long": "int", "nonNegativeInteger": "int", "decimal": "dec", "double": "double", "float": "double", "boolean": "bool", "dateTime": "date", "date": "date", "string": "str", "langString": "str"}


@dataclass(frozen=True)
class Value:
    """``prefix`` is what a key needs before it to be an IRI."""

    col: Column
    kind: str
    prefix: str = ""
    maybe: bool = False

    def lex(self) -> Column:
        """The lexical form, as in results."""
        if self.kind == "key":
            return F.concat(F.lit(self.prefix), self.col.cast("string"))
        if self.kind == "term":
            return self.col["lex"]
        if self.kind == "dec":  # without the zeros that the column's scale adds
            return F.regexp_replace(self.col.cast("string"), r"\.0*$|(\.\d*[1-9])0+$", "$1")
        return self.col.cast("string")

    def sorting(self) -> Column:
        """What to order by; of terms of several kinds a key that puts them in one order.

        Blank nodes come first, then IRIs, numbers by value, booleans, dates as instants, text, and
        literals of other datatypes. What is equal by value is told apart by what is written.
        """
        if self.kind != "term":
            return self.lex() if self.kind == "key" else self.instant() if self.kind == "date" else self.col
        kind, lex, of = self.col["kind"], self.col["lex"], self.col["datatype"]
        literal = F.when(of.isin("integer", "decimal", "double"), 2).when(of == "boolean", 3).when(of == "dateTime", 4).when(of.isin("string", "langString"), 5).otherwise(6)
        rank = F.when(kind == "bnode", 0).when(kind == "iri", 1).otherwise(literal)
        number = F.when(rank == 2, lex.try_cast("double"))
        exact = F.when(rank == 2, lex.try_cast("decimal(38,18)"))
        at = F.when(rank == 4, lex.try_cast("timestamp"))
        whole = F.struct(rank.alias("rank"), number.alias("number"), exact.alias("exact"), at.alias("at"), lex.alias("lex"), of.alias("of"), self.col["lang"].alias("lang"))
        return F.when(self.col.isNotNull(), whole)

    def instant(self) -> Column:
        return self.col.try_cast("timestamp")

    def term(self) -> Column:
        """The full term, so that values of different kinds can share a column."""
        if self.kind == "term":
            return self.col
        kind = "iri" if self.kind in ("key", "iri") else "lit"
        made = F.struct(F.lit(kind).alias("kind"), self.lex().alias("lex"), F.lit(DATATYPES.get(self.kind)).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
        return F.when(self.col.isNotNull(), made)

    def number(self) -> Column:
        if self.kind in NUMERIC:
            return self.col
        if self.kind == "bool":
            return F.lit(None).cast("double")
        if self.kind == "term":
            return F.when(self.col["datatype"].isin("integer", "decimal", "double"), self.col["lex"].try_cast("double"))
        return F.lit(None).cast("double")

    def truth(self) -> Column:
        """The effective boolean value; null is an error, which a filter drops."""
        if self.kind == "bool":
            return self.col
        if self.kind in NUMERIC:
            return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.kind == "str":
            return F.length(self.col) > 0
        if self.kind == "term":
            lex, kind = self.col["lex"], self.col["datatype"]
            return F.when(kind == "boolean", lex == "true").when(kind.isin("string", "langString"), F.length(lex) > 0).when(kind.isin("integer", "decimal", "double"), lex.try_cast("double") != 0)
        return F.lit(None).cast("boolean")


def alike(a: Value, b: Value) -> tuple[Value, Value]:
    """Both values in one kind, in which equal terms have equal columns."""
    if a.kind == b.kind and (a.kind != "key" or a.prefix == b.prefix):
        return a, b
    if {a.kind, b.kind} <= {"key", "iri"}:
        return Value(a.lex(), "iri", maybe=a.maybe), Value(b.lex(), "iri", maybe=b.maybe)
    return Value(a.term(), "term", maybe=a.maybe), Value(b.term(), "term", maybe=b.maybe)


def comparable(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Columns to compare by value; None if the kinds never compare."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return a.col, b.col
    if "term" in (a.kind, b.kind) and {a.kind, b.kind} & set(NUMERIC):
        return a.number().cast("double"), b.number().cast("double")
    if a.kind == b.kind == "date":
        return a.instant(), b.instant()
    if a.kind == b.kind and a.kind != "key":
        return a.col, b.col
    if {a.kind, b.kind} <= {"key", "iri"} or "term" in (a.kind, b.kind):
        a, b = alike(a, b)
        return a.col, b.col
    return None
