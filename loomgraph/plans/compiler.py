"""From algebra to DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import CLASSES, PROPERTIES, Catalog, Property
from ..operators import concat, paging
from ..operators.closure import TERM, Frontier, Step, checkpoint_dir, closure, connected, reach, reach_pairs
from ..sources.graph import Graph, emptied, merged
from ..sources.statistics import Estimate, join_order
from ..sparql.algebra import Bind, Expr, Filter, Group, Iri, Literal, Minus, Optional, Path, Query, Triple, Union, Values, Var, aggregates, variables
from ..sparql.lexer import SparqlSyntaxError
from ..sparql.parser import TYPE, parse
from .expressions import COLLATION, Expressions, common, constant, divided, into
from .values import KIND_OF, NUMERIC, SQL_TYPES, Value, alike, comparable


@dataclass(frozen=True)
class Rel:
    """Solutions: a DataFrame with a column ``v_<name>`` per variable, and what each holds."""

    df: DataFrame
    vars: dict[str, Value]
    bound: frozenset[frozenset[str]] | None = None  # sets of variables that solutions can have bound, where that is known
    page: Callable[[Callable[[Rel], Rel]], Rel] | None = None  # where sides meet in all pairs: the same of what a function leaves of such sides
    form: Callable[[Callable[[Rel], Rel]], Rel] | None = None  # likewise, of a function that changes only how values are held; kept by filters

    def bound_sets(self, names: list[str]) -> set[frozenset[str]]:
        """Which of some variables that may be unbound can be bound together."""
        if self.bound is not None:
            return {frozenset(s) & frozenset(names) for s in self.bound}
        return {frozenset(n for n, on in zip(names, ons, strict=True) if on) for ons in product((True, False), repeat=len(names))}

    def only(self, names: list[str]) -> Rel:
        return rel(self.df, {n: v for n, v in self.scope().items() if n in names})

    def scope(self) -> dict[str, Value]:
        return {n: replace(v, col=F.col(f"`v_{n}`")) for n, v in self.vars.items()}


def rel(df: DataFrame, values: dict[str, Value]) -> Rel:
    return Rel(df.select(*[v.col.alias(f"v_{n}") for n, v in values.items()]), values) if values else Rel(df.select(F.lit(1).alias("v_")), {})


def _columns(df: DataFrame) -> list[Column]:
    """All columns; names such as ``l_.row`` have a dot that is no field's."""
    return [F.col(f"`{c}`") for c in df.columns]


#: Sets of bound variables that are told apart, per relation.
_MOST_STATES = 64


def _states(a: Rel, b: Rel, optional: bool = False) -> frozenset[frozenset[str]] | None:
    """Which variables a join of two relations can have bound together; None where too many or unknown."""
    sides = []
    for r in (a, b):
        maybe = [n for n, v in r.vars.items() if v.maybe]
        if r.bound is None and len(maybe) > 5:
            return None
        sides.append({s | {n for n in r.vars if n not in maybe} for s in r.bound_sets(maybe)} if maybe or r.vars else {frozenset()})
    both = {frozenset(x | y) for x in sides[0] for y in sides[1]} | ({frozenset(x) for x in sides[0]} if optional else set())
    return frozenset(both) if len(both) <= _MOST_STATES else None


def _kind_of_node(catalog: Catalog, t) -> Value:
    """The kind of a constant end; an instance's IRI is a key."""
    if isinstance(t, Iri) and (prefix := next((catalog.key_prefix(c) for c in CLASSES if re.fullmatch(re.escape(catalog.key_prefix(c)) + r"(0|-?[1-9]\d{0,17})", t.value)), None)):
        return Value(F.lit(None).cast("bigint"), "key", prefix)
    return constant(t)


def _equates(f) -> bool:
    """Whether a filter asks for the equality of two variables, which is a key to join by."""
    if isinstance(f, Expr) and f.op == "&&":
        return any(map(_equates, f.args))
    return isinstance(f, Expr) and f.op == "=" and all(isinstance(x, Var) for x in f.args)


#: Rows that a constant leaves of a property's, and of patterns that aren't estimated.
_CONSTANT, _UNKNOWN = 0.02, 1e4


class Compiler:
    def __init__(self, graph: Graph):
        self.graph, self.catalog, self.spark = graph, graph.catalog, graph.spark
        self.given: dict[str, list] = {}  # constants that VALUES lists for a variable of the pattern at hand
        self.taken: set[str] = set()  # variables whose list became a filter

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("v_")), {})

    # joins
    def _matched(self, a: Rel, b: Rel) -> tuple[DataFrame, DataFrame, Column | None, dict[str, Value]]:
        """Both sides with columns renamed apart, the condition on shared variables, and the joined values."""
        left, right = a.scope(), b.scope()
        shared = [n for n in left if n in right]
        lcols, rcols, values, condition = {}, {}, {}, None
        for n in left.keys() | right.keys():
            if n in shared:
                x, y = alike(left[n], right[n])
                lcols[f"l_{n}"], rcols[f"r_{n}"] = x.col, y.col
                lx, ry = F.col(f"`l_{n}`"), F.col(f"`r_{n}`")
                test = lx == ry
                if x.maybe:
                    test = test | lx.isNull()
                if y.maybe:
                    test = test | ry.isNull()
                condition = test if condition is None else condition & test
                merged = F.coalesce(lx, ry) if x.maybe else lx
                values[n] = replace(x, col=merged, maybe=x.maybe and y.maybe)
            elif n in left:
                lcols[f"l_{n}"] = left[n].col
                values[n] = replace(left[n], col=F.col(f"`l_{n}`"))
            else:
                rcols[f"r_{n}"] = right[n].col
                values[n] = replace(right[n], col=F.col(f"`r_{n}`"))
        order = [*left, *(n for n in right if n not in left)]
        pick = lambda df, cols, mark: df.select(*[c.alias(k) for k, c in cols.items()], F.lit(1).alias(mark))
        return pick(a.df, lcols, "l_"), pick(b.df, rcols, "r_"), condition, {n: values[n] for n in order}

    def join(self, a: Rel, b: Rel) -> Rel:
        if not a.vars and a.df.columns == ["v_"] and not b.vars:
            return rel(a.df.crossJoin(b.df.select(F.lit(1).alias("w"))), {})
        if self._open(a, b):
            sides = [(x, y) for x in self._split(a, b) for y in self._split(b, a)]
            make = lambda first: self._together(a, b, [self._inner(x, y) if set(x.vars) & set(y.vars) else self._inner(first(x), first(y)) for x, y in sides])
            return replace(make(lambda side: side), page=make, form=make)
        left, right, condition, values = self._matched(a, b)
        made = rel(left.join(right, condition, "inner") if condition is not None else left.crossJoin(right), values)
        again = None if condition is not None else lambda first: self.join(first(a), first(b))
        return replace(made, bound=_states(a, b), page=again, form=again)

    # Joins on variables that may be unbound. Solutions of a side are parted by which of them they have
    # bound; two parts then join by equality on what both have. Only parts that share nothing bound meet
    # in pairs, as they should.
    def _open(self, a: Rel, b: Rel) -> list[str]:
        return [n for n in a.vars if n in b.vars and (a.vars[n].maybe or b.vars[n].maybe)]

    def _split(self, r: Rel, other: Rel) -> list[Rel]:
        """The parts of a side; in each, a shared variable is bound in all solutions or is not there."""
        names = [n for n in r.vars if n in other.vars and r.vars[n].maybe]
        if not names:
            return [r]
        out = []
        for on in sorted(r.bound_sets(names), key=sorted, reverse=True):
            test = reduce(lambda x, y: x & y, [F.col(f"`v_{n}`").isNotNull() if n in on else F.col(f"`v_{n}`").isNull() for n in names])
            kept = {n: replace(v, maybe=v.maybe and n not in names) for n, v in r.scope().items() if n not in names or n in on}
            out.append(rel(r.df.filter(test), kept))
        return out

    def _together(self, a: Rel, b: Rel | None, parts: list[Rel]) -> Rel:
        """Parts as one relation with the variables of ``a``, then those of ``b``."""
        sides = [a, b] if b else [a]
        order = list(dict.fromkeys(n for r in sides for n in r.vars))
        out = self.union(parts)
        scope = out.scope()
        maybe = {n: scope[n].maybe and not any(n in r.vars and not r.vars[n].maybe for r in sides[:1]) for n in order if n in scope}
        for n in [n for n in order if n not in scope]:  # bound in no part
            v = next(r.vars[n] for r in sides if n in r.vars)
            scope[n], maybe[n] = replace(v, col=F.lit(None).cast(self._type(v))), True
        return replace(rel(out.df, {n: replace(scope[n], maybe=maybe[n]) for n in order}), bound=_states(a, b) if b else a.bound)

    def _inner(self, a: Rel, b: Rel, filters: list = ()) -> Rel:
        """A join of two parts. Without a shared variable all pairs, dealt over as many tasks as a shuffle has."""
        left, right, condition, values = self._matched(a, b)
        if condition is None:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            left = left.withColumn("w_", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, "w_")
            right = right.withColumn("x_", F.pmod(F.xxhash64(*_columns(right)), F.lit(n)).cast("int")).repartition(n, "x_")
            right = right.hint("merge")  # goes through one buffer of rows; a hash table would look each pair up, and tasks are as many as dealt, however little the sides hold
            condition = F.col("w_") == F.col("x_")
        for f in filters:
            condition = condition & Expressions(values).truth(f)
        return rel(left.join(right, condition, "inner"), values)

    def _hit(self, a: Rel, b: Rel, filters: list, anti: bool) -> Rel:
        """Solutions of a part that have, or (``anti``) have none, in another part that agrees and passes the filters."""
        left, right, condition, values = self._matched(a, b)
        kept = {n: replace(v, col=F.col(f"`l_{n}`"), maybe=a.vars[n].maybe) for n, v in values.items() if n in a.vars}
        how = "left_anti" if anti else "left_semi"
        if condition is None and not filters:  # whether there is any at all
            zero = lambda df: F.pmod(F.xxhash64(*_columns(df)), F.lit(1)).cast("int")  # noqa: E731  no constant, so that the join has a key
            some = right.limit(1)
            return rel(left.withColumn("w_", zero(left)).join(some.select(zero(some).alias("x_")), F.col("w_") == F.col("x_"), how), kept)
        if condition is None and (some := self._decisive(a, b, right, values, filters)) is not None:
            zero = lambda df: F.pmod(F.xxhash64(*_columns(df)), F.lit(1)).cast("int")
            left, some = left.withColumn("w_", zero(left)), F.broadcast(some.withColumn("x_", zero(some)))
            return rel(left.join(some, reduce(lambda x, y: x & y, [Expressions(values).truth(f) for f in filters], F.col("w_") == F.col("x_")), how), kept)
        if condition is None and not any(_equates(f) for f in filters):  # a ledger of the solutions that are matched, by their values
            ledger = self._inner(a, b, filters).df.select(*[F.col(f"`v_{n}`").alias(f"w_{n}") for n in a.vars]).distinct()
            same = reduce(lambda x, y: x & y, [F.col(f"`l_{n}`").eqNullSafe(F.col(f"`w_{n}`")) for n in a.vars])
            left = left.select(*[values[n].col.alias(f"l_{n}") if f"l_{n}" not in left.columns else F.col(f"`l_{n}`") for n in a.vars], "l_")
            return rel(left.join(ledger, same, how), kept)
        for f in filters:
            test = Expressions(values).truth(f)
            condition = test if condition is None else condition & test
        return rel(left.join(right, condition, how), kept)

    @staticmethod
    def _decisive(a: Rel, b: Rel, right: DataFrame, values: dict[str, Value], filters: list) -> DataFrame | None:
        """The one row of the other side that passes the filters with a solution if any row does; None if that may take several.

        Where one test compares the sides by order, it is the least or the greatest of the rows that pass
        the tests of that side alone; where none does, any of them.
        """
        tests, of = [], lambda x: set(variables(x))
        pending = list(filters)
        while pending:
            f = pending.pop()
            if isinstance(f, Expr) and f.op == "&&":
                pending += f.args
            else:
                tests.append(f)
        both = [f for f in tests if of(f) & set(a.vars) and of(f) & set(b.vars)]
        for f in tests:
            if of(f) & set(b.vars) and f not in both:
                right = right.filter(Expressions(values).truth(f))
        if not both:
            return right.limit(1)
        f = both[0]
        if len(both) > 1 or f.op not in ("<", "<=", ">", ">="):
            return None
        ours = [not of(x) & set(a.vars) for x in f.args]
        pair = comparable(*[Expressions(values)(x) for x in f.args])
        if sorted(ours) != [False, True] or any(of(x) & set(b.vars) for x, own in zip(f.args, ours, strict=True) if not own) or pair is None:
            return None
        col = pair[ours.index(True)]
        best = F.min_by if (f.op in ("<", "<=")) == ours[0] else F.max_by
        found = right.filter(col.isNotNull()).agg(best(F.struct(*_columns(right)), col).alias("row"))
        return found.filter("row IS NOT NULL").select("row.*")

    def left_join(self, a: Rel, b: Rel, filters: list) -> Rel:
        """OPTIONAL; its filters are part of the condition."""
        shared = [n for n in a.vars if n in b.vars]
        keyless = not shared and a.vars and b.vars and not any(_equates(f) for f in filters)
        if not (self._open(a, b) or keyless):
            return self._optional(a, b, self._left(a, b, filters))

        def make(first: Callable[[Rel], Rel]) -> Rel:
            parts = []
            for x in self._split(a, b):
                others = self._split(b, a)
                if len(others) == 1 and set(x.vars) & set(others[0].vars):
                    parts.append(self._left(x, others[0], filters))
                    continue
                alone = x
                for y in others:
                    parts.append(self._inner(x, y, filters) if filters or set(x.vars) & set(y.vars) else self._inner(first(x), first(y)))
                    alone = self._hit(alone, y, filters, True)
                parts.append(alone)
            return self._optional(a, b, self._together(a, b, parts))

        return replace(make(lambda side: side), page=make, form=make)

    def _optional(self, a: Rel, b: Rel, made: Rel) -> Rel:
        out = {n: v if n in a.vars and not a.vars[n].maybe else replace(v, maybe=True) for n, v in made.scope().items()}
        return Rel(made.df, out, _states(a, b, optional=True))

    def _left(self, a: Rel, b: Rel, filters: list) -> Rel:
        left, right, condition, values = self._matched(a, b)
        for f in filters:
            test = Expressions(values).truth(f)
            condition = test if condition is None else condition & test
        joined = left.join(right, F.lit(True) if condition is None else condition, "left")
        return rel(joined, {n: v if n in a.vars and not a.vars[n].maybe else replace(v, maybe=True) for n, v in values.items()})

    def semi(self, a: Rel, b: Rel, anti: bool, filters: list = (), apart: bool = False) -> Rel:
        """Solutions of ``a`` that agree with one of ``b`` and pass the filters with it, or (``anti``) with none.

        With ``apart``, solutions that share no bound variable don't count as agreeing.
        """
        parts = []
        for x in self._split(a, b):
            left = x
            for y in self._split(b, a):
                if apart and not set(x.vars) & set(y.vars):
                    continue
                if not anti:
                    parts.append(self._hit(left, y, filters, False))
                left = self._hit(left, y, filters, True)
            if anti:
                parts.append(left)
        if len(parts) == 1 and not self._open(a, b):
            return replace(parts[0], bound=a.bound)
        return self._together(a, None, parts) if parts else Rel(a.df.limit(0), a.vars, a.bound)

    def minus(self, a: Rel, b: Rel) -> Rel:
        """Solutions that agree with one of ``b`` on a variable bound in both go; without any, none does."""
        if not set(a.vars) & set(b.vars):
            return a
        return self.semi(a, b, True, apart=True)

    def union(self, rels: list[Rel]) -> Rel:
        names = list(dict.fromkeys(n for r in rels for n in r.vars))
        out, values = None, {}
        for n in names:
            kinds = [r.scope()[n] for r in rels if n in r.vars]
            values[n] = reduce(lambda x, y: alike(x, y)[0], kinds)
        for r in rels:
            scope = r.scope()
            cols = []
            for n in names:
                kind = values[n]
                blank = F.lit(None).cast(self._type(kind))
                cols.append((into(scope[n], kind) if kind.kind != "key" else scope[n].col).cast(self._type(kind)).alias(f"v_{n}") if n in scope else blank.alias(f"v_{n}"))
            part = r.df.select(*cols) if cols else r.df.select(F.lit(1).alias("v_"))
            out = part if out is None else out.unionByName(part)
        maybe = {n: any(n not in r.vars or r.vars[n].maybe for r in rels) for n in names}
        states = {s for r in rels for s in (r.bound if r.bound is not None else [frozenset(r.vars)] if not any(v.maybe for v in r.vars.values()) else [None])}
        bound = frozenset(states) if None not in states and len(states) <= _MOST_STATES else None
        return Rel(out, {n: replace(v, col=F.col(f"`v_{n}`"), maybe=maybe[n]) for n, v in values.items()}, bound)

    @staticmethod
    def _type(v: Value) -> str:
        return "struct<kind:string,lex:string,datatype:string,lang:string>" if v.kind == "term" else SQL_TYPES.get(v.kind, "bigint")

    # patterns
    def group(self, g: Group) -> Rel:
        filters = [p.expr for p in g.parts if isinstance(p, Filter)]
        current: Rel | None = None
        bgp: list[Triple] = []
        inline: list[Rel | Values] = []

        def flush() -> None:
            nonlocal current, bgp, inline
            if bgp or inline:
                made = self.bgp(bgp, inline)
                current = made if current is None else self.join(current, made)
                bgp, inline = [], []

        for part in g.parts:
            match part:
                case Triple():
                    bgp.append(part)
                case Values():
                    inline.append(part)
                case Filter():
                    pass
                case Optional(inner):
                    flush()
                    inside = [p.expr for p in inner.parts if isinstance(p, Filter) and not self._has_exists(p.expr)]
                    body = Group(tuple(p for p in inner.parts if not (isinstance(p, Filter) and p.expr in inside)))
                    current = self.left_join(current or self.unit(), self.group(body), inside)
                case Minus(inner):
                    flush()
                    current = self.minus(current or self.unit(), self.group(inner))
                case Bind(expr, var):
                    flush()
                    base = current or self.unit()
                    if var.name in base.vars:
                        raise SparqlSyntaxError(f"?{var.name} is bound already")
                    scope = base.scope()
                    current = rel(base.df, scope | {var.name: replace(Expressions(scope)(expr), maybe=True)})
                case Union(groups):
                    flush()
                    made = self.union([self.group(x) for x in groups])
                    current = made if current is None else self.join(current, made)
                case Group() | Query():
                    made = self.group(part) if isinstance(part, Group) else self.select(part)
                    if bgp or current is None:
                        inline.append(made)
                    else:
                        flush()
                        current = self.join(current, made)
        flush()
        current = current or self.unit()
        for f in filters:
            current = self.filter(current, f)
        return current

    def _has_exists(self, x) -> bool:
        return isinstance(x, Expr) and (x.op == "EXISTS" or any(self._has_exists(a) for a in x.args))

    def filter(self, r: Rel, x) -> Rel:
        if isinstance(x, Expr) and x.op == "&&":
            return self.filter(self.filter(r, x.args[0]), x.args[1])
        if isinstance(x, Expr) and x.op == "EXISTS":
            return self._exists(r, x.args[0], False)
        if isinstance(x, Expr) and x.op == "!" and isinstance(x.args[0], Expr) and x.args[0].op == "EXISTS":
            return self._exists(r, x.args[0].args[0], True)
        if self._has_exists(x):  # inside a larger expression: mark rows, test, and drop the marks
            marked, names = [r], []

            def exists(g: Group) -> Column:
                names.append(f".e{len(names)}")
                marked[0] = self._mark(marked[0], g, names[-1])
                return F.col(f"`v_{names[-1]}`")

            condition = Expressions(r.scope(), exists).truth(x)
            scope = marked[0].scope()
            return rel(marked[0].df.filter(condition), {n: v for n, v in scope.items() if n not in names})
        again = r.form and (lambda change: self.filter(r.form(change), x))
        return Rel(r.df.filter(Expressions(r.scope()).truth(x)), r.vars, r.bound, form=again)

    def _mark(self, r: Rel, g: Group, name: str) -> Rel:
        """A column that says of each row whether a pattern has a solution that agrees with it."""
        outer = any(set(variables(p.expr)) - set(variables(g)) for p in g.parts if isinstance(p, Filter))
        inner = self.group(g) if not outer else None
        shared = [n for n in r.vars if inner is not None and n in inner.vars]
        if inner is not None and not any(r.vars[n].maybe or inner.vars[n].maybe for n in shared):
            if not shared:  # one row for all
                found = inner.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
                return rel(r.df.crossJoin(found), r.scope() | {name: Value(F.col("found"), "bool")})
            scope = inner.scope()
            found = rel(inner.df, {n: scope[n] for n in shared}).df.distinct()
            left, right, condition, values = self._matched(r, Rel(found, {n: inner.vars[n] for n in shared}))
            kept = {n: replace(values[n], col=F.col(f"`l_{n}`")) for n in r.vars}
            return rel(left.join(right, condition, "left"), kept | {name: Value(F.col("r_").isNotNull(), "bool")})
        checkpoint_dir(self.spark)  # numbers of rows that are written once and read by both sides
        numbered = rel(r.df, r.scope() | {".row": Value(F.monotonically_increasing_id(), "int")})
        base = Rel(numbered.df.checkpoint(), numbered.vars)
        hit = self._exists(base, g, False)
        found = hit.df.select(F.col("`v_.row`").alias("row")).withColumn("found", F.lit(True))
        df = base.df.join(found, F.col("`v_.row`") == F.col("row"), "left")
        scope = {n: v for n, v in base.scope().items() if n != ".row"}
        return rel(df, scope | {name: Value(F.coalesce("found", F.lit(False)), "bool")})

    def _exists(self, r: Rel, g: Group, anti: bool) -> Rel:
        outer = [p.expr for p in g.parts if isinstance(p, Filter) and set(variables(p.expr)) - set(variables(g))]
        inner = self.group(Group(tuple(p for p in g.parts if not (isinstance(p, Filter) and p.expr in outer))))
        return self.semi(r, inner, anti, outer)

    def values(self, v: Values) -> Rel:
        names = [x.name for x in v.vars]
        columns, kinds = [], {}
        for i, n in enumerate(names):
            cells = [constant(row[i]) for row in v.rows if row[i] is not None]
            kind = reduce(common, cells) if cells else Value(F.lit(None).cast("string"), "str")
            kinds[n] = replace(kind, maybe=any(row[i] is None for row in v.rows))
            columns.append([into(constant(row[i]), kind).cast(self._type(kind)) if row[i] is not None else F.lit(None).cast(self._type(kind)) for row in v.rows])
        rows = F.array(*[F.struct(*[c[k].alias(f"v_{n}") for n, c in zip(names, columns, strict=True)]) for k in range(len(v.rows))])
        if not v.rows:
            empty = self.spark.range(0).select(*[F.lit(None).cast(self._type(kinds[n])).alias(f"v_{n}") for n in names])
            return Rel(empty, {n: replace(kinds[n], col=F.col(f"`v_{n}`")) for n in names})
        df = self.spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
        bound = frozenset(frozenset(n for n, cell in zip(names, row, strict=True) if cell is not None) for row in v.rows)
        return Rel(F.broadcast(df), {n: replace(kinds[n], col=F.col(f"`v_{n}`")) for n in names}, bound if len(bound) <= _MOST_STATES else None)  # as long as the query's text

    # basic graph patterns
    def bgp(self, triples: list[Triple], inline: list[Rel | Values]) -> Rel:
        graphs = {}
        for t in triples:
            graphs.setdefault(t.graph, []).append(t)
        before, rels, self.given, self.taken = (self.given, self.taken), [], {}, set()
        for v in inline:
            if isinstance(v, Values) and len(v.vars) == 1 and v.rows and None not in {r[0] for r in v.rows}:
                self.given.setdefault(v.vars[0].name, [r[0] for r in v.rows])
        for g, some in graphs.items():
            if g is None:
                rels += self._patterns(some)
            elif isinstance(g, Iri):
                named = self.graph.named.get(g.value)
                if named is None:
                    raise SparqlSyntaxError(f"unknown graph <{g.value}>")
                rels.append(self._unknown(Compiler(named).bgp([replace(t, graph=None) for t in some], [])))
            else:
                parts = []
                for name, named in self.graph.named.items():
                    made = Compiler(named).bgp([replace(t, graph=None) for t in some], [])
                    parts.append(rel(made.df, made.scope() | {g.name: Value(F.lit(name), "iri")}))
                if not parts:
                    raise SparqlSyntaxError("there are no named graphs")
                rels.append(self._unknown(self.union(parts)))
        for v in inline:  # a list that filters a scan already needs no join, unless it repeats a solution
            once = isinstance(v, Values) and len(v.vars) == 1 and v.vars[0].name in self.taken and self.given[v.vars[0].name] == [r[0] for r in v.rows] and len(set(v.rows)) == len(v.rows)
            if not once:
                made = self.values(v) if isinstance(v, Values) else v
                rels.append(self._unknown(made, float(len(v.rows)) if isinstance(v, Values) else _UNKNOWN / 10))
        self.given, self.taken = before
        left = [r for _, r in rels]
        for a, b in join_order([e for e, _ in rels]):
            left[a] = self.join(left[a], left[b])
        return left[0]

    @staticmethod
    def _unknown(r: Rel, rows: float = _UNKNOWN) -> tuple[Estimate, Rel]:
        return Estimate(rows, {n: rows for n, v in r.vars.items() if not v.maybe}), r  # what may be unbound is no key yet

    def _classes(self, triples: list[Triple]) -> dict:
        """Classes each node can have, from its types and the domains and ranges of its properties."""
        found: dict = {}

        def narrow(node, classes) -> None:
            found[node] = tuple(c for c in found.get(node, CLASSES) if c in classes)

        for t in triples:
            if t.p == TYPE and isinstance(t.o, Iri):
                narrow(t.s, self.catalog.classes_of(t.o.value) or ())
            elif isinstance(t.p, Iri) and (p := self.catalog.property(t.p.value)):
                narrow(t.s, p.of)
                if p.to:
                    narrow(t.o, (p.to,))
        return found

    def _patterns(self, triples: list[Triple]) -> list[tuple[Estimate, Rel]]:
        """A relation per edge, per subject's literals, and per pattern that needs more; each with its estimate."""
        classes, out = self._classes(triples), []
        literals: dict = {}
        typed: dict = {}
        linked = set()
        for t in triples:
            p = self.catalog.property(t.p.value) if isinstance(t.p, Iri) else None
            if t.p == TYPE and isinstance(t.o, Iri):
                typed.setdefault(t.s, []).append(t.o.value)
            elif isinstance(t.p, Path):
                made = self.path(t)
                out.append(self._unknown(made, _UNKNOWN if len(made.vars) < 2 else 100 * _UNKNOWN))
            elif isinstance(t.p, Var) or t.p == TYPE:
                rows = 4 * sum(self.graph.statistics.rows.values())
                out.append(self._unknown(self.general(t), rows if isinstance(t.s, Var) and isinstance(t.o, Var) else rows * _CONSTANT))
            elif p is None:
                out.append(self._unknown(self._nothing(t), 1e-3))
            elif p.to:
                linked |= {t.s, t.o}
                out.append((self._edge_estimate(t, p), self.edge(t, p)))
            else:
                literals.setdefault(t.s, []).append((t, p))
        for s, some in literals.items():
            out.append((self._star_estimate(s, some, classes[s]), self.star(s, some, classes[s])))
        for s, types in typed.items():
            if not isinstance(s, Iri) and (s in literals or s in linked) and len(classes.get(s, ())) and all(set(classes[s]) <= set(self.catalog.classes_of(x) or ()) for x in types):
                continue  # the tables that are joined hold instances of these classes alone
            out.append((self._star_estimate(s, [], classes[s]), self.star(s, [], classes[s])))
        return out

    def _edge_estimate(self, t: Triple, p: Property) -> Estimate:
        n, sources, targets = self.graph.statistics.edges[p.name]
        rows = n / (1 if isinstance(t.s, Var) else sources) / (1 if isinstance(t.o, Var) else targets)
        return Estimate(rows, {x.name: min(d, max(rows, 1.0)) for x, d in ((t.s, sources), (t.o, targets)) if isinstance(x, Var)})

    def _star_estimate(self, s, some: list[tuple[Triple, Property]], classes: tuple[str, ...]) -> Estimate:
        """All instances of the classes, or what constants, and the constants that VALUES lists, leave of them."""
        rows = 0.0
        for cls in classes:
            each = 1.0 if isinstance(s, Iri) else self.graph.statistics.rows[cls]
            for t, p in some:
                listed = 1 if not isinstance(t.o, Var) else len(self.given.get(t.o.name, ()))
                if listed:
                    each = min(each, float(listed)) if (cls, p.name) in self.graph.codes else max(1.0, each * min(1.0, _CONSTANT * listed))
            rows += each
        return Estimate(rows, {x.name: max(1.0, rows) for x in (s, *(t.o for t, _ in some)) if isinstance(x, Var)})

    def node(self, t, key: Column, cls: str) -> tuple[dict[str, Value], Column | None]:
        """What a pattern's end binds, and the test a constant makes."""
        prefix = self.catalog.key_prefix(cls)
        if isinstance(t, Var):
            return {t.name: Value(key, "key", prefix)}, None
        if isinstance(t, Iri) and t.value.startswith(prefix) and t.value[len(prefix) :].isdigit():
            return {}, key == int(t.value[len(prefix) :])
        return {}, F.lit(False)

    def _bound(self, df: DataFrame, ends: list[tuple[dict[str, Value], Column | None]]) -> Rel:
        """Filter by constants, and by equality where a variable comes twice."""
        values: dict[str, Value] = {}
        for bound, test in ends:
            if test is not None:
                df = df.filter(test)
            for n, v in bound.items():
                if n in values:
                    pair = comparable(values[n], v)
                    df = df.filter(F.lit(False) if pair is None else pair[0] == pair[1])
                else:
                    values[n] = v
        return rel(df, values)

    def edge(self, t: Triple, p: Property) -> Rel:
        df = self.graph.edges[p.name]
        return self._bound(df, [self.node(t.s, F.col("s"), p.of[0]), self.node(t.o, F.col("o"), p.to)])

    def star(self, s, some: list[tuple[Triple, Property]], classes: tuple[str, ...]) -> Rel:
        """All literal properties of one subject: where keys are unique from one read of each class's table."""
        rels = []
        for cls in classes:
            key = self.node(s, F.col("key"), cls)
            if self.graph.unique:
                df, ends = self.graph.tables[cls], [key]
                for t, p in some:
                    ends.append(self._literal(cls, t.o, F.col(p.name), p))
                    df = df.filter(F.col(p.name).isNotNull())
                rels.append(self._bound(df, ends))
            elif not some:
                rels.append(self._bound(self.graph.instances(cls), [key]))
            else:
                each = [self._bound(self.graph.literals(cls, p.name), [key, self._literal(cls, t.o, F.col("value"), p)]) for t, p in some]
                rels.append(reduce(self.join, each))
        if not rels:
            names = [x.name for x in (s, *(t.o for t, _ in some)) if isinstance(x, Var)]
            return rel(self.spark.range(0), {n: Value(F.lit(None).cast("string"), "iri") for n in names})
        return rels[0] if len(rels) == 1 else self.union(rels)

    def _literal(self, cls: str, t, col: Column, p: Property) -> tuple[dict[str, Value], Column | None]:
        """What a pattern's object binds, and the test that a constant, or the constants that VALUES lists, make."""
        if isinstance(t, Var):
            if t.name not in self.given:
                return {t.name: Value(col, p.kind)}, None
            self.taken.add(t.name)
            return {t.name: Value(col, p.kind)}, self._among(cls, self.given[t.name], col, p)
        return {}, self._among(cls, [t], col, p)

    def _among(self, cls: str, terms: list, col: Column, p: Property) -> Column:
        """Whether a property is one of some constants; a term of another kind is another term."""
        texts = [t.value for t in terms if isinstance(t, Literal) and not t.lang and KIND_OF.get(t.datatype) == p.kind]
        if (cls, p.name) in self.graph.codes:  # the text of a key: the key itself reaches the scan
            col, wanted = F.col("key"), [int(x) for x in texts if re.fullmatch(r"0|-?[1-9]\d{0,17}", x)]
        else:
            wanted = texts if p.kind == "str" else [int(x) for x in texts if re.fullmatch(r"[+-]?\d{1,18}", x)]
        return F.lit(False) if not wanted else col == wanted[0] if len(wanted) == 1 else col.isin(*wanted)

    def _nothing(self, t: Triple) -> Rel:
        """A pattern with a predicate that the catalog doesn't know: no triple has it."""
        values = {x.name: Value(F.lit(None).cast("string"), "iri") for x in (t.s, t.o) if isinstance(x, Var)}
        return rel(self.spark.range(0), values)

    def general(self, t: Triple) -> Rel:
        """A pattern whose predicate or type is open, over types or all triples."""
        if t.p == TYPE:
            df = self.graph.types
            return self._bound(df, [self._iri(t.s, F.col("s")), self._iri(t.o, F.col("o"))])
        df = self.graph.triples
        ends = [self._iri(t.s, F.col("s")), self._iri(t.p, F.col("p"))]
        if isinstance(t.o, Var):
            ends.append(({t.o.name: Value(F.col("o"), "term")}, None))
        else:
            wanted = constant(t.o)
            ends.append(({}, (F.col("o.lex") == wanted.lex()) & (F.col("o.kind") == ("iri" if isinstance(t.o, Iri) else "lit")) & F.coalesce(F.col("o.datatype") == F.lit(None if isinstance(t.o, Iri) else t.o.datatype), F.lit(isinstance(t.o, Iri)))))
        return self._bound(df, ends)

    @staticmethod
    def _iri(t, col: Column) -> tuple[dict[str, Value], Column | None]:
        if isinstance(t, Var):
            return {t.name: Value(col, "iri")}, None
        return {}, col == t.value if isinstance(t, Iri) else F.lit(False)

    # property paths
    def path(self, t: Triple) -> Rel:
        p = t.p
        if p.op in ("star", "plus", "opt"):
            return self._repeated(t, p)
        if p.op == "seq" and not (isinstance(t.s, Var) and isinstance(t.o, Var)):
            return self._sequence(t, list(p.parts))
        if p.op == "inv" and isinstance(p.parts[0], Path):
            return self.path(Triple(t.o, p.parts[0], t.s))
        return self._ends(self.steps(p), t.s, t.o)

    def _sequence(self, t: Triple, parts: list) -> Rel:
        """A sequence from its constant end, so that each part begins at what the part before has found."""
        if isinstance(t.s, Var):
            return self._sequence(Triple(t.o, None, t.s), [x.parts[0] if isinstance(x, Path) and x.op == "inv" else Path("inv", (x,)) for x in reversed(parts)])
        current = self.bgp([Triple(t.s, parts[0], Var(".o"))], [])
        for x in parts[1:]:
            turned = isinstance(x, Path) and x.op == "inv" and isinstance(x.parts[0], Path) and x.parts[0].op in ("star", "plus", "opt")
            if turned or isinstance(x, Path) and x.op in ("star", "plus", "opt"):
                found = self._reached(current.scope()[".o"], current.df, x.parts[0] if turned else x, turned)
            else:
                found = self.steps(x)
            left, scope = rel(current.df, {".m": current.scope()[".o"]}), found.scope()
            joined = self.join(left, rel(found.df, {".m": scope[".s"], ".o": scope[".o"]}))
            current = rel(joined.df, {".o": joined.scope()[".o"]})
        scope = current.scope()
        return self._ends(rel(current.df, {".s": Value(F.lit(None).cast("string"), "iri"), ".o": scope[".o"]}), Var(".s"), t.o).only([t.o.name] if isinstance(t.o, Var) else [])

    def _reached(self, start: Value, df: DataFrame, p: Path, turned: bool) -> Rel:
        """Pairs ``.s, .o`` of a repeated path from the nodes of a column alone."""
        a, b = (".o", ".s") if turned else (".s", ".o")
        parts = [(r, r.scope()) for r in self._parts(p.parts[0])]
        seeds = df.select(self._as_node(start).alias("node")).distinct()
        if p.op == "opt":
            pairs = reduce(DataFrame.union, [x.df.select("s", "o") for x in self._steps(parts, a, b)]).join(seeds.select(F.col("node").alias("s")), "s", "left_semi")
        else:
            pairs = reach_pairs(self._steps(parts, a, b), seeds)
        kinds = [scope[b] for _, scope in parts]
        if p.op != "plus":
            pairs, kinds = pairs.union(seeds.select("node", "node")).distinct(), [*kinds, start]
        return rel(pairs.distinct(), {".s": self._of_node(F.col("s"), [start]), ".o": self._of_node(F.col("o"), kinds)})

    def steps(self, p) -> Rel:
        """Pairs ``.s, .o`` of a path, as often as there are ways."""
        s, o = Var(".s"), Var(".o")
        if isinstance(p, Iri):
            return self.bgp([Triple(s, p, o)], [])
        if p.op == "inv":
            made = self.steps(p.parts[0])
            inner = made.scope()
            return rel(made.df, {".s": inner[".o"], ".o": inner[".s"]})
        if p.op == "alt":
            return self.union([self.steps(x) for x in p.parts])
        if p.op == "seq":
            current = self.steps(p.parts[0])
            for i, x in enumerate(p.parts[1:]):
                scope = current.scope()
                left = rel(current.df, {".s": scope[".s"], f".m{i}": scope[".o"]})
                nxt = self.steps(x)
                scope = nxt.scope()
                joined = self.join(left, rel(nxt.df, {f".m{i}": scope[".s"], ".o": scope[".o"]}))
                scope = joined.scope()
                current = rel(joined.df, {".s": scope[".s"], ".o": scope[".o"]})
            return current
        if p.op == "not":
            ahead = [x.value for x in p.parts if isinstance(x, Iri)]
            back = [x.parts[0].value for x in p.parts if isinstance(x, Path)]
            rels, triples = [], self.graph.triples
            if ahead:
                rels.append(rel(triples.filter(~F.col("p").isin(*ahead)), {".s": Value(F.col("s"), "iri"), ".o": Value(F.col("o"), "term")}))
            if back:
                turned = triples.filter(~F.col("p").isin(*back))
                rels.append(rel(turned, {".s": Value(F.col("o"), "term"), ".o": Value(F.col("s"), "iri")}))
            return rels[0] if len(rels) == 1 else self.union(rels)
        return self._repeated(Triple(s, p, o), p)

    def _ends(self, pairs: Rel, s, o) -> Rel:
        scope = pairs.scope()
        df, values = pairs.df, {}
        for t, v in ((s, scope[".s"]), (o, scope[".o"])):
            if isinstance(t, Var):
                if t.name in values:
                    pair = comparable(values[t.name], v)
                    df = df.filter(F.lit(False) if pair is None else pair[0] == pair[1])
                else:
                    values[t.name] = v
            else:
                number = t.value[len(v.prefix) :] if v.kind == "key" and isinstance(t, Iri) and t.value.startswith(v.prefix) else ""
                pair = (v.col, F.lit(int(number))) if number.isdigit() else comparable(v, constant(t))
                df = df.filter(F.lit(False) if pair is None else pair[0] == pair[1])
        return rel(df, values)

    def _parts(self, p) -> list[Rel]:
        """Pairs ``.s, .o`` of a path in parts, so that the ends of each are of one kind where possible."""
        s, o = Var(".s"), Var(".o")
        if isinstance(p, Iri):
            literal = self.catalog.property(p.value)
            if literal and not literal.to:
                return [self.star(s, [(Triple(s, p, o), literal)], (cls,)) for cls in literal.of]
        elif p.op == "inv":
            return [rel(r.df, {".s": r.scope()[".o"], ".o": r.scope()[".s"]}) for r in self._parts(p.parts[0])]
        elif p.op == "alt":
            return [r for x in p.parts for r in self._parts(x)]
        return [self.steps(p)]

    def _as_node(self, v: Value) -> Column:
        """A value as a node; an instance's IRI becomes its number, whatever kind it comes in."""
        made = lambda c, k, t: F.struct(c.alias("c"), k.cast("bigint").alias("k"), t.alias("t"))
        no_text, no_number, no_term = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast(TERM)
        if v.kind == "key":
            return made(F.lit(v.prefix), v.col, no_term)
        if v.kind not in ("iri", "term"):
            return made(no_text, no_number, v.term())
        prefixes = "|".join(re.escape(self.catalog.key_prefix(c)) for c in CLASSES)
        pattern = rf"^({prefixes})(0|-?[1-9][0-9]{{0,17}})$"
        term = v.term()
        lex = F.when(term["kind"] == "iri", term["lex"])
        instance = made(F.regexp_extract(lex, pattern, 1), F.regexp_extract(lex, pattern, 2).try_cast("bigint"), no_term)
        return F.when(F.coalesce(lex.rlike(pattern), F.lit(False)), instance).otherwise(made(no_text, no_number, term))

    def _of_node(self, node: Column, kinds: list[Value]) -> Value:
        """A node as a value of the narrowest kind that holds what kinds of ends it can have."""
        if all(v.kind == "key" and v.prefix == kinds[0].prefix for v in kinds):
            return Value(node["k"], "key", kinds[0].prefix)
        iri = F.concat(node["c"], node["k"].cast("string"))
        if all(v.kind in ("key", "iri") for v in kinds):
            return Value(F.coalesce(iri, node["t"]["lex"]), "iri")
        return Value(F.when(node["c"].isNotNull(), Value(iri, "iri").term()).otherwise(node["t"]), "term")

    def _steps(self, parts: list[tuple[Rel, dict[str, Value]]], a: str, b: str) -> list[Step]:
        """Parts of a path as steps from one of their ends to the other."""
        out = []
        for r, scope in parts:
            key = scope[a].kind == "key"
            df = r.df.select(self._as_node(scope[a]).alias("s"), self._as_node(scope[b]).alias("o"), *([scope[a].col.alias("key")] if key else []))
            out.append(Step(df, scope[a].prefix, F.col("key")) if key else Step(df))
        return out

    def _nodes(self) -> DataFrame:
        """``s``: every subject and object of the graph as a node."""
        parts = [self.graph.instances(c).select(self._as_node(Value(F.col("key"), "key", self.catalog.key_prefix(c))).alias("s")) for c in CLASSES]
        types = F.explode(F.array(*[F.lit(t) for c in CLASSES for t in self.catalog.types_of(c)]))
        parts.append(self.spark.range(1).select(types.alias("x")).select(self._as_node(Value(F.col("x"), "iri")).alias("s")))
        for p in PROPERTIES:
            for cls in p.of if not p.to else ():
                parts.append(self.graph.literals(cls, p.name).select(self._as_node(Value(F.col("value"), p.kind)).alias("s")))
            if p.to:
                parts += [self.graph.edges[p.name].select(self._as_node(Value(F.col(e), "key", self.catalog.key_prefix(c))).alias("s")) for e, c in (("s", p.of[0]), ("o", p.to))]
        return reduce(DataFrame.union, parts).distinct()

    def _repeated(self, t: Triple, p: Path) -> Rel:
        """``*``, ``+`` and ``?``: a set of pairs, with every node beside itself for ``*`` and ``?``.

        Followed from a constant end where there is one, from both where both are.
        """
        parts = [(r, r.scope()) for r in self._parts(p.parts[0])]

        steps = lambda a, b: self._steps(parts, a, b)
        fixed = [x for x in (t.s, t.o) if not isinstance(x, Var)]
        one = lambda x: self.spark.range(1).select(self._as_node(constant(x)).alias("node"))
        if len(fixed) == 2:
            same = p.op != "plus" and one(t.s).join(one(t.o), "node", "left_semi").count() > 0
            if p.op == "opt":
                near = [m for step in steps(".s", ".o") if (m := step.among(Frontier(self.spark, [one(t.s).first()["node"]], size=1))) is not None]
                found = same or any(not m.join(one(t.o), "node", "left_semi").isEmpty() for m in near)
            else:
                found = same or connected(steps(".s", ".o"), steps(".o", ".s"), one(t.s), one(t.o))
            return Rel(self.spark.range(1 if found else 0).select(F.lit(1).alias("v_")), {})
        if fixed:
            a, b = (".s", ".o") if t.s is fixed[0] else (".o", ".s")
            if p.op == "opt":
                start = Frontier(self.spark, [one(fixed[0]).first()["node"]], size=1)
                made = [m for step in steps(a, b) if (m := step.among(start)) is not None]
                nodes = reduce(DataFrame.union, made, one(fixed[0])).distinct()
            else:
                nodes = reach(steps(a, b), one(fixed[0]))
                nodes = nodes if p.op == "plus" else nodes.union(one(fixed[0])).distinct()
            kinds = [scope[b] for _, scope in parts] + ([_kind_of_node(self.catalog, fixed[0])] if p.op != "plus" else [])
            free = t.o if a == ".s" else t.s
            return rel(nodes, {free.name: self._of_node(F.col("node"), kinds)})
        edges = reduce(DataFrame.union, [s.df.select("s", "o") for s in steps(".s", ".o")])
        out = edges if p.op == "opt" else closure(edges)
        kinds = {x: [scope[x] for _, scope in parts] for x in (".s", ".o")}
        if p.op != "plus":
            nodes = self._nodes()
            out = out.union(nodes.select("s", F.col("s").alias("o")))
            kinds = {x: [Value(F.lit(None), "term")] for x in kinds}
        out = out.distinct()
        return self._ends(rel(out, {x: self._of_node(F.col(x[1:]), kinds[x]) for x in (".s", ".o")}), t.s, t.o)

    # queries
    @staticmethod
    def _foremost(current: Rel, q: Query) -> Rel:
        """What the first rows of an order by variables need, where sides meet in all pairs.

        A side's row that follows ``n`` others of its side in the order of that side's own variables
        makes only pairs that follow ``n`` others, so the first ``n`` of each side are enough.
        """
        if not current.page or q.limit is None or not q.order_by or not all(isinstance(e, Var) and e.name in current.vars for e, _ in q.order_by):
            return current

        def first(side: Rel) -> Rel:
            scope, order = side.scope(), []
            for e, down in q.order_by:
                if (v := scope.get(e.name)) is not None:
                    if (v.kind, v.prefix) != (current.vars[e.name].kind, current.vars[e.name].prefix):
                        return side
                    order.append(v.sorting().desc_nulls_last() if down else v.sorting().asc_nulls_first())
            df = side.df.orderBy(*order) if order else side.df
            return replace(side, df=df.limit(q.limit + (q.offset or 0)), page=None)

        return current.page(first)

    @staticmethod
    def _written(current: Rel, q: Query, items: list) -> Rel:
        """Where sides meet in all pairs, IRIs that the result shows are built once per row of a side, not per pair."""
        if not current.form or q.order_by or not all(isinstance(i, Var) for i in items):
            return current
        shown = {i.name for i in items}
        iri = lambda n, v: replace(v, col=v.lex(), kind="iri", prefix="") if v.kind == "key" and n in shown else v
        return current.form(lambda side: rel(side.df, {n: iri(n, v) for n, v in side.scope().items()}))

    def _aggregate(self, x: Expr, scope: dict[str, Value]) -> Value:
        inner = Expressions(scope)(x.args[0]) if x.args else None
        if x.op == "COUNT":
            if inner is None:
                whole = F.struct(*[v.col for v in scope.values()]) if scope else F.lit(1)
                return Value(F.countDistinct(whole) if x.distinct else F.count(F.lit(1)), "int")
            return Value(F.countDistinct(inner.col) if x.distinct else F.count(inner.col), "int")
        if x.op in ("SUM", "AVG"):
            kind, col = (inner.kind if inner.kind in NUMERIC else "double"), inner.number()
            total, n = (F.sum_distinct if x.distinct else F.sum)(col), F.countDistinct(col) if x.distinct else F.count(col)
            if x.op == "AVG":
                total = F.try_divide(total, n) if kind == "double" else divided(total, n, kind == "int")
                kind = "dec" if kind == "int" else kind
            return Value(F.coalesce(total.cast(SQL_TYPES[kind]), F.lit(0).cast(SQL_TYPES[kind])), kind)
        if x.op in ("MIN", "MAX", "SAMPLE"):
            if inner.kind in ("date", "term", "key") and x.op != "SAMPLE":  # by value, or in the order of terms
                return replace(inner, col=(F.max_by if x.op == "MAX" else F.min_by)(inner.col, F.when(inner.col.isNotNull(), inner.sorting())), maybe=True)
            return replace(inner, col=(F.max if x.op == "MAX" else F.min)(inner.col), maybe=True)
        text = inner.lex()
        every = F.collect_set(text) if x.distinct else F.collect_list(text)
        return Value(F.array_join(F.array_sort(every), x.separator), "str")  # sorted, so reruns agree

    def _large(self) -> bool:
        return max([n for n, _, _ in self.graph.statistics.edges.values()], default=0) >= concat.MANY

    def _joined_texts(self, df: DataFrame, current: Rel, keys: dict[str, Value], x: Expr) -> DataFrame:
        """Groups ``df`` with a column ``joined``: the texts of each, '' where it has none."""
        text = Expressions(current.scope())(x.args[0]).lex()
        own = [(f"k{k}_", v.col, F.col(f"`v_{n}`")) for k, (n, v) in enumerate(keys.items())] or [("k0_", F.lit(0), F.lit(0))]
        rows = current.df.select(*[col.alias(k) for k, col, _ in own], text.alias("text_"))
        texts = concat.concat_in_ranges(rows, [k for k, _, _ in own], "text_", x.separator, distinct=x.distinct)
        same = reduce(lambda a, b: a & b, [group.eqNullSafe(texts[k]) for k, _, group in own])
        return df.join(texts, same, "left").drop(*[k for k, _, _ in own]).withColumn("joined", F.coalesce("joined", F.lit("")))

    def select(self, q: Query) -> Rel:
        current = self.group(q.where)
        if q.values:
            current = self.join(current, self.values(q.values))
        items = list(q.items) or [Var(n) for n in variables(q.where) if not n.startswith(".")] if q.form == "SELECT" else [Var(n) for n in variables(q.where)]
        found = [a for i in items if not isinstance(i, Var) for a in aggregates(i[0])] + [a for h in q.having for a in aggregates(h)] + [a for e, _ in q.order_by for a in aggregates(e)]
        if q.group_by or found:
            scope = current.scope()
            keys, named = {}, {}
            for k, (expr, var) in enumerate(q.group_by):
                name = var.name if var else f".g{k}"
                keys[name] = Expressions(scope)(expr)
                named[expr] = name
            made = {f".a{k}": self._aggregate(a, scope) for k, a in enumerate(dict.fromkeys(found))}
            apart = {f".a{k}": a for k, a in enumerate(dict.fromkeys(found)) if a.op == "GROUP_CONCAT"} if self._large() else {}
            spots = {a: Var(f".a{k}") for k, a in enumerate(dict.fromkeys(found))} | {e: Var(n) for e, n in named.items() if not isinstance(e, Var)}
            grouped = current.df.groupBy(*[v.col.alias(f"v_{n}") for n, v in keys.items()]) if keys else current.df.groupBy()
            whole = [v.col.alias(f"v_{n}") for n, v in made.items() if n not in apart]
            df = grouped.agg(*whole) if whole else grouped.agg(F.lit(1).alias("v_")).drop(*["v_"] if keys else [])
            for n, a in apart.items():
                df = self._joined_texts(df, current, keys, a).withColumnRenamed("joined", f"v_{n}")
            current = Rel(df, {n: replace(v, col=F.col(f"`v_{n}`")) for n, v in (keys | made).items()})
            swap = lambda x: spots.get(x) or (replace(x, args=tuple(map(swap, x.args))) if isinstance(x, Expr) and x.op != "EXISTS" else x)
        else:
            swap = lambda x: x
            if not (q.distinct or q.having or any(not isinstance(i, Var) and Var(i[1].name) in [e for e, _ in q.order_by] for i in items)):
                current = self._written(self._foremost(current, q), q, items)
        for h in q.having:
            current = self.filter(current, swap(h))
        scope = current.scope()
        projected = {}
        for i in items:
            name, expr = (i.name, i) if isinstance(i, Var) else (i[1].name, swap(i[0]))
            projected[name] = Expressions(scope | projected)(expr)
        order = []
        for expr, down in q.order_by:
            v = Expressions(scope | projected)(swap(expr))
            col = v.sorting()
            order.append(col.desc_nulls_last() if down else col.asc_nulls_first())
        df = current.df
        first = Expressions(scope | projected)(swap(q.order_by[0][0])) if order else None
        if q.offset >= paging.DEEP and not q.distinct and first.kind not in ("term", "bool"):  # by ranges of what is ordered by first
            page = paging.deep_page(df, first.sorting(), q.order_by[0][1], order, q.offset, q.limit)
            out = rel(page, projected)
            return Rel(out.df, {n: replace(v, col=F.col(f"`v_{n}`")) for n, v in projected.items()})
        if q.distinct:
            out = rel(df, projected)
            shown = out.scope()
            df = out.df.distinct()
            if order:
                order = []
                for expr, down in q.order_by:
                    v = Expressions(shown)(swap(expr))
                    col = v.sorting()
                    order.append(col.desc_nulls_last() if down else col.asc_nulls_first())
                df = df.orderBy(*order)
            out = Rel(df, {n: replace(v, col=F.col(f"`v_{n}`")) for n, v in projected.items()})
        else:
            out = rel(df.orderBy(*order) if order else df, projected)
            out = Rel(out.df, {n: replace(v, col=F.col(f"`v_{n}`")) for n, v in projected.items()})
        df = out.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df, out.vars)

    def run(self, q: Query, *, as_text: bool = False) -> DataFrame:
        if q.graphs:
            default = [iri for iri, named in q.graphs if not named]
            missing = [iri for iri, _ in q.graphs if iri not in self.graph.named]
            if missing:
                raise SparqlSyntaxError(f"unknown graph <{missing[0]}>")
            named = {iri: self.graph.named[iri] for iri, n in q.graphs if n}
            base = merged([self.graph.named[iri] for iri in dict.fromkeys(default)]) if default else emptied(self.graph)
            own = Graph(base.spark, base.tables, base.edges, base.catalog, named, unique=base.unique, codes=base.codes)
            return Compiler(own).run(replace(q, graphs=()), as_text=as_text)
        if q.form == "SELECT":
            made = self.select(q)
            return made.df.select(*[v.lex().alias(n) if as_text or v.kind in ("key", "term") else v.col.alias(n) for n, v in made.scope().items()])
        if q.form == "ASK":
            return self.group(q.where).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if q.form == "CONSTRUCT":
            made = self.group(q.where) if not (q.limit or q.offset or q.order_by) else self.select(replace(q, form="SELECT", items=()))
            scope = made.scope()
            text = lambda t: scope[t.name].lex() if isinstance(t, Var) and t.name in scope else F.concat(F.lit("_:" + t.name), F.monotonically_increasing_id().cast("string")) if isinstance(t, Var) else F.lit(t.value)
            rows = F.explode(F.array(*[F.struct(text(t.s).alias("s"), text(t.p).alias("p"), text(t.o).alias("o")) for t in q.template]))
            return made.df.select(rows.alias("t")).select("t.*").dropna().distinct()
        triples = self.graph.triples.select("s", "p", F.col("o.lex").alias("o"))
        fixed = [i.value for i in q.items if isinstance(i, Iri)]
        wanted = self.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in fixed]).cast("array<string>")).alias("s"))
        if names := [i for i in q.items if isinstance(i, Var)]:
            made = self.select(replace(q, form="SELECT", items=tuple(names), distinct=True))
            for n, v in made.scope().items():
                wanted = wanted.union(made.df.select(v.lex().alias("s")))
        return triples.join(wanted.distinct(), "s", "left_semi").distinct()


def query(graph: Graph, text: str, *, as_text: bool = False) -> DataFrame:
    """The answer to a SPARQL query, lazily; with ``as_text`` every cell is its lexical form."""
    own = COLLATION.set(graph.catalog.collation)
    try:
        return Compiler(graph).run(parse(text, graph.catalog.prefixes | {"": graph.catalog.namespace}), as_text=as_text)
    finally:
        COLLATION.reset(own)
