"""Recursive descent over SPARQL 1.1 queries."""

from __future__ import annotations

from urllib.parse import urljoin

from .algebra import AGGREGATES, Bind, Expr, Filter, Group, Iri, Literal, Minus, Optional, Path, Query, Triple, Union, Values, Var
from .check import check
from .lexer import SparqlSyntaxError, Token, tokens, unquote

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = Iri(RDF + "type")
_UPDATES = frozenset(("INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD", "WITH"))
_COMPARE = ("=", "!=", "<", "<=", ">", ">=")


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.toks, self.i = tokens(text), 0
        self.prefixes, self.base, self.blanks = dict(prefixes or {}), "", 0

    # tokens
    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def fail(self, wanted: str):
        raise SparqlSyntaxError(f"expected {wanted}, found {self.tok.text or 'the end'!r} at {self.tok.at}")

    def next(self) -> Token:
        self.i += 1
        return self.toks[self.i - 1]

    def word(self, *words: str) -> str | None:
        """Take a keyword if it comes next."""
        if self.tok.kind == "word" and self.tok.text.upper() in words:
            return self.next().text.upper()
        return None

    def op(self, *ops: str) -> str | None:
        if self.tok.kind == "op" and self.tok.text in ops:
            return self.next().text
        return None

    def need(self, what: str) -> None:
        if not (self.op(what) or self.word(what)):
            self.fail(repr(what))

    # terms
    def iri(self) -> Iri | None:
        if self.tok.kind == "iri":
            return Iri(urljoin(self.base, self.next().text[1:-1]) if self.base else self.next().text[1:-1])
        if self.tok.kind == "pname":
            prefix, _, local = self.tok.text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlSyntaxError(f"unknown prefix {prefix!r} at {self.tok.at}")
            self.next()
            return Iri(self.prefixes[prefix] + local)
        return None

    def var(self) -> Var | None:
        return Var(self.next().text[1:]) if self.tok.kind == "var" else None

    def literal(self) -> Literal | None:
        if self.tok.kind == "string":
            value = unquote(self.next().text)
            if self.tok.kind == "lang":
                return Literal(value, "langString", self.next().text[1:].lower())
            if self.op("^^"):
                kind = (self.iri() or self.fail("a datatype")).value
                return Literal(value, kind.removeprefix(XSD) if kind.startswith(XSD) else kind)
            return Literal(value)
        sign = ""
        if self.tok.kind == "op" and self.tok.text in "+-" and self.toks[self.i + 1].kind == "number":
            sign = self.next().text.replace("+", "")
        if self.tok.kind == "number":
            text = self.next().text
            kind = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return Literal(sign + text, kind)
        if found := self.word("TRUE", "FALSE"):
            return Literal(found.lower(), "boolean")
        return None

    def blank(self) -> Var:
        self.blanks += 1
        return Var(f".b{self.blanks}")

    def term(self, out: list, graph) -> Var | Iri | Literal:
        if self.tok.kind == "blank":
            return Var("." + self.next().text[2:])
        if self.op("["):
            node = self.blank()
            if not self.op("]"):
                self.properties(node, out, graph)
                self.need("]")
            return node
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.term(out, graph))
            nodes = [self.blank() for _ in items]
            for i, item in enumerate(items):
                out.append(Triple(nodes[i], Iri(RDF + "first"), item, graph))
                out.append(Triple(nodes[i], Iri(RDF + "rest"), nodes[i + 1] if i + 1 < len(nodes) else Iri(RDF + "nil"), graph))
            return nodes[0] if nodes else Iri(RDF + "nil")
        return self.var() or self.iri() or self.literal() or self.fail("a term")

    # queries
    def query(self, top: bool = True) -> Query:
        if top:
            while found := self.word("PREFIX", "BASE"):
                if found == "BASE":
                    self.base = (self.iri() or self.fail("an IRI")).value
                    continue
                if self.tok.kind != "pname" or not self.tok.text.endswith(":"):
                    self.fail("a prefix")
                name = self.next().text[:-1]
                self.prefixes[name] = (self.iri() or self.fail("an IRI")).value
            if self.tok.kind == "word" and self.tok.text.upper() in _UPDATES:
                raise SparqlSyntaxError(f"updates are not accepted: {self.tok.text}")
        form = self.word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE") if top else self.word("SELECT")
        if not form:
            self.fail("SELECT, ASK, CONSTRUCT or DESCRIBE")
        items, distinct, template = [], False, []
        if form == "SELECT":
            distinct = bool(self.word("DISTINCT", "REDUCED"))
            if not self.op("*"):
                while True:
                    if v := self.var():
                        items.append(v)
                    elif self.op("("):
                        expr = self.expr()
                        self.need("AS")
                        items.append((expr, self.var() or self.fail("a variable")))
                        self.need(")")
                    else:
                        break
                if not items:
                    self.fail("a variable or '*'")
        elif form == "CONSTRUCT" and self.op("{"):
            while not self.op("}"):
                self.triples(template, None)
                self.op(".")
        elif form == "DESCRIBE":
            while t := (self.var() or self.iri()):
                items.append(t)
            self.op("*")
        graphs = []
        while self.word("FROM"):
            named = bool(self.word("NAMED"))
            graphs.append(((self.iri() or self.fail("an IRI")).value, named))
        where = Group(())
        if self.word("WHERE") or self.tok.text == "{":
            where = self.group()
        elif form != "DESCRIBE":
            self.fail("'{'")
        if form == "CONSTRUCT" and not template:
            template = [p for p in where.parts if isinstance(p, Triple)]
        group_by, having, order_by = [], [], []
        if self.word("GROUP"):
            self.need("BY")
            while True:
                if self.op("("):
                    expr = self.expr()
                    group_by.append((expr, self.var() or self.fail("a variable")) if self.word("AS") else (expr, None))
                    self.need(")")
                elif v := self.var():
                    group_by.append((v, v))
                elif self.tok.kind in ("word", "iri", "pname") and self.tok.text.upper() not in ("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    group_by.append((self.primary(), None))
                else:
                    break
            if not group_by:
                self.fail("what to group by")
        if self.word("HAVING"):
            while self.tok.text == "(" or self.tok.kind in ("word", "iri", "pname") and self.tok.text.upper() not in ("ORDER", "LIMIT", "OFFSET", "VALUES"):
                having.append(self.primary())
        if self.word("ORDER"):
            self.need("BY")
            while True:
                if found := self.word("ASC", "DESC"):
                    order_by.append((self.primary(), found == "DESC"))
                elif self.tok.kind == "var" or self.tok.text == "(" or self.tok.kind in ("word", "iri", "pname") and self.tok.text.upper() not in ("LIMIT", "OFFSET", "VALUES"):
                    order_by.append((self.primary(), False))
                else:
                    break
            if not order_by:
                self.fail("what to order by")
        limit, offset = None, 0
        while found := self.word("LIMIT", "OFFSET"):
            if self.tok.kind != "number" or not self.tok.text.isdigit():
                self.fail("a number")
            n = int(self.next().text)
            limit, offset = (n, offset) if found == "LIMIT" else (limit, n)
        values = self.values() if self.word("VALUES") else None
        if top and self.tok.kind != "end":
            self.fail("the end")
        query = Query(form, where, tuple(items), distinct, tuple(group_by), tuple(having), tuple(order_by), limit, offset, values, tuple(template), tuple(graphs), self.prefixes)
        return self.checked(query)

    def checked(self, q: Query) -> Query:
        """Only grouped variables may stand beside aggregates."""
        from .algebra import aggregates, variables

        used = [i for i in q.items if not isinstance(i, Var)]
        if q.form == "SELECT" and (q.group_by or any(aggregates(e) for e, _ in used)):
            if not q.items:
                raise SparqlSyntaxError("SELECT * can't be grouped")
            free = {v.name for _, v in q.group_by if v}
            for item in q.items:
                names = [item.name] if isinstance(item, Var) else [n for n in variables(item[0]) if item[0] not in [g for g, _ in q.group_by]] if not aggregates(item[0]) else []
                for name in names:
                    if name not in free and (isinstance(item, Var) or name not in [v.name for _, v in used]):
                        raise SparqlSyntaxError(f"?{name} is neither grouped nor aggregated")
                if not isinstance(item, Var):
                    free.add(item[1].name)
        return q

    def values(self) -> Values:
        many = bool(self.op("("))
        names = []
        while v := self.var():
            names.append(v)
            if not many:
                break
        if many:
            self.need(")")
        if not names and not many:
            self.fail("a variable")
        self.need("{")
        rows = []
        while not self.op("}"):
            if many:
                self.need("(")
            row = []
            while True:
                if self.word("UNDEF"):
                    row.append(None)
                elif t := (self.iri() or self.literal()):
                    row.append(t)
                else:
                    break
                if not many:
                    break
            if many:
                self.need(")")
            if len(row) != len(names):
                self.fail(f"{len(names)} values")
            rows.append(tuple(row))
        return Values(tuple(names), tuple(rows))

    # patterns
    def group(self, graph=None) -> Group:
        self.need("{")
        if self.tok.kind == "word" and self.tok.text.upper() == "SELECT":
            inner = self.query(top=False)
            self.need("}")
            return Group((inner,))
        parts: list = []
        while not self.op("}"):
            if self.op("."):
                continue
            if self.word("FILTER"):
                parts.append(Filter(self.primary()))
            elif self.word("OPTIONAL"):
                parts.append(Optional(self.group(graph)))
            elif self.word("MINUS"):
                parts.append(Minus(self.group(graph)))
            elif self.word("BIND"):
                self.need("(")
                expr = self.expr()
                self.need("AS")
                parts.append(Bind(expr, self.var() or self.fail("a variable")))
                self.need(")")
            elif self.word("VALUES"):
                parts.append(self.values())
            elif self.word("GRAPH"):
                parts.append(self.group(self.var() or self.iri() or self.fail("a graph")))
            elif self.word("SERVICE"):
                raise SparqlSyntaxError("SERVICE needs a network and is not accepted")
            elif self.tok.text == "{":
                groups = [self.group(graph)]
                while self.word("UNION"):
                    groups.append(self.group(graph))
                parts.append(Union(tuple(groups)) if len(groups) > 1 else groups[0])
            else:
                self.triples(parts, graph)
                if self.tok.text not in (".", "}") and not (self.tok.kind == "word" or self.tok.text == "{"):
                    self.fail("'.' or '}'")
        return Group(tuple(parts))

    def triples(self, out: list, graph) -> None:
        before = len(out)
        subject = self.term(out, graph)
        if len(out) > before and self.tok.text in (".", "}"):
            return
        self.properties(subject, out, graph)

    def properties(self, subject, out: list, graph) -> None:
        while True:
            verb = self.var() or self.path()
            while True:
                obj = self.term(out, graph)
                out.append(Triple(subject, verb, obj, graph))
                if not self.op(","):
                    break
            more = False
            while self.op(";"):
                more = True
            if not more or self.tok.text in (".", "}", "]"):
                return

    def path(self):
        parts = [self.path_sequence()]
        while self.op("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_sequence(self):
        parts = [self.path_step()]
        while self.op("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_step(self):
        inverse = bool(self.op("^"))
        if self.op("!"):
            many = bool(self.op("("))
            parts = []
            while True:
                back = bool(self.op("^"))
                iri = TYPE if self.word("A") else self.iri() or self.fail("an IRI")
                parts.append(Path("inv", (iri,)) if back else iri)
                if not many or not self.op("|"):
                    break
            if many:
                self.need(")")
            step = Path("not", tuple(parts))
        elif self.op("("):
            step = self.path()
            self.need(")")
        elif self.tok.kind == "word" and self.tok.text == "a":
            self.next()
            step = TYPE
        else:
            step = self.iri() or self.fail("a property")
        if found := self.op("*", "+", "?"):
            step = Path({"*": "star", "+": "plus", "?": "opt"}[found], (step,))
        return Path("inv", (step,)) if inverse else step

    # expressions
    def expr(self):
        left = self.conjunction()
        while self.op("||"):
            left = Expr("||", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.relation()
        while self.op("&&"):
            left = Expr("&&", (left, self.relation()))
        return left

    def relation(self):
        left = self.sum()
        if found := self.op(*_COMPARE):
            return Expr(found, (left, self.sum()))
        negated = bool(self.tok.kind == "word" and self.tok.text.upper() == "NOT" and self.toks[self.i + 1].text.upper() == "IN" and self.next())
        if self.word("IN"):
            return Expr("NOT IN" if negated else "IN", (left, *self.arguments()))
        return left

    def sum(self):
        left = self.product()
        while True:
            if found := self.op("+", "-"):
                left = Expr(found, (left, self.product()))
            else:
                return left

    def product(self):
        left = self.unary()
        while found := self.op("*", "/"):
            left = Expr(found, (left, self.unary()))
        return left

    def unary(self):
        if self.op("!"):
            return Expr("!", (self.unary(),))
        if self.tok.text == "-" and self.toks[self.i + 1].kind != "number":
            self.next()
            return Expr("NEG", (self.unary(),))
        return self.primary()

    def arguments(self) -> tuple:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expr())
            if not self.op(",") and self.tok.text != ")":
                self.fail("',' or ')'")
        return tuple(out)

    def primary(self):
        if self.op("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.tok.kind == "word" and self.tok.text.upper() not in ("TRUE", "FALSE"):
            name = self.next().text.upper()
            if name == "EXISTS":
                return Expr("EXISTS", (self.group(),))
            if name == "NOT":
                self.need("EXISTS")
                return Expr("!", (Expr("EXISTS", (self.group(),)),))
            if name not in AGGREGATES:
                if self.tok.text != "(":
                    self.fail("'('")
                return Expr(name, self.arguments())
            self.need("(")
            distinct = bool(self.word("DISTINCT"))
            args = () if self.op("*") else (self.expr(),)
            separator = " "
            if self.op(";"):
                self.need("SEPARATOR")
                self.need("=")
                separator = unquote(self.next().text)
            self.need(")")
            return Expr(name, args, distinct, separator)
        if v := self.var():
            return v
        if iri := self.iri():
            return Expr("CAST", (iri, *self.arguments())) if self.tok.text == "(" else iri
        return self.literal() or self.fail("an expression")


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return check(Parser(text, prefixes).query())


def validate(text: str, prefixes: dict[str, str] | None = None) -> str | None:
    """None for a query that parses and means something, else what is wrong with it."""
    try:
        parse(text, prefixes)
    except SparqlSyntaxError as error:
        return str(error) or "invalid query"
    return None
