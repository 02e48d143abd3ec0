"""Tokens of SPARQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SparqlSyntaxError(ValueError):
    """Says what was expected and where."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


_TOKEN = re.compile(
    r"""(?P<space>(?:\s+|\#[^\n]*)+)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<var>[?$]\w+)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<blank>_:[\w.-]*\w)
    |(?P<pname>(?:[^\W\d_][\w.-]*)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;=<>!+\-*/|^?])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlSyntaxError(f"unexpected {text[at : at + 10]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token("string" if m.lastgroup == "long" else m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


def unquote(text: str) -> str:
    body = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]
    body = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), body)
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body)
