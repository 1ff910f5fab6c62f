"""Tokens of the dialect: (kind, text). Kinds: word, number, string, op, param, end."""

from __future__ import annotations

import re
from typing import NamedTuple

from lodemill.errors import SyntaxProblem


class Token(NamedTuple):
    kind: str
    text: str
    at: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<number>[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*")
    |(?P<word>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<param>\?|\$[0-9]+)
    |(?P<op><>|!=|>=|<=|[-+*/%=<>(),.;])""",
    re.S | re.X,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at : at + 10]!r} at {at}")
        kind, part = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token("string", part[1:-1].replace("''", "'"), at))
        elif kind == "quoted":  # a name where a name is wanted, else a string
            out.append(Token("quoted", part[1:-1].replace('""', '"'), at))
        elif kind != "skip":
            out.append(Token(kind, part, at))
        at = m.end()
    return [*out, Token("end", "", at)]
