"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal


class DialectError(ValueError):
    """A statement that the dialect cannot accept."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, string, number, body, parameter, symbol, quoted
    text: str  # the value: unquoted for strings, bodies and quoted names
    at: int

    def is_word(self, *names: str) -> bool:
        return self.kind == "word" and self.text.upper() in names


_SCAN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
    |(?P<body>\$\$.*?\$\$)
    |(?P<parameter>\$[0-9]+)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>`[^`]+`|"[^"]+")
    |(?P<number>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<symbol>->>|@>|<=|>=|!=|<>|\|\||[-+*/%=<>(),.;\[\]:])""",
    re.VERBOSE | re.DOTALL,
)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _SCAN.match(sql, at)
        if not m:
            raise DialectError(f"Syntax error at position {at}: {sql[at : at + 20]!r}")
        kind, text = m.lastgroup, m[0]
        if kind == "string":
            text = text[1:-1].replace("''", "'")
        elif kind == "body":
            text = text[2:-2]
        elif kind == "quoted":
            text = text[1:-1]
        if kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    return out


def statements(sql: str) -> list[list[Token]]:
    """The ``;``-separated statements of a script, as token lists; strings and bodies stay whole."""
    out: list[list[Token]] = [[]]
    for token in tokenize(sql):
        if token.kind == "symbol" and token.text == ";":
            out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


def literal(value: object) -> str:
    """A value as a Spark SQL literal; binding renders values, never text from outside."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value) if value >= 0 else f"({value})"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, Decimal):
        digits = f"{value:f}".lstrip("-").partition(".")
        scale = len(digits[2])
        return f"CAST('{value:f}' AS DECIMAL({max(1, min(38, len(digits[0].lstrip('0')) + scale), scale)},{scale}))"
    if isinstance(value, datetime):
        return f"{'TIMESTAMP' if value.tzinfo else 'TIMESTAMP_NTZ'} '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
