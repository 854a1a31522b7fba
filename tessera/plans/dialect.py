"""Lowering of dialect queries to Spark SQL.

The dialect's own predicates become built-in expressions, so Catalyst sees ordinary plans:

* ``c CONTAINS 'word'``            whole-word membership, case-insensitive
* ``c @> v``                       array membership
* ``c ->> 'k'``                    JSON text of a top-level key
* ``(s, e) OVERLAPS (lo, hi)``     intervals that share a point, both ends inclusive
* ``ARRAY[...]``                   array literal

Everything else is passed to Spark's parser as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.predicates import word_pattern
from .lexer import DialectError, Token, literal

_AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
_RANKINGS = ("ROW_NUMBER", "RANK", "DENSE_RANK")
_BEFORE_OPERAND = ("WHERE", "AND", "OR", "NOT", "ON", "HAVING", "SELECT", "WHEN", "THEN", "ELSE", "IN", "LIKE")
_CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION")


def _name(token: Token) -> str:
    return f"`{token.text}`" if token.kind == "quoted" else token.text


def _argument(token: Token, args: Sequence[object]) -> object:
    at = int(token.text[1:])
    if not 1 <= at <= len(args):
        raise DialectError(f"No value for parameter {token.text}")
    return args[at - 1]


def _operand(out: list[str]) -> str:
    """Takes the operand to the left off ``out``: one name or value, or a parenthesis with the function before it."""
    if out[-1] != ")":
        return out.pop()
    depth, at = 0, len(out)
    while at:
        at -= 1
        depth += (out[at] == ")") - (out[at] == "(")
        if not depth:
            break
    if at and (out[at - 1].replace("_", "").replace(".", "").isalnum()) and out[at - 1].upper() not in _BEFORE_OPERAND:
        at -= 1
    text = " ".join(out[at:])
    del out[at:]
    return text


def _value(token: Token, args: Sequence[object]) -> str:
    if token.kind == "string":
        return literal(token.text)
    if token.kind == "parameter":
        return literal(_argument(token, args))
    if token.kind == "number":
        return token.text if token.text.isdigit() else f"CAST('{token.text}' AS DOUBLE)"
    return _name(token)


def lower(tokens: list[Token], args: Sequence[object] = ()) -> str:
    """Spark SQL text of a query or an expression."""
    out: list[str] = []
    i = 0

    def symbol(at: int, text: str) -> bool:
        return at < len(tokens) and tokens[at].kind == "symbol" and tokens[at].text == text

    while i < len(tokens):
        token = tokens[i]
        if token.kind in ("word", "quoted"):
            if token.is_word("CONTAINS") and out and i + 1 < len(tokens) and tokens[i + 1].kind in ("string", "parameter"):
                word = tokens[i + 1].text if tokens[i + 1].kind == "string" else _argument(tokens[i + 1], args)
                pattern = word_pattern(word) if isinstance(word, str) else None
                if pattern:
                    out.append(f"(lower({_operand(out)}) RLIKE {literal(pattern)})")
                else:
                    out.append(f"array_contains(split(lower({_operand(out)}), '[^a-z0-9]+'), lower({literal(word)}))")
                i += 2
                continue
            if token.is_word("OVERLAPS") and len(out) >= 5 and out[-1] == ")" and out[-3] == "," and out[-5] == "(":
                if not (symbol(i + 1, "(") and symbol(i + 3, ",") and symbol(i + 5, ")")):
                    raise DialectError("OVERLAPS needs two literals in parentheses")
                low, high = (_value(tokens[i + k], args) for k in (2, 4))
                start, end = out[-4], out[-2]
                del out[-5:]
                out.append(f"({start} <= {high} AND {end} >= {low})")
                i += 6
                continue
            if token.is_word("ARRAY") and symbol(i + 1, "["):
                depth, j = 1, i + 2
                while j < len(tokens) and depth:
                    depth += symbol(j, "[") - symbol(j, "]")
                    j += 1
                out.append(f"array({lower(tokens[i + 2 : j - 1], args)})")
                i = j
                continue
            if token.is_word("LIKE") and i + 1 < len(tokens) and tokens[i + 1].kind in ("string", "parameter"):
                pattern = tokens[i + 1].text if tokens[i + 1].kind == "string" else _argument(tokens[i + 1], args)
                out += ["LIKE", literal(pattern if pattern is None else str(pattern).replace("\\", "\\\\"))]  # a backslash is an ordinary character
                i += 2
                continue
            if token.is_word("AS") and i + 1 < len(tokens) and tokens[i + 1].kind == "string":
                out.append(f"AS `{tokens[i + 1].text}`")
                i += 2
                continue
            name = _name(token)
            while symbol(i + 1, ".") and i + 2 < len(tokens) and tokens[i + 2].kind in ("word", "quoted"):
                name += f".{_name(tokens[i + 2])}"
                i += 2
            out.append(name)
        elif token.kind == "symbol" and token.text == "@>" and out and i + 1 < len(tokens):
            out.append(f"array_contains({_operand(out)}, {_value(tokens[i + 1], args)})")
            i += 1
        elif token.kind == "symbol" and token.text == "->>" and out and i + 1 < len(tokens) and tokens[i + 1].kind == "string":
            path = literal(f"$['{tokens[i + 1].text}']")
            out.append(f"try_variant_get(try_parse_json({_operand(out)}), {path}, 'string')")
            i += 1
        elif token.kind == "body":
            raise DialectError("A quoted body is not part of a query")
        else:
            out.append(_value(token, args) if token.kind != "symbol" else token.text)
        i += 1
    return " ".join(out)


def _split(tokens: list[Token]) -> list[list[Token]]:
    """Parts between top-level commas."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "symbol":
            depth += (t.text in "([") - (t.text in ")]")
        if t.kind == "symbol" and t.text == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def with_default_names(tokens: list[Token]) -> list[Token]:
    """Names unaliased aggregates ``FUNC(arg)`` and unaliased rankings by their function."""
    if not tokens or not tokens[0].is_word("SELECT"):
        return tokens
    depth = 0
    for end, t in enumerate(tokens):
        if t.kind == "symbol":
            depth += (t.text == "(") - (t.text == ")")
        if end and not depth and t.is_word(*_CLAUSES):
            break
    else:
        end = len(tokens)
    out: list[Token] = [tokens[0]]
    for k, part in enumerate(_split(tokens[1:end])):
        if k:
            out.append(Token("symbol", ",", part[0].at if part else 0))
        out += part
        called = len(part) > 2 and part[1].kind == "symbol" and part[1].text == "("
        closed = part and part[-1].kind == "symbol" and part[-1].text == ")"
        if called and closed and part[0].is_word(*_AGGREGATES):
            inner = "".join(t.text for t in part[2:-1])
            out += [Token("word", "AS", 0), Token("quoted", f"{part[0].text.upper()}({inner})", 0)]
        elif called and closed and part[0].is_word(*_RANKINGS):
            out += [Token("word", "AS", 0), Token("quoted", part[0].text.upper(), 0)]
    return out + tokens[end:]


def check_with(tokens: list[Token]) -> bool:
    """For a WITH query: RECURSIVE and UNION ALL in the definition must come together."""
    if not tokens or not tokens[0].is_word("WITH"):
        return False
    recursive = len(tokens) > 1 and tokens[1].is_word("RECURSIVE")
    depth, inside = 0, False
    for t, after in zip(tokens, [*tokens[1:], None], strict=True):
        if t.kind == "symbol":
            depth += (t.text == "(") - (t.text == ")")
        inside |= depth == 1 and t.is_word("UNION") and after is not None and after.is_word("ALL")
    if recursive and not inside:
        raise DialectError("WITH RECURSIVE needs UNION ALL in its definition")
    if inside and not recursive:
        raise DialectError("UNION ALL in WITH needs RECURSIVE")
    return recursive
