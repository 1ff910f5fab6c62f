"""Patterns of the dialect as Java regular expressions and LIKE patterns."""

from __future__ import annotations


def like_pattern(pattern: str) -> str:
    """LIKE has no escape here; Spark's escapes with a backslash."""
    return pattern.replace("\\", "\\\\")


def _quoted(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 or c in "_ " else "\\" + c


def regexp_pattern(pattern: str) -> str:
    r"""The dialect knows literals, . * + ? [..] [^..] \x, and ^ and $ at the ends alone.

    All else is literal: | ( ) { }, a quantifier with nothing before it, ^ and $ inside. A backslash makes the next
    character literal, so \d is the letter d. The dot matches line ends.
    """
    out, i, n, atom = ["(?s)"], 0, len(pattern), False
    while i < n:
        c = pattern[i]
        if c == "^" and i == 0:
            out.append("^")
        elif c == "$" and i == n - 1:
            out.append("\\z")
        elif c in "*+?" and atom:
            out.append(c)
            atom = False
        elif c == ".":
            out.append(".")
            atom = True
        elif c == "[" and (end := _class_end(pattern, i)) > 0:
            out.append(_class(pattern[i + 1 : end]))
            i, atom = end, True
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(_quoted(pattern[i]))
            atom = True
        else:
            out.append(_quoted(c))
            atom = True
        i += 1
    return "".join(out)


def _class_end(pattern: str, at: int) -> int:
    """Place of the ] that ends a class; one right after [ or [^ is literal."""
    k = at + 1
    if pattern[k : k + 1] == "^":
        k += 1
    return pattern.find("]", k + 1)


def _class(body: str) -> str:
    """A range that runs backwards holds nothing."""
    negated = body.startswith("^")
    body, out, i = body[negated:], "", 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            out += f"{_quoted(low)}-{_quoted(high)}" if low <= high else ""
            i += 3
        else:
            out += _quoted(body[i])
            i += 1
    if not out:
        return "." if negated else "(?!.)(?=.)"
    return f"[{'^' if negated else ''}{out}]"
