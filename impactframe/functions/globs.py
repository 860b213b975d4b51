"""Glob patterns as regular expressions for ``rlike``.

``*`` and ``?`` cross ``/``; ``**/`` is any number of whole directories, and a trailing
``/**`` everything below; ``[abc]``, ``[!abc]`` and ``{a,b}`` work as usual."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    out, i, depth = [], 0, 0
    n = len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith("**", i):
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            first = i == 0 or pattern[i - 1] == "/"
            if j - i == 2 and first and j < n and pattern[j] == "/":
                out.append("(?:.*/)?")
                i = j + 1
                continue
            out.append(".+" if j - i == 2 and first and j == n and i > 0 else ".*")
            i = j
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            if j < n and pattern[j] in "!^":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                raise ValueError(f"unclosed character class in glob {pattern!r}")
            body = pattern[i + 1 : j]
            negated = body[:1] in ("!", "^")
            inner = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + "^" * negated + inner + "]")
            i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                raise ValueError(f"unopened alternative in glob {pattern!r}")
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternative in glob {pattern!r}")
    return "(?s)^" + "".join(out) + "$"


def any_glob(patterns: list[str]) -> str:
    """One expression for a set of patterns."""
    return "|".join(glob_regex(p) for p in patterns)
