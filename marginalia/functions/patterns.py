"""Regular expressions in two dialects: rules are written for Python and translated for the JVM."""

from __future__ import annotations

import re


class Untranslatable(ValueError):
    """The pattern has no equal in the JVM's dialect."""


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern for rlike and regexp_*; classes and case follow Unicode, as in Python."""
    re.compile(pattern)
    if re.search(r"\(\?\(|\(\?P=|\(\?[aLux]+\)", pattern):
        raise Untranslatable(pattern)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            out.append({"\\Z": "\\z"}.get(two, two))
            i += 2
            continue
        if in_class:
            if c == "[" or pattern.startswith("&&", i):
                out.append("\\" + c)
            else:
                in_class = c != "]" or out[-1] in ("[", "[^")
                out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out[-1] = "[^"
                i += 1
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        else:
            out.append(c)
        i += 1
    return ("(?iuU)" if ignore_case else "(?U)") + "".join(out)


def sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
