"""Shell patterns as Columns: literal tests where they do, else an anchored regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str, sets: bool = True, stop_at_dir: bool = False) -> str | None:
    """`*`, `?`, `[set]`, `[!set]` and `\\`; with stop_at_dir only `**` crosses `/`. None: matches nothing."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            twice = pattern[i : i + 1] == "*"
            while pattern[i : i + 1] == "*":
                i += 1
            out.append("[^/]*" if stop_at_dir and not twice else ".*")
        elif c == "?":
            out.append("[^/]" if stop_at_dir else ".")
        elif c == "[" and sets:
            j, negate = i, False
            if pattern[j : j + 1] in ("!", "^"):
                negate, j = True, j + 1
            body, first = [], True
            while j < n and (pattern[j] != "]" or first):
                first = False
                if pattern[j] == "\\" and j + 1 < n:
                    j += 1
                    body.append("\\" + pattern[j])
                elif pattern[j] == "-" and body and j + 1 < n and pattern[j + 1] != "]":
                    body.append("-")
                else:
                    body.append(re.escape(pattern[j]) if not pattern[j].isalnum() else pattern[j])
                j += 1
            if j >= n:
                return None
            out.append(f"[{'^' if negate else ''}{''.join(body)}]")
            i = j + 1
        elif c == "\\":
            if i >= n:
                return None
            out.append(re.escape(pattern[i]))
            i += 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def wildcard_at(name: Column) -> Column:
    """Place, from 1, of the first wildcard that no backslash stands before; 0 if there is none."""
    before = F.regexp_extract(name, r"(?s)^((?:\\.|[^*?\[\\])*)[*?\[]", 1)
    return F.when(is_wild(name), F.length(before) + 1).otherwise(0)


def is_wild(name: Column) -> Column:
    return name.rlike(r"(?s)^(?:\\.|[^*?\[\\])*[*?\[]")


def has_metachar(name: Column) -> Column:
    """Names that other tools would take for a pattern."""
    return name.rlike(r"[*?\[\]\\]")


def matches(name: Column, pattern: str, ignore_case: bool = False, sets: bool = True, stop_at_dir: bool = False, dos: bool = False) -> Column:
    if dos and "." in pattern:
        name = F.when(name.contains("."), name).otherwise(F.concat(name, F.lit(".")))
    special = set("*?\\") | (set("[") if sets else set())
    if not ignore_case and not special & set(pattern):
        return name == pattern
    if not ignore_case and not stop_at_dir and pattern.startswith("*") and not special & set(pattern[1:]):
        return name.endswith(pattern[1:])
    if not ignore_case and not stop_at_dir and pattern.endswith("*") and not special & set(pattern[:-1]):
        return name.startswith(pattern[:-1])
    regex = to_regex(pattern, sets, stop_at_dir)
    return F.lit(False) if regex is None else name.rlike(f"(?s{'i' if ignore_case else ''})^{regex}\\z")


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def _tail(name: Column, pattern: str) -> Column:
    """As many last components as the pattern has."""
    return F.substring_index(name, "/", -(pattern.count("/") + 1))


def name_filter(name: Column, include: list[str] = (), exclude: list[str] = (), recurse: list[str] = (), **how) -> Column:
    """Exclusion wins; inclusion and recursion patterns must both hold where both are given; none accepts all."""
    out = ~_any([matches(name, p, **how) for p in exclude])
    if include:
        out = out & _any([matches(name, p, **how) for p in include])
    if recurse:
        out = out & _any([matches(_tail(name, p), p, **how) for p in recurse])
    return out


def has_suffix(name: Column, suffixes: str) -> Column:
    """Of a `:`- or `;`-separated list, ignoring case; `none` matches nothing."""
    some = [s for s in re.split("[:;]", suffixes) if s and s != "none"]
    return _any([F.lower(name).endswith(s.lower()) for s in some])
