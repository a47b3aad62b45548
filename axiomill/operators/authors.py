"""Boolean author search: an expression of names becomes semi-joins on the author table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Name:
    first: str
    middle: str
    last: str


@dataclass(frozen=True)
class Both:
    """``kind`` 'and' or 'or' of two or more parts."""

    kind: str
    parts: tuple


def name_of(text: str) -> Name:
    parts = [p for p in re.split(r"[.\s]+", text.strip().lower()) if p]
    if len(parts) < 2:
        return Name("", "", parts[0] if parts else "")
    return Name(parts[0], parts[1] if len(parts) > 2 else "", parts[-1])


def parse(expression: str):
    """The tree of ``A and (B or C)``; a missing or surplus bracket is put right."""
    tokens = re.findall(r"\(|\)|(?:(?!\band\b|\bor\b|[()]).)+|\band\b|\bor\b", expression.lower())
    tokens = [t.strip() for t in tokens if t.strip()]
    at = 0

    def level():
        nonlocal at
        groups, kind = [[]], "and"
        while at < len(tokens):
            token = tokens[at]
            at += 1
            if token == ")":
                break
            if token == "(":
                part = level()
                if part is not None:
                    groups[-1].append(part)
            elif token == "or":
                groups.append([])
            elif token != "and":
                groups[-1].append(name_of(token))
        either = [g[0] if len(g) == 1 else Both("and", tuple(g)) for g in groups if g]
        return None if not either else either[0] if len(either) == 1 else Both("or", tuple(either))

    parts = []
    while at < len(tokens):  # what follows a surplus closing bracket is a further condition
        kind = tokens[at] if tokens[at] in ("and", "or") else "and"
        part = level()
        if part is not None:
            parts.append((kind, part))
    if not parts:
        return None
    tree = parts[0][1]
    for kind, part in parts[1:]:
        tree = Both(kind, (tree, part))
    return tree


def count(tree) -> int:
    return 0 if tree is None else 1 if isinstance(tree, Name) else sum(map(count, tree.parts))


def predicate(name: Name, first_initial: bool = False, last_initial: bool = False) -> Column:
    """A name's condition: full names are equal, initials are prefixes."""
    first, middle, last = F.col("first_name"), F.col("middle_name"), F.col("last_name")
    out = last.startswith(name.last[:1]) if last_initial or len(name.last) == 1 else last == name.last
    if name.first:
        if first_initial or len(name.first) == 1:
            out = out & first.startswith(name.first[:1])
        else:
            out = out & (first == name.first)
            if name.middle:
                out = out & middle.startswith(name.middle[:1])
    return out


def matching(authors: DataFrame, tree, **how) -> DataFrame:
    """``thm_id``: statements whose authors satisfy the tree. A conjunction is a chain of semi-joins
    on the id, so Spark can filter each side at the scan."""
    if isinstance(tree, Name):
        return authors.where(predicate(tree, **how)).select("thm_id").distinct()
    sides = [matching(authors, part, **how) for part in tree.parts]
    if tree.kind == "and":
        return reduce(lambda a, b: a.join(b, "thm_id", "left_semi"), sides)
    return reduce(lambda a, b: a.unionByName(b), sides).distinct()


def search(authors: DataFrame, expression: str) -> DataFrame:
    """``thm_id, level``: exact names (0); if none match, first initials (1); then, for fewer than
    three names, last initials (2)."""
    tree = parse(expression)
    if tree is None:
        return authors.select("thm_id", F.lit(0).alias("level")).limit(0)
    levels = [{}, {"first_initial": True}] + ([{"last_initial": True}] if count(tree) < 3 else [])
    for i, how in enumerate(levels):
        found = matching(authors, tree, **how).withColumn("level", F.lit(i))
        # A wider level is looked at only if the one before has nothing.
        if i == len(levels) - 1 or not found.isEmpty():
            return found


def split_query(query: str) -> tuple[str, str | None]:
    """(words, author expression) of ``compact operators by author A and B``."""
    m = re.match(r"(.*?)\s*\b(?:by\s+)?authors?\b\s*:?\s*(.*)$", query, re.I | re.S)
    return (m.group(1), m.group(2)) if m and m.group(2) else (query, None)
