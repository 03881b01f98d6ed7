"""Many words in one pattern: a regular expression that reads like the tree of their prefixes, so that a place is looked at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(words: Iterable[str]) -> str:
    """A pattern of the words, the longest first where one begins another."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [(c if c.isalnum() else "\\" + c) + pattern(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return pattern(tree)


def spaced(x: Column) -> Column:
    """Lower case, with a single space for each run of anything but letters, digits and underscores, and one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def names_in(text: Column, names: Iterable[str]) -> Column:
    """All names (as spaced() writes them, without the outer spaces) in spaced text, the longest at each word."""
    return F.regexp_extract_all(text, F.lit(f"(?<= )(?=({one_of(names)}) )"), F.lit(1))
