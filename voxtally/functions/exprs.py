"""Small column helpers shared by all operators."""

from __future__ import annotations

import json
import re
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

# The characters that count as white space at the edges of a text.
EDGE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


#: Ways to go on at one place of a pattern from which on they are grouped.
GROUP = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Catalyst may inline a projected column into a lambda, which would redo the
    work per element; a lambda variable is bound exactly once.
    """
    return F.transform(F.array(value), body)[0]


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are computed once per row, whatever later steps do with them.

    A filter on a projected column is pushed below the projection with the
    whole expression copied into it, again at every level.  Columns made by a
    generator are out of reach for that rule; the generator here yields exactly
    one row and stays inside generated code.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def running_totals(values: Column, block: int = 256) -> Column:
    """For each long of an array the sum of those before it.

    A fold copies its growing array at each step, which is quadratic in the length of the array; blocks keep that small.
    """
    def run(part: Column, first: Column) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("sums"), first.alias("total"))
        step = lambda s, x: F.struct(F.array_append(s["sums"], s["total"]).alias("sums"), (s["total"] + x).alias("total"))
        return F.reduce(part, start, step)["sums"]

    zero = F.lit(0).cast("long")
    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1) / block)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    whole = lambda p: F.transform(p, lambda x: F.reduce(x, zero, lambda s, v: s + v))
    return let(parts, lambda p: F.flatten(F.zip_with(p, run(whole(p), zero), run)))


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(EDGE_SPACE))


def trim_to_null(column: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(strip(column), F.lit(""))


def normalize_text(column: Column) -> Column:
    """Trimmed text; null, blank and the word ``nan`` (any case) become null."""
    text = strip(column)
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def constant(value, kind: str) -> Column:
    """A nested constant.  Parsed once by the optimizer's constant folding, whatever its size."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def strings(values: Iterable[str]) -> Column:
    """An array<string> constant, also for an empty list."""
    return constant(list(values), "array<string>")


def string_map(values: dict[str, str]) -> Column:
    return constant(values, "map<string,string>")


def prefix_pattern(terms: Iterable[str]) -> str:
    """A regex that finds the longest of the terms at a place: common beginnings are written once, so that a place costs as
    many steps as its text goes along with any term, however many terms there are."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(c) + pattern(after) for c, after in sorted(node.items()) if c]
        if not ways:
            return ""
        if len(ways) > GROUP:
            # Many ways are looked at in groups: a class of first letters tells whether any of a group can go on.
            firsts = [re.escape(c) for c in sorted(node) if c]
            step = max(GROUP // 2, round(len(ways) ** 0.5))
            ways = [f"(?=[{''.join(firsts[i: i + step])}])(?:{'|'.join(ways[i: i + step])})" for i in range(0, len(ways), step)]
        return f"(?:{'|'.join(ways)}){'?+' if '' in node else ''}" if len(ways) > 1 or "" in node else ways[0]

    return pattern(root)


def contained_terms(text_lower: Column, terms: Iterable[str]) -> Column:
    """Distinct terms contained in the text, in no particular order, in one pass over it.

    A pattern gives the longest term at each place, overlapping ones too; shorter terms at the same place are beginnings of it and are looked up.
    """
    known = [t for t in dict.fromkeys(terms) if t]
    if not known:
        return strings([])
    longest = F.array_distinct(F.regexp_extract_all(text_lower, F.lit(f"(?=({prefix_pattern(known)}))"), F.lit(1)))
    listed = set(known)
    beginnings = {t: [t[:n] for n in range(1, len(t)) if t[:n] in listed] for t in known}
    beginnings = {t: b for t, b in beginnings.items() if b}
    if beginnings:
        table = constant(beginnings, "map<string,array<string>>")
        longest = let(longest, lambda found: F.array_distinct(F.concat(found, F.flatten(F.array_compact(F.transform(found, lambda t: F.try_element_at(table, t)))))))
    return F.coalesce(longest, strings([]))


def lexicon_match(text_lower: Column, terms: Iterable[str]) -> Column:
    """Terms contained in the text as substrings, distinct, in lexicon order."""
    terms = list(dict.fromkeys(terms))
    return let(contained_terms(text_lower, terms), lambda hits: F.array_intersect(strings(terms), hits))


def round_half_even(column: Column, digits: int) -> Column:
    return F.bround(column, digits)


def keep(*conditional: Column) -> Column:
    """Array of the given strings without the nulls."""
    return F.array_compact(F.array(*conditional))


def word_or_phrase(terms: Iterable[str]) -> tuple[str, list[str]]:
    """(regex for word-bounded terms, plain symbols such as ``?``)."""
    words = [t for t in terms if any(c.isalnum() for c in t)]
    symbols = [t for t in terms if t and t not in words]
    pattern = "(?<![a-zA-Z0-9_])(?:" + "|".join(re.escape(w) for w in words) + ")(?![a-zA-Z0-9_])"
    return pattern, symbols
