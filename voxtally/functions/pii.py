"""Personal-data detection and masking as column expressions.

Each pattern runs on the original text: one ``regexp_replace`` brackets every
match with two marker characters, a split on the markers gives the pieces, and
running lengths give the offsets.  A cheap necessary condition in front of each
pattern keeps clean rows away from the regex engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from voxtally import fixed
from voxtally.functions.exprs import let, running_totals, strip

OPEN, CLOSE = "\ufdd0", "\ufdd1"
STAND_IN = "\ufffd\ufffd"
SPAN_TYPE = "array<struct<priority:int,start:int,neg_length:int,stop:int,entity_type:string,ambiguous:boolean>>"

# What a text must contain for any pattern of the type to match.
_NEEDS = {
    "UPI": lambda t: F.contains(t, F.lit("@")),
    "EMAIL": lambda t: F.contains(t, F.lit("@")),
    "PHONE": lambda t: F.rlike(t, F.lit(r"(?U)[6-9]\d{9}")),
    "AADHAAR": lambda t: F.rlike(t, F.lit(r"(?U)\d{4}[\s-]?\d{4}[\s-]?\d{4}")),
    "CARD": lambda t: F.rlike(t, F.lit(r"(?U)\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}")),
    "ACCOUNT": lambda t: F.rlike(t, F.lit(r"(?U)\d{8}")),
    "TRANSACTION_ID": lambda t: F.rlike(t, F.lit(r"(?iU)transaction|txn|ref|payment\s+id")),
    "PAN": lambda t: F.rlike(t, F.lit(r"(?iU)[A-Z]{5}\d{4}[A-Z]")),
}


def is_missing(text: Column) -> Column:
    bare = strip(text)
    return text.isNull() | (bare == "") | (F.lower(bare) == "nan")


# A word character is a letter, a digit or an underscore.  Java's own \b also
# counts combining marks, so boundaries are spelled out.
_WORD = r"[\p{L}\p{N}_]"
_BEGIN, _END = f"(?<!{_WORD})", f"(?!{_WORD})"
_EDGE = f"(?:{_BEGIN}(?={_WORD})|(?<={_WORD}){_END})"


def _regex(flags: str, before: str, span: str, after: str) -> str:
    """The pattern with the text before it as group 1 and the span as group 2."""
    begins_in_word = not span.startswith("[a-zA-Z0-9._")
    ends_in_word = not span.endswith("-]{6,}")
    before = before.replace(r"\b", _BEGIN if begins_in_word else _EDGE)
    after = after.replace(r"\b", _END if ends_in_word else _EDGE)
    return f"(?{flags}U)({before})({span}){after}"


def _spans(text: Column, entity: str, flags: str, before: str, span: str, after: str, priority: int, ambiguous: bool) -> Column:
    regex = F.lit(_regex(flags, before, span, after))
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, STAND_IN), regex, F.lit(f"$1{OPEN}$2{CLOSE}"))
    pieces = F.split(marked, f"[{OPEN}{CLOSE}]", -1)

    def located(lengths: Column) -> Column:
        """Pieces alternate between text and span."""
        def at(start: Column, size: Column) -> Column:
            return F.struct(
                F.lit(priority).alias("priority"), start.cast("int").alias("start"), (-size).cast("int").alias("neg_length"),
                (start + size).cast("int").alias("stop"), F.lit(entity).alias("entity_type"), F.lit(ambiguous).alias("ambiguous"),
            )

        spans = F.zip_with(running_totals(lengths), lengths, at)
        return F.when(F.size(lengths) > 1, F.filter(spans, lambda s, i: i % 2 == 1))

    found = let(F.transform(pieces, lambda p: F.length(p).cast("long")), located)
    return F.coalesce(F.when(_NEEDS[entity](text), found), F.array()).cast(SPAN_TYPE)


def pii_candidates(text: Column, patterns=fixed.PII_PATTERNS) -> Column:
    """Every match of every pattern, overlaps included."""
    return F.when(~is_missing(text), F.flatten(F.array(*[_spans(text, *p) for p in patterns])))


def pii_resolve(candidates: Column) -> Column:
    """Non-overlapping spans: lowest priority number, then start, then longest; sorted by start.

    Only spans that hang together by overlaps can stand in each other's way, so the choice is made in each such run by itself.
    """
    def take(kept: Column, span: Column) -> Column:
        clash = F.exists(kept, lambda k: (span["start"] < k["stop"]) & (k["start"] < span["stop"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, span))

    def by_start(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s.alias("span")))
        return F.transform(F.array_sort(keyed), lambda s: s["span"])

    def choose(run: Column) -> Column:
        chosen = F.aggregate(F.array_sort(run), F.array().cast(SPAN_TYPE), take)
        return F.when(F.size(run) < 2, run).otherwise(by_start(chosen))

    def gather(state: Column, span: Column) -> Column:
        goes_on = span["start"] < state["stop"]
        return F.struct(
            F.when(goes_on, state["runs"]).otherwise(F.array_append(state["runs"], state["run"])).alias("runs"),
            F.when(goes_on, F.array_append(state["run"], span)).otherwise(F.array(span)).alias("run"),
            F.greatest(state["stop"], span["stop"]).alias("stop"),
        )

    def pick(spans: Column) -> Column:
        nothing = F.array().cast(SPAN_TYPE)
        start = F.struct(F.array().cast(f"array<{SPAN_TYPE}>").alias("runs"), nothing.alias("run"), F.lit(0).alias("stop"))
        runs = F.reduce(by_start(spans), start, gather, lambda s: F.array_append(s["runs"], s["run"]))
        return F.flatten(F.transform(runs, choose))

    return let(candidates, lambda spans: F.when(F.size(spans) < 2, spans).otherwise(pick(spans)))


def token(entity_type: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("_REDACTED]"))


def pii_mask(text: Column, spans: Column) -> Column:
    """Replace each resolved span by its token."""
    def masked(found: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(found, lambda s: s["stop"]))
        gaps = F.zip_with(found, F.slice(begins, F.lit(1), F.size(found)), lambda s, at: F.concat(F.substring(text, at + 1, s["start"] - at), token(s["entity_type"])))
        return F.concat(F.array_join(gaps, ""), F.substring(text, F.element_at(begins, -1) + 1, F.length(text)))

    none = F.coalesce(F.size(spans), F.lit(0)) <= 0
    return F.when(none, F.when(is_missing(text), "").otherwise(text)).otherwise(let(spans, masked))


def pii_entity_types(spans: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity_type"]))), F.array().cast("array<string>"))


def pii_review_required(spans: Column) -> Column:
    return F.coalesce(F.exists(spans, lambda s: s["ambiguous"]) | (F.size(pii_entity_types(spans)) > 1), F.lit(False))


def pii_entities(spans: Column) -> Column:
    return F.coalesce(
        F.transform(
            spans,
            lambda s: F.struct(
                s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["stop"].alias("end"),
                (-s["neg_length"]).alias("original_length"), token(s["entity_type"]).alias("masked_value"),
            ),
        ),
        F.array().cast("array<struct<entity_type:string,start:int,end:int,original_length:int,masked_value:string>>"),
    )


def unmasked(text: Column, entity_type: str) -> Column:
    """Whether one type of personal data is still readable in an output text."""
    tests = [
        _NEEDS[entity](text) & F.rlike(text, F.lit(_regex(flags, before, span, after)))
        for entity, flags, before, span, after, _, _ in fixed.PII_PATTERNS
        if entity == entity_type
    ]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def any_unmasked(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [unmasked(text, t) for t in fixed.GATE_TYPES])
