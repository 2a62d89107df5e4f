"""Sentiment, theme, severity and intent as column expressions.

The text is searched once: ``term_hits`` lists every known term it contains.
All rules are then small set operations on that short list.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F

from voxtally import fixed
from voxtally.functions.exprs import constant, contained_terms, let, string_map, strings, word_or_phrase
from voxtally.sources.taxonomy import lexicon

THEME_TYPE = (
    "array<struct<theme:string,subtheme:string,confidence:double,matched_terms:array<string>,"
    "product_area:string,severity:string,method:string>>"
)


def _theme_terms(terms: Sequence[str]) -> list[str]:
    return [t for t in dict.fromkeys(terms) if t not in lexicon()["theme_stopwords"]]


def vocabulary(rules: Sequence[dict]) -> list[str]:
    """Every term any rule or word list looks for."""
    words = lexicon()
    terms = [*words["sentiment"]["positive"], *words["sentiment"]["negative"]]
    for rule in rules:
        terms += _theme_terms(rule["phrases"]) + _theme_terms(rule["keywords"])
        for sub in rule["subthemes"]:
            terms += sub["terms"]
    for group in ("severity", "intent"):
        for members in words[group].values():
            terms += members
    return list(dict.fromkeys(terms))


def term_hits(text_lower: Column, rules: Sequence[dict]) -> Column:
    return F.coalesce(contained_terms(text_lower, vocabulary(rules)), strings([]))


def found(hits: Column, terms: Sequence[str]) -> Column:
    """Terms of the list present in the text, in list order."""
    return F.array_intersect(strings(dict.fromkeys(terms)), hits)


def has_any(hits: Column, terms: Sequence[str]) -> Column:
    return F.arrays_overlap(hits, strings(terms)) if terms else F.lit(False)


# --- sentiment --------------------------------------------------------------


def sentiment(text: Column, hits: Column) -> Column:
    """Struct: label, score, positive_score, negative_score, matched terms, warning, method.

    ``text`` is the normalised text (null when missing).
    """
    words = lexicon()["sentiment"]

    def build(pair: Column) -> Column:
        good, bad = F.size(pair["good"]), F.size(pair["bad"])
        good_score, bad_score = F.least(F.lit(1.0), good / 3.0), F.least(F.lit(1.0), bad / 3.0)
        label = (
            F.when(text.isNull(), "unknown")
            .when((good > 0) & (bad > 0), "mixed")
            .when(bad > 0, "negative")
            .when(good > 0, "positive")
            .otherwise("neutral")
        )
        score = F.when((good > 0) & (bad > 0), (good_score + bad_score) / 2).otherwise(F.greatest(good_score, bad_score))
        return F.struct(
            label.alias("label"),
            score.alias("score"),
            good_score.alias("positive_score"),
            bad_score.alias("negative_score"),
            pair["good"].alias("matched_positive_terms"),
            pair["bad"].alias("matched_negative_terms"),
            F.when(text.isNull(), fixed.MSG_SENTIMENT_MISSING).alias("warning"),
            F.when(text.isNull(), "unknown").otherwise("local_rule_based").alias("method"),
        )

    return let(F.struct(found(hits, words["positive"]).alias("good"), found(hits, words["negative"]).alias("bad")), build)


# --- severity and intent ----------------------------------------------------


def severity_from_text(hits: Column) -> Column:
    """Severity named by the text itself; null when no phrase applies."""
    lists = lexicon()["severity"]
    chain = F.when(has_any(hits, lists["critical"]), "critical")
    for level in ("high", "medium", "low"):
        chain = chain.when(has_any(hits, lists[level]), level)
    return chain


def severity(hits: Column, default: Column) -> Column:
    return F.coalesce(severity_from_text(hits), default)


def severity_score(label: Column) -> Column:
    scores = constant({k: float(v) for k, v in fixed.SEVERITY_SCORES.items()}, "map<string,double>")
    return F.coalesce(F.try_element_at(scores, label), F.lit(1.0))


def _says(text_lower: Column, hits: Column, terms: Sequence[str]) -> Column:
    """Whole-word match; the regex only runs where a substring hit exists."""
    pattern, symbols = word_or_phrase(terms)
    words = [t for t in terms if t not in symbols]
    said = has_any(hits, words) & F.rlike(text_lower, F.lit(pattern))
    return said | has_any(hits, symbols) if symbols else said


def intent(text_lower: Column, hits: Column, default: Column) -> Column:
    lists = lexicon()["intent"]
    negated = has_any(hits, lists["negation"])
    known = default.isin("complaint", "praise", "request", "bug_report", "question")
    return (
        F.when(~negated & _says(text_lower, hits, lists["praise"]), "praise")
        .when(_says(text_lower, hits, lists["request"]), "request")
        .when(_says(text_lower, hits, lists["question"]), "question")
        .when(_says(text_lower, hits, lists["bug_report"]), "bug_report")
        .when(known & negated & (default == "praise"), "complaint")
        .when(known, default)
        .when(negated | has_any(hits, lists["complaint_cues"]), "complaint")
        .otherwise("unknown")
    )


# --- themes -----------------------------------------------------------------


RULE_TYPE = (
    "array<struct<rule_ord:int,theme:string,phrases:array<string>,keywords:array<string>,scale:double,"
    "product_area:string,default_severity:string>>"
)


def rules_literal(rules: Sequence[dict]) -> Column:
    """The rule table as one constant array of structs."""
    return constant(
        [
            {
                "rule_ord": i,
                "theme": r["theme"],
                "phrases": _theme_terms(r["phrases"]),
                "keywords": _theme_terms(r["keywords"]),
                "scale": max(2.0, 0.5 * max(1, len(r["phrases"]) + len(r["keywords"]))),
                "product_area": r["product_area"],
                "default_severity": r["default_severity"],
            }
            for i, r in enumerate(rules)
        ],
        RULE_TYPE,
    )


def theme_scores(hits: Column, rules: Sequence[dict]) -> Column:
    """One struct per rule with any match: raw score, confidence, matched terms."""

    def score(rule: Column) -> Column:
        def build(m: Column) -> Column:
            raw = fixed.PHRASE_WEIGHT * F.size(m["p"]) + fixed.KEYWORD_WEIGHT * F.size(m["k"])
            return F.struct(
                rule["rule_ord"].alias("rule_ord"),
                rule["theme"].alias("theme"),
                raw.alias("raw_score"),
                F.least(F.lit(1.0), raw / rule["scale"]).alias("confidence"),
                F.array_union(m["p"], m["k"]).alias("matched_terms"),
                rule["product_area"].alias("product_area"),
                rule["default_severity"].alias("default_severity"),
            )

        return let(
            F.struct(F.array_intersect(rule["phrases"], hits).alias("p"), F.array_intersect(rule["keywords"], hits).alias("k")),
            build,
        )

    # Which rules list a term: only rules with a hit are scored.
    users: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for term in {*_theme_terms(rule["phrases"]), *_theme_terms(rule["keywords"])}:
            users.setdefault(term, []).append(i)
    by_term = constant(users, "map<string,array<int>>")
    touched = F.flatten(F.array_compact(F.transform(hits, lambda h: F.try_element_at(by_term, h))))
    table = rules_literal(rules)
    return let(touched, lambda t: F.transform(F.filter(table, lambda r: F.array_contains(t, r["rule_ord"])), score))


SUBTHEME_TYPE = "map<string,array<struct<name:string,terms:array<string>>>>"


def subtheme(theme: Column, hits: Column, rules: Sequence[dict]) -> Column:
    """First declared subtheme of the theme with a term in the text, else ``general``."""
    declared = F.try_element_at(constant({r["theme"]: r["subthemes"] for r in rules}, SUBTHEME_TYPE), theme)
    fitting = F.filter(declared, lambda s: F.arrays_overlap(s["terms"], hits))
    return F.coalesce(F.get(fitting, F.lit(0))["name"], F.lit("general"))


def rank_themes(scores: Column, hits: Column, rules: Sequence[dict]) -> Column:
    """Best theme first: confidence, severity score, raw score; ties keep rule order."""

    def sortable(s: Column) -> Column:
        def build(level: Column) -> Column:
            return F.struct(
                (-s["confidence"]).alias("a"),
                (-severity_score(level)).alias("b"),
                (-s["raw_score"]).alias("c"),
                s["rule_ord"].alias("d"),
                F.struct(
                    s["theme"].alias("theme"),
                    subtheme(s["theme"], hits, rules).alias("subtheme"),
                    s["confidence"].alias("confidence"),
                    s["matched_terms"].alias("matched_terms"),
                    s["product_area"].alias("product_area"),
                    level.alias("severity"),
                    F.lit("keyword_rule").alias("method"),
                ).alias("label"),
            )

        return let(severity(hits, s["default_severity"]), build)

    return F.transform(F.array_sort(F.transform(scores, sortable)), lambda s: s["label"])


def classify_theme(text: Column, ranked: Column) -> Column:
    """Struct with the primary theme, secondary themes, method, warning and review flag."""
    none = F.lit(None).cast("string")

    def build(labels: Column) -> Column:
        first = F.get(labels, F.lit(0))
        some = F.size(labels) > 0
        others = F.filter(F.slice(labels, F.lit(2), F.size(labels)), lambda s: s["confidence"] >= fixed.SECONDARY_MIN_CONFIDENCE)
        return F.struct(
            F.when(some, first["theme"]).otherwise("unknown").alias("primary_theme"),
            F.when(some, first["subtheme"]).otherwise("unknown").alias("primary_subtheme"),
            F.when(some, first["confidence"]).otherwise(0.0).alias("primary_confidence"),
            F.when(some, others).otherwise(F.array().cast(THEME_TYPE)).alias("secondary_themes"),
            F.when(some, first["matched_terms"]).otherwise(strings([])).alias("matched_terms"),
            F.when(some, first["product_area"]).otherwise("unknown").alias("product_area"),
            F.when(some, first["severity"]).otherwise("unknown").alias("severity"),
            F.when(text.isNull(), "unknown").otherwise("keyword_rule").alias("method"),
            F.when(text.isNull(), fixed.MSG_THEME_MISSING)
            .when(~some, fixed.MSG_NO_THEME_EVIDENCE)
            .otherwise(none)
            .alias("warning"),
            (~some | (first["confidence"] < fixed.PRIMARY_MIN_CONFIDENCE)).alias("requires_human_review"),
        )

    return let(F.coalesce(ranked, F.array().cast(THEME_TYPE)), build)


def rule_value(theme: Column, rules: Sequence[dict], field: str) -> Column:
    """A rule's field looked up by theme name; null for no such theme."""
    return F.try_element_at(string_map({r["theme"]: r[field] for r in rules}), theme)


def customer_problem(theme: Column, terms: Column) -> Column:
    return F.when(
        F.size(terms) > 0,
        F.concat(F.lit("Detected "), F.replace(theme, F.lit("_"), F.lit(" ")), F.lit(" related to: "),
                 F.array_join(F.slice(terms, 1, 3), ", ")),
    ).otherwise("")
