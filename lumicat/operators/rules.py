"""Rule taxonomies as data: ordered tables turned into expressions.

A taxonomy is a list of rules in order of precedence. They are small and fixed
by the caller, so they become literals of one expression: no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    code: str
    name: str
    parent: str
    needles: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Taxonomy:
    """Content rules, service rules with a guard flag, manual and noise patterns, synonyms, each in order."""

    content: tuple[Rule, ...]
    service: tuple[tuple[str, tuple[str, ...], bool], ...] = ()
    manual: tuple[tuple[str, str, str], ...] = ()  # pattern, record type, code
    noise: tuple[tuple[str, str], ...] = ()  # pattern, reason
    generic: tuple[str, ...] = field(default=())
    synonyms: tuple[tuple[str, str], ...] = ()  # pattern of whole words, what it becomes


def first_match(tests: list[tuple[Column, Column | str]], default: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for test, value in tests:
        out = out.when(test, value)
    return out.otherwise(default)


def any_of(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(text, F.lit(needle))
    return out


def hits(text: Column, needles: tuple[str, ...]) -> Column:
    """How many of the needles the text contains."""
    out = F.lit(0)
    for needle in needles:
        out = out + F.contains(text, F.lit(needle)).cast("int")
    return out


def scored(topic: Column, context: Column, rules: tuple[Rule, ...]) -> Column:
    """An array of (minus score in halves, order, code, name, parent, phrases, needles), best first.

    A phrase weighs 3, a needle in the topic 2, in the context 0.5 up to 2.
    Scores are whole numbers of halves, so they compare exactly.
    """
    made = []
    for order, rule in enumerate(rules):
        phrases, needles = hits(topic, rule.phrases), hits(topic, rule.needles)
        score = phrases * 6 + needles * 4 + F.least(F.lit(4), hits(context, rule.needles))
        made.append(
            F.struct((-score).alias("minus"), F.lit(order).alias("order"), F.lit(rule.code).alias("code"), F.lit(rule.name).alias("name"), F.lit(rule.parent).alias("parent"), phrases.alias("phrases"), needles.alias("needles"))
        )
    return F.array_sort(F.array(*made))
