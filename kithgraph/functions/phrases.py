"""Sentences built from templates as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import vocabulary as v
from .identity import literal_map


def whole(value: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.bround(value, 0).cast("bigint")


def grouped(value: Column) -> Column:
    """1,234 for whole numbers, 1,234.50 for others."""
    return F.when(F.abs(value - F.bround(value, 0)) < 1e-9, F.format_number(value, 0)).otherwise(F.format_number(value, 2))


def percent(value: Column) -> Column:
    return F.concat(whole(value * 100).cast("string"), F.lit("%"))


def one_decimal(value: Column) -> Column:
    return F.regexp_replace(F.format_number(value, 1), ",", "")


def word_for(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, F.lit(one)).otherwise(F.lit(many))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 20))


def spoken_list(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(head, F.lit(" and "), F.try_element_at(items, F.lit(-1))))


def _with_spaces(kind: Column) -> Column:
    return F.replace(kind, F.lit("_"), F.lit(" "))


def kind_noun(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(v.TYPE_NOUN), kind), _with_spaces(kind))


def kind_plural(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(v.TYPE_PLURAL), kind), F.concat(_with_spaces(kind), F.lit(" values")))


def kind_with_article(kind: Column) -> Column:
    other = F.concat(F.lit("an identifier ("), _with_spaces(kind), F.lit(")"))
    return F.coalesce(F.try_element_at(literal_map(v.TYPE_WITH_ARTICLE), kind), other)


def fill(template: str, fields: dict[str, Column] | Callable[[str], Column]) -> Column:
    """A template with its {fields} replaced."""
    pick = fields if callable(fields) else fields.__getitem__
    parts = []
    for i, piece in enumerate(re.split(r"\{([^}]*)\}", template)):
        if i % 2:
            parts.append(pick(piece).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def clause(feature: Column, value: Column, raised: Column, label: Column) -> Column:
    """What one feature value says about the account, NULL where it would read as nonsense."""
    n = whole(value)
    kind = F.regexp_replace(feature, "_shared_count$", "")

    def say(template: str, kind_text: Column) -> Column:
        fields = {
            "n": n, "pct": percent(value), "points": whole(value * 100), "v1": one_decimal(value),
            "num": grouped(value), "label": label, "kind": kind_text,
        }
        return fill(template, lambda name: word_for(n, *name.split("|")) if "|" in name else fields[name])

    def matches(name: str) -> Column:
        return feature.endswith(name[1:]) if name.startswith("*_") else feature == name

    text = None
    for name, template in v.CLAUSE.items():
        said = say(template, kind_with_article(kind))
        zero = whole(value * 100) == 0 if name == "utilization_range" else n == 0
        if name in v.CLAUSE_AT_ZERO:
            said = F.when(zero, F.lit(v.CLAUSE_AT_ZERO[name])).otherwise(said)
        if name in v.CLAUSE_AT_ZERO_WHEN_DOWN:
            down = say(v.CLAUSE_AT_ZERO_WHEN_DOWN[name], kind_noun(kind))
            said = F.when(n > 0, said).when(~raised, down)
        if name == "*":
            return text.otherwise(said)
        text = F.when(matches(name), said) if text is None else text.when(matches(name), said)
    raise AssertionError("the catch-all clause must come last")
