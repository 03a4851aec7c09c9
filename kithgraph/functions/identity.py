"""Identity-value normalisation as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from . import vocabulary as v


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    found = F.try_element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, default)


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def placeholder_to_null(text: Column) -> Column:
    text = strip(text)
    return F.when(~F.lower(text).isin(v.PLACEHOLDERS), text)


def _one_char_repeated(text: Column) -> Column:
    return text.rlike(r"^(.)\1*$")


def phone_key(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\P{Nd}", "")
    last = F.right(digits, F.lit(10))
    return F.when((F.length(digits) >= 7) & ~_one_char_repeated(last), last)


def email_key(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^[^@].*@.*[^@]$"), F.lower(text))


def address_key(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    short = literal_map(v.STREET_WORDS)
    return F.nullif(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " "), F.lit(""))


def account_number_key(text: Column) -> Column:
    """National IDs, bank accounts and cards."""
    compact = F.regexp_replace(F.lower(text), "[^0-9a-z]", "")
    return F.when((F.length(compact) >= 4) & ~_one_char_repeated(compact), compact)


def ip_key(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(~lowered.isin(v.NON_ROUTABLE_IPS), lowered)


def plain_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\s+", " ")


def key_of(kind: Column, text: Column) -> Column:
    """The matching key of a usable text, NULL when its type rejects it."""
    return (
        F.when(kind == "phone", phone_key(text))
        .when(kind == "email", email_key(text))
        .when(kind == "address", address_key(text))
        .when(kind.isin(v.SENSITIVE_TYPES), account_number_key(text))
        .when(kind == "ip", ip_key(text))
        .otherwise(plain_key(text))
    )


def identity_key(kind: Column, raw: Column) -> Column:
    """The matching key of one identity value, NULL when unusable."""
    return key_of(kind, placeholder_to_null(raw))


def hashed(key: Column) -> Column:
    return F.sha2(key, 256)


def attribute_id(kind: Column, key: Column) -> Column:
    """Typed matching key; sensitive values are stored only as a hash."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin(v.SENSITIVE_TYPES), hashed(key)).otherwise(key))


def display_value(kind: Column, raw: Column, key: Column) -> Column:
    return F.when(
        kind.isin(v.SENSITIVE_TYPES), F.concat(F.lit("•••• "), F.right(key, F.lit(4)))
    ).otherwise(strip(raw))


def name_words(text: Column) -> Column:
    """Lower-case words of a snake, camel or spaced name."""
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def attribute_type(raw: Column) -> Column:
    words = name_words(raw)
    joined = F.array_join(words, "")
    result = lookup(v.ATTRIBUTE_SYNONYMS, joined)
    for prefix in v.ATTRIBUTE_PREFIXES:
        result = F.coalesce(result, F.when(joined.startswith(prefix), F.lit(prefix)))
    snake = F.array_join(words, "_")
    return F.coalesce(result, F.nullif(snake, F.lit("")), F.lit("identifier"))


def event_type(raw: Column) -> Column:
    snake = F.array_join(name_words(raw), "_")
    return F.coalesce(F.try_element_at(literal_map(v.EVENT_SYNONYMS), snake), F.nullif(snake, F.lit("")), F.lit("event"))


def joined_address(parts: list[Column]) -> Column:
    """Several address columns as one value, blanks skipped."""
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))
