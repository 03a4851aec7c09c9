"""Labels, numbers, dates and name assembly as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocabulary as v

# Text removed from a number, and what then counts as a number.
NUMBER_NOISE = r"(?U)[,\s$€£₹%]"
NUMBER_SHAPE = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"

ISO_SHAPE = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ].*)?)?)?$"

# Accepted shapes of a date and how each is read; month first where both readings fit.
DATE_SHAPES = [
    (r"\d{8}", ["yyyyMMdd"]),
    (r"\d{4}-\d{1,2}-\d{1,2}", ["yyyy-M-d"]),
    (r"\d{4}/\d{1,2}/\d{1,2}", ["yyyy/M/d"]),
    (r"\d{1,2}/\d{1,2}/\d{4}", ["M/d/yyyy", "d/M/yyyy"]),
    (r"\d{1,2}/\d{1,2}/\d{2}", ["M/d/yy", "d/M/yy"]),
    (r"\d{1,2}-\d{1,2}-\d{4}", ["M-d-yyyy", "d-M-yyyy"]),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", ["M.d.yyyy", "d.M.yyyy"]),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", ["d MMM yyyy"]),
    (r"\d{1,2}-[A-Za-z]{3}-\d{4}", ["d-MMM-yyyy"]),
    (r"\d{1,2}-[A-Za-z]{3}-\d{2}", ["d-MMM-yy"]),
    (r"\d{1,2} [A-Za-z]{4,} \d{4}", ["d MMMM yyyy"]),
    (r"[A-Za-z]{3} \d{1,2} \d{4}", ["MMM d yyyy"]),
    (r"[A-Za-z]{4,} \d{1,2} \d{4}", ["MMMM d yyyy"]),
]
# A time of day may follow, of 12 or 24 hours, with a fraction and an offset, or as plain digits.
CLOCK_SHAPE = r"([T ]\d.*)?$"
CLOCK = "[['T'][ ]h:mm[:ss][.SSSSSS][ ]a][['T'][ ]H:mm[:ss][.SSSSSS][ ][XXX]]['T'HHmmss]"


def parse_label(text: Column) -> Column:
    """1, 0 or NULL."""
    word = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when(word.isin(v.POSITIVE_WORDS), F.lit(1)).when(word.isin(v.NEGATIVE_WORDS), F.lit(0))


def to_number(text: Column) -> Column:
    clean = F.regexp_replace(text, NUMBER_NOISE, "")
    return F.when(clean.rlike(NUMBER_SHAPE), clean.try_cast("double"))


def to_moment(text: Column) -> Column:
    """Timestamp of a date, with or without a time of day, written in any accepted shape; NULL when unreadable.

    The shape decides the format first, so a row pays for one or two parses and not for a failed
    parse per format.
    """
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    plain = F.regexp_replace(F.regexp_replace(text, ",", ""), r"(?i)\bsept\b", "Sep")
    parsed = F.when(text.rlike(ISO_SHAPE) & text.try_cast("timestamp").isNotNull(), text.try_cast("timestamp"))
    for shape, formats in DATE_SHAPES:
        reading = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f + CLOCK)) for f in formats])
        if formats[0].endswith(("/yy", "-yy")):  # 69 to 99 are years of the last century
            reading = F.when(F.year(reading) >= 2069, reading - F.expr("interval 100 years")).otherwise(reading)
        parsed = parsed.when(plain.rlike(f"^{shape}{CLOCK_SHAPE}"), reading)
    return parsed


def full_name(parts: list[Column], fallback: Column) -> Column:
    joined = F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(joined, F.lit("")), fallback)


def as_fraction(values: Column, largest: Column) -> Column:
    """Utilization given in percent (seen from its largest value) as a fraction, never below zero."""
    return F.greatest(F.when(largest > 1.5, values / 100.0).otherwise(values), F.lit(0.0))


def log_standardised(values: Column, mean: Column, sd: Column) -> Column:
    shifted = F.log1p(F.greatest(values, F.lit(0.0))) - mean
    return shifted / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def risk_level(score: Column, threshold: Column | float) -> Column:
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score >= threshold, "high").when(score >= threshold / 2, "medium").otherwise("low")


def equal_width_bin(value: Column, edges: list[float]) -> Column:
    """Index of the bin holding ``value``: the number of inner edges at or below it.

    Literal edges, because bucket arithmetic rounds 0.15 into another bin than the edge list does.
    """
    inner = edges[1:-1]
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in inner]), lambda e: e <= value))


def unit_edges(bins: int) -> list[float]:
    """Edges of ``bins`` equal bins over [0, 1], each computed as index times step."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]
