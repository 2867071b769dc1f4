"""Sunspot and magnetic class scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Codes of the three letters of a sunspot class.
SIZE_CODES = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "H": 7, "J": 8}
SHAPE_CODES = {"X": 0, "R": 1, "S": 2, "A": 3, "H": 4, "K": 5}
# Keywords of a magnetic class and what each adds to the score.
MAGNETIC_POINTS = {"alpha": 1.0, "beta": 2.0, "gamma": 3.0, "delta": 4.0}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def magnetic_complexity(text: Column | str) -> Column:
    """Canonical magnetic class: the strongest keyword decides, other text passes through."""
    raw = _col(text)
    low = F.lower(raw)
    return (
        F.when(raw.isNull() | (raw == ""), "unknown")
        .when(low.contains("delta"), "beta-gamma-delta")
        .when(low.contains("gamma"), "beta-gamma")
        .when(low.contains("beta"), "beta")
        .when(low.contains("alpha"), "alpha")
        .otherwise(raw)
    )


def polarity(text: Column | str) -> Column:
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    mixed = low.contains("beta") | low.contains("gamma") | low.contains("delta")
    return F.when(mixed, "mixed").otherwise("unknown")


def _code(letter: Column, codes: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, letter), F.lit(0))


def sunspot_letters(text: Column | str) -> tuple[Column, Column, Column]:
    """Size, shape and third letter; fewer than three letters give the size only."""
    t = F.upper(F.trim(_col(text)))
    whole = F.length(t) >= 3
    return (
        F.when(F.length(t) >= 1, F.substring(t, 1, 1)),
        F.when(whole, F.substring(t, 2, 1)),
        F.when(whole, F.substring(t, 3, 1)),
    )


def sunspot_codes(text: Column | str) -> tuple[Column, Column, Column]:
    size, shape, third = sunspot_letters(text)
    return _code(size, SIZE_CODES), _code(shape, SHAPE_CODES), _code(third, SHAPE_CODES)


def sunspot_score(text: Column | str) -> Column:
    """0..1: size weighs 40 %, shape and third letter 30 % each."""
    size, shape, third = sunspot_codes(text)
    return size / F.lit(8.0) * 0.4 + shape / F.lit(5.0) * 0.3 + third / F.lit(5.0) * 0.3


def magnetic_flags(text: Column | str) -> dict[str, Column]:
    """0/1 per keyword."""
    low = F.lower(F.trim(F.coalesce(_col(text), F.lit(""))))
    return {word: low.contains(word).cast("int") for word in MAGNETIC_POINTS}


def magnetic_score(text: Column | str, preferred: Column | str | None = None) -> Column:
    """0..1 from the keywords; ``preferred`` is read first when it is not empty."""
    source = _col(text)
    if preferred is not None:
        other = _col(preferred)
        source = F.when(other.isNotNull() & (other != ""), other).otherwise(source)
    flags = magnetic_flags(source)
    points = sum((flags[w] * F.lit(p) for w, p in MAGNETIC_POINTS.items()), F.lit(0.0))
    return F.least(points / 4, F.lit(1.0))
