"""Event class scalars: flux to class, class text, ranks, risk and display levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lower flux bound of each class, strongest first (W/m^2).
CLASS_FLOORS = {"X": 1e-4, "M": 1e-5, "C": 1e-6, "B": 1e-7}
# Order of the classes when filtering, and as forward labels.
FILTER_RANK = {"B": 1, "C": 2, "M": 3, "X": 4}
LABEL_RANK = {"None": 0, "C": 1, "M": 2, "X": 3}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_decimal(x: Column) -> Column:
    """Rounding that halves upward on the binary value, the same in every engine."""
    return F.floor(x * 10 + 0.5) / F.lit(10.0)


def class_letter(flux: Column | str) -> Column:
    f = _col(flux)
    return F.when(f.isNull(), None).when(f >= 1e-4, "X").when(f >= 1e-5, "M").when(f >= 1e-6, "C").otherwise("B")


def class_magnitude(flux: Column | str) -> Column:
    f = _col(flux)
    scaled = F.when(f >= 1e-4, f / 1e-4).when(f >= 1e-5, f / 1e-5).when(f >= 1e-6, f / 1e-6).otherwise(f / 1e-7)
    return one_decimal(scaled)


def class_label(flux: Column | str) -> Column:
    """Letter and magnitude, e.g. M5.5; a magnitude may read 10.0 just below the next class."""
    return F.concat(class_letter(flux), F.format_string("%.1f", class_magnitude(flux)))


def parsed_class(text: Column | str) -> tuple[Column, Column]:
    """(letter, magnitude) of a class text; both null when either part is unreadable."""
    t = _col(text)
    letter = F.upper(F.substring(t, 1, 1))
    number = F.substring(t, 2, 64).try_cast("double")
    valid = number.isNotNull() & (F.length(letter) == 1)
    return F.when(valid, letter), F.when(valid, number)


def rank_of(letter: Column | str, ranks: dict[str, int]) -> Column:
    """Rank of a class letter; unknown letters rank 0."""
    c = _col(letter)
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def rank_name(rank: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in ranks.items():
        out = F.when(rank == value, name).otherwise(out)
    return out


def _p(probs: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(probs, F.lit(name)), F.lit(0.0))


def risk_level(probs: Column | str) -> Column:
    """Four-step risk of a class-probability map."""
    p = _col(probs)
    x, m = _p(p, "X"), _p(p, "M")
    return F.when(x > 0.20, "EXTREME").when((x > 0.05) | (m > 0.70), "HIGH").when(m > 0.30, "MEDIUM").otherwise("LOW")


def _top_two(probs: Column) -> tuple[Column, Column]:
    ranked = F.reverse(F.array_sort(F.map_values(probs)))
    top = F.coalesce(F.get(ranked, 0), F.lit(0.0))
    return top, top - F.coalesce(F.get(ranked, 1), F.lit(0.0))


def confidence(probs: Column | str) -> tuple[Column, Column]:
    """(band, score 10..100) from the best probability and its lead over the runner-up."""
    top, lead = _top_two(_col(probs))
    high = (top >= 0.7) & (lead >= 0.3)
    normal = (top >= 0.5) | (lead >= 0.2)
    band = F.when(high, "high").when(normal, "normal").otherwise("low")
    score = (
        F.when(high, F.least(F.lit(100.0), 100 * top + 50 * lead))
        .when(normal, F.least(F.lit(90.0), 100 * top + 30 * lead))
        .otherwise(F.greatest(F.lit(20.0), 100 * top))
    )
    return band, F.greatest(F.lit(10.0), F.least(F.lit(100.0), score))


def display_level(probs: Column | str) -> tuple[Column, Column]:
    """(class, level): the best of C, M, X from 5 % on, with a strength word."""
    p = _col(probs)
    c, m, x = _p(p, "C"), _p(p, "M"), _p(p, "X")
    best = F.greatest(c, m, x)
    pick = F.when(best < 0.05, "None").when(c == best, "C").when(m == best, "M").otherwise("X")
    level = (
        F.when(pick == "None", "None")
        .when(pick == "X", "Extreme")
        .when(pick == "M", F.when(best >= 0.5, "Strong").when(best >= 0.25, "Moderate").otherwise("Minor"))
        .otherwise(F.when(best >= 0.5, "Moderate").otherwise("Minor"))
    )
    return pick, level
