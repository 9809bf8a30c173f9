"""Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Party accounts and their display names.
PARTY_NAMES = {
    "cdu": "CDU",
    "spdde": "SPD",
    "csu": "CSU",
    "fdp": "FDP",
    "die_gruenen": "Die Grünen",
}


def not_blank(text: Column) -> Column:
    """True where the text holds a character that is not Unicode white space."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def exact_sum(column: str) -> Column:
    """Sum of doubles with at most twelve decimal places that does not depend on the order of the rows."""
    return F.sum(F.col(column).cast("decimal(38,12)")).cast("double")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, and 0 where the bottom is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def row_id(day: Column, name: Column) -> Column:
    """Key of an output row, such as ``2021-03_name``."""
    return F.concat_ws("_", month_label(day), name)


def display_name(account: Column, names: dict[str, str] | None = None) -> Column:
    """Display name of a known account; any other account stays as it is."""
    pairs = [F.lit(x) for pair in (names or PARTY_NAMES).items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), account), account)


def class_probability(name: str, label: Column, score: Column) -> Column:
    """Score of the predicted class, and one minus it for each other class."""
    return F.when(label == name, score).otherwise(1 - score)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where either side does not vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))
