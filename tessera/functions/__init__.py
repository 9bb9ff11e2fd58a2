"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_of(timestamp: Column, seconds: int = 60) -> Column:
    """Interval number of a time in seconds; division truncates towards zero, so -61 is in interval -1."""
    return F.call_function("div", timestamp, F.lit(seconds))


def is_extreme(temperature: Column, high: float = 40.0, low: float = 0.0) -> Column:
    """Whether a temperature is at least high or at most low."""
    return (temperature >= high) | (temperature <= low)


def inserted(content: Column, text: Column, position: Column) -> Column:
    """content with text put in before the code point at position, counted from 0."""
    return F.overlay(content, text, (position + 1).cast("int"), F.lit(0))


def fits(position: Column, content: Column) -> Column:
    """Whether position is a place in content: 0 to its length in code points."""
    return position.between(0, F.char_length(content))


def known_number(text: Column, kind: str) -> Column:
    """text as a number of the kind, or null; NaN is no number."""
    value = text.try_cast(kind)
    return F.when(F.isnan(value), None).otherwise(value) if kind == "double" else value


def parts_of(text: Column, kinds: list[str], separator: str = ":") -> Column:
    """A struct (p0, p1, ...) of a text such as `3:4:0.5`, each part as its kind; null unless there are as many parts and all are of their kinds."""
    parts = F.split(text, f"\\Q{separator}\\E", -1)
    made = [F.get(parts, F.lit(k)).try_cast(kind) for k, kind in enumerate(kinds)]
    good = F.size(parts) == len(kinds)
    for m in made:
        good = good & m.isNotNull()
    return F.when(good, F.struct(*(m.alias(f"p{k}") for k, m in enumerate(made))))


def setting(text: Column, name: str) -> Column:
    """The value of `name=value`, null where text does not begin so."""
    return F.when(F.startswith(text, F.lit(f"{name}=")), F.substr(text, F.lit(len(name) + 2)))
