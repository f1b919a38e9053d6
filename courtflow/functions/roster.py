"""Player names from recording titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of titles: leading date, versus word, separators, names.
DATE = r"^\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s+"
VERSUS = r"(?i)\s+(?:vs\.?|versus)\s+"
SEPARATOR = r"\s*(?:&|\+|,|/)\s*"
CAMEL = r"([A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)?)"
NAME = r"^[A-Za-z][A-Za-z .'-]{0,63}$"


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _team(text: Column) -> Column:
    text = stripped(text)
    parts = F.filter(F.transform(F.split(text, SEPARATOR), stripped), lambda p: p != "")
    listed = (F.size(parts) == 2) & F.forall(parts, lambda p: p.rlike(NAME))
    joined = F.regexp_replace(text, r"\s+", "")
    camel = F.regexp_extract_all(joined, F.lit(CAMEL), F.lit(1))
    run_on = (F.size(camel) == 2) & (F.array_join(camel, "") == joined)
    return F.when(listed, parts).when(run_on, camel)


def roster(title: Column) -> Column:
    """Four distinct names in title order, or null when the title is not clear."""
    sides = F.split(F.regexp_replace(stripped(title), DATE, ""), VERSUS, 2)
    names = F.when(F.size(sides) == 2, F.concat(_team(F.get(sides, F.lit(0))), _team(F.get(sides, F.lit(1)))))
    return F.when(F.size(F.array_distinct(F.transform(names, F.lower))) == 4, names)
