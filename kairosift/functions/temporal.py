"""Historical dates: recognition in text, order keys, bounds and relations as columns.

Years are signed, -44 is 44 BCE and there is no year 0; months and days may be missing, so a date is three nullable
integers and is compared by an order key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammar, its forms in the order in which they are tried; a form's name begins with its precision.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
_MONTH = rf"(?P<month>{'|'.join(sorted(MONTHS, key=len, reverse=True))})\.?"
_ERA = r"(?P<era>BCE|BC|CE|AD)"
_NTH = r"(?:st|nd|rd|th)"
_ANY_YEAR = rf"(?P<year>\d{{1,4}})(?:\s*{_ERA})?"
_SURE_YEAR = rf"(?:(?P<year>\d{{3,4}})|(?P<old>\d{{1,4}})\s*{_ERA})"
FORMS = {
    "DAY_ISO": r"(?P<year>\d{4})-(?P<number>\d{2})-(?P<day>\d{2})",
    "DAY_FIRST": rf"(?P<day>\d{{1,2}}){_NTH}?\s+{_MONTH}\s+{_ANY_YEAR}",
    "DAY_SECOND": rf"{_MONTH}\s+(?P<day>\d{{1,2}}){_NTH}?,?\s+{_ANY_YEAR}",
    "SEASON": rf"(?:spring|summer|autumn|fall|winter)\s+{_SURE_YEAR}",
    "CENTURY": rf"(?P<nth>\d{{1,2}}){_NTH}\s+century(?:\s*{_ERA})?",
    "DECADE": r"(?P<year>\d{3,4})s",
    "MONTH": rf"{_MONTH}\s+{_SURE_YEAR}",
    "YEAR_ERA": rf"(?P<year>\d{{1,4}})\s*{_ERA}",
    "YEAR": r"(?P<year>1\d{3}|20\d{2})",
}
_RELATIVE = r"(?:\d+|a|one|two|three|four|five|several|many)\s+(?:years?|months?|days?|decades?|centuries|century)\s+(?:later|earlier|afterwards?|after|before|ago)"
_UNSURE = r"(?:possibly|perhaps|probably|allegedly|reportedly|may have|might have)\b\W*$"
_ROUGH = r"(?:\bc\.|\bca\.|circa|around|about|roughly|approx\w*)\s*$"
HEDGE_WINDOW = 24


def _date(place: str) -> str:
    """A date of any form; its groups, and its form's, are named after its place in the whole pattern."""
    named = lambda form, pattern: f"(?P<{place}_{form}>" + pattern.replace("(?P<", f"(?P<{place}_{form}_") + ")"
    return f"(?:{'|'.join(named(form, pattern) for form, pattern in FORMS.items())})"


#: The places of the first and the second date of each kind of expression.
_PLACES = {"between": ("a", "b"), "dash": ("c", "d"), "single": ("e",), "relative": ()}
_ALL = re.compile(
    rf"(?P<between>(?:from|between)\s+{_date('a')}\s+(?:to|until|and|through)\s+{_date('b')})|(?P<dash>{_date('c')}\s*[–—]\s*{_date('d')})|(?P<relative>{_RELATIVE})|(?P<single>{_date('e')})", re.I
)
_HEDGES = ((re.compile(_UNSURE, re.I), "UNCERTAIN"), (re.compile(_ROUGH, re.I), "APPROXIMATE"))

#: Precision, then start and end (year, month, day).
Reading = tuple[str, tuple, tuple]
_NONE = (None, None, None)


def _reading(groups: dict[str, str | None], place: str) -> Reading:
    """The date at a place, from the groups of the form that it has there."""
    form = next(f for f in FORMS if groups[f"{place}_{f}"] is not None)
    part = lambda name: groups.get(f"{place}_{form}_{name}")
    precision = form.partition("_")[0]
    sign = -1 if (part("era") or "").upper().startswith("B") else 1
    if precision == "CENTURY":
        years = sorted(sign * y for y in (100 * int(part("nth")) - 99, 100 * int(part("nth"))))
        return precision, (years[0], None, None), (years[1], None, None)
    year = sign * int(part("year") or part("old"))
    if precision == "DECADE":
        return precision, (year, None, None), (year + 9, None, None)
    month = int(part("number")) if part("number") else MONTHS.get((part("month") or "").lower())
    return precision, (year, month, int(part("day")) if part("day") else None), _NONE


def mentions(text: str) -> Iterator[tuple]:
    """(start, end, text, precision, certainty, start y, m, d, end y, m, d) of each date expression; offsets in code points."""
    for found in _ALL.finditer(text):
        groups = found.groupdict()
        kind = next(k for k in _PLACES if groups[k] is not None)
        dates = [_reading(groups, place) for place in _PLACES[kind]]
        before = text[max(0, found.start() - HEDGE_WINDOW) : found.start()]
        certainty = next((name for pattern, name in _HEDGES if pattern.search(before)), "EXACT")
        if not dates:  # relative to what isn't said
            precision, first, last, certainty = "UNKNOWN", _NONE, _NONE, "UNCERTAIN"
        elif len(dates) == 1:
            precision, first, last = dates[0]
        else:
            precision, first, last = "RANGE", dates[0][1], max(dates[1][2], dates[1][1], key=lambda d: d != _NONE)
        yield (*found.span(), found.group(), precision, certainty, *first, *last)


_COLUMNS = ["start_offset", "end_offset", "text", "precision", "certainty", "start_year", "start_month", "start_day", "end_year", "end_month", "end_day"]


def recognize(blocks: DataFrame) -> DataFrame:
    """Mentions of ``blocks`` (doc_id, block_id, text), a row each; an unreadable block has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(b.doc_id, b.block_id, *m) for b in pdf.itertuples() if b.text for m in mentions(b.text)]
            out = pd.DataFrame(rows, columns=["doc_id", "block_id", *_COLUMNS])
            yield out.astype({c: "Int32" for c in _COLUMNS[5:]})

    kinds = ", ".join(f"{c} {'string' if c in ('text', 'precision', 'certainty') else 'int'}" for c in _COLUMNS)
    return blocks.select("doc_id", "block_id", "text").mapInPandas(run, f"doc_id long, block_id string, {kinds}")


def order_key(year: Column, month: Column, day: Column) -> Column:
    return year * 372 + (month - 1) * 31 + (day - 1)


def with_bounds(dates: DataFrame, plain: bool = False) -> DataFrame:
    """Adds bound_low and bound_high, null where unresolved; a single date keeps its precision unless ``plain``."""
    low = order_key(F.col("start_year"), F.coalesce("start_month", F.lit(1)), F.coalesce("start_day", F.lit(1)))
    month = F.coalesce("end_month", F.lit(12)) if plain else F.coalesce("end_month", F.when(F.col("end_year").isNull(), F.col("start_month")), F.lit(12))
    day = F.coalesce("end_day", F.lit(31)) if plain else F.coalesce("end_day", F.when(F.col("end_year").isNull(), F.col("start_day")), F.lit(31))
    high = F.when(F.col("start_year").isNotNull(), order_key(F.coalesce("end_year", "start_year"), month, day))
    return dates.withColumns({"bound_low": low, "bound_high": high})


def relation(kind: str, low: Column, high: Column, q_low: Column, q_high: Column, tolerance: int = 0) -> Column:
    """Whether a date's bounds stand in the relation to the asked ones; null bounds never do."""
    holds = {
        "OVERLAP": (low <= q_high) & (high >= q_low),
        "BEFORE": high < q_low,
        "AFTER": low > q_high,
        "AROUND": (low <= q_high + tolerance) & (high >= q_low - tolerance),
    }[kind]
    return F.coalesce(holds & (low <= high), F.lit(False))


def recurs(month: Column, day: Column, m: int, d: int) -> Column:
    return F.coalesce((month == m) & (day == d), F.lit(False))


def years_apart(a: Column, b: Column) -> Column:
    """Years between two signed years; there is no year 0."""
    return F.abs(a - b) - F.when((a < 0) != (b < 0), F.lit(1)).otherwise(F.lit(0))


def decade_end(year: Column) -> Column:
    return year + 9


def century_bounds(n: Column, bce: Column) -> tuple[Column, Column]:
    first, last = n * 100 - 99, n * 100
    return F.when(bce, -last).otherwise(first), F.when(bce, -first).otherwise(last)


PRECISION_RANK = {"DAY": 6, "MONTH": 5, "SEASON": 4, "YEAR": 3, "DECADE": 2, "CENTURY": 1, "RANGE": 0, "UNKNOWN": -1}


def precision_rank(precision: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in PRECISION_RANK.items() for x in p])[precision]
