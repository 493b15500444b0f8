"""Durations, backoff, deadlines and interval schedules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of a unit, by every name that it goes by (fixed values).
UNITS = {
    "ms": 1, "msec": 1, "msecs": 1, "millisecond": 1, "milliseconds": 1,
    "s": 1_000, "sec": 1_000, "secs": 1_000, "second": 1_000, "seconds": 1_000,
    "m": 60_000, "min": 60_000, "mins": 60_000, "minute": 60_000, "minutes": 60_000,
    "h": 3_600_000, "hr": 3_600_000, "hrs": 3_600_000, "hour": 3_600_000, "hours": 3_600_000,
    "d": 86_400_000, "day": 86_400_000, "days": 86_400_000,
    "w": 604_800_000, "week": 604_800_000, "weeks": 604_800_000,
}
TERM = r"(\d+(?:\.\d+)?)\s*([a-z]+)"
DEFAULT_START_TO_CLOSE_MS = 600_000


def duration_ms(text: Column) -> Column:
    """Milliseconds of "1h 30m" and the like; null for text of another form or with
    units that are not of a fixed length."""
    low = F.lower(F.trim(text))
    whole = low.rlike(rf"^{TERM}(\s*{TERM})*$")
    numbers = F.regexp_extract_all(low, F.lit(TERM), 1)
    units = F.regexp_extract_all(low, F.lit(TERM), 2)
    size = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])
    terms = F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.try_element_at(size, u))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(whole, F.floor(total + 0.5).cast("long"))


def duration_to_ms(value: int | float | str) -> int:
    """The same for a constant; raises on what ``duration_ms`` makes null."""
    if isinstance(value, (int, float)):
        return int(value + 0.5)
    low = value.strip().lower()
    terms = re.findall(TERM, low)
    if not re.fullmatch(rf"{TERM}(\s*{TERM})*", low) or any(u not in UNITS for _, u in terms):
        raise ValueError(f"not a duration: {value!r}")
    return int(sum(float(n) * UNITS[u] for n, u in terms) + 0.5)


def next_boundary(after: Column, every: Column, offset: Column) -> Column:
    """The first instant after ``after`` that is ``offset`` behind a multiple of ``every``."""
    return after - F.pmod(after - offset, every) + every


def next_fire(after: Column, every: Column, offset: Column, not_before: Column, not_after: Column) -> Column:
    """The next fire within bounds (first inclusive, last exclusive); null when there is none."""
    start = F.greatest(after, not_before - 1)  # greatest() skips nulls
    fire = next_boundary(start, every, offset)
    return F.when(not_after.isNull() | (fire < not_after), fire)


def catch_up(handled: Column, now: Column, every: Column, offset: Column) -> tuple[Column, Column]:
    """(nominal, delay) of one fire after an outage: what was missed collapses to the last one."""
    start = F.when(handled.isNull(), now).otherwise(F.greatest(handled, now - every))
    nominal = next_boundary(start, every, offset)
    return nominal, F.greatest(F.lit(0), nominal - now)


def backoff_ms(attempt: Column, initial: Column, coefficient: Column, cap: Column) -> Column:
    """Wait behind the ``attempt``-th failure: grows by the coefficient (2) up to the cap."""
    grown = initial * F.pow(F.coalesce(coefficient, F.lit(2.0)), attempt - 1)
    return F.when(initial.isNull(), F.lit(0.0)).otherwise(F.least(grown, cap))  # least() skips nulls


def should_retry(attempt: Column, maximum: Column) -> Column:
    """Whether another attempt follows; without a positive maximum there is one attempt."""
    return attempt < F.when(maximum > 0, maximum).otherwise(1)


def effective_timeout(start_to_close: Column, heartbeat: Column) -> Column:
    """The deadline of an attempt: 0 opts out, a heartbeat replaces the default."""
    return (
        F.when(start_to_close > 0, start_to_close)
        .when(start_to_close == 0, F.lit(None).cast("long"))
        .when(heartbeat > 0, F.lit(None).cast("long"))
        .otherwise(F.lit(DEFAULT_START_TO_CLOSE_MS).cast("long"))
    )


def spec_problems(every: Column, not_before: Column, not_after: Column) -> Column:
    """All that is wrong with an interval schedule, as an array."""
    found = F.array(
        F.when(every.isNull() | (every < 1), "every must be at least 1 ms"),
        F.when(not_before >= not_after, "the bounds leave no time"),
    )
    return F.filter(found, lambda x: x.isNotNull())


#: Milliseconds of the units that connectors accept, by name (fixed values); case counts.
CONNECTOR_UNITS = {
    "ms": 1, "millisecond": 1, "milliseconds": 1,
    "s": 1_000, "sec": 1_000, "secs": 1_000, "second": 1_000, "seconds": 1_000,
    "m": 60_000, "min": 60_000, "mins": 60_000, "minute": 60_000, "minutes": 60_000,
    "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000,
}


def connector_ms(text: Column) -> Column:
    """Milliseconds of one whole number and a unit, as connectors write them ("5m"); null for
    anything else: fractions, several terms, days and upper case."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^(\d+)\s*([a-z]+)$", i)
    size = F.create_map(*[F.lit(v) for pair in CONNECTOR_UNITS.items() for v in pair])
    return part(1).try_cast("long") * F.try_element_at(size, part(2))
