"""Identifiers and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_suffix(identifier: Column) -> Column:
    """The number behind the last dash of an id, or null."""
    return F.regexp_extract(identifier, r"-(\d+)$", 1).try_cast("long")


def file_name(identifier: Column) -> Column:
    """A file name for an id: safe characters, 64 at most, and eight digits of its SHA-1."""
    safe = F.regexp_replace(identifier, r"[^a-zA-Z0-9._-]", "_")
    return F.concat(F.substring(safe, 1, 64), F.lit("-"), F.substring(F.sha1(identifier.cast("binary")), 1, 8))


def child_id(parent: Column, run: Column, seq: Column) -> Column:
    return F.concat_ws(".", parent, run.cast("string"), seq.cast("string"))


def is_power_of_two(n: Column) -> Column:
    """Which of repeated failures are reported: the 1st, 2nd, 4th, 8th and so on."""
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def status_kind(status: Column) -> Column:
    """The kind of error that an HTTP status stands for."""
    return (
        F.when(status.isin(401, 403), "auth")
        .when(status == 404, "not_found")
        .when(status == 409, "conflict")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "unavailable")
        .otherwise("invalid")
    )


#: Kinds of connector errors, and whether trying again may help (fixed values).
RETRYABLE = {
    "invalid": False, "notFound": False, "conflict": False, "denied": False,
    "unavailable": True, "upstream": True, "drift": False,
}


def retryable(kind: Column) -> Column:
    """Whether a connector error of a kind is worth another attempt; kinds that are not known
    are left to the retry policy, so they are."""
    known = F.create_map(*[F.lit(v) for pair in RETRYABLE.items() for v in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(True))
