"""Status values: one map for each kind of source, and the order in which the worst wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each source's words mean.  The maps differ on purpose: `unavailable` and unknown words.
REPORT = {
    "pass": "passed", "passed": "passed", "pass_with_review": "passed_with_warnings", "passed_with_warnings": "passed_with_warnings",
    "warning": "passed_with_warnings", "warnings": "passed_with_warnings", "fail": "failed", "failed": "failed", "error": "failed", "unavailable": "passed_with_warnings",
}
RANKS = ("passed", "passed_with_warnings", "failed")


def from_map(status: Column, meaning: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    key = F.lower(F.btrim(F.coalesce(status, F.lit(""))))
    for word, means in meaning.items():
        out = F.when(key == word, F.lit(means)).otherwise(out)
    return out


def report_status(status: Column) -> Column:
    """As reports read it: unknown words are failures."""
    return from_map(status, REPORT, "failed")


def state_status(status: Column) -> Column:
    """As the state of a conversion reads it: `unavailable` stays, unknown words are unavailable."""
    return from_map(status, REPORT | {"unavailable": "unavailable"}, "unavailable")


def project_status(status: Column) -> Column:
    """As the project's overview reads it: skipped and unknown words are unavailable."""
    return from_map(status, REPORT | {"unavailable": "unavailable", "skipped": "unavailable"}, "unavailable")


def rank(status: Column) -> Column:
    out = F.lit(0)
    for k, word in enumerate(RANKS):
        out = F.when(status == word, F.lit(k)).otherwise(out)
    return out


def of_rank(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RANKS)), k + 1)


def worst(status: Column) -> Column:
    """Aggregate: failed before warnings before passed; passed if there is none."""
    return of_rank(F.coalesce(F.max(rank(status)), F.lit(0)))
