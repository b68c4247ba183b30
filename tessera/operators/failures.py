"""Failures that a new session may repair, and when a source asks for one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import Machine

# Statuses and words of a provider's answer that say that a session has ended.
STATUSES = (400, 401, 403)
WORDS = r"invalid[_ ]argument|expired|invalid session|session token"


def session_failure(status: Column, body: Column) -> Column:
    """By the status, or by the answer's body alone: a URL names sessions in any case.  Nulls say nothing."""
    return F.coalesce(status.isin(*STATUSES), F.lit(False)) | F.coalesce(body.rlike(f"(?i){WORDS}"), F.lit(False))


def refreshes(within_ms: int = 10_000, cooldown_ms: int = 30_000) -> Machine:
    """When the failures of a source ask for a new session: five within ``within_ms``, unless the last refresh is younger than
    ``cooldown_ms``.  A refresh forgets the failures; other failures (``counts`` false) leave no trace."""
    never = -1_000_000_000_000
    asks = f"(b.counts AND a.oldest >= b.at_ms - {within_ms} AND b.at_ms - a.refreshed_at >= {cooldown_ms})"

    def moved(name: str, after: str) -> tuple[str, str, str, str]:
        return name, "BIGINT", str(never), f"CASE WHEN {asks} THEN {never} WHEN b.counts THEN {after} ELSE a.{name} END"

    return Machine(
        fields=(
            moved("oldest", "a.older"), moved("older", "a.newer"), moved("newer", "a.newest"), moved("newest", "b.at_ms"),
            ("refreshed_at", "BIGINT", str(never), f"CASE WHEN {asks} THEN b.at_ms ELSE a.refreshed_at END"),
            ("refreshes", "BIGINT", "0", f"a.refreshes + CASE WHEN {asks} THEN 1 ELSE 0 END"),
            ("counted", "BIGINT", "0", "a.counted + CASE WHEN b.counts THEN 1 ELSE 0 END"),
        ),
        inputs=(("at_ms", "BIGINT"), ("counts", "BOOLEAN")),
    )
