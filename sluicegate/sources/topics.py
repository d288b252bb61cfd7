"""Topic selection, discovery and preflight."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def topic_pattern(include: str, exclude: str = "", dead_letter: str = "") -> str:
    """A Java pattern for ``subscribePattern``: full matches of include, without those of exclude and the
    dead-letter topic."""
    banned = [p for p in (f"(?:{exclude})" if exclude else "", re.escape(dead_letter) if dead_letter else "") if p]
    return (f"(?!(?:{'|'.join(banned)})$)" if banned else "") + f"(?:{include})"


def selected(topic: Column, include: str, exclude: str = "", dead_letter: str = "") -> Column:
    return topic.rlike(f"^(?:{topic_pattern(include, exclude, dead_letter)})$")


def listed_topics(listing: str | None, configured: Iterable[str]) -> list[str]:
    """Topics of a comma list, else those of the thresholds."""
    named = [t.strip() for t in (listing or "").split(",") if t.strip()]
    return named or list(configured)


def discover_topics(records: DataFrame, include: str, exclude: str = "", dead_letter: str = "", limit: int = 500) -> DataFrame:
    """Distinct selected topics in order, the first ``limit`` of them."""
    return records.select("topic").where(selected(F.col("topic"), include, exclude, dead_letter)).distinct().orderBy("topic").limit(limit)


class TopicLister:
    """Refreshes a topic list; when listing fails the last list stays."""

    def __init__(self, listing: Callable[[], Iterable[str]], pattern: str, limit: int = 500, interval_ms: int = 60_000) -> None:
        self.listing, self.pattern, self.limit, self.interval_ms = listing, re.compile(pattern), limit, interval_ms
        self.topics: list[str] = []
        self.next_ms = 0

    def refresh(self, now_ms: int) -> list[str]:
        if now_ms >= self.next_ms:
            self.next_ms = now_ms + self.interval_ms
            try:
                self.topics = sorted(t for t in self.listing() if self.pattern.fullmatch(t))[: self.limit]
            except Exception:  # noqa: BLE001  the broker may be away for a while
                pass
        return self.topics


def preflight(existing: Iterable[str], required: Iterable[str]) -> None:
    """Fails when required topics are missing."""
    missing = sorted(set(required) - set(existing))
    if missing:
        raise ValueError(f"missing topics: {', '.join(missing)}")
