"""Pacing of requests by host, in one state for all workers: slots at a rate, and a backoff that throttled answers open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.functions.http import BACKOFF_MS

OUTPUT = "host string, url string, slot long, streak long"
_STATE = "next long, until long, streak long, waiting array<string>"


def _after(answer: tuple, until: int, streak: int, most: int) -> tuple[int, int]:
    """The backoff's end and the streak after an answer (t, status, retry_ms)."""
    t, status, retry = answer
    if status not in (429, 503):
        return until, max(0, streak - 1)
    wait = min(most, retry if retry > 0 else BACKOFF_MS * 2 ** min(streak, 30))
    return max(until, t + wait), streak + 1


def paced(events: DataFrame, gap_ms: int, max_backoff_ms: int = 300_000) -> DataFrame:
    """(host, url, slot, streak) of a stream of events (host, t, url, status, retry_ms): each url asked for with the time at which it may be fetched.

    A row with a status is an answer, others ask for their url; t is milliseconds since the epoch. All events of a
    host meet in one state, whatever task or worker they come from: urls wait in it, in order of t, while a
    backoff lasts, and go out one per gap when it has passed, on a timer if nothing else comes. A
    throttled answer (429, 503) opens a backoff of its Retry-After, else of 5 s doubling with the streak, at most max_backoff_ms;
    any other shortens the streak. A state holds the urls that wait for its host.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        after, until, streak, waiting = state.get if state.exists else (0, 0, 0, [])
        waiting = list(waiting)
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            frames = iter(())
        rows = pd.concat(list(frames) or [pd.DataFrame(columns=["t", "url", "status", "retry_ms"])]).sort_values(["t", "url"], kind="stable")
        for t, url, status, retry in zip(rows["t"], rows["url"], rows["status"], rows["retry_ms"], strict=True):
            if pd.isna(status):
                waiting.append(url)
            else:
                until, streak = _after((int(t), int(status), 0 if pd.isna(retry) else int(retry)), until, streak, max_backoff_ms)
        gone: list[tuple] = []
        if until <= now:
            for url in waiting:
                after = max(after, now)
                gone.append((key[0], url, after, streak))
                after += gap_ms
            waiting = []
        state.update((after, until, streak, waiting))
        if waiting:
            state.setTimeoutDuration(max(1, until - now))
        yield pd.DataFrame(gone, columns=["host", "url", "slot", "streak"])

    return events.groupBy("host").applyInPandasWithState(update, OUTPUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
