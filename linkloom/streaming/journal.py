"""Folding a journal as a stream, url by url."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.operators.journal import COMPLETIONS

OUTPUT = "u string, status string, sessions long, line long"


def fold_urls(events: DataFrame) -> DataFrame:
    """(u, status, sessions, line) in update mode: what is known of each url after a batch.

    events are streaming rows (line, session, t, u). The earliest line's completion wins, in whatever batch it
    comes; a url visited in two sessions without completion is quarantined. sessions is 2 for two or more.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, line, seen = state.get if state.exists else ("", -1, [])
        seen = set(seen)
        for frame in frames:
            seen = set(sorted(seen | set(frame.loc[frame["t"] == "v", "session"].astype(int)))[:2])  # two sessions tell all
            done = frame[frame["t"].isin(COMPLETIONS)].nsmallest(1, "line")
            if len(done) and (line < 0 or int(done["line"].iloc[0]) < line):
                kind, line = str(done["t"].iloc[0]), int(done["line"].iloc[0])
        state.update((kind, line, sorted(seen)))
        status = {"p": "page", "k": "skipped", "e": "error", "b": "blocked"}.get(kind) or ("quarantined" if len(seen) >= 2 else "open")
        yield pd.DataFrame({"u": [key[0]], "status": [status], "sessions": [len(seen)], "line": [line]})

    return events.groupBy("u").applyInPandasWithState(update, OUTPUT, "kind string, line long, seen array<long>", "update", GroupStateTimeout.NoTimeout)


def checkpoints(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, seconds: int = 2):
    """Run a stream that hands each batch to write, at most every so many seconds; its progress is kept in folder.

    A stream of ``progress.tail`` with max_lines has the other limit too: a checkpoint every so many lines or seconds.
    """
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", folder).trigger(processingTime=f"{seconds} seconds").start()
