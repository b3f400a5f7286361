"""Live segments and frames as streams: the same merges as in batch, with state per conversation.

A segment is emitted once it can no longer grow: when one of another speaker or after a gap follows,
or when the watermark has passed it by `patience`. Ends of streams flush by the same timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.turns import GAP

STATE = "start double, end double, speaker string, text string, seen long"
OUT = "project_id string, start double, end double, speaker string, text string"


def merge_live(segments: DataFrame, gap: float = GAP, patience: str = "30 seconds") -> DataFrame:
    """Streamed segments (project_id, at timestamp, start, end, speaker, text) merged as in batch.

    Within a batch, segments are taken in order of start; late ones beyond the watermark drop out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        held = list(state.get) if state.exists else None
        if state.hasTimedOut:
            if held:
                out.append(held[:4])
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "start"])
            for r in rows.itertuples():
                if held and r.speaker == held[2] and pd.notna(r.start) and held[1] is not None and r.start - held[1] <= gap:
                    held[1], held[3] = float(r.end) if pd.notna(r.end) else None, f"{held[3]} {r.text}".strip()
                else:
                    if held:
                        out.append(held[:4])
                    held = [None if pd.isna(r.start) else float(r.start), None if pd.isna(r.end) else float(r.end), r.speaker, r.text, 0]
                held[4] = max(held[4], int(r.at.timestamp() * 1000))
            state.update(tuple(held))
            state.setTimeoutTimestamp(max(held[4], state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["project_id", "start", "end", "speaker", "text"]).astype({"start": "float64", "end": "float64"})

    rows = segments.select("project_id", "at", "start", "end", "speaker", "text").withWatermark("at", patience)
    return rows.groupBy("project_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def speaking_sessions(segments: DataFrame, gap: str = "2 seconds", patience: str = "30 seconds") -> DataFrame:
    """Sessions of one speaker of one conversation by event time. Other than merge_live, another
    speaker in between does not end a session."""
    s = segments.withWatermark("at", patience).groupBy("project_id", "speaker", F.session_window("at", gap).alias("w"))
    return s.agg(F.count("*").alias("segments"), F.sum(F.size(F.split("text", r"\s+")).cast("long")).alias("words")).select("project_id", "speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "segments", "words")


def activity(segments: DataFrame, width: str = "1 minute", patience: str = "30 seconds") -> DataFrame:
    """Segments and words of each conversation in each window of time."""
    s = segments.withWatermark("at", patience).groupBy("project_id", F.window("at", width).alias("w"))
    return s.agg(F.count("*").alias("segments"), F.sum(F.size(F.split("text", r"\s+")).cast("long")).alias("words")).select("project_id", F.col("w.start").alias("start"), "segments", "words")
