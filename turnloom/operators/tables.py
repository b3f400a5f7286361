"""Operators as SQL table functions.

    SELECT * FROM wav_frames('file:/data/a.wav', 0.02)
    SELECT * FROM align_chunks(TABLE(rows) PARTITION BY project_id ORDER BY position)

`wav_frames` reads one recording piece by piece and gives what `sources.audio.frames` gives of it. `align_chunks` takes the
turns of a project and the segments of one source as rows (project_id, kind: turn or segment, position, start, end,
speaker, text) and gives each turn's text from the source, and the segment that gave most of it, as `alignment.align_source`
does; a partition is a project. Wrong columns are an error when the query is analysed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources import audio
from . import alignment

NEEDED = ("project_id", "kind", "position", "start", "end", "speaker", "text")


class WavFrames:
    """Frames of a recording: level in decibels below full scale; null for digital silence."""

    @staticmethod
    def analyze(path: AnalyzeArgument, seconds: AnalyzeArgument | None = None) -> AnalyzeResult:
        if path.dataType.typeName() != "string":
            raise ValueError("wav_frames needs a path")
        return AnalyzeResult(StructType().add("frame", LongType()).add("start_frame", LongType()).add("end_frame", LongType()).add("dbfs", DoubleType()))

    def eval(self, path: str, seconds: float | None = None) -> Iterator[tuple]:
        if path is None:
            return
        with audio.opened(path) as f:
            rate, channels, width, offset, total = audio.header(f)
            size = max(1, round(float(0.02 if seconds is None else seconds) * rate))  # halves go to the even number, as in `frames`
            piece = max(1, audio.PIECE // size) * size
            scale = channels * 2.0 ** (8 * width - 1)
            for first in range(0, total, piece):
                n = min(piece, total - first)
                f.seek(offset + first * width * channels)
                x = audio.integers(f.read(n * width * channels), width, channels)
                starts = np.arange(0, n, size)
                for start, power in zip(starts.tolist(), audio.squares(x, starts), strict=True):
                    end = min(n, start + size)
                    rms = math.sqrt(power / (end - start)) / scale
                    yield (first + start) // size, first + start, first + end, 20 * math.log10(rms) if rms > 0 else None


class AlignChunks:
    """Turns of a project with their text from a source."""

    def __init__(self):
        self.project, self.turns, self.segments = None, [], []

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("align_chunks needs a table, partitioned by project_id")
        missing = [c for c in NEEDED if c not in rows.dataType.names]
        if missing:
            raise ValueError(f"align_chunks: no columns {', '.join(missing)}")
        return AnalyzeResult(StructType().add("project_id", rows.dataType["project_id"].dataType).add("turn_id", IntegerType()).add("text", StringType()).add("segment_idx", IntegerType()))

    def eval(self, rows: Row) -> None:
        self.project = rows["project_id"]
        if rows["kind"] == "turn":
            self.turns.append(rows)
        elif rows["kind"] == "segment":
            self.segments.append(rows)
        else:
            raise ValueError(f"align_chunks: {rows['kind']!r} is neither turn nor segment")

    def terminate(self) -> Iterator[tuple]:
        turns, segments = (sorted(x, key=lambda r: r["position"]) for x in (self.turns, self.segments))
        own = [alignment.Turn(r["start"], r["end"], r["speaker"] or "", {alignment.ANCHORS[0]: r["text"] or ""}) for r in turns]
        texts, hits = alignment.align(own, [alignment.Segment(r["start"], r["end"], r["speaker"] or "", r["text"] or "", None) for r in segments])
        for r, text, k in zip(turns, texts, hits, strict=True):
            yield self.project, r["position"], text, None if k is None else segments[k]["position"]


def register(spark: SparkSession) -> list[str]:
    """Makes the table functions callable from SQL; returns their names."""
    for name, kind in (("wav_frames", WavFrames), ("align_chunks", AlignChunks)):
        spark.udtf.register(name, F.udtf(kind))
    return ["align_chunks", "wav_frames"]
