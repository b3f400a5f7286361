"""The library's pipelines: from segments to scored turns, from turns to metrics, from gold turns to models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import alignment, evaluation, evidence, identity, intervals, learning, quality, turns as turn_ops
from ..sources import audio


@dataclass
class Analysis:
    """Tables of analysed projects. Some are held in memory until `release`."""

    turns: DataFrame
    events: DataFrame
    evidence: DataFrame
    metrics: DataFrame
    by_source: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for x in self.held:
            x.unpersist()


def analyse(turns: DataFrame, events: DataFrame, projects: DataFrame, predicted: str | None = None, known: DataFrame | None = None) -> Analysis:
    """Scores turns and gathers evidence and metrics.

    Open pauses mark hesitation; open grammar evidence on a learner's turn asks for a review.
    """
    t = first = quality.score(quality.freeze_target(schemas.turns(turns) if predicted is None else turns), predicted).drop("features").persist()
    found = evidence.wanted(t)
    if known is not None:
        found = evidence.sync(known, found)
    found = found.persist()
    open_ = found.where("NOT reviewed") if known is not None else found
    paused = events.where("event_type = 'silent_pause' AND NOT reviewed AND turn_id IS NOT NULL").select("project_id", "turn_id").distinct().withColumn("p_", F.lit(True))
    asked = open_.select("project_id", "turn_id").distinct().join(evidence.learner_turns(t, projects), ["project_id", "turn_id"], "left_semi").withColumn("g_", F.lit(True))
    t = t.join(paused, ["project_id", "turn_id"], "left").join(asked, ["project_id", "turn_id"], "left")
    t = t.withColumn("hesitation_or_repetition", F.col("hesitation_or_repetition") | F.coalesce("p_", F.lit(False)))
    t = t.withColumn("manual_review", F.col("manual_review") | F.coalesce("g_", F.lit(False))).drop("p_", "g_")
    return Analysis(t, events, found, evaluation.evaluate(t), evaluation.by_source(t), (first, found))


def transcribe(segments: DataFrame, projects: DataFrame, delays: DataFrame | None = None, recordings: DataFrame | None = None) -> Analysis:
    """From all sources' segments to analysed turns.

    segments: schemas.SEGMENTS with source 'model' and any of zoom, chatgpt, gold. projects:
    project_id, conversation_type, learner_id, speaker_mapping. delays: project_id, delay_id, start, end.
    recordings: project_id and what sources.audio.recordings gives, or, of short ones, rate, samples and perhaps
    unit; with them turns get their levels, and silences are the delays if none are given.
    """
    first = schemas.turns(intervals.mark_overlaps(alignment.first_turns(segments)))
    aligned = alignment.align_all(first, segments)
    t = first.drop("zoom_text", "chatgpt_text", "gold_text", "gold_speaker").join(aligned, ["project_id", "turn_id"])
    t = t.withColumnRenamed("gold_label", "gold_speaker")
    t = quality.freeze_target(schemas.turns(t))
    t = t.withColumn("final_text", F.coalesce(F.nullif(F.trim("final_text"), F.lit("")), "quality_target_text"))
    who = identity.resolve(t, segments, projects).drop("mapping")
    t = schemas.turns(t.drop("speaker_raw", "speaker", "gold_speaker").join(who, ["project_id", "turn_id"]))
    merged, _ = turn_ops.consolidate(t.withColumn("label_n_", T.normalized(F.col("speaker"))), F.col("label_n_"))
    merged = schemas.turns(intervals.mark_overlaps(merged.drop("label_n_"))).persist()
    if recordings is not None:
        files = "path" in recordings.columns
        merged = schemas.turns(audio.turn_levels(merged, recordings) if files else intervals.turn_levels(merged, recordings, audio.thinned)).persist()
        delays = delays if delays is not None else (audio if files else intervals).detected_delays(recordings)
    spark = segments.sparkSession
    events = spark.createDataFrame([], schemas.EVENTS)
    if delays is not None:
        named = F.coalesce(F.nullif("speaker", F.lit("")), F.col("speaker_raw"))
        events = turn_ops.delay_events(intervals.labels(merged.withColumn("who_", T.normalized(named)), F.col("who_")), delays)
    out = analyse(merged, events.persist(), projects)
    out.held += (merged, events)
    return out


def train(turns: DataFrame, projects: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, learning.Fitted]:
    """Compares models on all gold turns (and known records); returns the comparison and the fitted models."""
    rows = learning.training_rows(turns, projects)
    if known is not None:
        rows = known.unionByName(learning.append(known, rows))
    return learning.compare(rows)
