"""What a reviewer looks at: listings, choices, counts and intervals, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, spoken
from ..functions import text as T
from . import identity, turns as turn_ops


def review_list(turns: DataFrame, events: DataFrame | None = None, only_flagged: bool = True) -> DataFrame:
    """(project_id, turn_id, time, label, quality_label, score, text) of turns to review; delays are shown in the text."""
    t = turns.where("manual_review") if only_flagged else turns
    text = T.text("final_text")
    if events is not None:
        seconds = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
        e = turn_ops.review_target(events).where("target_turn_id IS NOT NULL AND `end` > `start`")
        at = F.coalesce(F.col("start"), F.lit(float("inf")))
        pause = e.where("event_type = 'silent_pause'").groupBy("project_id", F.col("target_turn_id").alias("turn_id")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct(at.alias("a"), "event_id", F.col("token_start").alias("token"), seconds.alias("seconds")))), lambda x: F.struct(x.token.alias("token"), x.seconds.alias("seconds"))).alias("pauses")
        )
        gap = e.where("event_type = 'response_gap'").groupBy("project_id", F.col("target_turn_id").alias("turn_id")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("a"), "event_id", T.gap_marker(seconds).alias("m")))), lambda x: x.m), " ").alias("gaps")
        )
        t = t.join(pause, ["project_id", "turn_id"], "left").join(gap, ["project_id", "turn_id"], "left")
        text = F.concat_ws(" ", F.col("gaps"), F.nullif(spoken.with_pauses(text, F.col("pauses")), F.lit("")))
    time = F.concat(T.time_label(F.col("start")), F.lit(" - "), T.time_label(F.col("end")))
    return t.select("project_id", "turn_id", time.alias("time"), identity.display_label().alias("label"), "quality_label", F.col("quality_score").alias("score"), text.alias("text"))


def speaker_choices(turns: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, choice, rank): roles of the conversation, then raw labels, then resolved names, then Unknown."""
    ai = F.lower(F.trim(T.text("conversation_type"))) == "ai"
    roles = F.when(ai, F.array(*(F.lit(r) for r in names.roles("ai")))).otherwise(F.array(*(F.lit(r) for r in names.roles(""))))
    a = projects.select("project_id", F.posexplode(roles)).select("project_id", F.lit(0).alias("k"), F.col("pos").cast("string").alias("o"), F.col("col").alias("choice"))
    parts = [a]
    for k, c in ((1, "speaker_raw"), (2, "speaker")):
        parts.append(turns.where(~T.normalized_ascii(c).isin(*T.UNKNOWN_LABELS)).select("project_id", F.lit(k).alias("k"), T.squeezed(c).alias("o"), T.squeezed(c).alias("choice")))
    parts.append(projects.select("project_id", F.lit(3).alias("k"), F.lit("").alias("o"), F.lit("Unknown").alias("choice")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    g = every.groupBy("project_id", "choice").agg(F.min(F.struct("k", "o")).alias("at"))
    return turn_ops.renumber(g, "rank", "at", "choice").select("project_id", "choice", "rank")


def input_counts(turns: DataFrame, segments: DataFrame, events: DataFrame) -> DataFrame:
    """Per project: segments of each source, pauses, gaps, turns, turns to review, with gold, with model text, with both."""
    text = lambda c: F.trim(T.text(c)) != ""
    t = turns.groupBy("project_id").agg(
        F.count("*").alias("turns"), F.count_if("manual_review").alias("review_turns"), F.count_if(text("gold_text")).alias("gold_turns"),
        F.count_if(text("model_text")).alias("model_turns"), F.count_if(text("gold_text") & text("model_text")).alias("paired_turns"),
    )
    s = segments.groupBy("project_id").agg(*(F.count_if(F.col("source") == c).alias(f"{c}_segments") for c in ("zoom", "chatgpt", "gold", "model")))
    e = events.groupBy("project_id").agg(F.count_if(F.col("event_type") == "silent_pause").alias("pauses"), F.count_if(F.col("event_type") == "response_gap").alias("response_gaps"))
    return t.join(s, "project_id", "left").join(e, "project_id", "left").na.fill(0)


def playback(turns: DataFrame, events: DataFrame) -> DataFrame:
    """(project_id, turn_id, start, end): what to play for a turn, from the response gaps before it on."""
    gaps = turn_ops.review_target(events).where("event_type = 'response_gap'").groupBy("project_id", F.col("target_turn_id").alias("turn_id")).agg(F.min("start").alias("gs"), F.max("end").alias("ge"))
    j = turns.join(gaps, ["project_id", "turn_id"], "left")
    return j.select("project_id", "turn_id", F.least("start", "gs").alias("start"), F.greatest("end", "ge").alias("end"))


def delay_summary(events: DataFrame) -> DataFrame:
    """(project_id, turn_id, pauses, pause_seconds, gaps, all_reviewed) of turns with delays."""
    e = turn_ops.review_target(events).where("target_turn_id IS NOT NULL")
    pause = F.col("event_type") == "silent_pause"
    length = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    return e.groupBy("project_id", F.col("target_turn_id").alias("turn_id")).agg(
        F.count_if(pause).alias("pauses"), F.coalesce(F.sum(F.when(pause, length)), F.lit(0.0)).alias("pause_seconds"),
        F.count_if(~pause).alias("gaps"), F.bool_and("reviewed").alias("all_reviewed"),
    )
