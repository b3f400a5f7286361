"""Turns: merging neighbours, renumbering, events that follow them, and edits of single turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import intervals

AUTOMATIC = "audio_energy_vad"
JOINED = ("zoom_text", "chatgpt_text", "model_text", "gold_text", "final_text", "quality_target_text", "notes")
FLAGS = ("hebrew_switch", "hesitation_or_repetition", "self_correction", "unclear_speech", "overlapping_speech", "manual_review")
#: Seconds between segments of one speaker that still merge.
GAP = 0.6


def islands(same: Column, w) -> Column:
    """A number for each run of rows that continue the row before."""
    return F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def texts_in_order(order: str, c: str) -> Column:
    """Non-blank texts of a group, trimmed, in order, joined by spaces."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(T.text(c)).alias("t"))))
    return F.array_join(F.transform(F.filter(parts, lambda x: x.t != ""), lambda x: x.t), " ")


def merge_segments(segments: DataFrame, gap: float = GAP) -> DataFrame:
    """Neighbouring segments of one speaker, at most `gap` seconds apart, as one."""
    w = Window.partitionBy("project_id", "source").orderBy("seg_idx")
    same = F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) & (F.col("start") - F.lag("end").over(w) <= gap)
    s = segments.withColumn("island", islands(F.coalesce(same, F.lit(False)) & (F.row_number().over(w) > 1), w))
    text = F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("text", F.lit("")).alias("t"))))
    out = s.groupBy("project_id", "source", "island").agg(
        F.min("seg_idx").alias("first"), F.min_by("start", "seg_idx").alias("start"), F.max_by("end", "seg_idx").alias("end"),
        F.first("speaker").alias("speaker"), F.array_join(F.transform(text, lambda x: x.t), " ").alias("text"), F.min_by("confidence", "seg_idx").alias("confidence"),
    )
    order = Window.partitionBy("project_id", "source").orderBy("first")
    return out.withColumn("seg_idx", F.row_number().over(order) - 1).select("project_id", "source", "seg_idx", "start", "end", "speaker", "text", "confidence")


def from_segments(segments: DataFrame) -> DataFrame:
    """A turn for each segment, numbered from 1; its text is the model's and the final text."""
    w = Window.partitionBy("project_id").orderBy("seg_idx")
    return segments.select(
        "project_id", F.row_number().over(w).alias("turn_id"), "start", "end", F.col("speaker").alias("speaker_raw"), "speaker",
        F.col("text").alias("model_text"), F.col("text").alias("final_text"), F.col("confidence").alias("model_confidence"),
    )


def folded_confidence(parts: Column) -> Column:
    """The confidence of parts (confidence, words) folded from the left, each weighted by its words so far.

    A null takes the other side's confidence; words add up either way.
    """
    weight = lambda n: F.greatest(F.lit(1), n).cast("double")

    def step(s: Column, x: Column) -> Column:
        mean = (s.c * weight(s.n) + x.c * weight(x.n)) / (weight(s.n) + weight(x.n))
        return F.struct(F.when(s.c.isNull(), x.c).when(x.c.isNull(), s.c).otherwise(mean).alias("c"), (s.n + x.n).alias("n"))

    first = F.struct(F.element_at(parts, 1).c.alias("c"), F.element_at(parts, 1).n.alias("n"))
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), first, step, lambda s: s.c)


def consolidate(turns: DataFrame, speaker_label: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs of turns of one known speaker as one turn, renumbered from 1; and (project_id, old_id, new_id).

    speaker_label: the normalized speaker, `normalized_ascii` unless given. Unknown speakers never merge.
    """
    label = T.known(T.normalized_ascii("speaker") if speaker_label is None else speaker_label)
    w = Window.partitionBy("project_id").orderBy("turn_id")
    t = turns.withColumn("label_", label)
    same = (F.col("label_") != "") & (F.col("label_") == F.lag("label_").over(w))
    t = t.withColumn("new_id", islands(F.coalesce(same, F.lit(False)), w).cast("int"))
    kept = [c for c in turns.columns if c not in ("project_id", "turn_id", "start", "end", "model_confidence", "gold_speaker", *JOINED, *FLAGS)]
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn_id").alias("o"), F.col("model_confidence").alias("c"), T.word_count("model_text").alias("n")))), lambda x: F.struct(x.c.alias("c"), x.n.alias("n")))
    named = F.when(F.trim(T.text("gold_speaker")) != "", F.col("turn_id"))
    merged = t.groupBy("project_id", F.col("new_id").alias("turn_id")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), *(texts_in_order("turn_id", c).alias(c) for c in JOINED if c in turns.columns),
        *(F.bool_or(c).alias(c) for c in FLAGS if c in turns.columns),
        *([folded_confidence(parts).alias("model_confidence")] if "model_confidence" in turns.columns else []),
        *([F.coalesce(F.min_by("gold_speaker", named), F.lit("")).alias("gold_speaker")] if "gold_speaker" in turns.columns else []),
        *(F.min_by(c, "turn_id").alias(c) for c in kept),
    )
    return merged.select(*turns.columns), t.select("project_id", F.col("turn_id").alias("old_id"), "new_id")


# --- events ---------------------------------------------------------------------------------------


def without(c: str, *keys: str) -> Column:
    return F.map_filter(c, lambda k, v: ~k.isin(*keys))


def remap_events(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events that were not detected in audio, with turn ids old to new, also in their details."""
    m = ids.select("project_id", F.col("old_id").alias("turn_id"), "new_id")
    automatic = F.col("source") == AUTOMATIC
    out = events.join(m, ["project_id", "turn_id"], "left").withColumn("turn_id", F.when(automatic, F.col("turn_id")).otherwise(F.coalesce("new_id", "turn_id"))).drop("new_id")
    for k in ("previous_turn_id", "following_turn_id"):
        d = ids.select("project_id", F.col("old_id").cast("string").alias("k_"), F.col("new_id").cast("string").alias("v_"))
        out = out.withColumn("k_", F.col("details")[k]).join(d, ["project_id", "k_"], "left")
        swap = F.map_concat(without("details", k), F.create_map(F.lit(k), F.col("v_")))
        out = out.withColumn("details", F.when(~automatic & F.col("v_").isNotNull(), swap).otherwise(F.col("details"))).drop("k_", "v_")
    return out.select(*events.columns)


def delay_events(turns: DataFrame, delays: DataFrame, first_ids: DataFrame | None = None) -> DataFrame:
    """Events of detected delays: owner, type and place in the owner's text.

    turns needs `label` (see intervals.labels); delays: project_id, delay_id, start, end. Invalid
    delays drop out. first_ids (project_id, first): ids go on from there, else from 1.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    fine = delays.where(finite("start") & finite("end") & (F.col("end") > F.col("start")))
    owned = intervals.delay_owners(turns, fine)
    t = turns.select(
        "project_id", F.col("turn_id").alias("owner"), F.col("start").alias("ts"), F.col("end").alias("te"),
        F.size(F.regexp_extract_all(F.coalesce(F.nullif("final_text", F.lit("")), F.col("model_text"), F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))).alias("n"),
    )
    e = owned.join(t, ["project_id", "owner"], "left")
    share = ((F.col("start") + F.col("end")) / 2 - F.col("ts")) / (F.col("te") - F.col("ts"))
    at = F.when(F.col("te") > F.col("ts"), T.token_index(share, F.col("n"))).otherwise(F.col("n"))
    at = F.when((F.col("event_type") == "silent_pause") & F.col("owner").isNotNull(), F.when(F.col("n") <= 0, 0).otherwise(at))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("delay_id"))
    if first_ids is not None:
        e = e.join(first_ids, "project_id", "left")
        rank = rank + F.coalesce("first", F.lit(1)) - 1
    return e.select(
        "project_id", rank.cast("int").alias("event_id"), F.col("owner").alias("turn_id"), "event_type", "start", "end", F.lit("").alias("text"),
        F.lit(None).cast("double").alias("confidence"), F.lit(AUTOMATIC).alias("source"), at.cast("int").alias("token_start"), at.cast("int").alias("token_end"),
        F.lit(False).alias("reviewed"),
        F.map_filter(
            F.create_map(
                F.lit("association"), F.col("association"), F.lit("previous_turn_id"), F.col("previous_turn_id").cast("string"),
                F.lit("following_turn_id"), F.col("following_turn_id").cast("string"), F.lit("token_position_estimated"), at.isNotNull().cast("string"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("details"),
    )


def replace_delay_events(events: DataFrame, turns: DataFrame, delays: DataFrame) -> DataFrame:
    """All events, those detected in audio replaced by new ones; ids go on after the kept ones."""
    kept = events.where(~F.col("source").eqNullSafe(F.lit(AUTOMATIC)))
    first = kept.groupBy("project_id").agg((F.max("event_id") + 1).alias("first"))
    return kept.unionByName(delay_events(turns, delays, first).select(*events.columns))


def reassociate(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Detected delays with owners found anew; `invalidated` where the review target changed, which unsets `reviewed`."""
    live = (F.col("source") == AUTOMATIC) & F.col("start").isNotNull() & (F.col("end") > F.col("start"))
    again = delay_events(turns, events.where(live).withColumn("delay_id", F.col("event_id"))).select(
        "project_id", F.col("start").alias("s_"), F.col("end").alias("e_"), F.col("turn_id").alias("turn_"), F.col("event_type").alias("type_"),
        F.col("token_start").alias("at_"), F.col("details").alias("details_"),
    ).dropDuplicates(["project_id", "s_", "e_"])
    e = events.withColumn("live_", F.coalesce(live, F.lit(False)))
    j = e.join(again, (e.project_id == again.project_id) & e.live_ & (e.start == again.s_) & (e.end == again.e_), "left").drop(again.project_id)
    target = lambda kind, turn, details: F.when(kind == "silent_pause", turn).when(kind == "response_gap", details["following_turn_id"].cast("int"))
    same = F.col("event_type").eqNullSafe(F.col("type_")) & F.col("turn_id").eqNullSafe(F.col("turn_")) & target(F.col("event_type"), F.col("turn_id"), F.col("details")).eqNullSafe(target(F.col("type_"), F.col("turn_"), F.col("details_")))
    j = j.withColumn("invalidated", F.col("live_") & ~same)
    old = without("details", "association", "previous_turn_id", "following_turn_id", "token_position_estimated")
    pick = lambda new, c: F.when(F.col("live_"), F.col(new)).otherwise(F.col(c)).alias(c)
    swapped = {
        "turn_id": pick("turn_", "turn_id"), "event_type": pick("type_", "event_type"), "token_start": pick("at_", "token_start"), "token_end": pick("at_", "token_end"),
        "reviewed": (F.col("reviewed") & ~F.col("invalidated")).alias("reviewed"),
        "details": F.when(F.col("live_"), F.map_concat(old, F.col("details_"))).otherwise(F.col("details")).alias("details"),
    }
    return j.select(*(swapped.get(c, F.col(c)) for c in events.columns), "invalidated")


def review_target(events: DataFrame) -> DataFrame:
    """Events with `target_turn_id`: the turn at which a delay is reviewed."""
    gap = F.col("details")["following_turn_id"].cast("int")
    return events.withColumn("target_turn_id", F.when(F.col("event_type") == "silent_pause", F.col("turn_id")).when(F.col("event_type") == "response_gap", gap))


def same_audio(events: DataFrame, path: str, size: int, modified: int) -> DataFrame:
    """(project_id, same): whether all detected delays come from this file; null without any."""
    d = F.col("details")
    hit = (d["audio_source_path"] == path) & (d["audio_source_size_bytes"] == str(size)) & (d["audio_source_modified_time_ns"] == str(modified))
    return events.groupBy("project_id").agg(F.bool_and(F.when(F.col("source") == AUTOMATIC, F.coalesce(hit, F.lit(False)))).alias("same"))


def navigate(rows: DataFrame, flag: str, order: str) -> DataFrame:
    """For each row the next and previous flagged row (around the ends) and the flagged rows up to it."""
    w = Window.partitionBy("project_id").orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mark = F.when(F.col(flag), F.col(order))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        "*", F.coalesce(after, F.first(mark, ignorenulls=True).over(whole)).alias("next_flagged"),
        F.coalesce(before, F.last(mark, ignorenulls=True).over(whole)).alias("previous_flagged"),
        F.sum(F.col(flag).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("flagged_so_far"),
    )


def renumber(rows: DataFrame, id_col: str, *order) -> DataFrame:
    return rows.withColumn(id_col, F.row_number().over(Window.partitionBy("project_id").orderBy(*order)).cast("int"))


def merge_two(turns: DataFrame, project_id: str, first: int) -> DataFrame:
    """An editor's merge of a turn with the next: texts join, the end is the second's, only the review flag is united."""
    w = Window.partitionBy("project_id").orderBy("turn_id")
    pick = (F.col("project_id") == project_id) & F.col("turn_id").isin(first, first + 1)
    a = turns.where(pick)
    joined = a.groupBy("project_id").agg(
        F.max_by("end", "turn_id").alias("end"), F.bool_or("manual_review").alias("manual_review"), *(texts_in_order("turn_id", c).alias(c) for c in JOINED if c != "notes"),
    )
    kept = [c for c in turns.columns if c not in joined.columns]
    one = a.where(F.col("turn_id") == first).select("project_id", *kept).join(joined, "project_id").select(*turns.columns)
    return turns.where(~pick).unionByName(one).withColumn("turn_id", F.row_number().over(w).cast("int"))


def split_one(turns: DataFrame, project_id: str, turn_id: int, at: int) -> DataFrame:
    """An editor's split of a turn's final text at a character: time and target text split in proportion."""
    hit = (F.col("project_id") == project_id) & (F.col("turn_id") == turn_id)
    share = F.lit(float(at)) / F.greatest(F.length("final_text"), F.lit(1))
    cut = F.bround(F.length("quality_target_text") * share).cast("int")
    middle = F.col("start") + (F.col("end") - F.col("start")) * share
    one = turns.where(hit)
    part = lambda c, n: F.trim(F.substring(F.col(c), F.lit(1), n))
    rest = lambda c, n: F.trim(F.substring(F.col(c), n + 1, F.length(c)))
    left = one.withColumns({"end": middle, "quality_target_text": part("quality_target_text", cut), "final_text": part("final_text", F.lit(at))})
    right = one.withColumns({
        "start": middle, "quality_target_text": rest("quality_target_text", cut), "final_text": rest("final_text", F.lit(at)),
        **{c: F.lit("") for c in ("zoom_text", "chatgpt_text", "model_text", "gold_text", "notes")},
    })
    out = turns.where(~hit).withColumn("k_", F.lit(0)).unionByName(left.withColumn("k_", F.lit(0))).unionByName(right.withColumn("k_", F.lit(1)))
    w = Window.partitionBy("project_id").orderBy("turn_id", "k_")
    return out.withColumn("turn_id", F.row_number().over(w).cast("int")).drop("k_")
