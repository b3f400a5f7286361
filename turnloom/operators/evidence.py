"""Grammar evidence between a turn's final text and its sources, and its life over edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grammar
from ..functions import text as T
from ..functions.spoken import normalized
from ..functions.udf import digest, vectorized

EVENT_TYPE, SOURCE = "grammar_preservation", "grammar_guard"
LEARNERS = ("student", "learner", "pupil")


def ambiguous() -> Column:
    """Turns that give no evidence: overlap, unclear words, another language, or a restart."""
    any_ = F.lit(False)
    for c in ("overlapping_speech", "unclear_speech", "hebrew_switch", "self_correction"):
        any_ = any_ | F.coalesce(F.col(c), F.lit(False))
    return any_


@vectorized("string")
def fingerprint(turn_id: pd.Series, found: pd.DataFrame) -> pd.Series:
    """What tells a turn's evidence apart: its place and its words in comparable form."""
    return pd.Series([
        digest({
            "turn_id": int(t), "operation": e.operation, "pattern": e.pattern,
            "observed_fragment": normalized(e.baseline_fragment), "alternate_fragment": normalized(e.final_fragment),
            "observed_token_span": [int(e.baseline_token_start), int(e.baseline_token_end)],
            "anchors": [normalized(e.left_anchor), normalized(e.right_anchor)],
        })
        for t, e in zip(turn_id, found.itertuples(), strict=True)
    ], dtype="object")


def wanted(turns: DataFrame) -> DataFrame:
    """(project_id, turn_id, fingerprint, evidence, variants): distinct evidence of each turn.

    The final text is compared with the target, model, ChatGPT and Zoom texts; evidence of the same
    place and words from several sources is one row that lists them.
    """
    t = turns.where((F.trim(T.text("final_text")) != "") & ~ambiguous())
    long = t.select(
        "project_id", "turn_id", "final_text",
        F.expr("stack(4, 'quality_target', quality_target_text, 'model', model_text, 'chatgpt', chatgpt_text, 'zoom', zoom_text) AS (source, other)"),
    ).where(F.trim(T.text("other")) != "")
    e = long.select("project_id", "turn_id", "source", F.explode(grammar.grammar_evidence(F.col("final_text"), F.col("other"))).alias("e"))
    e = e.withColumn("fingerprint", fingerprint(F.col("turn_id"), F.col("e")))
    return e.groupBy("project_id", "turn_id", "fingerprint").agg(
        F.min_by("e", F.struct("source", "e.final_token_start")).alias("evidence"),
        F.array_sort(F.collect_set(F.struct("source", F.col("e.final_fragment").alias("fragment")))).alias("variants"),
    )


def sync(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known evidence brought up to date with what is found now.

    known: project_id, event_id, turn_id, fingerprint, reviewed, decision. Evidence that is still
    there keeps its id and review; new evidence gets the next ids; the rest goes. `state` says which.
    """
    k = known.select("project_id", "turn_id", "fingerprint", "event_id", "reviewed", "decision")
    j = found.join(k, ["project_id", "turn_id", "fingerprint"], "left")
    last = known.groupBy("project_id").agg(F.max("event_id").alias("last"))
    w = Window.partitionBy("project_id").orderBy(F.col("event_id").isNotNull(), "turn_id", "evidence.baseline_token_start", "evidence.final_token_start", "fingerprint")
    j = j.join(last, "project_id", "left").withColumn("rank", F.row_number().over(w))
    return j.select(
        "project_id", F.coalesce("event_id", F.coalesce("last", F.lit(0)) + F.col("rank")).cast("int").alias("event_id"), "turn_id", "fingerprint",
        "evidence", "variants", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), "decision",
        F.when(F.col("event_id").isNull(), "new").otherwise("kept").alias("state"),
    )


def stale(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known evidence that is gone."""
    return known.join(found, ["project_id", "turn_id", "fingerprint"], "left_anti")


def confirm(known: DataFrame, chosen: DataFrame, decision: str) -> DataFrame:
    """Known evidence, that of `chosen` (project_id, event_id) reviewed with a decision; ids count within their project."""
    hit = chosen.select("project_id", "event_id").distinct().withColumn("hit_", F.lit(True))
    out = known.join(hit, ["project_id", "event_id"], "left").withColumn("hit_", F.coalesce("hit_", F.lit(False)))
    out = out.withColumn("reviewed", F.col("reviewed") | F.col("hit_")).withColumn("decision", F.when(F.col("hit_"), decision).otherwise(F.col("decision")))
    return out.select(*known.columns)


def summary(found: DataFrame, most: int = 3) -> DataFrame:
    """Per turn the number of differences and the first few as text."""
    one = F.concat(F.col("evidence.pattern"), F.lit(": "), F.col("evidence.baseline_fragment"), F.lit(" / "), F.col("evidence.final_fragment"))
    rows = found.select("project_id", "turn_id", F.struct(F.col("evidence.baseline_token_start").alias("a"), F.col("evidence.final_token_start").alias("b"), one.alias("t")).alias("s"))
    g = rows.groupBy("project_id", "turn_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("s")).alias("s"))
    return g.select("project_id", "turn_id", "n", F.array_join(F.transform(F.slice("s", 1, most), lambda x: x.t), "; ").alias("examples"))


def learner_turns(turns: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, turn_id) of turns that are probably a learner's.

    A turn counts by a learner's role word or the learner's id in its labels, or if it shares its
    speaker with a turn that has such a label.
    """
    t = turns.join(projects.select("project_id", F.coalesce("learner_id", F.lit("")).alias("learner_id")), "project_id", "left")
    t = t.select("project_id", "turn_id", *(T.words(c).alias(c) for c in ("speaker", "speaker_raw", "gold_speaker")), T.words("learner_id").alias("id"))
    roles = F.array(*(F.lit(x) for x in LEARNERS))
    hit = F.lit(False)
    for c in ("speaker", "speaker_raw", "gold_speaker"):
        hit = hit | F.arrays_overlap(F.col(c), roles) | ((F.size("id") > 0) & (F.size(F.array_except("id", c)) == 0))
    t = t.withColumn("hit", hit)
    who = t.where("hit AND size(speaker) > 0").select("project_id", "speaker").distinct()
    who = who.where(~F.array_join("speaker", " ").isin(*T.UNKNOWN_LABELS_SHORT))
    same = t.join(who, ["project_id", "speaker"], "left_semi").select("project_id", "turn_id")
    return t.where("hit").select("project_id", "turn_id").unionByName(same).distinct()
