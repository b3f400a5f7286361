"""Measures of transcripts against a gold standard, per project, in one aggregation each.

Rates without a denominator are null; word and character error rates and the review rate are 0 there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edits
from ..functions import text as T
from .spread import spread


def rate(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b)


def rate0(a: Column, b: Column) -> Column:
    return F.coalesce(rate(a, b), F.lit(0.0))


def blank(c: str) -> Column:
    return F.trim(T.text(c)) == ""


def errors(e: str) -> Column:
    return F.col(f"{e}.substitutions") + F.col(f"{e}.deletions") + F.col(f"{e}.insertions")


def pair_counts(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds `w` and `c`: word and character edit counts of each pair; texts cross to Python once."""
    return df.withColumn("w", edits.word_edits(F.col(ref), F.col(hyp))).withColumn("c", edits.char_edits(F.col(ref), F.col(hyp)))


def error_aggregates() -> list[Column]:
    """Word and character error rates of all pairs together. Pairs' texts count as joined by one
    character each, which is correct."""
    joints = F.greatest(F.count("w") - 1, F.lit(0))
    return [
        rate0(F.sum(errors("w")), F.sum("w.reference")).alias("wer"),
        rate0(F.sum(errors("c")), F.sum("c.reference") + joints).alias("cer"),
        F.coalesce(F.sum("w.substitutions"), F.lit(0)).alias("substitutions"), F.coalesce(F.sum("w.deletions"), F.lit(0)).alias("deletions"),
        F.coalesce(F.sum("w.insertions"), F.lit(0)).alias("insertions"),
        F.coalesce(F.sum("w.approximate"), F.lit(0)).alias("wer_approximations"), F.coalesce(F.sum("c.approximate"), F.lit(0)).alias("cer_approximations"),
    ]


def evaluate(turns: DataFrame) -> DataFrame:
    """All metrics of each project that has a gold text; counts before rates."""
    gold = ~blank("gold_text")
    t = pair_counts(spread(turns.where(gold), "project_id", "turn_id"), "gold_text", "final_text")
    t = t.withColumn("e", edits.matched_events(F.col("gold_text"), F.col("final_text"))).withColumn("g", edits.grammar_words(F.col("gold_text"), F.col("final_text")))
    t = t.withColumn("gs", T.evaluation_label(T.normalized(F.col("gold_speaker")))).withColumn("hs", T.evaluation_label(T.normalized(F.col("speaker"))))
    named = F.col("gs") != ""
    right = F.count_if(named & (F.col("gs") == F.col("hs")))
    ref, hyp, hit = F.sum("e.reference_events"), F.sum("e.hypothesis_events"), F.sum("e.matches")
    g = {k: F.sum(f"g.{k}") for k in ("evaluated", "preserved", "substituted", "deleted")}
    out = t.groupBy("project_id").agg(
        F.count("*").alias("evaluated_turns"), *error_aggregates(),
        F.count_if(named).alias("speaker_labels_evaluated"), right.alias("speaker_labels_correct"), rate(right, F.count_if(named)).alias("speaker_accuracy"),
        ref.alias("speech_events_evaluated"), hyp.alias("speech_events_hypothesized"), hit.alias("speech_events_preserved"),
        rate(hit, hyp).alias("speech_event_precision"), rate(hit, ref).alias("speech_event_recall"), rate(2 * hit, ref + hyp).alias("speech_event_f1"),
        g["evaluated"].alias("grammar_tokens_evaluated"), g["preserved"].alias("grammar_tokens_preserved"), g["substituted"].alias("grammar_token_substitutions"),
        g["deleted"].alias("grammar_token_deletions"), rate(g["preserved"], g["evaluated"]).alias("grammar_token_preservation"),
        rate(g["substituted"], g["evaluated"]).alias("grammar_token_substitution_rate"), rate(g["deleted"], g["evaluated"]).alias("grammar_token_deletion_rate"),
    )
    review = turns.groupBy("project_id").agg(rate0(F.count_if("manual_review"), F.count("*")).alias("manual_review_rate"))
    return out.join(review, "project_id")


def by_source(turns: DataFrame) -> DataFrame:
    """Error rates of each source over turns where it and gold have text; sources without any are missing."""
    long = turns.where(~blank("gold_text")).select(
        "project_id", "gold_text",
        F.expr("stack(4, 'Final', final_text, 'Zoom', zoom_text, 'ChatGPT', chatgpt_text, 'Model', model_text) AS (source, text)"),
    )
    return pair_counts(spread(long.where(~blank("text")), "project_id", "gold_text"), "gold_text", "text").groupBy("project_id", "source").agg(F.count("*").alias("turns"), *error_aggregates())


def sum_grammar(counts: DataFrame, *by: str) -> DataFrame:
    """Counts of annotated words summed, then their rates."""
    s = {k: F.sum(k) for k in ("evaluated", "preserved", "substituted", "deleted")}
    return counts.groupBy(*by).agg(*(v.alias(k) for k, v in s.items()), *(rate(s[k], s["evaluated"]).alias(f"{k}_rate") for k in ("preserved", "substituted", "deleted")))


def vote(votes: DataFrame, key: list[str], choice: str, weight: str) -> DataFrame:
    """Per key the choice with the greatest total weight, if no other has as much."""
    totals = votes.where(F.col(choice).isNotNull()).groupBy(*key, choice).agg(F.sum(weight).alias("score"))
    # The best two scores are enough to see whether the first stands alone.
    top = totals.groupBy(*key).agg(F.max("score").alias("best"), F.count("*").alias("n"))
    hit = totals.join(top, key).where(F.col("score") == F.col("best"))
    return hit.groupBy(*key).agg(F.min(choice).alias(choice), F.first("best").alias("score"), F.count("*").alias("ties")).where("ties = 1").drop("ties")


def report_counts(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Counts for a project's report: reviews, pauses, response gaps, grammar candidates."""
    length = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    pause, gap, cand = F.col("event_type") == "silent_pause", F.col("event_type") == "response_gap", F.col("event_type") == "grammar_preservation"
    e = events.groupBy("project_id").agg(
        F.count_if(pause).alias("pauses"), F.coalesce(F.sum(F.when(pause, length)), F.lit(0.0)).alias("pause_seconds"), F.count_if(gap).alias("response_gaps"),
        F.count_if(cand).alias("grammar_candidates"), F.count_if(cand & ~F.col("reviewed")).alias("grammar_candidates_unreviewed"),
    )
    t = turns.groupBy("project_id").agg(F.count("*").alias("turns"), F.count_if("manual_review").alias("review_turns"))
    return t.join(e, "project_id", "left").na.fill(0).na.fill(0.0)
