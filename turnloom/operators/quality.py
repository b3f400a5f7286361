"""Features, scores and review decisions of turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import edits, spoken
from ..functions import text as T
from .spread import spread

# The features in their order, and the limits of scores.
FEATURES = (
    "agreement", "model_confidence", "zoom_model_similarity", "chatgpt_model_similarity", "zoom_chatgpt_similarity",
    "word_disagreement_rate", "source_presence_ratio", "speech_rate_normality", "snr_normality", "volume_normality",
    "overlap_penalty", "unclear_penalty", "repetition_rate", "hebrew_switch", "self_correction",
)
WEIGHTS = {
    "agreement": 0.29, "model_confidence": 0.16, "source_presence_ratio": 0.10, "best_similarity": 0.10, "word_agreement": 0.07,
    "speech_rate_normality": 0.08, "snr_normality": 0.07, "volume_normality": 0.05, "overlap_penalty": -0.12, "unclear_penalty": -0.18, "repetition": -0.04,
}
ACCEPTABLE, MINOR, CONSENSUS, RISK = 0.72, 0.46, 0.64, 0.30


def shown_text() -> Column:
    return F.coalesce(F.nullif("final_text", F.lit("")), F.col("model_text"), F.lit(""))


def target_text() -> Column:
    """The text whose quality is judged: the frozen target, else the final text, else the model's."""
    return F.coalesce(F.nullif("quality_target_text", F.lit("")), F.nullif("final_text", F.lit("")), F.col("model_text"), F.lit(""))


def freeze_target(turns: DataFrame) -> DataFrame:
    """`quality_target_text` where it is blank: the best source text, else the model's, else the final one; trimmed."""
    best = edits.best_text(F.col("model_text"), F.col("chatgpt_text"), F.col("zoom_text"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    chosen = F.coalesce(some(F.col("quality_target_text")), some(best), some(F.col("model_text")), some(F.col("final_text")), F.lit(""))
    return spread(turns, "project_id", "turn_id").withColumn("quality_target_text", chosen)


def detect(turns: DataFrame) -> DataFrame:
    """Text flags and speech rate, from the final text or else the model's."""
    t = turns.withColumn("f_", spoken.text_flags(shown_text()))
    span = F.col("end") - F.col("start")
    flags = {c: F.col(f"f_.{c}") for c in ("hebrew_switch", "hesitation_or_repetition", "self_correction", "unclear_speech")}
    return t.withColumns({**flags, "speech_rate_wpm": F.when(span > 0, F.col("f_.n_words") / span * 60.0)}).drop("f_").select(*turns.columns)


def features(turns: DataFrame) -> DataFrame:
    """Turns with their 15 features, and what consensus needs (exact_majority, present)."""
    t = spread(turns, "project_id", "turn_id").withColumn("a_", edits.source_agreement(F.col("zoom_text"), F.col("chatgpt_text"), F.col("model_text"))).withColumn("q_", spoken.text_flags(target_text()))
    normal = lambda c, x: F.when(F.col(c).isNull(), 0.55).otherwise(T.clamp(x))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    made = {
        "agreement": F.col("a_.agreement"), "model_confidence": T.clamp(F.coalesce("model_confidence", "a_.agreement")),
        "zoom_model_similarity": F.col("a_.zoom_model"), "chatgpt_model_similarity": F.col("a_.chatgpt_model"), "zoom_chatgpt_similarity": F.col("a_.zoom_chatgpt"),
        "word_disagreement_rate": F.col("a_.disagreement"), "source_presence_ratio": F.col("a_.present") / 3.0,
        "speech_rate_normality": normal("speech_rate_wpm", 1.0 - F.abs(F.col("speech_rate_wpm") - 125.0) / 180.0),
        "snr_normality": normal("noise_snr_db", (F.col("noise_snr_db") - 3.0) / 27.0),
        "volume_normality": normal("volume_dbfs", 1.0 - F.abs(F.col("volume_dbfs") + 24.0) / 30.0),
        "overlap_penalty": flag("overlapping_speech"), "unclear_penalty": flag("q_.unclear_speech"), "repetition_rate": T.repetition_rate(target_text()),
        "hebrew_switch": flag("q_.hebrew_switch"), "self_correction": flag("q_.self_correction"),
    }
    return t.withColumn("features", F.struct(*(made[c].cast("double").alias(c) for c in FEATURES))).withColumn("exact_majority", F.col("a_.exact_majority")).withColumn("present", F.col("a_.present")).drop("a_", "q_")


def rule_score(f: Column) -> Column:
    parts = {
        **{c: f[c] for c in FEATURES}, "best_similarity": F.greatest(f.zoom_model_similarity, f.chatgpt_model_similarity),
        "word_agreement": 1.0 - f.word_disagreement_rate, "repetition": F.least(F.lit(1.0), f.repetition_rate * 5.0),
    }
    return T.clamp(reduce(lambda a, b: a + b, (F.lit(w) * parts[c] for c, w in WEIGHTS.items())))


def label(klass: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in schemas.QUALITY_LABELS)), klass + 1)


def rule_class(score: Column) -> Column:
    return F.when(score >= ACCEPTABLE, 0).when(score >= MINOR, 1).otherwise(2)


def consensus(f: Column) -> Column:
    """Two sources that say the same, or near agreement of all."""
    two = (f.agreement >= 0.88) & (f.word_disagreement_rate <= 0.20)
    three = (f.agreement >= 0.78) & (f.word_disagreement_rate <= 0.35)
    return (F.col("present") >= 2) & (F.col("exact_majority") | F.when(F.col("present") == 2, two).otherwise(three))


def hard_reason(f: Column) -> Column:
    """No text, overlap, unclear words, or an unknown speaker."""
    unknown = T.normalized(T.text("speaker")).isin(*T.UNKNOWN_LABELS)
    return (F.trim(target_text()) == "") | (f.overlap_penalty > 0) | (f.unclear_penalty > 0) | unknown


def probabilities(raw: Column) -> Column:
    """Three finite, non-negative numbers, scaled to sum to 1; null if they are not."""
    fine = (F.size(raw) == 3) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.when(fine & (total > 0), F.transform(raw, lambda x: x / total))


def score(turns: DataFrame, predicted: str | None = None) -> DataFrame:
    """Turns with agreement, quality score, label and review decision.

    predicted: a column of class probabilities (array<double>); where it is null or invalid, rules decide.
    """
    t = features(detect(turns)).withColumn("hard_", hard_reason(F.col("features"))).withColumn("same_", consensus(F.col("features"))).withColumn("rule_", rule_score(F.col("features")))
    rule_review = F.col("hard_") | ~((F.col("rule_") >= ACCEPTABLE) | ((F.col("rule_") >= CONSENSUS) & F.col("same_")))
    klass, value, review = rule_class(F.col("rule_")), F.col("rule_"), rule_review
    if predicted:
        t = t.withColumn("p_", probabilities(F.col(predicted)))
        p = F.col("p_")
        best = (F.array_position(p, F.array_max(p)) - 1).cast("int")
        ml = p[0] + 0.5 * p[1]
        clear = (ml >= CONSENSUS) & (p[2] + 0.5 * p[1] <= RISK) & F.col("same_")
        ml_review = F.col("hard_") | (best == 2) | ((best == 1) & ~clear)
        klass, value, review = (F.when(p.isNotNull(), a).otherwise(b) for a, b in ((best, klass), (ml, value), (ml_review, review)))
    out = {"agreement_score": F.col("features.agreement"), "quality_score": value, "quality_label": label(klass), "manual_review": review}
    return t.withColumns(out).select(*turns.columns, *(c for c in out if c not in turns.columns), "features")
