"""Tables of the library, all keyed by project_id, and an exact check of a table against them.

Times are seconds from the recording's start; a rate without a denominator is null, never 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()), "array<double>": T.ArrayType(T.DoubleType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def ddl(text: str) -> T.StructType:
    """A schema from `name type, ...`, without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(", "))])


SEGMENTS = ddl(
    "project_id string, source string, seg_idx int, start double, end double, speaker string, text string, confidence double"
)
TURNS = ddl(
    "project_id string, turn_id int, start double, end double, speaker_raw string, speaker string, "
    "zoom_text string, chatgpt_text string, model_text string, gold_text string, gold_speaker string, final_text string, "
    "quality_target_text string, model_confidence double, agreement_score double, quality_score double, quality_label string, "
    "hebrew_switch boolean, hesitation_or_repetition boolean, self_correction boolean, unclear_speech boolean, "
    "overlapping_speech boolean, manual_review boolean, speech_rate_wpm double, volume_dbfs double, noise_snr_db double, notes string"
)
EVENTS = ddl(
    "project_id string, event_id int, turn_id int, event_type string, start double, end double, text string, confidence double, "
    "source string, token_start int, token_end int, reviewed boolean, details map<string,string>"
)
TRAINING = ddl(
    "schema_version int, label_target string, feature_names array<string>, features array<double>, label int, target_wer double, example_id string"
)
PROJECTS = ddl(
    "project_id string, title string, learner_id string, session_number string, conversation_type string, audio_file string, "
    "zoom_file string, chatgpt_file string, gold_file string, transcription_model string, detect_speech_delays boolean, minimum_pause_seconds double, "
    "created_at string, updated_at string"
)

# Text sources in their order, quality labels, and defaults of a turn.
SOURCES = ("zoom", "chatgpt", "model")
QUALITY_LABELS = ("Transcript acceptable", "Needs minor correction", "Needs major correction")
TURN_DEFAULTS = {
    **{f.name: "" for f in TURNS if isinstance(f.dataType, T.StringType)},
    **{f.name: False for f in TURNS if isinstance(f.dataType, T.BooleanType)},
    "speaker_raw": "Unknown", "speaker": "Unknown", "quality_label": QUALITY_LABELS[2], "manual_review": True,
    "agreement_score": 0.0, "quality_score": 0.0,
}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The schema's columns in order and type, with defaults for missing columns and null texts."""
    from pyspark.sql import functions as F

    out = []
    for f in schema:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        default = (defaults or {}).get(f.name)
        out.append((F.coalesce(value, F.lit(default)) if default is not None else value).alias(f.name))
    return df.select(*out)


def turns(df: DataFrame) -> DataFrame:
    return conform(df, TURNS, TURN_DEFAULTS)


def check_exact(df: DataFrame, schema: T.StructType) -> None:
    """Raises ValueError with the missing and unexpected names unless the columns are exactly the schema's."""
    have, want = set(df.columns), set(schema.names)
    if have != want:
        raise ValueError(f"missing: {sorted(want - have)}; unexpected: {sorted(have - want)}")
