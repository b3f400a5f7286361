"""Functions of the library under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import edits, grammar, spoken, text

#: SQL name: (function, type).
NAMED = {
    "normalize_text": (text.normalized, "string"),
    "text_similarity": (edits.text_similarity, "double"),
    "edit_counts": (edits.word_edits, edits.COUNTS),
    "char_edit_counts": (edits.char_edits, edits.COUNTS),
    "word_error_rate": (edits.word_error_rate, "double"),
    "char_error_rate": (edits.char_error_rate, "double"),
    "speech_events": (spoken.located_events, f"array<{spoken.EVENT}>"),
    "grammar_evidence": (grammar.grammar_evidence, f"array<{grammar.EVIDENCE}>"),
    "grammar_preservation": (edits.grammar_words, "struct<evaluated:long,preserved:long,substituted:long,deleted:long>"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions callable from SQL; returns their names."""
    for name, (call, _) in NAMED.items():
        spark.udf.register(name, call.udf())
    return sorted(NAMED)
