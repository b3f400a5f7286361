"""Text rules as column expressions (JVM only), and the few that need Unicode tables as Arrow UDFs."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import vectorized

# Patterns and word lists.
WORD = r"[\p{L}\p{N}_'’]+"
HEBREW = r"[\x{0590}-\x{05FF}]"
UNCLEAR = r"(?i)\b(?:inaudible|unclear|unintelligible|unknown)\b|\[.*?(?:inaudible|unclear).*?\]|\?{2,}"
FILLER = r"(?i)(?<![\p{L}\p{N}_'])(?:uh+|um+|erm+|er+|ah+|eh+|hmm+|mm+|mhm+)(?![\p{L}\p{N}_'])"
PARTIAL_WORD = r"(?<![\p{L}\p{N}_'])[\p{L}\p{N}_']+[-\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}](?=\s|$|[.,!?;:)\]}])"
SELF_CORRECTION = r"(?i)\b(?:i mean|sorry|rather|actually|no[, ]|let me (?:start|say|try) again|what i meant)\b"
UNKNOWN_LABELS = ("", "unknown", "unmapped", "none", "n a", "na", "not available", "speaker")
UNKNOWN_LABELS_SHORT = ("", "unknown", "unmapped", "speaker", "none")
ROLE_ALIASES = (
    ("learner", "student"), ("student", "student"), ("pupil", "student"), ("teacher", "teacher"), ("tutor", "teacher"),
    ("instructor", "teacher"), ("supervisor", "supervisor"), ("observer", "supervisor"), ("monitor", "supervisor"),
    ("ai", "ai"), ("assistant", "ai"), ("bot", "ai"), ("chatgpt", "ai"),
)
PERSISTED_TYPES = {
    "filler": "filled_pause", "partial_word": "partial_word", "repetition": "repetition",
    "self_correction": "revision", "unclear_marker": "unclear", "hebrew": "code_switch",
}


def _folding() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose case folding is not their lower case: to one character, and to several."""
    one, many = {}, {}
    for c in range(0x80, sys.maxunicode + 1):
        s = chr(c)
        low, fold = s.lower(), s.casefold()
        if low != fold:
            # What lower() leaves of the character is what is replaced afterwards.
            (one if len(low) == len(fold) == 1 else many)[low] = fold
    return one, many


_ONE, _MANY = _folding()
#: Characters whose folding is not all letters: words must be found before they are folded.
_MARKED = "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if chr(c).isalpha() and not all(x.isalpha() for x in chr(c).casefold()))
_MANY = {k: v for k, v in _MANY.items() if k not in _ONE}


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def is_ascii(c) -> Column:
    return text(c).rlike(r"^[\x00-\x7F]*$")


def casefold(c) -> Column:
    """Unicode case folding. The long chain of replacements runs only on texts that need it."""
    low = F.lower(text(c))
    plain = F.translate(low, "".join(_ONE), "".join(_ONE.values()))
    special = plain
    for k, v in _MANY.items():
        special = F.replace(special, F.lit(k), F.lit(v))
    needs = low.rlike("[" + "".join(sorted(set("".join(_MANY)) - set("̇"))) + "]")
    return F.when(is_ascii(c), low).when(needs, special).otherwise(plain)


def words(c) -> Column:
    """Comparable words in order: runs of letters, digits, underscores and apostrophes, case-folded."""
    found = F.regexp_extract_all(F.replace(casefold(c), F.lit("’"), F.lit("'")), F.lit(WORD), F.lit(0))
    first = F.transform(F.regexp_extract_all(text(c), F.lit(WORD), F.lit(0)), lambda x: F.replace(casefold(x), F.lit("’"), F.lit("'")))
    return F.when(text(c).rlike(f"[{_MARKED}]"), first).otherwise(found)


def word_count(c) -> Column:
    return F.size(words(c))


@vectorized("string")
def normalized(s: pd.Series) -> pd.Series:
    """Words after compatibility normalization and case folding, joined by single spaces."""
    import regex

    word = regex.compile(WORD)
    return s.map(lambda x: " ".join(word.findall(unicodedata.normalize("NFKC", x or "").casefold().replace("’", "'"))))


def normalized_ascii(c) -> Column:
    """`normalized` for ASCII texts, in the JVM."""
    return F.array_join(words(c), " ")


def squeezed(c) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def contains_hebrew(c) -> Column:
    return text(c).rlike(HEBREW)


def contains_unclear(c) -> Column:
    return text(c).rlike(UNCLEAR)


def fillers(c) -> Column:
    return F.regexp_extract_all(text(c), F.lit(FILLER), F.lit(0))


def partial_words(c) -> Column:
    return F.regexp_extract_all(text(c), F.lit(PARTIAL_WORD), F.lit(0))


def once(c: Column, f) -> Column:
    """f of a value that is made once a row: what f's own lambdas name would else be made anew for every element that they see."""
    return F.transform(F.array(c), f)[0]


def has_repetition(c, longest: int = 4) -> Column:
    """Whether some run of 1 to `longest` words follows itself, unless only fillers repeat."""
    bare = F.array(*(F.lit(x) for x in ("uh", "um", "erm", "er", "ah", "eh", "hmm", "mm", "mhm")))

    def at(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= 2 * n, F.sequence(F.lit(1), F.size(w) - 2 * n + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: (F.slice(w, i, n) == F.slice(w, i + n, n)) & ~F.forall(F.slice(w, i, n), lambda x: F.array_contains(bare, x)))

    return once(words(c), lambda w: reduce(lambda a, b: a | b, (at(w, n) for n in range(1, longest + 1))))


def matches_self_correction(c) -> Column:
    return text(c).rlike(SELF_CORRECTION)


def repetition_rate(c) -> Column:
    """Adjacent equal words over n - 1; 0 for fewer than two."""

    def rate(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
        return F.when(F.size(w) < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / (F.size(w) - 1))

    return once(words(c), rate)


def common_words(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two word arrays."""
    least = lambda x: F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + least(x))


def token_overlap(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two word arrays; 0 if either is empty."""
    c = common_words(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(c / (F.size(a) + F.size(b) - c))


def word_difference_rate(a: Column, b: Column) -> Column:
    """Words of either side that the other lacks, over the longer side, at most 1."""
    c = common_words(a, b)
    longer = F.greatest(F.lit(1), F.size(a), F.size(b))
    return F.least(F.lit(1.0), (F.size(a) + F.size(b) - 2 * c) / longer)


def speech_rate(c, start, end) -> Column:
    """Words a minute; null without a positive duration."""
    span = F.col(end) - F.col(start)
    return F.when(span > 0, word_count(c) / span * 60.0)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def distinct_versions(*columns: str) -> Column:
    """Distinct non-empty texts, white space squeezed, in the order given."""
    return F.array_distinct(F.filter(F.array(*(squeezed(c) for c in columns)), lambda x: x != ""))


def known(label: Column, unknown=UNKNOWN_LABELS) -> Column:
    """A normalized label, or '' if it says nothing."""
    return F.when(F.coalesce(label, F.lit("")).isin(*unknown), "").otherwise(label)


def evaluation_label(label: Column) -> Column:
    """A normalized label's role by the first alias among its words (in the table's order), else itself; '' if unknown."""
    tokens = F.regexp_extract_all(label, F.lit(WORD), F.lit(0))
    out = F.when(F.coalesce(label, F.lit("")).isin(*UNKNOWN_LABELS), "")
    for alias, role in ROLE_ALIASES:
        out = out.when(F.array_contains(tokens, alias), role)
    return out.otherwise(label)


def pause_marker(seconds: Column) -> Column:
    return F.format_string("[pause %.2fs]", seconds)


def gap_marker(seconds: Column) -> Column:
    return F.format_string("[response gap %.2fs]", seconds)


def time_label(seconds: Column) -> Column:
    """[HH:]MM:SS.ff, or --:-- for null."""
    hundredths = F.round(seconds * 100).cast("long")
    h = F.floor(hundredths / 360000)
    m = F.floor(hundredths / 6000) % 60
    s = (hundredths % 6000) / 100.0
    short = F.format_string("%02d:%05.2f", m.cast("long"), s.cast("double"))
    long = F.format_string("%02d:%02d:%05.2f", h.cast("long"), m.cast("long"), s.cast("double"))
    return F.when(seconds.isNull(), "--:--").when(h > 0, long).otherwise(short)


def size_label(n: Column) -> Column:
    """Bytes as KiB with one decimal; halves round to even."""
    return F.format_string("%.1f KiB", F.bround(n / 1024.0, 1))


def metric_label(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_string("%.3f", x.cast("double")))


# How stages and items are written, words that end a stage, and its longest summary.
STAGE, ITEM = r"(?i)\bStage\s+(\d+)/(\d+)\b", r"(?i)\bturn\s+(\d+)\s+of\s+(\d+)\b"
DONE = (" complete", " finished", " removed")
STAGES, SUMMARY_CHARS, UPDATE_SECONDS = 7, 150, 0.1


def progress(line: Column) -> Column:
    """struct(percent, label) of a line that reports a stage, else null.

    A line that counts turns is that far in its stage, one that says that something is done has ended
    it. Five or seven reported stages are seven in all.
    """
    number = lambda pattern, k: F.regexp_extract(line, pattern, k).try_cast("int")
    stage, reported, item, items = number(STAGE, 1), number(STAGE, 2), number(ITEM, 1), number(ITEM, 2)
    total = F.when(reported.isin(5, STAGES), STAGES).otherwise(reported)
    ended = F.lit(False)
    for word in DONE:
        ended = ended | F.lower(line).contains(word)
    share = F.when(items > 0, clamp(item / items)).when(items.isNull() & ended, 1.0).otherwise(0.0)
    after = F.trim(F.when(F.instr(line, " - ") > 0, F.substring(line, F.instr(line, " - ") + 3, F.length(line))).otherwise(line))
    short = F.when(F.length(after) > SUMMARY_CHARS, F.concat(F.rtrim(F.substring(after, 1, SUMMARY_CHARS - 3)), F.lit("..."))).otherwise(after)
    label = F.format_string("Stage %d of %d: %s", stage, total, short)
    percent = F.least(F.lit(100.0), (stage - 1 + share) / total * 100.0)
    return F.when((stage > 0) & (total > 0), F.struct(percent.alias("percent"), label.alias("label")))


def shows_progress(line: Column, elapsed: Column) -> Column:
    """Whether a line is worth showing: the first and last of a count, else after UPDATE_SECONDS."""
    item, items = F.regexp_extract(line, ITEM, 1).try_cast("int"), F.regexp_extract(line, ITEM, 2).try_cast("int")
    return item.isNull() | (item <= 1) | (item >= items) | (elapsed >= UPDATE_SECONDS)


def token_index(fraction: Column, tokens: Column) -> Column:
    """Where in a text of so many tokens a fraction lies; halves round to even."""
    return F.least(tokens, F.greatest(F.lit(0), F.bround(fraction * tokens).cast("int")))


def quality_class(wer: Column) -> Column:
    return F.when(wer <= 0.10, 0).when(wer <= 0.30, 1).otherwise(2)


def pause_setting(seconds: float | None) -> float:
    """The least pause to detect: 0.3 s unless set, from 0.2 to 5."""
    return min(5.0, max(0.2, 0.3 if seconds is None else float(seconds)))


def playback_interval(start: Column, end: Column) -> Column:
    """struct(start, end) of what can be played: finite, from 0, longer than 10 ms; else null."""
    ok = start.isNotNull() & end.isNotNull() & ~F.isnan(start) & ~F.isnan(end) & (F.abs(start) < float("inf")) & (F.abs(end) < float("inf"))
    begin = F.greatest(F.lit(0.0), start)
    return F.when(ok & (end - begin > 0.01), F.struct(begin.alias("start"), end.alias("end")))


# --- parsing of times and captions -------------------------------------------------------------

TIMESTAMP = r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2}(?:[.,]\d+)?)"


def timestamp(c: Column) -> Column:
    """Seconds of HH:MM:SS[.f] or MM:SS[.f]; null for anything else."""
    parts = F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":")
    number = lambda k: F.expr(f"try_cast(parts[{k}] AS DOUBLE)")
    del number
    p = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 3, p(1) * 3600 + p(2) * 60 + p(3)).when(F.size(parts) == 2, p(1) * 60 + p(2))


def time_value(c: Column, serial: Column | None = None) -> Column:
    """Seconds of a cell: blank is null, with a colon a timestamp, else a number (days where `serial`)."""
    value = F.trim(c)
    number = value.try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    if serial is not None:
        number = F.when(serial, number * 86400).otherwise(number)
    return F.when(F.coalesce(value, F.lit("")) == "", None).when(value.contains(":"), timestamp(value)).otherwise(number)


def clean_markup(c: Column) -> Column:
    """Caption text without tags; &nbsp; and white space runs become spaces."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, "<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" ")), r"\s+", " "))


VOICE = r"(?is)^\s*<v(?:\.[^ >]+)?\s+([^>]+)>(.*?)(?:</v>)?\s*$"
PREFIX = r"^(?:\[([^\]]+)\]\s*)?([^:\n]{1,80}):\s*(.+)$"


def voice(c: Column) -> Column:
    """struct(speaker, text) of a caption with a voice tag; null without one."""
    return F.when(
        c.rlike(VOICE),
        F.struct(clean_markup(F.regexp_extract(c, VOICE, 1)).alias("speaker"), clean_markup(F.regexp_extract(c, VOICE, 2)).alias("text")),
    )


def speaker_prefix(c: Column) -> Column:
    """struct(speaker, text) of `[time] Speaker: text`; without a prefix the speaker is Unknown."""
    hit = c.rlike(PREFIX)
    return F.struct(
        F.when(hit, F.trim(F.regexp_extract(c, PREFIX, 2))).otherwise("Unknown").alias("speaker"),
        F.when(hit, F.trim(F.regexp_extract(c, PREFIX, 3))).otherwise(F.trim(c)).alias("text"),
    )


def header_name(name: str) -> str:
    """A column header for comparison."""
    import re

    return re.sub(r"\s+", " ", re.sub(r"[_\-]+", " ", name.strip().casefold().replace("\n", " "))).strip()
