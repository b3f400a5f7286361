"""Alignment of differently cut texts onto one line of turns.

A source's white-space chunks go to turns in order. Each chunk's candidates get votes (its words'
places in a global word alignment, its time, its speaker); the best is taken, but never one before
the last chunk's. That last rule makes the choice sequential, so it runs as one grouped map per
project; projects are the unit of parallelism.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks, edits, names, spoken
from ..functions import text as T
from .spread import spread
from . import intervals

# Votes, the least similarity of texts without common times, and labels that say nothing here.
EXACT, INEXACT, TIMED, SPEAKER = 4, 1, 3, 2
LEAST_SIMILARITY = 0.08
SILENT_LABELS = frozenset(("", "unknown", "speaker", "unmapped"))
#: Texts of a turn in the order in which they anchor an alignment.
ANCHORS = ("model_text", "quality_target_text", "final_text", "zoom_text", "chatgpt_text", "gold_text")
#: Sources in the order in which they are aligned, and of preference as scaffold.
ORDER, PREFERENCE = ("zoom", "chatgpt", "gold"), {"zoom": 3, "gold": 2, "chatgpt": 1}


@dataclass
class Turn:
    start: float | None = None
    end: float | None = None
    speaker_raw: str = ""
    texts: dict[str, str] = field(default_factory=dict)

    def anchor(self) -> str:
        return next((self.texts[c] for c in ANCHORS if self.texts.get(c, "").strip()), "")


@dataclass
class Segment:
    start: float | None
    end: float | None
    speaker: str
    text: str
    confidence: float | None = None


@dataclass
class Chunk:
    text: str
    segment: int
    middle: float | None
    words: list[str]


def timed(x) -> bool:
    return x.start is not None and x.end is not None


def chunks(source: list[Segment]) -> list[Chunk]:
    out = []
    for k, s in enumerate(source):
        parts = s.text.split()
        span = s.end - s.start if timed(s) and s.end >= s.start else None
        out += [Chunk(p, k, None if span is None else s.start + span * (i + 0.5) / len(parts), spoken.words(p)) for i, p in enumerate(parts)]
    return out


def word_owners(source: list[str], target: list[str], owners: list[int]) -> list[tuple[int, int] | None]:
    """For each source word (owner, votes): of equal words 4 votes, of others one for the place they stand in."""
    out: list[tuple[int, int] | None] = [None] * len(source)
    if not target:
        return out
    for tag, a, b, x, y in blocks.steps(source, target):
        for i in range(a, b):
            if tag == "equal":
                out[i] = owners[x + i - a], EXACT
            elif x == y:
                out[i] = owners[min(x, len(owners) - 1)], INEXACT
            else:
                out[i] = owners[x + min(y - x - 1, int((i - a + 0.5) / (b - a) * (y - x)))], INEXACT
    return out


class Clock:
    """Which turn a moment belongs to, by a look at a few timed turns around it."""

    def __init__(self, turns: list[Turn]):
        self.spans = sorted((t.start, t.end, i) for i, t in enumerate(turns) if timed(t))
        self.starts = [s for s, _, _ in self.spans]

    def owner(self, moment: float | None) -> int | None:
        if moment is None or not self.spans:
            return None
        at = bisect_right(self.starts, moment)
        near = self.spans[max(0, at - 3) : at + 2]
        inside = [(abs(moment - (s + e) / 2.0), i) for s, e, i in near if s <= moment <= e]
        return min(inside or [(min(abs(moment - s), abs(moment - e)), i) for s, e, i in near])[1]


def owners(turns: list[Turn], source: list[Segment], parts: list[Chunk]) -> list[int]:
    """The turn of each chunk, in order."""
    target, target_owner = [], []
    for i, t in enumerate(turns):
        w = spoken.words(t.anchor())
        target += w
        target_owner += [i] * len(w)
    votes = [Counter() for _ in parts]
    chunk_of = [k for k, c in enumerate(parts) for _ in c.words]
    for k, found in zip(chunk_of, word_owners([w for c in parts for w in c.words], target, target_owner), strict=True):
        if found:
            votes[k][found[0]] += found[1]
    clock, speakers = Clock(turns), [spoken.normalized(t.speaker_raw) for t in turns]
    out, last = [], 0
    for c, score in zip(parts, votes, strict=True):
        here = clock.owner(c.middle)
        if here is not None:
            score[here] += TIMED
        who = spoken.normalized(source[c.segment].speaker)
        if who not in SILENT_LABELS:
            for i in {*score, last}:
                if speakers[i] == who:
                    score[i] += SPEAKER
        best = max(score, key=lambda i: (score[i], -abs(i - last), -i)) if score else last
        last = max(last, best)
        out.append(last)
    return out


def supported(turns: list[Turn], source: list[Segment]) -> bool:
    """Whether both have times that meet, or texts that are alike at all."""
    a, b = [t for t in turns if timed(t)], [s for s in source if timed(s)]
    if a and b and min(max(t.end for t in a), max(s.end for s in b)) > max(min(t.start for t in a), min(s.start for s in b)):
        return True
    left = " ".join(x for x in (t.anchor() for t in turns) if x)
    return edits.similarity(left, " ".join(s.text for s in source if s.text.strip())) >= LEAST_SIMILARITY


def iou(a, b) -> float:
    if not (timed(a) and timed(b)):
        return 0.0
    hull = max(a.end, b.end) - min(a.start, b.start)
    return max(0.0, min(a.end, b.end) - max(a.start, b.start)) / hull if hull > 0 else 0.0


def align(turns: list[Turn], source: list[Segment]) -> tuple[list[str], list[int | None]]:
    """Each turn's text from the source, and the segment that gave it most (by words, time, likeness; ties: the first)."""
    texts: list[list[str]] = [[] for _ in turns]
    weights = [Counter() for _ in turns]
    parts = chunks(source)
    if turns and parts and supported(turns, source):
        for c, i in zip(parts, owners(turns, source, parts), strict=True):
            texts[i].append(c.text)
            weights[i][c.segment] += max(1, len(c.words))
    joined = [" ".join(t).strip() for t in texts]

    def strongest(i: int) -> int | None:
        if not joined[i]:
            return None
        return max(weights[i], key=lambda k: (weights[i][k], iou(turns[i], source[k]), edits.similarity(joined[i], source[k].text), -k))

    return joined, [strongest(i) for i in range(len(turns))]


# --- frames to lists and back ---------------------------------------------------------------------


def number(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


def string(x) -> str:
    return x if isinstance(x, str) else ""


def turns_of(rows: pd.DataFrame) -> list[Turn]:
    return [Turn(number(r.get("start")), number(r.get("end")), string(r.get("speaker_raw")), {c: string(r.get(c)) for c in ANCHORS}) for r in rows.to_dict("records")]


def segments_of(rows: pd.DataFrame) -> list[Segment]:
    rows = rows.sort_values("seg_idx")
    return [Segment(number(r["start"]), number(r["end"]), string(r["speaker"]), string(r["text"]), number(r.get("confidence"))) for r in rows.to_dict("records")]


def align_source(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """(project_id, turn_id, source, text, segment_idx, speaker, confidence) of each source, each on its own."""

    def step(key, t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        t, out = t.sort_values("turn_id"), []
        for name, own in s.groupby("source"):
            source, ordered = segments_of(own), own.sort_values("seg_idx")["seg_idx"].tolist()
            for turn_id, text, k in zip(t["turn_id"], *align(turns_of(t), source), strict=True):
                hit = source[k] if k is not None else None
                out.append((key[0], turn_id, name, text, None if k is None else ordered[k], hit and hit.speaker, hit and hit.confidence))
        return pd.DataFrame(out, columns=["project_id", "turn_id", "source", "text", "segment_idx", "speaker", "confidence"]).astype({"segment_idx": "Int32", "confidence": "float64"})

    schema = "project_id string, turn_id int, source string, text string, segment_idx int, speaker string, confidence double"
    return spread(turns, "project_id").groupBy("project_id").cogroup(spread(segments, "project_id").groupBy("project_id")).applyInPandas(step, schema)


def align_all(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """(project_id, turn_id, zoom_text, chatgpt_text, gold_text, gold_label): all sources in order,
    where what an earlier source brought may anchor a later one."""

    def step(key, t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("turn_id")
        own, out = turns_of(t), {"project_id": key[0], "turn_id": t["turn_id"].to_numpy()}
        label = [""] * len(own)
        for name in ORDER:
            rows = s[s["source"] == name]
            if len(rows):
                source = segments_of(rows)
                texts, hits = align(own, source)
                for turn, text in zip(own, texts, strict=True):
                    turn.texts[f"{name}_text"] = text
                if name == "gold":
                    label = [source[k].speaker if k is not None else "" for k in hits]
            out[f"{name}_text"] = [turn.texts.get(f"{name}_text", "") for turn in own]
        return pd.DataFrame({**out, "gold_label": label})

    schema = "project_id string, turn_id int, zoom_text string, chatgpt_text string, gold_text string, gold_label string"
    return spread(turns, "project_id").groupBy("project_id").cogroup(spread(segments, "project_id").groupBy("project_id")).applyInPandas(step, schema)


def source_chunks(segments: DataFrame) -> DataFrame:
    """(project_id, source, seg_idx, chunk, text, middle) of white-space chunks, in the JVM."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(T.text("text"), r"(?U)\s+", " ")), " "), lambda x: x != "")
    s = segments.withColumn("parts", parts).where("size(parts) > 0")
    s = s.select("*", F.posexplode("parts").alias("chunk", "piece"))
    middle = F.when(F.col("end") >= F.col("start"), F.col("start") + (F.col("end") - F.col("start")) * (F.col("chunk") + 0.5) / F.size("parts"))
    return s.select("project_id", "source", "seg_idx", "chunk", F.col("piece").alias("text"), middle.alias("middle"))


def scaffold(segments: DataFrame) -> DataFrame:
    """(project_id, source, timed): the labelled source that the turns are built on: timed ones first, then by preference."""
    labelled = segments.where(segments.source.isin(*PREFERENCE)).where(~T.normalized(T.text("speaker")).isin(*T.UNKNOWN_LABELS))
    rank = F.create_map(*(F.lit(x) for kv in PREFERENCE.items() for x in kv))
    has = F.max((F.col("start").isNotNull() & F.col("end").isNotNull()).cast("int"))
    s = labelled.groupBy("project_id", "source").agg(has.alias("timed"))
    return s.groupBy("project_id").agg(F.max_by(F.struct("source", "timed"), F.struct("timed", rank[F.col("source")].alias("p"))).alias("b")).select("project_id", "b.source", (F.col("b.timed") == 1).alias("timed"))


def first_turns(segments: DataFrame) -> DataFrame:
    """Turns of each project: of its timed scaffold if there is one, else of the model's segments.

    On a scaffold, the scaffold's text goes to its own column and model text and confidence are aligned;
    on the model's segments, an untimed labelled source lends its speakers.
    """
    best = scaffold(segments)

    def step(key, s: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        name = b["source"].iloc[0] if len(b) else None
        by = {k: segments_of(g) for k, g in s.groupby("source")}
        base, model, cols = by.get(name, []), by.get("model", []), ("zoom_text", "chatgpt_text", "gold_text")
        named = any(timed(x) and x.speaker.strip() and x.speaker.strip().casefold() != "unknown" for x in base)
        on = base if named else model
        rows = [{"project_id": key[0], "turn_id": i + 1, "start": x.start, "end": x.end, "speaker_raw": x.speaker, "speaker": x.speaker, **dict.fromkeys(cols, "")} for i, x in enumerate(on)]
        turns = [Turn(x.start, x.end, x.speaker, {f"{name}_text" if named else "model_text": x.text}) for x in on]
        texts, hits = align(turns, model if named else base)
        for r, t, x, text, k in zip(rows, turns, on, texts, hits, strict=True):
            if named:
                r |= {f"{name}_text": x.text, "model_text": text, "final_text": "", "model_confidence": model[k].confidence if k is not None else None}
            else:
                r |= {"model_text": x.text, "final_text": x.text, "model_confidence": x.confidence}
                if k is not None and names.usable(base[k].speaker):
                    r |= {"speaker_raw": base[k].speaker.strip(), "speaker": base[k].speaker.strip()}
        order = ["project_id", "turn_id", "start", "end", "speaker_raw", "speaker", *cols, "model_text", "final_text", "model_confidence"]
        out = pd.DataFrame(rows, columns=order)
        return out.astype({"start": "float64", "end": "float64", "model_confidence": "float64", "turn_id": "int32"})

    schema = (
        "project_id string, turn_id int, start double, end double, speaker_raw string, speaker string, zoom_text string, chatgpt_text string, "
        "gold_text string, model_text string, final_text string, model_confidence double"
    )
    made = segments.groupBy("project_id").cogroup(best.groupBy("project_id")).applyInPandas(step, schema)
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    return made.withColumns({c: nan(c) for c in ("start", "end", "model_confidence")})


def nearest_turn(turns: DataFrame, moments: DataFrame) -> DataFrame:
    """(project_id, moment_id, turn_id): the turn around each moment (most centred), else the nearest edge; ties: the earlier turn.

    Moments meet only the turns of their index cells and the edges next to them in sorted time.
    """
    t = turns.where("`start` IS NOT NULL AND `end` IS NOT NULL").select("project_id", "turn_id", F.col("start").alias("s"), F.col("end").alias("e"))
    m = moments.select("project_id", "moment_id", "moment")
    around = intervals.at_cells(m, "moment").join(intervals.in_cells(t.where("e >= s"), "s", "e"), ["project_id", *intervals.CELLS]).where("moment BETWEEN s AND e")
    middle = F.abs(F.col("moment") - (F.col("s") + F.col("e")) / 2)
    held = around.groupBy("project_id", "moment_id").agg(F.min_by("turn_id", F.struct(middle.alias("f"), "turn_id")).alias("held"))
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    edges = t.select("project_id", F.explode(F.array("s", "e")).alias("at"), F.lit(0).alias("kind"), none("moment_id", m), "turn_id")
    both = edges.unionAll(m.select("project_id", F.col("moment").alias("at"), F.lit(1).alias("kind"), "moment_id", none("turn_id", t)))
    edge = F.when(F.col("kind") == 0, F.struct("at", "turn_id"))
    back = F.when(F.col("kind") == 0, F.struct("at", (-F.col("turn_id")).alias("turn_id")))  # of equal edges the earlier turn is the greatest
    rows = (Window.unboundedPreceding, 0)
    up = Window.partitionBy("project_id").orderBy("at", "kind").rowsBetween(*rows)
    down = Window.partitionBy("project_id").orderBy(F.col("at").desc(), "kind").rowsBetween(*rows)
    near = both.withColumn("before", F.max(back).over(up)).withColumn("after", F.min(edge).over(down)).where("kind = 1")
    one = F.struct((F.col("at") - F.col("before.at")).alias("far"), (-F.col("before.turn_id")).alias("turn_id"))
    two = F.struct((F.col("after.at") - F.col("at")).alias("far"), F.col("after.turn_id").alias("turn_id"))
    best = F.least(F.when(F.col("before").isNotNull(), one), F.when(F.col("after").isNotNull(), two))
    out = near.join(held, ["project_id", "moment_id"], "left")
    return out.select("project_id", "moment_id", F.coalesce("held", best["turn_id"]).alias("turn_id")).where("turn_id IS NOT NULL")
