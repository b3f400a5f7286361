"""Project documents: one JSON object a project, its fields fixed.

Documents are read in one pass: a task parses each once, checks its fields and yields the rows of all parts, which are
held until released. Parts are turns, speech_events, segments (a document has them by source), metadata, speaker_mapping,
metrics and model_comparison; `sinks.files.save_projects` writes them all again.

Cases: documents without speech events, and metadata without the settings of pause detection, are of an older writer and get none and the
defaults; a byte order mark is passed over; a project's id is its file's name, without suffix and escapes; values of metrics,
models and details that are not text are kept as JSON text; a document that is none, of another version or with other fields is an error that names it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .. import schemas

VERSION = "1.0"
SUFFIX = ".ntproject"

# The fields of a document and of its parts, besides the project's id.
DOCUMENT = ["metadata", "turns", "speech_events", "speaker_mapping", "metrics", "model_comparison", "source_transcripts", "project_file", "application_version"]
SEGMENT = ["start", "end", "speaker", "text", "confidence"]
PAUSES = {"detect_speech_delays": True, "minimum_pause_seconds": 0.3}

#: Parts of a document and the tables that they become.
PARTS = {
    "turns": schemas.TURNS, "speech_events": schemas.EVENTS, "segments": schemas.SEGMENTS, "metadata": schemas.PROJECTS,
    "speaker_mapping": schemas.ddl("project_id string, label string, name string"), "metrics": schemas.ddl("project_id string, name string, value string"),
    "model_comparison": schemas.ddl("project_id string, place int, fields map<string,string>"),
}


def fields(part: str) -> list[str]:
    return SEGMENT if part == "segments" else [n for n in PARTS[part].names if n != "project_id"]


def problems(raw: object, versions: tuple[str, ...] = (VERSION,)) -> list[str]:
    """What keeps a document from being a project of one of the versions."""
    if not isinstance(raw, dict):
        return ["the document is not an object"]
    if raw.get("application_version") not in versions:
        return [f"version {raw.get('application_version')!r}; read are {', '.join(versions)}"]
    found = []
    missing, more = set(DOCUMENT) - set(raw), set(raw) - set(DOCUMENT)
    if missing - {"speech_events"} or more:
        found.append(f"missing {sorted(missing)}, unexpected {sorted(more)}")
    kinds = {"metadata": dict, "turns": list, "speech_events": list, "speaker_mapping": dict, "metrics": dict, "model_comparison": list, "source_transcripts": dict}
    found += [f"{k}: not {'an object' if kind is dict else 'an array'}" for k, kind in kinds.items() if k in raw and not isinstance(raw[k], kind)]
    if found:
        return found
    segments = [s for own in raw["source_transcripts"].values() for s in (own if isinstance(own, list) else [None])]
    for part, rows in (("metadata", [raw["metadata"]]), ("turns", raw["turns"]), ("speech_events", raw.get("speech_events", [])), ("segments", segments)):
        want = set(fields(part))
        legacy = want - set(PAUSES) if part == "metadata" else want
        if any(not isinstance(r, dict) or set(r) not in (want, legacy) for r in rows):
            found.append(f"{part}: other fields than {sorted(want)}")
        elif part == "speech_events" and any(not isinstance(r["details"], dict) for r in rows):
            found.append("speech_events: details is not an object")
    return found


def parsed(text: str, versions: tuple[str, ...] = (VERSION,)) -> tuple[object, list[str]]:
    """A document's object, and what keeps it from being a project."""
    try:
        raw = json.loads(text.lstrip("﻿"))
    except json.JSONDecodeError as e:
        return None, [f"not JSON: {e}"]
    return raw, problems(raw, versions)


def as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def texts(x: dict) -> dict:
    return {k: as_text(v) for k, v in x.items()}


def rows_of(raw: dict, key: str) -> Iterator[tuple[str, dict]]:
    """(part, row) of all parts of a document."""
    yield "metadata", PAUSES | raw["metadata"] | {"project_id": key}
    for t in raw["turns"]:
        yield "turns", t | {"project_id": key}
    for e in raw.get("speech_events", []):
        yield "speech_events", e | {"details": texts(e["details"]), "project_id": key}
    for source, own in raw["source_transcripts"].items():
        for i, s in enumerate(own):
            yield "segments", s | {"source": source, "seg_idx": i, "project_id": key}
    for label, name in raw["speaker_mapping"].items():
        yield "speaker_mapping", {"project_id": key, "label": label, "name": as_text(name)}
    for name, value in raw["metrics"].items():
        yield "metrics", {"project_id": key, "name": name, "value": as_text(value)}
    for i, model in enumerate(raw["model_comparison"]):
        yield "model_comparison", {"project_id": key, "place": i, "fields": texts(model)}


class Projects(dict):
    """The tables of projects by part; `release` gives back what they are read from."""

    def __init__(self, every: DataFrame):
        self.every = every
        super().__init__((part, every.where(F.col("part") == part).select(F.from_json("row", schema).alias("r")).select("r.*")) for part, schema in PARTS.items())

    def release(self) -> None:
        self.every.unpersist()


def project_id(path: str) -> str:
    return unquote(path.rstrip("/").rsplit("/", 1)[-1].removesuffix(SUFFIX))


def file_name(key: str) -> str:
    """A project's file, from which its id can be read back."""
    return quote(key, safe=" ()[]+,;=@").replace(".", "%2E") + SUFFIX


def load(spark: SparkSession, path: str, versions: tuple[str, ...] = (VERSION,)) -> Projects:
    """The tables of project documents below a path; ValueError names a document that is not one."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, t in zip(batch["path"], batch["text"], strict=True):
                raw, wrong = parsed(t, versions)
                own = [("problem", f"{p}: {'; '.join(wrong)}")] if wrong else [(part, json.dumps(r, ensure_ascii=False)) for part, r in rows_of(raw, project_id(p))]
                yield pd.DataFrame(own, columns=["part", "row"])

    every = files.mapInPandas(rows, "part string, row string").persist(StorageLevel.DISK_ONLY)
    bad = every.where("part = 'problem'").agg(F.min("row")).first()[0]
    if bad:
        every.unpersist()
        raise ValueError(bad)
    return Projects(every)
