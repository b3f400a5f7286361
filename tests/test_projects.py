import datetime as dt
import json
import os

import pytest

from turnloom import schemas
from turnloom.sinks import files
from turnloom.sources import project

TURN = {n: schemas.TURN_DEFAULTS.get(n) for n in project.fields("turns")}
EVENT = dict.fromkeys(project.fields("speech_events")) | {"event_id": 1, "event_type": "silent_pause", "details": {"note": "x", "source_size": 7, "list": [1, None]}, "reviewed": True, "text": "", "source": "auto"}
META = {n: "" for n in project.fields("metadata")} | {"title": "Tïtle", "detect_speech_delays": False, "minimum_pause_seconds": 0.5, "created_at": "2024-01-02T03:04:05+00:00"}


def document(**changes):
    return {
        "metadata": META, "turns": [TURN | {"turn_id": i, "final_text": f"hi {i} \u2028", "start": i / 3} for i in (1, 2)], "speech_events": [EVENT],
        "speaker_mapping": {"Speaker 1": "Ann", "": "x"}, "metrics": {"wer": 0.25, "note": None, "name": "text", "deep": {"a": [1]}}, "model_comparison": [{"model": "a", "f1": 0.5}, {"model": "b"}],
        "source_transcripts": {"zoom": [dict.fromkeys(project.SEGMENT) | {"speaker": "A", "text": "one", "start": 1.0}, dict.fromkeys(project.SEGMENT)], "gold": []},
        "project_file": "/old/place", "application_version": project.VERSION,
    } | changes


def put(folder, name, raw):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(raw if isinstance(raw, str) else json.dumps(raw))


def all_rows(tables):
    return {k: sorted(map(repr, t.drop("updated_at").collect())) for k, t in tables.items()}


def test_documents_load_whole_and_saving_them_is_the_inverse(spark, tmp_path):
    old = {k: v for k, v in META.items() if k not in project.PAUSES}
    put(tmp_path / "in", "a%2Fb" + project.SUFFIX, document())
    put(tmp_path / "in", "plain" + project.SUFFIX, "\ufeff" + json.dumps({k: v for k, v in document(metadata=old, turns=[], metrics={}, model_comparison=[], source_transcripts={}, speaker_mapping={}).items() if k != "speech_events"}))
    read = project.load(spark, str(tmp_path / "in"))
    first = all_rows(read)
    assert {k: len(v) for k, v in first.items()} == {"turns": 2, "speech_events": 1, "segments": 2, "metadata": 2, "speaker_mapping": 2, "metrics": 4, "model_comparison": 2}
    meta = {r["project_id"]: r for r in read["metadata"].collect()}
    assert (meta["a/b"]["detect_speech_delays"], meta["plain"]["detect_speech_delays"], meta["plain"]["minimum_pause_seconds"]) == (False, True, 0.3)
    assert {(r["name"], r["value"]) for r in read["metrics"].collect()} == {("wer", "0.25"), ("note", None), ("name", "text"), ("deep", '{"a": [1]}')}
    made = files.save_projects(str(tmp_path / "out"), read, dt.datetime(2025, 1, 1, tzinfo=dt.UTC))
    paths = {r["project_id"]: r["path"] for r in made.collect()}
    assert set(paths) == {"a/b", "plain"} and sorted(os.listdir(tmp_path / "out")) == ["a%2Fb" + project.SUFFIX, "plain" + project.SUFFIX]
    again = project.load(spark, str(tmp_path / "out"))
    assert all_rows(again) == first
    assert {r["updated_at"] for r in again["metadata"].collect()} == {"2025-01-01T00:00:00+00:00"}
    whole = json.load(open(paths["a/b"], encoding="utf-8"))
    want = document()
    want["source_transcripts"].pop("gold")  # a source without rows has no row
    for part in ("turns", "speech_events", "speaker_mapping", "metrics", "model_comparison", "source_transcripts"):
        assert whole[part] == want[part], part
    read.release(), again.release()


def test_other_documents_are_refused_by_name(spark, tmp_path):
    for i, (raw, said) in enumerate((
        ("{", "not JSON"), ("[]", "not an object"), (document(application_version="0"), "version '0'"), ({k: v for k, v in document().items() if k != "metrics"}, "missing"),
        (document(extra=1), "unexpected"), (document(turns=[{"turn_id": 1}]), "turns"), (document(speech_events=[EVENT | {"details": 3}]), "details"), (document(turns={}), "not an array"),
        (document(source_transcripts={"zoom": 3}), "segments"),
    )):
        put(tmp_path / str(i), "good" + project.SUFFIX, document())
        put(tmp_path / str(i), "wrong" + project.SUFFIX, raw)
        with pytest.raises(ValueError, match=f"wrong.*{said}"):
            project.load(spark, str(tmp_path / str(i)))
    put(tmp_path / "other", "x" + project.SUFFIX, document(application_version="9.9"))
    assert project.load(spark, str(tmp_path / "other"), versions=("9.9",))["turns"].count() == 2


def test_saving_needs_metadata_and_leaves_no_halves(spark, tmp_path):
    meta = schemas.conform(spark.createDataFrame([("p",)], "project_id string"), schemas.PROJECTS)
    turns = schemas.turns(spark.createDataFrame([("p", 1), ("q", 1)], "project_id string, turn_id int"))
    with pytest.raises(Exception, match="'q' has no metadata"):
        files.save_projects(str(tmp_path / "a"), {"metadata": meta, "turns": turns})
    with pytest.raises(Exception, match="two rows of metadata"):
        files.save_projects(str(tmp_path / "b"), {"metadata": meta.unionAll(meta)})
    assert not [x for x in os.listdir(tmp_path / "b") if not x.startswith(".")]
    files.save_projects(str(tmp_path / "c"), {"metadata": meta})
    assert project.load(spark, str(tmp_path / "c"))["metadata"].first()["project_id"] == "p"


def test_one_document_keeps_mapping_and_metrics(spark, tmp_path):
    meta = schemas.conform(spark.createDataFrame([("p", "T")], "project_id string, title string"), schemas.PROJECTS)
    path = files.save_project(f"file://{tmp_path}/one", {"metadata": meta}, {"S": "Ann"}, {"wer": 0.5})
    back = project.load(spark, path)
    assert back["speaker_mapping"].first()["name"] == "Ann" and back["metrics"].first()["value"] == "0.5" and back["metadata"].first()["project_id"] == "one"
