import random

import pytest
from pyspark.sql import functions as F

from turnloom import schemas
from turnloom.functions import spoken
from turnloom.functions import text as T
from turnloom.operators import alignment, evaluation, evidence, identity, intervals, learning, quality, turns as TO
from turnloom.plans import pipeline


def turns(spark, rows):
    names = [n for n in rows[0]]
    return schemas.turns(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], _ddl(names)))


def _ddl(names):
    kinds = {f.name: f.dataType.simpleString() for f in schemas.TURNS}
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def test_words_in_the_jvm_match_python(spark):
    said = ["It’s Straße", "ﬁne ΑΣ İx", "a_b 3½ שלום", "", None, "don't  ''"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    for r in df.select("i", T.words("s").alias("w")).collect():
        assert r["w"] == spoken.words(said[r["i"]]), said[r["i"]]


def test_segments_merge_as_a_fold(spark):
    rng = random.Random(5)
    rows, at = [], 0.0
    for i in range(300):
        at += rng.choice([0.2, 0.5, 0.9])
        start = None if rng.random() < 0.1 else at
        rows.append(("p", "zoom", i, start, None if rng.random() < 0.1 else at + 0.1, rng.choice("ab"), f"w{i}", None))
    out = []
    for r in rows:
        if out and out[-1][2] == r[5] and r[3] is not None and out[-1][1] is not None and r[3] - out[-1][1] <= 0.6:
            out[-1] = (out[-1][0], r[4], r[5], f"{out[-1][3]} {r[6]}")
        else:
            out.append((r[3], r[4], r[5], r[6]))
    got = TO.merge_segments(spark.createDataFrame(rows, schemas.SEGMENTS)).orderBy("seg_idx")
    assert [(r["start"], r["end"], r["speaker"], r["text"]) for r in got.collect()] == out


def test_overlap_is_strict_and_between_speakers(spark):
    rows = [dict(project_id="p", turn_id=i, start=s, end=e, speaker_raw=w) for i, s, e, w in
            [(1, 0.0, 1.5, "Student"), (2, 1.0, 2.0, "Teacher"), (3, 5.0, 6.0, "A"), (4, 5.85, 7.0, "B"), (5, 9.0, 10.0, "A"), (6, 9.1, 9.9, "A"), (7, None, None, "B")]]
    got = {r["turn_id"] for r in intervals.overlapping_ids(turns(spark, rows)).collect()}
    assert {1, 2} <= got and not got & {5, 6, 7}


def test_consolidation_weighs_confidence_and_renumbers(spark):
    rows = [dict(project_id="p", turn_id=i, start=float(i), end=i + 0.5, speaker=w, model_text=t, final_text=t, model_confidence=c) for i, w, t, c in
            [(1, "Ann", "two words", 0.9), (2, "ann", "one", 0.6), (3, "Unknown", "x", None), (4, "Unknown", "y", None)]]
    merged, ids = TO.consolidate(turns(spark, rows))
    got = merged.orderBy("turn_id").collect()
    assert [r["turn_id"] for r in got] == [1, 2, 3] and got[0]["model_confidence"] == pytest.approx(0.8) and got[0]["final_text"] == "two words one"
    assert {(r["old_id"], r["new_id"]) for r in ids.collect()} == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_alignment_splits_and_keeps_every_word():
    t = [alignment.Turn(0, 2, "", {"model_text": "Hello there"}), alignment.Turn(2, 4, "", {"model_text": "how are you"})]
    assert alignment.align(t, [alignment.Segment(0, 4, "", "Hello there how are you")])[0] == ["Hello there", "how are you"]
    t = [alignment.Turn(0, 2, "", {"model_text": "I like electrical engineering"}), alignment.Turn(2, 4, "", {"model_text": "because it is interesting"})]
    s = [alignment.Segment(None, None, "", x) for x in ("I like", "electrical engineering because", "it is interesting")]
    assert alignment.align(t, s)[0] == ["I like electrical engineering", "because it is interesting"]
    assert alignment.align(t, [])[0] == ["", ""] and alignment.align([], s) == ([], [])


def cast(rows, kind, learner="", saved=None, sources=None):
    base = {"start": None, "end": None, "speaker": "", "gold_speaker": "", **dict.fromkeys(identity.CAST_TEXTS, "")}
    c = identity.Cast([{**base, "speaker_raw": w, "final_text": t, "model_text": t} for w, t in rows], sources or {}, kind, learner, saved or {})
    c.run()
    return [t["speaker"] for t in c.turns]


def test_roles_by_label_and_dialogue():
    assert cast([("L-17", "a"), ("ChatGPT", "b"), ("Teacher", "c"), ("Unknown", "d")], "AI", "L-17") == ["Student", "AI", "Supervisor", "Unknown"]
    assert cast([("Speaker 1", "How are you today?"), ("Speaker 2", "I am fine")], "AI") == ["AI", "Student"]
    assert cast([("Speaker 1", "What did you do yesterday?"), ("Speaker 2", "I went to school.")], "Human teacher") == ["Teacher", "Student"]
    three = [("Speaker 1", "What is it? Why?"), ("Speaker 2", "I think so and so"), ("Speaker 1", "How?"), ("Speaker 2", "it is good"), ("Speaker 3", "Continue.")]
    assert cast(three, "AI") == ["AI", "Student", "AI", "Student", "Supervisor"]


def test_uploaded_labels_stay_and_introductions_count():
    source = {"zoom": [alignment.Segment(None, None, "ChatGPT", "hello there friend")]}
    assert cast([("ChatGPT", "hello there friend"), ("", "My name is Maya.")], "AI", sources=source) == ["ChatGPT", "Maya"]


def test_rates_are_null_without_a_denominator(spark):
    t = turns(spark, [dict(project_id="p", turn_id=1, gold_text="I go home", final_text="I go home", gold_speaker="", speaker="x", manual_review=False)])
    r = evaluation.evaluate(t).first()
    assert (r["wer"], r["speaker_accuracy"], r["speech_event_f1"], r["grammar_token_preservation"], r["manual_review_rate"]) == (0.0, None, None, None, 0.0)
    t = turns(spark, [dict(project_id="p", turn_id=1, gold_text="a", final_text="a", gold_speaker="Student", speaker="Learner"),
                      dict(project_id="p", turn_id=2, gold_text="a", final_text="a", gold_speaker="AI", speaker="ChatGPT")])
    assert evaluation.evaluate(t).first()["speaker_accuracy"] == 1.0


def test_review_needs_consensus_or_score(spark):
    same = dict(project_id="p", start=0.0, end=2.0, zoom_text="we go home now", chatgpt_text="we go home now", model_text="we go home now", final_text="we go home now")
    t = turns(spark, [dict(same, turn_id=1, speaker="Ann", overlapping_speech=False), dict(same, turn_id=2, speaker="Unknown", overlapping_speech=False), dict(same, turn_id=3, speaker="Ann", overlapping_speech=True)])
    assert [r["manual_review"] for r in quality.score(t).orderBy("turn_id").collect()] == [False, True, True]


def test_evidence_keeps_its_id_and_review(spark):
    t = turns(spark, [dict(project_id="p", turn_id=1, final_text="It have a lamp", zoom_text="It has a lamp", model_text="It has a lamp", overlapping_speech=False),
                      dict(project_id="p", turn_id=2, final_text="It have a lamp", zoom_text="It has a lamp", model_text="", overlapping_speech=True)])
    found = evidence.wanted(t)
    rows = found.collect()
    assert [(r["turn_id"], r["evidence"]["pattern"], len(r["variants"])) for r in rows] == [(1, "have_form_change", 2)]
    known = spark.createDataFrame([("p", 7, 1, rows[0]["fingerprint"], True, "kept"), ("p", 9, 1, "gone", False, None)], "project_id string, event_id int, turn_id int, fingerprint string, reviewed boolean, decision string")
    got = evidence.sync(known, found).first()
    assert (got["event_id"], got["reviewed"], got["state"]) == (7, True, "kept")
    assert [r["event_id"] for r in evidence.stale(known, found).collect()] == [9]


def test_silence_runs(spark):
    x = [0.5] * 100 + [0.0] * 100 + [0.5] * 100
    s = spark.createDataFrame([("a", 0, None, None, 100, [float(v) for v in x])], "audio_id string, interval_index int, start double, end double, rate int, samples array<double>")
    r = intervals.silent_runs(intervals.frames(s)).collect()
    assert [(round(q["start_seconds"], 2), round(q["end_seconds"], 2)) for q in r] == [(1.0, 2.0)]
    assert intervals.silent_runs(intervals.frames(s), least=1.5).count() == 0


def test_training_needs_rows_and_classes(spark):
    rows = spark.createDataFrame([(0, 1)] * 3, "label int, x int")
    with pytest.raises(ValueError):
        learning.check(rows)


def test_whole_pipeline(spark):
    seg = [("p", "model", 0, 0.0, 2.0, "Unknown", "Hello there how are you today?", 0.9), ("p", "model", 1, 2.2, 4.0, "Unknown", "My name is Maya and I have went home", 0.8),
           ("p", "zoom", 0, 0.0, 2.0, "Speaker 1", "Hello there how are you today?", None), ("p", "zoom", 1, 2.2, 4.0, "Speaker 2", "My name is Maya and I had went home", None),
           ("p", "gold", 0, None, None, "Student", "My name is Maya and I have went home", None)]
    p = spark.createDataFrame([("p", "AI", "", {})], "project_id string, conversation_type string, learner_id string, speaker_mapping map<string,string>")
    d = spark.createDataFrame([("p", 1, 2.0, 2.2), ("p", 2, 2.9, 3.3)], "project_id string, delay_id int, start double, end double")
    a = pipeline.transcribe(spark.createDataFrame(seg, schemas.SEGMENTS), p, d)
    t = a.turns.orderBy("turn_id").collect()
    assert [x["speaker"] for x in t] == ["Speaker 1", "Speaker 2"] and t[1]["gold_text"] == "My name is Maya and I have went home"
    assert [e["event_type"] for e in a.events.orderBy("event_id").collect()] == ["response_gap", "silent_pause"]
    assert [e["evidence"]["pattern"] for e in a.evidence.collect()] == ["have_form_change"]
    assert a.metrics.first()["wer"] == 0.0 and a.by_source.where(F.col("source") == "Zoom").first()["substitutions"] == 1


def test_confirmation_is_of_one_project(spark):
    known = spark.createDataFrame([("p", 3, 1, "a", False, None), ("q", 3, 1, "b", False, None), ("q", 4, 2, "c", True, "kept")], "project_id string, event_id int, turn_id int, fingerprint string, reviewed boolean, decision string")
    got = evidence.confirm(known, spark.createDataFrame([("p", 3), ("p", 3)], "project_id string, event_id int"), "confirmed")
    assert got.columns == known.columns
    assert {(r["project_id"], r["event_id"], r["reviewed"], r["decision"]) for r in got.collect()} == {("p", 3, True, "confirmed"), ("q", 3, False, None), ("q", 4, True, "kept")}


def test_ids_are_digests_of_sorted_compact_json(spark):
    import hashlib
    import json

    t = turns(spark, [dict(project_id="p", turn_id=1, start=1.0, end=2.5, speaker_raw="Ann", zoom_text="It has é", chatgpt_text="", model_text="It has é", gold_text="It has é", final_text="It have é", overlapping_speech=False)])
    p = spark.createDataFrame([("p", "L1", 3, "T")], "project_id string, learner_id string, session_number int, title string")
    want = {"learner_id": "L1", "session_number": 3, "project_title": "T", "turn_id": 1, "start": 1.0, "end": 2.5, "speaker_raw": "Ann", "zoom_text": "It has é",
            "chatgpt_text": "", "model_text": "It has é", "quality_target_text": "It has é", "gold_text": "It has é"}
    said = lambda d: hashlib.sha256(json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert learning.training_rows(t, p).first()["example_id"] == said(want)
    r = evidence.wanted(t).first()
    e = r["evidence"]
    assert r["fingerprint"] == said({
        "turn_id": 1, "operation": e["operation"], "pattern": e["pattern"], "observed_fragment": spoken.normalized(e["baseline_fragment"]), "alternate_fragment": spoken.normalized(e["final_fragment"]),
        "observed_token_span": [e["baseline_token_start"], e["baseline_token_end"]], "anchors": [spoken.normalized(e["left_anchor"]), spoken.normalized(e["right_anchor"])],
    })


def test_recordings_give_levels_and_delays(spark):
    from turnloom.sources import audio

    loud, quiet = [0.5, -0.5] * 400, [0.0] * 800  # two seconds each at 400 a second
    rec = spark.createDataFrame([("p", 400, 2.0**-15, loud + quiet + loud)], "project_id string, rate int, unit double, samples array<double>")
    assert [(r["delay_id"], round(r["start"], 2), round(r["end"], 2)) for r in intervals.detected_delays(rec).collect()] == [(1, 2.0, 4.0)]
    t = schemas.turns(turns(spark, [dict(project_id="p", turn_id=1, start=0.0, end=2.0), dict(project_id="p", turn_id=2, start=2.0, end=4.0), dict(project_id="p", turn_id=3, start=1.0, end=3.0), dict(project_id="q", turn_id=1, start=0.0, end=1.0)]))
    got = {(r["project_id"], r["turn_id"]): (r["volume_dbfs"], r["noise_snr_db"]) for r in intervals.turn_levels(t, rec, audio.thinned).collect()}
    assert got["p", 1] == pytest.approx((-6.0206, 0.0), abs=1e-3) and got["q", 1] == (None, None)
    assert got["p", 2][0] == pytest.approx(-90.309, abs=1e-3) and got["p", 2][1] is None  # silence is one step of the integers
    assert got["p", 3][0] == pytest.approx(-9.031, abs=1e-3) and got["p", 3][1] == pytest.approx(3.01, abs=0.02)
    long = spark.createDataFrame([("a", 0, 400, [float(i % 7) for i in range(900_000)])], "audio_id string, interval_index int, rate int, samples array<double>")
    assert len(audio.thinned(long).first()["samples"]) == 225_000
    seg = [("p", "model", 0, 0.0, 2.0, "Ann", "Hello there", 0.9), ("p", "model", 1, 4.0, 6.0, "Bob", "fine thanks", 0.8)]
    p = spark.createDataFrame([("p", "AI", "", {})], "project_id string, conversation_type string, learner_id string, speaker_mapping map<string,string>")
    a = pipeline.transcribe(spark.createDataFrame(seg, schemas.SEGMENTS), p, recordings=rec)
    assert [r["volume_dbfs"] for r in a.turns.orderBy("turn_id").collect()] == pytest.approx([-6.0206, -6.0206], abs=1e-3)
    assert [(e["event_type"], e["start"], e["end"]) for e in a.events.collect()] == [("response_gap", 2.0, 4.0)]
    a.release()


def test_editing_moves_text_and_time(spark):
    rows = [dict(project_id="p", turn_id=i, start=float(i), end=i + 1.0, final_text=f"text {i} more", quality_target_text=f"text {i} more", zoom_text=f"z{i}", manual_review=i == 2) for i in (1, 2, 3)]
    t = schemas.turns(turns(spark, rows))
    m = TO.merge_two(t, "p", 1).orderBy("turn_id").collect()
    assert [(r["turn_id"], r["start"], r["end"], r["final_text"], r["manual_review"]) for r in m] == [(1, 1.0, 3.0, "text 1 more text 2 more", True), (2, 3.0, 4.0, "text 3 more", False)]
    s = TO.split_one(t, "p", 2, 6).orderBy("turn_id").collect()
    assert [(r["turn_id"], r["final_text"], r["zoom_text"]) for r in s] == [(1, "text 1 more", "z1"), (2, "text 2", "z2"), (3, "more", ""), (4, "text 3 more", "z3")]
    assert s[1]["end"] == s[2]["start"] == pytest.approx(2 + 6 / 11)


def test_delays_know_their_recording(spark):
    d = {"audio_source_path": "a.wav", "audio_source_size_bytes": "10", "audio_source_modified_time_ns": "7"}
    rows = [("p", "automatic", d), ("p", "manual", {}), ("q", "automatic", {**d, "audio_source_size_bytes": "11"}), ("r", "manual", {})]
    rows = [(a, TO.AUTOMATIC if b == "automatic" else b, c) for a, b, c in rows]
    got = TO.same_audio(spark.createDataFrame(rows, "project_id string, source string, details map<string,string>"), "a.wav", 10, 7)
    assert {r["project_id"]: r["same"] for r in got.collect()} == {"p": True, "q": False, "r": None}


def test_recognizer_rows_and_sql_names(spark):
    from turnloom.functions import register
    from turnloom.sources import transcripts

    rows = spark.createDataFrame([("p", 0, 0, 150, " hi ", 0.5), ("p", 1, 150, 200, " ", 0.5), ("p", 2, 200, 300, "x", float("nan")), ("p", 3, 300, 400, "y", 1.5)], "project_id string, idx int, t0 long, t1 long, text string, probability double")
    got = transcripts.recognized(rows).collect()
    assert [(r["seg_idx"], r["start"], r["end"], r["text"], r["confidence"]) for r in got] == [(0, 0.0, 1.5, "hi", 0.5), (2, 2.0, 3.0, "x", None), (3, 3.0, 4.0, "y", 1.0)]
    assert "word_error_rate" in register.register(spark)
    assert spark.sql("SELECT word_error_rate('I go to school', 'I went to school') AS x").first()["x"] == 0.25
