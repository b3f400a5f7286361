import random

import pytest
from pyspark.sql import functions as F

from turnloom import schemas
from turnloom.operators import alignment, tables
from turnloom.sources import audio

from .test_recordings import rows, written


@pytest.fixture(scope="module", autouse=True)
def named(spark):
    assert tables.register(spark) == ["align_chunks", "wav_frames"]


@pytest.mark.parametrize("piece", [50, 1 << 18])
def test_frames_in_sql_equal_those_of_the_data_frame(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(audio, "PIECE", piece)
    rng = random.Random(1)
    path = written(tmp_path / "x.wav", [0] * 30 + [rng.randrange(-9000, 9000) for _ in range(415)], 1000)
    for seconds in (0.02, 0.0125):
        want = audio.frames(audio.recordings(spark, path), seconds=seconds).select("frame", "start_frame", "end_frame", "dbfs")
        assert rows(spark.sql(f"SELECT * FROM wav_frames('{path}', {seconds}D)")) == rows(want)
    assert spark.sql(f"SELECT count(*) AS n FROM wav_frames('{path}')").first()["n"] == 23
    assert spark.sql("SELECT * FROM wav_frames(CAST(NULL AS STRING))").count() == 0
    with pytest.raises(Exception, match="needs a path"):
        spark.sql("SELECT * FROM wav_frames(3)")


def test_alignment_in_sql_equals_that_of_the_data_frame(spark):
    rng = random.Random(2)
    words = ["yes", "no", "well", "i", "went", "home", "today", "again", "tea"]
    turns, segments = [], []
    for p in ("p", "q"):
        for i in range(25):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
            turns.append((p, i, float(2 * i), 2 * i + 1.8, rng.choice(["A", "B"]), text))
        for i in range(18):
            segments.append((p, i, 2.7 * i, 2.7 * i + 2, rng.choice(["A", "B", "Unknown"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))))
    t = spark.createDataFrame(turns, f"project_id string, turn_id int, start double, end double, speaker_raw string, `{alignment.ANCHORS[0]}` string")
    s = spark.createDataFrame(segments, "project_id string, seg_idx int, start double, end double, speaker string, text string").withColumn("source", F.lit("zoom"))
    want = alignment.align_source(schemas.turns(t), s).select("project_id", "turn_id", "text", "segment_idx")
    both = t.toDF("project_id", "position", "start", "end", "speaker", "text").withColumn("kind", F.lit("turn")).unionByName(s.withColumnRenamed("seg_idx", "position").drop("source").withColumn("kind", F.lit("segment")))
    both.createOrReplaceTempView("to_align")
    got = spark.sql("SELECT * FROM align_chunks(TABLE(to_align) PARTITION BY project_id ORDER BY position)")
    assert rows(got) == rows(want) and got.count() == 50
    with pytest.raises(Exception, match="no columns kind"):
        spark.sql("SELECT * FROM align_chunks(TABLE(SELECT project_id, position, start, end, speaker, text FROM to_align) PARTITION BY project_id)")
