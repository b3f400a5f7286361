import io
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import intervals as I
from turnloom.sources import audio


def written(path, x, rate=1000, width=2, channels=1):
    x = np.asarray(x).reshape(-1, channels)
    if width == 1:
        raw = (x + 128).astype(np.uint8).tobytes()
    elif width == 3:
        raw = x.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        raw = x.astype(f"<i{width}").tobytes()
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate), f.writeframes(raw)
    return str(path)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(1)
    path = tmp_path_factory.mktemp("wav")
    loud = lambda n: rng.integers(-20_000, 20_000, n)
    written(path / "a.wav", np.concatenate([loud(900), np.zeros(2100), loud(500), rng.integers(-3, 3, 700), loud(1333)]))
    written(path / "b.wav", np.concatenate([np.zeros(40), loud(3000), np.zeros(1500)]), rate=800)
    written(path / "c.wav", [], rate=8000)
    return path


def short(spark, path):
    """Whole recordings in rows."""
    return audio.read(spark, str(path)).select(F.col("audio_id").alias("project_id"), "rate", "unit", "samples")


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


SPANS = [("a", 1, 0.5, 1.75), ("a", 2, None, None), ("a", 3, -3.0, 0.4), ("a", 4, 2.0, 99.0), ("b", 5, 1.0, None), ("b", 6, 2.0, 2.0), ("c", 7, None, None), ("b", 8, 900.0, 901.0)]


def spans(spark, folder):
    at = {x: f"file:{folder}/{x}.wav" for x in "abc"}
    return spark.createDataFrame([(at[a], *r) for a, *r in SPANS], "audio_id string, interval_index int, start double, end double")


@pytest.mark.parametrize("piece", [7, 100, 1 << 18])
def test_frames_and_levels_do_not_depend_on_pieces_and_equal_whole_signals(spark, folder, piece):
    recs, own = audio.recordings(spark, str(folder)), spans(spark, folder)
    whole = audio.read(spark, str(folder), own)
    key = ["audio_id", "interval_index", "lo", "hi", "rate", "frame", "start_frame", "end_frame", "dbfs"]
    assert rows(audio.frames(recs, own, piece=piece).select(key)) == rows(I.frames(whole).select(key))
    turns = own.withColumnRenamed("audio_id", "project_id").withColumnRenamed("interval_index", "turn_id")
    old = I.turn_levels(turns, short(spark, folder), audio.thinned)
    new = audio.turn_levels(turns, recs.withColumn("project_id", F.col("audio_id")), piece)
    same = ["project_id", "turn_id", "volume_dbfs", "noise_snr_db"]
    assert rows(new.select(same)) == rows(old.select(same))


def test_delays_of_recordings(spark, folder):
    recs = audio.recordings(spark, str(folder)).withColumn("project_id", F.col("audio_id"))
    old = I.detected_delays(short(spark, folder))
    found = rows(audio.detected_delays(recs, piece=333))
    assert found == rows(old) and len(found) == 2


def test_long_intervals_are_thinned_as_whole_signals_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audio, "MOST_SAMPLES", 500)
    rng = random.Random(2)
    path = written(tmp_path / "x.wav", [rng.randrange(-9000, 9000) if i // 700 % 2 else 0 for i in range(5003)])
    t = spark.createDataFrame([("file:" + path, 1, 0.3, 4.9), ("file:" + path, 2, None, None)], "project_id string, turn_id int, start double, end double")
    old = I.turn_levels(t, short(spark, path), audio.thinned)
    new = audio.turn_levels(t, audio.recordings(spark, path).withColumn("project_id", F.col("audio_id")), 61)
    assert rows(new.select("turn_id", "volume_dbfs", "noise_snr_db")) == rows(old.select("turn_id", "volume_dbfs", "noise_snr_db"))


@pytest.mark.parametrize(("width", "channels"), [(1, 1), (2, 2), (3, 1), (4, 3)])
def test_squares_of_all_widths_are_exact(spark, tmp_path, width, channels):
    top = 2 ** (8 * width - 1)
    rng = random.Random(width)
    x = [-top] * 30 * channels + [rng.randrange(-top, top) for _ in range(300 * channels)]
    path = written(tmp_path / "x.wav", x, 100, width, channels)
    work = audio.recordings(spark, path, mono=False).select("path", "channels", "width", "offset", *(F.lit(v).alias(k) for k, v in (("a", 3), ("b", 320), ("size", 50), ("stride", 2))))
    got = sorted((r["block"], r["n"], int(r["power"])) for r in audio.sums(work, 64).groupBy("block").agg(F.sum("n").alias("n"), F.sum("power").alias("power")).collect())
    mixed = [sum(x[i * channels : (i + 1) * channels]) for i in range(330)][3:320:2]
    assert got == [(k, len(mixed[50 * k : 50 * k + 50]), sum(v * v for v in mixed[50 * k : 50 * k + 50])) for k in range(4)]


def test_headers():
    with pytest.raises(ValueError, match="RIFF"):
        audio.header(io.BytesIO(b"RIFF"))
    with pytest.raises(ValueError, match="no samples"):
        audio.header(io.BytesIO(b"RIFF\x04\0\0\0WAVE"))
    fmt = b"fmt \x10\0\0\0" + b"\x01\0\x01\0" + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + b"\x02\0\x10\0"
    odd = b"note\x03\0\0\0abc\0"
    assert audio.header(io.BytesIO(b"RIFF\0\0\0\0WAVE" + odd + fmt + b"data\xff\xff\xff\xff" + b"12345")) == (8000, 1, 2, 56, 2)
    with pytest.raises(ValueError, match="format 3"):
        audio.header(io.BytesIO(b"RIFF\0\0\0\0WAVE" + fmt.replace(b"\x01\0\x01\0", b"\x03\0\x01\0")))


def test_stereo_is_refused_where_one_channel_is_needed(spark, tmp_path):
    path = written(tmp_path / "x.wav", [1, 2, 3, 4], channels=2)
    with pytest.raises(Exception, match="one channel"):
        audio.recordings(spark, path).collect()


# --- silent runs


@pytest.mark.parametrize(("stretch", "stretches"), [(1, 2), (2, 3), (5, 2), (64, 4), (4096, 4096)])
def test_runs_do_not_depend_on_stretches(spark, stretch, stretches):
    rng = random.Random(3)
    made, want = [], []
    for k in range(12):
        quiet = [rng.random() < 0.8 for _ in range(rng.randint(1, 60))] if k else [True] * 50
        level = [None if q and rng.random() < 0.3 else -60.0 - rng.randrange(9) if q else -10.0 for q in quiet]
        n = len(quiet)
        made += [(f"r{k}", 0, 0.0, n / 10, 10, i, i, i + 1, level[i]) for i in range(n)]
        i = 0
        while i < n:
            j = i
            while j < n and quiet[j]:
                j += 1
            if j - i >= 2:
                loudest = max((x for x in level[i:j] if x is not None), default=None)
                want.append((f"r{k}", i / 10, j / 10, loudest))
            i = max(j, i + 1)
    df = spark.createDataFrame(made, "audio_id string, interval_index int, lo double, hi double, rate int, frame long, start_frame long, end_frame long, dbfs double").repartition(3)
    got = I.silent_runs(df, least=0.2, edges=True, stretch=stretch, stretches=stretches).select("audio_id", "start_seconds", "end_seconds", "loudest_frame_dbfs")
    assert rows(got) == sorted(want, key=repr)


# --- the time index


def test_intervals_of_any_length_have_few_cells_and_hold_their_moments_once(spark):
    rng = random.Random(4)
    long = [(0.0, 1e9), (-1e9, 1e9), (5.0, 1e300), (-math.inf, math.inf), (599.9, 600.0), (0.0, 0.0), (38_399.0, 38_401.0)]
    many = long + [(s, s + rng.choice([0, 1, 500, 7000, 10**5, 10**7])) for s in (rng.uniform(-1e6, 1e6) for _ in range(60))]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(many)], "i int, s double, e double")
    cells = I.in_cells(df, "s", "e")
    per = {r["i"]: r["count"] for r in cells.groupBy("i").count().collect()}
    assert max(per.values()) <= 2 * I.FAN * I.LEVELS + 4000 and per[0] < 300 and per[4] == 2 and per[5] == 1
    moments = sorted({x for p in many for x in p} | {rng.uniform(-2e6, 2e6) for _ in range(300)} | {600.0 * k for k in range(-70, 70)})
    m = I.at_cells(spark.createDataFrame([(x,) for x in moments], "x double"), "x")
    got = sorted((r["i"], r["x"]) for r in cells.join(m, I.CELLS).where("x BETWEEN s AND e").collect())
    assert got == sorted((i, x) for i, (a, b) in enumerate(many) for x in moments if a <= x <= b)


def test_overlaps_and_owners_with_one_endless_turn(spark):
    rng = random.Random(5)
    turns = [("p", 0, 10.0, 1e9, "x")] + [("p", i, t := rng.uniform(0, 1e6), t + rng.choice([0.1, 0.5, 20.0, 5000.0]), rng.choice("xy")) for i in range(1, 200)]
    df = spark.createDataFrame(turns, "project_id string, turn_id int, start double, end double, speaker_raw string")
    hit = {a[1] for a in turns for b in turns if a[1] != b[1] and a[4] != b[4] and min(a[3], b[3]) - max(a[2], b[2]) > I.OVERLAP}
    assert {r["turn_id"] for r in I.overlapping_ids(df).collect()} == hit
    delays = spark.createDataFrame([("p", 1, 50.0, 1e9), ("p", 2, 100.0, 101.0)], "project_id string, delay_id int, start double, end double")
    found = {r["delay_id"]: r["association"] for r in I.delay_owners(df.withColumnRenamed("speaker_raw", "label"), delays).collect()}
    assert found[2] == "inside_turn" and set(found) == {1, 2}
