"""PCM WAV files as signals: samples in units of full scale.

Recordings of any length are read in pieces (`recordings`, `frames`, `levels`): only a file's header is read to list it, intervals
meet the pieces that they touch, and a task reads one piece's bytes at a time and gives exact integer sums of squares for each
frame in it. Sums of frames that lie across pieces are added, so results do not depend on how files are cut. `read` decodes whole
files into rows and is for short signals.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators.spread import spread

#: Samples (of all channels together) of a piece.
PIECE = 1 << 18
#: Most samples of an interval that level measures look at; longer ones are thinned evenly.
MOST_SAMPLES = 200_000


def samples(data: bytes, mono: bool = True) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, rate) of 8, 16, 24 or 32 bit PCM; several channels are averaged unless `mono`."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            channels, width, rate, raw = f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError(f"not a PCM WAV file: {e}") from e
    if mono and channels != 1:
        raise ValueError(f"one channel is needed; there are {channels}")
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    elif width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int64)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
    else:
        x = np.frombuffer(raw[: len(raw) // width * width], f"<i{width}")
    x = x.astype(float) / 2 ** (8 * width - 1)
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def unit(data: bytes) -> float:
    """What one step of a file's integers is, in units of full scale."""
    with wave.open(io.BytesIO(data)) as f:
        return 2.0 ** (1 - 8 * f.getsampwidth())


def read(spark: SparkSession, path: str, intervals: DataFrame | None = None, mono: bool = True) -> DataFrame:
    """(audio_id, interval_index, start, end, rate, unit, samples) of WAV files.

    intervals: audio_id, interval_index, start, end; without it each file is one interval. A file is
    decoded once for all of its intervals.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("audio_id"), "content")

    def step(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                x, rate = samples(bytes(r.content), mono)
                out.append((r.audio_id, rate, unit(bytes(r.content)), x))
            yield pd.DataFrame(out, columns=["audio_id", "rate", "unit", "samples"])

    audio = files.mapInPandas(step, "audio_id string, rate int, unit double, samples array<double>")
    if intervals is None:
        none = F.lit(None).cast("double")
        return audio.select("audio_id", F.lit(0).alias("interval_index"), none.alias("start"), none.alias("end"), "rate", "unit", "samples")
    return audio.join(intervals, "audio_id").select("audio_id", "interval_index", "start", "end", "rate", "unit", "samples")


def thinned(signals: DataFrame) -> DataFrame:
    """Signals with at most about MOST_SAMPLES samples, every k-th."""
    k = F.greatest(F.lit(1), F.floor(F.size("samples") / MOST_SAMPLES))
    return signals.withColumn("samples", F.when(k == 1, F.col("samples")).otherwise(F.filter("samples", lambda x, i: i % k == 0))).withColumn("rate", F.col("rate") / k)


# --- recordings in pieces -------------------------------------------------------------------------


def opened(path: str):
    """A file by its path or URI, open for reading at any place."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return open(path, "rb")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def header(f) -> tuple[int, int, int, int, int]:
    """(rate, channels, bytes of a sample, where the samples start, samples of each channel) of a PCM WAV file; its samples are not read."""
    size = f.seek(0, 2)
    f.seek(0)
    lead = f.read(12)
    if len(lead) < 12 or lead[:4] != b"RIFF" or lead[8:] != b"WAVE":
        raise ValueError("not a PCM WAV file: no RIFF header")
    at, form = 12, None
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels:
                raise ValueError(f"not a PCM WAV file: format {kind}, {bits} bits")
            form = rate, channels, bits // 8
        elif name == b"data":
            if form is None:
                raise ValueError("not a PCM WAV file: samples before their format")
            n = min(n, size - at - 8)
            return *form, at + 8, n // (form[1] * form[2])
        at += 8 + n + n % 2
    raise ValueError("not a PCM WAV file: no samples")


def recordings(spark: SparkSession, path: str, mono: bool = True) -> DataFrame:
    """(audio_id, path, rate, unit, channels, width, offset, total) of WAV files: their formats, and where their samples are."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch["path"]:
                with opened(p) as f:
                    rate, channels, width, offset, total = header(f)
                if mono and channels != 1:
                    raise ValueError(f"one channel is needed; there are {channels}")
                out.append((p, p, rate, 2.0 ** (1 - 8 * width), channels, width, offset, total))
            yield pd.DataFrame(out, columns=["audio_id", "path", "rate", "unit", "channels", "width", "offset", "total"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(step, "audio_id string, path string, rate int, unit double, channels int, width int, offset long, total long")


def integers(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples as integers, the sum over the channels."""
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.int64)
    return x.reshape(-1, channels).sum(axis=1)


def squares(x: np.ndarray, starts: np.ndarray) -> list[int]:
    """Sums of squares of the stretches that begin at `starts`: exact, as 16 bits at a time cannot overflow."""
    high, low = x >> 16, x & 0xFFFF
    sums = (np.add.reduceat(y, starts).tolist() for y in (high * high, high * low, low * low))
    return [(a << 32) + (b << 17) + c for a, b, c in zip(*sums, strict=True)]


def sums(work: DataFrame, piece: int = PIECE) -> DataFrame:
    """Adds the exact `power` (sum of squared integers) of each block of intervals, and the `n` of its samples.

    work: path, channels, width, offset, `a` and `b` (first sample and end), `size` (samples of a block), `stride` (every so
    many samples count), and other columns, which are kept; `block` counts from the interval's first sample. A block that lies
    across pieces has a row for each.
    """
    kept = work.columns
    cut = work.where("b > a").withColumn("piece_", F.explode(F.sequence(F.floor(F.col("a") / piece), F.floor((F.col("b") - 1) / piece))))
    # Rows of a piece lie together, so that a task reads it once; rows are few bytes, their pieces are not.
    dealt = spread(cut, "path", "piece_").sortWithinPartitions("path", "piece_")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, x = None, np.zeros(0, np.int64)
        for batch in batches:
            for i, r in enumerate(batch.itertuples(index=False)):
                first = int(r.piece_) * piece
                if at != (r.path, first):
                    with opened(r.path) as f:
                        f.seek(r.offset + first * r.width * r.channels)
                        raw = f.read(piece * r.width * r.channels)
                    x, at = integers(raw[: len(raw) // (r.width * r.channels) * r.width * r.channels], r.width, r.channels), (r.path, first)
                low, high = max(int(r.a), first), min(int(r.b), first + len(x))
                low += -(low - int(r.a)) % int(r.stride)
                if low >= high:
                    continue
                own = x[low - first : high - first : int(r.stride)]
                nth = (low - int(r.a)) // int(r.stride) + np.arange(len(own))
                block = nth // int(r.size)
                starts = np.flatnonzero(np.diff(block, prepend=-1))
                out = pd.concat([batch.iloc[[i]]] * len(starts), ignore_index=True)[kept] if len(starts) > 1 else batch.iloc[[i]][kept].reset_index(drop=True)
                out["block"], out["n"] = block[starts], np.diff(starts, append=len(own))
                out["power"] = [Decimal(p) for p in squares(own, starts)]
                yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema)
    return dealt.mapInPandas(step, f"{kinds}, block long, n long, power decimal(38,0)")


def rms(power: Column, n: Column) -> Column:
    """Root of the mean square in units of full scale; needs `channels` and `width`."""
    return F.sqrt(power.cast("double") / n) / (F.col("channels") * F.pow(F.lit(2.0), 8 * F.col("width") - 1))


def whole(recs: DataFrame) -> DataFrame:
    """An interval for each recording."""
    none = F.lit(None).cast("double")
    return recs.select("audio_id", F.lit(0).alias("interval_index"), none.alias("start"), none.alias("end"))


def frames(recs: DataFrame, intervals: DataFrame | None = None, seconds: float = 0.02, piece: int = PIECE) -> DataFrame:
    """What `operators.intervals.frames` gives, of recordings: levels of frames of each interval (audio_id, interval_index, start, end)."""
    own = I.frame_bounds((whole(recs) if intervals is None else intervals).join(recs, "audio_id"), F.col("total"), seconds)
    key = ["audio_id", "interval_index", "lo", "hi", "rate", "a", "b", "size", "channels", "width"]
    work = own.select(*key, F.lit(1).alias("stride"), "path", "offset")
    found = sums(work, piece).groupBy(*key, F.col("block").alias("frame")).agg(F.sum("power").alias("power"), F.sum("n").alias("n"))
    start = F.col("a") + F.col("frame") * F.col("size")
    return found.select("audio_id", "interval_index", "lo", "hi", "rate", "frame", start.alias("start_frame"), F.least(F.col("b"), start + F.col("size")).alias("end_frame"), I.dbfs(rms(F.col("power"), F.col("n"))).alias("dbfs"))


def levels(recs: DataFrame, intervals: DataFrame, block: float = 0.05, least_block: int = 64, piece: int = PIECE) -> DataFrame:
    """What `operators.intervals.signal_levels` gives, of intervals of recordings; long ones are thinned to about MOST_SAMPLES samples."""
    start = F.greatest(F.lit(0.0), F.coalesce("start", F.lit(0.0)))
    a = F.floor(start * F.col("rate"))
    b = F.least(F.col("total"), F.coalesce(F.floor(F.greatest(F.coalesce("start", F.lit(0.0)), F.col("end")) * F.col("rate")), F.col("total")))
    own = intervals.join(recs, "audio_id").withColumn("a", a).withColumn("b", b).where("b > a")
    stride = F.greatest(F.lit(1), F.floor((F.col("b") - F.col("a")) / MOST_SAMPLES))
    own = own.withColumn("stride", stride).withColumn("samples", F.ceil((F.col("b") - F.col("a")) / F.col("stride")))
    own = own.withColumn("size", F.greatest(F.lit(least_block), F.least(F.col("samples"), F.floor(F.col("rate") / F.col("stride") * block))))
    key = ["audio_id", "interval_index", "unit", "channels", "width"]
    parts = sums(own.select(*key, "path", "offset", "a", "b", "size", "stride"), piece).groupBy(*key, "block").agg(F.sum("power").alias("power"), F.sum("n").alias("n"))
    loud = F.when(F.col("power") > 0, rms(F.col("power"), F.col("n")))
    # At most 2 * MOST_SAMPLES / least_block blocks.
    found = parts.groupBy(*key).agg(F.sum("power").alias("power"), F.sum("n").alias("n"), F.array_sort(F.collect_list(loud)).alias("blocks"))
    return I.levels_of_blocks(found.withColumn("rms", rms(F.col("power"), F.col("n"))).withColumn("unit_", F.col("unit")))


def turn_levels(turns: DataFrame, recs: DataFrame, piece: int = PIECE) -> DataFrame:
    """Turns with `volume_dbfs` and `noise_snr_db` measured in their project's recording; recs has project_id besides what `recordings` gives."""
    spans = turns.select(F.col("project_id").alias("audio_id"), F.col("turn_id").alias("interval_index"), "start", "end")
    found = levels(recs.drop("audio_id").withColumnRenamed("project_id", "audio_id"), spans, piece=piece)
    found = found.select(F.col("audio_id").alias("project_id"), F.col("interval_index").alias("turn_id"), "volume_dbfs", "noise_snr_db")
    return turns.drop("volume_dbfs", "noise_snr_db").join(found, ["project_id", "turn_id"], "left")


def detected_delays(recs: DataFrame, threshold: float = -45.0, least: float = 0.3, piece: int = PIECE) -> DataFrame:
    """(project_id, delay_id, start, end): silences of each project's recording, in order of time."""
    framed = frames(recs.drop("audio_id").withColumnRenamed("project_id", "audio_id"), piece=piece)
    return I.as_delays(I.silent_runs(framed, threshold, least))
