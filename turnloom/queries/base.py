"""Stand-in inputs for the queries, in Spark and in SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL where SQL can express it."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- conversations as turns -----------------------------------------------------------------------

#: Words in DuckDB; the tables' only letter whose case folding is not its lower case is the sharp s.
WORDS = "regexp_extract_all(replace(replace(lower({0}), 'ß', 'ss'), '’', ''''), '[\\p{{L}}\\p{{N}}_''’]+')"


def words_sql(c: str) -> str:
    return WORDS.format(c)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns: 0.4 s a word, one after another; `gold` holds the words, `cut` all but
    every 7th, `alien` every 5th replaced."""
    c = table(spark, sf_dir, "conversations").withColumn("w", T.words("text")).withColumn("n", F.size("w"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return c.select(
        F.col("conv_id").cast("string").alias("project_id"), (F.col("turn") + 1).cast("int").alias("turn_id"), F.col("role").alias("speaker_raw"), "text", "w", "n",
        (F.lit(0.4).cast("double") * (total - F.col("n"))).alias("start"), (F.lit(0.4).cast("double") * total).alias("end"),
        F.array_join("w", " ").alias("gold"), F.array_join(F.filter("w", lambda x, i: (i + 1) % 7 != 0), " ").alias("cut"),
        F.array_join(F.transform("w", lambda x, i: F.when((i + 1) % 5 == 0, "zzq").otherwise(x)), " ").alias("alien"),
    )


TURNS = f"""
  t0 AS (SELECT conv_id, turn, role, text, {words_sql("text")} AS w FROM conversations),
  t1 AS (SELECT *, len(w) AS n, CAST(sum(len(w)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS total FROM t0),
  turns AS (SELECT CAST(conv_id AS VARCHAR) AS project_id, CAST(turn + 1 AS INTEGER) AS turn_id, role AS speaker_raw, text, w, n,
    CAST(0.4 AS DOUBLE) * (total - n) AS "start", CAST(0.4 AS DOUBLE) * total AS "end" FROM t1)
"""


# --- events as timed rows -------------------------------------------------------------------------

#: Seconds that an event lasts for each unit of its value.
SECONDS = 120


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of users: a turn each, in order of time; the type stands for the speaker."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").cast("string").alias("project_id"), F.row_number().over(w).alias("turn_id"), F.col("event_id"), F.col("event_type").alias("speaker_raw"),
        F.col("event_type").alias("speaker"), start.alias("start"), (start + F.lit(float(SECONDS)) * F.col("value")).alias("end"), "value",
    )


INTERVALS = f"""
  intervals AS (SELECT CAST(user_id AS VARCHAR) AS project_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS turn_id,
    event_id, event_type AS speaker_raw, event_type AS speaker, epoch_us(ts) / 1e6 AS "start", epoch_us(ts) / 1e6 + {SECONDS}.0 * value AS "end", value FROM events)
"""


# --- vectors as signals ---------------------------------------------------------------------------


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as recordings of 64 samples at 400 a second: frames of 20 ms hold 8."""
    e = table(spark, sf_dir, "embeddings")
    none = F.lit(None).cast("double")
    return e.select(
        F.col("vec_id").cast("string").alias("audio_id"), F.lit(0).alias("interval_index"), none.alias("start"), none.alias("end"), F.lit(400).alias("rate"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


FRAMES = """
  f0 AS (SELECT CAST(vec_id AS VARCHAR) AS audio_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s, unnest(range(8)) AS frame FROM embeddings),
  f1 AS (SELECT audio_id, frame, sqrt(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(s[frame * 8 + 1 : frame * 8 + 8], lambda x: x * x)), lambda a, b: a + b) / 8) AS rms FROM f0),
  frames AS (SELECT audio_id, frame, CASE WHEN rms > 0 THEN 20 * log10(rms) END AS dbfs FROM f1)
"""
