"""Queries of intervals, turns, windows and views over events as timed rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import alignment, identity, intervals as I, turns as TO, views
from .base import FRAMES, INTERVALS, TURNS, intervals, query, signals, turns

W = "WITH " + INTERVALS


@query(W + """, n AS (SELECT *, lead("start") OVER w AS s2, lead("end") OVER w AS e2 FROM intervals WINDOW w AS (PARTITION BY project_id ORDER BY turn_id))
  SELECT event_id, CASE WHEN s2 IS NOT NULL AND greatest("end", e2) - least("start", s2) > 0
    THEN greatest(0.0, least("end", e2) - greatest("start", s2)) / (greatest("end", e2) - least("start", s2)) ELSE 0.0 END AS iou FROM n""")
def f19_time_iou(spark, sf):
    w = Window.partitionBy("project_id").orderBy("turn_id")
    t = intervals(spark, sf).withColumn("s2", F.lead("start").over(w)).withColumn("e2", F.lead("end").over(w))
    return t.select("event_id", I.time_iou(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")).alias("iou"))


@query(W + """ SELECT DISTINCT a.event_id FROM intervals a JOIN intervals b ON a.project_id = b.project_id AND a.turn_id <> b.turn_id AND a.speaker_raw <> b.speaker_raw
  AND least(a."end", b."end") - greatest(a."start", b."start") > 0.15""")
def j_overlap(spark, sf):
    t = intervals(spark, sf)
    return I.overlapping_ids(t, "event_id").select("event_id")


_GAP = 20_000.0


@query(W + f""", b AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND "start" - lag("end") OVER w <= {_GAP} THEN 0 ELSE 1 END AS brk FROM intervals WINDOW w AS (PARTITION BY project_id ORDER BY turn_id)),
  i AS (SELECT *, sum(brk) OVER (PARTITION BY project_id ORDER BY turn_id) AS g FROM b)
  SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY min(turn_id)) - 1 AS INTEGER) AS seg_idx, arg_min("start", turn_id) AS "start", arg_max("end", turn_id) AS "end",
    min(speaker) AS speaker, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY turn_id) AS text FROM i GROUP BY project_id, g""")
def s10_merge_segments(spark, sf):
    t = intervals(spark, sf).select(
        "project_id", F.lit("zoom").alias("source"), F.col("turn_id").alias("seg_idx"), "start", "end", "speaker", F.col("event_id").cast("string").alias("text"), F.lit(None).cast("double").alias("confidence")
    )
    return TO.merge_segments(t, _GAP).select("project_id", "seg_idx", "start", "end", "speaker", "text")


@query(W + """ SELECT project_id, turn_id, event_id, speaker_raw FROM intervals""")
def a1_segments_to_turns(spark, sf):
    t = intervals(spark, sf).select("project_id", F.col("turn_id").alias("seg_idx"), "start", "end", "speaker", F.col("event_id").cast("string").alias("text"), F.lit(None).cast("double").alias("confidence"))
    return TO.from_segments(t).select("project_id", "turn_id", F.col("model_text").cast("long").alias("event_id"), "speaker_raw")


@query("WITH " + TURNS + """, p AS (SELECT project_id, turn_id, "start", "end", list_filter(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM turns),
  c AS (SELECT *, unnest(range(len(w))) AS chunk FROM p)
  SELECT project_id, turn_id, CAST(chunk AS INTEGER) AS chunk, w[chunk + 1] AS text, CASE WHEN "end" >= "start" THEN "start" + ("end" - "start") * (chunk + 0.5) / len(w) END AS middle FROM c""")
def a3_source_chunks(spark, sf):
    t = turns(spark, sf).select("project_id", F.lit("zoom").alias("source"), F.col("turn_id").alias("seg_idx"), "start", "end", "text")
    return alignment.source_chunks(t).select("project_id", F.col("seg_idx").alias("turn_id"), "chunk", "text", "middle")


@query(W + """, m AS (SELECT project_id, event_id AS moment_id, "start" + 1000 AS moment FROM intervals),
  j AS (SELECT m.project_id, moment_id, turn_id, moment BETWEEN "start" AND "end" AS inside,
    CASE WHEN moment BETWEEN "start" AND "end" THEN abs(moment - ("start" + "end") / 2) ELSE least(abs(moment - "start"), abs(moment - "end")) END AS far FROM m JOIN intervals t ON t.project_id = m.project_id)
  SELECT project_id, moment_id, turn_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, moment_id ORDER BY NOT inside, far, turn_id) AS rn FROM j) WHERE rn = 1""")
def a5_nearest_turn(spark, sf):
    t = intervals(spark, sf)
    m = t.select("project_id", F.col("event_id").alias("moment_id"), (F.col("start") + 1000).alias("moment"))
    return alignment.nearest_turn(t, m)


@query(W + """, s AS (SELECT project_id, CASE WHEN speaker IN ('click', 'signup') THEN 'zoom' WHEN speaker = 'view' THEN 'gold' ELSE 'chatgpt' END AS source, CAST(bool_or(speaker <> 'signup') AS INTEGER) AS timed
    FROM intervals WHERE speaker <> 'purchase' GROUP BY ALL)
  SELECT project_id, arg_max(source, 10 * timed + CASE source WHEN 'zoom' THEN 3 WHEN 'gold' THEN 2 ELSE 1 END) AS source, max(timed) = 1 AS timed FROM s GROUP BY project_id""")
def a12_scaffold(spark, sf):
    """Clicks are one source and signups more of it, without times; purchases are the recogniser's, which is no scaffold."""
    kind = F.col("speaker")
    name = F.when(kind.isin("click", "signup"), "zoom").when(kind == "view", "gold").when(kind == "error", "chatgpt").otherwise("model")
    t = intervals(spark, sf)
    return alignment.scaffold(t.withColumns({"source": name, "start": F.when(kind != "signup", F.col("start")), "end": F.when(kind != "signup", F.col("end"))}))


#: Every 9th interval of the second half of a day as a delay, the others as turns.
_SPLIT = "event_id % 9 = 0"


def _owners_sql(n: str = "", turns_where: str = f"NOT {_SPLIT}") -> str:
    """Tables of delays and their owners among some turns; `n` ends the tables' names."""
    return f""", t{n} AS (SELECT *, row_number() OVER w AS rn, lead(turn_id) OVER w AS n_id, lead("start") OVER w AS n_start, lead(speaker) OVER w AS n_speaker FROM intervals WHERE {turns_where}
    WINDOW w AS (PARTITION BY project_id ORDER BY "start", "end", turn_id)),
  d{n} AS (SELECT project_id, event_id AS delay_id, "start" - 3000 AS ds, "start" + 3000 AS de, "start" AS mid FROM intervals WHERE {_SPLIT}),
  r1{n} AS (SELECT delay_id, arg_min(t.turn_id, rn) AS p, arg_min(n_id, rn) AS f FROM d{n} d JOIN t{n} t ON d.project_id = t.project_id WHERE t."end" <= n_start AND (t."end" + n_start) / 2 BETWEEN ds AND de AND t.speaker <> n_speaker GROUP BY delay_id),
  r2{n} AS (SELECT delay_id, turn_id FROM (SELECT delay_id, turn_id, row_number() OVER (PARTITION BY delay_id ORDER BY t."end" - t."start", abs(mid - (t."start" + t."end") / 2), rn) AS k FROM d{n} d JOIN t{n} t ON d.project_id = t.project_id WHERE mid BETWEEN t."start" AND t."end") WHERE k = 1),
  pv{n} AS (SELECT delay_id, arg_max(turn_id, rn) AS id, arg_max(speaker, rn) AS sp FROM d{n} d JOIN t{n} t ON d.project_id = t.project_id WHERE t."end" <= mid GROUP BY delay_id),
  nx{n} AS (SELECT delay_id, arg_min(turn_id, rn) AS id, arg_min(speaker, rn) AS sp FROM d{n} d JOIN t{n} t ON d.project_id = t.project_id WHERE t."start" >= mid GROUP BY delay_id),
  o{n} AS (SELECT d.project_id, d.delay_id, ds, de, CASE WHEN r1.delay_id IS NOT NULL THEN 'speaker_boundary' WHEN r2.delay_id IS NOT NULL THEN 'inside_turn' ELSE 'between_turns' END AS association,
    r2.turn_id AS t2, r1.p, r1.f, pv.id AS prev, nx.id AS next, pv.id IS NULL OR (nx.id IS NOT NULL AND pv.sp <> nx.sp) AS gap
    FROM d{n} d LEFT JOIN r1{n} r1 USING (delay_id) LEFT JOIN r2{n} r2 USING (delay_id) LEFT JOIN pv{n} pv USING (delay_id) LEFT JOIN nx{n} nx USING (delay_id)),
  owned{n} AS (SELECT project_id, delay_id, ds AS "start", de AS "end", CASE association WHEN 'inside_turn' THEN t2 WHEN 'between_turns' THEN CASE WHEN NOT gap THEN prev END END AS owner,
    CASE WHEN association = 'speaker_boundary' OR (association = 'between_turns' AND gap) THEN 'response_gap' ELSE 'silent_pause' END AS event_type, association,
    CASE association WHEN 'speaker_boundary' THEN p WHEN 'between_turns' THEN prev END AS previous_turn_id, CASE association WHEN 'speaker_boundary' THEN f WHEN 'between_turns' THEN next END AS following_turn_id FROM o{n})"""


_OWNERS = W + _owners_sql()


def _owned(spark, sf):
    t = intervals(spark, sf)
    d = t.where(_SPLIT).select("project_id", F.col("event_id").alias("delay_id"), (F.col("start") - 3000).alias("start"), (F.col("start") + 3000).alias("end"))
    return t.where(f"NOT {_SPLIT}").withColumn("label", F.col("speaker")), d


@query(_OWNERS + " SELECT * FROM owned")
def j_event_owner(spark, sf):
    return I.delay_owners(*_owned(spark, sf))


def _delay_events(spark, sf):
    t, d = _owned(spark, sf)
    t = t.withColumn("final_text", F.repeat(F.lit("a "), 5)).withColumn("model_text", F.lit(""))
    return t, TO.delay_events(t, d)


@query(_OWNERS + """, e AS (SELECT w.*, CAST(row_number() OVER (PARTITION BY w.project_id ORDER BY delay_id) AS INTEGER) AS event_id, t."start" AS ts, t."end" AS te FROM owned w LEFT JOIN t ON t.project_id = w.project_id AND t.turn_id = w.owner)
  SELECT project_id, event_id, owner AS turn_id, event_type, "start", "end",
    CAST(CASE WHEN event_type = 'silent_pause' AND owner IS NOT NULL THEN CASE WHEN te > ts THEN least(5, greatest(0, round_even((("start" + "end") / 2 - ts) / (te - ts) * 5, 0))) ELSE 5 END END AS INTEGER) AS token_start FROM e""")
def e1_delay_events(spark, sf):
    return _delay_events(spark, sf)[1].select("project_id", "event_id", "turn_id", "event_type", "start", "end", "token_start")


@query(_OWNERS + _owners_sql("2", f"NOT {_SPLIT} AND event_id % 4 <> 1") + """, x AS (SELECT project_id, delay_id, a.event_type AS k1, b.event_type AS k2, a.owner AS o1, b.owner AS o2,
    CASE a.event_type WHEN 'silent_pause' THEN a.owner ELSE a.following_turn_id END AS g1, CASE b.event_type WHEN 'silent_pause' THEN b.owner ELSE b.following_turn_id END AS g2 FROM owned a JOIN owned2 b USING (project_id, delay_id))
  SELECT project_id, CAST(count(*) FILTER (k2 = 'silent_pause') AS BIGINT) AS pauses, CAST(count(*) FILTER (k2 = 'response_gap') AS BIGINT) AS gaps,
    CAST(count(*) FILTER (k1 <> k2 OR o1 IS DISTINCT FROM o2 OR g1 IS DISTINCT FROM g2) AS BIGINT) AS invalidated FROM x GROUP BY project_id""")
def e2_reassociate(spark, sf):
    """Owners found anew after every fourth turn has gone."""
    t, e = _delay_events(spark, sf)
    r = TO.reassociate(e, t.where("event_id % 4 <> 1"))
    return r.groupBy("project_id").agg(F.count_if(F.col("event_type") == "silent_pause").alias("pauses"), F.count_if(F.col("event_type") == "response_gap").alias("gaps"), F.count_if("invalidated").alias("invalidated"))


@query(W + """, b AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY project_id ORDER BY turn_id) THEN 0 ELSE 1 END AS brk FROM intervals)
  SELECT event_id, CAST(sum(brk) OVER (PARTITION BY project_id ORDER BY turn_id) AS INTEGER) AS turn_id FROM b""")
def e3_remap(spark, sf):
    t = schemas.turns(intervals(spark, sf)).drop("manual_review")
    _, ids = TO.consolidate(t)
    e = intervals(spark, sf).select("project_id", "event_id", "turn_id", F.lit("manual").alias("source"), F.create_map(F.lit("previous_turn_id"), F.col("turn_id").cast("string")).alias("details"))
    return TO.remap_events(e, ids).select("event_id", "turn_id")


@query(W + """, b AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY project_id ORDER BY turn_id) THEN 0 ELSE 1 END AS brk FROM intervals),
  i AS (SELECT *, sum(brk) OVER (PARTITION BY project_id ORDER BY turn_id) AS g FROM b)
  SELECT project_id, CAST(g AS INTEGER) AS turn_id, min("start") AS "start", max("end") AS "end", min(speaker) AS speaker, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY turn_id) AS final_text,
    bool_or(value > 50) AS manual_review FROM i GROUP BY project_id, g""")
def w1_consolidate(spark, sf):
    t = schemas.turns(intervals(spark, sf).withColumn("final_text", F.col("event_id").cast("string")).withColumn("manual_review", F.col("value") > 50))
    return TO.consolidate(t)[0].select("project_id", "turn_id", "start", "end", "speaker", "final_text", "manual_review")


@query("WITH " + FRAMES + """, s AS (SELECT *, dbfs IS NULL OR dbfs <= -18.5 AS silent, row_number() OVER (PARTITION BY audio_id ORDER BY frame) AS rn FROM frames),
  r AS (SELECT *, rn - row_number() OVER (PARTITION BY audio_id ORDER BY frame) AS run FROM s WHERE silent)
  SELECT audio_id, min(frame) * 8 / 400.0 AS start_seconds, (max(frame) + 1) * 8 / 400.0 AS end_seconds, max(dbfs) AS loudest_frame_dbfs FROM r GROUP BY audio_id, run
  HAVING (max(frame) + 1) * 8 / 400.0 - min(frame) * 8 / 400.0 + 0.5 / 400 >= 0.04""")
def w3_silence_runs(spark, sf):
    runs = I.silent_runs(I.frames(signals(spark, sf)), -18.5, 0.04, edges=True)
    return runs.select("audio_id", "start_seconds", "end_seconds", "loudest_frame_dbfs")


@query("WITH " + FRAMES + " SELECT audio_id, CAST(frame AS BIGINT) AS frame, CAST(frame * 8 AS BIGINT) AS start_frame, CAST(frame * 8 + 8 AS BIGINT) AS end_frame FROM frames")
def w4_frames(spark, sf):
    return I.frames(signals(spark, sf)).select("audio_id", "frame", "start_frame", "end_frame")


@query("WITH " + FRAMES + " SELECT audio_id, CAST(frame AS BIGINT) AS frame, round(dbfs, 9) AS dbfs FROM frames")
def g17_dbfs(spark, sf):
    return I.frames(signals(spark, sf)).select("audio_id", "frame", F.round("dbfs", 9).alias("dbfs"))


@query("WITH " + FRAMES + """, n AS (SELECT audio_id, min(dbfs) AS quiet, count(*) AS k FROM frames GROUP BY audio_id),
  v AS (SELECT CAST(vec_id AS VARCHAR) AS audio_id, sqrt(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), lambda a, b: a + b) / 64) AS rms FROM embeddings)
  SELECT audio_id, round(20 * log10(rms), 7) AS volume_dbfs, round(20 * log10(rms) - quiet, 7) AS noise_snr_db FROM v JOIN n USING (audio_id)""")
def g16_signal_levels(spark, sf):
    levels = I.signal_levels(signals(spark, sf), 0.02, 1)
    return levels.select("audio_id", F.round("volume_dbfs", 7).alias("volume_dbfs"), F.round("noise_snr_db", 7).alias("noise_snr_db"))


@query(W + """, n AS (SELECT *, lead("start") OVER w - "end" AS gap, lead(speaker) OVER w AS next FROM intervals WINDOW w AS (PARTITION BY project_id ORDER BY turn_id))
  SELECT event_id, gap FROM n WHERE next <> speaker AND gap >= 0""")
def w5_adjacent_gaps(spark, sf):
    w = Window.partitionBy("project_id").orderBy("turn_id")
    t = intervals(spark, sf).withColumn("gap", F.lead("start").over(w) - F.col("end")).withColumn("next", F.lead("speaker").over(w))
    return t.where("next <> speaker AND gap >= 0").select("event_id", "gap")


@query(W + """ SELECT event_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM intervals""")
def w6_numbering(spark, sf):
    return TO.renumber(intervals(spark, sf), "rank", F.col("value").desc(), "event_id").select("event_id", "rank")


@query(W + """, f AS (SELECT project_id, turn_id, event_id, speaker = 'error' AS flag FROM intervals), m AS (SELECT project_id, turn_id AS t FROM f WHERE flag),
  e AS (SELECT project_id, min(t) AS lo, max(t) AS hi FROM m GROUP BY project_id)
  SELECT f.event_id, coalesce((SELECT min(t) FROM m WHERE m.project_id = f.project_id AND t > f.turn_id), e.lo) AS next_flagged,
    coalesce((SELECT max(t) FROM m WHERE m.project_id = f.project_id AND t < f.turn_id), e.hi) AS previous_flagged,
    CAST((SELECT count(*) FROM m WHERE m.project_id = f.project_id AND t <= f.turn_id) AS BIGINT) AS flagged_so_far FROM f LEFT JOIN e USING (project_id)""")
def w7_review_navigation(spark, sf):
    t = intervals(spark, sf).withColumn("flag", F.col("speaker") == "error")
    return TO.navigate(t, "flag", "turn_id").select("event_id", "next_flagged", "previous_flagged", "flagged_so_far")


def _review(spark, sf):
    t = intervals(spark, sf).withColumn("manual_review", F.col("value") > 50).withColumn("final_text", F.col("event_id").cast("string"))
    return schemas.turns(t.withColumn("start", F.col("turn_id") * 1.5).withColumn("end", F.col("turn_id") * 1.5 + 1))


@query(W + """ SELECT project_id, turn_id, speaker AS label, CAST(event_id AS VARCHAR) AS text FROM intervals WHERE value > 50""")
def v1_review_list(spark, sf):
    return views.review_list(_review(spark, sf)).select("project_id", "turn_id", "label", "text")


@query(W + """, c AS (SELECT DISTINCT project_id, speaker AS choice, 1 AS k, speaker AS o FROM intervals UNION SELECT DISTINCT project_id, 'Student', 0, '0' FROM intervals
  UNION SELECT DISTINCT project_id, 'Teacher', 0, '1' FROM intervals UNION SELECT DISTINCT project_id, 'Unknown', 3, '' FROM intervals)
  SELECT project_id, choice, CAST(row_number() OVER (PARTITION BY project_id ORDER BY k, o, choice) AS INTEGER) AS rank FROM c""")
def v2_speaker_choices(spark, sf):
    t = intervals(spark, sf)
    return views.speaker_choices(t, t.select("project_id").distinct().withColumn("conversation_type", F.lit("Human teacher")))


@query(_OWNERS + """, a AS (SELECT project_id, CAST(count(*) AS BIGINT) AS turns, CAST(count(*) FILTER (value > 50) AS BIGINT) AS review_turns FROM intervals GROUP BY project_id),
  e AS (SELECT project_id, CAST(count(*) FILTER (event_type = 'silent_pause') AS BIGINT) AS pauses, CAST(count(*) FILTER (event_type = 'response_gap') AS BIGINT) AS response_gaps FROM owned GROUP BY project_id)
  SELECT project_id, turns, review_turns, coalesce(pauses, 0) AS pauses, coalesce(response_gaps, 0) AS response_gaps FROM a LEFT JOIN e USING (project_id)""")
def v3_input_counts(spark, sf):
    none = spark.createDataFrame([], schemas.SEGMENTS)
    return views.input_counts(_review(spark, sf), none, _delay_events(spark, sf)[1]).select("project_id", "turns", "review_turns", "pauses", "response_gaps")


@query(_OWNERS + """, g AS (SELECT project_id, following_turn_id AS turn_id, min("start") AS gs, max("end") AS ge FROM owned WHERE event_type = 'response_gap' AND following_turn_id IS NOT NULL GROUP BY ALL)
  SELECT i.project_id, i.turn_id, CASE WHEN gs < i."start" THEN gs ELSE i."start" END AS "start", CASE WHEN ge > i."end" THEN ge ELSE i."end" END AS "end" FROM intervals i LEFT JOIN g ON g.project_id = i.project_id AND g.turn_id = i.turn_id""")
def v4_playback(spark, sf):
    return views.playback(intervals(spark, sf), _delay_events(spark, sf)[1])


@query(_OWNERS + """, e AS (SELECT project_id, CASE event_type WHEN 'silent_pause' THEN owner ELSE following_turn_id END AS turn_id, event_type FROM owned)
  SELECT project_id, turn_id, CAST(count(*) FILTER (event_type = 'silent_pause') AS BIGINT) AS pauses, CAST(6000 * count(*) FILTER (event_type = 'silent_pause') AS DOUBLE) AS pause_seconds,
    CAST(count(*) FILTER (event_type = 'response_gap') AS BIGINT) AS gaps, FALSE AS all_reviewed FROM e WHERE turn_id IS NOT NULL GROUP BY ALL""")
def v5_delay_summary(spark, sf):
    return views.delay_summary(_delay_events(spark, sf)[1])


@query(W + """ SELECT event_id, CASE WHEN event_id % 3 = 0 THEN speaker ELSE upper(speaker) END AS label FROM intervals""")
def f29_display_label(spark, sf):
    t = intervals(spark, sf).withColumn("speaker_raw", F.when(F.col("event_id") % 3 == 0, " unknown ").otherwise(F.upper("speaker")))
    return t.select("event_id", identity.display_label().alias("label"))


@query(W + """ SELECT event_id, CASE WHEN speaker = 'error' THEN NULL ELSE 'role ' || speaker END AS identity FROM intervals""")
def j_speaker_lookup(spark, sf):
    t = intervals(spark, sf).withColumn("speaker_raw", F.concat(F.lit("  "), F.upper("speaker")))
    every = t.select("project_id").distinct().crossJoin(F.broadcast(t.where("speaker <> 'error'").select("speaker").distinct()))  # five types
    m = every.select("project_id", F.col("speaker").alias("label"), F.concat(F.lit("role "), F.col("speaker")).alias("identity"))
    return identity.mapped(t, m).select("event_id", "identity")

