"""Queries of text rules, parsing and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits, grammar, names, spoken
from ..functions import text as T
from ..operators.spread import spread
from ..sinks import files
from .base import TURNS, query, table, turns, words_sql


@query(f"""SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5
  FROM (SELECT conv_id, turn, {words_sql("text")} AS w FROM conversations)""")
def f1_words(spark, sf):
    c = table(spark, sf, "conversations").withColumn("w", T.words("text"))
    return c.select("conv_id", "turn", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"))


@query()
def f2_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalized(F.col("text")).cast("binary")).alias("text_md5"))


@query()
def f3_word_spans(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(spoken.word_spans(F.col("text"))).alias("s"))
    return c.select("conv_id", "turn", "s.value", "s.char_start", "s.char_end")


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (regexp_matches(text, '[\\x{0590}-\\x{05FF}]')) AS BIGINT) AS hebrew
  FROM documents GROUP BY lang""")
def f5_hebrew(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.contains_hebrew("text")).alias("hebrew"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(inaudible|unclear|unintelligible|unknown)($|[^\\p{L}\\p{N}_])|\\[[^\\n]*?(inaudible|unclear)[^\\n]*?\\]|\\?\\?') AS unclear FROM documents""")
def f6_unclear(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.contains_unclear("text").alias("unclear"))


@query("""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_'']+'), lambda x:
  regexp_full_match(x, '(?i)(uh+|um+|erm+|er+|ah+|eh+|hmm+|mm+|mhm+)'))) AS BIGINT) AS fillers FROM documents""")
def f7_fillers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.fillers("text")).cast("long").alias("fillers"))


@query("""SELECT doc_id, regexp_matches(text, '[\\p{L}\\p{N}_''][-‐‑‒–—](\\s|$|[.,!?;:)\\]}])') AS cut_off FROM documents""")
def f8_partial_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.size(T.partial_words("text")) > 0).alias("cut_off"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(i mean|sorry|rather|actually|let me (start|say|try) again|what i meant)($|[^\\p{L}\\p{N}_])|(^|[^\\p{L}\\p{N}_])no[, ][\\p{L}\\p{N}_]') AS corrects FROM documents""")
def f9_self_correction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.matches_self_correction("text").alias("corrects"))


@query()
def f10_repetitions(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.has_repetition("text").alias("repeats"))


@query()
def f11_hesitation(spark, sf):
    c = table(spark, sf, "conversations").withColumn("f", spoken.text_flags(F.col("text")))
    return c.select("conv_id", "turn", "f.hesitation_or_repetition", "f.self_correction")


@query()
def f12_events(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(spoken.located_events(F.col("text"))).alias("e"))
    return c.select("conv_id", "turn", "e.*")


@query()
def f13_event_counts(spark, sf):
    return spoken.event_counts(table(spark, sf, "conversations"), "text", "role")


@query(f"""SELECT conv_id, turn, CASE WHEN len(w) < 2 THEN CAST(0 AS DOUBLE)
    ELSE CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS DOUBLE) / (len(w) - 1) END AS rate
  FROM (SELECT conv_id, turn, {words_sql("text")} AS w FROM conversations)""")
def f15_repetition_rate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.repetition_rate("text").alias("rate"))


_PAIRS = f"""WITH p AS (SELECT conv_id, turn, a, b FROM (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b
    FROM (SELECT conv_id, turn, {words_sql("text")} AS a FROM conversations)) WHERE b IS NOT NULL),
  x AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS word FROM p) GROUP BY ALL),
  y AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS word FROM p) GROUP BY ALL),
  c AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS c FROM x JOIN y USING (conv_id, turn, word) GROUP BY ALL),
  s AS (SELECT p.conv_id, p.turn, len(a) AS la, len(b) AS lb, CAST(coalesce(c, 0) AS BIGINT) AS c FROM p LEFT JOIN c USING (conv_id, turn))"""


def _next_turn(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").withColumn("a", T.words("text"))
    return c.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")


@query(_PAIRS + " SELECT conv_id, turn, CASE WHEN la = 0 OR lb = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(c AS DOUBLE) / (la + lb - c) END AS overlap FROM s")
def f16_token_overlap(spark, sf):
    return _next_turn(spark, sf).select("conv_id", "turn", T.token_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query(_PAIRS + " SELECT conv_id, turn, least(CAST(1 AS DOUBLE), CAST(la + lb - 2 * c AS DOUBLE) / greatest(1, la, lb)) AS difference FROM s")
def f17_word_difference(spark, sf):
    return _next_turn(spark, sf).select("conv_id", "turn", T.word_difference_rate(F.col("a"), F.col("b")).alias("difference"))


@query()
def f18_similarity(spark, sf):
    t = spread(turns(spark, sf), "project_id", "turn_id")
    return t.select("project_id", "turn_id", edits.text_similarity(F.col("gold"), F.col("cut")).alias("similarity"))


@query("WITH " + TURNS + """ SELECT project_id, turn_id, CASE WHEN "end" - "start" > 0 THEN n / ("end" - "start") * 60.0 END AS wpm FROM turns""")
def f20_speech_rate(spark, sf):
    return turns(spark, sf).select("project_id", "turn_id", T.speech_rate("text", "start", "end").alias("wpm"))


@query("""SELECT event_id, greatest(0.0, least(1.0, 1.0 - abs(value - 125.0) / 180.0)) AS rate, greatest(0.0, least(1.0, (value - 3.0) / 27.0)) AS snr,
  greatest(0.0, least(1.0, 1.0 - abs(24.0 - value) / 30.0)) AS volume FROM events""")
def f21_normality(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", T.clamp(1.0 - F.abs(v - 125.0) / 180.0).alias("rate"), T.clamp((v - 3.0) / 27.0).alias("snr"), T.clamp(1.0 - F.abs(24.0 - v) / 30.0).alias("volume")
    )


@query("""SELECT role, CASE WHEN role IN ('assistant') THEN 'ai' ELSE role END AS label, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY role""")
def f22_evaluation_label(spark, sf):
    return table(spark, sf, "conversations").select("role", T.evaluation_label(T.normalized_ascii("role")).alias("label")).groupBy("role", "label").agg(F.count("*").alias("n")).select("role", "label", "n")


@query()
def f26_human_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", names.human_names(F.col("c_name")).alias("name"))


@query(f"""WITH t AS (SELECT conv_id, turn, {words_sql("text")} AS w, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS a FROM conversations),
  v AS (SELECT conv_id, turn, list_filter([a, array_to_string(w, ' '), array_to_string(w, ' ')], lambda x: x <> '') AS v FROM t)
  SELECT conv_id, turn, CAST(len(list_distinct(v)) AS BIGINT) AS versions FROM v""")
def f28_versions(spark, sf):
    c = table(spark, sf, "conversations").withColumn("b", F.array_join(T.words("text"), " ")).withColumn("c", F.col("b"))
    return c.select("conv_id", "turn", F.size(T.distinct_versions("text", "b", "c")).cast("long").alias("versions"))


@query("""SELECT event_id, format('[pause {:.2f}s]', CAST(round(value * 4) / 4 AS DOUBLE)) AS pause, format('[response gap {:.2f}s]', CAST(round(value * 4) / 4 AS DOUBLE)) AS gap FROM events""")
def f30_markers(spark, sf):
    v = F.round(F.col("value") * 4) / 4
    return table(spark, sf, "events").select("event_id", T.pause_marker(v).alias("pause"), T.gap_marker(v).alias("gap"))


@query("""SELECT event_id, CAST(least(12, greatest(0, round_even(value / 100 * 12, 0))) AS INTEGER) AS token FROM events""")
def f31_token_index(spark, sf):
    return table(spark, sf, "events").select("event_id", T.token_index(F.col("value") / 100, F.lit(12)).alias("token"))


@query()
def f32_rendered(spark, sf):
    t = turns(spark, sf)
    p = F.array(F.struct(F.lit(1).alias("token"), F.lit(0.5).alias("seconds")), F.struct(F.lit(None).cast("int").alias("token"), F.lit(0.8).alias("seconds")))
    return t.select("project_id", "turn_id", spoken.with_pauses(F.col("text"), p).alias("shown"))


@query()
def f34_difference_spans(spark, sf):
    return turns(spark, sf).select("project_id", "turn_id", F.explode(edits.difference_spans(F.col("gold"), F.col("alien"))).alias("s")).select("project_id", "turn_id", "s.*")


@query("""SELECT CAST(CASE WHEN value / 100 <= 0.10 THEN 0 WHEN value / 100 <= 0.30 THEN 1 ELSE 2 END AS INTEGER) AS class, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def f36_quality_class(spark, sf):
    return table(spark, sf, "events").groupBy(T.quality_class(F.col("value") / 100).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, format('{:.1f} KiB', n_chars / 1024.0) AS size FROM documents""")
def f39_size_label(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.size_label(F.col("n_chars")).alias("size"))


_LINE = """'Stage ' || (event_id % 9) || '/' || CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE 8 END || ' - ' || CASE event_id % 4 WHEN 0 THEN 'all finished' WHEN 1 THEN 'turn ' || (event_id % 11) || ' of 10' ELSE 'working - on it' END"""


@query(f"""WITH e AS (SELECT event_id, event_id % 9 AS stage, CASE WHEN event_id % 3 < 2 THEN 7 ELSE 8 END AS total, {_LINE} AS line,
    CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN least(1.0, (event_id % 11) / 10) ELSE 0.0 END AS share FROM events)
  SELECT event_id, CASE WHEN stage > 0 THEN round(least(CAST(100 AS DOUBLE), (stage - 1 + CAST(share AS DOUBLE)) / total * 100), 9) END AS percent,
    CASE WHEN stage > 0 THEN 'Stage ' || stage || ' of ' || total || ': ' || substr(line, 13) END AS label,
    event_id % 4 <> 1 OR event_id % 11 <= 1 OR event_id % 11 >= 10 OR value >= 0.1 AS shown FROM e JOIN (SELECT event_id, value FROM events) USING (event_id)""")
def f42_progress(spark, sf):
    e = F.col("event_id")
    what = F.when(e % 4 == 0, "all finished").when(e % 4 == 1, F.format_string("turn %d of 10", e % 11)).otherwise("working - on it")
    line = F.concat(F.format_string("Stage %d/%d - ", e % 9, F.when(e % 3 == 0, 5).when(e % 3 == 1, 7).otherwise(8)), what)
    p = T.progress(line)
    return table(spark, sf, "events").select("event_id", F.round(p["percent"], 9).alias("percent"), p["label"].alias("label"), T.shows_progress(line, F.col("value")).alias("shown"))


@query("""SELECT event_id, CASE WHEN (value - 10) - greatest(0.0, value - 50) > 0.01 THEN greatest(0.0, value - 50) END AS "start",
  CASE WHEN (value - 10) - greatest(0.0, value - 50) > 0.01 THEN value - 10 END AS "end" FROM events""")
def f40_playback_interval(spark, sf):
    i = T.playback_interval(F.col("value") - 50, F.col("value") - 10)
    return table(spark, sf, "events").withColumn("i", i).select("event_id", F.col("i.start").alias("start"), F.col("i.end").alias("end"))


@query("""SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS seconds FROM events""")
def s3_timestamp(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.timestamp(F.date_format("ts", "HH:mm:ss")).alias("seconds"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(event_id % 60 + 60 AS DOUBLE) WHEN 2 THEN CAST(event_id AS DOUBLE) ELSE CAST(event_id AS DOUBLE) * 86400 END AS seconds FROM events""")
def s4_time_value(spark, sf):
    k = F.col("event_id") % 4
    cell = F.when(k == 0, " ").when(k == 1, F.format_string("01:%02d", F.col("event_id") % 60)).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", T.time_value(cell, k == 3).alias("seconds"))


@query("""SELECT page_id, md5(trim(regexp_replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def s5_clean_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.clean_markup(F.col("html")).cast("binary")).alias("text_md5"))


@query("""SELECT conv_id, turn, role AS speaker, md5(trim(regexp_replace(replace(regexp_replace(text, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))) AS text_md5 FROM conversations WHERE trim(text) <> ''""")
def s6_voice(spark, sf):
    c = table(spark, sf, "conversations").where("trim(text) <> ''")
    v = T.voice(F.concat(F.lit("<v.x "), F.col("role"), F.lit(">"), F.col("text"), F.lit("</v>")))
    return c.withColumn("v", v).select("conv_id", "turn", "v.speaker", F.md5(F.col("v.text").cast("binary")).alias("text_md5"))


@query("""SELECT conv_id, turn, role AS speaker, md5(trim(replace(text, chr(10), ' '))) AS text_md5 FROM conversations WHERE trim(replace(text, chr(10), ' ')) <> ''""")
def s7_speaker_prefix(spark, sf):
    c = table(spark, sf, "conversations").withColumn("line", F.replace("text", F.lit("\n"), F.lit(" "))).where("trim(line) <> ''")
    p = T.speaker_prefix(F.concat(F.lit("[00:01] "), F.col("role"), F.lit(": "), F.col("line")))
    return c.withColumn("p", p).select("conv_id", "turn", "p.speaker", F.md5(F.col("p.text").cast("binary")).alias("text_md5"))


@query("""SELECT doc_id, md5(CASE WHEN length(t) > 32767 THEN substr(t, 1, 32767 - 24) || ' … [truncated for Excel]' ELSE t END) AS cell_md5
  FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS t FROM documents)""")
def k3_cell_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(files.cell_text("text").cast("binary")).alias("cell_md5"))


@query()
def d1_grammar_evidence(spark, sf):
    t = turns(spark, sf).select("project_id", "turn_id", F.explode(grammar.grammar_evidence(F.col("gold"), F.col("cut"))).alias("e"))
    return t.select("project_id", "turn_id", "e.*").drop("rationale")


@query("""WITH e AS (SELECT event_id, value, CAST(floor(value * 60) AS BIGINT) AS s FROM events)
  SELECT event_id, CASE WHEN value >= 90 THEN '--:--' ELSE CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END
    || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '.00' END AS label FROM e""")
def v6_time_label(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.time_label(F.when(F.col("value") < 90, F.floor(F.col("value") * 60).cast("double"))).alias("label"))
