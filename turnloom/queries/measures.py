"""Queries of metrics, votes, scores, models, alignment and identities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import edits
from ..operators import alignment, evaluation, evidence, identity, learning, quality
from ..operators.spread import spread
from .base import TURNS, query, table, turns, words_sql

#: Hypotheses by construction: every 7th word is missing, or every 5th is alien; then counts are certain.
_COUNTED = "WITH " + TURNS + """, c AS (SELECT project_id, turn_id, n, n // 7 AS d, n // 5 AS s FROM turns WHERE n > 0)"""


@query(_COUNTED + """ SELECT project_id, CAST(sum(n) AS BIGINT) AS ref_words, CAST(sum(d) AS BIGINT) AS deletions, CAST(sum(d) AS DOUBLE) / sum(n) AS wer FROM c GROUP BY project_id""")
def flagship_wer(spark, sf):
    """Word errors of a hypothesis that lacks every 7th word, per conversation."""
    t = spread(turns(spark, sf).where("n > 0"), "project_id", "turn_id").withColumn("e", edits.word_edits(F.col("gold"), F.col("cut")))
    s = F.sum("e.reference")
    return t.groupBy("project_id").agg(s.alias("ref_words"), F.sum("e.deletions").alias("deletions"), (F.sum(evaluation.errors("e")) / s).alias("wer"))


@query(_COUNTED + """ SELECT project_id, turn_id, CAST(s AS BIGINT) AS substitutions, CAST(0 AS BIGINT) AS deletions, CAST(0 AS BIGINT) AS insertions, CAST(n - s AS BIGINT) AS correct FROM c""")
def g1_edit_counts(spark, sf):
    t = spread(turns(spark, sf).where("n > 0"), "project_id", "turn_id").withColumn("e", edits.word_edits(F.col("gold"), F.col("alien")))
    return t.select("project_id", "turn_id", "e.substitutions", "e.deletions", "e.insertions", "e.correct")


@query()
def g2_char_edits(spark, sf):
    return spread(turns(spark, sf), "project_id", "turn_id").withColumn("e", edits.char_edits(F.col("gold"), F.col("cut"))).select("project_id", "turn_id", "e.*")


def _evaluated(spark, sf):
    t = turns(spark, sf).withColumn("k", F.col("turn_id") % 3)
    return schemas.turns(t.select(
        "project_id", "turn_id", "start", "end", "speaker_raw", F.col("speaker_raw").alias("speaker"), F.col("gold").alias("gold_text"),
        F.when(F.col("k") == 0, F.col("speaker_raw")).otherwise("user").alias("gold_speaker"), F.col("cut").alias("final_text"), F.col("alien").alias("zoom_text"),
        F.col("gold").alias("chatgpt_text"), F.when(F.col("k") == 1, F.col("cut")).otherwise("").alias("model_text"), (F.col("k") == 2).alias("manual_review"),
    ))


_LABEL = "CASE {0} WHEN 'assistant' THEN 'ai' ELSE {0} END"


@query(_COUNTED + f""", t AS (SELECT project_id, CAST(count(*) FILTER (n > 0) AS BIGINT) AS evaluated_turns, CAST(sum(n // 7) AS BIGINT) AS deletions, CAST(sum(n // 7) AS DOUBLE) / sum(n) AS wer,
    CAST(count(*) FILTER (n > 0) AS BIGINT) AS speaker_labels_evaluated,
    CAST(count(*) FILTER (n > 0 AND (turn_id % 3 = 0 OR speaker_raw = 'user')) AS BIGINT) AS speaker_labels_correct,
    CAST(count(*) FILTER (turn_id % 3 = 2) AS DOUBLE) / count(*) AS manual_review_rate FROM turns GROUP BY project_id)
  SELECT project_id, evaluated_turns, deletions, wer, speaker_labels_evaluated, speaker_labels_correct, CAST(speaker_labels_correct AS DOUBLE) / speaker_labels_evaluated AS speaker_accuracy, manual_review_rate FROM t WHERE evaluated_turns > 0""")
def g6_evaluate(spark, sf):
    e = evaluation.evaluate(_evaluated(spark, sf))
    return e.select("project_id", "evaluated_turns", "deletions", "wer", "speaker_labels_evaluated", "speaker_labels_correct", "speaker_accuracy", "manual_review_rate")


@query()
def g6_all_metrics(spark, sf):
    return evaluation.evaluate(_evaluated(spark, sf))


@query(_COUNTED + """ SELECT project_id, 'Zoom' AS source, CAST(count(*) AS BIGINT) AS turns, CAST(sum(s) AS DOUBLE) / sum(n) AS wer FROM c GROUP BY project_id
  UNION ALL SELECT project_id, 'ChatGPT', CAST(count(*) AS BIGINT), 0.0 FROM c GROUP BY project_id
  UNION ALL SELECT project_id, 'Final', CAST(count(*) AS BIGINT), CAST(sum(d) AS DOUBLE) / sum(n) FROM c GROUP BY project_id
  UNION ALL SELECT project_id, 'Model', CAST(count(*) AS BIGINT), CAST(sum(d) AS DOUBLE) / sum(n) FROM c WHERE turn_id % 3 = 1 GROUP BY project_id""")
def g7_by_source(spark, sf):
    return evaluation.by_source(_evaluated(spark, sf)).select("project_id", "source", "turns", "wer")


@query(_COUNTED + """ SELECT project_id, turn_id, CAST(len(range(6, n + 1, 6)) AS BIGINT) AS evaluated, CAST(n // 6 - len(list_filter(range(6, n + 1, 6), lambda i: i % 5 = 0)) AS BIGINT) AS preserved,
    CAST(len(list_filter(range(6, n + 1, 6), lambda i: i % 5 = 0)) AS BIGINT) AS substituted, CAST(0 AS BIGINT) AS deleted FROM c""")
def g8_grammar_words(spark, sf):
    """Every sixth word is marked, every fifth is replaced."""
    plain = F.transform("w", lambda x, i: F.concat(F.lit("w"), (i + 1).cast("string")))
    marked = F.array_join(F.transform(plain, lambda x, i: F.when((i + 1) % 6 == 0, F.concat(x, F.lit("@!"))).otherwise(x)), " ")
    hyp = F.array_join(F.transform(plain, lambda x, i: F.when((i + 1) % 5 == 0, "zzq").otherwise(x)), " ")
    t = spread(turns(spark, sf).where("n > 0"), "project_id", "turn_id").withColumn("g", edits.grammar_words(marked, hyp))
    return t.select("project_id", "turn_id", "g.*")


@query("""SELECT event_type, CAST(sum(p + s + d) AS BIGINT) AS evaluated, CAST(sum(p) AS BIGINT) AS preserved, CAST(sum(s) AS BIGINT) AS substituted, CAST(sum(d) AS BIGINT) AS deleted,
  CAST(sum(p) AS DOUBLE) / sum(p + s + d) AS preserved_rate, CAST(sum(s) AS DOUBLE) / sum(p + s + d) AS substituted_rate, CAST(sum(d) AS DOUBLE) / sum(p + s + d) AS deleted_rate
  FROM (SELECT event_type, event_id % 5 AS p, event_id % 3 AS s, event_id % 2 AS d FROM events) GROUP BY event_type""")
def g9_grammar_rates(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select("event_type", (e % 5).alias("preserved"), (e % 3).alias("substituted"), (e % 2).alias("deleted"), (e % 5 + e % 3 + e % 2).alias("evaluated"))
    return evaluation.sum_grammar(rows, "event_type")


@query("""WITH v AS (SELECT user_id, event_type, sum(event_id % 4 + 1) AS score FROM events GROUP BY ALL), m AS (SELECT user_id, max(score) AS best FROM v GROUP BY user_id)
  SELECT user_id, min(event_type) AS event_type, CAST(min(best) AS BIGINT) AS score FROM v JOIN m USING (user_id) WHERE score = best GROUP BY user_id HAVING count(*) = 1""")
def g10_vote(spark, sf):
    e = table(spark, sf, "events").withColumn("weight", F.col("event_id") % 4 + 1)
    return evaluation.vote(e, ["user_id"], "event_type", "weight")


@query("WITH " + TURNS + """, x AS (SELECT project_id, turn_id, trim(speaker_raw) AS label, lead(trim(speaker_raw), 1) OVER w AS n1, lead(trim(speaker_raw), 2) OVER w AS n2 FROM turns
    WINDOW w AS (PARTITION BY project_id ORDER BY turn_id)),
  v AS (SELECT project_id, label, 'Maya' AS name, 7 AS weight FROM x WHERE turn_id % 5 = 1
    UNION ALL SELECT project_id, CASE WHEN n1 <> label THEN n1 WHEN n2 <> label THEN n2 END, 'Dana', 3 FROM x WHERE turn_id % 5 = 2)
  SELECT project_id, label, name, CAST(sum(weight) AS BIGINT) AS weight FROM v WHERE label IS NOT NULL GROUP BY ALL""")
def g11_name_votes(spark, sf):
    """Every fifth turn introduces its speaker, every fifth thanks another."""
    k = F.col("turn_id") % 5
    said = F.when(k == 1, "and my name is Maya.").when(k == 2, "ok then, thanks Dana.").otherwise("so it goes on")
    t = turns(spark, sf).select("project_id", "turn_id", "speaker_raw", said.alias("final_text"), *(F.lit("").alias(c) for c in ("zoom_text", "chatgpt_text", "model_text")))
    return identity.name_votes(t).groupBy("project_id", "label", "name").agg(F.sum("weight").alias("weight"))


@query("WITH " + TURNS + """ SELECT project_id, speaker_raw AS label, min(turn_id) AS first_turn, CAST(count(*) AS BIGINT) AS turns, CAST(sum(n) AS BIGINT) AS words FROM turns GROUP BY ALL""")
def g12_profiles(spark, sf):
    t = turns(spark, sf).select("project_id", "turn_id", "speaker_raw", F.col("gold").alias("final_text"), *(F.lit("").alias(c) for c in ("zoom_text", "chatgpt_text", "model_text")))
    return identity.profiles(t).select("project_id", "label", "first_turn", "turns", "words")


_CLASS = "CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END"


def _labelled(spark, sf):
    return table(spark, sf, "labels").withColumn("label", F.expr(_CLASS))


@query(f"""WITH c AS (SELECT {_CLASS} AS label, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
  SELECT CAST(label AS INTEGER) AS label, CAST(n AS BIGINT) AS n, greatest(0.35, least(4.0, CAST(total AS DOUBLE) / (k * n))) AS weight FROM c, t""")
def g13_class_weights(spark, sf):
    return learning.class_weights(_labelled(spark, sf))


@query("""WITH x AS (SELECT unnest(range(64)) AS i, embedding FROM embeddings) SELECT CAST(i AS INTEGER) AS feature, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 9) AS mean, round(greatest(1e-6, stddev_pop(CAST(embedding[i + 1] AS DOUBLE))), 9) AS scale FROM x GROUP BY i""")
def g14_standardize(spark, sf):
    s = learning.scales(table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("features")))
    return s.select("feature", F.round("mean", 9).alias("mean"), F.round("scale", 9).alias("scale"))


@query(f"""WITH p AS (SELECT {_CLASS} AS label, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE {_CLASS} END AS prediction FROM labels), k AS (SELECT DISTINCT label AS c FROM p),
  s AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS a, (SELECT count(*) FROM p WHERE prediction = c) AS g, (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS tp FROM k),
  m AS (SELECT avg(2.0 * tp / (a + g)) AS f1, avg(CAST(tp AS DOUBLE) / a) AS ba, CAST(sum(tp) AS DOUBLE) / sum(a) AS acc FROM s)
  SELECT round(acc, 9) AS accuracy, round(f1, 9) AS macro_f1, round(ba, 9) AS balanced_accuracy, round(0.70 * f1 + 0.20 * ba + 0.10 * acc, 9) AS selection FROM m""")
def g15_scores(spark, sf):
    p = _labelled(spark, sf).withColumn("prediction", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("label")))
    return learning.confusion_scores(p).select(*(F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy", "selection")))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_id % 4 <> 0 THEN value / 100 END AS c, CAST(event_id % 5 AS BIGINT) AS n FROM events),
  f AS (SELECT user_id, k, c, n FROM e WHERE k = 1
    UNION ALL SELECT f.user_id, e.k, CASE WHEN f.c IS NULL THEN e.c WHEN e.c IS NULL THEN f.c ELSE (f.c * greatest(1, f.n) + e.c * greatest(1, e.n)) / (greatest(1, f.n) + greatest(1, e.n)) END, f.n + e.n
    FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
  SELECT user_id, round(arg_max(coalesce(c, -1), k), 9) AS confidence FROM f GROUP BY user_id""")
def g18_confidence(spark, sf):
    from ..operators.turns import folded_confidence

    e = table(spark, sf, "events").withColumn("c", F.when(F.col("event_id") % 4 != 0, F.col("value") / 100))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "c"))), lambda x: F.struct(x.c.alias("c"), (x.event_id % 5).cast("int").alias("n")))
    return e.groupBy("user_id").agg(F.round(F.coalesce(folded_confidence(parts), F.lit(-1.0)), 9).alias("confidence"))


@query("""SELECT CAST(user_id AS VARCHAR) AS project_id, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS pauses, CAST(coalesce(sum(2.0) FILTER (event_type = 'view'), 0) AS DOUBLE) AS pause_seconds,
  CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS response_gaps, CAST(count(*) AS BIGINT) AS turns, CAST(count(*) FILTER (value > 50) AS BIGINT) AS review_turns FROM events GROUP BY user_id""")
def g19_report_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("project_id", F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "view", "silent_pause").when(F.col("event_type") == "click", "response_gap").otherwise("other")
    out = evaluation.report_counts(e.withColumn("manual_review", F.col("value") > 50), e.select("project_id", kind.alias("event_type"), F.lit(1.0).alias("start"), F.lit(3.0).alias("end"), F.lit(False).alias("reviewed")))
    return out.select("project_id", "pauses", "pause_seconds", "response_gaps", "turns", "review_turns")


@query(f"SELECT CAST({_CLASS} AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS records FROM labels WHERE doc_id % 10 <> 0 GROUP BY 1")
def g20_training_summary(spark, sf):
    return learning.summary(_records(spark, sf))


def _records(spark, sf):
    """Labels as training records: features from the document's id, some of them not finite."""
    from pyspark.sql import Column

    k = F.col("doc_id")

    def x(i: int) -> Column:
        noise = F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(1000)) / 1000.0
        value = 0.25 * noise + 0.3 * F.col("label") if i % 2 else noise
        return F.when((k % 10 == 0) & (F.lit(i) == 3), float("nan")).otherwise(value)

    return _labelled(spark, sf).select(
        F.lit(learning.SCHEMA_VERSION).alias("schema_version"), F.lit(learning.LABEL_TARGET).alias("label_target"), F.array(*(F.lit(n) for n in quality.FEATURES)).alias("feature_names"),
        F.array(*(x(i) for i in range(len(quality.FEATURES)))).alias("features"), "label", (F.col("label") / 2).alias("target_wer"), F.sha2(k.cast("string"), 256).alias("example_id"),
    )


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id FROM labels WHERE doc_id % 10 <> 0 AND doc_id % 3 <> 0")
def l_append_records(spark, sf):
    r = _records(spark, sf).join(table(spark, sf, "labels").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("example_id")), "example_id")
    return learning.append(r.where("doc_id % 3 = 0"), r.drop("schema_version").withColumn("schema_version", F.lit(learning.SCHEMA_VERSION)).select(*r.columns)).select("doc_id")


@query(f"""WITH c AS (SELECT {_CLASS} AS label, row_number() OVER (PARTITION BY {_CLASS} ORDER BY doc_id) AS rn FROM labels WHERE doc_id % 10 <> 0), t AS (SELECT label FROM c ORDER BY rn, label LIMIT 120)
  SELECT CAST(label AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY label""")
def l2_capped(spark, sf):
    return learning.capped(learning.valid_rows(_records(spark, sf)), 120).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT {_CLASS} AS label, count(*) AS n FROM labels WHERE doc_id % 10 <> 0 GROUP BY 1) SELECT CAST(label AS INTEGER) AS label, CAST(least(n - 1, greatest(1, round_even(n * 0.25, 0))) AS BIGINT) AS held FROM c""")
def l4_splits(spark, sf):
    return learning.splits(learning.valid_rows(_records(spark, sf)), 0).groupBy("label").agg(F.count_if("held").alias("held"))


@query()
def l9_compare(spark, sf):
    return learning.compare(_records(spark, sf), trees=5, iterations=5)[0]


_FEATURES = [f"CAST(event_id % {k + 2} AS DOUBLE) / {k + 1}" for k in range(15)]


@query("WITH f AS (SELECT event_id, " + ", ".join(f"least(1.0, {x}) AS {n}" for x, n in zip(_FEATURES, quality.FEATURES, strict=True)) + """ FROM events)
  SELECT event_id, round(greatest(0.0, least(1.0, 0.29 * agreement + 0.16 * model_confidence + 0.10 * source_presence_ratio + 0.10 * greatest(zoom_model_similarity, chatgpt_model_similarity)
    + 0.07 * (1.0 - word_disagreement_rate) + 0.08 * speech_rate_normality + 0.07 * snr_normality + 0.05 * volume_normality - 0.12 * overlap_penalty - 0.18 * unclear_penalty
    - 0.04 * least(1.0, repetition_rate * 5.0))), 9) AS score FROM f""")
def q2_rule_score(spark, sf):
    part = lambda k: (F.col("event_id") % (k + 2)) / F.lit(float(k + 1))
    f = F.struct(*(F.least(F.lit(1.0), part(k)).alias(n) for k, n in enumerate(quality.FEATURES)))
    return table(spark, sf, "events").withColumn("f", f).select("event_id", F.round(quality.rule_score(F.col("f")), 9).alias("score"))


@query("""WITH p AS (SELECT event_id, CAST(event_id % 3 AS DOUBLE) AS a, CAST(event_id % 5 AS DOUBLE) AS b, CAST(event_id % 2 AS DOUBLE) - CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS c FROM events)
  SELECT event_id, CASE WHEN c >= 0 AND a + b + c > 0 THEN round(a / (a + b + c), 9) END AS p0, CASE WHEN c >= 0 AND a + b + c > 0 THEN round(c / (a + b + c), 9) END AS p2 FROM p""")
def q5_probabilities(spark, sf):
    e = F.col("event_id")
    raw = F.array((e % 3).cast("double"), (e % 5).cast("double"), (e % 2).cast("double") - F.when(e % 11 == 0, 2.0).otherwise(0.0))
    return table(spark, sf, "events").withColumn("p", quality.probabilities(raw)).select("event_id", F.round(F.col("p")[0], 9).alias("p0"), F.round(F.col("p")[2], 9).alias("p2"))


@query()
def q1_features(spark, sf):
    return quality.features(quality.detect(_evaluated(spark, sf))).select("project_id", "turn_id", "features.*")


@query()
def q6_score(spark, sf):
    return quality.score(quality.freeze_target(_evaluated(spark, sf))).select("project_id", "turn_id", "quality_score", "quality_label", "manual_review", "agreement_score")


@query()
def a14_initial_text(spark, sf):
    return spread(turns(spark, sf), "project_id", "turn_id").select("project_id", "turn_id", edits.best_text(F.col("gold"), F.col("cut"), F.col("alien")).alias("text"))


def _segments(spark, sf):
    """Turns' words in groups of six as another source's segments, without times."""
    t = turns(spark, sf).withColumn("piece", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.greatest("n", F.lit(1)) - 1) / 6).cast("int")), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("w", i * 6 + 1, 6), " ").alias("t")))))
    w = Window.partitionBy("project_id").orderBy("turn_id", "piece.i")
    none = F.lit(None).cast("double")
    return t.select("project_id", F.lit("zoom").alias("source"), F.row_number().over(w).alias("seg_idx"), none.alias("start"), none.alias("end"), F.col("speaker_raw").alias("speaker"), F.col("piece.t").alias("text"), none.alias("confidence"))


def _anchored(spark, sf):
    return schemas.turns(turns(spark, sf).select("project_id", "turn_id", "start", "end", "speaker_raw", F.col("gold").alias("model_text")))


@query()
def a8_align(spark, sf):
    return alignment.align_source(_anchored(spark, sf), _segments(spark, sf))


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS project_id, md5(string_agg(array_to_string(w, ' '), ' ' ORDER BY turn)) AS words_md5
  FROM (SELECT conv_id, turn, {words_sql("text")} AS w FROM conversations) WHERE len(w) > 0 GROUP BY conv_id""")
def a8_words_kept(spark, sf):
    """Every word of a source goes to exactly one turn, in order."""
    a = alignment.align_source(_anchored(spark, sf), _segments(spark, sf)).where("trim(text) <> ''")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "text"))), lambda x: x.text), " ")
    return a.groupBy("project_id").agg(F.md5(said.cast("binary")).alias("words_md5"))


@query()
def a11_align_all(spark, sf):
    s = _segments(spark, sf)
    return alignment.align_all(_anchored(spark, sf), s.unionByName(s.withColumn("source", F.lit("gold"))))


@query()
def i_resolve_speakers(spark, sf):
    t = _anchored(spark, sf)
    p = t.select("project_id").distinct().select("project_id", F.lit("AI").alias("conversation_type"), F.lit("").alias("learner_id"), F.create_map().cast("map<string,string>").alias("speaker_mapping"))
    return identity.resolve(t, _segments(spark, sf), p).drop("mapping")


@query()
def d7_evidence(spark, sf):
    t = _evaluated(spark, sf).withColumn("model_text", F.regexp_replace("final_text", " (is|was|the) ", " are "))
    return evidence.wanted(t).select("project_id", "turn_id", "fingerprint", "evidence.pattern", F.size("variants").alias("sources"))


@query()
def d8_sync(spark, sf):
    found = evidence.wanted(_evaluated(spark, sf))
    first = evidence.sync(spark.createDataFrame([], "project_id string, event_id int, turn_id int, fingerprint string, reviewed boolean, decision string"), found)
    # Every second id is known, every fourth is decided.
    known = first.where("event_id % 2 = 0").select("project_id", "event_id", "turn_id", "fingerprint", (F.col("event_id") % 4 == 0).alias("reviewed"), F.when(F.col("event_id") % 4 == 0, "confirmed").alias("decision"))
    return evidence.sync(known, found).select("project_id", "event_id", "turn_id", "fingerprint", "reviewed", "decision", "state")


@query(f"SELECT CAST(conv_id AS VARCHAR) AS project_id, CAST(turn + 1 AS INTEGER) AS turn_id, md5(array_to_string({words_sql('text')}, ' ')) AS anchor_md5 FROM conversations")
def a2_anchor_text(spark, sf):
    t = _anchored(spark, sf)
    anchor = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in alignment.ANCHORS), F.lit(""))
    return t.select("project_id", "turn_id", F.md5(anchor.cast("binary")).alias("anchor_md5"))
