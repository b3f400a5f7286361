"""The queries of this package's operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import articles, chat, chunks, compaction, decontaminate, jaccard, langid, neighbours, runs, secrets, sentencepieces, tokenfiles, toxicity
from .common import table

#: The id that ends each document in the token files.
END_ID = 2


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), END_ID)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.conversations(chat.from_turns(turns)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.by_document(table(spark, sf_dir, "documents"))


def op11_compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.document_plan(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find(runs.with_repeats(table(spark, sf_dir, "documents"))))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.extract(table(spark, sf_dir, "pages"))


ALL = (
    op1_neighbours, op2_secret_scan, op3_token_files, op4_decontamination, op5_toxicity,
    op6_jaccard_join, op7_language_id, op8_sentencepiece, op9_chat_format, op10_substring_dedup,
    op11_compaction_plan, op12_periodic_runs, op13_main_text,
)
QUERIES = {f.__name__: f for f in ALL}

# --- SQL ------------------------------------------------------------------------------------------

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

_OP4 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
  b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
  bw AS (SELECT item_id, m, array_to_string(w[i + 1 : i + m], ' ') AS s FROM (SELECT *, unnest(range(len(w) - m + 1)) AS i FROM b)),
  dw AS (SELECT r, m, i, array_to_string(w[i + 1 : i + m], ' ') AS s FROM (SELECT r, w, m, unnest(range(len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
  h AS (SELECT r, i, m, item_id FROM dw JOIN bw USING (m, s)),
  p AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM h) GROUP BY r),
  t AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
  FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""

_OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
  x AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
  g AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM x WHERE len(s) > 0 GROUP BY list_sort(s)),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
  q AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
  l AS (SELECT a, b FROM q WHERE 100 * c >= 90 * (na + nb - c) UNION SELECT g.doc_id, x.doc_id FROM x JOIN g ON list_sort(x.s) = g.s WHERE x.doc_id <> g.doc_id),
  y AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  z AS (SELECT DISTINCT a AS doc_id, a AS root FROM y UNION SELECT y.b, z.root FROM z JOIN y ON y.a = z.doc_id),
  m AS (SELECT doc_id, min(root) AS root FROM z GROUP BY doc_id)
  SELECT x.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, x.doc_id) AS component_id FROM x LEFT JOIN m USING (doc_id)"""

_SAID = "'\\### Assistant: </turn> ok'"
_ESCAPED = "length(replace(replace(replace({0}, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t'))"
_OP9 = f"""WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}),
  f AS (SELECT *, 13 + {_ESCAPED.format("role")} + length(role) - length(replace(replace(role, ':', ''), chr(10), '')) + {_ESCAPED.format("text")} + 1 AS n FROM c)
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM f GROUP BY conv_id"""

_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)), 4294967295))"""

_OP11 = f"""WITH RECURSIVE d AS (SELECT coalesce(source, '') AS source, doc_id, coalesce(text, '') AS text, doc_id // 2000 AS block, coalesce({_CRC32.format("doc_id")}, 0) AS h FROM documents),
  e AS (SELECT *, least(h % 8, h // 8 % 8) AS slot, h // 64 % 100 < 9 * ((least(h % 8, h // 8 % 8) + block) % 8) AS gone FROM d),
  f AS (SELECT source, block, slot, count(*) AS n, count(*) FILTER (gone) AS g, sum(strlen(text)) AS bytes, count(*) FILTER (NOT gone) AS live_rows, coalesce(sum(strlen(text)) FILTER (NOT gone), 0) AS live_bytes FROM e GROUP BY ALL),
  l AS (SELECT *, 100 * g >= 50 * n AS dirty, row_number() OVER (PARTITION BY source ORDER BY block, slot) AS i FROM f WHERE 100 * g >= 50 * n OR 4 * bytes < 3 * 131072),
  r AS (SELECT source, i, block, slot, live_bytes AS c, block AS fb, slot AS fs FROM l WHERE i = 1
    UNION ALL SELECT l.source, l.i, l.block, l.slot, CASE WHEN c + live_bytes > 131072 THEN live_bytes ELSE c + live_bytes END,
      CASE WHEN c + live_bytes > 131072 THEN l.block ELSE fb END, CASE WHEN c + live_bytes > 131072 THEN l.slot ELSE fs END FROM r JOIN l ON l.source = r.source AND l.i = r.i + 1),
  q AS (SELECT r.source, fb, fs, count(*) AS n_files, sum(live_rows) AS live_rows, sum(bytes) AS bytes, sum(live_bytes) AS live_bytes FROM r JOIN l USING (source, i) GROUP BY ALL HAVING count(*) >= 2 OR bool_or(dirty)),
  o AS (SELECT *, row_number() OVER w - 1 AS k, sum(bytes) OVER w AS upto, sum(bytes) OVER () AS whole FROM q WINDOW w AS (ORDER BY n_files DESC, bytes, source, fb, fs)),
  c AS (SELECT * FROM o WHERE 100 * upto <= 30 * whole),
  m AS (SELECT r.source, r.block, r.slot, c.fb, c.fs FROM r JOIN c ON r.source = c.source AND r.fb = c.fb AND r.fs = c.fs),
  u AS (SELECT source, fb AS block, fs AS slot, n_files, live_rows, bytes, bytes + live_bytes + 4096 * n_files AS cost, k // 4 AS wave FROM c
    UNION ALL SELECT source, block, slot, 1, live_rows, bytes, NULL, NULL FROM f WHERE (source, block, slot) NOT IN (SELECT (source, block, slot) FROM m)),
  s AS (SELECT e.source, coalesce(fb, e.block) AS block, coalesce(fs, e.slot) AS slot, sha256(string_agg(doc_id || ':' || text || chr(10), '' ORDER BY doc_id, text)) AS h
    FROM e LEFT JOIN m ON e.source = m.source AND e.block = m.block AND e.slot = m.slot WHERE NOT gone GROUP BY ALL)
  SELECT u.source, CAST(u.block AS BIGINT) AS block, CAST(u.slot AS BIGINT) AS slot, CAST(n_files AS BIGINT) AS n_files, CAST(live_rows AS BIGINT) AS live_rows, CAST(bytes AS BIGINT) AS bytes,
    CAST(cost AS BIGINT) AS cost, CAST(wave AS BIGINT) AS wave, coalesce(s.h, sha256('')) AS live_sha256 FROM u LEFT JOIN s ON u.source = s.source AND u.block = s.block AND u.slot = s.slot"""

ORACLE_SQL: dict[str, str] = {op11_compaction_plan.__name__: _OP11, op4_decontamination.__name__: _OP4, op6_jaccard_join.__name__: _OP6, op9_chat_format.__name__: _OP9}
