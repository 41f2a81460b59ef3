"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, fertility, language, lexical_search, line_dedup, near_duplicates, pitman_yor, source_mix, spelling, substring_dedup, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.language_of_documents(spark, docs.select("doc_id", "text", "lang"))
    return out.select("doc_id", language.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents")).drop("spans", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text"))
    out = line_dedup.dedup_lines(docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(~language.held_out("doc_id", 3, 1)))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", language.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mix.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fertility.quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "fallback_share", "token_entropy", "script")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id", 5, 1))
    model = pitman_yor.fit(docs.where("not held_out"))
    out = pitman_yor.score(docs.withColumn("train", ~F.col("held_out")), model)
    return out.select("doc_id", language.held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]{6,}"), 0)).alias("run"))
    # lower() leaves alone what has no capital at all; else only A-Z are lowered
    runs = runs.select("doc_id", F.when(F.col("run") == F.lower("run"), F.col("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("run"))
    h, run = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")), F.col("run")
    at = (h % F.char_length(run)).cast("int")
    words = runs.select(F.when(h % 199 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run).alias("word"))
    return spelling.spelling_variants(spelling.count_words(words, min_chars=6, min_count=5))


#: The contract's rules: host, path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_line_dedup, op4_near_duplicates, op5_toxicity, op6_source_mix, op7_fertility, op8_decontaminate, op9_warc, op10_pitman_yor, op11_lexical_search, op12_spelling_variants, op13_url_filter)}

ORACLE_SQL = {
    "op6_source_mix": r"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS missing,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (
  SELECT missing, s, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY missing, s) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY missing, s),
filled AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, missing, s) AS place,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS share
  FROM totals
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, missing, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(share, place) FILTER (WHERE most >= weight * share) AS share FROM filled),
targets AS (
  SELECT f.missing, f.s, f.source_size, least(f.most, f.weight * l.share) AS target,
         CASE WHEN f.source_size > 0 THEN round(least(f.most, f.weight * l.share) / f.source_size, 9) ELSE 1.0 END AS rate
  FROM filled f, level l),
placed AS (
  SELECT d.doc_id, d.size, d.missing, d.s, t.source_size, t.target, t.rate, floor(t.rate) AS whole,
         (row_number() OVER (PARTITION BY d.missing, d.s ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS i
  FROM sized d JOIN targets t USING (missing, s)),
tried AS (
  SELECT missing, s, k / 32.0::DOUBLE AS phase,
         abs(sum((whole + floor((i + 1) * (rate - whole) + k / 32.0::DOUBLE) - floor(i * (rate - whole) + k / 32.0::DOUBLE))::BIGINT * size) - any_value(target)) AS error
  FROM placed, range(32) r(k) GROUP BY missing, s, k),
best AS (SELECT missing, s, arg_min(phase, (error, phase)) AS phase FROM tried GROUP BY missing, s)
SELECT doc_id, size, source_size, round(p.target, 6) AS target,
       ((whole + floor((i + 1) * (rate - whole) + b.phase) - floor(i * (rate - whole) + b.phase))::BIGINT * size)::BIGINT AS taken
FROM placed p JOIN best b USING (missing, s)
""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
r AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
""",
    "op11_lexical_search": r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE len(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda j: ('0x' || substr(x, j, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM counted, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, sum(k)::BIGINT AS n FROM words WHERE len(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
dropped AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM vocabulary)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM dropped a JOIN dropped b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM dropped a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM vocabulary a JOIN dropped b ON a.word = b.rest),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS place FROM pairs),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN near END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND place = 1),
walk AS (
  SELECT word, word AS here, 0 AS depth FROM formed
  UNION ALL SELECT w.word, f.form, depth + 1 FROM walk w JOIN formed f ON f.word = w.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, depth) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
""",
    "op13_url_filter": r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, arg_max(h || q, len(h || q)) AS rule, arg_max(v, len(h || q)) AS v
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN fits USING (page_id)
""",
}
