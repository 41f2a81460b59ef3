"""Queries over boards, run ledgers and the item store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import edition, merge, ranking, timeline
from inkwell.plans.tables import AS_OF_BOARD, AS_OF_ITEMS, AS_OF_RUNS, ITEMS_SQL, RUNS_SQL, SNAPSHOTS_SQL, clock, items, runs, snapshots, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


NEW = f"WITH {SNAPSHOTS_SQL}, entered AS (SELECT board, content_hash, min(observed_at) AS first_seen FROM snapshots GROUP BY ALL HAVING min(observed_at) >= TIMESTAMP '2024-01-02')"
RISING = "rising AS (SELECT board, content_hash, arg_min(rank, (observed_at, rank)) - min(rank) AS delta FROM snapshots WHERE observed_at >= TIMESTAMP '2024-01-02' GROUP BY ALL HAVING arg_min(rank, (observed_at, rank)) - min(rank) >= 15)"


@query(f"{NEW} SELECT board, content_hash, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen FROM entered")
def j1_newly_entered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.newly_entered(snapshots(spark, sf_dir), AS_OF_BOARD, 24).select("board", "content_hash", clock("first_seen"))


@query(f"WITH {SNAPSHOTS_SQL}, {RISING} SELECT * FROM rising")
def w2_fast_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.fast_rising(snapshots(spark, sf_dir), AS_OF_BOARD, 24)


@query(f"{NEW}, {RISING} SELECT e.board, e.content_hash, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, delta FROM entered e LEFT JOIN rising r USING (board, content_hash)")
def board_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    rising = timeline.fast_rising(s, AS_OF_BOARD, 24)
    return timeline.newly_entered(s, AS_OF_BOARD, 24).join(rising, ["board", "content_hash"], "left").select("board", "content_hash", clock("first_seen"), "delta")


@query(f"{NEW}, {ITEMS_SQL}, b AS (SELECT 'u' || doc_id AS content_hash, heat, rank FROM items) SELECT content_hash, heat, rank FROM b WHERE content_hash IN (SELECT content_hash FROM entered) ORDER BY coalesce(heat, 0) DESC, coalesce(rank, 999), content_hash LIMIT 20")
def j2_new_entry_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    entered = timeline.newly_entered(snapshots(spark, sf_dir), AS_OF_BOARD, 24)
    own = items(spark, sf_dir).select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("content_hash"), "heat", "rank")
    return timeline.new_entry_items(entered, own)


HEALTH = """SELECT collector, count(*) AS runs, count(*) FILTER (WHERE status = 'ok') AS ok_runs, count(*) FILTER (WHERE status = 'failed') AS failed_runs, sum(coalesce(new_count, 0))::BIGINT AS new_items,
  max(started_at) AS last_run, max(started_at) FILTER (WHERE status = 'ok') AS last_ok, arg_max(error, id) FILTER (WHERE error IS NOT NULL) AS last_error
  FROM runs WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL {h} HOUR AND started_at <= TIMESTAMP '2024-01-31' GROUP BY collector"""


@query(f"WITH {RUNS_SQL}, h AS ({HEALTH.format(h=168)}) SELECT * EXCLUDE (last_run, last_ok), strftime(last_run, '%Y-%m-%d %H:%M:%S') AS last_run, strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_ok FROM h")
def a2_collector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.collector_health(runs(spark, sf_dir), AS_OF_RUNS, 168)
    return out.select("collector", "runs", "ok_runs", "failed_runs", "new_items", "last_error", clock("last_run"), clock("last_ok"))


@query(f"""WITH {RUNS_SQL} SELECT collector, max(id) AS id, arg_max(status, id) AS status, strftime(arg_max(started_at, id), '%Y-%m-%d %H:%M:%S') AS started_at, arg_max(new_count, id) AS new_count,
  (SELECT error FROM runs q WHERE q.id = max(r.id)) AS error FROM runs r GROUP BY collector""")
def j4_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.latest_runs(runs(spark, sf_dir)).select("collector", "id", "status", clock("started_at"), "new_count", "error")


@query(f"""WITH {RUNS_SQL}, d AS ({HEALTH.format(h=24)}), w AS ({HEALTH.format(h=168)}),
  e AS (SELECT DISTINCT 'c' || s_suppkey % 25 AS collector FROM supplier),
  s AS (SELECT e.collector, coalesce(d.runs, 0) AS runs, coalesce(d.ok_runs, 0) AS ok_runs, coalesce(d.failed_runs, 0) AS failed_runs, coalesce(d.new_items, 0) AS new_24h, coalesce(w.new_items, 0) AS new_7d,
    coalesce(d.last_run, w.last_run) AS last_run FROM e LEFT JOIN d USING (collector) LEFT JOIN w USING (collector)),
  t AS (SELECT *, CASE WHEN runs = 0 THEN 'idle' WHEN ok_runs = 0 THEN 'never_ok' WHEN new_7d / 7.0 >= 3 AND new_24h < 0.2 * new_7d / 7.0 THEN 'volume_drop' ELSE 'ok' END AS state FROM s)
  SELECT * EXCLUDE (last_run), strftime(last_run, '%Y-%m-%d %H:%M:%S') AS last_run, CASE state WHEN 'never_ok' THEN 'fail' WHEN 'ok' THEN 'ok' ELSE 'warn' END AS severity FROM t""")
def a4_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), (F.col("s_suppkey") % 25).cast("string")).alias("collector")).distinct()
    out = timeline.diagnose(expected, runs(spark, sf_dir), AS_OF_RUNS)
    return out.select("collector", "runs", "ok_runs", "failed_runs", "new_24h", "new_7d", clock("last_run"), "state", "severity")


@query(f"""WITH {RUNS_SQL}, {ITEMS_SQL}, d AS ({HEALTH.format(h=24)}), w AS ({HEALTH.format(h=168)}), e AS (SELECT DISTINCT 'c' || s_suppkey % 25 AS collector FROM supplier),
  s AS (SELECT e.collector, coalesce(d.runs, 0) AS runs, coalesce(d.ok_runs, 0) AS ok_runs, coalesce(d.new_items, 0) AS new_24h, coalesce(w.new_items, 0) AS new_7d, d.last_error FROM e LEFT JOIN d USING (collector) LEFT JOIN w USING (collector)),
  t AS (SELECT *, CASE WHEN runs = 0 THEN 'idle' WHEN ok_runs = 0 THEN 'never_ok' WHEN new_7d / 7.0 >= 3 AND new_24h < 0.2 * new_7d / 7.0 THEN 'volume_drop' ELSE 'ok' END AS state FROM s),
  a AS (SELECT row_number() OVER (ORDER BY collector) AS pos, CASE state WHEN 'never_ok' THEN collector || ' 过去 24h 全失败' || coalesce(' · ' || last_error, '') ELSE collector || ' 产出骤降:24h=' || new_24h || ' < 20% × 7日日均 ' || printf('%.1f', new_7d / 7.0) END AS alert FROM t WHERE state IN ('never_ok', 'volume_drop')),
  u AS (SELECT count(*) AS n, (epoch(TIMESTAMP '2024-01-31') - epoch(min(fetched_at))) / 3600.0 AS hours FROM items WHERE used_in IS NULL AND kind IN ('article', 'post') AND content IS NOT NULL AND trim(content) <> '')
  SELECT * FROM a UNION ALL SELECT 1000000, count(*) || ' 张网 24h 未调度' FROM t WHERE state = 'idle' HAVING count(*) > 0 UNION ALL SELECT 1000001, n || ' 篇有正文的未读已积压 ' || round_even(hours, 0)::INT || 'h,该出报了' FROM u WHERE hours >= 72 AND n >= 5""")
def a4_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), (F.col("s_suppkey") % 25).cast("string")).alias("collector")).distinct()
    return timeline.alerts(timeline.diagnose(expected, runs(spark, sf_dir), AS_OF_RUNS), timeline.backlog(items(spark, sf_dir), AS_OF_ITEMS))


@query()
def s12_health_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), (F.col("s_suppkey") % 25).cast("string")).alias("collector")).distinct()
    state, left = timeline.diagnose(expected, runs(spark, sf_dir), AS_OF_RUNS), timeline.backlog(items(spark, sf_dir), AS_OF_ITEMS)
    return edition.health_page(state, timeline.alerts(state, left), left, "now").select("text")


@query(f"WITH {ITEMS_SQL} SELECT source, count(*) AS items, count(*) FILTER (WHERE used_in IS NULL) AS unused, count(content) AS with_content FROM items GROUP BY ROLLUP (source)")
def a1_item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.item_stats(items(spark, sf_dir))


@query(f"""WITH {ITEMS_SQL}, f AS (SELECT *, kind IN ('article', 'post') AND content IS NOT NULL AND trim(content) <> '' AS readable FROM items WHERE used_in IS NULL)
  SELECT 'unused' AS what, count(*) AS n, (epoch(TIMESTAMP '2024-01-31') - epoch(min(fetched_at))) / 3600.0 AS hours FROM f
  UNION ALL SELECT 'readable', count(*) FILTER (WHERE readable), (epoch(TIMESTAMP '2024-01-31') - epoch(min(fetched_at) FILTER (WHERE readable))) / 3600.0 FROM f""")
def a3_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.backlog(items(spark, sf_dir), AS_OF_ITEMS)


@query(f"WITH {RUNS_SQL} SELECT strftime(time_bucket(INTERVAL 1 HOUR, started_at), '%Y-%m-%d %H:%M:%S') AS round, count(DISTINCT collector) FILTER (WHERE status = 'ok') AS ok_collectors, count(DISTINCT collector) FILTER (WHERE status = 'ok') >= 5 AS covered FROM runs GROUP BY ALL")
def a15_batch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.batch_coverage(runs(spark, sf_dir), 60).select(clock("round"), "ok_collectors", "covered")


@query(f"WITH {ITEMS_SQL} SELECT content_hash, kind, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM items WHERE fetched_at >= TIMESTAMP '2024-01-28' AND kind IN ('article', 'post') AND used_in IS NULL ORDER BY items.fetched_at DESC, content_hash LIMIT 3000")
def s7_query_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.query_items(items(spark, sf_dir), "2024-01-28 00:00:00", kinds=("article", "post"), limit=3000).select("content_hash", "kind", clock("fetched_at"))


@query(f"WITH {ITEMS_SQL} SELECT content_hash, url FROM items WHERE url LIKE 'http%' AND (content IS NULL OR trim(content) = '') ORDER BY fetched_at DESC, content_hash LIMIT 50")
def f3_missing_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.missing_content(items(spark, sf_dir)).select("content_hash", "url")


@query(f"WITH {ITEMS_SQL} SELECT content_hash, url FROM items WHERE url LIKE 'http%' AND images IS NULL AND regexp_matches(url, 'mp\\.weixin\\.qq\\.com/s|zhihu\\.com/p/') ORDER BY fetched_at DESC, content_hash LIMIT 50")
def f4_missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.missing_images(items(spark, sf_dir)).select("content_hash", "url")


@query(f"""WITH {ITEMS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 400 ORDER BY doc_id) AS seq FROM items),
  j AS (SELECT content_hash, doc_id % 400 AS k, doc_id, rank, heat, content, summary FROM i)
  SELECT k, arg_min(content_hash, doc_id) AS content_hash, (SELECT rank FROM items q WHERE q.doc_id = max(j.doc_id)) AS rank, (SELECT heat FROM items q WHERE q.doc_id = max(j.doc_id)) AS heat,
    length(arg_min(content, doc_id)) AS content_n, length(arg_min(summary, doc_id)) AS summary_n, NOT bool_or(doc_id < 100) AS is_new, count(*) - 1 AS duplicates FROM j GROUP BY k""")
def u1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir).select(F.col("doc_id"), (F.col("doc_id") % 400).alias("k"), F.col("content_hash"), "rank", "heat", "content", "summary")
    old, new = own.where("doc_id < 100").drop("doc_id"), own.where("doc_id >= 100").withColumnRenamed("doc_id", "seq")
    out = merge.upsert_items(old, new, key="k")
    return out.select("k", "content_hash", F.col("rank").cast("long").alias("rank"), "heat", F.char_length("content").cast("long").alias("content_n"), F.char_length("summary").cast("long").alias("summary_n"), "is_new", "duplicates")


@query(f"""WITH {ITEMS_SQL}, n AS (SELECT collector, doc_id % 400 AS k, doc_id, row_number() OVER (PARTITION BY doc_id % 400 ORDER BY doc_id) AS r FROM items WHERE doc_id >= 100),
  o AS (SELECT DISTINCT doc_id % 400 AS k FROM items WHERE doc_id < 100), m AS (SELECT collector, r = 1 AND k NOT IN (SELECT k FROM o) AS new FROM n)
  SELECT collector, count(*) AS total, count(*) FILTER (WHERE new) AS new, count(*) FILTER (WHERE NOT new) AS dup, 'ok' AS status FROM m GROUP BY collector""")
def a5_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir).select("doc_id", (F.col("doc_id") % 400).cast("string").alias("content_hash"), "collector", "rank", "heat", "content", "summary")
    old, new = own.where("doc_id < 100").drop("doc_id"), own.where("doc_id >= 100").withColumnRenamed("doc_id", "seq")
    return merge.ledger(merge.upsert_items(old, new), new)


@query(f"""WITH {SNAPSHOTS_SQL}, k AS (SELECT DISTINCT content_hash, board, date_trunc('day', observed_at) AS observed_at, min(rank) AS rank FROM snapshots GROUP BY ALL)
  SELECT board, count(*) AS n, sum(rank)::BIGINT AS ranks FROM k GROUP BY board""")
def u2_append_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir).select("content_hash", "board", F.date_trunc("day", "observed_at").alias("observed_at"), "rank", "heat")
    half = F.lit("2024-01-15").cast("timestamp")
    first = merge.append_snapshots(s.where("false"), s.where(F.col("observed_at") < half))
    both = merge.append_snapshots(first, s)
    return both.groupBy("board").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"))


@query(f"WITH {ITEMS_SQL} SELECT content_hash, coalesce(used_in, CASE WHEN doc_id % 4 = 1 THEN '2024-01-31-pm' END) AS used_in FROM items")
def u3_mark_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir)
    used = own.where("doc_id % 4 = 1 or doc_id % 10 = 0").select("content_hash", F.lit("2024-01-31-pm").alias("edition"))
    return merge.mark_used(own, used).select("content_hash", "used_in")


@query(f"WITH {ITEMS_SQL} SELECT content_hash, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 100) / 100.0::DOUBLE ELSE score END AS score, CASE WHEN doc_id % 6 = 0 THEN length('new ' || doc_id) ELSE length(content) END AS content_n FROM items")
def u4_sparse_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir)
    changes = own.where("doc_id % 3 = 0").select("content_hash", (F.col("doc_id") % 100 / 100.0).cast("double").alias("score"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(" new "), F.col("doc_id").cast("string"), F.lit(" "))).otherwise("  ").alias("content"))
    return merge.sparse_update(own, changes, ["score", "content"]).select("content_hash", "score", F.char_length("content").cast("long").alias("content_n"))


@query("SELECT doc_id % 50 AS item, 'e' || doc_id % 4 AS edition, arg_max(CASE WHEN quality = 1 THEN 1 ELSE -1 END, doc_id) AS label, max(doc_id) AS created_at FROM labels GROUP BY ALL")
def u5_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("item"), F.concat(F.lit("e"), (F.col("doc_id") % 4).cast("string")).alias("edition"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("label"), F.col("doc_id").alias("created_at"))
    return merge.last_wins(merge.valid_feedback(f)[0], ["item", "edition"], "created_at").select("item", "edition", "label", "created_at")


@query("SELECT vec_id % 100 AS item, max(vec_id) AS updated_at, arg_max(label, vec_id) AS label FROM embeddings GROUP BY ALL")
def u6_embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).alias("item"), F.col("vec_id").alias("updated_at"), "label", "embedding")
    return merge.last_wins(e, ["item"], "updated_at").select("item", "updated_at", "label")


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT *, 0 AS queue FROM items WHERE url LIKE 'http%' AND (content IS NULL OR trim(content) = '') ORDER BY fetched_at DESC, content_hash LIMIT 50),
  b AS (SELECT *, 1 AS queue FROM items WHERE url LIKE 'http%' AND images IS NULL AND regexp_matches(url, 'mp\\.weixin\\.qq\\.com/s|zhihu\\.com/p/') ORDER BY fetched_at DESC, content_hash LIMIT 50)
  SELECT content_hash, min(queue) AS queue FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE kind <> 'video' GROUP BY content_hash""")
def u7_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir)
    return merge.work_queue(ranking.missing_content(own), ranking.missing_images(own), 50).select("content_hash", "queue")


@query(f"WITH {ITEMS_SQL} SELECT content_hash, CASE WHEN length(trim(coalesce(summary, ''))) > length(trim(coalesce(content, ''))) THEN length(trim(summary)) ELSE length(content) END AS n FROM items")
def u8_replace_if_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("content_hash", F.char_length(merge.longer(F.col("content"), F.col("summary"))).cast("long").alias("n"))


@query("""WITH c AS (SELECT s_suppkey AS k, 's' || s_suppkey AS name, s_name AS url, s_nationkey AS weight FROM supplier),
  o AS (SELECT 's' || (n_nationkey * 3) AS name, n_name AS url, n_regionkey AS weight, n_nationkey % 4 = 0 AS disabled FROM nation)
  SELECT c.name, coalesce(o.url, c.url) AS url, coalesce(o.weight, c.weight) AS weight FROM c LEFT JOIN o ON c.name = o.name WHERE coalesce(NOT o.disabled, true)
  UNION ALL SELECT name, url, weight FROM o WHERE NOT disabled AND name NOT IN (SELECT name FROM c)
  UNION ALL SELECT 'r' || r_regionkey, r_name, r_regionkey FROM region""")
def j15_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_name").alias("url"), F.col("s_nationkey").alias("weight"))
    o = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), (F.col("n_nationkey") * 3).cast("string")).alias("name"), F.col("n_name").alias("url"), F.col("n_regionkey").alias("weight"), (F.col("n_nationkey") % 4 == 0).alias("disabled"))
    extra = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("url"), F.col("r_regionkey").alias("weight"))
    return merge.overlay(c, o, extra)


@query(f"WITH {ITEMS_SQL} SELECT kind, source, count(*) AS n, source IN ('weibo','zhihu','bilibili','wechat_mp','toutiao','rss') AS known FROM (SELECT kind, CASE WHEN source IN ('xiaohongshu', 'news') THEN 'blog' ELSE source END AS source FROM items) GROUP BY ALL")
def f13_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir).select("kind", F.when(F.col("source").isin("xiaohongshu", "news"), "blog").otherwise(F.col("source")).alias("source"))
    good, bad = merge.quarantine(own)
    return good.withColumn("known", F.lit(True)).unionByName(bad.drop("reason").withColumn("known", F.lit(False))).groupBy("kind", "source", "known").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS_SQL} SELECT content_hash FROM items WHERE content_hash NOT IN (SELECT content_hash FROM items WHERE doc_id % 4 = 1)")
def f14_drop_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir)
    return merge.drop_used(own, own.where("doc_id % 4 = 1")).select("content_hash")


@query("SELECT id, arg_min(text, o) AS text FROM (SELECT item_id AS id, text, 0 AS o FROM benchmark UNION ALL SELECT doc_id % 300, text, doc_id + 1 FROM documents) GROUP BY id")
def s5_golden_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(0).cast("long").alias("o"))
    more = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("id"), "text", (F.col("doc_id") + 1).alias("o"))
    return merge.append_unseen(seed, more, "id", ["o"]).select("id", "text")
