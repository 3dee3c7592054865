"""Queries on formatting, curation filters, joins, set operations and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.functions import text as T
from corveil.operators import batch, formatting, sampling
from corveil.plans.catalog import query, table
from corveil.sources import readers, sinks


@query("""
SELECT source, avg(quality)::DOUBLE AS mean_quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source
""")
def offline_eval_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_offline_eval: mean of the row scores by data source."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return labels.join(docs, "doc_id").groupBy("source").agg(F.avg("quality").alias("mean_quality"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT conv_id, count(*)::INTEGER AS n_messages, string_agg(role, '|' ORDER BY turn) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS prompt_md5 FROM conversations GROUP BY conv_id
""")
def format_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_normalize_prompt, bat_fold: each conversation as an ordered list of messages."""
    p = formatting.fold_messages(table(spark, sf_dir, "conversations"))
    p = p.withColumn("prompt", formatting.normalize_prompt(F.col("prompt"), F.lit("")))
    joined = lambda c: F.array_join(F.transform("prompt", lambda m: m[c]), "|" if c == "role" else "\n")
    return p.select("conv_id", F.size("prompt").alias("n_messages"), joined("role").alias("roles"), F.md5(joined("content").cast("binary")).alias("prompt_md5"))


@query("""
SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> ''), '') AS question FROM conversations GROUP BY conv_id
""")
def first_user_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_choose_question: the question is that of the extra info, else the first user message."""
    p = formatting.fold_messages(table(spark, sf_dir, "conversations"))
    return p.select("conv_id", formatting.choose_question(F.lit(None).cast("string"), F.col("prompt")).alias("question"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations),
k AS (SELECT *, NOT (a = 1 AND role = 'system') AND NOT (z = 1 AND role = 'assistant') AS keep FROM n)
SELECT conv_id, coalesce(count(*) FILTER (WHERE keep), 0)::INTEGER AS n_messages,
  md5(coalesce(string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE keep), '')) AS rendered_md5 FROM k GROUP BY conv_id
""")
def drop_system_trailing_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_chat_render: role-capitalised lines without a first system and a last assistant message."""
    p = formatting.fold_messages(table(spark, sf_dir, "conversations")).withColumn("prompt", formatting.trim_ends(F.col("prompt")))
    return p.select("conv_id", F.size("prompt").alias("n_messages"), F.md5(formatting.render(F.col("prompt")).cast("binary")).alias("rendered_md5"))


@query("""
WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer, row_number() OVER w - 1 AS history FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, history::INTEGER AS history, md5(text) AS question_md5, md5(answer) AS answer_md5 FROM n WHERE role = 'user' AND next_role = 'assistant'
""")
def explode_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_explode_turns: one row per user and assistant pair with the number of messages before."""
    d = formatting.explode_turns(table(spark, sf_dir, "conversations"))
    return d.select("conv_id", "turn", "history", F.md5(F.col("question").cast("binary")).alias("question_md5"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN printf('sample_%06d', row_number() OVER (ORDER BY doc_id) - 1) ELSE 'd' || doc_id END AS id FROM documents
""")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_sample_id: blank ids become sample_ and the absolute row number."""
    d = batch.numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    given = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return d.select("doc_id", formatting.sample_id(given, F.col("_idx")).alias("id"))


@query("""
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(p_name || '/' || p_type || ' #', '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'unnamed') AS file_name FROM part
""")
def sanitize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_sanitize: names that are safe as file names."""
    return table(spark, sf_dir, "part").select("p_partkey", T.sanitize(F.concat("p_name", F.lit("/"), "p_type", F.lit(" #")), "unnamed").alias("file_name"))


@query("""
SELECT doc_id, lower(coalesce(nullif(regexp_extract(source || CASE WHEN doc_id % 2 = 0 THEN '/x.JPG' ELSE '' END, '([.][^./]+)$', 1), ''), '.png')) AS suffix,
  'images/' || lang || '/' || source || '/' || printf('%08d', doc_id) || '_' || doc_id || '.png' AS path FROM documents
""")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_suffix, snk_image: suffixes and relative paths of exported media."""
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "/x.JPG").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.suffix(name).alias("suffix"), sinks.image_path(F.col("lang"), F.col("source"), F.col("doc_id"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))


@query("""
WITH n AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, source, lang FROM n WHERE k <= 5 AND i >= 10 AND i < 800
""")
def slice_limit_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_slice, flt_limit_split: rows 10 to 799, of these the first 5 of each source and language of the whole."""
    d = batch.numbered(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["doc_id"])
    k = F.row_number().over(W.partitionBy("source", "lang").orderBy("doc_id"))
    return d.withColumn("k", k).filter("k <= 5 and _idx >= 10 and _idx < 800").select("doc_id", "source", "lang")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_resume, join_resume_anti, set_except: rows that aren't processed yet."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
WITH n AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT event_id, user_id FROM n WHERE i % 4 = 1 AND i < 5000
""")
def rank_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_rank_stride: every fourth row from the second below an absolute stop."""
    d = batch.numbered(table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"])
    return batch.stride(d, 1, 4, 5000).select("event_id", "user_id")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS shard FROM documents")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snk_rollout_shards: a shard for every 100 samples."""
    d = batch.numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return d.select("doc_id", sinks.shard_of(F.col("_idx"), 100).alias("shard"))


@query("""
WITH s AS (SELECT source FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 40 AND avg(n_chars) >= 2000 AND NOT bool_and(coalesce(quality, 0) = 1))
SELECT doc_id, source FROM documents JOIN s USING (source)
""")
def dataset_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_dataset_heuristic: sources with enough rows, large enough on average, and not all of one kind."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    kept = d.join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("size"), F.bool_and(F.coalesce("quality", F.lit(0)) == 1).alias("binary"))
    return d.join(kept.filter("n >= 40 and size >= 2000 and not binary"), "source", "left_semi").select("doc_id", "source")


@query("""
SELECT doc_id, (len(string_split(text, ' ')) * 1.5)::DOUBLE AS tokens FROM documents WHERE len(string_split(text, ' ')) * 1.5 <= 300
""")
def overlong_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_overlong, fn_space_tokens: rows whose estimated tokens are within the limit."""
    tokens = (F.size(F.split("text", " ")) * 1.5).alias("tokens")
    return table(spark, sf_dir, "documents").select("doc_id", tokens).filter("tokens <= 300")


@query("""
WITH a AS (SELECT doc_id, quality, toxic, '{"relevance_filter":"' || (quality = 0)::VARCHAR || '","ambiguous_filter":"false","language_filter":"' || (toxic = 1)::VARCHAR || '","reason":"x"}' AS j FROM labels)
SELECT doc_id, (j->>'relevance_filter' = 'true' OR j->>'ambiguous_filter' = 'true' OR j->>'language_filter' = 'true') AS filtered FROM a
""")
def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_question_flags: rows whose filter answer has a flag that is the string true."""
    flag = lambda c: F.when(c, "true").otherwise("false")
    answer = F.concat(F.lit('{"relevance_filter":"'), flag(F.col("quality") == 0), F.lit('","ambiguous_filter":"false","language_filter":"'), flag(F.col("toxic") == 1), F.lit('","reason":"x"}'))
    return table(spark, sf_dir, "labels").select("doc_id", formatting.question_filtered(answer).alias("filtered"))


@query("""
SELECT doc_id, 'type ' || (doc_id % 4) AS kind, 'T' || doc_id AS normalized_ground_truth FROM labels WHERE quality = 1
""")
def answer_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_answer_keep: the kept rows of an answer filter with their normalised truth and type."""
    keep = F.when(F.col("quality") == 1, "true").otherwise("false")
    answer = F.concat(F.lit('{"keep":'), keep, F.lit(',"reason":"r","normalized_ground_truth":"T'), F.col("doc_id").cast("string"), F.lit('","type":"type '), (F.col("doc_id") % 4).cast("string"), F.lit('"}'))
    d = table(spark, sf_dir, "labels").select("doc_id", formatting.answer_decision(answer).alias("a"))
    return d.filter("a.keep").select("doc_id", F.col("a.type").alias("kind"), "a.normalized_ground_truth")


@query("""
SELECT doc_id, md5('Q: ' || text || ' | truth: ' || source) AS prompt_md5, length('Q: ' || text || ' | truth: ' || source)::INTEGER AS n FROM documents
""")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_template: placeholders replaced by columns."""
    p = formatting.template("Q: {QUESTION} | truth: {GROUND_TRUTH}", QUESTION=F.col("text"), GROUND_TRUTH=F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(p.cast("binary")).alias("prompt_md5"), F.length(p).alias("n"))


@query("""
SELECT event_id, trim(replace(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE '<image> ' || event_type END, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'q' || event_id END, ''), '<image>', '')) AS question,
  coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END, 'answer ' || user_id) AS answer FROM events
""")
def question_and_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_question_text, prj_true_answer: the first candidate that isn't blank."""
    i = F.col("event_id")
    first = F.when(i % 3 == 0, "  ").otherwise(F.concat(F.lit("<image> "), "event_type"))
    second = F.when(i % 2 != 0, F.concat(F.lit("q"), i.cast("string")))
    true = F.when(i % 5 == 0, "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", formatting.question_text(first, second).alias("question"), F.coalesce(F.nullif(true, F.lit("")), F.concat(F.lit("answer "), F.col("user_id").cast("string"))).alias("answer"))


@query("""
SELECT event_id, CASE WHEN event_id::VARCHAR LIKE '%99%' THEN 'clicking' WHEN event_type = 'click' THEN 'grounding' WHEN event_type LIKE '%view%' THEN 'counting' ELSE 'general' END AS task FROM events
""")
def route_task_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_task_type: by id, by a box in the truth, by a word of the question."""
    truth = F.when(F.col("event_type") == "click", '{"bbox_2d":[1,2,3,4]}').otherwise("")
    kind = formatting.task_type(F.col("event_id").cast("string"), truth, F.col("event_type"), {"99": "clicking"}, {"view": "counting"}, "general")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("task"))


@query("""
SELECT o_orderkey || '_qa' || (i - 1) AS id, ['status', 'priority', 'total'][i] AS question, coalesce([o_orderstatus, o_orderpriority][i], '') AS answer FROM orders, range(1, 4) t(i)
""")
def explode_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_explode_qa: one row per question and answer, missing answers empty."""
    qa = F.arrays_zip(F.array(F.lit("status"), F.lit("priority"), F.lit("total")).alias("q"), F.array("o_orderstatus", "o_orderpriority").alias("a"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(qa).alias("i", "x"))
    return d.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("_qa"), F.col("i").cast("string")).alias("id"), F.col("x.q").alias("question"), F.coalesce("x.a", F.lit("")).alias("answer"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'id' || doc_id ELSE source || '_' || lang || '_' || doc_id END AS id, source AS data_source, 1 AS n_messages, md5(text) AS question_md5, lang AS reward_type, try_cast(CASE WHEN doc_id % 7 = 0 THEN 'bad' ELSE '0.05' END AS DOUBLE) AS tolerance, '' AS ability FROM documents
""")
def format_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_format_row, prj_reward_model: canonical training rows from nested columns."""
    i = F.col("doc_id")
    none = F.lit(None).cast("string")
    row = formatting.format_row(
        F.col("source"), F.col("lang"), i, F.when(i % 2 == 0, F.concat(F.lit("id"), i.cast("string"))), F.col("source"), F.array().cast(formatting.MESSAGES), none, F.lit("rule"), F.col("lang"), F.col("text"), F.col("lang"), F.col("lang"),
        F.when(i % 7 == 0, "bad").otherwise("0.05"),
    )
    d = table(spark, sf_dir, "documents").select("doc_id", row.alias("r"))
    return d.select("doc_id", "r.id", "r.data_source", F.size("r.prompt").alias("n_messages"), F.md5(F.col("r.extra_info.question").cast("binary")).alias("question_md5"), F.col("r.extra_info.reward_type").alias("reward_type"), F.col("r.extra_info.tolerance").alias("tolerance"), "r.ability")


@query("SELECT doc_id, sha256(doc_id || '|' || source || '|' || text) AS doc_hash, md5(text) AS path_md5 FROM documents")
def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_doc_hash, fn_hash."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "source", "text"), 256).alias("doc_hash"), F.md5(F.col("text").cast("binary")).alias("path_md5"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_type, user_id, event_id, value FROM r WHERE k = 1
""")
def latest_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_logs, join_log_replay: the latest logged run of each task."""
    return readers.latest_by(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "event_id").select("event_type", "user_id", "event_id", "value")


@query("""
WITH c AS (SELECT user_id, max(value) AS response FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT event_id, e.user_id, coalesce(response, -1.0::DOUBLE) AS response, response IS NOT NULL AS cached FROM events e LEFT JOIN c ON c.user_id = e.user_id + 1
""")
def cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_cache, flt_cache_split: cached responses, and a default for misses."""
    e = table(spark, sf_dir, "events")
    cache = e.filter("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("response")).withColumn("user_id", F.col("user_id") - 1)
    d = e.select("event_id", "user_id").join(cache, "user_id", "left")
    return d.select("event_id", "user_id", F.coalesce("response", F.lit(-1.0)).alias("response"), F.col("response").isNotNull().alias("cached"))


@query("""
SELECT doc_id, source, CASE WHEN quality IS NULL THEN 'unseen' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS judged FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)
""")
def judge_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_judge_back, join_individual: judged values back on their rows by key."""
    judged = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(judged, "doc_id", "left")
    return d.select("doc_id", "source", F.when(F.col("quality").isNull(), "unseen").when(F.col("quality") == 1, "good").otherwise("bad").alias("judged"))


@query("""
SELECT conv_id, list_aggregate(list(turn ORDER BY turn), 'string_agg', ',') AS turns, count(*) AS n FROM conversations GROUP BY conv_id
""")
def requests_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_doc_requests: requests grouped per document in the order of their index."""
    rows = F.array_sort(F.collect_list("turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(rows, ",").alias("turns"), F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE edges AS (SELECT 'n' || n_nationkey AS task, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'all' FROM region),
up AS (SELECT task, parent, 1 AS depth FROM edges UNION ALL SELECT up.task, edges.parent, depth + 1 FROM up JOIN edges ON up.parent = edges.task)
SELECT task, parent, depth::INTEGER AS depth FROM up
""")
def task_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_hierarchy: every ancestor of every task, by a recursive expansion."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("corveil_nation")
    table(spark, sf_dir, "region").createOrReplaceTempView("corveil_region")
    return spark.sql("""
        WITH RECURSIVE edges AS (
          SELECT concat('n', n_nationkey) AS task, concat('r', n_regionkey) AS parent FROM corveil_nation UNION ALL SELECT concat('r', r_regionkey), 'all' FROM corveil_region
        ), up(task, parent, depth) AS (
          SELECT task, parent, 1 FROM edges UNION ALL SELECT up.task, edges.parent, depth + 1 FROM up JOIN edges ON up.parent = edges.task
        ) SELECT task, parent, depth FROM up
    """)


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS language FROM documents
""")
def choice_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_choice_map, rf_map: a lookup in a map with a default."""
    names = F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(names, "lang"), F.lit("other")).alias("language"))


@query("SELECT source AS name, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT lang FROM documents) GROUP BY 1")
def union_all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_union_all."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("name")).unionByName(d.select(F.col("lang").alias("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT lang AS domain FROM documents EXCEPT SELECT 'en'")
def missing_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_missing_domains: available domains that the weights don't name."""
    configured = spark.createDataFrame([("en",)], "domain string")
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("domain")).distinct().exceptAll(configured)


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'")
def intersect_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_intersect_keys."""
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'click'").select("user_id").intersect(e.filter("event_type = 'view'").select("user_id"))


@query("""
WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark), c AS (SELECT item_id, word, count(*) AS n FROM w GROUP BY 1, 2)
SELECT a.item_id, sum(least(a.n, b.n))::BIGINT AS overlap FROM c a JOIN c b ON a.word = b.word AND b.item_id = a.item_id + 1 GROUP BY a.item_id
""")
def multiset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_multiset_overlap: words that an item shares with the next, each as often as both have it."""
    c = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word")).groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("n"))
    b = c.select((F.col("item_id") - 1).alias("item_id"), "word", F.col("n").alias("m"))
    return c.join(b, ["item_id", "word"]).groupBy("item_id").agg(F.sum(F.least("n", "m")).alias("overlap"))


@query("""
SELECT conv_id, count(DISTINCT role) = count(role) AS all_distinct, list_sort(list(DISTINCT role)) = ['assistant', 'user'] AS same_set FROM conversations GROUP BY conv_id
""")
def distinct_and_equal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_distinct_check, set_equal."""
    roles = F.collect_list("role")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.size(F.array_distinct(roles)) == F.size(roles)).alias("all_distinct"), (F.array_sort(F.array_distinct(roles)) == F.array(F.lit("assistant"), F.lit("user"))).alias("same_set"))


@query("""
SELECT doc_id, source GLOB 'src1*' AS star, source GLOB 's?c[0-4]' AS classes, source GLOB '*[!0-4]' AS negated, (doc_id % 10 < 3) AS in_train FROM documents WHERE source GLOB 'src*'
""")
def glob_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_glob, flt_select_idxs: names by wildcards, and a mask."""
    d = table(spark, sf_dir, "documents").filter(T.globbed(F.col("source"), "src*"))
    return d.select("doc_id", *[T.globbed(F.col("source"), p).alias(n) for n, p in (("star", "src1*"), ("classes", "s?c[0-4]"), ("negated", "*[!0-4]"))], (F.col("doc_id") % 10 < 3).alias("in_train"))


@query("""
WITH q AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT * FROM (VALUES ('de', 8::BIGINT, 0::BIGINT), ('en', 16, 8), ('es', 4, 24), ('fr', 4, 28)) v(lang, quota, first)),
b AS (SELECT (sum(n) // 32)::BIGINT AS batches FROM q), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents),
p AS (SELECT r.lang, doc_id, quota, first, unnest(range(k, quota * batches, n)) AS place FROM r JOIN q ON r.lang = q.lang JOIN t ON t.lang = r.lang, b)
SELECT lang, doc_id, (place // quota)::BIGINT AS batch, (first + place % quota)::BIGINT AS slot FROM p
""")
def domain_quota_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """smp_domain_batch: batches with a quota for each domain, each domain starting over when it ends (unshuffled)."""
    weights = sampling.parse_weights("de:2,en:4,es:1,fr:1")
    return sampling.domain_batches(table(spark, sf_dir, "documents"), "lang", "doc_id", weights, 32, shuffled=False)


@query("""
WITH q AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT * FROM (VALUES ('de', 8::BIGINT, 0::BIGINT), ('en', 16, 8), ('es', 4, 24), ('fr', 4, 28)) v(lang, quota, first)),
b AS (SELECT (sum(n) // 32)::BIGINT AS batches FROM q), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('8:' || doc_id), doc_id) - 1 AS k FROM documents),
p AS (SELECT r.lang, doc_id, quota, first, unnest(range(k, quota * batches, n)) AS place FROM r JOIN q ON r.lang = q.lang JOIN t ON t.lang = r.lang, b)
SELECT lang, doc_id, (place // quota)::BIGINT AS batch, (first + place % quota)::BIGINT AS slot FROM p
""")
def domain_quota_batch_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """smp_domain_batch with hashed order."""
    return sampling.domain_batches(table(spark, sf_dir, "documents"), "lang", "doc_id", sampling.parse_weights("de:2,en:4,es:1,fr:1"), 32, seed=7, epoch=1)


@query("""
WITH c AS (SELECT doc_id AS example, row_number() OVER (ORDER BY ('0x' || left(md5('1234:' || doc_id), 13))::BIGINT, doc_id) - 1 AS at, count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, j, (floor(('0x' || left(md5('1235:' || doc_id), 13))::BIGINT / 4503599627370496.0::DOUBLE * n)::BIGINT + j) % n AS at FROM documents, range(0, 4) t(j), (SELECT max(n) AS n FROM c)),
f AS (SELECT doc_id, example, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS shot FROM s JOIN c ON s.at = c.at WHERE example <> doc_id)
SELECT doc_id, shot::INTEGER AS shot, example FROM f WHERE shot < 3
""")
def few_shot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """smp_fewshot: three examples for each document, never itself."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.few_shot(d, d, "doc_id", 3)


@query("""
WITH w AS (SELECT event_id, value * value AS w, md5('3:' || event_id) AS h FROM events WHERE value > 0), c AS (SELECT event_id, w, sum(w) OVER (ORDER BY h, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(w) OVER () AS total FROM w),
d AS (SELECT k AS draw, ('0x' || left(md5('3:' || k), 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM range(0, 10000) t(k))
SELECT draw, event_id FROM d JOIN c ON u >= (upto - w) / total AND u < upto / total
""")
def weighted_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """smp_pf_ppo: draws with replacement in proportion to a power of the score."""
    return sampling.weighted_draws(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", 10_000, 2.0, 3)
