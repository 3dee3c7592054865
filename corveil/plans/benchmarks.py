"""Queries on parsers, prompt construction, masks, ordering and benchmark aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.functions import answers, parse
from corveil.functions import text as T
from corveil.operators import batch, formatting, metrics
from corveil.plans.catalog import query, table
from corveil.plans.scoring import BOXES, box_columns


@query(r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props END AS candidate, CASE WHEN event_id % 2 = 0 THEN '[{"k": ' || (event_id % 9) || '}]' END AS fenced FROM events""")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_json_candidate, fn_json_strict, fn_json_fenced."""
    i = F.col("event_id")
    x = F.when(i % 3 == 0, F.col("props")).when(i % 3 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise("{broken")
    k = F.concat(F.lit('[{"k": '), (i % 9).cast("string"), F.lit("}]"))
    y = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), k, F.lit("\n```"))).when(i % 4 == 2, F.concat(F.lit("is "), k, F.lit("."))).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", parse.json_candidate(x).alias("candidate"), parse.json_fenced(y).alias("fenced"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 0.0 ELSE p_size END::DOUBLE AS x1, CASE WHEN p_partkey % 3 = 2 THEN 0.0 ELSE p_size + 10.5 END::DOUBLE AS y2, (p_size + 1)::DOUBLE AS px, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS boxes FROM part""")
def box_and_point_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_bbox_parse, fn_point_parse, fn_literal on boxes."""
    n, k = F.col("p_size"), F.col("p_partkey") % 3
    s = n.cast("string")
    four = F.concat(s, F.lit(", 2, 3, "), (n + 10.5).cast("string"))
    x = F.when(k == 0, F.concat(F.lit("box ["), four, F.lit("]"))).when(k == 1, F.concat(F.lit("("), four, F.lit(")"))).otherwise("nothing")
    p = F.when(k == 0, F.concat(F.lit('[{"point_2d": ['), (n + 1).cast("string"), F.lit(", 5]}]"))).otherwise(F.concat(F.lit("click ("), (n + 1).cast("string"), F.lit(", 5)")))
    b = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('```json\n[{"bbox_2d": [1, 2, 3, '), s, F.lit('], "label": "x"}]\n```'))).otherwise("no")
    four = parse.four_numbers(x)
    return table(spark, sf_dir, "part").select("p_partkey", four[0].alias("x1"), four[3].alias("y2"), parse.point(p)[0].alias("px"), F.coalesce(F.size(parse.boxes(b)), F.lit(0)).cast("int").alias("boxes"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN 4 THEN NULL WHEN 5 THEN 'Z' ELSE NULL END AS choice FROM part""")
def infer_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_choices_from_text, fn_choice_infer, fn_mcq_letter: letters, the article A, texts, refusals, several letters."""
    k = F.col("p_partkey") % 7
    options = parse.choices(F.concat(F.lit("Which?\nA. red "), "p_brand", F.lit("\nB. blue "), "p_brand", F.lit("\n")))
    said = F.when(k == 0, "The answer is A").when(k == 1, F.concat(F.lit("clearly the Blue "), "p_brand", F.lit(" here"))).when(k == 2, "(A)").when(k == 3, "I take B, as said").when(k == 4, "A or B")
    said = said.when(k == 5, "Cannot determine the answer, B").otherwise("neither")
    return table(spark, sf_dir, "part").select("p_partkey", answers.infer_option(said, options).alias("choice"))


@query("""SELECT o_orderkey, o_custkey AS first, o_orderkey AS last, o_custkey % 2 = 1 OR contains(o_custkey::VARCHAR, '1') AS binary_yes, least(greatest(o_custkey, 1), 10)::DOUBLE AS clamped FROM orders""")
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_int_extract, fn_judge_parse."""
    c = F.col("o_custkey").cast("string")
    first, last = parse.integers(F.concat(F.lit("n="), c, F.lit(" of 77, id "), F.col("o_orderkey").cast("string")))
    said = F.concat(F.when(F.col("o_custkey") % 2 == 1, "1: ").otherwise(""), c)
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first"), last.alias("last"), parse.judge_binary(said).alias("binary_yes"), parse.judge_number(c, 1.0, 10.0).alias("clamped"))


@query("""SELECT event_id, round((event_id % 5) / 5.0, 6)::DOUBLE AS first, round((event_id % 3) / 3.0, 6)::DOUBLE AS second, 'search' AS tool, 'before  after' AS rest FROM events""")
def component_and_tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_mia_component, fn_tool_call."""
    i = F.col("event_id")
    x = F.concat(F.lit("Component 1: "), (i % 5).cast("string"), F.lit("/5\ncomponent 2: "), (i % 3).cast("string"), F.lit("/3"))
    names, rest = parse.tool_calls(F.concat(F.lit('before <tool_call>{"name": "search", "arguments": {"q": "'), i.cast("string"), F.lit('"}}</tool_call> after')))
    m = parse.component_scores(x)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.element_at(m, 1), 6).alias("first"), F.round(F.element_at(m, 2), 6).alias("second"), F.get(names, 0).alias("tool"), rest.alias("rest"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END::INTEGER AS parts, md5(CASE WHEN doc_id % 2 = 0 THEN 'a <image> ' || lang ELSE 'b ' || lang END) AS text_md5 FROM documents""")
def typed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_build_messages, prj_stringify_content, prj_chat_media: text with media marks to typed parts and back."""
    x = F.concat(F.when(F.col("doc_id") % 2 == 0, "a <image> ").otherwise("b "), "lang")
    parts = formatting.typed_parts(x)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("parts"), F.md5(formatting.part_text(parts).cast("binary")).alias("text_md5"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(least(greatest(l_quantity * 20, 0), 1000), 0)::INTEGER AS x1, 1000 AS x2 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)""")
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_bbox_norm, prj_bbox_rescale, fn_coord_convert: to 0-1000, rounded half to even, clamped, corners in order."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    box = formatting.scale_box([F.lit(90.0), F.lit(1.0), F.col("l_quantity"), F.lit(2.0)], F.lit(50.0), F.lit(10.0))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box[0].alias("x1"), box[2].alias("x2"))


@query("""SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END)::BIGINT AS trained, sum(len(string_split(text, ' ')))::BIGINT AS tokens FROM conversations GROUP BY conv_id""")
def loss_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_loss_mask: ones on the assistant's tokens."""
    p = formatting.fold_messages(table(spark, sf_dir, "conversations"))
    mask = F.flatten(F.transform("prompt", lambda m: F.array_repeat(F.when(m["role"] == "assistant", 1).otherwise(0), F.size(F.split(m["content"], " ")))))
    return p.select("conv_id", mask.alias("m")).select("conv_id", F.aggregate("m", F.lit(0).cast("long"), lambda t, x: t + x).alias("trained"), F.size("m").cast("long").alias("tokens"))


@query("""SELECT conv_id, ('Answer the question.' || chr(10) || 'Q: ' || q || chr(10) || 'A:') AS context, letter, choice FROM (SELECT conv_id, min(turn)::VARCHAR AS q FROM conversations GROUP BY conv_id), (VALUES (0, 'yes'), (1, 'no')) v(letter, choice)""")
def choice_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_fewshot_ctx, prj_requests: one request for each choice of a document."""
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").cast("string").alias("q"))
    d = d.withColumn("context", F.concat_ws("\n", F.lit("Answer the question."), F.concat(F.lit("Q: "), "q"), F.lit("A:")))
    return d.select("conv_id", "context", F.posexplode(F.array(F.lit("yes"), F.lit("no"))).alias("letter", "choice"))


@query("""WITH n AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS k FROM documents) SELECT doc_id, k // 16 AS batch, k AS position FROM n""")
def length_sorted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord_collator, ord_reorderer, ord_chunks: longest first, in batches of 16, with the place to restore the order by."""
    d = table(spark, sf_dir, "documents").select("doc_id", (-F.col("n_chars")).alias("key"))
    return batch.numbered(d, ["key", "doc_id"]).select("doc_id", F.floor(F.col("_idx") / 16).alias("batch"), F.col("_idx").alias("position"))


@query("""WITH s AS (SELECT doc_id, source, 'in' || doc_id AS input FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY md5('42' || input), input) AS k FROM s) SELECT doc_id, source FROM r WHERE k <= 25""")
def sampled_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lim_generations: a seeded choice of a fixed number of rows to show, by hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("in"), F.col("doc_id").cast("string")).alias("input"))
    return d.orderBy(F.md5(F.concat(F.lit("42"), "input").cast("binary")), "input").limit(25).select("doc_id", "source")


@query(f"""WITH {BOXES}, s AS (SELECT l_orderkey, inter / greatest((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - inter, 1e-12) AS iou FROM i)
SELECT round(avg(iou), 6) AS mean_iou, round(avg((iou >= 0.5)::INTEGER), 6) AS acc_50, round(avg((iou >= 0.75)::INTEGER), 6) AS acc_75, count(*) AS n FROM s""")
def grounding_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aerialvg: mean IoU and accuracies at 0.5 and 0.75."""
    from corveil.functions.text import iou

    a, b = box_columns()
    d = table(spark, sf_dir, "lineitem").select(iou(a, b).alias("iou"))
    hit = lambda t: F.round(F.avg((F.col("iou") >= t).cast("int")), 6)
    return d.agg(F.round(F.avg("iou"), 6).alias("mean_iou"), hit(0.5).alias("acc_50"), hit(0.75).alias("acc_75"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT event_type, avg((value > 20)::INTEGER) AS acc FROM events GROUP BY 1) SELECT round(avg(acc), 6) AS macro, round((max(CASE WHEN event_type = 'click' THEN acc END) + max(CASE WHEN event_type = 'view' THEN acc END)) / 2, 6) AS two_d, round(max(CASE WHEN event_type = 'purchase' THEN acc END), 6) AS three_d FROM a""")
def paired_source_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cv_bench: averages of sources pivoted into two- and three-dimensional parts."""
    a = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 20).cast("int")).alias("acc"))
    of = lambda t: F.max(F.when(F.col("event_type") == t, F.col("acc")))
    return a.agg(F.round(F.avg("acc"), 6).alias("macro"), F.round((of("click") + of("view")) / 2, 6).alias("two_d"), F.round(of("purchase"), 6).alias("three_d"))


@query("""WITH s AS (SELECT n_regionkey AS domain, c_nationkey AS subject, avg((c_acctbal > 0)::INTEGER) AS acc, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT domain, round(sum(acc * n) / sum(n), 6) AS accuracy, sum(n)::BIGINT AS n FROM s GROUP BY domain UNION ALL SELECT -1, round(sum(acc * n) / sum(n), 6), sum(n)::BIGINT FROM s""")
def weighted_domain_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mmmu_pro: subjects to domains to the whole, weighted by instances."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("domain"))
    s = table(spark, sf_dir, "customer").join(F.broadcast(n), "c_nationkey").groupBy("domain", "c_nationkey").agg(F.avg((F.col("c_acctbal") > 0).cast("int")).alias("acc"), F.count(F.lit(1)).alias("n"))
    rolled = s.rollup("domain").agg(F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("accuracy"), F.sum("n").alias("n"))
    return rolled.select(F.coalesce("domain", F.lit(-1)).alias("domain"), "accuracy", "n")


@query("""WITH k AS (SELECT doc_id, quality, unnest(['q' || quality, 't' || toxic, 'all']) AS skill FROM labels) SELECT skill, count(*) AS n, nullif(round(100.0 * avg((quality = 1)::INTEGER), 6), 0)::DOUBLE AS accuracy FROM k GROUP BY skill""")
def accuracy_by_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mathvista, mmvetv2: exploded skills; an accuracy of 0 is null."""
    skills = F.array(F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string")), F.lit("all"))
    d = table(spark, sf_dir, "labels").select("quality", F.explode(skills).alias("skill"))
    accuracy = F.round(100 * F.avg((F.col("quality") == 1).cast("int")), 6)
    return d.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.nullif(accuracy, F.lit(0.0)).alias("accuracy"))


@query("""SELECT CASE WHEN user_id % 3 = 0 THEN 'mobile' WHEN user_id % 3 = 1 THEN 'desktop' ELSE 'web' END || '_' || CASE WHEN event_type = 'click' THEN 'icon' ELSE 'text' END AS bucket, round(avg((value > 30)::INTEGER), 6) AS accuracy, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'overall', round(avg((value > 30)::INTEGER), 6), count(*) FROM events""")
def platform_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """screenspot: platform by type buckets and the overall accuracy."""
    u = F.col("user_id") % 3
    bucket = F.concat_ws("_", F.when(u == 0, "mobile").when(u == 1, "desktop").otherwise("web"), F.when(F.col("event_type") == "click", "icon").otherwise("text"))
    d = table(spark, sf_dir, "events").select(bucket.alias("bucket"), (F.col("value") > 30).cast("int").alias("hit")).rollup("bucket")
    return d.agg(F.round(F.avg("hit"), 6).alias("accuracy"), F.count(F.lit(1)).alias("n")).select(F.coalesce("bucket", F.lit("overall")).alias("bucket"), "accuracy", "n")


@query("""WITH n AS (SELECT lang, sha256(doc_id || source) AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents), r AS (SELECT lang, k // 1000 AS run, sha256(string_agg(h, '' ORDER BY k)) AS h FROM n GROUP BY 1, 2)
SELECT lang, sha256(string_agg(h, '' ORDER BY run)) AS task_hash FROM r GROUP BY lang""")
def task_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_task_hash: the hash of a task's ordered sample hashes, by way of runs of a thousand."""
    return metrics.ordered_hash(table(spark, sf_dir, "documents"), "lang", "doc_id", F.concat(F.col("doc_id").cast("string"), "source"))


@query("""WITH m AS (SELECT user_id, event_type, greatest(-1, least(1, sum(value / 50) / count(*) * CASE event_type WHEN 'click' THEN 0.5 ELSE -0.25 END)) AS part FROM events GROUP BY 1, 2) SELECT user_id, round(sum(part), 6) AS reward FROM m GROUP BY user_id""")
def multi_rollout_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_multi_rollout: per metric the weighted mean over rollouts, clamped to +-1, then summed."""
    weight = F.when(F.col("event_type") == "click", 0.5).otherwise(-0.25)
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.sum(F.col("value") / 50) / F.count(F.lit(1))).alias("m"))
    return m.groupBy("user_id").agg(F.round(F.sum(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("m") * weight))), 6).alias("reward"))


@query("""WITH d AS (SELECT l_shipdate::DATE AS day, sum(l_quantity) AS tokens, sum(l_extendedprice) / 1000 AS secs FROM lineitem GROUP BY 1) SELECT day::VARCHAR AS day, round(secs * 1000 / tokens, 6) AS ms_per_token, round(tokens / (secs * 8), 6) AS throughput FROM d""")
def timing_and_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_timing, agg_throughput."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("tokens"), (F.sum("l_extendedprice") / 1000).alias("secs"))
    return d.select(F.col("day").cast("string").alias("day"), F.round(F.col("secs") * 1000 / F.col("tokens"), 6).alias("ms_per_token"), F.round(F.col("tokens") / (F.col("secs") * 8), 6).alias("throughput"))


@query("""WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), g AS (SELECT DISTINCT array_to_string(w[k : k + 7], ' ') AS gram FROM w, range(1, 100000) t(k) WHERE k <= len(w) - 7),
d AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), e AS (SELECT doc_id, array_to_string(w[k : k + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 6))) AS k FROM d))
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e JOIN g USING (gram))""")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_decontam, an extension of the stub: documents that share no eight-word run with a benchmark item."""
    def runs(df: DataFrame, key: str, of: Callable[[Column], Column]) -> DataFrame:
        # The words are worked out once a text: within the lambda over places they would be once a place.
        places = lambda w: F.sequence(F.lit(1), F.size(w) - 7)
        found = T.let(lambda w: F.when(F.size(w) >= 8, F.transform(places(w), lambda k: of(F.slice(w, k, 8)))), F.split(F.lower("text"), " "))
        return df.select(key, F.explode(found).alias("run"))

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    # Hashes tell which documents are worth comparing, the words themselves decide.
    some = runs(docs, "doc_id", F.xxhash64).join(runs(items, "item_id", F.xxhash64).select("run").distinct(), "run", "left_semi").select("doc_id").distinct()
    words = lambda run: F.array_join(run, " ")
    hit = runs(docs.join(some, "doc_id", "left_semi"), "doc_id", words).join(runs(items, "item_id", words).select("run").distinct(), "run", "left_semi").select("doc_id").distinct()
    return docs.select("doc_id", "source").join(hit, "doc_id", "left_anti")


@query("""WITH m AS (SELECT DISTINCT event_type AS data_source, var, name || '@' || n || CASE WHEN name IN ('best', 'maj') THEN '/mean' ELSE '' END AS metric, name, n FROM events, (VALUES ('acc'), ('reward'), ('len')) v(var), (VALUES ('mean'), ('std'), ('best'), ('maj'), ('worst')) w(name), (VALUES (2), (8), (16)) x(n) WHERE NOT (event_type = 'view' AND var = 'acc'))
SELECT data_source, var, metric, CASE WHEN n = 16 AND name IN ('mean', 'best', 'maj') AND var = CASE WHEN data_source = 'view' THEN 'reward' ELSE 'acc' END THEN 'val-core' ELSE 'val-aux' END AS section FROM m""")
def validation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_val_section: core are the mean, best and maj metrics at the largest N of acc, or of reward where a source has no acc."""
    d = table(spark, sf_dir, "events").select(F.col("event_type").alias("data_source")).distinct()
    each = lambda *v: F.explode(F.array(*map(F.lit, v)))
    d = d.select("data_source", each("acc", "reward", "len").alias("var")).filter("not (data_source = 'view' and var = 'acc')").withColumn("name", each("mean", "std", "best", "maj", "worst")).withColumn("n", each("2", "8", "16"))
    metric = F.concat("name", F.lit("@"), "n", F.when(F.col("name").isin("best", "maj"), "/mean").otherwise(""))
    return metrics.validation_sections(d.select("data_source", "var", metric.alias("metric")))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ', ' || p_brand), '[!-/:-@\[-`{-~]', '', 'g'), '[0-9]', '', 'g') AS exact, (lower(p_name) = lower(p_type))::INTEGER AS hit FROM part""")
def exact_match_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_exact_match: lower case without punctuation and digits."""
    return table(spark, sf_dir, "part").select("p_partkey", parse.exact_match_text(F.concat("p_name", F.lit(", "), "p_brand")).alias("exact"), (F.lower("p_name") == F.lower("p_type")).cast("int").alias("hit"))
