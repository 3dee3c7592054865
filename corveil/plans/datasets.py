"""Queries on sources, training rows of several kinds, prompt rewriting, batch algebra and token primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corveil.functions import images
from corveil.operators import batch, formatting, losses, metrics, sampling
from corveil.plans.catalog import query, table
from corveil.sources import readers, sinks


@query("""SELECT 'nation' AS config, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region""")
def configured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_configs, src_resolve: the tables that a list of names asks for, where the dataset lies."""
    there = ("customer", "nation", "region")
    out = None
    for name in readers.config_names(" nation, region ,", there):
        d = spark.read.parquet(readers.resolved(f"{sf_dir}/{name}.parquet", [])).agg(F.lit(name).alias("config"), F.count(F.lit(1)).alias("n"))
        out = d if out is None else out.unionByName(d)
    return out


@query("""SELECT doc_id, md5(text) AS prompt_md5, source AS response FROM documents""")
def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_sft_parquet: prompt and response taken from nested columns by their paths."""
    nested = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.struct(F.col("text").alias("question")).alias("extra"), F.col("source").alias("answer")).alias("row"))
    d = readers.sft_rows(nested, "row.extra.question", "row.answer", keep=["doc_id"])
    return d.select("doc_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "response")


@query("""SELECT conv_id, count(*)::INTEGER AS n, count(*) FILTER (WHERE role = 'user')::INTEGER AS users, 0 AS tools FROM conversations GROUP BY conv_id""")
def multiturn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_multiturn: messages and tools as arrays; no tools are an empty list."""
    p = formatting.fold_messages(table(spark, sf_dir, "conversations"))
    d = readers.multiturn_rows(p.withColumnRenamed("prompt", "messages"), keep=["conv_id"])
    return d.select("conv_id", F.size("messages").alias("n"), F.size(F.filter("messages", lambda m: m["role"] == "user")).alias("users"), F.size("tools").alias("tools"))


@query("""WITH p AS (SELECT user_id, arg_max(event_id, value * 1000000 + event_id) AS c, arg_min(event_id, value * 1000000 + event_id) AS r FROM events GROUP BY 1)
SELECT user_id, c AS chosen, r AS rejected, 8 AS n, CASE WHEN user_id % 2 = 0 THEN 4 ELSE 5 END::INTEGER AS kept, 8 AS mask_n FROM p""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_pairs, prj_pair_stack: prompt with the chosen and with the rejected response, padded or cut to one length."""
    order = F.col("value") * 1000000 + F.col("event_id")
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", order).alias("chosen"), F.min_by("event_id", order).alias("rejected"))
    prompt = F.array_repeat(F.lit(7), F.when(F.col("user_id") % 2 == 0, 2).otherwise(3))
    s = batch.pair_stack(prompt, F.array(F.col("chosen").cast("int"), F.lit(9)), F.array(F.col("rejected").cast("int")), 8)
    d = p.select("user_id", "chosen", "rejected", s.alias("s"))
    ids, mask = F.col("s.input_ids"), F.col("s.attention_mask")
    return d.select("user_id", F.element_at(ids[0], F.size(F.filter(mask[0], lambda m: m == 1)) - 1).cast("long").alias("chosen"), F.element_at(ids[1], F.size(F.filter(mask[1], lambda m: m == 1))).cast("long").alias("rejected"), F.size(ids[0]).alias("n"), F.size(F.filter(mask[0], lambda m: m == 1)).alias("kept"), F.size(mask[1]).alias("mask_n"))


@query("""SELECT p_partkey, (p_size % 5 + 2)::INTEGER AS trained, CASE WHEN p_size % 7 > 1 THEN p_size % 7 - 1 ELSE 0 END::INTEGER AS leading FROM part""")
def sft_loss_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_sft_loss_mask: zeros on the prompt but for its last token, and on the response's last."""
    a, b = (F.col("p_size") % 7).cast("int"), (F.col("p_size") % 5 + 3).cast("int")
    mask = batch.sft_loss_mask(a, b, a + b)
    # An empty prompt leaves all of the response but its last token; else the prompt's last token counts as well.
    total = F.aggregate(mask, F.lit(0), lambda t, m: t + m) - F.when(a > 0, 1).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", total.alias("trained"), (F.array_position(mask, 1) - 1).cast("int").alias("leading"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://x.org/' || doc_id WHEN 1 THEN '/data/' || doc_id WHEN 2 THEN '/root/images/' || doc_id ELSE '/lists/' || doc_id END AS path, 'B' AS kind FROM documents""")
def media_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_image_path, prj_bbox_format: addresses and absolute paths as they are, others under a root, else beside the list."""
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    x = F.when(k == 0, F.concat(F.lit("https://x.org/"), i)).when(k == 1, F.concat(F.lit("/data/"), i)).otherwise(i)
    path = F.when(k == 2, formatting.media_path(x, "/root/images/", "/lists/a.jsonl")).otherwise(formatting.media_path(x, "", "/lists/a.jsonl"))
    d = formatting.with_box_format(table(spark, sf_dir, "documents"), "B")
    return d.select("doc_id", path.alias("path"), F.col("bbox_format").alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'plain ' || event_type ELSE CASE event_id % 4 WHEN 0 THEN 'user' || chr(10) WHEN 1 THEN '<|im_start|>user' || chr(10) ELSE '<|start_header_id|>user<|end_header_id|>' || chr(10) END || event_type END AS prompt, event_id % 4 <> 3 AS cut FROM events""")
def stripped_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_strip_prefix: from the earliest user mark on, without the assistant's mark at the end."""
    k, e = F.col("event_id") % 4, F.col("event_type")
    body = F.when(k == 0, F.concat(F.lit("system\nbe kind\n user\n"), e, F.lit("\nassistant:  "))).when(k == 1, F.concat(F.lit("<|im_start|>system x<|im_start|>user\n"), e, F.lit("<|im_start|>assistant\n")))
    body = body.when(k == 2, F.concat(F.lit("sys<|start_header_id|>user<|end_header_id|>\n"), e, F.lit("<|start_header_id|>assistant<|end_header_id|>"))).otherwise(F.concat(F.lit("plain "), e))
    text, cut = formatting.strip_system(body)
    return table(spark, sf_dir, "events").select("event_id", formatting.strip_assistant(text).alias("prompt"), cut.alias("cut"))


@query("""SELECT doc_id, 'ID ' || doc_id || ' of ' || upper(source) || ': ' || replace(lang, 'e', 'E') || '.' AS prompt FROM documents""")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_jinja, prj_doc_map: a template over the row's columns with filters; an unknown column is an error."""
    t = formatting.rendered("ID {{ doc_id }} of {{source|upper}}: {{ lang | regex_replace('e', 'E') }}.", table(spark, sf_dir, "documents").columns)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("prompt"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Find it. Give boxes. Thanks' WHEN 1 THEN 'Find it. Give a point.' ELSE 'Find ' || event_type END AS prompt FROM events""")
def rewritten_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_rewrite_coords: a prompt's instruction on coordinates replaced by the model family's, by reward type."""
    k = F.col("event_id") % 3
    x = F.when(k == 0, "Find it. Output the bounding box(es) in a JSON array format: [x] one element per object in the array. Thanks").when(k == 1, "Find it. Output the point in a JSON array format: [x]").otherwise(F.concat(F.lit("Find "), "event_type"))
    kind = F.when(k == 0, "grounding").when(k == 1, "clicking").otherwise("numeric")
    rules = {"grounding": ("Output the bounding box(es) in a JSON array format:", "array.", "Give boxes."), "clicking": ("Output the point in a JSON array format:", "origin at top-left.", "Give a point.")}
    return table(spark, sf_dir, "events").select("event_id", formatting.rewrite_instruction(x, kind, rules).alias("prompt"))


@query("""SELECT (SELECT count(*) FROM documents) AS rows_in, 2 AS model_columns, 3 AS reward_columns, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 2) AS readable""")
def split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_gen_split, flt_bad_image: the model's columns apart from the reward's; media whose first bytes are no image's go."""
    k = F.col("doc_id") % 3
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(k == 0, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k == 1, F.unhex(F.lit("FFD8FFE000"))).otherwise(F.encode(F.lit("<html>"), "UTF-8")).alias("image"))
    for_model, for_reward = formatting.split_columns(d, ["doc_id", "image"], key="doc_id")
    kept = for_model.filter(formatting.readable_image(F.col("image"))).agg(F.count(F.lit(1)).alias("readable"))
    return for_reward.agg(F.count(F.lit(1)).alias("rows_in"), F.lit(len(for_model.columns)).alias("model_columns"), F.lit(len(for_reward.columns)).alias("reward_columns")).join(F.broadcast(kept))


@query("""WITH n AS (SELECT doc_id, doc_id % 5 AS k, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, CASE WHEN k IN (0, 4) THEN 'png' END AS format, CASE WHEN k IN (0, 4) THEN 1024 END::INTEGER AS width, CASE WHEN k IN (0, 4) THEN (greatest(n, 1) + 1023) // 1024 END::INTEGER AS height, k IN (0, 4) AS whole FROM n""")
def image_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_bad_image: whole texts as the pixels of PNG files; of five one is cut off, one has a flipped bit and one other first bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("k"), images.png_of("text", F.lit(1024)).alias("image"))
    size, place = F.length("image"), F.abs(F.xxhash64("doc_id"))
    cut = F.substring("image", F.lit(1), (F.lit(8) + place % (size - 8)).cast("int"))
    # Any byte behind the signature: a length, a kind, pixels or a checksum.
    at = (F.lit(9) + place % (size - 8)).cast("int")
    byte = F.conv(F.hex(F.substring("image", at, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(1))
    flipped = F.concat(F.substring("image", F.lit(1), at - 1), F.unhex(F.lpad(F.hex(byte), 2, "0")), F.substring("image", at + 1, size))
    other = F.concat(F.encode(F.lit("<html>"), "UTF-8"), "image")
    d = d.withColumn("image", F.when(F.col("k") == 1, cut).when(F.col("k") == 2, flipped).when(F.col("k") == 3, other).otherwise(F.col("image")))
    c = images.checked_images(d, "image", "c")
    whole = images.whole(F.col("c"))
    return c.select("doc_id", F.when(whole, F.col("c.format")).alias("format"), "c.width", "c.height", whole.alias("whole"))


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, i < ceil(n * 0.3) AS share, i < 7 AS whole FROM n WHERE i < ceil(n * 0.3) OR i < 7""")
def sample_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flt_sample_limit: a limit below 1 is a share of the rows, rounded up."""
    d = batch.numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    n = d.count()
    share, whole = (F.col("_idx") < sampling.sample_limit(n, x) for x in (0.3, 7))
    return d.filter(share | whole).select("doc_id", share.alias("share"), whole.alias("whole"))


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT event_id, i BETWEEN 10 AND 499 AND (i - 10) % 3 = 0 AS a, i < 400 AND i % 2 = 0 AS b FROM n WHERE (i BETWEEN 10 AND 499 AND (i - 10) % 3 = 0) OR (i < 400 AND i % 2 = 0)""")
def sliced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bat_slice: start, stop and step as of a list."""
    d = batch.numbered(table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    n = d.count()
    a = batch.sliced(d, n, 10, 500, 3).select("event_id", F.lit(True).alias("a"))
    b = batch.sliced(d, n, None, 400, 2).select("event_id", F.lit(True).alias("b"))
    return a.join(b, "event_id", "full").select("event_id", F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))


@query("""WITH n AS (SELECT part.p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), e AS (SELECT p_partkey, i, e FROM n, range(0, 2) t(e)), k AS (SELECT p_partkey, e, row_number() OVER (PARTITION BY e ORDER BY md5('5:' || e || ':' || i)) - 1 AS k FROM e)
SELECT p_partkey, e::INTEGER AS epoch, k // 20 AS batch, k % 20 AS at FROM k""")
def minibatch_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bat_iter: batches of an epoch, every epoch in an order of its own; rows must divide evenly."""
    d = batch.numbered(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"])
    return batch.minibatches(d, d.count(), 20, 2, seed=5).select("p_partkey", F.col("_epoch").alias("epoch"), F.col("_batch").alias("batch"), F.col("_at").alias("at"))


@query("""WITH n AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_partkey, i * 2 + h AS idx, p_size + h * 2 AS first, p_size + h * 2 + 1 AS last FROM n, range(0, 2) t(h)""")
def unfolded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bat_unfold_cols: the halves of an array column as rows, the others repeated."""
    d = batch.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"])
    d = d.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("p_size") + k).cast("long")))
    return batch.unfold_columns(d, 2, ["x"]).select("p_partkey", F.col("_idx").alias("idx"), F.get("x", 0).alias("first"), F.get("x", 1).alias("last"))


@query("""WITH n AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), k AS (SELECT event_id, event_type, i, n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM n)
SELECT event_id, n - 1 - i AS reversed, event_type, k // 16 AS chunk, k % 16 AS at FROM k""")
def reordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord_reorder, ord_grouper: rows by a permutation; chunks of 16 that don't mix groups, with the place to restore the order by."""
    d = batch.numbered(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"])
    n = d.count()
    back = batch.reorder(d, d.select("_idx", (n - 1 - F.col("_idx")).alias("_new"))).withColumnRenamed("_idx", "reversed")
    chunks = batch.grouped_chunks(batch.ranges(d, "event_id"), "event_type", 16, ["event_id"], "_bucket")
    return back.select("event_id", "reversed").join(chunks.select("event_id", "event_type", F.col("_chunk").alias("chunk"), F.col("_at").alias("at")), "event_id")


@query("""WITH a AS (SELECT p_brand AS category, round(avg((p_size > 25)::INTEGER), 6) AS accuracy FROM part GROUP BY 1) SELECT category, accuracy, row_number() OVER (ORDER BY accuracy DESC, category)::INTEGER AS place FROM a""")
def ranked_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord_acc_desc, ord_alpha_metrics: categories by falling accuracy, equal ones by name."""
    a = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category")).agg(F.round(F.avg((F.col("p_size") > 25).cast("int")), 6).alias("accuracy"))
    # One row a category.
    return metrics.placed(a, "accuracy", "category")


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber % 2 = 1 AND l_quantity > 25)::INTEGER AS differing, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS valid, round(sum(l_quantity) FILTER (WHERE l_linenumber % 2 = 1), 4) AS valid_sum FROM lineitem GROUP BY 1""")
def token_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_token_diff, flt_valid_tokens: masked positions where two token lists differ, and the masked values as rows."""
    rows = F.collect_list(F.struct(F.lit(1).alias("a"), F.when(F.col("l_quantity") > 25, 2).otherwise(1).alias("b"), (F.col("l_linenumber") % 2).alias("m"), F.col("l_quantity").alias("q")))
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    part = lambda c: F.transform("r", lambda x: x[c])
    d = d.select("l_orderkey", part("a").alias("a"), part("b").alias("b"), part("m").alias("m"), part("q").alias("q"))
    diff = d.select("l_orderkey", batch.token_diff(F.col("a"), F.col("b"), F.col("m")).alias("differing"))
    valid = batch.masked_values(d, "q", "m").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("valid"), F.round(F.sum("q"), 4).alias("valid_sum"))
    return diff.join(valid, "l_orderkey", "left").select("l_orderkey", "differing", F.coalesce("valid", F.lit(0)).alias("valid"), "valid_sum")


@query("""WITH x AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS x, (vec_id % 8 + 1)::BIGINT AS k FROM embeddings), m AS (SELECT vec_id, x, k, list_max(x) AS m FROM x), s AS (SELECT vec_id, x, k, m + ln(list_sum(list_transform(x, lambda v: exp(v - m)))) AS z FROM m)
SELECT vec_id, round(x[k] - z, 6) AS logprob, round(z - list_sum(list_transform(x, lambda v: v * exp(v - z))), 6) AS entropy FROM s""")
def token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logprob and entropy primitives: the log-probability of a token and the entropy of its distribution, from logits."""
    x, k = F.slice(F.col("embedding").cast("array<double>"), 1, 8), (F.col("vec_id") % 8).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(losses.logprob(x, k), 6).alias("logprob"), F.round(losses.entropy(x), 6).alias("entropy"))


@query("""WITH t AS (SELECT l_orderkey, l_quantity / 50 AS h, (l_linenumber % 3 <> 0)::INTEGER AS m FROM lineitem), r AS (SELECT sum(h * m) AS s, sum(m) AS n FROM t GROUP BY l_orderkey) SELECT round(sum(s) / sum(n), 8) AS token_mean, round(avg(s), 6) AS row_sum, round(avg(s / (n + 1e-8)), 6) AS row_mean FROM r WHERE n > 0""")
def entropy_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_entropy: the masked mean of entropies, over tokens, by rows' sums and by rows' means."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") / 50).alias("h"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("m"))
    r = d.groupBy("l_orderkey").agg(F.sum(F.col("h") * F.col("m")).alias("s"), F.sum("m").alias("n")).filter("n > 0")
    return r.agg(F.round(F.sum("s") / F.sum("n"), 8).alias("token_mean"), F.round(F.avg("s"), 6).alias("row_sum"), F.round(F.avg(F.col("s") / (F.col("n") + 1e-8)), 6).alias("row_mean"))


@query("""WITH b AS (SELECT lang AS domain, 1 - avg(quality) AS left_ FROM documents JOIN labels USING (doc_id) WHERE lang <> 'fr' GROUP BY 1), w AS (SELECT DISTINCT lang AS domain, 0.25::DOUBLE AS weight FROM documents),
m AS (SELECT w.domain, greatest(0.01, CASE WHEN left_ IS NULL THEN weight ELSE weight + 0.5 * (left_ / sum(left_) OVER () * sum(CASE WHEN left_ IS NOT NULL THEN weight END) OVER () - weight) END) AS weight FROM w LEFT JOIN b USING (domain)) SELECT domain, round(weight / sum(weight) OVER (), 8) AS weight FROM m""")
def curriculum_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """smp_curriculum: a sampler's weights moved by what a batch has left to learn in each domain."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"))
    seen = docs.filter("domain <> 'fr'").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    out = sampling.curriculum(docs.select("domain").distinct().withColumn("weight", F.lit(0.25)), seen, "domain", "quality")
    return out.select("domain", F.round("weight", 8).alias("weight"))


@query("""SELECT event_id, user_id, coalesce(value, 0) AS value, NULL::DOUBLE AS score, 'a' AS part FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, 0, value, 'b' FROM events WHERE event_id % 2 = 1""")
def united_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prj_rollout_pack, bat_concat: rows of several outputs, extra fields null where one lacks them."""
    e = table(spark, sf_dir, "events")
    a = e.filter("event_id % 2 = 0").select("event_id", "user_id", "value", F.lit("a").alias("part"))
    b = e.filter("event_id % 2 = 1").select("event_id", F.col("value").alias("score"), F.lit("b").alias("part"))
    d = a.unionByName(b, allowMissingColumns=True)
    return d.select("event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("value"), "score", "part")


@query("""SELECT p_partkey, p_size AS left_only, p_retailprice AS right_only FROM part""")
def joined_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_union_cols: two column sets row by row; a shared column that differs is an error."""
    d = batch.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"])
    out = batch.union_columns(d.select("_idx", "p_partkey", F.col("p_size").alias("left_only")), d.select("_idx", "p_partkey", F.col("p_retailprice").alias("right_only")))
    return out.select("p_partkey", "left_only", "right_only")


@query("""SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events""")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_distinct: the distinct keys of a table, each counted by its own distinct rows."""
    e = table(spark, sf_dir, "events")
    return e.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


@query("""SELECT doc_id, 'generate_until' AS request_type, md5(text) AS input_md5, source AS target, (source = 'src0')::INTEGER AS correct FROM documents""")
def sample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snk_wandb_df, prj_process_docs: logged samples as a flat table of the columns that their request type has."""
    logged = table(spark, sf_dir, "documents").select("doc_id", F.array(F.col("text")).alias("arguments"), F.array(F.lit("src0")).alias("filtered_resps"), F.col("source").alias("target"))
    d = sinks.sample_frame(logged, "generate_until")
    return d.select("doc_id", "request_type", F.md5(F.col("input").cast("binary")).alias("input_md5"), "target", (F.col("prediction") == F.col("target")).cast("int").alias("correct"))
