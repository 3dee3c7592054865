"""Sources, sinks, evaluation and streaming on small files."""

import json

import pytest
from pyspark.sql import functions as F

from corveil.operators import judging, responses
from corveil.plans import evaluate, tasks
from corveil.sources import readers, sinks
from corveil.streaming import increments


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_json_lines(spark, tmp_path):
    lines(tmp_path / "rollouts_1.jsonl", [{"id": "a"}, "", "{broken", {"id": "b"}, {"id": "a"}])
    assert sorted(r["id"] for r in readers.processed_ids(spark, str(tmp_path)).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl_strict(spark, str(tmp_path / "rollouts_1.jsonl"), "id string").collect()


def test_several_formats(spark, tmp_path):
    lines(tmp_path / "x.jsonl", [{"a": 1, "b": "p"}])
    spark.createDataFrame([(2,)], "a long").write.parquet(str(tmp_path / "y.parquet"))
    out = readers.multi_file(spark, [str(tmp_path / "x.jsonl"), str(tmp_path / "y.parquet")]).collect()
    assert sorted((r["a"], r["b"] or "") for r in out) == [(1, "p"), (2, "")]
    with pytest.raises(ValueError):
        readers.multi_file(spark, [])


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("train", "é"), ("test", "b"), ("train", "c")], "split string, x string")
    target = str(tmp_path / "out")
    assert sinks.split_jsonl(d, target) == {"train": 2, "test": 1}
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.split_jsonl(d, target)
    assert sinks.split_jsonl(d, target, overwrite=True) == {"train": 2, "test": 1}
    results = spark.createDataFrame([("t", "acc", "none", 0.5, None), ("t", "f1", "none", 0.25, 0.1)], "task string, metric string, filter string, value double, stderr double")
    assert json.loads(sinks.results_json(results))["t"] == {"acc,none": 0.5, "acc_stderr,none": "N/A", "f1,none": 0.25, "f1_stderr,none": 0.1}
    assert "|t|none|acc|0.5000|N/A|" in sinks.markdown_table(results)
    media = spark.createDataFrame([("a/b.bin", bytearray(b"xy")), ("c.bin", None)], "path string, content binary")
    assert sinks.write_media(media, str(tmp_path / "media"), "path", "content").count() == 1 and (tmp_path / "media/a/b.bin").read_bytes() == b"xy"
    samples = spark.createDataFrame([("t", 1, "d", ["a"], ["a"]), ("t", 2, "d", ["a"], ["b"])], "task string, doc_id long, doc string, resps array<string>, filtered_resps array<string>")
    sinks.samples(samples, str(tmp_path / "samples"), ["task", "doc_id"])
    back = {r["doc_id"]: r["resps"] for r in spark.read.json(str(tmp_path / "samples")).collect()}
    assert back == {1: None, 2: ["a"]}


def test_evaluation(spark):
    docs = spark.createDataFrame([(1, "q1", "A"), (2, "q2", "B"), (3, "q3", "C")], "id long, q string, gold string")
    log = spark.createDataFrame([("t", 1, ["(A)"]), ("t", 2, ["(C)"])], "task string, doc_id long, resps array<string>")
    task = evaluate.Task("t", "id", F.col("q"), F.col("gold"), {"acc": lambda r, t: F.coalesce(r == t, F.lit(False))}, {"letter": [responses.take_first, responses.regex(r"\((\w)\)")]})
    r = evaluate.evaluate(task, docs, evaluate.from_log(log)).first()
    assert r["value"] == pytest.approx(1 / 3) and r["samples"] == 3


def test_resumed_stream(spark, tmp_path):
    schema, seen = "id string, n int", []
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        rows = increments.once_each(increments.read_rows(spark, str(source), schema))
        increments.append_to(rows, target, state, lambda d: d.filter("n > 0"), lambda step, m: seen.append(m["rows"])).awaitTermination()

    lines(source / "1.json", [{"id": "a", "n": 1}, {"id": "b", "n": 0}])
    run()
    lines(source / "2.json", [{"id": "a", "n": 1}, {"id": "c", "n": 2}])
    run()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["a", "c"] and sum(seen) == 2


def test_running_coefficient(spark, tmp_path):
    source = tmp_path / "kl"
    lines(source / "1.json", [{"run": "r", "step": 1, "kl": 1.0, "n": 5}])
    lines(source / "2.json", [{"run": "r", "step": 2, "kl": 0.0, "n": 5}])
    rows = increments.read_rows(spark, str(source), "run string, step long, kl double, n long")
    out = increments.running_kl(rows, "run", "step", "kl", 0.2, 0.5, 10.0)
    q = out.writeStream.format("memory").queryName("coefficients").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["step"]: r["coefficient"] for r in spark.table("coefficients").collect()}
    assert got[1] == pytest.approx(0.22) and got[2] == pytest.approx(0.198)


def test_resolved_names_and_prompt_files(spark, tmp_path):
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap/x.txt").write_text(" Judge {QUESTION}\nnow \n")
    assert readers.resolved("x.txt", [str(tmp_path), str(tmp_path / "snap")]) == str(tmp_path / "snap/x.txt") and readers.resolved("s3://b/x", []) == "s3://b/x"
    assert readers.prompt_file(spark, str(tmp_path / "snap/x.txt")) == "Judge {QUESTION}\nnow"
    (tmp_path / "empty.txt").write_text("\n")
    with pytest.raises(ValueError):
        readers.prompt_file(spark, str(tmp_path / "empty.txt"))
    with pytest.raises(FileNotFoundError):
        readers.resolved("x.txt", [])
    with pytest.raises(ValueError):
        readers.config_names("a,b", ["a"])
    assert readers.config_names(None, ["a", "b"]) == ["a", "b"]
    d = spark.createDataFrame([("p", "c", "r"), ("p", None, "r")], "q string, chosen string, rejected string")
    assert [tuple(r) for r in readers.preference_pairs(d, "q").collect()] == [("p", "c", "r")]
    assert readers.multiturn_rows(spark.createDataFrame([(["m"], None)], "messages array<string>, tools array<string>")).first()["tools"] == []


def test_more_sinks(spark, tmp_path):
    sinks.run_args({"b": 1, "a": tmp_path}, str(tmp_path / "args.json"))
    assert list(json.loads((tmp_path / "args.json").read_text())) == ["a", "b"]
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "id long, q string")
    sinks.generated(docs, spark.createDataFrame([(1, ["r"])], "id long, responses array<string>"), "id", str(tmp_path / "gen"))
    assert {r["id"]: r["responses"] for r in spark.read.parquet(str(tmp_path / "gen")).collect()} == {1: ["r"], 2: []}
    sinks.submission(docs, str(tmp_path / "sub"), "id", "q")
    assert sorted((r["questionId"], r["answer"]) for r in spark.read.json(str(tmp_path / "sub")).collect()) == [(1, "x"), (2, "y")]
    cache = str(tmp_path / "cache")
    for rows in ([(1, "a")], [(1, "b"), (2, "c")]):
        sinks.append_cache(spark.createDataFrame(rows, "doc_id long, response string"), cache, "t")
    assert sorted((r["doc_id"], r["response"]) for r in spark.read.parquet(cache).collect()) == [(1, "a"), (2, "c")]
    made = []
    for _ in range(2):
        assert sinks.once(spark, str(tmp_path / "once"), lambda: made.append(1) or docs).count() == 2
    assert made == [1]
    with pytest.raises(KeyError):
        sinks.sample_frame(docs, "nothing")


def test_task_index_and_plugins(spark, tmp_path):
    (tmp_path / "util.py").write_text("def score(doc, result):\n    return len(result)\n\ndef rows(k, n):\n    yield from ((i,) for i in range(k, 10, n))\n")
    (tmp_path / "base.yaml").write_text("dataset: d\noutput_type: generate_until\n")
    (tmp_path / "a.yaml").write_text("include: base.yaml\ntask: a\ntag: [t, u]\noutput_type: multiple_choice\nprocess_results: !function util.score\n")
    (tmp_path / "b.yml").write_text("task: b\ntag: t\n")
    (tmp_path / "g.yaml").write_text("group: g\ntask: [a, b]\n")
    found = tasks.index(str(tmp_path))
    assert set(found.tasks) == {"a", "b"} and set(found.groups) == {"g"} and found.tags == {"t": ["a", "b"], "u": ["a"]}
    c = tasks.config(found.tasks["a"])
    assert c["dataset"] == "d" and c["output_type"] == "multiple_choice" and c["process_results"](None, "xyz") == 3
    assert found.table(spark).count() == 6
    (tmp_path / "c.yaml").write_text("task: b\n")
    with pytest.raises(ValueError, match="twice"):
        tasks.index(str(tmp_path))
    spark.dataSource.register(tasks.Generator)
    d = spark.read.format("generated").options(path=str(tmp_path / "util.py"), function="rows", schema="i long", partitions=3).load()
    assert sorted(r["i"] for r in d.collect()) == list(range(10))
    reward = F.udf(tasks.from_file(str(tmp_path / "util.py"), "score"), "long")
    assert spark.range(1).select(reward(F.lit(""), F.lit("abcd")).alias("s")).first()["s"] == 4
    with pytest.raises(AttributeError):
        tasks.from_file(str(tmp_path / "util.py"), "none")
    r = tasks.Registry("thing")
    r.register("x", "y")(1)
    assert r["x"] == r["y"] == 1
    with pytest.raises(ValueError, match="unknown thing"):
        r["z"]
    with pytest.raises(ValueError, match="twice"):
        r.register("x")(2)


def test_sampler_cursor(spark, tmp_path):
    source, target = tmp_path / "draws", str(tmp_path / "state")
    for k, rows in enumerate(([{"domain": "a", "rows": 7, "size": 10}], [{"domain": "a", "rows": 7, "size": 10}, {"domain": "b", "rows": 1, "size": 5}])):
        lines(source / f"{k}.json", rows)
        increments.cursor(increments.read_rows(spark, str(source), "domain string, rows long, size long"), target, str(tmp_path / "check")).awaitTermination()
    got = {r["domain"]: (r["cursor"], r["epoch"]) for r in spark.read.parquet(f"{target}/step=1").collect()}
    assert got == {"a": (4, 1), "b": (1, 0)}


def test_judging(spark):
    d = spark.createDataFrame([(1, "q", "r", "g"), (2, "q2", "r2", "g2")], "id long, question string, response string, reference string")
    out = judging.judged(d, "binary", "question", "response", "reference", lambda asked: asked.filter("id = 1").select("id", F.lit("1").alias("raw")), "id")
    got = {r["id"]: r["judge"] for r in out.collect()}
    assert got[1]["result"] is True and got[1]["success"] and "Reference: g\n" in got[1]["prompt"] and got[2]["result"] is None and not got[2]["success"]
