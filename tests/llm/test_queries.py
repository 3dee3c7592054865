"""The registered queries over the smallest tables, and the pipeline stage by stage."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from corveil.llm import queries, toxicity
from corveil.llm.common import table

from test_operators import kept_by_brute_force

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": {"page_id", "language", "posterior"},
    "op2_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op3_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op4_media_columns": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op8_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op9_url_filters": {"page_id", "host", "path", "rule", "verdict"},
    "op10_embedding_near_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op11_source_divergence": {"lang", "source", "part", "item", "value", "rank"},
    "op12_lexical_search": {"item_id", "rank", "doc_id", "score"},
    "op13_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}
ROWS = {"pages": ("op1", "op7", "op9"), "documents": ("op3", "op4", "op5", "op6", "op8", "op13"), "embeddings": ("op10",)}


@pytest.fixture(scope="module")
def results(spark):
    return {name: driver.queries()[name](spark, DIR).toPandas() for name in COLUMNS}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, results, name):
    found = results[name]
    assert set(found.columns) >= COLUMNS[name]
    for t, own in ROWS.items():
        if name.split("_")[0] in own:
            assert len(found) == table(spark, DIR, t).count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(results, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = db.sql(driver.oracle_sql()[name]).df()
    found = results[name][list(want.columns)]
    key = [want.columns[0]] if want[want.columns[0]].is_unique else list(want.columns)
    a, b = (d.sort_values(key).reset_index(drop=True) for d in (found, want))
    for c in want.columns:
        assert all(x == (y if isinstance(y, str) else pytest.approx(y, nan_ok=True)) for x, y in zip(a[c], b[c], strict=True)), c


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, table(spark, DIR, "labels")).collect()}
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept.toPandas(), stage(spark, kept, DIR).persist()
        assert kept.columns == columns, name
        after = kept.toPandas()
        assert set(after["doc_id"]) <= set(before["doc_id"])
        if name == "toxicity":
            assert set(after["doc_id"]) == {k for k, v in score.items() if v < 0.5}
        if name == "language_id":
            assert set(after["doc_id"]) == {k for k, t in zip(before["doc_id"], before["text"]) if any(c.isalpha() for c in t)}
        if name == "simhash_near_dedup":
            want = kept_by_brute_force(list(zip(before["doc_id"], before["text"])))
            assert sorted(after["doc_id"]) == sorted(group[0][0] for group in want)
        if name == "mixing":
            assert after["doc_id"].value_counts().max() <= 2
    rows = corpus_pipeline.STAGES[4][1](spark, kept, DIR).toPandas()
    assert (rows["piece"] == 0).sum() == len(after)
    used = rows.groupby("sequence_id")["length"].sum()
    assert used.max() <= 4096 and len(used) <= math.ceil(rows["length"].sum() / 4096) + 1
    assert set(driver.queries()) >= {"pipeline", *COLUMNS}
