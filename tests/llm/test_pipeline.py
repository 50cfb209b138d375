import zlib
from collections import defaultdict

import corpus_pipeline
from helpers import awkward, empty, lower, near_classes

from groundwork.llm import exact_dedup, mixing, near_dedup, packing, quality, queries


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        if name != "pack":
            assert out.columns == columns
        before = docs.collect()
        if name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            want = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
            assert {r.doc_id for r in rows} == want
        if name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[lower(r.text)].append(r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(max(g) for g in groups.values())
        if name == "near_dedup":
            pairs = [(r.doc_id, r.text) for r in before]
            assert sorted(r.doc_id for r in rows) == sorted(i for (i, _), c in zip(pairs, near_classes(pairs)) if i == c)
        if name == "mix":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before}
        if name == "pack":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
        steps[name] = len(rows)
        docs = spark.createDataFrame(rows, out.schema) if name != "pack" else docs
    assert steps["quality"] > steps["exact_dedup"] > steps["near_dedup"] > steps["mix"] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == steps["pack"]


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, long and empty texts, repeats: every stage works on what the one before it kept; nothing in, nothing out."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (7, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("some", awkward(spark)), ("none", empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        rows = out.collect()
        assert (name == "some") == bool(rows)
        assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
        stage = awkward(spark) if name == "some" else empty(spark)
        for step, f in corpus_pipeline.STAGES[:-1]:
            after = f(spark, stage, f"{tmp_path}/{name}")
            assert after.columns == docs.columns and after.count() <= stage.count()


def test_clean_documents_pass_the_first_stage(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    assert quality.accepted(docs, labels).join(good.select("doc_id"), "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_every_query_is_registered():
    assert sorted(queries.queries()) == sorted(
        ["op1_exact_dedup", "op2_chat_views", "op3_language_model", "op4_best_fit_packing", "op5_neighbours", "op6_mixing", "op7_pii", "op8_sentence_spans", "op9_near_dedup", "op10_quality", "pipeline"]
    )
    assert all(m for m in (exact_dedup, mixing, near_dedup, packing))
