"""The pipeline's stages, each against a plain version on its own input."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as cp
from siftline.llm import packing, quality, site_lines
from siftline.session import scratch_path
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, inputs, outputs = docs.columns, {}, {}
    for name, stage in cp.STAGES:
        inputs[name] = docs
        at = scratch_path(spark, f"test-{name}")
        stage(spark, docs, FOLDER).write.parquet(at)
        outputs[name] = docs = spark.read.parquet(at)
    assert [n for n, _ in cp.STAGES] == [
        "quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing",
    ]
    assert all(outputs[n].columns == names for n, _ in cp.STAGES[:-1])

    first = inputs["quality_classifier"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.score(first, quality.train(first, quality.graded(labels)))
    assert rows(outputs["quality_classifier"]) == rows(scored.filter("keep").select(names))

    duck = duckdb.connect()
    duck.register("documents", inputs["line_dedup"].toPandas())
    want = {r[0]: r[1] for r in duck.execute(f"SELECT doc_id, text FROM ({site_lines.SQL})").fetchall()}
    got = outputs["line_dedup"].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

    pairs = [(r.doc_id, r.text) for r in inputs["ngram_jaccard_join"].collect()]
    kept = sorted(k for k, _, component in plain.near(pairs) if k == component)
    assert sorted(r.doc_id for r in outputs["ngram_jaccard_join"].collect()) == kept

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    pairs = [(r.doc_id, r.text) for r in inputs["benchmark_decontamination"].collect()]
    clean = sorted(r[0] for r in plain.decontaminated(pairs, items) if not r[-1])
    assert sorted(r.doc_id for r in outputs["benchmark_decontamination"].collect()) == clean

    tok = packing.encoder(packing.tokenizer_path()).tokenizer
    lengths = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in inputs["best_fit_packing"].collect()}
    packed = outputs["best_fit_packing"]
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == lengths
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.filter("n > 4096").count() == 0 and full.count() <= -(-sum(lengths.values()) // 4096) + 1
    assert rows(cp.run(spark, FOLDER).drop("sequence_id", "offset")) == rows(packed.drop("sequence_id", "offset"))


def test_stages_keep_odd_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, "k"), (None, "a b", "en", "s", 3, None), (2, "", "en", "s", 0, "k"), (2, "", "en", "s", 0, "k")],
        "doc_id long, text string, lang string, source string, n_chars long, keep string",
    )
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() in (3, 4)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert cp.STAGES[-1][1](spark, docs, FOLDER).count() == 4
