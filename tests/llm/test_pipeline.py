"""The pipeline's stages, as run() chains them, against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import plain_spans, prose, table

KINDS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]


def redacted(t):
    out, at = "", 0
    for start, k, stop in plain_spans(t):
        out, at = out + t[at:start] + KINDS[k], max(at, stop)
    return out + t[at:]


def test_run_matches_plain_python(spark, tmp_path, monkeypatch):
    pytest.importorskip("public_tokenizers")
    texts = [(k if k % 3 else None, prose(k, 60 + k)) for k in range(12)] + [(40, prose(41, 80)), (40, prose(42, 80)), (50, prose(50, 70)), (51, prose(50, 70)), (None, prose(50, 70))]
    texts += [(None, f"{prose(60, 60)} me@b.org {prose(61, 9)}"), (60, f"{prose(62, 60)} 10.0.0.1"), (1, None), (None, ""), (None, "short"), (70, " \n")]
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    seen, own = {}, corpus_pipeline.stage
    monkeypatch.setattr(corpus_pipeline, "stage", lambda df, name: seen.setdefault(name, own(df, name)))
    corpus_pipeline.run(spark, str(tmp_path))
    rows = {name: [(r.doc_id, r.text) if "text" in df.columns else r for r in df.collect()] for name, df in seen.items()}
    good = [(i, t) for i, t in texts if len((t or "").split()) >= 50]
    assert Counter(rows["quality_rules"]) == Counter(good)
    single = [(i, t) for i, t in good if t != prose(50, 70) or i == 50]
    assert Counter(rows["near_duplicates"]) == Counter(single)
    clean = [(i, redacted(t)) for i, t in single]
    assert Counter(rows["personal_data"]) == Counter(clean)
    mixed = Counter(rows["mixing"])
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    words = lambda c: sum(n * len(t.split()) for (_, t), n in c.items())
    assert abs(words(mixed) - 1.5 * words(Counter(clean))) <= 60
    coded = rows["encoding"]
    assert Counter((r.doc_id, r.n_chars) for r in coded) == Counter((i, len(t)) for i, t in mixed.elements())
    assert all(r.n_pieces == len(r.ids) > 0 for r in coded)


def test_an_empty_table_runs_through(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_whole_texts_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(corpus_pipeline, "piece_model", lambda: b"")
    for module, name in ((corpus_pipeline.quality_rules, "drop_low_quality"), (corpus_pipeline.minhash, "deduplicate"), (corpus_pipeline.sentencepiece_fst, "encode_checked")):
        monkeypatch.setattr(module, name, lambda docs, *a: seen.append(spark.conf.get(key)) or docs.withColumn("ids", F.array(F.lit(1))))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, [(1, "a")]).write.parquet(f"{tmp_path}/documents.parquet")
    docs, was = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.conf.get(key)
    steps = [("q", corpus_pipeline.quality), ("d", corpus_pipeline.deduplicate), ("e", corpus_pipeline.encode)]
    try:
        for rows, most in (("10000", "2000"), ("0", "2000"), ("50", "50")):  # 0: no limit
            for _, step in steps:
                spark.conf.set(key, rows)
                step(spark, docs, str(tmp_path))
            assert seen == [most] * 3
            seen.clear()
        spark.conf.set(key, "10000")
        monkeypatch.setattr(corpus_pipeline, "STAGES", steps)
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
        assert spark.conf.get(key) == "10000" and seen == ["2000"] * 3
    finally:
        spark.conf.set(key, was)
