import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


def test_run_equals_its_stages_and_each_decision_takes_effect(spark, sf, tmp_path):
    from vistaframe.llm.decontam import find_hits
    from vistaframe.llm.simhash import Wider, near_duplicates
    from vistaframe.llm.toxicity import learn, score_toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and after.schema == docs.schema
        ids = sorted(r[0] for r in after.select("doc_id").collect())
        if name == "toxicity":
            bad = score_toxicity(docs, learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("score >= 0.5")
            assert ids == sorted({r[0] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in bad.collect()})
        if name == "near_dedup":
            assert ids == sorted({r["component_id"] for r in near_duplicates(docs, wider=Wider()).collect()})
        if name == "decontamination":
            bad = find_hits(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where(F.size("hits") > 0)
            assert ids == sorted({r[0] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in bad.collect()})
        if name == "secrets":
            assert ids == sorted(r[0] for r in docs.select("doc_id").collect())
            assert not after.where(F.col("text").rlike("[0-9a-f]{32,}")).count()
        docs, kept[name] = after, len(ids)
    assert 0 < kept["secrets"] <= kept["near_dedup"] < kept["toxicity"]
    out = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_null_and_repeated_ids_lose_no_unrelated_text(spark, sf, tmp_path):
    """Every stage judges rows; packing gives each row that is left its pieces."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    texts = [" ".join(f"{c}{i}" for i in range(50)) for c in "pqrstu"]
    item = next(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r["text"].split()) >= 12)
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[0]), (None, f"{texts[4]} {item}"), (9, f"{texts[5]} {item}"), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "secrets":
            left = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert sorted(left, key=str) == sorted([(8, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, None)], key=str)
    assert sorted(str(r["doc_id"]) for r in docs.where("start = 0").collect()) == ["7", "7", "8", "9", "None"]
