import corpus_pipeline

from tessera.llm import jaccard, secrets

DATA = "/root/testdata"


def test_stages(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "secret_scan", "mixing", "sentencepiece"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, d).cache()
        assert kept.columns == docs.columns
        if name == "jaccard_join":
            assert jaccard.jaccard_links(kept).where("n_links > 0").count() == 0 and kept.count() < before.count()
        if name == "secret_scan":
            assert kept.count() == before.count() and secrets.scan(kept).where("n_assign + n_hex + n_access > 0").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, kept, d)
    assert out.count() == kept.count() and out.where("n_tokens > 0").count() == kept.count()


def test_run_and_edges(spark, odd_documents):
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").count() > 0
    kept = odd_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"{DATA}/sf0.001")
        assert kept.columns == odd_documents.columns
    assert kept.where("text is null").count() == 2


def test_empty_table(spark, no_documents):
    kept = no_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"{DATA}/sf0.001")
        assert kept.columns == no_documents.columns
    assert corpus_pipeline.STAGES[-1][1](spark, kept, f"{DATA}/sf0.001").count() == 0
