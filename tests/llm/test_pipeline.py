import __spark_entry__ as entry
import corpus_pipeline


def test_pipeline_stages(spark):
    sf_dir = entry.SMOKE_DIR
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "near_dedup", "mix_sources", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        assert after.count() <= docs.count()
        docs = spark.createDataFrame(after.toPandas(), docs.schema)
    assert docs.count() > 0


def test_queries_are_registered():
    for n in range(1, 11):
        assert any(name.startswith(f"op{n}_") for name in entry.queries())
    assert "pipeline" in entry.queries()


def test_pipeline_to_the_end(spark):
    """Ids of what is left decode to texts of the documents, and an odd table goes through as well."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from larkspur.llm.byte_bpe import read_ranks

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{entry.SMOKE_DIR}/documents.parquet").collect()}
    found = corpus_pipeline.run(spark, entry.SMOKE_DIR).collect()
    assert len(found) > 50
    for r in found:
        assert r["ids"] == own.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pipeline_edge_rows(spark):
    docs = spark.read.parquet(f"{entry.SMOKE_DIR}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "a", 0), (5, None, "en", "a", 0), (5, "same row", "en", "a", 8), (5, "same row", "en", "a", 8)], docs.schema)
    for given in (docs.union(odd).selectExpr("*", "'x' AS _toxic", "'y' AS _quality"), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            after = stage(spark, given, entry.SMOKE_DIR)
            given = spark.createDataFrame(after.collect(), after.schema)
        assert "ids" in given.columns
