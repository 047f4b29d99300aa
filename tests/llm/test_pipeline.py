import corpus_pipeline


def test_stages_in_order(spark, tmp_path, odd, nothing):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", nothing)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, now = now, stage(spark, now, folder)
            now.write.parquet(f"{folder}/{k}")
            now = spark.read.parquet(f"{folder}/{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == before.columns
        assert (now.count() > 0) == (name == "odd")


def test_registered_queries_carry_the_contract_columns(spark):
    from folioscope.llm.queries import QUERIES

    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
    found = QUERIES["op7_source_mix"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
