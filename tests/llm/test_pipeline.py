import os

import corpus_pipeline
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names, name
        if k < 3:
            assert n * 0.5 < docs.count() <= n
    out = corpus_pipeline.run(spark, DATA)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert out.select("doc_id").distinct().count() <= n
