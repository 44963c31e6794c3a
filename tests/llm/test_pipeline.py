import corpus_pipeline as C
from tests.llm.helpers import DOC, awkward, docs, empty, prose


def test_stages(spark, tmp_path):
    rows = awkward() + [(200 + i, prose(300 + i, 60), "en", f"s{i % 3}", 0) for i in range(30)] + [(300, prose(900, 200) + " and " + prose(901, 40), "en", "s1", 0)]
    d = str(tmp_path)
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, prose(901, 40))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(200, 1, 0), (201, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, now, d)
        if k < len(C.STAGES) - 1:
            assert out.columns == C.COLUMNS, name
        out.write.parquet(f"{d}/{k}")
        now = spark.read.parquet(f"{d}/{k}")
    ids = {r.doc_id for r in now.collect()}
    assert {200 + i for i in range(30)} <= ids | {201, 202} and 300 not in ids and 5 not in ids
    assert {r.doc_id for r in C.run(spark, d).collect()} == ids


def test_empty(spark, tmp_path):
    d = str(tmp_path)
    empty(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert C.run(spark, d).count() == 0 and len(DOC.split(",")) == 5
