"""The pipeline: stages one by one against what their operators say, and as a whole."""

from pyspark.sql import functions as F

import corpus_pipeline
from phasegrid.llm import decontaminate, secret_scan, toxicity
from tests.llm.test_near_copies import survivors


def test_stages_do_what_their_operators_say(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_near_copies", "cut_benchmark", "mask_secrets", "encode"]
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        results.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = results[-1][1]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = results[0]
    model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(before) - ids(after) == {r["doc_id"] for r in before.select("doc_id", "text").collect() if model.score(r["text"] or "") >= 0.5}
    before, after = results[1]
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    assert ids(after) == survivors(rows)
    before, after = results[2]
    assert ids(before) == ids(after)
    dirty = decontaminate.op4(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").count()
    changed = before.select("doc_id", F.col("text").alias("old")).join(after, "doc_id").filter("old <> text").count()
    assert dirty == changed and decontaminate.op4(after, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").count() == 0
    before, after = results[3]
    assert ids(before) == ids(after)
    assert secret_scan.op10(after).filter("spans <> ''").count() == 0
    before, after = results[4]
    texts = {r["doc_id"]: r["h"] for r in before.select("doc_id", F.sha2("text", 256).alias("h")).collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in after.collect()} == texts


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
