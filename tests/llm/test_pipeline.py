import corpus_pipeline
from ledgerline.llm import byte_bpe, line_dedup, mixing, near_dup, quality_model
from ledgerline.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    good = quality_model.keep_good(docs, quality_model.train(docs, spark.read.parquet(f"{D}/labels.parquet")))
    last = mixing.mix(near_dup.keep_first(line_dedup.dedup(good), near_dup.STAGE))
    assert last.columns == docs.columns
    want = byte_bpe.digest(last).toPandas().sort_values(["doc_id", "ids_sha256"]).reset_index(drop=True)
    got = QUERIES["pipeline"](spark, D).drop("ids").toPandas().sort_values(["doc_id", "ids_sha256"]).reset_index(drop=True)
    assert len(got) and got.equals(want) and len(corpus_pipeline.STAGES) == 5
