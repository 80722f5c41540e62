"""The corpus pipeline from end to end on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_pieces_of_kept_documents_fill_sequences_without_gaps(spark):
    out = corpus_pipeline.run(spark, FOLDER).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.lower("text").alias("text")).collect()}
    kept = out["doc_id"].unique().tolist()
    assert kept and set(kept) <= set(texts) and len({texts[i] for i in kept}) == len(kept)
    for _, pieces in out.sort_values("offset").groupby("sequence_id"):
        ends = pieces["offset"] + pieces["length"]
        assert pieces["offset"].tolist() == [0, *ends.tolist()[:-1]] and ends.max() <= 2048
